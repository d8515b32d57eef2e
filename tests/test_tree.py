from __future__ import annotations

import json

from pyspark.sql import functions as F

from glyphwood.config import Config
from glyphwood.operators import parse, semantic, tree, validate

from tests import samples

CONFIG = Config(fallback_chunk_size_lines=10, max_section_size_lines=25, doc_type_path_mappings={"t": ["a", "b", "c"]})


def shown(nodes, file):
    return [(len(r.path), r.level, r.heading, r.line_start, r.line_end) for r in nodes.filter(F.col("file") == file).orderBy("path").collect()]


def made(sources, texts=None, config=CONFIG):
    m = parse.source_map(sources(texts or samples.ALL))
    return m, tree.documents(m, config), tree.build(m, config)


def test_sections(sources):
    _, _, nodes = made(sources)
    assert shown(nodes, "a/guide.md") == [
        (1, 1, "Running the press", None, None), (2, 2, "Running the press — Overview", 5, 8), (2, 2, "Paper", None, None),
        (3, 3, "Paper — Overview", 9, 12), (3, 3, "Sizes", 13, 16), (2, 2, "Ink", 17, 23), (1, 1, "Cleaning", 24, 25),
    ]
    assert shown(nodes, "c/flat.md") == [(1, 1, "Chunk 1", 1, 10), (1, 1, "Chunk 2", 11, 20), (1, 1, "Chunk 3", 21, 24)]
    assert shown(nodes, "c/long.md")[:4] == [(1, 1, "Table", None, None), (2, 2, "Entries", None, None), (3, 3, "Entries — Part 1", 3, 27), (3, 3, "Entries — Part 2", 28, 44)]
    ids = {r.heading: r.node_id for r in nodes.filter("file = 'a/setext.md'").collect()}
    assert ids["Second part"] == "a_setext_the-title-of-it_second-part"
    same = [r.node_id for r in nodes.filter("file = 'a/setext.md' AND heading = 'Same'").orderBy("path").collect()]
    assert same == ["a_setext_the-title-of-it_same", "a_setext_the-title-of-it_same-2"]


def test_preamble_is_split_and_pages_are_known(sources):
    config = CONFIG.with_(page_numbers_in_citations=True, max_section_size_lines=3)
    _, docs, nodes = made(sources, {"a/p.md": "\n".join(f"word {k}" for k in range(7)) + "\n# H\nx\npage 2\ny\n"}, config)
    assert shown(nodes, "a/p.md") == [
        (1, 1, "Preamble", None, None), (2, 2, "Preamble — Part 1", 1, 3), (2, 2, "Preamble — Part 2", 4, 6), (2, 2, "Preamble — Part 3", 7, 7),
        (1, 1, "H", None, None), (2, 2, "H — Part 1", 8, 10), (2, 2, "H — Part 2", 11, 11),
    ]
    assert [(r.page_start, r.page_end) for r in nodes.filter("depth = 2").orderBy("path").collect()] == [(None, None)] * 3 + [(2, 2), (2, 2)]
    assert tuple(docs.select("page_start", "page_end").first()) == (2, 2)


def test_levels_that_skip_and_untitled(sources):
    _, _, nodes = made(sources, {"a/x.md": "### deep\na\n# top\n#### !!!\nb\n## \nc\n"})
    assert [(r.heading, r.path, r.node_id) for r in nodes.orderBy("path").collect()] == [
        ("deep", [0], "a_x_deep"), ("top", [1], "a_x_top"), ("!!!", [1, 0], "a_x_top_n4"), ("(untitled section)", [1, 1], "a_x_top_untitled-section"),
    ]


def test_all_is_valid_and_covered(sources):
    m, docs, nodes = made(sources)
    assert validate.check_trees(docs, nodes, m, CONFIG).collect() == []
    assert {r.coverage_ratio for r in validate.coverage(nodes, m).collect()} == {1.0}
    again = made(sources)[2]
    assert nodes.exceptAll(again).count() == 0 == again.exceptAll(nodes).count()


def test_json(sources):
    _, docs, nodes = made(sources)
    trees = {r.file: json.loads(r.json) for r in tree.to_json(docs, nodes).collect()}
    assert len(trees) == 9

    def walk(children, depth=1):
        for c in children:
            yield depth, c["heading"], c["content_ref"]["lines"] if "content_ref" in c else None
            yield from walk(c["children"], depth + 1)

    assert [(d, h, tuple(r or (None, None))) for d, h, r in walk(trees["a/guide.md"]["children"])] == [(d, h, (a, b)) for d, _, h, a, b in shown(nodes, "a/guide.md")]


def codes(df):
    return sorted((r.code, r.node_id) for r in df.collect())


def test_mutations(sources):
    m, docs, nodes = made(sources, {"a/guide.md": samples.GUIDE})

    def found(bad_nodes=nodes, bad_docs=docs):
        return {c for c, _ in codes(validate.check_trees(bad_docs, bad_nodes, m, CONFIG))}

    assert found() == set()
    inner = F.col("heading") == "Paper"
    sizes = F.col("heading") == "Sizes"
    assert found(nodes.withColumns({"line_start": F.when(inner, 1).otherwise(F.col("line_start")), "line_end": F.when(inner, 2).otherwise(F.col("line_end"))})) == {"non_leaf_with_content_ref"}
    assert "node_id_duplicate" in found(nodes.withColumn("node_id", F.when(sizes, "a_guide_cleaning").otherwise(F.col("node_id"))))
    assert found(nodes.withColumn("node_id", F.when(sizes, "other").otherwise(F.col("node_id")))) == {"node_id_mismatch"}
    assert found(nodes.withColumn("line_end", F.when(sizes, 18).otherwise(F.col("line_end")))) == {"overlapping_leaf_ranges"}
    assert found(nodes.withColumn("line_end", F.when(sizes, 14).otherwise(F.col("line_end")))) == {"uncovered_substantive_lines"}
    assert "leaf_without_content_ref" in found(nodes.withColumns({c: F.when(~sizes, F.col(c)) for c in ("line_start", "line_end")}))
    assert "content_ref_order" in found(nodes.withColumn("line_end", F.when(sizes, 1).otherwise(F.col("line_end"))))
    assert "content_ref_out_of_bounds" in found(nodes.withColumn("line_end", F.when(F.col("heading") == "Cleaning", 99).otherwise(F.col("line_end"))))
    bad_hash = F.struct(F.col("fingerprint.line_count").alias("line_count"), F.lit("zz").alias("sha256"))
    assert found(bad_docs=docs.withColumn("fingerprint", bad_hash)) == {"fingerprint_sha256", "fingerprint_mismatch"}
    stale = F.struct(F.col("fingerprint.line_count").alias("line_count"), F.lit("0" * 64).alias("sha256"))
    assert found(bad_docs=docs.withColumn("fingerprint", stale)) == {"fingerprint_mismatch"}
    assert found(bad_docs=docs.withColumn("doc_type", F.lit(None).cast("string"))) == {"root_doc_type_missing"}
    assert "level_invalid" in found(nodes.withColumn("level", F.when(sizes, 0).otherwise(F.col("level"))))
    assert "heading_missing" in found(nodes.withColumn("heading", F.when(~sizes, F.col("heading"))))


def test_cross_ref_rules(spark):
    refs = spark.createDataFrame([("f", "n", "intra", "r", "t"), ("f", "n", "x", None, " ")], "file string, node_id string, type string, raw string, target string")
    assert {c for c, _ in codes(validate.check_cross_refs(refs))} == {"cross_ref_type", "cross_ref_raw", "cross_ref_target"}


def test_cross_ref_fields(spark, sources):
    """Absent fields are told of with the trees; blank ones with the references."""
    m, docs, nodes = made(sources, {"a/guide.md": samples.GUIDE})
    refs = spark.createDataFrame([("f", "n", "intra", "r", "t", " "), ("f", "o", "inter", "r", "t", None)], "file string, node_id string, type string, raw string, target string, resolved_file string")
    assert codes(validate.check_cross_refs(refs)) == [("cross_ref_resolved_file_type", "n")]
    due = [("cross_ref_resolved_file_type", "n"), ("cross_ref_resolved_node_missing", "n"), ("cross_ref_resolved_node_missing", "o")]
    assert codes(validate.check_trees(docs, nodes, m, CONFIG, refs)) == due
    whole = refs.withColumn("resolved_node", F.lit(None).cast("string"))
    assert codes(validate.check_cross_ref_fields(whole)) == []


def greedy(sizes, most, chars):
    out, batch, n, total = [], 1, 0, 0
    for s in sizes:
        if n >= most or (n and total + s > chars):
            batch, n, total = batch + 1, 0, 0
        out.append(batch)
        n, total = n + 1, total + s
    return out


def test_packing_over_many_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(semantic, "BLOCK", 16)
    monkeypatch.setattr(semantic, "LINK", 4)
    rng = random.Random(5)
    sizes = [rng.choice([0, 5, 5, 9, 40, 120, 31]) for _ in range(700)]
    queue = spark.createDataFrame([(f"k{i:04}", s) for i, s in enumerate(sizes)], "task_id string, size long").repartition(7)
    config = CONFIG.with_(max_content_characters_per_semantic_batch=100)
    got = semantic.pack(semantic.numbered(queue, "task_id"), config).orderBy("task_id").collect()
    assert [r.pos for r in got] == list(range(700))
    assert [r.batch for r in got] == greedy(sizes, 12, 100)


def test_packing_of_nothing(spark):
    queue = spark.createDataFrame([], "task_id string, size long")
    assert semantic.pack(semantic.numbered(queue, "task_id"), CONFIG).count() == 0
