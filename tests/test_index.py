"""Ingestion, publication, maintenance and search, end to end."""

from __future__ import annotations

import json
import shutil

import pytest
from pyspark.sql import functions as F

from glyphwood.config import Config, EngineError, impact
from glyphwood.operators import classify, cross_refs, maintenance, parse, publish, routing, search, semantic, tree
from glyphwood.plans import ingest as plans
from glyphwood.functions import text as t
from glyphwood.sources import scratch, vault
from glyphwood.sources.store import Store
from glyphwood.streaming import follow

from tests import samples

CONFIG = Config(
    fallback_chunk_size_lines=10,
    max_section_size_lines=25,
    doc_type_path_mappings={"guide": "a", "report": "b", "flat": "c/"},
    doc_groups={"guide": "manuals"},
    schemas={"guide": ("edition",), "report": ("year", "edition")},
    hierarchy_fields=("doc_group", "doc_type"),
    node_summary_min_words=1,
    root_summary_min_words=1,
    sibling_summary_similarity_max=1.0,
    cross_type_join_fields={"edition": {"guide": "edition", "report": "edition"}},
)


def model(tasks):
    """Fills in summaries that break no rule."""
    text = F.concat(F.lit("Tells alpha beta gamma delta of "), "task_id", F.lit(" and "), F.substring("content", 1, 60))
    meta = F.create_map(F.lit("edition"), F.lit("2"), F.lit("secret"), F.lit("x"))
    return tasks.select("task_id", text.alias("summary"), F.when(F.col("kind") == "root", F.array(F.lit("press"))).alias("topics"), meta.alias("metadata"))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "index"))


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """An index of all samples, made once; tests work on copies."""
    root = str(tmp_path_factory.mktemp("base") / "index")
    src = spark.createDataFrame(list(samples.ALL.items()), "file string, content string")
    report = plans.ingest(Store(spark, root), src, CONFIG, model, date_added="2026-01-01")
    assert report["published"] == 6 and report["rejected"] == 0
    return root, src


@pytest.fixture
def published(spark, base, tmp_path):
    shutil.copytree(base[0], tmp_path / "index")
    return Store(spark, str(tmp_path / "index")), base[1]


def test_publish_and_health(published):
    store, src = published
    leaves = {r.file: r for r in store.table("leaves").collect()}
    assert sorted(leaves) == ["a/guide.md", "a/setext.md", "b/dense.md", "b/paged.md", "c/flat.md", "c/long.md"]
    assert leaves["b/paged.md"].ext == {"year": None, "edition": "2"} and sorted(leaves["b/paged.md"].null_fields) == ["doc_group", "year"]
    assert leaves["a/guide.md"].doc_group == "manuals" and leaves["a/guide.md"].topics == ["press"]
    assert [tuple(r) for r in store.table("aliases").collect()] == [("b/old.md", "a/guide.md")]
    m = parse.source_map(src)
    found = maintenance.doctor(store.table("leaves"), store.table("docs"), CONFIG, store.table("nodes"), m, True)
    assert maintenance.health(found).first().ok
    assert {r.code for r in found.collect()} == {"unknown_grouping", "null_metadata"}
    nodes = {(r.type, tuple(r.path)): r.documents for r in routing.nodes(store.table("leaves"), CONFIG).collect()}
    assert nodes == {("root", ()): 6, ("intermediate", ("manuals",)): 2, ("intermediate", ("unknown",)): 4}


def test_double_ingest_dry_run_and_modify(published):
    store, src = published
    before = store.current()
    again = plans.ingest(store, src, CONFIG, model)
    assert (again["published"], again["rejected"]) == (0, 6)
    at = store.current()
    dry = plans.ingest(store, src, CONFIG, model, "modify", dry_run=True)
    assert dry["published"] == 6 and store.current() == at
    changed = plans.ingest(store, src.filter("file = 'a/guide.md'"), CONFIG, model, "modify")
    assert changed["published"] == 1 and store.table("leaves").count() == 6 and store.table("docs").count() == 6
    assert before != store.current()


def test_failed_publication_changes_nothing(published):
    store, _ = published
    at = store.current()
    bad = store.table("leaves").withColumn("tree_index", F.lit("x/y.json"))
    with pytest.raises(EngineError):
        store.publish({"leaves": bad}, {"mode": "modify"}, lambda s, name: ["leaf_tree_index_path"])
    assert store.current() == at
    with pytest.raises(EngineError):
        store.rollback("nothing")


def test_bad_summaries_are_not_published(store, sources):
    def lazy(tasks):
        said = F.when(F.col("file") == "a/guide.md", "This section describes things.").otherwise(F.concat(F.lit("Tells alpha beta gamma delta of "), "task_id"))
        return tasks.select("task_id", said.alias("summary"), F.array().cast("array<string>").alias("topics"), F.create_map().cast("map<string,string>").alias("metadata"))

    with store.stager() as stage:
        built = plans.build(sources(samples.ALL), CONFIG, stage)
        merged = plans.summarise(built, CONFIG, stage, lazy)
        assert [r.file for r in merged.excluded.collect()] == ["a/guide.md"]
        assert len(merged.retries) == CONFIG.semantic_retry_limit and merged.retries[0] == 8
        assert "generic_this_section" in {r.code for r in merged.findings.collect()}
        assert any("generic_this_section" in r.reasons for r in semantic.retry_tasks(merged.findings).collect())


def test_merge_takes_the_last_result_and_no_more(spark, sources):
    m = parse.source_map(sources({"a/guide.md": samples.GUIDE}))
    docs, nodes = tree.documents(m, CONFIG), tree.build(m, CONFIG)
    rows = [("a_guide:__root__", "r", ["t", None], {"edition": "1"}, "f1", 0, {}), ("a_guide:a_guide_cleaning", "old", None, None, "f1", 1, {"children": "[]"}), ("a_guide:a_guide_cleaning", "new", None, None, "f2", 0, {}), (None, "x", None, None, "f2", 1, {})]
    res = spark.createDataFrame(rows, "task_id string, summary string, topics array<string>, metadata map<string,string>, source string, pos int, extras map<string,string>")
    new_docs, new_nodes = semantic.fold(docs, nodes, semantic.last_results(res))
    assert [(r.heading, r.summary) for r in new_nodes.filter("summary IS NOT NULL").collect()] == [("Cleaning", "new")]
    assert tuple(new_docs.select("root_summary", "topics").first()) == ("r", ["t"])
    assert [tuple(r) for r in semantic.rejected_fields(res).collect()] == [("a_guide:a_guide_cleaning", "children", "f1")]
    semantic.ensure_unmutated(semantic.signature(docs, nodes), semantic.signature(new_docs, new_nodes))
    with pytest.raises(EngineError, match="structure_mutated"):
        semantic.ensure_unmutated(semantic.signature(docs, nodes), semantic.signature(docs, nodes.withColumn("level", F.col("level") + 1)))


def test_batches(sources):
    src = sources(samples.ALL)
    m = classify.substantive(parse.source_map(src), CONFIG)
    docs, nodes = tree.documents(m, CONFIG), tree.build(m, CONFIG)
    queue = semantic.tasks(nodes, docs, src, CONFIG)
    assert queue.filter("kind = 'root'").count() == 6 and queue.filter("kind = 'node'").count() == nodes.count()
    packed = semantic.pack(semantic.numbered(queue, "file", F.col("kind") == "root", "path"), CONFIG)
    made = [json.loads(r.payload) for r in semantic.batches(packed, docs, nodes).orderBy("batch_id").collect()]
    assert [b["batch_id"] for b in made] == [f"batch-{k:03}" for k in range(1, len(made) + 1)]
    assert all(sum(len(d["tasks"]) for d in b["documents"]) <= 12 for b in made)
    paper = next(t for b in made for d in b["documents"] for t in d["tasks"] if t["task_id"] == "a_guide:a_guide_running-the-press_paper")
    assert (paper["line_start"], paper["line_end"]) == (9, 16) and paper["sibling_headings"] == ["Running the press — Overview", "Ink"]
    assert paper["content"].startswith("## Paper")


def test_sync(published, sources):
    store, _ = published
    texts = dict(samples.ALL)
    texts["a/guide.md"] += "One more line.\n"
    texts["c/long.md"] = samples.STUB
    texts["a/new.md"] = samples.FLAT
    del texts["c/flat.md"]
    plan = plans.sync(store, sources(texts), CONFIG, model, dry_run=True)
    assert plan == {"modify": 1, "remove": 2, "ingest": 1, "unchanged": 3, "exclude": 3}
    plans.sync(store, sources(texts), CONFIG, model)
    assert sorted(r.file for r in store.table("leaves").collect()) == ["a/guide.md", "a/new.md", "a/setext.md", "b/dense.md", "b/paged.md"]
    assert plans.sync(store, sources(texts), CONFIG, model, dry_run=True) == {"unchanged": 5, "exclude": 4}


def test_remove_rebuild_rollback(published):
    store, _ = published
    first = store.current()
    with pytest.raises(EngineError, match="not_found"):
        publish.remove(store, ["nope.md"])
    assert publish.remove(store, ["a/guide.md", "nope.md"], dry_run=True)["not_found"] == ["nope.md"] and store.current() == first
    publish.remove(store, ["a/guide.md"])
    assert store.table("leaves").filter("file = 'a/guide.md'").count() == 0
    assert store.table("docs", first).filter("file = 'a/guide.md'").count() == 1
    store.rollback(first)
    assert store.table("leaves").count() == 6
    whole, lost = publish.rebuilt(store.table("docs"), CONFIG)
    assert whole.count() == 6 and lost.count() == 0
    bare = store.table("docs").drop("index_metadata").withColumn("root_summary", F.lit(None).cast("string"))
    assert publish.rebuilt(bare, CONFIG)[1].count() == 6


def test_rebuild_is_lossless(published):
    """The routing table made anew from the trees alone is the one that was published, fields of types and all."""
    store, _ = published
    due = store.table("leaves")
    rows = sorted(map(str, due.collect()))
    assert due.filter(F.map_contains_key("ext", "edition")).count() == 4
    store.publish({"leaves": due.limit(0)}, {"mode": "lost"})
    assert store.table("leaves").count() == 0
    report = publish.rebuild(store, CONFIG)
    assert report["rebuilt"] == 6 and not report["lost"] and ("c/flat.md",) in report["under_unknown"]
    assert sorted(map(str, store.table("leaves").select(due.columns).collect())) == rows
    assert store.table("postings").select("file").distinct().count() == 6


def test_publication_writes_what_it_touches(published, sources):
    """A changed document rewrites its buckets; all others are where they were, and nothing of it is left behind."""
    store, _ = published
    before = store.manifest()
    texts = {"a/guide.md": samples.GUIDE + "More of it.\n"}
    plans.ingest(store, sources(texts), CONFIG, model, "modify")
    after, at = store.manifest(), store.current()
    for name in ("docs", "nodes", "leaves", "postings"):
        moved = {b for b, where in after["tables"][name]["at"].items() if where == at}
        assert len(moved) == 1 and {b: w for b, w in after["tables"][name]["at"].items() if b not in moved} == {b: w for b, w in before["tables"][name]["at"].items() if b not in moved}
    assert store.table("docs").groupBy("file").count().filter("count > 1").count() == 0 and store.table("docs").count() == 6
    assert store.table("docs").filter("file = 'a/guide.md'").first().fingerprint.line_count == 27


def test_answers_envelope_and_references(published, spark):
    store, src = published
    args = (store.table("leaves"), store.table("docs"), store.table("nodes"), src, CONFIG)
    tables = {"aliases": store.table("aliases"), "refs": store.table("cross_refs"), "postings": store.table("postings")}
    asked = spark.createDataFrame([(1, "how is the type washed with lye"), (2, "zebra"), (3, "what does b/old.md say of lye")], "query_id long, text string")
    trail = search.explore(asked, *args, mode="aggregation", stage=scratch.stage, **tables)
    got = {r.query_id: json.loads(r.answer) for r in search.envelope(asked, trail, CONFIG, "aggregation").collect()}
    assert got[1]["status"] in ("ok", "partial") and got[1]["citations"][0]["file"] == "a/guide.md" and got[1]["tree_budget_used"].endswith(" / 75")
    assert got[2]["citations"] == [] and got[2]["confidence"] == "low" and got[2]["citation_verification"] == "not run"
    assert any(w.startswith("alias_resolved: b/old.md -> ") for w in got[3]["warnings"])
    prose = {r.query_id: r.answer for r in search.envelope(asked, trail, CONFIG, "aggregation", prose=True).collect()}[1]
    assert "a/guide.md > Cleaning > lines 24-25" in prose and "Node budget: " in prose
    whole = json.loads(search.answer(asked.filter("query_id = 1"), *args, mode="aggregation", verify=True, stage=scratch.stage, **tables).first().answer)
    assert whole["citation_verification"] == "failed" and whole["confidence"] == "low" and whole["deep_mode"] in (True, False)


def test_routing_descent_reads_top_down(spark):
    rows = [(f"g{k % 3}/d{k}.md", "t", f"g{k % 3}", [], f"word{k} common" if k % 3 else "zebra common", None) for k in range(30)]
    leaves = spark.createDataFrame(rows, "file string, doc_type string, doc_group string, topics array<string>, summary string, tree_index string")
    asked = spark.createDataFrame([(1, "a zebra"), (2, "nothing here")], "query_id long, text string")
    config = CONFIG.with_(hierarchy_fields=("doc_group", "doc_type"))
    way = search.routing_descent(asked, leaves, config, 15)
    seen = sorted((r.query_id, r.depth, tuple(r.path), r.file) for r in way.visited.collect() if r.query_id == 1)
    assert [x[:3] for x in seen] == [(1, 0, ()), (1, 1, ("g0",)), (1, 2, ("g0",)), (1, 2, ("g0",))]
    assert [r.file for r in way.candidates.orderBy("rank").collect()] == ["g0/d0.md", "g0/d12.md"]
    wide = search.routing_descent(asked, leaves, config, 15, "aggregation")
    assert wide.visited.filter("query_id = 2").count() == 15 and {r.query_id for r in wide.exhausted.collect()} == {1, 2}


def test_references_are_followed_once(spark):
    """From what was retrieved, to a node of the same document, to another document, and to nothing."""
    node = lambda file, k, word, leaf=True: (file, f"{file}_{k}", [k], 1, True, f"Part {k}", [f"Part {k}"], word, k + 1, k * 3 + 1, k * 3 + 3, k * 3 + 3, None, None)
    nodes = spark.createDataFrame([node("a.md", 0, "zebra"), node("a.md", 1, "other"), node("a.md", 2, "third"), node("b.md", 0, "zebra"), node("b.md", 1, "none")],
        "file string, node_id string, path array<int>, depth int, is_leaf boolean, heading string, heading_path array<string>, summary string, line int, line_start int, line_end int, block_end int, page_start int, page_end int")
    refs = spark.createDataFrame([("a.md", "a.md_0", "intra", "see part 2", "a.md_2", None), ("a.md", "a.md_0", "inter", "b.md", None, "b.md"), ("a.md", "a.md_0", "inter", "c.md", None, "c.md"), ("a.md", "a.md_0", "intra", "see nothing", None, None)],
        "file string, node_id string, type string, raw string, resolved_node string, resolved_file string")
    text = "\n".join(f"line {n} zebra" for n in range(1, 10))
    src = spark.createDataFrame([("a.md", text), ("b.md", text)], "file string, content string")
    docs = src.select("file", t.fingerprint(F.col("content")).alias("fingerprint"), F.lit(2).alias("schema_version"))
    leaves = spark.createDataFrame([("a.md", "guide", "x", [], "zebra", None), ("b.md", "guide", "x", [], "nothing", None)], "file string, doc_type string, doc_group string, topics array<string>, summary string, tree_index string")
    asked = spark.createDataFrame([(1, "zebra")], "query_id long, text string")
    trail = search.explore(asked, leaves, docs, nodes, src, CONFIG, refs=refs, stage=scratch.stage)
    got = {(r.file, r.node_id): r.via for r in trail.cited.collect()}
    assert got == {("a.md", "a.md_0"): None, ("a.md", "a.md_2"): "a.md_0: see part 2", ("b.md", "b.md_0"): "a.md_0: b.md"}
    assert {(r.code, r.detail) for r in trail.notes.collect()} == {("dangling_reference", "a.md: c.md"), ("unresolved_reference", "a.md: see nothing")}
    assert trail.used.first()._used == 1 + 1 + 1 + 1 + 1  # two roots, two peeks, one jump


def test_search(published, spark):
    store, src = published
    asked = spark.createDataFrame([(1, "how is the type washed with lye"), (2, "the of and"), (3, "zebra")], "query_id long, text string")
    args = (store.table("leaves"), store.table("docs"), store.table("nodes"), src, CONFIG)
    cited = search.search(asked, *args, mode="aggregation").cache()
    best = cited.filter("query_id = 1 AND rank = 1").first()
    assert (best.file, best.node_id, best.line_start, best.line_end) == ("a/guide.md", "a_guide_cleaning", 24, 25)
    assert best.citation == "a/guide.md > Cleaning > lines 24-25" and "lye" in best.text and best.staleness == "current"
    told = {r.query_id: r for r in search.answers(asked, cited).collect()}
    assert [told[k].status for k in (1, 2, 3)] == ["ok", "ambiguous", "no_candidates"]
    assert told[1].confidence in ("high", "partial") and told[3].confidence == "low"


def test_descent_keeps_to_its_budget(published, spark):
    store, _ = published
    nodes = store.table("nodes")
    files = nodes.select("file").distinct()
    found = files.select(F.lit(1).alias("query_id"), F.array(F.lit("alpha")).alias("terms"), "file", F.row_number().over(_order()).alias("rank"))
    total = nodes.count()
    for budget in (1, 5, 9, total):
        way = search.descend(found, nodes, budget, 4)
        assert way.visited.count() == min(budget, total)
        assert way.exhausted.count() == (1 if budget <= total else 0)
    assert search.descend(found, nodes, 999, 1).visited.agg(F.max("depth")).first()[0] == 1


def _order():
    from pyspark.sql import Window

    return Window.orderBy("file")


def test_questions_and_budgets():
    assert CONFIG.budgets() == {"routing_nodes": 15, "tree_nodes": 25, "depth": 4}
    assert CONFIG.budgets("aggregation", deep=True) == {"routing_nodes": 30, "tree_nodes": 150, "depth": 8}
    assert search.classify_question("what is lye", CONFIG) == "single"
    assert search.classify_question("list all inks", CONFIG) == "aggregation"
    assert search.classify_question("guide and report by edition", CONFIG) == "cross_type"
    assert search.classify_question("the of", CONFIG) == "ambiguous"
    with pytest.raises(EngineError, match="homogeneous"):
        search.classify_question("x", Config(), "cross_type")


def test_cross_type_join(published):
    store, _ = published
    got = [tuple(r) for r in search.cross_type_join(store.table("leaves"), CONFIG, "edition").collect()]
    assert got == [("edition", "2", 2, 4)]


def test_cross_refs(sources):
    texts = {"a/x.md": '# One\nSee "Two" and [g](./y.md#s), [h](old.md), [n](none.md).\n# Two\nrefer to section 9\n' + "word " * 30, "a/y.md": samples.FLAT, "a/old.md": "# o\nThis page has moved to [y](y.md).\n"}
    built = plans.build(sources(texts), CONFIG)
    got = {(r.type, r.target): (r.node_id, r.resolved_node, r.resolved_file) for r in plans.references(built).collect()}
    assert got == {
        ("intra", "Two"): ("a_x_one", "a_x_two", None), ("inter", "a/y.md"): ("a_x_one", None, "a/y.md"), ("inter", "a/old.md"): ("a_x_one", None, "a/y.md"),
        ("inter", "a/none.md"): ("a_x_one", None, None), ("intra", "section 9"): ("a_x_two", None, None),
    }
    rate = maintenance.cross_ref_rate(cross_refs.detect(built.source_map, built.nodes, built.docs.select("file"), built.aliases)).first()
    assert (rate.total, rate.resolved, rate.resolution_rate) == (5, 3, 0.6)


def test_migration(published):
    store, _ = published
    leaves = store.table("leaves")
    new = CONFIG.with_(schemas={"guide": ("edition", "size"), "report": ("year",)})
    diff = {r.file: (r.missing, r.obsolete) for r in maintenance.schema_diff(leaves, new).collect()}
    assert diff["a/guide.md"] == (["size"], []) and diff["b/paged.md"] == ([], ["edition"]) and diff["c/flat.md"] == ([], [])
    moved = {r.file: r.ext for r in maintenance.migrate(leaves, new).collect()}
    assert moved["a/guide.md"] == {"edition": "2", "size": None} and moved["b/paged.md"] == {"year": None}
    assert [(x["setting"], x["tier"]) for x in impact(CONFIG, new)] == [("schemas", 2)]
    assert [(x["setting"], x["tier"]) for x in impact(CONFIG, CONFIG.with_(hierarchy_fields=("doc_type",), max_nodes=3))] == [("hierarchy_fields", 4), ("max_nodes", 1)]


def test_config():
    raw = {"schema_version": 2, "vault": {"ingestion_directory": "d", "type": "mixed"}, "chunking": {"max_section_size_lines": "x"}, "ingestion_quality": {"placeholder_word_threshold": 5}, "doc_summary_index": {"hierarchy_fields": ["a", "b"]}}
    made = Config.load(raw)
    assert (made.max_section_size_lines, made.placeholder_word_threshold, made.hierarchy_fields, made.vault_type) == (200, 5, ("a", "b"), "mixed")
    for bad, code in (({"schema_version": 3}, "future_schema"), ({}, "bad_config"), ({"vault": {"ingestion_directory": "d"}, "doc_summary_index": {"hierarchy_fields": []}}, "bad_config")):
        with pytest.raises(EngineError) as e:
            Config.load(bad)
        assert e.value.code == code


def test_doc_types(spark):
    c = Config(doc_type_path_mappings={"x": "./a/", "y": "a/b", "z": ["c", "a/b/d"]})
    df = spark.createDataFrame([("a/q.md",), ("a/b/q.md",), ("a/bb.md",), ("a/b/d/q.md",), ("e.md",), ("c",)], "f string")
    assert [r[0] for r in df.select(c.doc_type(F.col("f"))).collect()] == ["x", "y", "x", "z", None, "z"]


def test_markdown_folder(spark, tmp_path):
    for name, text in {"a/one.md": b"# x\n", "a/Two.MD": b"y\xff", "b.txt": b"no", "node_modules/c.md": b"no", ".hid/d.md": b"no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text)
    got = {r.file: r.content for r in vault.markdown_folder(spark, str(tmp_path)).collect()}
    assert got == {"a/one.md": "# x\n", "a/Two.MD": "y�"}
    found, lost = vault.inputs(vault.markdown_folder(spark, str(tmp_path)), ["a/one.md, nope.md", "zz.txt"])
    assert [r.file for r in found.collect()] == ["a/one.md"] and {(r.name, r.reason) for r in lost.collect()} == {("nope.md", "not_found"), ("zz.txt", "not_markdown")}
    with pytest.raises(EngineError, match="outside_ingestion_dir"):
        vault.inputs(found, ["../x.md"])


def test_paged_and_pdf(spark, tmp_path):
    pages = spark.createDataFrame([("d", 2, "b"), ("d", 1, " a\n"), ("e", 1, None)], "doc string, n int, text string")
    got = {r.file: r.content for r in vault.paged(pages, "doc", "n", "text").collect()}
    assert got["d.md"] == "# d\n\nSource PDF: d.pdf\n\n<!-- page:1 -->\n\n## Page 1\n\na\n\n<!-- page:2 -->\n\n## Page 2\n\nb\n"
    (tmp_path / "x.pdf").write_bytes(b"one|two")
    (tmp_path / "y.PDF").write_bytes(b"three")
    convert = lambda raw: raw.decode().split("|")
    made = {r.file for r in vault.pdf_folder(spark, str(tmp_path), convert).collect()}
    assert made == {"x.md", "y.md"}
    done = spark.createDataFrame([("x.md",)], "file string")
    assert {r.file for r in vault.pdf_folder(spark, str(tmp_path), convert, done).collect()} == {"y.md"}
    assert {r.file for r in vault.pdf_folder(spark, str(tmp_path), convert, done, force=True, limit=1).collect()} == {"x.md"}


def test_html(spark):
    html = '<html><head><title>t</title></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- x --><h1>H &amp; I</h1><p>one<br>two</p><script>z()</script></body></html>'
    df = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    got = {r.file: r.content for r in vault.html_pages(df).collect()}
    assert got == {"pages/page_1.md": "- [A](/a.md)\n\n# H & I\n\none\ntwo\n", "pages/page_2.md": "\n"}


def test_stream(spark, store, tmp_path, sources):
    incoming, state = str(tmp_path / "in"), str(tmp_path / "state")
    sources({"a/guide.md": samples.GUIDE, "b/old.md": samples.REDIRECT}).write.parquet(incoming)

    def run():
        follow.follow(follow.sources_stream(spark, incoming), store, CONFIG, state, model).awaitTermination()
        return store.current()

    first = run()
    assert [r.file for r in store.table("leaves").collect()] == ["a/guide.md"]
    assert run() == first
    sources({"a/guide.md": samples.GUIDE + "More.\n", "c/flat.md": samples.FLAT}).write.mode("append").parquet(incoming)
    assert run() != first
    assert sorted(r.file for r in store.table("leaves").collect()) == ["a/guide.md", "c/flat.md"]
    assert store.table("docs").filter("file = 'a/guide.md'").first().fingerprint.line_count == 27


def test_stream_takes_the_last_version(spark, store, sources):
    rows = [("a/x.md", "# A\nnew", 2), ("a/x.md", "# A\nold", 1), ("a/y.md", "# B\nonly", 1)]
    for order in (rows, rows[::-1]):
        got = follow.changed(spark.createDataFrame(order, "file string, content string, version int"), store)
        assert {r.file: r.content for r in got.collect()} == {"a/x.md": "# A\nnew", "a/y.md": "# B\nonly"}
    with pytest.raises(EngineError, match="no_version"):
        follow.changed(spark.createDataFrame([r[:2] for r in rows], "file string, content string"), store)
