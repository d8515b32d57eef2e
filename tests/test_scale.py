"""What keeps costs in proportion: sources parsed once, frames that are summed up once, classes that Java decides quickly."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from glyphwood import queries
from glyphwood.config import Config
from glyphwood.functions import text as t
from glyphwood.operators import parse, similarity, tree

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["aliases", "sections", "index_findings", "tree_findings", "cross_refs"])
def test_sources_are_parsed_once(spark, name):
    """What looks at parsed sources twice reads them back."""
    scans = queries.QUERIES[name](spark, TABLES).inputFiles()
    assert not any("documents.parquet" in f for f in scans)


def test_frames_run_from_the_start(spark, sources):
    source = parse.source_map(sources({"a.md": "# A\n\nx y\n\n## B\n\nz\n"}))
    plan = tree.build(source, Config())._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "windowspecdefinition" in plan and "unboundedfollowing" not in plan


def test_quick_forms_match_the_same(spark):
    chars = spark.range(0xFFFF).filter("id < 55296 OR id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    forms = [f"[{t.SPACE}]", f"[^{t.SPACE}]", t.ANY, f"[^a-z0-9{t.SPACE}-]", f"[^a-z0-9{t.SPACE}]", "[^a-z0-9-]", f"[^){t.SPACE}]", f"[:{t.SPACE}]"]
    differ = [F.count_if(F.col("c").rlike(f"^{f}") != F.col("c").rlike("^" + t.quick(f))).alias(str(k)) for k, f in enumerate(forms)]
    assert all(t.quick(f) != f for f in forms)
    assert not any(chars.select(*differ).first())
    ends = chars.withColumn("s", F.concat("c", F.lit("a b"), "c"))
    assert ends.filter(t.trim(F.col("s")) != F.regexp_replace("s", rf"^[{t.SPACE}]+|[{t.SPACE}]+\z", "")).count() == 0


@pytest.mark.parametrize("threshold", [0.85, 0.9])
def test_parts_lose_no_pair(spark, threshold):
    """Sets of all sizes, changed by a few words each, against all pairs; texts of common words alone make no candidates."""
    import random

    rng, texts = random.Random(5), []
    for size in [1, 2, 5, 8, 9, 10, 11, 17, 18, 19, 20, 27, 40, 63, 100, 150]:
        base = [f"w{rng.randrange(400)}" for _ in range(size)]
        for _ in range(8):
            kept = [w for w in base if rng.random() > 0.04]
            texts.append(" ".join(kept + [f"v{rng.randrange(400)}" for _ in range(rng.randrange(1 + size // 16))]))
    sets = [set(x.split()) for x in texts]
    due = set()
    for j in range(len(sets)):
        hits = [i for i in range(j) if (round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 4) if sets[i] | sets[j] else 1.0) > threshold]
        due |= {(j, hits[0])} if hits else set()
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    assert {(r.k, r.other) for r in similarity.later_items(rows, [], "k", "text", threshold).collect()} == due and len(due) > 20
    common = spark.createDataFrame([(k, " ".join(f"c{rng.randrange(300)}" for _ in range(120))) for k in range(300)], "k int, text string")
    sets = similarity.classes(common, [], "k", "text")
    assert similarity.by_parts(sets, [], threshold).count() * 20 < similarity.by_rarest(sets, [], threshold).count()
