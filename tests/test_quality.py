from __future__ import annotations

import random

from pyspark.sql import functions as F

from glyphwood.config import Config
from glyphwood.functions import text as t
from glyphwood.operators import quality, similarity

GOOD = "Sheets are dampened overnight, pressed between boards, and hung in pairs on ropes until the fibres relax fully."


def codes_of(spark, summary, heading="Paper", root=False):
    df = spark.createDataFrame([(summary, heading, root)], "s string, h string, r boolean")
    return df.select(quality.codes(F.col("s"), F.col("h"), F.col("r"), Config()).alias("c")).first().c


def test_rules(spark):
    assert codes_of(spark, GOOD) == []
    assert codes_of(spark, None) == codes_of(spark, "   ") == ["summary_missing"]
    assert codes_of(spark, "Too short by far.") == ["too_short"]
    assert codes_of(spark, "word " * 61 + "alpha beta gamma") == ["too_long"]
    assert codes_of(spark, GOOD, root=True) == ["too_short"]
    assert codes_of(spark, "This section describes " + GOOD) == ["generic_this_section"]
    assert codes_of(spark, "Documentation covering " + GOOD) == ["generic_documentation_covering"]
    assert codes_of(spark, "This document contains information on " + GOOD) == ["generic_this_document"]
    assert codes_of(spark, "Information about " + GOOD) == ["generic_information_about"]
    assert codes_of(spark, "Redirecting " + GOOD) == ["redirect_language"]
    assert codes_of(spark, "An overview of the ink section.") == ["too_short", "generic_overview_of"]
    assert "repeats_heading" in codes_of(spark, "The Paper!", "the paper")
    assert "adds_nothing_to_heading" in codes_of(spark, "paper paper ink", "Paper")
    assert codes_of(spark, "Redirected_x " + GOOD) == []


def test_tokens(spark):
    df = spark.createDataFrame([("The Press-room, a 2nd look: I.O and THE end",)], "s string")
    assert df.select(t.tokens(F.col("s")).alias("x")).first().x == ["press-room", "2nd", "look", "end"]


def jaccard(a, b):
    if not a and not b:
        return 1.0
    return round(len(a & b) / len(a | b), 4) if a and b else 0.0


def test_similarity_is_exact(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    texts = []
    for k in range(120):
        base = rng.sample(words, rng.randint(0, 12))
        texts.append((k % 3 or None, k, " ".join(base)))
        if k % 4 == 0 and base:
            base[0] = rng.choice(words)
            texts.append((k % 3 or None, 1000 + k, " ".join(base)))
        if k % 10 == 0:
            texts.append((k % 3 or None, 2000 + k, texts[-1][2]))
    df = spark.createDataFrame(texts, "g int, o int, s string")
    sets = [(g, o, set(s.split())) for g, o, s in texts]
    for limit in (0.3, 0.85):
        due = {(g, min(o, p), max(o, p), jaccard(a, b)) for g, o, a in sets for h, p, b in sets if g == h and o < p and jaccard(a, b) > limit}
        got = {tuple(r) for r in similarity.similar_pairs(df, ["g"], "o", "s", limit).collect()}
        assert got == due
        later = {(r.g, r.o, r.other) for r in similarity.later_items(df, ["g"], "o", "s", limit).collect()}
        assert later == {(g, b, min(a for h, a, c, _ in due if h == g and c == b)) for g, _, b, _ in due}


def test_siblings_and_roots(spark):
    nodes = spark.createDataFrame([("f", "p", 0, "a", "h", GOOD), ("f", "p", 1, "b", "h", GOOD + " Really."), ("f", None, 0, "p", "h", GOOD), ("g", "p", 0, "c", "h", None)], "file string, parent_id string, ordinal int, node_id string, heading string, summary string")
    got = quality.check_siblings(nodes, Config()).collect()
    assert [(r.file, r.node_id, r.other) for r in got] == [("f", "b", "a")]
    docs = spark.createDataFrame([("x", GOOD), ("y", GOOD), ("z", None)], "file string, root_summary string")
    assert [(r.file, r.other, r.score) for r in quality.check_distinct(docs, Config()).collect()] == [("y", "x", 1.0)]
    told = quality.report(docs, nodes, Config()).first()
    assert (told.total_summaries, told.duplicate_sibling_summaries, told.root_summary_collisions) == (5, 1, 1)
