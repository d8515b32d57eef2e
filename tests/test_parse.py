from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from glyphwood.config import Config
from glyphwood.functions import text as t
from glyphwood.operators import classify, parse

from tests import samples


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_headings_fences_and_setext(sources):
    m = parse.source_map(sources({"s.md": samples.SETEXT}))
    heads = rows(parse.headings(m).orderBy("line"), "line", "level", "text", "kind")
    assert heads == [
        (1, 1, "The title of it", "setext"), (6, 2, "Second part", "setext"), (17, 2, "Same", "atx"), (19, 2, "Same", "atx"),
        (21, 2, "Closed", "atx"), (28, 2, "Last", "atx"),
    ]
    assert rows(parse.fences(m), "start", "end", "unterminated") == [(22, 26, False)]


def test_fence_states(sources):
    text = "```\na\n~~~\n```\n````x\n```\n# no\n````\n``` a`b\n# yes\n~~~\nopen"
    m = parse.source_map(sources({"f.md": text}))
    assert rows(parse.fences(m).orderBy("start"), "start", "end", "unterminated") == [(1, 4, False), (5, 8, False), (11, 12, True)]
    assert rows(parse.headings(m), "line", "text") == [(10, "yes")]


def test_frontmatter(sources):
    texts = {"a": "---\nx: 1\n---\n# h\n", "b": "---\nx\n", "c": "\n---\n---\n", "d": " --- \n...\nz"}
    m = parse.source_map(sources(texts)).orderBy("file")
    assert rows(m, "frontmatter_end") == [(3,), (0,), (0,), (2,)]


def test_page_markers(sources):
    m = parse.source_map(sources({"p.md": samples.PAGED, "f.md": "a\fb\nPAGE 7\n\f\n```\npage 9\n```\n"}))
    got = rows(parse.page_markers(m).orderBy("file", "line"), "file", "line", "page", "pattern")
    assert got == [
        ("f.md", 1, 1, "form_feed"), ("f.md", 2, 7, "bare"), ("f.md", 3, 3, "form_feed"),
        ("p.md", 1, 1, "html_comment"), ("p.md", 8, 2, "dashed"), ("p.md", 15, 3, "bare"),
    ]


def test_links(sources):
    text = 'a [x](y.md "t") [z](http://h/q) `n` [](e)\n## [h](in-heading.md)\ntitle [k](s.md)\n---\n'
    m = parse.source_map(sources({"l.md": text}))
    # a line is read before the underline below makes it a heading
    assert rows(parse.links(m).orderBy("line", "idx"), "line", "idx", "text", "target") == [
        (1, 0, "x", "y.md"), (1, 1, "z", "http://h/q"), (1, 2, "", "e"), (3, 0, "k", "s.md"),
    ]


def test_nulls_empty_and_odd_space(sources):
    texts = {"n": None, "e": "", "w": "  ﻿\n\u0085", "u": "# a b\n# c\n"}
    m = parse.source_map(sources(texts)).orderBy("file")
    got = rows(m, "file", "total_lines", "substantive_count")
    # U+0085 isn't white space here, U+00A0 and U+FEFF are
    assert got == [("e", 1, 0), ("n", 1, 0), ("u", 3, 2), ("w", 2, 1)]
    assert parse.headings(m).count() == 0


def test_fingerprint(sources):
    got = sources({"a": "x\r\ny\rz\n", "n": None}).orderBy("file").select(t.fingerprint(F.col("content")).alias("f")).collect()
    assert got[0].f.line_count == 4 and got[0].f.sha256 == hashlib.sha256(b"x\r\ny\rz\n").hexdigest()
    assert got[1].f is None


def test_classes(sources):
    m = parse.source_map(sources(samples.ALL | {"e.md": "", "g.md": None}))
    got = {r.file: (r.classification, r.alias_target) for r in classify.classify(m, Config()).collect()}
    assert got == {
        "a/guide.md": ("substantive", None), "a/setext.md": ("substantive", None), "b/paged.md": ("substantive", None), "b/old.md": ("redirect", "a/guide.md"),
        "b/stub.md": ("placeholder", None), "b/index.md": ("navigation_only", None), "b/dense.md": ("substantive", None), "c/flat.md": ("substantive", None),
        "c/long.md": ("substantive", None), "e.md": ("placeholder", None), "g.md": ("placeholder", None),
    }
    summary = {r.classification: r.documents for r in classify.scan_summary(classify.scan(classify.classify(m, Config()))).collect()}
    assert summary == {"substantive": 6, "redirect": 1, "placeholder": 3, "navigation_only": 1, "unsupported": 0}
    assert [tuple(r) for r in classify.aliases(classify.classify(m, Config())).collect()] == [("b/old.md", "a/guide.md", True)]


def test_link_targets(spark):
    cases = [("a/b/c.md", "../x.md#y", True, "a/x.md"), ("c.md", "./d/./e.md", True, "d/e.md"), ("a/b.md", "/r.md", True, "r.md"), ("a.md", "../../u.md", True, "u.md"),
             ("a.md", "http://h/x.md", False, None), ("a.md", "#x.md", False, None), ("a.md", "x.txt", False, None), ("a.md", "MAILTO:x.md", False, None)]
    df = spark.createDataFrame(cases, "f string, t string, is boolean, to string")
    for r in df.select("*", classify.is_local_markdown(F.col("t")).alias("got"), classify.resolve(F.col("f"), F.col("t")).alias("at")).collect():
        assert r["got"] == r["is"]
        assert not r["is"] or r["at"] == r["to"]
