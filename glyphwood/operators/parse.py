"""Markdown texts to a source map: one row per document, with lines, headings, fences, page markers and links as arrays.

Everything stays within the document's row, so parsing needs no shuffle and one pass over the text; the relations
(`lines`, `headings`, ...) are views that explode one of the arrays. Only fence candidates go through a sequential fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphwood.functions import text as t

# The Markdown forms that are recognised.
FENCE = rf"^ {{0,3}}(`{{3,}}|~{{3,}}){t.ANY}*\z"
FENCE_INFO = rf"^ {{0,3}}(?:`{{3,}}|~{{3,}})({t.ANY}*)\z"
FENCE_CLOSE = r"^ {0,3}(?:`{3,}|~{3,})[ \t]*\z"
ATX = rf"^ {{0,3}}(#{{1,6}})(?:[ \t]+{t.ANY}*)?\z"
ATX_BODY = rf"^ {{0,3}}#{{1,6}}[ \t]*({t.ANY}*)\z"
UNDERLINE = r"^ {0,3}(=+|-+)[ \t]*\z"
NO_SETEXT = rf"^ {{0,3}}[-*+][ \t]|^ {{0,3}}[0-9]+[.)][ \t]|^ {{0,3}}>|\||^ {{0,3}}(?:=+|-+)[ \t]*\z|{ATX}"
LINK = rf'\[([^\]]*)\]\(([^){t.SPACE}]+)(?:[{t.SPACE}]+"[^"]*")?\)'
COMMENT = r"(?s)<!--.*?-->"
PAGE_FORMS = {
    "html_comment": rf"(?i)<!--[{t.SPACE}]*page[:{t.SPACE}]+([0-9]+)[{t.SPACE}]*-->",
    "dashed": rf"(?i)^-{{2,}}[{t.SPACE}]*page[{t.SPACE}]+([0-9]+)[{t.SPACE}]*-{{2,}}\z",
    "bare": rf"(?i)^[{t.SPACE}]*page[{t.SPACE}]+([0-9]+)[{t.SPACE}]*\z",
    "form_feed": r"\f",
}
UNTITLED = "(untitled section)"


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def atx_text(line: Column) -> Column:
    """A heading's text: without its marks, a closing run of # and white space at the ends."""
    body = F.regexp_replace(F.regexp_extract(line, t.quick(ATX_BODY), 1), r"[ \t]+\z", "")
    open_end = F.regexp_replace(F.regexp_replace(body, r"[ \t]+#+[ \t]*\z", ""), r"^#+[ \t]*\z", "")
    return t.trim(open_end)


def _frontmatter_end(raw: Column) -> Column:
    """The line that closes the frontmatter, 0 without any."""
    closes = F.transform(raw, lambda x, i: (i > 0) & t.trim(x).isin("---", "..."))
    return F.when(t.trim(F.get(raw, F.lit(0))) == "---", F.array_position(closes, True)).otherwise(F.lit(0)).cast("int")


def _fences(candidates: Column, last: Column) -> Column:
    """The fenced intervals from the lines that may open or close one; an open one runs to the last line."""
    interval = "array<struct<start:int,end:int,unterminated:boolean>>"
    start = F.struct(
        F.array().cast(interval).alias("done"), F.lit("").alias("char"), F.lit(0).alias("len"), F.lit(0).alias("start")
    )

    def step(acc: Column, x: Column) -> Column:
        inside = acc["start"] > 0
        char = F.substring(x["mark"], 1, 1)
        closes = inside & x["closer"] & (char == acc["char"]) & (F.length(x["mark"]) >= acc["len"])
        opens = ~inside & x["opener"]
        done = F.struct(acc["start"].alias("start"), x["n"].alias("end"), F.lit(False).alias("unterminated"))
        return F.struct(
            F.when(closes, F.array_append(acc["done"], done)).otherwise(acc["done"]).alias("done"),
            F.when(opens, char).otherwise(acc["char"]).alias("char"),
            F.when(opens, F.length(x["mark"])).otherwise(acc["len"]).alias("len"),
            F.when(opens, x["n"]).when(closes, F.lit(0)).otherwise(acc["start"]).alias("start"),
        )

    def finish(acc: Column) -> Column:
        open_one = F.struct(acc["start"].alias("start"), last.alias("end"), F.lit(True).alias("unterminated"))
        return F.when(acc["start"] > 0, F.array_append(acc["done"], open_one)).otherwise(acc["done"])

    return F.aggregate(candidates, start, step, finish)


def _flagged(raw: Column, fences: Column) -> Column:
    """Numbered lines with in_code, put together from the runs within and between the fences in linear time."""

    def run(a: Column, b: Column, code: bool) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), F.lit(code).alias("code"))

    def pair(f: Column, k: Column) -> Column:
        after = F.when(k > 0, F.get(fences, k - 1)["end"]).otherwise(F.lit(0)) + 1
        return F.array(run(after, f["start"] - 1, False), run(f["start"], f["end"], True))

    last = F.coalesce(F.get(fences, F.size(fences) - 1)["end"], F.lit(0))
    runs = F.concat(F.flatten(F.transform(fences, pair)), F.array(run(last + 1, F.size(raw), False)))
    return F.flatten(
        F.transform(
            runs,
            lambda r: F.transform(
                F.slice(raw, r["a"], r["b"] - r["a"] + 1),
                lambda x, i: _struct(n=r["a"] + i, text=x, in_code=r["code"]),
            ),
        )
    )


def source_map(sources: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """The source map of `sources(file, content)`; further columns are left out, a null content counts as empty.

    Columns: file, total_lines, frontmatter_end, body_start, lines, headings, fences, page_markers, page_pattern, links,
    substantive_count, last_substantive_line, prose_words, non_link_words, code_blocks, prose, fingerprint.
    """
    df = sources.select(F.col(file).alias("file"), t.blank_to_empty(F.col(content)).alias("_c"))
    df = df.select("file", "_c", t.lines(F.col("_c")).alias("_raw"))
    raw = F.col("_raw")
    df = df.select("*", _frontmatter_end(raw).alias("frontmatter_end"), F.size(raw).alias("total_lines"))
    df = df.withColumn("body_start", F.col("frontmatter_end") + 1)
    body = F.col("body_start")

    numbered = F.transform(raw, lambda x, i: _struct(n=i + 1, text=x))
    df = df.withColumn("_marks", F.filter(numbered, lambda x: (x["n"] >= body) & x["text"].rlike(t.quick(FENCE))))
    candidates = F.transform(
        F.col("_marks"),
        lambda x: _struct(
            n=x["n"],
            mark=F.regexp_extract(x["text"], t.quick(FENCE), 1),
            opener=~(F.regexp_extract(x["text"], t.quick(FENCE), 1).startswith("`") & F.regexp_extract(x["text"], t.quick(FENCE_INFO), 1).contains("`")),
            closer=x["text"].rlike(t.quick(FENCE_CLOSE)),
        ),
    )
    df = df.withColumn("fences", _fences(candidates, F.col("total_lines")))
    df = df.withColumn("_flagged", _flagged(raw, F.col("fences")))

    flagged = F.col("_flagged")

    def leveled(x: Column, i: Column) -> Column:
        text, open_line = x["text"], (x["n"] >= body) & ~x["in_code"]
        atx = F.when(open_line & text.rlike(t.quick(ATX)), F.length(F.regexp_extract(text, t.quick(ATX), 1))).otherwise(0)
        above = F.get(flagged, i - 1)
        promotes = (
            open_line
            & (x["n"] > body)
            & text.rlike(UNDERLINE)
            & ~above["in_code"]
            & ~t.is_blank(above["text"])
            & ~above["text"].rlike(t.quick(NO_SETEXT))
        )
        setext = F.when(promotes, F.when(t.trim(text).startswith("="), 1).otherwise(2)).otherwise(0)
        filled = (x["n"] >= body) & ~t.is_blank(text)
        return _struct(n=x["n"], text=text, in_code=x["in_code"], substantive=filled, atx=atx, setext=setext)

    df = df.withColumn("_leveled", F.transform(flagged, leveled))
    rows = F.col("_leveled")

    def kinds(x: Column, i: Column) -> Column:
        below = F.coalesce(F.get(rows, i + 1)["setext"], F.lit(0))
        return _struct(
            n=x["n"],
            text=x["text"],
            in_code=x["in_code"],
            substantive=x["substantive"],
            level=F.when(x["atx"] > 0, x["atx"]).otherwise(below),
            kind=F.when(x["atx"] > 0, F.lit("atx")).when(below > 0, F.lit("setext")),
            underline=x["setext"] > 0,
        )

    df = df.withColumn("lines", F.transform(rows, kinds))
    all_lines = F.col("lines")

    # A line above an underline has been read before the underline makes it a heading, so its links and markers count.
    open_lines = F.filter(all_lines, lambda x: (x["n"] >= body) & ~x["in_code"] & ~x["underline"] & ~F.coalesce(x["kind"] == "atx", F.lit(False)))
    prose = F.filter(all_lines, lambda x: x["substantive"] & ~x["in_code"] & (x["level"] == 0) & ~x["underline"])
    df = df.select(
        "*",
        F.filter(all_lines, lambda x: x["level"] > 0).alias("_heads"),
        F.filter(open_lines, lambda x: is_page_marker(x["text"])).alias("_pages"),
        F.filter(open_lines, lambda x: x["text"].contains("](")).alias("_linked"),
        F.transform(prose, lambda x: x["text"]).alias("_prose"),
        F.filter(all_lines, lambda x: x["substantive"]).alias("_filled"),
    )

    heads = F.col("_heads")

    def heading(h: Column, i: Column) -> Column:
        below = F.get(heads, i + 1)["n"]
        between = F.slice(all_lines, h["n"] + 1, F.coalesce(below - h["n"] - 1, F.lit(0)))
        return _struct(
            line=h["n"],
            level=h["level"],
            text=F.when(h["kind"] == "atx", atx_text(h["text"])).otherwise(t.trim(h["text"])),
            kind=h["kind"],
            underline_line=F.when(h["kind"] == "setext", h["n"] + 1),
            intro=F.exists(between, lambda x: x["substantive"]),
        )

    pages = F.col("_pages")
    counted = F.col("_prose")
    filled = F.col("_filled")
    derived = {
        "total_lines": F.col("total_lines"),
        "frontmatter_end": F.col("frontmatter_end"),
        "body_start": body,
        "lines": all_lines,
        "headings": F.transform(heads, heading),
        "fences": F.col("fences"),
        "page_markers": F.transform(
            pages,
            lambda x, i: _struct(line=x["n"], page=F.coalesce(page_number(x["text"]), (i + 1).cast("long")), pattern=page_form(x["text"])),
        ),
        "page_pattern": page_form(F.get(pages, F.lit(0))["text"]),
        "links": F.flatten(F.transform(F.col("_linked"), line_links)),
        "substantive_count": F.size(filled),
        "last_substantive_line": F.coalesce(F.get(filled, F.size(filled) - 1)["n"], F.lit(0)),
        "prose_words": F.aggregate(counted, F.lit(0), lambda acc, x: acc + t.word_count(linked_words(x))),
        "non_link_words": F.aggregate(counted, F.lit(0), lambda acc, x: acc + F.size(non_link_words(x))),
        "code_blocks": F.size("fences"),
        "prose": F.array_join(counted, "\n"),
        "fingerprint": t.fingerprint(F.col("_c")),
    }
    return df.select("file", *[t.fenced(c).alias(name) for name, c in derived.items()])


def is_page_marker(line: Column) -> Column:
    found = F.lit(False)
    for form in PAGE_FORMS.values():
        found = found | line.rlike(t.quick(form))
    return found


def page_form(line: Column) -> Column:
    """The name of the first form that the line has."""
    return F.coalesce(*[F.when(line.rlike(t.quick(form)), F.lit(name)) for name, form in PAGE_FORMS.items()])


def page_number(line: Column) -> Column:
    """The number that the line states; null for a form feed."""
    stated = [F.when(line.rlike(t.quick(form)), F.regexp_extract(line, t.quick(form), 1)) for name, form in PAGE_FORMS.items() if name != "form_feed"]
    return F.coalesce(*stated).try_cast("long")


def line_links(x: Column) -> Column:
    """The links of a numbered line, in order."""
    texts, targets = F.regexp_extract_all(x["text"], F.lit(t.quick(LINK)), F.lit(1)), F.regexp_extract_all(x["text"], F.lit(t.quick(LINK)), F.lit(2))
    return F.transform(
        F.arrays_zip(texts.alias("text"), targets.alias("target")),
        lambda z, i: _struct(line=x["n"], idx=i, text=z["text"], target=z["target"]),
    )


def linked_words(line: Column) -> Column:
    """The line without comments, links replaced by their text."""
    return F.regexp_replace(F.regexp_replace(line, COMMENT, " "), t.quick(LINK), " $1 ")


def non_link_words(line: Column) -> Column:
    """Words with a letter or digit that are outside links."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, COMMENT, " "), t.quick(LINK), " "), t.quick(rf"^[{t.SPACE}]*[-*+][{t.SPACE}]*"), " ")
    return F.filter(t.words(F.regexp_replace(bare, "[|>#*_`]", " ")), lambda w: w.rlike("[A-Za-z0-9]"))


# ---- relations --------------------------------------------------------------------------------------------------


def lines(source: DataFrame) -> DataFrame:
    return t.exploded(source, F.col("lines"), "file")


def headings(source: DataFrame) -> DataFrame:
    return t.exploded(source, F.col("headings"), "file")


def fences(source: DataFrame) -> DataFrame:
    return t.exploded(source, F.col("fences"), "file")


def page_markers(source: DataFrame) -> DataFrame:
    return t.exploded(source, F.col("page_markers"), "file")


def links(source: DataFrame) -> DataFrame:
    return t.exploded(source, F.col("links"), "file")


def page_at(markers: Column, line: Column) -> Column:
    """The page of the last marker at or before the line; null before the first. Markers are in the order of lines, so
    many of them are searched by halving."""
    few = F.size(F.filter(markers, lambda m: m["line"] <= line))
    first = F.struct(F.lit(0).alias("low"), F.size(markers).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        below = (acc["low"] < acc["high"]) & (F.get(markers, middle)["line"] <= line)
        return F.struct(F.when(below, middle + 1).otherwise(acc["low"]).alias("low"), F.when(below | (acc["low"] >= acc["high"]), acc["high"]).otherwise(middle).alias("high"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(markers) + 1)).cast("int"))
    many = F.aggregate(steps, first, halve, lambda acc: acc["low"])
    return F.get(markers, F.when(F.size(markers) <= 16, few).otherwise(many) - 1)["page"]


def page_range(markers: Column, start: Column, end: Column) -> Column:
    """First and last page of a range of lines; null where no page is known."""
    first, last = page_at(markers, start), page_at(markers, end)
    a = F.coalesce(first, F.get(markers, F.lit(0))["page"])
    b = F.coalesce(last, a)
    return F.when(first.isNotNull() | last.isNotNull(), F.struct(a.alias("page_start"), F.greatest(a, b).alias("page_end")))
