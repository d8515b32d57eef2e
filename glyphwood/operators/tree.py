"""Section trees as an adjacency table: one row per node, ids and paths from window functions over each document.

All windows are partitioned by `file`, so the node table is shuffled once; texts don't travel with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphwood.config import SCHEMA_VERSION, Config
from glyphwood.functions import text as t
from glyphwood.operators import parse

OVERVIEW, PART, CHUNK, PREAMBLE = " — Overview", " — Part ", "Chunk ", "Preamble"
#: Rank of a container for ancestry: headings have their level, a preamble stands below all of them.
LEVELS = 7


def sections(headings: DataFrame, last_line: DataFrame) -> DataFrame:
    """Extent and parent of each heading. last_line(file, last_substantive_line) closes the last sections."""
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)  # a frame to the end would be summed up anew for each row
    ends = [F.min(F.when(F.col("level") <= k, F.col("line"))).over(after) for k in range(1, 7)]
    parents = [F.max(F.when(F.col("level") < k, F.col("line"))).over(before) for k in range(1, 7)]
    df = headings.select(
        "file",
        "line",
        "level",
        F.coalesce(F.nullif(F.col("text"), F.lit("")), F.lit(parse.UNTITLED)).alias("heading"),
        F.element_at(F.array(*ends), F.col("level")).alias("_next"),
        F.element_at(F.array(*parents), F.col("level")).alias("parent_line"),
    )
    end = F.greatest("line", F.coalesce(F.col("_next") - 1, "last_substantive_line"))
    return df.join(last_line, "file").select("file", "line", "level", "heading", "parent_line", end.alias("end_line"))


def _node(line: Column, rank: int, part: Column, below: Column, level: Column, heading: Column, start: Column, end: Column, leaf: Column, made: str | None) -> Column:
    """rank: 0 what may have children, 1 what is generated below it. below: its rank for ancestry."""
    return F.struct(
        line.cast("int").alias("line"),
        F.lit(rank).alias("rank"),
        part.cast("int").alias("part"),
        below.cast("int").alias("below"),
        level.cast("int").alias("level"),
        heading.alias("heading"),
        F.when(leaf, start).cast("int").alias("line_start"),
        F.when(leaf, end).cast("int").alias("line_end"),
        leaf.alias("is_leaf"),
        F.lit(made).cast("string").alias("generated"),
    )


def _with_parts(line: Column, below: Column, level: Column, heading: Column, end: Column, may_split: Column, made: str | None, most: int) -> tuple[Column, Column]:
    """A node over lines line..end and, if it is too long, its parts."""
    none = F.lit(0)
    split = may_split & (end - line + 1 > most) if most > 0 else F.lit(False)
    node = _node(line, 0, none, below, level, heading, line, end, may_split & ~split, made)
    starts = F.sequence(line, end, F.lit(max(most, 1)))
    parts = F.transform(
        starts,
        lambda s, i: _node(
            line, 1, i + 1, below + 1, level + 1, F.concat(heading, F.lit(PART), (i + 1).cast("string")), s, F.least(s + most - 1, end), F.lit(True), "part"
        ),
    )
    return node, F.when(split, parts).otherwise(F.array())


def _outline(config: Config) -> Column:
    """All nodes of one document of a source map, as an array in its row."""
    heads, last, body, zero = F.col("headings"), F.col("last_substantive_line"), F.col("body_start"), F.lit(0)
    most = config.max_section_size_lines

    def of_heading(h: Column, i: Column) -> Column:
        below = F.get(heads, i + 1)
        leaf = below.isNull() | (below["level"] <= h["level"])
        end = F.greatest(h["line"], F.coalesce(below["line"] - 1, last))
        title = F.when(h["text"] == "", F.lit(parse.UNTITLED)).otherwise(h["text"])
        node, parts = _with_parts(h["line"], h["level"], h["level"], title, end, leaf, None, most)
        overview = _node(h["line"], 1, zero, h["level"] + 1, h["level"] + 1, F.concat(title, F.lit(OVERVIEW)), h["line"], end, F.lit(True), "overview")
        return F.concat(F.array(node), F.when(~leaf & h["intro"], F.array(overview)).otherwise(F.array()), parts)

    first = F.get(heads, zero)["line"]
    filled_before = F.exists(F.slice("lines", body, F.greatest(first - body, zero)), lambda x: x["substantive"])
    preamble, parts = _with_parts(body, F.lit(LEVELS), F.lit(1), F.lit(PREAMBLE), first - 1, F.lit(True), "preamble", most)
    above = F.when((first > body) & filled_before, F.concat(F.array(preamble), parts)).otherwise(F.array())
    size = config.fallback_chunk_size_lines
    chunks = F.transform(
        F.sequence(body, last, F.lit(size)),
        lambda s, i: _node(s, 0, zero, F.lit(LEVELS), F.lit(1), F.concat(F.lit(CHUNK), (i + 1).cast("string")), s, F.least(s + size - 1, last), F.lit(True), "chunk"),
    )
    return (
        F.when(last < body, F.array())
        .when(F.size(heads) == 0, chunks)
        .otherwise(F.concat(above, F.flatten(F.transform(heads, of_heading))))
    )


def build(source: DataFrame, config: Config) -> DataFrame:
    """The nodes of all documents of a source map.

    Columns: file, node_id, parent_id, path, depth, ordinal, level, heading, heading_path, line, line_start, line_end,
    block_end, page_start, page_end, is_leaf, generated, summary. A document without a substantive line has no nodes.
    """
    df = t.exploded(source, _outline(config), "file", "last_substantive_line")
    ordered = Window.partitionBy("file").orderBy("line", "rank", "part")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy(F.desc("line"), F.desc("rank"), F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    holds = F.col("rank") == 0
    above = [F.max(F.when(holds & (F.col("below") <= k), F.col("line"))).over(before) for k in range(1, LEVELS + 1)]
    next_up = [F.min(F.when(holds & (F.col("below") <= k), F.col("line"))).over(after) for k in range(1, LEVELS + 1)]
    own = F.least("below", F.lit(LEVELS))
    df = df.select(
        "*",
        F.when(F.col("below") > 1, F.element_at(F.array(*above), F.greatest(F.col("below") - 1, F.lit(1)))).alias("_parent"),
        F.element_at(F.array(*next_up), own).alias("_next"),
    )
    df = df.withColumn("_slug", t.slug_or_line(F.col("heading"), F.coalesce("line_start", "line")))
    in_order = ["line", "rank", "part"]
    df = df.select(
        "*",
        (F.row_number().over(Window.partitionBy("file", "_parent").orderBy(*in_order)) - 1).alias("ordinal"),
        F.row_number().over(Window.partitionBy("file", "_parent", "_slug").orderBy(*in_order)).alias("_k"),
    )
    own_slug = F.when(F.col("_k") > 1, F.concat_ws("-", "_slug", F.col("_k").cast("string"))).otherwise(F.col("_slug"))
    df = df.withColumn("_me", F.struct("line", own_slug.alias("slug"), "ordinal", "heading"))
    chain = [F.max(F.when(holds & (F.col("below") <= k), F.col("_me"))).over(before) for k in range(1, LEVELS + 1)]
    reached = F.slice(F.array(*chain), F.lit(1), F.col("below") - 1)
    df = df.withColumn("_above", F.array_distinct(F.filter(reached, lambda x: x.isNotNull())))
    me, up = F.col("_me"), F.col("_above")
    whole = F.array_append(up, me)
    name = lambda chain: F.concat_ws("_", t.stem(F.col("file")), F.transform(chain, lambda x: x["slug"]))
    nodes = df.select(
        "file",
        name(whole).alias("node_id"),
        F.when(F.size(up) > 0, name(up)).alias("parent_id"),
        F.transform(whole, lambda x: x["ordinal"]).alias("path"),
        F.size(whole).alias("depth"),
        "ordinal",
        "level",
        "heading",
        F.transform(whole, lambda x: x["heading"]).alias("heading_path"),
        "line",
        "line_start",
        "line_end",
        F.coalesce("line_end", F.greatest("line", F.coalesce(F.col("_next") - 1, "last_substantive_line"))).alias("block_end"),
        "is_leaf",
        "generated",
        F.lit(None).cast("string").alias("summary"),
    )
    if not config.page_numbers_in_citations:
        return nodes.withColumns({"page_start": F.lit(None).cast("long"), "page_end": F.lit(None).cast("long")})
    nodes = nodes.join(source.select("file", "page_markers"), "file")
    pages = parse.page_range(F.col("page_markers"), F.coalesce("line_start", "line"), F.col("block_end"))
    return nodes.withColumn("_p", pages).select("*", "_p.page_start", "_p.page_end").drop("_p", "page_markers")


def documents(source: DataFrame, config: Config) -> DataFrame:
    """The root of each document's tree: file, doc_type, fingerprint, schema_version, page range, and what hinders it."""
    kind = config.doc_type(F.col("file"))
    wants = F.lit(config.page_numbers_in_citations)
    reject = F.when(kind.isNull(), "doc_type_unresolved").when(wants & (F.size("page_markers") == 0), "no_page_markers")
    end = F.when(F.col("last_substantive_line") > 0, F.col("last_substantive_line")).otherwise(F.col("body_start"))
    pages = F.when(wants, parse.page_range(F.col("page_markers"), F.col("body_start"), end))
    df = source.withColumn("_p", pages)
    return df.select(
        "file",
        kind.alias("doc_type"),
        "fingerprint",
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.col("_p.page_start").alias("page_start"),
        F.col("_p.page_end").alias("page_end"),
        reject.alias("reject"),
        t.tree_file(F.col("file")).alias("tree_index"),
        F.lit(None).cast("string").alias("root_summary"),
    )


def stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("file").agg(
        F.count("*").alias("nodes"),
        F.count_if("is_leaf").alias("leaves"),
        F.max("depth").cast("long").alias("depth"),
        F.count_if(F.col("generated").isNull()).alias("headings"),
    )


def subtree_ranges(nodes: DataFrame) -> DataFrame:
    """Lines of each node: its own if it is a leaf, else from its first leaf to its last.

    Each leaf goes to its ancestors (eight at most) and is summed up before the shuffle.
    """
    up = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda k: F.slice("path", F.lit(1), k))
    reach = nodes.filter("is_leaf").select("file", F.explode(up).alias("path"), "line_start", "line_end")
    ranges = reach.groupBy("file", "path").agg(F.min("line_start").alias("range_start"), F.max("line_end").alias("range_end"))
    return nodes.join(ranges, ["file", "path"], "left")


def to_json(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each document's tree as nested JSON, of any depth, in one shuffle: every node in order writes its opening part and
    closes whatever ends with it."""
    ordered = Window.partitionBy("file").orderBy("path")
    following = F.coalesce(F.lead("depth").over(ordered), F.lit(1))
    fields = F.to_json(
        F.struct(
            "heading",
            "level",
            "node_id",
            "summary",
            F.when(F.col("page_start").isNotNull(), F.array("page_start", "page_end")).alias("page_range"),
            F.when(F.col("is_leaf"), F.struct(F.array("line_start", "line_end").alias("lines"))).alias("content_ref"),
        ),
        {"ignoreNullFields": "true"},
    )
    with_summary = F.when(F.col("summary").isNull(), F.concat(F.expr("left(_f, length(_f) - 1)"), F.lit(',"summary":null}'))).otherwise(F.col("_f"))
    opening = F.concat(F.when(F.col("ordinal") > 0, ",").otherwise(""), F.expr("left(_g, length(_g) - 1)"), F.lit(',"children":['))
    closing = F.when(F.col("_following") <= F.col("depth"), F.repeat(F.lit("]}"), F.col("depth") - F.col("_following") + 1)).otherwise("")
    df = nodes.withColumn("_following", following).withColumn("_f", fields).withColumn("_g", with_summary)
    parts = df.select("file", "path", F.concat(opening, closing).alias("part"))
    bodies = parts.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("path", "part"))).alias("_b"))
    joined = F.coalesce(F.array_join(F.transform("_b", lambda x: x["part"]), ""), F.lit(""))
    root = F.to_json(F.struct("file", "doc_type", F.col("fingerprint").alias("source_fingerprint"), "schema_version", "root_summary"))
    df = docs.join(bodies, "file", "left").select("file", "tree_index", root.alias("_r"), joined.alias("_j"))
    json = F.concat(F.expr("left(_r, length(_r) - 1)"), F.lit(',"children":['), F.col("_j"), F.lit("]}"))
    return df.select("file", "tree_index", json.alias("json"))
