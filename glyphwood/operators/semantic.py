"""Work for a model and back: outline, tasks, batches under two budgets, and the merge of results into trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphwood.config import EngineError, Config
from glyphwood.functions import text as t
from glyphwood.operators import quality, tree, validate
from glyphwood.sources import scratch

CONTENT_CHARS, EXCERPT_CHARS = 12_000, 2_500
CUT_MARK = "\n\n[content truncated for length]"
RESULT_FIELDS = ("task_id", "node_id", "kind", "summary", "topics", "metadata", "file")
#: Tasks of one block of the packing chain, and blocks of one link of it.
BLOCK, LINK = 4096, 256


def sibling_headings(nodes: DataFrame) -> DataFrame:
    """nodes with the headings of the other children of the same parent, in order."""
    group = Window.partitionBy("file", "parent_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = F.collect_list("heading").over(group)
    return nodes.withColumn("_all", listed).withColumn("sibling_headings", F.filter("_all", lambda x, i: i != F.col("ordinal"))).drop("_all")


def content_slice(lines: Column, start: Column, end: Column) -> Column:
    """Lines of a range as one text, cut at CONTENT_CHARS with a mark."""
    text = F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n")
    return F.when(F.length(text) <= CONTENT_CHARS, text).otherwise(F.concat(F.substring(text, 1, CONTENT_CHARS), F.lit(CUT_MARK)))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, in which budgets are given."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def tasks(nodes: DataFrame, docs: DataFrame, sources: DataFrame, config: Config) -> DataFrame:
    """A task for each node and each document.

    Columns: task_id, kind, file, doc_type, path (empty array last within a document), node_id, heading, heading_path,
    level, line_start, line_end, sibling_headings, required_metadata, content, size.
    Nodes travel to their document's text in one array each, so a text is shuffled once and not copied per node.
    """
    ranged = tree.subtree_ranges(sibling_headings(nodes))
    picked = F.struct("path", "node_id", "heading", "heading_path", "level", F.col("range_start").alias("line_start"), F.col("range_end").alias("line_end"), "sibling_headings")
    held = ranged.groupBy("file").agg(F.collect_list(picked).alias("_nodes"))
    df = docs.select("file", "doc_type").join(held, "file", "left").join(sources.select("file", "content"), "file")
    df = df.withColumn("_lines", t.lines(F.col("content")))
    of_nodes = F.transform(
        F.coalesce("_nodes", F.array()),
        lambda x: F.struct(
            F.lit("node").alias("kind"),
            *[x[c].alias(c) for c in ("path", "node_id", "heading", "heading_path", "level", "line_start", "line_end", "sibling_headings")],
            content_slice(F.col("_lines"), x["line_start"], x["line_end"]).alias("content"),
        ),
    )
    none = F.lit(None)
    strings = F.array().cast("array<string>")
    root = F.struct(
        F.lit("root").alias("kind"),
        none.cast("array<int>").alias("path"),
        none.cast("string").alias("node_id"),
        F.col("file").alias("heading"),
        strings.alias("heading_path"),
        none.cast("int").alias("level"),
        none.cast("int").alias("line_start"),
        none.cast("int").alias("line_end"),
        strings.alias("sibling_headings"),
        F.substring(F.array_join("_lines", "\n"), 1, EXCERPT_CHARS).alias("content"),
    )
    out = t.exploded(df, F.array_append(of_nodes, root), "file", "doc_type")
    out = out.withColumn("required_metadata", F.when(F.col("kind") == "root", config.schema_fields(F.col("doc_type"))).otherwise(strings))
    task_id = F.concat_ws(":", t.stem(F.col("file")), F.coalesce("node_id", F.lit("__root__")))
    return out.select(task_id.alias("task_id"), "*", utf16_length(F.coalesce("content", F.lit(""))).alias("size"))


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with `pos`, the rows' number from 0 in the order given, without a window over all rows: ranges are numbered
    apart and moved by the counts of the ranges before them. The ranges are written out, since both passes must see the
    same, whatever is computed again meanwhile."""
    ranged = scratch.written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    moved = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_i", within).join(F.broadcast(moved), "_part").withColumn("pos", F.col("_i") + F.col("_base")).drop("_i", "_base", "_part")


def pack(queue: DataFrame, config: Config, size: str = "size") -> DataFrame:
    """queue(pos, size, ...) with `batch` from 1: batches are filled in order of pos and closed by the number of tasks or
    of characters, whichever budget the next task would break; a task over the budget has a batch of its own.

    Where the batch that starts at a task ends depends on a few tasks after it, so blocks of tasks are looked at apart:
    each says where it would be left for every place at which it may be entered. Only those short tables are chained.
    """
    most, chars, span = config.max_nodes_per_semantic_batch, config.max_content_characters_per_semantic_batch, max(BLOCK, config.max_nodes_per_semantic_batch)
    block = F.floor(F.col("pos") / span)
    lean = queue.select("pos", F.col(size).alias("_s"), block.alias("_b"))
    overlap = lean.filter((F.col("pos") % span < most) & (F.col("_b") > 0)).withColumn("_b", F.col("_b") - 1)
    ahead = Window.partitionBy("_b").orderBy("pos").rowsBetween(0, most - 1)
    sizes = lean.unionByName(overlap).withColumn("_w", F.collect_list("_s").over(ahead))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def fill(acc: Column, x: Column) -> Column:
        fits = acc["open"] & ((acc["n"] == 0) | (acc["sum"] + x <= chars))
        return F.struct(F.when(fits, acc["sum"] + x).otherwise(acc["sum"]).alias("sum"), F.when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n"), fits.alias("open"))

    lengths = sizes.filter(F.floor(F.col("pos") / span) == F.col("_b")).select("_b", "pos", F.aggregate("_w", start, fill, lambda a: a["n"]).alias("len"))
    rows = lengths.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("pos", "len"))).alias("_all"))
    rows = rows.select("_b", t.fenced(F.transform("_all", lambda x: x["len"])).alias("lens"))  # or it is sorted again for each entry

    def walk(lens: Column, entry: Column) -> Column:
        """Batches that start in a block entered at `entry`, and where the next block is entered."""
        begin = F.struct(entry.cast("int").alias("at"), F.lit(0).alias("n"), F.lit(0).alias("i"))

        def step(acc: Column, x: Column) -> Column:
            hit = acc["i"] == acc["at"]
            return F.struct(F.when(hit, acc["at"] + x).otherwise(acc["at"]).alias("at"), F.when(hit, acc["n"] + 1).otherwise(acc["n"]).alias("n"), (acc["i"] + 1).alias("i"))

        return F.aggregate(lens, begin, step, lambda a: F.struct((a["at"] - a["i"]).alias("exit"), a["n"].alias("n")))

    state = "struct<at:int,n:bigint,out:array<struct<b:bigint,entry:int,base:bigint>>>"

    def chained(steps: Column, at: Column, base: Column) -> Column:
        """Through steps (b, by) in order, from an entry and a number of batches: where each is entered, and the end."""
        first = F.struct(at.cast("int").alias("at"), base.cast("long").alias("n"), F.array().cast("array<struct<b:bigint,entry:int,base:bigint>>").alias("out")).cast(state)

        def link(acc: Column, x: Column) -> Column:
            left = F.get(x["by"], acc["at"])
            entry = F.struct(x["b"].alias("b"), acc["at"].alias("entry"), acc["n"].alias("base"))
            return F.struct(left["exit"].cast("int").alias("at"), (acc["n"] + left["n"]).cast("long").alias("n"), F.array_append(acc["out"], entry).alias("out"))

        return F.aggregate(steps, first, link)

    def end_of(steps: Column, at: Column) -> Column:
        """Where steps that are entered there are left, and how many batches start in them."""
        first = F.struct(at.cast("int").alias("at"), F.lit(0).cast("long").alias("n"))

        def link(acc: Column, x: Column) -> Column:
            left = F.get(x["by"], acc["at"])
            return F.struct(left["exit"].cast("int").alias("at"), (acc["n"] + left["n"]).cast("long").alias("n"))

        return F.aggregate(steps, first, link, lambda a: F.struct(a["at"].alias("exit"), a["n"].alias("n")))

    # blocks are chained within links, links as a whole: both lists are short, whatever the number of tasks
    table = rows.select("_b", F.transform(F.sequence(F.lit(0), F.lit(most)), lambda e: walk(F.col("lens"), e)).alias("by"))
    linked = table.groupBy(F.floor(F.col("_b") / LINK).alias("_l")).agg(F.array_sort(F.collect_list(F.struct(F.col("_b").alias("b"), "by"))).alias("_all"))
    linked = linked.select("_l", t.fenced(F.col("_all")).alias("all"))
    links = linked.select(F.col("_l").alias("b"), F.transform(F.sequence(F.lit(0), F.lit(most)), lambda e: end_of(F.col("all"), e)).alias("by"))
    whole = links.agg(F.array_sort(F.collect_list(F.struct("b", "by"))).alias("all"))
    entered = whole.select(F.explode(chained(F.col("all"), F.lit(0), F.lit(0))["out"]).alias("x")).select(F.col("x.b").alias("_l"), "x.entry", "x.base")
    entries = linked.join(entered, "_l").select(F.explode(chained(F.col("all"), F.col("entry"), F.col("base"))["out"]).alias("x")).select(F.col("x.b").alias("_b"), "x.entry", "x.base")
    marks = F.struct(F.col("entry").alias("at"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def mark(acc: Column, x: Column) -> Column:
        hit = acc["i"] == acc["at"]
        return F.struct(F.when(hit, acc["at"] + x).otherwise(acc["at"]).alias("at"), (acc["i"] + 1).alias("i"), F.when(hit, F.array_append(acc["starts"], acc["i"])).otherwise(acc["starts"]).alias("starts"))

    starts = rows.join(entries, "_b").select("base", (F.col("_b") * span).alias("_at"), F.posexplode(F.aggregate("lens", marks, mark, lambda a: a["starts"])).alias("k", "i"))
    starts = starts.select((F.col("_at") + F.col("i")).alias("pos"), (F.col("base") + F.col("k") + 1).alias("batch"))
    # a batch that reaches over from the block before has that block's last number
    known = queue.withColumn("_b", block).join(starts, "pos", "left").join(entries.select("_b", "base"), "_b")
    upto = Window.partitionBy("_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return known.withColumn("batch", F.coalesce(F.last("batch", ignorenulls=True).over(upto), "base")).drop("_b", "base")


def batches(packed: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row per batch with its documents, each with outline and tasks, as JSON."""
    outline = nodes.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("path", "node_id", "heading_path", "level"))).alias("outline"))
    own = [c for c in ("task_id", "kind", "node_id", "heading", "heading_path", "level", "line_start", "line_end", "sibling_headings", "required_metadata", "content") if c in packed.columns]
    grouped = packed.groupBy("batch", "file").agg(F.min("pos").alias("_first"), F.array_sort(F.collect_list(F.struct("pos", F.struct(*own).alias("task")))).alias("_t"))
    grouped = grouped.join(docs.select("file", "doc_type", F.col("fingerprint.line_count").alias("total_lines")), "file").join(outline, "file", "left")
    doc = F.struct("file", "doc_type", "total_lines", "outline", F.transform("_t", lambda x: x["task"]).alias("tasks"))
    per = grouped.groupBy("batch").agg(F.sum(F.size("_t")).alias("tasks"), F.count("*").alias("documents"), F.array_sort(F.collect_list(F.struct("_first", doc.alias("doc")))).alias("_d"))
    name = F.concat(F.lit("batch-"), F.when(F.col("batch") < 1000, F.lpad(F.col("batch").cast("string"), 3, "0")).otherwise(F.col("batch").cast("string")))
    return per.select(name.alias("batch_id"), "tasks", "documents", F.to_json(F.struct(name.alias("batch_id"), F.transform("_d", lambda x: x["doc"]).alias("documents"))).alias("payload"))


#: A model: takes the tasks, returns task_id, summary, topics and metadata of each.
Summariser = Callable[[DataFrame], DataFrame]


def extractive(task_rows: DataFrame, config: Config | None = None) -> DataFrame:
    """The default in place of a model: the text's first words within the bounds, and its most frequent content words as topics."""
    config = config or Config()
    root = F.col("kind") == "root"
    most = F.when(root, config.root_summary_max_words).otherwise(config.node_summary_max_words)
    own = t.words(F.regexp_replace(F.coalesce("content", F.lit("")), r"[#>|`*\[\]()-]+", " "))
    found = t.tokens(F.col("content"))
    counted = F.transform(F.array_distinct(found), lambda w: F.struct(F.negative(F.size(F.filter(found, lambda x: x == w))).alias("n"), w.alias("w")))
    topics = F.transform(F.slice(F.array_sort(counted), 1, 5), lambda x: x["w"])
    return task_rows.select(
        "task_id",
        F.array_join(F.slice(own, F.lit(1), most), " ").alias("summary"),
        F.when(root, topics).alias("topics"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )


# ---- merge ------------------------------------------------------------------------------------------------------


def last_results(results: DataFrame) -> DataFrame:
    """The last result of each task, by (source, pos); results without a task_id are left out."""
    df = results.filter("task_id IS NOT NULL AND task_id <> ''")
    return df.groupBy("task_id").agg(F.max_by(F.struct("summary", "topics", "metadata"), F.struct("source", "pos")).alias("r")).select("task_id", "r.*")


def rejected_fields(results: DataFrame, extras: str = "extras") -> DataFrame:
    """Fields that a model has no business to set: task_id, field, source. extras: map of what a result had besides."""
    named = F.filter(F.map_keys(extras), lambda k: ~k.isin(*RESULT_FIELDS))
    return results.filter(F.col("task_id").isNotNull()).select("task_id", F.explode(named).alias("field"), "source")


def fold(docs: DataFrame, nodes: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs and nodes with the summaries of their results; what has no result keeps its own. Structure can't change: only
    the summary columns are written. docs gain topics and metadata."""
    got = last.withColumn("_got", F.col("summary").isNotNull() & (F.col("summary") != "")).withColumnsRenamed({"summary": "_s", "topics": "_t", "metadata": "_m"})
    of_node = F.concat_ws(":", t.stem(F.col("file")), F.col("node_id"))
    told = nodes.withColumn("task_id", of_node).join(got, "task_id", "left")
    told = told.withColumn("summary", F.when(F.coalesce("_got", F.lit(False)), F.col("_s")).otherwise(F.col("summary"))).select(*nodes.columns)
    roots = docs.withColumn("task_id", F.concat_ws(":", t.stem(F.col("file")), F.lit("__root__"))).join(got, "task_id", "left")
    has = F.coalesce("_got", F.lit(False))
    roots = roots.withColumns(
        {
            "root_summary": F.when(has, F.col("_s")).otherwise(F.col("root_summary")),
            "topics": F.coalesce(F.filter(F.when(has, F.col("_t")), lambda x: x.isNotNull()), F.array().cast("array<string>")),
            "metadata": F.coalesce("_m", F.create_map().cast("map<string,string>")),
        }
    )
    return roots.select(*docs.columns, "topics", "metadata"), told


def missing(task_rows: DataFrame, last: DataFrame) -> DataFrame:
    """Tasks without a summary."""
    return task_rows.join(last.filter("summary IS NOT NULL AND summary <> ''").select("task_id"), "task_id", "left_anti")


def signature(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per document a hash of everything but summaries."""
    shape = F.struct("path", "heading", "level", "node_id", "page_start", "page_end", "line_start", "line_end")
    rows = nodes.groupBy("file").agg(F.array_sort(F.collect_list(shape)).alias("_n"))
    df = docs.join(rows, "file", "left")
    return df.select("file", F.sha2(F.to_json(F.struct("file", "doc_type", "fingerprint", "page_start", "page_end", "_n")), 256).alias("signature"))


def ensure_unmutated(before: DataFrame, after: DataFrame) -> None:
    other = before.withColumnRenamed("signature", "_s").join(after, "file", "full").filter(~F.col("_s").eqNullSafe(F.col("signature")))
    found = other.select("file").limit(1).collect()
    if found:
        raise EngineError("structure_mutated", f"merging changed the structure of {found[0][0]}")


def judge(docs: DataFrame, nodes: DataFrame, source: DataFrame, missing_tasks: DataFrame, config: Config) -> DataFrame:
    """All findings on merged trees: file, task_id, scope, code. One with any is not published."""
    stem = t.stem(F.col("file"))
    root_id, node_id = F.concat_ws(":", stem, F.lit("__root__")), F.concat_ws(":", stem, F.col("node_id"))
    broken = validate.check_trees(docs, nodes, source, config).select("file", F.lit(None).cast("string").alias("task_id"), F.lit("structure").alias("scope"), "code")
    poor = quality.check_trees(docs, nodes, config).unionByName(quality.check_distinct(docs, config))
    poor = poor.select("file", F.when(F.col("scope").isin("root", "roots"), root_id).otherwise(node_id).alias("task_id"), "scope", "code")
    absent = missing_tasks.select("file", "task_id", F.lit("node").alias("scope"), F.lit("summary_missing").alias("code"))
    return broken.unionByName(poor).unionByName(absent)


def retry_tasks(findings: DataFrame) -> DataFrame:
    """What a model is to do again, with every reason."""
    return findings.filter("task_id IS NOT NULL").groupBy("file", "task_id").agg(F.array_sort(F.collect_set("code")).alias("reasons"))


def make_leaves(docs: DataFrame, config: Config, date_added: str) -> DataFrame:
    """The routing row of each document, with null for what isn't stated and null_fields naming those."""
    fields = config.schema_fields(F.col("doc_type"))
    group = F.coalesce(F.nullif(config.doc_group(F.col("doc_type")), F.lit("")), F.nullif(F.try_element_at("metadata", F.lit("doc_group")), F.lit("")))
    ext = F.map_from_entries(F.transform(fields, lambda f: F.struct(f, F.try_element_at("metadata", f))))
    df = docs.select(
        "file",
        "doc_type",
        group.alias("doc_group"),
        "topics",
        F.lit(date_added).alias("date_added"),
        F.nullif("root_summary", F.lit("")).alias("summary"),
        "tree_index",
        ext.alias("ext"),
    )
    lacking = F.filter(F.map_keys("ext"), lambda f: F.try_element_at("ext", f).isNull())
    return df.withColumn("null_fields", F.concat(lacking, F.when(F.col("doc_group").isNull(), F.array(F.lit("doc_group"))).otherwise(F.array().cast("array<string>"))))


def passing(leaves: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves without a finding, and the files that are excluded."""
    failed = findings.select("file").distinct()
    excluded = leaves.join(failed, "file", "left_semi").select("file", F.lit("failed_semantic_validation").alias("reason"))
    return leaves.join(failed, "file", "left_anti"), excluded
