"""The engine's queries over the driver's tables, by name. Each has an equal in `oracle.py`, but for the search itself.

The vault of these queries holds every document (as Markdown), every page and a redirect for each benchmark item.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphwood.config import Config
from glyphwood.functions import text as t
from glyphwood.operators import classify as classes
from glyphwood.operators import cross_refs as refs
from glyphwood.operators import maintenance, parse, publish, quality, routing, search, semantic, similarity, tree, validate
from glyphwood.sources import scratch, vault

Query = Callable[[SparkSession, str], DataFrame]

CONFIG = Config(
    doc_type_path_mappings={
        "article": [f"src{n}" for n in range(0, 64, 3)],
        "report": [f"src{n}" for n in range(1, 64, 3)],
        "note": [f"src{n}" for n in range(2, 64, 3)],
        "brief": "src1/en",
        "web": "pages/",
        "notice": "./moved",
    },
    doc_groups={"article": "editorial", "brief": "editorial", "report": "internal", "web": "external"},
    schemas={"article": ("edition", "lang"), "report": ("lang", "region")},
    cross_type_join_fields={"language": {"article": "lang", "report": "lang", "brief": "lang"}},
    fallback_chunk_size_lines=10,
    max_section_size_lines=25,
    hierarchy_fields=("doc_group", "lang", "doc_type"),
)
#: The same with one level, for tables of leaves without a language.
BY_GROUP = CONFIG.with_(hierarchy_fields=("doc_group", "doc_type"))

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def source_map(spark: SparkSession, sf: str) -> DataFrame:
    return parse.source_map(vault.table_vault(spark, sf))


def substantive(spark: SparkSession, sf: str) -> DataFrame:
    """The source map of what gets a tree."""
    return classes.substantive(source_map(spark, sf), CONFIG).filter("doc_type IS NOT NULL")


def nodes_of(spark: SparkSession, sf: str) -> DataFrame:
    return tree.build(substantive(spark, sf), CONFIG)


def outlines(spark: SparkSession, sf: str) -> DataFrame:
    """The source map of what gets a tree without texts of lines, parsed once for queries that look at it more than once."""
    slim = F.transform("lines", lambda x: F.struct(x["n"].alias("n"), x["substantive"].alias("substantive"), x["level"].alias("level")))
    kept = substantive(spark, sf).select("file", "total_lines", "body_start", "headings", "page_markers", "last_substantive_line", "fingerprint", slim.alias("lines"))
    return scratch.written(kept, "outlines")


def trees(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Roots and nodes, made once."""
    whole = outlines(spark, sf)
    return tree.documents(whole, CONFIG), scratch.written(tree.build(whole, CONFIG), "nodes")


def kinds_of(spark: SparkSession, sf: str) -> DataFrame:
    """All sources classified, parsed once, with their last substantive line as _n."""
    kinds = classes.classify(source_map(spark, sf), CONFIG, "last_substantive_line").drop("local_targets")
    return scratch.written(kinds.withColumnRenamed("last_substantive_line", "_n"), "kinds")


# ---- sources and parsing ------------------------------------------------------------------------------------------


@query
def vault_(spark: SparkSession, sf: str) -> DataFrame:
    return vault.table_vault(spark, sf)


@query
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return vault.table_vault(spark, sf).select("file", t.fingerprint(F.col("content")).alias("f")).select("file", "f.*")


@query
def lines(spark: SparkSession, sf: str) -> DataFrame:
    return parse.lines(source_map(spark, sf)).select("file", *long("n"), "text", "in_code", "substantive", *long("level"), "underline")


@query
def frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    return source_map(spark, sf).select("file", *long("frontmatter_end", "total_lines"))


@query
def headings(spark: SparkSession, sf: str) -> DataFrame:
    return parse.headings(source_map(spark, sf)).select("file", *long("line", "level"), "text", "kind", *long("underline_line"))


@query
def fences(spark: SparkSession, sf: str) -> DataFrame:
    return parse.fences(source_map(spark, sf)).select("file", F.col("start").cast("long").alias("start_line"), F.col("end").cast("long").alias("end_line"), "unterminated")


@query
def page_markers(spark: SparkSession, sf: str) -> DataFrame:
    return parse.page_markers(source_map(spark, sf)).select("file", *long("line", "page"), "pattern")


@query
def page_at_asof(spark: SparkSession, sf: str) -> DataFrame:
    """The page in effect at every line, each line joined to the last marker at or before it."""
    whole = source_map(spark, sf)
    return whole.select("file", "page_markers", F.explode_outer(F.sequence(F.lit(1), "total_lines")).alias("n")).select("file", *long("n"), parse.page_at(F.col("page_markers"), F.col("n")).alias("page"))


@query
def links(spark: SparkSession, sf: str) -> DataFrame:
    return parse.links(source_map(spark, sf)).select("file", *long("line", "idx"), "text", "target")


@query
def resolve_links(spark: SparkSession, sf: str) -> DataFrame:
    found = parse.links(source_map(spark, sf)).filter(classes.is_local_markdown(F.col("target")))
    return found.select("file", *long("line", "idx"), "target", classes.resolve(F.col("file"), F.col("target")).alias("resolved"))


@query
def doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    return source_map(spark, sf).select("file", *long("substantive_count", "last_substantive_line", "prose_words", "non_link_words", "code_blocks"))


@query
def classify(spark: SparkSession, sf: str) -> DataFrame:
    return classes.classify(source_map(spark, sf), CONFIG).select("file", "classification", "indexed", "alias_target", "doc_type")


@query
def scan_summary(spark: SparkSession, sf: str) -> DataFrame:
    return classes.scan_summary(classes.scan(classes.classify(source_map(spark, sf), CONFIG)))


@query
def aliases(spark: SparkSession, sf: str) -> DataFrame:
    return classes.aliases(kinds_of(spark, sf))


@query
def doc_type_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return vault.table_vault(spark, sf).select("file", CONFIG.doc_type(F.col("file")).alias("doc_type"))


@query
def pdf_assembly(spark: SparkSession, sf: str) -> DataFrame:
    return vault.paged(spark.read.parquet(f"{sf}/conversations.parquet").filter("conv_id IS NOT NULL"), "conv_id", "turn", "text")


# ---- trees ------------------------------------------------------------------------------------------------------


@query
def sections(spark: SparkSession, sf: str) -> DataFrame:
    whole = scratch.written(substantive(spark, sf).select("file", "headings", "last_substantive_line"), "headings")
    return tree.sections(parse.headings(whole), whole.select("file", "last_substantive_line")).select("file", *long("line", "level"), "heading", *long("parent_line", "end_line"))


@query
def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return nodes_of(spark, sf).select(
        "file", "node_id", "parent_id", F.array_join("path", ".").alias("path"), *long("depth", "level"), "heading",
        F.array_join("heading_path", " > ").alias("heading_path"), *long("line_start", "line_end"), "is_leaf", "generated",
    )


@query
def generated_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return nodes_of(spark, sf).filter("generated IS NOT NULL AND is_leaf").select("file", "generated", "heading", *long("level", "line_start", "line_end"))


@query
def tree_stats(spark: SparkSession, sf: str) -> DataFrame:
    return tree.stats(nodes_of(spark, sf))


@query
def subtree_range(spark: SparkSession, sf: str) -> DataFrame:
    return tree.subtree_ranges(nodes_of(spark, sf)).select("file", "node_id", *long("range_start", "range_end"))


@query
def outline(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("file").orderBy("path"))
    return nodes_of(spark, sf).select("file", order.cast("long").alias("pre_order"), "node_id", F.array_join("heading_path", " > ").alias("heading_path"))


@query
def sibling_headings(spark: SparkSession, sf: str) -> DataFrame:
    return semantic.sibling_headings(nodes_of(spark, sf)).select("file", "node_id", F.array_join("sibling_headings", "|").alias("siblings"))


@query
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return validate.coverage(nodes_of(spark, sf), source_map(spark, sf))


@query
def coverage_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.coverage_histogram(coverage(spark, sf))


@query
def tree_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Every tree with leaves spoilt by their first line, against the rules on shape and coverage."""
    whole = outlines(spark, sf)
    good = tree.build(whole, CONFIG)
    kind = F.col("line_start") % 10
    end = F.when(kind == 1, F.col("line_end") + 1).when(kind == 2, F.col("line_start") - 1).when(kind == 3, 100_000).otherwise(F.col("line_end")).cast("int")
    bad = scratch.written(good.withColumns({"line_end": end, "heading": F.when(kind == 4, None).otherwise(F.col("heading"))}), "nodes")
    found = validate.check_shape(bad, tree.documents(whole, CONFIG), CONFIG).unionByName(validate.check_coverage(bad, whole))
    return found.select("file", "node_id", "code")


# ---- similarity and quality -----------------------------------------------------------------------------------------


@query
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.array_join(t.tokens(F.col("text")), " ").alias("tokens"))


def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    df = documents(spark, sf).select("doc_id", t.lines(F.col("text")).alias("ls"))
    before = F.transform("ls", lambda x, i: F.struct(x.alias("text"), F.coalesce(F.get("ls", i - 1), F.lit("")).alias("heading")))
    return df.select("doc_id", F.posexplode(before).alias("n", "x")).select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "x.*")


@query
def similar_siblings(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each document that are similar to each other."""
    return similarity.similar_pairs(text_lines(spark, sf), ["doc_id"], "n", "text", 0.5)


@query
def root_collisions(spark: SparkSession, sf: str) -> DataFrame:
    told = documents(spark, sf).filter(~t.is_blank(F.col("text")))
    return similarity.later_items(told, [], "doc_id", "text", CONFIG.root_summary_similarity_max)


@query
def quality_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Every line as a summary below its predecessor as heading, with openings that the rules know."""
    n, text = F.col("n"), F.col("text")
    said = (
        F.when(n % 8 == 0, text)
        .when(n % 8 == 1, F.concat(F.lit("This section describes "), text))
        .when(n % 8 == 2, F.concat(F.lit("Documentation covering "), text))
        .when(n % 8 == 3, F.concat(F.lit("Information about "), text))
        .when(n % 8 == 4, F.concat(F.lit("Redirecting "), text))
        .when(n % 8 == 5, "An overview of the main section.")
        .when(n % 8 == 6, F.col("heading"))
        .otherwise(F.concat(F.lit("This document contains information on "), text))
    )
    return text_lines(spark, sf).select("doc_id", "n", F.array_join(quality.codes(said, F.col("heading"), n == 1, CONFIG), ",").alias("codes"))


# ---- model work -------------------------------------------------------------------------------------------------


def tasks(spark: SparkSession, sf: str, docs: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    if docs is None:
        docs, nodes = trees(spark, sf)
    return semantic.tasks(nodes, docs, vault.table_vault(spark, sf), CONFIG)


def task_ids(spark: SparkSession, sf: str, docs: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """task_id and file of all tasks, without their contents."""
    if docs is None:
        docs, nodes = trees(spark, sf)
    named = vault.table_vault(spark, sf).select("file", F.lit(None).cast("string").alias("content"))
    return scratch.written(semantic.tasks(nodes, docs, named, CONFIG).select("task_id", "file"), "task-ids")


@query
def content_slice(spark: SparkSession, sf: str) -> DataFrame:
    return tasks(spark, sf).select("task_id", "file", "content", "size")


def packed(spark: SparkSession, sf: str, *made: DataFrame) -> DataFrame:
    queue = scratch.written(tasks(spark, sf, *made).select("task_id", "file", "kind", "path", "size"), "queue")  # cutting ranges looks at it twice
    return semantic.pack(semantic.numbered(queue, "file", F.col("kind") == "root", "path"), CONFIG)


@query
def packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed(spark, sf).select("task_id", *long("batch"))


@query
def batches(spark: SparkSession, sf: str) -> DataFrame:
    docs, nodes = trees(spark, sf)
    made = semantic.batches(packed(spark, sf, docs, nodes), docs, nodes)
    return made.select("batch_id", *long("tasks", "documents"))


def results(task_rows: DataFrame) -> DataFrame:
    """What a careless model might return: nothing, null, empty, twice, and fields it may not set."""
    of, n = F.col("task_id"), F.length("task_id")
    first = F.when(n % 5 == 1, None).when(n % 5 == 2, "").otherwise(F.concat(F.lit("Summary of "), of))
    second = F.concat(F.lit("Second summary of "), of)
    rows = F.array_compact(F.array(F.when(n % 5 != 0, F.struct(F.lit("a").alias("source"), first.alias("summary"))), F.when(n % 3 == 0, F.struct(F.lit("b").alias("source"), second.alias("summary")))))
    extras = F.when(n % 7 == 0, F.create_map(F.lit("children"), F.lit("[]"))).otherwise(F.create_map().cast("map<string,string>"))
    df = task_rows.select("task_id", F.explode(rows).alias("x"), extras.alias("extras"))
    return df.select("task_id", "x.*", F.lit(0).alias("pos"), F.array().cast("array<string>").alias("topics"), F.create_map().cast("map<string,string>").alias("metadata"), "extras")


@query
def merge_results(spark: SparkSession, sf: str) -> DataFrame:
    docs, nodes = trees(spark, sf)
    last = semantic.last_results(results(task_ids(spark, sf, docs, nodes)))
    _, told = semantic.fold(docs, nodes, last)
    return told.select("file", "node_id", "summary")


@query
def missing_results(spark: SparkSession, sf: str) -> DataFrame:
    ids = task_ids(spark, sf)
    return semantic.missing(ids, semantic.last_results(results(ids))).select("task_id", "file")


@query
def rejected_fields(spark: SparkSession, sf: str) -> DataFrame:
    return semantic.rejected_fields(results(task_ids(spark, sf)))


# ---- leaves and routing -------------------------------------------------------------------------------------------


def leaf_docs(all_kinds: DataFrame) -> DataFrame:
    """Roots of trees as merged: summary and metadata from what the parser has counted."""
    kinds = all_kinds.filter("indexed AND doc_type IS NOT NULL")
    n = F.col("headings")
    told = F.concat(F.lit("Covers "), n.cast("string"), F.lit(" sections and "), F.col("prose_words").cast("string"), F.lit(" words"))
    return kinds.select(
        "file",
        "doc_type",
        t.tree_file(F.col("file")).alias("tree_index"),
        F.when(F.col("substantive_lines") % 9 != 0, told).alias("root_summary"),
        F.array().cast("array<string>").alias("topics"),
        F.create_map(F.lit("lang"), F.get(F.split("file", "/"), F.lit(1)), F.lit("edition"), F.when(n % 5 != 0, n.cast("string"))).alias("metadata"),
        "fingerprint",
    )


def leaves_of(kinds: DataFrame) -> DataFrame:
    return semantic.make_leaves(leaf_docs(kinds), CONFIG, "2026-01-01")


def leaves(spark: SparkSession, sf: str) -> DataFrame:
    return leaves_of(kinds_of(spark, sf))


def ext(name: str) -> Column:
    return F.try_element_at("ext", F.lit(name)).alias(name)


@query
def leaf_build(spark: SparkSession, sf: str) -> DataFrame:
    return leaves(spark, sf).select("file", "doc_type", "doc_group", "tree_index", "summary", ext("lang"), ext("edition"), F.array_join(F.array_except("null_fields", F.array(F.lit("region"))), ",").alias("null_fields"))


@query
def routing_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return routing.rollup(leaves(spark, sf), CONFIG).select("doc_group", "lang", "documents", *long("level"))


@query
def routing_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return routing.nodes(leaves(spark, sf), CONFIG).select("type", F.array_join("path", "/").alias("path"), "documents")


@query
def unknown_fields(spark: SparkSession, sf: str) -> DataFrame:
    return routing.placed(leaves(spark, sf), CONFIG).select("file", F.array_join("unknown_fields", ",").alias("unknown_fields"), "value")


@query
def unknown_groupings(spark: SparkSession, sf: str) -> DataFrame:
    return routing.unknown_groupings(leaves(spark, sf), CONFIG).select(F.array_join("path", "/").alias("path"), "documents", F.array_join("files", ",").alias("files"))


@query
def remove_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Without two types: groups that held nothing else are gone."""
    all_leaves = leaves(spark, sf)
    left = routing.remove(all_leaves, all_leaves.filter("doc_type IN ('web', 'report')"))
    return routing.nodes(left, BY_GROUP).filter("type = 'intermediate'").select(F.col("value").alias("doc_group"), "documents")


@query
def alias_upsert(spark: SparkSession, sf: str) -> DataFrame:
    found = parse.links(source_map(spark, sf)).filter(classes.is_local_markdown(F.col("target")))
    old = found.groupBy(F.col("file").alias("from_file")).agg(F.min_by(classes.resolve(F.col("file"), F.col("target")), F.struct("line", "idx")).alias("to_file"))
    new = vault.table_vault(spark, sf).filter(F.length("file") % 3 == 0).select(F.col("file").alias("from_file"), F.concat("file", F.lit(".new")).alias("to_file"))
    return routing.upsert_aliases(old, new)


# ---- maintenance ------------------------------------------------------------------------------------------------


def synced(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classified sources, and an index that has missed some documents and changes, by their last line."""
    whole = source_map(spark, sf)
    kinds = classes.classify(whole, CONFIG)
    state = whole.select("file", (F.col("last_substantive_line") % 7).alias("k"), "fingerprint")
    gone = state.filter("k = 4").select(F.concat("file", F.lit(".gone.md")).alias("file"), F.lit(0).alias("k"), "fingerprint")
    had = state.filter("k > 0").unionByName(gone).withColumn("tree_index", t.tree_file(F.col("file")))
    other = F.struct(F.col("fingerprint.line_count").alias("line_count"), F.lit("0" * 64).alias("sha256"))
    docs = had.filter("k <> 1").select("tree_index", F.when(F.col("k") == 3, other).when(F.col("k") != 2, F.col("fingerprint")).alias("fingerprint"))
    return kinds, had.select("file", "tree_index"), docs


@query
def sync_diff(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.sync_plan(*synced(spark, sf)).select("file", "action", "staleness")


@query
def sync_totals(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.sync_totals(maintenance.sync_plan(*synced(spark, sf)))


@query
def rebuild(spark: SparkSession, sf: str) -> DataFrame:
    kinds = kinds_of(spark, sf)
    docs = leaves_of(kinds).join(kinds.select("file", "_n"), "file")
    meta = F.struct("doc_type", "doc_group", "topics", "date_added", "summary")
    roots = docs.select("file", "doc_type", "tree_index", meta.alias("index_metadata"), F.when(F.col("_n") % 2 == 0, "recovered").alias("root_summary"))
    return publish.rebuilt(roots, CONFIG)[0].select("file", "doc_type", "doc_group", "tree_index", "summary")


def loose_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves from before the schemas: all have the same two further fields."""
    kinds = kinds_of(spark, sf)
    return leaves_of(kinds).drop("ext").join(leaf_docs(kinds).select("file", F.col("metadata").alias("ext")), "file")


@query
def schema_diff(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.schema_diff(loose_leaves(spark, sf), CONFIG).select("file", F.array_join("missing", ",").alias("missing"), F.array_join("obsolete", ",").alias("obsolete"))


@query
def migrate(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.migrate(loose_leaves(spark, sf), CONFIG).select("file", F.array_join(F.map_values("ext"), "|", "null").alias("ext"))


@query
def doctor_counts(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.counts(leaves(spark, sf))


@query
def null_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.null_metadata(leaves(spark, sf), CONFIG).select("file", F.array_join("fields", ",").alias("fields"))


def shaken(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Leaves and trees, some of either without the other."""
    kinds = kinds_of(spark, sf)
    all_leaves = leaves_of(kinds).join(kinds.select("file", "_n"), "file")
    return all_leaves, all_leaves.filter("_n % 7 <> 1").select("file", "tree_index")


@query
def orphans_dangling(spark: SparkSession, sf: str) -> DataFrame:
    all_leaves, trees = shaken(spark, sf)
    return maintenance.orphans(all_leaves.filter("_n % 7 <> 0"), trees)


@query
def index_findings(spark: SparkSession, sf: str) -> DataFrame:
    all_leaves, trees = shaken(spark, sf)
    return validate.check_leaves(all_leaves.drop("_n"), trees, CONFIG).select("file", "code")


@query
def doctor(spark: SparkSession, sf: str) -> DataFrame:
    all_leaves, trees = shaken(spark, sf)
    kept = all_leaves.drop("_n")
    lost = all_leaves.filter("_n % 7 = 0").select(F.concat(F.lit("lost_"), "tree_index").alias("tree_index"))
    found = maintenance.doctor(kept, trees.select("tree_index").unionByName(lost), BY_GROUP)
    return found.groupBy("severity", "code").agg(F.count("*").alias("findings"))


# ---- search -----------------------------------------------------------------------------------------------------


@query
def cross_type_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = leaf_docs(kinds_of(spark, sf)).withColumn("ext", F.col("metadata"))
    return search.cross_type_join(docs.drop("metadata"), CONFIG, "language")


@query
def cross_refs(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("classification")
    told = classes.with_class(source_map(spark, sf), CONFIG)
    parts = told.select(
        "file", "lines", "links", "headings", "body_start", "last_substantive_line", "classification", "doc_type", (kind == "substantive").alias("indexed"),
        F.when(kind == "redirect", F.get("local_targets", F.lit(0))).alias("alias_target"),
    )
    whole = scratch.written(parts, "source-map")
    kept = whole.filter("indexed AND doc_type IS NOT NULL")
    found = refs.detect(kept, scratch.written(tree.build(kept, CONFIG), "nodes"), kept.select("file"), classes.aliases(whole))
    return found.filter("type = 'inter'").select("file", "node_id", "raw", "target", "resolved_file")


def question_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as leaves whose summary is their text."""
    file = F.concat("lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return documents(spark, sf).filter("text IS NOT NULL").select(file.alias("file"), F.lit(None).cast("string").alias("tree_index"), F.col("text").alias("summary"), F.array().cast("array<string>").alias("topics"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


@query
def routing_candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = search.routing_candidates(questions(spark, sf), question_leaves(spark, sf), CONFIG, CONFIG.max_nodes)
    return found.select(F.col("query_id").alias("item_id"), "file", F.round("score", 4).alias("score"), *long("rank"))


@query
def citations(spark: SparkSession, sf: str) -> DataFrame:
    """The citation of every leaf, with pages and staleness."""
    whole = substantive(spark, sf)
    made = tree.build(whole, CONFIG.with_(page_numbers_in_citations=True)).filter("is_leaf")
    stale = F.when(F.length("file") % 3 == 0, "stale").otherwise("current")
    cited = search.citation(F.col("file"), F.col("heading_path"), F.col("line_start"), F.col("line_end"), F.col("page_start"), F.col("page_end"), stale)
    return made.select(cited.alias("citation"))


@query
def staleness(spark: SparkSession, sf: str) -> DataFrame:
    sources = vault.table_vault(spark, sf)
    docs = tree.documents(substantive(spark, sf), CONFIG)
    k = F.length("file") % 3
    other = F.struct(F.col("fingerprint.line_count").alias("line_count"), F.lit("0" * 64).alias("sha256"))
    docs = docs.withColumn("fingerprint", F.when(k == 0, other).when(k == 2, F.col("fingerprint")))
    return search.staleness(docs, sources).select("file", "staleness")


@query
def routing_descent(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of the routing index that the benchmark's items, as questions about many documents, read: root, sources,
    languages, documents."""
    leaf_rows = scratch.written(documents(spark, sf).filter("text IS NOT NULL").select(
        F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), F.lit("x").alias("doc_type"), F.col("source").alias("doc_group"), "lang",
        F.lit(None).cast("string").alias("tree_index"), F.col("text").alias("summary"), F.array().cast("array<string>").alias("topics")), "leaves")
    route = search.routing_descent(questions(spark, sf), leaf_rows, CONFIG, CONFIG.max_nodes, "aggregation")
    return route.visited.select(F.col("query_id").alias("item_id"), *long("depth", "rank"), F.array_join("path", "/").alias("path"), "file", F.round("score", 4).alias("score"))


def told_nodes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Source map, roots and nodes, with the first words of a node's text as its summary."""
    whole = scratch.written(substantive(spark, sf), "source-map")
    made, docs = scratch.written(tree.build(whole, CONFIG), "nodes"), tree.documents(whole, CONFIG)
    told = semantic.tasks(made, docs, vault.table_vault(spark, sf), CONFIG).filter("kind = 'node'").select("file", "node_id", F.substring("content", 1, 200).alias("summary"))
    return whole, docs, scratch.written(made.drop("summary").join(told, ["file", "node_id"]), "told")


@query
def descent_visited(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of a tree that the benchmark's items peek at, in the documents that hold most of their words."""
    _, _, told = told_nodes(spark, sf)
    name = F.concat(F.lit("src"), F.regexp_extract("file", "^src([0-9]+)/", 1))
    texts = vault.table_vault(spark, sf).select("file", F.col("content").alias("summary"), F.array().cast("array<string>").alias("topics"), name.alias("tree_index"))
    kept = texts.join(told.select("file").distinct(), "file", "left_semi")
    found = scratch.written(search.routing_candidates(questions(spark, sf), kept, CONFIG, 3), "candidates")
    way = search.descend(found, told, CONFIG.max_nodes_per_query, CONFIG.max_depth_per_branch)
    return way.visited.select(F.col("query_id").alias("item_id"), "file", "node_id", *long("depth"), F.round("score", 4).alias("score"))


@query
def tree_descent(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's items as questions to the whole vault: every citation within the budgets."""
    whole, docs, told = told_nodes(spark, sf)
    leaf_rows = docs.select("file", "tree_index", "doc_type", CONFIG.doc_group(F.col("doc_type")).alias("doc_group"), F.get(F.split("file", "/"), F.lit(1)).alias("lang"), F.array().cast("array<string>").alias("topics"))
    leaf_rows = scratch.written(leaf_rows.join(whole.select("file", F.col("prose").alias("summary")), "file"), "leaves")
    docs = scratch.written(docs, "docs")
    found = search.explore(questions(spark, sf), leaf_rows, docs, told, vault.table_vault(spark, sf), CONFIG, "aggregation", stage=scratch.stage).cited
    return found.select("query_id", *long("rank"), "file", "node_id", *long("line_start", "line_end"), "score", "staleness", "citation")


@query
def tree_json(spark: SparkSession, sf: str) -> DataFrame:
    """Every tree as nested JSON."""
    whole = substantive(spark, sf)
    return tree.to_json(tree.documents(whole, CONFIG), tree.build(whole, CONFIG))


QUERIES["vault"] = QUERIES.pop("vault_")
