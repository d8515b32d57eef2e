"""Checks of trees and of the routing table. Every rule gives rows of findings: file, node_id, code, detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphwood.config import Config
from glyphwood.functions import text as t

HEX64 = "^[0-9a-f]{64}$"
RESOLVED = ("resolved_node", "resolved_file")


def _rules(df: DataFrame, node: Column, rules: dict[str, Column], detail: Column | None = None) -> DataFrame:
    """A row for each broken rule of each row of df, in one pass."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules.items()]))
    told = detail if detail is not None else F.lit(None).cast("string")
    return df.select("file", node.alias("node_id"), F.explode(broken).alias("code"), told.alias("detail"))


def check_roots(docs: DataFrame, config: Config) -> DataFrame:
    pages = F.lit(config.page_numbers_in_citations)
    fp = F.col("fingerprint")
    return _rules(
        docs,
        F.lit(None).cast("string"),
        {
            "root_file_missing": t.is_blank(F.col("file")),
            "root_doc_type_missing": t.is_blank(F.col("doc_type")),
            "fingerprint_missing": fp.isNull(),
            "fingerprint_line_count": fp.isNotNull() & (F.coalesce(fp["line_count"], F.lit(0)) < 1),
            "fingerprint_sha256": fp.isNotNull() & ~F.coalesce(F.lower(fp["sha256"]).rlike(HEX64), F.lit(False)),
            "root_page_range_missing": pages & F.col("page_start").isNull(),
            "root_page_range_unexpected": ~pages & F.col("page_start").isNotNull(),
        },
    )


def check_shape(nodes: DataFrame, docs: DataFrame, config: Config) -> DataFrame:
    """Rules on single nodes; a node is a leaf if no other has its path as parent."""
    inner = nodes.filter("parent_id IS NOT NULL").select("file", F.col("parent_id").alias("node_id")).distinct().withColumn("_has", F.lit(True))
    counts = docs.select("file", F.col("fingerprint.line_count").alias("_count"))
    df = nodes.join(inner, ["file", "node_id"], "left").join(counts, "file", "left")
    leaf = F.col("_has").isNull()
    start, end = F.col("line_start"), F.col("line_end")
    refers = start.isNotNull() | end.isNotNull()
    whole = start.isNotNull() & end.isNotNull()
    pages = F.lit(config.page_numbers_in_citations)
    return _rules(
        df,
        F.col("node_id"),
        {
            "heading_missing": t.is_blank(F.col("heading")),
            "level_invalid": F.col("level").isNull() | (F.col("level") < 1),
            "node_id_missing": t.is_blank(F.col("node_id")),
            "leaf_without_content_ref": leaf & ~refers,
            "non_leaf_with_content_ref": ~leaf & refers,
            "content_ref_shape": refers & ~whole,
            "content_ref_start": whole & (start < 1),
            "content_ref_order": whole & (end < start),
            "content_ref_out_of_bounds": whole & (end > F.col("_count")),
            "page_range_missing": pages & F.col("page_start").isNull() & F.col("page_end").isNull(),
            "page_range_shape": pages & (F.col("page_start").isNull() != F.col("page_end").isNull()),
            "page_range_unexpected": ~pages & F.col("page_start").isNotNull(),
        },
    )


def check_ids(nodes: DataFrame) -> DataFrame:
    """Repeated ids, and ids that don't follow from the headings above them; both recomputed from paths and headings."""
    repeats = nodes.withColumn("_n", F.row_number().over(Window.partitionBy("file", "node_id").orderBy("path")))
    doubled = _rules(repeats, F.col("node_id"), {"node_id_duplicate": F.col("_n") > 1})
    above = F.slice("path", F.lit(1), F.size("path") - 1)
    df = nodes.withColumn("_above", above).withColumn("_slug", t.slug_or_line(F.col("heading"), F.coalesce("line_start", "line")))
    same = Window.partitionBy("file", "_above", "_slug").orderBy("ordinal")
    df = df.withColumn("_k", F.row_number().over(same))
    df = df.withColumn("_slug", F.when(F.col("_k") > 1, F.concat_ws("-", "_slug", F.col("_k").cast("string"))).otherwise(F.col("_slug")))
    upto = Window.partitionBy("file").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    deepest = 8  # six levels, one generated below them, one below a preamble
    chain = F.array(*[F.last(F.when(F.size("path") == k, F.col("_slug")), ignorenulls=True).over(upto) for k in range(1, deepest + 1)])
    df = df.withColumn("_due", F.concat_ws("_", t.stem(F.col("file")), F.slice(chain, F.lit(1), F.size("path"))))
    renamed = _rules(df, F.col("node_id"), {"node_id_mismatch": F.col("node_id") != F.col("_due")}, F.col("_due"))
    return doubled.unionByName(renamed)


def owned_lines(nodes: DataFrame, source: DataFrame) -> DataFrame:
    """Every line of a body with its owners among the leaves: file, n, substantive, is_heading, owners (how many), and two of
    their ids. Ranges are cut at the document's lines, whatever they claim (content_ref_out_of_bounds tells of the rest).

    Numbers only: no text is shuffled.
    """
    leaves = nodes.filter("is_leaf AND line_start <= line_end").join(source.select("file", "total_lines"), "file")
    start, end = F.greatest("line_start", F.lit(1)), F.least("line_end", "total_lines")
    claims = leaves.withColumns({"_s": start, "_e": end}).filter("_s <= _e").select("file", "node_id", F.explode(F.sequence("_s", "_e")).alias("n"))
    owners = claims.groupBy("file", "n").agg(F.count("*").alias("owners"), F.min("node_id").alias("owner"), F.max("node_id").alias("other"))
    lean = F.transform("lines", lambda x: F.struct(x["n"].alias("n"), x["substantive"].alias("substantive"), (x["level"] > 0).alias("is_heading")))
    body = t.exploded(source, lean, "file")
    return body.join(owners, ["file", "n"], "full").withColumns({"owners": F.coalesce("owners", F.lit(0)), "substantive": F.coalesce("substantive", F.lit(False))})


def coverage(nodes: DataFrame, source: DataFrame) -> DataFrame:
    """Per document: coverable and covered lines, their ratio, uncovered and overlapping lines, exempt heading lines."""
    df = owned_lines(nodes, source)
    counts = df.groupBy("file").agg(
        F.count_if("substantive").alias("_substantive"),
        F.count_if(F.col("substantive") & (F.col("owners") > 0)).alias("covered_lines"),
        F.count_if(F.col("substantive") & (F.col("owners") == 0) & F.col("is_heading")).alias("structural_heading_lines"),
        F.count_if(F.col("substantive") & (F.col("owners") == 0) & ~F.col("is_heading")).alias("uncovered_count"),
        F.sum(F.greatest(F.col("owners") - 1, F.lit(0))).alias("overlapping"),
    )
    coverable = F.col("_substantive") - F.col("structural_heading_lines")
    ratio = F.when(coverable == 0, F.lit(1.0)).otherwise(F.round(F.try_divide(F.col("covered_lines"), coverable), 4))
    return counts.select("file", coverable.alias("coverable_lines"), "covered_lines", ratio.alias("coverage_ratio"), "uncovered_count", "structural_heading_lines", "overlapping")


def check_coverage(nodes: DataFrame, source: DataFrame) -> DataFrame:
    """A finding per overlapping line and one per document with uncovered lines (its first fifty named)."""
    df = owned_lines(nodes, source)
    none = F.lit(None).cast("string")
    twice = df.filter("owners > 1").select("file", none.alias("node_id"), F.lit("overlapping_leaf_ranges").alias("code"), F.concat(F.col("n").cast("string"), F.lit(": "), "owner", F.lit(", "), "other").alias("detail"))
    bare = df.filter("substantive AND owners = 0 AND NOT is_heading")
    rank = F.row_number().over(Window.partitionBy("file").orderBy("n"))
    named = bare.withColumn("_r", rank).groupBy("file").agg(F.array_sort(F.collect_list(F.when(F.col("_r") <= 50, F.col("n")))).alias("_n"))
    lost = named.select("file", none.alias("node_id"), F.lit("uncovered_substantive_lines").alias("code"), F.array_join("_n", ",").alias("detail"))
    return twice.unionByName(lost)


def check_sources(docs: DataFrame, source: DataFrame) -> DataFrame:
    """Trees whose source has changed. Trees without a source give no finding here."""
    now = source.select("file", F.col("fingerprint").alias("_now"))
    df = docs.filter("fingerprint IS NOT NULL").join(now, "file")
    return _rules(df, F.lit(None).cast("string"), {"fingerprint_mismatch": F.col("fingerprint") != F.col("_now")})


def check_cross_refs(refs: DataFrame) -> DataFrame:
    """refs(file, node_id, idx, type, raw, target, resolved_node, resolved_file): rules on the fields that are there."""
    node, file = (F.col(c) if c in refs.columns else F.lit(None).cast("string") for c in RESOLVED)
    return _rules(
        refs,
        F.col("node_id"),
        {
            "cross_ref_type": ~F.coalesce(F.col("type").isin("intra", "inter"), F.lit(False)),
            "cross_ref_raw": t.is_blank(F.col("raw")),
            "cross_ref_target": t.is_blank(F.col("target")),
            "cross_ref_resolved_node_type": node.isNotNull() & t.is_blank(node),
            "cross_ref_resolved_file_type": file.isNotNull() & t.is_blank(file),
        },
    )


def check_cross_ref_fields(refs: DataFrame) -> DataFrame:
    """Every reference must carry its resolutions, null or not: a column that isn't there is missing in all."""
    return _rules(refs, F.col("node_id"), {f"cross_ref_{c}_missing": F.lit(c not in refs.columns) for c in RESOLVED})


def check_trees(docs: DataFrame, nodes: DataFrame, source: DataFrame, config: Config, refs: DataFrame | None = None) -> DataFrame:
    """All findings on trees, structure, coverage and staleness; coverage of documents that have both source and tree."""
    held = nodes.join(source.select("file"), "file", "left_semi")
    known = source.join(docs.select("file"), "file", "left_semi")
    parts = [check_roots(docs, config), check_shape(nodes, docs, config), check_ids(nodes), check_coverage(held, known), check_sources(docs, source)]
    if refs is not None:
        parts += [check_cross_refs(refs), check_cross_ref_fields(refs)]
    return reduce(DataFrame.unionByName, parts)


def check_leaves(leaves: DataFrame, trees: DataFrame, config: Config, routing: DataFrame | None = None) -> DataFrame:
    """Findings on the routing table. leaves: one row per document; trees(tree_index): those there are.

    routing: the nodes above the leaves as `routing.nodes` gives them, for the rules on those.
    """
    known = trees.select("tree_index").distinct().withColumn("_there", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("file").orderBy("tree_index"))
    df = leaves.withColumn("_nth", nth).join(known, "tree_index", "left")
    name = F.col("tree_index")
    none = t.is_blank(name)
    path = name.contains("/") | name.contains("\\")
    out = _rules(
        df,
        F.lit(None).cast("string"),
        {
            "leaf_summary_missing": t.is_blank(F.col("summary")),
            "leaf_tree_index_missing": none,
            "leaf_tree_index_path": ~none & path,
            "leaf_tree_index_dangling": ~none & ~path & F.col("_there").isNull(),
            "leaf_duplicate_file": ~t.is_blank(F.col("file")) & (F.col("_nth") > 1),
        },
        name,
    )
    absent = [f for f in config.base_schema if f not in leaves.columns]
    if absent:
        out = out.unionByName(leaves.select("file", F.lit(None).cast("string").alias("node_id"), F.lit("leaf_missing_base_field").alias("code"), F.explode(F.array(*[F.lit(f) for f in absent])).alias("detail")))
    if routing is not None:
        fields = F.array(*[F.lit(f) for f in config.hierarchy_fields])
        due = F.get(fields, F.col("depth") - 1)
        up = routing.withColumn("file", F.lit(None).cast("string"))
        out = out.unionByName(
            _rules(
                up,
                F.lit(None).cast("string"),
                {
                    "node_type_invalid": ~F.col("type").isin("root", "intermediate", "leaf"),
                    "hierarchy_field_mismatch": (F.col("type") == "intermediate") & ~F.col("field").eqNullSafe(due),
                    "intermediate_empty": (F.col("type") == "intermediate") & (F.col("documents") == 0),
                    "leaf_depth_mismatch": (F.col("type") == "leaf") & (F.col("depth") != len(config.hierarchy_fields)),
                },
                F.array_join("path", " > "),
            )
        )
    return out
