"""Keeping an index in step: differences to the sources, schema migration, and health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphwood.config import Config
from glyphwood.operators import quality, routing, validate


def sync_plan(classified: DataFrame, leaves: DataFrame, docs: DataFrame) -> DataFrame:
    """Every source and every leaf with what is to be done: file, classification, action, reason, staleness.

    Actions: ingest, exclude, modify, remove, unchanged.
    """
    now = classified.select("file", "classification", "indexed", F.col("fingerprint").alias("_now"), F.lit(True).alias("_here"))
    had = leaves.select("file", "tree_index", F.lit(True).alias("_leaf")).dropDuplicates(["file"])
    trees = docs.select("tree_index", F.col("fingerprint").alias("_was"), F.lit(True).alias("_tree")).dropDuplicates(["tree_index"])
    df = now.join(had, "file", "full").join(trees, "tree_index", "left")
    here, leaf = F.col("_here").isNotNull(), F.col("_leaf").isNotNull()
    action = (
        F.when(~here, "remove")
        .when(~leaf & F.col("indexed"), "ingest")
        .when(~leaf, "exclude")
        .when(~F.col("indexed"), "remove")
        .when(F.col("_tree").isNull(), "modify")
        .when(F.col("_was").isNull(), "unchanged")
        .when(F.col("_was") != F.col("_now"), "modify")
        .otherwise("unchanged")
    )
    reason = (
        F.when(~here, "source_gone")
        .when(leaf & ~F.col("indexed"), F.concat(F.lit("reclassified_as_"), "classification"))
        .when(leaf & F.col("_tree").isNull(), "tree_missing")
        .when(F.col("_was") != F.col("_now"), "source_changed")
    )
    staleness = F.when(leaf & here & F.col("_tree").isNotNull(), F.when(F.col("_was").isNull(), "unknown").when(F.col("_was") == F.col("_now"), "current").otherwise("stale"))
    return df.select("file", "classification", action.alias("action"), reason.alias("reason"), staleness.alias("staleness"), here.alias("on_disk"), leaf.alias("has_leaf"))


def sync_totals(plan: DataFrame) -> DataFrame:
    count = lambda a: F.count_if(F.col("action") == a)
    return plan.agg(
        F.count_if("on_disk").alias("on_disk"),
        F.count_if("has_leaf").alias("indexed"),
        count("ingest").alias("to_ingest"),
        count("modify").alias("to_modify"),
        count("remove").alias("to_remove"),
        count("unchanged").alias("unchanged"),
        count("exclude").alias("excluded"),
    )


# ---- schema -----------------------------------------------------------------------------------------------------


def schema_diff(leaves: DataFrame, config: Config) -> DataFrame:
    """Per leaf the fields that its type's schema has and it lacks, and those that it has besides."""
    due = config.schema_fields(F.col("doc_type"))
    had = F.coalesce(F.map_keys("ext"), F.array().cast("array<string>"))
    return leaves.select("file", "doc_type", F.array_sort(F.array_except(due, had)).alias("missing"), F.array_sort(F.array_except(had, due)).alias("obsolete"))


def migrate(leaves: DataFrame, config: Config) -> DataFrame:
    """leaves with the fields of their type's schema and no others; new ones are null. Trees aren't touched."""
    due = config.schema_fields(F.col("doc_type"))
    held = F.coalesce("ext", F.create_map().cast("map<string,string>"))
    return leaves.withColumn("_h", held).withColumn("ext", F.map_from_entries(F.transform(due, lambda f: F.struct(f, F.try_element_at("_h", f))))).drop("_h")


# ---- health -----------------------------------------------------------------------------------------------------


def counts(leaves: DataFrame) -> DataFrame:
    """Documents by group and by type: kind, value, documents."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit("unknown")).alias("value")) for k in ("doc_group", "doc_type")])
    return leaves.select(F.explode(each).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("documents"))


def null_metadata(leaves: DataFrame, config: Config) -> DataFrame:
    """Leaves with fields that are null: file, fields."""
    base = [F.when(F.col(f).isNull(), f) if f in leaves.columns else F.lit(f) for f in config.base_schema]
    further = F.filter(config.schema_fields(F.col("doc_type")), lambda f: F.try_element_at("ext", f).isNull())
    fields = F.concat(F.array_compact(F.array(*base)), further)
    return leaves.select("file", fields.alias("fields")).filter(F.size("fields") > 0)


def orphans(leaves: DataFrame, docs: DataFrame) -> DataFrame:
    """Trees without a leaf and leaves without a tree: code, tree_index, file."""
    trees = docs.select("tree_index").distinct()
    named = leaves.filter("tree_index IS NOT NULL AND tree_index <> ''")
    lost = trees.join(named.select("tree_index"), "tree_index", "left_anti").select(F.lit("orphaned_tree").alias("code"), "tree_index", F.lit(None).cast("string").alias("file"))
    return lost.unionByName(named.join(trees, "tree_index", "left_anti").select(F.lit("dangling_leaf").alias("code"), "tree_index", "file"))


def coverage_bucket(ratio):
    return F.when(ratio >= 1, "1.0").when(ratio >= 0.9, "0.9-1.0").when(ratio >= 0.75, "0.75-0.9").when(ratio >= 0.5, "0.5-0.75").otherwise("<0.5")


def coverage_histogram(coverage: DataFrame) -> DataFrame:
    """Documents per range of coverage, with all five ranges."""
    got = coverage.groupBy(coverage_bucket(F.col("coverage_ratio")).alias("bucket")).agg(F.count("*").alias("documents"))
    names = coverage.sparkSession.range(1).select(F.explode(F.array(*[F.lit(b) for b in ("1.0", "0.9-1.0", "0.75-0.9", "0.5-0.75", "<0.5")])).alias("bucket"))
    return names.join(got, "bucket", "left").na.fill(0)


def cross_ref_rate(refs: DataFrame) -> DataFrame:
    resolved = F.count_if(F.col("resolved_node").isNotNull() | F.col("resolved_file").isNotNull())
    df = refs.agg(F.count("*").alias("total"), resolved.alias("resolved"))
    return df.withColumn("resolution_rate", F.round(F.try_divide("resolved", "total"), 4))


def doctor(leaves: DataFrame, docs: DataFrame, config: Config, nodes: DataFrame | None = None, source: DataFrame | None = None, with_quality: bool = False) -> DataFrame:
    """Findings on an index: severity, code, file, detail. With nodes and source it looks deeply into each tree."""

    def rows(df: DataFrame, severity: str, code: str | None, file: str | None, detail) -> DataFrame:
        return df.select(F.lit(severity).alias("severity"), (F.lit(code) if code else F.col("code")).alias("code"), (F.col(file) if file else F.lit(None).cast("string")).alias("file"), detail.alias("detail"))

    lost = orphans(leaves, docs)
    found = [
        rows(routing.unknown_groupings(leaves, config), "warn", "unknown_grouping", None, F.array_join("path", " > ")),
        rows(null_metadata(leaves, config), "warn", "null_metadata", "file", F.array_join("fields", ",")),
        rows(lost.filter("code = 'orphaned_tree'"), "warn", None, "file", F.col("tree_index")),
        rows(lost.filter("code = 'dangling_leaf'"), "error", None, "file", F.col("tree_index")),
    ]
    if nodes is not None and source is not None:
        checks = validate.check_trees(docs, nodes, source, config)
        found += [
            rows(checks.filter("code = 'fingerprint_mismatch'"), "warn", "stale_source", "file", F.lit(None).cast("string")),
            rows(checks.filter("code <> 'fingerprint_mismatch'"), "error", None, "file", F.col("detail")),
            rows(docs.join(source.select("file"), "file", "left_anti"), "error", "source_missing", "file", F.lit(None).cast("string")),
            rows(docs.filter("fingerprint IS NULL"), "info", "staleness_unknown", "file", F.lit(None).cast("string")),
            rows(validate.coverage(nodes, source.join(docs.select("file"), "file", "left_semi")).filter("coverage_ratio < 1"), "warn", "incomplete_coverage", "file", F.col("coverage_ratio").cast("string")),
        ]
    if nodes is not None and with_quality:
        poor = quality.check_trees(docs, nodes, config).groupBy("file").agg(F.count("*").alias("n"))
        found.append(rows(poor, "warn", "summary_quality", "file", F.col("n").cast("string")))
    return reduce(DataFrame.unionByName, found)


def health(findings: DataFrame) -> DataFrame:
    """One row: ok unless there is an error."""
    sev = lambda s: F.count_if(F.col("severity") == s)
    return findings.agg((sev("error") == 0).alias("ok"), sev("error").alias("errors"), sev("warn").alias("warnings"), sev("info").alias("infos"))
