"""Classes of documents: substantive ones are indexed, redirects give aliases, the rest is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphwood.config import Config
from glyphwood.functions.text import SPACE, quick, tree_file

CLASSES = ("substantive", "redirect", "placeholder", "navigation_only", "unsupported")

# What a redirect says.
REDIRECT = (
    r"(?i)(?<![A-Za-z0-9_])(?:has\s+moved|have\s+moved|moved\s+to|redirect(?:ed|s|ing)?|see\s+instead|now\s+lives|"
    r"now\s+located|relocated|superseded\s+by|replaced\s+by|this\s+page\s+is\s+now)(?![A-Za-z0-9_])"
).replace(r"\s", f"[{SPACE}]")


def is_local_markdown(target: Column) -> Column:
    """A link to another Markdown file: no scheme, no mere anchor, .md before any anchor."""
    path = F.split(target, "#")[0]
    return F.coalesce(~target.rlike("(?i)^[a-z][a-z0-9+.-]*:") & ~target.startswith("#") & path.rlike(r"(?i)\.md\z"), F.lit(False))


def resolve(file: Column, target: Column) -> Column:
    """The path that a link in `file` means, from the root of the vault, without anchor, `.`, `..` and empty parts."""
    path = F.split(target, "#")[0]
    folder = F.regexp_replace(file, r"[^/]*\z", "")
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    parts = F.filter(F.split(joined, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    return F.array_join(kept, "/")


def with_class(source: DataFrame, config: Config) -> DataFrame:
    """A source map with classification, doc_type and local_targets, in the same row: choosing documents by class then
    needs no join."""
    local = F.filter("links", lambda x: is_local_markdown(x["target"]))
    df = source.withColumn("local_targets", F.transform(local, lambda x: resolve(F.col("file"), x["target"])))
    no_code = F.col("code_blocks") == 0
    kind = (
        F.when(F.col("substantive_count") == 0, "placeholder")
        .when(
            (F.size("headings") <= 1)
            & no_code
            & (F.size("local_targets") >= 1)
            & (F.col("prose_words") <= config.redirect_max_prose_words)
            & F.col("prose").rlike(quick(REDIRECT)),
            "redirect",
        )
        .when((F.col("prose_words") < config.placeholder_word_threshold) & no_code, "placeholder")
        .when(
            (F.size("links") >= config.navigation_min_links) & (F.col("non_link_words") <= config.navigation_max_non_link_words) & no_code,
            "navigation_only",
        )
        .otherwise("substantive")
    )
    return df.withColumns({"classification": kind, "doc_type": config.doc_type(F.col("file"))})


def substantive(source: DataFrame, config: Config) -> DataFrame:
    """The part of a source map that is indexed."""
    return with_class(source, config).filter("classification = 'substantive'").drop("classification", "local_targets")


def classify(source: DataFrame, config: Config, *keep: str) -> DataFrame:
    """One row per document of a source map: file, classification, indexed, alias_target, counts, doc_type, doc_group, and
    the source map's columns `keep`."""
    df = with_class(source, config)
    return df.select(
        "file",
        "classification",
        F.size("headings").cast("long").alias("headings"),
        F.col("substantive_count").cast("long").alias("substantive_lines"),
        F.col("prose_words").cast("long"),
        F.col("non_link_words").cast("long"),
        F.col("code_blocks").cast("long"),
        F.size("links").cast("long").alias("links"),
        F.size("local_targets").cast("long").alias("local_markdown_links"),
        "local_targets",
        "fingerprint",
        (F.col("classification") == "substantive").alias("indexed"),
        F.when(F.col("classification") == "redirect", F.get("local_targets", F.lit(0))).alias("alias_target"),
        "doc_type",
        config.doc_group(F.col("doc_type")).alias("doc_group"),
        *keep,
    )


def scan(classified: DataFrame, leaves: DataFrame | None = None, trees: DataFrame | None = None) -> DataFrame:
    """Classified documents with what exists of them already; leaves(file) and trees(tree_index) may be missing."""
    df = classified.withColumn("tree_index", tree_file(F.col("file")))
    for flag, key, known in (("existing_leaf", "file", leaves), ("existing_tree", "tree_index", trees)):
        if known is None:
            df = df.withColumn(flag, F.lit(False))
        else:
            there = known.select(key).distinct().withColumn(flag, F.lit(True))
            df = df.join(there, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return df


def scan_summary(scanned: DataFrame) -> DataFrame:
    """Documents per class, with all five classes present."""
    counts = scanned.groupBy("classification").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("indexed") & ~F.col("existing_leaf")).alias("to_ingest"),
        F.count_if("existing_leaf").alias("already_indexed"),
        F.count_if(F.col("doc_type").isNull()).alias("unmapped"),
    )
    spark = scanned.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("classification"))
    return names.join(counts, "classification", "left").na.fill(0)


def aliases(classified: DataFrame) -> DataFrame:
    """from_file, to_file, and whether the target is an indexed document."""
    known = classified.filter("indexed").select(F.col("file").alias("to_file"), F.lit(True).alias("resolved"))
    redirects = classified.filter("classification = 'redirect'").select(F.col("file").alias("from_file"), F.col("alias_target").alias("to_file"))
    return redirects.join(known, "to_file", "left").select("from_file", "to_file", F.coalesce("resolved", F.lit(False)).alias("resolved"))
