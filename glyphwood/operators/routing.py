"""The routing table: leaves are its base relation, the tree above them is a roll-up over the hierarchy fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphwood.config import Config
from glyphwood.functions import text as t

UNKNOWN = "unknown"
BASE_COLUMNS = ("file", "doc_type", "doc_group", "topics", "date_added", "summary", "tree_index")


def field_value(leaves: DataFrame, name: str) -> Column:
    """A hierarchy field of a leaf: one of its columns, else one of its type's further fields."""
    if name in leaves.columns:
        return F.col(name).cast("string")
    return F.try_element_at("ext", F.lit(name)) if "ext" in leaves.columns else F.lit(None).cast("string")


def placed(leaves: DataFrame, config: Config) -> DataFrame:
    """leaves with `route` (the values above them, unknown for none), field, value and unknown_fields."""
    *above, last = config.hierarchy_fields
    values = [field_value(leaves, f) for f in above]
    route = [F.coalesce(F.nullif(v, F.lit("")), F.lit(UNKNOWN)) for v in values]
    lacks = [F.when(F.coalesce(v, F.lit("")) == "", f) for f, v in zip(above, values, strict=True)]
    strings = "array<string>"
    return leaves.select(
        "*",
        (F.array(*route) if route else F.array()).cast(strings).alias("route"),
        F.lit(last).alias("field"),
        F.coalesce(field_value(leaves, last), F.lit(UNKNOWN)).alias("value"),
        (F.array_compact(F.array(*lacks)) if lacks else F.array()).cast(strings).alias("unknown_fields"),
    )


def leaf_text() -> Column:
    """What a leaf says of its document: topics, summary, and the words of its path."""
    return F.concat_ws(" ", "topics", "summary", F.regexp_replace("file", "[/._]", " "))


def postings(leaves: DataFrame) -> DataFrame:
    """file, w: the words of each leaf, once each. Made at publication, so that no search looks at summaries for them."""
    words = leaves.select("file", t.token_set(leaf_text()).alias("_ws"))
    return words.select("file", F.explode("_ws").alias("w"))


def nodes(leaves: DataFrame, config: Config) -> DataFrame:
    """The nodes above the leaves: type, depth, path (values), field, value, documents, summary.

    Each leaf counts for all its prefixes at once, summed up before the shuffle. The summary is a roll-up of what is below.
    """
    at = placed(leaves, config).withColumn("_t", F.explode_outer(F.when(F.size("topics") > 0, F.col("topics"))) if "topics" in leaves.columns else F.lit(None).cast("string"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size("route")), lambda k: F.slice("route", F.lit(1), k))
    per = at.select(F.explode(prefixes).alias("path"), "file", "_t")
    counts = per.groupBy("path").agg(F.count_distinct("file").alias("documents"))
    ranked = per.filter("_t IS NOT NULL").groupBy("path", "_t").agg(F.count_distinct("file").alias("n"))
    top = ranked.groupBy("path").agg(F.min_by("_t", F.struct(F.negative("n"), "_t")).alias("top_topic"))
    df = counts.join(top, "path", "left").withColumn("depth", F.size("path"))
    fields = F.array(*[F.lit(f) for f in config.hierarchy_fields])
    told = F.concat_ws(" ", F.col("documents").cast("string"), F.lit("documents"), F.concat(F.lit("on "), F.col("top_topic")))
    return df.select(
        F.when(F.col("depth") == 0, "root").otherwise("intermediate").alias("type"),
        "depth",
        "path",
        F.when(F.col("depth") > 0, F.get(fields, F.col("depth") - 1)).alias("field"),
        F.get("path", F.col("depth") - 1).alias("value"),
        "documents",
        told.alias("summary"),
    )


def rollup(leaves: DataFrame, config: Config) -> DataFrame:
    """Documents per prefix of the hierarchy by ROLLUP: level (0 for all), one column per field above the last, documents."""
    *above, _ = config.hierarchy_fields
    df = leaves.select(*[F.coalesce(F.nullif(field_value(leaves, f), F.lit("")), F.lit(UNKNOWN)).alias(f) for f in above])
    if not above:
        return df.agg(F.count("*").alias("documents")).withColumn("level", F.lit(0))
    missing = F.bit_count(F.grouping_id())
    return df.rollup(*above).agg(F.count("*").alias("documents"), (F.lit(len(above)) - missing).alias("level"))


def find(leaves: DataFrame, file: str) -> DataFrame:
    return leaves.filter(F.col("file") == file).limit(1)


def remove(leaves: DataFrame, files: DataFrame) -> DataFrame:
    """leaves without those of files(file). What is left without leaves is gone from the tree, as that is derived."""
    return leaves.join(files.select("file").distinct(), "file", "left_anti")


def upsert_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """aliases(from_file, to_file): the new one of a key wins."""
    fresh = new.groupBy("from_file").agg(F.max("to_file").alias("_new"))
    return old.join(fresh, "from_file", "full").select("from_file", F.coalesce("_new", "to_file").alias("to_file"))


def unknown_groupings(leaves: DataFrame, config: Config, most: int = 20) -> DataFrame:
    """Nodes with the value `unknown`: path, field, documents and the first files below them."""
    at = placed(leaves, config)
    per = at.select("file", F.posexplode("route").alias("k", "v"), "route").filter(F.col("v") == UNKNOWN)
    path = F.slice("route", F.lit(1), F.col("k") + 1)
    fields = F.array(*[F.lit(f) for f in config.hierarchy_fields])
    keyed = per.select(path.alias("path"), F.get(fields, F.col("k")).alias("field"), "file")
    # The first files by rank: only so many of a group are ever gathered.
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("path", "field").orderBy("file")))
    named = F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.col("file"))))
    return ranked.groupBy("path", "field").agg(F.count("*").alias("documents"), named.alias("files"))


def to_json(leaves: DataFrame, config: Config) -> DataFrame:
    """The leaves as JSON rows in the order of their routes; what a reader nests by `route`."""
    at = placed(leaves, config)
    return at.select("route", "file", F.to_json(F.struct(F.lit("leaf").alias("type"), "field", "value", *[c for c in leaves.columns])).alias("json"))
