"""Cross references in the text of leaves, resolved within the document by heading and across documents by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphwood.functions import text as t
from glyphwood.operators.classify import is_local_markdown, resolve

# Phrases that refer to another section.
PHRASES = r"(?i)(?<![A-Za-z0-9_])(?:see|refer to)\s+(?:section\s+)?(?:\"([^\"]+)\"|(note\s+[0-9]+|section\s+[0-9.]*[0-9]))"


def detect(source: DataFrame, nodes: DataFrame, indexed: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """file, node_id, idx, type, raw, target, resolved_node, resolved_file of every reference.

    indexed(file): what may be referred to; a redirect's alias counts as its target. Documents without references give no rows.
    """
    plain = F.filter("lines", lambda x: x["substantive"] & ~x["in_code"] & (x["level"] == 0) & ~x["underline"])
    quoted = F.flatten(
        F.transform(
            plain,
            lambda x: F.transform(F.regexp_extract_all(x["text"], F.lit(PHRASES), F.lit(0)), lambda m, i: F.struct(x["n"].alias("line"), i.alias("k"), m.alias("raw"))),
        )
    )
    local = F.transform(F.filter("links", lambda x: is_local_markdown(x["target"])), lambda x: F.struct(x["line"].alias("line"), (x["idx"] + 1000).alias("k"), x["target"].alias("raw")))
    def as_type(found: Column, kind: str) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("type"), x["line"].alias("line"), x["k"].alias("k"), x["raw"].alias("raw")))

    df = t.exploded(source, F.concat(as_type(quoted, "intra"), as_type(local, "inter")), "file")
    named = F.regexp_extract("raw", PHRASES, 1)
    wanted = F.when(F.col("type") == "inter", resolve(F.col("file"), F.col("raw"))).otherwise(F.when(named != "", named).otherwise(F.regexp_extract("raw", PHRASES, 2)))
    df = df.withColumn("target", wanted).withColumn("_slug", F.when(F.col("type") == "intra", t.slug(F.col("target"))))
    leaves = nodes.filter("is_leaf").select("file", "node_id", "line_start", "line_end")
    # a line's leaf is found by equality on blocks of lines, not by comparing all lines with all leaves
    size = 64
    spread = leaves.withColumn("_block", F.explode(F.sequence(F.floor(F.col("line_start") / size), F.floor(F.col("line_end") / size))))
    df = df.withColumn("_block", F.floor(F.col("line") / size)).join(spread, ["file", "_block"]).filter("line BETWEEN line_start AND line_end")
    heads = nodes.filter(F.col("generated").isNull()).groupBy("file", t.slug(F.col("heading")).alias("_slug")).agg(F.min_by("node_id", "path").alias("_node"))
    df = df.join(heads, ["file", "_slug"], "left")
    files = indexed.select(F.col("file").alias("target"), F.col("file").alias("_file")).distinct()
    if aliases is not None:
        known = aliases.join(indexed.select(F.col("file").alias("to_file")).distinct(), "to_file", "left_semi")
        files = files.unionByName(known.select(F.col("from_file").alias("target"), F.col("to_file").alias("_file"))).dropDuplicates(["target"])
    df = df.join(files, "target", "left")
    inter = F.col("type") == "inter"
    return df.select(
        "file",
        "node_id",
        (F.row_number().over(Window.partitionBy("file", "node_id").orderBy("line", "k")) - 1).alias("idx"),
        "type",
        "raw",
        "target",
        F.when(~inter, F.col("_node")).alias("resolved_node"),
        F.when(inter, F.col("_file")).alias("resolved_file"),
    )

