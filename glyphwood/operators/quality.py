"""Rules for summaries: length, empty phrases, repetition of the heading, and distinctness among siblings and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphwood.config import Config
from glyphwood.functions import text as t
from glyphwood.operators import similarity

# Phrases that say nothing, by code.
EMPTY_PHRASES = {
    "generic_documentation_covering": r"(?i)^\s*documentation\s+(?:covering|for|about)\b",
    "generic_covers_config_usage": r"(?i)\bcovers\s+configuration,\s*usage,?\s*and\s+operational\s+guidance\b",
    "generic_this_section": r"(?i)^\s*this\s+(?:section|page|chapter|part)\s+(?:discusses|describes|covers|explains|contains|provides)\b",
    "generic_this_document": r"(?i)^\s*this\s+document\s+(?:contains|provides|covers|describes)\s+information\b",
    "generic_information_about": r"(?i)^\s*information\s+about\b",
    "generic_overview_of": r"(?i)^\s*(?:an?\s+)?overview\s+of\s+the\s+[A-Za-z0-9_]+\s+section\s*\.?\s*$",
    "redirect_language": r"(?i)^\s*redirect(?:ing|s|ed)?\b",
}


def _pattern(form: str) -> str:
    """Word ends by ASCII and white space as one class."""
    out = form.replace(r"\b", "(?![A-Za-z0-9_])").replace(r"\s", f"[{t.SPACE}]").replace("$", r"\z")
    return t.quick(out.replace("(?i)(?![A-Za-z0-9_])", "(?i)(?<![A-Za-z0-9_])"))


def codes(summary: Column, heading: Column, is_root: Column, config: Config) -> Column:
    """The codes of all rules that a summary breaks, in the order of the rules."""
    least = F.when(is_root, config.root_summary_min_words).otherwise(config.node_summary_min_words)
    most = F.when(is_root, config.root_summary_max_words).otherwise(config.node_summary_max_words)

    def broken(x: Column) -> Column:
        body, title = x["body"], x["title"]

        def listed(y: Column) -> Column:
            titled = title != ""
            new_words = F.size(F.array_except(t.token_set(body), t.token_set(heading)))
            return F.array_compact(
                F.array(
                    F.when(y["count"] < least, "too_short"),
                    F.when(y["count"] > most, "too_long"),
                    *[F.when(body.rlike(_pattern(form)), code) for code, form in EMPTY_PHRASES.items()],
                    F.when(titled & (y["plain"] == title), "repeats_heading"),
                    F.when(titled & (y["plain"] != title) & (new_words < 3), "adds_nothing_to_heading"),
                )
            )

        return t.bound(F.struct(t.word_count(body).alias("count"), t.comparable(body).alias("plain")), listed)

    parts = F.struct(t.trim(t.blank_to_empty(summary)).alias("body"), t.comparable(heading).alias("title"))
    return F.when(t.is_blank(summary), F.array(F.lit("summary_missing"))).otherwise(t.bound(parts, broken))


def _found(df: DataFrame, scope: Column, node: Column) -> DataFrame:
    return df.select("file", node.alias("node_id"), scope.alias("scope"), F.explode("_codes").alias("code"), F.lit(None).cast("string").alias("other"), F.lit(None).cast("double").alias("score"))


def check_nodes(nodes: DataFrame, config: Config) -> DataFrame:
    """Findings on each node's summary: file, node_id, scope, code, other, score."""
    df = nodes.withColumn("_codes", t.fenced(codes(F.col("summary"), F.col("heading"), F.lit(False), config)))
    return _found(df, F.lit("node"), F.col("node_id"))


def check_roots(docs: DataFrame, config: Config) -> DataFrame:
    """Findings on each document's summary; its heading is its file."""
    df = docs.withColumn("_codes", t.fenced(codes(F.col("root_summary"), F.col("file"), F.lit(True), config)))
    return _found(df, F.lit("root"), F.lit(None).cast("string"))


def check_siblings(nodes: DataFrame, config: Config) -> DataFrame:
    """Findings on nodes that are too similar to an earlier sibling."""
    told = nodes.filter(~t.is_blank(F.col("summary")))
    near = similarity.later_items(told, ["file", "parent_id"], "ordinal", "summary", config.sibling_summary_similarity_max)
    names = told.select("file", "parent_id", "ordinal", "node_id")
    late = similarity.joined(near, names, ["file", "parent_id", "ordinal"])
    first = names.select("file", "parent_id", F.col("ordinal").alias("other"), F.col("node_id").alias("_other_id"))
    both = similarity.joined(late, first, ["file", "parent_id", "other"])
    return both.select("file", "node_id", F.lit("siblings").alias("scope"), F.lit("sibling_summaries_too_similar").alias("code"), F.col("_other_id").alias("other"), "score")


def check_distinct(docs: DataFrame, config: Config) -> DataFrame:
    """Findings on documents whose summary is too similar to that of one earlier by file."""
    told = docs.filter(~t.is_blank(F.col("root_summary")))
    near = similarity.later_items(told, [], "file", "root_summary", config.root_summary_similarity_max)
    return near.select("file", F.lit(None).cast("string").alias("node_id"), F.lit("roots").alias("scope"), F.lit("root_summaries_too_similar").alias("code"), "other", "score")


def check_trees(docs: DataFrame, nodes: DataFrame, config: Config) -> DataFrame:
    """All findings within documents."""
    return check_roots(docs, config).unionByName(check_nodes(nodes, config)).unionByName(check_siblings(nodes, config))


def report(docs: DataFrame, nodes: DataFrame, config: Config) -> DataFrame:
    """One row: summaries, generic ones, their rate, duplicate siblings, root collisions."""
    found = check_trees(docs, nodes, config)
    generic = F.col("code").startswith("generic_") | F.col("code").isin("repeats_heading", "adds_nothing_to_heading")
    counts = found.agg(F.count_if(generic).alias("generic_summaries"), F.count_if(F.col("code") == "sibling_summaries_too_similar").alias("duplicate_sibling_summaries"))
    roots = check_distinct(docs, config).agg(F.count("*").alias("root_summary_collisions"))
    told = docs.select(F.col("root_summary").alias("s")).unionByName(nodes.select(F.col("summary").alias("s")))
    total = told.agg(F.count_if(~t.is_blank(F.col("s"))).alias("total_summaries"))
    rate = F.round(F.coalesce(F.try_divide("generic_summaries", "total_summaries"), F.lit(0.0)), 4)
    return total.join(counts).join(roots).withColumn("generic_rate", rate)
