"""Quality rules: a table of thresholds compiled into one projection, JVM-side only.

Every measure is a column expression over the text, the rules compare measures, and a single select evaluates both.
Repeated 5-word windows are found by sorting the windows' 64-bit hashes with their positions within the row, so a text
takes n log n steps and nothing is shuffled.

Defined results: a null text has no words and fails; so does an empty one. Ratios of an empty text are 0. Repeated rows
are judged alike. Very long texts are measured whole.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CAPITALS = "A-ZÀÂÄÇÈÉÊÖÜÑÓÍÁÚ"
SYMBOLS = "#*$%&|<>"
#: Words of a window, and how many of a hundred words may lie in repeated windows.
WINDOW, MOST_REPEATED = 5, 20
FEWEST_WORDS = 10
_STOP = set("the of and to in a is that for it was on as with be by are this or an at from have not der die und das ist von zu den mit ein eine auf für im sich auch le la les de et des du un une est que pour dans en el los las y por con una no se al".split())
#: As they stand, capitalised and in capitals.
STOP_WORDS = sorted(_STOP | {w.capitalize() for w in _STOP} | {w.upper() for w in _STOP})


class Rule(NamedTuple):
    """A text fails if the measure lies outside [least, most]."""

    measure: str
    least: float | None
    most: float | None


#: Measures in hundredths of words, characters or lines.
RULES = [
    Rule("symbol_pct", None, 8.0),
    Rule("dup_line_pct", None, 40.0),
    Rule("mean_word_chars", 2.0, 16.0),
    Rule("stop_word_pct", 0.5, None),
    Rule("upper_pct", None, 50.0),
]


def bind(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), lambda w: w != "")


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words within windows of `window` words that occur twice or more."""

    def found(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(p: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(p, a)["h"] == F.get(p, b)["h"], F.lit(False))
            hits = F.filter(F.transform(p, lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"])), lambda i: i.isNotNull())
            gaps = lambda s: F.aggregate(F.transform(s, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(s, k + 1) - i, F.lit(window)))), F.lit(0).cast("long"), lambda a, g: a + g)
            return bind(F.sort_array(hits), gaps)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(bind(pairs, covered))

    def of(w: Column) -> Column:
        windows = lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - (window - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, window)]))
        return bind(bind(F.transform(w, lambda x: F.xxhash64(x)), windows), found)

    return bind(words, of)


def measures(text: Column) -> dict[str, Column]:
    """Counts of a text (long), by name; they refer to each other, so select them with measured()."""
    return {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("_words")),
        "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS))).cast("long"),
        "n_upper": F.regexp_count(text, F.lit(f"[{CAPITALS}]")).cast("long"),
    }


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column _m of the counts and shares of its texts."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parts = docs.withColumns({"_words": words_of(t), "_lines": lines})
    counted = F.struct(*[c.alias(n) for n, c in measures(t).items()])

    def with_shares(m: Column) -> Column:
        share = lambda a, b: F.coalesce(F.try_divide(100.0 * m[a], m[b]), F.lit(0.0))
        shares = {"symbol_pct": share("n_symbols", "word_chars"), "dup_line_pct": share("n_dup_lines", "n_lines"), "mean_word_chars": share("word_chars", "n_words") / 100.0, "stop_word_pct": share("n_stop_words", "n_words"), "upper_pct": share("n_upper", "word_chars")}
        return F.struct(*[m[n].alias(n) for n in measures(t)], *[c.alias(n) for n, c in shares.items()])

    return parts.withColumn("_m", bind(counted, with_shares)).drop("_words", "_lines")


def base_failed() -> Column:
    return (F.col("_m.n_words") < FEWEST_WORDS) | (100 * F.col("_m.n_repeat_words") > MOST_REPEATED * F.col("_m.n_words"))


def verdict(rules: list[Rule] = RULES) -> Column:
    """Whether a measured text passes the whole table."""
    ok = ~base_failed()
    for r in rules:
        value = F.col(f"_m.{r.measure}")
        ok = ok & (value >= r.least if r.least is not None else F.lit(True)) & (value <= r.most if r.most is not None else F.lit(True))
    return ok


def quality_filter(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with their columns."""
    return measured(docs, text).filter(verdict(rules)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return measured(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *[F.col(f"_m.{n}").alias(n) for n in names], base_failed().alias("base_failed"), verdict().alias("kept"))


def oracle_parts(documents: str = "documents") -> str:
    """DuckDB common table expressions; the last, judged, has all columns and the verdict."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    checks = " AND ".join(f"{r.measure} >= {r.least}" for r in RULES if r.least is not None) + " AND " + " AND ".join(f"{r.measure} <= {r.most}" for r in RULES if r.most is not None)
    return rf"""
    rules_texts AS (
        SELECT row_number() OVER () AS k, *, coalesce(text, '') AS t FROM {documents}
    ), rules_words AS (
        SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
            list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS ls FROM rules_texts
    ), rules_windows AS (
        SELECT k, i, ws[i:i+{WINDOW - 1}] AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM rules_words)
    ), rules_hits AS (
        SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS j FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM rules_windows) WHERE n > 1
    ), rules_repeats AS (
        SELECT k, sum(least({WINDOW}, coalesce(j - i, {WINDOW}))) AS n FROM rules_hits GROUP BY k
    ), rules_counts AS (
        SELECT w.*, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
            (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
            (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
            len(list_filter(ws, lambda w: w IN ({stop})))::BIGINT AS n_stop_words,
            (length(t) - length(regexp_replace(t, '[{CAPITALS}]', '', 'g')))::BIGINT AS n_upper
        FROM rules_words w LEFT JOIN rules_repeats r USING (k)
    ), rules_shares AS (
        SELECT *, CASE WHEN word_chars > 0 THEN 100.0::DOUBLE * n_symbols / word_chars ELSE 0 END AS symbol_pct,
            CASE WHEN n_lines > 0 THEN 100.0::DOUBLE * n_dup_lines / n_lines ELSE 0 END AS dup_line_pct,
            CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word_chars,
            CASE WHEN n_words > 0 THEN 100.0::DOUBLE * n_stop_words / n_words ELSE 0 END AS stop_word_pct,
            CASE WHEN word_chars > 0 THEN 100.0::DOUBLE * n_upper / word_chars ELSE 0 END AS upper_pct,
            n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM rules_counts
    ), judged AS (
        SELECT *, NOT base_failed AND {checks} AS kept FROM rules_shares
    )"""


def oracle() -> str:
    return f"WITH {oracle_parts()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
