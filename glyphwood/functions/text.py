"""String expressions shared by the operators. All of them are built-in functions of the engine, no Python runs per row.

Regular expressions spell white space out as one class, because the pattern languages at hand disagree about `\\s`:
Java's has no U+00A0 and no U+FEFF. For the same reason "any character" is a class too, and `\\z` stands for the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space, for use within a character class.
SPACE = r"\x{09}-\x{0D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Any character of a line.
ANY = r"[^\n\r\x{2028}\x{2029}]"
LINE_BREAK = r"\r\n|\r|\n"

#: The characters of SPACE.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
# The same for Java, which tries the ranges of a class one by one but finds single characters below 256 in one look: these
# decide nearly all text by one or two parts.
_HIGH = r"[\x{80}-\x{FFFF}&&[\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
_SPACE = rf"\s{_HIGH}"
_ANY = r"[\x{20}-\x{7E}[^\n\r\x{2028}\x{2029}]]"
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def quick(form: str) -> str:
    """The form that the engine is given: it matches what `form` does, in a fraction of the time."""
    out = form.replace(rf"[^a-z0-9{SPACE}", rf"[^{_LETTERS}\x{{09}}\x{{0A}}\x{{0B}}\x{{0C}}\x{{0D}}\x{{20}}{_HIGH}").replace("[^a-z0-9", f"[^{_LETTERS}")
    return out.replace(ANY, _ANY).replace(SPACE, _SPACE)


# Words that carry no content.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "for", "from", "has", "have", "how", "in", "into",
    "is", "it", "its", "of", "on", "or", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to",
    "was", "were", "what", "when", "which", "who", "will", "with",
)


def blank_to_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trim(c: Column) -> Column:
    """c without white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    """Null or white space alone."""
    return ~F.coalesce(c.rlike(quick(rf"[^{SPACE}]")), F.lit(False))


def words(c: Column) -> Column:
    """The runs of anything but white space."""
    return F.filter(F.split(blank_to_empty(c), quick(rf"[{SPACE}]+")), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def lines(c: Column) -> Column:
    """Lines by any of the three line breaks; a last empty one counts."""
    text = blank_to_empty(c)
    return F.when(text.contains("\r"), F.split(text, LINE_BREAK, -1)).otherwise(F.split(text, "\n", -1))  # one character is split at without a pattern


def slug(c: Column) -> Column:
    """Lower case, white space to hyphens, then only letters, digits and hyphens."""
    spaced = F.regexp_replace(F.lower(blank_to_empty(c)), quick(rf"[{SPACE}]+"), "-")
    return F.regexp_replace(spaced, quick("[^a-z0-9-]"), "")


def slug_or_line(c: Column, line: Column) -> Column:
    return bound(slug(c), lambda s: F.when(s == "", F.concat(F.lit("n"), line.cast("string"))).otherwise(s))


def tokens(c: Column) -> Column:
    """Content words in order: lower case, of at least two characters, without stop words."""
    plain = F.regexp_replace(F.lower(blank_to_empty(c)), quick(rf"[^a-z0-9{SPACE}-]"), " ")
    return F.filter(F.split(plain, quick(rf"[{SPACE}]+")), lambda w: (F.length(w) > 1) & ~w.isin(list(STOPWORDS)))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets, to four decimals; 1 for two empty sets, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    ratio = F.round(both / F.when(either > 0, either), 4)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.coalesce(ratio, F.lit(0.0)))


def comparable(c: Column) -> Column:
    """Lower case, letters and digits with single spaces: how summaries and headings are compared."""
    kept = F.regexp_replace(F.lower(blank_to_empty(c)), quick(rf"[^a-z0-9{SPACE}]"), "")
    return trim(F.regexp_replace(kept, quick(rf"[{SPACE}]+"), " "))


def stem(file: Column) -> Column:
    """The document's part of node ids and file names: slashes to underscores, no .md."""
    return F.regexp_replace(F.replace(file, F.lit("/"), F.lit("_")), r"(?i)\.md\z", "")


def tree_file(file: Column) -> Column:
    return F.concat(stem(file), F.lit(".json"))


def fingerprint(content: Column) -> Column:
    """Number of lines and SHA-256 of a text; nulls where there is no text."""
    return F.when(
        content.isNotNull(),
        F.struct(F.size(lines(content)).cast("long").alias("line_count"), F.sha2(content, 256).alias("sha256")),
    )


# ---- how plans keep costly columns computed once ------------------------------------------------------------------


def fenced(c: Column) -> Column:
    """c, marked so that the optimizer keeps its computation where it is.

    Predicates on a derived column are otherwise pushed below its projection with the whole expression written out again,
    and once more per reference: for nested array functions that makes one pass over a text into many.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def exploded(df: DataFrame, array: Column, *keep: str) -> DataFrame:
    """The columns `keep` and the fields of an array of structs, a row per element; none for an empty array.

    As an outer explode, since an inner one infers a predicate that computes the array a second time.
    """
    out = df.select(*keep, F.explode_outer(array).alias("_x")).filter("_x IS NOT NULL")
    return out.select(*keep, "_x.*")
