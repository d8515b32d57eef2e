"""Sources of documents: folders of Markdown, tables of texts, pages of HTML, and documents that come in numbered pages.

All give `sources(file, content)`, with `file` relative to the vault and with forward slashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphwood.config import EngineError
from glyphwood.functions import text as t


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative(path: Column, root: str) -> Column:
    """A path below root, without root; null for one outside."""
    plain = F.regexp_replace(posix(path), "^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/")
    base = "/" + root.replace("\\", "/").split(":", 1)[-1].strip("/") + "/" if ":" in root[:12] and "://" in root or root.startswith("/") else root.rstrip("/") + "/"
    return F.when(plain.startswith(base), F.substr(plain, F.lit(len(base) + 1)))


def markdown_folder(spark: SparkSession, root: str) -> DataFrame:
    """All *.md files below root, in any case, without those in node_modules or in folders that start with a dot.

    Bytes that aren't UTF-8 become replacement characters.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    file = relative(F.col("path"), root)
    df = raw.select(file.alias("file"), F.expr("make_valid_utf8(cast(content AS string))").alias("content"))
    hidden = r"(?:^|/)(?:node_modules|\.[^/]*)/"
    return df.filter(F.col("file").rlike(r"(?i)\.md\z") & ~F.col("file").rlike(hidden)).dropDuplicates(["file"])


def inputs(sources: DataFrame, wanted: Iterable[str], root: str = "") -> tuple[DataFrame, DataFrame]:
    """The sources that a list of files and folders names, and the names that match nothing (`not_found`) or aren't Markdown.

    Entries may hold several names with commas. One that leaves the vault is refused.
    """
    names = [n.strip().replace("\\", "/").removeprefix("./") for w in wanted for n in w.split(",") if n.strip()]
    for n in names:
        if n.startswith("/") and not (root and n.startswith(root.rstrip("/") + "/")) or ".." in n.split("/"):
            raise EngineError("outside_ingestion_dir", n)
    names = sorted({n.removeprefix(root.rstrip("/") + "/").rstrip("/") if root else n.rstrip("/") for n in names})
    spark = sources.sparkSession
    asked = spark.createDataFrame([(n,) for n in names], "name string")
    hit = (F.col("file") == F.col("name")) | F.col("file").startswith(F.concat("name", F.lit("/")))
    pairs = sources.select("file").join(F.broadcast(asked), hit)  # the list is part of the call
    found = pairs.select("name").distinct()
    reason = F.when(F.col("name").rlike(r"(?i)\.md\z") | ~F.col("name").contains("."), "not_found").otherwise("not_markdown")
    return sources.join(pairs.select("file").distinct(), "file", "left_semi"), asked.join(found, "name", "left_anti").select("name", reason.alias("reason"))


def paged(pages: DataFrame, doc: str, number: str, text: str, title: str | None = None) -> DataFrame:
    """Documents from their numbered pages: a title, the source's name, and each page below a marker and a heading.

    title: the column with a document's name, else its key is it. Empty pages keep their marker.
    """
    name = F.col(title or doc).cast("string")
    page = F.concat(F.lit("<!-- page:"), F.col(number).cast("string"), F.lit(" -->\n\n## Page "), F.col(number).cast("string"), F.lit("\n\n"), t.trim(t.blank_to_empty(F.col(text))))
    rows = pages.select(name.alias("_name"), F.col(number).alias("_n"), page.alias("_p"))
    grouped = rows.groupBy("_name").agg(F.array_sort(F.collect_list(F.struct("_n", "_p"))).alias("_all"))
    body = F.array_join(F.transform("_all", lambda x: x["_p"]), "\n\n")
    content = F.concat(F.lit("# "), F.col("_name"), F.lit("\n\nSource PDF: "), F.col("_name"), F.lit(".pdf\n\n"), body, F.lit("\n"))
    return grouped.select(F.concat("_name", F.lit(".md")).alias("file"), content.alias("content"))


#: Turns the bytes of one PDF into the Markdown of its pages; given by the caller, as no converter is part of this engine.
Converter = Callable[[bytes], list[str]]


def pdf_folder(spark: SparkSession, root: str, convert: Converter, done: DataFrame | None = None, force: bool = False, limit: int | None = None) -> DataFrame:
    """PDFs below root as documents of pages. Those in done(file) are skipped unless forced; limit: the first so many files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    df = raw.select(F.regexp_replace(relative(F.col("path"), root), r"(?i)\.pdf\z", "").alias("stem"), "content", F.col("path").rlike(r"(?i)\.pdf\z").alias("_is")).filter("_is").drop("_is")
    if done is not None and not force:
        df = df.join(done.select(F.regexp_replace("file", r"(?i)\.md\z", "").alias("stem")), "stem", "left_anti")
    if limit is not None:
        df = df.orderBy("stem").limit(limit)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(s, k + 1, p) for s, c in zip(frame["stem"], frame["content"], strict=True) for k, p in enumerate(convert(bytes(c)))]
            yield pd.DataFrame(rows, columns=["stem", "page", "markdown"])

    return paged(df.mapInPandas(run, "stem string, page long, markdown string"), "stem", "page", "markdown")


# How HTML is read, in this order.
HTML_STEPS = (
    (r"(?is)<(script|style|head)[^>]*>.*?</(script|style|head)>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<h1[^>]*>", "\n\n# "),
    (r"(?is)<h2[^>]*>", "\n\n## "),
    (r"(?is)<h3[^>]*>", "\n\n### "),
    (r"(?is)</h[1-6]>", "\n\n"),
    (r"(?is)<li[^>]*>", "\n- "),
    (r'(?is)<a[^>]*href="([^" ]*)"[^>]*>([^<]*)</a>', "[$2]($1.md)"),
    (r"(?is)<br[^>]*>", "\n"),
    (r"(?is)</?(?:p|ul|div|article|nav|footer)[^>]*>", "\n\n"),
    (r"(?s)<[^>]*>", ""),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&amp;", "&"),
    (r"\n[ \t]+", "\n"),
    (r"\n{3,}", "\n\n"),
)


def html_to_markdown(html: Column) -> Column:
    """Headings, list items, links (to the page's Markdown form), paragraphs and line breaks; the rest of the tags goes."""
    out = t.blank_to_empty(html)
    for form, to in HTML_STEPS:
        out = F.regexp_replace(out, form, to)
    return F.concat(F.regexp_replace(out, r"^\n+|\n+\z", ""), F.lit("\n"))


def html_pages(pages: DataFrame, key: str = "page_id", html: str = "html", folder: str = "pages") -> DataFrame:
    return pages.select(F.concat(F.lit(f"{folder}/page_"), F.col(key).cast("string"), F.lit(".md")).alias("file"), html_to_markdown(F.col(html)).alias("content"))


def structured(documents: DataFrame) -> DataFrame:
    """Plain texts (doc_id, text, lang, source) as Markdown: a stand-in for a vault where only prose is at hand.

    Every line stays; by their numbers lines become headings of three levels, fences, page markers above lines, setext
    underlines and links, by rules that SQL engines compute alike.
    """
    k = F.col("doc_id")

    def line(x: Column, i: Column) -> Column:
        heading = F.concat(F.repeat(F.lit("#"), (F.floor(i / 4) % 3).cast("int") + 1), F.lit(" "), x)
        return (
            F.when((i % 4) == 0, heading)
            .when(((i % 11) == 5) & (k % 5 == 1), F.concat(F.lit("```\n"), x))
            .when(((i % 13) == 7) & (k % 5 == 2), F.concat(F.lit("<!-- page:"), F.floor(i / 13 + 1).cast("string"), F.lit(" -->\n"), x))
            .when(((i % 9) == 3) & (k % 5 == 3), F.concat(x, F.lit("\n-----")))
            .when((i % 4) == 2, F.concat(x, F.lit(" [more](./doc_"), (k + 1).cast("string"), F.lit(".md)")))
            .otherwise(x)
        )

    body = F.array_join(F.transform(t.lines(F.col("text")), line), "\n")
    front = F.when(k % 7 == 0, F.concat(F.lit("---\nlang: "), t.blank_to_empty(F.col("lang")), F.lit("\n---\n"))).otherwise("")
    file = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.concat(F.lit("doc_"), k.cast("string"), F.lit(".md")))
    return documents.select(file.alias("file"), F.concat(front, body).alias("content"))


def moved(items: DataFrame, key: str = "item_id", folder: str = "moved") -> DataFrame:
    """A redirect page for each item, to the Markdown form of its text's place among the pages."""
    number = F.col(key).cast("string")
    content = F.concat(F.lit("# Item "), number, F.lit("\n\nThis page has moved to [its page](../pages/page_"), number, F.lit(".md#top).\n"))
    return items.select(F.concat(F.lit(f"{folder}/item_"), number, F.lit(".md")).alias("file"), content.alias("content"))


def table_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, pages and redirects of a folder of tables, as one vault."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return structured(read("documents")).unionByName(html_pages(read("pages"))).unionByName(moved(read("benchmark")))
