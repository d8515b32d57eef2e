"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

All stages but the last return the columns of documents. Nulls: documents with a null text go at the first stage (they
have no perplexity), documents with a null doc_id at the near-duplicate stage (nothing can name them). Different texts under
one id are documents of their own. An empty table passes through as one. Tables that a stage was made from go when the
next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphwood.llm import near_dup, packing, quality_lm, quality_rules, suffix_dedup
from glyphwood.llm.common import map_arrow, staged, table, written


@staged
def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's threshold."""
    return quality_lm.quality_filter(docs, table(spark, sf_dir, "labels"))


@staged
def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the table of rules."""
    return quality_rules.quality_filter(docs)


def named(docs: DataFrame) -> DataFrame:
    """docs with _name: the same for copies of a text under one id, and for these only."""
    return docs.withColumn("_name", F.xxhash64("doc_id", "text"))


@staged
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document of the least id, once."""
    rows = named(docs.filter("doc_id IS NOT NULL"))
    groups = near_dup.near_duplicates(rows.select(F.col("_name").alias("doc_id"), "text")).select(F.col("doc_id").alias("_name"), F.col("component_id").alias("_of")).distinct()
    ids = rows.select("_name", F.col("doc_id").alias("_id")).distinct()
    place = F.struct(F.col("_id").alias("id"), F.col("_name").alias("name"))
    kept = groups.join(ids, "_name").groupBy("_of").agg(F.min(place).alias("_m")).select(F.col("_m.name").alias("_name"))
    first = F.row_number().over(Window.partitionBy("_name").orderBy("text"))
    return rows.join(kept, "_name", "left_semi").withColumn("_row", first).filter("_row = 1").select(*docs.columns)


@staged
def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes that also start elsewhere. A character that is cut in two goes as a whole.

    Every document stays, with what is left of its text and that text's n_chars.
    """
    rows = named(docs)
    spans = suffix_dedup.repeated_spans(rows.select(F.col("_name").alias("doc_id"), "text")).select("doc_id", "kept")

    def make(cols: dict[str, list]) -> dict[str, list]:
        return {"_name": cols["doc_id"], "text": [k.decode("utf-8", "ignore") for k in cols["kept"]]}

    texts = map_arrow(spans, make, "_name long, text string")
    rest = rows.drop("text", "n_chars").join(texts, "_name").withColumn("n_chars", F.length("text").cast("long"))
    return rest.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])


@staged
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens."""
    return packing.pack(packing.pieces_of(docs))


STAGES = [
    ("quality classifier", classifier_stage),
    ("quality rules", rules_stage),
    ("near dedup", near_stage),
    ("suffix dedup", suffix_stage),
    ("best-fit packing", packing_stage),
]

#: None: perplexities, tokenizers and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
