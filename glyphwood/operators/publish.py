"""What a publication takes: which documents are accepted, the next tables, and the checks before they count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphwood.config import Config, EngineError
from glyphwood.operators import routing, validate
from glyphwood.sources.store import Change, Store

def decide(leaves: DataFrame, docs: DataFrame, findings: DataFrame, sources: DataFrame, indexed: DataFrame | None, mode: str) -> DataFrame:
    """leaves with state and reason. mode `ingest` refuses what is indexed already, `modify` replaces it."""
    staged = docs.select("tree_index").distinct().withColumn("_staged", F.lit(True))
    there = sources.select("file").distinct().withColumn("_source", F.lit(True))
    errors = findings.groupBy("file").agg(F.count("*").alias("_errors"))
    df = leaves.join(staged, "tree_index", "left").join(there, "file", "left").join(errors, "file", "left")
    known = F.lit(False)
    if indexed is not None:
        old = indexed.select("file").distinct().withColumn("_old", F.lit(True))
        trees = indexed.select("tree_index").distinct().withColumn("_old_tree", F.lit(True))
        df = df.join(old, "file", "left").join(trees, "tree_index", "left")
        known = F.coalesce("_old", "_old_tree", F.lit(False))
    reason = (
        F.when(F.col("_staged").isNull(), "staged tree not found")
        .when(F.lit(mode == "ingest") & known, "already indexed")
        .when(F.col("_source").isNull(), "source file missing")
        .when(F.col("_errors").isNotNull(), F.concat(F.col("_errors").cast("string"), F.lit(" validation error(s)")))
    )
    structural = reason.startswith("source") | reason.contains("validation")
    state = F.when(reason.isNull(), "published").when(structural, "failed_structural_validation").otherwise("failed_publish")
    return df.withColumns({"state": state, "reason": reason}).select(*leaves.columns, "state", "reason")


def publish(store: Store, staged: dict[str, DataFrame], decided: DataFrame, config: Config, mode: str = "ingest", dry_run: bool = False) -> dict:
    """Publishes accepted documents: staged docs and nodes, their leaves, aliases. All or nothing; a dry run only reports.

    Replaced documents lose their old rows in every table. The new routing table is checked before it counts.
    """
    accepted = decided.filter("state = 'published'").drop("state", "reason")
    files = accepted.select("file")
    leaf = F.struct(*[F.col(c) for c in accepted.columns if c not in ("file", "tree_index")])
    docs = staged["docs"].join(accepted.select("file", leaf.alias("index_metadata")), "file")
    tables = {"docs": Change(docs, files), "leaves": Change(accepted, files), "postings": Change(routing.postings(accepted), files)}
    for key in ("nodes", "cross_refs"):
        if key in staged:
            tables[key] = Change(staged[key].join(files, "file", "left_semi"), files)
    if "aliases" in staged:
        new = staged["aliases"].groupBy("from_file").agg(F.max("to_file").alias("to_file"))
        tables["aliases"] = Change(new, new.select("from_file"))
    counts = {r["state"]: r["count"] for r in decided.groupBy("state").count().collect()}
    report = {"mode": mode, "published": counts.get("published", 0), "rejected": sum(v for k, v in counts.items() if k != "published"), "dry_run": dry_run}
    if dry_run:
        return report

    return report | {"snapshot": store.publish(tables, report, checked(config))}


def without(store: Store, files: DataFrame) -> dict[str, Change]:
    """All of files(file) gone from every table that names them."""
    return {k: Change(None, files) for k in ("docs", "nodes", "leaves", "cross_refs", "postings") if store.has(k)}


def remove(store: Store, files: list[str], dry_run: bool = False) -> dict:
    """Takes documents out of the index; the snapshot before keeps them. Fails if none of them is indexed."""
    spark = store.spark
    leaves = store.table("leaves")
    asked = spark.createDataFrame([(f,) for f in sorted(set(files))], "file string")
    found = [r[0] for r in asked.join(leaves.select("file"), "file", "left_semi").collect()]
    lost = sorted(set(files) - set(found))
    if not found:
        raise EngineError("not_found", ", ".join(lost))
    report = {"mode": "remove", "removed": sorted(found), "not_found": lost, "dry_run": dry_run}
    if dry_run:
        return report
    return report | {"snapshot": store.publish(without(store, asked), report)}


def rebuilt(docs: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """The routing table from the trees alone, and the documents whose leaf can't be made whole: file, tree_index, missing.

    docs: roots of trees, with index_metadata (their leaf, as publication has left it) where there is one.
    """
    own = {f.name: f.dataType for f in docs.schema.fields}
    meta = {f.name for f in own["index_metadata"].fields} if "index_metadata" in own else set()

    def either(name: str, kind: str = "string") -> Column:
        parts = [F.col(f"index_metadata.{name}")] if name in meta else []
        if name in own:
            parts.append(F.col(name))
        return F.coalesce(*parts).cast(kind) if parts else F.lit(None).cast(kind)

    strings, pairs = "array<string>", "map<string,string>"
    leaves = docs.select(
        "file",
        either("doc_type").alias("doc_type"),
        F.coalesce(either("doc_group"), config.doc_group(F.col("doc_type"))).alias("doc_group"),
        either("topics", strings).alias("topics"),
        either("date_added").alias("date_added"),
        F.coalesce(F.col("index_metadata.summary") if "summary" in meta else F.lit(None).cast("string"), "root_summary").alias("summary"),
        "tree_index",
        either("ext", pairs).alias("ext"),
        either("null_fields", strings).alias("null_fields"),
    )
    lacks = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in ("file", "doc_type", "summary")]))
    told = leaves.withColumn("missing", lacks)
    return told.filter(F.size("missing") == 0).drop("missing"), told.filter(F.size("missing") > 0).select("file", "tree_index", "missing")


def rebuild(store: Store, config: Config, dry_run: bool = False, most: int = 20) -> dict:
    """Makes the routing table anew from the trees and publishes it, checked. Reports what couldn't be made whole (these
    documents keep the leaf that they had, if any), fields without a value, and documents under an unknown group."""
    leaves, lost = rebuilt(store.table("docs"), config)
    gaps = leaves.select("file", F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in ("doc_group", "topics", "date_added")]))).alias("field"))
    unknown = routing.placed(leaves, config).filter(F.size("unknown_fields") > 0)
    named = lambda df, *c: [tuple(r) for r in df.select(*c).orderBy(*c).limit(most).collect()]
    report = {"mode": "rebuild", "rebuilt": leaves.count(), "lost": named(lost, "file", "tree_index"), "unrecovered": named(gaps, "file", "field"), "under_unknown": named(unknown, "file"), "dry_run": dry_run}
    if dry_run:
        return report
    stale = store.table("leaves").select("file").join(lost.select("file"), "file", "left_anti").unionByName(leaves.select("file")).distinct()
    tables = {"leaves": Change(leaves, stale), "postings": Change(routing.postings(leaves), stale)}
    return report | {"snapshot": store.publish(tables, report, checked(config))}


def checked(config: Config) -> Callable[[Store, str], list[str]]:
    """What a publication is held against before it counts: the rules on the routing table."""

    def verify(s: Store, name: str) -> list[str]:
        leaves = s.table("leaves", name)
        found = validate.check_leaves(leaves, s.table("docs", name), config, routing.nodes(leaves, config))
        return [f"{r['code']}: {r['file']}" for r in found.limit(10).collect()]

    return verify
