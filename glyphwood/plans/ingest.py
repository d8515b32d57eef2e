"""From sources to an index: parse, classify, build, summarise with retries, judge, publish; and keeping it in step."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphwood.config import Config, EngineError
from glyphwood.operators import classify as classes
from glyphwood.operators import cross_refs, maintenance, parse, semantic, tree
from glyphwood.operators import publish as publication
from glyphwood.sources.store import Store


@dataclass
class Built:
    """Everything that ingestion derives from sources before a publication."""

    sources: DataFrame
    source_map: DataFrame
    classified: DataFrame
    docs: DataFrame
    nodes: DataFrame
    aliases: DataFrame
    rejects: DataFrame


@dataclass
class Merged:
    docs: DataFrame
    nodes: DataFrame
    leaves: DataFrame
    findings: DataFrame
    excluded: DataFrame
    retries: list[int] = field(default_factory=list)


#: Keeps a table of a run: takes its name and the table, returns what is to be read instead.
Stage = Callable[[str, DataFrame], DataFrame]


def lazily(_: str, df: DataFrame) -> DataFrame:
    return df


def build(sources: DataFrame, config: Config, stage: Stage = lazily) -> Built:
    """Texts are parsed once; trees are made of substantive documents alone."""
    whole = stage("source_map", parse.source_map(sources))
    classified = classes.classify(whole, config)
    substantive = classes.substantive(whole, config)
    docs = tree.documents(substantive, config)
    fine = stage("docs", docs.filter("reject IS NULL").drop("reject"))
    rejects = docs.filter("reject IS NOT NULL").select("file", "reject")
    wanted = substantive.filter("doc_type IS NOT NULL")
    nodes = tree.build(wanted.filter(F.size("page_markers") > 0) if config.page_numbers_in_citations else wanted, config)
    return Built(sources, whole, classified, fine, stage("nodes", nodes), classes.aliases(classified), rejects)


def summarise(built: Built, config: Config, stage: Stage, model: semantic.Summariser = semantic.extractive, date_added: str | None = None) -> Merged:
    """Asks the model for every node and document, judges the outcome, and asks again for what failed, up to the limit.

    The model's answers are staged, so it isn't asked twice for the same, and rounds don't compute earlier rounds again.
    """
    queue = stage("tasks", semantic.tasks(built.nodes, built.docs, built.sources, config))
    results = stage("results", model(queue))
    rounds: list[int] = []
    while True:
        docs, nodes = semantic.fold(built.docs, built.nodes, results)
        docs, nodes = stage("merged_docs", docs), stage("merged_nodes", nodes)
        findings = stage("findings", semantic.judge(docs, nodes, built.source_map, semantic.missing(queue, results), config))
        # the default would give the same for the same text
        if len(rounds) == config.semantic_retry_limit or model is semantic.extractive:
            break
        again = queue.join(semantic.retry_tasks(findings).select("task_id"), "task_id", "left_semi")
        n = again.count()
        if not n:
            break
        rounds.append(n)
        renewed = stage("renewed", model(again))
        results = stage("results", results.join(renewed.select("task_id"), "task_id", "left_anti").unionByName(renewed))
    made = semantic.make_leaves(docs, config, date_added or f"{datetime.date.today():%Y-%m-%d}")
    leaves, excluded = semantic.passing(made, findings)
    return Merged(docs, nodes, leaves, findings, excluded, rounds)


def publish(store: Store, built: Built, merged: Merged, config: Config, mode: str = "ingest", dry_run: bool = False, stage: Stage = lazily) -> dict[str, Any]:
    indexed = store.table("leaves") if store.current() else None
    broken = merged.findings.filter("scope = 'structure'")
    decided = stage("decided", publication.decide(merged.leaves, merged.docs, broken, built.sources, indexed, mode))
    refs = stage("cross_refs", references(built))
    return publication.publish(store, {"docs": merged.docs, "nodes": merged.nodes, "aliases": built.aliases, "cross_refs": refs}, decided, config, mode, dry_run)


def ingest(store: Store, sources: DataFrame, config: Config, model: semantic.Summariser = semantic.extractive, mode: str = "ingest", dry_run: bool = False, date_added: str | None = None) -> dict[str, Any]:
    """All steps. mode `modify` replaces documents that are indexed already."""
    if mode not in ("ingest", "modify"):
        raise EngineError("bad_mode", mode)
    with store.stager() as stage:
        built = build(sources, config, stage)
        merged = summarise(built, config, stage, model, date_added)
        return publish(store, built, merged, config, mode, dry_run, stage)


def references(built: Built) -> DataFrame:
    return cross_refs.detect(built.source_map, built.nodes, built.docs.select("file"), built.aliases)


def sync(store: Store, sources: DataFrame, config: Config, model: semantic.Summariser = semantic.extractive, dry_run: bool = False) -> dict[str, Any]:
    """Brings the index in step with the sources: removals, then changes, then new documents; one publication each."""
    classified = classes.classify(parse.source_map(sources), config)
    if store.current() is None:
        plan = classified.select("file", F.when(F.col("indexed"), "ingest").otherwise("exclude").alias("action"))
    else:
        plan = maintenance.sync_plan(classified, store.table("leaves"), store.table("docs")).select("file", "action")
    plan = plan.persist()
    report: dict[str, Any] = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    try:
        if not dry_run:
            if report.get("remove"):
                gone = plan.filter("action = 'remove'").select("file")
                store.publish(publication.without(store, gone), {"mode": "remove", "removed": report["remove"]})
            for action in ("modify", "ingest"):
                if report.get(action):
                    chosen = sources.join(plan.filter(F.col("action") == action).select("file"), "file", "left_semi")
                    report[f"{action}_report"] = ingest(store, chosen, config, model, action)
    finally:
        plan.unpersist()
    return report

