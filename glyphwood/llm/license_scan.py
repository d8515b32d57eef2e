"""License scans: a positional index over the rarest words of licence templates, JVM-side only.

Templates and base phrases are word sequences. Each is filed under its words of highest inverse template frequency,
with their positions. A text's words are looked up in that index within the row; each hit proposes the template at the
start (position in the text less position in the template). Starts proposed are compared word by word with the
template, and a template counts where enough of its words agree and all its mandatory key phrases stand in the text at
their places. A base phrase needs all its words, so its rarest word finds every place and the count is exact.

Nothing is shuffled: the index is a literal of fixed size, and a text's own hits stay within its row.

Defined results: a null or empty text has no words, no labels and score 0; overlapping places count one by one; labels
are distinct and sorted; repeated rows are scanned alike.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .quality_rules import bind

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of each template that are filed, and the share of a template's words that must agree.
ANCHORS, LEAST_SHARE = 2, 0.8


class Template(NamedTuple):
    label: str
    words: list[str]
    #: (position, words) that must agree whatever the share.
    keys: list[tuple[int, list[str]]]


def template(label: str, text: str, *keys: str) -> Template:
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    found = []
    for key in keys:
        k = key.lower().split()
        found.append((next(i for i in range(len(words)) if words[i : i + len(k)] == k), k))
    return Template(label, words, found)


BASE = [template("mit", "under the mit license", "under the mit license"), template("apache-2", "apache license version 2", "apache license version 2"), template("cc-by-nc", "cc by nc", "cc by nc")]

TEMPLATES = [
    template("mit", "Released under the MIT License.", "the mit license"),
    template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "permission is hereby granted free of charge", "without restriction"),
    template("apache-2", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "except in compliance with the license"),
    template("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    template("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa 4 0"),
    template("gpl-3", "This work is licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    template("gpl", "GNU General Public License as published by the Free Software Foundation", "gnu general public license"),
    template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license v 2 0"),
]


def index(templates: list[Template], anchors: int = ANCHORS) -> dict[str, list[tuple[int, int]]]:
    """word -> (template, position), for the `anchors` rarest words of each template (base phrases: one is enough)."""
    holds = Counter(w for t in templates for w in set(t.words))
    idf = {w: math.log(len(templates) / n) for w, n in holds.items()}
    filed: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        must = {w for _, key in t.keys for w in key}
        for w in sorted(set(t.words), key=lambda w: (w not in must, -idf[w], -len(w), w))[:anchors]:
            filed.setdefault(w, []).append((k, t.words.index(w)))
    return filed


def lowered(text: Column) -> Column:
    """A-Z lower-cased. lower() also maps other letters, but only U+0130 and U+212A to ASCII ones, so words compare alike."""
    return F.when(text.rlike("[\u0130\u212A]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _words and _hits: (label, base, start, share) for each template found in a text."""
    every = BASE + TEMPLATES
    filed = index(BASE, 1)
    for w, places in index(TEMPLATES).items():
        filed.setdefault(w, []).extend((k + len(BASE), p) for k, p in places)
    low = lowered(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    words = F.filter(F.split(F.regexp_replace(low, NOT_WORD, " "), " "), lambda w: w != "")
    anchors = F.array([F.lit(w) for w in sorted(filed)])
    where = lambda w: F.filter(F.transform(w, lambda x, i: F.when(x.isin(sorted(filed)), i)), lambda i: i.isNotNull())
    postings = F.array([F.array([F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in filed[w]]) for w in sorted(filed)])
    lengths = F.array([F.lit(len(t.words)) for t in every])
    texts = F.array([F.array([F.lit(x) for x in t.words]) for t in every])
    labels = F.array([F.lit(t.label) for t in every])
    keys = F.array([F.array([F.struct(F.lit(p).alias("p"), F.array([F.lit(x) for x in k]).alias("k")) for p, k in t.keys]) for t in every])

    def proposals(w: Column, at: Column) -> Column:
        """Distinct (template, start) of the anchors at the positions `at`."""
        each = F.transform(at, lambda i: F.transform(F.get(postings, (F.array_position(anchors, F.get(w, i)) - 1).cast("int")), lambda x: F.struct(x["k"].alias("k"), (i - x["p"]).alias("s"))))
        return F.array_distinct(F.flatten(each))

    def verified(w: Column, proposed: Column) -> Column:
        def one(c: Column) -> Column:
            k, s = c["k"], c["s"]
            agree = F.size(F.filter(F.transform(F.get(texts, k), lambda x, j: F.coalesce(F.get(w, s + j) == x, F.lit(False))), lambda x: x))
            whole = F.forall(F.get(keys, k), lambda key: F.forall(F.transform(key["k"], lambda x, j: F.coalesce(F.get(w, s + key["p"] + j) == x, F.lit(False))), lambda x: x))
            return F.struct(F.get(labels, k).alias("label"), (k < len(BASE)).alias("base"), s.alias("start"), (agree / F.get(lengths, k)).alias("share"), whole.alias("whole"))

        return F.filter(F.transform(proposed, one), lambda x: x["whole"] & (x["share"] >= LEAST_SHARE))

    def hits(w: Column) -> Column:
        some = lambda at: F.when(F.size(at) > 0, bind(proposals(w, at), lambda p: verified(w, p)))
        return bind(where(w), some)

    return docs.withColumn("_words", words).withColumn("_hits", bind(F.col("_words"), hits))


def summary(scans: DataFrame, *keep: str) -> DataFrame:
    starts = F.transform(F.filter("_hits", lambda x: x["base"]), lambda x: x["start"].cast("long"))
    joined = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["label"]))), ",")
    none = F.lit("")
    return scans.select(
        *keep, F.size("_words").cast("long").alias("n_words"), F.coalesce(F.size(starts), F.lit(0)).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.coalesce(joined(F.filter("_hits", lambda x: x["base"])), none).alias("base_labels"), F.coalesce(joined(F.col("_hits")), none).alias("labels"),
        F.coalesce(F.array_max(F.transform("_hits", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    scans = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return summary(scans.withColumn("_hits", F.coalesce("_hits", F.array().cast(scans.schema["_hits"].dataType))), "doc_id")


def oracle() -> str:
    """DuckDB SQL for op10_license_scan: tries every template at every word."""
    every = BASE + TEMPLATES
    rows = []
    for k, t in enumerate(every):
        must = {p + j for p, key in t.keys for j in range(len(key))}
        rows += [f"({k}, '{t.label}', {str(k < len(BASE)).lower()}, {j}, '{w}', {str(j in must).lower()}, {len(t.words)}, {len(must)})" for j, w in enumerate(t.words)]
    return f"""
    WITH templates(k, label, base, j, w, must, n, n_must) AS (VALUES {", ".join(rows)}),
    texts AS (
        SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}'), lambda w: w <> '') AS ws FROM documents
    ), words AS (
        SELECT r, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM texts
    ), places AS (
        SELECT r, k, label, base, i - j AS start, count(*)::DOUBLE / n AS share FROM words JOIN templates USING (w)
        GROUP BY r, k, label, base, i - j, n, n_must HAVING count(*) FILTER (must) = n_must AND count(*)::DOUBLE / n >= {LEAST_SHARE}
    ), found AS (
        SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM places GROUP BY r
    )
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
        coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
    FROM texts LEFT JOIN found USING (r)
    """
