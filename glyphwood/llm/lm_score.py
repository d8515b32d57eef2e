"""LM scoring: a smoothed bigram model in sharded Elias-Fano tries.

The model counts words and word pairs of all training texts. Pairs are kept in tries: a level of contexts, a level of
monotone pointers into the next, and a level of successors, each made monotone by its context's rank and coded by
Elias-Fano (low bits packed, high bits in unary), with 16-bit codes of the pairs' counts beside them. The levels lie in one
memory-mapped file. A pair is found by the context's rank, its pointer range, and a successor search within that range.

A corpus has no bound, so neither has the trie: keys are range-sorted into shards of bounded size (a frequent context may
span several), each shard's task builds its own trie and answers the keys that blocks of documents ask of it. A block asks
for each distinct key once, gives its own training counts of it along, and gets the corpus' count back.

    p(w | v) = (count(v w) + MU * p(w)) / (count(v) + MU),   p(w) = (count(w) + 1) / (N + V + 1)

which sums to 1 over the vocabulary and one unseen word. Counts of pairs are quantised downwards (exact to 32, then 12 steps
to the doubling), those of words are exact, and a pair counts as its words do at most. Words are 64-bit hashes; pairs are
CONTEXT bits of the context's hash and NEXT bits of a hash of both, so contexts that share their bits share no successors.

Defined results: a null or empty text is the end token alone; a text's first context is the start of a text, counted once
per training text; without training texts every token has probability 1 under the base, and the model scores alike;
repeated rows count again; a null doc_id is hashed as an empty text.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, mix, pack, pack_sorted, small_batches, table, text_bytes, tidy, unpack, unpack_sorted, word_hashes, written

MU = 100.0
CONTEXT, NEXT = 26, 38
#: Bytes of text of a block, and for each shard.
BLOCK, PER_SHARD = 12_000_000, 8_000_000
#: Texts (their first SAMPLE_CHARS characters) that the shards' bounds are drawn from; they decide nothing else.
SAMPLE_ROWS, SAMPLE_CHARS = 500, 20_000

START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)

def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words and an end), and how many each text has."""
    ids, sizes = word_hashes(texts)
    return np.insert(ids, np.cumsum(sizes), END), sizes + 1


def pair_keys(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Key of each token with the token before it, 64 bits: the context's, then the pair's."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    if len(sizes):
        before[np.cumsum(sizes) - sizes] = START
    return mix(before) >> np.uint64(64 - CONTEXT) << np.uint64(NEXT) | mix(ids ^ mix(before ^ np.uint64(0x5851F42D4C957F2D))) >> np.uint64(64 - NEXT)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def code(counts: np.ndarray) -> np.ndarray:
    """16 bits for a count: itself to 32, then the step of 2 ** (1 / 12) below it."""
    steps = np.floor(12 * np.log2(np.maximum(counts, 1)) + 1e-9) - 60
    return np.where(counts <= 32, counts, 32 + steps).astype(np.uint16)


#: The counts that codes stand for, to 2 ** 53.
GRID = np.concatenate([np.arange(33, dtype=np.float64), np.floor(2 ** (5 + np.arange(1, 12 * 48 + 1) / 12) + 1e-9)])


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary; next_geq within ranges."""

    def __init__(self, values: np.ndarray, universe: int):
        n = max(len(values), 1)
        self.low_bits = max(int(universe // n).bit_length() - 1, 0)
        low = values & np.uint64((1 << self.low_bits) - 1)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        kind = np.uint8 if self.low_bits <= 8 else np.uint16 if self.low_bits <= 16 else np.uint32 if self.low_bits <= 32 else np.uint64
        unary = np.zeros(len(values) + (int(high[-1]) if len(high) else 0) + 1, np.uint8)
        unary[high + np.arange(len(values))] = 1
        self.parts = [low.astype(kind), np.packbits(unary)]

    def mapped(self, parts: list[np.ndarray]) -> EliasFano:
        """Reads from mapped arrays from here on; high parts are a directory over them."""
        self.low = parts[0]
        ones = np.flatnonzero(np.unpackbits(parts[1])[: 8 * len(parts[1])])[: len(self.low)]
        self.high = ones - np.arange(len(ones))
        return self

    def get(self, at: np.ndarray) -> np.ndarray:
        return self.high[at].astype(np.uint64) << np.uint64(self.low_bits) | self.low[at].astype(np.uint64)

    def next_geq(self, x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Index of the first value >= x in [first, last), else last."""
        a, b = first.copy(), last.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) // 2
            less = self.get(mid) < x[live]
            a[live[less]] = mid[less] + 1
            b[live[~less]] = mid[~less]
            live = live[a[live] < b[live]]
        return a


class Trie:
    """Sorted distinct pair keys and their counts, as three levels in one memory-mapped file."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        context, first = np.unique(keys >> np.uint64(NEXT), return_index=True)
        rank = np.repeat(np.arange(len(context), dtype=np.uint64), np.diff(np.append(first, len(keys))))
        follow = rank << np.uint64(NEXT) | keys & np.uint64((1 << NEXT) - 1)
        self.contexts = EliasFano(context, 1 << CONTEXT)
        self.pointers = EliasFano(np.append(first, len(keys)).astype(np.uint64), len(keys) + 1)
        self.follow = EliasFano(follow, max(len(context), 1) << NEXT)
        levels = (self.contexts, self.pointers, self.follow)
        arrays = [x for level in levels for x in level.parts] + [code(counts)]
        handle, self.path = tempfile.mkstemp(prefix="trie-")
        with os.fdopen(handle, "wb") as f:
            for x in arrays:
                f.write(x.tobytes())
        self.bytes = sum(x.nbytes for x in arrays)
        views, at = [], 0
        for x in arrays:
            views.append(np.memmap(self.path, x.dtype, "r", at, x.shape) if x.size else x)
            at += x.nbytes
        for k, level in enumerate(levels):
            level.mapped(views[2 * k : 2 * k + 2])
        self.codes, self.n = views[-1], len(context)
        os.unlink(self.path)  # the mapping holds it as long as it is used

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The code of each key's count; 0 where there is none."""
        out = np.zeros(len(keys), np.uint16)
        if not self.n:
            return out
        context, zero = keys >> np.uint64(NEXT), np.zeros(len(keys), np.int64)
        rank = self.contexts.next_geq(context, zero, zero + self.n)
        known = np.flatnonzero(rank < self.n)
        known = known[self.contexts.get(rank[known]) == context[known]]
        r = rank[known]
        low, high = self.pointers.get(r).astype(np.int64), self.pointers.get(r + 1).astype(np.int64)
        x = r.astype(np.uint64) << np.uint64(NEXT) | keys[known] & np.uint64((1 << NEXT) - 1)
        at = self.follow.next_geq(x, low, high)
        found = at < high
        found[found] = self.follow.get(at[found]) == x[found]
        out[known[found]] = self.codes[at[found]]
        return out


ROWS = pa.schema([("block", pa.string()), ("kind", pa.string()), ("shard", pa.int32()), ("payload", pa.binary()), ("extra", pa.binary())])
ROWS_DDL = "block string, kind string, shard int, payload binary, extra binary"


def bounds_of(docs: DataFrame, shards: int) -> np.ndarray:
    """Keys that cut the pairs of a bounded sample of distinct texts into shards of equal size. The sample is drawn by hashes,
    and cut within one task: the driver gets its hashes and the bounds, no text."""
    name = F.xxhash64("text")
    least = docs.select(name.alias("h")).distinct().orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]
    even = (np.arange(1, shards, dtype=object) * (1 << CONTEXT + NEXT) // shards).astype(np.uint64)
    if least is None:
        return even
    chosen = docs.filter(name <= F.lit(least)).groupBy(name.alias("h")).agg(F.first(F.substring("text", 1, SAMPLE_CHARS)).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.unique(pair_keys(*word_ids([(t or "").encode() for t in b.column(0).to_pylist()]))) for b in batches]
        keys = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        if len(keys) >= shards:
            yield pa.RecordBatch.from_arrays([pa.array(keys[np.arange(1, shards) * len(keys) // shards].astype(np.int64))], names=["key"])

    rows = chosen.select("text").coalesce(1).mapInArrow(tidy("lm", cut), "key long").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64)) if rows else even


def asked(docs: DataFrame, bounds: np.ndarray, shards: int) -> DataFrame:
    """Blocks of tokenised documents, and the words and pairs that they ask for, with their training counts."""
    small_batches(docs.sparkSession)
    word_bounds = (np.arange(1, shards, dtype=object) * (1 << 64) // shards).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, (ids, texts) in enumerate(blocks(batches, BLOCK)):
            tokens, sizes = word_ids(texts)
            out = np.array([held_out(i) for i in ids])
            train = np.repeat(~out, sizes)
            words, index = np.unique(tokens, return_inverse=True)
            counts = np.bincount(index, train, len(words)).astype(np.uint64)
            pairs, where = np.unique(pair_keys(tokens, sizes), return_inverse=True)
            pair_counts = np.bincount(where, train, len(pairs)).astype(np.uint64)
            # frequent words get small numbers, which pack well
            order = np.argsort(-np.bincount(index, minlength=len(words)), kind="stable")
            number = np.empty(len(words), np.uint32)
            number[order] = np.arange(len(words), dtype=np.uint32)
            known = np.array([i is not None for i in ids], np.uint8)
            head = [pack(np.array([i or 0 for i in ids], np.int64)), pack(known), pack(sizes), pack(number[index]), pack(words[order])]
            name = f"{part}-{k}"
            rows = [(name, "docs", -1, b"".join([len(h).to_bytes(8, "little") + h for h in head]), b"")]
            for kind, keys, own, at in (("word", words, counts, word_bounds), ("pair", pairs, pair_counts, bounds)):
                cuts = [0, *np.searchsorted(keys, at).tolist(), len(keys)]
                rows += [(name, kind, s, pack_sorted(keys[a:b]), pack(own[a:b])) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROWS, strict=True)], schema=ROWS)

    return docs.select("doc_id", "text").mapInArrow(tidy("lm", run), ROWS_DDL)


def answered(rows: DataFrame) -> DataFrame:
    """The shards' answers: block, kind, shard, answer; and per word shard the training tokens and distinct words."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asks = [unpack_sorted(p) for p in group["payload"]]
        keys, back = np.unique(np.concatenate(asks), return_inverse=True)
        counts = np.bincount(back, np.concatenate([unpack(e) for e in group["extra"]]).astype(np.float64), len(keys))
        kind = group["kind"].iloc[0]
        if kind == "word":
            replies = np.split(counts.astype(np.uint64)[back], np.cumsum([len(a) for a in asks])[:-1])
        else:
            some = counts > 0
            trie = Trie(keys[some], counts[some])
            replies = [trie.look_up(a) for a in asks]
        out = pd.DataFrame({"block": group["block"], "kind": kind, "shard": group["shard"], "answer": [pack(r) for r in replies], "tokens": 0, "words": 0})
        if kind == "word":
            out.loc[len(out)] = [None, kind, group["shard"].iloc[0], None, int(counts.sum()), int((counts > 0).sum())]
        return out

    return rows.groupBy("kind", "shard").applyInPandas(tidy("lm", run), "block string, kind string, shard int, answer binary, tokens long, words long")


def scores(docs: DataFrame, mu: float = MU) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    shards = max(64, -(-text_bytes(docs) // PER_SHARD))
    rows = written(asked(docs, bounds_of(docs, shards), shards), "lm-blocks")
    told = written(answered(rows.filter("kind <> 'docs'")), "lm-answers")
    total, distinct = told.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    base_log = np.log10(total + distinct + 1)

    def finish(group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        for payload in group["payload"]:
            parts, at = [], 0
            while at < len(payload):
                n = int.from_bytes(payload[at : at + 8], "little")
                parts.append(unpack(payload[at + 8 : at + 8 + n]))
                at += 8 + n
            ids, known, sizes, number, words = parts
            told = told.sort_values("shard")
            replies = {k: [unpack(x) for x in told["answer"][told["kind"] == k]] for k in ("word", "pair")}
            tokens = words[number]
            own, index = np.unique(tokens, return_inverse=True)
            count = np.concatenate(replies["word"])[index].astype(np.float64)
            _, where = np.unique(pair_keys(tokens, sizes), return_inverse=True)
            pair = GRID[np.concatenate(replies["pair"])[where]]
            starts = np.cumsum(sizes) - sizes
            context = np.empty_like(count)
            context[1:] = count[:-1]
            context[starts] = count[np.cumsum(sizes) - 1]  # a start for every end
            base = np.log10(count + 1) - base_log
            low = mu * (count + 1) / (total + distinct + 1)
            model = np.log10((np.minimum(np.minimum(pair, context), count) + low) / (context + mu))
            add = lambda x: np.add.reduceat(x, starts)
            names = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
            out.append(pd.DataFrame({"doc_id": pd.array(names, "Int64"), "held_out": [held_out(i) for i in names], "n_tokens": sizes, "n_known": add((count > 0).astype(np.int64)), "train_tokens": int(total), "base_score": add(base), "score": add(model)}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.filter("kind = 'docs'").groupBy("block").cogroup(told.filter("block IS NOT NULL").groupBy("block")).applyInPandas(tidy("lm", finish), ddl)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the model of six sevenths of them."""
    return scores(table(spark, sf_dir, "documents"))
