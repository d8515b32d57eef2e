"""Suffix-array dedup: bytes of substrings that repeat, by bucket-pointer refinement.

A suffix array sorted to a depth of `length` bytes is wanted only as far as it says which suffixes share their first
`length` bytes with another. Bucket pointers give that without sorting suffixes: a place's bucket at depth 1 is its
byte, and its bucket at depth a + b is made from its bucket at depth a and the bucket of the later offset a at depth b,
so the buckets of all depths come from each other by doubling (64-bit identifiers, vectorised).

Buckets are refined in three rounds, each of which settles most places and hands the rest on:

1. Initial q-gram buckets, q = length / 2. Of the q-grams in a window of `length` bytes, the one with the least
   identifier is its anchor, so equal windows have equal anchors at equal places. Consecutive windows with one anchor
   form a run, whose identifier is made from its first and last window. A q-gram that one anchor only has settles its run:
   nothing repeats. One that several runs have, all alike, settles them too: every window repeats.
2. Only windows under anchors whose runs differ are refined: by sorting on the pair of bucket identifiers (at the
   place, at the later offset), and on a second identifier of the same bytes that is made in another way, so that a
   bucket holds one string (120 bits agree). Windows whose bucket holds two places repeat.
3. The texts with such windows get the answers back and their bytes are cut.

Documents are handled in blocks. A block sends each bucket identifier once, however often it has it, cut into ranges of
the identifier space; so a passage that a third of all documents has is one key per block. Work is in proportion to the
text, memory to a block or a range.

Defined results: a null or empty text has nothing removed; a text shorter than `length` bytes neither; copies of a whole
text of that length lose every byte in every copy (both occurrences are repeats); runs overlap freely; matches never
cross documents; repeated rows are copies of each other. Texts are UTF-8 bytes, and what is left need not be UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, forget, mix, pack, pack_docs, pack_sorted, shard_cuts, small_batches, table, text_bytes, tidy, unpack, unpack_docs, unpack_sorted, written

LENGTH = 200
#: Bytes of text of a block, bytes looked at at once, and bytes of text for each range of identifiers.
BLOCK, SLICE, PER_SHARD = 6_000_000, 250_000, 8_000_000

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_UP = np.uint64(29)
_LETTERS = _rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_BASE = int(_rng.integers(0, 1 << 63)) * 2 + 1


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bucket identifiers of a greater depth from those of two consecutive parts."""
    x = left * _ODD
    x ^= x >> _UP
    x += right
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def buckets(data: np.ndarray, depths: list[int]) -> list[np.ndarray]:
    """Bucket identifiers of every place at each depth (ascending), by doubling."""
    out: list[np.ndarray | None] = [None] * len(depths)
    done = [0] * len(depths)
    power, level = 1, _BYTES[data]
    top = max(depths)
    while True:
        for k, d in enumerate(depths):
            if d & power:  # parts in ascending order of size, one after the other
                n = len(data) - d + 1
                at = done[k]
                if n > 0:
                    part = level[at : at + n] if at + n <= len(level) else level[at:]
                    out[k] = part[:n].copy() if out[k] is None else _joined(out[k][:n], part[:n])
                done[k] += power
        power *= 2
        if power > top:
            break
        if len(level) > power // 2:
            level = _joined(level[: -(power // 2)], level[power // 2 :])
        else:
            level = level[:0]
    return [np.zeros(0, np.uint64) if o is None or len(data) < d else o[: len(data) - d + 1] for o, d in zip(out, depths, strict=True)]


def window_min(a: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by block prefixes and suffixes."""
    n = len(a) - width + 1
    rows = -(-len(a) // width)
    whole = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    whole[: len(a)] = a
    grid = whole.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Runs:
    """The runs of a block: for each, first and last window (places in the joined texts), anchor bucket and identifier."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, length: int):
        q = length // 2
        first, last, anchor, name = [], [], [], []
        low, high = np.uint64((1 << 21) - 1), ~np.uint64((1 << 21) - 1)
        valid = np.zeros(len(data), bool)  # windows that lie within one document
        ends = np.cumsum(sizes)
        for end, n in zip(ends.tolist(), sizes.tolist(), strict=True):
            if n >= length:
                valid[end - n : end - length + 1] = True
        for start in range(0, len(data), SLICE):
            at = np.flatnonzero(valid[start : start + SLICE])
            if not len(at):
                continue
            short, full = buckets(data[start : start + SLICE + length - 1], [q, length])
            least = window_min((mix(short) & high) | np.arange(len(short), dtype=np.uint64), length - q + 1)[at]
            cut = np.flatnonzero((least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)) + 1
            lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
            first.append(at[lo] + start)
            last.append(at[hi] + start)
            anchor.append(short[(least[lo] & low).astype(np.int64)])
            # runs are alike if their bytes are, and their anchor's place in them
            place = (least[lo] & low) - at[lo].astype(np.uint64)
            name.append(_joined(_joined(full[at[lo]], full[at[hi]]), (hi - lo).astype(np.uint64) << np.uint64(32) | place))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.first, self.last = join(first, np.int64), join(last, np.int64)
        # anchors are least under mix(), so another mixing spreads them over the shards
        self.anchor, self.name = mix(join(anchor, np.uint64) ^ _ODD), join(name, np.uint64)


def window_ids(data: np.ndarray, asked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers, at the full depth, of the places where asked is 1, and 56 bits of another identifier of the same
    bytes, made in another way: a sum of letters times powers by place. Windows are the same if both are."""
    out, proof = [], []
    inverse = pow(_BASE, -1, 1 << 64)
    for start in range(0, len(data), SLICE):
        at = np.flatnonzero(asked[start : start + SLICE])
        if len(at):
            part = data[start : start + SLICE + length - 1]
            out.append(buckets(part, [length])[0][at])
            powers, back = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(part), b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse))
            upto = np.concatenate([[np.uint64(0)], np.cumsum(_LETTERS[part] * powers[:-1], dtype=np.uint64)])
            proof.append(mix((upto[at + length] - upto[at]) * back[at]) >> np.uint64(8))
    none = np.zeros(0, np.uint64)
    return (mix(np.concatenate(out)), np.concatenate(proof)) if out else (none, none)


def distinct_windows(keys: np.ndarray, proofs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows apart, sorted by identifier then proof; the flag (1: several places); and each window's index."""
    order = np.lexsort([proofs, keys])
    k, p = keys[order], proofs[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    index = np.empty(len(k), np.int64)
    index[order] = np.cumsum(new) - 1
    counts = np.diff(np.append(np.flatnonzero(new), len(k)))
    return k[new], p[new] << np.uint64(8) | (counts > 1).astype(np.uint64), index


def distinct_anchors(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted anchors, 56 bits of a run identifier of each, flags (1: several runs, 2: runs that differ), and each run's index."""
    keys, back, counts = np.unique(runs.anchor, return_inverse=True, return_counts=True)
    name = (runs.name >> np.uint64(8)).astype(np.uint64)
    least, most = np.full(len(keys), np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(len(keys), np.uint64)
    np.minimum.at(least, back, name)
    np.maximum.at(most, back, name)
    return keys, least, (counts > 1).astype(np.uint8) | ((least != most) * 2).astype(np.uint8), back


BLOCK_ROWS = pa.schema([("block", pa.string()), ("kind", pa.string()), ("shard", pa.int32()), ("payload", pa.binary()), ("extra", pa.binary())])
BLOCK_DDL = "block string, kind string, shard int, payload binary, extra binary"
DIGEST_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SPANS_DDL = "doc_id long, text binary, kept binary, starts array<long>, ends array<long>"


def key_rows(block: str, keys: np.ndarray, extra: np.ndarray, shards: int) -> list[tuple]:
    cuts = shard_cuts(keys, shards)
    return [(block, "key", s, pack_sorted(keys[a:b]), pack(extra[a:b])) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), BLOCK_ROWS, strict=True)], schema=BLOCK_ROWS)


def first_round(docs: DataFrame, length: int, shards: int) -> DataFrame:
    """Blocks of documents and their anchors' keys."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, (ids, texts) in enumerate(blocks(batches, BLOCK)):
            block = f"{part}-{k}"
            data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
            keys, names, flags, _ = distinct_anchors(Runs(data, sizes, length))
            yield rows_batch([(block, "docs", -1, pack_docs(ids, texts), b""), *key_rows(block, keys, names << np.uint64(8) | flags, shards)])

    return docs.select("doc_id", "text").mapInArrow(tidy("suffix", run), BLOCK_DDL)


def answers(keys: DataFrame, judge, shards: int) -> DataFrame:
    """judge(keys, extras, owners) of each shard, cut into the blocks' answers again."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_sorted(p) for p in group["payload"]]
        extra = [unpack(e) for e in group["extra"]]
        verdict = judge(np.concatenate(parts), np.concatenate(extra))
        ends = np.cumsum([len(p) for p in parts])
        return pd.DataFrame({"block": group["block"], "shard": group["shard"], "answer": [pack(v) for v in np.split(verdict, ends[:-1])]})

    return keys.groupBy("shard").applyInPandas(tidy("suffix", run), "block string, shard int, answer binary")


def judge_anchors(keys: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """0: one run only; 1: several, all alike; 2: several that differ."""
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    n, name, flags = len(counts), extra >> np.uint64(8), extra & np.uint64(255)
    least, most, flag = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.minimum.at(least, back, name)
    np.maximum.at(most, back, name)
    np.bitwise_or.at(flag, back, flags)
    differ = (least != most) | (flag & np.uint64(2) > 0)
    several = (counts > 1) | (flag & np.uint64(1) > 0)
    return np.where(differ, 2, several).astype(np.uint8)[back]


def judge_windows(keys: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """1 if the same window is at two places or more."""
    order = np.lexsort([extra >> np.uint64(8), keys])
    k, p, flag = keys[order], extra[order] >> np.uint64(8), (extra[order] & np.uint64(255)).astype(np.uint8)
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    first = np.flatnonzero(new)
    several = (np.diff(np.append(first, len(k))) > 1) | (np.maximum.reduceat(flag, first) > 0 if len(first) else False)
    out = np.empty(len(k), np.uint8)
    out[order] = np.repeat(several, np.diff(np.append(first, len(k))))
    return out


def gathered(group: pd.DataFrame) -> np.ndarray:
    """A block's answers in the order of its keys."""
    ordered = group.sort_values("shard")["answer"]
    return np.concatenate([unpack(a) for a in ordered]) if len(ordered) else np.zeros(0, np.uint8)


def cut_out(ids: list, sizes: np.ndarray, raw: bytes, covered: np.ndarray) -> Iterator[tuple]:
    """(id, text, kept, starts, ends of the removed runs) of each document; covered: bytes to remove, as 0 or 1."""
    data, at = np.frombuffer(raw, np.uint8), 0
    for i, n in zip(ids, sizes.tolist(), strict=True):
        text, own = raw[at : at + n], covered[at : at + n]
        if own.any():
            edge = np.diff(own.astype(np.int8), prepend=0, append=0)
            yield i, text, data[at : at + n][own == 0].tobytes(), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        else:
            yield i, text, text, np.zeros(0, np.int64), np.zeros(0, np.int64)
        at += n


def covering(n: int, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Bytes under windows first .. last of each pair. Both ascend, so pairs that meet are neighbours."""
    edges = np.zeros(n + 1, np.int8)
    if len(first):
        apart = first[1:] > last[:-1] + length
        edges[first[np.concatenate([[True], apart])]] = 1
        edges[last[np.concatenate([apart, [True]])] + length] = -1
    return np.cumsum(edges[:n], dtype=np.int8).view(np.uint8)


def digest(rows: Iterator[tuple]) -> pd.DataFrame:
    out = [(i, len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()) for i, text, kept, starts, _ in rows]
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})


def full(rows: Iterator[tuple]) -> pd.DataFrame:
    out = [(i, text, kept, starts.tolist(), ends.tolist()) for i, text, kept, starts, ends in rows]
    return pd.DataFrame(out, columns=["doc_id", "text", "kept", "starts", "ends"]).astype({"doc_id": "Int64"})


def repeated_spans(docs: DataFrame, length: int = LENGTH, digests: bool = False) -> DataFrame:
    """One row per document: with digests, of DIGEST_DDL; else its bytes, those kept, and the removed runs."""
    shards = max(64, -(-text_bytes(docs) // PER_SHARD))
    one = written(first_round(docs, length, shards), "suffix-one")
    settled = answers(one.filter("kind = 'key'"), judge_anchors, shards)
    finish, ddl = (digest, DIGEST_DDL) if digests else (full, SPANS_DDL)

    def refine(group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, payload in zip(group["block"], group["payload"], strict=True):
            ids, sizes, raw = unpack_docs(payload)
            data, ends = np.frombuffer(raw, np.uint8), np.cumsum(sizes)
            runs = Runs(data, sizes, length)
            status = gathered(told)[distinct_anchors(runs)[3]]
            sure = covering(len(data), runs.first[status == 1], runs.last[status == 1], length)
            asked = covering(len(data), runs.first[status == 2], runs.last[status == 2], 1)
            waits = np.zeros(len(ids), bool)
            waits[np.searchsorted(ends, runs.first[status == 2], side="right")] = True
            byte_waits = np.repeat(waits, sizes)
            for kind, flag in (("done", False), ("open", True)):
                chosen = np.flatnonzero(waits == flag).tolist()
                if chosen:
                    bits = [np.packbits(x[byte_waits == flag]) for x in (sure, asked)]
                    out.append((block, kind, -1, pack_docs([ids[k] for k in chosen], [raw[ends[k] - sizes[k] : ends[k]] for k in chosen]), pack(np.concatenate(bits))))
            keys, extra, _ = distinct_windows(*window_ids(data, asked, length))
            out += key_rows(block, keys, extra, shards)
        return pd.DataFrame(out, columns=["block", "kind", "shard", "payload", "extra"])

    two = written(one.filter("kind = 'docs'").groupBy("block").cogroup(settled.groupBy("block")).applyInPandas(tidy("suffix", refine), BLOCK_DDL), "suffix-two")
    forget(docs.sparkSession, one)

    def opened(payload: bytes, extra: bytes) -> tuple:
        ids, sizes, raw = unpack_docs(payload)
        bits = unpack(extra)
        sure, asked = (np.unpackbits(x, count=len(raw)) for x in np.split(bits, 2))
        return ids, sizes, raw, sure, asked

    def plain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for payload, extra in zip(f["payload"], f["extra"], strict=True):
                ids, sizes, raw, sure, _ = opened(payload, extra)
                yield finish(cut_out(ids, sizes, raw, sure))

    def last_round(group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        for payload, extra in zip(group["payload"], group["extra"], strict=True):
            ids, sizes, raw, sure, asked = opened(payload, extra)
            _, _, back = distinct_windows(*window_ids(np.frombuffer(raw, np.uint8), asked, length))
            at = np.flatnonzero(asked)[gathered(told)[back] > 0]
            rows += cut_out(ids, sizes, raw, sure | covering(len(raw), at, at, length))
        return finish(iter(rows))

    small_batches(docs.sparkSession, 8)
    done = two.filter("kind = 'done'").select("payload", "extra").mapInPandas(tidy("suffix", plain), ddl)
    rest = two.filter("kind = 'open'").groupBy("block").cogroup(answers(two.filter("kind = 'key'"), judge_windows, shards).groupBy("block")).applyInPandas(tidy("suffix", last_round), ddl)
    return done.unionByName(rest)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of its 200-byte strings that start anywhere else."""
    return repeated_spans(table(spark, sf_dir, "documents"), digests=True)
