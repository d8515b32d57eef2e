"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes, so that it knows spelling, case, punctuation and layout of all languages at once. Trusted text is
that of documents labelled good; the fit counts all of it. Every document is scored whole, and thresholds are quantiles over
all trusted documents of a language.

Few texts travel to meet the labels: a bitmap of hashed trusted ids (MOST_BITS at most) goes to the tasks that read documents,
and what passes it is joined with the ids, so what passes by chance goes again. Tasks count before they send.

Counts and questions are sharded by the same two bytes of an n-gram, the ones before the last two but one and before the
last: an n-gram of three bytes or more, its suffixes down to three bytes and all their contexts have them in common, so a
shard holds all that its n-grams' probabilities need. Only bigrams and single bytes cross shards; they are 2 ** 16 + 2 ** 8
at most and travel with the tasks. Documents are handled in blocks: a block asks each shard once for each distinct n-gram,
the shard joins the questions with its counts and sends probabilities back, and the block's documents are scored from
them. No task holds the model, no document's text waits anywhere but in its block.

Defined results: a null or empty text has no perplexity and is rejected; a language without FEWEST trusted documents (or a null
one) takes the threshold over all languages; without any trusted text every non-empty document is kept; repeated rows are
judged alike, and count again for thresholds; a document with contradictory labels isn't trusted. Blocks are made twice,
so docs must give the same rows in the same order each time, as a scan of files does; if they don't, the job fails.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import checkpointed, pack, pack_sorted, small_batches, table, text_bytes, tidy, unpack, unpack_sorted, written

ORDER = 5
#: Bits of the bitmap for each trusted id, and in all at most; with more ids more texts pass by chance and are joined in vain.
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Bits of a row in which Spark hands the bitmap over.
ROW_BITS = 1 << 15
#: Distinct n-grams that a task of the fit holds before it sends their counts.
HELD = 1_000_000
#: A document is rejected beyond the language's median plus SPREADS times the distance from there to the upper quantile.
UPPER, SPREADS, FEWEST = 0.98, 5.0, 30
#: Bytes of text of a block, and bytes looked at together.
BLOCK, SLICE = 6_000_000, 400_000
#: Shards of the model, and bytes of text whose questions a shard answers in one task; beyond them it is copied.
SHARDS, PER_GROUP = 256, 8_000_000_000
#: Thresholds of more languages than this are joined by a shuffle instead of broadcast.
MOST_LANGUAGES = 10_000

_LOW = [(1 << (8 * k)) - 1 for k in range(9)]


def grams_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte (texts start after line ends), and the texts' sizes."""
    lead = b"\n" * (order - 1)
    raw = b"".join([lead + t for t in texts])
    sizes = np.array([len(t) for t in texts], np.int64)
    # a number read at every byte, its first bytes foremost
    whole = np.ndarray(len(raw), ">u8", raw + b"\0" * 8, strides=(1,)) >> np.uint64(8 * (8 - order))
    keep = np.ones(len(raw), bool)
    keep[(np.cumsum(sizes + order - 1)[:, None] - np.arange(1, order)).reshape(-1)] = False  # these reach into the next text
    return whole[keep].astype(np.int64), sizes


class Table:
    """n-grams in slots by a hash: finds most of those asked for without a search. A slot holds one; others have none."""

    BITS = 19

    def __init__(self) -> None:
        self.grams, self.at = np.full(1 << self.BITS, -1, np.int64), np.zeros(1 << self.BITS, np.int32)

    def slots(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def fresh(self, grams: np.ndarray) -> np.ndarray:
        """Those that weren't in their slot, which now holds them (or another one of them)."""
        slot = self.slots(grams)
        new = self.grams[slot] != grams
        self.grams[slot[new]] = grams[new]
        return grams[new]

    def fill(self, keys: np.ndarray) -> None:
        """keys: sorted."""
        self.keys = keys
        slot = self.slots(keys)
        self.grams[slot] = keys
        self.at[slot] = np.arange(len(keys))

    def find(self, grams: np.ndarray) -> np.ndarray | None:
        """Where each lies among the keys; None if one doesn't."""
        slot = self.slots(grams)
        out = self.at[slot]
        miss = np.flatnonzero(self.grams[slot] != grams)
        if len(miss):
            x = grams[miss]
            at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
            if not len(self.keys) or (self.keys[at] != x).any():
                return None
            out[miss] = at
        return out


def sliced(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Groups of texts of SLICE bytes, one text at least."""
    group: list[bytes] = []
    held = 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= SLICE:
            yield group
            group, held = [], 0
    if group:
        yield group


def distinct(texts: list[bytes], order: int) -> np.ndarray:
    """The distinct n-grams of texts, sorted."""
    table = Table()
    parts = [np.unique(table.fresh(grams_of(group, order)[0])) for group in sliced(texts)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def shard_of(grams: np.ndarray) -> np.ndarray:
    """By the third and the second byte from the end."""
    middle = (grams >> 8 & 0xFFFF).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((middle >> np.uint64(32)) % np.uint64(SHARDS)).astype(np.int32)


# ---- the model --------------------------------------------------------------------------------------------------


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1 AND doc_id IS NOT NULL").select("doc_id")


def bitmap(ids: DataFrame) -> np.ndarray:
    """A power of two of bits, as bytes; the bits `places` of every id are set."""
    bits = ROW_BITS
    while bits < min(ids.count() * BITS_EACH, MOST_BITS):
        bits *= 2
    place = F.explode(F.array(*[p + 1 for p in places(bits)]))  # Spark's bitmaps count from 1
    rows = ids.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("b"))
    out = np.zeros((bits // ROW_BITS, ROW_BITS // 8), np.uint8)
    for r in rows.collect():
        out[r.k - 1] = np.frombuffer(r.b, np.uint8)
    return out.reshape(-1)


def places(bits: int) -> list[Column]:
    h = F.xxhash64(F.col("doc_id").cast("long"))
    return [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))]


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The compressed text of every row whose document is trusted."""
    ids = checkpointed(trusted_ids(labels).select(F.col("doc_id").cast("long")))
    held = bitmap(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for b in batches:
            passed = np.ones(b.num_rows, bool)
            for column in b.columns[2:]:
                at = column.to_numpy()
                passed &= (held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            if passed.any():
                few = b.filter(pa.array(passed))
                packed = pa.array([small.compress(t.encode()) for t in few.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([few.column("doc_id"), packed], names=["doc_id", "packed"])

    texts = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") > 0))
    one, two = places(8 * len(held))
    few = texts.select(F.col("doc_id").cast("long"), "text", one.alias("one"), two.alias("two")).mapInArrow(tidy("quality", run), "doc_id long, packed binary")
    return few.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").select("packed")


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams and their counts, added up."""
    grams, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    by = np.argsort(grams)
    grams = grams[by]
    first = np.flatnonzero(np.diff(grams, prepend=-1))
    return grams[first], np.add.reduceat(counts[by], first)


def train_counts(docs: DataFrame, labels: DataFrame, order: int) -> DataFrame:
    """shard, gram, c: n-grams of all trusted text."""

    def told(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        grams, counts = merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(shard_of(grams)), pa.array(grams), pa.array(counts)], names=["shard", "gram", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        new = 0  # n-grams of parts that aren't merged yet
        plain = zstandard.ZstdDecompressor()
        for b in batches:
            for group in sliced([plain.decompress(t) for t in b.column(0).to_pylist()]):
                parts.append(np.unique(grams_of(group, order)[0], return_counts=True))
                new += len(parts[-1][0])
                if new >= HELD:
                    parts, new = [merged(parts)], 0
                    if len(parts[0][0]) >= HELD:
                        yield told(parts)
                        parts = []
        if parts:
            yield told(parts)

    small_batches(docs.sparkSession)
    counted = trusted_texts(docs, labels).mapInArrow(tidy("quality", run), "shard int, gram long, c long")
    return counted.groupBy("shard", "gram").agg(F.sum("c").alias("c"))


def orders(grams: np.ndarray, counts: np.ndarray, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted n-grams and counts by order, down to three bytes: below the highest, numbers of distinct left neighbours."""
    by = np.argsort(grams)
    out = {order: (grams[by], counts[by])}
    for n in range(order - 1, 2, -1):
        out[n] = np.unique(out[n + 1][0] & _LOW[n], return_counts=True)
    return out


def discounts_of(n: dict[int, int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more, from the numbers of n-grams with counts of 1 to 4."""
    n1, n2, n3, n4 = (max(n.get(k, 0), 1) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(x, 0.1), k + 0.9) for k, x in enumerate(d)]


class Level:
    """The n-grams of one order and their contexts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, discounts: list[float]):
        less = np.array(discounts)[np.minimum(counts, 3) - 1]
        self.grams, self.own = grams, counts - less
        self.contexts, first = np.unique(grams >> 8, return_index=True)
        self.totals = np.add.reduceat(counts, first).astype(np.float64) if len(first) else np.zeros(0)
        self.back = np.add.reduceat(less, first) / self.totals if len(first) else np.zeros(0)

    @staticmethod
    def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return at, keys[at] == x

    def probabilities(self, grams: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Of the n-grams asked for, from those of their suffixes: the lower one alone where a context is unknown."""
        at, known = self._find(self.contexts, grams >> 8)
        out = np.where(known, self.back[at] * lower, lower) if len(self.contexts) else lower.copy()
        here, seen = self._find(self.grams, grams)
        out[seen] += self.own[here[seen]] / self.totals[at[seen]]
        return out


class Low:
    """What all shards share: discounts of all orders, and the probability of every byte after every byte."""

    def __init__(self, order: int, counted: dict[int, dict[int, int]], bigrams: np.ndarray, counts: np.ndarray):
        self.order = order
        self.discounts = {n: discounts_of(counted.get(n, {})) for n in range(3, order + 1)}
        singles, left = np.unique(bigrams & 255, return_counts=True)
        of = lambda c: dict(zip(*(x.tolist() for x in np.unique(c, return_counts=True)), strict=True))
        one = Level(singles, left, discounts_of(of(left))).probabilities(np.arange(256), np.full(256, 1 / 256))
        self.pairs = Level(bigrams, counts, discounts_of(of(counts))).probabilities(np.arange(1 << 16), np.tile(one, 256))

    def log_p(self, grams: np.ndarray, levels: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Natural logarithms of the last bytes' probabilities after the others, with a shard's n-grams."""
        p = self.pairs[grams & 0xFFFF]
        for n in range(3, self.order + 1):
            p = Level(*levels[n], self.discounts[n]).probabilities(grams & _LOW[n], p)
        return np.log(p)


def lowest(counts: DataFrame, order: int) -> Low | None:
    """What shards share; None without trusted text. The driver gets a row for each bigram and four for each order."""

    def run(shard: pa.Table) -> pa.Table:
        levels = orders(shard["gram"].to_numpy(), shard["c"].to_numpy(), order)
        kinds, keys, n = [], [], []
        for k in range(3, order + 1):
            few, many = np.unique(levels[k][1][levels[k][1] <= 4], return_counts=True)
            kinds += [k] * len(few)
            keys += few.tolist()
            n += many.tolist()
        pairs, many = np.unique(levels[3][0] & 0xFFFF, return_counts=True)
        return pa.table([pa.array(kinds + [2] * len(pairs), pa.int32()), pa.array(keys + pairs.tolist(), pa.int64()), pa.array(n + many.tolist(), pa.int64())], names=["kind", "key", "n"])

    rows = counts.groupBy("shard").applyInArrow(tidy("quality", run), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
    if not rows:
        return None
    counted: dict[int, dict[int, int]] = {}
    for r in rows:
        if r.kind > 2:
            counted.setdefault(r.kind, {})[r.key] = r.n
    pairs = np.array(sorted((r.key, r.n) for r in rows if r.kind == 2), np.int64).reshape(-1, 2)
    return Low(order, counted, pairs[:, 0], pairs[:, 1])


# ---- scoring ----------------------------------------------------------------------------------------------------


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], pa.RecordBatch]]:
    """Name, texts and rows of blocks of BLOCK bytes, one row at least. A block is named by its texts, so that whoever makes
    it again finds the answers to its questions."""
    held: list[pa.RecordBatch] = []
    size = 0

    def made() -> tuple[str, list[bytes], pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        texts = [(t or "").encode() for t in rows.column("text").to_pylist()]
        name = hashlib.blake2b(np.array([len(t) for t in texts], np.int64).tobytes(), digest_size=16)
        for t in texts:
            name.update(t)
        return name.hexdigest(), texts, rows

    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        start = 0
        for k, n in enumerate(sizes.tolist()):
            if size and size + n > BLOCK:
                held.append(b.slice(start, k - start))
                yield made()
                held, size, start = [], 0, k
            size += n
        if start < b.num_rows:
            held.append(b.slice(start))
    if sum(map(len, held)):
        yield made()


def answered(docs: DataFrame, counts: DataFrame, low: Low, groups: int) -> DataFrame:
    """block, shard, keys, logs: the distinct n-grams of each block with their log probabilities."""
    order = low.order

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, texts, _ in in_blocks(batches):
            grams = distinct(texts, order)
            shards = shard_of(grams)
            by = np.argsort(shards, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards[by])) + 1, [len(by)]])
            rows = [(name, int(shards[by[a]]), int(name[:8], 16) % groups, pack_sorted(grams[by[a:b]].astype(np.uint64))) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "shard", "part", "keys"])

    def tell(asked: pa.Table, own: pa.Table) -> pa.Table:
        keys = [unpack_sorted(k).astype(np.int64) for k in asked["keys"].to_pylist()]
        if not keys:
            return pa.table([pa.array([], k) for k in (pa.string(), pa.int32(), pa.binary(), pa.binary())], names=["block", "shard", "keys", "logs"])
        every = np.unique(np.concatenate(keys))
        logs = low.log_p(every, orders(own["gram"].to_numpy(), own["c"].to_numpy(), order)).astype(np.float32)
        values = [logs[np.searchsorted(every, k)].tobytes() for k in keys]
        return pa.table([asked["block"], asked["shard"], asked["keys"], pa.array(values, pa.binary())], names=["block", "shard", "keys", "logs"])

    asks = docs.select("text").mapInArrow(tidy("quality", ask), "block string, shard int, part int, keys binary")
    copies = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return asks.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(tidy("quality", tell), "block string, shard int, keys binary, logs binary")


def perplexities(texts: list[bytes], table: Table, logs: np.ndarray, order: int) -> list[float | None]:
    """Of each text; None for an empty one. table: where the logarithms of its n-grams lie."""
    out: list[float | None] = []
    for group in sliced(texts):
        full = [t for t in group if t]
        if full:
            grams, sizes = grams_of(full, order)
            at = table.find(grams)
            if at is None:
                raise RuntimeError("a block has no answers: docs gave other rows the second time")
            values = iter(np.exp(-np.add.reduceat(logs[at].astype(np.float64), np.cumsum(sizes) - sizes) / sizes).tolist())
        out += [next(values) if t else None for t in group]
    return out


def scored(docs: DataFrame, labels: DataFrame, order: int = ORDER, whole: bool = False) -> DataFrame:
    """doc_id, lang, perplexity of every row, null for empty texts, 1 without a model; with whole, also _row, the row."""
    small_batches(docs.sparkSession)
    head = StructType([StructField("doc_id", LongType()), StructField("lang", StringType()), StructField("perplexity", DoubleType())])
    kept = docs if whole else docs.select("doc_id", "lang", "text")
    schema = StructType([*head.fields, StructField("_row", kept.schema)]) if whole else head
    kinds = to_arrow_schema(schema)

    def told(rows: pa.RecordBatch, values: list[float | None]) -> pa.Table:
        columns = [rows.column("doc_id").cast(pa.int64()), rows.column("lang").cast(pa.string()), pa.array(values, pa.float64())]
        if whole:
            columns.append(pa.StructArray.from_arrays(rows.columns, fields=list(kinds.field("_row").type)))
        return pa.table([c.cast(k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)

    counts = checkpointed(train_counts(docs, labels, order))
    low = lowest(counts, order)
    if low is None:

        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from told(b, [1.0 if t else None for t in b.column("text").to_pylist()]).to_batches()

        return kept.mapInArrow(plain, schema)
    logs = answered(docs, counts, low, max(1, -(-text_bytes(docs) // PER_GROUP)))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, rows in in_blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as writer:
                writer.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([zstandard.ZstdCompressor(level=5).compress(sink.getvalue())], pa.binary())], names=["block", "rows"])

    def finish(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        once = {s: (unpack_sorted(k).astype(np.int64), np.frombuffer(v, np.float32)) for s, k, v in zip(*(answers[c].to_pylist() for c in ("shard", "keys", "logs")), strict=True)}  # a block that comes twice is answered twice
        keys, values = (np.concatenate([x[k] for x in once.values()] or [np.zeros(0)]) for k in (0, 1))
        by = np.argsort(keys)
        table, values = Table(), values[by]
        table.fill(keys[by].astype(np.int64))
        for payload in block["rows"].to_pylist():
            rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all().combine_chunks().to_batches()[0]
            out.append(told(rows, perplexities([(t or "").encode() for t in rows.column("text").to_pylist()], table, values, order)))
        return pa.concat_tables(out) if out else kinds.empty_table()

    blocks = kept.mapInArrow(tidy("quality", hold), "block string, rows binary")
    return blocks.groupBy("block").cogroup(logs.groupBy("block")).applyInArrow(tidy("quality", finish), schema)


# ---- verdicts ---------------------------------------------------------------------------------------------------


def thresholds(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """lang, most: the greatest perplexity that is kept; lang null: for all others."""
    known = scores.filter("perplexity IS NOT NULL").join(trusted_ids(labels), "doc_id", "left_semi")
    quantile = lambda q: F.percentile_approx("perplexity", q, 10_000)
    limit = (quantile(0.5) + SPREADS * (quantile(UPPER) - quantile(0.5))).alias("most")
    by = known.filter("lang IS NOT NULL").groupBy("lang").agg(limit, F.count("*").alias("n")).filter(F.col("n") >= FEWEST).select("lang", "most")
    return by.unionByName(known.agg(limit).select(F.lit(None).cast("string").alias("lang"), "most"))


def with_limits(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """scores with most and kept."""
    limits = checkpointed(limits)
    every = limits.filter("lang IS NULL").select(F.col("most").alias("_all"))
    own = limits.filter("lang IS NOT NULL")
    if own.count() <= MOST_LANGUAGES:
        own = F.broadcast(own)
    most = F.coalesce("most", F.lit(every.first()[0]).cast("double"))
    return scores.join(own, "lang", "left").withColumn("most", most).withColumn("kept", passes(F.col("perplexity"), F.col("most")))


def passes(perplexity: Column, most: Column) -> Column:
    return perplexity.isNotNull() & F.coalesce(perplexity <= most, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, most, kept of every row."""
    scores = written(scored(docs, labels), "quality-scores")
    return with_limits(scores, thresholds(scores, labels)).select("doc_id", "lang", "perplexity", "most", "kept")


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    rows = written(scored(docs, labels, whole=True), "quality-rows")
    return with_limits(rows, thresholds(rows.select("doc_id", "lang", "perplexity"), labels)).filter("kept").select("_row.*")


def op7_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
