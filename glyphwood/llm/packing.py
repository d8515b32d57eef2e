"""Best-fit packing of token sequences, bulk-synchronous over classes of equal length.

Texts become token ids; longer ones are cut into pieces of the capacity. Pieces are range-sorted by length. Lengths and
gaps are integers up to the capacity, so a rank range of pieces of one length and a range of sequences with one gap are
matched at once: each round takes the longest unplaced class, finds its best fit by a successor search among the gap
classes, lets ranks resolve which piece gets which sequence, moves those sequences to their new gap class and goes on;
what finds no gap opens new sequences. The rounds equal best-fit decreasing, piece by piece, and their state depends on
the capacity, never on the number of pieces. The matches (rank ranges) go back to the pieces by a search on
(length, rank), each piece's rank being its place in the range-sorted table.

Defined results: a null or empty text is the single end id; every piece is placed once; equal lengths are placed in the
order of (id, piece); repeated rows are packed one by one.
"""

from __future__ import annotations

import bisect
import json
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, crc, keeps, map_arrow, table, tidy

CAPACITY = 2048
#: Chunks between white space, and words, whose ids a worker keeps; as many again that weren't met since.
MOST_KEPT = 300_000
#: With other characters than these, a text goes through the library whole: ASCII, and letters and signs of Latin scripts
#: but numerals (² to ¹, fractions) and U+0130, on which splitting or lower-casing may differ.
ODD = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]|[²³¹¼½¾İ]")
#: The bytes of such texts in Latin-1, where they are fast to look for.
_PLAIN_BYTES = bytes(b for b in range(256) if not ODD.search(chr(b)))
# The vocabulary's own division of a text into words.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Signs between a letter or digit and white space are a word of their own: apart from it, there are fewer distinct chunks.
TRAILING = r"([\p{L}\p{N}])([^\s\p{L}\p{N}']+)(\s)", r"\1 \2\3"
#: Marks the last token of a word.
WORD_END = "</w>"
#: Words given to the library in one text.
TOGETHER = 200


def is_plain(text: str) -> bool:
    if "<|" in text:
        return False
    try:
        return not text.encode("latin-1").translate(None, _PLAIN_BYTES)
    except UnicodeEncodeError:
        return not ODD.search(text)


class ChunkTokenizer:
    """A tokenizer that drops white space and merges within words: ids are kept by word and by chunk between white space,
    so the library sees each new word once, many in one text, told apart by the tokens that end a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        # plain words need no normalising and are split already
        bare = json.loads(self.library.to_str())
        blanks, in_bytes = {"type": "WhitespaceSplit"}, bare["pre_tokenizer"]["pretokenizers"][-1]
        bare |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [blanks, in_bytes]}, "added_tokens": []}
        self.words = Tokenizer.from_str(json.dumps(bare))
        self.kept: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _learn_words(self, new: list[str]) -> None:
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            ids = np.array(self.words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(stops) == len(some):
                self.kept.update(zip(some, map(ids.tobytes().__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))
            else:
                self.kept.update(zip(some, self.whole(some), strict=True))

    def _recall(self, some: set[str]) -> set[str]:
        """Takes over what was kept before. Returns the rest."""
        known = {c: self.before[c] for c in some if c in self.before}
        self.kept.update(known)
        return some.difference(known)

    def _learn(self, chunks: set[str]) -> None:
        chunks = self._recall(chunks)
        several = {c: p for c in chunks if not c.isalpha() and len(p := WORD.findall(c)) > 1}
        words = {w for p in several.values() for w in p if w not in self.kept}
        self._learn_words(list(self._recall(words).union(chunks.difference(several))))
        self.kept.update((c, b"".join([self.kept[w] for w in p])) for c, p in several.items())

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Chunks are told apart outside Python, so it sees each
        distinct one of a batch once."""
        plain = [is_plain(text) for text in texts]
        lower = pc.utf8_lower(pa.array([t if p else "" for t, p in zip(texts, plain, strict=True)], pa.large_string()))
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, *TRAILING))
        coded = parts.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        new = set(chunks).difference(self.kept)
        if len(self.kept) + len(new) > MOST_KEPT:
            self.kept, self.before = {"": b""}, self.kept
            new = set(chunks).difference(self.kept)
        self._learn(new)
        own = list(map(self.kept.__getitem__, chunks))
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(own), "<u4")
        which = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[which])])
        ids = flat[np.repeat(starts[which] - ends[:-1], sizes[which]) + np.arange(ends[-1])]
        cuts = ends[parts.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() if p else self.whole([text])[0] for text, p, a, b in zip(texts, plain, cuts[:-1], cuts[1:], strict=True)]


_loaded: dict[str, ChunkTokenizer] = {}
keeps("packing", _loaded.clear)


def load(name: str) -> ChunkTokenizer:
    if name not in _loaded:
        import os

        import public_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded[name] = ChunkTokenizer(name if os.sep in name else public_tokenizers.path(name))
    return _loaded[name]


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "word_bpe_49k.json", end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each text's pieces."""
    end = np.array([end_id], "<u4").tobytes()

    def make(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for i, ids in zip(cols["doc_id"], load(vocabulary).encode_batch([t or "" for t in cols["text"]]), strict=True):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for column, value in zip(out.values(), (i, k, at // 4, len(part) // 4, crc(part)), strict=True):
                    column.append(value)
        return out

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id long, piece int, start long, length long, ids_crc32 long", "packing")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over classes. Rows (length, first rank, number, first sequence, offset), and how many sequences.

    Ranks of a length, and sequences of a row, are consecutive: rank first + i goes to sequence first + i at that offset.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # classes in use, ascending
    free: dict[int, deque[tuple[int, int]]] = {}
    made = 0

    def put(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in free:
                bisect.insort(gaps, gap)
                free[gap] = deque()
            held = free[gap]
            if held and held[-1][0] + held[-1][1] == first:
                held[-1] = (held[-1][0], held[-1][1] + number)
            else:
                held.append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(gaps, length)
            if k < len(gaps):
                gap = gaps[k]
                first, number = free[gap].popleft()
                take = min(number, left)
                if take < number:
                    free[gap].appendleft((first + take, number - take))
                elif not free[gap]:
                    del free[gap], gaps[k]
                rows.append((length, rank, take, first, capacity - gap))
                put(gap - length, first, take)
                rank, left = rank + take, left - take
                continue
            each = capacity // length
            full = left // each
            for j in range(each if full else 0):
                rows.append((length, rank + j * full, full, made, j * length))
            put(capacity - each * length, made, full)
            made, rank, left = made + full, rank + each * full, left - each * full
            if left:
                for j in range(left):
                    rows.append((length, rank + j, 1, made, j * length))
                put(capacity - left * length, made, 1)
                made, left = made + 1, 0
    return np.array(sorted(rows), np.int64).reshape(-1, 5), made


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with doc_id, piece, length) with sequence_id and offset.

    The driver gets a count per (partition of the sorted table, length): at most one row a partition and a length, as
    the table is range-sorted by length.
    """
    spark = pieces.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    pieces = checkpointed(pieces)  # range-sorting samples its input first, which would make the pieces twice
    ranged = pieces.repartitionByRange(n, F.col("length"), F.col("doc_id"), F.col("piece")).sortWithinPartitions("length", "doc_id", "piece")
    ranged = checkpointed(ranged.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    first: dict[tuple[int, int], tuple[int, int]] = {}
    counts: dict[int, int] = {}
    for p, length, least, number in sorted(ranged.groupBy(part.alias("p"), "length").agg(F.min("_place"), F.count("*")).collect()):
        first[p, length] = (least, counts.get(length, 0))
        counts[length] = counts.get(length, 0) + number
    rows, _ = plan(counts, capacity)
    where = np.array(sorted((length << 33 | p, *at) for (p, length), at in first.items()), np.int64).reshape(-1, 3)
    keys = rows[:, 0] << 45 | rows[:, 1]
    names = pieces.columns

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                place, length = f.pop("_place").to_numpy(np.int64), f["length"].to_numpy(np.int64)
                at = np.searchsorted(where[:, 0], length << 33 | place >> 33)
                rank = place - where[at, 1] + where[at, 2]
                row = rows[np.searchsorted(keys, length << 45 | rank, side="right") - 1]
                yield f.assign(sequence_id=row[:, 3] + rank - row[:, 1], offset=row[:, 4])

    kinds = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in names)
    return ranged.mapInPandas(tidy("packing", assign), f"{kinds}, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of 2048 tokens."""
    return pack(pieces_of(table(spark, sf_dir, "documents")))
