"""Helpers of the training-data operators: shared storage, Arrow batches, blocks of keys."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import tempfile
import threading
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word: anything between ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch handed to Python; long texts make small batches cheap to hold.
ARROW_ROWS = 1000
#: Bytes of a row group of written tables: a task holds one in memory while it writes.
ROW_GROUP = 16 << 20


#: Arrays from this size on get pages of their own, which go back to the system when the array goes; smaller ones are
#: reused, as fresh pages for every temporary array cost more than the work on it. What is free beyond KEPT goes back too.
OWN_PAGES, KEPT = 16 << 20, 64 << 20
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD = -1, -3

_libc = None
with contextlib.suppress(OSError, AttributeError):  # another C library: memory is then given back less eagerly
    _libc = ctypes.CDLL("libc.so.6")
    _libc.mallopt(M_MMAP_THRESHOLD, OWN_PAGES)
    _libc.mallopt(M_TRIM_THRESHOLD, KEPT)

_clearers: dict[str, Callable[[], None]] = {}
_user: list[str] = [""]


def keeps(user: str, clear: Callable[[], None]) -> None:
    """Says how the tables that an operator keeps in a Python worker are emptied."""
    _clearers[user] = clear


def working(user: str) -> None:
    """Called when a task of an operator starts: workers outlive stages, so what other operators keep in this one goes."""
    if _user[0] != user:
        for other, clear in _clearers.items():
            if other != user:
                clear()
        _user[0] = user
        give_back()


def give_back() -> None:
    """Hands unused memory of this worker back to the system."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def tidy(user: str, f: Callable) -> Callable:
    """f, run by a task of an operator, leaving a worker without what other operators keep and what f took: idle workers
    hold their memory. f takes and yields batches, or takes groups and returns one."""
    if inspect.isgeneratorfunction(f):

        def run(batches: Iterator) -> Iterator:
            working(user)
            yield from f(batches)
            give_back()

        return run
    names = list(inspect.signature(f).parameters)

    def one(group):
        working(user)
        out = f(group)
        give_back()
        return out

    def two(left, right):
        working(user)
        out = f(left, right)
        give_back()
        return out

    return one if len(names) == 1 else two


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where a local session names none, a temporary one of this machine; on a
    cluster executors wouldn't see each other's files there, so it is refused."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: driver and executors share no folder")
        at = "file://" + tempfile.mkdtemp(prefix="glyphwood-")
        sc.setCheckpointDir(at)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds the Arrow batches of this session, so that a worker holds few long texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as compressed Parquet in the shared folder and read back: cuts lineage and fixes partitions."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    if (held := getattr(_stage, "held", None)) is not None:
        held.append(at)
    return out


def forget(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes what written() has written, once nothing reads it any more."""
    for at in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(at if isinstance(at, str) else at.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_stage = threading.local()


def staged(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage of a pipeline: when it starts, the result of the stage before (of this thread) is written, so the tables that
    that one was made from go."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(spark, *getattr(_stage, "left", []))
        _stage.held, _stage.left = [], []
        try:
            return f(spark, docs, sf_dir)
        finally:
            _stage.left, _stage.held = _stage.held, None

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column: sizes shards by the data."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def map_arrow(df: DataFrame, make: Callable[[dict[str, list]], dict[str, list]], schema: str, user: str = "") -> DataFrame:
    """df.mapInArrow with columns as Python lists in and out. user: the operator that `make` keeps tables for."""
    small_batches(df.sparkSession)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = make({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns, strict=True)})
                yield pa.RecordBatch.from_pydict(out, schema=kinds)

    return df.mapInArrow(tidy(user, run), schema)


# ---- blocks of sorted 64-bit keys -------------------------------------------------------------------------------


def pack(a: np.ndarray) -> bytes:
    """An integer array as compressed byte planes; planes of small numbers are nearly free."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(a.dtype.char.encode() + np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    kind = np.dtype(raw[:1].decode())
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys as packed differences."""
    return pack(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


# ---- words ------------------------------------------------------------------------------------------------------

#: Bytes of text whose words are hashed together.
WORD_SLICE = 400_000
_rng = np.random.Generator(np.random.PCG64(40961))
_LETTERS = _rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_BASE = int(_rng.integers(0, 1 << 63)) * 2 + 1
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """_BASE ** i and _BASE ** -i, i < n, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    if n <= WORD_SLICE < len(_powers[0]):  # a longer word has been here
        _powers[:] = [p[:WORD_SLICE].copy() for p in _powers]
    return _powers


def hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-cased bytes start, and their 64-bit hashes: sums of letters times powers by place, from
    sums over the whole, so that no word is looked at by itself."""
    data = np.frombuffer(raw, np.uint8)
    power, inverse = powers(len(data) + 1)
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    upto = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * power[: len(data)], out=upto[1:])
    return starts, mix((upto[ends] - upto[starts]) * inverse[starts])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) of all texts, and how many words each text has."""
    ids: list[np.ndarray] = []
    sizes = np.zeros(len(texts), np.int64)
    k = 0
    while k < len(texts):
        last, held = k, 0
        while last < len(texts) and (last == k or held + len(texts[last]) < WORD_SLICE):
            held += len(texts[last]) + 1
            last += 1
        if last == k + 1 and held > WORD_SLICE:  # a long text goes in slices that end with white space
            raw, at = texts[k].lower(), 0
            while at < len(raw):
                end = at + WORD_SLICE
                while end < len(raw) and not _BLANK[raw[end]]:
                    end += 1
                found = hashed(raw[at:end])[1]
                ids.append(found)
                sizes[k] += len(found)
                at = end
        else:
            starts, found = hashed(b"\n".join(texts[k:last]).lower())
            bounds = np.cumsum([len(t) + 1 for t in texts[k:last]])
            sizes[k:last] = np.diff(np.searchsorted(starts, bounds), prepend=0)
            ids.append(found)
        k = last
    return np.concatenate(ids) if ids else np.zeros(0, np.uint64), sizes


def shard_cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where sorted keys are cut into `shards` equal ranges of the key space; shards + 1 positions."""
    step = (1 << 64) // shards
    bounds = np.array([min(i * step, (1 << 64) - 1) for i in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]).astype(np.int64)


def pack_docs(ids: list, texts: list[bytes]) -> bytes:
    """Documents as one compressed blob. Blobs are written and shuffled, so they are compressed well."""
    known = np.array([i is not None for i in ids], np.uint8)
    numbers = np.array([i if i is not None else 0 for i in ids], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    head = np.array([len(ids)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=7).compress(head + known.tobytes() + numbers.tobytes() + sizes.tobytes() + b"".join(texts))


def unpack_docs(data: bytes) -> tuple[list, np.ndarray, bytes]:
    """ids, sizes and the texts one after the other."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    known, at = np.frombuffer(raw, np.uint8, n, 8), 8 + n
    numbers = np.frombuffer(raw[at : at + 8 * n], np.int64)
    sizes = np.frombuffer(raw[at + 8 * n : at + 16 * n], np.int64)
    return [int(i) if k else None for i, k in zip(numbers, known, strict=True)], sizes, raw[at + 16 * n :]


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[bytes]]]:
    """Groups documents (columns doc_id, text) into blocks of about `most` bytes; one long document is a block of its own."""
    ids: list = []
    texts: list[bytes] = []
    held = 0
    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            raw = (t or "").encode()
            if ids and held + len(raw) > most:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(raw)
            held += len(raw)
    if ids:
        yield ids, texts


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
