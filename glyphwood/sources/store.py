"""An index as versioned snapshots of Parquet tables and one pointer to the current one.

Tables are cut into buckets by a hash of their key. A snapshot is a manifest that names, for each bucket of each table,
the snapshot whose run wrote it: a publication writes the buckets that it touches and takes the others over as they are.
It is written, read again and checked, and only then pointed at, by an atomic rename. Readers see one snapshot or the
other; a failed run leaves the pointer where it was; older snapshots are the backups. All files are reached through
Spark's file systems, so an index can live wherever Spark can write.
"""

from __future__ import annotations

import datetime
import json
import secrets
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphwood.config import EngineError

#: The tables of an index and the key that their buckets go by.
TABLES = {"docs": "file", "nodes": "file", "leaves": "file", "aliases": "from_file", "cross_refs": "file", "postings": "file"}
#: Buckets of a new index; more of them for larger ones, so that a publication has less to write again.
BUCKETS = 8
BUCKET = "_bucket"


@dataclass
class Change:
    """What a publication does to a table: rows to add, and keys whose rows go before that (one column, named as the key)."""

    rows: DataFrame | None
    gone: DataFrame | None = None


def run_id() -> str:
    """Time and six hexadecimal digits."""
    return f"{datetime.datetime.now(datetime.UTC):%Y%m%dT%H%M%S}-{secrets.token_hex(3)}"


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # ---- small files ----------------------------------------------------------------------------------------------

    def _read(self, name: str) -> str | None:
        at = self._path(f"{self.root}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """Written beside and renamed over."""
        folder, _, last = name.rpartition("/")
        new, at = self._path(f"{self.root}/{folder}/.{last}.{secrets.token_hex(4)}"), self._path(f"{self.root}/{name}")
        stream = self._fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._fs.makeQualified(new), self._fs.makeQualified(at), how)

    # ---- snapshots --------------------------------------------------------------------------------------------------

    def current(self) -> str | None:
        raw = self._read("CURRENT")
        if raw is None:
            return None
        try:
            return json.loads(raw)["snapshot"]
        except (ValueError, KeyError, TypeError):
            raise EngineError("bad_dsi", "the pointer to the current snapshot can't be read") from None

    def manifest(self, snapshot: str | None = None) -> dict[str, Any]:
        """buckets (how many), and for each table its schema and where each bucket lies."""
        at = snapshot or self.current()
        if at is None:
            raise EngineError("no_dsi", f"there is no index in {self.root}")
        raw = self._read(f"snapshots/{at}/manifest.json")
        if raw is None:
            raise EngineError("bad_dsi", f"snapshot {at} has no manifest")
        return json.loads(raw)

    def table(self, name: str, snapshot: str | None = None) -> DataFrame:
        held = self.manifest(snapshot)["tables"].get(name)
        if held is None:
            raise EngineError("no_table", name)
        return self._read_buckets(name, held, held["at"])

    def _read_buckets(self, name: str, held: Mapping[str, Any], at: Mapping[str, str]) -> DataFrame:
        schema = StructType.fromJson(held["schema"])
        paths = [f"{self.root}/snapshots/{where}/{name}/{BUCKET}={b}" for b, where in sorted(at.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def has(self, name: str) -> bool:
        return self.current() is not None and name in self.manifest()["tables"]

    def bucket(self, key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _changed(self, name: str, change: Change, folder: str, snapshot: str, held: Mapping[str, Any] | None, buckets: int) -> dict[str, Any] | None:
        """The table's entry in the manifest after a change; only buckets with keys that come or go are written."""
        key = TABLES[name]
        rows, gone = change.rows, change.gone
        keys = [df.select(key) for df in (rows, gone) if df is not None]
        if not keys:
            return dict(held) if held else None
        every = keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])
        touched = sorted(r[0] for r in every.select(self.bucket(key, buckets).alias(BUCKET)).distinct().collect())  # as many as there are buckets
        old = {b: at for b, at in (held or {"at": {}})["at"].items()}
        if held:
            before = self._read_buckets(name, held, {b: at for b, at in old.items() if int(b) in touched})
            if gone is not None:
                before = before.join(gone.select(key).distinct(), key, "left_anti").select(before.columns)
            rows = before if rows is None else before.unionByName(rows, allowMissingColumns=True)
        if rows is None:
            return None
        out = rows.withColumn(BUCKET, self.bucket(key, buckets)).hint("rebalance", BUCKET)
        out.write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{folder}/{name}")
        at = {b: where for b, where in old.items() if int(b) not in touched}
        for b in touched:
            if self._fs.exists(self._path(f"{folder}/{name}/{BUCKET}={b}")):
                at[str(b)] = snapshot
        return {"schema": json.loads(rows.schema.json()), "at": at}

    def publish(self, tables: Mapping[str, Change | DataFrame], record: Mapping[str, Any], verify: Callable[[Store, str], list[str]] | None = None) -> str:
        """Makes a snapshot with changed tables, reads them again, and makes it the current one unless `verify` objects.

        A table given as a DataFrame is replaced. Tables that aren't given, and buckets that no key of a change is in, are taken over from the current snapshot.
        """
        name, before = run_id(), self.current()
        folder = f"{self.root}/snapshots/{name}"
        try:
            old = self.manifest(before) if before else {"buckets": self.buckets, "tables": {}}
            entries = dict(old["tables"])
            for key, change in tables.items():
                whole = isinstance(change, DataFrame)
                entry = self._changed(key, Change(change) if whole else change, folder, name, None if whole else old["tables"].get(key), old["buckets"])
                if entry is not None:
                    entries[key] = entry
            self._write(f"snapshots/{name}/manifest.json", json.dumps({"buckets": old["buckets"], "tables": entries}))
            problems = verify(self, name) if verify else []
            for key in tables:
                if key in entries:
                    self.table(key, name).limit(1).count()
            if problems:
                raise EngineError("failed_publish", "; ".join(problems[:10]))
            self._write("CURRENT", json.dumps({"snapshot": name}))
        except Exception:
            self._fs.delete(self._path(folder), True)
            self._record(record, name, before, rolled_back=True)
            raise
        self._record(record, name, before, rolled_back=False)
        return name

    # ---- staging ----------------------------------------------------------------------------------------------------

    def stager(self) -> Stager:
        return Stager(self)

    def rollback(self, snapshot: str) -> None:
        """Points at an older snapshot."""
        if not self._fs.exists(self._path(f"{self.root}/snapshots/{snapshot}")):
            raise EngineError("no_snapshot", snapshot)
        self._write("CURRENT", json.dumps({"snapshot": snapshot}))

    def _record(self, record: Mapping[str, Any], name: str, before: str | None, rolled_back: bool) -> None:
        now = datetime.datetime.now(datetime.UTC).isoformat()
        self._write(f"run-{name}.json", json.dumps({"timestamp": now, "snapshot": name, "backup": before, "rolled_back": rolled_back, **record}))


class Stager:
    """Intermediate tables of one run, written once and read again by all that builds on them; gone when the run ends."""

    def __init__(self, store: Store) -> None:
        self.store, self.folder = store, f"{store.root}/staging/{run_id()}"

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        at = f"{self.folder}/{name}-{secrets.token_hex(4)}"
        df.write.option("compression", "zstd").parquet(at)
        return df.sparkSession.read.schema(df.schema).parquet(at)

    def __enter__(self) -> Stager:
        return self

    def __exit__(self, *_: object) -> None:
        self.store._fs.delete(self.store._path(self.folder), True)
