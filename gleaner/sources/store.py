"""Index tables on disk: versioned snapshots of Parquet files, a manifest that is swapped at once, one writer."""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import SCHEMAS, Index, empty_index

SCHEMA_VERSION = 2
#: Seconds for which a writer holds a store without a commit.
HELD = 6 * 3600.0


class NewerSchemaError(RuntimeError):
    """The store was written by a later version than this one reads."""


class BusyError(RuntimeError):
    """Another writer holds the store."""


#: By the version they start from, what leads to the next one: manifest to manifest.
MIGRATIONS: dict[int, Callable[[dict], dict]] = {
    1: lambda m: {**m, "tables": {}, "version": 2},  # the old layout isn't carried over: the next index run fills the tables
}


class Store:
    """A folder of any file system that Spark reads, with ``manifest.json`` naming the snapshot of each table.

    A write goes to a new folder; then the manifest is replaced by a rename and the
    one before stays as ``manifest.previous.json``. A failed write leaves the last
    state in place. Old snapshots are dropped by `vacuum`.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(conf)
        self._held: tuple[str, float] | None = None

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _read(self, name: str) -> dict | None:
        p = self._path(name)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, name: str, content: dict, overwrite: bool = True) -> None:
        out = self._fs.create(self._path(name), overwrite)
        try:
            out.write(bytearray(json.dumps(content, ensure_ascii=False).encode()))
        finally:
            out.close()

    def manifest(self) -> dict:
        """The present state; the previous one if the present file is gone; an empty one, with what was
        unreadable moved aside, if neither can be read."""
        for name in ("manifest.json", "manifest.previous.json"):
            try:
                m = self._read(name)
            except Exception:  # noqa: BLE001 - whatever is wrong with the file, it is kept aside
                self._fs.rename(self._path(name), self._path(f"{name}.corrupt-{uuid.uuid4().hex[:8]}"))
                continue
            if m is not None:
                return self._migrated(m)
        return {"version": SCHEMA_VERSION, "tables": {}, "meta": {}}

    @staticmethod
    def _migrated(m: dict) -> dict:
        version = m.get("version", 0)
        if version > SCHEMA_VERSION:
            raise NewerSchemaError(f"schema {version} is newer than {SCHEMA_VERSION}")
        while 0 < version < SCHEMA_VERSION:
            if version not in MIGRATIONS:
                raise RuntimeError(f"no migration from schema {version}")
            m = MIGRATIONS[version](m)
            version = m["version"]
        return {**m, "version": SCHEMA_VERSION, "meta": m.get("meta", {}), "tables": m.get("tables", {})}

    def _commit(self, m: dict) -> None:
        if self._held:
            me, seconds = self._held
            if (self._owner() or {}).get("owner") != me:
                raise BusyError(f"{self.folder} was taken over by another writer")
            self._write("lock", {"owner": me, "until": time.time() + seconds})
        new, main, previous = f"manifest.{uuid.uuid4().hex[:8]}.json", "manifest.json", "manifest.previous.json"
        self._write(new, m)
        if self._fs.exists(self._path(main)):
            self._fs.delete(self._path(previous), False)
            self._fs.rename(self._path(main), self._path(previous))
        self._fs.rename(self._path(new), self._path(main))

    @contextmanager
    def writing(self, seconds: float = HELD):
        """Holds the store for one writer; a second one is refused.

        The lock names its owner and the time until which it holds; each commit moves
        that on. One that was left behind by a writer that is gone is taken over after it.
        """
        me = f"{socket.gethostname()}-{os.getpid()}-{uuid.uuid4().hex[:8]}"
        if not self._lock(me, seconds):
            raise BusyError(f"{self.folder} is being written")
        self._held = me, seconds
        try:
            yield self
        finally:
            self._held = None
            if (self._owner() or {}).get("owner") == me:
                self._fs.delete(self._path("lock"), False)

    def _owner(self) -> dict | None:
        try:
            return self._read("lock")
        except Exception:  # noqa: BLE001 - another writer may be writing it just now
            return {}

    def _lock(self, me: str, seconds: float) -> bool:
        for _ in range(2):
            try:
                self._write("lock", {"owner": me, "until": time.time() + seconds}, overwrite=False)
                return True
            except Exception:  # noqa: BLE001 - the file exists
                held = self._owner()
                if held is None:
                    continue
                if held.get("until", float("inf")) >= time.time():
                    return False
                # whoever moves the old lock aside may try again; for all others it is gone
                aside = self._path(f"lock.{uuid.uuid4().hex[:8]}")
                if self._fs.rename(self._path("lock"), aside):
                    self._fs.delete(aside, False)
        return False

    def save(self, tables: dict[str, DataFrame], **meta: Any) -> None:
        """New snapshots of some tables and new values in the metadata, all visible at once."""
        m = self.manifest()
        written = {}
        for name, df in tables.items():
            written[name] = self._snapshot(name, df)
        self._commit({**m, "tables": {**m["tables"], **written}, "meta": {**m["meta"], **meta}})

    def append(self, name: str, df: DataFrame) -> None:
        """More rows for a table, visible at once; what it has stays where it is."""
        m = self.manifest()
        self._commit({**m, "tables": {**m["tables"], name: [*self._folders(m, name), self._snapshot(name, df)]}})

    def _snapshot(self, name: str, df: DataFrame) -> str:
        folder = f"{name}-{uuid.uuid4().hex}"
        # for skipping row groups by term; a term that all chunks hold is split by chunk
        rows = df.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id") if name == "postings" else df
        rows.write.parquet(f"{self.folder}/{folder}")
        return folder

    @staticmethod
    def _folders(m: dict, name: str) -> list[str]:
        at = m["tables"].get(name)
        return [] if at is None else at if isinstance(at, list) else [at]

    def table(self, name: str) -> DataFrame:
        at = self._folders(self.manifest(), name)
        if not at:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.parquet(*(f"{self.folder}/{a}" for a in at))

    def save_index(self, index: Index, **meta: Any) -> None:
        self.save(index.tables(), **meta)

    def load_index(self) -> Index:
        found = self.manifest()["tables"]
        return replace(empty_index(self.spark), **{n: self.table(n) for n in SCHEMAS if n in found})

    def meta(self, key: str) -> Any:
        return self.manifest()["meta"].get(key)

    def set_meta(self, key: str, value: Any) -> None:
        self.save({}, **{key: value})

    def meta_frame(self) -> DataFrame:
        return self.spark.createDataFrame([(k, str(v)) for k, v in self.manifest()["meta"].items()], "key string, value string")

    def vacuum(self) -> None:
        """Delete snapshots that neither the present nor the previous manifest names."""
        states = [{"tables": {}, **(self._read(n) or {})} for n in ("manifest.json", "manifest.previous.json")]
        kept = {folder for m in states for name in m["tables"] for folder in self._folders(m, name)}
        for status in self._fs.listStatus(self._path("")):
            if status.isDirectory() and status.getPath().getName() not in kept:
                self._fs.delete(status.getPath(), True)


def vectors_from_bytes(df: DataFrame, column: str = "vector") -> DataFrame:
    """Binary little-endian float32 as array<float>."""

    def unpack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return df.withColumn(column, F.pandas_udf(unpack, "array<float>", F.PandasUDFType.SCALAR_ITER)(column))


def vectors_to_bytes(df: DataFrame, column: str = "vector") -> DataFrame:
    """array<float> as binary little-endian float32."""

    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return df.withColumn(column, F.pandas_udf(pack, "binary", F.PandasUDFType.SCALAR_ITER)(column))
