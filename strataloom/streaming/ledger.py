"""Stored tables that a stream of batches changes exactly once.

Tables are cut into buckets by a hash of their keys. A batch is staged, the buckets that it touches are written anew beside the old
ones, and a manifest that names the batch and all buckets' folders comes into place by one rename: before it nothing has
changed, after it everything has. A batch whose number the last manifest has passed is a replay and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataloom.operators.shuffles import delete

#: Buckets of a table: the manifest, and what a batch asks the driver to know, is as long.
BUCKETS = 64


@dataclass
class Manifest:
    """number: of the manifest; batch: the last batch applied; folders: of each table's buckets."""

    number: int = 0
    batch: int = -1
    folders: dict[str, dict[str, str]] = field(default_factory=dict)


class Store:
    """Tables under `path`: name to (schema, keys). Rows with the same keys are in one bucket; a null key is a value."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, list[str]]], buckets: int = BUCKETS):
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), tables, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- the manifest

    def manifest(self) -> Manifest:
        at = self._path(f"{self.path}/manifest")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return Manifest()
        stream = self._fs.open(self._path(f"{self.path}/manifest/{names[-1]}"))
        try:
            return Manifest(**json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _swap(self, new: Manifest) -> None:
        at, staged = (self._path(f"{self.path}/manifest/{n}") for n in (f"{new.number:012}.json", f".{uuid.uuid4().hex}"))
        out = self._fs.create(staged, False)
        try:
            out.write(bytearray(json.dumps(vars(new)).encode()))
        finally:
            out.close()
        if self._fs.exists(at) or not self._fs.rename(staged, at):
            self._fs.delete(staged, False)
            raise RuntimeError(f"another writer has changed {self.path}")

    # -- tables

    def _bucket(self, name: str):
        return F.pmod(F.xxhash64(*self.tables[name][1]), F.lit(self.buckets)).cast("int")

    def read(self, name: str, buckets: list[int] | None = None, of: Manifest | None = None) -> DataFrame:
        """A table as of the manifest (the last one), whole or some buckets of it."""
        schema, _ = self.tables[name]
        folders = (of or self.manifest()).folders.get(name, {})
        at = [f for b, f in sorted(folders.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in at]) if at else self.spark.createDataFrame([], schema)

    def update(self, batch: int, changes: dict[str, DataFrame], merge: Callable[[dict[str, DataFrame], dict[str, DataFrame]], dict[str, DataFrame]]) -> bool:
        """Apply a batch; False where it has been applied before.

        changes: rows by name, each with the keys of the tables it concerns. merge gets the stored rows of the buckets that
        the changes touch, and the changes, and returns what these buckets hold from now on; a function in place of a table is
        called when those before it have been written. Changes are staged first, so a stream that can't be read twice
        alike is read once.
        """
        last = self.manifest()
        if batch <= last.batch:
            return False
        attempt = f"{batch:012}-{uuid.uuid4().hex}"
        staged, touched = {}, {}
        for name, rows in changes.items():
            at = f"{self.path}/staging/{attempt}/{name}"
            rows.write.parquet(at)
            staged[name] = self.spark.read.schema(rows.schema).parquet(at)
        for table, (_, keys) in self.tables.items():
            of = [staged[n].select(self._bucket(table).alias("b")) for n in staged if set(keys) <= set(staged[n].columns)]
            touched[table] = sorted({r["b"] for df in of for r in df.distinct().collect()})  # BUCKETS at most
        old = {table: self.read(table, touched[table], last) for table in self.tables}
        new = merge(old, staged)
        folders = {t: dict(b) for t, b in last.folders.items()}
        for table, rows in new.items():
            rows = rows() if callable(rows) else rows
            at = f"data/{attempt}/{table}"
            columns = self.spark.createDataFrame([], self.tables[table][0]).columns
            rows.select(*columns, self._bucket(table).alias("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/{at}")
            found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{at}"))]
            written = {int(n.split("=")[1]) for n in found if n.startswith("bucket=")}
            if not written <= set(touched[table]):
                raise ValueError(f"{table}: merge returned rows of buckets that the batch doesn't touch")
            own = {b: f for b, f in folders.get(table, {}).items() if int(b) not in touched[table]}
            folders[table] = own | {str(b): f"{at}/bucket={b}" for b in sorted(written)}
        self._swap(Manifest(last.number + 1, batch, folders))
        delete(self.spark, f"{self.path}/staging/{attempt}")
        return True

    def sweep(self) -> int:
        """Delete the folders of data and staging that the last manifest doesn't name; how many. Not while a batch is applied."""
        last = self.manifest()
        live = {f.split("/")[1] for b in last.folders.values() for f in b.values()}
        gone = 0
        for top in ("data", "staging"):
            at = self._path(f"{self.path}/{top}")
            for s in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if top == "staging" or s.getPath().getName() not in live:
                    gone += self._fs.delete(s.getPath(), True)
        return gone


def into(stream: DataFrame, store: Store, changes: Callable[[DataFrame], dict[str, DataFrame]], merge: Callable, checkpoint: str, **trigger) -> StreamingQuery:
    """Run a stream into a store: each micro-batch once, however often it is tried."""

    def batch(df: DataFrame, n: int) -> None:
        store.update(n, changes(df), merge)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(**(trigger or {"availableNow": True})).start()
