"""A stored table that changes by key: copy-on-write of the buckets touched, one manifest a version, one atomic rename.

Rows lie in hash buckets of their key, sorted by it, in Parquet with a bloom
filter on it.  A change writes the buckets that it touches anew, beside the old
ones, and then a manifest that names the buckets of the new version; readers see
either the old manifest or the new one.  A write that fails half-way leaves files
that no manifest names.  A lookup of keys reads their buckets only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer was first: read the new version and change that."""


@dataclass
class Manifest:
    """version, schema, key columns, and the folder of each bucket that has rows."""

    version: int
    schema: str
    keys: list[str]
    buckets: int
    folders: dict[str, str]


class StoredTable:
    """A table in a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest-{version:012d}.json"

    def versions(self) -> list[int]:
        """All versions, oldest first."""
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.versions()[-1] if version is None else version
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream := self._fs.open(self._path(self._manifest(version))), "UTF-8")
        stream.close()
        return Manifest(**json.loads(text))

    def _commit(self, m: Manifest) -> None:
        """Write a manifest under a name of its own, then give it its version's name, which only one writer can."""
        draft = self._path(f"{self.path}/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(m.__dict__).encode()))
        out.close()
        target = self._path(self._manifest(m.version))
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {m.version} of {self.path} is there already")

    @staticmethod
    def _bucket(keys: Sequence[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, keys: Sequence[str], buckets: int) -> dict[str, str]:
        """The folders of the buckets that rows fall into; one file for each, sorted by key."""
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        out = rows.withColumn(_BUCKET, self._bucket(keys, buckets)).repartition(_BUCKET).sortWithinPartitions(_BUCKET, *keys).write.partitionBy(_BUCKET)
        for k in keys:
            out = out.option(f"parquet.bloom.filter.enabled#{k}", "true").option(f"parquet.bloom.filter.expected.ndv#{k}", "1000000")
        out.parquet(folder)
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(folder))]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith(f"{_BUCKET}=")}

    def create(self, rows: DataFrame, keys: Sequence[str], *, buckets: int = 16) -> Manifest:
        """The first version; of rows with equal keys the largest stays."""
        if self.versions():
            raise Conflict(f"{self.path} has a table")
        self._fs.mkdirs(self._path(self.path))
        m = Manifest(1, rows.schema.json(), list(keys), buckets, self._write(_largest(rows, keys), keys, buckets))
        self._commit(m)
        return m

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the last one by default."""
        m = self.manifest(version)
        return self._read(m, m.folders)

    def _read(self, m: Manifest, folders: dict[str, str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(m.schema))
        return self.spark.read.schema(schema).parquet(*folders.values()) if folders else self.spark.createDataFrame([], schema)

    def lookup(self, *keys: tuple) -> DataFrame:
        """The rows of some keys, from their buckets alone; a bloom filter spares row groups in these."""
        m = self.manifest()
        wanted = self.spark.createDataFrame(list(keys), StructType([StructType.fromJson(json.loads(m.schema))[k] for k in m.keys])) if keys else None
        if wanted is None:
            return self._read(m, {})
        # as many rows as the caller gave
        places = {str(r[0]) for r in wanted.select(self._bucket(m.keys, m.buckets)).distinct().collect()}
        rows = self._read(m, {b: f for b, f in m.folders.items() if b in places})
        hit = F.lit(False)
        for key in keys:
            one = F.lit(True)
            for name, value in zip(m.keys, key, strict=True):
                one = one & (F.col(name) == F.lit(value) if value is not None else F.col(name).isNull())
            hit = hit | one
        return rows.where(hit)

    def _change(self, touched: DataFrame, change) -> Manifest:
        """A new version in which ``change`` of the old rows takes the place of the buckets that touched rows fall into."""
        m = self.manifest()
        places = {str(r[0]) for r in touched.select(self._bucket(m.keys, m.buckets)).distinct().collect()}  # at most as many as buckets
        old = self._read(m, {b: f for b, f in m.folders.items() if b in places})
        new = self._write(change(old), m.keys, m.buckets)
        kept = {b: f for b, f in m.folders.items() if b not in places}
        after = Manifest(m.version + 1, m.schema, m.keys, m.buckets, kept | new)
        self._commit(after)
        return after

    def upsert(self, rows: DataFrame) -> Manifest:
        """Rows by key in place of old ones, or beside them; of equal keys among the new ones the largest stays."""
        keys = self.manifest().keys
        new = _largest(rows, keys)

        def change(old: DataFrame) -> DataFrame:
            same = [old[k].eqNullSafe(new[k]) for k in keys]
            return old.join(new, same, "left_anti").unionByName(new.select(*old.columns))

        return self._change(new, change)

    def delete(self, keys: DataFrame) -> Manifest:
        """Without the rows of some keys."""
        names = self.manifest().keys
        return self._change(keys, lambda old: old.join(keys, [old[k].eqNullSafe(keys[k]) for k in names], "left_anti"))

    def insert_new(self, rows: DataFrame) -> Manifest:
        """Only rows whose key the table doesn't have."""
        keys = self.manifest().keys
        new = _largest(rows, keys)

        def change(old: DataFrame) -> DataFrame:
            return old.unionByName(new.join(old, [new[k].eqNullSafe(old[k]) for k in keys], "left_anti").select(*old.columns))

        return self._change(new, change)

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the last ``keep`` versions, and the folders that no version left names."""
        versions = self.versions()
        for v in versions[:-keep]:
            self._fs.delete(self._path(self._manifest(v)), False)
        named = {f.rsplit("/", 1)[0] for v in versions[-keep:] for f in self.manifest(v).folders.values()}
        for x in self._fs.listStatus(self._path(self.path)):
            name = x.getPath().getName()
            if name.startswith("data-") and f"{self.path}/{name}" not in named:
                self._fs.delete(x.getPath(), True)


def _largest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*rows.columns)
