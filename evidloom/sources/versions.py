"""Versions of a set of tables: all are written under a run's own folder, then published together by one manifest.

A manifest (manifests/<version>.json) names the folders that each table has in its version. Readers follow the last one, so a run that dies
before its manifest leaves the state before it, and its folder, which vacuum() deletes. A manifest is published only if its
number is new: two runs that start from one version can't both succeed, the second gets Conflict (compare and set).

A table with a key is laid out in buckets of its key's hash. replace() deletes the rows of some keys, and adds rows of them, by writing the
buckets that these keys are in; the folders of the other buckets are named again, not written.

The folder must be on a file system whose rename is atomic and doesn't overwrite (HDFS and the like), or a local one that all processes share.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


class Conflict(RuntimeError):
    """Another run has published since the version that this one started from."""


class Store:
    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS):
        self.spark, self.base, self.buckets = spark, base.rstrip("/"), buckets

    # Files.

    def _path(self, relative: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{relative}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, relative: str) -> list[str]:
        path, fs = self._path(relative)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _publish(self, version: int, text: str) -> None:
        name, temporary = f"manifests/{version:012d}.json", f"staged/{uuid.uuid4().hex}.json"
        for folder in ("manifests", "staged"):
            path, fs = self._path(folder)
            fs.mkdirs(path)
        path, fs = self._path(temporary)
        out = fs.create(path, False)
        out.write(bytearray(text.encode()))
        out.close()
        target, _ = self._path(name)
        if path.toUri().getScheme() in (None, "file"):
            # A local rename would overwrite; a link to a name that exists fails.
            local = lambda p: p.toUri().getPath()
            try:
                os.link(local(path), local(target))
            except FileExistsError as e:
                raise Conflict(f"version {version} has been published by another run") from e
            finally:
                os.unlink(local(path))
            return
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(path, target, none)
        except Exception as e:
            fs.delete(path, False)
            if fs.exists(target):
                raise Conflict(f"version {version} has been published by another run") from e
            raise

    # Reading.

    def version(self) -> int:
        """The last version's number; 0 if there is none."""
        return max((int(n.split(".")[0]) for n in self._names("manifests")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "run": None, "tables": {}, "notes": {}}
        path, fs = self._path(f"manifests/{version:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table of a version; null if it has none of this name."""
        table = self.manifest(version)["tables"].get(name)
        return None if table is None else self._rows(table, [f for _, f in table["parts"]])

    def _rows(self, table: dict, folders: list[str]) -> DataFrame:
        empty = self.spark.createDataFrame([], table["schema"])
        return self.spark.read.schema(table["schema"]).parquet(*[f"{self.base}/{f}" for f in folders]) if folders else empty

    # Writing.

    def begin(self) -> Change:
        """A change that starts from the last version."""
        return Change(self, self.manifest())

    def vacuum(self) -> int:
        """Delete the data of runs that no manifest names; their number. Not while another run is at work."""
        named = {f.split("/")[1] for v in self._names("manifests") for t in self.manifest(int(v.split(".")[0]))["tables"].values() for _, f in t["parts"]}
        lost = [r for r in self._names("data") if r not in named]
        for r in lost:
            path, fs = self._path(f"data/{r}")
            fs.delete(path, True)
        return len(lost)


class Change:
    """Tables staged under one run, from the version that it started from on."""

    def __init__(self, store: Store, manifest: dict):
        self.store, self.start, self.run = store, manifest["version"], uuid.uuid4().hex
        self.tables, self.notes = dict(manifest["tables"]), dict(manifest["notes"])

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.store.buckets)).cast("int")

    def _stage(self, name: str, df: DataFrame, key: str | None) -> list[list]:
        """Write rows; the parts [bucket, folder] that they are in."""
        folder = f"data/{self.run}/{name}-{uuid.uuid4().hex[:8]}"
        if key is None:
            df.write.parquet(f"{self.store.base}/{folder}")
            return [[None, folder]]
        df.withColumn("__bucket", self._bucket(key)).write.partitionBy("__bucket").parquet(f"{self.store.base}/{folder}")
        return [[int(n.partition("=")[2]), f"{folder}/{n}"] for n in self.store._names(folder) if n.startswith("__bucket=")]

    def put(self, name: str, df: DataFrame, key: str | None = None) -> None:
        """The table is these rows."""
        self.tables[name] = {"schema": _ddl(df), "key": key, "parts": self._stage(name, df, key)}

    def split(self, df: DataFrame, by: str, names: dict) -> None:
        """Rows written once, into the table that names gives for their value of a column; rows of other values are in none."""
        folder = f"data/{self.run}/split-{uuid.uuid4().hex[:8]}"
        df.write.partitionBy(by).parquet(f"{self.store.base}/{folder}")
        there, schema = set(self.store._names(folder)), _ddl(df.drop(by))
        for value, name in names.items():
            part = f"{by}={value}"
            self.tables[name] = {"schema": schema, "key": None, "parts": [[None, f"{folder}/{part}"]] if part in there else []}

    def add(self, name: str, df: DataFrame) -> None:
        """The table has these rows, too."""
        old = self.tables.get(name)
        if old is None:
            return self.put(name, df)
        self.tables[name] = old | {"parts": old["parts"] + self._stage(name, df, old["key"])}
        return None

    def replace(self, name: str, keys: DataFrame, rows: DataFrame | None = None) -> list[int]:
        """Of a table with a key: rows of these keys (a column of that name) go, `rows` come; the buckets that were written. Only they are read."""
        table = self.tables[name]
        key = table["key"]
        keys = keys.select(key).distinct()
        if rows is not None:
            keys = keys.unionByName(rows.select(key)).distinct()
        hit = sorted(r["b"] for r in keys.select(self._bucket(key).alias("b")).distinct().collect())
        old = self.store._rows(table, [f for b, f in table["parts"] if b in hit])
        kept = old.join(keys.select(F.col(key).alias("__k")), F.col(key).eqNullSafe(F.col("__k")), "left_anti")
        new = kept if rows is None else kept.unionByName(rows.select(*old.columns))
        self.tables[name] = table | {"parts": [p for p in table["parts"] if p[0] not in hit] + self._stage(name, new, key)}
        return hit

    def commit(self, **notes) -> int:
        """Publish all tables; the new version. Conflict if another run has published since."""
        version = self.start + 1
        self.store._publish(version, json.dumps({"version": version, "run": self.run, "tables": self.tables, "notes": self.notes | notes}))
        return version


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
