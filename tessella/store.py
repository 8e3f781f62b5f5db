"""A store of Parquet tables with versions: whatever changes is written beside what is there, and one small manifest,
renamed into place, says what counts. A failure before that leaves the old version as it was."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "MANIFEST.json"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._text = jvm.org.apache.commons.io.IOUtils
        self._utf8 = jvm.java.nio.charset.StandardCharsets.UTF_8

    def manifest(self) -> dict:
        at = self._path(f"{self.path}/{MANIFEST}")
        if not self._fs.exists(at):
            return {"version": 0, "schema": 0, "tables": {}}
        stream = self._fs.open(at)
        try:
            return json.loads(self._text.toString(stream, self._utf8))
        finally:
            stream.close()

    def publish(self, manifest: dict) -> None:
        """Puts a manifest in place by a rename; the one before stays beside it, for rollback."""
        new = self._path(f"{self.path}/.{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        at, old = self._path(f"{self.path}/{MANIFEST}"), self._path(f"{self.path}/MANIFEST-{manifest['version'] - 1}.json")
        if self._fs.exists(at):
            self._fs.delete(old, False)
            self._fs.rename(at, old)
        if not self._fs.rename(new, at):
            raise OSError("the manifest can't be put in place")

    def rollback(self) -> None:
        """Back to the version before."""
        version = self.manifest()["version"]
        old = self._path(f"{self.path}/MANIFEST-{version - 1}.json")
        if not self._fs.exists(old):
            raise ValueError("no version before this one")
        self._fs.delete(self._path(f"{self.path}/{MANIFEST}"), False)
        self._fs.rename(old, self._path(f"{self.path}/{MANIFEST}"))

    def tables(self) -> list[str]:
        return sorted(self.manifest()["tables"])

    def read(self, name: str) -> DataFrame:
        known = self.manifest()["tables"]
        if name not in known:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.path}/{known[name]}")

    def commit(self, tables: Mapping[str, DataFrame]) -> int:
        """Writes new versions of tables and makes all of them count at once. Returns the version."""
        now = self.manifest()
        places = {}
        for name, df in tables.items():
            places[name] = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{places[name]}")
        self.publish(now | {"version": now["version"] + 1, "tables": now["tables"] | places})
        return now["version"] + 1

    def upsert(self, name: str, rows: DataFrame, *keys: str) -> int:
        """Rows replace those of their keys and join the others. Of rows with one key the last in order of all columns counts."""
        new = rows.groupBy(*keys).agg(F.max(F.struct(*[c for c in rows.columns if c not in keys])).alias("_r")).select(*keys, "_r.*").select(*rows.columns)
        if name in self.manifest()["tables"]:
            old = self.read(name)
            new = old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)
        return self.commit({name: new})

    def insert_new(self, name: str, rows: DataFrame, *keys: str) -> int:
        """Only rows whose keys aren't there."""
        rows = rows.dropDuplicates(list(keys))
        if name in self.manifest()["tables"]:
            old = self.read(name)
            rows = old.unionByName(rows.join(old.select(*keys), list(keys), "left_anti").select(*rows.columns), allowMissingColumns=True)
        return self.commit({name: rows})

    def replace_documents(self, tables: Mapping[str, DataFrame], key: str = "doc_id") -> int:
        """All rows of the documents that tables hold are replaced, in all those tables at once."""
        ids = None
        for df in tables.values():
            ids = df.select(key) if ids is None else ids.union(df.select(key))
        ids = ids.distinct()
        known = self.manifest()["tables"]
        made = {}
        for name, df in tables.items():
            if name in known:
                old = self.read(name)
                df = old.join(ids, key, "left_anti").select(*old.columns).unionByName(df, allowMissingColumns=True)
            made[name] = df
        return self.commit(made)

    def delete_documents(self, ids: DataFrame, key: str = "doc_id") -> int:
        """Rows of the documents go from every table that has the key."""
        made = {}
        for name in self.tables():
            old = self.read(name)
            if key in old.columns:
                made[name] = old.join(ids.select(key).distinct(), key, "left_anti").select(*old.columns)
        return self.commit(made)

    def migrate(self, steps: list[Callable[[Store], Mapping[str, DataFrame]]]) -> int:
        """Runs the steps that haven't run, in order; each gives new versions of tables and runs once."""
        for number in range(self.manifest()["schema"], len(steps)):
            made = steps[number](self)
            self.commit(made)
            now = self.manifest()
            self.publish(now | {"version": now["version"] + 1, "schema": number + 1})
        return self.manifest()["schema"]


def violations(rows: DataFrame, unique: tuple[str, ...] = (), allowed: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """rule, n: how many rows break each constraint; rules that hold are left out."""
    checks = []
    if unique:
        checks.append(rows.groupBy(*unique).agg(F.count("*").alias("c")).where("c > 1").agg(F.lit(f"unique({', '.join(unique)})").alias("rule"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")))
    for name, values in (allowed or {}).items():
        checks.append(rows.where(F.col(name).isNotNull() & ~F.col(name).isin(*values)).agg(F.lit(f"allowed({name})").alias("rule"), F.count("*").alias("n")))
    out = checks[0] if checks else rows.sparkSession.createDataFrame([], "rule string, n bigint")
    for c in checks[1:]:
        out = out.union(c)
    return out.where("n > 0")
