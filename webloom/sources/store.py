"""A versioned Parquet store: all tables of a batch are written under one version, then a manifest names it in one rename.

One writer at a time. A batch that is committed twice changes nothing; a writer that dies leaves a version no manifest names. The schema number is part of the manifest, and an older one is migrated by a function per step.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = 2


class ConflictError(Exception):
    """Another writer was faster."""


class Store:
    def __init__(self, spark: SparkSession, root: str, migrations: dict[int, Callable[[str, DataFrame], DataFrame]] | None = None):
        self.spark, self.root, self.migrations = spark, root.rstrip("/"), migrations or {}
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.files = self.hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        if not self.files.exists(self._path("manifests")):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self.files.listStatus(self._path("manifests")) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "batches": [], "tables": {}, "schema": SCHEMA}
        text = self.spark.read.text(f"{self.root}/manifests/{version or known[-1]}.json", wholetext=True).first()[0]
        return json.loads(text)

    def commit(self, batch_id: str, tables: dict[str, DataFrame], expected: int | None = None) -> bool:
        """Appends to the tables. False if the batch is there already; ConflictError if the store has moved on from `expected`, or another writer took the version."""
        now = self.manifest()
        if batch_id in now["batches"]:
            return False
        if expected is not None and expected != now["version"]:
            raise ConflictError(f"version {now['version']} is not {expected}")
        version = now["version"] + 1
        for name, df in tables.items():
            at = f"{self.root}/data/{name}/v={version}"
            df.write.mode("overwrite").parquet(at)
            now["tables"].setdefault(name, []).append(at)
        now |= {"version": version, "batches": [*now["batches"], batch_id], "schema": SCHEMA}
        draft, final = self._path(f"manifests/{version}-{abs(hash(batch_id))}.tmp"), self._path(f"manifests/{version}.json")
        out = self.files.create(draft, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if self.files.exists(final) or not self.files.rename(draft, final):
            raise ConflictError(f"version {version} is taken")
        return True

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """The table as of a version, migrated to the present schema; None if it was never written."""
        m = self.manifest(version)
        paths = m["tables"].get(table)
        if not paths:
            return None
        df = self.spark.read.option("mergeSchema", "true").parquet(*paths)
        for step in range(m["schema"], SCHEMA):
            if step in self.migrations:
                df = self.migrations[step](table, df)
        return df


def evidence(contents: DataFrame, root: str) -> DataFrame:
    """Writes each content that is not stored yet once, under the first two digits of its digest, and returns the references of all. contents: (kind, body, headers). Of equal contents the row of the smallest kind and headers is kept."""
    from webloom.functions.text import public_headers

    spark = contents.sparkSession
    c = contents.select("kind", "body", public_headers(F.col("headers")).alias("headers"), F.sha2(F.col("body").cast("binary"), 256).alias("sha256"))
    first = c.groupBy("sha256").agg(F.min_by(F.struct("kind", "body", "headers"), F.struct("kind", F.to_json(F.array_sort(F.map_entries("headers"))))).alias("row"))
    first = first.select("sha256", "row.*", F.substring("sha256", 1, 2).alias("prefix"))
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        stored = spark.read.schema(first.schema).parquet(root).select("sha256")
        first = first.join(stored, "sha256", "left_anti")
    first.write.mode("append").partitionBy("prefix").parquet(root)
    return c.select("sha256", F.concat(F.lit("evidence://sha256/"), "sha256", F.lit("/"), "kind").alias("ref"))
