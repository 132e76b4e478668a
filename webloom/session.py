"""Sessions, code shipping and the shared scratch area."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and local use; clusters bring their own."""
    os.environ.setdefault("TZ", "UTC")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("webloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, and keeps Arrow batches small: rows hold whole texts, and both ends of the pipe hold a batch. A batch size that was set by hand stays."""
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="webloom-")) / "webloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, f"{PACKAGE.name}/{p.relative_to(PACKAGE)}")
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset (tests) is a local one made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="webloom-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Workspace:
    """Intermediate tables in the shared folder. A table that is written and read back cuts lineage and outlives executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark).rstrip('/')}/webloom/{label}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """The table as it is read back. Its shuffle files go once it is written; else they would stay until the driver happens to collect garbage, and those of all tables would add up."""
        at, before = f"{self.path}/{name}", self.spark.conf.get(CLEANUP_CONF, "false")
        self.spark.conf.set(CLEANUP_CONF, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        finally:
            self.spark.conf.set(CLEANUP_CONF, before)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        for name in names:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Drops all other tables."""
        self.drop(*sorted(self.names.difference(names)))
