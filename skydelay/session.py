"""SparkSession helpers.

The library never decides cluster sizing: it only fills in settings that are unset, so a cluster's own
configuration (shuffle partitions, checkpoint folder, broadcast threshold) always wins.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the operators rely on. Each is applied only when the session has no value of its own.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Runtime broadcast of a join side only once AQE has measured it (the size check); larger sides
    # stay sort-merge joins.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    # rows handed to a Python worker at a time: documents can be long
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app: str = "skydelay") -> SparkSession:
    """Return the active session (or build a local one for tests/bench) with the library defaults."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("SKYDELAY_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    conf = spark.conf
    for key, value in _DEFAULTS.items():
        if conf.get(key, None) in (None, ""):
            conf.set(key, value)
    conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def compiled_methods_only(spark: SparkSession) -> None:
    """The JVM never compiles a method beyond 8,000 bytes: a stage of many joins and expressions, generated as one method,
    would be interpreted for every row. With this limit Spark runs such a stage operator by operator, in small methods."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", None) in (None, "", "65535"):  # the default: no limit of its own
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def joins_in_place(spark: SparkSession) -> None:
    """Joins of two sides that are both spread by some of the columns they are joined on need no further shuffle; Spark takes
    that only from groupings and windows unless told."""
    if spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", None) in (None, "", "true"):
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    A cluster names it in ``spark.checkpoint.dir``; that value is always used. Only when it is unset (local tests)
    is a fresh scratch folder created and set.
    """
    sc = spark.sparkContext
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):  # local[..] and local-cluster[..] run on one machine
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="skydelay-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df):
    """Materialize a DataFrame that later steps read several times as a parquet table in the shared checkpoint folder.

    Unlike a cached or local copy it survives executor loss; unlike ``Dataset.checkpoint`` (Java-serialized rows read
    back as an opaque RDD) the table is columnar and compressed, and reads of it get column pruning and filter
    pushdown."""
    path = owned_path(df.sparkSession, "tables")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def owned_path(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared checkpoint folder; the open lineage scopes delete it at their end."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"
    for scope in _SCOPES:
        scope.append(path)
    return path


_SCOPES: list[list[str]] = []


@contextmanager
def lineage_scope(spark: SparkSession):
    """Owns the tables that ``cut_lineage`` writes inside the block and deletes them at its end, when the job's own
    output has been written: ``with lineage_scope(spark): build(...).write.parquet(target)``."""
    own: list[str] = []
    _SCOPES.append(own)
    try:
        yield
    finally:
        _SCOPES.remove(own)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in own:
            hpath = jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(conf).delete(hpath, True)
