"""Tables written once in the shared folder, to cut lineage and to be read more than once.

The folder is `spark.checkpoint.dir`, which every executor must see. Where it is unset, as in
tests, a folder below the warehouse is used; the session's settings are left alone. Staged
tables belong to the application: `release` deletes them, and so does the end of the process.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_owned: dict[str, list[tuple[SparkSession, str]]] = {}


def folder(spark: SparkSession) -> str:
    """Where this application stages its tables."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    return f"{base.rstrip('/')}/firnline-{sc.applicationId}"


def stage(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    Cuts the lineage, survives the loss of an executor, and gives Spark the true size and the
    column pruning of a Parquet table. The shuffle files that made it are removed once it stands.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    own(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, key: str, compression: str = "zstd") -> DataFrame:
    """As `stage`, dealt out by `key` in as many buckets as a shuffle has partitions.

    Joins and groups by `key` read the table as it lies, so its rows are shuffled once, while it is
    written. The catalog's entry is only needed until the table is read back and goes at once.
    """
    spark = df.sparkSession
    name = f"firnline_{uuid.uuid4().hex}"
    path = f"{folder(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    own(spark, path)
    try:
        dealt = df.repartition(buckets, key).write.option("compression", compression).option("path", path)
        dealt.bucketBy(buckets, key).saveAsTable(name, format="parquet")
        return spark.table(name)
    finally:
        spark.conf.set(_CLEANUP, before)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def own(spark: SparkSession, path: str) -> str:
    """Let the application delete `path` when it ends, as it does its staged tables."""
    _owned.setdefault(spark.sparkContext.applicationId, []).append((spark, path))
    return path


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete staged tables that are no longer read: those given, or all of this application."""
    app = spark.sparkContext.applicationId
    wanted = {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}
    kept = []
    for owner, path in _owned.get(app, []):
        if tables and not any(w.endswith(path.rpartition("/")[2]) for w in wanted):
            kept.append((owner, path))
            continue
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _owned[app] = kept


def _at_exit() -> None:
    for staged in list(_owned.values()):
        if staged:
            spark = staged[0][0]
            try:
                release(spark)
            except Exception:  # the session is gone: the folder's own retention removes them
                continue


atexit.register(_at_exit)
