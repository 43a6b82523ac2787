"""Session and storage helpers shared by every operator."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def local_session(app: str = "impactframe", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application; they may not share the driver's module path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="impactframe-"), "impactframe")
    target = shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named test table, a Parquet file or directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; the cluster's setting wins, a local one is made only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or None
    sc = spark.sparkContext
    if found is None:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="impactframe-ckpt-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise df reliably in the shared folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: column-pruned rereads, survives lost executors."""
    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, where its files give fewer: for scans that feed costly work on each row.

    Only a scan with filters and projections is changed; with enough splits it stays as it is, so large inputs are not shuffled.
    """
    plan = df._jdf.queryExecution()
    if "Adaptive" in plan.executedPlan().toString()[:40]:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


_staged: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete what this application has staged, once no result that reads it is needed any more."""
    while _staged:
        where = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
