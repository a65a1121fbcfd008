"""Session helpers: table access, shared checkpoints, sizes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application, unless their path has it."""
    root = Path(__file__).resolve().parent
    sc = spark.sparkContext
    if getattr(sc, "_lithoflow_shipped", False) or str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc._lithoflow_shipped = True
    tmp = tempfile.mkdtemp(prefix="lithoflow-")  # on the driver, which serves it as long as it runs
    atexit.register(shutil.rmtree, tmp, True)
    path = f"{tmp}/lithoflow_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(p for p in root.rglob("*") if p.suffix in (".py", ".csv")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.  Only a local session, whose
    executors are the driver, may do without: it gets a folder of its own, removed at its end.  On a cluster
    a missing folder is an error, as a machine's own would be lost with the machine."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lithoflow-checkpoint-")
        atexit.register(shutil.rmtree, named, True)
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there: computed once, and
    still readable when an executor is lost.  The files go when the frame is no longer used, where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set (a setting of the application)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows over all cores, for work that is long beside its rows; adaptive execution would put
    small rows into a single task.  By a hash of the keys: rows that are already partitioned by the keys
    themselves would stay where they are, and be put together again."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, F.xxhash64(*keys)) if keys else df.repartition(n)
