"""Session helpers shared by the whole library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table. The path goes to Spark's reader as it is, so any store it knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not share the driver's sys.path."""
    on_path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    sc = spark.sparkContext
    if str(PACKAGE.parent) in on_path or getattr(sc, "_cuelake_shipped", False):
        return
    out = Path(tempfile.mkdtemp(prefix="cuelake-")) / "cuelake.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(str(out))
    sc._cuelake_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; one of its own for a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="cuelake-shared-")
    return shared


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the cluster's own ``spark.checkpoint.dir``. Only where a session has none (tests,
    a laptop) is one made, and then only for a local master, whose tasks share the driver's disk.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="cuelake-checkpoint-"))
    return df.checkpoint()


@contextmanager
def written(df: DataFrame, *by: str) -> Iterator[DataFrame]:
    """df as a Parquet table in the shared folder with a folder for each value of ``by``, so that a filter on those
    columns reads only its own part. It is deleted at the end of the block."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    try:
        df.write.partitionBy(*by).parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove_folder(df.sparkSession, path)


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``broadcast(df)`` if it has at most ``rows`` rows (a counted bound), else df for a shuffle join.

    df should be cheap to count: aggregated or checkpointed.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
