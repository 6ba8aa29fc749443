"""Reading the input tables, and keeping intermediate results where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``; with ``columns``, only those (the scan reads no others)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for intermediate data, ``spark.checkpoint.dir``.

    Only where that is unset and the session runs on one machine, as in tests, a temporary folder is made and set; on a
    cluster no executor could read another's folder, so there the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="sparkwright-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, which is counted; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class Stage:
    """Tables written to the shared folder: a stage survives the loss of executors and cuts lineage.

    Columnar and compressed, so smaller than a checkpoint of rows. ``drop`` removes what a loop no longer needs.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def put(self, df: DataFrame, *sort: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_stage_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
