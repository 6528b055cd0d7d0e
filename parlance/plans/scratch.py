"""Written intermediates: lineage is cut with Parquet tables in the shared checkpoint folder.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only in local mode, where
driver and executors are one process, may that setting be absent (tests, a laptop): a folder
under the temporary directory is used then.  On a cluster without it, nothing is written.
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/parlance-scratch"
    return root.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """A new, empty location below the shared checkpoint folder."""
    return f"{_root(spark)}/parlance-{uuid.uuid4().hex}"


def expire(spark: SparkSession, hours: float = 48) -> int:
    """Delete the intermediates that were last changed more than ``hours`` ago; how many.

    For a maintenance job: results that have not been written yet may still read younger ones.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_root(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    before = (time.time() - hours * 3600) * 1000
    old = [f for f in (fs.listStatus(path) if fs.exists(path) else []) if f.getPath().getName().startswith("parlance-") and f.getModificationTime() < before]
    return sum(fs.delete(f.getPath(), True) for f in old)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in shared storage and read it back.

    Later reads survive lost executors and do not repeat the work above.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
