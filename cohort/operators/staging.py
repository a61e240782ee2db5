"""Written intermediate tables: computed once, read many times, and safe when executors are lost."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver may do without one; it gets a folder of its own that goes when
    the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder as Parquet and return a scan of it.

    Used where a result has several readers or a loop must cut its lineage. The scan knows its
    real size, prunes columns, and re-reads files instead of recomputing after a failure.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"stage-{uuid.uuid4().hex}")
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)
