"""Helpers shared by the training-data operators: cutting lineage and hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and all is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-cut-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    The result has no lineage, so a lost executor costs a re-read and never a recomputation.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that ``cut`` made, once nothing will read it again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/cut-" in f}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], text: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in pieces of about ``size`` bytes of the text column, so that a task holds few at once."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(np.diff(np.cumsum(lengths, dtype=np.int64) // size, append=-1))
        at = 0
        for end in (ends + 1).tolist():
            yield batch.slice(at, end - at)
            at = end
