"""What the operators share: the shared folder, tables written to cut lineage, and batches in Python workers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word: what lies between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker handles at a time; a longer text is handled alone.
SLICE_BYTES = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A cluster names it in spark.checkpoint.dir; only where that is unset (tests) a local one is made."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="corpusloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: it is computed once, its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table of written() once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = f"{shared_folder(spark)}/tables/".split(":", 1)[-1].replace("//", "/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in folder.replace("//", "/"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of frames that nothing refers to any more, so that Spark deletes the shuffle files of finished rounds now and not some time later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """df in Spark's checkpoint folder, for the small frames of iterations; Spark removes it when it is no longer used."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each slice hold at most so many bytes, or a single text."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield batch.slice(start)
