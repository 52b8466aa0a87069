"""Resumable ingest of landed files into chunks, up to a budget of tokens."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import at_least, budget_cut, dense_uid, estimated_tokens
from ..sources import writers


def landed(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def into_chunks(stream: DataFrame, path: str, target: int, order: str = "doc_id", text: str = "text", least: int = 50) -> StreamingQuery:
    """Write each batch's documents as a chunk until target tokens are there; the document that crosses the target is the last.

    The checkpoint beside the chunks remembers what was read, and a note of the progress what was kept, so that a stopped run goes on where it stood; a
    batch that comes again overwrites its own chunk and counts once.
    """
    note = f"{path}/progress.json"

    def chunk(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        state = json.loads(writers.read_text(spark, note)) if writers.exists(spark, note) else {"batches": {}}
        before = [v for k, v in state["batches"].items() if int(k) < batch]
        tokens, docs = sum(b["tokens"] for b in before), sum(b["docs"] for b in before)
        if tokens >= target:
            return
        kept = at_least(rows.withColumn("tokens", F.coalesce(estimated_tokens(F.col(text)), F.lit(0))), "tokens", least)
        kept = dense_uid(budget_cut(kept, "tokens", target - tokens, order), order, docs)
        kept.write.mode("overwrite").parquet(f"{path}/chunk_{batch:05d}")
        found = spark.read.parquet(f"{path}/chunk_{batch:05d}").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
        state["batches"][str(batch)] = {"tokens": found[0], "docs": found[1]}
        writers.write_text(spark, note, json.dumps(state))

    return stream.writeStream.foreachBatch(chunk).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()
