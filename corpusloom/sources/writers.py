"""Sinks: tables by suffix, resumable chunks, summaries and caches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return exists(spark, f"{path}/_SUCCESS") or exists(spark, f"{path}/_DONE")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and then moved, so that no reader finds half of it."""
    target, fs = _path(spark, path)
    part, _ = _path(spark, f"{path}.tmp")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write by suffix: .json, .jsonl and .ndjson, .csv, .orc; anything else is Parquet."""
    suffix = path.rsplit(".", 1)[-1].lower()
    writer = df.write.mode(mode)
    if suffix in ("json", "jsonl", "ndjson"):
        writer.json(path)
    elif suffix == "csv":
        writer.option("header", True).csv(path)
    elif suffix == "orc":
        writer.orc(path)
    else:
        writer.parquet(path)


def splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A corpus by split, so that readers of one split read no other."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def once(df: Callable[[], DataFrame], path: str, spark: SparkSession) -> DataFrame:
    """The table at path; it is made only if it isn't there to its end."""
    if not is_done(spark, path):
        df().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def progress(spark: SparkSession, path: str) -> dict[str, int]:
    """Where a chunked write stands: zeros if it has not begun."""
    state = {"stream_pos": 0, "tokens": 0, "docs": 0, "chunks": 0}
    return state | json.loads(read_text(spark, path)) if exists(spark, path) else state


def chunks(df: DataFrame, path: str, chunk: str = "chunk", order: str = "doc_id", tokens: str = "tokens") -> dict[str, int]:
    """Write each chunk that isn't written yet as a table of its own, and note the progress after each."""
    spark, note = df.sparkSession, f"{path}/progress.json"
    state = progress(spark, note)
    for (number,) in df.filter(F.col(chunk) >= state["chunks"]).select(chunk).distinct().orderBy(chunk).collect():
        rows = df.filter(F.col(chunk) == number)
        rows.write.mode("overwrite").parquet(f"{path}/chunk_{number:05d}")
        found = spark.read.parquet(f"{path}/chunk_{number:05d}").agg(F.max(order), F.sum(tokens), F.count("*")).first()
        state = {"stream_pos": found[0] + 1, "tokens": state["tokens"] + found[1], "docs": state["docs"] + found[2], "chunks": number + 1}
        write_text(spark, note, json.dumps(state))
    write_text(spark, f"{path}/_DONE", "")
    return state


def summary(rows: DataFrame, path: str, key: str | None = None) -> dict:
    """A small table as one JSON document: a map by key, or the single row."""
    found = [r.asDict(recursive=True) for r in rows.collect()]
    doc = {str(r.pop(key)): r for r in found} if key else found[0]
    write_text(rows.sparkSession, path, json.dumps(doc, indent=2, sort_keys=True))
    return doc


def nested_json(rows: DataFrame, keys: Iterable[str], name: str = "json") -> DataFrame:
    """keys and the other columns as a JSON object, for documents keyed by model."""
    keys = list(keys)
    return rows.select(*keys, F.to_json(F.struct(*(c for c in rows.columns if c not in keys))).alias(name))


def markdown(rows: DataFrame) -> str:
    """A small table in Markdown; numbers with four digits, a dash where there is none."""
    show = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [rows.columns, ["---"] * len(rows.columns), *([show(v) for v in r] for r in rows.collect())]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines)


def by_language(rows: DataFrame, model: str = "model", language: str = "language", value: str = "bpb") -> DataFrame:
    """A row for each model and a column for each language that there is."""
    return rows.groupBy(model).pivot(language).agg(F.round(F.first(value), 4)).orderBy(model)
