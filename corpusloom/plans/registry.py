"""How queries are registered: a function of (spark, sf_dir), with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pretok

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The pieces of the byte-level pattern for an engine without look-ahead: a mark before the last of several spaces ends their match.
PIECES_SQL = (
    r"regexp_extract_all(regexp_replace(text, '(\s)(\s)(\S)', '\1' || chr(1) || '\2\3', 'g'),"
    r" '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+')"
)
WORDS_SQL = r"regexp_extract_all(text, '\S+')"


def query(sql: str | None = None) -> Callable:
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over as many partitions as there are cores, where their files give fewer: a small table may be a single row group, which one task would read alone."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of most queries: uid, text, lang and source."""
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "text", "lang", "source"))


def pieces(docs: DataFrame) -> DataFrame:
    return docs.withColumn("pieces", pretok.byte_level(F.col("text")))


def words(docs: DataFrame) -> DataFrame:
    return docs.withColumn("pieces", pretok.whitespace_split(F.col("text")))
