"""The corpus pipeline: five stages, each of which works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the docs of the next. All but the last return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import jaccard, language, lines, mixing, packing
from corpusloom.llm.common import WORD, discard, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters, with the language that the classifier finds as their label, whatever it was. Where no row had a label, nothing is learned
    and labels stay null. A null or empty text goes; repeated rows stay or go together, and other columns stay as they are."""
    model = language.fit(docs)
    if not model.languages:
        return docs.filter(language.has_letters(F.col("text")))
    found = language.identify(docs, model).filter(F.col("lang_pred") != language.UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand in an earlier one; those of whose words nothing is left go, as all they say is said elsewhere.

    Texts that had no words before stay, null ones too, as do repeated rows; other columns but n_chars are as they were.
    """
    found = lines.dedup_lines(docs, run_words=lines.RUN_WORDS)
    emptied = (F.col("removed_chars") > 0) & ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    return found.filter(~emptied).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its shingles of five words: that with the smallest doc_id, null last. Texts without words all stay."""
    return jaccard.first_of_groups(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' words in shares by weight: a document comes once for each epoch that takes some of it, with what that takes.
    Texts without words go; a null source is one more source."""
    return mixing.mixed_texts(docs, mixing.mix_sources(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_documents),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the classifier, the draws or the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all that the stages leave of the table documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
