"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

BUCKETS = 1 << 16
#: The classifier is fitted on about so many labelled documents of each language, chosen by hash.
DOCUMENTS_PER_LANGUAGE = 4_000
#: More labels than this are no set of languages; fitting then stops with an error.
MOST_LANGUAGES = 1_000
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: log P(bucket | language), a row for each bucket
    log_likelihood: np.ndarray
    log_prior: np.ndarray


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of 1 to 3 characters, the first place of each text in them (with the end as the last), and whether it has letters.

    Texts are lower-cased, and each run of anything but letters counts as one space; a space stands at either end.
    """
    joined = "".join(f" {(t or '').lower()} " for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len((t or "").lower()) + 2 for t in texts], np.int64)
    letter = _letters()[code]
    first = np.zeros(len(code), bool)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    first[starts[:-1]] = True
    keep = letter.copy()
    keep[0:1] = True
    keep[1:] |= letter[:-1] | first[1:]
    owner = np.repeat(np.arange(len(texts)), sizes)[keep]
    has = np.bincount(np.repeat(np.arange(len(texts)), sizes)[letter], minlength=len(texts)) > 0
    code = np.where(letter, code, 32)[keep].astype(np.uint64)
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    grams = np.empty((len(code), 3), np.int32)
    value = np.zeros(len(code), np.uint64)
    same = np.ones(len(code), bool)
    for n in range(3):
        nth = np.zeros(len(code), np.uint64)
        nth[: len(code) - n] = code[n:]
        if n:
            nearer = np.zeros(len(code), bool)
            nearer[: len(code) - n] = owner[n:] == owner[: len(code) - n]
            same &= nearer
        value = (value * np.uint64(0x9E3779B97F4A7C15)) ^ (nth + np.uint64(n + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        grams[:, n] = np.where(same, (mixed >> np.uint64(48)).astype(np.int32), BUCKETS)  # a gram that would reach into the next text counts for nothing
    return grams.ravel(), at * 3, has


def fit(labelled: DataFrame, per_language: int = DOCUMENTS_PER_LANGUAGE, smoothing: float = 0.1) -> LanguageModel:
    """Fit to the columns doc_id, text and lang.

    Rows with a null label, or with no letters, teach nothing. Each language takes part with about per_language documents, and never with more than twice as many, chosen
    by the hash of doc_id and text, so that the sample and what reaches the driver (a count for each bucket and language) don't grow with the table. An empty table
    teaches nothing.
    """
    rows = labelled.filter("lang is not null").select("doc_id", "text", "lang")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not totals:
        return LanguageModel([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0))
    share = F.create_map(*(F.lit(x) for lang, n in totals.items() for x in (lang, min(1 << 20, -(-per_language * (1 << 20) // n)))))
    chosen = F.xxhash64("doc_id", "text")
    sample = rows.filter(F.pmod(chosen, F.lit(1 << 20)) < F.try_element_at(share, "lang"))
    # Repeated rows share a hash, and come together: there may be twice as many as meant, but no more.
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(chosen))
    sample = sample.withColumn("_turn", turn).filter(F.col("_turn") <= 2 * per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                grams, at, _ = features(part.column("text").to_pylist())
                for i, lang in enumerate(part.column("lang").to_pylist()):
                    counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    counts[lang] += np.bincount(grams[at[i] : at[i + 1]], minlength=BUCKETS + 1)
        yield pa.RecordBatch.from_pydict({"lang": list(counts), "counts": [c.tobytes() for c in counts.values()]}, pa.schema([("lang", pa.string()), ("counts", pa.binary())]))

    languages = sorted(totals)
    counts = np.zeros((BUCKETS, len(languages)))
    for row in sample.repartition(4).mapInArrow(count, "lang string, counts binary").toLocalIterator():
        counts[:, languages.index(row["lang"])] += np.frombuffer(row["counts"], np.int64)[:BUCKETS]
    known = counts.sum(0) > 0
    languages, counts = [x for x, k in zip(languages, known, strict=True) if k], counts[:, known] + smoothing
    table = np.vstack([np.log(counts / counts.sum(0)), np.zeros((1, len(languages)))])
    weight = np.array([totals[x] for x in languages], float)
    return LanguageModel(languages, table.astype(np.float32), np.log(weight / weight.sum()))


def scores(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The likeliest language of each text and its posterior; und and 0 where a text is null or has no letters, or nothing was learned."""
    if not texts:
        return [], []
    grams, at, has = features(texts)
    if not model.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    log = np.empty((len(texts), len(model.languages)))
    for k in range(len(model.languages)):
        log[:, k] = np.add.reduceat(model.log_likelihood[:, k][grams], at[:-1], dtype=np.float64)  # no text is empty here: each has its two spaces
    log += model.log_prior
    best = log.argmax(1)
    posterior = 1 / np.exp(log - log.max(1, keepdims=True)).sum(1)
    return [model.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], [float(p) if h else 0.0 for p, h in zip(posterior, has, strict=True)]


def has_letters(text: Column) -> Column:
    """Whether a text has letters; false for a null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score in place of any columns of those names.

    Only the text decides; every row stays, repeated ones too, and equal texts have equal results. Of languages with equal scores the first by name is taken. A null
    text, one without letters, and every text where nothing was learned, has und and 0. Other columns pass through; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    schema = f"{kept.schema.simpleString()[7:-1]},lang_pred:string,score:double"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lang, score = scores(shared.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(predict, schema)
