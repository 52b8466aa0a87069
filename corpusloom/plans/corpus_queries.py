"""Queries that build corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, statistics
from .registry import PIECES_SQL, WORDS_SQL, documents, pieces, query, table, words

_TOK = f"coalesce(len({PIECES_SQL}), 0)"
_BASE = f"SELECT doc_id AS uid, text, lang, source, {_TOK} AS tokens FROM documents"


def _with_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("tokens", F.coalesce(corpus.estimated_tokens(F.col("text")), F.lit(0)))


@query(f"SELECT lang, word, count(*) AS cnt FROM (SELECT lang, unnest({PIECES_SQL}) AS word FROM documents) GROUP BY lang, word")
def word_counts(spark, sf_dir):
    return statistics.word_counts(pieces(documents(spark, sf_dir)), by=["lang"])


@query(f"SELECT c AS char, sum(cnt)::BIGINT AS cnt FROM (SELECT unnest(regexp_extract_all(word, '(?s).')) AS c, cnt FROM (SELECT word, count(*) AS cnt FROM (SELECT unnest({WORDS_SQL}) AS word FROM documents) GROUP BY word)) GROUP BY c")
def char_alphabet(spark, sf_dir):
    return statistics.alphabet(statistics.word_counts(words(documents(spark, sf_dir))))


@query("SELECT lang, sum(strlen(text))::BIGINT AS bytes, count(*) AS docs FROM documents GROUP BY ROLLUP (lang)")
def byte_totals_rollup(spark, sf_dir):
    return documents(spark, sf_dir).rollup("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("docs"))


@query(f"SELECT lang, sum(strlen(text))::BIGINT AS bytes, sum({_TOK})::BIGINT AS n_pieces, round(sum(strlen(text)) / sum({_TOK}), 6) AS bytes_per_piece FROM documents GROUP BY lang")
def bytes_per_piece(spark, sf_dir):
    rows = _with_tokens(spark, sf_dir).groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum("tokens").alias("n_pieces"))
    return rows.withColumn("bytes_per_piece", F.round(F.col("bytes") / F.col("n_pieces"), 6))


@query(f"SELECT uid, tokens FROM ({_BASE}) WHERE tokens >= 50")
def min_token_filter(spark, sf_dir):
    return corpus.at_least(_with_tokens(spark, sf_dir), "tokens").select("uid", "tokens")


_CUT = "SELECT *, coalesce(sum(tokens) OVER ({p} ORDER BY uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({base})"


@query(f"SELECT uid, tokens FROM ({_CUT.format(p='', base=_BASE)}) WHERE before < 100000")
def token_budget_cut(spark, sf_dir):
    return corpus.budget_cut(_with_tokens(spark, sf_dir), "tokens", 100_000, "uid").select("uid", "tokens")


@query(f"SELECT lang, uid, tokens FROM ({_CUT.format(p='PARTITION BY lang', base=_BASE)}) WHERE before < 20000")
def budget_cut_by_lang(spark, sf_dir):
    return corpus.budget_cut(_with_tokens(spark, sf_dir), "tokens", 20_000, "uid", ["lang"]).select("lang", "uid", "tokens")


@query(f"SELECT uid AS doc_id, row_number() OVER (ORDER BY uid) - 1 + 7 AS new_uid FROM ({_BASE}) WHERE tokens >= 50")
def dense_uid(spark, sf_dir):
    rows = corpus.at_least(_with_tokens(spark, sf_dir), "tokens")
    return corpus.dense_uid(rows, "uid", 7, name="new_uid").select(F.col("uid").alias("doc_id"), "new_uid")


_KEPT = f"SELECT *, row_number() OVER (ORDER BY uid) - 1 AS new FROM ({_CUT.format(p='', base=f'SELECT * FROM ({_BASE}) WHERE tokens >= 50')}) WHERE before < 300000"
_PLACED = f"SELECT *, row_number() OVER (ORDER BY md5('42:' || new)) - 1 AS pos, count(*) OVER () AS n FROM ({_KEPT})"


@query(f"SELECT uid AS doc_id, new AS new_uid, pos, CASE WHEN pos < floor(n * 0.95::DOUBLE) THEN 'train' WHEN pos < floor(n * (0.95::DOUBLE + 0.025::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM ({_PLACED})")
def md5_shuffle_split(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumnRenamed("uid", "doc_id")
    made = corpus.base_corpus(docs, "doc_id", corpus.estimated_tokens(F.col("text")), 300_000)
    return made.select("doc_id", F.col("uid").alias("new_uid"), "pos", "split")


@query(
    "WITH kept AS (SELECT lang, uid, row_number() OVER (PARTITION BY lang ORDER BY uid) - 1 AS new FROM ("
    + _CUT.format(p="PARTITION BY lang", base=f"SELECT * FROM ({_BASE}) WHERE tokens >= 50")
    + ") WHERE before < 60000), placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || new)) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM kept),"
    " split AS (SELECT *, CASE WHEN pos < floor(n * 0.95::DOUBLE) THEN 'train' WHEN pos < floor(n * (0.95::DOUBLE + 0.025::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM placed),"
    " parts AS (SELECT lang, uid FROM split WHERE split = 'train' AND lang <> 'en' UNION ALL SELECT lang, uid FROM (SELECT *, row_number() OVER (ORDER BY uid) - 1 AS i, count(*) OVER () AS c FROM split WHERE split = 'train' AND lang = 'en') WHERE i < c // 2)"
    " SELECT lang, uid AS doc_id, row_number() OVER (ORDER BY md5('42:' || uid)) - 1 AS pos FROM parts"
)
def multilingual_merge(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumnRenamed("uid", "doc_id")
    base = corpus.base_corpus(docs, "doc_id", corpus.estimated_tokens(F.col("text")), 60_000, by=["lang"])
    return corpus.merged_languages(base.drop("pos"), "doc_id").select("lang", "doc_id", "pos")


@query(
    f"WITH t AS ({_BASE}), cut AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY lang ORDER BY uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t WHERE coalesce(text, '') <> '' AND lang IN ('en', 'de', 'fr')),"
    " kept AS (SELECT *, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS r FROM cut WHERE before < CASE lang WHEN 'en' THEN 40000 ELSE 10000 END)"
    " SELECT uid AS doc_id, lang, row_number() OVER (ORDER BY r, uid) - 1 AS new_uid FROM kept"
)
def mixed_corpus(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumnRenamed("uid", "doc_id")
    made = corpus.mixed_corpus(docs, "doc_id", corpus.estimated_tokens(F.col("text")), {"en": 40_000, "de": 10_000, "fr": 10_000})
    return made.select("doc_id", "lang", F.col("uid").alias("new_uid"))


@query(
    f"WITH t AS ({_BASE}), base AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t WHERE tokens >= 50),"
    " s AS (SELECT max(uid) + 1 AS start, count(*) AS n FROM base WHERE before < 100000),"
    " more AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t, s WHERE tokens >= 50 AND uid >= start)"
    " SELECT uid AS doc_id, row_number() OVER (ORDER BY uid) - 1 + n AS new_uid, (row_number() OVER (ORDER BY uid) - 1) // 100 AS chunk FROM more WHERE before < 150000"
)
def extra_chunks(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumnRenamed("uid", "doc_id")
    tokens = corpus.estimated_tokens(F.col("text"))
    base = corpus.budget_cut(corpus.at_least(docs.withColumn("tokens", tokens), "tokens"), "tokens", 100_000, "doc_id")
    last, n = base.agg(F.max("doc_id"), F.count("*")).first()
    more = corpus.extension(docs, "doc_id", last + 1, tokens, 150_000, n, chunk_docs=100)
    return more.select("doc_id", F.col("uid").alias("new_uid"), "chunk")


@query(f"SELECT count(*) AS n_docs, sum(tokens)::BIGINT AS n_tokens, round(avg(tokens), 6) AS avg_tokens, min(tokens) AS min_tokens, max(tokens) AS max_tokens FROM ({_BASE})")
def dataset_stats(spark, sf_dir):
    t = F.col("tokens")
    return _with_tokens(spark, sf_dir).agg(F.count("*").alias("n_docs"), F.sum(t).alias("n_tokens"), F.round(F.avg(t), 6).alias("avg_tokens"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"))


_IDS = f"SELECT doc_id AS uid, list_transform({PIECES_SQL}, lambda x: strlen(x)) AS ids, lang, strlen(text) AS num_bytes FROM documents"


@query(f"SELECT count(*) AS n_rows, min(len(ids)) AS min_len, max(len(ids)) AS max_len, round(avg(len(ids)), 6) AS avg_len, min(list_min(ids)) AS min_id, max(list_max(ids)) AS max_id FROM (SELECT * FROM ({_IDS}) ORDER BY uid LIMIT 1000)")
def validate_sample(spark, sf_dir):
    """The report on the first thousand rows, which is what the feature looks at."""
    return corpus.validated(with_ids(spark, sf_dir), "uid", sample=1000)


@query(f"SELECT count(*) AS n_rows, min(len(ids)) AS min_len, max(len(ids)) AS max_len, round(avg(len(ids)), 6) AS avg_len, min(list_min(ids)) AS min_id, max(list_max(ids)) AS max_id FROM ({_IDS})")
def validate_all(spark, sf_dir):
    return corpus.validated(with_ids(spark, sf_dir), "uid", sample=None)


def with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, lang, num_bytes and input_ids: the lengths in bytes of the pieces stand for ids, so that no trained model is needed."""
    docs = pieces(documents(spark, sf_dir))
    return docs.select("uid", "lang", F.octet_length("text").alias("num_bytes"), F.transform("pieces", F.octet_length).alias("input_ids"))


@query(
    "WITH p AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || uid)) - 1 AS pos, count(*) OVER () AS n FROM ("
    + _BASE
    + ")), s AS (SELECT *, CASE WHEN pos < floor(n * 0.95::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM p)"
    " SELECT split, count(*) AS n_rows, round(avg(tokens), 6) AS avg_tokens, sum(tokens)::BIGINT AS n_tokens FROM s GROUP BY split"
)
def split_compare(spark, sf_dir):
    rows = corpus.train_val_split(_with_tokens(spark, sf_dir))
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.round(F.avg("tokens"), 6).alias("avg_tokens"), F.sum("tokens").alias("n_tokens"))


@query("SELECT uid FROM (SELECT doc_id AS uid, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents WHERE lang = 'en') WHERE i < n // 2")
def half_cut(spark, sf_dir):
    return corpus.half(documents(spark, sf_dir).filter("lang = 'en'").select("uid"), "uid")


@query("SELECT doc_id AS uid, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def done_anti_join(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("uid"))
    return corpus.work_to_do(documents(spark, sf_dir).select("uid", "lang"), done, ["uid"])


@query(f"WITH t AS ({_BASE}), f AS (SELECT count(*) AS sample_rows, sum(tokens)::BIGINT AS sample_tokens FROM (SELECT * FROM t ORDER BY uid LIMIT 100)), a AS (SELECT count(*) AS n_rows FROM t) SELECT n_rows, sample_rows, sample_tokens, (sample_tokens * n_rows // sample_rows)::BIGINT AS estimated_tokens FROM f, a")
def estimate_total(spark, sf_dir):
    return corpus.estimate_total(_with_tokens(spark, sf_dir), "tokens", "uid", 100)


@query("SELECT doc_id AS uid, len(string_split(text, chr(10))) AS n_lines, md5(text) AS digest FROM documents")
def lines_with_endings(spark, sf_dir):
    """Texts cut into lines that keep their ends, and put together again."""
    from ..sources.readers import lines_keeping_ends

    docs = documents(spark, sf_dir).select("uid", "text")
    lines = lines_keeping_ends(docs)
    # A text that ends with a line feed has no further line.
    whole = lines.groupBy("uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "").alias("text"))
    # Texts that are empty or null have no line, but a row.
    whole = docs.select("uid", F.when(F.col("text").isNotNull(), "").alias("_none")).join(whole, "uid", "left").select("uid", F.coalesce("text", "_none").alias("text"))
    n_lines = F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n", -1)).cast("long"))
    return whole.select("uid", n_lines.alias("n_lines"), F.md5("text").alias("digest"))
