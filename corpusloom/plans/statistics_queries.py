"""Queries of statistics: usage, laws of frequency, packing, scoring, inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference, packing, results, scoring, statistics
from ..operators.iteration import checkpointed
from .corpus_queries import _IDS, with_ids
from .registry import PIECES_SQL, WORDS_SQL, documents, pieces, query, table, words

_PC = f"SELECT word, count(*) AS cnt FROM (SELECT unnest({PIECES_SQL}) AS word FROM documents) GROUP BY word"
_RANKS = f"SELECT *, row_number() OVER (ORDER BY cnt DESC, word) AS rank FROM ({_PC})"


def _counts(spark, sf_dir):
    return statistics.word_counts(pieces(documents(spark, sf_dir)))


def _ranks(spark, sf_dir):
    return statistics.ranked(_counts(spark, sf_dir), "word")


@query(f"SELECT token_id, count(*) AS cnt FROM (SELECT unnest(ids) AS token_id FROM ({_IDS})) GROUP BY token_id")
def token_usage(spark, sf_dir):
    return statistics.word_counts(with_ids(spark, sf_dir), "input_ids").withColumnRenamed("word", "token_id")


@query(f"SELECT word, cnt, rank FROM ({_RANKS})")
def frequency_ranks(spark, sf_dir):
    return _ranks(spark, sf_dir)


_TOTALS = f"SELECT 'bytes' AS name, sum(strlen(text))::BIGINT AS n FROM documents UNION ALL SELECT 'chars', sum(length(text))::BIGINT FROM documents UNION ALL SELECT 'pieces', sum(len({PIECES_SQL}))::BIGINT FROM documents UNION ALL SELECT 'words', sum(len({WORDS_SQL}))::BIGINT FROM documents"


@query(f"WITH t AS ({_TOTALS}), b AS (SELECT n AS base FROM t WHERE name = 'pieces') SELECT name, n, base, n - base AS diff, round((n - base) / base * 100, 6) AS diff_pct, CASE WHEN n > base THEN 'more' WHEN n < base THEN 'fewer' ELSE 'same' END AS direction FROM t, b")
def compression_vs_baseline(spark, sf_dir):
    docs = words(documents(spark, sf_dir)).withColumnRenamed("pieces", "words")
    docs = pieces(docs)
    sums = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.length("text")).alias("chars"), F.sum(F.size("pieces")).alias("pieces"), F.sum(F.size("words")).alias("words"))
    rows = sums.unpivot([], ["bytes", "chars", "pieces", "words"], "name", "n")
    return statistics.against_baseline(rows, "name", "n", "pieces")


@query(f"SELECT least(length(word), 16) AS length, count(*) AS n_tokens FROM ({_PC}) GROUP BY 1")
def length_hist_capped(spark, sf_dir):
    return statistics.length_histogram(_counts(spark, sf_dir), F.length("word").cast("long"), 16)


@query(f"SELECT round(avg(n), 6) AS mean_len, list_sort(list(n))[count(*) // 2 + 1] AS upper_median, max(n) AS max_len FROM (SELECT length(word) AS n FROM ({_PC}))")
def length_upper_median(spark, sf_dir):
    return statistics.length_summary(statistics.length_histogram(_counts(spark, sf_dir), F.length("word").cast("long")))


_FIT = "round(-regr_slope(ln(cnt), ln(rank)), 6) AS alpha, round(regr_r2(ln(cnt), ln(rank)), 6) AS r2, count(*) AS points"


@query(f"SELECT {_FIT} FROM ({_RANKS})")
def zipf_global(spark, sf_dir):
    return statistics.zipf_fit(_ranks(spark, sf_dir))


@query(" UNION ALL ".join(f"SELECT '{n}' AS segment, {_FIT} FROM ({_RANKS}) WHERE rank > {a} AND rank <= {b}" for n, a, b in (("head", 0, 100), ("middle", 99, 1000), ("tail", 999, 10000))))
def zipf_segments(spark, sf_dir):
    ranks = _ranks(spark, sf_dir)
    parts = [statistics.zipf_fit(ranks, first=a, last=b).select(F.lit(n).alias("segment"), "alpha", "r2", "points") for n, a, b in (("head", 0, 100), ("middle", 99, 1000), ("tail", 999, 10000))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT round(quantile_cont(ln(cnt) + 0.8 * ln(rank), 0.5), 6) AS intercept FROM ({_RANKS})")
def zipf_intercept(spark, sf_dir):
    return statistics.zipf_intercept(_ranks(spark, sf_dir), 0.8)


@query(f"WITH c AS ({_PC}), p AS (SELECT cnt / (SELECT sum(cnt) FROM c) AS p FROM c) SELECT round(-sum(p * log2(p)), 6) AS entropy, count(*) AS n_used, round(-sum(p * log2(p)) / log2(count(*)) * 100, 6) AS efficiency FROM p")
def entropy(spark, sf_dir):
    return statistics.entropy(_counts(spark, sf_dir))


@query(f"WITH r AS ({_RANKS}), p AS (SELECT rank, cnt / (SELECT sum(cnt) FROM r) AS p FROM r), b AS (SELECT CASE WHEN rank <= 100 THEN 0 WHEN rank <= 1000 THEN 1 WHEN rank <= 10000 THEN 2 ELSE 3 END AS band, p, -p * log2(p) AS h FROM p) SELECT band, count(*) AS n_tokens, round(sum(p) * 100, 6) AS corpus_pct, round(sum(h) / (SELECT sum(h) FROM b) * 100, 6) AS entropy_pct FROM b GROUP BY band")
def entropy_bands(spark, sf_dir):
    return statistics.entropy_bands(_ranks(spark, sf_dir), [100, 1000, 10_000])


@query(f"WITH r AS ({_RANKS}), s AS (SELECT rank, sum(cnt) OVER (ORDER BY rank) AS upto, (SELECT sum(cnt) FROM r) AS total FROM r) SELECT threshold, min(rank) AS rank FROM s, (VALUES (50.0::DOUBLE), (80.0::DOUBLE), (90.0::DOUBLE), (99.0::DOUBLE)) t(threshold) WHERE upto >= threshold / 100 * total GROUP BY threshold")
def coverage(spark, sf_dir):
    return statistics.coverage(_ranks(spark, sf_dir), [50, 80, 90, 99])


@query(f"WITH v AS (SELECT DISTINCT word FROM ({_PC})), u AS (SELECT unnest({PIECES_SQL}) AS word FROM documents WHERE lang = 'de') SELECT count(*) AS vocab_size, count(*) FILTER (v.word NOT IN (SELECT word FROM u)) AS unused FROM v")
def zero_usage(spark, sf_dir):
    docs = pieces(documents(spark, sf_dir))
    vocab = statistics.word_counts(docs).select("word")
    used = statistics.usage(vocab, statistics.word_counts(docs.filter("lang = 'de'")), "word")
    return used.agg(F.count("*").alias("vocab_size"), F.count_if(F.col("cnt") == 0).alias("unused"))


_STREAM = f"SELECT uid, list_append(ids, 0) AS t, len(ids) + 1 AS n, coalesce(sum(len(ids) + 1) OVER (ORDER BY md5('42:' || uid) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM ({_IDS})"
_TOKENS = f"SELECT start + i - 1 AS pos, t[i] AS tok FROM (SELECT start, t, unnest(range(1, n + 1)) AS i FROM ({_STREAM}))"


@query(f"SELECT pos // 129 AS seq_id, md5(string_agg(tok, ',' ORDER BY pos)) AS digest, sum(tok)::BIGINT AS total FROM ({_TOKENS}) GROUP BY 1 HAVING count(*) = 129")
def pack_sequences(spark, sf_dir):
    rows = packing.pack_sequences(with_ids(spark, sf_dir), seq_len=128)
    return rows.select("seq_id", F.md5(F.array_join(F.col("tokens").cast("array<string>"), ",")).alias("digest"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"WITH s AS ({_STREAM}), q AS (SELECT unnest(range(0, (SELECT max(start + n) FROM s), 97)) AS pos) SELECT pos, uid, pos - start AS \"offset\" FROM q JOIN s ON pos >= start AND pos < start + n")
def locate_positions(spark, sf_dir):
    index = packing.document_index(with_ids(spark, sf_dir))
    top = index.agg(F.max(F.col("start") + F.col("len"))).first()[0] or 0
    return packing.locate(spark.range(0, top, 97).withColumnRenamed("id", "pos"), index)


@query(
    f"WITH d AS (SELECT uid, len(ids) AS n FROM ({_IDS})), w AS (SELECT uid, n, 0 AS s FROM d WHERE n > 1 UNION ALL SELECT uid, n, unnest(range(128, ceil((n - 1 - 256) / 128)::BIGINT * 128 + 1, 128)) FROM d WHERE n > 256)"
    " SELECT uid, s AS start, least(s + 256, n - 1) AS \"end\", CASE WHEN s = 0 THEN 1 ELSE least(s - 128 + 256, n - 1) + 1 END AS new_from FROM w"
)
def sliding_windows(spark, sf_dir):
    rows = with_ids(spark, sf_dir).select("uid", F.size("input_ids").alias("n"))
    w = packing.sliding_windows(rows, 256, 128)
    return w.select("uid", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("new_from").cast("long").alias("new_from"))


_LOSS = (
    f"WITH c AS ({_PC}), t AS (SELECT sum(cnt) AS n, count(*) AS v FROM c), e AS (SELECT doc_id AS uid, unnest({PIECES_SQL}[2:]) AS word FROM documents),"
    " l AS (SELECT uid, sum(-ln((cnt + 1) / (n + v + 1))) AS loss_nats FROM e JOIN c USING (word), t GROUP BY uid),"
    f" d AS (SELECT doc_id AS uid, lang, strlen(text) AS num_bytes, len({PIECES_SQL}) AS num_tokens FROM documents),"
    " r AS (SELECT uid, lang, num_bytes, num_tokens, loss_nats, loss_nats / (num_bytes * 0.6931471805599453) AS bpb FROM d JOIN l USING (uid) WHERE num_bytes > 0 AND num_tokens > 1) "
)


def _losses(spark, sf_dir):
    docs = pieces(documents(spark, sf_dir))
    return scoring.document_losses(docs, scoring.unigram_model(docs))


@query(_LOSS + "SELECT uid, num_bytes, num_tokens, round(loss_nats, 6) AS loss_nats, round(bpb, 6) AS bpb FROM r")
def ngram_bpb(spark, sf_dir):
    return _losses(spark, sf_dir).select("uid", "num_bytes", "num_tokens", F.round("loss_nats", 6).alias("loss_nats"), F.round("bpb", 6).alias("bpb"))


@query(_LOSS + "SELECT round(avg(bpb), 6) AS bpb_mean, round(stddev_samp(bpb), 6) AS bpb_std, round(min(bpb), 6) AS bpb_min, round(max(bpb), 6) AS bpb_max FROM r")
def bpb_distribution(spark, sf_dir):
    return statistics.bpb_distribution(_losses(spark, sf_dir))


@query(_LOSS + "SELECT lang, count(*) AS n_docs, round(sum(loss_nats) / (sum(num_bytes) * 0.6931471805599453), 6) AS bpb FROM r GROUP BY lang")
def corpus_bpb(spark, sf_dir):
    rows = _losses(spark, sf_dir).join(documents(spark, sf_dir).select("uid", "lang"), "uid")
    return statistics.corpus_bpb(rows, ["lang"])


@query(_LOSS + "SELECT lang, round(exp(sum(loss_nats) / sum(num_tokens)), 6) AS token_ppl, round(sum(loss_nats) / (sum(num_bytes) * 0.6931472), 4) AS bpb4, round(pow(2, round(sum(loss_nats) / (sum(num_bytes) * 0.6931472), 4)), 2) AS export_ppl FROM r GROUP BY lang")
def perplexities(spark, sf_dir):
    rows = _losses(spark, sf_dir).join(documents(spark, sf_dir).select("uid", "lang"), "uid")
    return statistics.perplexities(rows, ["lang"])


@query("SELECT quality, toxic, round(avg(correct), 6) AS accuracy, count(*) AS n FROM (SELECT quality, toxic, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS correct FROM labels) GROUP BY GROUPING SETS ((quality), (toxic), ())")
def accuracy_grouping_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("correct", (F.col("quality") == 1) & (F.col("toxic") == 0))
    return statistics.accuracies(rows, ["quality", "toxic"])


@query(_LOSS + ", g AS (SELECT uid, -loss_nats AS good FROM r), p AS (SELECT a.uid, a.good AS logprob_good, b.good AS logprob_bad FROM g a JOIN g b ON b.uid = a.uid + 1) SELECT count(*) AS n, round(avg(CASE WHEN logprob_good > logprob_bad THEN 1 ELSE 0 END), 6) AS accuracy FROM p")
def pair_accuracy(spark, sf_dir):
    """Each document against the next."""
    probs = _losses(spark, sf_dir).select("uid", (-F.col("loss_nats")).alias("logprob"))
    pairs = probs.withColumnRenamed("logprob", "logprob_good").join(probs.select((F.col("uid") - 1).alias("uid"), F.col("logprob").alias("logprob_bad")), "uid")
    return scoring.pair_accuracy(pairs).agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))


_SEEDS = "SELECT source AS tokenizer, doc_id % 3 AS seed, round(avg(length(text)), 4) AS bpb FROM documents GROUP BY 1, 2"


@query(f"SELECT tokenizer, round(avg(bpb), 6) AS mean, round(coalesce(stddev_samp(bpb), 0), 6) AS std, round(min(bpb), 6) AS min, round(max(bpb), 6) AS max, count(*) AS n_seeds, string_agg(printf('%.4f', bpb), ',' ORDER BY seed) AS values FROM ({_SEEDS}) GROUP BY tokenizer")
def seed_stats(spark, sf_dir):
    runs = documents(spark, sf_dir).groupBy(F.col("source").alias("tokenizer"), (F.col("uid") % 3).alias("seed")).agg(F.round(F.avg(F.length("text")), 4).alias("bpb"))
    return statistics.seed_statistics(runs, ["tokenizer"])


_RUN = "'me' || (10 + doc_id % 5) || CASE WHEN doc_id % 7 = 0 THEN 'B' ELSE 'M' END || '-tied_' || source || '-' || (doc_id % 3 * 8 + 8) || 'k_2Btok_seed' || (doc_id % 4)"


@query(f"SELECT uid, regexp_extract(run, p, 1) AS size, regexp_extract(run, p, 2) AS tokenizer, regexp_extract(run, p, 3) AS vocab, regexp_extract(run, p, 4) AS budget, regexp_extract(run, p, 5)::INT AS seed, regexp_extract(run, p, 2) || '-' || regexp_extract(run, p, 3) AS directory FROM (SELECT doc_id AS uid, {_RUN} AS run, '^me(\\d+[MB])-tied_(.+?)-([^_]+)_(\\d+)Btok_seed(\\d+)$' AS p FROM documents)")
def run_name_parse(spark, sf_dir):
    i = F.col("uid")
    run = F.concat(F.lit("me"), 10 + i % 5, F.when(i % 7 == 0, "B").otherwise("M"), F.lit("-tied_"), "source", F.lit("-"), i % 3 * 8 + 8, F.lit("k_2Btok_seed"), i % 4)
    rows = documents(spark, sf_dir).select("uid", run.alias("run")).withColumn("r", results.parse_run(F.col("run")))
    return rows.select("uid", "r.*", results.tokenizer_of(F.col("run")).alias("directory"))


_DRAWS = "m AS (SELECT *, row_number() OVER (ORDER BY uid) - 1 AS i, count(*) OVER () AS n FROM r), x AS (SELECT b, ('0x' || substr(md5(b || ':' || i), 1, 12))::BIGINT % n AS i FROM m, (SELECT unnest(range(0, 1000)) AS b))"


@query(_LOSS + ", " + _DRAWS + ", s AS (SELECT b, sum(loss_nats) / (sum(num_bytes) * 0.6931471805599453) AS v FROM x JOIN m USING (i) GROUP BY b) SELECT 'unigram' AS model, (SELECT count(*) FROM r) AS n_docs, (SELECT round(sum(loss_nats) / (sum(num_bytes) * 0.6931471805599453), 6) FROM r) AS bpb, round(stddev_samp(v), 6) AS bpb_std, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high FROM s")
def bootstrap_ci_md5(spark, sf_dir):
    return inference.bootstrap(_losses(spark, sf_dir), 1000, model="unigram", draws="md5")


@query()
def bootstrap_ci(spark, sf_dir):
    """The interval of 10,000 replicates."""
    return inference.bootstrap(_losses(spark, sf_dir), model="unigram")


_DELTA = "sum(loss_nats) / (sum(num_bytes) * 0.6931471805599453) - sum(loss_b) / (sum(num_bytes) * 0.6931471805599453)"


@query(_LOSS.replace(" r AS (", " r0 AS (") + ", r AS (SELECT *, num_tokens * 8.0 AS loss_b FROM r0), " + _DRAWS + f", s AS (SELECT b, {_DELTA} AS d FROM x JOIN m USING (i) GROUP BY b), z AS (SELECT quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, avg(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS above FROM s) SELECT 'unigram' AS model_a, 'flat' AS model_b, (SELECT count(*) FROM r) AS n_docs, (SELECT round({_DELTA}, 6) FROM r) AS delta_bpb, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, lo > 0 OR hi < 0 AS significant, round(2 * least(above, 1 - above), 6) AS p_boot FROM z")
def paired_bootstrap_md5(spark, sf_dir):
    """Against a model that takes eight nats for each token."""
    a = checkpointed(_losses(spark, sf_dir))
    return inference.paired_bootstrap(a, a.withColumn("loss_nats", F.col("num_tokens") * 8.0), 1000, names=("unigram", "flat"), draws="md5")


_KERNEL = f"SELECT word, cnt, rank - 1000.0 AS x, 1 - abs(rank - 1000.0) / 500 AS w, CASE WHEN rank < 1000 THEN 1 ELSE 0 END AS t FROM ({_RANKS}) WHERE abs(rank - 1000.0) <= 500"


@query(f"SELECT word, x AS running, t AS treated, round(w, 6) AS weight FROM ({_KERNEL})")
def kernel_weights(spark, sf_dir):
    rows = inference.kernel_weights(_ranks(spark, sf_dir), "rank", 1000.0, 500.0)
    return rows.select("word", "running", "treated", F.round("weight", 6).alias("weight"))


_SIDES = f"SELECT t, count(*) AS n, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy FROM (SELECT *, ln(cnt) AS y FROM ({_KERNEL})) GROUP BY t"


@query(
    f"WITH s AS ({_SIDES}), a AS (SELECT *, sw * sxx - sx * sx AS det, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS b FROM s), c AS (SELECT *, (sy - b * sx) / sw AS i, sxx / det AS v FROM a), d AS (SELECT *, syy - i * sy - b * sxy AS rss FROM c),"
    " e AS (SELECT sum(CASE WHEN t = 1 THEN i ELSE -i END) AS effect, sum(v) AS v, sum(rss) AS rss, sum(n)::BIGINT AS n, sum(syy) - sum(sy) * sum(sy) / sum(sw) AS tss FROM d), f AS (SELECT *, sqrt(rss / (n - 4) * v) AS se FROM e)"
    " SELECT round(effect, 6) AS effect, round(se, 6) AS se, round(effect / se, 6) AS t, round(effect - 1.96 * se, 6) AS ci_low, round(effect + 1.96 * se, 6) AS ci_high, round(1 - rss / tss, 6) AS r2, n FROM f"
)
def rd_effect(spark, sf_dir):
    rows = inference.kernel_weights(_ranks(spark, sf_dir), "rank", 1000.0, 500.0).withColumn("y", F.ln("cnt"))
    return inference.discontinuity(rows, "y").drop("p")
