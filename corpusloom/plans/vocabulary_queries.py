"""Queries over vocabularies, and the trainers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize
from ..models import bpe, unigram
from ..operators import statistics, vocabulary
from .registry import PIECES_SQL, WORDS_SQL, documents, pieces, query, words

_WC = f"SELECT word, count(*) AS cnt FROM (SELECT unnest({WORDS_SQL}) AS word FROM documents) GROUP BY word"
_SYMS = f"SELECT word, cnt, regexp_extract_all(word, '(?s).') AS s FROM ({_WC})"
_PAIRS = f"SELECT s[i] AS l, s[i + 1] AS r, cnt FROM (SELECT s, cnt, unnest(range(1, len(s))) AS i FROM ({_SYMS}))"
_MARG = f"SELECT c AS sym, sum(cnt)::BIGINT AS n FROM (SELECT unnest(s) AS c, cnt FROM ({_SYMS})) GROUP BY c"


def _words(spark, sf_dir):
    return statistics.word_counts(words(documents(spark, sf_dir)))


@query(_MARG)
def symbol_marginals(spark, sf_dir):
    return statistics.symbol_marginals(statistics.symbols(_words(spark, sf_dir)))


@query(f'SELECT l AS "left", r AS "right", sum(cnt)::BIGINT AS n_bc FROM ({_PAIRS}) GROUP BY l, r')
def pair_counts(spark, sf_dir):
    return statistics.pair_counts(statistics.symbols(_words(spark, sf_dir)))


_SCORED = (
    f"WITH m AS ({_MARG}), p AS (SELECT l, r, sum(cnt)::BIGINT AS bc FROM ({_PAIRS}) GROUP BY l, r), t AS (SELECT sum(n)::DOUBLE AS n FROM m),"
    " j AS (SELECT p.l, p.r, bc, a.n::DOUBLE AS b, d.n::DOUBLE AS c, t.n FROM p JOIN m a ON a.sym = p.l JOIN m d ON d.sym = p.r, t)"
    ' SELECT l AS "left", r AS "right", bc AS n_bc, round({}, 4) AS score FROM j ORDER BY {} DESC, l, r LIMIT 100'
)
_X = lambda t: f"(CASE WHEN {t} <= 0 THEN 0 ELSE {t} * ln({t}) END)"
_GAINS = {
    "count": "bc::DOUBLE",
    "ll_exact": f"({_X('greatest(b - bc, 0)')} - {_X('b')} + {_X('greatest(c - bc, 0)')} - {_X('c')} + {_X('bc')} - {_X('greatest(n - bc, 0)')} + {_X('n')})",
    "ll_approx": "(bc * (ln(bc * n / (b * c)) - 1))",
}


def _top(spark, sf_dir, score):
    """The report of the hundred best pairs."""
    rows = statistics.scored_pairs(statistics.symbols(_words(spark, sf_dir)), score)
    return rows.orderBy(F.desc("score"), "left", "right").limit(100).select("left", "right", "n_bc", F.round("score", 4).alias("score"))


@query(_SCORED.format(_GAINS["count"], _GAINS["count"]))
def pair_score_count_top(spark, sf_dir):
    return _top(spark, sf_dir, "count")


@query(_SCORED.format(_GAINS["ll_exact"], _GAINS["ll_exact"]))
def pair_score_ll_exact_top(spark, sf_dir):
    return _top(spark, sf_dir, "ll_exact")


@query(_SCORED.format(_GAINS["ll_approx"], _GAINS["ll_approx"]))
def pair_score_ll_approx_top(spark, sf_dir):
    return _top(spark, sf_dir, "ll_approx")


@query(f"SELECT (row_number() OVER (ORDER BY cnt DESC, word) - 1 + 2)::INTEGER AS id, word AS token FROM ({_WC}) WHERE cnt >= 3 QUALIFY row_number() OVER (ORDER BY cnt DESC, word) <= 4998 UNION ALL SELECT 0, '<s>' UNION ALL SELECT 1, '<unk>'")
def wordlevel_vocab(spark, sf_dir):
    return vocabulary.word_level_vocab(_words(spark, sf_dir), 5000, 3, ("<s>", "<unk>"))


_SEED_WORDS = f"SELECT word FROM ({_WC})"


@query(
    f"WITH w AS ({_SEED_WORDS}), s AS (SELECT word, i, unnest(range(2, least(16, length(word) - i + 1) + 1)) AS k FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),"
    " p AS (SELECT substring(word, i::INT, k::INT) AS piece, CASE WHEN i + k > length(word) THEN chr(1) ELSE substring(word, (i + k)::INT, 1) END AS f FROM s)"
    " SELECT piece, count(*) AS occurrences, count(*) * length(piece) AS score FROM p GROUP BY piece HAVING count(*) >= 2 AND count(DISTINCT f) > 1"
)
def seed_substrings(spark, sf_dir):
    return vocabulary.seed_substrings(_words(spark, sf_dir))


_LANG_VOCAB = f"SELECT DISTINCT lang AS name, unnest({WORDS_SQL}) AS token FROM documents"


def _by_lang(spark, sf_dir):
    docs = words(documents(spark, sf_dir))
    return docs.select(F.col("lang").alias("name"), F.explode("pieces").alias("token")).distinct()


@query(f"WITH v AS ({_LANG_VOCAB}), n AS (SELECT name, count(*) AS size FROM v GROUP BY name), s AS (SELECT a.name AS a, b.name AS b, count(*) AS shared FROM v a JOIN v b USING (token) GROUP BY 1, 2) SELECT x.name AS a, y.name AS b, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / x.size * 100, 6) AS pct FROM n x CROSS JOIN n y LEFT JOIN s ON s.a = x.name AND s.b = y.name")
def vocab_overlap_matrix(spark, sf_dir):
    return vocabulary.overlap_matrix(_by_lang(spark, sf_dir))


@query(f"SELECT token, min(name) AS name FROM ({_LANG_VOCAB}) GROUP BY token HAVING count(DISTINCT name) = 1")
def vocab_unique_per_lang(spark, sf_dir):
    return vocabulary.unique_tokens(_by_lang(spark, sf_dir))


@query(f"WITH v AS ({_LANG_VOCAB}) SELECT token FROM v GROUP BY token HAVING count(DISTINCT name) = (SELECT count(DISTINCT name) FROM v)")
def vocab_shared_all(spark, sf_dir):
    return vocabulary.shared_by_all(_by_lang(spark, sf_dir))


@query(f"SELECT name, token FROM (SELECT name, token, row_number() OVER (PARTITION BY name ORDER BY length(token) DESC, token) AS r FROM (SELECT token, min(name) AS name FROM ({_LANG_VOCAB}) GROUP BY token HAVING count(DISTINCT name) = 1)) WHERE r <= 20")
def longest_unique_tokens(spark, sf_dir):
    """The report of the twenty longest of each."""
    return vocabulary.longest(vocabulary.unique_tokens(_by_lang(spark, sf_dir)), 20, by=["name"]).select("name", "token")


# Lists of merges that need no training: adjacent pairs of characters, ranked by two scores.
_RANKED = f"WITH m AS ({_MARG}), p AS (SELECT l, r, sum(cnt)::BIGINT AS bc FROM ({_PAIRS}) GROUP BY l, r), t AS (SELECT sum(n)::DOUBLE AS n FROM m), j AS (SELECT p.l, p.r, bc, a.n::DOUBLE AS b, d.n::DOUBLE AS c, t.n FROM p JOIN m a ON a.sym = p.l JOIN m d ON d.sym = p.r, t), x AS (SELECT l, r, row_number() OVER (ORDER BY bc DESC, l, r) - 1 AS ra, row_number() OVER (ORDER BY b * c DESC, l, r) - 1 AS rb FROM j), a AS (SELECT l, r, ra AS rank FROM x WHERE ra < 300), b AS (SELECT l, r, rb AS rank FROM x WHERE rb < 300) "


def _pair_lists(spark, sf_dir):
    rows = statistics.scored_pairs(statistics.symbols(_words(spark, sf_dir)))
    rows = rows.withColumn("key", F.concat("left", F.lit("\u0001"), "right"))
    first = statistics.ranked(rows, "key", "n_bc").select("left", "right", (F.col("rank") - 1).alias("rank")).filter("rank < 300")
    second = statistics.ranked(rows.withColumn("prod", F.col("n_b") * F.col("n_c")), "key", "prod").select("left", "right", (F.col("rank") - 1).alias("rank")).filter("rank < 300")
    return first, second


@query(_RANKED + "SELECT count(*) FILTER (a.l IS NOT NULL AND b.l IS NOT NULL) AS shared, count(*) FILTER (b.l IS NULL) AS only_a, count(*) FILTER (a.l IS NULL) AS only_b FROM a FULL JOIN b ON a.l = b.l AND a.r = b.r")
def merge_overlap(spark, sf_dir):
    return vocabulary.merge_overlap(*_pair_lists(spark, sf_dir))


@query(_RANKED + "SELECT count(*) AS shared, count(*) FILTER (a.rank = b.rank) AS same, count(*) FILTER (abs(a.rank - b.rank) <= 10) AS within_10, count(*) FILTER (abs(a.rank - b.rank) <= 100) AS within_100, round(avg(abs(a.rank - b.rank)), 6) AS mean_diff FROM a JOIN b ON a.l = b.l AND a.r = b.r WHERE a.rank < 200")
def merge_rank_agreement(spark, sf_dir):
    return vocabulary.rank_agreement(*_pair_lists(spark, sf_dir), 200)


@query(_RANKED + "SELECT rank, coalesce(a.l || ' ' || a.r, '-') AS a, coalesce(b.l || ' ' || b.r, '-') AS b FROM (SELECT * FROM a WHERE rank < 50) a FULL JOIN (SELECT * FROM b WHERE rank < 50) b USING (rank)")
def merges_side_by_side(spark, sf_dir):
    return vocabulary.side_by_side(*_pair_lists(spark, sf_dir), 50)


@query(_RANKED + "SELECT min(rank) AS rank FROM a FULL JOIN b USING (rank) WHERE a.l IS DISTINCT FROM b.l OR a.r IS DISTINCT FROM b.r")
def merge_first_divergence(spark, sf_dir):
    return vocabulary.first_divergence(*_pair_lists(spark, sf_dir))


def _byte_words(spark, sf_dir):
    """Pieces of the byte-level pattern in the byte alphabet, with their counts: each distinct piece is mapped once."""
    counts = statistics.word_counts(pieces(documents(spark, sf_dir)))
    return counts.select(normalize.byte_level(F.col("word")).alias("word"), "cnt")


SPECIALS = ("<|endoftext|>", "<|padding|>")


def _trained(spark, sf_dir, score, size):
    config = bpe.BpeConfig(vocab_size=size, min_frequency=2, special_tokens=SPECIALS, score_by=score)
    rows = bpe.train_all(_byte_words(spark, sf_dir), {score: config})
    return rows.select("rank", "left", "right", "result", F.round("score", 4).alias("score"), "cnt")


@query()
def bpe_train(spark, sf_dir):
    return _trained(spark, sf_dir, "count", 1000)


@query()
def bottomup_ll_exact(spark, sf_dir):
    return _trained(spark, sf_dir, "ll_exact", 300)


@query()
def bottomup_ll_approx(spark, sf_dir):
    return _trained(spark, sf_dir, "ll_approx", 300)


def _listed(spark, vocab):
    return spark.createDataFrame([(i, p, round(s, 6)) for i, (p, s) in enumerate(vocab)], "id int, token string, score double")


@query()
def topdown_comp(spark, sf_dir):
    """The pieces of frequent words, from all seeds of the trainer's defaults; deleted in batches, as one by one takes a pass for each seed (see the README)."""
    config = unigram.TopDownConfig(special_tokens=SPECIALS, prune_ratio=0.5, min_prune=100)
    return _listed(spark, unigram.train_topdown(_byte_words(spark, sf_dir), config)[0])


@query()
def unigram_em(spark, sf_dir):
    config = unigram.UnigramConfig(special_tokens=SPECIALS)
    return _listed(spark, unigram.train_unigram(_byte_words(spark, sf_dir), config))
