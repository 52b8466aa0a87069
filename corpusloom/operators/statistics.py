"""Statistics of token counts, losses and vocabularies."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LN2 = math.log(2)


def word_counts(pieces: DataFrame, column: str = "pieces", by: Sequence[str] = ()) -> DataFrame:
    """word and cnt of an array column; partial sums are made before the only shuffle."""
    return pieces.select(*by, F.explode(column).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("cnt"))


def alphabet(words: DataFrame) -> DataFrame:
    """char and cnt: characters weighted by the counts of their words."""
    return words.select(F.explode(F.split("word", "")).alias("char"), "cnt").filter("char <> ''").groupBy("char").agg(F.sum("cnt").alias("cnt"))


def symbols(words: DataFrame) -> DataFrame:
    """words as arrays of their characters."""
    return words.select("word", "cnt", F.filter(F.split("word", ""), lambda c: c != "").alias("syms"))


def symbol_marginals(words: DataFrame, syms: str = "syms") -> DataFrame:
    return words.select(F.explode(syms).alias("sym"), "cnt").groupBy("sym").agg(F.sum("cnt").alias("n"))


def pair_counts(words: DataFrame, syms: str = "syms") -> DataFrame:
    """left, right and n_bc of adjacent symbols, overlapping ones included."""
    pairs = F.expr(f"if(size({syms}) > 1, transform(sequence(1, size({syms}) - 1), i -> struct({syms}[i - 1] as left, {syms}[i] as right)), array())")
    return words.select(F.explode(pairs).alias("p"), "cnt").groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.sum("cnt").alias("n_bc"))


def _xlogx(x: Column) -> Column:
    return F.when(x <= 0, F.lit(0.0)).otherwise(x * F.ln(x))


def exact_gain(n_bc: Column, n_b: Column, n_c: Column, n: Column) -> Column:
    """How much merging the pair adds to the log-likelihood of a unigram model; differences are 0 at least."""
    less = lambda x: F.greatest((x - n_bc).cast("double"), F.lit(0.0))
    d = lambda x: x.cast("double")
    return _xlogx(less(n_b)) - _xlogx(d(n_b)) + _xlogx(less(n_c)) - _xlogx(d(n_c)) + _xlogx(d(n_bc)) - _xlogx(less(n)) + _xlogx(d(n))


def approximate_gain(n_bc: Column, n_b: Column, n_c: Column, n: Column) -> Column:
    d = lambda x: x.cast("double")
    return F.when((n_bc == 0) | (n_b == 0) | (n_c == 0), F.lit(0.0)).otherwise(d(n_bc) * (F.ln(d(n_bc) * d(n) / (d(n_b) * d(n_c))) - 1))


SCORES = {"count": lambda n_bc, n_b, n_c, n: n_bc.cast("double"), "ll_exact": exact_gain, "ll_approx": approximate_gain}


def scored_pairs(words: DataFrame, score: str = "count") -> DataFrame:
    """left, right, n_bc, n_b, n_c, n and score of each adjacent pair of symbols."""
    marginals = symbol_marginals(words)
    total = marginals.agg(F.sum("n").alias("total")).withColumn("_one", F.lit(1))
    pairs = pair_counts(words).join(marginals.select(F.col("sym").alias("left"), F.col("n").alias("n_b")), "left")
    pairs = pairs.join(marginals.select(F.col("sym").alias("right"), F.col("n").alias("n_c")), "right").withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    return pairs.withColumn("score", SCORES[score](F.col("n_bc"), F.col("n_b"), F.col("n_c"), F.col("total"))).drop("_one")


def ranked(counts: DataFrame, token: str, cnt: str = "cnt", by: Sequence[str] = ()) -> DataFrame:
    """counts with rank, from 1, by descending count and then token; a null in by is a group of its own, and counts that are null or not positive come last.

    Ranks are made in two levels: rows of one magnitude of counts among themselves, and the magnitudes' totals.
    """
    from .corpus import joined_on

    # The logarithm of what isn't positive is null; such rows are one more magnitude, after all others.
    magnitude = F.coalesce(-F.floor(F.log2(F.when(F.col(cnt) > 0, F.col(cnt).cast("double"))) * 16).cast("int"), F.lit(1 << 20))
    rows = counts.withColumn("_m", magnitude)
    inner = F.row_number().over(Window.partitionBy(*by, "_m").orderBy(F.desc(cnt), token))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1))
    bases = rows.groupBy(*by, "_m").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(before, F.lit(0))).drop("_n")
    return joined_on(rows.withColumn("_inner", inner), bases, [*by, "_m"]).withColumn("rank", (F.col("_base") + F.col("_inner")).cast("long")).drop("_m", "_inner", "_base")


def zipf_fit(ranks: DataFrame, cnt: str = "cnt", by: Sequence[str] = (), first: int = 0, last: int | None = None) -> DataFrame:
    """alpha, r2 and points of the line through log frequency over log rank, for ranks in (first, last]; null with fewer than two points."""
    rows = ranks.filter(F.col("rank") > first) if last is None else ranks.filter((F.col("rank") > first) & (F.col("rank") <= last))
    x, y = F.ln("rank"), F.ln(cnt)
    fitted = rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("points"))
    return fitted.select(*by, F.round(-F.col("slope"), 6).alias("alpha"), F.round("r2", 6).alias("r2"), "points")


def zipf_intercept(ranks: DataFrame, alpha: float, cnt: str = "cnt") -> DataFrame:
    """The median of log frequency plus alpha times log rank."""
    return ranks.agg(F.round(F.percentile(F.ln(cnt) + alpha * F.ln("rank"), 0.5), 6).alias("intercept"))


def rank_sample(ranks: DataFrame, points: int) -> DataFrame:
    """About so many of the ranks, evenly spread over their logarithms."""
    top = ranks.agg(F.max("rank").alias("top"))
    picks = top.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.floor(F.exp(F.ln("top") * i / (points - 1)) + 1e-9))).alias("rank")).distinct()
    return ranks.join(F.broadcast(picks), "rank")


def with_shares(counts: DataFrame, cnt: str = "cnt", by: Sequence[str] = ()) -> DataFrame:
    """counts with total and p, each count's share of its group; null is a group too."""
    from .corpus import joined_on

    if by:
        totals = counts.groupBy(*by).agg(F.sum(cnt).alias("total"))
        return joined_on(counts, totals, by).withColumn("p", F.col(cnt) / F.col("total"))
    totals = counts.agg(F.sum(cnt).alias("total")).withColumn("_one", F.lit(1))
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(totals), "_one").drop("_one").withColumn("p", F.col(cnt) / F.col("total"))


def entropy(counts: DataFrame, cnt: str = "cnt", by: Sequence[str] = ()) -> DataFrame:
    """entropy in bits of the used tokens, their number, and the entropy as a percentage of the greatest possible."""
    rows = with_shares(counts.filter(F.col(cnt) > 0), cnt, by).groupBy(*by).agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.count("*").alias("n_used"))
    return rows.select(*by, F.round("h", 6).alias("entropy"), "n_used", F.round(F.when(F.col("n_used") > 1, F.col("h") / F.log2("n_used") * 100), 6).alias("efficiency"))


def entropy_bands(ranks: DataFrame, edges: Sequence[int], cnt: str = "cnt") -> DataFrame:
    """Of bands of ranks (up to each edge, and beyond the last): tokens, and shares of the corpus and of the entropy in percent."""
    band = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        band = F.when(F.col("rank") <= edges[i], i).otherwise(band)
    rows = with_shares(ranks, cnt).withColumn("h", -F.col("p") * F.log2("p")).withColumn("band", band)
    bands = rows.groupBy("band").agg(F.count("*").alias("n_tokens"), F.sum("p").alias("mass"), F.sum("h").alias("h"))
    whole = bands.agg(F.sum("h").alias("all_h")).withColumn("_one", F.lit(1))
    return bands.withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one").select("band", "n_tokens", F.round(F.col("mass") * 100, 6).alias("corpus_pct"), F.round(F.col("h") / F.col("all_h") * 100, 6).alias("entropy_pct"))


def coverage(ranks: DataFrame, thresholds: Sequence[float], cnt: str = "cnt") -> DataFrame:
    """For each threshold in percent the least rank up to which the counts reach it."""
    from .corpus import running_sum

    sums = running_sum(with_shares(ranks, cnt), F.col(cnt), "rank", "upto", exclusive=False)
    wanted = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    return sums.select("rank", "upto", "total", wanted).filter(F.col("upto") >= F.col("threshold") / 100 * F.col("total")).groupBy("threshold").agg(F.min("rank").alias("rank"))


def usage(vocab: DataFrame, counts: DataFrame, token: str = "token", by: Sequence[str] = ()) -> DataFrame:
    """vocab with cnt, 0 where a token wasn't used."""
    return vocab.join(counts, [*by, token], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def length_histogram(tokens: DataFrame, length: Column, cap: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Tokens of each length; with a cap, all from it on together."""
    size = F.least(length, F.lit(cap)) if cap else length
    return tokens.groupBy(*by, size.alias("length")).agg(F.count("*").alias("n_tokens"))


def length_summary(histogram: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, upper median and greatest length, from a histogram and so without sorting the tokens."""
    lengths = Window.partitionBy(*by).orderBy("length")
    rows = histogram.withColumns({"upto": F.sum("n_tokens").over(lengths), "n": F.sum("n_tokens").over(Window.partitionBy(*by))})
    middle = F.min(F.when(F.col("upto") > F.expr("n div 2"), F.col("length")))
    return rows.groupBy(*by).agg(F.round(F.sum(F.col("length") * F.col("n_tokens")) / F.sum("n_tokens"), 6).alias("mean_len"), middle.alias("upper_median"), F.max("length").alias("max_len"))


def against_baseline(rows: DataFrame, name: str, value: str, baseline: str) -> DataFrame:
    """rows with the difference to the one named baseline, absolute and in percent, and its direction."""
    base = rows.filter(F.col(name) == baseline).select(F.col(value).alias("base")).withColumn("_one", F.lit(1))
    both = rows.withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one").drop("_one")
    diff = F.col(value) - F.col("base")
    direction = F.when(diff > 0, "more").when(diff < 0, "fewer").otherwise("same")
    return both.withColumns({"diff": diff, "diff_pct": F.round(diff / F.col("base") * 100, 6), "direction": direction})


def bits_per_byte(loss: Column, size: Column) -> Column:
    return loss / (size * LN2)


def corpus_bpb(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """bpb, weighted by bytes, of rows of loss_nats and num_bytes."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_docs"), F.round(bits_per_byte(F.sum("loss_nats"), F.sum("num_bytes")), 6).alias("bpb"))


def chunk_weighted_loss(rows: DataFrame, loss: str, place: str, by: Sequence[str] = (), chunk: int = 4) -> DataFrame:
    """loss and n: the mean losses of chunks of so many neighbouring rows, weighted by the chunks' rows."""
    chunks = rows.groupBy(*by, F.expr(f"`{place}` div {chunk}").alias("_chunk")).agg(F.avg(loss).alias("_mean"), F.count(loss).alias("_n"))
    return chunks.groupBy(*by).agg(F.round(F.sum(F.col("_mean") * F.col("_n")) / F.sum("_n"), 6).alias("loss"), F.sum("_n").alias("n"))


def bpb_distribution(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    r = lambda c, n: F.round(c, 6).alias(n)
    return rows.groupBy(*by).agg(r(F.avg("bpb"), "bpb_mean"), r(F.stddev_samp("bpb"), "bpb_std"), r(F.min("bpb"), "bpb_min"), r(F.max("bpb"), "bpb_max"))


def perplexities(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """token_ppl, exp of nats a token; and export_ppl, 2 to the power of the rounded bpb, with a shortened ln 2."""
    sums = rows.groupBy(*by).agg(F.sum("loss_nats").alias("l"), F.sum("num_tokens").alias("t"), F.sum("num_bytes").alias("b"))
    bpb = F.round(F.col("l") / (F.col("b") * 0.6931472), 4)
    return sums.select(*by, F.round(F.exp(F.col("l") / F.col("t")), 6).alias("token_ppl"), bpb.alias("bpb4"), F.round(F.pow(F.lit(2.0), bpb), 2).alias("export_ppl"))


def accuracies(rows: DataFrame, sets: Sequence[str], correct: str = "correct") -> DataFrame:
    """Accuracy for each value of each of some columns, and over all, in one pass of grouping sets."""
    found = rows.groupingSets([[F.col(c)] for c in sets] + [[]], *(F.col(c) for c in sets)).agg(F.avg(F.col(correct).cast("int")).alias("a"), F.count("*").alias("n"))
    return found.select(*sets, F.round("a", 6).alias("accuracy"), "n")


def seed_statistics(runs: DataFrame, by: Sequence[str], value: str = "bpb", seed: str = "seed") -> DataFrame:
    """Mean, deviation (0 of a single one), range, number and the seeds' values in order."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seed, value))), lambda x: F.format_string("%.4f", x[value])), ",")
    r = lambda c, n: F.round(c, 6).alias(n)
    return runs.groupBy(*by).agg(r(F.avg(value), "mean"), r(F.coalesce(F.stddev_samp(value), F.lit(0.0)), "std"), r(F.min(value), "min"), r(F.max(value), "max"), F.count("*").alias("n_seeds"), texts.alias("values"))


def incomplete_seeds(stats: DataFrame) -> DataFrame:
    """The groups with fewer seeds than the fullest."""
    most = stats.agg(F.max("n_seeds").alias("most")).withColumn("_one", F.lit(1))
    return stats.withColumn("_one", F.lit(1)).join(F.broadcast(most), "_one").filter("n_seeds < most").drop("_one", "most")
