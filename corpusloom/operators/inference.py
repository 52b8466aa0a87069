"""Bootstrap intervals and regression discontinuities."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import dense_uid
from .iteration import checkpointed
from .statistics import LN2


def draw(replicate: Column, i: Column, n: Column) -> Column:
    """The index that replicate b draws i-th: the first twelve hex digits of md5(b:i), modulo n."""
    digits = F.substring(F.md5(F.concat_ws(":", replicate.cast("string"), i.cast("string"))), 1, 12)
    return F.conv(digits, 16, 10).cast("long") % n


#: Parts into which the replicates are dealt, and places of documents whose values a task holds at a time: 32 bytes each with four values.
PARTS, HELD = 48, 1 << 22
#: Draws made at a time, whose arrays stay in a processor's cache.
STEP = 8_192
_SHIFTS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]])
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)


def _md5_heads(words: list[np.ndarray]) -> np.ndarray:
    """The first twelve hex digits of the md5 of many messages of one block each, as numbers: words are their 16 32-bit words."""
    a0, b0, c0, d0 = (np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    a, b, c, d = a0, b0, c0, d0
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + a + _SINES[i] + words[g]
        left = _SHIFTS[i // 16, i % 4]
        a, d, c, b = d, c, b, b + (f << np.uint32(left) | f >> np.uint32(32 - left))
    first, second = (a + a0).byteswap().astype(np.int64), (b + b0).byteswap().astype(np.int64)
    return first << 16 | second >> 16


def draws_of(replicates: Sequence[int], first: int, upto: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """replicate and the indices that it draws first-th to upto-th (without), as draw() says; places of equally many digits at a time, and few enough for the cache."""
    with np.errstate(over="ignore"):
        while first < upto:
            digits = len(str(first))
            end = min(upto, first + STEP, 10**digits)
            places = np.arange(first, end, dtype=np.int64)
            for size in {len(str(b)) for b in replicates}:
                # Messages are "b:i", a bit, zeros and the length in bits; only the bytes of b differ from one replicate to the next.
                block = np.zeros((len(places), 64), np.uint8)
                block[:, size] = ord(":")
                for k in range(digits):
                    block[:, size + digits - k] = places // 10**k % 10 + 48
                block[:, size + 1 + digits] = 0x80
                block[:, 56:58] = np.array([8 * (size + 1 + digits)], "<u2").view(np.uint8)
                own = [np.ascontiguousarray(x) for x in block.view("<u4").T]
                for b in replicates:
                    if len(str(b)) == size:
                        name = np.frombuffer(str(b).encode().ljust((size + 3) // 4 * 4, b"\0"), "<u4")
                        yield b, _md5_heads([x | name[k] if k < len(name) else x for k, x in enumerate(own)]) % n
            first = end


def _resampled(rows: DataFrame, replicates: int, values: list[str], order: str = "uid") -> DataFrame:
    """replicate and the sum of each of values over as many documents as there are, drawn with replacement.

    Each document's place draws once for each replicate. Replicates are dealt into parts, and each part gets the values of all documents by their places, so that a draw
    looks its document up in an array and none is shuffled. Where there are more than HELD documents a task takes those of so many places, and the draws that fall on them.
    """
    placed = checkpointed(dense_uid(rows.select(order, *values), order, name="_i"))
    n = placed.count()
    parts = min(PARTS, replicates)

    def run(key: tuple[int, int], held: pd.DataFrame) -> pd.DataFrame:
        part, base = key[0], key[1] * HELD
        at = held["_i"].to_numpy() - base
        size = min(HELD, n - base)
        tables = []
        for v in values:
            table = np.zeros(size, np.float64)
            table[at] = held[v].to_numpy(np.float64, na_value=0.0)
            tables.append(table)
        mine = range(part, replicates, parts)
        sums = {b: [0.0] * len(values) for b in mine}
        for b, found in draws_of(mine, 0, n, n):
            if size < n:
                found = found[(found >= base) & (found < base + size)] - base
            for k, table in enumerate(tables):
                sums[b][k] += float(table[found].sum())
        return pd.DataFrame([(b, *x) for b, x in sums.items()], columns=["replicate", *values])

    each = placed.select("_i", *values).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("_held", F.expr(f"_i div {HELD}"))
    schema = ", ".join(["replicate int", *(f"`{v}` double" for v in values)])
    return each.groupBy("_part", "_held").applyInPandas(run, schema).groupBy("replicate").agg(*(F.sum(v).alias(v) for v in values))


def poisson_weight(replicate: Column, uid: Column, most: int = 12) -> Column:
    """How often a replicate takes a document: a number drawn from Poisson's law of mean 1, by the hash of both; larger ones than most have chances below 1e-9."""
    uniform = (F.shiftrightunsigned(F.xxhash64(uid, replicate), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    share, upto, weight = math.exp(-1), 0.0, F.lit(0)
    for k in range(most):
        upto += share
        share /= k + 1
        weight = weight + (uniform > upto).cast("int")
    return weight


def _weighted(rows: DataFrame, replicates: int, values: list[str], order: str = "uid") -> DataFrame:
    """replicate and the sum of each of values, each document taken as often as poisson_weight() says.

    What a document gives to the replicates is summed up where it stands, so that only sums are shuffled, a row for each replicate and task.
    """
    each = rows.select(order, *values, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    weight = poisson_weight(F.col("replicate"), F.col(order))
    return each.withColumn("_w", weight).filter("_w > 0").groupBy("replicate").agg(*(F.sum(F.col(v) * F.col("_w")).alias(v) for v in values))


RESAMPLERS = {"poisson": _weighted, "md5": _resampled}


def bootstrap(rows: DataFrame, replicates: int = 10_000, alpha: float = 0.025, model: str = "model", draws: str = "poisson") -> DataFrame:
    """model, n_docs, bpb, bpb_std, ci_low and ci_high of the corpus bpb of rows (uid, loss_nats, num_bytes).

    draws: poisson, which scales with the documents; or md5, by which any engine can draw the same documents, at the price of a digest for each draw.
    """
    rows = checkpointed(rows.select("uid", "loss_nats", "num_bytes"))  # a few numbers for each document, which are read again and again
    whole = rows.agg(F.count("*").alias("n_docs"), (F.sum("loss_nats") / (F.sum("num_bytes") * LN2)).alias("bpb"))
    each = RESAMPLERS[draws](rows, replicates, ["loss_nats", "num_bytes"]).select((F.col("loss_nats") / (F.col("num_bytes") * LN2)).alias("b"))
    q = F.percentile("b", F.array(F.lit(alpha), F.lit(1 - alpha)))
    spread = each.agg(F.round(F.stddev_samp("b"), 6).alias("bpb_std"), F.round(q[0], 6).alias("ci_low"), F.round(q[1], 6).alias("ci_high"))
    both = whole.withColumn("_one", F.lit(1)).join(F.broadcast(spread.withColumn("_one", F.lit(1))), "_one")
    return both.select(F.lit(model).alias("model"), "n_docs", F.round("bpb", 6).alias("bpb"), "bpb_std", "ci_low", "ci_high")


def paired_bootstrap(a: DataFrame, b: DataFrame, replicates: int = 10_000, alpha: float = 0.025, names: tuple[str, str] = ("a", "b"), draws: str = "poisson") -> DataFrame:
    """The difference of two models' corpus bpb on their common documents, whose draws both share.

    significant: the interval is on one side of 0. p_boot: twice the smaller share of differences above 0 and of the others. No common document is an error.
    """
    both = a.select("uid", "loss_nats", "num_bytes").join(b.select("uid", F.col("loss_nats").alias("loss_b"), F.col("num_bytes").alias("bytes_b")), "uid")
    both = checkpointed(both)
    if both.isEmpty():
        raise ValueError("the models have no document in common")
    delta = (F.sum("loss_nats") / (F.sum("num_bytes") * LN2)) - (F.sum("loss_b") / (F.sum("bytes_b") * LN2))
    whole = both.agg(F.count("*").alias("n_docs"), F.round(delta, 6).alias("delta_bpb"))
    sums = RESAMPLERS[draws](both, replicates, ["loss_nats", "num_bytes", "loss_b", "bytes_b"])
    each = sums.select((F.col("loss_nats") / (F.col("num_bytes") * LN2) - F.col("loss_b") / (F.col("bytes_b") * LN2)).alias("d"))
    q = F.percentile("d", F.array(F.lit(alpha), F.lit(1 - alpha)))
    spread = each.agg(q[0].alias("lo"), q[1].alias("hi"), F.avg((F.col("d") > 0).cast("int")).alias("above"))
    rows = whole.withColumn("_one", F.lit(1)).join(F.broadcast(spread.withColumn("_one", F.lit(1))), "_one")
    return rows.select(
        F.lit(names[0]).alias("model_a"), F.lit(names[1]).alias("model_b"), "n_docs", "delta_bpb", F.round("lo", 6).alias("ci_low"), F.round("hi", 6).alias("ci_high"),
        ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("significant"), F.round(2 * F.least(F.col("above"), 1 - F.col("above")), 6).alias("p_boot"),
    )


def pairs_of_models(rows: DataFrame, name: str = "model", baseline: str | None = None) -> DataFrame:
    """a and b: every unordered pair of names, or each with the single one that holds baseline."""
    names = sorted(r[0] for r in rows.select(name).distinct().collect())
    if baseline is not None:
        matching = [x for x in names if baseline in x]
        if len(matching) != 1:
            raise ValueError(f"{len(matching)} models match {baseline}: {', '.join(matching)}")
        pairs = [(x, matching[0]) for x in names if x != matching[0]]
    else:
        pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]
    return rows.sparkSession.createDataFrame(pairs, "a string, b string")


def kernel_weights(rows: DataFrame, order: str, cutoff: float, bandwidth: float, kernel: str = "triangular") -> DataFrame:
    """The rows within bandwidth of cutoff, with running (order minus cutoff), treated (before it) and weight."""
    r = F.col(order) - F.lit(cutoff)
    weight = F.lit(1.0) if kernel != "triangular" else 1 - F.abs(F.col("running")) / bandwidth
    kept = rows.withColumn("running", r).filter(F.abs("running") <= bandwidth)
    return kept.withColumns({"treated": (F.col("running") < 0).cast("int"), "weight": weight})


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 500):
        step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / (1 + step * d), 1 + step / c
        total *= d * c
        step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / (1 + step * d), 1 + step / c
        total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * total


def t_two_sided(t: float, df: float) -> float:
    return _incomplete_beta(df / 2, 0.5, df / (df + t * t))


def discontinuity(rows: DataFrame, y: str, by: tuple[str, ...] = (), least: int = 10) -> DataFrame:
    """effect, se, t, p, ci_low, ci_high, r2 and n of weighted lines on both sides of the cutoff (rows of kernel_weights()).

    The model has a line of its own on either side, so that the effect is the difference of their values at the cutoff; all follows from one pass of
    weighted sums for each side. Groups with fewer rows than least have nulls.
    """
    w, x, v = F.col("weight"), F.col("running"), F.col(y)
    sums = {"sw": w, "sx": w * x, "sy": w * v, "sxx": w * x * x, "sxy": w * x * v, "syy": w * v * v}
    sides = rows.groupBy(*by, "treated").agg(F.count("*").alias("n"), *(F.sum(c).alias(n) for n, c in sums.items()))
    det = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / det
    sides = sides.withColumns({"slope": slope, "at0": F.col("sxx") / det}).withColumn("icept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("sw"))
    sides = sides.withColumn("rss", F.col("syy") - F.col("icept") * F.col("sy") - F.col("slope") * F.col("sxy"))
    side = lambda c, t: F.sum(F.when(F.col("treated") == t, F.col(c)))
    both = sides.groupBy(*by).agg((side("icept", 1) - side("icept", 0)).alias("effect"), F.sum("at0").alias("v"), F.sum("rss").alias("rss"), F.sum("n").alias("n"), (F.sum("syy") - F.sum("sy") * F.sum("sy") / F.sum("sw")).alias("tss"))
    both = both.withColumn("se", F.sqrt(F.col("rss") / (F.col("n") - 4) * F.col("v"))).withColumn("t", F.col("effect") / F.col("se"))

    def p_values(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 4 else t_two_sided(float(a), float(b) - 4) for a, b in zip(t, n, strict=True)], dtype="float64")

    p_values.__annotations__ = {"t": pd.Series, "n": pd.Series, "return": pd.Series}
    r = lambda c: F.round(F.when(F.col("n") >= least, c), 6)
    e, s = F.col("effect"), F.col("se")
    return both.select(*by, r(e).alias("effect"), r(s).alias("se"), r(F.col("t")).alias("t"), r(F.pandas_udf(p_values, "double")("t", "n")).alias("p"), r(e - 1.96 * s).alias("ci_low"), r(e + 1.96 * s).alias("ci_high"), r(1 - F.col("rss") / F.col("tss")).alias("r2"), "n")


def compared_models(statistics: DataFrame, merges: DataFrame, y: str, cutoff: float, bandwidth: float, model: str = "model", least: int = 10) -> DataFrame:
    """model, effect, se, t, p, ci_low, ci_high, r2, n and error: the discontinuity at a place in the order of merges, for each model's statistics of tokens.

    statistics: model, token_id and y; merges: token_id and rank. A model with fewer than least tokens near the cutoff has a row with an error.
    """
    rows = kernel_weights(statistics.join(merges.select("token_id", "rank"), "token_id"), "rank", cutoff, bandwidth)
    names = statistics.select(model).distinct()
    found = names.join(discontinuity(rows, y, (model,), least), model, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.withColumn("error", F.when(F.col("n") < least, F.concat(F.lit(f"fewer than {least} tokens near the cutoff: "), F.col("n"))))
