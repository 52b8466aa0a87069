"""Comparing vocabularies, merges and usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iteration import checkpointed



def overlap_matrix(vocab: DataFrame, name: str = "name", token: str = "token") -> DataFrame:
    """a, b, shared and pct: the share of a's tokens that b has, for all ordered pairs of names.

    Tokens are joined with themselves by equality; the few names give the pairs that share nothing.
    """
    rows = vocab.select(name, token).distinct()
    sizes = rows.groupBy(name).agg(F.count("*").alias("size"))
    left, right = rows.select(F.col(name).alias("a"), token), rows.select(F.col(name).alias("b"), token)
    shared = left.join(right, token).groupBy("a", "b").agg(F.count("*").alias("shared"))
    names = sizes.agg(F.collect_list(name).alias("all"))
    pairs = sizes.select(F.col(name).alias("a"), "size").withColumn("_one", F.lit(1)).join(F.broadcast(names.withColumn("_one", F.lit(1))), "_one")
    pairs = pairs.select("a", "size", F.explode("all").alias("b"))
    found = pairs.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return found.select("a", "b", "shared", F.round(F.col("shared") / F.col("size") * 100, 6).alias("pct"))


def unique_tokens(vocab: DataFrame, name: str = "name", token: str = "token") -> DataFrame:
    """Tokens that one name alone has."""
    return vocab.groupBy(token).agg(F.count_distinct(name).alias("_n"), F.min(name).alias(name)).filter("_n = 1").drop("_n")


def shared_by_all(vocab: DataFrame, name: str = "name", token: str = "token") -> DataFrame:
    """Tokens that every name has."""
    total = vocab.agg(F.count_distinct(name).alias("_all")).withColumn("_one", F.lit(1))
    counts = vocab.groupBy(token).agg(F.count_distinct(name).alias("_n")).withColumn("_one", F.lit(1))
    return counts.join(F.broadcast(total), "_one").filter("_n = _all").select(token)


def longest(tokens: DataFrame, n: int, token: str = "token", by: Sequence[str] = ()) -> DataFrame:
    """The n longest tokens, ties in their order."""
    if not by:
        return tokens.orderBy(F.desc(F.length(token)), token).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.length(token)), token))
    return tokens.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def first_occurrences(tokens: DataFrame, token: str = "token", order: str = "pos") -> DataFrame:
    """Each token at its first place."""
    return tokens.groupBy(token).agg(F.min(order).alias(order))


def merge_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """shared, only_a and only_b: merges (left, right) of two lists."""
    keys = ["left", "right"]
    both = a.select(*keys, F.lit(True).alias("in_a")).join(b.select(*keys, F.lit(True).alias("in_b")), keys, "full_outer")
    found, missing = F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), lambda c: F.col(c).isNull()
    return both.agg(F.count_if(found).alias("shared"), F.count_if(missing("in_b")).alias("only_a"), F.count_if(missing("in_a")).alias("only_b"))


def rank_agreement(a: DataFrame, b: DataFrame, window: int) -> DataFrame:
    """Of the first window merges of a that b has too: how many, at the same rank, within 10, within 100, and the mean difference."""
    keys = ["left", "right"]
    both = a.filter(F.col("rank") < window).select(*keys, F.col("rank").alias("ra")).join(b.select(*keys, F.col("rank").alias("rb")), keys)
    d = F.abs(F.col("ra") - F.col("rb"))
    return both.agg(F.count("*").alias("shared"), F.count_if(d == 0).alias("same"), F.count_if(d <= 10).alias("within_10"), F.count_if(d <= 100).alias("within_100"), F.round(F.avg(d), 6).alias("mean_diff"))


def side_by_side(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """The i-th merges of both lists, with a dash where one has none."""
    show = lambda df, name: df.filter(F.col("rank") < n).select("rank", F.concat("left", F.lit(" "), "right").alias(name))
    return show(a, "a").join(show(b, "b"), "rank", "full_outer").select("rank", F.coalesce("a", F.lit("-")).alias("a"), F.coalesce("b", F.lit("-")).alias("b"))


def first_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """The first rank at which the lists differ; null if they don't."""
    pair = lambda df, name: df.select("rank", F.struct("left", "right").alias(name))
    both = pair(a, "a").join(pair(b, "b"), "rank", "full_outer")
    return both.agg(F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("rank"))).alias("rank"))


def absorptions(merges: DataFrame) -> DataFrame:
    """token, created and absorbed: for each token that a merge makes, the first later merge that takes it up, or null."""
    made = merges.groupBy(F.col("result").alias("token")).agg(F.min("rank").alias("created"))
    used = merges.select(F.col("left").alias("token"), F.col("rank").alias("at")).unionByName(merges.select(F.col("right").alias("token"), F.col("rank").alias("at")))
    # No merge makes a single character; those are most of what is taken up, all in a few hands.
    met = made.join(used.filter(F.length("token") > 1), "token", "left")
    return met.groupBy("token", "created").agg(F.min(F.when(F.col("at") > F.col("created"), F.col("at"))).alias("absorbed"))


def absorbed_anywhere(merges: DataFrame) -> DataFrame:
    """Tokens that one merge makes and any merge takes up, whatever the order."""
    parts = merges.select(F.col("left").alias("token")).unionByName(merges.select(F.col("right").alias("token")))
    return merges.select(F.col("result").alias("token")).distinct().join(parts, "token", "left_semi")


def absorbed_by_length(absorbed: DataFrame, least: Sequence[int] = (0, 3, 5, 10)) -> DataFrame:
    """For each least length: how many tokens are made, how many of them are absorbed, and the percentage."""
    rows = absorbed.select(F.length("token").alias("n"), F.col("absorbed").isNotNull().alias("gone"), F.explode(F.array(*(F.lit(x) for x in least))).alias("least"))
    found = rows.filter("n >= least").groupBy("least").agg(F.count("*").alias("made"), F.count_if("gone").alias("absorbed"))
    return found.withColumn("pct", F.round(F.col("absorbed") / F.col("made") * 100, 6))


def merge_chains(merges: DataFrame, most: int | None = None) -> DataFrame:
    """start, end and length of the longest chains: each token leads to the result of the first later merge that absorbs it; with most, the longest ones.

    By pointer jumping: after each round the pointers reach twice as far, so that rounds grow with the logarithm of the longest chain. Each round is
    checkpointed, so that plans don't grow. A chain whose start another token leads to is no longest one.
    """
    results = merges.select(F.col("rank").alias("absorbed"), F.col("result").alias("next"))
    steps = checkpointed(absorptions(merges).join(results, "absorbed", "left").select("token", "next"))
    jumps = checkpointed(steps.select("token", F.coalesce("next", "token").alias("end"), F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("long").alias("length")))
    total = jumps.agg(F.sum("length")).first()[0]
    while total:
        on = jumps.select(F.col("token").alias("end"), F.col("end").alias("far"), F.col("length").alias("more"))
        jumps = checkpointed(jumps.join(on, "end").select("token", F.col("far").alias("end"), (F.col("length") + F.col("more")).alias("length")))
        # The numbers of steps stop to grow when every pointer is at an end.
        before, total = total, jumps.agg(F.sum("length")).first()[0]
        if before == total:
            break
    starts = jumps.join(steps.filter("next is not null").select(F.col("next").alias("token")), "token", "left_anti")
    found = starts.filter("length > 0").select(F.col("token").alias("start"), "end", "length")
    return found if most is None else found.orderBy(F.desc("length"), "start").limit(most)


def used_absorbed(absorbed: DataFrame, counts: DataFrame, most: int = 10, token: str = "token") -> DataFrame:
    """Absorbed tokens (rows of absorptions()) with how often they are used all the same: the most used ones."""
    gone = absorbed.filter(F.col("absorbed").isNotNull())
    return gone.join(counts, token).orderBy(F.desc("cnt"), token).limit(most)


def with_merges(statistics: DataFrame, merges: DataFrame, key: str = "token_id") -> DataFrame:
    """Statistics of tokens with the merges that made them; tokens that none made are left out."""
    return statistics.join(merges, key)


def apply_merge(words: DataFrame, left: str, right: str) -> DataFrame:
    """words (syms, cnt) with each occurrence of the pair merged, from the left and without overlap."""
    # Symbols are delimited by a character that none of them has; the look-ahead leaves the delimiter for the next symbol.
    import re

    d = "\u001f"
    pattern = f"(?<={d}){re.escape(left)}{d}{re.escape(right)}(?={d})"
    joined = F.concat(F.lit(d), F.array_join("syms", d), F.lit(d))
    merged = F.regexp_replace(joined, pattern, re.sub(r"([\\$])", r"\\\1", left + right))
    return words.withColumn("syms", F.filter(F.split(merged, d), lambda s: s != ""))


def prune_candidates(scored: DataFrame, key: str, k: int, protected: str = "protected", token: str = "id") -> DataFrame:
    """The k tokens with the least key that aren't protected; ties by id."""
    return scored.filter(~F.col(protected)).orderBy(key, token).limit(k)


def keep_best(scored: DataFrame, loss: str, k: int, token: str = "id") -> DataFrame:
    return scored.orderBy(F.desc(loss), token).limit(k)


def word_level_vocab(words: DataFrame, size: int, min_frequency: int = 0, specials: Sequence[str] = ()) -> DataFrame:
    """id and token: specials first, then words by descending count and name."""
    from .statistics import ranked

    kept = ranked(words.filter(F.col("cnt") >= min_frequency), "word").filter(F.col("rank") <= size - len(specials))
    rows = kept.select((F.col("rank") - 1 + len(specials)).cast("int").alias("id"), F.col("word").alias("token"))
    if not specials:
        return rows
    first = words.sparkSession.createDataFrame(list(enumerate(specials)), "id int, token string")
    return first.unionByName(rows)


def seed_substrings(words: DataFrame, longest_piece: int = 16, least: int = 2) -> DataFrame:
    """piece, occurrences and score (occurrences times length) of frequent substrings of the distinct words.

    Only those stay that at least two different characters follow; the end of a word counts as one.
    """
    rows = words.select(F.concat("word", F.lit("\u0000")).alias("w"), F.length("word").alias("n"))
    starts = rows.select("w", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    sizes = F.expr(f"if(least({longest_piece}, n - i + 1) >= 2, sequence(2, least({longest_piece}, n - i + 1)), array())")
    parts = starts.select("w", "i", F.explode(sizes).alias("k"))
    parts = parts.select(F.substring("w", F.col("i"), F.col("k")).alias("piece"), F.substring("w", F.col("i") + F.col("k"), F.lit(1)).alias("follow"))
    found = parts.groupBy("piece").agg(F.count("*").alias("occurrences"), F.min("follow").alias("lo"), F.max("follow").alias("hi"))
    found = found.filter((F.col("occurrences") >= least) & (F.col("lo") != F.col("hi")))
    return found.select("piece", "occurrences", (F.col("occurrences") * F.length("piece")).alias("score"))


