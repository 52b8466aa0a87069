"""Scoring texts with a language model: windows, per-document losses, minimal pairs. Any model can be put in; n-gram models are built in."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iteration import checkpointed
from .statistics import bits_per_byte, word_counts

#: A scorer takes batches of uid, input_ids, start, end and new_from, and gives for each window the loss in nats of its new targets.
Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def unigram_model(pieces: DataFrame, column: str = "pieces") -> DataFrame:
    """word and nats: what each piece costs under counts with one added, and one more for unknown pieces (null)."""
    counts = word_counts(pieces, column)
    totals = counts.agg(F.sum("cnt").alias("n"), F.count("*").alias("v")).withColumn("_one", F.lit(1))
    known = counts.unionByName(totals.select(F.lit(None).cast("string").alias("word"), F.lit(0).cast("long").alias("cnt")))
    return known.withColumn("_one", F.lit(1)).join(F.broadcast(totals), "_one").select("word", (-F.ln((F.col("cnt") + 1) / (F.col("n") + F.col("v") + 1))).alias("nats"))


#: Pieces of at least this share's inverse are broadcast with their costs; as shares add up to 1 at most, there are never more.
HOT = 1 << 16


def with_costs(rows: DataFrame, costs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows with nats of frequent values of key, null for others, by a broadcast of HOT costs at most; and the costs of all others, for a join of what is left."""
    known = costs.filter(F.col(key).isNotNull())
    frequent = F.col("nats") <= math.log(HOT)
    hot = known.filter(frequent).select(F.col(key).alias("_key"), "nats")
    return rows.join(F.broadcast(hot), rows[key] == F.col("_key"), "left").drop("_key"), known.filter(~frequent)


def document_losses(docs: DataFrame, model: DataFrame, column: str = "pieces", skip_first: bool = True) -> DataFrame:
    """uid, num_bytes, num_tokens, loss_nats and bpb. The first piece is not predicted, but its bytes count; documents without bytes or with one piece are left out.

    Frequent pieces get their costs where they stand and are summed up before the shuffle, which only rare ones go through, each once for a document.
    """
    model = checkpointed(model)
    unknown = model.filter("word is null").select(F.col("nats").alias("unknown")).withColumn("_one", F.lit(1))
    sizes = F.octet_length("text").cast("long").alias("num_bytes"), F.size(column).cast("long").alias("num_tokens")
    each = docs.select("uid", *sizes, column).filter("num_bytes > 0 and num_tokens > 1").select("uid", "num_bytes", "num_tokens", F.posexplode(column).alias("pos", "word"))
    each, rare = with_costs(each.filter("pos > 0" if skip_first else "true"), model, "word")
    each = each.select("uid", "num_bytes", "num_tokens", "nats", F.when(F.col("nats").isNull(), F.col("word")).alias("word"))
    of = ["uid", "num_bytes", "num_tokens"]
    sums = each.groupBy(*of, "word").agg(F.sum("nats").alias("_sum"), F.count_if(F.col("nats").isNull()).alias("_n"))
    # Rows of sums meet no rare piece; a second key deals them out.
    sums = sums.withColumn("_salt", F.when(F.col("_n") == 0, F.xxhash64("uid").bitwiseOR(1)).otherwise(0)).withColumn("word", F.coalesce("word", F.lit("")))
    met = sums.join(rare.select("word", "nats").withColumn("_salt", F.lit(0).cast("long")), ["word", "_salt"], "left").withColumn("_one", F.lit(1)).join(F.broadcast(unknown), "_one")
    cost = F.when(F.col("_n") > 0, F.col("_n") * F.coalesce("nats", "unknown")).otherwise(F.col("_sum"))
    rows = met.groupBy(*of).agg(F.sum(cost).alias("loss_nats"))
    return rows.select("uid", "num_bytes", "num_tokens", "loss_nats", bits_per_byte(F.col("loss_nats"), F.col("num_bytes")).alias("bpb"))


def windowed_losses(windows: DataFrame, scorer: Scorer) -> DataFrame:
    """uid and loss_nats: the sum over windows (uid, input_ids, start, end, new_from) of what a scorer gives."""
    needed = windows.select("uid", "input_ids", "start", "end", "new_from")
    return needed.mapInPandas(scorer, "uid long, loss double").groupBy("uid").agg(F.sum("loss").alias("loss_nats"))


def unigram_scorer(costs: dict[int, float], unknown: float) -> Scorer:
    """A scorer from a table of costs by id; its size is that of a vocabulary."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            loss = [sum(costs.get(int(t), unknown) for t in ids[a : b + 1]) for ids, a, b in zip(rows["input_ids"], rows["new_from"], rows["end"], strict=True)]
            yield pd.DataFrame({"uid": rows["uid"], "loss": loss})

    return score


def token_logprobs(docs: DataFrame, costs: dict[int, float], unknown: float) -> DataFrame:
    """uid, token_ids and token_logprobs: 0 for the first token, which isn't predicted."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            probs = [[0.0, *(-costs.get(int(t), unknown) for t in ids[1:])] if len(ids) else [] for ids in rows["input_ids"]]
            yield pd.DataFrame({"uid": rows["uid"], "token_ids": rows["input_ids"], "token_logprobs": probs})

    return docs.select("uid", "input_ids").mapInPandas(score, "uid long, token_ids array<int>, token_logprobs array<double>")


def joined_logprobs(docs: DataFrame, costs: DataFrame) -> DataFrame:
    """uid, token_id, place and logprob of each predicted token, from a table of costs (token_id, nats; null for unknown ones). The first token isn't predicted, and has 0."""
    costs = checkpointed(costs)
    unknown = costs.filter("token_id is null").select(F.col("nats").alias("unknown")).withColumn("_one", F.lit(1))
    # Frequent tokens, which would meet in a few tasks, get their costs by a broadcast; a second key deals them out when rare ones are joined.
    each, rare = with_costs(docs.select("uid", F.posexplode("input_ids").alias("place", "token_id")), costs, "token_id")
    each = each.withColumnRenamed("nats", "_nats").withColumn("_salt", F.when(F.col("_nats").isNull(), 0).otherwise(F.xxhash64("uid", "place").bitwiseOR(1)))
    each = each.join(rare.select("token_id", "nats").withColumn("_salt", F.lit(0).cast("long")), ["token_id", "_salt"], "left")
    each = each.withColumn("_one", F.lit(1)).join(F.broadcast(unknown), "_one")
    return each.select("uid", "token_id", "place", F.when(F.col("place") == 0, 0.0).otherwise(-F.coalesce("_nats", "nats", "unknown")).alias("logprob"))


def window_logprobs(docs: DataFrame, costs: DataFrame, window: int = 2048, stride: int = 512) -> DataFrame:
    """uid, token_ids and token_logprobs of documents that are scored in windows: each token is taken from the window that first predicts it."""
    from .packing import sliding_windows

    each = joined_logprobs(docs, costs)
    spans = sliding_windows(docs.select("uid", F.size("input_ids").alias("n")), window, stride).select("uid", "start", "new_from", F.col("end").alias("upto"))
    scored = each.join(spans, "uid").filter("place >= new_from and place <= upto or place = 0 and start = 0")
    rows = scored.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("place", "token_id", "logprob"))).alias("all"))
    return rows.select("uid", F.col("all.token_id").alias("token_ids"), F.col("all.logprob").alias("token_logprobs"))


def settings_accuracy(settings: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """setting, correct and the other columns of each setting's rows; and why settings failed, which are skipped."""
    found, failed = None, {}
    for name, make in settings.items():
        try:
            rows = make().withColumn("setting", F.lit(name))
            rows.schema, rows.limit(1).count()
            found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
        except Exception as error:  # noqa: BLE001  whatever a setting's source or model raises
            failed[name] = f"{type(error).__name__}: {error}".splitlines()[0]
    return found, failed


def token_statistics(logprobs: DataFrame) -> DataFrame:
    """For each token: mean, deviation, number and sum of its log-probabilities."""
    each = logprobs.select(F.explode(F.arrays_zip("token_ids", "token_logprobs")).alias("t")).select(F.col("t.token_ids").alias("token_id"), F.col("t.token_logprobs").alias("p"))
    return each.groupBy("token_id").agg(F.avg("p").alias("mean"), F.stddev_samp("p").alias("std"), F.count("*").alias("n"), F.sum("p").alias("total"))


def sentence_logprobs(sentences: DataFrame, model: DataFrame, column: str = "pieces") -> DataFrame:
    """uid and logprob of each sentence; minus infinity with one piece or none."""
    losses = document_losses(sentences, model, column)
    return sentences.select("uid").join(losses.select("uid", (-F.col("loss_nats")).alias("logprob")), "uid", "left").withColumn("logprob", F.coalesce("logprob", F.lit(float("-inf"))))


def pair_accuracy(pairs: DataFrame) -> DataFrame:
    """pairs with correct: whether the good sentence is strictly likelier."""
    return pairs.withColumn("correct", F.col("logprob_good") > F.col("logprob_bad"))


def steps_for_budget(tokens: int, sequences: int = 128, length: int = 2048) -> int:
    """Training steps that a token budget pays for."""
    return tokens // (sequences * length)


def learning_rates(spark, steps: int, peak: float, warmup: int, decay: int) -> DataFrame:
    """step and lr: linear warm-up, a plateau, and a linear end."""
    step = F.col("step")
    rate = F.when(step < warmup, (step + 1) / max(1, warmup)).when(step >= steps - decay, (steps - step) / max(1, decay)).otherwise(F.lit(1.0))
    return spark.range(steps).withColumnRenamed("id", "step").withColumn("lr", rate * peak)


def launch_grid(spark, **axes: Sequence) -> DataFrame:
    """Every combination of a few settings, with its number."""
    import itertools

    names = list(axes)
    rows = [(i, *map(str, c)) for i, c in enumerate(itertools.product(*axes.values()))]
    return spark.createDataFrame(rows, ", ".join(["job int", *(f"{n} string" for n in names)]))
