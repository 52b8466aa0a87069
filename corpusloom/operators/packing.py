"""Packing token streams into sequences, and batching."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .corpus import RANGE, key_ranges, running_sum, shuffle_key

BLOCK = 1 << 16


def document_index(docs: DataFrame, seed: int | None = 42, uid: str = "uid", ids: str = "input_ids") -> DataFrame:
    """uid, start and len of each document in the stream: documents in shuffled order (or by uid), each followed by one end token."""
    rows = docs.select(uid, ids, (F.size(ids) + 1).alias("len"))
    if seed is None:
        return running_sum(rows, F.col("len"), uid, "start")
    keyed = rows.withColumn("_key", shuffle_key(F.col(uid), seed))
    return running_sum(keyed, F.col("len"), "_key", "start", ranges=key_ranges("_key")).drop("_key")


def pack_sequences(docs: DataFrame, seq_len: int = 2048, eos: int = 0, seed: int | None = 42, uid: str = "uid", ids: str = "input_ids") -> DataFrame:
    """seq_id and tokens: the stream cut into blocks of seq_len + 1 tokens; what is left at the end is dropped.

    Documents are not exploded into tokens: each gives a slice to every block it reaches into, and a block joins its few slices.
    """
    size = seq_len + 1
    index = document_index(docs, seed, uid, ids)
    parts = index.withColumn("seq_id", F.explode(F.sequence(F.expr(f"start div {size}"), F.expr(f"(start + len - 1) div {size}"))))
    first = F.greatest(F.lit(0), F.col("seq_id") * size - F.col("start"))
    last = F.least(F.col("len"), (F.col("seq_id") + 1) * size - F.col("start"))
    stream = F.concat(F.col(ids).cast("array<int>"), F.array(F.lit(eos)))
    parts = parts.select("seq_id", "start", F.slice(stream, (first + 1).cast("int"), (last - first).cast("int")).alias("part"))
    blocks = parts.groupBy("seq_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"])).alias("tokens"))
    return blocks.filter(F.size("tokens") == size)


def shuffled_sequences(sequences: DataFrame, seed: int = 42) -> DataFrame:
    """pos and seq_id: the order in which an epoch reads the sequences."""
    keyed = sequences.select("seq_id").withColumn("_key", shuffle_key(F.col("seq_id"), seed))
    return running_sum(keyed, F.lit(1), "_key", "pos", ranges=key_ranges("_key")).select("pos", "seq_id")


def locate(positions: DataFrame, index: DataFrame, block: int = BLOCK) -> DataFrame:
    """positions (pos) with the uid of the document whose range [start, start + len) holds each, and the offset in it.

    A range join by blocks: a document stands in each block it reaches into, and a position looks only into its own.
    """
    blocks = index.select("uid", "start", "len", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + len - 1) div {block}"))).alias("_block"))
    asked = positions.withColumn("_block", F.expr(f"pos div {block}"))
    found = asked.join(blocks, "_block").filter("pos >= start and pos < start + len")
    return found.withColumn("offset", F.col("pos") - F.col("start")).drop("_block", "start", "len")


def batches(sequences: DataFrame, batch_size: int = 32, world: int = 1, rank: int = 0, skip: int = 0, drop_last: bool = True) -> DataFrame:
    """The sequences (pos) of one of world readers with their batch_id, from batch skip on; an incomplete last batch is dropped."""
    own = sequences.filter(F.col("pos") % world == rank).withColumn("batch_id", F.expr(f"pos div {world * batch_size}"))
    own = own.filter(F.col("batch_id") >= skip)
    if not drop_last:
        return own
    return own.withColumn("_n", F.count("*").over(Window.partitionBy("batch_id"))).filter(F.col("_n") == batch_size).drop("_n")


def token_budget_batches(docs: DataFrame, budget: int, ids: str = "input_ids", shard: int = RANGE) -> DataFrame:
    """docs with batch (a number within a shard of lengths) so that the longest of a batch times its rows stays within budget.

    Documents come in descending length, in shards of about so many rows, and a batch ends before the row that would break the budget; a row
    that is longer than the budget is alone. The greedy choice depends on all rows before, so that it is made shard by shard.
    """
    # Only lengths go to Python, whose memory then doesn't depend on the ids; these wait in the JVM. A null counts as no ids and comes last.
    rows = docs.withColumn("_len", F.size(ids))
    last = F.coalesce(F.lit(2_000_000_000) - F.col("_len"), F.lit(2_000_000_001))
    cut = running_sum(rows.withColumn("_order", F.format_string("%010d:%s", last, F.col("uid").cast("string"))), F.lit(1), "_order", "_nth", ranges=(F.substring("_order", 1, 7), F.substring("_order", 1, 10)))
    cut = cut.withColumn("shard", F.expr(f"_nth div {shard}")).drop("_order")

    def fold(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        at, batch, count, longest = None, 0, 0, 0
        for shards, lengths in columns:
            found = []
            for k, n in zip(shards, lengths):
                if k != at:
                    at, batch, count, longest = k, 0, 0, 0
                if count and max(longest, n) * (count + 1) > budget:
                    batch, count, longest = batch + 1, 0, 0
                count, longest = count + 1, max(longest, n)
                found.append(batch)
            yield pd.Series(found, dtype="int32")

    # It depends on the order of rows, so that it must not pass for deterministic: the sort below would be left out where what follows needs none.
    number = F.pandas_udf(fold, "int").asNondeterministic()
    dealt = cut.repartition("shard").sortWithinPartitions("_nth")
    return dealt.withColumn("batch", number("shard", F.coalesce("_len", F.lit(0)))).drop("_len", "_nth")


def left_padded(docs: DataFrame, ids: str = "input_ids", pad: int = 0, by: str = "batch") -> DataFrame:
    """input_ids filled up on the left to the longest of the batch, and a mask of what is real."""
    width = F.max(F.size(ids)).over(Window.partitionBy(by))
    rows = docs.withColumn("_fill", width - F.size(ids))
    return rows.withColumn("mask", F.concat(F.array_repeat(F.lit(0), F.col("_fill")), F.array_repeat(F.lit(1), F.size(ids)))).withColumn(
        ids, F.concat(F.array_repeat(F.lit(pad).cast("int"), F.col("_fill")), F.col(ids))
    ).drop("_fill")


def sliding_windows(docs: DataFrame, window: int = 2048, stride: int = 512, length: str = "n") -> DataFrame:
    """Scoring windows of documents of n ids: start and end of the inputs and new_from, the first target that counts (targets are start + 1 to end).

    Each target 1 to n - 1 counts once. A document that fits one window has one; one of a single id has none.
    """
    n = F.col(length)
    last = n - 1
    starts = F.when(n <= 1, F.array().cast("array<int>")).when(n <= window, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((last - window) / stride) * stride).cast("int"), F.lit(stride)))
    rows = docs.withColumn("start", F.explode(starts)).withColumn("end", F.least(F.col("start") + window, last))
    before = F.when(F.col("start") == 0, 0).otherwise(F.least(F.col("start") - stride + window, last))
    return rows.withColumn("new_from", before + 1)


def iterate(rows: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The rows of batches, dealt again into frames of size rows."""
    held: list[pd.DataFrame] = []
    count = 0
    for frame in rows:
        held.append(frame)
        count += len(frame)
        while count >= size:
            whole = pd.concat(held, ignore_index=True)
            yield whole.iloc[:size]
            held, count = [whole.iloc[size:]], count - size
    if count:
        yield pd.concat(held, ignore_index=True)
