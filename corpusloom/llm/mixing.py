"""Mixing sources to target weights: blocks of words drawn by multinomial counts and pseudorandom permutations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import mix
from .common import slices, written
from .words import text_bytes, word_spans

#: A plan is made for so many sources at most; more are no sources, and an error.
MOST_SOURCES = 100_000
#: Slots of an output shard, on average.
SHARD_SLOTS = 65_536
#: Rows of a source between which prefix sums are kept.
RANGE_ROWS = 4_096
BLOCK_WORDS = 64


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    rows: int
    target: float
    blocks: int
    slots: int


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Shares of the sum of sizes by weight; a target stops at most times its size, and the excess is shared by weight among the others, until none is above."""
    left, found, free = float(sum(sizes)), [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n]
    while free:
        total = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not above:
            for i in free:
                found[i] = left * weights[i] / total
            break
        for i in above:
            found[i] = most * sizes[i]
        left -= sum(found[i] for i in above)
        free = [i for i in free if i not in set(above)]
    return found


def plan_sources(totals: list[tuple[str | None, int, int]], weights: Sequence[float], most: float, block: int) -> list[Source]:
    """The sources by code point, null last, with weights in turn. slots: how many blocks the mix takes; no more than most times each block."""
    totals = sorted(totals, key=lambda r: (r[0] is None, r[0] or ""))
    goal = targets([n for _, n, _ in totals], [weights[i % len(weights)] for i in range(len(totals))], most)
    found = []
    for (name, size, rows), target in zip(totals, goal, strict=True):
        blocks = -(-size // block)
        found.append(Source(name, size, rows, target, blocks, min(round(target * blocks / size), int(most * blocks)) if size else 0))
    return found


def draw_counts(slots: int, shards: int, key: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """The shards that a source gives slots to, and how many: a multinomial draw of all its slots over the shards, so that it gives exactly its slots."""
    rng = np.random.default_rng(list(key))
    if slots < shards:
        return np.unique(rng.integers(0, shards, slots), return_counts=True)
    counts = rng.multinomial(slots, np.full(shards, 1 / shards))
    some = np.flatnonzero(counts)
    return some, counts[some]


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 to n - 1 under key: four Feistel rounds over the next power of four, again for values beyond n."""
    half = max(1, -(-(int(n - 1).bit_length()) // 2))
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & low
        for k in keys:
            a, b = b, a ^ (mix(b + k) & low)
        return a << np.uint64(half) | b

    value = once(index.astype(np.uint64))
    while (beyond := value >= n).any():
        value[beyond] = once(value[beyond])
    return value.astype(np.int64)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words (0 of a null text) and a hash of the text for each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                first = word_spans(*text_bytes(part.column("text")))[2]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(np.diff(first), pa.int64()), part.column("tie")], ["doc_id", "source", "size", "tie"])

    rows = docs.select("doc_id", "source", "text", F.xxhash64("text", "doc_id").alias("tie"))
    return rows.mapInArrow(count, "doc_id long, source string, size long, tie long")


@dataclass(frozen=True)
class Mixture:
    #: a row for each document: doc_id, source, size, tie, source_no, and start, the place of its first word among its source's
    documents: DataFrame
    #: a row for each part of a document in a slot: shard, slot (numbers by which a shard's slots are ordered), source_no, epoch, block, start (the document's), word (the part's first) and n_words
    parts: DataFrame
    sources: list[Source]


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, block: int = BLOCK_WORDS, seed: int = 0) -> Mixture:
    """Mix the columns doc_id, text and source to targets(); no block, and so no word, is taken more than most times.

    The words of a source's documents, in an order by hash, are packed into blocks. In a task for each source draw_counts() deals its slots out to the output
    shards. The k-th slot of a source takes block permuted(k mod blocks) of its epoch, k div blocks, and joins the documents' parts by that index.

    Null texts have no words; null is a source; repeated rows are documents of their own, each with its place; other columns are ignored; an empty table gives no rows.
    Only a row for each source is gathered.
    """
    spark = docs.sparkSession
    rows = written(sized(docs))
    totals = [(r["source"], r["size"], r["rows"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).limit(MOST_SOURCES + 1).collect()]
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sources = plan_sources(totals, weights, most, block)
    numbers = spark.createDataFrame([(s.name, i, -(-s.rows // RANGE_ROWS)) for i, s in enumerate(sources)], "name string, source_no int, ranges int")

    # Prefix sums in two levels: of the ranges of a source, and within a range.
    ranged = rows.join(F.broadcast(numbers), rows["source"].eqNullSafe(numbers["name"])).withColumn("range", F.pmod(F.xxhash64("tie", F.lit(seed)), "ranges")).drop("name", "ranges")
    before = Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("source_no", "range").agg(F.sum("size").alias("words")).select("source_no", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_no", "range").orderBy("tie", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(bases, ["source_no", "range"])
    documents = written(placed.select("doc_id", "source", "size", "tie", "source_no", (F.col("base") + F.col("inner")).alias("start")))

    last = F.expr(f"(start + size - 1) div {block}")
    blocks = documents.filter("size > 0").select("source_no", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), last)).alias("block"))
    begin = F.greatest("start", F.col("block") * block)
    blocks = blocks.select("source_no", "block", "start", (begin - F.col("start")).alias("word"), (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - begin).alias("n_words"))

    total = sum(s.slots for s in sources)
    shards, tasks = max(1, -(-total // SHARD_SLOTS)), max(1, min(-(-total // SHARD_SLOTS), 4096))
    facts = [(i, s.slots, s.blocks) for i, s in enumerate(sources) if s.slots]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, n = draw_counts(row["slots"], shards, [seed, row["source_no"]])
                given = np.cumsum(n) - n
                for i in range(0, len(n), SHARD_SLOTS):
                    j = slice(i, i + SHARD_SLOTS)
                    same = [np.full(len(n[j]), row[c]) for c in ("source_no", "blocks")]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard[j], *same, n[j], given[j])], ["shard", "source_no", "blocks", "n", "given"])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for i in range(0, row["n"], SHARD_SLOTS):
                    k = row["given"] + np.arange(i, min(i + SHARD_SLOTS, row["n"]))
                    epoch, block = k // row["blocks"], np.zeros(len(k), np.int64)
                    for e in np.unique(epoch).tolist():
                        key = int(mix(np.array([(seed * MOST_SOURCES + row["source_no"]) * 1024 + e], np.uint64))[0])
                        block[epoch == e] = permuted(k[epoch == e] % row["blocks"], row["blocks"], key)
                    # The order of a shard's slots is that of these numbers.
                    slot = (mix(k.astype(np.uint64) * np.uint64(MOST_SOURCES) + np.uint64(row["source_no"])) >> np.uint64(1)).astype(np.int64)
                    same = [pa.array(np.full(len(k), row["shard"])), pa.array(slot), pa.array(np.full(len(k), row["source_no"], np.int32))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(epoch.astype(np.int32)), pa.array(block)], ["shard", "slot", "source_no", "epoch", "block"])

    plan = spark.createDataFrame(facts, "source_no long, slots long, blocks long").repartition(max(1, min(len(facts), 4096)), "source_no")
    cells = plan.mapInArrow(draw, "shard long, source_no long, blocks long, n long, given long").repartition(tasks, "shard", "source_no")
    drawn = cells.mapInArrow(slots, "shard long, slot long, source_no int, epoch int, block long")
    # The planner takes the slots for as few as the shards, and would broadcast them.
    return Mixture(documents, drawn.join(blocks.hint("merge"), ["source_no", "block"]), sources)


def taken_words(mixture: Mixture) -> DataFrame:
    """For each document: doc_id, source, size, source_size, target (its source's) and taken, the words that the mix takes, repeats counted."""
    spark = mixture.documents.sparkSession
    taken = mixture.parts.groupBy("source_no", "start").agg(F.sum("n_words").alias("taken"))
    facts = spark.createDataFrame([(i, s.size, s.target) for i, s in enumerate(mixture.sources)], "source_no int, source_size long, target double")
    known = mixture.documents.join(F.broadcast(facts), "source_no")
    taken = taken.withColumn("some", F.lit(True))
    found = known.withColumn("some", F.col("size") > 0).join(taken, ["source_no", "start", "some"], "left")
    return found.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_texts(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """The mix as documents: for each document and epoch that takes any of its words a row like its own, with the text of the words taken.

    Runs of words keep the white space between them; apart from each other they stand on lines of their own. n_chars, if there is one, is renewed.
    """
    same = ["doc_id", "source", "tie"]
    copy = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))
    numbered = mixture.documents.withColumn("copy", F.row_number().over(Window.partitionBy(*same).orderBy("start"))).filter("size > 0")
    spans = mixture.parts.groupBy("source_no", "start", "epoch").agg(F.sort_array(F.collect_list(F.struct("word", "n_words"))).alias("spans"))
    wanted = spans.join(numbered, ["source_no", "start"]).select(*(F.col(c).alias(f"_{c}") for c in same), F.col("copy").alias("_copy"), "spans")
    # The rows' own columns are kept apart, whatever their names.
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    texts = docs.select(own, "doc_id", "source", F.xxhash64("text", "doc_id").alias("tie")).withColumn("copy", copy)
    met = [texts[c].eqNullSafe(wanted[f"_{c}"]) for c in same] + [texts["copy"] == wanted["_copy"]]
    found = texts.join(wanted, met).select(F.col("row.text").alias("text"), "row", "spans")
    docs_columns, count = docs.columns, "n_chars" in docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                starts, _, first = word_spans(data, offsets)
                out = []
                for i, spans in enumerate(part.column("spans").to_pylist()):
                    runs: list[list[int]] = []
                    for s in spans:
                        if runs and runs[-1][1] == s["word"]:
                            runs[-1][1] += s["n_words"]
                        else:
                            runs.append([s["word"], s["word"] + s["n_words"]])
                    edge = [*starts[first[i] : first[i + 1]], offsets[i + 1]]
                    texts = [data[edge[a] : edge[b]].tobytes().decode() for a, b in runs]
                    out.append("".join(t if t.endswith("\n") or k == len(texts) - 1 else f"{t}\n" for k, t in enumerate(texts)))
                row = part.column("row")
                columns = {n: row.field(i) for i, n in enumerate(docs_columns)} | {"text": pa.array(out, pa.string())}
                if count:
                    columns["n_chars"] = pa.array([len(t) for t in out], pa.int64())
                yield pa.RecordBatch.from_pydict(columns)

    return found.mapInArrow(cut, docs.schema)
