"""Document fingerprints: sets of digests of content-defined chunks, weighted by length."""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import byte_table, part_hashes
from .common import slices

#: Bytes of a chunk: at least, the size up to which the strict condition holds, and at most. The gear hash looks back as far as the least chunk.
LEAST, NORMAL, MOST = 32, 64, 256
STRICT, LOOSE = np.uint32(0xFE000000), np.uint32(0xF8000000)
#: Documents are sorted in so many ranges at most, of at least so many rows.
MOST_RANGES, RANGE_ROWS = 20_000, 4_096

Chunks = dict[int, int]


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum over itself and the 31 bytes before of their numbers, the one k bytes before shifted left by k."""
    value = (byte_table(7)[data] >> np.uint64(32)).astype(np.uint32)
    for step in (1, 2, 4, 8, 16):
        shifted = value[:-step] << np.uint32(step)
        value = value.copy()
        value[step:] += shifted
    return value


def chunk_sets(texts: list[str]) -> list[Chunks]:
    """For each text its chunks' digests with their lengths in bytes.

    A chunk ends at the first place, beyond the least length, where the leading bits of the gear hash are 0: seven bits up to the normal length, five
    beyond, and at the greatest length anyway. Only the 32 bytes before a place decide, so that an edit moves the boundaries near it alone.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    value = gear(data)
    loose = np.flatnonzero((value & LOOSE) == 0)
    strict = (loose[(value[loose] & STRICT) == 0] + 1).tolist()
    loose = (loose + 1).tolist()
    cuts: list[int] = []
    counts: list[int] = []
    place = 0
    for r in raw:
        end, before = place + len(r), len(cuts)
        while place < end:
            cut = min(place + MOST, end)
            i = bisect_left(strict, place + LEAST)
            if i < len(strict) and strict[i] <= place + NORMAL:
                cut = min(cut, strict[i])
            else:
                i = bisect_left(loose, place + NORMAL + 1)
                if i < len(loose):
                    cut = min(cut, loose[i])
            cuts.append(cut)
            place = cut
        counts.append(len(cuts) - before)
    ends = np.array(cuts, np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    digest, sizes = part_hashes(data, starts, ends).tolist(), (ends - starts).tolist()
    found, at = [], 0
    for n in counts:
        found.append(dict(zip(digest[at : at + n], sizes[at : at + n], strict=True)))
        at += n
    return found


def as_string(chunks: Chunks) -> str:
    """The digests in ascending order, each of 8 bytes and followed by its length in 2, in base64."""
    pairs = np.empty(len(chunks), np.dtype([("digest", "<u8"), ("size", "<u2")]))
    pairs["digest"] = np.fromiter(chunks, np.uint64, len(chunks))
    pairs["size"] = np.fromiter(chunks.values(), np.int64, len(chunks))
    pairs.sort(order="digest")
    return base64.b64encode(pairs.tobytes()).decode()


def from_string(fingerprint: str) -> Chunks:
    pairs = np.frombuffer(base64.b64decode(fingerprint), np.dtype([("digest", "<u8"), ("size", "<u2")]))
    return dict(zip(pairs["digest"].tolist(), pairs["size"].tolist(), strict=True))


def containment(a: Chunks, b: Chunks) -> float:
    """The share of a, by length, whose chunks b has too; of an empty a, 1 if b is empty and else 0."""
    total = sum(a.values())
    return sum(n for d, n in a.items() if d in b) / total if total else float(not b)


def fingerprint(docs: DataFrame) -> DataFrame:
    """docs with a column fingerprint (a null text has an empty one), in place of one of that name."""
    kept = docs.drop("fingerprint")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [as_string(c) for c in chunk_sets([t or "" for t in part.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], [*part.schema.names, "fingerprint"])

    return kept.mapInArrow(add, f"{kept.schema.simpleString()[7:-1]},fingerprint:string")


def edited(text: str, other: str) -> str:
    """text with its last third of code points replaced by the first as many of other, or by all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def with_next(docs: DataFrame) -> DataFrame:
    """The rows of docs, sorted by descending doc_id (null last) within ranges, each range in one partition and followed by a row that starts the next one.

    Columns: range int, follows boolean (the row after the range), doc_id, text. A range's successor is the next lower one; that of the last is the
    first. Rows of one doc_id come in the order of their texts' hashes. Only ids are gathered to find the ranges, and a bounded number of them.
    """
    rows = docs.select("doc_id", "text").withColumns({"id_key": F.coalesce("doc_id", F.lit(-(1 << 63))), "tie": F.xxhash64("text")})
    ids = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id_key"))
    wanted = min(MOST_RANGES, ids.count() // RANGE_ROWS)
    edges = np.unique(np.array(ids.approxQuantile("id_key", [i / wanted for i in range(1, wanted)], 1 / (4 * wanted)) if wanted > 1 else [], np.float64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.float64), side="right").astype(np.int32))

    heads = sorted(((r["head"], r["range"]) for r in ids.groupBy(range_of("id_key").alias("range")).agg(F.max("id_key").alias("head")).collect()), reverse=True)
    before = [(head, heads[i - 1][1]) for i, (head, _) in enumerate(heads)]
    starts = F.broadcast(docs.sparkSession.createDataFrame(before, "head long, range int"))  # a row for each range
    following = rows.join(starts, rows["id_key"] == starts["head"]).select("doc_id", "text", "id_key", "tie", "range", F.lit(True).alias("follows"))
    ranged = rows.select("doc_id", "text", "id_key", "tie", range_of("id_key").alias("range"), F.lit(False).alias("follows"))
    order = ["range", "follows", F.desc("id_key"), F.desc("tie")]
    return ranged.unionByName(following).repartition(max(1, len(heads)), "range").sortWithinPartitions(*order).select("range", "follows", "doc_id", "text")


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_probe(docs: DataFrame) -> DataFrame:
    """How far the fingerprint of each document holds when a third of its text is replaced by the start of the next document (see EDITS).

    Null texts count as empty; a lone document follows itself; an empty table gives no rows; other columns are ignored. Rows stream through a task in
    sorted order, so that memory is bounded by the longest texts.
    """

    def compare(rows: list[tuple[int | None, str]], after: str) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        following = [*texts[1:], after]
        changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
        sets, other = chunk_sets([*texts, after]), chunk_sets(changed)
        columns = [
            pa.array([d for d, _ in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
            pa.array([as_string(c) for c in sets[:-1]], pa.string()),
            pa.array([as_string(c) for c in other], pa.string()),
            pa.array([containment(a, b) for a, b in zip(sets, other, strict=False)], pa.float64()),
            pa.array([containment(a, b) for a, b in zip(sets, sets[1:], strict=False)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in EDITS.split(", ")])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int | None, str]] = []
        size = 0
        done = None  # the range whose successor has come
        for batch in batches:
            for part in slices(batch, "text"):
                for at, follows, doc, text in zip(*(part.column(c).to_pylist() for c in ("range", "follows", "doc_id", "text")), strict=True):
                    text = text or ""
                    if follows:
                        if at != done:  # further rows here only repeat the id of the first
                            yield compare(waiting, text)
                            waiting, size, done = [], 0, at
                        continue
                    if waiting and size > 1 << 20:
                        yield compare(waiting, text)
                        waiting, size = [], 0
                    waiting.append((doc, text))
                    size += len(text)

    return with_next(docs).mapInArrow(stream, EDITS)
