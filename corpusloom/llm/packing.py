"""Best-fit packing of token sequences by the sum of squares rule."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

#: About so many short pieces are packed together in one task; the remainder that a group leaves is under one part in a thousand.
GROUP_PIECES = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"


def public_tokenizer() -> tuple[str, str]:
    """Paths of the byte-level vocabulary for the libraries tokenizers and tiktoken."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Token ids as tokenizers gives them for vocabulary.

    ranks names the same vocabulary in the form of tiktoken, which finds the same ids several times faster. Texts that hold the string of an
    added token, or a run of white space so long that the faster library may run out of stack, go through tokenizers itself.
    """

    def __init__(self, vocabulary: str, ranks: str | None, longest_run: int = 10_000):
        import re

        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary)
        self.fast = None
        added = [re.escape(t.content) for t in self.exact.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join([*added, rf"\s{{{longest_run}}}"]))
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or self.special.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def token_pieces(docs: DataFrame, length: int = 1024, end_id: int = 2, vocabulary: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document's ids, which end with end_id.

    Only documents longer than length are cut; then the first piece is the shorter one. A null text counts as empty, so that its only id is
    end_id; repeated rows stand for themselves; other columns are ignored; an empty table gives none. uid numbers the rows of a run.
    """
    if vocabulary is None:
        vocabulary, ranks = public_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, uid = Encoder(vocabulary, ranks), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                doc, piece, start, n, crc, ids = [], [], [], [], [], []
                for d, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    tokens = np.append(encode(text or ""), end_id).astype("<u4")
                    first = len(tokens) % length or length
                    edges = [0, *range(first, len(tokens) + 1, length)]
                    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        doc.append(d), piece.append(i), start.append(a), n.append(b - a)
                        crc.append(zlib.crc32(tokens[a:b]))
                        if with_ids:
                            ids.append(tokens[a:b].astype(np.int32))
                uids = np.arange(uid, uid + len(doc))
                uid += len(doc)
                columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, n, crc, uids))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "uid"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32()))][: 6 + with_ids], [*names, "ids"][: 6 + with_ids])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The bin and the offset in it of each item, and the number of bins.

    Items come in descending size. Of the open bins with room an item takes the one after which the sum over all gaps of the squared number of
    open bins with that gap is smallest; among equals the one with the smallest gap. A bin is opened only where none has room.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; full ones (gap 0) don't count
    places: list[list[int]] = [[] for _ in range(capacity + 1)]
    total = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        here = count[s:capacity]
        change = 2 * (count[: capacity - s] - here + 1)
        if len(change):
            change[0] = 1 - 2 * here[0]  # this bin becomes full and leaves the sum
            change = np.where(here > 0, change, np.iinfo(np.int64).max)
        best = int(change.argmin()) if len(change) else -1
        if best < 0 or here[best] == 0:
            gap, home = capacity, total
            total += 1
        else:
            gap = s + best
            home = places[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = home, capacity - gap
        if gap > s:
            places[gap - s].append(home)
            count[gap - s] += 1
    return bins, offsets, total


def pack(pieces: DataFrame, length: int = 1024, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces with sequence_id and offset, so that no sequence holds more than length tokens and each is gapless from 0.

    Full pieces are sequences of their own. The others are dealt at random to groups of about group_pieces, each packed in one task of bounded
    memory, however many there are. pieces must be stable (a written table).
    """
    short = pieces.filter(F.col("length") < length)
    groups = max(1, -(-short.count() // group_pieces))
    schema = f"{pieces.schema.simpleString()[7:-1]},sequence_id:bigint,offset:bigint"

    def place(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        bins, offsets, _ = sum_of_squares(table.column("length").to_numpy(), length)
        ids = (bins * groups) + key[0].as_py()
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    dealt = short.withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    packed = dealt.groupBy("group").applyInArrow(place, schema)
    full = pieces.filter(F.col("length") == length).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, length: int = 1024, end_id: int = 2, **tokenizer) -> DataFrame:
    """The place of every piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty, and has the end's id alone; repeated rows, and rows without doc_id, are documents of their own; pieces of equal length
    are placed in the order of a run's numbers; other columns are ignored; an empty table gives no rows.
    """
    return pack(written(token_pieces(docs, length, end_id, **tokenizer)), length).drop("uid")
