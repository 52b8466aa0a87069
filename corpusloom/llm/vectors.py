"""Near-duplicate vectors: inverted lists with product-quantised residuals, table-lookup distances, and an exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, discard, written
from .components import components

#: Codebooks are fitted on about so many vectors of a dimension, chosen by hash.
SAMPLE = 20_000
#: There are about so many lists for each square root of the vectors; no more than MOST_LISTS, beyond which lists grow and meet in blocks.
LISTS, MOST_LISTS = 1.5, 2_048
#: There is a coarse cell for so many vectors; those of a cell, and its guests, meet in one task, list by list.
GROUP_ROWS = 4_096
SUBSPACES, CODES = 8, 256
#: Vectors of a dimension beyond these are an error: each has codebooks of its own.
MOST_DIMENSIONS = 100
#: Members and guests that meet in one task at a time.
MEMBERS, GUESTS = 4_096, 8_192
#: Distances are single precision in places; bounds are widened by this.
SLACK = 1e-4


@dataclass(frozen=True)
class Codebooks:
    """Centres of the lists and of the coarse cells, and for each subspace (a range of components) the code words of residuals."""

    centres: np.ndarray
    cells: np.ndarray
    ranges: list[tuple[int, int]]
    words: list[np.ndarray]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([w[codes[:, m]] for m, w in enumerate(self.words)], axis=1)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T), 0)


def cluster(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Lloyd's centres of x, no more than k."""
    x = np.unique(x, axis=0)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = squared_distances(x, centres).argmin(1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def fit(sample: np.ndarray, lists: int, cells: int) -> Codebooks:
    centres = cluster(sample, max(1, min(lists, len(sample) // 8)))
    residual = sample - centres[squared_distances(sample, centres).argmin(1)]
    edges = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int).tolist()
    ranges = list(zip(edges, edges[1:], strict=False))
    return Codebooks(centres, cluster(sample, max(1, min(cells, len(sample) // 8))), ranges, [cluster(residual[:, a:b], CODES) for a, b in ranges])


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def vector_classes(vectors: DataFrame) -> DataFrame:
    """Equal vectors of a label as one row: cid, label, dim, embedding, rows and least (the smallest vec_id). Only vectors that can link are there."""
    usable = "label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    rows = vectors.filter(usable).groupBy("label", "embedding").agg(F.count("*").alias("rows"), F.min("vec_id").alias("least"))
    return written(rows.select(F.monotonically_increasing_id().alias("cid"), "label", F.size("embedding").alias("dim"), "embedding", "rows", "least"))


def codebooks(classes: DataFrame, sample: int = SAMPLE) -> dict[int, Codebooks]:
    """Codebooks for each dimension; their sizes, and that of the sample, are bounded."""
    totals = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().limit(MOST_DIMENSIONS + 1).collect()}
    if len(totals) > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions")
    found = {}
    for dim, n in totals.items():
        share = min(1 << 20, -(-sample * (1 << 20) // n))
        chosen = classes.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) < share)).limit(2 * sample)
        column = chosen.orderBy("cid").select(F.col("embedding").cast("array<double>")).toArrow().column(0).combine_chunks()
        x = _unit(column) if len(column) else np.ones((1, dim)) / np.sqrt(dim)
        found[dim] = fit(x, min(MOST_LISTS, math.ceil(LISTS * math.sqrt(n))), max(1, n // GROUP_ROWS))
    return found


INDEX = "cid long, label int, dim int, rows long, list int, group int, visited array<int>, codes binary, error double, vector binary"


def margins(centres: np.ndarray, far: np.ndarray, home: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How far vectors are, at least, from anything whose nearest centre is one of others: from the planes halfway between their own centres and those.

    far holds the squared distances of the vectors from all centres.
    """
    between = np.sqrt(squared_distances(centres[home], centres[others]))
    return (far[:, others] - far[np.arange(len(far)), home][:, None]) / np.maximum(2 * between, 1e-300)


def index(classes: DataFrame, books: dict[int, Codebooks], radius: float) -> DataFrame:
    """Every vector's list and cell (group), residual codes and their error, its unit vector, and the further cells that it must be compared in.

    Whatever lies within radius of a vector and in another cell lies beyond the plane halfway between the two centres. So it visits just the cells
    whose plane is no farther than radius; of two cells, the vectors of the lower one visit the other. Lists are probed by the same rule.
    """
    shared = classes.sparkSession.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims):
                b, batch = shared.value[int(dim)], whole.filter(pa.array(dims == dim))
                cells = np.arange(len(b.cells))
                for start in range(0, len(batch), 1024):
                    part = batch.slice(start, 1024)
                    x = _unit(part.column("embedding"))
                    home = squared_distances(x, b.centres).argmin(1)
                    far = squared_distances(x, b.cells)
                    cell = far.argmin(1)
                    visits = (margins(b.cells, far, cell, cells) <= radius + SLACK) & (cells > cell[:, None])
                    residual = x - b.centres[home]
                    codes = np.stack([squared_distances(residual[:, s:e], w).argmin(1) for (s, e), w in zip(b.ranges, b.words, strict=True)], 1)
                    error = np.linalg.norm(residual - b.decode(codes), axis=1)
                    columns = [part.column(n) for n in ("cid", "label", "dim", "rows")]
                    columns += [pa.array(home.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array([np.flatnonzero(v).astype(np.int32) for v in visits], pa.list_(pa.int32()))]
                    columns += [pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(error), pa.array([v.tobytes() for v in x], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX.split(", ")])

    rows = classes.select("cid", F.col("label").cast("int").alias("label"), "dim", "rows", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(assign, INDEX)


def _joined(pairs: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The least of the numbers below n that pairs connect each to."""
    root = np.arange(n)
    a, b = (np.concatenate([p[i] for p in pairs] or [np.zeros(0, np.int64)]) for i in (0, 1))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


LINKS = "cid long, links long, root long"


def _meet(book: Codebooks, block: int, members: pa.Table, guests: pa.Table, inner: bool, radius: float, cosine: float) -> pa.Table:
    """Compare members with guests and, if inner, with each other, list by list: for each vector its links here and the least vector that they connect it to.

    The squared distance from a vector q to a list's centre c plus code words w is |q - c|^2 + (|w|^2 + 2 c w) - 2 q w: the bracket belongs to the member, and the
    last term is looked up in a table for each vector and subspace, whatever the list.
    """
    dim, own = book.centres.shape[1], len(members)
    members = members.sort_by("list")
    read = lambda t: np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64).reshape(-1, dim)
    both = lambda c: np.concatenate([members.column(c).to_numpy(), guests.column(c).to_numpy()])
    cids, rows, home, x = both("cid"), both("rows"), both("list"), np.concatenate([read(members), read(guests)])
    codes = np.frombuffer(b"".join(members.column("codes").to_pylist()), np.uint8).reshape(own, -1)
    limit = (radius + members.column("error").to_numpy().astype(np.float32) + np.float32(SLACK)) ** 2
    came = np.concatenate([np.full(own, block), guests.column("from").to_numpy()])
    here, first = np.unique(home[:own], return_index=True)
    last = np.append(first[1:], own)
    fixed = np.zeros(own, np.float32)
    for m, ((s, e), w) in enumerate(zip(book.ranges, book.words, strict=True)):
        fixed += ((w * w).sum(1)[codes[:, m]] + 2 * np.einsum("ij,ij->i", book.centres[home[:own], s:e], w[codes[:, m]])).astype(np.float32)
    links, found = np.zeros(len(cids), np.int64), []

    def rerank(p: np.ndarray, r: np.ndarray) -> None:
        for i in range(0, len(p), 65_536):
            a, b = p[i : i + 65_536], r[i : i + 65_536]
            linked = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            a, b = a[linked], b[linked]
            links[:] += (np.bincount(a, rows[b], len(cids)) + np.bincount(b, rows[a], len(cids))).astype(np.int64)
            found.append((a, b))

    for start in range(0 if inner else own, len(cids), 512):
        q, at = x[start : start + 512], home[start : start + 512]
        tables = [(-2 * q[:, s:e] @ w.T).astype(np.float32) for (s, e), w in zip(book.ranges, book.words, strict=True)]
        far = squared_distances(q, book.centres)
        probed = margins(book.centres, far, at, here) <= radius + SLACK
        # Vectors of the cell meet those of higher lists, and of their own list those of higher blocks; guests of other cells (-1) meet all.
        source = came[start : start + len(q)][:, None]
        probed &= (source < 0) | (here > at[:, None]) | (here == at[:, None]) & (source <= block)
        for k in np.flatnonzero(probed.any(0)):
            who, span = np.flatnonzero(probed[:, k]), slice(first[k], last[k])
            near = far[who, here[k]].astype(np.float32)[:, None] + fixed[span][None]
            for m, t in enumerate(tables):
                near += t[who][:, codes[span, m]]
            near = near <= limit[span]
            # Of members of one list each pair once; guests come after all members, and meet all of them.
            near &= (at[who] != here[k])[:, None] | (np.arange(first[k], last[k])[None] < (who + start)[:, None])
            a, b = np.nonzero(near)
            rerank(who[a] + start, b + first[k])
    some = links > 0
    root = _joined(found, len(cids))
    return pa.table({"cid": cids[some], "links": links[some], "root": cids[root[some]]}, pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]))


def near_links(indexed: DataFrame, books: dict[int, Codebooks], cosine: float) -> DataFrame:
    """LINKS of the vectors of indexed, in parts that add up.

    A cell is cut into blocks of about MEMBERS, and its guests (vectors of lower cells that visit it, and those of its own other blocks) into blocks of about GUESTS; each pair of blocks meets in one task, of bounded memory. Every pair of vectors that can link meets once.
    """
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    shared = indexed.sparkSession.sparkContext.broadcast(books)
    place = ["label", "dim", "group"]
    sizes = indexed.groupBy(*place).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    members = indexed.drop("visited").join(sizes, place).withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    visits = indexed.select("cid", "label", "dim", "rows", "list", "vector", F.explode("visited").alias("group")).join(sizes, place)
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    inside = members.filter("blocks > 1").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("to <> block")
    columns = ["cid", *place, "rows", "list", "vector", "block", "from"]
    guests = visits.withColumn("from", F.lit(-1)).select(*columns).unionByName(inside.withColumn("from", F.col("block")).withColumn("block", F.col("to")).select(*columns))
    tiles = guests.groupBy(*place, "block").agg(F.ceil(F.count("*") / GUESTS).cast("int").alias("tiles"))
    at = [*place, "block"]
    members = members.join(tiles, at, "left").withColumn("tile", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
    guests = guests.join(tiles, at).withColumn("tile", F.pmod(F.xxhash64("cid"), "tiles").cast("int"))
    key = [*at, "tile"]

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        _, dim, _, block, tile = (k.as_py() for k in key)
        return _meet(shared.value[dim], block, left, right, tile == 0, radius, cosine)

    # Both sides come of one frame: new names of columns keep them apart.
    left = members.select(*(F.col(c).alias(c) for c in (*key, "cid", "rows", "list", "codes", "error", "vector")))
    right = guests.select(*(F.col(c).alias(c) for c in (*key, "cid", "rows", "list", "vector", "from")))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, LINKS)


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding, label).

    Rows link when their labels are equal and the cosine of their embeddings, in double precision, reaches cosine. Embeddings that are null, empty, zero or hold a null or
    non-finite component, and rows without a label, link with nothing; embeddings of different lengths don't link. component_id is the smallest vec_id
    that links lead to, the row's own included; kept is whether that is its own (false for a null vec_id). Repeated rows are vectors of their own, which link;
    a null vec_id takes part, and is a component_id only where no other is there. Other columns are ignored; an empty table gives no rows.

    Equal vectors are one row of the index. Distances from a vector to residual codes can't be wrong by more than a code's error, which
    the index holds; a pair is left out only if it is farther apart than the radius and that error. So no link is missed.
    """
    spark = vectors.sparkSession
    classes = vector_classes(vectors)
    books = codebooks(classes)
    indexed = written(index(classes, books, float(np.sqrt(2 - 2 * cosine))))
    parts = written(near_links(indexed, books, cosine)) if books else spark.createDataFrame([], LINKS)
    roots = components(parts.select(F.col("cid").alias("a"), F.col("root").alias("b")).filter("a <> b"))
    counts = parts.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.join(counts, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    known = known.select("label", "embedding", "least", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    known = checkpointed(known)
    tops = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(tops, "root").select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "n_links", "component_id")
    rows = vectors.select("vec_id", "embedding", "label")
    found = rows.join(known, (rows["label"] == known["_label"]) & (rows["embedding"] == known["_embedding"]), "left")
    discard(indexed)
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
                        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))
