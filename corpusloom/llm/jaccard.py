"""N-gram Jaccard join: documents that share most of their word shingles, found by adaptive multi-match prefixes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytehash import mix
from .common import checkpointed, discard, release, slices, written
from .components import components
from .shingles import parities, set_id, shingle_sets

#: Prefixes are lengthened by up to so many tokens less one.
LEVELS = 12
#: Counters that a task keeps for frequent shingles, and frequent shingles that are broadcast.
COUNTERS, MOST_FREQUENT = 1 << 15, 1 << 18
#: The list of a frequent shingle is dealt to a task for about so many sets.
HOT = 1_024
#: Sets whose postings a task remembers, to leave out those of further copies.
REMEMBERED = 200_000
#: In lists longer than this, neighbours are compared first: in so many rounds at most, in which a set is in chains of so many of its lists, of about so many sets.
LONG_LIST, CHAIN_ROUNDS, CHAINS, CHAIN_GROUP = 64, 4, 4, 4_096
#: A list is led by so many sets, and a set follows the leads of so many of its lists.
LEADS, LED = 8, 2
#: Of the candidates of a set, so many of the nearest are compared before the others.
NEAREST = 2
#: A bitmap has at least 16 bits for each key, within these powers of two.
LEAST_BITS, MOST_BITS = 20, 27


class Frequent:
    """Counts of the most frequent of many values in bounded memory (Misra and Gries): a count is too small by at most what was subtracted."""

    def __init__(self, counters: int):
        self.counters, self.values, self.counts, self.waiting, self.size = counters, np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(values)
        self.size += len(values)
        if self.size > 32 * self.counters:
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        values, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
        merged, at = np.unique(np.concatenate([self.values, values]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([self.counts, counts]), len(merged)).astype(np.int64)
        if len(merged) > self.counters:
            counts = counts - np.partition(counts, -self.counters - 1)[-self.counters - 1]
        self.values, self.counts, self.waiting, self.size = merged[counts > 0], counts[counts > 0], [], 0


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[tuple[int | None, int], np.ndarray]]:
    for part in slices(batch, "text"):
        yield from zip(zip(part.column("doc_id").to_pylist(), part.column("tie").to_pylist(), strict=True), shingle_sets(part.column("text"), k), strict=True)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text")


_PARITIES = [f"p{i}" for i in range(4)]


def shingled(docs: DataFrame, k: int) -> DataFrame:
    """A row for each document: doc_id, tie (a hash of the text), n shingles, and sid, a hash of their set, with the set's parities, null without any; and,
    with a null n, rows of token and seen: frequent shingles of each task."""
    names = ["doc_id", "tie", "n", "sid", *_PARITIES, "token", "seen"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(COUNTERS)
        for batch in batches:
            rows: list[tuple] = []
            for (doc, tie), found in _sets(batch, k):
                if len(found):
                    rows.append((doc, tie, len(found), set_id(found), *parities(found).tolist()))
                    frequent.add(found)
                else:
                    rows.append((doc, tie, 0, None, None, None, None, None))
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(8)), none, none], names)
        frequent.merge()
        often = frequent.counts > 1
        none = pa.nulls(int(often.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([*[none] * 8, pa.array(frequent.values[often].view(np.int64)), pa.array(frequent.counts[often])], names)

    return _keyed(docs).mapInArrow(scan, ", ".join(f"{n} long" for n in names))


def _least_shared(n: int, percent: int) -> int:
    """A set of n shares at least so many tokens with each that it is similar to."""
    return -(-n * percent // 100)


def postings(docs: DataFrame, k: int, percent: int, frequent: np.ndarray, seen: np.ndarray) -> DataFrame:
    """token, salt, sid, n and place of the longest prefix of each set that is asked for.

    Shingles are in the order of their hashes, but those in frequent (ascending by seen) come last. Similar sets share at least `l` tokens of
    their prefixes of n - least shared + l. salt deals out the lists of tokens that were seen very often; it is 0 for all others.
    """
    order = np.argsort(frequent, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order.astype(np.int32), (seen[order] // HOT).astype(np.int32)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ranks, hot = shared.value
        some = np.zeros(1 << 20, bool)
        some[values >> np.uint64(44)] = True
        remembered: set[int] = set()
        for batch in batches:
            tokens, salts, sids, sizes, places = [], [], [], [], []
            for _, found in _sets(batch, k):
                n = len(found)
                if not n or (sid := set_id(found)) in remembered:
                    continue
                if len(remembered) < REMEMBERED:
                    remembered.add(sid)
                take = min(n, n - _least_shared(n, percent) + LEVELS)
                maybe = np.flatnonzero(some[found >> np.uint64(44)])
                salt = np.zeros(n, np.int32)
                if len(maybe):
                    at = np.minimum(np.searchsorted(values, found[maybe]), len(values) - 1)
                    hit = values[at] == found[maybe]
                    rank = np.full(n, -1, np.int32)
                    rank[maybe[hit]] = ranks[at[hit]]
                    deals = hot[at[hit]]
                    salt[maybe[hit]] = np.where(deals > 0, 1 + (sid & 0x7FFFFFFF) % np.maximum(deals, 1), 0)
                    order = np.argsort(rank, kind="stable")[:take]
                    found, salt = found[order], salt[order]
                tokens.append(found[:take]), salts.append(salt[:take])
                sids.append(np.full(take, sid)), sizes.append(np.full(take, n, np.int32)), places.append(np.arange(take, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (salts, sids, sizes, places))], ["token", "salt", "sid", "n", "place"]
                )

    return _keyed(docs).mapInArrow(scan, "token long, salt int, sid long, n int, place int")


def _met(posted: DataFrame, percent: int) -> DataFrame:
    """token, sid, n and place of the postings that another set of a size like theirs has too, each once; of tokens dealt out by salt, of all.

    One exchange by token and salt serves both steps.
    """
    by = ["token", "salt"]
    once = posted.repartition(*by).groupBy(*by, "sid").agg(F.first("n").cast("long").alias("n"), F.first("place").alias("place"))
    along = Window.partitionBy(*by).orderBy("n")
    less, more = F.lag("n").over(along), F.lead("n").over(along)
    like = (less * 100 >= F.col("n") * percent) | (F.col("n") * 100 >= more * percent)
    return once.withColumn("_like", (F.col("salt") > 0) | F.coalesce(like, F.lit(False))).filter("_like").select("token", "sid", "n", "place")


#: What is known of each set beside its number.
_FACTS = ("n", "lone", "alone", *_PARITIES)


def _may_match(x: str, y: str, percent: int) -> Column:
    """Whether two sets (columns of _FACTS that end in x and y) that share a token of their prefixes can be similar.

    lone tokens come before the first token that a set shares with any: no other set has them. alone tokens of the prefix are in no other prefix: of two sets,
    the one whose prefix ends first in the order of all tokens has at least so many that the other lacks, whose prefix would hold them. And sets
    differ by at least as many tokens as their parities do.
    """
    rest = lambda s, c: F.col(f"n{s}") - F.col(f"{c}{s}")
    apart = sum((F.bit_count(F.col(f"{p}{x}").bitwiseXOR(F.col(f"{p}{y}"))) for p in _PARITIES), F.lit(0))
    both = F.col(f"n{x}") + F.col(f"n{y}")
    common = F.least(rest(x, "lone"), rest(y, "lone"), F.greatest(rest(x, "alone"), rest(y, "alone")), F.shiftright(both - apart, 1))
    return 100 * common >= percent * (both - common)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of which each key of one column sets one; there are up to 2**MOST_BITS (16 MB), which bounds what is gathered."""
    size = min(1 << MOST_BITS, max(1 << LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    place = F.pmod(F.col(keys.columns[0]), F.lit(size))
    words = keys.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits")).toArrow()
    found = np.zeros(size >> 6, np.int64)
    found[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return found


class Sets:
    """The token sets of the sids that pairs name, made again from the texts and kept in the shared folder: those of a sid once, whatever the rounds."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int):
        self.docs, self.classes, self.k, self.parts = docs, classes, k, []

    def of(self, sids: DataFrame) -> DataFrame:
        """sid and tokens of at least all sids. A bitmap of fixed size names the texts that are read; what it lets through beyond is dropped by a join."""
        new = sids.distinct()
        for part in self.parts:
            new = new.join(part.select("sid"), "sid", "left_anti")
        new = checkpointed(new)
        if not new.isEmpty():
            self.parts.append(written(self.made(new)))
        found = self.parts[0]
        for part in self.parts[1:]:
            found = found.unionByName(part)
        return found

    def made(self, sids: DataFrame) -> DataFrame:
        shared = self.docs.sparkSession.sparkContext.broadcast(_bitmap(self.classes.join(sids, "sid", "left_semi").select("tie")))
        k = self.k

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = shared.value
            for batch in batches:
                place = batch.column("tie").to_numpy() & ((len(bits) << 6) - 1)
                batch = batch.filter(pa.array((bits[place >> 6] >> (place & 63)) & 1 == 1))
                for part in slices(batch, "text"):
                    found = [s for s in shingle_sets(part.column("text"), k) if len(s)]
                    yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["sid", "tokens"])

        return _keyed(self.docs).select("text", "tie").mapInArrow(scan, "sid long, tokens binary").join(sids, "sid", "left_semi").groupBy("sid").agg(F.first("tokens").alias("tokens"))

    def discard(self) -> None:
        for part in self.parts:
            discard(part)


def verified(sets: Sets, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) of sids whose sets have 100 * common >= percent * union."""
    found = sets.of(pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))))
    left, right = (found.select(F.col("sid").alias(x), F.col("tokens").alias(f"tokens_{x}")) for x in "ab")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hold = []
            for a, b in zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                hold.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(hold, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "tokens_a", "tokens_b")
    return checkpointed(joined.mapInArrow(compare, "a long, b long"))


def _with_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows with the root of their sid's component, or its sid."""
    if roots is None:
        return rows.withColumn("root", F.col("sid"))
    found = roots.select(F.col("node").alias("sid"), "root")
    return rows.join(found, "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def _mixed(lists: DataFrame) -> DataFrame:
    """The rows of lists (token, sid, root) whose token is in different components, with their number df."""
    mixed = lists.groupBy("token").agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    return lists.join(mixed.select("token", "df"), "token")


def _side(facts: DataFrame, end: str) -> DataFrame:
    return facts.select(*(F.col(c).alias(f"{c}_{end}") for c in ("sid", *_FACTS)))


def _neighbours(lists: DataFrame, facts: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that are in one of the lists, which are long, and may match.

    A set is paired with those that lead LED of its lists, which are the LEADS with the fewest tokens of their own (alone): of a text and its near copies those
    nearest to the text. And in each turn it takes part in CHAINS of its lists, in random orders in which neighbours are paired. So pairs grow with the lists' lengths, not
    their squares, and yet a large group of sets of which each is similar to some others comes together.
    """
    rows = _mixed(lists).withColumn("_some", F.row_number().over(Window.partitionBy("sid").orderBy(F.xxhash64("token", F.lit(turn)))))
    rows = rows.withColumns({"_order": F.xxhash64("sid", "token", F.lit(turn)), "_group": F.pmod(F.xxhash64("sid", F.lit(turn)), F.ceil(F.col("df") / CHAIN_GROUP))})
    chain = Window.partitionBy("token", "_group").orderBy("_order", "sid")
    chained = rows.filter(f"_some <= {CHAINS}").select("sid", "root", F.lead("sid").over(chain).alias("other"), F.lead("root").over(chain).alias("other_root"))
    least = F.row_number().over(Window.partitionBy("token").orderBy("alone", "_order", "sid"))
    leads = rows.withColumn("_least", least).filter(f"_least <= {LEADS}").select("token", F.col("sid").alias("other"), F.col("root").alias("other_root"))
    led = rows.filter(f"_some <= {LED}").select("token", "sid", "root").join(leads, "token").drop("token")
    pairs = chained.unionByName(led).filter("root <> other_root").select(F.greatest("sid", "other").alias("a"), F.least("sid", "other").alias("b")).distinct()
    known = pairs.join(_side(facts, "x"), F.col("a") == F.col("sid_x")).join(_side(facts, "y"), F.col("b") == F.col("sid_y"))
    return known.filter(_may_match("_x", "_y", percent)).select("a", "b")


def _spare(percent: int, n: str = "n") -> Column:
    """How many of n tokens a similar set may lack."""
    return F.expr(f"{n} - ({n} * {percent} + 99) div 100")


def _wanted(lists: DataFrame, percent: int) -> DataFrame:
    """sid, wanted and met: the level that each set takes, and how many rows of lists (token, sid, n, place, df) it has.

    It is that at which its expected work is least: the postings that it reads and, at level l, a comparison for each l-th of them, whose cost grows
    with its size. Similar sets are only sure to share the least number of tokens: a level beyond would ask for more than some have in common.
    """
    work = [F.sum(F.when(F.col("place") < _spare(percent) + at, F.col("df") - 1).otherwise(0)) * (1 + F.first("n") / F.lit(2 * at)) for at in range(1, LEVELS + 1)]
    costs = lists.groupBy("sid").agg(F.array(*work).alias("work"), F.first("n").alias("n"), (F.first("n") - F.first(_spare(percent))).cast("int").alias("least"), F.count("*").alias("met"))
    costs = costs.withColumn("work", F.slice("work", 1, F.least(F.lit(LEVELS), "least")))
    return costs.select("sid", "n", F.array_position("work", F.array_min("work")).cast("int").alias("wanted"), "met")


def _enough(chosen: DataFrame, percent: int) -> DataFrame:
    """The rows of _wanted() whose set has as many tokens in lists as a pair must share: as the larger set its own level, as the smaller one at least the
    lowest level of the sets that may be larger and similar. Those are in its class of sizes or the two after it; there are a few hundred classes."""
    width = max(math.log(100 / percent), 0.05)
    size = F.floor(F.ln("n") / width).cast("int")
    lows = chosen.groupBy(size.alias("_class")).agg(F.min("wanted").alias("_low"))
    lows = lows.select(F.explode(F.array(F.col("_class"), F.col("_class") - 1, F.col("_class") - 2)).alias("_class"), "_low").groupBy("_class").agg(F.min("_low").alias("_low"))
    return chosen.withColumn("_class", size).join(F.broadcast(lows), "_class").filter("met >= least(wanted, _low)").drop("_class", "_low", "n")


def similar_pairs(lists: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that share enough tokens of their prefixes, and near, by which the likelier of them come first.

    The larger set of a pair (then the one with the larger sid) decides on the level.
    """
    lists = written(_mixed(lists).select("token", "sid", "n", "place", "root", "df"))
    release(lists.sparkSession)
    chosen = checkpointed(_enough(_wanted(lists, percent), percent))
    # Only here do the rows of lists get all that is known of their sets.
    known = lists.select("token", "sid", "place", "root").join(facts.join(chosen.drop("met"), "sid"), "sid")
    known = known.withColumn("level", F.greatest(F.lit(1), F.col("place") - _spare(percent) + 1))
    columns = ["sid", "root", "place", "level", "wanted", *_FACTS]
    a = known.filter("level <= wanted").select("token", *(F.col(c).alias(f"{c}_x") for c in columns if c != "level"))
    b = known.select("token", *(F.col(c).alias(f"{c}_y") for c in columns if c != "wanted"))
    larger = F.struct("n_x", "sid_x") > F.struct("n_y", "sid_y")
    met = a.join(b, "token").filter((F.col("root_x") != F.col("root_y")) & larger & (F.col("level_y") <= F.col("wanted_x")) & _may_match("_x", "_y", percent))
    apart = sum((F.bit_count(F.col(f"{p}_x").bitwiseXOR(F.col(f"{p}_y"))) for p in _PARITIES), F.lit(0))
    pairs = met.groupBy(F.col("sid_x").alias("a"), F.col("sid_y").alias("b")).agg(
        F.count("*").alias("shared"), F.first("wanted_x").alias("wanted"), F.first("n_x").alias("na"), F.first("n_y").alias("nb"),
        F.min("place_x").alias("pa"), F.min("place_y").alias("pb"), F.first(apart).alias("apart"),
    )
    # What comes before the first token that both have is in one of them only. And of the two prefixes, what the one that ends first doesn't share is in
    # its set only: whichever that is, so many tokens are left to be common.
    left = lambda n: F.expr(f"{n} - least({n}, {n} - ({n} * {percent} + 99) div 100 + wanted) + shared")
    common = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"), F.greatest(left("na"), left("nb")), F.expr("(na + nb - apart) div 2"))
    both = F.col("na") + F.col("nb")
    found = pairs.filter("shared >= wanted").filter(100 * common >= percent * (both - common)).select("a", "b", (common / both).alias("near"))
    nearest = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("near"), "b"))
    found = checkpointed(found.select("a", "b", nearest.alias("turn")))
    discard(lists)
    release(lists.sparkSession)
    return found


def grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """A row for each row of docs: doc_id, tie (a hash of the text), n, and root, which the sets of a component share; null without shingles.

    No link between different components is missed: prefixes that miss a similar pair don't exist, and pairs are left out only when both are known
    to be in one component, through links that were verified. In lists longer than LONG_LIST sets are first compared with a leader and with neighbours in random orders, for up
    to CHAIN_ROUNDS rounds, so that large groups of near copies are together before pairs are made; and of the pairs, those of each set's NEAREST come
    first. Frequencies, costs and nearness only decide on the work.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and at most 100")
    spark: SparkSession = docs.sparkSession
    scanned = written(shingled(docs, k))
    rows = scanned.filter("n is not null").select("doc_id", "tie", "n", "sid")
    tokens = scanned.filter("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(MOST_FREQUENT)
    often = tokens.orderBy("seen", "token").toArrow()
    frequent, seen = often.column("token").to_numpy().view(np.uint64), often.column("seen").to_numpy()
    classes = checkpointed(scanned.filter("sid is not null").groupBy("sid").agg(F.min("tie").alias("tie"), *(F.first(p).alias(p) for p in _PARITIES)))

    met = written(_met(postings(docs, k, percent, frequent, seen), percent))
    release(spark)
    # lone: how many tokens come before the first one in a list; whatever shares a token of both prefixes has none of them.
    shares = met.groupBy("sid").agg(F.first("n").alias("n"), F.min("place").alias("lone"), F.count("*").alias("met"))
    shares = shares.withColumn("alone", F.least(F.col("n"), _spare(percent) + LEVELS) - F.col("met")).drop("met")
    facts = checkpointed(shares.join(classes.drop("tie"), "sid").select("sid", *_FACTS))
    long = met.groupBy("token").count().filter(f"count > {LONG_LIST}").select("token")
    long = checkpointed(met.join(long, "token").join(facts.select("sid", "alone"), "sid").select("token", "sid", "alone"))

    links, roots, sets = None, None, Sets(docs, classes, k)

    def add(new: DataFrame) -> None:
        nonlocal links, roots
        links = new if links is None else links.unionByName(new)
        roots = components(links)
        release(spark)

    for turn in range(CHAIN_ROUNDS):
        pairs = checkpointed(_neighbours(_with_roots(long, roots), facts, percent, turn))
        if pairs.isEmpty():
            break
        new = verified(sets, pairs, percent)
        if new.isEmpty():
            break
        add(new)
        if 50 * new.count() < pairs.count():  # what is left is hardly ever similar
            break
    pairs = similar_pairs(_with_roots(met, roots), facts, percent)
    discard(met)
    # With few pairs for each set, all are compared at once.
    first = pairs.filter(f"turn <= {NEAREST}")
    if pairs.count() < 2 * first.count():
        first = pairs
    if not first.isEmpty():
        add(verified(sets, first.select("a", "b"), percent))
    if first is not pairs:
        rest = pairs.filter(f"turn > {NEAREST}")
        ends = (roots if roots is not None else spark.createDataFrame([], "node long, root long")).select("node", "root")
        rest = rest.join(ends.select(F.col("node").alias("a"), F.col("root").alias("_a")), "a", "left").join(ends.select(F.col("node").alias("b"), F.col("root").alias("_b")), "b", "left")
        rest = checkpointed(rest.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b"))
        if not rest.isEmpty():
            add(verified(sets, rest, percent))
    sets.discard()
    return _with_roots(rows, roots)


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs (doc_id, text).

    A document's set holds its distinct shingles of k words (A-Z lower-cased; with fewer words, all of them as one). Two documents link when
    100 * common >= percent * union. component_id is the smallest doc_id that links lead to, the document's own included.

    A null, empty or wordless text has an empty set, and links with nothing. Rows with equal sets are one node from the start, however many they are.
    A null doc_id takes part, but is no component_id unless no other is there: then that is null. Repeated rows are judged alike; other columns are ignored;
    an empty table gives no rows.
    """
    rows = grouped(docs, k, percent)
    tops = rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(tops, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def first_of_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, of each component of jaccard_groups() only one: that with the smallest doc_id (null last), of several such rows one.

    Rows without shingles all stay.
    """
    rows = grouped(docs, k, percent)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")
    first = rows.filter("root is not null").groupBy("root").agg(F.min(rank).alias("top")).select("top.doc_id", "top.tie", F.lit(True).alias("one"))
    bare = rows.filter("root is null").select("doc_id", "tie", F.lit(False).alias("one")).distinct()
    keep = first.unionByName(bare).select(F.col("doc_id").alias("_key"), F.col("tie").alias("_tie"), F.col("one").alias("_one"))
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    whole = docs.select(own, F.col("doc_id").alias("_k"), F.xxhash64("text").alias("_t"))
    whole = whole.join(keep, whole["_k"].eqNullSafe(keep["_key"]) & (whole["_t"] == keep["_tie"]))
    turn = F.row_number().over(Window.partitionBy("_k", "_t").orderBy(F.lit(0)))
    return whole.withColumn("_turn", turn).filter("_turn = 1 or not _one").select("row.*")
