"""Line deduplication by content-defined chunks and by runs of lines, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, discard, written

#: One boundary in so many lines, on average.
DIVISOR = 3
#: A line of so many words is a chunk by itself, so that a long passage on one line is found whatever stands around it.
LONG_LINE = 20
#: Runs of lines with so many words are found wherever they stand.
RUN_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _joined(first: str, n: str) -> str:
    return f"array_join(slice(lines, {first} + 1, {n}), '\\n')"


def _chunks(divisor: int, long_line: int) -> list[tuple[str, str]]:
    """Steps of SQL that make of `lines` the array `chunks` of {first, n, h, size}: those of two or more lines, or of one long line, that aren't blank.

    A chunk starts at the first line; where the rolling hash over the hashes of a line and the one before is 0 modulo divisor; and on either side of
    a long line. Two neighbours alone decide, so that a boundary in a passage is where it is in each copy of the passage.
    """
    return [
        ("marks", f"transform(lines, x -> named_struct('h', xxhash64(x), 'words', regexp_count(x, r'{WORD}')))"),
        (
            "starts",
            f"filter(sequence(0, size(lines) - 1), i -> i = 0 or marks[i].words >= {long_line} or marks[i - 1].words >= {long_line}"
            f" or pmod(xxhash64(marks[i - 1].h, marks[i].h), {divisor}) = 0)",
        ),
        ("sized", "transform(starts, (s, k) -> named_struct('first', s, 'n', coalesce(get(starts, k + 1), size(lines)) - s))"),
        ("bodies", f"transform(filter(sized, c -> c.n > 1 or marks[c.first].words >= {long_line}), c -> named_struct('first', c.first, 'n', c.n, 'body', {_joined('c.first', 'c.n')}))"),
        ("chunks", "transform(filter(bodies, c -> trim(c.body) <> ''), c -> named_struct('first', c.first, 'n', c.n, 'h', xxhash64(c.body), 'size', length(c.body)))"),
    ]


def _runs(long_line: int, run_words: int) -> list[tuple[str, str]]:
    """Steps of SQL that make of `lines` and `marks` the array `runs` of {first, n, h, size}, whose size is -n.

    A run is the shortest one with run_words words or more that starts at a line, or that ends at a line. Whatever stands around a passage with as many
    words, each of its lines with words is in a run that lies in the passage: the one that ends there, or else the one that starts where the passage does.
    """

    def reach(words: str, most: int) -> str:
        step = f"if(a.s >= {run_words}, a, named_struct('s', a.s + y, 'n', a.n + 1))"
        return f"aggregate(slice({words}, p + 1, {most}), named_struct('s', 0, 'n', 0), (a, y) -> {step}, a -> if(a.s >= {run_words}, a.n, null))"

    # Each of the lines has a word at least. Mostly a few are enough.
    shortest = lambda words: f"transform({words}, (x, p) -> coalesce({reach(words, 8)}, {reach(words, run_words)}))"
    span = "shiftleft(cast(at[{0}] as bigint), 32) + (at[{1}] - at[{0}] + 1)"
    return [
        ("hashes", "transform(marks, m -> m.h)"),
        ("at", "filter(sequence(0, size(lines) - 1), i -> marks[i].words > 0)"),
        ("counts", "transform(at, i -> marks[i].words)"),
        ("reversed", "reverse(counts)"),
        ("ahead", shortest("counts")),
        ("back", shortest("reversed")),
        (
            "spans",
            f"array_distinct(concat(transform(ahead, (n, p) -> if(n is null, null, {span.format('p', 'p + n - 1')})),"
            f" transform(back, (n, q) -> if(n is null, null, {span.format('size(at) - q - n', 'size(at) - q - 1')}))))",
        ),
        ("sized_runs", "transform(filter(spans, e -> e is not null), e -> named_struct('first', cast(shiftright(e, 32) as int), 'n', cast(e & 4294967295 as int)))"),
        # A long line is a chunk.
        (
            "runs",
            f"transform(filter(sized_runs, r -> r.n > 1 or marks[r.first].words < {long_line}),"
            " r -> named_struct('first', r.first, 'n', r.n, 'h', xxhash64(slice(hashes, r.first + 1, r.n)), 'size', -r.n))",
        ),
    ]


def _stepwise(rows: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """rows with a column for each step. Each is a generator of one row, which the optimizer doesn't copy into the lambdas of the next."""
    for name, step in steps:
        rows = rows.select("*", F.inline(F.array(F.struct(F.expr(step).alias(name)))))
    return rows


def _units(rows: DataFrame, divisor: int, long_line: int, run_words: int) -> DataFrame:
    """rows of doc_id and tie with `u`: each chunk and, if there are run_words, each run of their `text`."""
    rows = _stepwise(rows.withColumn("lines", _lines(F.col("text"))), _chunks(divisor, long_line) + (_runs(long_line, run_words) if run_words else []))
    return rows.select("doc_id", "tie", F.explode(F.concat("chunks", "runs") if run_words else "chunks").alias("u"))


#: The bytes of a chunk; of a run, which overlaps others, their digest.
_BYTES = f"if(u.size < 0, sha2({_joined('u.first', 'u.n')}, 256), {_joined('u.first', 'u.n')})"


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR, long_line: int = LONG_LINE, run_words: int = 0) -> DataFrame:
    """docs without the chunks that stand elsewhere too, and with removed_chunks and removed_chars.

    Each text's lines are cut into chunks. Of equal chunks of two or more lines, or of one long line, the first by (doc_id, text hash, line) stays and the
    others go, after their bytes have been compared with those of the first. Chunks without anything but white space stay. n_chars, if there is
    one, is renewed.

    With run_words, every passage of whole lines with so many words or more that stands in an earlier place goes too, whatever stands around either:
    its runs, which overlap, are compared by their SHA-256. Blank lines between two runs may stay. A line that goes has an equal one in an earlier
    place, and the earliest of those in equal runs stays. removed_chunks counts chunks and runs.

    A null text stays null; an empty one stays empty; every row stays, with an empty text if nothing is left; rows that agree in doc_id and text
    are one document and have one result; other columns pass through, but columns named removed_chunks or removed_chars are replaced.
    """
    kept = docs.drop("removed_chunks", "removed_chars")
    names = kept.columns
    texts = kept.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    found = _units(texts, divisor, long_line, run_words).select("doc_id", "tie", "u.*")

    place = F.struct("doc_id", "tie", "first")
    found = written(found)
    repeated = found.groupBy("h", "size").agg(F.min(place).alias("origin"), F.max(place).alias("last"), F.first("n").alias("n")).filter(F.col("origin") != F.col("last")).drop("last")
    repeated = written(repeated)
    copies = written(found.join(repeated.drop("n"), ["h", "size"]).filter(place != F.col("origin")).select("doc_id", "tie", "first", "n", "h", "size"))
    discard(found)

    # Only documents that have to do with a repeated chunk are joined, and so shuffled.
    origins = repeated.select("h", "size", "n", F.col("origin.doc_id").alias("doc_id"), F.col("origin.tie").alias("tie"), F.col("origin.first").alias("first"))
    involved = _in_bitmap(origins.select("tie").unionByName(copies.select("tie")))
    rows = involved(kept.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("_row"), "doc_id", F.xxhash64("text").alias("tie")))
    some = rows.filter("_in").drop("_in")

    # The bytes of the first of each.
    by_doc = origins.groupBy(F.col("doc_id").alias("o_doc"), F.col("tie").alias("o_tie")).agg(F.collect_list(F.struct("first", "n", "h", "size")).alias("firsts"))
    firsts = some.join(by_doc, some["doc_id"].eqNullSafe(by_doc["o_doc"]) & (some["tie"] == by_doc["o_tie"])).select(F.col("_row.text").alias("text"), "firsts")
    firsts = firsts.select("firsts", F.inline(F.array(F.struct(_lines(F.col("text")).alias("lines"))))).select("lines", F.explode("firsts").alias("u"))
    firsts = firsts.select("u.h", "u.size", F.expr(_BYTES).alias("bytes")).dropDuplicates(["h", "size"])

    # What each document has to compare.
    same = copies.join(firsts, ["h", "size"]).groupBy(F.col("doc_id").alias("r_doc"), F.col("tie").alias("r_tie")).agg(F.collect_set(F.struct("first", "n", "size", "bytes")).alias("same"))
    whole = some.join(same, some["doc_id"].eqNullSafe(same["r_doc"]) & (some["tie"] == same["r_tie"]), "left").select("_row", "same")
    rest = rows.filter("not _in").select(*(F.col(f"_row.`{n}`").alias(n) for n in names), F.lit(0).cast("long").alias("removed_chunks"), F.lit(0).cast("long").alias("removed_chars"))
    if "n_chars" in names:
        rest = rest.withColumn("n_chars", F.length("text").cast("long"))
    return _without(whole, names).unionByName(rest)


#: A bitmap has at least 16 bits for each key, within these powers of two.
LEAST_BITS, MOST_BITS = 20, 26


def _in_bitmap(keys: DataFrame):
    """A function that adds the column _in to a frame: whether its hash `tie` may be among those of keys.

    It goes by a bitmap of up to 2**MOST_BITS bits (8 MB), which is broadcast: with few keys hardly any other row is let through, with very many all are.
    """
    size = min(1 << MOST_BITS, max(1 << LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    place = F.pmod(F.col("tie"), F.lit(size))
    words = keys.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    bits = [0] * (size >> 6)
    for row in words.toLocalIterator():
        bits[row["word"]] = row["bits"]
    table = keys.sparkSession.createDataFrame([(1, bits)], "_one int, _bits array<long>")

    def add(rows: DataFrame) -> DataFrame:
        joined = rows.withColumn("_one", F.lit(1)).join(F.broadcast(table), "_one")
        joined = joined.withColumn("_word", F.get("_bits", F.shiftright(place, 6).cast("int")))
        return joined.withColumn("_in", F.expr("bit_get(_word, cast(pmod(tie, 64) as int)) = 1")).drop("_one", "_bits", "_word")

    return add


def _without(rows: DataFrame, names: list[str]) -> DataFrame:
    """Take out of the texts the lines of what equals the bytes that `same` has for it."""
    rows = rows.withColumn("lines", F.when(F.col("same").isNotNull(), _lines(F.col("_row.text"))))
    # Arrays of numbers are made distinct and subtracted by hash.
    rows = _stepwise(rows, [
        ("equal", f"filter(same, u -> u.bytes = {_BYTES})"),
        ("gone", "array_distinct(flatten(transform(equal, u -> sequence(u.first, u.first + u.n - 1))))"),
        ("left", "array_except(sequence(0, size(lines) - 1), gone)"),
    ])
    text = F.when(F.col("same").isNull(), F.col("_row.text")).otherwise(F.expr("array_join(transform(left, i -> lines[i]), '\n')"))
    rows = rows.withColumn("_text", text)
    renewed = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast("long")} if "n_chars" in names else {})
    gone = F.when(F.col("same").isNull(), 0).otherwise(F.size("equal")).cast("long")
    lost = (F.coalesce(F.length("_row.text"), F.lit(0)) - F.coalesce(F.length("_text"), F.lit(0))).cast("long")
    return rows.select(*(renewed[n].alias(n) if n in renewed else F.col(f"_row.`{n}`").alias(n) for n in names), gone.alias("removed_chunks"), lost.alias("removed_chars"))
