"""Building corpora under a token budget: filters, prefix sums, cuts, shuffles, splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pretok
from ..schemas import require_columns

#: Rows of a range of the order column, in which running sums are made before the ranges are added up.
RANGE = 4_096


def text_column(df: DataFrame) -> str:
    """text if there is such a column, else the first."""
    return "text" if "text" in df.columns else df.columns[0]


def estimated_tokens(text: Column) -> Column:
    """How many pieces the byte-level pattern finds."""
    return F.size(pretok.byte_level(text)).cast("long")


def non_empty(df: DataFrame, column: str = "text") -> DataFrame:
    return df.filter(F.coalesce(column, F.lit("")) != "")


def at_least(df: DataFrame, column: str, least: int = 50) -> DataFrame:
    return df.filter(F.col(column) >= least)


def skip_prefix(df: DataFrame, consumed: int, order: str = "pos") -> DataFrame:
    return df.filter(F.col(order) >= consumed)


def head(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def select_languages(df: DataFrame, languages: Sequence[str], known: Sequence[str]) -> DataFrame:
    """The rows of some languages; an unknown one is an error."""
    wrong = [x for x in languages if x not in known]
    if wrong:
        raise ValueError(f"unknown language {', '.join(wrong)}; known: {', '.join(known)}")
    return df.filter(F.col("lang").isin(list(languages)))


def ranges_of(order: str) -> tuple[Column, Column]:
    """Coarse and fine ranges of an integer order column for running_sum()."""
    return F.expr(f"`{order}` div {RANGE * RANGE}"), F.expr(f"`{order}` div {RANGE}")


def key_ranges(key: str) -> tuple[Column, Column]:
    """Coarse and fine ranges of a column of hexadecimal digests: 256 and 65,536 of even size."""
    return F.substring(key, 1, 2), F.substring(key, 1, 4)


def joined_on(rows: DataFrame, table: DataFrame, keys: Sequence[str], broadcast: bool = False) -> DataFrame:
    """rows with the other columns of table, which has one row for each value of keys; a null meets a null."""
    other = table.select(*(F.col(f"`{k}`").alias(f"_key_{i}") for i, k in enumerate(keys)), *(f"`{c}`" for c in table.columns if c not in keys))
    met = [rows[f"`{k}`"].eqNullSafe(other[f"_key_{i}"]) for i, k in enumerate(keys)]
    return rows.join(F.broadcast(other) if broadcast else other, met).drop(*(f"_key_{i}" for i in range(len(keys))))


def running_sum(df: DataFrame, value: Column, order: str, name: str, by: Sequence[str] = (), ranges: tuple[Column, Column] | None = None, exclusive: bool = True) -> DataFrame:
    """df with the sum of value over the rows before each (and itself, unless exclusive), in the order of a unique column.

    Sums are made in levels: within the fine ranges of the order (the second of ranges, which doesn't decrease along it and refines the first, the coarse ones), over the
    fine ranges of each coarse one, and over the coarse ones. So no task sees more than the rows of a fine range, the fine ranges of a coarse one, or the coarse ranges
    of one group. Rows whose order is null come first; a null in by is a group of its own.
    """
    coarse, fine = ranges or ranges_of(order)
    rows = df.withColumns({"_coarse": coarse, "_fine": fine, "_value": value.cast("long")})
    before = lambda column, *at: F.coalesce(F.sum(column).over(Window.partitionBy(*by, *at[:-1]).orderBy(at[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.sum("_value").over(Window.partitionBy(*by, "_coarse", "_fine").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0))
    # The fine ranges of a coarse one are an array of a few thousand totals while the coarse ones are summed up, so that the rows are read only once for both.
    totals = rows.groupBy(*by, "_coarse", "_fine").agg(F.sum("_value").alias("_total"))
    totals = totals.groupBy(*by, "_coarse").agg(F.collect_list(F.struct("_fine", F.coalesce("_total", F.lit(0)).alias("_total"))).alias("_ranges"))
    totals = totals.withColumn("_all", F.aggregate("_ranges", F.lit(0).cast("long"), lambda a, x: a + x["_total"]))
    totals = totals.withColumn("_start", before("_all", "_coarse")).select(*by, "_coarse", "_start", F.inline("_ranges"))
    totals = totals.withColumn("_base", F.col("_start") + before("_total", "_coarse", "_fine")).drop("_start", "_total")
    found = joined_on(rows.withColumn("_inner", F.coalesce(inner, F.lit(0))), totals, [*by, "_coarse", "_fine"])
    return found.withColumn(name, F.col("_base") + F.col("_inner")).drop("_coarse", "_fine", "_value", "_base", "_inner")


def budget_cut(df: DataFrame, tokens: str, target: int | Column, order: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows in order until their tokens reach target; the row that crosses it stays."""
    target = F.lit(target) if isinstance(target, int) else target
    return running_sum(df, F.col(tokens), order, "_before", by).filter(F.col("_before") < target).drop("_before")


def dense_uid(df: DataFrame, order: str, offset: int = 0, by: Sequence[str] = (), name: str = "uid") -> DataFrame:
    """Number the rows in order, from offset."""
    return running_sum(df, F.lit(1), order, name, by).withColumn(name, F.col(name) + offset)


def shuffle_key(uid: Column, seed: int = 42) -> Column:
    """A key whose order is a fixed shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), uid.cast("string")))


def shuffled(df: DataFrame, uid: str = "uid", seed: int = 42, by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """df with each row's place in the fixed shuffle."""
    keyed = df.withColumn("_key", shuffle_key(F.col(uid), seed))
    return running_sum(keyed, F.lit(1), "_key", name, by, key_ranges("_key")).drop("_key")


def split_name(place: Column, n: Column, train: float = 0.95, val: float = 0.025) -> Column:
    """train, val or test for a place among n rows; the bounds are the truncated products, in double precision and this order."""
    first = F.floor(n * F.lit(train))
    second = F.floor(n * (F.lit(train) + F.lit(val)))
    return F.when(place < first, "train").when(place < second, "val").otherwise("test")


def with_count(df: DataFrame, by: Sequence[str] = (), name: str = "n") -> DataFrame:
    """df with the number of its rows, or of those of a group: a table of one row for each group, joined. Null is a group too."""
    if not by:
        return df.withColumn("_one", F.lit(1)).join(F.broadcast(df.agg(F.count("*").alias(name)).withColumn("_one", F.lit(1))), "_one").drop("_one")
    return joined_on(df, df.groupBy(*by).agg(F.count("*").alias(name)), by)


def base_corpus(df: DataFrame, order: str, tokens: Column, target: int, least: int = 50, seed: int = 42, train: float = 0.95, val: float = 0.025, by: Sequence[str] = ()) -> DataFrame:
    """Filter by length, cut at the budget, number, shuffle and split; with by, each group for itself."""
    rows = at_least(df.withColumn("tokens", tokens), "tokens", least)
    rows = dense_uid(budget_cut(rows, "tokens", target, order, by), order, by=by)
    placed = with_count(shuffled(rows, "uid", seed, by), by, "_rows")
    return placed.withColumn("split", split_name(F.col("pos"), F.col("_rows"), train, val)).drop("_rows")


def stream_position(base: DataFrame, order: str) -> int:
    """The place in the stream after the last row that a corpus took, from which an extension must start."""
    last = base.agg(F.max(order)).first()[0]
    return 0 if last is None else last + 1


def extension(df: DataFrame, order: str, start: int, tokens: Column, target: int, first_uid: int, least: int = 50, chunk_docs: int = 500_000) -> DataFrame:
    """More rows of the stream from start until target tokens, numbered from first_uid, with the chunk each belongs to."""
    rows = at_least(skip_prefix(df, start, order).withColumn("tokens", tokens), "tokens", least)
    rows = dense_uid(budget_cut(rows, "tokens", target, order), order, first_uid)
    return rows.withColumn("chunk", F.expr(f"(uid - {first_uid}) div {chunk_docs}"))


def half(df: DataFrame, order: str) -> DataFrame:
    """The first half of the rows, rounded down."""
    return with_count(dense_uid(df, order, name="_nth"), name="_rows").filter(F.col("_nth") < F.expr("_rows div 2")).drop("_nth", "_rows")


def train_val_split(df: DataFrame, uid: str = "uid", train: float = 0.95, seed: int = 42) -> DataFrame:
    return with_count(shuffled(df, uid, seed), name="_rows").withColumn("split", F.when(F.col("pos") < F.floor(F.col("_rows") * F.lit(train)), "train").otherwise("val")).drop("_rows")


def merged_languages(base: DataFrame, order: str, half_of: str = "en", seed: int = 42) -> DataFrame:
    """One shuffled train split of all languages, of half_of its first half; test stays by language."""
    parts = base.filter((F.col("split") == "train") & (F.col("lang") != half_of))
    whole = half(base.filter((F.col("split") == "train") & (F.col("lang") == half_of)), order).unionByName(parts)
    return shuffled(whole, order, seed)


def mixed_corpus(df: DataFrame, order: str, tokens: Column, budgets: Mapping[str, int], source: str = "lang") -> DataFrame:
    """Each source up to its budget, numbered on from one source to the next in the order of budgets."""
    amounts = F.create_map(*(F.lit(x) for name, n in budgets.items() for x in (name, n)))
    rank = F.create_map(*(F.lit(x) for i, name in enumerate(budgets) for x in (name, i)))
    rows = non_empty(df).filter(F.col(source).isin(list(budgets))).withColumn("tokens", tokens)
    kept = dense_uid(budget_cut(rows, "tokens", F.element_at(amounts, F.col(source)), order, [source]), order, by=[source], name="_nth")
    sizes = kept.groupBy(source).agg(F.count("*").alias("_rows")).withColumn("_rank", F.element_at(rank, F.col(source)))
    bases = sizes.withColumn("_base", F.coalesce(F.sum("_rows").over(Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return kept.join(F.broadcast(bases.select(source, "_base")), source).withColumn("uid", F.col("_base") + F.col("_nth")).drop("_base", "_nth")


def work_to_do(planned: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is planned and not yet done."""
    return planned.join(done, list(keys), "left_anti")


def estimate_total(df: DataFrame, tokens: str, order: str, sample: int = 1000) -> DataFrame:
    """n_rows, sample_rows, sample_tokens and estimated_tokens: what the first rows have, carried on to all, truncated."""
    first = head(df, sample, order).agg(F.count("*").alias("sample_rows"), F.coalesce(F.sum(tokens), F.lit(0)).alias("sample_tokens"))
    total = df.agg(F.count("*").alias("n_rows"))
    both = total.withColumn("_one", F.lit(1)).join(F.broadcast(first.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return both.withColumn("estimated_tokens", F.when(F.col("sample_rows") > 0, F.expr("sample_tokens * n_rows div sample_rows")).otherwise(F.lit(0)))


def validated(df: DataFrame, order: str, ids: str = "input_ids", sample: int | None = 1000) -> DataFrame:
    """Number of rows, least, greatest and mean length, and range of ids, over the first rows or (sample None) all."""
    require_columns(df, [ids], "dataset")
    rows = head(df, sample, order) if sample else df
    size = F.size(ids)
    return rows.agg(
        F.count("*").alias("n_rows"), F.min(size).alias("min_len"), F.max(size).alias("max_len"), F.round(F.avg(size), 6).alias("avg_len"),
        F.min(F.array_min(ids)).alias("min_id"), F.max(F.array_max(ids)).alias("max_id"),
    )
