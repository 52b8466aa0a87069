"""Names of runs and tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A fixed value: how runs are named.
RUN = r"^me(\d+[MB])-tied_(.+?)-([^_]+)_(\d+)Btok_seed(\d+)$"


def parse_run(run: Column, sizes: str = "MB") -> Column:
    """size, tokenizer, vocab, budget and seed of a run's name; null if it isn't one. sizes "M" takes names of millions only, as older tools do."""
    parts = [F.regexp_extract(run, RUN, i) for i in range(1, 6)]
    made = F.struct(parts[0].alias("size"), parts[1].alias("tokenizer"), parts[2].alias("vocab"), parts[3].alias("budget"), parts[4].try_cast("int").alias("seed"))
    return F.when(run.rlike(RUN) & F.substring(parts[0], -1, 1).isin(list(sizes)), made)


def tokenizer_of(run: Column) -> Column:
    """The tokenizer's directory name in a run's name."""
    return F.regexp_replace(F.regexp_replace(run, r"^me\d+[MB]-tied_", ""), r"_\d+Btok_seed\d+$", "")


def method_name(name: Column) -> Column:
    """Short names of the methods; the size suffix of the largest vocabulary goes."""
    # The methods and what they are called.
    short = {"bpe": "BPE", "bottomup-ll": "BottomUpLL", "bottomup-ll-approx": "BottomUpLL-approx", "topdown-comp": "TopDownComp", "unigramlm": "UnigramLM"}
    table = F.create_map(*(F.lit(x) for pair in short.items() for x in pair))
    base, size = F.regexp_extract(name, r"^(.*?)(?:-(\d+k))?$", 1), F.regexp_extract(name, r"-(\d+k)$", 1)
    called = F.coalesce(F.try_element_at(table, base), base)
    return F.when((size == "") | (size == "128k"), called).otherwise(F.concat_ws("-", called, size))


def placed(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with their place, from 0, in an order; of a table of results, which is small."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)


def gathered(rows: DataFrame) -> DataFrame:
    """Results in the order of size, vocabulary and bpb (9 if there is none), sizes as text."""
    return rows.orderBy("size", "vocab", F.coalesce("bpb", F.lit(9.0)))
