"""What queries send to Python, shuffle or read again, where it decides whether they fit at size."""

import pytest
from corpusloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["piece_offsets", "trimmed_offsets"])
def test_offsets_send_lengths_alone_to_python(spark, name):
    """An array of whole pieces with their ranges takes gigabytes of a batch."""
    rows = catalogue.QUERIES[name](spark, SF)
    sent = [x for x in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "EvalPython" in x]
    assert len(sent) == 1 and "transform(" in sent[0] and "length(" in sent[0] and "run(" not in sent[0]


def test_draws_by_md5_are_looked_up_not_joined(spark):
    """A row for each draw doesn't get through a shuffle at size."""
    import hashlib

    from corpusloom.operators import inference

    n = 12_345
    found = {b: [] for b in (0, 7, 10, 123)}
    for b, drawn in inference.draws_of(tuple(found), 0, n, n):
        found[b] += drawn.tolist()
    assert all(x == [int(hashlib.md5(f"{b}:{i}".encode()).hexdigest()[:12], 16) % n for i in range(n)] for b, x in found.items())
    rows = spark.range(100).selectExpr("id as uid", "id * 1.5D as loss_nats", "id as num_bytes")
    sums = inference._resampled(rows, 20, ["loss_nats", "num_bytes"])
    assert "md5" not in plan(sums) and "Join" not in plan(sums)
    first = [int(hashlib.md5(f"3:{i}".encode()).hexdigest()[:12], 16) % 100 for i in range(100)]
    assert sums.filter("replicate = 3").collect()[0].asDict() == {"replicate": 3, "loss_nats": sum(first) * 1.5, "num_bytes": sum(first)}


def test_losses_shuffle_rare_pieces_alone(spark):
    """Frequent pieces get their costs by a broadcast and are summed up where they stand."""
    from corpusloom.operators import scoring

    docs = spark.createDataFrame([(1, "a b a c", list("abac")), (2, "a", ["a"]), (3, "a a b", list("aab"))], "uid long, text string, pieces array<string>")
    rows = scoring.document_losses(docs, scoring.unigram_model(docs))
    assert plan(rows).count("strategy=broadcast") >= 2 and {r["uid"]: round(r["loss_nats"], 6) for r in rows.collect()} == {1: 3.871201, 3: 2.079442}


def test_absorptions_shuffle_no_single_characters(spark):
    """Which no merge makes, and which would all meet in a few tasks."""
    from corpusloom.operators import vocabulary

    merges = spark.createDataFrame([(0, "a", "b", "ab"), (1, "ab", "c", "abc"), (2, "x", "y", "xy")], "rank long, left string, right string, result string")
    rows = vocabulary.absorptions(merges)
    assert "length(token" in plan(rows) or "length(left" in plan(rows)
    assert sorted(map(tuple, rows.collect())) == [("ab", 0, 1), ("abc", 1, None), ("xy", 2, None)]


@pytest.mark.parametrize("name", ["train_unigram", "train_topdown"])
def test_trainers_read_kept_words(spark, monkeypatch, name):
    """Passes over words that are made anew from all texts each time take the time of the corpus, not of its words."""
    from corpusloom.models import unigram

    seen, sums = [], unigram._sums
    monkeypatch.setattr(unigram, "_sums", lambda words, *a, **k: seen.append(plan(words)) or sums(words, *a, **k))
    words = spark.createDataFrame([("abab", 3), ("abc", 5)], "word string, cnt long").groupBy("word").sum("cnt").withColumnRenamed("sum(cnt)", "cnt")
    config = unigram.UnigramConfig(vocab_size=3) if name == "train_unigram" else unigram.TopDownConfig(vocab_size=3, prune_ratio=0.5)
    getattr(unigram, name)(words, config)
    assert seen and not any("Aggregate" in x for x in seen)


def test_trimmed_offsets_keep_texts_waiting_not_pieces(spark):
    """Arrays of pieces beside each text that waits for Python take several times the text; and a piece's ends are not looked for in a function of arrays."""
    rows = catalogue.QUERIES["trimmed_offsets"](spark, SF)
    lines = plan(rows).splitlines()
    below = lines[next(i for i, x in enumerate(lines) if "EvalPython" in x) + 1 :]
    assert not any("regexp_extract_all" in x for x in below)
    assert not any("transform(" in x and "regexp_replace(" in x for x in lines)


@pytest.mark.parametrize("kind", ["count", "ll_exact", "ll_approx"])
def test_trainers_keep_words_as_numbers(kind):
    """A task trains from all distinct words; lists and sets for each of them take about a kilobyte a word."""
    import random
    import tracemalloc

    from corpusloom.models import bpe

    rng = random.Random(3)
    words = [("".join(rng.choices("abcdefghij", k=8)), 3) for _ in range(60_000)]
    tracemalloc.start()
    found = bpe.train_counts(words, bpe.BpeConfig(vocab_size=40, score_by=kind))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found.merges) == 30 and peak / len(words) < 250


def test_words_reach_the_trainer_in_batches(spark):
    """A group that is made into one frame holds every word at once, as objects."""
    from corpusloom.models import bpe

    rows = bpe.train_all(spark.createDataFrame([("abab", 3), ("abc", 5)], "word string, cnt long"), {"a": bpe.BpeConfig(vocab_size=5), "b": bpe.BpeConfig(vocab_size=4)})
    assert "MapInArrow" in plan(rows) and "FlatMapGroupsInPandas" not in plan(rows)
    assert sorted((r["config"], r["rank"], r["result"], r["cnt"]) for r in rows.collect()) == [("a", 0, "ab", 11), ("a", 1, "abc", 5), ("b", 0, "ab", 11)]


def test_pipelines_train_once_from_counted_pieces(spark, monkeypatch):
    """Sorting the merges in Spark trained twice, and the alphabet counted the pieces of all texts again."""
    from corpusloom.models import bpe, pipeline

    seen, trained, train_all = [], [], pipeline.train_all
    runs = spark.sparkContext.accumulator(0)

    def counting(words, configs):
        seen.append(plan(words))
        rows = train_all(words, configs)
        schema = rows.schema

        def once(batches):
            runs.add(1)
            yield from batches

        trained.append(schema)
        return rows.mapInArrow(once, schema)

    monkeypatch.setattr(pipeline, "train_all", counting)
    docs = spark.createDataFrame([(1, "abab abc"), (2, "abc ab")], "uid long, text string")
    made = pipeline.byte_level_bpe(docs, bpe.BpeConfig(vocab_size=6))
    assert made.model.merges[0] == ("a", "b") and len(made.model.vocab) == 6
    assert not any("regexp_extract_all" in x for x in seen) and runs.value == len(trained) == 1


def test_logprobs_deal_frequent_tokens_out(spark):
    """All rows of a frequent token would meet in one task."""
    from corpusloom.operators import scoring

    docs = spark.createDataFrame([(1, [7, 7, 8, 9]), (2, [7]), (3, [])], "uid long, input_ids array<int>")
    costs = spark.createDataFrame([(7, 1.0), (8, 20.0), (None, 30.0)], "token_id int, nats double")
    rows = scoring.joined_logprobs(docs, costs)
    assert plan(rows).count("strategy=broadcast") >= 2 and "_salt" in plan(rows)
    assert sorted(map(tuple, rows.collect())) == [(1, 7, 0, 0.0), (1, 7, 1, -1.0), (1, 8, 2, -20.0), (1, 9, 3, -30.0), (2, 7, 0, 0.0)]


def test_budget_batches_send_lengths_alone_to_python(spark):
    """A shard of whole documents in one frame takes gigabytes; and an aggregate that needs no order must not take the order from the numbering."""
    from corpusloom.operators import packing

    sizes = [(37 * i) % 101 for i in range(400)]
    docs = spark.createDataFrame([(i, [7] * n) for i, n in enumerate(sizes)], "uid long, input_ids array<int>").repartition(5)
    rows = packing.token_budget_batches(docs, 300, shard=64)
    sent = [x for x in plan(rows).splitlines() if "EvalPython" in x]
    assert len(sent) == 1 and "input_ids" not in sent[0].split("[pythonUDF")[0] and "FlatMapGroupsInPandas" not in plan(rows)
    order, expected, held = sorted(range(400), key=lambda i: (-sizes[i], str(i))), {}, 0
    for nth, i in enumerate(order):
        first = order[nth - held] if held else i
        if nth % 64 == 0:
            batch, held = 0, 1
        elif sizes[first] * (held + 1) > 300:
            batch, held = batch + 1, 1
        else:
            held += 1
        expected[i] = (nth // 64, batch)
    assert {r["uid"]: (r["shard"], r["batch"]) for r in rows.collect()} == expected and all(len(r["input_ids"]) == sizes[r["uid"]] for r in rows.collect())
    counts = rows.groupBy("shard", "batch").count().collect()
    assert sorted((r["shard"], r["batch"], r["count"]) for r in counts) == sorted((*k, list(expected.values()).count(k)) for k in set(expected.values()))
