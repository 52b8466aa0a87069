"""Corpus building, packing, scoring, sinks and streams."""

import json
import random

import numpy as np
import pytest
from corpusloom.operators import corpus, inference, packing, results, scoring, statistics, vocabulary
from corpusloom.schemas import SCHEMAS, require_columns
from corpusloom.sources import readers, writers
from corpusloom.streaming import decode as streams
from corpusloom.streaming import events, ingest
from pyspark.sql import functions as F


@pytest.mark.parametrize("seed", range(4))
def test_budget_cut(spark, seed):
    rng = random.Random(seed)
    counts = [rng.randrange(300) for _ in range(rng.randrange(1, 400))]
    target = rng.randrange(1, 20_000)
    kept, total = [], 0
    for i, n in enumerate(counts):
        if total >= target:
            break
        kept.append(i)
        total += n
    rows = spark.createDataFrame(list(enumerate(counts)), "pos long, n long").repartition(3)
    assert sorted(r["pos"] for r in corpus.budget_cut(rows, "n", target, "pos").collect()) == kept


def test_running_sums_over_many_ranges(spark):
    rows = spark.range(0, 30_000).select((F.col("id") * 3).alias("pos"), F.lit(2).alias("v"))
    found = corpus.running_sum(rows, F.col("v"), "pos", "s")
    assert found.filter("s <> pos div 3 * 2").count() == 0 and found.count() == 30_000


def test_null_groups_and_orders_are_kept(spark):
    """A null in by is a group like any other, and rows whose order is null come first."""
    rows = [(i, None if i % 3 == 0 else "ab"[i % 2], i % 7) for i in range(30)]
    table = spark.createDataFrame(rows, "pos long, g string, n long").repartition(3)
    before = {}
    wanted = {}
    for i, g, n in rows:
        wanted[i] = before.get(g, 0)
        before[g] = before.get(g, 0) + n
    assert {r["pos"]: r["s"] for r in corpus.running_sum(table, F.col("n"), "pos", "s", ["g"]).collect()} == wanted
    assert {r["pos"]: r["k"] for r in corpus.with_count(table, ["g"], "k").collect()} == {i: 10 for i in range(30)}
    assert sorted(r["pos"] for r in corpus.budget_cut(table, "n", 12, "pos", ["g"]).collect()) == sorted(i for i in wanted if wanted[i] < 12)
    base = corpus.base_corpus(table, "pos", F.col("n"), 1000, least=0, by=["g"])
    assert base.count() == 30 and sorted(r["uid"] for r in base.filter("g is null").collect()) == list(range(10))
    shares = statistics.with_shares(table, "n", ["g"]).groupBy("g").agg(F.sum("p").alias("p")).collect()
    assert len(shares) == 3 and all(r["p"] == pytest.approx(1) for r in shares)
    ranks = statistics.ranked(table, "pos", "n", ["g"]).collect()
    for g in (None, "a", "b"):
        own = sorted((r for r in ranks if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and [(r["n"], r["pos"]) for r in own] == sorted(((r["n"], r["pos"]) for r in own), key=lambda x: (-x[0], x[1]))
    late = spark.createDataFrame([(None, 5), (0, 1), (9000, 2), (20_000_000, 3)], "pos long, n long")
    assert sorted((r["n"], r["s"]) for r in corpus.running_sum(late, F.col("n"), "pos", "s").collect()) == [(1, 5), (2, 6), (3, 8), (5, 0)]


def test_texts_are_numbered_by_their_paths(spark, tmp_path):
    for name, text in (("b.txt", "two\nlines"), ("a.txt", "one"), ("c.md", "no")):
        (tmp_path / name).write_text(text)
    assert [(r["uid"], r["text"]) for r in readers.whole_texts(spark, str(tmp_path)).orderBy("uid").collect()] == [(0, "one"), (1, "two\nlines")]


def test_failing_settings_are_skipped(spark):
    rows = spark.createDataFrame([("x", True)], "phenomenon string, correct boolean")

    def missing():
        return spark.read.parquet("/nowhere/at/all")

    found, failed = scoring.settings_accuracy({"a": lambda: rows, "b": missing})
    assert [r["setting"] for r in found.collect()] == ["a"] and set(failed) == {"b"}
    assert scoring.settings_accuracy({"b": missing})[0] is None


def test_windows_score_each_token_once(spark):
    docs = spark.createDataFrame([(1, list(range(1, 40))), (2, [3]), (3, [1, 2])], "uid long, input_ids array<int>")
    costs = spark.createDataFrame([(i, i / 10) for i in range(1, 30)] + [(None, 9.0)], "token_id int, nats double")
    rows = {r["uid"]: r for r in scoring.window_logprobs(docs, costs, 8, 3).collect()}
    assert rows[1]["token_ids"] == list(range(1, 40)) and rows[1]["token_logprobs"] == [0.0, *(-i / 10 if i < 30 else -9.0 for i in range(2, 40))]
    assert rows[3]["token_logprobs"] == [0.0, -0.2]


def test_a_model_with_few_tokens_has_an_error(spark):
    stats = spark.createDataFrame([("m", i, float(i % 5)) for i in range(40)] + [("few", 3, 1.0)], "model string, token_id long, y double")
    merges = spark.createDataFrame([(i, i) for i in range(40)], "token_id long, rank long")
    found = {r["model"]: r for r in inference.compared_models(stats, merges, "y", 20.0, 15.0).collect()}
    assert found["m"]["error"] is None and found["m"]["effect"] is not None and "fewer than 10" in found["few"]["error"]


def test_extension_starts_after_the_base(spark):
    docs = spark.createDataFrame([(i, "word " * 60) for i in range(40)], "doc_id long, text string")
    tokens = corpus.estimated_tokens(F.col("text"))
    base = corpus.base_corpus(docs, "doc_id", tokens, 600)
    start = corpus.stream_position(base, "doc_id")
    more = corpus.extension(docs, "doc_id", start, tokens, 300, base.count())
    assert base.join(more, "doc_id").count() == 0 and more.agg(F.min("uid")).first()[0] == base.count()
    assert set(base.groupBy("split").count().toPandas()["split"]) <= {"train", "val", "test"}


def test_languages_and_columns(spark):
    docs = spark.createDataFrame([("x", "en")], "text string, lang string")
    with pytest.raises(ValueError, match="unknown language"):
        corpus.select_languages(docs, ["xx"], ["en"])
    with pytest.raises(ValueError, match="lacks uid"):
        require_columns(docs, ["uid"])
    assert corpus.text_column(docs) == "text" and corpus.text_column(docs.select("lang")) == "lang" and len(SCHEMAS) >= 26


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_packing_rebuilds_the_stream(spark, seed):
    rng = np.random.default_rng(42)
    docs = [(u, rng.integers(1, 1000, rng.integers(50, 200)).tolist()) for u in range(100)]
    table = spark.createDataFrame(docs, "uid long, input_ids array<int>")
    order = [r["uid"] for r in packing.document_index(table, seed).orderBy("start").collect()]
    stream = [t for u in order for t in [*docs[u][1], 0]]
    found = {r["seq_id"]: r["tokens"] for r in packing.pack_sequences(table, 128, 0, seed).collect()}
    assert len(found) == len(stream) // 129 and all(found[i] == stream[i * 129 : (i + 1) * 129] for i in found)
    assert (order == sorted(order)) == (seed is None)


def test_locate(spark):
    index = spark.createDataFrame([(0, 0, 10), (1, 10, 15), (2, 25, 25), (3, 50, 50)], "uid long, start long, len long")
    asked = spark.createDataFrame([(p,) for p in (0, 5, 10, 15, 25, 49, 50, 99)], "pos long")
    found = {r["pos"]: r["uid"] for r in packing.locate(asked, index, block=2).collect()}
    assert found == {0: 0, 5: 0, 10: 1, 15: 1, 25: 2, 49: 2, 50: 3, 99: 3}


@pytest.mark.parametrize(("sizes", "budget", "batches"), [([10] * 5, 100, 1), ([50] * 10, 150, 4), ([], 10, 0), ([200, 1], 100, 2)])
def test_token_budget_batches(spark, sizes, budget, batches):
    table = spark.createDataFrame([(i, [1] * n) for i, n in enumerate(sizes)], "uid long, input_ids array<int>")
    rows = packing.token_budget_batches(table, budget).collect()
    by = {}
    for r in rows:
        by.setdefault((r["shard"], r["batch"]), []).append(len(r["input_ids"]))
    assert len(by) == batches and all(max(b) * len(b) <= budget or len(b) == 1 for b in by.values())


def test_left_padding(spark):
    table = spark.createDataFrame([(100, [1, 2, 3, 4, 5], 0), (200, [6, 7, 8], 0)], "uid long, input_ids array<int>, batch int")
    found = {r["uid"]: (r["input_ids"], r["mask"]) for r in packing.left_padded(table).collect()}
    assert found == {100: ([1, 2, 3, 4, 5], [1] * 5), 200: ([0, 0, 6, 7, 8], [0, 0, 1, 1, 1])}


@pytest.mark.parametrize(("n", "window", "stride"), [(1, 64, 32), (2, 64, 32), (64, 64, 32), (65, 64, 32), (256, 64, 32), (1000, 64, 64), (97, 32, 8)])
def test_windows_count_each_target_once(spark, n, window, stride):
    rows = packing.sliding_windows(spark.createDataFrame([(0, n)], "uid long, n int"), window, stride).collect()
    targets = [t for r in rows for t in range(r["new_from"], r["end"] + 1)]
    assert sorted(targets) == list(range(1, n)) and all(r["end"] - r["start"] <= window and r["new_from"] > r["start"] for r in rows)


def test_batches(spark):
    rows = spark.range(100).withColumnRenamed("id", "pos")
    assert packing.batches(rows, 8).count() == 96 and packing.batches(rows, 8, drop_last=False).count() == 100
    halves = [packing.batches(rows, 4, world=2, rank=r, skip=3) for r in (0, 1)]
    assert {r["pos"] % 2 for r in halves[1].collect()} == {1} and halves[0].agg(F.min("batch_id")).first()[0] == 3


def test_scorers_agree(spark):
    docs = [(i, [random.Random(i).randrange(9) for _ in range(40 + i)]) for i in range(12)]
    table = spark.createDataFrame(docs, "uid long, input_ids array<int>")
    costs = {t: 0.5 + t / 7 for t in range(8)}
    windows = packing.sliding_windows(table.withColumn("n", F.size("input_ids")), 16, 8)
    found = {r["uid"]: r["loss_nats"] for r in scoring.windowed_losses(windows, scoring.unigram_scorer(costs, 3.0)).collect()}
    assert found == {u: pytest.approx(sum(costs.get(t, 3.0) for t in ids[1:])) for u, ids in docs}
    probs = scoring.token_logprobs(table, costs, 3.0)
    assert {r["uid"]: -sum(r["token_logprobs"]) for r in probs.collect()} == {u: pytest.approx(x) for u, x in found.items()}


def test_ties_are_wrong(spark):
    pairs = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "logprob_good double, logprob_bad double")
    assert [r["correct"] for r in scoring.pair_accuracy(pairs).collect()] == [False, True]
    assert scoring.steps_for_budget(10_000_000) == 38


def test_discontinuity(spark):
    rng = np.random.default_rng(0)
    r = np.arange(0, 200)
    y = 1 + 0.01 * r + 2.5 * (r < 100) + rng.normal(0, 0.1, 200)
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(r, y, strict=True)], "merge_order long, y double")
    kept = inference.kernel_weights(rows, "merge_order", 100, 50)
    found = inference.discontinuity(kept, "y").first()
    x, w = r[np.abs(r - 100) <= 50] - 100.0, 1 - np.abs(r[np.abs(r - 100) <= 50] - 100) / 50
    d = (x < 0).astype(float)
    m = np.stack([np.ones_like(x), d, x, d * x], 1)
    v = y[np.abs(r - 100) <= 50]
    inv = np.linalg.inv(m.T @ (m * w[:, None]))
    beta = inv @ (m.T @ (w * v))
    se = np.sqrt((w * (v - m @ beta) ** 2).sum() / (len(x) - 4) * inv[1, 1])
    assert found["effect"] == pytest.approx(beta[1], abs=1e-5) and found["se"] == pytest.approx(se, abs=1e-5) and found["p"] < 1e-6 and found["n"] == 101
    assert inference.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-6)


def test_vocabularies(spark):
    merges = spark.createDataFrame([(0, "a", "b", "ab"), (1, "ab", "c", "abc"), (2, "x", "y", "xy"), (3, "abc", "d", "abcd"), (4, "q", "r", "qr")], "rank int, left string, right string, result string")
    gone = {r["token"]: r["absorbed"] for r in vocabulary.absorptions(merges).collect()}
    assert gone == {"ab": 1, "abc": 3, "xy": None, "abcd": None, "qr": None}
    assert sorted(map(tuple, vocabulary.merge_chains(merges).collect())) == [("ab", "abcd", 2)]
    assert {r[0] for r in vocabulary.absorbed_anywhere(merges).collect()} == {"ab", "abc"}
    words = statistics.symbols(spark.createDataFrame([("aaab", 2), ("a.b", 1)], "word string, cnt long"))
    assert sorted(r["syms"] for r in vocabulary.apply_merge(words, "a", "a").collect()) == [["a", ".", "b"], ["aa", "a", "b"]]
    assert inference.pairs_of_models(spark.createDataFrame([("m1",), ("m2",), ("base",)], "model string"), baseline="base").count() == 2
    with pytest.raises(ValueError, match="match"):
        inference.pairs_of_models(spark.createDataFrame([("m1",), ("m2",)], "model string"), baseline="m")


def test_run_names(spark):
    runs = spark.createDataFrame([("me57M-tied_bpe-128k_2Btok_seed3",), ("me1B-tied_unigramlm-8k_10Btok_seed0",), ("other",)], "run string")
    found = [r["r"] for r in runs.select(results.parse_run(F.col("run")).alias("r")).collect()]
    assert found[0]["size"] == "57M" and found[0]["seed"] == 3 and found[1]["tokenizer"] == "unigramlm" and found[2] is None
    assert [r[0] is None for r in runs.select(results.parse_run(F.col("run"), "M")).collect()] == [False, True, True]
    names = spark.createDataFrame([("bpe-128k",), ("bottomup-ll-8k",), ("own",)], "n string").select(results.method_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["BPE", "BottomUpLL-8k", "own"]


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "x long, s string")
    for suffix in ("json", "csv", "orc", "parquet"):
        writers.table(rows, str(tmp_path / f"t.{suffix}"))
    assert readers.parquet(spark, str(tmp_path / "t.parquet")).count() == 2 and spark.read.orc(str(tmp_path / "t.orc")).count() == 2
    assert spark.read.csv(str(tmp_path / "t.csv"), header=True).count() == 2
    (tmp_path / "docs").mkdir()
    for n in "ba":
        (tmp_path / "docs" / f"{n}.txt").write_text(f"text {n}\nmore")
    assert [(r["uid"], r["text"][:6]) for r in readers.whole_texts(spark, str(tmp_path / "docs")).orderBy("uid").collect()] == [(0, "text a"), (1, "text b")]
    (tmp_path / "v.json").write_text(json.dumps({"model": {"vocab": {"a": 0, "ab": 1}, "merges": ["a b", ["ab", "c d"]]}}))
    assert readers.vocabulary(spark, str(tmp_path / "v.json")).count() == 2
    assert [(r["left"], r["right"]) for r in readers.merges(spark, str(tmp_path / "v.json")).collect()] == [("a", "b"), ("ab", "c d")]
    (tmp_path / "m.txt").write_text("#version: 0.2\na b\n")
    assert readers.merges(spark, str(tmp_path / "m.txt")).first()["result"] == "ab"
    calls = []
    for _ in range(2):
        writers.once(lambda: calls.append(1) or rows, str(tmp_path / "once"), spark)
    assert len(calls) == 1
    assert writers.summary(rows.filter("x = 1"), str(tmp_path / "s.json")) == {"x": 1, "s": "a"}
    assert "| 1 | a |" in writers.markdown(rows) and "| 2 | - |" in writers.markdown(rows)
    counts = spark.createDataFrame([('{"a b": {"token_id": 3, "merge_order": 0}, "c d": {"token_id": 4, "merge_order": 1, "count": 7}}',)], "value string")
    assert sorted((r["merge"], r["count"]) for r in readers.merge_counts(counts).collect()) == [("a b", 0), ("c d", 7)]


def test_chunks_go_on_where_they_stood(spark, tmp_path):
    rows = spark.createDataFrame([(i, 10, i // 3) for i in range(9)], "doc_id long, tokens long, chunk int")
    path = str(tmp_path / "chunks")
    writers.chunks(rows.filter("chunk < 2"), path)
    state = writers.chunks(rows, path)
    assert state == {"stream_pos": 9, "tokens": 90, "docs": 9, "chunks": 3} and writers.is_done(spark, path)


def test_ingest_stream(spark, tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    docs = spark.createDataFrame([(i, "word " * 60) for i in range(30)], "doc_id long, text string")
    docs.filter("doc_id < 10").coalesce(1).write.parquet(land)
    schema = "doc_id long, text string"
    ingest.into_chunks(ingest.landed(spark, land, schema), out, 900).awaitTermination()
    docs.filter("doc_id >= 10").coalesce(1).write.mode("append").parquet(land)
    ingest.into_chunks(ingest.landed(spark, land, schema), out, 900).awaitTermination()
    kept = spark.read.parquet(f"{out}/chunk_*")
    assert kept.agg(F.sum("tokens")).first()[0] >= 900 and kept.count() == 15
    assert sorted(r["uid"] for r in kept.collect()) == list(range(15))


def test_streamed_decoding(spark, tmp_path):
    text = "héllo 日本 🙂!"
    stream = streams.DecodeStream(lambda ids: bytes(ids).decode("utf-8", "replace"))
    parts = [stream.step(b) for b in text.encode()]
    assert "".join(p for p in parts if p) == text and any(p is None for p in parts)


def test_streamed_windows(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = str(tmp_path / "events")
    table.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(table.schema).parquet(path)
    query = events.windowed(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == table.count() == events.windowed(table, "1 hour").agg(F.sum("n")).first()[0]
    assert events.sessions(table, "30 minutes").agg(F.sum("n")).first()[0] == table.count()
