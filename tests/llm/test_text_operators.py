"""Operators on texts against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import bisect
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from corpusloom.llm import bytehash, fingerprints, jaccard, language, licenses, lines, mixing, packing, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tie string, same int, row string, copy int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def made(seed=0, n=60):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 120))) for _ in range(n)]
    rows = [(i, t.replace(" mu ", "\n"), "en" if i % 2 else "fr", f"s{i % 3}") for i, t in enumerate(texts)]
    base = " ".join(rng.choices(WORDS, k=200))
    for i in range(30):  # near copies
        words = base.split()
        for _ in range(i % 4):
            words[rng.randrange(200)] = f"new{rng.random()}"
        rows.append((100 + i, " ".join(words), None, "s0"))
    rows += [(200, None, "en", None), (201, "", "en", "s1"), (202, " \n\t ", None, "s1"), (203, rows[0][1], "en", None), (None, rows[1][1], "en", "s2"), (None, "only here " * 3, None, None)]
    rows += [(204, "One two", "en", "s0"), (205, "one TWO", "en", "s0"), (206, "x" * 5000, "en", "s0"), (204, "One two", "en", "s0"), (207, "word " * 3000, "en", "s1")]
    return [(d, t, lang, s, None if t is None else len(t), "t", 1, "r", 2) for d, t, lang, s in rows]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def groups(texts, k, percent):
    """Of each text the least number of a text that links lead to."""
    own, root = [sets(t, k) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(own[i] & own[j])
        if own[i] and own[j] and 100 * common >= percent * len(own[i] | own[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))], own


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard_groups(docs, rows, k, percent):
    roots, own = groups([r[1] for r in rows], k, percent)
    members = collections.defaultdict(list)
    for i, r in enumerate(roots):
        members[r].append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in members.items()}
    wanted = sorted(((rows[i][0], len(own[i]), least[roots[i]] if own[i] else rows[i][0]) for i in range(len(rows))), key=str)
    assert sorted((tuple(r) for r in jaccard.jaccard_groups(docs, k, percent).collect()), key=str) == wanted


def test_jaccard_finds_all_of_a_large_group(spark):
    rng, base = random.Random(5), [f"w{i}" for i in range(60)]
    texts = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(60)] = f"x{rng.random()}"
        texts.append(" ".join(words))
    roots, _ = groups(texts, 3, 90)
    found = jaccard.jaccard_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 90).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(roots))


def test_jaccard_links_short_texts(spark):
    """Pairs of 1 to 15 shingles that differ by one or two words at either end or by one in between."""
    texts, rng = [], random.Random(5)
    for n, turn in itertools.product(range(5, 20), range(6)):
        words = [f"w{rng.random()}" for _ in range(n)]
        near = [words[:-1], words[1:], words[:-2], words[2:], words[1:-1], [*words[: n // 2], "other", *words[n // 2 + 1 :]]][turn]
        texts += [" ".join(words), " ".join(near)]
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 80).collect()}
    expected = {}
    for i in range(0, len(texts), 2):
        a, b = sets(texts[i], 5), sets(texts[i + 1], 5)
        expected |= {i: i, i + 1: i if 100 * len(a & b) >= 80 * len(a | b) else i + 1}
    assert found == expected and sum(i != c for i, c in expected.items()) >= 40


def test_words_are_told_apart_whatever_their_pattern(spark):
    """Two words of which a sum of powers modulo 2**64 would be equal."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [f"{word} one two three", f"{other} one two three", f"{word[:300]} x", f"{other[:300]} x"]
    found = jaccard.jaccard_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_any_id_is_an_id(spark):
    least = -(1 << 63)
    rows = [(least, "one two three four"), (5, "one two three four"), (None, "one two three four"), (7, "other words here")]
    found = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in found), key=str) == sorted([(least, least), (5, least), (None, least), (7, 7)], key=str)
    kept = jaccard.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted(r["doc_id"] for r in kept) == [least, 7]


def test_parities_bound_what_sets_differ_in():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 3000):
        a, b = (np.unique(rng.integers(0, 2 * n + 2, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        apart = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in (shingles.parities(a) ^ shingles.parities(b)).tolist())
        assert apart <= len(np.setxor1d(a, b)) and (apart == 0) == (apart % 2 == 0 and np.array_equal(shingles.parities(a), shingles.parities(b)))


def test_hashes_of_parts():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 4, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 3000)
    ends = starts + rng.choice([0, 1, 2, 3, 7, 8, 9, 16, 17, 900], 3000)
    found, seen = bytehash.part_hashes(data, starts, ends).tolist(), {}
    for h, a, b in zip(found, starts, ends, strict=True):
        assert seen.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_first_of_groups(docs, rows):
    roots, own = groups([r[1] for r in rows], 5, 80)
    kept = jaccard.first_of_groups(docs, 5, 80).collect()
    assert len(kept) == len({r for r, s in zip(roots, own, strict=True) if s}) + sum(not s for s in own)
    assert kept[0].asDict().keys() == {c.split()[0] for c in DOCS.split(", ")} and all(r["tie"] == "t" for r in kept)


def test_frequent_counts_are_never_too_high():
    rng, counter = np.random.default_rng(0), jaccard.Frequent(50)
    values = rng.zipf(1.3, 20_000).astype(np.uint64)
    for part in np.array_split(values, 13):
        counter.add(part)
    counter.merge()
    true = collections.Counter(values.tolist())
    assert all(n <= true[v] for v, n in zip(counter.values.tolist(), counter.counts.tolist(), strict=True))
    assert {v for v, n in true.items() if n > len(values) / 25} <= set(counter.values.tolist())


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.public_tokenizer()[0])
    found = packing.pack_documents(docs).collect()
    ids = [np.array([*exact.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows]
    wanted = collections.Counter()
    for r, x in zip(rows, ids, strict=True):
        first = len(x) % 1024 or 1024
        edges = [0, *range(first, len(x) + 1, 1024)]
        wanted.update((r[0], i, a, b - a, zlib.crc32(x[a:b].tobytes())) for i, (a, b) in enumerate(itertools.pairwise(edges)))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == wanted
    places = collections.defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [0, *itertools.accumulate(n for _, n in p)][:-1] and sum(n for _, n in p) <= 1024
    assert len(places) <= -(-sum(map(len, ids)) // 1024) + 2


def test_fast_ids_are_those_of_tokenizers():
    encode = packing.Encoder(*packing.public_tokenizer())
    for t in ("", "Hello  world", "a<|endoftext|>b", "日本語 ñandú 123", " " * 20_000 + "x", "\n\n\t", "it's we'll 'quoted'", "é\u0301 🙂"):
        assert encode(t).tolist() == encode.exact.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(5))
def test_sum_of_squares(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 101, 400)
    bins, offsets, n = packing.sum_of_squares(sizes, 100)
    for b in range(n):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == [0, *np.cumsum(sizes[own])[:-1]] and sizes[own].sum() <= 100
    gaps, fitted = [], 0  # best fit of descending items
    for x in sorted(sizes.tolist(), reverse=True):
        at = bisect.bisect_left(gaps, x)
        fitted += at == len(gaps)
        bisect.insort(gaps, (gaps.pop(at) if at < len(gaps) else 100) - x)
    assert n <= fitted * 1.01 + 1


def test_sum_of_squares_takes_the_best_gap():
    # Two open bins with gap 40 and one with 30: after 10 more, 40 -> 30 gives 1 + 4 and 30 -> 20 gives 4 + 1; of these the smaller gap.
    bins, _, _ = packing.sum_of_squares(np.array([60, 60, 70, 10]), 100)
    assert bins.tolist() == [1, 2, 0, 0]


def plain_next(rows):
    def tie(t):
        import xxhash

        return 42 if t is None else np.uint64(xxhash.xxh64(t.encode(), 42).intdigest()).astype(np.int64)

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])), reverse=True)
    return list(zip(order, [*order[1:], order[0]], strict=True)) if order else []


@pytest.mark.parametrize("range_rows", [4096, 5])
def test_edit_probe(docs, rows, range_rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", range_rows)
    found = collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprints.edit_probe(docs).collect())
    wanted = collections.Counter()
    for (d, t, *_), (_, o, *_) in plain_next(rows):
        t, o = t or "", o or ""
        n = len(t) // 3
        wanted[d, len(t), hashlib.sha256((t[: len(t) - n] + o[:n]).encode()).hexdigest()] += 1
    assert found == wanted


def plain_chunks_of(text):
    """The chunks by the rule, a byte at a time."""
    table = [int(x) >> 32 for x in bytehash.byte_table(7).tolist()]
    data, out, start = (text or "").encode(), [], 0
    while start < len(data):
        end = min(start + 256, len(data))
        for at in range(start + 32, end + 1):
            value = sum(table[data[at - 1 - k]] << k for k in range(32)) % 2**32
            if value >> (25 if at - start <= 64 else 27) == 0:
                end = at
                break
        out.append(data[start:end])
        start = end
    return out


def test_likeness_by_plain_chunks(docs, rows):
    """near_edited and near_next: the share by length of a text's distinct chunks that the other has."""
    share = lambda a, b: sum(len(c) for c in set(a) & set(b)) / sum(map(len, set(a))) if a else float(not b)
    wanted = collections.Counter()
    for (d, t, *_), (_, o, *_) in plain_next(rows):
        t, o = t or "", o or ""
        n = len(t) // 3
        wanted[d, round(share(plain_chunks_of(t), plain_chunks_of(t[: len(t) - n] + o[:n])), 9), round(share(plain_chunks_of(t), plain_chunks_of(o)), 9)] += 1
    found = fingerprints.edit_probe(docs).collect()
    assert collections.Counter((r["doc_id"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found) == wanted


def test_fingerprints(docs):
    rows = fingerprints.fingerprint(docs).select("text", "fingerprint").collect()
    assert len({r["fingerprint"] for r in rows}) == len({r["text"] or "" for r in rows})
    text = " ".join(random.Random(1).choices(WORDS, k=2000))
    whole, cut, other = fingerprints.chunk_sets([text, text[137:], " ".join(random.Random(2).choices(WORDS, k=2000))])
    assert fingerprints.containment(cut, whole) > 0.95 and fingerprints.containment(other, whole) < 0.05
    assert fingerprints.from_string(fingerprints.as_string(whole)) == whole
    assert fingerprints.containment({}, {}) == 1 and fingerprints.containment({}, whole) == 0


def test_chunks_don_t_depend_on_the_batch():
    texts = ["", "a", " ".join(WORDS * 9), "é" * 300, " ".join(WORDS * 9)[50:]]
    together = fingerprints.chunk_sets(texts)
    assert together == [fingerprints.chunk_sets([t])[0] for t in texts]


def test_language(spark, docs, rows):
    parts = {"aa": "ba da ga ka la", "bb": "xor yth zeq wix vox", "cc": "ñu éla öto"}
    rng = random.Random(3)
    taught = [(i, " ".join(rng.choices(p.split(), k=30)), lang) for lang, p in parts.items() for i in range(40)]
    model = language.fit(spark.createDataFrame([*taught, (1, None, "aa"), (2, "12 34", "bb"), (3, "x", None)], "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"]
    got, score = language.scores(model, ["da ba", "yth xor", "ÉLA", None, "", "123 !", "?"])
    assert got == ["aa", "bb", "cc", "und", "und", "und", "und"] and all(0 <= s <= 1 for s in score) and score[3:] == [0] * 4
    assert language.identify(docs, model).count() == len(rows)


def test_language_of_batches():
    model = language.LanguageModel(["a", "b"], np.random.default_rng(0).normal(size=(language.BUCKETS + 1, 2)).astype(np.float32), np.log([0.5, 0.5]))
    model.log_likelihood[-1] = 0
    texts = ["one two three", "", "ß", "four", "x y"]
    assert language.scores(model, texts)[0] == [language.scores(model, [t])[0][0] for t in texts]


def test_languages_by_plain_bayes(spark):
    """Counts of n-grams in dictionaries instead of buckets; two of them rarely share one."""
    rng = random.Random(2)
    parts = {"aa": ["the", "house", "on", "hill", "wood"], "bb": ["das", "haus", "am", "hügel", "wald"], "cc": ["la", "maison", "sur", "colline", "bois"]}
    rows = [(i, " ".join(rng.choices(parts[x], k=rng.randrange(2, 12))) + rng.choice(["", "!", " 12"]), x) for i in range(150) for x in [rng.choice(list(parts))]]

    def grams(text):
        code = re.sub(r"[^a-zü]+", " ", f" {text.lower()} ")
        return [code[i : i + n] for i in range(len(code)) for n in (1, 2, 3) if i + n <= len(code)]

    counts = {x: collections.Counter(g for _, t, lang in rows if lang == x for g in grams(t)) for x in parts}
    prior = collections.Counter(x for *_, x in rows)
    tests = [*(t for _, t, _ in rows[:60]), "das haus the maison", "wald"]
    found = language.identify(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect()
    for r in found:
        log = {x: np.log(prior[x] / len(rows)) + sum(np.log((counts[x][g] + 0.1) / (counts[x].total() + 0.1 * language.BUCKETS)) for g in grams(r["text"])) for x in parts}
        best = max(log, key=log.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 / sum(np.exp(v - log[best]) for v in log.values()), abs=1e-3)


def test_mixing(docs, rows):
    mixture = mixing.mix_sources(docs, block=4)
    found = [r.asDict() for r in mixing.taken_words(mixture).collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((r["doc_id"], r["source"], r["size"]) for r in found) == collections.Counter((r[0], r[3], size(r[1])) for r in rows)
    totals = collections.Counter()
    for r in rows:
        totals[r[3]] += size(r[1])
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([totals[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    taken = collections.Counter()
    for r in found:
        assert r["taken"] <= 3 * r["size"] and r["target"] == pytest.approx(goal[r["source"]]) and r["source_size"] == totals[r["source"]]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 8 for s in names)
    again = mixing.taken_words(mixing.mix_sources(docs.repartition(7), block=4)).collect()
    assert collections.Counter((r["doc_id"], r["taken"]) for r in again) == collections.Counter((r["doc_id"], r["taken"]) for r in found)


def test_mixed_texts(docs, rows):
    mixture = mixing.mix_sources(docs, block=4)
    total = sum(r["taken"] for r in mixing.taken_words(mixture).collect())
    out = mixing.mixed_texts(docs, mixture).collect()
    assert sum(len(r["text"].split()) for r in out) == total and all(r["n_chars"] == len(r["text"]) and r["tie"] == "t" for r in out)
    texts = collections.defaultdict(set)
    for r in rows:
        texts[r[0]].add(" ".join((r[1] or "").split()))
    for r in out:
        for run in r["text"].split("\n"):
            assert any(" ".join(run.split()) in t for t in texts[r["doc_id"]])


def test_targets():
    assert mixing.targets([100, 100, 1000], [5, 2, 1]) == [300, 300, 600]
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]
    assert sum(mixing.targets([7, 1, 90, 4, 0], [5, 2, 1, 5, 2])) == pytest.approx(102)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutations(n):
    a, b = (mixing.permuted(np.arange(n), n, key) for key in (1, 2))
    assert sorted(a) == list(range(n)) and (n < 7 or a.tolist() != b.tolist())


@pytest.mark.parametrize(("slots", "shards"), [(500, 7), (3, 1000), (0, 4), (100_000, 3)])
def test_counts_add_up(slots, shards):
    at, counts = mixing.draw_counts(slots, shards, [1, 2])
    assert counts.sum() == slots and len(set(at.tolist())) == len(at) and (counts > 0).all() and all(0 <= x < shards for x in at)
    if slots >= 50 * shards:
        assert len(at) == shards and abs(counts - slots / shards).max() < 6 * (slots / shards) ** 0.5


@pytest.mark.parametrize("seed", range(6))
def test_targets_fill_up_to_one_level(seed):
    """The level at which the shares by weight, each cut at three times its size, add up to all sizes."""
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 10, 1000, 5000]) + rng.randrange(5) for _ in range(rng.randrange(1, 9))]
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    low, high = 0.0, 4.0 * sum(sizes) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (low, level) if sum(min(level * w, 3 * n) for w, n in zip(weights, sizes, strict=True)) >= sum(sizes) else (level, high)
    assert mixing.targets(sizes, weights) == pytest.approx([min(high * w, 3 * n) for w, n in zip(weights, sizes, strict=True)], rel=1e-9, abs=1e-6)


def spark_hash(text):
    import xxhash

    return np.uint64(xxhash.xxh64(text.encode(), 42).intdigest()).astype(np.int64)


def pair_hash(a, b):
    import struct

    import xxhash

    first = xxhash.xxh64(struct.pack("<q", a), 42).intdigest()
    return xxhash.xxh64(struct.pack("<q", b), first).intdigest()


def plain_chunks(text, divisor, long_line):
    rows = (text or "").split("\n")
    long = [x.count(" ") >= long_line - 1 for x in rows]
    h = [int(spark_hash(x)) for x in rows]
    starts = [i for i in range(len(rows)) if i == 0 or long[i] or long[i - 1] or np.uint64(pair_hash(h[i - 1], h[i])).astype(np.int64) % divisor == 0]
    return [(a, b - a, long[a], "\n".join(rows[a:b])) for a, b in zip(starts, [*starts[1:], len(rows)], strict=True)]


def plain_dedup(rows, divisor, long_line):
    first, out = {}, {}
    key = lambda d, t: (d is not None, d or 0, 42 if t is None else int(spark_hash(t)))
    kept = sorted({(d, t) for d, t in rows}, key=lambda r: key(*r))
    for d, t in kept:
        for a, n, long, body in plain_chunks(t, divisor, long_line):
            if (n > 1 or long) and body.strip(" "):
                first.setdefault(body, (*key(d, t), a))
    for d, t in kept:
        parts = [c for c in plain_chunks(t, divisor, long_line) if not ((c[1] > 1 or c[2]) and c[3].strip(" ")) or first[c[3]] == (*key(d, t), c[0])]
        out[d, t] = None if t is None else "\n".join(c[3] for c in parts)
    return out


def test_line_dedup(spark):
    rng = random.Random(4)
    pool = [" ".join(rng.choices(WORDS, k=rng.choice([1, 2, 5, 30]))) for _ in range(40)] + ["", "", " "]
    passage = "\n".join(pool[:6])
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(12)) + [passage] * (i % 3 == 0) + [f"own line {i}"])) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n\n"), (62, "\n\n\n"), (63, rows[3][1]), (None, rows[3][1]), (None, rows[4][1]), (64, "\n".join(["again", "and again"] * 400))]
    table = spark.createDataFrame([(d, t, 1, "x", "y", 5) for d, t in rows], "doc_id long, text string, same int, chunks string, tie string, n_chars long")
    out = lines.dedup_lines(table)
    assert out.columns == ["doc_id", "text", "same", "chunks", "tie", "n_chars", "removed_chunks", "removed_chars"]
    wanted = plain_dedup(rows, lines.DIVISOR, lines.LONG_LINE)
    assert collections.Counter((r["doc_id"], r["text"]) for r in out.collect()) == collections.Counter((d, wanted[d, t]) for d, t in rows)
    assert out.filter("n_chars <> length(text) or same <> 1").count() == 0
    assert out.filter("removed_chunks > 0").count() > 10


def test_long_passages_go_and_unique_text_stays(docs, spark):
    passage = " ".join(WORDS * 3)
    table = spark.createDataFrame([(i, f"first {i}\n{passage}\nlast {i}") for i in range(9)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(table).collect()}
    assert out[0] == f"first 0\n{passage}\nlast 0" and all(out[i] == f"first {i}\nlast {i}" for i in range(1, 9))


def test_passages_of_short_lines_go(spark):
    """Passages of 4 to 10 lines in different surroundings: the first copy stays whole, of the others nothing; what has fewer words, or only looks alike, stays."""
    rng = random.Random(8)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = {n: [line(14 if n < 6 else 8) for _ in range(n)] for n in range(4, 11)}
    passages |= {11: [line(49), line(1), "", line(5)], 12: [line(3) for _ in range(20)], 13: [line(60)], 14: [line(17).replace(" ", "\t") for _ in range(3)]}
    short = [line(12) for _ in range(4)]
    rows, wanted = [], {}
    for i in range(5):
        for passage in (p for p in passages.values() if sum(len(x.split()) for x in p) >= 50):
            before, after, key = [line(3) for _ in range(i)], [line(5)] * (i < 4), len(rows)
            rows.append((key, "\n".join(before + passage + after)))
            wanted[key] = "\n".join(before + (passage if i == 0 else []) + after)
    rows += [(1000 + i, "\n".join([line(4), short[i], line(4)])) for i in range(4)] + [(None, "x y")]
    wanted |= {d: t for d, t in rows if d is None or d >= 1000}
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), run_words=lines.RUN_WORDS).collect()}
    assert out == wanted


def test_runs_within_a_text_keep_each_line_once(spark):
    texts = ["\n".join(["again", "and again"] * 400), "\n".join(f"line {i % 30} of many" for i in range(90))]
    out = [r["text"].split("\n") for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), run_words=lines.RUN_WORDS).orderBy("doc_id").collect()]
    assert [set(x) for x in out] == [set(t.split("\n")) for t in texts] and [len(x) < len(t.split("\n")) for x, t in zip(out, texts, strict=True)] == [True, True]


def test_licenses(spark):
    texts = {
        1: "Some text.\nReleased under the MIT License.\nMore.",
        2: "This work is licensed under the GNU General Public License, version 3.",
        3: "Licensed under CC BY-NC 4.0.",
        4: "please note: Licensed under the Apache License, Version 2.0 as usual",
        5: "You need a driving license to rent a car.",
        6: "nothing of the kind",
        7: None,
        8: "",
        9: "Licensed under the MIT License.\nCopyright (c) 2020 the authors. All rights reserved.",
    }
    rows = [*texts.items(), (6, "nothing of the kind"), (None, "Licensed under the Mozilla Public License, version 2.0.")]
    found = licenses.scan_licenses(spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, gram string")).collect()
    assert len(found) == len(rows)
    wanted = {1: "mit", 2: "gpl", 3: "cc-by-nc", 4: "apache", 5: "unknown", 6: None, 7: None, 8: None, 9: "mit", None: "mpl"}
    assert {r["doc_id"]: r["family"] for r in found} == wanted


def plain_scan(text, model):
    """The paragraphs' families, probabilities and similarities, from the weights and templates alone."""
    anchored = re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(licenses.anchors())})(?![A-Za-z0-9])", re.IGNORECASE | re.ASCII)
    parts, rows = [], (text or "").split("\n")
    for i, row in enumerate(rows):
        blank = lambda x: re.search("[A-Za-z0-9]", x) is None
        if i == 0 or blank(row) or blank(rows[i - 1]) or re.search(r"[.!?:;]\s*$", rows[i - 1]):
            parts.append(row)
        else:
            parts[-1] += " " + row
    found = []
    for part in filter(anchored.search, parts):
        grams = licenses.ngrams(part)
        z = (np.array(model.bias) + sum((np.array(model.weights.get(g, [0.0] * len(model.bias))) for g in grams), np.zeros(len(model.bias)))) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = int(p[:-1].argmax())
        family = model.families[best]
        near = max([len(licenses.ngrams(t) & grams) / len(licenses.ngrams(t)) for t in licenses.TEMPLATES[family]] + [float(n in grams) for n in licenses.NAMES.get(family, ())])
        found.append((family if p[best] >= model.threshold and p[best] > p[-1] and near >= 0.5 else "unknown", p[best], near))
    return found


def test_license_scores_are_sums_over_ngrams(spark):
    """Also where rows come several times, share an id or have none."""
    model = licenses.train()
    texts = ["Released under the MIT License.", "All rights reserved.\nThe license fee is due.", "a work\nof the public\ndomain. Files", "Permission is hereby granted", "x MIT y"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 3 + [(None, texts[1]), (None, texts[2]), (1, texts[4]), (9, None)]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model).collect()
    wanted = []
    for d, t in rows:
        each = plain_scan(t, model)
        kind = {"unknown": 0, "proprietary": 1}
        top = max(((kind.get(f, 2), round(p, 9), f, round(s, 9)) for f, p, s in each), default=(None,) * 4)
        wanted.append((d, top[2], top[1], top[3], len(each)))
    shown = lambda x: sorted(((d, f, None if p is None else round(p, 6), None if s is None else round(s, 6), n) for d, f, p, s, n in x), key=str)
    assert shown(map(tuple, found)) == shown(wanted)


def test_wrapped_licenses_are_one_paragraph(spark):
    notice = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public\n# License as published"
    text = f"def f():\n    pass;\n\n{notice}\n\nother words"
    row = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["family"] == "gpl" and row["similarity"] > 0.9


def test_license_probabilities_are_calibrated():
    model = licenses.train()
    assert sum(n for n, _, _ in model.reliability) > 50 and model.temperature > 0
    assert sum(n * abs(p - r) for n, p, r in model.reliability) / sum(n for n, _, _ in model.reliability) < 0.25


def test_license_names_and_identifiers(spark):
    texts = {
        "SPDX-License-Identifier: Apache-2.0": "apache", "// SPDX-License-Identifier: MIT": "mit", "see BSD-3-Clause": "bsd", "This code is available under the GPLv3.": "gpl",
        "SPDX-License-Identifier: GPL-2.0-or-later": "gpl", "You can use it under the LGPLv2.1 or later": "lgpl", "LGPL-3.0-only": "lgpl", "AGPL-3.0": "agpl", "under the MPL 2.0": "mpl",
        "The text is CC-BY-4.0.": "cc-by", "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa", "CC BY-NC 4.0": "cc-by-nc", "CC0-1.0": "public-domain", "The Unlicense": "public-domain",
        "Several licenses apply.": "unknown", "SPDX-License-Identifier: LicenseRef-Other": "unknown", "mit\u212a": "unknown", "He was licentious at the summit": None, "an mplayer": None,
    }
    found = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {list(texts)[r["doc_id"]]: r["family"] for r in found} == texts
    assert all((r["n_paragraphs"] == 0) == (r["family"] is None) for r in found)


def test_license_grams_in_columns_are_those_of_training(spark):
    from pyspark.sql import functions as F

    texts = [t for ts in licenses.TEMPLATES.values() for t in ts] + list(licenses.OTHERS) + ["MIT", "a", "the mit-license, and CC0 1.0"]
    found = spark.createDataFrame([(t, licenses.words_of(t)) for t in texts], "t string, words array<string>").select("t", F.expr(licenses._grams("words")).alias("g")).collect()
    assert all(set(r["g"]) == licenses.ngrams(r["t"]) | {""} for r in found)


def test_license_families_on_held_out_copies():
    import random as r

    model = licenses.train()
    rng, right, total = r.Random(99), 0, 0
    for family, ts in licenses.TEMPLATES.items():
        for t in ts:
            words = t.split()
            if len(words) < 6:
                continue
            words.pop(rng.randrange(len(words)))
            z = np.array(model.bias) + sum((np.array(model.weights[g]) for g in licenses.features(" ".join(words)) if g in model.weights), np.zeros(len(model.bias)))
            right += model.families[int(z.argmax())] == family
            total += 1
    assert right / total > 0.85


def test_empty_tables(none):
    assert jaccard.jaccard_groups(none).count() == 0 and jaccard.first_of_groups(none).count() == 0
    assert packing.pack_documents(none).count() == 0 and fingerprints.edit_probe(none).count() == 0
    assert language.identify(none, language.fit(none)).count() == 0 and lines.dedup_lines(none).count() == 0
    assert licenses.scan_licenses(none).count() == 0
    mixture = mixing.mix_sources(none)
    assert mixing.taken_words(mixture).count() == 0 and mixing.mixed_texts(none, mixture).count() == 0


def test_one_document(spark):
    one = spark.createDataFrame([(5, "lone text", "en", None)], "doc_id long, text string, lang string, source string")
    assert [r["component_id"] for r in jaccard.jaccard_groups(one).collect()] == [5]
    assert fingerprints.edit_probe(one).first()["near_next"] == 1
    assert mixing.taken_words(mixing.mix_sources(one)).first()["taken"] == 2
