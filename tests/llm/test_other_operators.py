"""Operators on pages, vectors and conversations against plain versions, and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
from corpusloom.llm import chat, components, packing, urls, vectors

PAGES = "page_id long, url string, html string, host int, rule string"


def test_url_parts(spark):
    cases = {
        "http://A.Example.COM/Path/x?q#f": ("a.example.com", "/Path/x"),
        "https://x.org": ("x.org", ""),
        "https://x.org?y/z": ("x.org", ""),
        "no scheme/x": ("", ""),
        "": ("", ""),
        None: ("", ""),
        "a://b://c/d": ("b:", "//c/d"),
        "http://ÄÖ.net/é#": ("ÄÖ.net", "/é"),
        "x\n://h/p\nq": ("h", "/p\nq"),
    }
    rows = spark.createDataFrame([(i, u, None, 1, "r") for i, u in enumerate(cases)], PAGES)
    found = urls.judge(rows).orderBy("page_id").collect()
    assert [(r["host"], r["path"]) for r in found] == list(cases.values())


def plain_ranks(pages, damping=0.85, rounds=300):
    """Hosts' trust and distrust by dense matrices."""
    import re

    host = lambda u: m[1].lower() if (m := re.match(r"^.*?://([^/?#]*)", u or "", re.S)) else ""
    path = lambda u: m[1] if (m := re.match(r"^.*?://[^/?#]*([^?#]*)", u or "", re.S)) else ""

    def rule(u):
        fits = [r for r in urls.RULES if (host(u) == r.host or host(u).endswith(f".{r.host}")) and path(u).startswith(r.path)]
        return max(fits, key=lambda r: len(r.rule), default=None)

    links, good, bad = {}, {}, {}
    for u, html in pages:
        h = host(u)
        if not h:
            continue
        r = rule(u)
        good[h], bad[h] = good.get(h, 0) + bool(r and r.allow), bad.get(h, 0) + bool(r and not r.allow)
        for t in re.findall(r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)""", html or ""):
            if t.lower() != h:
                links[h, t.lower()] = links.get((h, t.lower()), 0) + 1
    names = sorted({*good, *(t for _, t in links)})
    at = {n: i for i, n in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for (s, t), n in links.items():
        w[at[s], at[t]] = n
    norm = lambda m: m / np.maximum(m.sum(1, keepdims=True), 1e-300)
    jump = lambda x: np.array([x.get(n, 0) for n in names]) / max(1, sum(x.values()))
    t, d = jump(good), jump(bad)
    for _ in range(rounds):
        t = (1 - damping) * jump(good) + damping * norm(w).T @ t
        d = (1 - damping) * jump(bad) + damping * norm(w.T).T @ d
    return {n: (t[i], d[i]) for n, i in at.items()}, rule


def test_trust_spreads_along_links(spark):
    rng = random.Random(0)
    hosts = [f"{a}.{b}" for a in ("www.example", "x", "y", "z", "spam") for b in ("com", "net", "org", "io")]
    pages = []
    for _ in range(150):
        links = "".join(f'<p><A class=x HREF="http{rng.choice(["", "s"])}://{rng.choice(hosts).upper()}/q">t</a>' for _ in range(rng.randrange(4)))
        pages.append((f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', ''])}/{rng.random()}", links or None))
    pages += [(None, "<a href='//x.org'>"), ("junk", None), ("http:///x", "<a href=//y.org>"), ("http://lone.dev", "<a href='/here'>")]
    table = spark.createDataFrame([(i, u, h, 0, "") for i, (u, h) in enumerate(pages)], PAGES)
    ranks, rule = plain_ranks(pages)
    verdicts = {r["host"]: r for r in urls.host_verdicts(table, tolerance=1e-9, most_rounds=200).collect()}
    assert verdicts.keys() == ranks.keys()
    for h, (t, d) in ranks.items():
        assert verdicts[h]["trust"] == pytest.approx(t, abs=1e-6) and verdicts[h]["distrust"] == pytest.approx(d, abs=1e-6)
    assert any(v["blocked"] for v in verdicts.values()) and not all(v["blocked"] for v in verdicts.values())
    for r in urls.judge(table, tolerance=1e-9, most_rounds=200).collect():
        fit = rule(pages[r["page_id"]][0])
        assert r["rule"] == (fit.rule if fit else None)
        assert r["verdict"] == ("allow" if (fit.allow if fit else not (r["host"] in verdicts and verdicts[r["host"]]["blocked"])) else "block")


def test_distrust_reaches_a_small_farm_beside_many_seeds(spark):
    """One of 20,000 blocked seed pages is linked from a chain of 55 hosts; the others have no links."""
    pages = [(f"http://example.com/en/{i}", None) for i in range(19_999)] + [("http://s.net/es/x", None)]
    chain = ["s.net", *(f"h{i}.org" for i in range(55))]
    pages += [(f"http://{b}/", f"<a href='http://{a}/'>") for a, b in zip(chain, chain[1:], strict=False)] + [("http://apart.org/", "<a href='http://lone.org/'>")]
    table = spark.createDataFrame([(i, u, h, 0, "") for i, (u, h) in enumerate(pages)], PAGES)
    found = {r["host"]: r for r in urls.host_verdicts(table).collect()}
    for i, host in enumerate(chain):
        assert found[host]["blocked"] and found[host]["distrust"] == pytest.approx(0.15 * 0.85**i / 20_000, rel=1e-3)
    assert not found["apart.org"]["blocked"] and not found["lone.org"]["blocked"]


def test_no_pages(spark):
    assert urls.judge(spark.createDataFrame([], PAGES)).count() == 0


def plain_links(rows, cosine=0.98):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ok = [lab is not None and e is not None and len(e) > 0 and None not in e and np.isfinite(e).all() and any(e) for _, e, lab in rows]
    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    n[i] += 1
                    n[j] += 1
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    least = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return sorted(((r[0], n[i], least[find(i)], r[0] is not None and r[0] == least[find(i)]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize(("list_rows", "members", "guests"), [(4096, 4096, 8192), (16, 7, 9), (40, 4096, 8192)])
def test_near_duplicates(spark, monkeypatch, list_rows, members, guests):
    for name, value in (("GROUP_ROWS", list_rows), ("MEMBERS", members), ("GUESTS", guests)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), i % 3) for i in range(120)]
    centre = rng.normal(size=16)
    rows += [(200 + i, (centre + rng.normal(size=16) * rng.uniform(0.02, 0.2)).astype(np.float32).tolist(), 1) for i in range(120)]
    rows += [(400 + i, rows[5][1], rows[5][2]) for i in range(20)] + [(420, rows[5][1], 9), (421, [2 * x for x in rows[5][1]], rows[5][2])]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] * 16, 1), (504, rows[5][1], None), (505, [], 1), (506, [1.0, 2.0], 1), (507, [2.0, 4.0], 1)]
    rows += [(508, [float("inf")] * 16, 1), (None, rows[5][1], rows[5][2]), (None, [3.0, 1.0, 2.0], 2), (400, rows[5][1], rows[5][2]), (600, [-0.0, 1.0], 4), (601, [0.0, 1.0], 4)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, cid string, rows int").repartition(4)
    assert sorted((tuple(r) for r in vectors.near_duplicates(table).collect()), key=str) == plain_links(rows)


@pytest.mark.parametrize("rows_of_a_cell", [4096, 300])
def test_many_vectors_against_all_products(spark, monkeypatch, rows_of_a_cell):
    """More vectors of a label than a task compares at a time, in one cell and in several."""
    monkeypatch.setattr(vectors, "GROUP_ROWS", rows_of_a_cell)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(300, 24)), 6, axis=0) + rng.normal(size=(1800, 24)) * rng.uniform(0, 0.25, (1800, 1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = ((unit @ unit.T >= 0.98).sum(1) - 1).tolist()
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(table).collect()} == dict(enumerate(links)) and sum(links) > 1000


def test_vectors_are_in_several_lists(spark):
    """At the size of the smallest tables there are lists that most vectors don't visit."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    classes = vectors.vector_classes(table)
    (book,) = vectors.codebooks(classes).values()
    assert len(book.centres) > 20
    x = np.stack([np.array(r["embedding"], float) for r in classes.collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    far = vectors.squared_distances(x, book.centres)
    probed = vectors.margins(book.centres, far, far.argmin(1), np.arange(len(book.centres))) <= 0.2 + vectors.SLACK
    assert probed.mean() < 0.5


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    odd = spark.createDataFrame([(1, None, 1), (2, [0.0], None)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, vectors.near_duplicates(odd).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: find(x) for x in root if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


TURNS = "conv_id long, turn long, role string, text string, window int"


def plain_digests(rows):
    found = {}
    for c, _, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        n, turns, loss = found.setdefault(c, [0, "", ""])
        found[c] = [n + 1, turns + f"{role or ''}\n{text or ''}\n", loss + (text or "") * (role == "assistant")]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return {c: (n, digest(t), len(x), digest(x)) for c, (n, t, x) in found.items()}


@pytest.mark.parametrize("budget", [1, 30, 2048])
def test_chat_round_trip(spark, budget):
    rng, encode = random.Random(6), packing.Encoder(*packing.public_tokenizer())
    parts = ["hi", "</turn>", "<turn user>", "\\", "\\<", "\n", "### ", "ünï", "a b c d e f g", "<", ">", ":", ""]
    rows = []
    for c in range(25):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be kind", 1))
        rows += [(c, t, rng.choice(["user", "assistant", "a>b", None]), " ".join(rng.choices(parts, k=rng.randrange(6))), 1) for t in range(1, rng.randrange(2, 40))]
    rows += [(90, 0, "assistant", None, 1), (90, 0, "assistant", None, 1), (91, None, "user", "x", 1), (None, 1, "assistant", "lone", 1), (92, 1, "assistant", "long " * 5000, 1), *((93, i, "user", "日本語" * 400, 1) for i in range(9))]
    windows = chat.format_conversations(spark.createDataFrame(rows, TURNS).repartition(5), budget=budget, history=3)
    found = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(windows).collect()}
    assert found == plain_digests(rows)
    for w in windows.collect():
        turns = chat.turns_of(w["text"])
        fresh = len(turns) - w["repeated"]
        assert fresh >= 1 and (w["n_tokens"] <= budget or fresh == 1)
        assert w["n_tokens"] == sum(len(encode(f"{chat.OPEN}{chat.escape(r)}>{chat.escape(t)}{chat.CLOSE}")) for r, t in turns) and w["repeated"] <= 4
        assert [chat.unescape(w["text"][a:b]) for a, b in zip(w["loss_start"], w["loss_end"], strict=True)] == [t for r, t in turns[w["repeated"] :] if r == "assistant"]
        if w["window"] and w["conv_id"] is not None and w["conv_id"] % 3 == 0 and w["conv_id"] < 25:
            assert turns[0] == ("system", "be kind")


def test_no_conversations(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], TURNS))).count() == 0


def test_escapes():
    for t in ("", "\\", "\\\\<", "</turn>\n", "<turn x>", "a\\>b"):
        bare = re.sub(r"\\.", "", chat.escape(t), flags=re.DOTALL)
        assert chat.unescape(chat.escape(t)) == t and not set("<>\\") & set(bare)


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "mix_sources", "best_fit_packing"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        from corpusloom.llm.common import written

        seen = written(stage(spark, seen, "/root/testdata/sf0.001"))
        assert seen.columns == docs.columns and seen.count() > 100
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0


def test_pipeline_drops_what_line_dedup_empties(spark):
    """A copy of which nothing is left goes; what had no words before, and what keeps some, stays."""
    import corpus_pipeline

    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage), (2, passage), (3, f"{passage}\nown"), (4, ""), (5, None), (6, " \n "), (7, "short"), (8, "short")]
    out = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert out == {1: passage, 3: "own", 4: "", 5: None, 6: " \n ", 7: "short", 8: "short"}


def test_pipeline_labels_are_predicted(spark):
    """A wrong label is put right; with no labels at all every document with letters stays."""
    import corpus_pipeline

    texts = {"en": "the quick dog was over there with the other things that were", "fr": "le chien est dans la maison avec les autres choses qui sont"}
    rows = [(2 * i + (x == "fr"), f"{t} {i}", x) for i in range(40) for x, t in texts.items()]
    rows += [(100, texts["fr"], "en"), (101, texts["en"], None), (102, "12 34 !", "en"), (103, None, "fr"), (104, "", None)]
    out = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()}
    assert out == {d: x for d, _, x in rows[:80]} | {100: "fr", 101: "en"}
    bare = spark.createDataFrame([(d, t, None) for d, t, _ in rows], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, bare, "").collect()} == dict.fromkeys(out)
