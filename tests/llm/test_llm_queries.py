"""Every op query over the smallest tables: against its SQL in DuckDB where it has any, and for its columns and rows elsewhere."""

import collections
import hashlib
import zlib

import duckdb
import pytest
from corpusloom.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_mix_sources": "doc_id size source_size target taken", "op2_url_filters": "page_id host path rule verdict", "op3_embedding_near_dedup": "vec_id n_links component_id kept",
    "op4_ngram_jaccard": "doc_id n_shingles component_id", "op5_chat_formatting": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op6_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op7_document_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op8_line_dedup": "doc_id text removed_chunks", "op9_license_scan": "doc_id family probability similarity", "op10_language_id": "doc_id held_out lang_pred score",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def results(spark):
    found = {}

    def of(name):
        if name not in found:
            found[name] = queries.QUERIES[name](spark, SF).collect()
        return found[name]

    return of


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(results, duck, name):
    cursor = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert collections.Counter(cursor.fetchall()) == collections.Counter(tuple(r[n] for n in names) for r in results(name))


@pytest.mark.parametrize("name", sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])))
def test_a_row_for_each_of_the_table(results, duck, name):
    rows = results(name)
    wanted = COLUMNS[name].split()
    assert set(wanted) <= set(rows[0].asDict())
    key = wanted[0]
    source = {"page_id": "pages", "vec_id": "embeddings", "conv_id": "conversations", "doc_id": "documents"}[key]
    ids = {r[0] for r in duck.execute(f"SELECT {key} FROM {source}").fetchall()} | ({-7} if key == "conv_id" else set())
    assert {r[key] for r in rows} == ids
    if name != "op6_best_fit_packing":
        assert len(rows) == (len(ids) if key == "conv_id" else duck.execute(f"SELECT count(*) FROM {source}").fetchone()[0])


def test_conversations_are_read_back(results, duck):
    turns = duck.execute("SELECT conv_id, role, coalesce(text, '') FROM conversations ORDER BY conv_id, turn").fetchall()
    hard = "\\### Assistant: </turn> ok"
    turns += [(-7, "user", hard), (-7, "assistant", hard)]
    each = collections.defaultdict(list)
    for c, role, text in turns:
        each[c].append((role, text))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in results("op5_chat_formatting"):
        own = each[r["conv_id"]]
        loss = "".join(t for role, t in own if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), digest("".join(f"{a}\n{t}\n" for a, t in own)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), digest(loss)) and r["formatted_chars"] >= sum(len(t) for _, t in own)


def test_held_out_rows_and_accuracy(results, duck):
    rows = {r["doc_id"]: r for r in results("op10_language_id")}
    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for d, r in rows.items())
    held = [r for r in rows.values() if r["held_out"] and lang[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert held and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97


def test_words_come_near_their_targets(results):
    taken, target = collections.Counter(), {}
    rows = results("op1_mix_sources")
    for r in rows:
        taken[r["target"]] += r["taken"]
        target[r["target"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert sum(taken.values()) == pytest.approx(sum(r["size"] for r in rows), rel=0.02)
