"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, jaccard, language, licenses, lines, mixing, packing, urls, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of all documents."""
    mixture = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixing.taken_words(mixture).select("doc_id", "size", "source_size", "target", "taken")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of all vectors of equal labels and nearly equal directions."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of all documents that share nine tenths of their shingles of three words."""
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), k=3, percent=90)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the control strings of templates, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(turns.unionByName(more)))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all documents in sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' fingerprints, and what an edit leaves of them."""
    return fingerprints.edit_probe(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the chunks of lines, and the passages of fifty words, that stand in another place before."""
    return lines.dedup_lines(table(spark, sf_dir, "documents"), run_words=lines.RUN_WORDS)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence family of all documents."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents; three quarters of them, by the remainder of crc32, may teach."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    # A row without doc_id has no remainder: it is not held out, and does not teach.
    model = language.fit(docs.filter(~F.col("held_out")))
    docs = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    return language.identify(docs, model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mix_sources, op2_url_filters, op3_embedding_near_dedup, op4_ngram_jaccard, op5_chat_formatting, op6_best_fit_packing, op7_document_fingerprints, op8_line_dedup, op9_license_scan, op10_language_id,
    )
}

_REACH = (
    "reach AS (SELECT {id} AS node, {id} AS seen FROM {nodes} UNION SELECT e.b, r.seen FROM reach r JOIN edges e ON e.a = r.node),"
    " least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)"
)

ORACLE_SQL: dict[str, str] = {
    "op3_embedding_near_dedup": (
        "WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),"
        " ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),"
        " edges AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),"
        f" {_REACH.format(id='vec_id', nodes='v')}, n AS (SELECT a, count(*) AS n FROM edges GROUP BY a)"
        " SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least ON node = vec_id LEFT JOIN n ON a = vec_id"
    ),
    "op4_ngram_jaccard": (
        r"WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),"
        " s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),"
        " n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),"
        " c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),"
        " edges AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),"
        f" {_REACH.format(id='doc_id', nodes='documents')}"
        " SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN least ON node = d.doc_id"
    ),
}
