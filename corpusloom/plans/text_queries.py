"""Queries over text functions: normalisers, pre-tokenisers, decoders, post-processing."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import decode, normalize, post, pretok
from ..operators import packing, statistics
from .corpus_queries import _IDS, with_ids
from .registry import PIECES_SQL, WORDS_SQL, documents, pieces, query, table, words


def _counted(array_sql: str) -> str:
    return f"SELECT word, count(*) AS cnt FROM (SELECT unnest({array_sql}) AS word FROM documents) WHERE word <> '' GROUP BY word"


def _sum_of(ids: Column) -> Column:
    """The sum of an array, null for one without elements."""
    return F.when(F.size(ids) > 0, F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x))


def _counts(spark, sf_dir, splitter):
    docs = documents(spark, sf_dir)
    return statistics.word_counts(docs.withColumn("pieces", splitter(F.col("text"))))


@query(_counted(r"regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+')"))
def pretok_whitespace(spark, sf_dir):
    return _counts(spark, sf_dir, pretok.whitespace)


@query(_counted(WORDS_SQL))
def pretok_wssplit(spark, sf_dir):
    return _counts(spark, sf_dir, pretok.whitespace_split)


@query(_counted(r"regexp_extract_all(text, '[\p{P}$+<=>^`|~]|[^\s\p{P}$+<=>^`|~]+')"))
def pretok_bert(spark, sf_dir):
    return _counts(spark, sf_dir, pretok.bert)


@query(_counted(r"regexp_extract_all(text, '\p{N}+|\P{N}+')"))
def pretok_digits(spark, sf_dir):
    return _counts(spark, sf_dir, pretok.digits)


@query(_counted(r"regexp_extract_all(text, '\p{N}|\P{N}+')"))
def pretok_digits_individual(spark, sf_dir):
    return _counts(spark, sf_dir, lambda t: pretok.digits(t, individual=True))


@query(_counted("regexp_extract_all(text, '(?s).{1,5}')"))
def pretok_fixed5(spark, sf_dir):
    return _counts(spark, sf_dir, pretok.fixed_length)


@query(_counted("regexp_extract_all(CASE WHEN text = '' OR starts_with(replace(text, ' ', '▁'), '▁') THEN replace(text, ' ', '▁') ELSE '▁' || replace(text, ' ', '▁') END, '▁[^▁]*|[^▁]+')"))
def pretok_metaspace(spark, sf_dir):
    return _counts(spark, sf_dir, pretok.metaspace)


@query(_counted(PIECES_SQL))
def pretok_bytelevel(spark, sf_dir):
    return _counts(spark, sf_dir, pretok.byte_level)


@query(_counted("string_split(text, '|')"))
def pretok_char_delimiter(spark, sf_dir):
    return _counts(spark, sf_dir, lambda t: pretok.char_delimiter(t, "|"))


@query(_counted(r"regexp_extract_all(text, '[^.,]*[.,]|[^.,]+')"))
def pretok_split_previous(spark, sf_dir):
    return _counts(spark, sf_dir, lambda t: pretok.split(t, "[.,]", "merged_with_previous"))


@query(_counted(r"regexp_extract_all(text, '[.,][^.,]*|[^.,]+')"))
def pretok_split_next(spark, sf_dir):
    return _counts(spark, sf_dir, lambda t: pretok.split(t, "[.,]", "merged_with_next"))


@query(_counted(r"regexp_extract_all(text, '[.,]+|[^.,]+')"))
def pretok_split_contiguous(spark, sf_dir):
    return _counts(spark, sf_dir, lambda t: pretok.split(t, "[.,]", "contiguous"))


@query(_counted(r"regexp_extract_all(text, '[\p{P}$+<=>^`|~]|[^\p{P}$+<=>^`|~]+')"))
def pretok_punctuation(spark, sf_dir):
    return _counts(spark, sf_dir, pretok.punctuation)


@query(_counted(r"list_filter(flatten(list_transform(regexp_extract_all(text, '\S+'), lambda w: regexp_extract_all(w, '\p{N}|\P{N}+'))), lambda w: w <> '')"))
def pretok_sequence(spark, sf_dir):
    return _counts(spark, sf_dir, lambda t: pretok.sequence(t, pretok.whitespace_split, lambda w: pretok.digits(w, individual=True)))


# Scripts of the texts; elsewhere every script is known.
_RUN_OF = "{0}(?:{0}| )*"
_SCRIPT_RUNS = "|".join(_RUN_OF.format(c) for c in (r"\p{Latin}", r"[^\P{Common} ー]", r"[\p{Han}\p{Hiragana}\p{Katakana}ー]", r"\p{Inherited}", r"\p{Greek}", r"\p{Cyrillic}", r"\p{Arabic}"))


@query(_counted(f"regexp_extract_all(text, '{_SCRIPT_RUNS}')"))
def pretok_scripts(spark, sf_dir):
    return _counts(spark, sf_dir, pretok.unicode_scripts)


_OFFSETS = (
    'SELECT uid, i - 1 AS i, e - length(p) AS start, e AS "end", md5(p) AS piece FROM (SELECT uid, i, p, sum(length(p)) OVER (PARTITION BY uid ORDER BY i)::BIGINT AS e'
    " FROM (SELECT doc_id AS uid, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, %s AS p FROM documents)))"
)


@query(_OFFSETS % PIECES_SQL)
def piece_offsets(spark, sf_dir):
    """Where the pieces of all texts stand."""
    rows = pieces(documents(spark, sf_dir))
    each = rows.select("uid", F.posexplode(pretok.with_offsets(F.col("pieces"))).alias("i", "o"))
    return each.select("uid", F.col("i").cast("long").alias("i"), F.col("o.start").cast("long").alias("start"), F.col("o.end").cast("long").alias("end"), F.md5("o.piece").alias("piece"))


@query(r"SELECT doc_id AS uid, md5(regexp_replace(regexp_replace(lower(text), '^\s+', ''), '\s+$', '')) AS digest FROM documents")
def norm_lower_strip(spark, sf_dir):
    return documents(spark, sf_dir).select("uid", F.md5(normalize.strip(normalize.lowercase(F.col("text")))).alias("digest"))


@query(r"SELECT doc_id AS uid, md5(regexp_replace(regexp_replace(text, '[\x01-\x08\x0B\x0E-\x1F\x7F]', '', 'g'), '[\x09\x0A\x0C\x0D ]', ' ', 'g')) AS digest FROM documents")
def norm_nmt(spark, sf_dir):
    return documents(spark, sf_dir).select("uid", F.md5(normalize.nmt(F.col("text"))).alias("digest"))


@query("SELECT doc_id AS uid, md5(nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)))) AS digest FROM documents")
def norm_nfc(spark, sf_dir):
    apart = F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("é")), F.lit("ü"), F.lit("ü"))
    return documents(spark, sf_dir).select("uid", F.md5(normalize.nfc(apart)).alias("digest"))


@query("SELECT doc_id AS uid, md5(strip_accents(text)) AS digest FROM documents")
def norm_strip_accents(spark, sf_dir):
    """Accents are dropped after decomposition; what is left is composed again."""
    text = normalize.nfc(normalize.strip_accents(normalize.nfd(F.col("text"))))
    return documents(spark, sf_dir).select("uid", F.md5(text).alias("digest"))


@query(r"SELECT doc_id AS uid, md5(CASE WHEN text = '' THEN text ELSE '▁' || replace(regexp_replace(text, '\s+', ' ', 'g'), ' ', '▁') END) AS digest FROM documents")
def norm_replace_prepend(spark, sf_dir):
    text = normalize.replace(F.col("text"), r"\s+", " ", regex=True)
    return documents(spark, sf_dir).select("uid", F.md5(normalize.replace(normalize.prepend(text, "▁"), " ", "▁")).alias("digest"))


@query("SELECT doc_id AS uid, strlen(text) AS n_bytes FROM documents")
def norm_bytelevel(spark, sf_dir):
    """The byte alphabet has one character for each byte."""
    return documents(spark, sf_dir).select("uid", F.length(normalize.byte_level(F.col("text"))).cast("long").alias("n_bytes"))


@query()
def norm_bert(spark, sf_dir):
    return documents(spark, sf_dir).select("uid", F.md5(normalize.bert(F.col("text"))).alias("digest"))


_CLEAN = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, ' .', '.'), ' ?', '?'), ' !', '!'), ' ,', ','), ' '' ', ''''), ' n''t', 'n''t'), ' ''m', '''m'), ' do not', ' don''t'), ' ''s', '''s'), ' ''ve', '''ve'), ' ''re', '''re')"
_BERT = r"regexp_extract_all(text, '[\p{P}$+<=>^`|~]|[^\s\p{P}$+<=>^`|~]+')"


@query(f"SELECT doc_id AS uid, md5(array_to_string(list_transform({_BERT}, lambda t, i: {_CLEAN.format('CASE WHEN i = 1 THEN t ELSE chr(32) || t END')}), '')) AS digest FROM documents")
def decode_wordpiece_cleanup(spark, sf_dir):
    return documents(spark, sf_dir).select("uid", F.md5(decode.text_of(decode.wordpiece(pretok.bert(F.col("text"))))).alias("digest"))


@query("SELECT doc_id AS uid, md5(text) AS digest FROM documents")
def decode_metaspace(spark, sf_dir):
    """There and back."""
    marked = pretok.metaspace(F.when(F.col("text").startswith(" "), F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    return documents(spark, sf_dir).select("uid", F.md5(decode.text_of(decode.metaspace(marked))).alias("digest"))


@query("SELECT doc_id AS uid, md5(text) AS digest FROM documents")
def decode_bytelevel(spark, sf_dir):
    """Texts to the byte alphabet and back."""
    tokens = F.array(normalize.byte_level(F.col("text")))
    text = F.when(F.col("text").isNotNull(), decode.text_of(decode.byte_level(tokens)))
    return documents(spark, sf_dir).select("uid", F.md5(text).alias("digest"))


@query(f"SELECT doc_id AS uid, md5(array_to_string({WORDS_SQL}, ' ')) AS digest FROM documents")
def decode_bpe(spark, sf_dir):
    tokens = F.transform(pretok.whitespace_split(F.col("text")), lambda w: F.concat(w, F.lit("</w>")))
    return documents(spark, sf_dir).select("uid", F.md5(decode.text_of(decode.bpe(tokens))).alias("digest"))


@query(
    "SELECT uid, md5(replace(array_to_string(list_filter(list_transform(c, lambda x, i: CASE WHEN i > 1 AND c[i - 1] = x THEN '' ELSE x END), lambda x: x <> ''), ''), '|', ' ')) AS digest"
    " FROM (SELECT doc_id AS uid, regexp_extract_all(replace(replace(text, '|', ''), ' ', '|'), '(?s).') AS c FROM documents)"
)
def decode_ctc(spark, sf_dir):
    """Characters as frames: repeats fall together, and the mark between words becomes a space."""
    frames = F.filter(F.split(F.replace(F.replace(F.col("text"), F.lit("|"), F.lit("")), F.lit(" "), F.lit("|")), ""), lambda c: c != "")
    return documents(spark, sf_dir).withColumn("frames", frames).select("uid", F.md5(F.replace(decode.text_of(decode.ctc(F.col("frames"), clean=False)), F.lit("|"), F.lit(" "))).alias("digest"))


@query(f"SELECT uid, part, len(p) AS n, list_sum(p)::BIGINT AS total FROM (SELECT uid, i AS part, ids[i * 96 + 1 : i * 96 + 128] AS p FROM (SELECT uid, ids, unnest(range(0, (ceil(greatest(0, len(ids) - 128) / 96) + 1)::BIGINT)) AS i FROM ({_IDS})))")
def stride_windows(spark, sf_dir):
    parts = with_ids(spark, sf_dir).select("uid", F.posexplode(post.stride_parts(F.col("input_ids"), 128, 32)).alias("part", "p"))
    return parts.select("uid", F.col("part").cast("long").alias("part"), F.size("p").cast("long").alias("n"), _sum_of(F.col("p")).alias("total"))


_PAD = f"SELECT uid, len(ids) AS n, max(len(ids)) OVER (PARTITION BY uid // 32) AS width FROM ({_IDS})"


@query(f"SELECT uid, width, (ceil(width / 8) * 8)::BIGINT AS padded, n AS real FROM ({_PAD})")
def pad_batch_longest(spark, sf_dir):
    rows = with_ids(spark, sf_dir).withColumn("batch", F.expr("uid div 32")).withColumn("width", F.max(F.size("input_ids")).over(Window.partitionBy("batch")).cast("long"))
    rows = post.pad_batches(rows, "batch", multiple=8)
    return rows.select("uid", "width", F.size("input_ids").cast("long").alias("padded"), F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("real"))


@query(f"SELECT uid, array_to_string(list_concat([101], a[1:20], [102], b[1:10], [102]), ' ') AS ids, array_to_string(list_concat(list_transform(range(0, len(a[1:20]) + 2), lambda x: 0), list_transform(range(0, len(b[1:10]) + 1), lambda x: 1)), ' ') AS types FROM (SELECT uid, ids AS a, list_reverse(ids) AS b FROM ({_IDS}))")
def template_concat(spark, sf_dir):
    template, a, b = post.bert_template(), post.truncated(F.col("input_ids"), 20), post.truncated(F.reverse("input_ids"), 10)
    show = lambda c: F.array_join(c.cast("array<string>"), " ")
    return with_ids(spark, sf_dir).select("uid", show(template.ids(a, b)).alias("ids"), show(template.type_ids(a, b)).alias("types"))


@query(
    f"SELECT uid, CASE WHEN a + b <= 300 THEN a WHEN a <= b THEN s ELSE l END AS keep_a, CASE WHEN a + b <= 300 THEN b WHEN a <= b THEN l ELSE s END AS keep_b FROM ("
    "SELECT *, CASE WHEN least(a, b) <= 150 THEN least(a, b) ELSE 150 END AS s, CASE WHEN least(a, b) <= 150 THEN least(greatest(a, b), 300 - least(a, b)) ELSE 150 END AS l"
    f" FROM (SELECT uid, len(ids) AS a, len(ids) * 7 % 400 AS b FROM ({_IDS})))"
)
def truncation_longest_first(spark, sf_dir):
    a = F.size("input_ids")
    first, second = post.truncated_lengths(a, (a * 7) % 400, 300)
    return with_ids(spark, sf_dir).select("uid", first.cast("long").alias("keep_a"), second.cast("long").alias("keep_b"))


@query(f"SELECT uid, len(ids) - first + 1 AS n, list_sum(ids[first:])::BIGINT AS total FROM (SELECT uid, ids, coalesce(list_position(list_transform(ids, lambda x: x > 3), true), 1) AS first FROM ({_IDS}))")
def strip_left_padding(spark, sf_dir):
    """Lengths of up to three bytes stand for log-probabilities of 0."""
    probs = F.transform("input_ids", lambda x: F.when(x > 3, -x.cast("double")).otherwise(F.lit(0.0)))
    ids, _ = post.stripped_left(F.col("input_ids"), probs)
    return with_ids(spark, sf_dir).select("uid", F.size(ids).cast("long").alias("n"), _sum_of(ids).alias("total"))


@query(f"SELECT uid, b AS batch, w - len(ids) AS fill FROM (SELECT uid, ids, uid // 16 AS b, max(len(ids)) OVER (PARTITION BY uid // 16) AS w FROM ({_IDS}))")
def left_padding(spark, sf_dir):
    rows = packing.left_padded(with_ids(spark, sf_dir).withColumn("batch", F.expr("uid div 16")))
    return rows.select("uid", "batch", (F.size("mask") - F.aggregate("mask", F.lit(0), lambda a, x: a + x)).cast("long").alias("fill"))


@query("SELECT conv_id, turn, md5(coalesce(text, '')) AS digest FROM conversations WHERE strlen(text) > 0")
def non_empty_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.filter(F.octet_length("text") > 0).select("conv_id", "turn", F.md5("text").alias("digest"))


@query(f"SELECT word, len(word) AS n FROM (SELECT DISTINCT unnest({WORDS_SQL}) AS word FROM documents) WHERE length(word) >= 12")
def long_words(spark, sf_dir):
    each = words(documents(spark, sf_dir)).select(F.explode("pieces").alias("word")).distinct()
    return each.filter(F.length("word") >= 12).select("word", F.length("word").cast("long").alias("n"))
