"""The tables that the operators read and write, and the check that a frame has what an operator needs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

#: Schemas as DDL, which readers and createDataFrame() take; they need no session to be imported.
SCHEMAS: dict[str, str] = {
    "document": "text string, uid bigint",
    "multilingual_document": "text string, uid bigint, lang string",
    "tokenised_document": "input_ids array<int>, uid bigint",
    "split_document": "text string, uid bigint, split string",
    "sequence": "seq_id bigint, tokens array<int>",
    "doc_index": "pos bigint, uid bigint, start bigint, len bigint",
    "seq_index": "pos bigint, seq_id bigint",
    "bpb": "uid bigint, num_bytes bigint, num_tokens bigint, loss_nats double, bpb double",
    "blimp": "task string, sentence_good string, sentence_bad string, logprob_good double, logprob_bad double, correct boolean",
    "multiblimp": "language string, phenomenon string, sentence_good string, sentence_bad string, logprob_good double, logprob_bad double, correct boolean",
    "zhoblimp": "paradigm string, phenomenon string, sentence_good string, sentence_bad string, logprob_good double, logprob_bad double, correct boolean",
    "token_logprobs": "uid bigint, token_ids array<int>, token_logprobs array<double>",
    "vocabulary": "tokenizer string, id int, token string, score double",
    "merges": "tokenizer string, rank int, left string, right string, result string",
    "word_counts": "word string, cnt bigint",
    "edges": "word string, start int, end int, token_id int, score double",
    "encoding": "ids array<int>, type_ids array<int>, tokens array<string>, words array<int>, offsets array<struct<start:int,end:int>>,"
    " special_tokens_mask array<int>, attention_mask array<int>",
    "normalized": "original string, normalized string, align array<struct<start:int,end:int>>",
    "pieces": "pieces array<struct<piece:string,start:int,end:int,token_id:int>>",
    "added_token": "content string, single_word boolean, lstrip boolean, rstrip boolean, normalized boolean, special boolean",
    "merge_trace": "rank int, left string, right string, result string, score double, cnt bigint, delta_ll double",
    "score_snapshot": "step int, left string, right string, score double, cnt bigint",
    "token_counts": "tokenizer string, token_id int, cnt bigint",
    "bootstrap": "model string, n_docs bigint, bpb double, bpb_std double, ci_low double, ci_high double",
    "paired_bootstrap": "model_a string, model_b string, n_docs bigint, delta_bpb double, ci_low double, ci_high double, significant boolean, p_boot double",
    "run_name": "run string, size string, tokenizer string, vocab string, budget string, seed int",
}


def require_columns(df: DataFrame, needed: Iterable[str], what: str = "table") -> DataFrame:
    """df, or a ValueError that names the columns it lacks and those it has."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df
