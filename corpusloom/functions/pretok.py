"""Pre-tokenisers: a string column becomes an array of pieces, by regular expressions inside the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The pattern of byte-level vocabularies; a fixed value. (?U) makes \s, \w and \p classes those of Unicode.
BYTE_LEVEL = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: ASCII symbols that count as punctuation besides the class P.
_PUNCT = r"\p{P}$+<=>^`|~"
BEHAVIOURS = ("removed", "isolated", "merged_with_previous", "merged_with_next", "contiguous")
#: Scripts that are told apart; a fixed list.


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of pattern, without empty ones; null for null."""
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: x != "")


def split_pattern(delimiter: str, behaviour: str, invert: bool = False) -> tuple[str, int]:
    """The pattern whose matches (of the group) are the pieces that a split at delimiter leaves.

    With invert the stretches between matches are the delimiters.
    """
    match, gap = f"(?:{delimiter})", f"(?:(?!{delimiter})(?s:.))"
    # Possessive, so that long stretches need no stack: a gap can't hold what follows it.
    found, between = (f"{gap}++", match) if invert else (match, f"{gap}++")
    patterns = {
        "removed": (f"{found}|({between})", 1),
        "isolated": (f"{found}|{between}", 0),
        "contiguous": (f"(?:{found})++|{between}" if not invert else f"{found}|(?:{between})++", 0),
        "merged_with_previous": (f"(?:{between})?{found}|{between}", 0),
        "merged_with_next": (f"{found}(?:{between})?|{between}", 0),
    }
    if behaviour not in patterns:
        raise ValueError(f"unknown behaviour {behaviour}; known: {', '.join(patterns)}")
    return patterns[behaviour]


def split(text: Column, delimiter: str, behaviour: str = "removed", invert: bool = False) -> Column:
    """Split at the matches of a regular expression; empty pieces are dropped."""
    pattern, group = split_pattern(delimiter, behaviour, invert)
    return extract(text, pattern, group)


def byte_level(text: Column, add_prefix_space: bool = False, use_regex: bool = True) -> Column:
    """Pieces of the byte-level pattern (as text: their bytes are not mapped here)."""
    if add_prefix_space:
        text = F.when(text.startswith(" ") | (text == ""), text).otherwise(F.concat(F.lit(" "), text))
    return extract(text, BYTE_LEVEL) if use_regex else F.filter(F.array(text), lambda x: x != "")


def whitespace(text: Column) -> Column:
    return extract(text, r"(?U)\w+|[^\w\s]+")


def whitespace_split(text: Column) -> Column:
    return extract(text, r"(?U)\S+")


def bert(text: Column) -> Column:
    """White space is removed and each punctuation character stands alone."""
    return extract(text, rf"(?U)[{_PUNCT}]|[^\s{_PUNCT}]+")


def punctuation(text: Column, behaviour: str = "isolated") -> Column:
    return split(text, f"[{_PUNCT}]", behaviour)


def digits(text: Column, individual: bool = False) -> Column:
    return extract(text, r"\p{N}|\P{N}+" if individual else r"\p{N}+|\P{N}+")


def char_delimiter(text: Column, delimiter: str) -> Column:
    return split(text, rf"\Q{delimiter}\E")


def fixed_length(text: Column, length: int = 5) -> Column:
    return extract(text, f"(?s).{{1,{length}}}")


def metaspace(text: Column, replacement: str = "▁", prepend: str = "always", do_split: bool = True) -> Column:
    """Spaces become replacement; one is put before a text that doesn't begin with it (always; first: the whole column is first pieces; never)."""
    if prepend not in ("always", "first", "never"):
        raise ValueError(f"unknown prepend {prepend}")
    marked = F.replace(text, F.lit(" "), F.lit(replacement))
    if prepend != "never":
        marked = F.when(marked.startswith(replacement) | (marked == ""), marked).otherwise(F.concat(F.lit(replacement), marked))
    return extract(marked, f"{replacement}[^{replacement}]*|[^{replacement}]+") if do_split else F.array(marked)


def _scripts() -> list[str]:
    """The names of all scripts that the JVM knows, but for those that count as Han and that of unassigned characters; the commonest come first."""
    from pyspark import SparkContext

    first = ["LATIN", "COMMON"]
    known = [str(x.toString()) for x in SparkContext._active_spark_context._jvm.java.lang.Character.UnicodeScript.values()]
    return first + [x for x in known if x not in (*first, "HAN", "HIRAGANA", "KATAKANA", "UNKNOWN")]


def unicode_scripts(text: Column) -> Column:
    """Break where the script changes. Hiragana, Katakana and the long vowel mark count as Han; spaces and unassigned characters belong to any script.

    So they stay with what stands before them; those before the first other character go.
    """
    classes = [r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]", *(rf"[\p{{Is{s}}}&&[^ ー]]" for s in _scripts())]
    return extract(text, "|".join(rf"{c}[{c}\p{{IsUnknown}} ]*+" for c in classes))


def sequence(text: Column, *steps) -> Column:
    """Apply pre-tokenisers (functions of a column) one after another to the pieces of the ones before."""
    pieces = F.array(text)
    for step in steps:
        pieces = F.flatten(F.transform(pieces, step))
    return pieces


def _ends(lengths: pa.Array) -> pa.Array:
    """Running sums of each row's lengths, none for null."""
    sizes = pc.fill_null(lengths.value_lengths(), 0).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    upto = np.concatenate([[0], np.cumsum(lengths.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)])
    ends = upto[1:] - np.repeat(upto[starts[:-1]], sizes)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(ends.astype(np.int32)))


def with_offsets(pieces: Column) -> Column:
    """Pieces that cover their whole text, as {piece, start, end} in characters.

    Only their lengths go to Python, four bytes for each, and are summed up by the batch; the pieces stay in the JVM.
    """
    ends = F.arrow_udf(_ends, "array<int>")(F.coalesce(F.transform(pieces, F.length), F.array().cast("array<int>")))
    pieces = F.coalesce(pieces, F.array().cast("array<string>"))
    return F.zip_with(pieces, ends, lambda p, e: F.struct(p.alias("piece"), (e - F.length(p)).alias("start"), e.alias("end")))
