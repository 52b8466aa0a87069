"""Normalisers: string column to string column. Unicode forms, which Spark lacks, run as Arrow functions and only on texts that need them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[Column], Column]


def _by_row(change: Callable[[str], str]) -> Callable[[Column], Column]:
    """change as an Arrow function; it is made where it is used, as that takes a session."""

    def run(text: Column) -> Column:
        def each(texts: pd.Series) -> pd.Series:
            return texts.map(change, na_action="ignore")

        each.__annotations__ = {"texts": pd.Series, "return": pd.Series}
        return F.pandas_udf(each, "string")(text)

    return run


def _form(name: str) -> Step:
    normal = _by_row(lambda t: unicodedata.normalize(name, t))

    def apply(text: Column) -> Column:
        # Texts of ASCII alone are in every form: they are spared the way to Python.
        plain = text.rlike(r"^\p{ASCII}*\z")
        return F.when(plain, text).otherwise(normal(F.when(~plain, text)))

    return apply


nfc, nfd, nfkc, nfkd = (_form(n) for n in ("NFC", "NFD", "NFKC", "NFKD"))

# Characters that the translation normaliser deletes, and those it makes a space.
NMT_DELETED = r"[\x01-\x08\x0B\x0E-\x1F\x7F\x8F\x9F]"
NMT_SPACED = r"[\x09\x0A\x0C\x0D ​-‏  ▁﻿�]"


def nmt(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, NMT_DELETED, ""), NMT_SPACED, " ")


def lowercase(text: Column) -> Column:
    return F.lower(text)


def strip(text: Column, left: bool = True, right: bool = True) -> Column:
    """Remove white space of Unicode at the ends."""
    if left:
        text = F.regexp_replace(text, r"(?U)^\s+", "")
    return F.regexp_replace(text, r"(?U)\s+$", "") if right else text


def strip_accents(text: Column) -> Column:
    """Drop combining marks; nothing is decomposed."""
    return F.regexp_replace(text, r"\p{M}", "")


def replace(text: Column, pattern: str, content: str, regex: bool = False) -> Column:
    return F.regexp_replace(text, pattern, content) if regex else F.replace(text, F.lit(pattern), F.lit(content))


def prepend(text: Column, prefix: str) -> Column:
    return F.when(F.length(text) > 0, F.concat(F.lit(prefix), text)).otherwise(text)


def byte_alphabet() -> list[str]:
    """The printable character of each byte: printable ones of Latin-1 stand for themselves, the others, in order, for U+0100 onward."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    found, extra = [], 0x100
    for b in range(256):
        found.append(chr(b) if b in itself else chr(extra))
        extra += b not in itself
    return found


_TO_BYTES = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})


def to_byte_characters(text: str) -> str:
    return text.encode().decode("latin-1").translate(_TO_BYTES)


def byte_level(text: Column) -> Column:
    """Each byte of the UTF-8 form as its printable character."""
    # Bytes are read as Latin-1; only those that don't stand for themselves are translated.
    moved = {chr(b): c for b, c in enumerate(byte_alphabet()) if chr(b) != c}
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "".join(moved), "".join(moved.values()))


def bert(text: Column, clean_text: bool = True, handle_chinese_chars: bool = True, strip_accents: bool | None = None, lowercase: bool = True) -> Column:
    """Drop controls, make white space spaces, set CJK characters apart, strip accents (by default as lowercase says), lower-case."""
    if clean_text:
        text = F.regexp_replace(F.regexp_replace(text, r"[\t\n\r]", " "), r"[\x00�\p{Cc}\p{Cf}\p{Cn}\p{Co}]", "")
        text = F.regexp_replace(text, r"(?U)\s", " ")
    if handle_chinese_chars:
        text = F.regexp_replace(text, r"([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}])", " $1 ")
    if lowercase if strip_accents is None else strip_accents:
        text = F.regexp_replace(nfd(text), r"\p{Mn}", "")
    return F.lower(text) if lowercase else text


def sequence(text: Column, *steps: Step) -> Column:
    for step in steps:
        text = step(text)
    return text


class Aligned:
    """A text under normalisation whose every character knows the range of the original that it stands for."""

    def __init__(self, text: str):
        self.original, self.chars, self.align = text, list(text), [(i, i + 1) for i in range(len(text))]

    @property
    def text(self) -> str:
        return "".join(self.chars)

    def transform(self, changes: list[tuple[str, int]], skip: int = 0) -> Aligned:
        """changes: characters with 0 (replaces the next one), 1 (is inserted, and shares the range before it) or -n (replaces one, then n are left out)."""
        chars, align, at = [], [], skip
        for c, change in changes:
            if change > 0:
                align.append(align[-1] if align else (0, 0))
            else:
                align.append(self.align[at])
                at += 1 - change
            chars.append(c)
        self.chars, self.align = chars, align
        return self

    def filter(self, keep: Callable[[str], bool]) -> Aligned:
        kept = [i for i, c in enumerate(self.chars) if keep(c)]
        self.chars, self.align = [self.chars[i] for i in kept], [self.align[i] for i in kept]
        return self

    def map(self, change: Callable[[str], str]) -> Aligned:
        """Put for each character the ones that change gives for it; all of them share its range."""
        pairs = [(n, a) for c, a in zip(self.chars, self.align, strict=True) for n in change(c)]
        self.chars, self.align = [c for c, _ in pairs], [a for _, a in pairs]
        return self

    def normalize(self, form: str) -> Aligned:
        """A Unicode form, cluster by cluster: what comes of a base and its marks shares their range."""
        clusters: list[list[int]] = []
        for i, c in enumerate(self.chars):
            if clusters and unicodedata.combining(c):
                clusters[-1].append(i)
            else:
                clusters.append([i])
        chars, align = [], []
        for cluster in clusters:
            made = unicodedata.normalize(form, "".join(self.chars[i] for i in cluster))
            first, last = self.align[cluster[0]], self.align[cluster[-1]]
            same = len(made) == len(cluster)
            chars += made
            align += [self.align[i] for i in cluster] if same else [(first[0], last[1])] * len(made)
        self.chars, self.align = chars, align
        return self

    def prepend(self, prefix: str) -> Aligned:
        if self.chars:
            self.chars, self.align = [*prefix, *self.chars], [self.align[0]] * len(prefix) + self.align
        return self

    def append(self, suffix: str) -> Aligned:
        if self.chars:
            self.chars, self.align = [*self.chars, *suffix], self.align + [self.align[-1]] * len(suffix)
        return self

    def replace(self, pattern: str, content: str) -> Aligned:
        """Put content for each match; it has the range of the match's last character."""
        import re

        chars, align, at = [], [], 0
        for m in re.finditer(pattern, self.text):
            if m.end() == m.start():
                continue
            chars += self.chars[at : m.start()] + list(content)
            align += self.align[at : m.start()] + [self.align[m.end() - 1]] * len(content)
            at = m.end()
        self.chars, self.align = chars + self.chars[at:], align + self.align[at:]
        return self

    def strip(self, left: bool = True, right: bool = True) -> Aligned:
        a, b = 0, len(self.chars)
        while left and a < b and self.chars[a].isspace():
            a += 1
        while right and b > a and self.chars[b - 1].isspace():
            b -= 1
        self.chars, self.align = self.chars[a:b], self.align[a:b]
        return self

    def original_range(self, start: int, end: int) -> tuple[int, int]:
        """The range of the original that the characters [start, end) stand for."""
        if start >= end:
            at = self.align[start][0] if start < len(self.align) else len(self.original)
            return at, at
        return self.align[start][0], self.align[end - 1][1]


def aligned(text: Column, *steps: Callable[[Aligned], Aligned]) -> Column:
    """{normalized, align}: for offsets, when they are asked for."""

    def run(texts):
        rows = []
        for t in texts:
            a = Aligned(t or "")
            for step in steps:
                a = step(a)
            rows.append((a.text, [{"start": s, "end": e} for s, e in a.align]))
        return pd.DataFrame(rows, columns=["normalized", "align"])

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "normalized string, align array<struct<start:int,end:int>>")(text)
