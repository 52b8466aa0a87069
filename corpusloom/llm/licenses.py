"""Licence scans: a logistic regression over word n-grams names the licence family of a paragraph, and a comparison with templates confirms it."""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urls import LOWER, UPPER

UNKNOWN, RESERVED = "unknown", "proprietary"

# Statements and openings by which public licences are recognised.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "public-domain": ("This work is dedicated to the public domain under CC0 1.0.", "This is free and unencumbered software released into the public domain."),
    "proprietary": ("All rights reserved.", "Copyright (c) 2020 the authors. All rights reserved.", "No part of this work may be reproduced without permission of the copyright holder."),
}
# Paragraphs that speak of such things without naming a licence.
OTHERS = (
    "You need a driving license to rent a car.",
    "The license fee is due at the end of the month.",
    "Permission to enter the building is granted at the gate.",
    "The terms of the agreement were not made public.",
    "He released the software under pressure.",
    "The warranty covers parts and labour for two years.",
    "Copyright law protects authors in most countries.",
    "The source of the river lies in the hills.",
    "Students of the MIT met at the harbour.",
    "Apache helicopters flew over the valley in version two of the film.",
    "The commons were open to the public in creative ways.",
    "The Mozilla foundation published a report.",
)
_VERSIONS = ("1", "2", "3", "4")
# Abbreviations, identifiers and addresses as words, up to three, of which each names a licence by itself.
NAMES: dict[str, tuple[str, ...]] = {
    "apache": ("apache 1 0", "apache 1 1", "apache 2 0", "apache org licenses"),
    "mit": ("identifier mit", "mit 0", "mit licensed", "org licenses mit"),
    "bsd": ("0bsd", "bsd 1 clause", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "bsd licensed"),
    "gpl": ("gpl", "gplv1", "gplv2", "gplv3"),
    "lgpl": ("lgpl", "lgplv2", "lgplv3"),
    "agpl": ("agpl", "agplv1", "agplv3"),
    "mpl": ("mpl 1 0", "mpl 1 1", "mpl 2 0", "mplv1", "mplv2"),
    "cc-by": tuple(f"{w} by {v}" for w in ("cc", "licenses") for v in _VERSIONS),
    "cc-by-sa": ("cc by sa", "licenses by sa"),
    "cc-by-nc": ("cc by nc", "licenses by nc"),
    "public-domain": ("cc0", "unlicense", "publicdomain zero"),
}
# Words of any text, which say nothing about licences.
STOP = frozenset("a an and any are as at be by can do for from has he if in into is it may must no not of on or our she so that the their them they this to under was were which will with without you your".split())
_WORD = r"[A-Za-z0-9]+"
#: A line that ends so, or has no word, ends a paragraph.
_END = r"[.!?:;]\\s*$"


def words_of(text: str) -> list[str]:
    return [w.lower() for w in re.findall(_WORD, text)]


def ngrams(text: str) -> set[str]:
    """The n-grams of 1 to 3 words."""
    words = words_of(text)
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


@cache
def anchors() -> frozenset[str]:
    """The words of templates and names but for STOP, numbers and those of one or two letters (cc stays).

    The features are the n-grams that hold one, so that a paragraph without any has the bias for its score, which means UNKNOWN, and no template's half.
    """
    texts = [t for ts in TEMPLATES.values() for t in ts] + [n for ns in NAMES.values() for n in ns]
    return frozenset(w for t in texts for w in words_of(t) if w not in STOP and not w.isdigit() and (len(w) > 2 or w == "cc"))


def anchor_pattern() -> str:
    return rf"(?i)(?<![A-Za-z0-9])(?:{'|'.join(sorted(anchors()))})(?![A-Za-z0-9])"


def features(text: str) -> set[str]:
    return {g for g in ngrams(text) if not anchors().isdisjoint(g.split())}


@dataclass(frozen=True)
class LicenseModel:
    families: list[str]  # the last is UNKNOWN
    weights: dict[str, list[float]]
    bias: list[float]
    #: what logits are divided by, so that probabilities are those that templates which weren't taught have
    temperature: float
    #: the least probability of a family that isn't put down to UNKNOWN; it must also be likelier than that
    threshold: float
    #: of the held-out texts, by tenths of the likeliest class's probability: how many, their mean probability and how many were right
    reliability: list[tuple[int, float, float]]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


@cache
def train(seed: int = 0, copies: int = 6, rounds: int = 100, rate: float = 1.0, decay: float = 1e-4, folds: int = 3) -> LicenseModel:
    """Fit to the templates and names and to copies of them with words lost, doubled or set among others; OTHERS teach UNKNOWN.

    Temperature and threshold come from texts that weren't taught: in each of some folds a part of the templates and of OTHERS is left out whole, with all
    of its copies, and judged by a model of the rest. The temperature makes these texts' classes likeliest, the threshold tells the most of them rightly.
    """
    rng = random.Random(seed)
    filler = "in the and of to with for that this on by as an is it from are at be or".split()
    families = [*TEMPLATES, UNKNOWN]

    def variant(text: str) -> str:
        words = [w for w in text.split() if rng.random() > 0.08]
        at = rng.randrange(len(words) + 1) if words and rng.random() < 0.2 else 0
        words[at:at] = rng.choices(filler, k=rng.randrange(3))
        return " ".join(rng.choices(filler, k=rng.randrange(4)) + words + rng.choices(filler, k=rng.randrange(6)))

    known = [(t, families.index(f), i) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)] + [(t, len(families) - 1, i) for i, t in enumerate(OTHERS)]
    rows = [(features(t if k == 0 else variant(t)), y, i % folds) for t, y, i in known for k in range(copies)]
    # Families have few names or many, and teach about as much by them; names are never held out.
    forms = lambda name: (name, f"Licensed under {name}.", f"SPDX-License-Identifier: {name}")
    rows += [(features(t), families.index(f), -1) for f, names in NAMES.items() for name in names for t in forms(name) for _ in range(copies * 2 // len(names) + 1)]
    # Texts with words of anyone's teach that a few such words are no licence.
    rows += [(features(" ".join(rng.choices(filler, k=8) + rng.sample(sorted(anchors()), 1))), len(families) - 1, -1) for _ in range(copies * len(OTHERS))]
    vocabulary = sorted({g for grams, _, _ in rows for g in grams})
    number = {g: i for i, g in enumerate(vocabulary)}
    x, truth, fold = np.zeros((len(rows), len(vocabulary) + 1)), np.array([y for _, y, _ in rows]), np.array([k for *_, k in rows])
    x[:, -1] = 1
    for i, (grams, _, _) in enumerate(rows):
        x[i, [number[g] for g in grams]] = 1

    def fit(some: np.ndarray) -> np.ndarray:
        a, y = x[some], np.eye(len(families))[truth[some]]
        w, speed = np.zeros((a.shape[1], len(families))), np.zeros((a.shape[1], len(families)))
        for _ in range(rounds):
            speed = 0.9 * speed - rate * (a.T @ (_softmax(a @ w) - y) / len(a) + decay * w)
            w += speed
        return w

    left = np.zeros((len(rows), len(families)))
    for k in range(folds):
        left[fold == k] = x[fold == k] @ fit(fold != k)
    left, held = left[fold >= 0], truth[fold >= 0]
    temperature = float(min(np.linspace(0.5, 5, 46), key=lambda t: -np.log(_softmax(left / t)[np.arange(len(held)), held]).sum()))
    p = _softmax(left / temperature)
    best, top = p[:, :-1].argmax(1), p[:, :-1].max(1)
    levels = np.linspace(0.2, 0.9, 71)
    known = [(top >= t) & (top > p[:, -1]) for t in levels]
    right = [((k & (best == held)) | (~k & (held == len(families) - 1))).sum() for k in known]
    bins = np.minimum((p.max(1) * 10).astype(int), 9)
    reliability = [(int((bins == b).sum()), float(p.max(1)[bins == b].mean()), float((p.argmax(1) == held)[bins == b].mean())) for b in range(10) if (bins == b).any()]
    table = np.round(fit(np.ones(len(rows), bool)), 6)
    return LicenseModel(families, {g: table[i].tolist() for g, i in number.items()}, table[-1].tolist(), temperature, float(levels[int(np.argmax(right))]), reliability)


def shapes() -> tuple[list[str], dict[str, list[tuple[int, float]]]]:
    """The family of each template (a family's names are one more), and for each n-gram the templates that have it with its share of each; a name is the whole."""
    found: dict[str, list[tuple[int, float]]] = {}
    owners: list[str] = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            grams = ngrams(text)
            for g in grams:
                found.setdefault(g, []).append((len(owners), 1 / len(grams)))
            owners.append(family)
        for name in NAMES.get(family, ()):
            found.setdefault(name, []).append((len(owners), 1.0))
        owners.append(family)
    return owners, found


def paragraphs(text: Column) -> Callable[[DataFrame], DataFrame]:
    """A function that gives each row its paragraphs, as line (where each begins) and paragraph.

    Wrapped lines are one paragraph: it goes on until a line that ends a sentence or has no word.
    """
    blank = "not lines[{0}] rlike '[A-Za-z0-9]'"
    starts = f"filter(sequence(0, size(lines) - 1), i -> i = 0 or {blank.format('i')} or {blank.format('i - 1')} or lines[i - 1] rlike '{_END}')"
    runs = "transform(starts, (s, k) -> struct(s as line, array_join(slice(lines, s + 1, coalesce(get(starts, k + 1), size(lines)) - s), ' ') as paragraph))"

    def add(rows: DataFrame) -> DataFrame:
        rows = rows.select("*", F.inline(F.array(F.struct(F.split(text, "\n", -1).alias("lines")))))
        rows = rows.select("*", F.inline(F.array(F.struct(F.expr(starts).alias("starts")))))
        return rows.select("*", F.inline(F.expr(runs))).drop("lines", "starts")

    return add


def _grams(words: str) -> str:
    """SQL for the n-grams of an array of words, each once, and the empty one, which counts how often a paragraph comes."""
    runs = [f"if(size({words}) < {n}, array(), transform(sequence(1, size({words}) - {n - 1}), i -> array_join(slice({words}, i, {n}), ' ')))" for n in (1, 2, 3)]
    return f"array_distinct(concat({', '.join(runs)}, array('')))"


def license_paragraphs(docs: DataFrame, model: LicenseModel | None = None, similar: float = 0.5) -> DataFrame:
    """text_hash, line, family, probability and similarity of each paragraph of the column text that holds one of anchors().

    family is the likeliest class if that isn't UNKNOWN, its probability reaches the model's threshold and at least the share similar of the n-grams of a template of the family, or
    one of its names, is in the paragraph; else unknown. Each paragraph is judged by sums over its n-grams; equal texts are judged once, however often they come.
    """
    model = model or train()
    spark, pattern = docs.sparkSession, anchor_pattern()
    texts = docs.select("text").filter(F.col("text").rlike(pattern)).select(F.xxhash64("text").alias("text_hash"), "text")
    rows = paragraphs(F.col("text"))(texts).drop("text").filter(F.col("paragraph").rlike(pattern))
    rows = rows.select("text_hash", "line", F.inline(F.array(F.struct(F.regexp_extract_all(F.translate("paragraph", UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0)).alias("words")))))
    rows = rows.select("text_hash", "line", F.explode(F.expr(_grams("words"))).alias("gram"))

    families, (owners, found) = model.families[:-1], shapes()
    zero, none = [0.0] * len(model.families), [0.0] * len(owners)
    spread = lambda pairs: [dict(pairs).get(t, 0.0) for t in range(len(owners))]
    grams = {""} | set(model.weights) | set(found)
    # A fixed table, of a few thousand n-grams.
    table = spark.createDataFrame([(g, model.bias if g == "" else model.weights.get(g, zero), spread(found[g]) if g in found else none, int(g == "")) for g in sorted(grams)], "gram string, w array<double>, s array<double>, one int")
    scored = rows.join(F.broadcast(table), "gram")
    sums = [F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(len(model.families))] + [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(len(owners))]
    scored = scored.groupBy("text_hash", "line").agg(F.sum("one").alias("copies"), *sums)
    logits = F.array(*(F.col(f"w{i}") / F.col("copies") / model.temperature for i in range(len(model.families))))
    near = F.array(*(F.greatest(F.lit(0.0), *(F.least(F.col(f"s{t}") / F.col("copies"), F.lit(1.0)) for t, g in enumerate(owners) if g == f)) for f in families))
    scored = scored.select("text_hash", "line", logits.alias("z"), near.alias("near"))
    scored = scored.withColumn("e", F.expr("transform(z, x -> exp(x - array_max(z)))")).withColumn("total", F.expr("aggregate(e, 0D, (a, x) -> a + x)"))
    scored = scored.withColumn("known", F.expr(f"slice(e, 1, {len(families)})")).withColumn("best", F.expr("array_position(known, array_max(known))").cast("int"))
    probability, similarity = F.expr("array_max(known) / total"), F.expr("element_at(near, best)")
    likely = (probability >= model.threshold) & F.expr("array_max(known) > element_at(e, -1)")
    names = F.array(*(F.lit(f) for f in families))
    family = F.when(likely & (similarity >= similar), F.element_at(names, F.col("best"))).otherwise(UNKNOWN)
    return scored.select("text_hash", "line", family.alias("family"), probability.alias("probability"), similarity.alias("similarity"))


def scan_licenses(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, family, probability, similarity and n_paragraphs.

    family is that of the confirmed paragraph with the highest probability (then the last by name), where reserved rights yield to a licence; unknown if paragraphs hold anchors but none is
    confirmed; null, as are probability and similarity, if none does or the text is null or empty. A text decides, whatever its doc_id: equal texts have equal
    results, and rows of one doc_id or none are judged each for itself. Other columns are ignored; an empty table gives no rows. Only hashes and ids are joined, never texts.
    """
    found = license_paragraphs(docs, model)
    kind = F.when(F.col("family") == UNKNOWN, 0).when(F.col("family") == RESERVED, 1).otherwise(2)
    rank = F.struct(kind.alias("a"), F.round("probability", 9).alias("b"), F.col("family").alias("c"), F.round("similarity", 9).alias("d"))
    found = found.groupBy("text_hash").agg(F.max(rank).alias("top"), F.count("*").alias("n"))
    rows = docs.select("doc_id", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_hash"))
    joined = rows.join(found, "text_hash", "left")
    return joined.select("doc_id", F.col("top.c").alias("family"), F.col("top.b").alias("probability"), F.col("top.d").alias("similarity"), F.coalesce("n", F.lit(0)).alias("n_paragraphs"))
