"""License scan: a trained paragraph classifier, calibrated, with templates confirming its predictions.

A paragraph is one line of a text, or a notice wrapped over neighbouring lines: a run of words over two or more lines
without a wordless line between them that holds at least ``like`` of a template's word pairs within twice its length.
Comment marks are no words, so they part nothing. A run is judged like a line, from its first pair to its last, unless
one of its lines has that family already; where a family is confirmed, its lines are no longer ``unknown``. Its words and word pairs are hashed to sparse features for a
multinomial logistic regression over the licence families and ``none``. The model is trained on
variants of the templates below (words dropped, swapped, doubled, foreign words around them) and
on a bounded sample of paragraphs of the corpus that hold no licence word. A temperature fitted on a held-out
fifth calibrates the probabilities. A paragraph is

* a family, where that family has the largest calibrated probability, at least ``sure``, one of its
  templates shares at least ``like`` of its word pairs with the paragraph, and no mark of a neighbouring licence contradicts it: another
  version number, or a word such as ``lesser`` or ``sharealike``;
* ``unknown``, where ``none`` has less than half but no family is both sure and confirmed;
* ``none`` otherwise.

Defined cases: null or empty text has no paragraph and gets ``none``; an empty table gives an empty
result (the model then trains on templates and their shuffled words alone); repeated rows are
judged alike; a tie goes to the family earlier in ``FAMILIES``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Short public licence notices by family.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"],
    "MIT": ["Released under the MIT License.",
            "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
                     "Licensed under the BSD 3-Clause License."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
                "Released into the public domain under CC0 1.0."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved.", "Copyright holder. All rights reserved. No part of this publication may be reproduced without permission."],
}
# The version a family's notices name, and words (or word pairs) that only its neighbours' notices hold.
VERSIONS = {"Apache-2.0": "2", "GPL-3.0": "3", "MPL-2.0": "2", "CC-BY-4.0": "4", "CC-BY-NC-4.0": "4"}
NEIGHBOURS = {
    "GPL-3.0": ["lesser", "library", "affero", "lgpl", "agpl"],
    "BSD-3-Clause": ["2 clause", "4 clause", "simplified"],
    "CC-BY-4.0": ["sharealike", "noncommercial", "noderivatives", "noderivs", "by sa", "by nc", "by nd"],
    "CC-BY-NC-4.0": ["sharealike", "noderivatives", "noderivs", "nc sa", "nc nd"],
    "MIT": ["mit 0", "no attribution"],
}
FAMILIES = list(TEMPLATES)
NONE = len(FAMILIES)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_HINT = "(?i)licen[sc]|copyright|rights reserved|public domain|creative commons|redistribut|permission"


@dataclass(frozen=True)
class Settings:
    """sample: most corpus paragraphs trained on; sample_chars: characters of each that training sees; variants: training variants of each template;
    bits: hashed feature space; sure, like: thresholds of probability and of template likeness."""
    sample: int = 4000
    sample_chars: int = 400
    variants: int = 60
    bits: int = 15
    sure: float = 0.6
    like: float = 0.6
    rounds: int = 300
    seed: int = 7


def words_of(b: bytes) -> list[bytes]:
    return _WORD.findall(b.lower())


def grams(words: list[bytes], bits: int) -> np.ndarray:
    """Hashed ids of words and word pairs."""
    if not words:
        return np.zeros(0, np.int64)
    c = np.fromiter(map(crc32, words), np.int64, len(words))
    return np.concatenate([c, (c[:-1] * 31 + c[1:] * 17 + 1)]) & ((1 << bits) - 1)


def _variants(rng, words, k, filler):
    for _ in range(k):
        w = [x for x in words if rng.random() > 0.08] or list(words)
        if rng.random() < 0.3 and len(w) > 2:
            i = int(rng.integers(len(w) - 1))
            w[i], w[i + 1] = w[i + 1], w[i]
        if rng.random() < 0.4 and filler:
            at = int(rng.integers(len(filler)))
            extra = filler[at:at + int(rng.integers(1, 9))]
            w = extra + w if rng.random() < 0.5 else w + extra
        yield w


@dataclass
class Model:
    weights: np.ndarray  # (2^bits + 1, classes); the last row is the bias
    temperature: float
    settings: Settings
    heldout_accuracy: float

    def probabilities(self, words: list[bytes]) -> np.ndarray:
        return self.batch([words])[0]

    def batch(self, docs: list[list[bytes]]) -> np.ndarray:
        return _softmax(_scores(self.weights, [grams(w, self.settings.bits) for w in docs]) / self.temperature)


def _scores(weights, feats):
    n = np.array([len(f) for f in feats])
    out = np.tile(weights[-1], (len(feats), 1))
    full = n > 0
    if full.any():
        at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        out[full] += np.add.reduceat(weights[np.concatenate([f for f in feats if len(f)])], at, axis=0) / np.sqrt(n[full])[:, None]
    return out


def _softmax(s):
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(plain: list[bytes], settings: Settings = Settings()) -> Model:
    """Fit on template variants and ``plain`` paragraphs; a fifth is held out for the temperature."""
    rng = np.random.default_rng(settings.seed)
    plain_words = [w for w in map(words_of, plain) if w]
    filler = [x for w in plain_words[:400] for x in w]
    docs, y = [], []
    for k, family in enumerate(FAMILIES):
        for t in TEMPLATES[family]:
            w = words_of(t.encode())
            for v in [w, *_variants(rng, w, settings.variants, filler)]:
                docs.append(v)
                y.append(k)
            for _ in range(3):  # the same words in no order say nothing
                docs.append([w[i] for i in rng.permutation(len(w))][: max(1, len(w) // 2)])
                y.append(NONE)
    docs += plain_words
    y = np.array(y + [NONE] * len(plain_words))
    feats = [grams(w, settings.bits) for w in docs]
    held = rng.random(len(docs)) < 0.2
    fit, rest = np.flatnonzero(~held), np.flatnonzero(held)
    size, k = 1 << settings.bits, NONE + 1
    weights = np.zeros((size + 1, k))
    f = [feats[i] for i in fit]
    n = np.array([len(x) for x in f])
    flat, row = np.concatenate(f), np.repeat(np.arange(len(f)), n)
    used, flat = np.unique(flat, return_inverse=True)
    scale = (1 / np.sqrt(np.maximum(n, 1)))[row]
    small, grad2 = np.zeros((len(used) + 1, k)), np.full((len(used) + 1, k), 1e-8)
    goal = np.eye(k)[y[fit]]
    for _ in range(settings.rounds):  # full-batch adaptive gradient steps
        s = np.tile(small[-1], (len(f), 1))
        for c in range(k):
            s[:, c] += np.bincount(row, small[flat, c] * scale, len(f))
        err = (_softmax(s) - goal) / len(f)
        g = np.vstack([np.stack([np.bincount(flat, err[row, c] * scale, len(used)) for c in range(k)], axis=1), err.sum(axis=0)]) + 1e-6 * small
        grad2 += g * g
        small -= 0.3 * g / np.sqrt(grad2)
    weights[used], weights[-1] = small[:-1], small[-1]
    s = _scores(weights, [feats[i] for i in rest])
    temps = np.linspace(0.25, 4, 76)
    loss = [-np.log(_softmax(s / t)[np.arange(len(rest)), y[rest]] + 1e-12).mean() for t in temps]
    return Model(weights.astype(np.float32), float(temps[int(np.argmin(loss))]), settings, float((s.argmax(axis=1) == y[rest]).mean()))


def plain_sample(docs: DataFrame, settings: Settings = Settings()) -> list[bytes]:
    """Bounded training sample: a paragraph without licence words, picked by a hash, of documents in the order of
    another hash. Only documents whose hash falls below some three times the sample are sorted at all."""
    n = docs.count()
    lines = F.filter(F.split(F.col("text").cast("string"), "\n"), lambda x: F.trim(x) != "")
    one = F.get(lines, F.pmod(F.xxhash64("doc_id", F.lit(settings.seed + 1)), F.greatest(F.size(lines), F.lit(1))).cast("int"))
    lines = docs.select(F.substring(one, 1, settings.sample_chars).alias("line"), F.xxhash64("doc_id", F.lit(settings.seed)).alias("h"))
    rows = lines.filter(F.pmod("h", F.lit(max(n, 1))) < 3 * settings.sample).filter(~F.col("line").rlike(_HINT)).orderBy("h", "line").limit(settings.sample).select("line").collect()
    return [r[0].encode() for r in rows]


_PAIRS = {f: [set(zip(w, w[1:])) for w in (words_of(t.encode()) for t in ts)] for f, ts in TEMPLATES.items()}


def likeness(words: list[bytes], family: str) -> float:
    """Largest share of a template's word pairs that the paragraph holds."""
    have = set(zip(words, words[1:]))
    return max(len(p & have) / len(p) for p in _PAIRS[family])


_NUMBERED = re.compile(rb"(?:version|v|license|licence|gpl|by|nc|international|attribution)?v?([0-9]+)$")
_VERSION_OF = {b"version", b"v", b"gpl", b"attribution", b"noncommercial", b"by", b"nc", b"mpl", b"apache", b"sharealike", b"sa", b"nd"}


def contradicted(words: list[bytes], family: str) -> bool:
    """Whether the paragraph names another version than the family's (and not that one too) or holds a mark of a neighbour."""
    text = b" " + b" ".join(words) + b" "
    if any(b" " + mark.encode() + b" " in text for mark in NEIGHBOURS.get(family, ())):
        return True
    if family not in VERSIONS:
        return False
    named = {m[1] for a, b in zip([b"", *words], words) if (m := _NUMBERED.match(b)) and (a in _VERSION_OF or b != m[1])}
    return bool(named) and VERSIONS[family].encode() not in named


_TEMPLATE_PAIRS = [pairs for family in FAMILIES for pairs in _PAIRS[family]]
_HOLDERS: dict = {}
for _t, _pairs in enumerate(_TEMPLATE_PAIRS):
    for _pair in _pairs:
        _HOLDERS.setdefault(_pair, []).append(_t)


def runs_of(words: list[bytes], like: float) -> list[tuple[int, int]]:
    """(start, end) in words of the runs that hold at least ``like`` of a template's word pairs within twice the template's
    length, none overlapping another: those with the larger share first, then the shorter."""
    at: dict = {}
    for i, pair in enumerate(zip(words, words[1:])):
        for t in _HOLDERS.get(pair, ()):
            at.setdefault(t, []).append((i, pair))
    found = []
    for t, hits in at.items():
        size, inside, left = len(_TEMPLATE_PAIRS[t]), Counter(), 0
        if len(hits) < like * size:
            continue
        for i, pair in hits:
            inside[pair] += 1
            while i - hits[left][0] > 2 * size or inside[hits[left][1]] > 1:
                first = hits[left][1]
                inside[first] -= 1
                if not inside[first]:
                    del inside[first]
                left += 1
            if len(inside) >= like * size:
                found.append((-len(inside) / size, i + 2 - hits[left][0], hits[left][0], i + 2))
    out, taken = [], bytearray(len(words))
    for _, _, a, b in sorted(found):
        if not any(taken[a:b]):
            out.append((a, b))
            taken[a:b] = b"\1" * (b - a)
    return sorted(out)


def _wrapped(ids, paras, like):
    """((text, first line), last line, words) of the runs over two or more lines; ``ids``: (text, line) of ``paras``."""
    at = 0
    while at < len(ids):
        end = at + 1
        while end < len(ids) and ids[end] == (ids[end - 1][0], ids[end - 1][1] + 1):
            end += 1
        if end - at > 1:
            words = [w for p in paras[at:end] for w in p]
            edge = np.cumsum([len(p) for p in paras[at:end]])
            for a, b in runs_of(words, like):
                first, last = (at + int(np.searchsorted(edge, x, side="right")) for x in (a, b - 1))
                if last > first:
                    yield ids[first], ids[last][1], words[a:b]
        at = end


def classify(words: list[bytes], p: np.ndarray, settings: Settings) -> tuple[str, float, float]:
    """(class, probability, likeness) of one paragraph, given its calibrated probabilities."""
    best = int(p[:NONE].argmax())
    alike = likeness(words, FAMILIES[best]) if p[NONE] < 0.5 else 0.0
    if p[best] >= settings.sure and p[best] > p[NONE] and alike >= settings.like and not contradicted(words, FAMILIES[best]):
        return FAMILIES[best], float(p[best]), alike
    return ("unknown" if p[NONE] < 0.5 else "none"), float(p[best]), alike


SCHEMA = "paragraph int, license string, probability double, likeness double"


def _scan(it, model: Model):
    for batch in it:
        ids, paras = [], []
        for i, b in enumerate(batch.column(1).to_pylist()):
            for j, line in enumerate((b or b"").split(b"\n")):
                w = words_of(line)
                if w:
                    ids.append((i, j))
                    paras.append(w)
        found = {}
        for at in range(0, len(paras), 2000):
            probs = model.batch(paras[at:at + 2000])
            for x in np.flatnonzero(probs[:, NONE] < 0.5):
                found[ids[at + x]] = classify(paras[at + x], probs[x], model.settings)
        runs = list(_wrapped(ids, paras, model.settings.like))
        judged = []
        for at in range(0, len(runs), 2000):
            part = [r[2] for r in runs[at:at + 2000]]
            judged += [classify(w, p, model.settings) for w, p in zip(part, model.batch(part))]
        for ((i, j), last, _), got in zip(runs, judged):
            own = {x: found[i, x][0] for x in range(j, last + 1) if (i, x) in found}
            if got[0] not in FAMILIES or got[0] in own.values():
                continue
            for x, label in own.items():
                if label == "unknown":
                    del found[i, x]
            found.setdefault((i, j), got)
        rows = [(*k, *found[k]) for k in sorted(found)]
        src = [r[0] for r in rows]
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(src, pa.int64())), *[pa.array(c, t) for c, t in zip(cols[1:], (pa.int32(), pa.string(), pa.float64(), pa.float64()))]], names=["doc_id", "paragraph", "license", "probability", "likeness"])


def license_paragraphs(docs: DataFrame, model: Model | None = None, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, paragraph, license, probability, likeness) of every paragraph that is not ``none``."""
    model = model or train(plain_sample(docs, settings), settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("b"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(lambda it: _scan(it, shared.value), f"doc_id {kind}, {SCHEMA}")


def _by_document(it, model: Model):
    for batch in it:
        n = batch.num_rows
        found = list(_scan([pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), batch.column(1)], names=["doc_id", "b"])], model))[0].to_pylist()
        license, prob, known, unknown = ["none"] * n, [0.0] * n, [0] * n, [0] * n
        for r in found:
            i = r["doc_id"]
            if r["license"] == "unknown":
                unknown[i] += 1
                if license[i] == "none":
                    license[i] = "unknown"
            else:
                known[i] += 1
                if r["probability"] > prob[i] or license[i] in ("none", "unknown"):
                    license[i], prob[i] = r["license"], r["probability"]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(license), pa.array([round(x, 4) for x in prob]), pa.array(known, pa.int64()), pa.array(unknown, pa.int64())], names=["doc_id", "license", "probability", "n_license", "n_unknown"])


def license_scan(docs: DataFrame, model: Model | None = None, settings: Settings = Settings()) -> DataFrame:
    """One row per document: the surest confirmed licence (else ``unknown`` or ``none``), its
    probability, and the numbers of licence paragraphs and of unknown ones. No shuffle."""
    model = model or train(plain_sample(docs, settings), settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("b"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(lambda it: _by_document(it, shared.value), f"doc_id {kind}, license string, probability double, n_license long, n_unknown long")
