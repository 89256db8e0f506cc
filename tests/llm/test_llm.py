"""Training-data operators against brute force, exact round trips and odd inputs."""

from __future__ import annotations

import hashlib
import itertools
import json
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from chainsight.llm import op1_quality, op2_license, op3_chat, op4_simhash, op5_mtree, op6_packing, op7_cdc, op8_sharding, op9_mixing, op10_edits, queries
from chainsight.llm.common import components, ranked
from chainsight.llm.tokens import default_paths, encoder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, digest string, unit string, grp string, rank string, host string, kept string, probability string, first string, salt string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Ids and texts with copies, near copies, a shared passage, empty, null, blank and long ones."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(30, 200)) for _ in range(40)]
    passage = prose(rng, 60)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[0]) for i in range(30)]
    near = prose(rng, 400).split()
    for i in range(20):
        w = list(near)
        w[7 * i] = "changed"
        out.append((200 + i, " ".join(w)))
    out += [(300 + i, f"{base[i]} {passage} {base[i + 1]}") for i in range(6)]
    out += [(400, None), (401, ""), (402, " \n\t "), (403, "One"), (404, "two words"), (405, "ÄÖ é 漢字 \U0001f600 end"), (406, "in " * 900), (407, "in " * 700 + "x"), (408, prose(rng, 30_000)), (409, "<|endoftext|> a <|endoftext|>")]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][n % 3], ["a", "a", "b", None][n % 4], len(t or ""), *["x"] * 10) for n, (i, t) in enumerate(texts)]
    rows += [(403, "One", "en", "a", 3, *"xxxxxxxxxx"), (None, "no id", "en", "a", 5, *"xxxxxxxxxx"), (None, None, None, None, None, *[None] * 10)]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---------------------------------------------------------------- shared helpers

def test_ranked_is_gapless_whatever_the_buckets(spark):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 20, None).otherwise("cold").alias("k"))
    for buckets in (1, 7):
        got = ranked(df, ["k"], F.xxhash64("id"), ["id"], "r", buckets).collect()
        assert len(got) == 500
        for k in ("hot", "cold", None):
            assert sorted(r.r for r in got if r.k == k) == list(range(sum(r.k == k for r in got)))


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300) - 150, rng.randrange(300) - 150) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root}
    assert rows(components(spark.createDataFrame([], "a long, b long"))) == []


# ---------------------------------------------------------------- 1: quality

def brute_measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if win[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)


def test_quality_measures(docs, texts):
    got = {(r.doc_id, r.n_words): r for r in op1_quality.quality_verdicts(docs).collect()}
    for i, t in texts:
        want = brute_measures(t)
        r = got[i, want[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert op1_quality.quality_verdicts(docs).count() == docs.count()


def test_frequent_lines_count_documents_not_copies(spark):
    rng = random.Random(2)
    rows_ = [(i, f"Shared LINE 7 here\n{prose(rng, 12)}", "en", "h", 0, *"xxxxxxxxxx") for i in range(30)]
    copy = "\n".join(prose(rng, 20) for _ in range(3))
    rows_ += [(100 + i, copy, "en", "h", 0, *"xxxxxxxxxx") for i in range(60)]
    rows_ += [(200 + i, f"shared line 9   here\n{prose(rng, 12)}", "en", "small", 0, *"xxxxxxxxxx") for i in range(4)]
    rows_ += [(300, "shared line 1 here\n" * 12 + "own", "en", "h", 0, *"xxxxxxxxxx")]
    d = spark.createDataFrame(rows_, DOCS)
    limits = op1_quality.Limits(share=0.1, least=5)
    often = rows(op1_quality.frequent_lines(d, limits=limits).select("host", "line", "n_docs"))
    assert [(h, l) for h, l, _ in often] == [("h", op1_quality.line_hash(b"shared line 0 HERE"))] and 25 <= often[0][2] <= 31
    want = None
    for broadcast_rows in (100, 0):  # both ways to bring the lines to the documents
        x = op1_quality.Limits(share=0.1, least=5, broadcast_rows=broadcast_rows)
        got = {r.doc_id: (r.removed_words, r.kept, r["__text"]) for r in op1_quality.judge(d, ["doc_id"], limits=x, clean_text=True).collect()}
        assert want in (None, got)
        want = got
    assert want[0][0] == 4 and want[0][1] and "LINE" not in want[0][2]
    assert want[100] == (0, True, copy) and want[200][0] == 0
    assert want[300][:2] == (48, False)
    kept = op1_quality.kept_documents(d, limits)
    assert kept.columns == d.columns and kept.count() == 94 and kept.filter("n_chars <> length(text)").count() == 0


def test_boilerplate_heavy_documents_are_counted_exactly(spark):
    rng = random.Random(12)
    shared = prose(rng, 60)  # most of each text, so that its smallest shingle is nearly always one of the shared line's
    rows_ = [(i, f"{prose(rng, 10)}\n{shared}", "en", "h", 0, *"xxxxxxxxxx") for i in range(100)]
    rows_ += [(1000 + i, "copy " + prose(random.Random(1), 30), "en", None, 0, *"xxxxxxxxxx") for i in range(2500)]  # one of this host's 22 texts
    rows_ += [(None, t, "en", "h", 0, *"xxxxxxxxxx") for t in (None, "")]
    rows_ += [(2000 + i, f"{prose(rng, 10)}\n{shared}", "en", None, 0, *"xxxxxxxxxx") for i in range(21)]
    d = spark.createDataFrame(rows_, DOCS)
    line = op1_quality.line_hash(shared.encode())
    assert sorted(rows(op1_quality.frequent_lines(d).select("host", "line", "n_docs")), key=str) == sorted([("h", line, 100), (None, line, 21)], key=str)
    got = op1_quality.quality_verdicts(d).filter("removed_words = 60")
    assert got.count() == 121 and got.filter("kept").count() == 0


# ---------------------------------------------------------------- 2: licences

@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    return op2_license.train([prose(rng, rng.randrange(5, 40)).encode() for _ in range(800)])


def test_license_heldout_accuracy_and_templates(model):
    assert model.heldout_accuracy > 0.95
    for family, ts in op2_license.TEMPLATES.items():
        for t in ts:
            w = op2_license.words_of(t.encode())
            assert op2_license.classify(w, model.probabilities(w), model.settings)[0] == family, t
    rng = random.Random(9)
    plain = [op2_license.words_of(prose(rng, 30).encode()) for _ in range(200)]
    assert sum(op2_license.classify(w, p, model.settings)[0] == "none" for w, p in zip(plain, model.batch(plain))) >= 198


def test_license_calibration_and_unknown(model):
    rng = np.random.default_rng(1)
    hits, prob = [], []
    for k, f in enumerate(op2_license.FAMILIES):
        for t in op2_license.TEMPLATES[f]:
            for v in op2_license._variants(rng, op2_license.words_of(t.encode()), 10, [b"x1", b"y2"]):
                p = model.probabilities(v)
                hits.append(p.argmax() == k)
                prob.append(p.max())
    assert abs(np.mean(hits) - np.mean(prob)) < 0.1
    w = op2_license.words_of(b"License terms: redistribution permission under version public")
    label, _, alike = op2_license.classify(w, model.probabilities(w), model.settings)
    assert label in ("unknown", "none") and alike < 0.6


def test_license_scan(spark, docs, empty, model):
    d = spark.createDataFrame([(1, "Some text here.\nReleased under the MIT License.\nAll rights reserved."), (1, "Some text here.\nReleased under the MIT License.\nAll rights reserved."), (2, None), (3, ""), (None, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    got = sorted(rows(op2_license.license_scan(d, model).select("doc_id", "license", "n_license")), key=str)
    assert [r[2] for r in got if r[0] == 1] == [2, 2] and (2, "none", 0) in got and (3, "none", 0) in got and (None, "CC-BY-NC-4.0", 1) in got
    assert op2_license.license_scan(docs, model).count() == docs.count()
    assert rows(op2_license.license_scan(empty, settings=op2_license.Settings(rounds=5))) == []
    assert {(r.doc_id, r.paragraph, r.license) for r in op2_license.license_paragraphs(d, model).collect()} >= {(1, 1, "MIT"), (1, 2, "proprietary")}


WRAPPED = {
    "GPL-3.0": """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful
 */""",
    "BSD-3-Clause": """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:""",
    "MIT": """// Permission is hereby granted, free of charge, to any person obtaining a copy
// of this software and associated documentation files (the "Software"), to deal
// in the Software without restriction""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at""",
    "CC0-1.0": "To the extent possible under law,\r\nthe author has waived all copyright\r\nand related or neighboring rights\r\nto this work."}


def test_wrapped_notices_are_confirmed(spark, model):
    rng = random.Random(14)
    data = []
    for n, (family, notice) in enumerate(WRAPPED.items()):
        data += [(3 * n, notice), (3 * n + 1, f"{prose(rng, 12)}\n{notice}\n{prose(rng, 12)}"), (3 * n + 2, f"{prose(rng, 12)}\n\n{notice}\n\n{notice}")]
    half = "Redistribution and use in source\n\nand binary forms\n\nwith or without modification"
    data += [(100, "\n".join(prose(rng, 9) for _ in range(40))), (101, half)]
    got = {r.doc_id: (r.license, r.n_license, r.n_unknown) for r in op2_license.license_scan(spark.createDataFrame(data, "doc_id long, text string"), model).collect()}
    for n, family in enumerate(WRAPPED):
        assert [got[3 * n + k][:2] for k in range(3)] == [(family, 1), (family, 1), (family, 2)]
    assert got[100] == ("none", 0, 0) and got[101][1] == 0


# ---------------------------------------------------------------- 3: chat

NASTY = ["", "plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "<\\|im_end|>", "<\\\\/s>", "<<SYS>> [[INST] <s></s>", "\\", "a\n\nb\\n", "<|endoftext|><", "\U0001f600 é"]


def test_template_round_trip():
    for role, text in itertools.product([*NASTY, "assistant", "user"], NASTY):
        out, a, b = op3_chat.render_turn(role, text)
        assert op3_chat.parse_turn(out) == (role, text)
        if role == "assistant":
            assert op3_chat.unescape(out[a:b]) == text
        body = out[len(op3_chat.START):-len(op3_chat.END)]
        assert not any(c in body for c in ("<|im_start|>", "<|im_end|>", "</s>", "[INST]", "[/INST]", "<s>", "<|endoftext|>"))


def digest_of(turns):
    t = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
    own = "".join(x for r, x in turns if r == "assistant")
    return len(turns), t, len(own), hashlib.sha256(own.encode()).hexdigest()


def test_chat_digests(spark):
    convs = {i: [(["user", "assistant", "system", "tool"][(i + k) % 4], NASTY[(i * 3 + k) % len(NASTY)]) for k in range(1 + i % 5)] for i in range(30)}
    data = [(c, k, r, x) for c, ts in convs.items() for k, (r, x) in enumerate(ts)] + [(99, 0, None, None), (None, 0, "assistant", "n"), (98, 1, "assistant", "b"), (98, 1, "assistant", "b")]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame([(*d, "x", "y") for d in data], "conv_id long, turn long, role string, text string, formatted string, part string")
    got = {r[0]: tuple(r)[1:5] for r in op3_chat.read_back(op3_chat.formatted_conversations(df)).collect()}
    want = {c: digest_of(ts) for c, ts in convs.items()} | {99: digest_of([("", "")]), None: digest_of([("assistant", "n")]), 98: digest_of([("assistant", "b")] * 2)}
    assert got == want
    assert rows(op3_chat.read_back(op3_chat.formatted_conversations(df.limit(0)))) == []


def test_chat_query_on_the_table(spark):
    got = {r.conv_id: r for r in queries.op3_chat_formatting(spark, SF).collect()}
    convs = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    convs[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert {c: tuple(r)[1:5] for c, r in got.items()} == {c: digest_of(t) for c, t in convs.items()}


def test_unlike_layouts_become_the_same_turns():
    want = [("user", "q"), ("assistant", "a")]
    for rec in ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
                {"prompt": "q", "completion": "a"}, {"instruction": "q", "input": None, "output": "a"}, {"question": "q", "answer": "a"}):
        assert op3_chat.turns_of(json.dumps(rec))[1] == want
    assert op3_chat.turns_of(json.dumps({"instruction": "q", "input": "more", "output": "a"}))[1][0] == ("user", "q\n\nmore")
    for odd in (None, "", "{", "[]", '{"what": 1}', '{"messages": []}'):
        assert op3_chat.turns_of(odd)[1] == [("unmapped", odd or "")]


# ---------------------------------------------------------------- 4: SimHash

def brute_fingerprint(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    if not w:
        return 0
    sh = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """(id, fp) rows -> smallest id reachable, per fingerprint."""
    fps = sorted({f for _, f in pairs})
    seen, comp = {}, {}
    for f in fps:
        if f in seen:
            continue
        todo, group = [f], {f}
        while todo:
            x = todo.pop()
            for y in fps:
                if y not in group and (x ^ y).bit_count() <= 3:
                    group.add(y)
                    todo.append(y)
        for g in group:
            seen[g] = group
    for f in fps:
        ids = [i for i, g in pairs if g in seen[f] and i is not None]
        comp[f] = min(ids) if ids else None
    return comp


def test_simhash_against_brute_force(docs, texts, empty):
    pairs = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    comp = brute_components(pairs)
    want = Counter((i, f"{f:016x}", comp[f]) for i, f in pairs)
    for bucket_rows in (4096, 3):  # whole buckets, and buckets in parts
        found = op4_simhash.near_duplicates(docs, bucket_rows=bucket_rows)
        assert Counter(rows(found.select("doc_id", op4_simhash.hex_fingerprint(), "component_id"))) == want
    assert rows(op4_simhash.near_duplicates(empty)) == []
    one = op4_simhash.one_of_each(docs)
    ids = [r.doc_id for r in one.select("doc_id").collect()]
    assert one.columns == docs.columns and Counter(ids) == Counter([*{c for i, f in pairs if i is not None and (c := comp[f]) is not None}, None, None])


def test_links_lose_nothing_in_dense_and_sparse_buckets():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 63, 300, np.uint64)
    fp = np.unique(np.concatenate([fp, fp[:60] ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)), fp[0] ^ (np.uint64(1) << np.arange(40, dtype=np.uint64))]))
    pairs = {(a, b) for a, b in itertools.combinations(fp.tolist(), 2) if (a ^ b).bit_count() <= 3}
    keys = op4_simhash.block_keys(fp, 3)
    assert all(any(k[i] == k[j] for k in keys) for i, j in itertools.combinations(range(len(fp)), 2) if (fp.tolist()[i], fp.tolist()[j]) in pairs)
    links = {tuple(sorted((fp.tolist()[x], fp.tolist()[y]))) for x, y in op4_simhash.forest(fp, op4_simhash.pivot_table(fp), 3)}
    assert links <= pairs and len(links) < len(fp)
    comp = brute_components([(f, f) for f in fp.tolist()])
    root = {f: f for f in fp.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {f: find(f) for f in root} == comp


# ---------------------------------------------------------------- 5: M-tree

def brute_top(vecs, qs, k):
    out = {}
    for q, x in vecs:
        if q in qs:
            s = sorted(((-int(np.dot(x, y)), i) for i, y in vecs if i != q))[:k]
            out[q] = [(i, -v) for v, i in s]
    return out


def test_mtree_is_exact(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 12)) * rng.uniform(0.2, 2, (700, 1))
    x[100:340] = x[100]  # a very common vector
    x[400] = 0
    data = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    odd = [(1001, None), (1002, [None] * 12), (1003, [float("nan")] * 12), (1004, [float("inf")] + [0.0] * 11), (1005, []), (None, [1.0] * 12), (1006, [0.5, 0.5]), (1100, None)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>").withColumn("grp", F.lit("x")).withColumn("v", F.lit("x")).repartition(4)
    vecs = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in data] + [(1006, np.array([512, 512] + [0] * 10))]
    for tree in (op5_mtree.Tree(), op5_mtree.Tree(routers=5, sample=50, page=16, group=100, block=3)):
        got = {}
        for r in op5_mtree.top_k(df, F.col("vec_id") % 25 == 0, 10, tree=tree).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == brute_top(vecs, {i for i, _ in vecs if i % 25 == 0}, 10)
    few = op5_mtree.top_k(df.filter("vec_id < 4"), F.col("vec_id") == 0, 10).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3]
    assert op5_mtree.top_k(df.limit(0), F.lit(True), 10).collect() == []
    assert op5_mtree.top_k(df.filter("vec_id = 1"), F.lit(True), 10).collect() == []


def test_mtree_skips_distances_by_stored_bounds():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8)) * 3000
    x = op5_mtree.lifted(np.rint(np.repeat(centres, 50, axis=0) + rng.normal(size=(1000, 8)) * 20), 1e9)
    routers = op5_mtree.spread_out(x[::7], 16)
    pages = [dict(zip([c.split()[0] for c in op5_mtree.PAGES.split(", ")], op5_mtree._page(0, int(op5_mtree.distances(x[i:i + 1], routers).argmin()), routers, np.arange(i, i + 50), x[i:i + 50]))) for i in range(0, 1000, 50)]
    nodes = op5_mtree.Nodes(pages, 9)
    touched = []

    class Watched(list):
        def __getitem__(self, i):
            touched.append(i)
            return super().__getitem__(i)
    nodes.entries = Watched(nodes.entries)
    got = op5_mtree.search(x[3, :-1], 3, 10, nodes, routers, 1e9)
    want = sorted(((-int(x[i, :-1] @ x[3, :-1]), i) for i in range(1000) if i != 3))[:10]
    assert [(-s, i) for s, i in got] == want and len(touched) < 20


# ---------------------------------------------------------------- 6: packing

def test_token_ids_equal_the_tokenizers_library(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(default_paths()[0])
    ids = encoder()
    for x in [x for _, x in texts if x] + NASTY:
        assert ids(x).tolist() == t.encode(x, add_special_tokens=False).ids


def test_packing_is_whole_and_tight(docs, texts, empty):
    got = op6_packing.packed(docs, bucket_rows=10).collect()
    ids = encoder()
    want = Counter()
    by_doc = {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for i, t in texts:
        a = np.append(ids(t or ""), 0).astype("<u4")
        ps = sorted(by_doc[i, len(a)], key=lambda r: r.start)
        copies = 2 if i == 403 else 1
        assert sum(p.length for p in ps) == copies * len(a)
        assert all(crc32(a[p.start:p.start + p.length].tobytes()) == p.ids_crc32 for p in ps)
        want[i] += copies
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        ends = list(itertools.accumulate(n for _, n in sorted(s)))
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert sorted(seqs) == list(range(len(seqs)))
    assert len(seqs) * 1024 - sum(r.length for r in got) < 1024 + 0.01 * 1024 * len(seqs)
    assert rows(op6_packing.packed(empty)) == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    hist = np.zeros(257, np.int64)
    np.add.at(hist, rng.integers(1, 257, 4000 * seed + 5), 1)
    hist[90] += 1000 * seed
    patterns, stream = op6_packing.plan(hist, 256)
    used = stream.copy()
    for p, n in patterns:
        assert 256 * 0.99 <= sum(p) <= 256
        for x in p:
            used[x] += n
    assert (used == hist).all()


def test_fit_minimises_the_least_squares():
    combos = np.array([[0, 3, 7], [0, 4, 6], [2, 4, 4], [0, 5, 5], [3, 3, 4]])
    hist = np.array([0, 0, 5, 20, 30, 8, 10, 9, 0, 0, 0], float)
    a = np.zeros((11, 5))
    for j, c in enumerate(combos):
        for x in c[c > 0]:
            a[x, j] += 1
    x = op6_packing.fit(combos, hist, 5000)
    grad = a.T @ (a @ x - hist)
    assert (x >= 0).all() and (grad > -1e-3).all() and abs(grad @ x) < 1e-2


# ---------------------------------------------------------------- 7: chunks

def test_chunks_resist_shifts():
    rng = random.Random(6)
    text = prose(rng, 800).encode()
    spans = lambda b: [b[s:e] for s, e in op7_cdc.chunk_spans(b)]
    assert b"".join(spans(text)) == text
    moved = text[:1000] + b" inserted words " + text[1000:]
    assert len(set(spans(text)) - set(spans(moved))) <= 4
    for odd in (b"", b"a", b"a" * 20_000, b"in " * 5000, bytes(range(256)) * 9):
        got = spans(odd)
        assert b"".join(got) == odd and all(len(c) <= 4000 for c in got)


def test_boundaries_by_definition():
    rng = random.Random(3)
    data = np.frombuffer(prose(rng, 300).encode(), np.uint8)
    h = []
    for i in range(len(data)):
        h.append(sum(int(op7_cdc.GEAR[data[i - j]]) << j for j in range(min(16, i + 1))) & 0xFFFF)
    assert op7_cdc.gear(data).tolist() == h
    want, last = [], -99
    for i, x in enumerate(h):
        if x >= max(h[max(0, i - 16):i], default=-1) and x >= max(h[i + 1:i + 17], default=-1) and i - last > 16:
            want.append(i)
            last = i
    assert op7_cdc.boundaries(data, 16).tolist() == want


def test_repeated_passages_are_found_and_clean_texts_left(docs, texts, empty):
    found = op7_cdc.passages(docs).collect()
    by = dict(texts)
    hit = {r.doc_id for r in found}
    assert {*range(100, 130), *range(201, 220), *range(301, 306), 406, 407} <= hit  # 306.. hold it first
    assert not hit & {*range(40), 400, 401, 402, 403, 404, 405, 408, 409, 300 - 1}
    for r in found:
        assert by[r.doc_id].encode()[r.start_byte:r.end_byte] in by[r.source_doc_id].encode() * 2 or r.doc_id >= 200
    out = {r.doc_id: r for r in op7_cdc.deduplicated(docs).collect()}
    for i in (0, 1, 39, 404, 405, 408):
        assert out[i].text == by[i] and out[i].n_chars == len(by[i])
    assert 101 not in out and None in out and out[400].text is None and out[401].text == ""
    assert not set(range(301, 306)) & set(out)  # base, passage and next base all stand in earlier documents
    assert len(out[300].text.split()) == 60  # the passage, held first here; both texts around it stand in documents 0 and 1
    assert op7_cdc.deduplicated(docs).columns == docs.columns
    assert rows(op7_cdc.passages(empty)) == [] and rows(op7_cdc.deduplicated(empty)) == []


def short_words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 3))) for _ in range(n))


def two_digits(rng, n):
    return " ".join(str(rng.randint(10, 99)) for _ in range(n))


@pytest.mark.parametrize("words", [prose, short_words, two_digits])
def test_every_planted_passage_of_51_words_is_cut_whole(spark, words):
    rng = random.Random(11)
    data = []
    for i in range(300):
        p = words(rng, 51)
        data += [(2 * i, f"{words(rng, 20)} {p} {words(rng, 20)}", p), (2 * i + 1, f"{words(rng, 9)}\n{p}\n{words(rng, 33)}", p)]
    docs = spark.createDataFrame([x[:2] for x in data], "doc_id long, text string")
    found = {r.doc_id: r for r in op7_cdc.passages(docs).collect()}
    assert not any(i % 2 == 0 for i in found)
    whole = 0
    for i, text, p in data[1::2]:
        r = found.get(i)
        whole += r is not None and r.start_byte <= text.index(p) and r.end_byte >= text.index(p) + len(p) and r.n_words >= 51
    assert whole == 300


def test_extended_runs_equal_brute_force(spark):
    """Each run, grown to the largest common stretch of the two documents around it, by comparing characters one by one."""
    rng = random.Random(8)
    data, want = [], {}
    for i in range(60):
        p = (prose, short_words)[i % 2](rng, rng.randint(60, 90))
        a, b = f"{prose(rng, 30)} {p} {prose(rng, 30)}", f"{prose(rng, 12)} {p} {prose(rng, 7)}"
        x, y = a.index(p), b.index(p)
        e, f = x + len(p), y + len(p)
        while x and y and a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
        while e < len(a) and f < len(b) and a[e] == b[f]:
            e, f = e + 1, f + 1
        words = len([k for k in range(y, f) if b[k] != " " and (k == 0 or b[k - 1] == " ")])
        data += [(2 * i, a), (2 * i + 1, b), (2 * i + 1, b)]  # a repeated row counts once
        want[2 * i + 1] = (y, f, words, 2 * i)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.start_byte, r.end_byte, r.n_words, r.source_doc_id) for r in op7_cdc.passages(docs).collect()}
    assert got == want
    for near in (1, 5):  # long agreements are compared in a second pass
        assert got == {r.doc_id: (r.start_byte, r.end_byte, r.n_words, r.source_doc_id) for r in op7_cdc.passages(docs, op7_cdc.Chunks(near=near)).collect()}


def test_text_without_words_repeats_by_bytes(spark):
    rng = random.Random(2)
    blob = lambda n: "".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(n))
    p = blob(600)
    docs = spark.createDataFrame([(1, f"{blob(90)}{p}{blob(200)}"), (2, f"{blob(310)}{p}{blob(20)}"), (3, blob(900)), (4, None), (5, "")], "doc_id long, text string")
    got = op7_cdc.passages(docs).collect()
    assert [(r.doc_id, r.source_doc_id) for r in got] == [(2, 1)] and got[0].start_byte <= 310 and got[0].end_byte >= 910


def test_agreement_of_edges():
    assert op7_cdc.agreement(b" one two", b"x one two", 0, 100) == (8, 2)
    assert op7_cdc.agreement(b"zone two", b"xone two", 0, 100) == (7, 1)
    assert op7_cdc.agreement(b" one two", b" one twx", 1, 100) == (6, 2)
    assert op7_cdc.agreement(b"xone two", b"yone two", 1, 4) == (4, 0)
    assert op7_cdc.agreement(b"", b"abc", 0, 9) == (0, 0) and op7_cdc.agreement(b"a", b"a", 1, 9) == (0, 0)


def test_common_chunks_are_dealt_over_tasks_with_the_same_result(spark):
    rng = random.Random(21)
    passage = prose(rng, 40)
    data = [(i, f"{prose(rng, 15)}\n{passage}\n{prose(rng, 12)}") for i in range(1500)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    salted, plain = op7_cdc.Chunks(sample=4, parts=7), op7_cdc.Chunks(share=2.0)
    assert len(op7_cdc.common_digests(d, salted)) > 3 and not op7_cdc.common_digests(d, plain)
    span = lambda s: {(r.doc_id, r.start_byte, r.end_byte, r.n_words) for r in op7_cdc.passages(d, s).collect()}
    got = span(salted)
    assert got == span(plain) and {x[0] for x in got} == set(range(1, 1500))


def test_spans_never_break_a_character():
    text = "aé漢b".encode()
    for s in range(len(text) + 1):
        for e in range(s, len(text) + 1):
            op7_cdc.remove_spans(text, [(s, e)]).decode()


# ---------------------------------------------------------------- 8: sharding

def shard_check(got, n, shards):
    count = Counter(r.shard for r in got)
    sizes = [count.get(s, 0) for s in range(shards)]
    assert len(got) == n and (not n or max(sizes) - min(sizes) <= 1)
    for s in count:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))


def test_sharding_law_and_groups(docs, empty, spark):
    got = op8_sharding.assign(docs, shards=7).collect()
    shard_check(got, docs.count(), 7)
    text = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    assert all(r["size"] == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == crc32(text[r.doc_id].encode()) for r in got if r.doc_id is not None)
    groups = {}
    for r in got:
        groups.setdefault(r.grp, set()).add(r.shard)
    assert max(len(s) for g, s in groups.items()) <= 4  # 31 copies of one text, 15 or 16 places a shard
    shard_check(op8_sharding.assign(empty, shards=7).collect(), 0, 7)
    shard_check(op8_sharding.assign(docs.limit(3), shards=7).collect(), 3, 7)


def test_sharding_where_everything_is_linked(spark):
    data = [(i, f"t{i % 25}") for i in range(403)] + [(1000 + i, "hot") for i in range(200)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = op8_sharding.assign(d, shards=10).collect()
    shard_check(got, 603, 10)
    own = {}
    for r in got:
        own.setdefault(r.grp, []).append(r.shard)
    kept = sum(max(Counter(s).values()) for s in own.values())
    assert kept > 2.5 * sum(max(Counter(i % 10 for i in range(len(s))).values()) for s in own.values())  # far better than dealt out
    plan = op8_sharding.assign(d, shards=10)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# ---------------------------------------------------------------- 9: mixing

def test_raking_meets_the_marginals(spark, docs):
    cells = op9_mixing.cell_table(docs)
    targets = {d: op9_mixing.targets_of(cells, d, 0.5) for d in op9_mixing.DIMS}
    raked = op9_mixing.rake(cells, targets, op9_mixing.Mix(sweeps=200, every=10, close=1e-8)).toPandas()
    total = raked.tokens.sum()
    rank = raked.groupby("source").tokens.sum()
    for d in op9_mixing.DIMS[:2]:
        want = raked.groupby(d).tokens.sum() ** 0.5
        have = raked.groupby(d).w.sum()
        assert np.allclose(have / total, want / want.sum(), atol=2e-2), d
    assert len(rank)
    # against the same sweeps by hand
    w = raked.tokens.astype(float).copy()
    for _ in range(400):
        for d in op9_mixing.DIMS:
            goal = raked.groupby(d).tokens.sum() ** 0.5
            w = w * raked[d].map(goal / goal.sum() * total) / w.groupby(raked[d]).transform("sum")
    assert np.allclose(w, raked.w, rtol=1e-3, atol=1e-3)


def test_sampling_is_calibrated_and_total(spark, docs, empty):
    rng = random.Random(4)
    data = [(i, prose(rng, 20), "en", "a" if i % 4 else "b", 0, *"xxxxxxxxxx") for i in range(4000)]
    d = spark.createDataFrame(data, DOCS)
    given = {"source": spark.createDataFrame([("a", 1.0), ("b", 1.0), ("absent", 7.0)], "source string, share double")}
    out = op9_mixing.sampled(d, ["doc_id"], given).toPandas()
    p = out.groupby("__source")["__probability"].agg(["min", "max"])
    assert np.allclose(p.loc["b"], 1) and np.allclose(p.loc["a"], 1 / 3, atol=0.01)
    assert abs(out[out["__source"] == "a"]["__kept"].mean() - 1 / 3) < 0.03 and out[out["__source"] == "b"]["__kept"].all()
    full = op9_mixing.sampled(docs, ["doc_id"])
    assert full.count() == docs.count()
    got = {r.doc_id: r for r in full.collect()}
    assert got[400]["__kept"] and got[401]["__topic"] == "empty"
    mixed = op9_mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and rows(op9_mixing.mixed_documents(empty)) == []
    plan = mixed._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_tiny_source_does_not_thin_out_the_others(spark):
    import corpus_pipeline
    rng = random.Random(8)
    data = [(i, prose(rng, 200), ["en", "de"][i % 2], "abc"[i % 3 if i % 5 else 0], 0, *"xxxxxxxxxx") for i in range(3000)]
    stray = [(5000, prose(rng, 10), "en", "stray", 0, *"xxxxxxxxxx"), (5001, prose(rng, 10), None, None, 0, *"xxxxxxxxxx")]
    alone = {r.doc_id for r in corpus_pipeline.mixing(spark, spark.createDataFrame(data, DOCS), SF).select("doc_id").collect()}
    out = {r.doc_id for r in corpus_pipeline.mixing(spark, spark.createDataFrame(data + stray, DOCS), SF).select("doc_id").collect()}
    assert {5000, 5001} <= out and abs(len(out) - len(alone)) < 30 and len(out) > 2500
    mix = op9_mixing.Mix(rare=0.01)
    cells = op9_mixing.cell_table(spark.createDataFrame(data + stray, DOCS))
    p = op9_mixing.probabilities(op9_mixing.rake(cells, {d: op9_mixing.targets_of(cells, d, mix.alpha) for d in op9_mixing.DIMS}, mix), mix.rare).toPandas()
    cap = (p.ratio / p.probability)[p.probability < 1].median()
    assert p.w[p.ratio > cap * 1.002].sum() <= 0.01 * p.w.sum() and np.allclose(p.probability, np.minimum(1, p.ratio / cap), atol=1e-6)


# ---------------------------------------------------------------- 10: edits

def test_edited_trees_equal_a_full_count():
    count = op10_edits.counter()
    rng = random.Random(12)
    for n in (0, 1, 5, 200, 3000):
        text = prose(rng, n).replace(" p", "\n\n p").replace("mu", "don't  ")
        tree = op10_edits.Tree(text, count)
        assert tree.total == count(text) and sum(tree.lengths) == len(text)
        for _ in range(25):
            at, gone = rng.randrange(-2, len(text) + 3), rng.choice([0, 1, 3, 40, 600])
            new = rng.choice(["", " ", "\n", "x", " some new words", "é漢", prose(rng, 200), "<|endoftext|>"])
            a = min(max(at, 0), len(text))
            text = text[:a] + new + text[min(len(text), a + gone):]
            tree.edit(at, gone, new)
            assert tree.text == text and tree.total == count(text) and sum(tree.lengths) == len(text)
            assert tree.total == sum(tree.counts())


def test_edits_encode_only_what_they_touch():
    tree = op10_edits.Tree(prose(random.Random(1), 20_000), op10_edits.counter())
    tree.encoded = 0
    tree.edit(50_000, 3, "abc")
    assert 0 < tree.encoded < 1500


def test_edit_counts_of_documents(spark, docs, empty):
    edits = spark.createDataFrame([(0, 2, 0, 5, "New start "), (0, 1, 3, None, None), (400, 1, 0, 0, "from nothing"), (408, 1, 10 ** 6, 4, "tail"), (999, 1, 0, 0, "x")], "doc_id long, seq int, at int, deleted int, inserted string")
    out = op10_edits.apply_edits(op10_edits.with_edits(op10_edits.build_trees(docs), edits)).collect()
    count = op10_edits.counter()
    assert len(out) == docs.count()
    for r in out:
        assert r.tokens_after == count(r.text or "") == (r.tree_sums[1] if len(r.tree_sums) > 1 else 0)
    got = {r.doc_id: r for r in out}
    assert got[0].text.startswith("New start ") and got[400].text == "from nothing" and got[408].text.endswith("tail") and got[401].tokens_after == 0 and got[1].reencoded_chars == 0
    assert op10_edits.apply_edits(op10_edits.with_edits(op10_edits.build_trees(empty), edits)).collect() == []


def test_edit_query_equals_a_full_count(spark):
    count = op10_edits.counter()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op10_edit_counts(spark, SF).collect()}
    at = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", *[F.pmod(F.xxhash64("doc_id") + F.lit(k), F.greatest(F.length("text"), F.lit(1)).cast("long")).alias(f"a{k}") for k in (1, 1009, 500_009)]).collect()}
    for i, d in docs.items():
        t = d.text
        assert got[i].tokens_before == count(t)
        for k, gone, new in ((1, 9, ""), (1009, 0, f" revised {d.source}\n"), (500_009, 5, d.lang)):
            p = min(at[i][f"a{k}"], len(t))
            t = t[:p] + new + t[p + gone:]
        assert (got[i].tokens_after, got[i].text_chars) == (count(t), len(t))


# ---------------------------------------------------------------- pipeline and tables

def test_odd_tables_through_the_pipeline(spark, docs, empty):
    import corpus_pipeline
    for first in (docs, empty):
        d = first.select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, SF)
            if name != "packing":
                assert out.columns == d.columns and [t for _, t in out.dtypes] == [t for _, t in d.dtypes]
                assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in d.select("doc_id").collect()}
            d = out
        d.collect()


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = corpus_pipeline.quality(spark, docs, SF)
    kept = {r.doc_id for r in one.collect()}
    base = {r.doc_id: brute_measures(r.text) for r in docs.collect()}
    assert kept <= {i for i, m in base.items() if m[0] >= 10 and 100 * m[4] <= 20 * m[0]} and len(kept) > 0.8 * len(base)
    two = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, one, SF).collect()}
    pairs = [(r.doc_id, brute_fingerprint(r.text)) for r in one.collect()]
    assert two == set(brute_components(pairs).values())
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and {r.doc_id for r in out} <= two


def test_batches_without_rows():
    none = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary())], names=["doc_id", "b"])
    assert list(op4_simhash._fingerprints([none], 3))[0].num_rows == 0
    assert list(op7_cdc._chunks([none], op7_cdc.Chunks()))[0].num_rows == 0


def test_small_batches_lose_and_reorder_nothing():
    import pyarrow as pa
    from chainsight.llm.common import small_batches
    texts = [b"a" * 10, None, b"", b"b" * 100, b"c", b"d" * 3, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.binary())], names=["i", "b"])
    for column in (1, "b"):
        parts = list(small_batches([batch, batch.slice(2, 3), batch.slice(0, 0)], column, most=8))
        assert [r for p in parts for r in p.column(1).to_pylist()] == texts + texts[2:5]
        assert len(parts) > 4 and all(p.schema == batch.schema for p in parts)
