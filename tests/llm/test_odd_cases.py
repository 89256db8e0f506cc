"""Cases that a review found: long white space, two texts of one id, hubs, large vectors, odd records, clashing names, target tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainsight.llm import op3_chat, op4_simhash, op5_mtree, op6_packing, op7_cdc, op8_sharding, op9_mixing, op10_edits
from chainsight.llm.common import components
from chainsight.llm.tokens import default_paths, encoder


@pytest.mark.parametrize("run", [" ", "\t", "\n"])
def test_a_million_white_spaces_encode_like_the_tokenizer(run):
    from tokenizers import Tokenizer
    text = f"a{run * 1_000_000}b"
    assert encoder()(text).tolist() == Tokenizer.from_file(default_paths()[0]).encode(text, add_special_tokens=False).ids


def test_long_white_space_in_packing_and_edits(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 1_000_000 + "b"), (2, "plain words")], "doc_id long, text string")
    pieces = op6_packing.packed(docs, window=1024, end=0).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert len(pieces) == 2 and all(r.n == r.t for r in pieces)
    edits = F.array(F.struct(F.lit(1).alias("at"), F.lit(3).alias("deleted"), F.lit("x").alias("inserted")))
    got = {r.doc_id: r for r in op10_edits.apply_edits(op10_edits.build_trees(docs, edits)).select("doc_id", "tokens_before", "tokens_after").collect()}
    count = lambda t: len(encoder()(t))
    assert got[1].tokens_before == count("a" + " " * 1_000_000 + "b") and got[1].tokens_after == count("ax" + " " * 999_997 + "b")


def test_an_id_with_two_texts_keeps_both(spark):
    x, y = " ".join(f"alpha{i}" for i in range(50)), " ".join(f"omega{i * 7}" for i in range(50))
    rows = [(3, x, 1), (5, x, 2), (5, y, 3), (5, y, 3), (None, x, 4), (7, None, 5), (8, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id long").withColumns({"digest": F.lit("d"), "row": F.lit(1)})
    got = sorted((r.doc_id or 0, r.text or "") for r in op4_simhash.one_of_each(docs).collect())
    assert got == sorted([(3, x), (5, y), (0, x), (7, "")])


def test_components_of_a_star_and_a_chain(spark):
    star = [(0, i) for i in range(1, 3001)] + [(3000 + i, 3001 + i) for i in range(40)]
    edges = spark.createDataFrame(star, "a long, b long")
    for hub in (20_000, 50):
        got = {r.node: r.root for r in components(edges, hub).collect()}
        assert got == {i: 0 for i in range(1, 3041)}


def test_large_vectors_are_scored_exactly(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) * np.where(np.arange(300) % 3 == 0, 1e9, 1.0)[:, None]
    x[7] = 1e6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in op5_mtree.top_k(df, F.col("vec_id") % 50 == 0, 10, tree=op5_mtree.Tree(routers=5, page=16, group=100)).collect()]
    ints = [[int(np.floor(1024 * c)) for c in v] for v in x]
    want = []
    for q in range(0, 300, 50):
        scores = sorted(((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in enumerate(ints) if i != q))[:10]
        want += [(q, k + 1, i, -s if abs(s) < 2 ** 63 else None) for k, (s, i) in enumerate(scores)]
    assert sorted(got) == sorted(want)


def test_records_with_more_fields_odd_keys_and_halves_of_pairs(spark):
    turns = lambda r: op3_chat.turns_of(json.dumps(r))[1]
    assert turns({"id": 1, "messages": [{"role": "user", "content": "x", "name": "n"}, {"role": "gpt", "content": "y"}]}) == [("user", "x"), ("assistant", "y")]
    assert turns({"prompt": "a", "response": "b", "score": 0.5}) == [("user", "a"), ("assistant", "b")]
    assert turns({"messages[].role": "a", "messages[].content": "b"})[0][0] == "unmapped"
    assert op3_chat.paths({"a.b": 1, "a": {"b": 1}}) == {"a\\.b", "a.b"}
    rows = [(1, 1, '{"prompt": "\\ud800x", "response": "y"}'), (1, 2, "[" * 100_000), (2, 1, '{"a":' * 50_000 + "1" + "}" * 50_000), (3, 1, None)]
    got = op3_chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, record string")).collect()
    assert sorted((r.conv_id, r.turn, r.role) for r in got) == [(1, 1, "assistant"), (1, 1, "user"), (1, 2, "unmapped"), (2, 1, "unmapped"), (3, 1, "unmapped")]
    assert {r.text for r in got if r.role == "user"} == {"�x"}


def test_ties_are_ordered_by_plain_text(spark):
    import hashlib
    texts = ["<|im_start|>", "<zz", "<|aa", "[INST]", "<s>"]
    df = spark.createDataFrame([(1, 1, "user", t) for t in texts], "conv_id long, turn long, role string, text string")
    got = op3_chat.read_back(op3_chat.formatted_conversations(df)).first()
    assert got.turns_sha256 == hashlib.sha256("".join(f"user\n{t}\n" for t in sorted(texts)).encode()).hexdigest()


def test_clashing_names_in_mixing_and_passages(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(i, long if i < 3 else f"own text {i} " * 10, "en", f"s{i % 2}", 5) for i in range(12)]
    odd = {c: F.lit(1) for c in ("row", "b", "spans", "had", "span_id", "__b", "__id", "tokens", "topic", "kept", "probability", "p_lang", "__p", "__tokens", "a.b")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(odd)
    cut = op7_cdc.deduplicated(docs)
    assert cut.columns == docs.columns and {r.doc_id for r in cut.collect()} >= {0, 3, 11}
    mixed = op9_mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {r["__tokens"] for r in mixed.collect()} == {1}


def test_target_tables_are_checked(spark):
    rows = [(i, "some words here", "en", "ab"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    target = lambda *r: {"source": spark.createDataFrame(r, "source string, share double")}
    for bad in ([("a", 0.5), ("a", 0.5), ("b", 1.0)], [("a", 0.0), ("b", 1.0)], [("a", None), ("b", 1.0)], [("a", float("nan"))], [("z", 1.0)]):
        with pytest.raises(ValueError):
            op9_mixing.mixed_documents(docs, target(*bad)).count()
    assert {r.source for r in op9_mixing.mixed_documents(docs, target(("a", 1.0), ("z", 3.0))).collect()} == {"a"}


def test_shards_when_nothing_is_linked_or_all_is(spark):
    for texts in ([f"t{i}" for i in range(90)], ["same"] * 90, []):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        got = op8_sharding.assign(docs, shards=8).groupBy("shard").count().collect()
        assert sum(r["count"] for r in got) == len(texts) and (not texts or max(r["count"] for r in got) - min(r["count"] for r in got) <= 1)


def test_neighbouring_licences_are_not_confirmed():
    from chainsight.llm import op2_license as op2
    plain = [f"word{i} tells of house{i % 7} and tree{i % 11} in the evening".encode() for i in range(400)]
    model = op2.train(plain)
    label = lambda t: op2.classify(op2.words_of(t.encode()), model.probabilities(op2.words_of(t.encode())), model.settings)[0]
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    for text in (gpl.format("", 2), gpl.format("Lesser ", 3), gpl.format("Affero ", 3), gpl.format("Lesser ", "2.1"), "This work is licensed under the GNU General Public License, version 2.",
                 "Licensed under the BSD 2-Clause License.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-ND 4.0.",
                 "Licensed under CC BY 3.0.", "Licensed under the Apache License, Version 1.1.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1."):
        assert label(text) in ("unknown", "none"), text
    for family, templates in op2.TEMPLATES.items():
        for t in templates:
            assert label(t) == family and label(f"{t} See page 7, section 12 of 2019.") == family, t
    assert label(gpl.format("", "2 or version 3")) == "GPL-3.0"
