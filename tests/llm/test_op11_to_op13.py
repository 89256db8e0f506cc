"""Operators 11 to 13: brute force, held-out accuracy, odd inputs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainsight.llm import op11_quality_fm as fm
from chainsight.llm import op12_variants as variants
from chainsight.llm import op13_prefix as prefix

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- 11: factorisation machine

def test_linear_time_margin_equals_all_pairs():
    m = fm.Machine(buckets=32, factors=3)
    rng = np.random.default_rng(1)
    model = fm.Model(40, m)
    model.w, model.bias = rng.normal(size=40).astype(np.float32), 0.3
    rows = [(rng.choice(40, n, replace=False).astype(np.int32), rng.normal(size=n).astype(np.float32)) for n in (1, 2, 9, 30)]
    got = model.margins(*fm._joined(rows))
    for (at, x), z in zip(rows, got):
        pairs = sum(float(model.v[at[i]] @ model.v[at[j]]) * float(x[i] * x[j]) for i in range(len(at)) for j in range(i + 1, len(at)))
        assert z == pytest.approx(model.bias + float(model.w[at] @ x) + pairs, abs=1e-4)


def test_pairs_alone_are_learned():
    """Label = exclusive or of two words: no linear score can tell them apart."""
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (2000, 2))
    rows = [(np.array([int(a), 2 + int(b)], np.int32), np.ones(2, np.float32)) for a, b in bits]
    y = (bits[:, 0] ^ bits[:, 1]).astype(float)
    model = fm.fit(rows, y, 4, fm.Machine(buckets=4, epochs=60, patience=60, rate=0.1))
    assert ((model.margins(*fm._joined(rows)) > 0) == (y == 1)).mean() > 0.99


def _labelled(n):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice("the of and house tree water light stone river".split()) for _ in range(rnd.randint(5, 60))]
        bad = i % 3 == 0
        rows.append((i, " ".join(w + "!!" if bad else w for w in words), 100))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_held_out_accuracy_and_columns(spark):
    rows, labels = _labelled(400)
    rows += [(None, "the house", None), (1000, None, 5), (1001, "", None), (1002, "stone " * 300_000, 9), (5, rows[5][1], 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").withColumns({"score": F.lit(1.0), "y": F.lit(0), "id": F.lit("a"), "lang": F.lit("en")})
    lab = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, quality int")
    got = fm.quality_scores(docs, lab).collect()
    assert len(got) == len(rows)
    want = dict(labels)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == want[r.doc_id] for r in held if r.doc_id in want) >= 0.97 * sum(r.doc_id in want for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1


def test_labels_of_held_out_rows_and_ids_do_not_matter(spark):
    rows, labels = _labelled(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (sorted((r.doc_id, r.score) for r in fm.quality_scores(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()) for x in (labels, flipped))
    assert a == b


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in fm.quality_scores(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    assert {r.predicted for r in fm.quality_scores(docs, ones).collect()} == {1}
    assert fm.quality_scores(docs.limit(0), ones).count() == 0


def test_pieces_cover_a_long_text():
    text = b"ab cd\n" * 700_000 + b"x" * 3_000_000 + b" end"
    assert b"".join(fm._pieces(text)) == text


# ---------------------------------------------------------------- 12: spelling variants

def _brute_variants(rows):
    lower = {i: i + 32 for i in range(65, 91)}
    count = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    v = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        a, b = sorted((a, b), key=len)
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[p + (len(a) == len(b)):] == b[p + 1:]

    words = sorted(v)
    links = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w in words:
        if links[w]:
            best = min(links[w], key=lambda x: (-v[x], x))
            if v[best] >= 10 * v[w]:
                form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, v[w], len(links[w]), form.get(w), v[form[w]] if w in form else None, root))
    return out


def _odd_words():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abÀ") for _ in range(rnd.choice([6, 7, 8, 9]))) for _ in range(500)]
    words += ["z" * k for k in range(5, 15)] + ["ttttttt" + c for c in "abcdefghijkl"]
    texts = [" ".join(rnd.choice(words) if rnd.random() < 0.6 else "abababab" for _ in range(200)).upper() if i % 2 else "1".join(rnd.choice(words) for _ in range(90)) for i in range(50)]
    return [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(3, None), (4, ""), (5, "퟿中" + "ÿ" * 9), (6, "ÿ" * 9), (7, "abababab " * 2000)]


@pytest.mark.parametrize("most", [20_000, 3])
def test_variants_equal_brute_force(spark, most):
    rows = _odd_words()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(0), "key": F.lit("k")})
    got = sorted(tuple(r) for r in variants.variants(docs, most=most).select("word", "n", "n_near", "form", "form_n", "root").collect())
    assert got == _brute_variants(rows)


def test_forms_are_followed_to_the_last(spark):
    text = [(1, "aaaaaaa " * 2 + "aaaaaab " * 30 + "aaaaabb " * 400)]
    docs = spark.createDataFrame(text, "doc_id long, text string")
    got = {r.word: (r.form, r.root) for r in variants.variants(docs).collect()}
    want = {w: (f, r) for w, _, _, f, _, r in _brute_variants(text)}
    assert got == want and any(f != r for f, r in want.values() if f)


def test_variants_of_an_empty_table(spark):
    assert variants.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_in_pieces_equal_one_search(monkeypatch):
    monkeypatch.setattr(variants, "PIECE", 7)
    text = "Abc Àÿ×x中yz, qrstuvw" * 9
    got = [r.decode() for part in variants.runs(text.encode()) for r in part]
    assert got == [r.translate({i: i + 32 for i in range(65, 91)}) for r in re.findall("[A-Za-zÀ-ÿ]+", text)]


# ---------------------------------------------------------------- 13: prefix trie

def _brute_trie(rows):
    conv = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in conv.items()}
    seqs = {c: tuple(conv.get(c - c % 20, [])[:zlib.crc32(str(c).encode()) % 4] + v[zlib.crc32(str(c).encode()) % 4:]) for c, v in conv.items()}
    members, kids, below = collections.defaultdict(list), collections.defaultdict(list), {}
    for c, v in seqs.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        below[p] = (sum(below[k][0] for k in kids[p]) or 1, own + sum(below[k][1] for k in kids[p]))
        ends = ",".join(map(str, sorted(c for c in members[p] if len(seqs[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else -1, len(members[p]), len(kids[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def _trie(df, **kw):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in prefix.prefix_trie(df, **kw).collect())


SCHEMA = "conv_id long, turn int, role string, text string"


@pytest.mark.parametrize("hot", [10_000, 1])
def test_trie_equals_brute_force(spark, hot, monkeypatch):
    if hot == 1:
        monkeypatch.setattr(prefix, "SUPER", 2)
        monkeypatch.setattr(prefix, "CHUNK_BITS", 1)
    rnd = random.Random(5)
    rows = []
    for c in range(60):
        for i in range(rnd.choice([0, 1, 2, 9, 17, 33])):
            rows.append((c, rnd.choice([None, i, i, i]), rnd.choice(["u", "a", None]), rnd.choice(["x y", "x", "", None, "a  b\tc"])))
        if c % 7 == 3:
            rows += [(c + 100, i, "u", f"same {i}") for i in range(40)]
    rows += [(None, 1, "u", "z"), (20, 3, "u", "x"), (20, 3, "u", "x"), (300, 0, "u", "only")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit(1), "part": F.lit(2), "conv": F.lit(3), "block": F.lit(0)})
    assert _trie(df, hot_children=hot) == _brute_trie(rows)


def test_one_very_long_conversation_and_its_copy(spark):
    rows = [(c, i, "user", f"turn {i}") for c in (1, 2) for i in range(3000)] + [(3, 0, "user", "turn 0")]
    assert _trie(spark.createDataFrame(rows, SCHEMA)) == _brute_trie(rows)


def test_empty_conversations(spark):
    assert _trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []
