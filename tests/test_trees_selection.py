"""Boosted trees against a direct implementation; nearest-neighbour information, medians, running totals against brute force."""

import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainsight.operators import boosting, ordered, selection, stats

FEATS = ["f0", "f1", "f2", "f3"]
B = boosting.Boosting(rounds=3, depth=3, rate=0.3, bins=8, min_child_weight=2.0)


def _rows():
    rng = np.random.default_rng(4)
    out = []
    for sym in ("A", "B"):
        for fold in (0, 1):
            for i in range(160):
                x = [float(rng.normal()), float(rng.integers(0, 4)), None if rng.random() < 0.1 else float(rng.normal()), 1.0]
                y = int(np.clip(round(1 + x[0] + 0.5 * (x[1] == 2) + 0.3 * rng.normal()), 0, 2))
                out.append((sym, fold, f"d{i:03d}", y, *x))
    return out


def _direct(rows, b):
    """One model's trees in numpy: the same bins, samples, gains and tie rule."""
    key = rows[0][:2]
    y = np.array([r[3] for r in rows])
    cols = [[r[4 + j] for r in rows] for j in range(len(FEATS))]
    edges = []
    for c in cols:
        v = sorted(x for x in c if x is not None)
        edges.append(sorted({v[max(0, math.ceil(k / b.bins * len(v)) - 1)] for k in range(1, b.bins)}))
    bins = np.array([[0 if x is None else sum(e < x for e in edges[j]) for x in c] for j, c in enumerate(cols)]).T
    margin = np.zeros((len(rows), 3))
    out = []
    for rnd in range(b.rounds):
        used = np.array([int(hashlib.md5(f"{b.seed}:{rnd}:{key[0]}:{key[1]}:{r[2]}".encode()).hexdigest()[:8], 16) / 2 ** 32 < b.subsample for r in rows])
        e = np.exp(margin - margin.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        step = np.zeros_like(margin)
        for k in range(3):
            g, h = p[:, k] - (y == k), np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16)
            node = np.ones(len(rows), int)
            open_nodes, value = [1], {}
            for level in range(b.depth + 1):
                nxt = []
                for n in open_nodes:
                    at = used & (node == n)
                    gt, ht = g[at].sum(), h[at].sum()
                    value[n] = -b.rate * gt / (ht + b.l2)
                    best = None
                    for f in boosting.sampled_columns(FEATS, rnd, k, b) if level < b.depth else []:
                        for cut in sorted(set(bins[at, f]))[:-1]:
                            left = at & (bins[:, f] <= cut)
                            gl, hl = g[left].sum(), h[left].sum()
                            gain = round(gl ** 2 / (hl + b.l2) + (gt - gl) ** 2 / (ht - hl + b.l2) - gt ** 2 / (ht + b.l2), 9)
                            if hl >= b.min_child_weight and ht - hl >= b.min_child_weight and gain > boosting.LEAST_GAIN and (best is None or gain > best[0]):
                                best = (gain, f, cut)
                    out.append((*key, rnd, k, n, FEATS[best[1]] if best else None, edges[best[1]][best[2]] if best else None, best[0] if best else None, ht, value[n]))
                    if best:
                        here = node == n
                        node = np.where(here, 2 * n + (bins[:, best[1]] > best[2]), node)
                        nxt += [2 * n, 2 * n + 1]
                open_nodes = nxt
            step[:, k] = [value[n] for n in node]
        margin += step
    return out, margin


@pytest.fixture(scope="module")
def grown(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "symbol string, fold_id int, quote_date string, y int, f0 double, f1 double, f2 double, f3 double")
    return rows, df, boosting.train_boosted(df, FEATS, b=B)


def test_trees_equal_a_direct_implementation(grown):
    rows, _, trees = grown
    want = []
    for sym in ("A", "B"):
        for fold in (0, 1):
            want += _direct([r for r in rows if r[:2] == (sym, fold)], B)[0]
    cols = ("symbol", "fold_id", "round", "class", "node", "feature", "threshold", "gain", "cover", "value")
    got = {r[:5]: r[5:] for r in ((*(r[c] for c in cols),) for r in trees.collect())}
    assert set(got) == {w[:5] for w in want} and any(w[5] for w in want if w[4] > 1)
    for w in want:
        g = got[w[:5]]
        assert g[0] == w[5] and g[1] == w[6]
        assert g[2:] == pytest.approx(w[7:], abs=1e-7) if w[7] is not None else g[2] is None and g[3:] == pytest.approx(w[8:], abs=1e-9)


def test_scores_are_the_margins_of_the_trees(grown):
    rows, df, trees = grown
    x = df.filter("fold_id = 0").drop("fold_id", "y")
    got = {(r.symbol, r.quote_date, r.fold_id): (r.p_down, r.p_flat, r.p_up) for r in boosting.score(x, trees, FEATS).collect()}
    assert len(got) == 2 * 160 * 2
    for sym in ("A", "B"):
        part = [r for r in rows if r[:2] == (sym, 0)]
        z = _direct(part, B)[1]
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        assert all(got[sym, r[2], 0] == pytest.approx(tuple(q), abs=1e-9) for r, q in zip(part, p))
    assert not np.allclose([got["A", r[2], 1] for r in rows[:160]], [got["A", r[2], 0] for r in rows[:160]])


def test_importance_sums_to_one_and_unused_features_have_none(grown):
    _, _, trees = grown
    per = boosting.fold_importance(trees, FEATS).toPandas()
    assert np.allclose(per.groupby(["symbol", "fold_id"]).importance.sum(), 1) and (per[per.feature == "f3"].importance == 0).all()
    top = boosting.importance(trees, FEATS).toPandas().sort_values("mean_importance").groupby("symbol").feature.last()
    assert set(top) == {"f0"}


def test_scoring_plan_does_not_grow_with_folds(grown, spark):
    _, df, trees = grown
    plan = lambda t: boosting.score(df.drop("fold_id", "y"), t, FEATS)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(trees) == plan(trees.filter("fold_id = 0"))


# ---------------------------------------------------------------- nearest neighbours

def _psi(n):
    return -0.57721566490153286 + sum(1 / i for i in range(1, n))


def _brute_mi(pairs, k=3):
    by = {c: [v for v, l in pairs if l == c] for c in {l for _, l in pairs}}
    pairs = [(v, c) for v, c in pairs if len(by[c]) > 1]
    ks, ns, ms = [], [], []
    for i, (v, c) in enumerate(pairs):
        d = sorted(abs(v - w) for j, (w, e) in enumerate(pairs) if e == c and j != i)
        kk = min(k, len(d))
        r = d[kk - 1]
        ms.append(sum(abs(v - w) < r or (r == 0 and v == w) for w, _ in pairs))
        ks.append(kk)
        ns.append(len(by[c]))
    mean = lambda x: sum(map(_psi, x)) / len(x)
    return max(0.0, _psi(len(pairs)) + mean(ks) - mean(ns) - mean(ms))


def test_neighbour_information_equals_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        y = rnd.choice([-1, 0, 0, 1])
        rows.append((y, rnd.gauss(y, 1), float(rnd.randint(0, 3) + (y > 0)), rnd.gauss(0, 1e6), 5.0, None if i % 50 == 0 else rnd.random()))
    rows += [(7, 0.0, 1.0, 2.0, 5.0, 0.5), (8, 1.0, 1.0, 2.0, 5.0, 0.5), (8, 1.5, 1.0, 2.0, 5.0, 0.25)]
    df = spark.createDataFrame(rows, "label int, a double, b double, c double, d double, e double").withColumns({"v": F.lit(1), "n": F.lit(2)})
    names = ["a", "b", "c", "d", "e"]
    got = {r.feature: r.mi_score for r in stats.mutual_information_knn(df, names).collect()}
    full = [r for r in rows if r[5] is not None]
    for j, f in enumerate(names):
        assert got[f] == pytest.approx(_brute_mi([(round(r[1 + j] * 1e6), r[0]) for r in full]), abs=1e-9)
    assert got["a"] > 0.1 > got["c"] and got["d"] == pytest.approx(0, abs=1e-9)


def test_digamma(spark):
    got = spark.range(1, 200).select("id", stats.digamma(F.col("id")).alias("p")).collect()
    assert all(r.p == pytest.approx(_psi(r.id), abs=5e-12) for r in got)


# ---------------------------------------------------------------- medians, running totals

@pytest.mark.parametrize("few", [20, 100_000])
def test_medians_by_narrowing(spark, few):
    rnd = random.Random(1)
    rows = []
    for i in range(700):
        g = rnd.choice(["a", "a", "b", None])
        rows.append((g, rnd.random(), rnd.choice([1.0, 2.0]), 10.0 ** rnd.randint(-300, 300) * rnd.choice([-1, 1]), None if i % 3 else rnd.gauss(0, 1), float("nan") if i % 2 else float(i)))
    rows += [("lone", 1.0, None, 5.0, None, float("nan")), ("two", 1.0, 2.0, 1.7e308, 4.0, 1.0), ("two", 2.0, 4.0, -1.7e308, 8.0, 2.0)]
    cols = ["x", "y", "wide", "gaps", "nans"]
    df = spark.createDataFrame(rows, "g string, x double, y double, wide double, gaps double, nans double")
    for by in (["g"], []):
        got = {(r["g"] if by else 0): [r[c] for c in cols] for r in selection.exact_medians(df, cols, by, few=few, bins=16).collect()}
        for g in ({r[0] for r in rows} if by else {0}):
            for j, c in enumerate(cols):
                v = [r[1 + j] for r in rows if (not by or r[0] == g) and r[1 + j] is not None and not math.isnan(r[1 + j])]
                want = statistics.median(v) if v else None
                assert got[g][j] == (pytest.approx(want, rel=1e-12) if want is not None else None), (by, g, c)


def test_medians_of_distinct_values_hold_no_column(spark):
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_000).cast("double").alias("x"))
    assert selection.exact_medians(df, ["x"], few=500).first()["x"] == 29_999.5


def test_running_totals_over_a_common_key(spark):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 else rnd.choice("abc"), rnd.randint(0, 5), rnd.randint(1, 9)) for i in range(900)] + [(None, 1, 1), (None, 0, 2)]
    df = spark.createDataFrame(rows, "k string, o int, w int")
    got = ordered.running_total(ordered.in_order(df, ["k", "o"]), ["k"], "w", "t").groupBy("k", "o").agg(F.max("t").alias("t")).collect()
    assert {(r.k, r.o): r.t for r in got} == {(k, o): sum(w for a, b, w in rows if a == k and b <= o) for k, o, _ in rows}
    assert sorted(r.i for r in ordered.ranks(ordered.in_order(df, ["k", "o"]), ["k"], "i").filter("k = 'hot'").collect()) == list(range(1, 601))
