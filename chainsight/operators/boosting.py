"""Three-class boosted trees for all (symbol, fold) models at once.

Histogram boosting as Spark aggregates. A level of the trees of one round is ONE job for every model and class: the
gradients and hessians of the softmax loss are summed by (model, class, node, feature, bin), running sums over
a feature's bins give the gain of every split, and the best one of each node is kept. Rows are sampled by a hash of
their key, columns by a hash of round and class, so a run can be repeated and restated in SQL. Nothing
of the data or of the models passes through the driver; it only counts rounds and levels.

The ensemble is a TABLE: one row per node (model, round, class, node) with its feature, threshold, gain, cover and value; node 1
is the root and 2n, 2n + 1 are the children of n, left where value <= threshold. Missing values go left. Margins of the training rows
are written after each round, which cuts the lineage; the state before is deleted.

Scoring brings the rows and the trees of a symbol together in one cogroup (both bounded by the calendar) and walks arrays, so the plan is the
same for any number of folds.

Bins are exact quantiles while a model has at most ``accuracy`` training rows, and the approximate ones of a
bounded sketch beyond.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..session import ensure_checkpoint_dir, file_system

CLASSES = 3
#: gains below this make no split
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Boosting:
    rounds: int = DEFAULTS.n_trees
    depth: int = DEFAULTS.max_depth
    rate: float = DEFAULTS.learning_rate
    subsample: float = DEFAULTS.subsample
    colsample: float = DEFAULTS.colsample
    min_child_weight: float = DEFAULTS.min_child_weight
    l2: float = 1.0
    bins: int = 32
    accuracy: int = 10_000
    seed: int = DEFAULTS.seed


def sampled_columns(features: list[str], rnd: int, k: int, b: Boosting) -> list[int]:
    """The tree's columns: a fixed share of them, of smallest hash."""
    digest = {i: hashlib.md5(f"{b.seed}:{rnd}:{k}:{c}".encode()).hexdigest() for i, c in enumerate(features)}
    return sorted(sorted(digest, key=digest.get)[:max(1, int(b.colsample * len(features)))])


def row_draw(keys: list[str], rnd: int, seed: int) -> Column:
    """A number in [0, 1) that a row's key and the round determine."""
    text = F.concat_ws(":", F.lit(f"{seed}:{rnd}"), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def bin_edges(rows: DataFrame, features: list[str], keys: list[str], b: Boosting) -> DataFrame:
    """(keys..., edges): per feature the distinct values at k / bins of a model's rows, from one aggregate."""
    at = F.array(*[F.lit(k / b.bins) for k in range(1, b.bins)])
    cuts = [F.coalesce(F.array_distinct(F.percentile_approx(c, at, b.accuracy)), F.array().cast("array<double>")) for c in features]
    return rows.groupBy(*keys).agg(F.array(*cuts).alias("edges"))


def _bin(edges: Column, value: Column) -> Column:
    """Number of edges below the value; 0 where it is missing."""
    return F.when(value.isNull() | F.isnan(value), F.lit(0)).otherwise(F.size(F.filter(edges, lambda e: e < value)))


def _walk(k: int, levels: int) -> Column:
    """Node of class ``k`` after ``levels`` levels of the splits in ``tree``; 0 where the walk ended before."""
    node = F.lit(1)
    for _ in range(levels):
        split = F.try_element_at("tree", F.lit(k * 1000) + node)
        node = F.when(split.isNull(), F.lit(0)).otherwise(2 * node + (F.get("bins", split["f"]) > split["b"]).cast("int"))
    return node


def _leaf(k: int, depth: int) -> Column:
    """Node of class ``k`` at which a row ends."""
    node = F.lit(1)
    for _ in range(depth):
        split = F.try_element_at("tree", F.lit(k * 1000) + node)
        node = F.when(split.isNull(), node).otherwise(2 * node + (F.get("bins", split["f"]) > split["b"]).cast("int"))
    return node


def _splits_of(levels: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys..., tree): a round's splits of each model as a map, at most 3 * 2^depth entries."""
    rows = levels[0]
    for d in levels[1:]:
        rows = rows.unionByName(d)
    entry = F.struct((F.col("k") * 1000 + F.col("node")).alias("key"), F.struct("f", "b").alias("value"))
    return rows.filter("f IS NOT NULL").groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("tree"))


def _probabilities() -> list[Column]:
    top = F.array_max("margin")
    e = [F.exp(F.get("margin", F.lit(k)) - top) for k in range(CLASSES)]
    return [x / (e[0] + e[1] + e[2]) for x in e]


def _level(state: DataFrame, splits: DataFrame | None, features: list[str], keys: list[str], row_keys: list[str], rnd: int, level: int, b: Boosting) -> DataFrame:
    """One row per live node of this level: its sums, and the best split if there is one."""
    rows = state.filter(row_draw([*keys, *row_keys], rnd, b.seed) < b.subsample)
    rows = rows.join(splits, keys) if splits is not None else rows
    p = _probabilities()
    classes = []
    for k in range(CLASSES):
        g = p[k] - (F.col("y") == k).cast("double")
        h = F.greatest(2.0 * p[k] * (1.0 - p[k]), F.lit(1e-16))
        classes.append(F.struct(F.lit(k).alias("k"), _walk(k, level).alias("node"), g.alias("g"), h.alias("h"),
                                F.array(*[F.lit(i) for i in sampled_columns(features, rnd, k, b)]).alias("columns")))
    long = rows.select(*keys, "bins", F.explode(F.array(*classes)).alias("c")).filter("c.node > 0")
    long = long.select(*keys, "c.k", "c.node", "c.g", "c.h", "bins", F.explode("c.columns").alias("f")).withColumn("b", F.get("bins", F.col("f")))
    hist = long.groupBy(*keys, "k", "node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    per = [*keys, "k", "node", "f"]
    run = Window.partitionBy(*per).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*per)
    s = hist.withColumns({"gl": F.sum("g").over(run), "hl": F.sum("h").over(run), "gt": F.sum("g").over(whole), "ht": F.sum("h").over(whole),
                          "last": F.max("b").over(whole) == F.col("b")})
    side = lambda g, h: g * g / (h + F.lit(b.l2))
    gl, hl, gt, ht = (F.col(c) for c in ("gl", "hl", "gt", "ht"))
    gain = F.round(side(gl, hl) + side(gt - gl, ht - hl) - side(gt, ht), 9)
    ok = ~F.col("last") & (hl >= b.min_child_weight) & (ht - hl >= b.min_child_weight) & (gain > LEAST_GAIN)
    # ties go to the first feature and the lowest bin
    best = s.groupBy(*keys, "k", "node").agg(F.max(F.struct(F.coalesce(F.when(ok, gain), F.lit(-1.0)).alias("gain"), F.negative("f").alias("f"),
                                                            F.negative("b").alias("b"), "gl", "hl", "gt", "ht")).alias("s"))
    is_split = F.col("s.gain") > 0
    return best.select(*keys, "k", "node", F.when(is_split, F.negative("s.f")).alias("f"), F.when(is_split, F.negative("s.b")).alias("b"),
                       F.when(is_split, F.col("s.gain")).alias("gain"), "s.gl", "s.hl", F.col("s.gt").alias("g"), F.col("s.ht").alias("h"))


def _children(level: DataFrame, keys: list[str]) -> DataFrame:
    """The leaves below the last level's splits."""
    none = {c: F.lit(None).cast(t) for c, t in (("f", "int"), ("b", "int"), ("gain", "double"), ("gl", "double"), ("hl", "double"))}
    sides = F.array(F.struct((2 * F.col("node")).alias("node"), F.col("gl").alias("g"), F.col("hl").alias("h")),
                    F.struct((2 * F.col("node") + 1).alias("node"), (F.col("g") - F.col("gl")).alias("g"), (F.col("h") - F.col("hl")).alias("h")))
    return level.filter("f IS NOT NULL").select(*keys, "k", F.explode(sides).alias("s")).select(*keys, "k", "s.node", *[v.alias(c) for c, v in none.items()], "s.g", "s.h")


def train_boosted(rows: DataFrame, features: list[str], keys=("symbol", "fold_id"), row_keys=("quote_date",), b: Boosting = Boosting()) -> DataFrame:
    """Fit every model of ``rows`` (keys..., row keys..., class id ``y``, features); returns the table of nodes:
    (keys..., round, class, node, feature, threshold, gain, cover, value). Leaves have no feature."""
    keys, row_keys, spark = list(keys), list(row_keys), rows.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/boosting-{uuid.uuid4().hex}"

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    rows = put(rows.select(*keys, *row_keys, F.col("y").cast("int").alias("y"), *[F.col(c).cast("double").alias(c) for c in features]), "rows")
    edges = put(bin_edges(rows, features, keys, b), "edges")
    binned = F.array(*[_bin(F.get("edges", F.lit(i)), F.col(c)) for i, c in enumerate(features)])
    state = put(rows.join(edges, keys).select(*keys, *row_keys, "y", binned.alias("bins"), F.array(*[F.lit(0.0)] * CLASSES).alias("margin")), "state-0")
    for r in range(b.rounds):
        levels: list[DataFrame] = []
        for lv in range(b.depth):
            grown = _level(state, _splits_of(levels, keys) if levels else None, features, keys, row_keys, r, lv, b)
            levels.append(put(grown, f"nodes/round={r}/level={lv}"))
        put(_children(levels[-1], keys), f"nodes/round={r}/level={b.depth}")
        if r + 1 == b.rounds:
            break
        nodes = spark.read.schema(levels[0].schema).parquet(*[f"{root}/nodes/round={r}/level={lv}" for lv in range(b.depth + 1)])
        entry = F.struct((F.col("k") * 1000 + F.col("node")).alias("key"), (F.lit(-b.rate) * F.col("g") / (F.col("h") + b.l2)).alias("value"))
        values = nodes.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("leaf"))
        stepped = state.join(values.join(_splits_of(levels, keys), keys, "left"), keys)
        margin = F.array(*[F.get("margin", F.lit(k)) + F.element_at("leaf", F.lit(k * 1000) + _leaf(k, b.depth)) for k in range(CLASSES)])
        state = put(stepped.select(*keys, *row_keys, "y", "bins", margin.alias("margin")), f"state-{r + 1}")
        fs, p = file_system(spark, f"{root}/state-{r}")
        fs.delete(p, True)
    schema = f"{', '.join(f'`{k}` {rows.schema[k].dataType.simpleString()}' for k in keys)}, k int, node int, f int, b int, gain double, gl double, hl double, g double, h double, round int, level int"
    nodes = spark.read.schema(schema).option("basePath", f"{root}/nodes").parquet(f"{root}/nodes").join(edges, keys)
    return nodes.select(*keys, "round", F.col("k").alias("class"), "node", F.get(F.array(*[F.lit(c) for c in features]), F.col("f")).alias("feature"),
                        F.get(F.get("edges", F.col("f")), F.col("b")).alias("threshold"), "gain", F.col("h").alias("cover"),
                        (F.lit(-b.rate) * F.col("g") / (F.col("h") + b.l2)).alias("value"))


# ---------------------------------------------------------------- scoring

def _dense(trees: pd.DataFrame, features: list[str]) -> tuple[np.ndarray, ...]:
    """One fold's trees as arrays (class, round, node): feature or -1, threshold, value."""
    rounds, size = int(trees["round"].max()) + 1, int(trees["node"].max()) + 1
    at = (trees["class"].to_numpy(), trees["round"].to_numpy(), trees["node"].to_numpy())
    f, t, v = np.full((CLASSES, rounds, size), -1, np.int32), np.zeros((CLASSES, rounds, size)), np.zeros((CLASSES, rounds, size))
    f[at] = trees["feature"].map({c: i for i, c in enumerate(features)}).fillna(-1).astype(int)
    t[at] = trees["threshold"].fillna(0.0)
    v[at] = trees["value"]
    return f, t, v


def margins(x: np.ndarray, f: np.ndarray, t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(rows, classes) sums of leaf values: all rows walk a tree together."""
    out = np.zeros((len(x), CLASSES))
    rows = np.arange(len(x))
    for k in range(CLASSES):
        for r in range(f.shape[1]):
            node = np.ones(len(x), np.int64)
            while True:
                at = f[k, r][node]
                live = at >= 0
                if not live.any():
                    break
                value = x[rows, np.maximum(at, 0)]
                node = np.where(live, 2 * node + (value > t[k, r][node]), node)  # a missing value is not above
            out[:, k] += v[k, r][node]
    return out


def score(rows: DataFrame, trees: DataFrame, features: list[str], keys=("symbol", "quote_date"), out=("p_down", "p_flat", "p_up")) -> DataFrame:
    """Every row by every fold of its symbol: keys + fold_id + three probabilities."""
    keys = list(keys)
    types = {c.name: c.dataType.simpleString() for c in rows.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", fold_id int, " + ", ".join(f"{c} double" for c in out)
    cols = [*keys, "fold_id", *out]

    def walk(group: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        parts = []
        x = group[features].to_numpy(dtype=float) if len(group) else None
        for fold, trees_of in (model.groupby("fold_id") if len(group) else ()):
            z = margins(x, *_dense(trees_of, features))
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            parts.append(pd.DataFrame({**{k: group[k].to_numpy() for k in keys}, "fold_id": np.int32(fold), **{c: p[:, i] for i, c in enumerate(out)}})[cols])
        return pd.concat(parts) if parts else pd.DataFrame(columns=cols)

    x = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in features if c not in keys])
    m = trees.select("symbol", "fold_id", "round", "class", "node", "feature", "threshold", "value")
    return x.groupBy("symbol").cogroup(m.groupBy("symbol")).applyInPandas(walk, schema)


# ---------------------------------------------------------------- importance

def fold_importance(trees: DataFrame, features: list[str]) -> DataFrame:
    """(symbol, fold_id, feature, importance): mean gain of a feature's splits, as a share of the fold's sum; 0 for unused features."""
    used = trees.filter("feature IS NOT NULL").groupBy("symbol", "fold_id", "feature").agg(F.avg("gain").alias("gain"))
    every = trees.select("symbol", "fold_id").distinct().withColumn("feature", F.explode(F.array(*[F.lit(c) for c in features])))
    g = every.join(used, ["symbol", "fold_id", "feature"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    total = F.sum("gain").over(Window.partitionBy("symbol", "fold_id"))  # one row a feature
    return g.select("symbol", "fold_id", "feature", F.when(total > 0, F.col("gain") / total).otherwise(0.0).alias("importance"))


def importance(trees: DataFrame, features: list[str]) -> DataFrame:
    """Mean and population standard deviation over a symbol's folds."""
    return fold_importance(trees, features).groupBy("symbol", "feature").agg(
        F.avg("importance").alias("mean_importance"), F.stddev_pop("importance").alias("std_importance"))
