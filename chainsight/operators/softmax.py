"""Grouped multinomial logistic regression: all (symbol, fold) models in ONE Spark job.

Training is ``groupBy(symbol, fold_id).applyInPandas``: Spark shuffles each
fold's (already standardised) training rows to one task, where a small
numpy Newton solver fits a 3-class softmax regression with an L2 penalty.
A group is one fold's training window of one symbol (bounded by the
calendar, e.g. 36 months of trading days), so no group grows with the data
volume. The result is a coefficient TABLE (symbol, fold_id, coef array),
and scoring is plain column arithmetic (dot products and a softmax) over
a join with that table, inside whole-stage codegen; no per-fold transform
loop, no model objects on the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

N_CLASSES = 3


def fit_softmax(x: np.ndarray, y: np.ndarray, l2: float = 0.01, max_iter: int = 50,
                tol: float = 1e-8) -> tuple[np.ndarray, int]:
    """Newton's method for an L2-penalised softmax regression.

    x: (n, d) standardised features, y: (n,) class ids 0..2. Returns the
    (3, d + 1) weight matrix (column 0 = intercept, penalised 1e-6 only to
    fix the softmax's redundant direction) and the iteration count.
    """
    n, d = x.shape
    xb = np.hstack([np.ones((n, 1)), np.nan_to_num(x)])
    k = N_CLASSES
    yy = np.zeros((n, k))
    yy[np.arange(n), y.astype(int)] = 1.0
    pen = np.full(d + 1, l2)
    pen[0] = 1e-6
    w = np.zeros((k, d + 1))
    it = 0
    for it in range(1, max_iter + 1):
        z = xb @ w.T
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        grad = ((p - yy).T @ xb) / n + w * pen
        hess = np.zeros((k * (d + 1), k * (d + 1)))
        for a in range(k):
            for b in range(k):
                c = p[:, a] * ((1.0 if a == b else 0.0) - p[:, b])
                blk = (xb * c[:, None]).T @ xb / n
                if a == b:
                    blk += np.diag(pen)
                hess[a * (d + 1):(a + 1) * (d + 1), b * (d + 1):(b + 1) * (d + 1)] = blk
        step = np.linalg.solve(hess, grad.reshape(-1))
        w -= step.reshape(k, d + 1)
        if np.abs(step).max() < tol:
            break
    return w, it


def train_grouped(train_rows: DataFrame, features: list[str], keys=("symbol", "fold_id"),
                  l2: float = 0.01, max_iter: int = 50) -> DataFrame:
    """Fit one softmax regression per (symbol, fold) group; returns (keys..., n_train, n_iter, coef).

    ``train_rows`` carries standardised columns ``z_<feature>`` and the class id ``y``; a missing
    standardised value counts as 0, the feature's mean. ``converged`` tells whether Newton's
    steps fell below the tolerance before the last allowed one.
    ``coef`` is the flattened (3, d + 1) matrix, class-major, intercept first.
    """
    zcols = [f"z_{c}" for c in features]
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in train_rows.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n_train bigint, n_iter int, converged boolean, coef array<double>"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        w, it = fit_softmax(pdf[zcols].to_numpy(dtype=float), pdf["y"].to_numpy(), l2, max_iter)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n_train": [len(pdf)],
                             "n_iter": [it], "converged": [it < max_iter], "coef": [w.reshape(-1).tolist()]})

    return train_rows.select(*keys, "y", *zcols).groupBy(*keys).applyInPandas(fit, schema)


def score(rows: DataFrame, coefs: DataFrame, scalers: DataFrame, features: list[str],
          keys=("symbol", "quote_date"), out=("p_down", "p_flat", "p_up")) -> DataFrame:
    """J3 with linear models: every row x every fold of its symbol, standardised with that
    fold's scaler, then softmax of the three dot products. Returns keys + fold_id + probs.

    The fan-out joins rows to the coefficient table on ``symbol`` (one row
    per trained fold: bounded by the fold count per symbol).
    """
    d = len(features)
    j = (rows.select(*keys, *features).join(coefs.select("symbol", "fold_id", "coef"), "symbol", "inner")
         .join(scalers, ["symbol", "fold_id"], "inner"))
    # one SQL expression per class: hundreds of Column objects through py4j would be slow
    zs = [f"((`{c}` - `mean_{c}`) / `scale_{c}`)" for c in features]
    logits = []
    for k in range(N_CLASSES):
        base = k * (d + 1)
        terms = [f"coef[{base}]"] + [f"coef[{base + 1 + i}] * coalesce({z}, 0D)" for i, z in enumerate(zs)]
        logits.append(" + ".join(terms) + f" AS _l{k}")
    x = j.selectExpr(*[f"`{k}`" for k in keys], "fold_id", *logits)
    m = F.greatest(*[F.col(f"_l{k}") for k in range(N_CLASSES)])
    e = [F.exp(F.col(f"_l{k}") - m) for k in range(N_CLASSES)]
    tot = e[0] + e[1] + e[2]
    return x.select(*keys, "fold_id", *[(e[k] / tot).alias(out[k]) for k in range(N_CLASSES)])


def importance(coefs: DataFrame, features: list[str]) -> DataFrame:
    """Per-fold importance: mean |coefficient| over classes, normalised to sum 1 per fold."""
    d = len(features)
    names = F.array(*[F.lit(f) for f in features])
    x = coefs.select("symbol", "fold_id", F.posexplode("coef").alias("pos", "w"))
    x = x.filter(F.col("pos") % (d + 1) != 0).withColumn("fi", (F.col("pos") % (d + 1) - 1).cast("int"))
    per = x.groupBy("symbol", "fold_id", "fi").agg(F.avg(F.abs("w")).alias("imp"))
    per = per.withColumn("importance", F.col("imp") / F.sum("imp").over(Window.partitionBy("symbol", "fold_id")))
    return per.select("symbol", "fold_id", F.element_at(names, F.col("fi") + 1).alias("feature"), "importance")
