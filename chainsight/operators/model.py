"""Walk-forward model training, ensemble scoring and artifacts.

Each fold is a (symbol, fold_id) key. Its model is a ``pyspark.ml``
pipeline (assembler + classifier) fitted on that fold's training rows,
standardised with the fold's own scaler statistics (A23, population std).
Fits are Spark jobs submitted from a small driver thread pool, as
``CrossValidator(parallelism=...)`` does; the driver only holds fold ids
and fitted models, never rows.

Scoring writes member probabilities as a LONG table
(symbol, quote_date, fold_id, p_down, p_flat, p_up) and combines them with
one weighted aggregation (A24), never with one join or column per fold.

``classifier`` is "boosted" (three-class boosted trees of all folds in one job per level, the reference's model,
see ``boosting.py``), "softmax" (default: every fold in ONE grouped job, see ``softmax.py``),
or a ``pyspark.ml`` pipeline per fold: "logistic", "forest", "gbt"
(one-vs-rest GBTs, normalised). The first two give a TABLE of models, so neither plans nor the driver grow with the folds.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..session import cut_lineage
from . import boosting, signals, softmax, walkforward as wf

PROBS = ("p_down", "p_flat", "p_up")


def _classifier(kind: str, cfg=DEFAULTS, n_trees: int | None = None):
    """The optional engines; trees and boosting rounds are ``n_trees``, ``cfg.n_trees`` unless given."""
    trees = cfg.n_trees if n_trees is None else n_trees
    if kind == "logistic":
        return LogisticRegression(featuresCol="features", labelCol="y", family="multinomial",
                                  maxIter=100, regParam=0.01)
    if kind == "forest":
        return RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=trees,
                                      maxDepth=cfg.max_depth, subsamplingRate=cfg.subsample,
                                      featureSubsetStrategy=str(cfg.colsample),
                                      minInstancesPerNode=cfg.min_child_weight, seed=cfg.seed)
    if kind == "gbt":
        gbt = GBTClassifier(featuresCol="features", labelCol="y", maxDepth=cfg.max_depth,
                            stepSize=cfg.learning_rate, subsamplingRate=cfg.subsample,
                            featureSubsetStrategy=str(cfg.colsample),
                            minInstancesPerNode=cfg.min_child_weight, seed=cfg.seed, maxIter=trees)
        return OneVsRest(classifier=gbt, featuresCol="features", labelCol="y")
    raise ValueError("classifier must be 'logistic', 'forest' or 'gbt'")


def scale_rows(rows: DataFrame, stats: DataFrame, features: list[str], keys=("symbol", "fold_id")) -> DataFrame:
    """Standardise features with the fold's mean and scale (joined on the fold key)."""
    j = rows.join(stats, list(keys), "inner")
    return j.withColumns({f"z_{c}": (F.col(c) - F.col(f"mean_{c}")) / F.col(f"scale_{c}") for c in features})


def _pipeline(features: list[str], kind: str, n_trees: int | None = None) -> Pipeline:
    asm = VectorAssembler(inputCols=[f"z_{c}" for c in features], outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[asm, _classifier(kind, n_trees=n_trees)])


def _probs(scored: DataFrame, model) -> DataFrame:
    """Three class probabilities as doubles (padded with 0 when a class was absent in training)."""
    stage = model.stages[-1]
    if "OneVsRest" in type(stage).__name__:
        raw = vector_to_array("rawPrediction")
        # one-vs-rest margins -> per-class positive-class scores, normalised to sum 1
        n = F.size(raw)
        pos = F.transform(raw, lambda x: 1 / (1 + F.exp(-x)))
        arr = F.transform(pos, lambda x: x / F.aggregate(pos, F.lit(0.0), lambda a, b: a + b))
    else:
        arr = vector_to_array("probability")
        n = F.size(arr)
    return scored.withColumns({p: F.when(n > i, F.element_at(arr, i + 1)).otherwise(F.lit(0.0))
                               for i, p in enumerate(PROBS)})


class WalkForwardResult:
    """Outputs of ``train_walkforward``: results table, models, scaler stats, weights."""

    def __init__(self, results, models, scalers, weights, features, plan, members):
        self.results = results
        self.models = models          # coefficient DataFrame (softmax) or {(symbol, fold_id): PipelineModel}
        self.scalers = scalers        # DataFrame (symbol, fold_id, mean_*, scale_*)
        self.weights = weights        # DataFrame (symbol, fold_id, weight)
        self.features = features
        self.plan = plan              # DataFrame (symbol, fold_id, train/test boundaries)
        self.members = members        # DataFrame (symbol, quote_date, fold_id, p_down, p_flat, p_up)


def _is_trees(models) -> bool:
    return isinstance(models, DataFrame) and "threshold" in models.columns


def member_probabilities(rows: DataFrame, models: dict, scalers: DataFrame, features: list[str],
                         keys=("symbol", "quote_date")) -> DataFrame:
    """Every row scored by every trained fold model of its symbol (with that fold's scaler).

    ``models`` is the softmax coefficient table or the table of tree nodes (one plan for any number of folds),
    or a dict of fitted pipelines (one transform per fold, unioned).
    """
    if _is_trees(models):
        return boosting.score(rows, models, features, keys)
    if isinstance(models, DataFrame):
        return softmax.score(rows, models, scalers, features, keys)
    outs = []
    for (sym, fid), model in sorted(models.items()):
        r = rows.filter(F.col("symbol") == sym).withColumn("fold_id", F.lit(fid).cast("int"))
        z = scale_rows(r, scalers, features)
        s = _probs(model.transform(z), model)
        outs.append(s.select(*keys, "fold_id", *PROBS))
    if not outs:
        raise RuntimeError("every fold failed the size gate, so there is no model to use")
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def train_walkforward(ml: DataFrame, features: list[str], classifier: str = "softmax",
                      n_train: int | None = None, n_test: int | None = None, alpha: float | None = None,
                      parallelism: int = 4, n_trees: int | None = None, boost: boosting.Boosting | None = None) -> WalkForwardResult:
    """M2-M5: folds, per-fold scaler + classifier, test predictions, recency-weighted ensemble.

    Folds failing the size gate (A22) are skipped but keep their ids; no
    trained fold raises. The ensemble applies ALL trained folds of a symbol
    to all its result rows, as the reference does (see ``causal_ensemble``
    for the look-ahead-free variant).
    """
    idx = wf.month_index(ml)
    assigned = wf.assign_folds(idx, wf.fold_counts(idx, n_train, n_test), n_train, n_test)
    # reused by every fit and by scoring: cut the lineage into the shared checkpoint dir
    assigned = cut_lineage(assigned)
    sizes = cut_lineage(wf.fold_sizes(assigned))
    if not sizes.filter("trained").limit(1).take(1):
        raise RuntimeError("every fold failed the size gate, so there is no model to use")
    stats = wf.scaler_stats(assigned, features)
    stats = cut_lineage(stats)
    train_rows = scale_rows(assigned.filter(F.col("role") == "train").join(
        sizes.filter("trained").select("symbol", "fold_id"), ["symbol", "fold_id"], "left_semi"), stats, features)
    if classifier == "softmax":
        models = cut_lineage(softmax.train_grouped(train_rows, features))
    elif classifier == "boosted":  # splits do not depend on the scale of a feature: trees take the plain values
        b = boost or boosting.Boosting()
        models = cut_lineage(boosting.train_boosted(train_rows, features, b=replace(b, rounds=n_trees) if n_trees else b))
    else:
        pipe = _pipeline(features, classifier, n_trees)
        trained = [(r["symbol"], int(r["fold_id"])) for r in
                   sizes.filter("trained").select("symbol", "fold_id").collect()]

        def fit(key):
            sym, fid = key
            part = train_rows.filter((F.col("symbol") == sym) & (F.col("fold_id") == fid))
            return key, pipe.fit(part)

        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            models = dict(pool.map(fit, trained))

    plan = wf.fold_plan(idx, n_train, n_test)
    test = assigned.filter(F.col("role") == "test").join(
        sizes.filter("trained").select("symbol", "fold_id"), ["symbol", "fold_id"], "left_semi")
    members = member_probabilities(test.drop("fold_id", "role", "ym", "m_idx").distinct(), models, stats, features)
    members = cut_lineage(members)

    # M4: single-fold predictions = the member row of the row's own test fold
    own = members.join(test.select("symbol", "quote_date", "fold_id"), ["symbol", "quote_date", "fold_id"], "inner")
    own = own.withColumnsRenamed({"p_down": "proba_down", "p_flat": "proba_flat", "p_up": "proba_up"})
    own = signals.ensemble_class(own, "proba_down", "proba_flat", "proba_up", "pred_raw", "pred_dir")
    own = own.withColumn("model_id", F.concat(F.lit("fold_"), F.col("fold_id").cast("string")))

    weights = signals.fold_weights(sizes.filter("trained").select("symbol", "fold_id"), alpha, by=["symbol"])
    ens = signals.ensemble_average(members, weights, ["symbol", "quote_date"], weight_keys=["symbol"])
    ens = signals.ensemble_class(ens)
    base = test.drop("role", "ym", "m_idx")
    results = (base.join(own, ["symbol", "quote_date", "fold_id"], "inner")
               .join(plan, ["symbol", "fold_id"], "left")
               .join(ens, ["symbol", "quote_date"], "inner"))
    return WalkForwardResult(results, models, stats, weights, features, plan, members)


def causal_ensemble(members: DataFrame, weights: DataFrame, plan: DataFrame,
                    keys=("symbol", "quote_date"), weight_keys=("symbol",)) -> DataFrame:
    """J8 [ext]: a row uses only folds whose training window ended before the row's month;
    weights are renormalised per row (rows with no eligible fold get 1/3 each).

    Eligibility is an equi-join on the fold key plus a row-level predicate,
    so no range join is needed; ineligible members get weight 0 and still
    keep their row in the aggregation.
    """
    m = members.join(plan.select("symbol", "fold_id", "train_end"), ["symbol", "fold_id"], "inner")
    eligible = F.col("train_end") < F.trunc("quote_date", "MM")
    m = m.withColumn("_ok", eligible).drop("train_end")
    w = weights.select(*weight_keys, "fold_id", "weight")
    m = m.join(w, ["fold_id", *weight_keys], "left")
    m = m.withColumn("weight", F.when(F.col("_ok"), F.col("weight")).otherwise(F.lit(0.0))).drop("_ok")
    return signals.weighted_average(m, list(keys))


def feature_importance(res: WalkForwardResult) -> DataFrame:
    """Mean and population std of per-fold importances per feature, per symbol.

    Boosted trees: mean gain of a feature's splits, as a share; forest: ``featureImportances``; logistic: mean |coefficient| over classes,
    normalised to sum 1. The per-fold vectors are model metadata (folds x
    features numbers), turned into a long table and aggregated by Spark.
    """
    if _is_trees(res.models):
        return boosting.importance(res.models, res.features)
    if isinstance(res.models, DataFrame):
        long = softmax.importance(res.models, res.features)
        return long.groupBy("symbol", "feature").agg(F.avg("importance").alias("mean_importance"),
                                                     F.stddev_pop("importance").alias("std_importance"))
    rows = []
    for (sym, fid), model in sorted(res.models.items()):
        st = model.stages[-1]
        if hasattr(st, "featureImportances"):
            imp = list(st.featureImportances.toArray())
        elif hasattr(st, "coefficientMatrix"):
            cm = st.coefficientMatrix.toArray()
            imp = [float(abs(cm[:, j]).mean()) for j in range(cm.shape[1])]
            tot = sum(imp) or 1.0
            imp = [x / tot for x in imp]
        else:
            continue
        rows += [(sym, fid, f, float(v)) for f, v in zip(res.features, imp)]
    spark = res.results.sparkSession
    long = spark.createDataFrame(rows, "symbol string, fold_id int, feature string, importance double")
    return long.groupBy("symbol", "feature").agg(F.avg("importance").alias("mean_importance"),
                                                 F.stddev_pop("importance").alias("std_importance"))


# ---------------------------------------------------------------- artifacts (K7, K8)

def export_ensemble(res: WalkForwardResult, artifacts_dir: str, horizon: int | None = None) -> None:
    """K7: models, scaler stats, weights, fold list and date ranges as tables in a new folder; the config, written last, names
    it, so a failed export leaves the ensemble before it whole. Keys stay in tables; only fitted pipelines,
    which the driver holds anyway, are saved one by one."""
    top = artifacts_dir.rstrip("/")
    version = f"v-{uuid.uuid4().hex}"
    root = f"{top}/{version}"
    spark = res.results.sparkSession
    if isinstance(res.models, DataFrame):
        kind = "trees" if _is_trees(res.models) else "softmax"
        res.models.write.parquet(f"{root}/models")
        folds = res.models.select("symbol", "fold_id").distinct()
    else:
        kind = "pipeline"
        for (sym, fid), model in res.models.items():
            model.write().save(f"{root}/pipelines/symbol={sym}/fold={fid}")
        folds = spark.createDataFrame(sorted(res.models), "symbol string, fold_id int")
    folds.write.parquet(f"{root}/folds")
    res.scalers.write.parquet(f"{root}/scalers")
    res.weights.write.parquet(f"{root}/weights")
    wf.date_range(res.results, by=["symbol"]).write.parquet(f"{root}/date_range")
    cfg = {
        "version": version,
        "feature_cols": list(res.features),
        "model_kind": kind,
        "label_horizon_days": DEFAULTS.horizon if horizon is None else horizon,
    }
    spark.createDataFrame([(json.dumps(cfg),)], "config string").coalesce(1).write.mode("overwrite").text(
        f"{top}/config")


def load_ensemble(spark: SparkSession, artifacts_dir: str):
    """K8: (features, models, scalers, weights); a missing config, table or fold raises and names it (of many folds,
    the first 20). The fold list is checked against the tables by anti joins."""
    top = artifacts_dir.rstrip("/")
    try:
        txt = spark.read.text(f"{top}/config").first()
    except Exception as e:  # noqa: BLE001
        raise FileNotFoundError(f"Missing ensemble config in {top}") from e
    if txt is None:
        raise FileNotFoundError(f"Missing ensemble config in {top}")
    cfg = json.loads(txt[0])
    root = f"{top}/{cfg['version']}"

    def stored(name: str) -> DataFrame:
        try:
            return spark.read.parquet(f"{root}/{name}")
        except Exception as e:  # noqa: BLE001
            raise FileNotFoundError(f"no table of {name} in {root}") from e

    folds, scalers, weights = stored("folds"), stored("scalers"), stored("weights")
    in_table = cfg["model_kind"] != "pipeline"
    models = stored("models") if in_table else {}
    for have in [scalers, *([models] if in_table else [])]:
        missing = folds.join(have, ["symbol", "fold_id"], "left_anti").orderBy("symbol", "fold_id").limit(20).collect()
        if missing:
            raise FileNotFoundError(f"Missing artifacts for folds {[tuple(r) for r in missing]} in {root}")
    if in_table:
        return cfg["feature_cols"], models, scalers, weights
    missing = []
    for key in sorted((r[0], int(r[1])) for r in folds.collect()):  # pipelines are objects of the driver, one a fold
        try:
            models[key] = PipelineModel.load(f"{root}/pipelines/symbol={key[0]}/fold={key[1]}")
        except Exception:  # noqa: BLE001
            missing.append(key)
    if missing:
        raise FileNotFoundError(f"Missing artifacts for folds {missing} in {root}")
    return cfg["feature_cols"], models, scalers, weights


# ---------------------------------------------------------------- inference (M9)

def run_inference(features_df: DataFrame, feature_cols: list[str], models: dict, scalers: DataFrame,
                  weights: DataFrame, trade_date=None, latest: bool = True) -> DataFrame:
    """M9: latest feature row per symbol (every row with ``latest=False``), all fold models, zero fill, weighted ensemble,
    live gate, one signal row per symbol (date = ``trade_date`` override or the row's date)."""
    missing = [c for c in feature_cols if c not in features_df.columns]
    if missing:
        raise RuntimeError(f"the features lack columns that the ensemble was trained on: {missing}")
    from .quality import latest_rows, require_rows
    chosen = latest_rows(require_rows(features_df, "feature table")) if latest else features_df
    rows = wf.zero_fill(chosen, feature_cols)
    members = member_probabilities(rows, models, scalers, feature_cols)
    ens = signals.ensemble_average(members, weights, ["symbol", "quote_date"], weight_keys=["symbol"])
    ctx = signals.context_columns(chosen).select("symbol", "quote_date", *DEFAULTS.context_cols)
    out = signals.signal_gate(ens.join(ctx, ["symbol", "quote_date"], "inner"), mode="live")
    if trade_date is not None:
        out = out.withColumn("quote_date", F.lit(str(trade_date)).cast("date"))
    return out.select("quote_date", "symbol", "signal_dir", "proba_up_ens", "proba_flat_ens",
                      "proba_down_ens", *DEFAULTS.context_cols)
