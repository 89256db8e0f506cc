"""Classification evaluation over predictions tables.

Classes are the fixed directions -1/0/1; every metric is a set of
``count_if`` aggregates in one pass per grouping, no per-class loops over
the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import sweep_thresholds

# Direction labels and their report names.
CLASSES = (-1, 0, 1)
CLASS_NAMES = {-1: "Down", 0: "Flat", 1: "Up"}


def _macro_f1(y: Column, p: Column) -> Column:
    """Macro F1 over classes present in truth or prediction (zero division -> 0)."""
    f1s, present = [], []
    for c in CLASSES:
        tp = F.count_if((y == c) & (p == c))
        fp = F.count_if((y != c) & (p == c))
        fn = F.count_if((y == c) & (p != c))
        den = 2 * tp + fp + fn
        f1s.append(F.when(den > 0, 2.0 * tp / den).otherwise(0.0))
        present.append(F.when(den > 0, 1).otherwise(0))
    return F.try_divide(reduce(lambda a, b: a + b, f1s), reduce(lambda a, b: a + b, present).cast("double"))


def fold_metrics(res: DataFrame, by: list[str] | None = None, label: str = "label",
                 pred: str = "pred_dir", pred_ens: str = "pred_dir_ens") -> DataFrame:
    """Per fold rows, train/test boundaries, accuracy and macro F1 of single-fold and ensemble."""
    keys = list(by or []) + ["fold_id"]
    y, p, pe = F.col(label), F.col(pred), F.col(pred_ens)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in ("train_start", "test_start", "test_end"):
        if c in res.columns:
            aggs.append(F.min(c).alias(c))
    aggs += [F.avg((y == p).cast("double")).alias("accuracy"), _macro_f1(y, p).alias("macro_f1"),
             F.avg((y == pe).cast("double")).alias("acc_ens"), _macro_f1(y, pe).alias("f1_ens")]
    return res.groupBy(*keys).agg(*aggs)


def mean_fold_accuracy(fm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of per-fold accuracies, single fold and ensemble."""
    return fm.groupBy(*(by or [])).agg(F.avg("accuracy").alias("mean_accuracy"),
                                       F.avg("acc_ens").alias("mean_acc_ens"))


def confusion_matrix(res: DataFrame, scope_col: str | None = None, label: str = "label",
                     pred: str = "pred_dir_ens") -> DataFrame:
    """rows = truth (-1, 0, 1 always present), columns = prediction counts (0 when absent)."""
    keys = [scope_col] if scope_col else []
    counts = res.groupBy(*keys, F.col(label).alias("label")).pivot(pred, list(CLASSES)).count()
    counts = counts.withColumnsRenamed({str(c): f"pred_{CLASS_NAMES[c].lower()}" for c in CLASSES})
    dims = res.select(*keys).distinct() if keys else res.sparkSession.range(1).select()
    dims = dims.withColumn("label", F.explode(F.array(*[F.lit(c) for c in CLASSES])))
    out = dims.join(counts, keys + ["label"], "left")
    return out.fillna(0, subset=[f"pred_{CLASS_NAMES[c].lower()}" for c in CLASSES])


def classification_report(res: DataFrame, label: str = "label", pred: str = "pred_dir_ens",
                          by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1, support per class, then accuracy, macro avg and weighted avg rows."""
    keys = list(by or [])
    y, p = F.col(label), F.col(pred)
    aggs = [F.count(F.lit(1)).alias("_n"), F.count_if(y == p).alias("_hit")]
    for c in CLASSES:
        aggs += [F.count_if((y == c) & (p == c)).alias(f"tp{c + 1}"), F.count_if((y != c) & (p == c)).alias(f"fp{c + 1}"),
                 F.count_if((y == c) & (p != c)).alias(f"fn{c + 1}")]
    s = res.groupBy(*keys).agg(*aggs)
    rows = []
    for c in CLASSES:
        i = c + 1
        tp, fp, fn = F.col(f"tp{i}"), F.col(f"fp{i}"), F.col(f"fn{i}")
        prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
        rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
        f1 = F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(0.0)
        rows.append(F.struct(F.lit(CLASS_NAMES[c]).alias("class"), prec.alias("precision"), rec.alias("recall"),
                             f1.alias("f1"), (tp + fn).alias("support")))
    per = s.select(*keys, "_n", "_hit", F.array(*rows).alias("_rows"))
    cls = per.select(*keys, "_n", "_hit", F.explode("_rows").alias("r")).select(*keys, "_n", "_hit", "r.*")
    avg = cls.groupBy(*keys).agg(
        F.first("_n").alias("_n"), F.first("_hit").alias("_hit"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    acc = avg.select(*keys, F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("_hit") / F.col("_n")).alias("f1"),
                     F.col("_n").alias("support"))
    macro = avg.select(*keys, F.lit("macro avg").alias("class"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("_n").alias("support"))
    weighted = avg.select(*keys, F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("_n").alias("support"))
    return cls.drop("_n", "_hit").unionByName(acc).unionByName(macro).unionByName(weighted)


def threshold_sweep(res: DataFrame, thresholds: list[float] | None = None, label: str = "label",
                    up: str = "proba_up_ens", down: str = "proba_down_ens",
                    by: list[str] | None = None) -> DataFrame:
    """A10: per threshold, up/down precision (NULL when nothing is selected) and coverage.

    Threshold fan-out is an explode of the bounded threshold list; one groupBy.
    """
    keys = list(by or [])
    thr = thresholds or sweep_thresholds()
    t = res.select(*keys, label, up, down).withColumn(
        "threshold", F.explode(F.array(*[F.lit(float(x)) for x in thr])))
    su, sd = F.col(up) >= F.col("threshold"), F.col(down) >= F.col("threshold")
    return t.groupBy(*keys, "threshold").agg(
        F.avg(F.when(su, (F.col(label) == 1).cast("double"))).alias("up_precision"),
        F.avg(F.when(sd, (F.col(label) == -1).cast("double"))).alias("down_precision"),
        F.avg(su.cast("double")).alias("up_coverage"),
        F.avg(sd.cast("double")).alias("down_coverage"))
