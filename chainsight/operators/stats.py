"""Feature statistics: correlations, mutual information, histograms.

Every statistic is computed from partial aggregates (sums, counts,
min/max) grouped by small keys, so no feature column is ever gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import in_order, ranks, running_total


def _long(df: DataFrame, features: list[str], extra: list[str] | None = None) -> DataFrame:
    ids = list(extra or [])
    x = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in features])
    return x.unpivot(ids, features, "feature", "value") if ids else \
        x.withColumn("_id", F.lit(0)).unpivot(["_id"], features, "feature", "value").drop("_id")


def corr_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson r for every pair i < j, pairwise complete (a row with a NULL in either
    column is skipped for that pair), returned long (feature_a, feature_b, r).

    Each task sums its rows' products as matrices and emits one row per pair, whatever the number of rows; these
    few rows are summed by pair. Sums are taken about the features' means (one small
    aggregate before) for precision. r is NULL for a constant column.
    """
    shift = list(df.select([F.coalesce(F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))), F.lit(0.0)).alias(c) for c in features]).first())
    names = list(features)
    cols = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def sums(batches):
        import numpy as np
        import pyarrow as pa
        d = len(names)
        total = np.zeros((6, d, d))
        for batch in batches:
            here = np.stack([batch.column(i).is_valid().to_numpy(zero_copy_only=False) for i in range(d)], axis=1).astype(float)
            x = np.stack([batch.column(i).fill_null(m).to_numpy(zero_copy_only=False) for i, m in enumerate(shift)], axis=1) - np.array(shift)
            # a NULL became the shift, so its difference is 0 and adds nothing but in the counts of ``here``
            x2 = x * x
            total += np.stack([here.T @ here, x.T @ here, here.T @ x, x2.T @ here, here.T @ x2, x.T @ x])
        i, j = np.triu_indices(d, 1)
        yield pa.RecordBatch.from_arrays([pa.array([names[a] for a in i], pa.string()), pa.array([names[b] for b in j], pa.string()),
                                          *[pa.array(t[i, j]) for t in total]], names=["feature_a", "feature_b", *cols])

    src = df.select([F.col(c).cast("double").alias(c) for c in features])
    part = src.mapInArrow(sums, "feature_a string, feature_b string, " + ", ".join(f"{c} double" for c in cols))
    g = part.groupBy("feature_a", "feature_b").agg(*[F.sum(c).alias(c) for c in cols])
    means = F.create_map(*[F.lit(x) for c, m in zip(names, shift) for x in (c, float(m))])

    def var(s, ss, feature):  # a spread below the rounding of the values is none
        v = F.try_divide(F.col(ss), F.col("n")) - F.pow(F.try_divide(F.col(s), F.col("n")), 2)
        return F.when(v > 1e-24 * F.pow(means[F.col(feature)], 2), v)

    cov = F.try_divide(F.col("sxy"), F.col("n")) - F.try_divide(F.col("sx"), F.col("n")) * F.try_divide(F.col("sy"), F.col("n"))
    r = F.try_divide(cov, F.sqrt(var("sx", "sxx", "feature_a") * var("sy", "syy", "feature_b")))
    return g.select("feature_a", "feature_b", F.when(~F.isnan(r), r).alias("r"))


def correlated_pairs(corr: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs with abs(r) >= threshold (upper triangle); sort by abs(r) desc at the sink."""
    return corr.filter(F.abs(F.col("r")) >= threshold).withColumn("abs_r", F.abs("r"))


def _ranges(long: DataFrame) -> DataFrame:
    # one row per feature: bounded by the feature count, safe to broadcast
    return F.broadcast(long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi")))


def _width_bin(n_bins: int):
    span = F.col("hi") - F.col("lo")
    return F.when(span == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) / span * n_bins), F.lit(n_bins - 1))).cast("int")


def histogram(df: DataFrame, features: list[str], n_bins: int = 50) -> DataFrame:
    """Equal-width bins per feature over [min, max] (NULLs dropped; the max falls in the
    last bin; a constant column is one bin). Returns (feature, bin, bin_lo, bin_hi, n)."""
    long = _long(df, features).filter(F.col("value").isNotNull())
    b = long.join(_ranges(long), "feature").withColumn("bin", _width_bin(n_bins))
    g = b.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"),
                                        F.first("hi").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / n_bins
    return g.select("feature", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"), "n")


def mutual_information(df: DataFrame, features: list[str], label: str = "label", n_bins: int = 20,
                       binning: str = "width") -> DataFrame:
    """Binned mutual information of each feature with the label (nats).

    Rows with a NULL in any feature or the label are dropped first (as the
    reference does). ``binning="width"``: equal-width bins between the
    feature's min and max (exact, default); ``"quantile"``: edges from
    ``percentile_approx`` at k/n_bins (bounded-memory sketch, approximate).
    MI = sum p(b,l) ln(p(b,l) / (p(b) p(l))). The reference uses a kNN
    estimator, so values differ from its published numbers.
    """
    clean = df.dropna(subset=list(features) + [label])
    long = _long(clean, features, [label])
    if binning == "width":
        b = long.join(_ranges(long), "feature").withColumn("bin", _width_bin(n_bins))
    elif binning == "quantile":
        qs = [k / n_bins for k in range(1, n_bins)]
        edges = F.broadcast(long.groupBy("feature").agg(F.percentile_approx("value", qs, 10000).alias("edges")))
        b = long.join(edges, "feature").withColumn(
            "bin", F.size(F.filter("edges", lambda e: F.col("value") > e)).cast("int"))
    else:
        raise ValueError("binning must be 'width' or 'quantile'")
    joint = b.groupBy("feature", "bin", label).agg(F.count(F.lit(1)).alias("n"))
    # windows below run over at most n_bins x n_labels rows per feature
    wf = Window.partitionBy("feature")
    joint = joint.withColumns({
        "_n": F.sum("n").over(wf),
        "_nb": F.sum("n").over(Window.partitionBy("feature", "bin")),
        "_nl": F.sum("n").over(Window.partitionBy("feature", label)),
    })
    term = (F.col("n") / F.col("_n")) * F.log((F.col("n") * F.col("_n")) / (F.col("_nb") * F.col("_nl")))
    return joint.groupBy("feature").agg(F.sum(term).alias("mi_score"))


def digamma(n: Column) -> Column:
    """psi(n) of a positive integer, to 5e-12: six steps up, then the asymptotic series."""
    x = n.cast("double")
    steps = sum((1 / (x + i) for i in range(1, 6)), 1 / x)
    y = x + 6
    z = 1 / (y * y)
    return F.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - steps


def mutual_information_knn(df: DataFrame, features: list[str], label: str = "label", neighbours: int = 3,
                           decimals: int | dict[str, int] = 6) -> DataFrame:
    """Nearest-neighbour mutual information of each feature with a discrete label (nats), (feature, mi_score).

    For a row with N_c rows of its class: r is the distance to its k-th nearest value inside the class
    (k = ``neighbours``, or N_c - 1 if fewer), m the number of rows of all classes closer than r (at r = 0: equal ones), itself
    included. MI = psi(N) + mean psi(k) - mean psi(N_c) - mean psi(m), 0 at least. Rows with a missing value
    and classes of one row are left out. Values are first rounded to ``decimals`` and compared as whole numbers, which makes distances
    exact; no noise is added to ties.

    Equal values of a class are one row with a count. Their ranks inside (feature, class) are two-level, neighbours meet by
    rank in one shuffle, and m is a difference of two running counts over the sorted values and interval ends: no pairs, and no
    task that holds a feature or a class.
    """
    k_of = lambda c: decimals.get(c, 6) if isinstance(decimals, dict) else decimals
    clean = df.select(F.col(label).alias("_y"), *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in features]).dropna()
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"), F.lit(float(10 ** k_of(c))).alias("scale")) for c in features])
    one = clean.select("_y", F.explode(pairs).alias("p")).select("p.feature", "_y", F.round(F.col("p.value") * F.col("p.scale"), 0).cast("long").alias("v"))
    counted = cut_lineage(one.groupBy("feature", "_y", "v").agg(F.count(F.lit(1)).alias("n")))
    sizes = counted.filter(F.col("feature") == features[0]).groupBy("_y").agg(F.sum("n").alias("n_y")).filter("n_y > 1")
    long = counted.join(sizes, "_y").select("feature", "_y", "v", "n", "n_y")
    ranked = cut_lineage(ranks(in_order(long, ["feature", "_y", "v"]), ["feature", "_y"], "i").select("feature", "_y", "v", "n", "n_y", "i"))
    # each value goes to the places of its next ``neighbours`` values on both sides
    near = ranked.select("feature", "_y", "v", "n", "n_y", F.explode(F.sequence(F.col("i") - neighbours, F.col("i") + neighbours)).alias("to"), "i")
    own = F.col("to") == F.col("i")
    met = near.groupBy("feature", "_y", "to").agg(F.max(F.when(own, F.struct("v", "n", "n_y"))).alias("own"),
                                                  F.collect_list(F.when(~own, F.struct("v", "n"))).alias("others")).filter("own IS NOT NULL")
    k = F.least(F.lit(neighbours), F.col("own.n_y") - 1)
    by_distance = F.array_sort(F.transform("others", lambda o: F.struct(F.abs(o["v"] - F.col("own.v")).alias("d"), o["n"].alias("n"))))
    # the first distance at which the class has k others
    reach = F.aggregate(by_distance, F.struct(F.col("own.n") - 1, F.lit(0).cast("long").alias("r")),
                        lambda a, o: F.struct((a["col1"] + o["n"]).alias("col1"), F.when(a["col1"] >= k, a["r"]).otherwise(o["d"]).alias("r")))["r"]
    points = met.select("feature", F.col("own.v").alias("v"), F.col("own.n").alias("n"), F.col("own.n_y").alias("n_y"), k.alias("k"), reach.alias("r"))
    points = cut_lineage(points.withColumns({"id": F.monotonically_increasing_id(), "half": F.greatest(F.col("r") - 1, F.lit(0))}))
    values = points.groupBy("feature", "v").agg(F.sum("n").alias("n")).select("feature", F.col("v").alias("x"), F.lit(0).alias("kind"), "n", F.lit(None).cast("long").alias("id"))
    ends = points.select("feature", F.explode(F.array(F.struct((F.col("v") + F.col("half")).alias("x"), F.lit(1).alias("kind")),
                                                      F.struct((F.col("v") - F.col("half") - 1).alias("x"), F.lit(2).alias("kind")))).alias("e"), F.lit(0).cast("long").alias("n"), "id")
    mixed = values.unionByName(ends.select("feature", "e.x", "e.kind", "n", "id"))
    upto = running_total(in_order(mixed, ["feature", "x", "kind"]), ["feature"], "n", "upto").filter("kind > 0")
    inside = upto.groupBy("feature", "id").agg(F.sum(F.when(F.col("kind") == 1, F.col("upto")).otherwise(-F.col("upto"))).alias("m"))
    whole = points.join(inside, ["feature", "id"])
    total = F.sum("n")
    mean = lambda c: F.sum(F.col("n") * digamma(F.col(c))) / total
    return whole.groupBy("feature").agg(F.greatest(F.lit(0.0), digamma(total) + mean("k") - mean("n_y") - mean("m")).alias("mi_score"))
