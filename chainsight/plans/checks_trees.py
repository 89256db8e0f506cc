"""Registered queries of the boosted trees (M3-M5, J3, A25) and of the stored ensemble (K7, K8).

The oracle restates the boosting in SQL, unrolled over rounds and levels: bins, gradients, gains, splits, leaf values,
margins. Features are rounded first on both sides, so that bins cut equal values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting
from .checks import _ALLF, _ML_SQL, _ROUND_ML, _ml, _r, _scratch, register
from .output import round_doubles

#: two rounds of depth two keep the unrolled SQL short; the operator's defaults are those of the configuration
SMALL = boosting.Boosting(rounds=2, depth=2, bins=16, rate=0.3)


def _lists(rnd: int) -> str:
    return " ".join(f"WHEN {k} THEN {boosting.sampled_columns(_ALLF, rnd, k, SMALL)}" for k in range(boosting.CLASSES))


def _boost_sql(b: boosting.Boosting = SMALL) -> str:
    """CTEs up to ``trees`` (all nodes) and ``be`` (edges)."""
    x = ", ".join(f"CAST({_r(c)} AS DOUBLE)" for c in _ALLF)
    cuts = "[" + ", ".join(str(k / b.bins) for k in range(1, b.bins)) + "]"
    key = "symbol, fold_id"
    out = [f"""sz AS (SELECT symbol, fold_id FROM asg GROUP BY 1, 2 HAVING count_if(role = 'train') >= 50 AND count_if(role = 'test') >= 5)""",
           f"""bt AS MATERIALIZED (SELECT asg.symbol, asg.fold_id, quote_date, y, [{x}] AS x FROM asg JOIN sz USING (symbol, fold_id) WHERE role = 'train')""",
           f"""be AS MATERIALIZED (SELECT {key}, [{', '.join(f'list_sort(list_distinct(quantile_disc(x[{i + 1}], {cuts})))' for i in range(len(_ALLF)))}] AS e FROM bt GROUP BY 1, 2)""",
           f"""s0 AS MATERIALIZED (SELECT {key}, quote_date, y, list_transform(range(1, {len(_ALLF)} + 1), lambda i: len(list_filter(e[i], lambda v: v < x[i]))) AS b,
               [0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE] AS m FROM bt JOIN be USING ({key}))"""]
    for r in range(b.rounds):
        out.append(f"""p{r} AS (SELECT *, exp(m[1] - list_max(m)) AS e1, exp(m[2] - list_max(m)) AS e2, exp(m[3] - list_max(m)) AS e3,
            ('0x' || substr(md5('{b.seed}:{r}:' || symbol || ':' || fold_id || ':' || CAST(quote_date AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 < {b.subsample} AS used FROM s{r})""")
        out.append(f"""n{r}_0 AS MATERIALIZED (SELECT {key}, quote_date, b, used, k, p - CASE WHEN y = k THEN 1 ELSE 0 END AS g, greatest(2.0 * p * (1.0 - p), 1e-16) AS h, 1 AS node, true AS live
            FROM (SELECT {key}, quote_date, y, b, used, unnest([0, 1, 2]) AS k, unnest([e1, e2, e3]) / (e1 + e2 + e3) AS p FROM p{r}))""")
        for lv in range(b.depth):
            out.append(f"""h{r}_{lv} AS (SELECT {key}, k, node, f, b[f + 1] AS bb, sum(g) AS g, sum(h) AS h
                FROM (SELECT *, unnest(CASE k {_lists(r)} END) AS f FROM n{r}_{lv} WHERE live AND used) GROUP BY ALL)""")
            part = f"PARTITION BY {key}, k, node, f"
            out.append(f"""c{r}_{lv} AS (SELECT *, sum(g) OVER ({part} ORDER BY bb) AS gl, sum(h) OVER ({part} ORDER BY bb) AS hl, sum(g) OVER ({part}) AS gt, sum(h) OVER ({part}) AS ht,
                bb = max(bb) OVER ({part}) AS last FROM h{r}_{lv})""")
            out.append(f"""d{r}_{lv} AS (SELECT *, round(gl * gl / (hl + {b.l2}) + (gt - gl) * (gt - gl) / (ht - hl + {b.l2}) - gt * gt / (ht + {b.l2}), 9) AS gain0 FROM c{r}_{lv})""")
            out.append(f"""w{r}_{lv} AS (SELECT *, CASE WHEN NOT last AND hl >= {b.min_child_weight} AND ht - hl >= {b.min_child_weight} AND gain0 > {boosting.LEAST_GAIN} THEN gain0 END AS gain FROM d{r}_{lv})""")
            out.append(f"""b{r}_{lv} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key}, k, node ORDER BY gain DESC NULLS LAST, f, bb) AS i FROM w{r}_{lv}) WHERE i = 1)""")
            out.append(f"""n{r}_{lv + 1} AS MATERIALIZED (SELECT n.* REPLACE (CASE WHEN s.gain IS NULL THEN n.node ELSE 2 * n.node + CASE WHEN n.b[s.f + 1] > s.bb THEN 1 ELSE 0 END END AS node, s.gain IS NOT NULL AS live)
                FROM n{r}_{lv} n LEFT JOIN b{r}_{lv} s ON n.live AND s.symbol = n.symbol AND s.fold_id = n.fold_id AND s.k = n.k AND s.node = n.node)""")
        inner = " UNION ALL ".join(f"SELECT {key}, k, node, CASE WHEN gain IS NOT NULL THEN f END AS f, CASE WHEN gain IS NOT NULL THEN bb END AS bb, gain, gt AS g, ht AS h FROM b{r}_{lv}" for lv in range(b.depth))
        last = f"b{r}_{b.depth - 1}"
        out.append(f"""t{r} AS MATERIALIZED (SELECT {r} AS round, *, -{b.rate} * g / (h + {b.l2}) AS value FROM ({inner}
            UNION ALL SELECT {key}, k, 2 * node, NULL, NULL, NULL, gl, hl FROM {last} WHERE gain IS NOT NULL
            UNION ALL SELECT {key}, k, 2 * node + 1, NULL, NULL, NULL, gt - gl, ht - hl FROM {last} WHERE gain IS NOT NULL))""")
        out.append(f"""s{r + 1} AS MATERIALIZED (SELECT {key}, quote_date, y, s.b, [s.m[1] + v[1], s.m[2] + v[2], s.m[3] + v[3]] AS m FROM s{r} s JOIN
            (SELECT symbol, fold_id, quote_date, list(value ORDER BY k) AS v FROM n{r}_{b.depth} JOIN t{r} USING (symbol, fold_id, k, node) GROUP BY ALL) USING ({key}, quote_date))""")
    names = "[" + ", ".join(f"'{c}'" for c in _ALLF) + "]"
    every = " UNION ALL ".join(f"SELECT * FROM t{r}" for r in range(b.rounds))
    out.append(f"""trees AS MATERIALIZED (SELECT {key}, round, k AS class, node, {names}[f + 1] AS feature, e[f + 1][bb + 1] AS threshold, f, gain, h AS cover, value FROM ({every}) JOIN be USING ({key}))""")
    return _ML_SQL.rstrip() + ",\n" + ",\n".join(out)


_BOOST_SQL = _boost_sql()


def _rounded_ml(spark, sf):
    ml, cols = _ml(spark, sf)
    return round_doubles(ml, overrides=_ROUND_ML), cols


def _trained(spark, sf):
    from ..operators import model
    ml, cols = _rounded_ml(spark, sf)
    return ml, cols, model.train_walkforward(ml, cols, classifier="boosted", boost=SMALL)


@register("m3_boosted_trees", _BOOST_SQL + """
SELECT symbol, fold_id, round, class, node, feature, round(threshold, 6) AS threshold, round(gain, 6) AS gain, round(cover, 6) AS cover, round(value, 6) AS value FROM trees""")
def q_boosted_trees(spark, sf):
    """Every node of every model's trees."""
    return round_doubles(_trained(spark, sf)[2].models)


@register("m4_m5_boosted_ensemble", _BOOST_SQL + f""",
x AS MATERIALIZED (SELECT symbol, quote_date, label, [{', '.join(f'CAST({_r(c)} AS DOUBLE)' for c in _ALLF)}] AS x FROM ml),
u AS (SELECT DISTINCT x.* FROM x JOIN (SELECT a.symbol, a.quote_date FROM asg a JOIN sz USING (symbol, fold_id) WHERE role = 'test') t USING (symbol, quote_date)),
a0 AS (SELECT u.symbol, quote_date, fold_id, round, class, 1 AS node, x FROM u JOIN (SELECT DISTINCT symbol, fold_id, round, class FROM trees) USING (symbol)),
""" + ",\n".join(f"""a{lv + 1} AS (SELECT a.* REPLACE (CASE WHEN t.f IS NULL THEN a.node ELSE 2 * a.node + CASE WHEN a.x[t.f + 1] > t.threshold THEN 1 ELSE 0 END END AS node)
  FROM a{lv} a JOIN trees t USING (symbol, fold_id, round, class, node))""" for lv in range(SMALL.depth)) + f""",
mg AS (SELECT symbol, quote_date, fold_id, class, sum(value) AS m FROM a{SMALL.depth} JOIN trees USING (symbol, fold_id, round, class, node) GROUP BY ALL),
pr AS (SELECT symbol, quote_date, fold_id, class, exp(m) / sum(exp(m)) OVER (PARTITION BY symbol, quote_date, fold_id) AS p FROM mg),
mem AS (SELECT symbol, quote_date, fold_id, max(p) FILTER (WHERE class = 0) AS p_down, max(p) FILTER (WHERE class = 1) AS p_flat, max(p) FILTER (WHERE class = 2) AS p_up FROM pr GROUP BY 1, 2, 3),
rk AS (SELECT symbol, fold_id, pow(0.7, count(*) OVER (PARTITION BY symbol) - row_number() OVER (PARTITION BY symbol ORDER BY fold_id)) AS raw FROM sz),
wt AS (SELECT symbol, fold_id, raw / sum(raw) OVER (PARTITION BY symbol) AS weight FROM rk),
en AS (SELECT symbol, quote_date, sum(weight * p_down) / sum(weight) AS proba_down_ens, sum(weight * p_flat) / sum(weight) AS proba_flat_ens, sum(weight * p_up) / sum(weight) AS proba_up_ens
       FROM mem JOIN wt USING (symbol, fold_id) GROUP BY 1, 2)
SELECT symbol, quote_date, a.fold_id, round(p_down, 6) AS proba_down, round(p_flat, 6) AS proba_flat, round(p_up, 6) AS proba_up,
       round(proba_down_ens, 6) AS proba_down_ens, round(proba_flat_ens, 6) AS proba_flat_ens, round(proba_up_ens, 6) AS proba_up_ens
FROM asg a JOIN sz USING (symbol, fold_id) JOIN mem USING (symbol, quote_date, fold_id) JOIN en USING (symbol, quote_date) WHERE role = 'test'""")
def q_boosted_ensemble(spark, sf):
    """Fold predictions and the recency-weighted ensemble of the boosted trees."""
    res = _trained(spark, sf)[2]
    return round_doubles(res.results.select("symbol", "quote_date", "fold_id", "proba_down", "proba_flat", "proba_up", "proba_down_ens", "proba_flat_ens", "proba_up_ens"))


@register("a25_split_gain_importance", _BOOST_SQL + f""",
ug AS (SELECT symbol, fold_id, feature, avg(gain) AS gain FROM trees WHERE feature IS NOT NULL GROUP BY 1, 2, 3),
ev AS (SELECT symbol, fold_id, unnest([{', '.join(f"'{c}'" for c in _ALLF)}]) AS feature FROM (SELECT DISTINCT symbol, fold_id FROM trees)),
ig AS (SELECT symbol, fold_id, feature, coalesce(gain, 0) AS gain, sum(coalesce(gain, 0)) OVER (PARTITION BY symbol, fold_id) AS total FROM ev LEFT JOIN ug USING (symbol, fold_id, feature))
SELECT symbol, feature, round(avg(CASE WHEN total > 0 THEN gain / total ELSE 0 END), 6) AS mean_importance,
       round(stddev_pop(CASE WHEN total > 0 THEN gain / total ELSE 0 END), 6) AS std_importance FROM ig GROUP BY 1, 2""")
def q_split_gain(spark, sf):
    from ..operators import model
    return round_doubles(model.feature_importance(_trained(spark, sf)[2]))


@register("k7_k8_stored_ensemble", _ML_SQL + f""",
sz AS (SELECT symbol, fold_id FROM asg GROUP BY 1, 2 HAVING count_if(role = 'train') >= 50 AND count_if(role = 'test') >= 5),
sc AS (SELECT symbol, fold_id, round(avg(ret_20d), 6) AS mean_ret_20d, round(CASE WHEN stddev_pop(ret_20d) = 0 THEN 1.0 ELSE stddev_pop(ret_20d) END, 6) AS scale_ret_20d FROM asg WHERE role = 'train' GROUP BY 1, 2),
rk AS (SELECT symbol, fold_id, pow(0.7, count(*) OVER (PARTITION BY symbol) - row_number() OVER (PARTITION BY symbol ORDER BY fold_id)) AS raw FROM sz)
SELECT symbol, fold_id, round(raw / sum(raw) OVER (PARTITION BY symbol), 6) AS weight, mean_ret_20d, scale_ret_20d, true AS has_model FROM rk JOIN sc USING (symbol, fold_id)""")
def q_stored_ensemble(spark, sf):
    """K7 then K8: weights, scaler and presence of a model of each fold, read back from the stored ensemble."""
    from ..operators import model
    ml, cols = _ml(spark, sf)
    root = _scratch(spark, "stored-ens")
    model.export_ensemble(model.train_walkforward(ml, cols), root)
    _, models, scalers, weights = model.load_ensemble(spark, root)
    have = models.select("symbol", "fold_id").distinct().withColumn("has_model", F.lit(True))
    out = weights.join(scalers, ["symbol", "fold_id"]).join(have, ["symbol", "fold_id"], "left")
    return round_doubles(out.select("symbol", "fold_id", "weight", "mean_ret_20d", "scale_ret_20d", "has_model"))
