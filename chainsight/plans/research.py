"""Research run: features -> labels -> ML table -> walk-forward ensemble -> signals -> backtest.

A plain driver function composing the operators; every step is a lazy
DataFrame plan except the model fits (one Spark job per fold) and the
small statistics that decide the feature projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import backtest, evaluate, labels, model, signals, walkforward as wf
from ..session import cut_lineage


@dataclass
class ResearchOutputs:
    results: DataFrame          # per test row: fold and ensemble predictions, signal, position
    daily: DataFrame            # B1: strategy / benchmark returns and equity curves
    performance: DataFrame      # A21
    filter_impact: DataFrame    # B4
    thresholds: DataFrame       # B5
    monthly: DataFrame          # A15
    fold_metrics: DataFrame     # A7
    sweep: DataFrame            # A10
    walkforward: model.WalkForwardResult
    sub_periods: DataFrame | None = None   # B6, when periods are given


def research_run(feature_table: DataFrame, price_col: str = "und_price", classifier: str = "softmax",
                 periods: list | None = None, parallelism: int = 4) -> ResearchOutputs:
    """Section 3.1 of the survey as one call, for every symbol of ``feature_table`` at once."""
    lab = labels.path_labels(feature_table, price_col=price_col)
    ml, cols = wf.ml_table(lab)
    wfr = model.train_walkforward(ml, cols, classifier=classifier, parallelism=parallelism)
    # scored table reused by every report below: cut the lineage once
    res = cut_lineage(signals.add_signal_columns(wfr.results))
    daily = backtest.daily_pnl(res)
    out = ResearchOutputs(
        results=res,
        daily=daily,
        performance=backtest.performance(daily),
        filter_impact=backtest.filter_impact(res, daily),
        thresholds=backtest.threshold_sensitivity(res),
        monthly=backtest.monthly_returns(daily),
        fold_metrics=evaluate.fold_metrics(res, by=["symbol"]),
        sweep=evaluate.threshold_sweep(res, by=["symbol"]),
        walkforward=wfr,
    )
    if periods:
        out.sub_periods = backtest.sub_periods(daily, periods)
    return out
