"""Strategy and live-universe defaults as one frozen dataclass.

Every operator takes its knobs as arguments; ``DEFAULTS`` holds the values the
library uses when a caller passes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class StrategyConfig:
    # Fixed values (must equal the reference defaults for matching results):
    # label up threshold 0.015, label down threshold -0.015, label horizon 5 rows,
    # train window 36 months, test window 3 months,
    # boosted trees: 300 trees, depth 4, learning rate 0.05, subsample 0.8,
    # column sample 0.8, min child weight 5, seed 42,
    # confidence thresholds up 0.45 / down 0.45,
    # flat-class filter on, above-SMA200 filter on, vol-regime filter on,
    # ensemble recency alpha 0.7,
    # minimum history 270 rows, moneyness band 0.20 (legacy 0.5),
    # monthly expiries: 10 wanted within 18 months; legacy calendar 12 months,
    # trade-date cut-off hour 7 (orchestrator 5), price seed 1095 days,
    # sparse-feature null share 0.80, fold gate 50 train / 5 test rows,
    # threshold sweep 0.30 .. 0.75 step 0.05, annualisation 252 periods.
    up_threshold: float = 0.015
    down_threshold: float = -0.015
    horizon: int = 5
    n_train_months: int = 36
    n_test_months: int = 3
    n_trees: int = 300
    max_depth: int = 4
    learning_rate: float = 0.05
    subsample: float = 0.8
    colsample: float = 0.8
    min_child_weight: int = 5
    seed: int = 42
    conf_threshold_up: float = 0.45
    conf_threshold_down: float = 0.45
    use_flat_class_filter: bool = True
    use_above_sma200_filter: bool = True
    use_vol_regime_filter: bool = True
    alpha: float = 0.7
    min_history_rows: int = 270
    atm_range: float = 0.20
    legacy_atm_range: float = 0.5
    target_expiries: int = 10
    max_expiry_months: int = 18
    legacy_expiry_months: int = 12
    cutoff_hour: int = 7
    orchestrator_cutoff_hour: int = 5
    price_seed_days: int = 1095
    max_null_share: float = 0.80
    min_train_rows: int = 50
    min_test_rows: int = 5
    periods_per_year: int = 252
    feature_cols_base: tuple = field(default=(
        "pc_ratio_front", "pc_ratio_back",
        "call_wall_dist_pct", "put_wall_dist_pct", "wall_spread_pct",
        "net_gex", "net_gex_back", "gex_flip",
        "max_pain_dist_pct", "atm_iv", "iv_skew", "oi_concentration",
        "dte_front",
        "sma_200", "above_sma200", "ret_20d", "ret_60d",
        "vol_20d", "daily_ret", "vol_5d", "vol_regime",
    ))
    context_cols: tuple = field(default=(
        "above_sma200", "vol_regime", "sma_200",
        "ret_20d", "ret_60d", "vol_20d", "vol_5d", "daily_ret",
    ))


DEFAULTS = StrategyConfig()


def sweep_thresholds() -> list[float]:
    """Ten sweep thresholds 0.30 .. 0.75 as (6 + i) * 0.05 rounded to 2 dp."""
    return [round((6 + i) * 0.05, 2) for i in range(10)]
