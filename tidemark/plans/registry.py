"""The default registries: features and signals for the metrics at hand, built by rule."""

from __future__ import annotations

from tidemark.operators.features import Feature
from tidemark.operators.signals import Condition, Registry, Signal

GROWN = ("revenue", "net_income", "operating_cash_flow")
AXIS = "fundamentals_based"
MARKET = "market_price"


def default_features() -> list[Feature]:
    found = []
    for m in GROWN:
        found += [
            Feature("growth", AXIS, m, "latestGrowth", "direct", source="yoy"),
            Feature("growth", AXIS, m, "durableGrowth", "positive_ratio", source="yoy"),
            Feature("growth", AXIS, m, "yoyGrowthAcceleration", "direct", source="yoy_delta"),
            Feature("growth", AXIS, m, "turnaroundMomentum", "turnaround_momentum"),
            Feature("stretch", AXIS, m, "trendStretch", "relative_deviation"),
            Feature("stretch", AXIS, m, "annualStretch", "lag_ratio_deviation", lag=4),
            Feature("stretch", AXIS, m, "quarterRatio", "ratio_deviation"),
            Feature("quality", AXIS, m, "observedShare", "valid_ratio", source="ttm_val"),
            Feature("quality", AXIS, m, "decline", "negative_ratio", source="qoq"),
        ]
    return found + [
        Feature("profitability", AXIS, "net_income", "netMargin", "ratio_to_denominator", source="ttm_val", denominator="revenue", denominator_source="ttm_val"),
        Feature("profitability", AXIS, "operating_cash_flow", "freeCashToAssets", "spread_to_denominator", source="ttm_val", counterpart="capex_cash", counterpart_source="ttm_val", denominator="assets"),
        Feature("investment", AXIS, "capex_cash", "capexRelief", "negative_direct", source="yoy"),
        Feature("investment", AXIS, "capex_cash", "capexTrendRelief", "negative_relative_deviation"),
        Feature("macro", AXIS, "revenue", "rateSensitivity", "macro_sensitivity_beta", source="yoy", macro_series="rate", macro_scale=0.01),
    ]


def default_signals(with_market: bool = False) -> Registry:
    def trio(factor: str, key: str, high: float, low: float, names: tuple[str, str], extra: tuple[Condition, ...] = (), support: tuple[str, ...] = ()) -> list[Signal]:
        shown = (key, *support)
        return [
            Signal(factor, AXIS, names[0], 10, all=(Condition(key, ">=", high), *extra), supporting=shown, full_metrics=3),
            Signal(factor, AXIS, names[1], 20, any=(Condition(key, "<=", low),), supporting=shown, contradicting=support, full_metrics=3),
            Signal(factor, AXIS, f"mixed_{factor}", 90, default=True, supporting=shown, full_metrics=3),
        ]

    market = [
        Signal("momentum", MARKET, "rising_price", 10, all=(Condition("yearReturn", ">=", 0.01),), supporting=("yearReturn", "quarterReturn")),
        Signal("momentum", MARKET, "falling_price", 20, any=(Condition("yearReturn", "<=", -0.01),), supporting=("yearReturn", "quarterReturn")),
        Signal("momentum", MARKET, "mixed_momentum", 90, default=True, supporting=("yearReturn",)),
    ] if with_market else []
    return Registry([
        *market,
        *trio("growth", "latestGrowth", 0.05, -0.05, ("strong_growth", "weak_growth"), (Condition("durableGrowth", ">=", 0.4, 2),), ("durableGrowth", "yoyGrowthAcceleration")),
        *trio("stretch", "trendStretch", 0.05, -0.05, ("stretched", "compressed"), support=("annualStretch",)),
        *trio("profitability", "netMargin", 0.05, -0.05, ("high_margin", "low_margin"), support=("freeCashToAssets",)),
        *trio("investment", "capexRelief", 0.1, -0.1, ("investing_less", "investing_more"), support=("capexTrendRelief",)),
        *trio("quality", "decline", 0.6, 0.4, ("declining", "rising"), support=("observedShare",)),
    ])


QUESTIONS = [(f, AXIS) for f in ("growth", "investment", "profitability", "quality", "stretch")]


def graded_signals() -> Registry:
    """114 rules by rule: for each of six features a state for every tenth from 0.9 down to -0.9, highest first."""
    graded = (("growth", "latestGrowth"), ("growth", "durableGrowth"), ("stretch", "trendStretch"), ("quality", "observedShare"), ("profitability", "netMargin"), ("investment", "capexRelief"))
    return Registry([
        Signal(f, AXIS, f"{k}_{g:+d}", 100 * i + 9 - g, all=(Condition(k, ">=", g / 10),), supporting=(k,), full_metrics=3)
        for i, (f, k) in enumerate(graded) for g in range(9, -10, -1)
    ])
