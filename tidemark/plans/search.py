"""Parameter search: trials over a space, tuning of pattern rates, and bringing results into a configuration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import deep_get, deep_set, sample

BASE = "features.price_action_params"


def search(spark: SparkSession, run: Callable[[dict], DataFrame], objective: Callable[[DataFrame], DataFrame], space: dict, trials: int, seed: int = 0, rules: dict[str, str] | None = None) -> tuple[dict, DataFrame]:
    """Draw parameters `trials` times, run each and keep the best: (parameters, all trials with their value).

    run(parameters) gives a frame, objective(frame) one row with a column value; a null value is the
    worst. The trials are one union, so Spark runs them side by side and the driver gets a row a trial.
    """
    drawn = [sample(space, seed + i, rules) for i in range(trials)]
    parts = [objective(run(p)).select(F.lit(i).alias("trial"), F.col("value").cast("double").alias("value")) for i, p in enumerate(drawn)]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    values = {r["trial"]: r["value"] for r in all_.collect()}
    best = max(values, key=lambda i: (values[i] is not None, values[i] or 0.0, -i))
    rows = [(i, str(sorted(p.items())), values.get(i)) for i, p in enumerate(drawn)]
    return drawn[best], spark.createDataFrame(rows, "trial int, parameters string, value double")


#: The parameter that a pattern's rate follows, and its direction when the rate is too high.
TUNED = {"soldiers": ("min_body_atr", 1), "crows": ("min_body_atr", 1), "tweezer": ("tol_k", -1), "inside": ("min_range_k_atr", 1), "outside": ("min_range_k_atr", 1), "hammer": ("wick_ratio", 1), "shoot": ("wick_ratio", 1), "pin": ("ratio", 1), "morning": ("small_body_atr", -1), "evening": ("small_body_atr", -1), "belt": ("wick_frac", -1), "marubozu": ("wick_frac", -1)}


def rate_shifts(rates: DataFrame, low: float, high: float, step: float) -> DataFrame:
    """(flag, rate, parameter, shift) of rates(flag, rate): what to change where a rate lies outside [low, high]."""
    name, sign = F.lit(None).cast("string"), F.lit(None).cast("int")
    for key, (p, s) in TUNED.items():
        own = F.col("flag").startswith(key) | F.col("flag").startswith(f"pat_{key}")
        name, sign = F.when(own, p).otherwise(name), F.when(own, s).otherwise(sign)
    side = F.when(F.col("rate") > high, 1).when(F.col("rate") < low, -1).otherwise(0)
    return rates.select("flag", "rate", name.alias("parameter"), (sign * side * step).cast("double").alias("shift"))


def tune(rate: Callable[[float], float], value: float, low: float, high: float, step: float, sign: int = 1, rounds: int = 20) -> float:
    """Shift one parameter until the rate it gives lies inside [low, high], or no longer gets nearer."""
    gap = lambda r: max(low - r, 0.0, r - high)
    best = gap(rate(value))
    for _ in range(rounds):
        if not best:
            break
        new = value + sign * step * (1 if rate(value) > high else -1)
        if (g := gap(rate(new))) >= best:
            break
        value, best = new, g
    return value


def apply(cfg: dict, found: dict) -> dict:
    """A configuration with found parameters pa.<component>.<name> in its place; weights come as a list."""
    for key, value in found.items():
        if not key.startswith("pa."):
            continue
        if key == "pa.confluence.weights":
            if not isinstance(value, (list, tuple)) or len(value) < 4:
                continue
            value = dict(zip(("structure", "zones", "imbalance", "mtf", "extras"), map(float, value), strict=False))
        cfg = deep_set(cfg, f"{BASE}.{key[3:]}", value)
    return cfg


def component(cfg: dict, name: str, explicit: dict | None = None, base: str = BASE) -> dict:
    """Keyword arguments of a component: common, then the component's own, then overrides, then those given."""
    layers = [deep_get(cfg, f"{base}.{part}", {}) or {} for part in ("common", name, f"overrides.{name}")]
    return {k: v for layer in (*layers, explicit or {}) for k, v in layer.items()}


def fib_parameters(cfg: dict, symbol: str | None = None, tf: str | None = None) -> dict:
    """Fibonacci settings: the general ones, those of a timeframe over them, those of a symbol over both."""
    own = deep_get(cfg, "features.fibonacci", {}) or {}
    out = {k: v for k, v in own.items() if k != "overrides"}
    for kind, key in (("timeframes", tf), ("symbols", symbol)):
        out |= deep_get(own, f"overrides.{kind}", {}).get(key, {}) if key else {}
    return out


def news_windows(cfg: dict) -> dict:
    """The news gate's settings, with the names they may also go by."""
    own = deep_get(cfg, "safety.news_filter", {}) or {}
    medium = lambda side, default: int(own.get(f"medium_impact_reduce_minutes_{side}", own.get(f"medium_impact_freeze_minutes_{side}", default)))
    return {
        "enabled": bool(own.get("enabled", True)),
        "high": (int(own.get("high_impact_freeze_minutes_before", 30)), int(own.get("high_impact_freeze_minutes_after", 15))),
        "medium": (medium("before", 15), medium("after", 10)),
        "low": (int(own.get("low_impact_window_before", 0)), int(own.get("low_impact_window_after", 0))),
        "scale": float(own.get("reduce_risk_scale", 0.5)), "currencies": own.get("currencies") or None,
    }


def spread_of(cfg: dict, columns: list[str] = ()) -> dict:
    """Where the spread comes from: a spread column if history is to be used and there is one, else the costs, else 0."""
    series = next((c for c in columns if "spread" in c.lower()), None)
    if series and deep_get(cfg, "evaluation.backtest.reuse_historical_spread", False):
        return {"use_series": True, "column": series, "value": 0.0, "source": "broker_data"}
    given = deep_get(cfg, "trading.costs.spread_pts")
    return {"use_series": False, "value": max(float(given or 0.0), 0.0), "source": "zero_default" if given is None else "config_costs"}
