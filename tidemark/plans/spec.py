"""The specification language name(args)@TF: parser, registry and planner.

Specs are parsed to plan nodes, grouped by timeframe and turned into one DataFrame plan: bars of a
timeframe are made once, all its operators are chained on them (their windows share one sort), and
the results come back to the base grid by one as-of window for all timeframes, at the time their
bars are closed.
"""

from __future__ import annotations

import inspect
import logging
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import patterns as pat
from ..operators import levels, price_action, sequential, zigzag, zones
from ..operators.asof import asof_many
from ..operators.scan import Steps, together
from ..sources.bars import resample, seconds

log = logging.getLogger(__name__)
#: Parameters that positional numbers and strings go to, in this order.
NUMBERS = ("period", "n", "window", "length", "fast", "slow", "signal", "k", "d")
STRINGS = ("col", "column", "field")


@dataclass(frozen=True)
class Spec:
    name: str
    args: tuple = ()
    kwargs: tuple = ()
    timeframe: str | None = None
    raw: str = field(default="", compare=False)


def split_args(text: str) -> list[str]:
    """Parts between commas that neither a bracket nor quotes enclose."""
    parts, depth, start, quote = [], 0, 0, ""
    for i, c in enumerate(text + ","):
        if quote or c in "'\"":
            quote = c if not quote else "" if c == quote else quote
            continue
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth <= 0:
            parts.append(text[start:i].strip())
            start = i + 1
    return [p for p in parts if p]


#: Words that mean something else, and the tokens of a value.
WORDS = {"true": True, "false": False, "none": None, "null": None}
TOKEN = re.compile(r"""(?P<quoted>'[^']*'|"[^"]*")|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+)(?:e[-+]?\d+)?)(?![\w.])|(?P<open>[\[(])|(?P<close>[\])])|(?P<word>[^\s,\[\]()'"]+)""", re.IGNORECASE)


def literal(text: str):
    """What a text of one value stands for: a number, a quoted text, a word of WORDS, a bare word, or a list of such in
    brackets. A text that isn't one value stands for itself."""
    lists: list[list] = [[]]
    for token in TOKEN.finditer(text):
        kind, found = token.lastgroup, token[0]
        if kind == "open":
            lists.append([])
            continue
        if kind == "close" and len(lists) == 1:
            return text.strip()
        if kind == "number":
            value = int(found) if found.lstrip("+-").isdigit() else float(found)
        else:
            value = lists.pop() if kind == "close" else found[1:-1] if kind == "quoted" else WORDS.get(found.lower(), found)
        lists[-1].append(value)
    return lists[0][0] if len(lists) == 1 and len(lists[0]) == 1 else text.strip()


def closing(text: str) -> int:
    """Where the bracket that a text begins with is closed; brackets in quotes don't count; -1 if it never is."""
    depth, quote = 0, ""
    for i, c in enumerate(text):
        if quote or c in "'\"":
            quote = c if not quote else "" if c == quote else quote
            continue
        depth += (c in "([{") - (c in ")]}")
        if not depth:
            return i
    return -1


def parse(text: str) -> Spec:
    """name, then arguments in brackets, then @ and a timeframe; the last two may be missing."""
    body = text.strip()
    size = next((i for i, c in enumerate(body) if not (c.isalnum() or c == "_")), len(body))
    name, rest, inner = body[:size], body[size:].strip(), ""
    if rest.startswith("(") and (end := closing(rest)) > 0:
        inner, rest = rest[1:end], rest[end + 1 :].strip()
    marked = rest.startswith("@")
    tf, rest = (rest[1:].strip(), "") if marked else ("", rest)
    if not name.isidentifier() or rest or marked != tf.isalnum():
        raise ValueError(f"no specification: {text!r}")
    args, kwargs = [], {}
    for part in split_args(inner):
        key = re.match(r"([A-Za-z_]\w*)\s*=(?!=)", part)
        if key:
            kwargs[key[1]] = literal(part[key.end() :])
        else:
            args.append(literal(part))
    freeze = lambda v: tuple(v) if isinstance(v, list) else v
    return Spec(name.lower(), tuple(map(freeze, args)), tuple(sorted((k, freeze(v)) for k, v in kwargs.items())), tf.upper() or None, text)


parse_spec = parse_spec_v2 = parse


@dataclass(frozen=True)
class Operator:
    """fn(bars, **params) adds columns to bars. causal: later bars never change earlier values."""

    fn: Callable[..., DataFrame]
    causal: bool = True
    grouped: bool = False
    aliases: tuple = ()
    volume: bool = False

    @property
    def params(self) -> list[str]:
        skip = {"df", "bars", "states", "higher"}
        return [p for p in inspect.signature(self.fn).parameters if p not in skip]


def _on_zigzag(fn):
    def op(df: DataFrame, depth: int = 12, deviation: float = 5.0, backstep: int = 10, point: float = 0.01) -> DataFrame:
        return fn(zigzag.zigzag(df, depth, deviation, backstep, point))

    return op


def _div_rsi(df: DataFrame, period: int = 14, k: int = 2, mode: str = "classic") -> DataFrame:
    return ind.divergence(ind.rsi(df, n=period, out="_osc"), "_osc", k, mode, "div_rsi").drop("_osc")


def _div_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, k: int = 2, mode: str = "classic") -> DataFrame:
    return ind.divergence(ind.macd(df, fast=fast, slow=slow, signal=signal), "macd", k, mode, "div_macd").drop("macd", "macd_signal", "macd_hist")


def _zone(name):
    def op(df: DataFrame, max_bars_alive: int = 3, atr_window: int = 14) -> DataFrame:
        return zones.zone(df, name, max_bars_alive, atr_window)

    return op


def _sr_distance(df: DataFrame, depth: int = 12, deviation: float = 5.0, backstep: int = 10, point: float = 0.01) -> DataFrame:
    return levels.sr_distance(ind.atr(zigzag.support_resistance(zigzag.zigzag(df, depth, deviation, backstep, point), True), 14))


def _overlap(df: DataFrame, k: int = 5, tol_pct: float = 0.05) -> DataFrame:
    return df.join(levels.fractal_levels(df, k), "symbol", "left").withColumn("sr_overlap", levels.overlap(F.col("close"), F.col("levels"), tol_pct)).drop("levels")


def _fibo_full(df: DataFrame, tol_pct: float = 0.3) -> DataFrame:
    return levels.nearest_cluster(df, levels.fibo_pipeline({"base": df}, "base", tol_pct))


def _golden(df: DataFrame, low: float = 0.382, high: float = 0.618) -> DataFrame:
    z = levels.golden_zone(levels.leg_levels(levels.swing_legs(levels.swings(df), 1)), (low, high))
    return df.join(z, "symbol", "left")


def _ext(df: DataFrame, sl_mult: float = 1.5) -> DataFrame:
    t = levels.ext_targets(levels.swing_legs(levels.swings(df), 1), sl_mult=sl_mult).groupBy("symbol").agg(*[F.max(F.when(F.col("ratio") == r, F.col("target"))).alias(f"fib_ext_{str(r).replace('.', '_')}") for r in levels.EXTENSIONS])
    return df.join(t, "symbol", "left")


def _leg_levels(df: DataFrame, max_legs: int = 1) -> DataFrame:
    t = levels.leg_levels(levels.swing_legs(levels.swings(df), max_legs)).groupBy("symbol").agg(*[F.max(F.when(F.col("ratio") == r, F.col("price"))).alias(f"leg_level_{str(r).replace('.', '_')}") for r in levels.RATIOS])
    return df.join(t, "symbol", "left")


def _legs(df: DataFrame, max_legs: int = 1) -> DataFrame:
    t = levels.swing_legs(levels.swings(df), max_legs).groupBy("symbol").agg(F.max_by("p0", "to_time").alias("leg_from"), F.max_by("p1", "to_time").alias("leg_to"), F.max(F.col("leg_up").cast("int")).alias("leg_up"))
    return df.join(t, "symbol", "left")


def _zigzag_mtf(df: DataFrame, tf_higher: str = "D1", depth: int = 3) -> DataFrame:
    return zigzag.mtf(df, resample(df, tf_higher), depth=depth)


REGISTRY: dict[str, Operator] = {
    **{n: Operator(getattr(ind, n)) for n in ("sma", "ema", "wma", "rsi", "roc", "atr", "tr", "macd", "bbands", "keltner", "stoch", "cci", "wr", "donchian", "chaikin_vol", "adx", "aroon", "kama", "dema", "tema", "hma", "ichimoku", "ma_slope", "rsi_zone")},
    **{n: Operator(getattr(ind, n), volume=True) for n in ("mfi", "obv", "vwap", "vwap_roll", "adl", "cmf")},
    "ha": Operator(ind.heikin_ashi), "sar": Operator(sequential.psar, grouped=True), "supertrend": Operator(sequential.supertrend, grouped=True),
    "div_rsi": Operator(_div_rsi, causal=False), "div_macd": Operator(_div_macd, causal=False),
    "pivots": Operator(levels.pivots), "round_levels": Operator(levels.round_levels), "adr": Operator(levels.adr), "adr_distance_to_open": Operator(levels.adr_distance_to_open),
    "sr_overlap_score": Operator(_overlap, causal=False), "sr": Operator(_on_zigzag(zigzag.support_resistance), False, True), "sr_distance": Operator(_sr_distance, False, True), "fibo": Operator(_on_zigzag(zigzag.fibo), False, True),
    "zigzag_mtf": Operator(_zigzag_mtf, False, True), "fibo_features_full": Operator(_fibo_full, False, True), "golden_zone": Operator(_golden, causal=False), "fib_cluster": Operator(_fibo_full, False, True),
    "fib_ext_targets": Operator(_ext, causal=False), "levels_from_legs": Operator(_leg_levels, causal=False), "select_legs_from_swings": Operator(_legs, causal=False),
    **{f"pat_{n}": Operator(f) for n, f in {"engulf": pat.engulf, "doji": pat.doji, "pin": pat.pin, "hammer_star": pat.hammer_star, "harami": pat.harami, "inside_outside": pat.inside_outside, "marubozu": pat.marubozu, "tweezer": pat.tweezer, "3soldiers_crows": pat.soldiers_crows, "morning_evening": pat.star, "piercing_dark": pat.piercing_dark, "belt": pat.belt}.items()},
    "fvg": Operator(_zone("fvg")), "supply_demand": Operator(_zone("sd")), "order_block": Operator(_zone("ob")), "liq_sweep": Operator(_zone("ls")), "breaker_flip": Operator(_zone("bf")), "sr_fusion": Operator(zones.fusion),
    "pa_market_structure": Operator(_on_zigzag(zigzag.market_structure), False, True), "pa_regime": Operator(price_action.regime, causal=False), "pa_breakouts": Operator(price_action.breakouts, causal=False), "pa_microchannels": Operator(price_action.microchannels),
    "pa_mtf_context": Operator(price_action.mtf_context, causal=False), "pa_confluence": Operator(price_action.confluence), "pa_zones": Operator(lambda df: price_action.zone_features(ind.atr(df, 14))), "pa_imbalance": Operator(lambda df: price_action.imbalance_features(ind.atr(df, 14))),
}


def register(name: str, fn: Callable[..., DataFrame], **marks) -> None:
    """Add an operator of one's own."""
    REGISTRY[name] = Operator(fn, **marks)


def bind(spec: Spec) -> dict:
    """Keyword arguments of the operator: positional numbers and strings go to the usual names first."""
    op = REGISTRY[spec.name]
    given = dict(spec.kwargs)
    rename = {"period": "n", "window": "n", "length": "n", "multiplier": "m"}
    given = {(rename[k] if k not in op.params and rename.get(k) in op.params else k): v for k, v in given.items()}
    for v in spec.args:
        order = NUMBERS if isinstance(v, (int, float)) and not isinstance(v, bool) else STRINGS
        free = [p for p in op.params if p not in given]
        name = next((p for p in order if p in free), next(iter(free), None))
        if name is None:
            raise ValueError(f"too many arguments: {spec.raw}")
        given[name] = v
    return given


BARS = ("symbol", "time", "open", "high", "low", "close", "volume")


def name_of(spec: Spec, tf: str, key: str) -> str:
    params = "_".join(re.sub(r"\W", "_", str(v)) for v in (*spec.args, *(v for _, v in spec.kwargs)))
    return f"__{spec.name}@{tf}__{key}" + (f"_{params}" if params else "")


@dataclass
class Plan:
    """What runs: specs by timeframe, in order, without repetition, and what was left out and why."""

    groups: dict[str, list[Spec]]
    skipped: dict[str, str]


def plan(specs: list[str], base_tf: str, has_volume: bool = True, strict: bool = True) -> Plan:
    groups: dict[str, list[Spec]] = {}
    skipped: dict[str, str] = {}
    for spec in dict.fromkeys(map(parse, specs)):
        if spec.name not in REGISTRY:
            if strict:
                raise KeyError(f"no operator {spec.name!r} in {spec.raw!r}")
            skipped[spec.raw] = "unknown"
        elif REGISTRY[spec.name].volume and not has_volume:
            skipped[spec.raw] = "no volume"
        else:
            groups.setdefault(spec.timeframe or base_tf, []).append(spec)
    for raw, why in skipped.items():
        log.warning("skipped %s: %s", raw, why)
    return Plan(groups, skipped)


def _kept(steps: Callable, params: dict, plain: Callable[[list[str]], dict[str, str]]) -> Callable:
    """Steps whose columns, which come with the last step, get plain names at once: two may make the same."""

    def run(df: DataFrame) -> Steps:
        g = steps(df, **params)
        wanted = next(g)
        while True:
            df = yield wanted
            try:
                wanted = g.send(df)
            except StopIteration as done:
                return done.value.withColumnsRenamed(plain([c for c in done.value.columns if c not in df.columns]))

    return run


def _numbered(df: DataFrame) -> DataFrame:
    """df with a number for the rows that a symbol has at one time, in the order of their values."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", "time").orderBy(*[c for c in BARS if c in df.columns and c not in ("symbol", "time")])
    return df.withColumn("_of_time", F.row_number().over(w))


def compute(bars: DataFrame, specs: list[Spec], tf: str, whole: bool = False) -> DataFrame:
    """(symbol, time, features) of one timeframe, or with whole all columns of the bars instead of the first two; a row a bar.

    All operators are chained on the same bars. Operators with exponential means run together, so that the
    means of a timeframe are one scan. Bars of one time stay rows of their own.
    """
    base = bars.select(*[c for c in BARS if c in bars.columns], *([F.struct(*[F.col(f"`{c}`") for c in bars.columns]).alias("_bar")] if whole else []))
    names: dict[str, str] = {}
    calls = [(s, REGISTRY[s.name].fn, bind(s)) for s in specs]

    def plain(spec: Spec, new: list[str]) -> dict[str, str]:
        """Names for an operator's columns until the end: no operator makes them, and they need no quotes."""
        own = {c: f"kept{len(names) + i}" for i, c in enumerate(new)}
        names.update({k: name_of(spec, tf, c) for c, k in own.items()})
        return own

    out = together(base, [_kept(fn.steps, params, lambda new, s=s: plain(s, new)) for s, fn, params in calls if hasattr(fn, "steps")])
    for spec, fn, params in calls:
        if hasattr(fn, "steps"):
            continue
        keep = out.columns
        done = fn(out, **params)
        made = done.columns
        new = [c for c in made if c not in keep and c != "pos"]
        missing = [c for c in keep if c not in made]
        if missing:  # an operator that rebuilds its rows from the bars
            rest = _numbered(out).select("symbol", "time", "_of_time", *missing)
            done = _numbered(done).join(rest, ["symbol", "time", "_of_time"], "left").drop("_of_time")
        out = done.select(*keep, *[F.col(c).alias(k) for c, k in plain(spec, new).items()])
    return out.select(*(["_bar.*"] if whole else ["symbol", "time"]), *[F.col(k).alias(n) for k, n in names.items()])


def run_specs(bars: DataFrame, specs: list[str], base_tf: str, *, strict: bool = True, tolerance: bool = False) -> DataFrame:
    """Features on the base grid. Higher timeframes are true bars, joined as of their close."""
    p = plan(specs, base_tf, "volume" in bars.columns, strict)
    out, higher = bars, []
    for tf, own in p.groups.items():
        if seconds(tf) < seconds(base_tf):
            raise ValueError(f"{tf} is finer than the base {base_tf}")
        if tf == base_tf:
            out = compute(bars, own, tf, whole=True)
        else:
            f = compute(resample(bars, tf), own, tf)
            higher.append((f, [c for c in f.columns if c not in ("symbol", "time")]))
    return asof_many(out, higher, tolerance_us=seconds(base_tf) * 1_000_000 if tolerance else None) if higher else out


def fill(df: DataFrame, cols: list[str], backward: bool = False) -> DataFrame:
    """Forward fill, then 0; backward also fills heads from the future (not causal, off unless asked for)."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("time")
    value = lambda c: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = lambda c: F.first(c, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumns({c: F.coalesce(value(c), *([back(c)] if backward else []), F.lit(0)) for c in cols})


def metadata(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, first_valid, warmup, coverage) of numeric feature columns over all symbols, in one pass."""
    from pyspark.sql import Window

    n = df.withColumn("_i", F.row_number().over(Window.partitionBy("symbol").orderBy("time")) - 1)
    ok = [F.col(f"`{c}`").isNotNull() for c in cols]
    # one row of a struct a column: the rows aren't multiplied by the columns
    each = n.agg(*[F.struct(F.lit(c).alias("column"), F.min(F.when(v, F.col("time"))).alias("first_valid"), F.min(F.when(v, F.col("_i"))).alias("warmup"), F.avg(v.cast("double")).alias("coverage")).alias(f"c{i}") for i, (c, v) in enumerate(zip(cols, ok, strict=True))], F.count(F.lit(1)).alias("_n"))
    return each.where("_n > 0").select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(cols))])))


def observation_columns(columns: list[str], keep: list[str], drop: list[str]) -> list[str]:
    """Columns that end in or hold a wanted name and hold no unwanted one."""
    return [c for c in columns if any(c.endswith(k) or k in c for k in keep) and not any(d in c for d in drop)]


def drop_empty(df: DataFrame, cols: list[str]) -> DataFrame:
    """Without feature columns that have no value at all: one aggregate."""
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return df.drop(*[c for i, c in enumerate(cols) if not row[i]])


def timeframes_in(columns: list[str]) -> list[str]:
    """Timeframes that prefix columns such as H4_close, coarsest last."""
    found = {m[1] for c in columns if (m := re.match(r"([MHDW]\d+)_", c))}
    return sorted(found, key=seconds)


def tf_view(df: DataFrame, tf: str) -> DataFrame:
    """The columns of one timeframe without their prefix; rows where all of them are null go."""
    own = [c for c in df.columns if c.startswith(f"{tf}_")]
    view = df.select("symbol", "time", *[F.col(c).alias(c.removeprefix(f"{tf}_")) for c in own])
    return view.na.drop("all", subset=[c.removeprefix(f"{tf}_") for c in own])


def first_existing(columns: list[str], names: list[str]) -> str | None:
    return next((n for n in names if n in columns), None)


def covered(df: DataFrame, cols: list[str], least: float) -> list[str]:
    """Feature columns whose share of values reaches a minimum: one small result row a column."""
    rows = metadata(df, cols).where(F.col("coverage") >= least).select("column").collect()
    return [c for c in cols if c in {r["column"] for r in rows}]
