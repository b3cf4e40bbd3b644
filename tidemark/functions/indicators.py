"""Technical indicators: each takes bars (symbol, time, open, high, low, close, volume) and adds columns.

Null heads follow each indicator's warm-up. All are built-in expressions; the recursive ones use
the affine scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import Steps, affine_scan, fresh, recurrent, span
from .frames import after, by_time, earlier, flag, last_rows, nonzero, prev, rolling, rows, running


def sma(df: DataFrame, col: str = "close", n: int = 20, out: str = "sma") -> DataFrame:
    return df.withColumn(out, rolling(col, n, F.avg))


@recurrent
def ema(df: DataFrame, col: str = "close", n: int = 20, out: str = "ema") -> Steps:
    mean = fresh("mean")
    df = yield df, {mean: (col, span(n))}
    return df.withColumn(out, F.when(F.count(F.col(col)).over(running()) >= n, F.col(mean))).drop(mean)


def wma_of(c: Column, n: int) -> Column:
    """Linear weights 1..n; a sum of lags, so null as long as one is missing."""
    total = reduce(lambda a, b: a + b, [F.lag(c, n - k).over(by_time()) * float(k) for k in range(1, n + 1)])
    return total / (n * (n + 1) / 2)


def wma(df: DataFrame, col: str = "close", n: int = 20, out: str = "wma") -> DataFrame:
    return df.withColumn(out, wma_of(F.col(col), n))


def hma(df: DataFrame, col: str = "close", n: int = 20, out: str = "hma") -> DataFrame:
    half = max(2, n // 2)
    return df.withColumn("_h", 2 * wma_of(F.col(col), half) - wma_of(F.col(col), n)).withColumn(out, wma_of(F.col("_h"), int(n**0.5))).drop("_h")


def true_range() -> Column:
    pc = prev("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def tr(df: DataFrame, out: str = "tr") -> DataFrame:
    return df.withColumn(out, true_range())


def _classic(df: DataFrame, n: int, out: str) -> DataFrame:
    tr_ = fresh("tr")
    return df.withColumn(tr_, true_range()).withColumn(out, rolling(tr_, n, F.avg)).drop(tr_)


@recurrent
def _smoothed_range(df: DataFrame, n: int = 14, out: str = "atr", alpha: float = 1 / 14) -> Steps:
    tr_, mean = fresh("tr"), fresh("mean")
    df = yield df.withColumn(tr_, true_range()), {mean: (tr_, alpha)}
    return df.withColumn(out, after(F.col(mean), n)).drop(tr_, mean)


def atr(df: DataFrame, n: int = 14, out: str = "atr", method: str = "wilder") -> DataFrame:
    """classic: mean of the true range; wilder and ema: its exponential mean, null in the first n rows."""
    return _classic(df, n, out) if method == "classic" else _smoothed_range(df, n, out, 1.0 / n if method == "wilder" else span(n))


def _atr_steps(df: DataFrame, n: int = 14, out: str = "atr", method: str = "wilder") -> Steps:
    if method == "classic":
        df = yield _classic(df, n, out), {}
        return df
    return (yield from _smoothed_range.steps(df, n, out, 1.0 / n if method == "wilder" else span(n)))


atr.steps = _atr_steps


@recurrent
def rsi(df: DataFrame, col: str = "close", n: int = 14, out: str = "rsi", method: str = "ema") -> Steps:
    """100 where there was no loss; null without gain and loss and in the first n rows."""
    alpha = 1.0 / n if method == "wilder" else span(n)
    d, g, l = (fresh(x) for x in "dgl")  # noqa: E741
    c = F.col(d)
    gain, loss = (F.when(c.isNotNull(), F.greatest(x, F.lit(0.0))) for x in (c, -c))
    df = yield df.withColumn(d, F.col(col) - prev(col)), {g: (gain, alpha), l: (loss, alpha)}
    value = F.when((F.col(l) == 0) & (F.col(g) == 0), None).when(F.col(l) == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.col(g) / F.col(l)))
    return df.withColumn(out, after(value, n)).drop(d, g, l)


def roc(df: DataFrame, col: str = "close", n: int = 10, out: str = "roc") -> DataFrame:
    return df.withColumn(out, (F.col(col) / nonzero(prev(col, n)) - 1) * 100)


@recurrent
def macd(df: DataFrame, col: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> Steps:
    f, s = fresh("f"), fresh("s")
    df = yield df, {f: (col, span(fast)), s: (col, span(slow))}
    line, mean = fresh("line"), fresh("mean")
    df = yield df.withColumn(line, after(F.col(f) - F.col(s), slow)), {mean: (line, span(signal))}
    df = df.withColumns({"macd": F.col(line), "macd_signal": after(F.col(mean), slow + signal - 1)})
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop(f, s, line, mean)


def bbands(df: DataFrame, col: str = "close", n: int = 20, k: float = 2.0) -> DataFrame:
    mid, dev = rolling(col, n, F.avg), rolling(col, n, F.stddev_pop)
    return df.withColumns({"bb_mid": mid, "bb_up": mid + k * dev, "bb_low": mid - k * dev})


@recurrent
def keltner(df: DataFrame, n: int = 20, m: float = 2.0) -> Steps:
    tr_, a, b = fresh("tr"), fresh("mid"), fresh("atr")
    df = yield df.withColumn(tr_, true_range()), {a: ("close", span(n)), b: (tr_, 1.0 / n)}
    mid, width = after(F.col(a), n), after(F.col(b), n) * m
    return df.withColumns({"kc_mid": mid, "kc_up": mid + width, "kc_low": mid - width}).drop(tr_, a, b)


def stoch(df: DataFrame, n: int = 14, d: int = 3) -> DataFrame:
    hi, lo = rolling("high", n, F.max), rolling("low", n, F.min)
    df = df.withColumn("stoch_k", after(100 * (F.col("close") - lo) / nonzero(hi - lo), n))
    return df.withColumn("stoch_d", rolling("stoch_k", d, F.avg))


def cci(df: DataFrame, n: int = 20, out: str = "cci") -> DataFrame:
    """The deviation uses each bar's own mean, so the first value comes at row 2n-2."""
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn("_m", rolling("_tp", n, F.avg))
    df = df.withColumn("_ad", F.abs(F.col("_tp") - F.col("_m")))
    return df.withColumn(out, (F.col("_tp") - F.col("_m")) / nonzero(0.015 * rolling("_ad", n, F.avg))).drop("_tp", "_m", "_ad")


def mfi(df: DataFrame, n: int = 14, out: str = "mfi") -> DataFrame:
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn("_d", F.col("_tp") - prev("_tp"))
    flow = F.col("_tp") * F.col("volume")
    df = df.withColumn("_p", F.when(F.col("_d") > 0, flow).otherwise(0.0)).withColumn("_n", F.when(F.col("_d") < 0, flow).otherwise(0.0))
    pos, neg = F.sum("_p").over(last_rows(n)), F.sum("_n").over(last_rows(n))
    return df.withColumn(out, after(F.when(neg == 0, F.when(pos > 0, 100.0)).otherwise(100 - 100 / (1 + pos / neg)), n)).drop("_tp", "_d", "_p", "_n")


def obv(df: DataFrame, out: str = "obv") -> DataFrame:
    step = F.signum(F.col("close") - prev("close")) * F.col("volume")
    return df.withColumn("_s", step).withColumn(out, after(F.sum("_s").over(running()), 1)).drop("_s")


def wr(df: DataFrame, n: int = 14, out: str = "wr") -> DataFrame:
    hi, lo = rolling("high", n, F.max), rolling("low", n, F.min)
    return df.withColumn(out, after(-100 * (hi - F.col("close")) / nonzero(hi - lo), n))


def heikin_ashi(df: DataFrame) -> DataFrame:
    df = df.withColumn("ha_close", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4)
    first = F.row_number().over(by_time()) == 1
    b = F.when(first, (F.col("open") + F.col("close")) / 2).otherwise(prev("ha_close") / 2)
    df = affine_scan(df, {"ha_open": (F.when(first, 0.0).otherwise(0.5), b)})
    return df.withColumns({"ha_high": F.greatest("high", "ha_open", "ha_close"), "ha_low": F.least("low", "ha_open", "ha_close")})


def donchian(df: DataFrame, n: int = 20) -> DataFrame:
    hi, lo = rolling("high", n, F.max), rolling("low", n, F.min)
    return df.withColumns({"don_up": hi, "don_low": lo, "don_mid": (hi + lo) / 2})


@recurrent
def chaikin_vol(df: DataFrame, n: int = 10, k: int = 10, out: str = "chaikin_vol") -> Steps:
    e = fresh("e")
    df = yield df, {e: (F.col("high") - F.col("low"), span(n))}
    df = df.withColumn(e, after(F.col(e), n - 1))
    return df.withColumn(out, 100 * (F.col(e) / nonzero(prev(e, k)) - 1)).drop(e)


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    up, dn = F.col("high") - prev("high"), prev("low") - F.col("low")
    df = df.withColumns({"_up": up, "_dn": dn, "_tr": nonzero(true_range())})
    plus = F.when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0)
    minus = F.when((F.col("_dn") > F.col("_up")) & (F.col("_dn") > 0), F.col("_dn")).otherwise(0.0)
    df = df.withColumns({"_p": plus, "_m": minus})
    mean = rolling("_tr", n, F.avg)
    df = df.withColumns({"pdi": 100 * rolling("_p", n, F.sum) / mean, "mdi": 100 * rolling("_m", n, F.sum) / mean})
    df = df.withColumn("_dx", 100 * F.abs(F.col("pdi") - F.col("mdi")) / nonzero(F.col("pdi") + F.col("mdi")))
    df = df.withColumn("adx", rolling("_dx", n, F.avg))
    return df.withColumn("adxr", (F.col("adx") + prev("adx", n)) / 2).drop("_up", "_dn", "_tr", "_p", "_m", "_dx")


def aroon(df: DataFrame, n: int = 25) -> DataFrame:
    """Bars since the extreme over n-1, times 10,000 as the definition has it."""

    def since(c: str, best) -> Column:
        held = F.collect_list(c).over(last_rows(n))
        at = F.array_position(F.reverse(held), best(c).over(last_rows(n))) - 1
        return F.when(F.count(c).over(last_rows(n)) >= n, at / (n - 1) * 10000.0)

    df = df.withColumns({"aroon_up": since("high", F.max), "aroon_down": since("low", F.min)})
    return df.withColumn("aroon_osc", F.col("aroon_up") - F.col("aroon_down"))


def kama(df: DataFrame, col: str = "close", n: int = 10, fast: int = 2, slow: int = 30, out: str = "kama") -> DataFrame:
    """The first n rows are the price itself; the smoothing then follows the efficiency ratio."""
    df = df.withColumn("_d", F.abs(F.col(col) - prev(col)))
    er = F.abs(F.col(col) - prev(col, n)) / nonzero(rolling("_d", n, F.sum))
    df = df.withColumn("_sc", F.pow(er * (span(fast) - span(slow)) + span(slow), F.lit(2.0))).withColumn("_r", F.row_number().over(by_time()))
    head = F.col("_r") <= n
    df = affine_scan(df, {out: (F.when(head, 0.0).otherwise(1 - F.col("_sc")), F.when(head, F.col(col)).otherwise(F.col("_sc") * F.col(col)))})
    return df.drop("_d", "_sc", "_r")


def _stacked(df: DataFrame, col: str, n: int, depth: int) -> Steps:
    """EMA of EMA ..., each null until n values of the one before; returns the frame and their names."""
    names: list[str] = []
    for _ in range(depth):
        last = names[-1] if names else col
        e = yield from _named_ema(df, last, n)
        df = e[0]
        names.append(e[1])
    return df, names


def _named_ema(df: DataFrame, col: str, n: int) -> Steps:
    name = fresh("e")
    df = yield from ema.steps(df, col, n, name)
    return df, name


@recurrent
def dema(df: DataFrame, col: str = "close", n: int = 20, out: str = "dema") -> Steps:
    df, (a, b) = yield from _stacked(df, col, n, 2)
    return df.withColumn(out, 2 * F.col(a) - F.col(b)).drop(a, b)


@recurrent
def tema(df: DataFrame, col: str = "close", n: int = 20, out: str = "tema") -> Steps:
    df, (a, b, c) = yield from _stacked(df, col, n, 3)
    return df.withColumn(out, 3 * F.col(a) - 3 * F.col(b) + F.col(c)).drop(a, b, c)


def ichimoku(df: DataFrame, tenkan: int = 9, kijun: int = 26, span_b: int = 52) -> DataFrame:
    mid = lambda n: (rolling("high", n, F.max) + rolling("low", n, F.min)) / 2
    df = df.withColumns({"ich_conv": mid(tenkan), "ich_base": mid(kijun), "_b": mid(span_b)})
    df = df.withColumn("_a", (F.col("ich_conv") + F.col("ich_base")) / 2)
    return df.withColumns({"ich_span_a": prev("_a", kijun), "ich_span_b": prev("_b", kijun)}).drop("_a", "_b")


@recurrent
def ma_slope(df: DataFrame, col: str = "close", n: int = 20, method: str = "ema", norm: str = "stdev", out: str = "ma_slope", eps: float = 1e-12) -> Steps:
    least, ma = max(2, n // 2), fresh("ma")
    if method == "ema":
        df = yield df, {ma: (col, span(n))}
        df = df.withColumn(ma, F.when(F.count(col).over(running()) >= least, F.col(ma)))
    else:
        df = yield df.withColumn(ma, rolling(col, n, F.avg, least)), {}
    slope = F.col(ma) - prev(ma)
    if norm == "stdev":
        slope = slope / (rolling(col, n, F.stddev_samp, least) + eps)
    elif norm == "price":
        slope = slope / (F.abs(F.col(col)) + eps)
    return df.withColumn(out, slope).drop(ma)


@recurrent
def rsi_zone(df: DataFrame, n: int = 14, over: float = 70, under: float = 30, mid: float = 50, band: float = 5) -> Steps:
    df = yield from rsi.steps(df, n=n)
    r = F.col("rsi")
    return df.withColumns({"rsi_is_overbought": flag(r >= over), "rsi_is_oversold": flag(r <= under), "rsi_mid_zone": flag(F.abs(r - mid) <= band)})


def vwap(df: DataFrame, out: str = "vwap") -> DataFrame:
    """Volume-weighted price of the UTC day so far."""
    from pyspark.sql import Window

    day = Window.partitionBy("symbol", F.to_date("time")).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    return df.withColumn("_pv", tp * F.col("volume")).withColumn(out, F.sum("_pv").over(day) / nonzero(F.sum("volume").over(day).cast("double"))).drop("_pv")


def vwap_roll(df: DataFrame, n: int = 100, out: str = "vwap_roll") -> DataFrame:
    df = df.withColumn("_pv", (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume"))
    return df.withColumn(out, rolling("_pv", n, F.sum) / nonzero(rolling("volume", n, F.sum).cast("double"))).drop("_pv")


def _money() -> Column:
    return (2 * F.col("close") - F.col("high") - F.col("low")) / nonzero(F.col("high") - F.col("low"))


def adl(df: DataFrame, out: str = "adl") -> DataFrame:
    return df.withColumn("_mf", _money() * F.col("volume")).withColumn(out, F.when(F.col("_mf").isNotNull(), F.sum("_mf").over(running()))).drop("_mf")


def cmf(df: DataFrame, n: int = 20, out: str = "cmf") -> DataFrame:
    df = df.withColumn("_mf", _money() * F.col("volume"))
    return df.withColumn(out, rolling("_mf", n, F.sum) / nonzero(rolling("volume", n, F.sum).cast("double"))).drop("_mf")


def zscore(df: DataFrame, col: str = "close", n: int = 20, out: str = "zscore") -> DataFrame:
    return df.withColumn(out, (F.col(col) - rolling(col, n, F.avg)) / nonzero(rolling(col, n, F.stddev_samp)))


def zscore_distance(x: Column, mu: Column, sigma: Column, eps: float = 1e-12) -> Column:
    return (x - mu) / (sigma + eps)


def centred_pivots(df: DataFrame, col: str = "close", k: int = 2) -> DataFrame:
    """Local extremes over k rows on both sides; not causal by k rows."""
    w = rows(-k, k)
    full = F.count(col).over(w) == 2 * k + 1
    return df.withColumns({"pivot_high": flag(full & (F.col(col) == F.max(col).over(w))), "pivot_low": flag(full & (F.col(col) == F.min(col).over(w)))})


def divergence(df: DataFrame, osc: str, k: int = 2, mode: str = "classic", prefix: str = "div") -> DataFrame:
    """Change of the oscillator between price pivots where price and oscillator part."""
    df = centred_pivots(df, "close", k)
    both = F.struct(F.col("close").alias("p"), F.col(osc).alias("o"))
    up = 1 if mode == "classic" else -1
    df = df.withColumns({"_h": F.last(F.when(F.col("pivot_high") == 1, both), True).over(earlier()), "_l": F.last(F.when(F.col("pivot_low") == 1, both), True).over(earlier())})
    price, value = F.col("close"), F.col(osc)
    bear = (F.col("pivot_high") == 1) & (up * (price - F.col("_h.p")) > 0) & (up * (value - F.col("_h.o")) < 0)
    bull = (F.col("pivot_low") == 1) & (up * (price - F.col("_l.p")) < 0) & (up * (value - F.col("_l.o")) > 0)
    return df.withColumns({f"{prefix}_bear": F.when(bear, value - F.col("_h.o")), f"{prefix}_bull": F.when(bull, value - F.col("_l.o"))}).drop("_h", "_l", "pivot_high", "pivot_low")


def divergence_flags(df: DataFrame, osc: str, k: int = 2, mode: str = "classic", prefix: str = "divf") -> DataFrame:
    """Flags one row later; the oscillator's last value counts only where it has a pivot of its own."""
    up = 1 if mode == "classic" else -1
    df = centred_pivots(df, "close", k).withColumnsRenamed({"pivot_high": "_ph", "pivot_low": "_pl"})
    df = centred_pivots(df, osc, k).withColumnsRenamed({"pivot_high": "_oh", "pivot_low": "_ol"})
    price, value = F.col("close"), F.col(osc)
    for p, o, s in (("_ph", "_oh", "h"), ("_pl", "_ol", "l")):
        df = df.withColumn(f"_p{s}v", F.last(F.when(F.col(p) == 1, price), True).over(earlier())).withColumn(f"_o{s}v", F.last(F.when((F.col(p) == 1) & (F.col(o) == 1), value), True).over(earlier()))
    bear = (F.col("_ph") == 1) & (up * (price - F.col("_phv")) > 0) & (up * (value - F.col("_ohv")) < 0)
    bull = (F.col("_pl") == 1) & (up * (price - F.col("_plv")) < 0) & (up * (value - F.col("_olv")) > 0)
    df = df.withColumns({"_bear": flag(bear), "_bull": flag(bull)})
    df = df.withColumns({f"{prefix}_bear": F.coalesce(prev("_bear"), F.lit(0)), f"{prefix}_bull": F.coalesce(prev("_bull"), F.lit(0))})
    return df.drop("_ph", "_pl", "_oh", "_ol", "_phv", "_ohv", "_plv", "_olv", "_bear", "_bull")

