"""Queries of the indicators and patterns over H4 bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import patterns as pat
from ..operators import ranges, sequential
from .catalog import ewm_sql, full, over_bars, r6, win, with_bars

PART = "partition by symbol order by time"


def simple(name, fn, cols, exprs, pre="", where="b", tf="H4"):
    """Query name: fn's cols against one SQL expression each, over table `where`."""
    body = (pre + " === " if pre else "") + "select symbol, time, " + ", ".join(r6(e, c) for c, e in zip(cols, exprs, strict=True)) + f" from {where}"
    over_bars(name, with_bars(body), fn, cols, tf)


def flags(name, fn, cols, exprs, pre="", where="b"):
    body = (pre + " === " if pre else "") + "select symbol, time, " + ", ".join(f"cast(coalesce({e}, false) as integer) as {c}" for c, e in zip(cols, exprs, strict=True)) + f" from {where}"
    over_bars(name, with_bars(body), fn, cols)


def head(e, n):
    return f"case when rn > {n} then {e} end"


TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
T = f"t as (select *, {TR} as tr from b),"

simple("ind01_sma", ind.sma, ["sma"], [full("avg", "close", 20)])
simple("ind02_ema", ind.ema, ["ema"], [head(ewm_sql("close", "(2.0/21)"), 19)])
simple("ind03_wma", lambda d: ind.wma(d, n=10), ["wma"], ["(" + " + ".join(f"lag(close, {10 - k}) over ({PART}) * {k}.0" for k in range(1, 11)) + ") / 55.0"])

RSI = """d as (select *, close - pc as dd from b),
ud as (select *, case when dd is not null then greatest(dd, 0) end as up, case when dd is not null then greatest(-dd, 0) end as dn from d),
gl as (select *, {g} as g, {l} as l from ud),
rs as (select *, case when rn > 14 then case when l = 0 and g = 0 then null when l = 0 then 100.0 else 100.0 - 100.0 / (1.0 + g / l) end end as rsi from gl),"""
RSI_EMA = RSI.format(g=ewm_sql("up", "(2.0/15)"), l=ewm_sql("dn", "(2.0/15)"))
simple("ind04_rsi", ind.rsi, ["rsi"], ["rsi"], RSI_EMA, "rs")
simple("ind04_rsi_wilder", lambda d: ind.rsi(d, method="wilder"), ["rsi"], ["rsi"], RSI.format(g=ewm_sql("up", "(1.0/14)"), l=ewm_sql("dn", "(1.0/14)")), "rs")
simple("ind05_roc", ind.roc, ["roc"], [f"(close / lag(close, 10) over ({PART}) - 1) * 100"])
simple("ind06_tr", ind.tr, ["tr"], [TR])
simple("ind07_atr", ind.atr, ["atr"], [head(ewm_sql("tr", "(1.0/14)"), 14)], T, "t")
simple("ind08_atr_classic", lambda d: ind.atr(d, method="classic"), ["atr"], [full("avg", "tr", 14)], T, "t")
simple("ind08_atr_ema", lambda d: ind.atr(d, method="ema"), ["atr"], [head(ewm_sql("tr", "(2.0/15)"), 14)], T, "t")

MACD = f"m1 as (select *, case when rn > 26 then {ewm_sql('close', '(2.0/13)')} - {ewm_sql('close', '(2.0/27)')} end as macd from b), m2 as (select *, case when rn > 34 then {ewm_sql('macd', '(2.0/10)')} end as sg from m1),"
simple("ind09_macd", ind.macd, ["macd", "macd_signal", "macd_hist"], ["macd", "sg", "macd - sg"], MACD, "m2")
simple("ind10_bbands", ind.bbands, ["bb_mid", "bb_up", "bb_low"], [full("avg", "close", 20), full("avg", "close", 20) + " + 2 * " + full("stddev_pop", "close", 20).join("()"), full("avg", "close", 20) + " - 2 * " + full("stddev_pop", "close", 20).join("()")])
KC = f"k as (select *, {ewm_sql('close', '(2.0/21)')} as m, {ewm_sql('tr', '(1.0/20)')} as a from t),"
simple("ind11_keltner", ind.keltner, ["kc_mid", "kc_up", "kc_low"], [head("m", 20), head("m + 2 * a", 20), head("m - 2 * a", 20)], T + KC, "k")
HL14 = f"hl as (select *, {full('max', 'high', 14)} as hh, {full('min', 'low', 14)} as ll from b),"
simple("ind12_stoch", ind.stoch, ["stoch_k", "stoch_d"], ["k", full("avg", "k", 3)], HL14 + "st as (select *, case when rn > 14 then 100 * (close - ll) / nullif(hh - ll, 0) end as k from hl),", "st")
simple("ind13_cci", ind.cci, ["cci"], [f"(tp - m) / nullif(0.015 * ({full('avg', 'ad', 20)}), 0)"], f"c1 as (select *, (high + low + close) / 3 as tp from b), c2 as (select *, {full('avg', 'tp', 20)} as m from c1), c3 as (select *, abs(tp - m) as ad from c2),", "c3")
simple("ind14_mfi", ind.mfi, ["mfi"], [head(f"case when sum(ng) over {win(14)} = 0 then case when sum(ps) over {win(14)} > 0 then 100.0 end else 100 - 100 / (1 + sum(ps) over {win(14)} / sum(ng) over {win(14)}) end", 14)], f"f1 as (select *, (high + low + close) / 3 as tp from b), f2 as (select *, tp - lag(tp) over ({PART}) as d from f1), f3 as (select *, case when d > 0 then tp * volume else 0.0 end as ps, case when d < 0 then tp * volume else 0.0 end as ng from f2),", "f3")
simple("ind15_obv", ind.obv, ["obv"], [head(f"sum(s) over ({PART})", 1)], "o as (select *, cast(sign(close - pc) * volume as double) as s from b),", "o")
simple("ind16_wr", ind.wr, ["wr"], [head("-100 * (hh - close) / nullif(hh - ll, 0)", 14)], HL14, "hl")
simple("ind18_heikin_ashi", ind.heikin_ashi, ["ha_open", "ha_high", "ha_low", "ha_close"], ["ho", "greatest(high, ho, hc)", "least(low, ho, hc)", "hc"], f"h1 as (select *, (open + high + low + close) / 4 as hc from b), h2 as (select *, case when rn = 1 then (open + close) / 2 else lag(hc) over ({PART}) end as x from h1), h3 as (select *, list_reduce(list(x) over ({PART}), lambda a, v: a / 2 + v / 2) as ho from h2),", "h3")
simple("ind19_donchian", ind.donchian, ["don_up", "don_low", "don_mid"], [full("max", "high", 20), full("min", "low", 20), f"(({full('max', 'high', 20)}) + ({full('min', 'low', 20)})) / 2"])
simple("ind20_chaikin_vol", ind.chaikin_vol, ["chaikin_vol"], [f"100 * (e / nullif(lag(e, 10) over ({PART}), 0) - 1)"], f"v1 as (select *, high - low as hl from b), v2 as (select *, case when rn > 9 then {ewm_sql('hl', '(2.0/11)')} end as e from v1),", "v2")
ADX = f"""a1 as (select *, high - lag(high) over ({PART}) as u, lag(low) over ({PART}) - low as d, nullif({TR}, 0) as tr from b),
a2 as (select *, case when u > d and u > 0 then u else 0.0 end as pp, case when d > u and d > 0 then d else 0.0 end as mm from a1),
a3 as (select *, 100 * ({full('sum', 'pp', 14)}) / ({full('avg', 'tr', 14)}) as pdi, 100 * ({full('sum', 'mm', 14)}) / ({full('avg', 'tr', 14)}) as mdi from a2),
a4 as (select *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) as dx from a3), a5 as (select *, {full('avg', 'dx', 14)} as adx from a4),"""
simple("ind22_adx", ind.adx, ["pdi", "mdi", "adx", "adxr"], ["pdi", "mdi", "adx", f"(adx + lag(adx, 14) over ({PART})) / 2"], ADX, "a5")
AR = f"r1 as (select *, list_reverse(list(high) over {win(25)}) as hs, list_reverse(list(low) over {win(25)}) as ls from b), r2 as (select *, case when rn >= 25 then (list_position(hs, list_max(hs)) - 1) / 24.0 * 10000.0 end as u, case when rn >= 25 then (list_position(ls, list_min(ls)) - 1) / 24.0 * 10000.0 end as d from r1),"
simple("ind23_aroon", ind.aroon, ["aroon_up", "aroon_down", "aroon_osc"], ["u", "d", "u - d"], AR, "r2")
KAMA = f"""k1 as (select *, abs(close - pc) as d from b), k2 as (select *, abs(close - lag(close, 10) over ({PART})) / nullif({full('sum', 'd', 10)}, 0) as er from k1),
k3 as (select *, case when rn <= 10 then 1.0 else pow(er * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2.0) end as sc from k2),"""
simple("ind24_kama", ind.kama, ["kama"], [f"list_reduce(list({{'s': sc, 'y': close}}) over ({PART}), lambda a, v: {{'s': v.s, 'y': case when v.s is null then a.y else (1 - v.s) * a.y + v.s * v.y end}}).y"], KAMA, "k3")
E1 = f"e1 as (select *, {head(ewm_sql('close', '(2.0/21)'), 19)} as x1 from b), e2 as (select *, {head(ewm_sql('x1', '(2.0/21)'), 38)} as x2 from e1), e3 as (select *, {head(ewm_sql('x2', '(2.0/21)'), 57)} as x3 from e2),"
simple("ind25_dema", ind.dema, ["dema"], ["2 * x1 - x2"], E1, "e3")
simple("ind25_tema", ind.tema, ["tema"], ["3 * x1 - 3 * x2 + x3"], E1, "e3")


def wma_sql(c, n):
    return "(" + " + ".join(f"lag({c}, {n - k}) over ({PART}) * {k}.0" for k in range(1, n + 1)) + f") / {n * (n + 1) / 2}"


simple("ind26_hma", ind.hma, ["hma"], [wma_sql("x", 4)], f"w1 as (select *, 2 * {wma_sql('close', 10)} - {wma_sql('close', 20)} as x from b),", "w1")
MID = lambda n: f"(({full('max', 'high', n)}) + ({full('min', 'low', n)})) / 2"
simple("ind27_ichimoku", ind.ichimoku, ["ich_conv", "ich_base", "ich_span_a", "ich_span_b"], ["c", "k", f"lag((c + k) / 2, 26) over ({PART})", f"lag(sb, 26) over ({PART})"], f"i1 as (select *, {MID(9)} as c, {MID(26)} as k, {MID(52)} as sb from b),", "i1")
simple("ind28_ma_slope", ind.ma_slope, ["ma_slope"], [f"(m - lag(m) over ({PART})) / (({full('stddev_samp', 'close', 20, 10)}) + 1e-12)"], f"s1 as (select *, {head(ewm_sql('close', '(2.0/21)'), 9)} as m from b),", "s1")
over_bars("ind29_rsi_zone", with_bars(RSI_EMA + " === select symbol, time, round(rsi, 6) + 0.0 as rsi, cast(coalesce(rsi >= 70, false) as integer) as rsi_is_overbought, cast(coalesce(rsi <= 30, false) as integer) as rsi_is_oversold, cast(coalesce(abs(rsi - 50) <= 5, false) as integer) as rsi_mid_zone from rs"), ind.rsi_zone, ["rsi", "rsi_is_overbought", "rsi_is_oversold", "rsi_mid_zone"])
DAY = "(partition by symbol, cast(time as date) order by time)"
simple("ind30_vwap", ind.vwap, ["vwap"], [f"sum((high + low + close) / 3 * volume) over {DAY} / nullif(sum(volume) over {DAY}, 0)"])
simple("ind31_vwap_roll", lambda d: ind.vwap_roll(d, 20), ["vwap_roll"], [f"({full('sum', 'pv', 20)}) / nullif({full('sum', 'volume', 20)}, 0)"], "p1 as (select *, (high + low + close) / 3 * volume as pv from b),", "p1")
MF = "mf as (select *, (2 * close - high - low) / nullif(high - low, 0) * volume as m from b),"
simple("ind32_adl", ind.adl, ["adl"], [f"case when m is not null then sum(m) over ({PART}) end"], MF, "mf")
simple("ind33_cmf", ind.cmf, ["cmf"], [f"({full('sum', 'm', 20)}) / nullif({full('sum', 'volume', 20)}, 0)"], MF, "mf")
simple("ind34_zscore", ind.zscore, ["zscore"], [f"(close - ({full('avg', 'close', 20)})) / nullif({full('stddev_samp', 'close', 20)}, 0)"])
simple("ind35_zscore_distance", lambda d: ind.sma(d).withColumn("zd", ind.zscore_distance(F.col("close"), F.col("sma"), F.lit(2.5))), ["zd"], [f"(close - ({full('avg', 'close', 20)})) / (2.5 + 1e-12)"])
CW = "(partition by symbol order by time rows between 2 preceding and 2 following)"
PIV = f"pv as (select *, count(close) over {CW} = 5 and close = max(close) over {CW} as ph, count(close) over {CW} = 5 and close = min(close) over {CW} as pl from {{src}}),"
flags("ind36_pivots", ind.centred_pivots, ["pivot_high", "pivot_low"], ["ph", "pl"], PIV.format(src="b"), "pv")
LASTP = "lp as (select *, last_value(case when ph then {{'p': close, 'o': {o}}} end ignore nulls) over (partition by symbol order by time rows between unbounded preceding and 1 preceding) as xh, last_value(case when pl then {{'p': close, 'o': {o}}} end ignore nulls) over (partition by symbol order by time rows between unbounded preceding and 1 preceding) as xl from pv),"
DIV = ["case when ph and close > xh.p and {o} < xh.o then {o} - xh.o end", "case when pl and close < xl.p and {o} > xl.o then {o} - xl.o end"]
HID = ["case when ph and close < xh.p and {o} > xh.o then {o} - xh.o end", "case when pl and close > xl.p and {o} < xl.o then {o} - xl.o end"]
simple("ind37_div_rsi", lambda d: ind.divergence(ind.rsi(d), "rsi"), ["div_bear", "div_bull"], [x.format(o="rsi") for x in DIV], RSI_EMA + PIV.format(src="rs") + LASTP.format(o="rsi"), "lp")
simple("ind37_div_rsi_hidden", lambda d: ind.divergence(ind.rsi(d), "rsi", mode="hidden"), ["div_bear", "div_bull"], [x.format(o="rsi") for x in HID], RSI_EMA + PIV.format(src="rs") + LASTP.format(o="rsi"), "lp")
simple("ind37_div_macd", lambda d: ind.divergence(ind.macd(d), "macd"), ["div_bear", "div_bull"], [x.format(o="macd") for x in DIV], MACD + PIV.format(src="m1") + LASTP.format(o="macd"), "lp")
DF = f"""pw as (select *, count(rsi) over {CW} = 5 and rsi = max(rsi) over {CW} as oh, count(rsi) over {CW} = 5 and rsi = min(rsi) over {CW} as ol from pv),
lq as (select *, last_value(case when ph then close end ignore nulls) over pr as hp, last_value(case when ph and oh then rsi end ignore nulls) over pr as ho, last_value(case when pl then close end ignore nulls) over pr as lp, last_value(case when pl and ol then rsi end ignore nulls) over pr as lo from pw window pr as (partition by symbol order by time rows between unbounded preceding and 1 preceding)),
ff as (select *, coalesce(ph and close > hp and rsi < ho, false) as be, coalesce(pl and close < lp and rsi > lo, false) as bu from lq),"""
flags("ind38_divergence_flags", lambda d: ind.divergence_flags(ind.rsi(d), "rsi"), ["divf_bear", "divf_bull"], [f"lag(be) over ({PART})", f"lag(bu) over ({PART})"], RSI_EMA + PIV.format(src="rs") + DF, "ff")

# sequential indicators: recursive queries step from row to row
PSAR = """r as (
 select symbol, time, rn, high, low, h1, l1, h2, l2, case when h1 > h2 then true else false end as up0, cast(null as boolean) as up, cast(null as double) as ep, cast(null as double) as sar, cast(null as double) as af from w where rn = 2
 union all
 select w.symbol, w.time, w.rn, w.high, w.low, w.h1, w.l1, w.h2, w.l2, null, z.up1, z.ep1, z.sar1, z.af1 from r join w on w.symbol = r.symbol and w.rn = r.rn + 1,
 lateral (select case when r.rn = 2 then r.high > r.h1 else r.up end as up, case when r.rn = 2 then (case when r.high > r.h1 then r.high else r.low end) else r.ep end as ep, case when r.rn = 2 then (case when r.high > r.h1 then r.l1 else r.h1 end) else r.sar end as sar, case when r.rn = 2 then 0.02 else r.af end as af) s,
 lateral (select case when s.up then least(s.sar + s.af * (s.ep - s.sar), w.l1, w.l2) else greatest(s.sar + s.af * (s.ep - s.sar), w.h1, w.h2) end as n) t,
 lateral (select case when s.up then w.low < t.n else w.high > t.n end as flip) f,
 lateral (select case when f.flip then not s.up else s.up end as up1, case when f.flip then s.ep else t.n end as sar1,
   case when f.flip then (case when s.up then w.low else w.high end) when s.up and w.high > s.ep then w.high when not s.up and w.low < s.ep then w.low else s.ep end as ep1,
   case when f.flip then 0.02 when (s.up and w.high > s.ep) or (not s.up and w.low < s.ep) then least(s.af + 0.02, 0.2) else s.af end as af1) z)"""
W2 = f"w as (select *, lag(high) over ({PART}) as h1, lag(low) over ({PART}) as l1, lag(high, 2) over ({PART}) as h2, lag(low, 2) over ({PART}) as l2 from b), "
over_bars("ind17_sar", with_bars(W2 + PSAR + " === select b.symbol, b.time, round(r.sar, 6) + 0.0 as sar from b left join r on r.symbol = b.symbol and r.rn = b.rn", recursive=True), sequential.psar, ["sar"])
ST = f"""u as (select *, (high + low) / 2 + 3 * atr as up, (high + low) / 2 - 3 * atr as lo from (select *, {head(ewm_sql('tr', '(1.0/10)'), 10)} as atr from t)),
r as (select symbol, time, rn, up as st from u where rn = 1 union all
 select u.symbol, u.time, u.rn, case when r.st is null then u.up when u.close > r.st then greatest(u.lo, r.st) else least(u.up, r.st) end from r join u on u.symbol = r.symbol and u.rn = r.rn + 1)"""
over_bars("ind21_supertrend", with_bars(T + ST + " === select symbol, time, round(st, 6) + 0.0 as supertrend from r", recursive=True), sequential.supertrend, ["supertrend"])

# patterns
P = f"q as (select *, lag(open) over ({PART}) as po, lag(high) over ({PART}) as ph, lag(low) over ({PART}) as pl, close - open as bd, lag(close - open) over ({PART}) as pb, abs(close - open) as sz, nullif(high - low, 0) as rg, high - greatest(open, close) as uw, least(open, close) - low as lw, {TR} as tr from b), qa as (select *, nullif({full('avg', 'tr', 14)}, 0) as atr, nullif({full('avg', 'sz', 20, 5)}, 0) as mb from q),"


def pattern(name, fn, cols, exprs, pre="", where="qa"):
    flags(name, fn, cols, exprs, P + pre, where)


pattern("pat01_engulf", pat.engulf, ["engulf_bull", "engulf_bear"], ["pb < 0 and close > po and open < pc", "pb > 0 and close < po and open > pc"])
pattern("pat02_doji", pat.doji, ["doji"], ["sz / atr <= 0.1 and sz / rg <= 0.2"])
pattern("pat03_pin", pat.pin, ["pin_bull", "pin_bear"], ["lw >= 2 * sz and uw <= sz", "uw >= 2 * sz and lw <= sz"])
pattern("pat04_hammer_star", lambda d: pat.hammer_star(d, 0.05), ["hammer_star_bull", "hammer_star_bear"], ["lw >= 2 * sz and uw <= 1.25 * sz and sz / rg >= 0.05", "uw >= 2 * sz and lw <= 1.25 * sz and sz / rg >= 0.05"])
INS = "least(open, close) >= least(po, pc) and greatest(open, close) <= greatest(po, pc)"
pattern("pat05_harami", pat.harami, ["harami_bull", "harami_bear"], [f"bd > 0 and pc < po and {INS}", f"bd < 0 and pc > po and {INS}"])
pattern("pat06_inside_outside", lambda d: pat.inside_outside(d, 0.5), ["inside_bar", "outside_bar"], ["high <= ph and low >= pl and high - low >= 0.5 * atr", "high >= ph and low <= pl and high - low >= 0.5 * atr"])
pattern("pat07_marubozu", lambda d: pat.marubozu(d, 0.3), ["marubozu_bull", "marubozu_bear"], ["bd > 0 and (uw + lw) / rg <= 0.3", "bd < 0 and (uw + lw) / rg <= 0.3"])
pattern("pat08_tweezer", lambda d: pat.tweezer(d, 0.01), ["tweezer_top", "tweezer_bottom"], ["abs(high - ph) <= 0.01 * abs(ph)", "abs(low - pl) <= 0.01 * abs(pl)"])
pattern("pat08_tweezer_adaptive", lambda d: pat.tweezer(d, None, 0.5), ["tweezer_top", "tweezer_bottom"], ["abs(high - ph) <= 0.5 * atr / nullif((high + low) / 2, 0) * abs(ph)", "abs(low - pl) <= 0.5 * atr / nullif((high + low) / 2, 0) * abs(pl)"])
ST3 = "s3 as (select *, coalesce(bd > 0 and sz / mb >= 0.2, false) as su, coalesce(bd < 0 and sz / mb >= 0.2, false) as sd from qa),"
pattern("pat09_soldiers_crows", pat.soldiers_crows, ["three_bull", "three_bear"], [f"{c} and lag({c}) over ({PART}) and lag({c}, 2) over ({PART})" for c in ("su", "sd")], ST3, "s3")
MS = f"(lag(open, 2) over ({PART}) + lag(close, 2) over ({PART})) / 2"
pattern("pat10_star", pat.star, ["morning_star", "evening_star"], [f"lag(bd, 2) over ({PART}) < 0 and abs(pb) / atr <= 0.3 and bd > 0 and close > {MS}", f"lag(bd, 2) over ({PART}) > 0 and abs(pb) / atr <= 0.3 and bd < 0 and close < {MS}"])
OKB = "abs(pb) / mb >= 0.2 and sz / mb >= 0.2"
pattern("pat11_piercing_dark", pat.piercing_dark, ["piercing", "dark_cloud"], [f"pc < po and bd > 0 and close >= (po + pc) / 2 and open < pc and {OKB}", f"pc > po and bd < 0 and close <= (po + pc) / 2 and open > pc and {OKB}"])
pattern("pat12_belt", lambda d: pat.belt(d, 0.2), ["belt_bull", "belt_bear"], ["(open - low) / rg <= 0.2 and bd > 0", "(high - open) / rg <= 0.2 and bd < 0"])


# a symbol's bars cut into ranges, each a task's: the same values as over whole symbols
RANGE, M1_US = 500, 60_000_000
over_bars("rng01_bbands", with_bars("select symbol, time, " + ", ".join([r6(full("avg", "close", 20), "bb_mid"), r6(f"{full('avg', 'close', 20)} + 2 * {full('stddev_pop', 'close', 20)}", "bb_up")]) + " from b", M1_US), lambda b: ranges.over_ranges(b, ind.bbands, 20, RANGE), ["bb_mid", "bb_up"], "M1")
over_bars("rng02_ewm", with_bars("select symbol, time, " + r6(ewm_sql("close", "(2.0/21)"), "mean") + " from b", M1_US), lambda b: ranges.ewm_over_ranges(b, {"mean": ("close", 2.0 / 21)}, RANGE), ["mean"], "M1")
over_bars("rng03_asof", with_bars(f"r as (select * from b where close > 50), === select b.symbol, b.time, " + r6("r.close", "last_high") + " from b asof left join r on b.symbol = r.symbol and b.time >= r.time", M1_US), lambda b: ranges.asof_over_ranges(b, b.where("close > 50").withColumnRenamed("close", "last_high"), ["last_high"], rows=RANGE), ["last_high"], "M1")
