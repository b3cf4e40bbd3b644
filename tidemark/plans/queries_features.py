"""Queries of levels, zones, swings, price action and specs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import patterns as pat
from ..operators import levels, price_action, zones
from ..sources.bars import resample
from . import spec
from .catalog import bars, ewm_sql, full, out, over_bars, query, r6, win, with_bars
from .queries_indicators import RSI_EMA, T, head

PART = "partition by symbol order by time"
ATR = T + f" att as (select *, {head(ewm_sql('tr', '(1.0/14)'), 14)} as atr from t),"


def cast_flags(*cols):
    return ", ".join(f"cast(coalesce({e}, false) as integer) as {n}" for e, n in cols)


# levels
over_bars("lvl01_pivots", with_bars(f"p as (select *, (h + l + c) / 3 as p from (select *, lag(high) over ({PART}) as h, lag(low) over ({PART}) as l, pc as c from b)), === select symbol, time, " + ", ".join(r6(e, n) for e, n in (("p", "pv_p"), ("2 * p - l", "pv_r1"), ("2 * p - h", "pv_s1"), ("p + (h - l)", "pv_r2"), ("p - (h - l)", "pv_s2"), ("h + 2 * (p - l)", "pv_r3"), ("l - 2 * (h - p)", "pv_s3"))) + " from p"), levels.pivots, ["pv_p", "pv_r1", "pv_s1", "pv_r2", "pv_s2", "pv_r3", "pv_s3"])
RL = "f as (select *, floor(first_value(close) over (partition by symbol order by time) / 10.0 + 0.5) * 10 as base from b), g as (select *, list_sort(list_transform(range(-5, 6), lambda k: {'d': abs(close - (base + k * 10)), 'v': base + k * 10}))[1] as n from f),"
over_bars("lvl02_round_levels", with_bars(RL + " === select symbol, time, " + r6("n.v", "round_level") + ", " + r6("n.d", "round_dist") + " from g"), levels.round_levels, ["round_level", "round_dist"])
ADR = """dr as (select symbol, cast(time as date) as day, max(high) - min(low) as r, first(close order by time) as o from bars group by 1, 2),
da as (select *, case when count(r) over w >= 7 then avg(r) over w end as adr from dr window w as (partition by symbol order by day rows between 14 preceding and 1 preceding)),"""
over_bars("lvl04_adr", with_bars(ADR + " === select b.symbol, b.time, " + r6("adr", "adr") + " from b join da on b.symbol = da.symbol and cast(b.time as date) = day"), levels.adr, ["adr"])
over_bars("lvl05_adr_distance", with_bars(ADR + " === select b.symbol, b.time, " + r6("o", "day_open") + ", " + r6("abs(close - o)", "dist_abs") + ", " + r6("100 * abs(close - o) / nullif(adr, 0)", "dist_pct_of_adr") + " from b join da on b.symbol = da.symbol and cast(b.time as date) = day"), levels.adr_distance_to_open, ["day_open", "dist_abs", "dist_pct_of_adr"])
LV = "[close * 0.995, close, close * 1.02, 50.0]"


def lvs():
    return F.array(F.col("close") * 0.995, F.col("close"), F.col("close") * 1.02, F.lit(50.0))


OS = f"q as (select *, abs(close + 0.3) * 0.05 as w, list_transform({LV}, lambda v: abs(close + 0.3 - v)) as ds from b),"
over_bars("lvl06_overlap_simple", with_bars(OS + " === select symbol, time, " + r6("case when list_min(ds) <= w and w > 0 then least(1.0, greatest(0.0, 1 - list_min(ds) / w + 0.1 * (len(list_filter(ds, lambda d: d <= w)) - 1))) else 0.0 end", "score") + " from q"), lambda b: b.withColumn("score", levels.overlap_simple(F.col("close") + 0.3, lvs())), ["score"])
over_bars("lvl07_overlap", with_bars(OS + " === select symbol, time, " + r6("case when list_min(ds) <= w and w > 0 then least(1.0, 1 / (1 + exp(-12 * ((1 - list_min(ds) / w) - 0.5))) + list_sum(list_transform(list_filter(ds, lambda d: d <= w), lambda d: 1 - d / w)) - (1 - list_min(ds) / w)) else 0.0 end", "score") + " from q"), lambda b: b.withColumn("score", levels.overlap(F.col("close") + 0.3, lvs())), ["score"])
SW = "sw as (select *, case when count(close) over p = 5 and count(close) over f = 5 and close >= max(close) over p and close >= max(close) over f then 'H' end as kh, case when count(close) over p = 5 and count(close) over f = 5 and close <= min(close) over p and close <= min(close) over f then 'L' end as kl from b window p as (partition by symbol order by time rows between 5 preceding and 1 preceding), f as (partition by symbol order by time rows between 1 following and 5 following)), s as (select symbol, time, close as price, kh as kind from sw where kh is not null union all select symbol, time, close, kl from sw where kl is not null),"


@query("swg01_swings", with_bars(SW + " === select symbol, time, " + r6("price", "price") + ", kind from s"))
def swings(spark: SparkSession, d: str) -> DataFrame:
    return out(levels.swings(bars(spark, d)), "symbol", "time", "price", "kind")


LEG = SW + "lg as (select symbol, lag(time) over o as t0, time as t1, lag(price) over o as p0, price as p1, lag(kind) over o as k0, kind as k1 from s window o as (partition by symbol order by time, kind)), l2 as (select *, p1 > p0 as up, 100 * abs(p1 - p0) / abs(p0) as len from lg where k0 is not null and k0 <> k1 and p0 <> p1),"


@query("fib04_legs", with_bars(LEG + " === select symbol, t0 as from_time, t1 as to_time, " + r6("p0", "p0") + ", " + r6("p1", "p1") + ", up as leg_up, " + r6("len", "length_pct") + " from l2 where len >= 0.5"))
def legs(spark: SparkSession, d: str) -> DataFrame:
    return out(levels.swing_legs(levels.swings(bars(spark, d)), min_length_pct=0.5))


L3 = LEG + " l3 as (select *, row_number() over (partition by symbol order by t1 desc, t0 desc) as n from l2), lv as (select l3.*, ratio, case when up then greatest(p0, p1) - ratio * abs(p1 - p0) else least(p0, p1) + ratio * abs(p1 - p0) end as price from l3, (select unnest([0.236, 0.382, 0.5, 0.618, 0.786]) as ratio) r where n <= 3),"


@query("fib05_levels", with_bars(L3 + " === select symbol, t1 as to_time, cast(ratio as double) as ratio, " + r6("price", "price") + " from lv"))
def fib_levels(spark: SparkSession, d: str) -> DataFrame:
    return out(levels.leg_levels(levels.swing_legs(levels.swings(bars(spark, d)), 3)), "symbol", "to_time", "ratio", "price")


@query("fib06_golden_zone", with_bars(L3 + " gz as (select symbol, first(price order by abs(ratio - 0.382), price) as a, first(price order by abs(ratio - 0.618), price) as z from lv where n = 1 group by symbol), === select symbol, " + r6("least(a, z)", "golden_low") + ", " + r6("greatest(a, z)", "golden_high") + " from gz"))
def golden_zone(spark: SparkSession, d: str) -> DataFrame:
    return out(levels.golden_zone(levels.leg_levels(levels.swing_legs(levels.swings(bars(spark, d)), 1))))


@query("fib09_ext_targets", with_bars(L3 + " x as (select l3.*, ratio, case when up then greatest(p0, p1) + ratio * abs(p1 - p0) else least(p0, p1) - ratio * abs(p1 - p0) end as tg from l3, (select unnest([1.272, 1.618, 2.0]) as ratio) r where n <= 3), === select symbol, t1 as to_time, cast(ratio as double) as ratio, " + r6("tg", "target") + ", " + r6("abs(tg - p1) / nullif(abs(p1 - p0), 0)", "rr") + " from x"))
def ext_targets(spark: SparkSession, d: str) -> DataFrame:
    return out(levels.ext_targets(levels.swing_legs(levels.swings(bars(spark, d)), 3)), "symbol", "to_time", "ratio", "target", "rr")


@query("fib15_abc", with_bars(SW + " x as (select symbol, time, lag(price, 2) over o as a, lag(price) over o as bb, price as c from s window o as (partition by symbol order by time, kind)), === select symbol, time, cast(ratio as double) as ratio, " + r6("c + ratio * (bb - a)", "price") + " from x, (select unnest([0.618, 1.0, 1.272, 1.618]) as ratio) r where a is not null"))
def abc(spark: SparkSession, d: str) -> DataFrame:
    return out(levels.abc_projections(levels.swings(bars(spark, d))), "symbol", "time", "ratio", "price")


@query("pat14_abcd", with_bars(SW + " z as (select symbol, time, min(price) as price from s group by symbol, time), k as (select *, row_number() over (partition by symbol order by time desc) as n from z), v as (select symbol, max(price) filter (n = 4) as a, max(price) filter (n = 3) as bb, max(price) filter (n = 2) as c, max(price) filter (n = 1) as dd from k where n <= 4 group by symbol), === select symbol, " + r6("abs(dd - c) / nullif(abs(bb - a), 0)", "cd_ab") + ", cast(coalesce(abs(abs(dd - c) / nullif(abs(bb - a), 0) - 1) <= 0.25 and sign(bb - a) = sign(dd - c), false) as integer) as abcd from v"))
def abcd(spark: SparkSession, d: str) -> DataFrame:
    s = levels.swings(bars(spark, d)).groupBy("symbol", "time").agg(F.min("price").alias("price"))
    return out(pat.abcd(s, 0.25), "symbol", "cd_ab", "abcd")


@query("lvl12_fractal_levels", with_bars(SW + " k as (select *, row_number() over (partition by symbol order by time desc, kind) as n from s), === select symbol, round(price, 6) + 0.0 as level from k where n <= 10 group by symbol, price"))
def fractal_levels(spark: SparkSession, d: str) -> DataFrame:
    return out(levels.fractal_levels(bars(spark, d)).select("symbol", F.explode("levels").alias("level")))


over_bars("fib11_rsi_score", with_bars(RSI_EMA + " === select symbol, time, " + r6("greatest(0.0, 1 - abs(rsi - 50) / 20)", "rsi_score") + " from rs where rsi is not null"), lambda b: ind.rsi(b).where("rsi is not null").withColumn("rsi_score", levels.rsi_score(F.col("rsi"))), ["rsi_score"])

# zones
ZONE = {
    "fvg": f"""z1 as (select *, lag(high, 2) over ({PART}) as ph, lag(low, 2) over ({PART}) as pl from att),
z2 as (select *, coalesce(low > ph and low - ph >= atr * 0.5, false) as bu, coalesce(high < pl and pl - high >= atr * 0.5, false) as be from z1),
fvg_z as (select *, case when bu then low when be then pl end as top, case when bu then ph when be then high end as bot from z2),""",
    "sd": f"""y1 as (select *, (high - low) / nullif(atr, 0) as ra from att), y2 as (select *, cast(coalesce(ra <= 0.6, false) as integer) as calm from y1),
y3 as (select *, coalesce(sum(calm) over {win(3)} = 3, false) as base from y2), y4 as (select *, coalesce(lag(base) over ({PART}) and ra >= 1.2, false) as raw from y3),
y5 as (select *, coalesce(lag(raw) over ({PART}), false) as born from y4), sd_z as (select *, case when born then {full('max', 'high', 3)} end as top, case when born then {full('min', 'low', 3)} end as bot from y5),""",
    "ob": f"""o1 as (select *, abs(close - open) as sz, greatest(high - low - abs(close - open), 0) as wk, max(high) over (partition by symbol order by time rows between 5 preceding and 1 preceding) as rh, min(low) over (partition by symbol order by time rows between 5 preceding and 1 preceding) as rl from att),
o2 as (select *, coalesce(sz / nullif(atr, 0) >= 0.6 and wk / nullif(sz, 0) <= 0.6, false) as ok, coalesce(close > rh, false) as up, coalesce(close < rl, false) as dn from o1),
o3 as (select *, last_value(case when ok and close < open then {{'o': open, 'c': close}} end ignore nulls) over ({PART} rows between unbounded preceding and current row) as cu, last_value(case when ok and close > open then {{'o': open, 'c': close}} end ignore nulls) over ({PART} rows between unbounded preceding and current row) as ce from o2),
o4 as (select *, coalesce(lag(up) over ({PART}), false) and cu is not null as b1, coalesce(lag(dn) over ({PART}), false) and ce is not null as b2 from o3),
ob_z as (select *, case when b1 then cu.o when b2 then ce.c end as top, case when b1 then cu.c when b2 then ce.o end as bot from o4),""",
    "ls": """x1 as (select *, max(high) over (partition by symbol order by time rows between 5 preceding and 1 preceding) as rh, min(low) over (partition by symbol order by time rows between 5 preceding and 1 preceding) as rl from att),
x2 as (select *, coalesce(high > rh and close < rh and (high - greatest(open, close)) / nullif(atr, 0) >= 0.5, false) as be, coalesce(low < rl and close > rl and (least(open, close) - low) / nullif(atr, 0) >= 0.5, false) as bu from x1),
ls_z as (select *, case when be then high when bu then rl end as top, case when be then rh when bu then low end as bot from x2),""",
}
ZONE["bf"] = ZONE["ob"] + f"brk as (select *, {' or '.join([f'coalesce(close > lag(top, {k}) over ({PART}), false)' for k in range(1, 6)] + [f'coalesce(close < lag(bot, {k}) over ({PART}), false)' for k in range(1, 6)])} as raw from ob_z), bf_z as (select symbol, time, open, high, low, close, atr, case when raw then greatest(open, close) end as top, case when raw then least(open, close) end as bot from brk),"


def life(n: str) -> str:
    lag = lambda c, k: f"lag({c}, {k}) over ({PART})"
    hit = " or ".join(f"coalesce(low <= {lag('top', k)} and high >= {lag('bot', k)}, false)" for k in (1, 2, 3))
    has = " or ".join(f"({lag('top', k)} is not null and {lag('bot', k)} is not null)" for k in (1, 2, 3))
    return f"""{n}1 as (select *, {hit} as hit, {has} as has, {lag('top', 3)} is not null and {lag('bot', 3)} is not null as old, case {' '.join(f'when {lag("top", k)} is not null then {k}' for k in (1, 2, 3))} end as ag, coalesce({', '.join(lag('top', k) for k in (1, 2, 3))}) as st, coalesce({', '.join(lag('bot', k) for k in (1, 2, 3))}) as sb from {n}_z),
{n}2 as (select *, has and not hit as alive, case when has and not hit then st end as atop, case when has and not hit then sb end as abot, case when has and not hit then ag else 0 end as age from {n}1),
{n}3 as (select *, coalesce(abs(atop - abot) / nullif(atr, 0), 0) as sn, cast(coalesce(low <= atop and high >= abot, false) as integer) as tn from {n}2),
{n}4 as (select *, case when atop is not null then sum(tn) over {win(3)} else 0 end as tc from {n}3),
{n}5 as (select *, 0.5 * sn + 0.3 * (case when age > 0 then 1.0 / (1 + age) else 0 end) + 0.2 * tc / 3 as score from {n}4),"""


for _n, _id in (("fvg", "sra01_fvg"), ("sd", "sra02_supply_demand"), ("ob", "sra03_order_block"), ("ls", "sra04_liq_sweep"), ("bf", "sra05_breaker_flip")):
    _sql = ATR + ZONE[_n] + life(_n) + f" === select symbol, time, {r6('top', _n + '_top')}, {r6('bot', _n + '_bottom')}, cast(alive as integer) as {_n}_alive_n, cast(hit as integer) as {_n}_filled_window, cast(old and not hit as integer) as {_n}_expired_now, {r6('atop', _n + '_active_top')}, {r6('abot', _n + '_active_bottom')}, cast(age as integer) as {_n}_age_bars_est, cast(tc as bigint) as {_n}_touch_count, {r6('score', _n + '_score')} from {_n}5"
    over_bars(_id, with_bars(_sql), (lambda name: lambda b: zones.zone(b, name))(_n), [f"{_n}_{c}" for c in ("top", "bottom", "alive_n", "filled_window", "expired_now", "active_top", "active_bottom", "age_bars_est", "touch_count", "score")])

_names = ["fvg", "sd", "ob", "bf", "ls"]
_eff = "".join(f"{n}6 as (select symbol, time, rn, alive, atop, abot, age, {ewm_sql('score', '(2.0/6)')} as se, max(cast(hit or (old and not hit) as integer)) over {win(3)} as cool from {n}5), " for n in _names if n != "bf")
ZONE["bf"] = ZONE["bf"].replace("select symbol, time, open", "select symbol, time, rn, open")
_fusion = ATR + "".join(ZONE[n] for n in _names if n != "ob") + "".join(life(n) for n in _names) + _eff + f"bf6 as (select symbol, time, rn, alive, atop, abot, age, {ewm_sql('score', '(2.0/6)')} as se, max(cast(hit or (old and not hit) as integer)) over {win(3)} as cool from bf5), " + "".join(f"{n}7 as (select *, case when alive and cool = 0 then se / (1 + age / 5.0) else 0.0 end as e from {n}6), " for n in _names)
_fusion += "u1 as (select fvg7.symbol, fvg7.time, fvg7.rn, greatest(fvg7.e, sd7.e, ob7.e, bf7.e, ls7.e) as s, [" + ", ".join(f"{{'e': {n}7.e, 'off': 1 - cast({n}7.alive as integer), 'age': cast({n}7.age as double), 'i': {i}, 'name': '{n}', 'top': {n}7.atop, 'bot': {n}7.abot}}" for i, n in enumerate(_names)) + "] as pool from fvg7 " + " ".join(f"join {n}7 using (symbol, time)" for n in _names[1:]) + "), "
_fusion += "u2 as (select *, list_sort(list_transform(list_filter(pool, lambda p: abs(p.e - s) <= 0.02), lambda p: {'off': p.off, 'age': p.age, 'i': p.i, 'name': p.name, 'top': p.top, 'bot': p.bot}))[1] as w from u1), u3 as (select *, coalesce(last_value(case when s >= 0.55 and s >= 0.3 then 1 when s < 0.35 or s < 0.3 then 0 end ignore nulls) over (partition by symbol order by time rows between unbounded preceding and current row), 0) as onn from u2), "
over_bars("sra07_fusion", with_bars(_fusion + " === select symbol, time, " + r6("s", "sr_score_raw") + ", " + r6("case when onn = 1 then s else 0.0 end", "sr_score") + ", " + r6("case when onn = 1 then w.top end", "sr_active_top") + ", " + r6("case when onn = 1 then w.bot end", "sr_active_bottom") + ", cast(onn as integer) as sr_on, w.name as sr_source from u3"), zones.fusion, ["sr_score_raw", "sr_score", "sr_active_top", "sr_active_bottom", "sr_on", "sr_source"])

# price action
Q = lambda c, n, q, least: f"case when count({c}) over {win(n)} >= {least} then quantile_cont({c}, {q}) over {win(n)} end"
REG = T + f"""g1 as (select *, {full('avg', 'tr', 14, 7)} as atr, ({Q('close', 20, 0.75, 10)}) - ({Q('close', 20, 0.25, 10)}) as wd, close - pc as dd from t),
g2 as (select *, wd / (atr + 1e-9) as rel0, tr / (atr + 1e-9) as ratio, {full('sum', 'dd', 12, 6)} as sl from g1),
g3 as (select *, coalesce(rel0, quantile_cont(rel0, 0.5) over (partition by symbol)) as rel, (sl - ({Q('sl', 12, 0.5, 6)})) / nullif(({Q('sl', 12, 0.75, 6)}) - ({Q('sl', 12, 0.25, 6)}), 0) as z0 from g2),
g4 as (select *, case when z0 is not null then abs(least(greatest(z0, -2), 2)) / 2 end as z, (rel - min(rel) over ps) / (max(rel) over ps - min(rel) over ps + 1e-9) as nr, (ratio - min(ratio) over ps) / (max(ratio) over ps - min(ratio) over ps + 1e-9) as nq from g3 window ps as (partition by symbol)),
g5 as (select *, case when nr is not null then least(greatest(1 - nr, 0), 1) end as a0, case when nq is not null then least(greatest(least(greatest(nq, 0), 1) + 0.25 * cast(coalesce(ratio > 1.8, false) as integer), 0), 1) end as b0, case when z is not null then least(greatest(z + 0.15 * cast(z > 0.2 as integer), 0), 1) end as c0 from g4),
g6 as (select *, lag(a0) over ({PART}) as i0, lag(b0) over ({PART}) as i1, lag(c0) over ({PART}) as i2 from g5),"""
over_bars("pa04_regime", with_bars(REG + " === select symbol, time, " + r6("coalesce(i0, 0)", "regime_range") + ", " + r6("coalesce(i1, 0)", "regime_spike") + ", " + r6("coalesce(i2, 0)", "regime_channel") + ", case when i0 is null then 'range' when i1 is null then 'spike' when i2 is null then 'channel' when i0 = greatest(i0, i1, i2) then 'range' when i1 = greatest(i0, i1, i2) then 'spike' else 'channel' end as regime_label, " + r6("coalesce(greatest(i0, i1, i2), 0)", "regime_confidence") + " from g6"), price_action.regime, ["regime_range", "regime_spike", "regime_channel", "regime_label", "regime_confidence"])
FW = "(partition by symbol order by time rows between 1 following and {} following)"
BO = f"""k1 as (select *, {full('max', 'high', 20, 10)} as ru, {full('min', 'low', 20, 10)} as rl from b), k2 as (select *, lag(ru) over ({PART}) as u, lag(rl) over ({PART}) as l from k1),
k3 as (select *, coalesce(close > u, false) as bu, coalesce(close < l, false) as bd from k2),
k4 as (select *, coalesce(bu and min(low) over {FW.format(10)} <= u, false) as rtu, coalesce(bd and max(high) over {FW.format(10)} >= l, false) as rtd, coalesce(bu and min(close) over {FW.format(5)} < u, false) as fu, coalesce(bd and max(close) over {FW.format(5)} > l, false) as fd from k3),"""
over_bars("pa05_breakouts", with_bars(BO + " === select symbol, time, " + r6("ru", "range_upper") + ", " + r6("rl", "range_lower") + ", " + cast_flags(*[(f"lag({a}) over ({PART})", n) for a, n in (("bu", "breakout_up"), ("bd", "breakout_down"), ("rtu", "retest_up"), ("rtd", "retest_down"), ("fu", "fail_break_up"), ("fd", "fail_break_down"))]) + " from k4"), price_action.breakouts, ["range_upper", "range_lower", "breakout_up", "breakout_down", "retest_up", "retest_down", "fail_break_up", "fail_break_down"])
MC = f"""m1 as (select *, cast(coalesce((high - close) / nullif(high - low, 0) <= 0.2, false) as integer) as nh, cast(coalesce((close - low) / nullif(high - low, 0) <= 0.2, false) as integer) as nl, cast(coalesce(low > lag(low) over ({PART}), false) as integer) as hl, cast(coalesce(high < lag(high) over ({PART}), false) as integer) as lh from b),
m2 as (select *, rn - coalesce(max(case when greatest(nh, hl) = 0 then rn end) over ({PART}), 0) as lu, rn - coalesce(max(case when greatest(nl, lh) = 0 then rn end) over ({PART}), 0) as ld, list({{'nh': nh, 'hl': hl, 'nl': nl, 'lh': lh}}) over ({PART} rows between unbounded preceding and current row) as hs from m1),
m3 as (select *, lu >= 3 and lu >= ld as u, not (lu >= 3 and lu >= ld) and ld >= 3 as dn from m2),
m4 as (select *, case when u then lu when dn then ld else 0 end as ln, case when u then 0.5 * list_avg(list_transform(hs[-lu:], lambda x: x.nh)) + 0.5 * list_avg(list_transform(hs[-lu:], lambda x: x.hl)) when dn then 0.5 * list_avg(list_transform(hs[-ld:], lambda x: x.nl)) + 0.5 * list_avg(list_transform(hs[-ld:], lambda x: x.lh)) else 0.0 end as ql from m3),"""
over_bars("pa06_microchannels", with_bars(MC + f" === select symbol, time, {cast_flags((f'lag(u) over ({PART})', 'micro_channel_up'), (f'lag(dn) over ({PART})', 'micro_channel_down'))}, cast(coalesce(lag(ln) over ({PART}), 0) as bigint) as micro_channel_len, {r6(f'coalesce(lag(ql) over ({PART}), 0)', 'micro_channel_quality')} from m4"), lambda b: price_action.microchannels(b).withColumn("micro_channel_len", F.col("micro_channel_len").cast("long")), ["micro_channel_up", "micro_channel_down", "micro_channel_len", "micro_channel_quality"])


def bias(src: str, n: str) -> str:
    return f"{n}a as (select *, close - lag(close) over ({PART}) as dd from {src}), {n}b as (select *, {full('sum', 'dd', 8, 4)} as gr from {n}a), {n}c as (select *, (gr - ({Q('gr', 8, 0.5, 4)})) / nullif(({Q('gr', 8, 0.75, 4)}) - ({Q('gr', 8, 0.25, 4)}), 0) as z from {n}b), {n}d as (select *, case when z is not null then least(greatest(z, -2), 2) / 2 end as bias from {n}c),"


HI = "h as (select symbol, make_timestamp(((epoch_us(time) + 86400000000 - 1) // 86400000000) * 86400000000) as time, last(close order by time) as close from bars group by 1, 2),"
MT = HI + bias("b", "lo") + bias("h", "hi") + f"""j1 as (select lod.symbol, lod.time, lod.bias as bl, hid.bias as bh from lod asof left join hid on lod.symbol = hid.symbol and lod.time >= hid.time),
j2 as (select *, cast(sign(coalesce(bl, 0)) * sign(coalesce(bh, 0)) < 0 as integer) as cf, least(greatest(1 - abs(coalesce(bl, 0) - coalesce(bh, 0)) / 2, 0), 1) as cn from j1), j3 as (select symbol, time, lag(bl) over ({PART}) as bl, lag(bh) over ({PART}) as bh, coalesce(lag(cf) over ({PART}), 0) as cf, coalesce(lag(cn) over ({PART}), 0.5) as cn, coalesce(lag(abs(bh)) over ({PART}), 0) as sg from j2),"""
over_bars("pa07_mtf_context", with_bars(MT + " === select symbol, time, " + r6("bh", "mtf_bias") + ", " + r6("bl", "mtf_bias_local") + ", cf as mtf_conflict, " + r6("cn", "mtf_confluence_score") + ", " + r6("sg", "mtf_strength") + " from j3"), lambda b: price_action.mtf_context(b, resample(b, "D1")), ["mtf_bias", "mtf_bias_local", "mtf_conflict", "mtf_confluence_score", "mtf_strength"])
CO = MT + BO + f"""kk as (select symbol, time, {', '.join(f'coalesce(cast(lag({a}) over ({PART}) as integer), 0) as {a}' for a in ('bu', 'bd', 'rtu', 'rtd', 'fu', 'fd'))} from k4),
c1 as (select j3.*, least(greatest(0.2 * bu + 0.2 * bd + 0.1 * rtu + 0.1 * rtd - 0.15 * fu - 0.15 * fd, 0), 1) as ex, least(greatest(least(greatest(cn * 0.8 - 0.5 * cf, 0), 1) + 0.2 * sg, 0), 1) as mt from j3 join kk using (symbol, time)),
c2 as (select *, least(greatest((0.2 * mt + 0.1 * ex) / 1.1, 0), 1) as sc from c1),"""
over_bars("pa10_confluence", with_bars(CO + f" === select symbol, time, {r6(f'lag(mt) over ({PART})', 'conf_components_mtf')}, {r6(f'lag(ex) over ({PART})', 'conf_components_extras')}, {r6(f'coalesce(lag(sc) over ({PART}), 0.5)', 'conf_score')}, cast(coalesce(lag(sc) over ({PART}) >= 0.15, false) as integer) as conf_flag_filter_pass from c2"), lambda b: price_action.confluence(price_action.mtf_context(price_action.breakouts(b), resample(b, "D1")), {"extras": 0.1}, keep=0.15), ["conf_components_mtf", "conf_components_extras", "conf_score", "conf_flag_filter_pass"])
over_bars("pa08_zones", with_bars(ATR + ZONE["sd"] + ZONE["ob"] + life("sd") + life("ob") + " === select sd5.symbol, sd5.time, " + r6("abs(sd5.close - (sd5.atop + sd5.abot) / 2) / nullif(sd5.atr, 0)", "dist_to_sd") + ", " + r6("abs(ob5.close - (ob5.atop + ob5.abot) / 2) / nullif(ob5.atr, 0)", "dist_to_ob") + " from sd5 join ob5 using (symbol, time)"), lambda b: price_action.zone_features(ind.atr(b)), ["dist_to_sd", "dist_to_ob"])
over_bars("pa09_imbalance", with_bars(ATR + ZONE["fvg"] + ZONE["ls"] + life("fvg") + " lt as (select symbol, time, lag(bu and not be) over (partition by symbol order by time) as su, lag(be) over (partition by symbol order by time) as se from ls_z), === select fvg5.symbol, fvg5.time, " + r6("abs(close - (atop + abot) / 2) / nullif(atr, 0)", "dist_to_fvg_mid") + ", " + cast_flags(("su", "sweep_up"), ("se", "sweep_down")) + " from fvg5 join lt using (symbol, time)"), lambda b: price_action.imbalance_features(ind.atr(b)), ["dist_to_fvg_mid", "sweep_up", "sweep_down"])


@query("agg12_flag_rates", with_bars(f"q as (select *, lag(open) over ({PART}) as po, lag(close - open) over ({PART}) as pb from b), r as (select avg(cast(coalesce(pb < 0 and close > po and open < pc, false) as integer)) as a, avg(cast(coalesce(pb > 0 and close < po and open > pc, false) as integer)) as z from q), === select 'engulf_bull' as flag, {r6('a', 'rate')} from r union all select 'engulf_bear', {r6('z', 'rate')} from r"))
def flag_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of pattern flags, highest first; a report of the top 15."""
    df = pat.engulf(bars(spark, d))
    flags = ["engulf_bull", "engulf_bear"]
    one = df.agg(*[F.avg(c).alias(c) for c in flags])
    return out(one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("rate")) for c in flags])).alias("x")).select("x.*").orderBy(F.col("rate").desc(), "flag").limit(15))


# specs
SPECS = ["sma(close,20)@H4", "rsi(14)@D1", "bbands(close,20,2)", "donchian(10)@D1"]
SP = "h as (select symbol, make_timestamp(((epoch_us(time) + 86400000000 - 1) // 86400000000) * 86400000000) as time, max(high) as high, min(low) as low, last(close order by time) as close from bars group by 1, 2), hh as (select *, lag(close) over (partition by symbol order by time) as pc, row_number() over (partition by symbol order by time) as rn from h), " + RSI_EMA.replace("from b)", "from hh)") + f" hf as (select *, {full('max', 'high', 10)} as du, {full('min', 'low', 10)} as dl from rs), lo as (select *, {full('avg', 'close', 20)} as m, {full('stddev_pop', 'close', 20)} as sd from b),"


@query("spec_features", with_bars(SP + " === select lo.symbol, lo.time, " + ", ".join(r6(e, n) for e, n in (("m", "sma_20"), ("hf.rsi", "rsi_d1"), ("m + 2 * sd", "bb_up"), ("du", "don_up_d1"), ("dl", "don_low_d1"))) + " from lo asof left join hf on lo.symbol = hf.symbol and lo.time >= hf.time"))
def spec_features(spark: SparkSession, d: str) -> DataFrame:
    f = spec.run_specs(bars(spark, d), SPECS, "H4")
    return out(f.select("symbol", "time", F.col("`__sma@H4__sma_close_20`").alias("sma_20"), F.col("`__rsi@D1__rsi_14`").alias("rsi_d1"), F.col("`__bbands@H4__bb_up_close_20_2`").alias("bb_up"), F.col("`__donchian@D1__don_up_10`").alias("don_up_d1"), F.col("`__donchian@D1__don_low_10`").alias("don_low_d1")))


@query("agg06_feature_metadata", with_bars(f"m as (select *, {full('avg', 'close', 20)} as sma from b), === select 'sma' as \"column\", min(time) filter (sma is not null) as first_valid, cast(min(rn - 1) filter (sma is not null) as integer) as warmup, {r6('avg(cast(sma is not null as double))', 'coverage')} from m"))
def feature_metadata(spark: SparkSession, d: str) -> DataFrame:
    return out(spec.metadata(ind.sma(bars(spark, d)), ["sma"]))




#: Twelve indicators on eight timeframes of M15 bars.
MATRIX = [f"{s}@{tf}" for tf in ("M15", "M30", "H1", "H2", "H4", "H8", "D1", "W1") for s in ("sma(close,20)", "ema(close,20)", "wma(close,10)", "rsi(14)", "roc(10)", "atr(14)", "bbands(close,20,2)", "stoch(14,3)", "cci(20)", "wr(14)", "donchian(20)", "adx(14)")]


@query("prj03_tf_view", with_bars("select symbol, time, " + ", ".join(r6(c, c) for c in ("open", "high", "low", "close")) + " from b"))
def tf_view(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    wide = b.select("symbol", "time", *[F.col(c).alias(f"H4_{c}") for c in ("open", "high", "low", "close")], F.col("close").alias("D1_close"))
    return out(spec.tf_view(wide, spec.timeframes_in(wide.columns)[0]))


@query("prj06_clean", "select event_id, case when value < 1 or value > 150 then null else round(value, 6) + 0.0 end as value from events")
def clean_values(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.frames import clean
    from .catalog import events

    v = F.col("value")
    return out(events(spark, d).select("event_id", clean(F.when(v < 1, float("nan")).when(v > 150, float("inf")).otherwise(v)).alias("value")))


@query("src11_covered_features", with_bars(f"m as (select *, {full('avg', 'close', 20)} as s20, {full('avg', 'close', 2)} as s2 from b), === select 'sma_2' as \"column\", {r6('avg(cast(s2 is not null as double))', 'coverage')} from m having avg(cast(s2 is not null as double)) >= 0.95 union all select 'sma_20', {r6('avg(cast(s20 is not null as double))', 'coverage')} from m having avg(cast(s20 is not null as double)) >= 0.95"))
def covered_features(spark: SparkSession, d: str) -> DataFrame:
    f = ind.sma(ind.sma(bars(spark, d), n=20, out="sma_20"), n=2, out="sma_2")
    return out(spec.metadata(f, ["sma_2", "sma_20"]).where(F.round("coverage", 12) >= 0.95).select("column", "coverage"))


@query("fib03_last_leg", with_bars(L3 + " === select symbol, t0 as from_time, t1 as to_time, " + r6("p0", "p0") + ", " + r6("p1", "p1") + " from l3 where n = 1"))
def last_leg(spark: SparkSession, d: str) -> DataFrame:
    return out(levels.swing_legs(levels.swings(bars(spark, d)), 1), "symbol", "from_time", "to_time", "p0", "p1")


over_bars("fib14_enhanced_score", with_bars(ADR + f" s1 as (select *, {head(ewm_sql('close', '(2.0/21)'), 9)} as m from b), s2 as (select *, (m - lag(m) over ({PART})) / (({full('stddev_samp', 'close', 20, 10)}) + 1e-12) as sl from s1), === select s2.symbol, s2.time, " + r6("50 + 10 * tanh(abs(sl) / nullif(adr, 0))", "score") + " from s2 join da on s2.symbol = da.symbol and cast(s2.time as date) = day"), lambda b: levels.adr(ind.ma_slope(b)).withColumn("score", levels.enhanced_score(F.lit(50.0), F.col("ma_slope"), F.col("adr"))), ["score"])
over_bars("pa12_confluence_additive", with_bars(CO.replace("/ 1.1, 0), 1) as sc", "/ 1.0, 0), 1) as sc") + f" === select symbol, time, {r6(f'coalesce(lag(sc) over ({PART}), 0.5)', 'conf_score')} from c2"), lambda b: price_action.confluence(price_action.mtf_context(price_action.breakouts(b), resample(b, "D1")), {"extras": 0.1}, extras_mode="additive"), ["conf_score"])
