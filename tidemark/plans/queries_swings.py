"""Queries of the zigzag, of what is built from its legs, of clusters, and of the chains over many features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..operators import levels, price_action, zigzag
from ..sources.bars import resample
from . import spec
from .catalog import bars, ewm_sql, full, out, over_bars, query, r6, win, with_bars
from .queries_features import ATR, BO, MC, MT, PART, REG, SW, ZONE, cast_flags, life
from .queries_indicators import RSI_EMA, T, head

SMALL = {"depth": 5, "backstep": 3}


def after(n: int) -> str:
    return f"(partition by symbol order by time rows between 1 following and {n} following)"


def zigzag_sql(src: str, n: str, depth: int, backstep: int, margin: float = 0.05) -> str:
    """Tables {n}s (states of the rows of src) and {n}l (legs)."""
    return f"""
{n}1 as (select *, row_number() over ({PART}) - 1 as pos from {src}),
{n}2 as (select *, case when pos >= {depth - 1} then min(low) over {win(depth)} end as bl, case when pos >= {depth - 1} then max(high) over {win(depth)} end as bh from {n}1),
{n}3 as (select *, low = bl and not coalesce(min(case when low - bl <= {margin} then bl end) over {after(backstep)} < low, false) as cl,
  high = bh and not coalesce(max(case when bh - high <= {margin} then bh end) over {after(backstep)} > high, false) as ch from {n}2),
{n}4 as (select *, case when cl and not ch then 1 when ch and not cl then -1 end as one, sum(cast(cl and ch as integer)) over ({PART}) as flips from {n}3 where cl or ch),
{n}5 as (select *, last_value(case when one is not null then {{'one': one, 'flips': flips}} end ignore nulls) over ({PART} rows between unbounded preceding and current row) as f from {n}4),
{n}6 as (select *, coalesce(f.one, -1) * case when (flips - coalesce(f.flips, 1)) % 2 = 0 then 1 else -1 end as kind from {n}5),
{n}7 as (select *, kind is distinct from lag(kind) over ({PART}) as turn from {n}6),
{n}8 as (select *, sum(cast(turn as integer)) over ({PART}) as run from {n}7),
{n}9 as (select *, row_number() over (partition by symbol, run order by case when kind = 1 then low else -high end, time) as k from {n}8),
{n}s as (select a.*, coalesce(z.kind, 0) as st, case when z.kind = -1 then a.high when z.kind = 1 then a.low end as x from {n}1 a left join (select symbol, time, kind from {n}9 where k = 1) z using (symbol, time)),
{n}w as (select symbol, row_number() over ({PART}) - 1 as leg, time as t0, pos as p0, st, x as x0, lead(time) over ({PART}) as t1, lead(pos) over ({PART}) as p1, lead(x) over ({PART}) as x1 from {n}s where st <> 0),
{n}l as (select * from {n}w where p1 is not null),
{n}e as (select l.* replace (case when leg = max(leg) over (partition by symbol) then n else p1 end as p1) from {n}l l join (select symbol, max(pos) + 1 as n from {n}1 group by symbol) using (symbol)),"""


ZZ = zigzag_sql("b", "zg", 5, 3)
DAY = "h as (select symbol, make_timestamp(((epoch_us(time) + 86400000000 - 1) // 86400000000) * 86400000000) as time, first(open order by time) as open, max(high) as high, min(low) as low, last(close order by time) as close, sum(volume) as volume from bars group by 1, 2),"


def at_leg(legs: str) -> str:
    """The leg that each row lies in: the latest start at or before it, while its end is not reached."""
    return f"q as (select s.*, case when s.pos < l.p1 then l.st end as d, case when s.pos < l.p1 then l.x0 end as a, case when s.pos < l.p1 then l.x1 end as e from zgs s asof left join {legs} l on s.symbol = l.symbol and s.pos >= l.p0),"


def states(spark: SparkSession, d: str) -> DataFrame:
    return zigzag.zigzag(bars(spark, d), **SMALL)


@query("zz01_zigzag", with_bars(ZZ + " === select symbol, time, cast(st as integer) as zz_state, " + r6("case when st = -1 then x end", "zz_high") + ", " + r6("case when st = 1 then x end", "zz_low") + " from zgs"))
def zigzag_states(spark: SparkSession, d: str) -> DataFrame:
    return out(states(spark, d), "symbol", "time", "zz_state", "zz_high", "zz_low")


@query("zz03_legs", with_bars(ZZ + " === select symbol, cast(leg as integer) as leg, t0 as start_time, t1 as end_time, cast(p0 as integer) as start_pos, cast(p1 as integer) as end_pos, cast(st as integer) as direction, " + r6("x0", "start_extr") + ", " + r6("x1", "end_extr") + " from zgl"))
def zigzag_legs(spark: SparkSession, d: str) -> DataFrame:
    return out(zigzag.legs(states(spark, d)))


@query("zz02_zigzag_mtf", with_bars(DAY + zigzag_sql("h", "zg", 3, 10) + " === select b.symbol, b.time, cast(l.st as integer) as htf_direction, " + r6("l.x0", "htf_start_extr") + " from b asof left join zgl l on b.symbol = l.symbol and b.time >= l.t0"))
def zigzag_mtf(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    return out(zigzag.mtf(b.withColumn("time", F.col("time").cast("timestamp")), resample(b, "D1"), depth=3), "symbol", "time", "htf_direction", "htf_start_extr")


@query("lvl08_support_resistance", with_bars(ZZ + at_leg("zge") + " === select symbol, time, " + r6("case when d = 1 then a end", "support") + ", " + r6("case when d = -1 then a end", "resistance") + " from q"))
def support_resistance(spark: SparkSession, d: str) -> DataFrame:
    return out(zigzag.support_resistance(states(spark, d), True), "symbol", "time", "support", "resistance")


@query("lvl09_sr_distance", with_bars(ATR + zigzag_sql("att", "zg", 5, 3) + at_leg("zge") + " === select symbol, time, " + r6("(close - case when d = 1 then a end) / (atr + 1e-8)", "sr_distance") + " from q"))
def sr_distance(spark: SparkSession, d: str) -> DataFrame:
    return out(levels.sr_distance(ind.atr(zigzag.support_resistance(states(spark, d), True))), "symbol", "time", "sr_distance")


@query("lvl10_leg_mask", with_bars(ZZ + at_leg("zgl") + " === select symbol, time, cast(coalesce(d, 0) as integer) as leg_mask from q"))
def leg_mask(spark: SparkSession, d: str) -> DataFrame:
    return out(zigzag.leg_mask(states(spark, d)), "symbol", "time", "leg_mask")


@query("lvl11_fibo", with_bars(ZZ + at_leg("zge") + " === select symbol, time, " + ", ".join(r6(f"e - {r} * (e - a)", f"fib_{str(r).replace('.', '_')}") for r in levels.RATIOS) + " from q"))
def fibo(spark: SparkSession, d: str) -> DataFrame:
    return out(zigzag.fibo(states(spark, d)), "symbol", "time", "fib_0_236", "fib_0_382", "fib_0_5", "fib_0_618", "fib_0_786")


KIND = "(partition by symbol, st order by time)"
PA1 = ZZ + f"""
p1 as (select *, lag(x) over {KIND} as px from zgs where st <> 0),
p2 as (select *, case when st = -1 then case when x > px then 'HH' when x < px then 'LH' end else case when x > px then 'HL' when x < px then 'LL' end end as label from p1),
p3 as (select *, last_value(label ignore nulls) over ({PART} rows between unbounded preceding and 1 preceding) as was from p2),
p4 as (select symbol, time, label, coalesce(label = 'HH' and was in ('HL', 'HH'), false) as bu, coalesce(label = 'LL' and was in ('LH', 'LL'), false) as bd, coalesce(label = 'HH' and was in ('LH', 'LL'), false) as cu, coalesce(label = 'LL' and was in ('HL', 'HH'), false) as cd from p3),
ms as (select s.symbol, s.time, label, cast(coalesce(bu, false) as integer) as bos_up, cast(coalesce(bd, false) as integer) as bos_down, cast(coalesce(cu, false) as integer) as choch_up, cast(coalesce(cd, false) as integer) as choch_down from zgs s left join p4 using (symbol, time)),"""


@query("pa01_market_structure", with_bars(PA1 + f" === select *, cast(coalesce(last_value(case when bos_up + choch_up > 0 then 1 when bos_down + choch_down > 0 then -1 end ignore nulls) over ({PART} rows between unbounded preceding and current row), 0) as integer) as regime from ms"))
def market_structure(spark: SparkSession, d: str) -> DataFrame:
    return out(zigzag.market_structure(states(spark, d)), "symbol", "time", "label", "bos_up", "bos_down", "choch_up", "choch_down", "regime")


# clusters of levels
def levels_sql(src: str, n: str, tf: str) -> str:
    """{n}v: the levels of the last three legs of swings over three bars on both sides."""
    sw = SW.replace("5 preceding and 1 preceding", "3 preceding and 1 preceding").replace("1 following and 5 following", "1 following and 3 following").replace("= 5", "= 3")
    sw = sw.replace("sw as", f"{n}a as").replace("from b window", f"from {src} window").replace(" s as (", f" {n}b as (").replace("from sw ", f"from {n}a ")
    return sw + f"""
{n}c as (select symbol, time as t1, lag(time) over o as t0, lag(price) over o as p0, price as p1, lag(kind) over o as k0, kind as k1 from {n}b window o as (partition by symbol order by time, kind)),
{n}d as (select *, p1 > p0 as up, row_number() over (partition by symbol order by t1 desc, t0 desc) as n from {n}c where k0 is not null and k0 <> k1 and p0 <> p1),
{n}v as (select symbol, '{tf}' as tf, cast(ratio as double) as ratio, case when up then greatest(p0, p1) - ratio * abs(p1 - p0) else least(p0, p1) + ratio * abs(p1 - p0) end as price from {n}d, (select unnest([0.236, 0.382, 0.5, 0.618, 0.786]) as ratio) r where n <= 3),"""


FRACTAL = SW.replace("sw as", "fa as").replace(" s as (", " fb as (").replace("from sw ", "from fa ") + " fk as (select *, row_number() over (partition by symbol order by time desc, kind) as n from fb), sr as (select symbol, list_distinct(list(price)) as lv from fk where n <= 10 group by symbol),"
SLOPE = f"sl1 as (select *, {head(ewm_sql('close', '(2.0/21)'), 9)} as m from b), sl2 as (select *, (m - lag(m) over ({PART})) / (({full('stddev_samp', 'close', 20, 10)}) + 1e-12) as sl from sl1),"
#: A cluster reaches from its first level as far as the tolerance: nxt is where the next one begins.
CLUSTERS = DAY + levels_sql("b", "hf", "H4") + levels_sql("h", "dy", "D1") + FRACTAL + RSI_EMA + SLOPE + """
lv as (select *, row_number() over (partition by symbol order by price, tf, ratio) as i from (select * from hfv union all select * from dyv)),
nx as (select a.symbol, a.i, a.price, min(c.i) as nxt from lv a left join lv c on a.symbol = c.symbol and c.i > a.i and c.price - a.price > a.price * 0.5 / 100 group by all),
st as (select symbol, i, nxt from nx where i = 1 union all select nx.symbol, nx.i, nx.nxt from st join nx on st.symbol = nx.symbol and st.nxt = nx.i),
ls as (select symbol, last(sl order by time) as trend from sl2 group by symbol), lr as (select symbol, last(rsi order by time) as rsi from rs group by symbol),
cx as (select lv.symbol, st.i, avg(price) as price_mean, min(price) as price_min, max(price) as price_max, count(*) as members, list_distinct(list(tf)) as tfs, min(abs(ratio - 0.618)) as off from st join lv on st.symbol = lv.symbol and lv.i >= st.i and (st.nxt is null or lv.i < st.nxt) group by 1, 2),
cy as (select cx.*, (select count(distinct tf) from lv where lv.symbol = cx.symbol) as ntf, list_sum(list_transform(tfs, lambda t: case when t = 'H4' then 2.0 else 2.3 end)) as wt, coalesce(tanh(abs(trend)), 0) as trend_score, case when rsi is null then 0.5 when rsi >= 70 then 1.0 when rsi <= 30 then 0.0 else 0.5 end as rsi_score, abs(price_mean) * 0.05 as wd, coalesce(lv, []) as lv from cx left join ls using (symbol) left join lr using (symbol) left join sr using (symbol)),
cz as (select *, list_transform(lv, lambda v: abs(price_mean - v)) as ds from cy),
ca as (select *, case when len(ds) > 0 and list_min(ds) <= wd and wd > 0 then least(1.0, 1 / (1 + exp(-12 * ((1 - list_min(ds) / wd) - 0.5))) + list_sum(list_transform(list_filter(ds, lambda d: d <= wd), lambda d: 1 - d / wd)) - (1 - list_min(ds) / wd)) else 0.0 end as sr_score from cz),
cl as (select *, 50 * wt / (ntf + 1e-9) + 30 * (1 - least(1.0, off)) + 20 * least(1.0, greatest(0.0, 1 - (price_max - price_min) / (price_min * 0.01 + 1e-9))) + 10 * trend_score + 10 * rsi_score + 10 * sr_score as score from ca),"""
ZONES = CLUSTERS + "tz as (select *, row_number() over (partition by symbol order by score desc, price_mean) as k from cl),"


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    return levels.fibo_pipeline({"H4": b, "D1": resample(b, "D1")}, "H4", 0.5)


@query("fib07_clusters", with_bars(CLUSTERS + " === select symbol, " + ", ".join(r6(c, c) for c in ("price_mean", "price_min", "price_max")) + ", cast(members as integer) as members, " + ", ".join(r6(c, c) for c in ("score", "sr_score", "trend_score")) + " from cl", recursive=True))
def clusters(spark: SparkSession, d: str) -> DataFrame:
    return out(_clusters(spark, d), "symbol", "price_mean", "price_min", "price_max", "members", "score", "sr_score", "trend_score")


@query("top01_top_zones", with_bars(CLUSTERS + " tz as (select *, row_number() over (partition by symbol order by score desc, price_mean) as k from cl where members >= 2), === select symbol, cast(k as integer) as zone_rank, " + r6("price_mean", "price_mean") + ", cast(members as integer) as members, " + r6("score", "score") + " from tz where k <= 10", recursive=True))
def top_zones(spark: SparkSession, d: str) -> DataFrame:
    return out(levels.top_zones(_clusters(spark, d), 10, 2), "symbol", "zone_rank", "price_mean", "members", "score")


TRADE = ZONES + f"""px as (select symbol, last(close order by time) as price, last(atr order by time) as atr from att group by symbol),
ty as (select tz.symbol, k, price_min as lo, price_max as hi, (price_min + price_max) / 2 as mid, price_max - price_min as w, score, members, price, atr from tz join px using (symbol) where k <= 5),
tx as (select *, case when atr > 0 then atr else avg(w) over (partition by symbol) end as a from ty),
tw as (select *, lo - 1.5 * a as lsl, hi + 2.0 * a as ltp, hi + 1.5 * a as ssl, lo - 2.0 * a as stp from tx),"""


@query("fib17_trade_zones", with_bars(ATR + TRADE.replace(T, "") + " === select symbol, cast(k as integer) as zone_rank, " + ", ".join(r6(e, n) for e, n in (("lo", "zone_low"), ("hi", "zone_high"), ("mid", "zone_mid"), ("w", "zone_width"), ("score", "score"))) + ", cast(members as integer) as members, " + r6("abs(mid - price)", "distance_to_price") + ", price between lo - price * 0.2 / 100 and hi + price * 0.2 / 100 as within_proximity, " + ", ".join(r6(e, n) for e, n in (("lsl", "long_sl"), ("ltp", "long_tp"), ("(ltp - price) / nullif(price - lsl, 0)", "long_rr"), ("ssl", "short_sl"), ("stp", "short_tp"), ("(price - stp) / nullif(ssl - price, 0)", "short_rr"))) + " from tw", recursive=True))
def trade_zones(spark: SparkSession, d: str) -> DataFrame:
    b = ind.atr(bars(spark, d))
    context = b.groupBy("symbol").agg(F.max_by("close", "time").alias("price"), F.max_by("atr", "time").alias("atr"))
    return out(levels.trade_zones(_clusters(spark, d), context), "symbol", "zone_rank", "zone_low", "zone_high", "zone_mid", "zone_width", "score", "members", "distance_to_price", "within_proximity", "long_sl", "long_tp", "long_rr", "short_sl", "short_tp", "short_rr")


NEAR = ZONES + "nr as (select b.symbol, b.time, b.close, arg_min({'d': abs(close - price_mean), 'm': price_mean, 'lo': price_min, 'hi': price_max, 'n': members, 's': score}, {'d': abs(close - price_mean), 'm': price_mean}) as n from b left join tz on b.symbol = tz.symbol and k <= 20 group by 1, 2, 3),"


@query("fib16_nearest_cluster", with_bars(NEAR + " === select symbol, time, " + r6("n.d", "fib_dist") + ", " + r6("n.m", "fib_level") + ", cast(n.n as integer) as fib_members, " + r6("n.s", "fib_score") + ", cast(coalesce(close between n.lo and n.hi, false) as integer) as fib_inside from nr", recursive=True))
def nearest_cluster(spark: SparkSession, d: str) -> DataFrame:
    return out(levels.nearest_cluster(bars(spark, d), _clusters(spark, d)), "symbol", "time", "fib_dist", "fib_level", "fib_members", "fib_score", "fib_inside")


# chains
IMB = "fvx as (select symbol, time, abs(close - (atop + abot) / 2) / nullif(atr, 0) as df from fvg5), lt as (select symbol, time, coalesce(lag(bu and not be) over (partition by symbol order by time), false) as su, coalesce(lag(be) over (partition by symbol order by time), false) as se from ls_z),"
ZON = "sdx as (select symbol, time, abs(close - (atop + abot) / 2) / nullif(atr, 0) as ds from sd5), obx as (select symbol, time, abs(close - (atop + abot) / 2) / nullif(atr, 0) as dob from ob5),"
CHAIN = ATR + PA1 + ZONE["sd"] + ZONE["ob"] + ZONE["fvg"] + ZONE["ls"] + life("sd") + life("ob") + life("fvg") + ZON + IMB + REG.replace(T, "") + BO + MC + MT + f"""
w1 as (select ms.symbol, ms.time, label, least(1.0, greatest(0.0, 0.5 * bos_up + 0.5 * bos_down + 0.35 * choch_up + 0.35 * choch_down)) as s0, least(1.0, 0.6 * coalesce(1 / (1 + abs(sdx.ds)), 0) + 0.6 * coalesce(1 / (1 + abs(obx.dob)), 0)) as z,
  least(1.0, 0.6 * coalesce(1 / (1 + abs(fvx.df)), 0) + 0.25 * cast(su as integer) + 0.25 * cast(se as integer)) as i,
  least(1.0, greatest(0.0, least(1.0, greatest(0.0, cn * 0.8 - 0.5 * cf)) + 0.2 * sg)) as m, cn, i0, i1, i2, lag(k4.bu) over (partition by ms.symbol order by ms.time) as up, lag(m4.u) over (partition by ms.symbol order by ms.time) as mu
  from ms join sdx using (symbol, time) join obx using (symbol, time) join fvx using (symbol, time) join lt using (symbol, time) join j3 using (symbol, time) join g6 using (symbol, time) join k4 using (symbol, time) join m4 using (symbol, time)),
w2 as (select *, 0.3 * least(1.0, s0 + case when label in ('HH', 'LL') then 0.15 else 0.0 end) + 0.3 * z + 0.2 * i + 0.2 * m as sc from w1),"""
LABEL = "case when i0 is null then 'range' when i1 is null then 'spike' when i2 is null then 'channel' when i0 = greatest(i0, i1, i2) then 'range' when i1 = greatest(i0, i1, i2) then 'spike' else 'channel' end"


@query("pa14_price_action", with_bars(CHAIN + f" === select symbol, time, label as swing_type, {LABEL} as regime_label, {cast_flags(('up', 'breakout_up'), ('mu', 'micro_channel_up'))}, {r6('cn', 'mtf_confluence_score')}, {r6(f'coalesce(lag(sc) over ({PART}), 0.5)', 'conf_score')}, cast(coalesce(lag(sc) over ({PART}) >= 0.35, false) as integer) as conf_flag_filter_pass from w2"))
def price_action_chain(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    b = b.withColumn("time", F.col("time").cast("timestamp"))
    return out(price_action.price_action(b, resample(b, "D1"), **SMALL), "symbol", "time", "swing_type", "regime_label", "breakout_up", "micro_channel_up", "mtf_confluence_score", "conf_score", "conf_flag_filter_pass")


SO_FAR = f"over ({PART} rows between unbounded preceding and current row)"
CAUSAL = REG.replace("coalesce(rel0, quantile_cont(rel0, 0.5) over (partition by symbol)) as rel", f"last_value(rel0 ignore nulls) {SO_FAR} as rel").replace("window ps as (partition by symbol)", "window ps as (partition by symbol order by time)")
over_bars("pa04_regime_causal", with_bars(CAUSAL + f" === select symbol, time, {r6('coalesce(i0, 0)', 'regime_range')}, {r6('coalesce(i1, 0)', 'regime_spike')}, {r6('coalesce(i2, 0)', 'regime_channel')}, {LABEL} as regime_label from g6"), lambda b: price_action.regime(b, causal=True), ["regime_range", "regime_spike", "regime_channel", "regime_label"])

#: Twelve indicators on eight timeframes of M15 bars.
TFS = ("M15", "M30", "H1", "H2", "H4", "H8", "D1", "W1")
TWELVE = ("sma(close,20)", "ema(close,20)", "wma(close,10)", "rsi(14)", "roc(10)", "atr(14)", "bbands(close,20,2)", "stoch(14,3)", "cci(20)", "wr(14)", "donchian(20)", "adx(14)")
MATRIX = [f"{s}@{tf}" for tf in TFS for s in TWELVE]


@query("spec_matrix_12x8")
def spec_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The 12 x 8 workload: one scan and one aggregate a timeframe, one as-of join for all. Its parts have SQL of their own."""
    f = spec.run_specs(bars(spark, d, "M15"), MATRIX, "M15")
    cols = [c for c in f.columns if c.startswith("__")]
    return f.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), *[F.count(F.col(f"`{c}`")).alias(c.strip("_").replace("@", "_").replace("__", "_")) for c in cols])
