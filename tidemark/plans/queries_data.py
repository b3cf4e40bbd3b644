"""Queries of bars, joins, time features, news, windows and relational operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timeparts as tp
from ..operators import asof as joins
from ..operators import news
from ..sources import bars as src
from .catalog import bars, events, out, over_bars, query, r6, symbols, with_bars

PART = "partition by symbol order by time"
OHLCV = ["open", "high", "low", "close", "volume"]
SHOW = "symbol, time, " + ", ".join(r6(c, c) for c in OHLCV[:4]) + ", volume"
DAY_US = 86_400_000_000


@query("agg01_resample_ticks", with_bars(f"select {SHOW} from b"))
def resample_ticks(spark: SparkSession, d: str) -> DataFrame:
    return out(bars(spark, d), "symbol", "time", *OHLCV)


def higher(width: str) -> str:
    return f"h as (select symbol, make_timestamp(((epoch_us(time) + {width} - 1) // {width}) * {width}) as time, first(open order by time) as open, max(high) as high, min(low) as low, last(close order by time) as close, cast(sum(volume) as bigint) as volume from bars group by 1, 2),"


over_bars("agg01_resample_bars", with_bars(higher(str(DAY_US)) + f" === select {SHOW} from h"), lambda b: src.resample(b, "D1"), OHLCV)
over_bars("agg02_resample_left", with_bars(f"h as (select symbol, time_bucket(interval 1 day, time) as time, max(high) as high, min(low) as low from bars group by 1, 2), === select symbol, time, {r6('high', 'high')}, {r6('low', 'low')} from h"), lambda b: src.resample(b, "D1", "left"), ["high", "low"])


@query("agg03_daily_range", with_bars(f"select symbol, cast(time as date) as day, {r6('max(high)', 'hi')}, {r6('min(low)', 'lo')}, {r6('first(close order by time)', 'first_close')} from bars group by 1, 2"))
def daily_range(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    return out(b.groupBy("symbol", F.to_date("time").alias("day")).agg(F.max("high").alias("hi"), F.min("low").alias("lo"), F.min_by("close", "time").alias("first_close")))


over_bars("agg05_daily_running", with_bars("select symbol, time, cast(sum(volume) over (partition by symbol, cast(time as date) order by time) as bigint) as volume_day from b"), lambda b: b.withColumn("volume_day", F.sum("volume").over(Window.partitionBy("symbol", F.to_date("time")).orderBy("time"))), ["volume_day"])


@query("agg08_null_counts", "select count(*) filter (where value is null or isnan(value) or isinf(value)) as value_bad, count(*) filter (where props is null) as props_bad, count(*) as n from events")
def null_counts(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return events(spark, d).agg(F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("value_bad"), F.count_if(F.col("props").isNull()).alias("props_bad"), F.count(F.lit(1)).alias("n"))


@query("src01_last_candles", with_bars(f"select {SHOW} from b where symbol = 'click' order by time desc limit 20"))
def last_candles(spark: SparkSession, d: str) -> DataFrame:
    return out(src.last_candles(bars(spark, d), "click", 20), "symbol", "time", *OHLCV)


@query("src02_candles_between", with_bars(f"select {SHOW} from b where symbol = 'click' and time between '2024-01-05' and '2024-01-12'"))
def candles_between(spark: SparkSession, d: str) -> DataFrame:
    return out(src.candles_between(bars(spark, d), "click", "2024-01-05", "2024-01-12"), "symbol", "time", *OHLCV)


over_bars("flt01_time_range", with_bars(f"select symbol, time, {r6('close', 'close')} from b where time between '2024-01-10' and '2024-01-20'"), lambda b: b.where(F.col("time").between("2024-01-10", "2024-01-20")), ["close"])


@query("src10_download_plan", "with s as (select distinct event_type as symbol from events), t as (select unnest(['M15', 'H4', 'D1']) as tf) select symbol, tf, case when tf = 'D1' then 1000 when symbol = 'click' then 5000 else 2000 end as bars from s, t")
def download_plan(spark: SparkSession, d: str) -> DataFrame:
    tfs = spark.createDataFrame([("M15",), ("H4",), ("D1",)], "tf string")
    return src.download_plan(events(spark, d).select(F.col("event_type").alias("symbol")).distinct(), tfs, F.when(F.col("tf") == "D1", 1000).when(F.col("symbol") == "click", 5000).otherwise(2000))


@query("prj01_normalise", "with r as (select event_type as symbol, ts as time, try_cast(value as double) as close, event_id from events), k as (select *, row_number() over (partition by symbol, time order by event_id desc) as n from r) select symbol, time, round(close, 6) + 0.0 as close from k where n = 1")
def normalise(spark: SparkSession, d: str) -> DataFrame:
    """Each symbol's ticks as a raw table of its own."""

    def one(symbol: str) -> DataFrame:
        own = events(spark, d).where(F.col("event_type") == symbol).orderBy("event_id")
        return src.normalise(own.select(F.col("ts").cast("string").alias("Time"), F.col("value").cast("string").alias("CLOSE")), symbol, "TICK")

    return out(reduce(DataFrame.unionByName, map(one, symbols(spark, d))), "symbol", "time", "close")


@query("prj02_prefix", with_bars(f"select symbol, time, {r6('close', 'H4_close')}, {r6('open', 'H4_open')} from b"))
def prefix(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    return out(b.select("symbol", "time", *[F.col(c).alias(f"H4_{c}") for c in ("open", "close")]))


@query("rel03_keep_last", "with k as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) select user_id, event_id, event_type from k where n = 1")
def keep_last(spark: SparkSession, d: str) -> DataFrame:
    return src.keep_last(events(spark, d), ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_id", "event_type")


@query("snk01_merge_append", with_bars("k as (select symbol, time, case when time > '2024-01-10' then close + 1 else close end as close from b), === select symbol, time, " + r6("close", "close") + " from k"))
def merge_append(spark: SparkSession, d: str) -> DataFrame:
    """Old candles up to one day, new ones from a day before it on, the new winning where both are."""
    b = bars(spark, d)
    old = b.where("time <= timestamp_ntz '2024-01-12 00:00:00'")
    new = b.where("time > timestamp_ntz '2024-01-10 00:00:00'").withColumn("close", F.col("close") + 1)
    return out(src.merge_append(old, new), "symbol", "time", "close")


@query("snk05_publish", with_bars("select symbol, time, " + r6("close", "close") + ", " + r6("close - open", "body") + " from b"))
def publish(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    return out(src.publish(b.select("symbol", "time", "close"), b.select("symbol", "time", F.col("close"), (F.col("close") - F.col("open")).alias("body"))), "symbol", "time", "close", "body")


QC = f"""s as (select symbol, quantile_cont(dt, 0.5) as md from (select symbol, epoch_us(time) - lag(epoch_us(time)) over ({PART}) as dt from b) group by symbol),
g as (select b.*, epoch_us(time) - lag(epoch_us(time)) over (partition by b.symbol order by time) as dt, md from b join s using (symbol)),"""
over_bars("flt04_quality", with_bars(QC + " === select symbol, time, cast(coalesce(dt > 5 * md, false) as integer) as qc_gap, cast(coalesce(abs(close / nullif(pc, 0) - 1) > 0.05, false) as integer) as qc_spike, cast(coalesce(dt = 0, false) as integer) as qc_stale from g"), tp.quality, ["qc_gap", "qc_spike", "qc_stale"])
MIN = "(hour(time) * 60 + minute(time))"
over_bars("flt03_sessions", with_bars(f"select symbol, time, cast({MIN} between 0 and 480 as integer) as session_asia, cast({MIN} between 480 and 960 as integer) as session_london, cast({MIN} between 780 and 1260 as integer) as session_newyork, cast({MIN} >= 1320 or {MIN} <= 120 as integer) as night from b"), lambda b: tp.sessions(b).withColumn("night", tp.in_session("22:00", "02:00").cast("int")), ["session_asia", "session_london", "session_newyork", "night"])
over_bars("tim01_time_features", with_bars("select symbol, time, cast(hour(time) as integer) as hour, cast((dayofweek(time) + 6) % 7 as integer) as dow, " + ", ".join(r6(f"{f}({c} * (2 * pi() / {n}))", f"{o}_{f}") for c, n, o in (("hour(time)", 24, "hour"), ("((dayofweek(time) + 6) % 7)", 7, "dow")) for f in ("sin", "cos")) + " from b"), tp.time_features, ["hour", "dow", "hour_sin", "hour_cos", "dow_sin", "dow_cos"])


@query("tim02_last_closed", "select event_id, make_timestamp((epoch_us(ts) // 14400000000) * 14400000000) as last_closed from events")
def last_closed(spark: SparkSession, d: str) -> DataFrame:
    return out(tp.last_closed(events(spark, d), "H4", "ts"), "event_id", "last_closed")


H = higher(str(DAY_US))
over_bars("jon01_asof", with_bars(H + " === select b.symbol, b.time, " + r6("h.close", "d1_close") + " from b asof left join h on b.symbol = h.symbol and b.time >= h.time"), lambda b: joins.asof(b, src.resample(b, "D1"), ["close"], prefix="d1_"), ["d1_close"])
over_bars("jon02_asof_tolerance", with_bars(H + " === select b.symbol, b.time, " + r6("case when epoch_us(b.time) - epoch_us(h.time) <= 14400000000 then h.close end", "d1_close") + " from b asof left join h on b.symbol = h.symbol and b.time >= h.time"), lambda b: joins.asof(b, src.resample(b, "D1"), ["close"], prefix="d1_", tolerance_us=14_400_000_000), ["d1_close"])
over_bars("jon03_aligned_columns", with_bars("select symbol, time, " + r6("close - open", "body") + ", " + r6("high - low", "span") + " from b"), lambda b: b.select("symbol", "time", (F.col("close") - F.col("open")).alias("body")).join(b.select("symbol", "time", (F.col("high") - F.col("low")).alias("span")), ["symbol", "time"], "left"), ["body", "span"])
over_bars("jon04_daily_to_bars", with_bars("dd as (select symbol, cast(time as date) as day, max(high) as hi from bars group by 1, 2), === select b.symbol, b.time, " + r6("hi", "day_high") + " from b join dd on b.symbol = dd.symbol and cast(b.time as date) = dd.day"), lambda b: b.withColumn("day", F.to_date("time")).join(b.groupBy("symbol", F.to_date("time").alias("day")).agg(F.max("high").alias("day_high")), ["symbol", "day"]), ["day_high"])


def error_calendar(spark: SparkSession, d: str) -> DataFrame:
    """The error events as a calendar: impact by id, windows by impact."""
    e = events(spark, d).where("event_type = 'error'")
    impact = F.when(F.col("event_id") % 3 == 0, "high").when(F.col("event_id") % 3 == 1, "medium").otherwise("low")
    return e.select(F.col("ts").cast("timestamp").alias("time_utc"), impact.alias("impact"), F.lit("USD").alias("currency"), F.concat(F.lit("e"), F.col("event_id")).alias("title"), news.minutes_of(impact, 0).alias("window_before_min"), news.minutes_of(impact, 1).alias("window_after_min"))


CAL = """n as (select ts, event_id, case event_id % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as impact, case event_id % 3 when 0 then 30 when 1 then 15 else 0 end as bm, case event_id % 3 when 0 then 15 when 1 then 10 else 0 end as am from events where event_type = 'error'),
win as (select ts - to_minutes(bm) as s, ts + to_minutes(am) as e, impact, event_id from n),"""
GATE = CAL + " g as (select symbol, time, max(cast(impact = 'high' as integer)) as frozen, max(cast(impact = 'medium' as integer)) as reduce_risk, count(*) as n_events from b join win on time between s and e group by symbol, time),"
over_gate = with_bars(GATE + " === select b.symbol, b.time, coalesce(frozen, 0) as frozen, coalesce(reduce_risk, 0) as reduce_risk, coalesce(n_events, 0) as n_events, case when frozen = 1 then 'freeze' when reduce_risk = 1 then 'reduce' else 'ok' end as reason from b left join g on b.symbol = g.symbol and b.time = g.time")


@query("jon05_news_gate", over_gate)
def news_gate(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    return out(news.gate(b, error_calendar(spark, d)), "symbol", "time", "frozen", "reduce_risk", "n_events", "reason")


@query("nws05_state_changes", with_bars(GATE + f" st as (select b.symbol, b.time, case when frozen = 1 then 'freeze' when reduce_risk = 1 then 'reduce' else 'ok' end as reason from b left join g on b.symbol = g.symbol and b.time = g.time), c as (select *, lag(reason) over ({PART}) as p from st), === select symbol, time, reason from c where p is null or p <> reason"))
def state_changes(spark: SparkSession, d: str) -> DataFrame:
    return out(news.state_changes(news.gate(bars(spark, d), error_calendar(spark, d))), "symbol", "time", "reason")


@query("nws01_normalise_calendar", "select ts as time_utc, 'USD' as currency, case event_id % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as impact, cast(case event_id % 3 when 0 then 30 when 1 then 15 else 0 end as integer) as window_before_min, event_id::varchar as title from events where event_type = 'error'")
def normalise_calendar(spark: SparkSession, d: str) -> DataFrame:
    raw = events(spark, d).where("event_type = 'error'").select(F.col("ts").cast("string").alias("Time_UTC"), F.lit(" usd ").alias("Country"), F.when(F.col("event_id") % 3 == 0, "High Impact Expected").when(F.col("event_id") % 3 == 1, "**").otherwise("Holiday").alias("Impact"), F.col("event_id").cast("string").alias("Title"))
    return out(news.normalise(raw), "time_utc", "currency", "impact", "window_before_min", "title")


@query("nws02_merge_calendars", "select distinct ts as time_utc, 'e' || event_id as title from events where event_type = 'error'")
def merge_calendars(spark: SparkSession, d: str) -> DataFrame:
    c = error_calendar(spark, d)
    return out(news.merge(c, news.select(c, impacts=["high"])), "time_utc", "title")


@query("flt02_news_filter", "select ts as time_utc, 'e' || event_id as title from events where event_type = 'error' and event_id % 3 in (0, 1) and ts between '2024-01-05' and '2024-01-15'")
def news_filter(spark: SparkSession, d: str) -> DataFrame:
    return out(news.select(error_calendar(spark, d), "2024-01-05", "2024-01-15", ["usd"], ["High", "medium"]), "time_utc", "title")


over_bars("jon07_nearest_level", with_bars("l as (select *, list_sort(list_transform([45.0, 50.0, 55.0, 60.0], lambda v, i: {'d': abs(close - v), 'i': i, 'v': v})) as x from b), === select symbol, time, " + r6("x[1].d", "distance") + ", " + r6("x[1].v", "level") + " from l"), lambda b: b.withColumn("n", joins.nearest(F.col("close"), F.array(*[F.lit(v) for v in (45.0, 50.0, 55.0, 60.0)]))).select("symbol", "time", "n.distance", "n.level"), ["distance", "level"])
over_bars("jon08_stretch", with_bars(H + f""" nb as (select symbol, count(*) as n from b group by symbol), nh as (select symbol, count(*) as m from h group by symbol),
hh as (select symbol, row_number() over ({PART}) - 1 as j, close as hc from h), bb as (select b.symbol, b.time, least((rn - 1) // greatest(1, n // m), m - 1) as j from b join nb using (symbol) join nh using (symbol)), === select bb.symbol, bb.time, {r6('hc', 'd1_close')} from bb left join hh on bb.symbol = hh.symbol and bb.j = hh.j"""), lambda b: joins.stretch(b, src.resample(b, "D1"), "close", "d1_close"), ["d1_close"])


@query("jon06_fill_ranges", with_bars("leg as (select symbol, (rn - 1) // 10 as leg, min(rn) as s, min(rn) + 7 as e, first(close order by rn) as lv from b group by 1, 2), === select b.symbol, b.time, " + r6("lv", "level") + " from b left join leg on b.symbol = leg.symbol and b.rn >= s and b.rn < e"))
def fill_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Legs of ten bars, of which the first seven carry the leg's opening close."""
    from ..functions.frames import by_time

    b = bars(spark, d).withColumn("pos", F.row_number().over(by_time()))
    legs = b.groupBy("symbol", F.floor((F.col("pos") - 1) / 10).alias("leg")).agg(F.min("pos").alias("start_pos"), (F.min("pos") + 7).alias("end_pos"), F.min_by("close", "pos").alias("level"))
    return out(joins.fill_ranges(b, legs, ["level"]), "symbol", "time", "level")


@query("set01_union", with_bars("select symbol, time, " + r6("close", "close") + ", null::double as open from b union all select symbol, time, null, " + r6("open", "open") + " from b"))
def union_all(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    return out(b.select("symbol", "time", "close").unionByName(b.select("symbol", "time", "open"), allowMissingColumns=True))


@query("set02_distinct", "select distinct user_id, event_type from events")
def distinct(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("user_id", "event_type").distinct()


@query("top02_last_per_symbol", with_bars("k as (select *, row_number() over (partition by symbol order by time desc) as n from b), === select symbol, time, " + r6("close", "close") + " from k where n <= 6"))
def last_per_symbol(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.col("time").desc())
    return out(bars(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 6"), "symbol", "time", "close")


@query("src08_symbol_specs", with_bars("sp as (select * from (values ('click', 0.01, 100.0), ('view', 0.001, 10.0)) t(symbol, point, contract_size)), === select b.symbol, b.time, " + r6("close / point * contract_size", "notional") + " from b left join sp using (symbol)"))
def symbol_specs(spark: SparkSession, d: str) -> DataFrame:
    s = src.symbol_specs(spark, {"click": {"point": 0.01, "contract_size": 100}, "view": {"point": 0.001, "contract_size": 10}})
    return out(bars(spark, d).join(F.broadcast(s), "symbol", "left"), "symbol", "time", (F.col("close") / F.col("point") * F.col("contract_size")).alias("notional"))  # two rows


