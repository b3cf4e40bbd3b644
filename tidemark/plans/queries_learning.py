"""Queries of labels, rewards, splits, scaling, windows, metrics, risk, gates and streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions.frames import by_time, running
from ..operators import asof, news
from ..operators import learning as ml
from ..streaming import live
from ..streaming.ordered import stale_ticks
from .catalog import bars, events, ewm_sql, full, out, over_bars, query, r6, shared, win, with_bars
from .queries_indicators import T, head

PART = "partition by symbol order by time"
ATR = T + f" att as (select *, {head(ewm_sql('tr', '(1.0/14)'), 14)} as atr from t),"
#: A position for every bar: long above its 5-bar mean by a share, short below it, else flat.
POS_SQL = f"m as (select *, {full('avg', 'close', 5)} as m5 from b), p as (select *, case when close > m5 * 1.2 then 1.0 when close < m5 * 0.8 then -1.0 else 0.0 end as pos from m),"


def positions(b: DataFrame) -> DataFrame:
    m = F.col("m5")
    return ind.sma(b, n=5, out="m5").withColumn("position", F.when(F.col("close") > m * 1.2, 1.0).when(F.col("close") < m * 0.8, -1.0).otherwise(0.0)).drop("m5")


over_bars("lab01_sign", with_bars(f"y as (select *, cast(coalesce(sign(close - lag(close, 2) over ({PART})), 0) as integer) as y from b), === select symbol, time, coalesce(lag(y) over ({PART}), 0) as label from y"), lambda b: ml.label_sign(b, 2), ["label"])
over_bars("lab02_logret", with_bars(f"y as (select *, ln(close / pc) as l from b), z as (select *, {full('sum', 'l', 3)} as s from y), === select symbol, time, {r6(f'coalesce(lag(s) over ({PART}), 0)', 'label')} from z"), lambda b: ml.label_logret(b, 3), ["label"])
TB = f"""y as (select *, coalesce(ln(close / pc), 0) as l from b), z as (select *, {full('stddev_samp', 'l', 50, 20)} as v0, list(l) over (partition by symbol order by time rows between 1 following and 5 following) as ls from y),
v as (select *, coalesce(v0, first_value(v0 ignore nulls) over (partition by symbol order by time rows between current row and unbounded following)) as v from z),
c as (select *, list_transform(range(1, len(ls) + 1), lambda i: list_sum(ls[1:i])) as cs from v),
h as (select *, coalesce(list_max(cs) >= 1.0 * v, false) as u, coalesce(list_min(cs) <= -1.0 * v, false) as d from c), w as (select *, case when u and not d then 1 when d and not u then -1 else 0 end as y from h),"""
over_bars("lab03_triple_barrier", with_bars(TB + f" === select symbol, time, coalesce(lag(y) over ({PART}), 0) as label from w"), lambda b: ml.triple_barrier(b, 1.0, 1.0, 5, 50), ["label"])
RW = f"r as (select *, lead(close) over ({PART}) as nx, lag(pos) over ({PART}) as pp from p),"
over_bars("rew01_pnl", with_bars(POS_SQL + RW + " === select symbol, time, " + r6("pos * (nx / close - 1)", "reward") + " from r"), lambda b: ml.reward(positions(b)), ["reward"])
over_bars("rew01_logret", with_bars(POS_SQL + RW + " === select symbol, time, " + r6("pos * ln(nx / close)", "reward") + " from r"), lambda b: ml.reward(positions(b), "logret"), ["reward"])
over_bars("rew01_atr_norm", with_bars(ATR + POS_SQL + RW + " === select r.symbol, r.time, " + r6("pos * (nx / r.close - 1) / greatest(atr, 1e-8)", "reward") + " from r join att using (symbol, time) where rn > 14".replace("where rn", "where r.rn")), lambda b: ml.reward(positions(ind.atr(b)), "atr_norm").where("atr is not null"), ["reward"])
over_bars("rew02_step", with_bars(POS_SQL + RW + " === select symbol, time, " + r6("pos * (nx / close - 1) - abs(pos - coalesce(pp, 0)) * 0.001", "reward") + " from r"), lambda b: ml.step_reward(positions(b), 0.0006, 0.0004), ["reward"])
over_bars("spl01_ratio", with_bars("s as (select *, count(*) over (partition by symbol) as n from b), === select symbol, time, case when rn - 1 < greatest(1, floor(n * cast('0.7' as double))) then 'train' when rn - 1 < greatest(greatest(1, floor(n * cast('0.7' as double))) + 1, floor(n * (cast('0.7' as double) + cast('0.15' as double)))) then 'val' else 'test' end as split from s"), ml.ratio_split, ["split"])
over_bars("spl02_dates", with_bars("select symbol, time, case when time between '2024-01-01' and '2024-01-15' then 'train' when time between '2024-01-16' and '2024-01-20' then 'val' end as split from b"), lambda b: ml.date_split(b, {"train": ("2024-01-01", "2024-01-15"), "val": ("2024-01-16", "2024-01-20")}), ["split"])


@query("agg13_split_summary", with_bars("s as (select *, count(*) over (partition by symbol) as n from b), q as (select symbol, time, case when rn - 1 < floor(n * cast('0.7' as double)) then 'train' when rn - 1 < floor(n * (cast('0.7' as double) + cast('0.15' as double))) then 'val' else 'test' end as split from s), === select symbol, split, count(*) as bars, min(time) as start, max(time) as \"end\" from q group by symbol, split"))
def split_summary(spark: SparkSession, d: str) -> DataFrame:
    return out(ml.split_summary(ml.ratio_split(bars(spark, d))))


@query("agg07_scaler_fit", with_bars(f"select {r6('avg(close)', 'close_mean')}, {r6('avg(volume)', 'volume_mean')}, {r6('coalesce(nullif(stddev_samp(close), 0), 1)', 'close_std')}, {r6('coalesce(nullif(stddev_samp(volume), 0), 1)', 'volume_std')} from b"))
def scaler_fit(spark: SparkSession, d: str) -> DataFrame:
    return out(ml.scaler_fit(bars(spark, d), ["close", "volume"]))


over_bars("scl01_scaler_apply", with_bars("s as (select avg(close) as m, stddev_samp(close) as d from b), === select symbol, time, " + r6("(close - m) / d", "close") + ", " + r6("open", "z_open") + " from b, s"), lambda b: ml.scaler_apply(b.select("symbol", "time", "close", F.col("open").alias("z_open")), ml.scaler_fit(b.select("close", F.col("open").alias("z_open")), ["close", "z_open"]), ["close", "z_open"]), ["close", "z_open"])
W3 = "(partition by symbol order by time rows between 2 preceding and current row)"
over_bars("win01_observation", with_bars(f"o as (select *, list(close) over {W3} as c, list(open) over {W3} as o from b), === select symbol, time, " + ", ".join(r6(f"case when len({x}) > {2 - i} then {x}[len({x}) - {2 - i}] else 0 end", f"{n}{i}") for n, x in (("close_", "c"), ("open_", "o")) for i in range(3)) + " from o"), lambda b: ml.observation(b, ["close", "open"], 3).select("symbol", "time", *[F.col("obs")[i][k].alias(f"{n}{i}") for k, n in enumerate(("close_", "open_")) for i in range(3)]), [f"{n}{i}" for n in ("close_", "open_") for i in range(3)])
over_bars("win02_transform_mean", with_bars(f"select symbol, time, {r6(f'avg(close) over {win(4)}', 'close_obs')} from b"), lambda b: ml.transform_obs(b, ["close"], "mean", 4), ["close_obs"])
over_bars("win02_transform_flat", with_bars(f"o as (select *, list(close) over {W3} as c from b), === select symbol, time, " + r6("list_sum(c)", "total") + ", 3 as width from o"), lambda b: ml.transform_obs(b, ["close"], "flat", 3).select("symbol", "time", F.aggregate("obs", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("obs").alias("width")), ["total", "width"])
OE = "e as (select symbol, list_sort(list_distinct([quantile_cont(close, 0.0), quantile_cont(close, 1.0 / 3), quantile_cont(close, 2.0 / 3), quantile_cont(close, 1.0)])) as ed from b group by symbol),"
over_bars("rep01_representation", with_bars(OE + f" === select b.symbol, time, cast(coalesce(close - pc <> 0, true) as integer) as binary_change, least(len(list_filter(ed[2:], lambda v: v < close)), len(ed) - 2)::integer as close from b join e using (symbol)"), lambda b: ml.representation(b.withColumn("binary_change", F.col("close") - F.lag("close").over(by_time())), {"binary_change": "binary", "close": "ordinal3"}), ["binary_change", "close"])

TRADE = POS_SQL + RW + f"""w as (select symbol, time, rn, pos, pos * (nx / close - 1) as reward from r where nx is not null),
n as (select *, case when sign(pos) <> coalesce(lag(sign(pos)) over ({PART}), 0) then 1 else 0 end as nw from w), g as (select *, sum(nw) over ({PART}) as trade from n),
tr as (select symbol, trade, sum(reward) as pnl, count(*) as bars, min(time) as opened, first(sign(pos) order by time) as side from g where pos <> 0 group by symbol, trade),"""


@query("agg11_trades", with_bars(TRADE + " === select symbol, cast(trade as bigint) as trade, " + r6("pnl", "pnl") + ", bars, opened, cast(side as double) as side from tr"))
def trades(spark: SparkSession, d: str) -> DataFrame:
    return out(ml.trades(ml.reward(positions(bars(spark, d))).where("reward is not null")), "symbol", "trade", "pnl", "bars", "opened", "side")


MET = TRADE + f"""eq as (select *, sum(reward) over ({PART}) as eq from w), pk as (select *, max(eq) over ({PART}) as pk from eq),
a as (select symbol, sum(reward) as tot, count(*) as steps, avg(reward) as av, stddev_samp(reward) as sd, max(pk - eq) as dd, max(pk) as top from pk group by symbol),
tt as (select symbol, count(*) as trades, coalesce(sum(pnl) filter (pnl > 0), 0) as wn, coalesce(sum(pnl) filter (pnl < 0), 0) as ls, count(*) filter (pnl > 0) as wins from tr group by symbol),
mm as (select a.symbol, tot, steps, av, coalesce(trades, 0) as trades, coalesce(wins, 0) / greatest(1, coalesce(trades, 0)) as winrate, coalesce(wn / (abs(ls) + 1e-12), 0) as pf, av / (sd + 1e-12) * sqrt(steps) as sharpe, dd / greatest(1, abs(top)) as mdd, coalesce(trades, 0) / (steps * 240 / 1440.0) as turn from a left join tt using (symbol)),"""
MCOLS = [("tot", "total_reward"), ("av", "avg_per_step"), ("winrate", "winrate"), ("pf", "profit_factor"), ("sharpe", "sharpe"), ("mdd", "max_drawdown"), ("turn", "turnover_per_day")]


@query("agg09_metrics", with_bars(MET + " === select symbol, steps, trades, " + ", ".join(r6(e, n) for e, n in MCOLS) + " from mm"))
def metrics(spark: SparkSession, d: str) -> DataFrame:
    return out(ml.metrics(ml.reward(positions(bars(spark, d)))))


LIMITS = {"sharpe": ("sharpe >=", 0.5), "profit_factor": ("profit_factor >=", 1.1), "drawdown": ("max_drawdown <=", 0.9), "turnover": ("turnover_per_day <=", 3.0)}


@query("gat01_gates", with_bars(MET + " f as (select *, list_filter([case when not coalesce(sharpe >= 0.5, false) then 'sharpe' end, case when not coalesce(pf >= 1.1, false) then 'profit_factor' end, case when not coalesce(mdd <= 0.9, false) then 'drawdown' end, case when not coalesce(turn <= 3.0, false) then 'turnover' end], lambda x: x is not null) as fl from mm), === select symbol, array_to_string(fl, ',') as failed, cast(len(fl) = 0 as integer) as passed from f"))
def gates(spark: SparkSession, d: str) -> DataFrame:
    return out(ml.gates(ml.metrics(ml.reward(positions(bars(spark, d)))), LIMITS), "symbol", "failed", "passed")


over_bars("agg10_drawdown", with_bars(f"e as (select *, sum(close - open) over ({PART}) as eq from b), k as (select *, max(eq) over ({PART}) as pk from e), === select symbol, time, " + r6("pk - eq", "drawdown") + " from k"), lambda b: b.withColumn("eq", F.sum(F.col("close") - F.col("open")).over(running())).withColumn("drawdown", F.max("eq").over(running()) - F.col("eq")), ["drawdown"])
over_bars("agg14_norm01", with_bars(f"select symbol, time, {r6('(close - min(close) over ps) / (max(close) over ps - min(close) over ps + 1e-9)', 'whole')}, {r6(f'(close - min(close) over ({PART})) / (max(close) over ({PART}) - min(close) over ({PART}) + 1e-9)', 'so_far')} from b window ps as (partition by symbol)"), lambda b: b.withColumns({"whole": _norm(False), "so_far": _norm(True)}), ["whole", "so_far"])
over_bars("agg15_slippage", with_bars(f"s as (select *, abs(close - open) as sl from b), === select symbol, time, {r6(f'quantile_cont(sl, 0.5) over {win(512)}', 'sl_p50')}, {r6(f'quantile_cont(sl, 0.9) over {win(512)}', 'sl_p90')} from s"), lambda b: ml.slippage_quantiles(b.withColumn("sl", F.abs(F.col("close") - F.col("open"))), "sl"), ["sl_p50", "sl_p90"])


def _norm(causal: bool):
    from ..operators.price_action import norm01

    return norm01(F.col("close"), causal)


@query("agg16_fill_summary", "select event_type, count(*) as attempts, count(*) filter (value >= 50) as opens, count(*) filter (value < 10) as fails, count(*) filter (value >= 10 and value < 50) as closes from events group by event_type")
def fill_summary(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(v >= 50).alias("opens"), F.count_if(v < 10).alias("fails"), F.count_if((v >= 10) & (v < 50)).alias("closes"))


over_bars("rsk01_lots", with_bars(ATR + " s as (select *, case when atr > 0 then 1.5 * atr else 0 end as sd from att), === select symbol, time, " + r6("sd", "stop_distance") + ", " + r6("coalesce(least(greatest(round_even(0.01 * 100000 / (nullif(sd, 0) / 0.01 * 1) / 0.01, 0) * 0.01, 0.01), 5.0), 0.01)", "lots") + " from s"), lambda b: ml.lots(ind.atr(b), F.lit(100000.0)), ["stop_distance", "lots"])
over_bars("rsk02_breach", with_bars(f"e as (select *, 1000 + sum(close - open) over ({PART}) as eq from b), f as (select *, first_value(eq) over (partition by symbol, cast(time as date) order by time) as st, max(eq) over ({PART}) as pk from e), === select symbol, time, cast(st > 0 and (eq - st) / st <= -0.03 as integer) as daily_breach, cast(pk > 0 and (eq - pk) / pk <= -0.10 as integer) as total_breach from f"), lambda b: ml.loss_breach(b.withColumn("equity", 1000 + F.sum(F.col("close") - F.col("open")).over(running()))), ["daily_breach", "total_breach"])
over_bars("rsk03_manage", with_bars(ATR + " === select symbol, time, cast(coalesce((close - open) / 10 >= 1, false) as integer) as breakeven, " + r6("case when atr > 0 then 2 * atr else 0 end", "trail_offset") + ", " + r6("least(greatest(round_even(volume * 0.1 / 0.01, 0) * 0.01, 0.01), 5.0)", "canary_lots") + " from att"), lambda b: ml.manage(ind.atr(b).withColumns({"r_multiple": (F.col("close") - F.col("open")) / 10, "lots": F.col("volume").cast("double")}), trail_mult=2.0), ["breakeven", "trail_offset", "canary_lots"])


# streams: a bounded file source, run to its end, must equal the batch
def _run_stream(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read what it wrote to the shared folder."""
    spark = stream.sparkSession
    at = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    static = events(spark, d)
    path = f"{d}/events.parquet"
    # a file source wants a folder: the table's own, or the folder it lies in narrowed to it
    folder = path if not _is_file(spark, path) else d
    stream = spark.readStream.schema(static.schema)
    return stream.option("pathGlobFilter", os.path.basename(path)).parquet(folder) if folder == d else stream.parquet(folder)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def _ticks_to_their_end(spark: SparkSession, d: str) -> DataFrame:
    """The tick stream and a heartbeat a day after the last tick, so that the watermark passes all of a finished table."""
    columns = ["event_type as symbol", "cast(ts as timestamp) as time", "event_id as seq", "value as price"]
    last = events(spark, d).agg(F.max("ts").cast("timestamp").alias("last")).where("last is not null")
    beat = last.selectExpr("cast(null as string) as symbol", "last + interval 1 day as time", "cast(null as long) as seq", "cast(null as double) as price")
    path = f"{shared(spark)}/heartbeat-{uuid.uuid4().hex}"
    beat.write.parquet(path)
    return _event_stream(spark, d).selectExpr(*columns).unionByName(spark.readStream.schema(beat.schema).parquet(path))


CLOSED = "cl as (select max(ts) - interval 1 microsecond - interval 1 hour as mark from events),"


@query("str09_stream_bars", with_bars(CLOSED + f" === select symbol, time, {', '.join(r6(c, c) for c in ('open', 'high', 'low', 'close'))}, volume from b, cl where time <= mark"))
def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    """Closed bars of the event stream; those the watermark hasn't passed yet are not out."""
    return out(_run_stream(live.stream_bars(_event_stream(spark, d))), "symbol", "time", "open", "high", "low", "close", "volume")


@query("str01_idempotent", "select distinct user_id, event_type, cast(ts as date) as day from events")
def idempotent(spark: SparkSession, d: str) -> DataFrame:
    """Intents that repeat come once; the stream is a day's keys, so the watermark is wider than the data."""
    s = live.intent_id(_event_stream(spark, d).withColumn("day", F.to_date("ts")).withColumn("at", F.col("ts").cast("timestamp")), ["user_id", "event_type", "day"])
    return _run_stream(live.once(s, "at", "365 days")).select("user_id", "event_type", "day")


@query("str03_gates", "select event_id, case when not (hour(ts) * 3600 + minute(ts) * 60 + cast(floor(second(ts)) as integer) between 28800 and 57600) then 'hours' when value > 100 then 'spread' end as reject from events")
def stream_gates(spark: SparkSession, d: str) -> DataFrame:
    e = _event_stream(spark, d).withColumns({"time": F.col("ts").cast("timestamp"), "spread": F.col("value")})
    return _run_stream(live.gated(e, hours=("08:00", "16:00"), max_spread=100.0).select("event_id", "reject"))


@query("str02_news_gate", "with n as (select ts - interval 30 minute as s, ts + interval 15 minute as e, event_id as ev from events where event_type = 'error' and event_id % 3 = 0) select event_id, 'e' || ev as title from events join n on ts between s and e")
def stream_news(spark: SparkSession, d: str) -> DataFrame:
    """A row a pair of a tick and a window. Where both crowd pairs are the square of them, so the stream writes cells and the pairs are listed as they are read."""
    from .queries_data import error_calendar

    def written(df: DataFrame, name: str) -> DataFrame:
        path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    slices = written(asof.interval_slices(news.windows(error_calendar(spark, d).where("impact = 'high'")).select("start", "end", "title")), "windows")
    counts = written(asof.interval_counts(slices), "counts")
    ticks = _event_stream(spark, d).select("event_id", F.col("ts").cast("timestamp").alias("time"))
    return asof.pairs_of(_run_stream(live.news_cells(ticks, slices, counts)), slices).select("event_id", "title")


@query("str05_price_spikes", "with k as (select event_type as symbol, ts, value, lag(value) over (partition by event_type order by ts, event_id) as p from events) select symbol, count(*) as n, sum(cast(coalesce(abs(value - p) > 50, false) as integer)) as spikes from k group by symbol")
def price_spikes(spark: SparkSession, d: str) -> DataFrame:
    return _run_stream(live.price_spikes(_ticks_to_their_end(spark, d), 50.0)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("spike").alias("spikes"))


@query("str04_stale", "with k as (select event_type as symbol, ts, lead(ts) over (partition by event_type order by ts, event_id) as nxt from events) select symbol, ts as time, ts + interval 30 minute as due from k where nxt is null or nxt - ts > interval 30 minute")
def stale(spark: SparkSession, d: str) -> DataFrame:
    """Ticks of a symbol after which none comes for half an hour; a timer finds them, not the next tick."""
    return _run_stream(stale_ticks(_ticks_to_their_end(spark, d), 1800)).select("symbol", F.col("time").cast("timestamp_ntz").alias("time"), F.col("due").cast("timestamp_ntz").alias("due"))


@query("stream_ewm", "with k as (select event_type as symbol, list_reduce(list(value order by ts, event_id), lambda a, v: a * 0.9 + v * 0.1) as ewm, count(*) as n from events group by 1) select symbol, n, round(ewm, 6) + 0.0 as ewm from k")
def stream_ewm(spark: SparkSession, d: str) -> DataFrame:
    """The mean after the last tick of each symbol."""
    done = _run_stream(live.stream_ewm(_ticks_to_their_end(spark, d), 0.1))
    return out(done.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max_by("ewm", F.struct("time", "seq")).alias("ewm")))

