"""Queries of stores, configuration, search, positions and the simulator."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import patterns as pat
from ..functions.timeparts import lookback
from ..operators import learning as ml
from ..operators import levels, news, price_action, zones
from ..sources import bars as src
from ..sources import store
from ..streaming import positions as pos
from . import search, spec
from .catalog import SQL, bars, events, full, out, over_bars, query, r6, shared, symbols, with_bars
from .queries_features import ADR, ATR, BO, PART, SW
from .queries_learning import POS_SQL, _event_stream, _run_stream, positions
from .queries_swings import CLUSTERS, _clusters


def place(spark: SparkSession, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


# sources
@query("src03_raw_candles", with_bars("select symbol, 'H4' as tf, time, " + ", ".join(r6(c, c) for c in ("open", "high", "low")) + ", " + r6("close + 1", "close") + ", volume, cast(null as bigint) as spread from b"))
def raw_candles(spark: SparkSession, d: str) -> DataFrame:
    """A raw file a symbol, in which every candle stands twice: the last one read stays."""
    both = bars(spark, d).select("symbol", "time", "open", "high", "low", "close", "volume")
    both = both.withColumn("k", F.lit(0)).unionByName(both.withColumn("close", F.col("close") + 1).withColumn("k", F.lit(1)))
    path = place(spark, "raw")

    def one(symbol: str) -> DataFrame:
        own = f"{path}/{symbol}.csv"
        both.where(F.col("symbol") == symbol).coalesce(1).sortWithinPartitions("k", "time").drop("k", "symbol").write.option("header", True).csv(own)
        return src.read_raw(spark, own, symbol, "H4")

    return out(reduce(DataFrame.unionByName, map(one, symbols(spark, d))), "symbol", "tf", "time", "open", "high", "low", "close", "volume", "spread")


@query("src04_read_processed", with_bars("select symbol, time, " + r6("close", "close") + ", volume from b"))
def read_processed(spark: SparkSession, d: str) -> DataFrame:
    """Parquet first, CSV if there is none; of repeated rows one stays."""
    path = place(spark, "processed")
    b = bars(spark, d)
    b.unionByName(b).write.option("header", True).csv(path)
    held = store.read_processed(spark, f"{path}.parquet", path, key=["symbol", "time"])
    return out(held, "symbol", "time", F.col("close").cast("double").alias("close"), F.col("volume").cast("long").alias("volume"))


def calendar(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where("event_type = 'error'")
    return e.select(F.concat(F.lit("e"), "event_id").alias("Title"), F.lit("usd").alias("Country"), F.date_format("ts", "MM-dd-yyyy").alias("Date"), F.lower(F.date_format("ts", "h:mma")).alias("Time"), F.when(F.col("event_id") % 3 == 0, "High").otherwise("Medium").alias("Impact"))


@query("src05_calendar_file", "select 'e' || event_id as title, date_trunc('minute', ts) as time_utc, 'USD' as currency, case when event_id % 3 = 0 then 'high' else 'medium' end as impact, cast(case when event_id % 3 = 0 then 30 else 15 end as integer) as window_before_min from events where event_type = 'error'")
def calendar_file(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "calendar")
    calendar(spark, d).write.option("header", True).csv(path)
    return out(store.read_calendar(spark, path), "title", "time_utc", "currency", "impact", "window_before_min")


@query("src07_calendar_cache", "select 'absent' as cache, 0 as n union all select 'there', count(*) from events where event_type = 'error'")
def calendar_cache(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "cache")
    news.normalise(calendar(spark, d)).write.parquet(path)
    n = lambda name, p: store.load_calendar_cache(spark, p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("cache"), "n")
    return n("absent", path + "-none").unionByName(n("there", path))


@query("src08_spec_overlay", with_bars("sp as (select * from (values ('click', 0.01, 50.0), ('view', 0.001, 10.0)) t(symbol, point, contract_size)), === select b.symbol, b.time, " + r6("close / point * contract_size", "notional") + " from b left join sp using (symbol)"))
def spec_overlay(spark: SparkSession, d: str) -> DataFrame:
    specs = store.overlay_specs({"click": {"point": 0.01, "contract_size": 100}, "view": {"point": 0.001}}, {"click": {"contract_size": 50, "point": None}, "view": {"contract_size": 10}})
    return out(bars(spark, d).join(F.broadcast(src.symbol_specs(spark, specs)), "symbol", "left"), "symbol", "time", (F.col("close") / F.col("point") * F.col("contract_size")).alias("notional"))  # two rows


# sinks
@query("snk01_merge_counts", with_bars("n as (select symbol, count(*) filter (time < timestamp '2024-01-20') as before, count(*) as after from b group by symbol) === select * from n"))
def merge_counts(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    return store.merge_counted(b.where("time < timestamp '2024-01-20'"), b.where("time >= timestamp '2024-01-15'"))[1]


@query("snk03_manifest", with_bars("select 'v7' as config_version, 'H4,D1' as timeframes, count(*) as \"rows\", cast(7 as integer) as n_columns, cast(min(time) as varchar) as first, cast(max(time) as varchar) as last from b"))
def manifest(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "processed")
    store.save_processed(bars(spark, d), path, version="v7", timeframes=["H4", "D1"])
    m = store.read_json(spark, f"{path}.manifest.json")
    return spark.createDataFrame([(m["config_version"], ",".join(m["timeframes"]), m["rows"], len(m["columns"]), m["first"], m["last"])], "config_version string, timeframes string, rows long, n_columns int, first string, last string")


META = ", ".join(f"select '__{n}' as \"column\", min(time) filter ({c} is not null) as first_valid, cast(min(rn - 1) filter ({c} is not null) as integer) as warmup, {r6(f'avg(cast({c} is not null as double))', 'coverage')} from m" for n, c in (("sma@H4__sma_close_20", "a"), ("roc@H4__roc_5", "z"))).replace(", select", " union all select")


@query("snk04_feature_store", with_bars(f"m as (select *, {full('avg', 'close', 20)} as a, (close / nullif(lag(close, 5) over ({PART}), 0) - 1) * 100 as z from b), === " + META))
def feature_store(spark: SparkSession, d: str) -> DataFrame:
    f = spec.run_specs(bars(spark, d), ["sma(close,20)", "roc(5)"], "H4")
    return out(store.save_features(f, place(spark, "features"), base_tf="H4"))


@query("snk06_families", "select * from (values ('base', 7), ('bbands', 3), ('sma', 1)) t(family, n)")
def families(spark: SparkSession, d: str) -> DataFrame:
    f = spec.run_specs(bars(spark, d), ["sma(close,20)", "bbands(close,20,2)"], "H4")
    return spark.createDataFrame([(k, len(v)) for k, v in store.families(f.columns).items()], "family string, n int")


@query("snk07_trade_log", SQL["agg11_trades"])
def trade_log(spark: SparkSession, d: str) -> DataFrame:
    t = ml.trades(ml.reward(positions(bars(spark, d))).where("reward is not null"))
    held = store.save_trades(t, place(spark, "trades"), "json")
    from .catalog import QUERIES

    return out(held, *QUERIES["agg11_trades"](spark, d).columns)


@query("snk08_split_json", with_bars("s as (select *, count(*) over (partition by symbol) as n from b), q as (select symbol, case when rn - 1 < floor(n * cast('0.7' as double)) then 'train' when rn - 1 < floor(n * (cast('0.7' as double) + cast('0.15' as double))) then 'val' else 'test' end as split from s), === select symbol, split, count(*) as bars from q group by all"))
def split_json(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "split") + ".json"
    store.save_split(ml.split_summary(ml.ratio_split(bars(spark, d))), path, "H4")
    data = store.read_json(spark, path)["symbols"]
    return spark.createDataFrame([(s, k, v["bars"]) for s, parts in data.items() for k, v in parts.items()], "symbol string, split string, bars long")


# plans
@query("prj05_first_column", with_bars("select symbol, time, volume as v from b"))
def first_column(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    return out(b, "symbol", "time", F.col(spec.first_existing(b.columns, ["real_volume", "tick_volume", "volume"])).alias("v"))


@query("prj07_drop_empty", with_bars("select symbol, time, " + r6("close", "close") + " from b"))
def drop_empty(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).select("symbol", "time", "close", F.lit(None).cast("double").alias("hole"))
    return out(spec.drop_empty(b, ["close", "hole"]))


@query("prj08_observation_columns", "select * from (values ('__rsi@H4__rsi_14'), ('__sma@H4__sma_close_20')) t(name)")
def observation_columns(spark: SparkSession, d: str) -> DataFrame:
    f = spec.run_specs(bars(spark, d), ["sma(close,20)", "rsi(14)", "roc(5)"], "H4")
    return spark.createDataFrame([(c,) for c in spec.observation_columns(f.columns, ["_20", "rsi"], ["roc"])], "name string")


@query("prj09_no_volume", "select * from (values ('mfi(14)', 'no volume'), ('none(3)', 'unknown')) t(spec, why)")
def no_volume(spark: SparkSession, d: str) -> DataFrame:
    p = spec.plan(["sma(close,20)", "mfi(14)", "none(3)", "sma(close,20)"], "H4", has_volume=False, strict=False)
    return spark.createDataFrame(sorted(p.skipped.items()), "spec string, why string")


@query("spl03_warmup", with_bars(f"m as (select *, {full('avg', 'close', 20)} as a, {full('avg', 'close', 30)} as z from b), x as (select greatest(min(rn - 1) filter (a is not null), min(rn - 1) filter (z is not null)) as w from m), === select cast(w as integer) as warmup from x"))
def warmup(spark: SparkSession, d: str) -> DataFrame:
    f = ind.sma(ind.sma(bars(spark, d), n=20, out="a"), n=30, out="z")
    return spec.metadata(f, ["a", "z"]).agg(F.max("warmup").alias("warmup"))


@query("tim03_lookback", with_bars("m as (select *, max(time) over (partition by symbol) as t from b), === select symbol, time, " + r6("close", "close") + " from m where time > t - interval 80 hour"))
def last_span(spark: SparkSession, d: str) -> DataFrame:
    """The bars of the last thirty steps, capped at twenty."""
    b = bars(spark, d)
    last = b.groupBy("symbol").agg(F.max("time").alias("t"))
    return out(b.join(F.broadcast(last), "symbol").where(F.unix_micros("t") - F.unix_micros("time") < lookback("H4", 30, 20) * 1_000_000), "symbol", "time", "close")  # a row a symbol


over_bars("pat13_scaled", with_bars("select symbol, time, cast(coalesce((open - low) / nullif(high - low, 0) <= 0.15 and close > open, false) as integer) as belt_bull, cast(coalesce((high - open) / nullif(high - low, 0) <= 0.15 and close < open, false) as integer) as belt_bear from b"), lambda b: pat.belt(b, **pat.scaled(0.5, [("wick", 0.3, 0.05, 0.2)])), ["belt_bull", "belt_bear"])


@query("flt05_cluster_filter", with_bars(CLUSTERS + " === select symbol, " + r6("price_mean", "price_mean") + ", " + r6("score", "score") + " from cl where members >= 2 and score >= 60", recursive=True))
def cluster_filter(spark: SparkSession, d: str) -> DataFrame:
    return out(_clusters(spark, d).where("members >= 2 and score >= 60"), "symbol", "price_mean", "score")


# Fibonacci settings
@query("fib08_tolerance", with_bars(ATR + ADR + " la as (select symbol, last(close order by time) as c, last(atr order by time) filter (atr is not null) as a, last(time order by time) as t from att group by symbol), ld as (select b.symbol, last(adr order by b.time) filter (adr is not null) as r from b join da on b.symbol = da.symbol and cast(b.time as date) = day group by 1) === select symbol, " + r6("coalesce(a / c * 0.5, 0.08)", "atr_tol") + ", " + r6("coalesce(r / c, 0.08)", "adr_tol") + ", cast(0.08 as double) as fixed_tol from la left join ld using (symbol)"))
def tolerance(spark: SparkSession, d: str) -> DataFrame:
    b = levels.adr(ind.atr(bars(spark, d)))
    t = lambda mode, name, mult=1.0: levels.adaptive_tolerance(b, mode, mult=mult).withColumnRenamed("tol_pct", name)
    return out(t("ATR", "atr_tol", 0.5).join(t("ADR", "adr_tol"), "symbol").join(t("FIXED", "fixed_tol"), "symbol"))


FIB = {"features": {"fibonacci": {"low": 0.382, "high": 0.618, "overrides": {"timeframes": {"H4": {"high": 0.65}}, "symbols": {"click": {"low": 0.3, "high": 0.7}}}}}}


@query("fib10_overrides", "select * from (values ('click', cast(0.3 as double), cast(0.7 as double)), ('view', 0.382, 0.65)) t(symbol, low, high)")
def overrides(spark: SparkSession, d: str) -> DataFrame:
    rows = [(s, p["low"], p["high"]) for s in ("click", "view") for p in [search.fib_parameters(FIB, s, "H4")]]
    return spark.createDataFrame(rows, "symbol string, low double, high double")


@query("fib18_abc", with_bars(SW + " x as (select symbol, time, lag(price, 2) over o as a, lag(price) over o as bb, price as c, row_number() over (partition by symbol order by time desc, kind desc) as n from s window o as (partition by symbol order by time, kind)), === select b.symbol, b.time, " + r6("c + 1.0 * (bb - a)", "abc_1_0") + ", " + r6("c + 1.618 * (bb - a)", "abc_1_618") + " from b left join x on b.symbol = x.symbol and n = 1"))
def abc(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    return out(levels.attach_abc(b, levels.swings(b)), "symbol", "time", "abc_1_0", "abc_1_618")


# configuration to operators
CFG = {"features": {"price_action_params": {"common": {"atr_window": 14}, "fvg": {"alive": 9}, "breakouts": {"window": 20, "retest": 3}, "overrides": {"fvg": {"alive": 3}}}}}
over_bars("sra08_configured", SQL["sra01_fvg"], lambda b: zones.zone(b, "fvg", **search.component(CFG, "fvg")), [f"fvg_{c}" for c in ("top", "bottom", "alive_n", "filled_window", "expired_now", "active_top", "active_bottom", "age_bars_est", "touch_count", "score")])
over_bars("pa15_configured", with_bars(BO + " === select symbol, time, " + r6("ru", "range_upper") + f", cast(coalesce(lag(rtu) over ({PART}), false) as integer) as retest_up from k4"), lambda b: price_action.breakouts(b, **{k: v for k, v in search.component(CFG, "breakouts", {"retest": 10}).items() if k != "atr_window"}), ["range_upper", "retest_up"])
over_bars("pa13_signals", with_bars(f"s as (select *, least(1.0, (cast(close > open as integer) + cast(high > 100 as integer)) / 3.0) as st, cast(low < 50 as integer) / 2.0 as z, least(greatest(close / 100, 0), 1) as m, greatest(cast(close > 80 as integer) - 0.5, 0) as ex from b), t as (select *, least(greatest(0.3 * st + 0.3 * z + 0.2 * m + 0.4 * ex, 0), 1) as sc from s), === select symbol, time, {r6(f'lag(sc) over ({PART})', 'conf_score')}, {r6(f'lag(ex) over ({PART})', 'conf_components_extras')}, cast(sc > 0.7 as integer) as conf_flag_strong_entry, cast(sc > 0.5 as integer) as conf_flag_filter_pass from t"), lambda b: price_action.confluence_signals(b.withColumns({"pa_structure_1": F.col("close") > F.col("open"), "pa_structure_2": F.col("high") > 100, "pa_zone_1": F.col("low") < 50, "pa_mtf": F.col("close") / 100, "bo_signal": (F.col("close") > 80).cast("double") - 0.5}), {"extras": 0.4}), ["conf_score", "conf_components_extras", "conf_flag_strong_entry", "conf_flag_filter_pass"])


@query("nws04_config_windows", "select 'e' || event_id as title, date_trunc('minute', ts) - interval 40 minute * cast(event_id % 3 = 0 as integer) - interval 12 minute * cast(event_id % 3 <> 0 as integer) as start from events where event_type = 'error'")
def config_windows(spark: SparkSession, d: str) -> DataFrame:
    w = search.news_windows({"safety": {"news_filter": {"high_impact_freeze_minutes_before": 40, "medium_impact_freeze_minutes_before": 12}}})
    e = news.normalise(calendar(spark, d)).withColumns({f"window_{side}_min": F.coalesce(*[F.when(F.col("impact") == k, F.lit(w[k][i])) for k in ("high", "medium", "low")]) for i, side in enumerate(("before", "after"))})
    return out(news.windows(e), "title", "start")


# search
SPACE = {"n": {"type": "int", "low": 3, "high": 40}, "m": {"type": "choice", "values": [1.0, 2.0]}}
DRAWN = [search.sample(SPACE, 5 + i) for i in range(4)]


@query("hpo01_search", with_bars(" ".join(f"t{i} as (select *, sign(close - ({full('avg', 'close', p['n'])})) * {p['m']} as pos, lead(close) over ({PART}) / nullif(close, 0) - 1 as ret from b)," for i, p in enumerate(DRAWN)) + " === " + " union all ".join(f"select cast({i} as integer) as trial, {r6('sum(pos * ret)', 'value')} from t{i}" for i in range(4))))
def parameter_search(spark: SparkSession, d: str) -> DataFrame:
    """Four trials of a moving average's length and a stake; the value is the sum of returns."""
    run = lambda p: ind.sma(bars(spark, d), n=p["n"]).withColumn("position", F.signum(F.col("close") - F.col("sma")) * p["m"])
    _, trials = search.search(spark, run, lambda df: ml.reward(df).agg(F.sum("reward").alias("value")), SPACE, 4, 5)
    return out(trials, "trial", "value")


SHIFT = "case when {0} > 0.3 then 0.1 when {0} < 0.2 then -0.1 else 0.0 end"


@query("hpo02_rate_shifts", with_bars(f"w as (select high <= lag(high) over ({PART}) and low >= lag(low) over ({PART}) as a, high >= lag(high) over ({PART}) and low <= lag(low) over ({PART}) as z from b), r as (select avg(cast(coalesce(a, false) as integer)) as i, avg(cast(coalesce(z, false) as integer)) as o from w), === select 'inside' as flag, 'min_range_k_atr' as parameter, {r6(SHIFT.format('i'), 'shift')} from r union all select 'outside', 'min_range_k_atr', {r6(SHIFT.format('o'), 'shift')} from r"))
def rate_shifts(spark: SparkSession, d: str) -> DataFrame:
    """How the parameters of two patterns should move, from the rates of their flags."""
    f = bars(spark, d).withColumns({"inside": (F.col("high") <= price_action.prev("high")) & (F.col("low") >= price_action.prev("low")), "outside": (F.col("high") >= price_action.prev("high")) & (F.col("low") <= price_action.prev("low"))})
    one = f.agg(*[F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")).alias(c) for c in ("inside", "outside")])
    rates = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("rate")) for c in ("inside", "outside")])).alias("x")).select("x.*")
    return out(search.rate_shifts(rates, 0.2, 0.3, 0.1), "flag", "parameter", "shift")


# splits, budget, positions, the simulator
def edge(t: str) -> str:
    """The next 17:00 in New York at or after a time."""
    local = f"timezone('America/New_York', timezone('UTC', {t}))"
    at = f"(date_trunc('day', {local}) + interval 17 hour)"
    return f"timezone('UTC', timezone('America/New_York', case when {local} <= {at} then {at} else {at} + interval 1 day end))"


@query("spl01_ratio_session", with_bars(f"s as (select *, count(*) over (partition by symbol) as n from b), c as (select *, greatest(1, floor(n * cast('0.7' as double))) as i1 from s), e as (select *, greatest(i1 + 1, floor(n * (cast('0.7' as double) + cast('0.15' as double)))) as i2 from c), f as (select *, max(case when rn - 1 = least(i1, n - 1) then time end) over (partition by symbol) as a, max(case when rn - 1 = least(i2, n - 1) then time end) over (partition by symbol) as z from e), === select symbol, time, case when time < {edge('a')} then 'train' when time < {edge('z')} then 'val' else 'test' end as split from f"))
def ratio_session(spark: SparkSession, d: str) -> DataFrame:
    return out(ml.ratio_split(bars(spark, d), snap_tz="America/New_York"), "symbol", "time", "split")


over_bars("str07_budget", with_bars(f"e as (select *, 1000 + sum(close - open) over ({PART}) as eq from b), f as (select *, first_value(eq) over (partition by symbol, cast(time as date) order by time) as st, max(eq) over ({PART}) as pk from e), === select symbol, time, cast(least(greatest(0, 0.03 * st - greatest(0, st - eq)), greatest(0, 0.1 * pk - greatest(0, pk - eq))) > (high - low) / 10 * 1.0 * 2.0 as integer) as within from f"), lambda b: _budget(b), ["within"])


def _budget(b: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    from ..functions.frames import running

    b = b.withColumn("equity", 1000 + F.sum(F.col("close") - F.col("open")).over(running()))
    day = Window.partitionBy("symbol", F.to_date("time")).orderBy("time")
    b = b.withColumns({"start": F.first("equity").over(day), "peak": F.max("equity").over(running())})
    return b.withColumn("within", pos.within_budget(F.col("high") - F.col("low"), 10.0, 1.0, F.lit(2.0), F.col("equity"), F.col("start"), F.col("peak")).cast("int"))


MANAGED = """x as (select event_type as symbol, ts as time, value as price, row_number() over (partition by event_type order by ts, event_id) as i from events where value is not null),
m as (select symbol, i, price, price as entry, price - 20.0 as stop, cast(1.0 as double) as volume, false as even, cast(0 as bigint) as managed, cast(0.0 as double) as r, '' as event from x where i = 1
 union all select symbol, i, price, entry, case when due and price - 8.0 > case when tb then entry else stop end + 1e-3 and not (ev2 and price - 8.0 < entry) then price - 8.0 when due and ev2 and price - 8.0 < entry and entry > case when tb then entry else stop end + 1e-3 then entry when tb then entry else stop end,
   case when due and r >= 2.0 then volume * 0.75 else volume end, ev2, case when due then i - 1 else managed end, r,
   concat_ws(',', case when tb then 'breakeven' end, case when due and greatest(price - 8.0, case when ev2 then entry else price - 8.0 end) > case when tb then entry else stop end + 1e-3 then 'trail' end, case when due and r >= 2.0 and volume > 0 then 'scale' end)
 from (select *, even or (due and r >= 1.0) as ev2, due and not even and r >= 1.0 and entry - stop > 1e-3 as tb from (select x.symbol, x.i, x.price, m.entry, m.stop, m.volume, m.even, m.managed, (x.price - m.entry) / 20.0 as r, x.i - 1 - m.managed >= 5 as due from m join x on m.symbol = x.symbol and x.i = m.i + 1)))"""


@query("str08_positions", "with recursive " + MANAGED + " select symbol, event, count(*) as n, round(sum(stop), 4) + 0.0 as stops, round(sum(volume), 6) + 0.0 as volumes from m group by all")
def managed_positions(spark: SparkSession, d: str) -> DataFrame:
    """A position a symbol, opened at its first tick and managed every five ticks; its steps by what happened."""
    pos.use_rocksdb(spark)
    t = _event_stream(spark, d).where("value is not null").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("time"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(8.0).alias("atr"), F.lit(1).alias("side"), F.lit(20.0).alias("distance"), F.lit(1.0).alias("lots"))
    done = _run_stream(pos.manage_stream(t, every=5, scale=((2.0, 0.25),)))
    return done.groupBy("symbol", "event").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("stop"), 4) + F.lit(0.0)).alias("stops"), (F.round(F.sum("volume"), 6) + F.lit(0.0)).alias("volumes"))


SIM = POS_SQL + """x as (select p.symbol, p.time, p.rn, p.high, p.low, p.close, pos as action, atr from p join att using (symbol, time)),
r as (select distinct symbol, cast(null as timestamp) as time, cast(0 as bigint) as rn, cast(0 as double) as pos, cast(null as double) as entry, cast(null as double) as stop, cast(null as double) as target, cast(null as double) as risk, 0 as wait, cast(0 as double) as equity, cast(0 as double) as gain, cast(null as double) as pc, '' as event from x
 union all select symbol, time, rn, case when chg then action else p1 end, case when opens then close else entry end, case when opens then close - action * 1.5 * width when not chg then s1 end, case when opens then close + action * 2.0 * width when not chg then t1 end, case when opens then 1.5 * width else risk end,
   case when chg then 2 when w1 > 0 and e1 = '' then w1 - 1 else w1 end, equity + g1 - case when chg then 0.001 * abs(action - p1) else 0 end, g1 - case when chg then 0.001 * abs(action - p1) else 0 end, close, case when chg then 'change' else e1 end
 from (select *, chg and action <> 0 as opens, coalesce(atr, 0.01 * close) as width from (select *, e1 = '' and w1 = 0 and action <> p1 as chg from
  (select *, case when ex is not null then 0 else pos end as p1, case when ex is null then '' when ex = stop then 'stop' else 'target' end as e1, case when ex is not null then 2 else wait end as w1,
     case when ex is not null then pos * (ex / pc - 1) - 0.001 when pos <> 0 then pos * (close / pc - 1) else 0 end as g1, case when ex is null then target end as t1,
     case when ex is not null then null when pos <> 0 and pos * (close - entry) >= risk then pos * greatest(pos * stop, pos * entry, coalesce(pos * (close - pos * atr), pos * entry)) else stop end as s1
   from (select x.*, r.pos, r.entry, r.stop, r.target, r.risk, r.wait, r.equity, r.pc, case when r.pos = 0 then null when r.pos * (case when r.pos > 0 then x.low else x.high end - r.stop) <= 0 then r.stop when r.pos * (case when r.pos > 0 then x.high else x.low end - r.target) >= 0 then r.target end as ex from r join x on r.symbol = x.symbol and x.rn = r.rn + 1))))),"""


@query("sim01_simulator", with_bars(ATR + SIM + " === select symbol, time, cast(pos as integer) as position, " + ", ".join(r6(c, n) for c, n in (("gain", "reward"), ("equity", "equity"), ("stop", "stop"), ("target", "target"))) + ", event from r where rn > 0", recursive=True))
def simulator(spark: SparkSession, d: str) -> DataFrame:
    b = positions(ind.atr(bars(spark, d))).withColumnRenamed("position", "action")
    return out(ml.simulate(b, cost=0.001), "symbol", "time", "position", "reward", "equity", "stop", "target", "event")
