"""Queries of time series, windows and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import windows as w
from .base import Tables, plan

c = F.col


def _ntz(name: str):
    return c(name).cast("timestamp")


_BUCKET = "make_timestamp((epoch_us(ts) // 3600000000) * 3600000000)"


@plan(
    "TS.RANGE", "TS.ADD", "TS.MADD", "TS.CREATE", "TS.ALTER", "ROLLUPX.*",
    sql=f"select event_type, {_BUCKET} as bucket, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean, min(value) as low, max(value) as high, arg_min(value, (ts, event_id)) as first, arg_max(value, (ts, event_id)) as last from events group by 1, 2",
)
def ts_range_hourly(t: Tables) -> DataFrame:
    out = w.downsample(t.events, "event_type", "ts", "value", 3600, "event_id")
    return out.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@plan("TS.RANGE", "XRANGE", sql="select event_id, event_type, value from events where ts between '2024-01-05' and '2024-01-08' order by ts")
def ts_range(t: Tables) -> DataFrame:
    return w.between(t.events, "ts", "2024-01-05", "2024-01-08").select("event_id", "event_type", "value")


@plan("TS.REVRANGE", "XREVRANGE", sql="select event_id, value from events where ts between '2024-01-05' and '2024-01-20' order by ts desc, event_id desc limit 50")
def ts_revrange(t: Tables) -> DataFrame:
    return w.between(t.events, "ts", "2024-01-05", "2024-01-20").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "value")


@plan("TS.GET", sql="select event_type, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by 1")
def ts_get(t: Tables) -> DataFrame:
    return w.latest(t.events.select("event_type", "event_id", "value", "ts"), "event_type", F.struct("ts", "event_id")).select("event_type", "event_id", "value")


@plan("TS.INFO", sql="select event_type, count(*) as samples, min(ts) as first, max(ts) as last from events group by 1")
def ts_info(t: Tables) -> DataFrame:
    return w.info(t.events.withColumn("ts", _ntz("ts")), "event_type", "ts")


@plan("TS.QUERYINDEX", sql="select event_type, count(*) as n from events where json_extract(props, '$.k')::int = 7 group by 1")
def ts_queryindex(t: Tables) -> DataFrame:
    labels = F.from_json("props", "map<string,int>")
    return t.events.where(F.try_element_at(labels, F.lit("k")) == 7).groupBy("event_type").agg(F.count("*").alias("n"))


@plan("TS.INCRBY", "TS.DECRBY", sql="select event_id, round(sum(case when event_type = 'error' then -value else value end) over (partition by user_id order by ts, event_id), 4) as value from events")
def ts_incrby(t: Tables) -> DataFrame:
    from ..operators.aggregates import running

    signed = t.events.withColumn("d", F.when(c("event_type") == "error", -c("value")).otherwise(c("value")))
    return running(signed, "user_id", ["ts", "event_id"], "d").select("event_id", F.round("running", 4).alias("value"))


@plan("TS.DEL", sql="select event_id from events where ts not between '2024-01-05' and '2024-01-08'")
def ts_del(t: Tables) -> DataFrame:
    return t.events.where("NOT (ts BETWEEN timestamp'2024-01-05' AND timestamp'2024-01-08')").select("event_id")


@plan("TS.CREATE", sql="select e.event_id from events e join (select event_type, max(ts) as m from events group by 1) x using (event_type) where date_sub('second', e.ts, m) <= 86400")
def ts_retention(t: Tables) -> DataFrame:
    return w.retained(t.events, "event_type", "ts", 86400).select("event_id")


@plan("ROLLUP.*", sql="select o_custkey, date_trunc('month', o_orderdate)::timestamp as bucket, round(sum(o_totalprice), 2) as total from orders group by 1, 2")
def rollup_month(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey", F.date_trunc("month", _ntz("o_orderdate")).alias("bucket")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@plan(
    "WINDOW.*", "WINDOWX.*",
    sql="select event_id, round(sum(value) over w, 4) as last_sum, round(avg(value) over w, 6) as last_avg, min(value) over w as last_min, max(value) over w as last_max from events window w as (partition by user_id order by ts, event_id rows between 9 preceding and current row)",
)
def window_last_n(t: Tables) -> DataFrame:
    out = w.last_n(t.events, "user_id", ["ts", "event_id"], "value", 10, "sum", "avg", "min", "max")
    return out.select("event_id", F.round("last_sum", 4).alias("last_sum"), F.round("last_avg", 6).alias("last_avg"), "last_min", "last_max")


@plan("RINGBUFFER.*", "LOGX.READ", "TOPIC.HISTORY", "XTRIM", "LTRIM", sql="select event_id, user_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 5")
def ring_last_n(t: Tables) -> DataFrame:
    return w.ring(t.events, "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("event_id", "user_id")


@plan("GETSET", sql="select event_id, lag(value) over (partition by user_id order by ts, event_id) as previous from events")
def getset_previous(t: Tables) -> DataFrame:
    return w.previous(t.events, "user_id", ["ts", "event_id"], "value").select("event_id", "previous")


@plan("SLIDING.*", "SLIDINGWINDOW.*", "RATELIMIT.*", "RATELIMITER.*", "THROTTLEX.*", "QUOTA.*", "QUOTAX.*", sql="select event_id, count(*) over (partition by user_id order by ts range between interval 3600 second preceding and current row) as recent from events")
def sliding_count(t: Tables) -> DataFrame:
    return w.trailing(t.events, "user_id", "ts", 3600).select("event_id", "recent")


@plan("SESSION.*", "SESSIONX.*", sql="""select event_id, sum(n) over (partition by user_id order by ts, event_id)::bigint as session from (
    select event_id, user_id, ts, case when coalesce(date_sub('second', lag(ts) over (partition by user_id order by ts, event_id), ts) > 7200, true) then 1 else 0 end as n from events)""")
def session_gap(t: Tables) -> DataFrame:
    return w.sessions(t.events, "user_id", "ts", 7200, "event_id").select("event_id", "session")


@plan("CHAIN.*", sql="select user_id, true as valid, count(*) as length from events group by 1")
def chain_validate(t: Tables) -> DataFrame:
    blocks = w.chain(t.events, "user_id", ["event_id"], c("props"))
    return w.chain_valid(blocks, "user_id", ["event_id"])


@plan("ROLLUP.GET", sql="select l_suppkey, sum(l_quantity) filter (l_shipdate < '2000-01-01') as before, sum(l_quantity) filter (l_shipdate >= '2000-01-01') as since from lineitem group by 1")
def rollup_pivot(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.sum(F.when(c("l_shipdate") < "2000-01-01", c("l_quantity"))).alias("before"), F.sum(F.when(c("l_shipdate") >= "2000-01-01", c("l_quantity"))).alias("since"))
