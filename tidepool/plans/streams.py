"""Queries of streams, consumer groups and Structured Streaming; a streaming query has its batch twin's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import streams as s
from ..streaming import stateful
from ..streaming import windows as w
from .base import Tables, plan

c = F.col


@plan("XADD", "XSETID", sql="select event_id, epoch_us(ts) // 1000 as ms, row_number() over (partition by event_type, epoch_us(ts) // 1000 order by event_id) - 1 as seq from events")
def stream_ids(t: Tables) -> DataFrame:
    return s.numbered(t.events, "event_type", "ts", "event_id").select("event_id", "ms", c("seq").cast("long").alias("seq"))


@plan("XREAD", "XRANGE", "REPLAY.*", "REPLAYX.*", sql="select event_id from events where epoch_us(ts) // 1000 > 1704844800000")
def stream_read(t: Tables) -> DataFrame:
    return s.after(s.numbered(t.events, "event_type", "ts", "event_id"), 1704844800000, 10**6).select("event_id")


@plan("XLEN", "XINFO", "STREAMX.*", sql="select event_type, count(*) as n, min(event_id) as first, max(event_id) as last from events group by 1")
def stream_info(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def _pending(t: Tables) -> DataFrame:
    got = t.events.select(c("event_type").alias("grp"), (c("event_id") % 50).alias("entry"), (c("user_id") % 4).alias("consumer"), c("event_id").alias("at"), c("ts").cast("timestamp").alias("ts"))
    acks = t.events.where("event_type = 'click'").select(c("event_type").alias("grp"), ((c("event_id") * 7) % 50).alias("entry"))
    return s.pending(got, acks, ["grp", "entry"])


_PENDING = """p as (select event_type as grp, event_id % 50 as entry, arg_max(user_id % 4, event_id) as consumer, arg_max(ts, event_id) as ts, count(*) as deliveries from events
    where (event_type, event_id % 50) not in (select event_type, (event_id * 7) % 50 from events where event_type = 'click') group by 1, 2)"""


@plan("XPENDING", "XREADGROUP", "XACK", "XGROUP", sql=f"with {_PENDING} select grp, consumer, count(*) as n, min(entry) as first, max(entry) as last from p group by 1, 2")
def stream_pending(t: Tables) -> DataFrame:
    return s.pending_summary(_pending(t), "grp", "consumer", "entry")


@plan("XCLAIM", "XAUTOCLAIM", sql=f"with {_PENDING} select grp, entry, deliveries from p where date_sub('second', ts, timestamp '2024-01-31') >= 86400")
def stream_claim(t: Tables) -> DataFrame:
    return s.claimable(_pending(t), "ts", F.lit("2024-01-31").cast("timestamp"), 86400).select("grp", "entry", "deliveries")


@plan("MSGQUEUE.*", sql="select user_id, case when bool_or(event_type = 'purchase') then 'acked' when count(*) >= 3 then 'dead' else 'waiting' end as outcome, count(*) as tries from events group by 1")
def queue_outcomes(t: Tables) -> DataFrame:
    return s.redelivered(t.events.withColumn("ok", c("event_type") == "purchase"), "user_id", "ok", 3)


@plan("PUBLISH", "SUBSCRIBE", "PSUBSCRIBE", "SPUBLISH", "SSUBSCRIBE", "UNSUBSCRIBE", "PUNSUBSCRIBE", "SUNSUBSCRIBE", "PUBSUB", "TOPIC.*", "EVENTX.*", "EVENT.*", "WS.BROADCAST", "WS.SEND", sql="select subscriber, count(*) as n from events join (select unnest(['ann', 'bob', 'cy']) as subscriber, unnest(['c%', 'purchase', '%']) as pattern) on event_type like pattern group by 1")
def topic_fan_out(t: Tables) -> DataFrame:
    subs = t.spark.createDataFrame([("ann", "c%"), ("bob", "purchase"), ("cy", "%")], "subscriber string, pattern string")
    return s.fan_out(t.events, subs, "event_type").groupBy("subscriber").agg(F.count("*").alias("n"))


@plan("EVENTSOURCING.*", "OBSERVABLE.*", sql="select user_id, event_id, version from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as version from events) where version >= 3")
def event_replay(t: Tables) -> DataFrame:
    return s.versions(t.events, "user_id", ["ts", "event_id"]).where("version >= 3").select("user_id", "event_id", c("version").cast("long").alias("version"))


def _stream(t: Tables) -> DataFrame:
    return w.stream(t.spark, f"{t.folder}/events.parquet").withColumn("ts", c("ts").cast("timestamp"))


@plan("SLIDINGWINDOW.INCR", "ROLLUP.ADD", "TS.ADD", sql="select make_timestamp((epoch_us(ts) // 3600000000) * 3600000000) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def streaming_tumbling(t: Tables) -> DataFrame:
    return w.run(w.tumbling(_stream(t), "ts", "event_type", "value", "1 hour", "10 minutes"), "complete").withColumn("total", F.round("total", 4))


@plan("SLIDING.CHECK", sql="select make_timestamp((epoch_us(ts) // 1800000000 - k) * 1800000000) as start, event_type, count(*) as n from events, (select unnest([0, 1]) as k) group by 1, 2")
def streaming_sliding(t: Tables) -> DataFrame:
    return w.run(w.sliding(_stream(t), "ts", "event_type", "1 hour", "30 minutes", "10 minutes"), "complete")


@plan("SESSION.CREATE", "SESSION.REFRESH", sql="""with m as (select *, case when coalesce(ts >= lag(ts) over w + interval 2 hour, true) then 1 else 0 end as n from events window w as (partition by user_id order by ts, event_id)),
    g as (select *, sum(n) over (partition by user_id order by ts, event_id) as g from m) select min(ts) as start, max(ts) + interval 2 hour as stop, user_id, count(*) as n from g group by user_id, g""")
def streaming_sessions(t: Tables) -> DataFrame:
    return w.run(w.sessions(_stream(t), "ts", "user_id", "2 hours", "10 minutes"), "complete")


@plan("DEDUP.ADD", sql="select distinct event_id from events")
def streaming_dedup(t: Tables) -> DataFrame:
    rows = _stream(t)
    return w.run(w.without_duplicates(rows.union(rows), "ts", ["event_id"], "60 days").select("event_id"))


@plan("METRICS.CMD", "ACTOR.SEND", sql="select event_type, count(*) as n from events group by 1")
def streaming_counts(t: Tables) -> DataFrame:
    out = w.run(stateful.running_counts(_stream(t).select("event_type"), "event_type"))
    return out.groupBy("event_type").agg(F.max("n").alias("n"))


@plan("MSGQUEUE.NACK", "MSGQUEUE.DEADLETTER")
def streaming_queue(t: Tables) -> DataFrame:
    return w.run(stateful.message_queue(_stream(t).withColumn("ok", c("event_type") == "purchase"), "user_id", "ok", 3))
