"""Queries of exact aggregates and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as a
from .base import Tables, plan

c = F.col


def _single(kind: str, commands: str, sql: str) -> None:
    def run(t: Tables) -> DataFrame:
        return a.aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity", kind).withColumnRenamed(kind, "value")

    plan(*commands.split(), name=f"agg_{kind}", sql=f"select l_returnflag, l_linestatus, {sql} as value from lineitem group by all")(run)


for _kind, _commands, _sql in (
    ("sum", "AGG.SUM AGG.PUSH ANALYTICS.SUM ANALYTICS.INCR AGGREGATOR.* MATH.SUM", "sum(l_quantity)"),
    ("avg", "AGG.AVG ANALYTICS.AVG ROLLUPX.GET ROLLUPX.ADD MATH.AVG", "avg(l_quantity)"),
    ("min", "AGG.MIN ANALYTICS.MIN", "min(l_quantity)"),
    ("max", "AGG.MAX ANALYTICS.MAX", "max(l_quantity)"),
    ("count", "AGG.COUNT ANALYTICS.COUNT DOC.COUNT LOGX.STATS", "count(l_quantity)"),
):
    _single(_kind, _commands, _sql)


@plan(
    "ANALYTICS.GET",
    "STATS.ALL",
    "TELEMETRY.QUERY",
    "TELEMETRY.RECORD",
    "TELEMETRY.EXPORT",
    sql="select event_type, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean, min(value) as low, max(value) as high, round(stddev_pop(value), 6) as deviation, median(value) as median from events group by event_type",
)
def analytics_summary(t: Tables) -> DataFrame:
    out = a.summary(t.events, ["event_type"], "value")
    return out.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


@plan("MATH.MEDIAN", sql="select o_orderpriority, median(o_totalprice) as value from orders group by 1")
def math_median(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.median("o_totalprice").alias("value"))


@plan("MATH.STDDEV", sql="select o_orderpriority, round(stddev_pop(o_totalprice), 4) as value from orders group by 1")
def math_stddev(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.round(F.stddev_pop("o_totalprice"), 4).alias("value"))


@plan("METER.BILLING", "METER.RECORD", "METER.GET", "METER.CREATE", "METER.DELETE", sql="select l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as total, count(*) as records from lineitem group by 1")
def meter_billing(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("total"), F.count("*").alias("records"))


@plan(
    "INCR", "INCRBY", "DECR", "DECRBY", "INCRBYFLOAT", "COUNTER.*", "COUNTERX.*", "COUNTERX2.*", "GAUGE.*", "SEQUENCE.*", "ANALYTICS.DECR", "LEVEL.*", "ID.*",
    sql="""with s as (select user_id, max(event_id) filter (event_type = 'signup') as t0 from events group by 1)
    select e.user_id, coalesce(sum(case when event_type = 'error' then -1 else 1 end) filter (t0 is null or event_id > t0), 0)::bigint as value from events e join s on s.user_id = e.user_id group by 1""",
)
def counter_with_reset(t: Tables) -> DataFrame:
    """Events count up, errors down, a signup sets to 0."""
    delta = F.when(c("event_type") == "error", -1).otherwise(1).cast("long")
    return a.counter(t.events, "user_id", delta, "event_id", c("event_type") == "signup")


@plan("ZINCRBY", "HINCRBY", sql="select user_id, event_id, round(sum(value) over (partition by user_id order by event_id), 4) as running from events")
def counter_running(t: Tables) -> DataFrame:
    return a.running(t.events, "user_id", ["event_id"], "value").select("user_id", "event_id", F.round("running", 4).alias("running"))


@plan("CRDT.PNCounter.*", "CRDT.GCOUNTER.*", sql="select event_type, sum(case when event_id % 3 = 0 then -2 else 1 end)::bigint as value from events group by 1")
def crdt_pncounter(t: Tables) -> DataFrame:
    log = t.events.select("event_type", (c("user_id") % 4).alias("node"), F.when(c("event_id") % 3 == 0, -2).otherwise(1).cast("long").alias("delta"))
    return a.pn_counter(log, "event_type", "node", "delta")


@plan("CRDT.LWW.*", sql="select user_id, arg_max(event_type, (ts, event_id)) as value from events group by 1")
def crdt_lww(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("value"))


@plan("COALESCE.*", sql="select user_id, arg_min(event_type, event_id) as value from events group by 1")
def coalesce_first(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("value"))


@plan("DOC.DISTINCT", "SCARD", "PFCOUNT", sql="select l_shipdate, count(distinct l_suppkey) as suppliers, count(distinct l_partkey) as parts from lineitem group by 1")
def count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_shipdate").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))


@plan("DOC.AGGREGATE", sql="select p_brand, p_type, count(*) as n from part group by 1, 2")
def doc_aggregate(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


@plan("DBSIZE", "STATS.*", "CACHE.STATS", "NAMESPACEINFO", "INFO", sql="select count(*) as keys, sum(strlen(c_name))::bigint as key_bytes, min(c_custkey) as first, max(c_custkey) as last from customer")
def keyspace_stats(t: Tables) -> DataFrame:
    return t.customer.agg(F.count("*").alias("keys"), F.sum(F.octet_length("c_name")).alias("key_bytes"), F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"))


@plan("METRICS.*", "AUDIT.STATS", "EXPERIMENT.RESULTS", "EXPERIMENT.TRACK", sql="select event_type, count(*) as n, count(distinct user_id) as users, max(ts) as last from events group by 1")
def metrics_by_command(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.max(c("ts").cast("timestamp")).alias("last"))


@plan("TAGCOUNT", "PARTITION.LIST", sql="select tag, count(*) as n from (select unnest(str_split(p_name, ' ')) as tag from part) group by 1")
def tag_count(t: Tables) -> DataFrame:
    return t.part.select(F.explode(F.split("p_name", " ")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@plan("MERKLE.*", sql="""with l as (select p_partkey // 1024 as node, sha256(string_agg(sha256(p_name), '' order by p_partkey)) as hash from part group by 1),
    r as (select sha256(string_agg(hash, '' order by node)) as hash, count(*) as n, max(node) as high from l)
    select 0 as level, node, hash from l union all select 1, 0::bigint, hash from r where high > 0""")
def merkle_root(t: Tables) -> DataFrame:
    return a.merkle(t.part, "p_name", "p_partkey")


@plan("AGG.CLEAR", "ANALYTICS.CLEAR", "AGGREGATOR.RESET", sql="select l_returnflag, 0.0::double as value from lineitem group by 1")
def agg_cleared(t: Tables) -> DataFrame:
    """Cleared keys stay, with nothing pushed since."""
    return t.lineitem.groupBy("l_returnflag").agg(F.coalesce(F.sum(F.when(F.lit(False), c("l_quantity"))), F.lit(0.0)).alias("value"))


@plan("STATS.KEYSPACE", sql="""select c_nationkey, c_mktsegment, count(*) as n, sum(c_acctbal) as total from customer group by rollup (c_nationkey, c_mktsegment)""")
def keyspace_rollup(t: Tables) -> DataFrame:
    return t.customer.rollup("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total"))


@plan("DOC.AGGREGATE", sql="select p_brand, p_type, count(*) as n, avg(p_size) as size from part group by cube (p_brand, p_type)")
def doc_cube(t: Tables) -> DataFrame:
    return t.part.cube("p_brand", "p_type").agg(F.count("*").alias("n"), F.avg("p_size").alias("size"))
