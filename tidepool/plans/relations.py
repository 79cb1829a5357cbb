"""Queries of sets, joins, tags and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins as j
from ..operators import sets as s
from .base import Tables, crc32_sql, plan

c = F.col
#: Users by kind of event, over a threshold that tells the sets apart.
_SQL = {k: f"select distinct user_id from events where event_type = '{k}' and value > {v}" for k, v in (("click", 35), ("purchase", 30), ("signup", 60))}


def _set(t: Tables, kind: str) -> DataFrame:
    low = {"click": 35, "purchase": 30, "signup": 60}[kind]
    return t.events.where((c("event_type") == kind) & (c("value") > low)).select("user_id").distinct()


@plan("SUNION", "SUNIONSTORE", "CRDT.GSET.*", "SADD", sql=" union ".join(_SQL.values()))
def set_union(t: Tables) -> DataFrame:
    return s.union([_set(t, k) for k in _SQL], "user_id")


@plan("SINTER", "SINTERSTORE", sql=" intersect ".join(_SQL.values()))
def set_inter(t: Tables) -> DataFrame:
    return s.intersection([_set(t, k) for k in _SQL], "user_id")


@plan("SINTERCARD", sql=f"select count(*) as n from ({' intersect '.join(_SQL.values())})")
def set_intercard(t: Tables) -> DataFrame:
    return s.intersection([_set(t, k) for k in _SQL], "user_id").agg(F.count("*").alias("n"))


@plan("SDIFF", "SDIFFSTORE", "SREM", sql="select distinct user_id from events where event_type = 'click' except select user_id from events where user_id % 3 = 0")
def set_diff(t: Tables) -> DataFrame:
    return s.difference(t.events.where("event_type = 'click'").select("user_id"), [t.events.where("user_id % 3 = 0")], "user_id")


@plan("SISMEMBER", "SMISMEMBER", sql=f"select c_custkey as user_id, c_custkey in ({_SQL['click']}) as found from customer")
def set_ismember(t: Tables) -> DataFrame:
    return s.membership(t.customer.select(c("c_custkey").alias("user_id")), _set(t, "click"), "user_id")


@plan("SMEMBERS", "SSCAN", sql=_SQL["signup"])
def set_members(t: Tables) -> DataFrame:
    return _set(t, "signup")


@plan("SMOVE", sql="select distinct case when event_type = 'click' and user_id < 50 then 'moved' else event_type end as k, user_id from events where event_type in ('click', 'view')")
def set_move(t: Tables) -> DataFrame:
    sets = t.events.where(c("event_type").isin("click", "view")).select(c("event_type").alias("k"), "user_id").distinct()
    return s.move(sets, "k", "user_id", "click", "moved", t.customer.where("c_custkey < 50").select(c("c_custkey").alias("user_id")))


@plan("DEDUP.*", "IDEMPOTENCY.*", "MSETNX", "SETNX", sql="select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1")
def dedup_first(t: Tables) -> DataFrame:
    return s.first_seen(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@plan("DEDUP.CHECK", "DEDUP.EXPIRE", sql="""select event_id, coalesce(date_sub('second', lag(ts) over w, ts) >= 3600, true) as is_new from events window w as (partition by user_id order by ts, event_id)""")
def dedup_ttl(t: Tables) -> DataFrame:
    return s.new_within(t.events, "user_id", "ts", 3600, "event_id").select("event_id", "is_new")


@plan("CRDT.ORSET.*", sql="select event_type, user_id from events group by 1, 2 having arg_max(case when event_id % 4 = 0 then 'remove' else 'add' end, event_id) = 'add'")
def crdt_orset(t: Tables) -> DataFrame:
    return s.observed_remove(t.events.withColumn("op", F.when(c("event_id") % 4 == 0, "remove").otherwise("add")), "event_type", "user_id", "op", "event_id")


@plan("JOINX.*", sql="select r_name, event_type from region, (select distinct event_type from events)")
def join_cross(t: Tables) -> DataFrame:
    return j.cross(t.region.select("r_name"), t.events.select("event_type").distinct())


@plan("JOINX.GET", sql="select n_name, c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2")
def join_star(t: Tables) -> DataFrame:
    nation = j.small(t.nation)
    rows = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).join(nation, c("c_nationkey") == c("n_nationkey"))
    return rows.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@plan("EXISTS", "TOUCH", sql="select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F')")
def join_semi(t: Tables) -> DataFrame:
    keys = t.orders.where("o_orderstatus = 'F'").select(c("o_custkey").alias("c_custkey"))
    return t.customer.join(keys, "c_custkey", "left_semi").select("c_custkey", "c_name")


@plan("DEL", "UNLINK", "BATCH.DEL", "BATCH.MDEL", "CACHE.BULKDEL", "XDEL", "GETDEL", sql="select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def join_anti(t: Tables) -> DataFrame:
    keys = t.orders.where("o_orderpriority = '1-URGENT'").select(c("o_custkey").alias("c_custkey"))
    return t.customer.join(keys, "c_custkey", "left_anti").select("c_custkey", "c_name")


@plan("JOINX.GET", sql="select l_suppkey, s_name, count(*) as n from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2")
def join_salted(t: Tables) -> DataFrame:
    rows = j.salted(t.lineitem.withColumn("tie", F.xxhash64("l_orderkey", "l_linenumber")), t.supplier.select(c("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", 8, "tie")
    return rows.groupBy("l_suppkey", "s_name").agg(F.count("*").alias("n"))


@plan("ENRICH.*", sql="select e.event_id, p.event_id as right_event_id, p.value as right_value from events e asof left join (select * from events where event_type = 'purchase' qualify row_number() over (partition by user_id, ts order by event_id desc) = 1) p on e.user_id = p.user_id and e.ts >= p.ts where e.event_type = 'click'")
def join_as_of(t: Tables) -> DataFrame:
    clicks = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = t.events.where("event_type = 'purchase'").select("user_id", c("ts").alias("at"), "event_id", "value")
    return j.as_of(clicks, bought, "user_id", "ts", "at", "event_id").select("event_id", "right_event_id", "right_value")


@plan("SHARD.MAP", "SHARD.MOVE", sql="select p_partkey, s_suppkey from part join supplier on p_partkey between s_suppkey * 15 and s_suppkey * 15 + 20")
def join_interval(t: Tables) -> DataFrame:
    spans = t.supplier.select("s_suppkey", (c("s_suppkey") * 15).alias("a"), (c("s_suppkey") * 15 + 20).alias("b"))
    return j.interval(t.part.select("p_partkey"), spans, "p_partkey", "a", "b", 32).select("p_partkey", "s_suppkey")


@plan("PARTITION.*", "PARTITIONX.*", "SHARD.STATUS", "SHARD.LIST", "SHARD.REBALANCE", sql=f"select {crc32_sql('c_custkey::varchar')} % 16 as part, count(*) as n from customer group by 1")
def partition_assign(t: Tables) -> DataFrame:
    return t.customer.select(j.partition_of(c("c_custkey"), 16).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


_NODES = ["north", "east", "south", "west"]


@plan("RING.*", sql=f"""with p as (select n, {crc32_sql("n || '#' || i")} as h from (select unnest({_NODES}) as n), (select unnest(range(16)) as i)), k as (select c_custkey, {crc32_sql("c_custkey::varchar")} as h from customer),
    f as (select c_custkey, coalesce(arg_min(p.n, p.h) filter (p.h >= k.h), arg_min(p.n, p.h)) as node from k, p group by 1) select node, count(*) as n from f group by 1""")
def ring_nodes(t: Tables) -> DataFrame:
    return j.ring(t.customer.select("c_custkey"), "c_custkey", _NODES).groupBy("node").agg(F.count("*").alias("n"))


@plan("TAGKEYS", "TAGS", "ADDTAG", "SETTAG", "INDEX.*", sql="select unnest(list_distinct(str_split(p_name, ' ') || [p_type])) as tag, p_partkey from part")
def tag_keys(t: Tables) -> DataFrame:
    """The index of all tags, a row for each tag of a key, so that a common tag is no long list."""
    return t.part.select(F.explode(F.array_distinct(F.concat(F.split("p_name", " "), F.array("p_type")))).alias("tag"), "p_partkey")


@plan("REMTAG", sql="select p_partkey, array_to_string(list_filter(str_split(p_name, ' '), lambda x: x not in ('red', 'ring')), ' ') as tags from part")
def tag_remove(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(F.filter(F.split("p_name", " "), lambda x: ~x.isin("red", "ring")), " ").alias("tags"))


def _tags(t: Tables) -> DataFrame:
    region = t.nation.join(j.small(t.region), c("n_regionkey") == c("r_regionkey")).select(c("r_name").alias("parent"), c("n_name").alias("child"))
    customers = t.customer.join(j.small(t.nation), c("c_nationkey") == c("n_nationkey")).select(c("n_name").alias("parent"), c("c_name").alias("child"))
    return region.union(customers)


@plan("TAGLINK", "TAGUNLINK", "TAGCHILDREN", "RELATION.*", sql="select r_name as parent, n_name as child from nation join region on n_regionkey = r_regionkey union all select n_name, c_name from customer join nation on c_nationkey = n_nationkey")
def tag_children(t: Tables) -> DataFrame:
    return _tags(t)


@plan("INVALIDATE", sql="select c_custkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name <> 'ASIA'")
def invalidate_cascade(t: Tables) -> DataFrame:
    """Keys that stay once a tag and all tags below it are gone."""
    gone = j.descendants(t.spark, _tags(t), "r_name", t.region.where("r_name = 'ASIA'"))
    return t.customer.join(gone.select(c("tag").alias("c_name")), "c_name", "left_anti").select("c_custkey")
