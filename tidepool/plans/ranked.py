"""Queries of ranked sets, sorts, top-k and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranked as r
from .base import Tables, plan

c = F.col
#: Spend of a customer as a ranked set for each nation.
_SPEND = "spend as (select c_nationkey as k, c_name as member, round(sum(o_totalprice), 2) as score from orders join customer on o_custkey = c_custkey group by 1, 2)"


def spend(t: Tables) -> DataFrame:
    totals = t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("score"))
    return totals.join(t.customer, c("o_custkey") == c("c_custkey")).select(c("c_nationkey").alias("k"), c("c_name").alias("member"), "score")


def _zset(name: str, commands: str, run, sql: str) -> None:
    plan(*commands.split(), name=name, sql=f"with {_SPEND} {sql}")(lambda t: run(spend(t)))


_rank = "row_number() over (partition by k order by score, member) - 1"
_zset("zset_rank", "ZRANK", lambda z: r.ranks(z, "k", "member", "score").select("k", "member", c("rank").cast("long").alias("rank")), f"select k, member, {_rank} as rank from spend")
_zset("zset_revrank", "ZREVRANK", lambda z: r.ranks(z, "k", "member", "score", True).select("k", "member", c("rank").cast("long").alias("rank")), "select k, member, row_number() over (partition by k order by score desc, member desc) - 1 as rank from spend")
_zset("zset_revrange", "ZREVRANGE ZPOPMAX BZPOPMAX ZMPOP BZMPOP", lambda z: r.top(z, "k", "member", "score", 3).select("k", "member", "score"), "select k, member, score from spend qualify row_number() over (partition by k order by score desc, member desc) <= 3")
_zset("zset_popmin", "ZPOPMIN BZPOPMIN", lambda z: r.top(z, "k", "member", "score", 2, False).select("k", "member", "score"), "select k, member, score from spend qualify row_number() over (partition by k order by score, member) <= 2")
_zset("zset_range", "ZRANGE ZRANGESTORE", lambda z: r.rank_range(z, "k", "member", "score", 1, -2).select("k", "member", "score"), f"select k, member, score from spend qualify {_rank} between 1 and count(*) over (partition by k) - 2")
_zset("zset_remrangebyrank", "ZREMRANGEBYRANK", lambda z: z.join(r.rank_range(z, "k", "member", "score", 0, 4).select("k", "member"), ["k", "member"], "left_anti"), f"select k, member, score from spend qualify {_rank} > 4")
_zset("zset_rangebyscore", "ZRANGEBYSCORE ZREVRANGEBYSCORE", lambda z: r.score_range(z, "score", 1e6, 2e6, open_low=True), "select * from spend where score > 1e6 and score <= 2e6")
_zset("zset_remrangebyscore", "ZREMRANGEBYSCORE", lambda z: r.score_range(z, "score", 1e6), "select * from spend where score >= 1e6")
_zset("zset_count", "ZCOUNT", lambda z: r.score_range(z, "score", 1e6, 3e6).groupBy("k").agg(F.count("*").alias("n")), "select k, count(*) as n from spend where score between 1e6 and 3e6 group by k")
_zset("zset_card", "ZCARD", lambda z: z.groupBy("k").agg(F.count("*").alias("n")), "select k, count(*) as n from spend group by k")
_zset("zset_score", "ZSCORE ZMSCORE", lambda z: z.where(c("member").isin("Customer#000000001", "Customer#000000007")).select("member", "score"), "select member, score from spend where member in ('Customer#000000001', 'Customer#000000007')")
_zset("zset_rem", "ZREM", lambda z: z.where(~c("member").isin("Customer#000000001")), "select * from spend where member <> 'Customer#000000001'")
_zset("zset_scan", "ZSCAN", lambda z: z.where(c("member").like("%7")), "select * from spend where member like '%7'")


@plan("ZLEXCOUNT", "ZRANGEBYLEX", "ZREVRANGEBYLEX", "ZREMRANGEBYLEX", sql="select p_name, count(*) as n from part where p_name >= 'g' and p_name < 's' group by 1")
def zset_lex(t: Tables) -> DataFrame:
    return r.lex_range(t.part, "p_name", "g", "s", open_high=True).groupBy("p_name").agg(F.count("*").alias("n"))


def _users(t: Tables, kind: str) -> DataFrame:
    return t.events.where(c("event_type") == kind).groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("score"))


_U = "u as (select event_type, user_id, round(sum(value), 4) as score from events group by 1, 2)"


def _combined(name: str, commands: str, how: str, inner: bool) -> None:
    def run(t: Tables) -> DataFrame:
        return r.combine([(_users(t, "click"), 2.0), (_users(t, "purchase"), 3.0)], "user_id", "score", how, inner).withColumn("score", F.round("score", 4))

    fold = {"SUM": "sum", "MIN": "min", "MAX": "max"}[how]
    plan(*commands.split(), name=name, sql=f"with {_U} select user_id, round({fold}(score * case event_type when 'click' then 2 else 3 end), 4) as score from u where event_type in ('click', 'purchase') group by 1" + (" having count(*) = 2" if inner else ""))(run)


_combined("zset_union_sum", "ZUNION ZUNIONSTORE", "SUM", False)
_combined("zset_union_max", "ZUNION", "MAX", False)
_combined("zset_union_min", "ZUNION", "MIN", False)
_combined("zset_inter_sum", "ZINTER ZINTERSTORE", "SUM", True)
_combined("zset_inter_min", "ZINTER", "MIN", True)


@plan("ZDIFF", "ZDIFFSTORE", sql=f"with {_U} select user_id, score from u where event_type = 'click' and user_id not in (select user_id from u where event_type = 'signup' and user_id % 3 = 0)")
def zset_diff(t: Tables) -> DataFrame:
    return r.difference(_users(t, "click"), [_users(t, "signup").where("user_id % 3 = 0")], "user_id")


def _added(mode: str, sql: str) -> None:
    def run(t: Tables) -> DataFrame:
        z = [_users(t, k).select(F.lit("z").alias("k"), "user_id", "score") for k in ("click", "purchase")]
        return r.upsert(z[0], z[1], "k", "user_id", "score", mode).select("user_id", F.round("score", 4).alias("score"))

    plan("ZADD", *(["ZINCRBY"] if mode == "INCR" else []), name=f"zset_add{'_' + mode.lower() if mode else ''}", sql=f"with {_U}, a as (select user_id, score as x from u where event_type = 'click'), b as (select user_id, score as y from u where event_type = 'purchase') select user_id, round({sql}, 4) as score from a full join b using (user_id)" + (" where x is not null" if mode == "XX" else ""))(run)


for _mode, _sql in (("", "coalesce(y, x)"), ("NX", "coalesce(x, y)"), ("XX", "coalesce(y, x)"), ("GT", "greatest(x, y)"), ("LT", "least(x, y)"), ("INCR", "coalesce(x, 0) + coalesce(y, 0)")):
    _added(_mode, _sql)


@plan("SORT", "SORT_RO", sql="select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 5")
def sort_numeric(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20)


@plan("SORT", sql="select p_partkey, p_name from part order by p_name, p_partkey limit 15")
def sort_alpha(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(15)


@plan("FREQ.*", "TOPK.*", "HOTKEYS", sql="select l_partkey, count(*) as n from lineitem group by 1 order by n desc, l_partkey limit 10")
def freq_top(t: Tables) -> DataFrame:
    return r.frequencies(t.lineitem, "l_partkey", 10)


@plan("FREQ.COUNT", "FREQ.ADD", sql="select p_brand, count(*) as n from part group by 1")
def freq_count(t: Tables) -> DataFrame:
    return r.frequencies(t.part, "p_brand")


@plan("PQ.*", sql="select o_orderkey, o_orderpriority, o_totalprice from orders order by o_orderpriority, o_totalprice desc, o_orderkey limit 10")
def priority_queue(t: Tables) -> DataFrame:
    return r.priority_pop(t.orders, 10, c("o_orderpriority"), F.desc("o_totalprice"), c("o_orderkey")).select("o_orderkey", "o_orderpriority", "o_totalprice")


@plan("HEAP.*", sql="select l_orderkey, l_linenumber, l_quantity from lineitem order by l_quantity, l_orderkey, l_linenumber limit 10")
def heap_pop(t: Tables) -> DataFrame:
    return r.priority_pop(t.lineitem, 10, c("l_quantity"), c("l_orderkey"), c("l_linenumber")).select("l_orderkey", "l_linenumber", "l_quantity")


@plan("SRANDMEMBER", "SPOP", "ZRANDMEMBER", "HRANDFIELD", "RANDOMKEY", "SAMPLE.*", "SHUFFLE.*")
def sample(t: Tables) -> DataFrame:
    return r.sampled(t.customer, 25, 42, "c_custkey").select("c_custkey", "c_name")
