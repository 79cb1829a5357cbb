"""Queries of the keyspace, registries, queues, state machines and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kv, state
from .base import Tables, plan

c = F.col


def _log(t: Tables) -> DataFrame:
    """Events as operations: errors delete, all else sets."""
    return t.events.select("event_id", c("ts").cast("timestamp").alias("ts"), "user_id", F.when(c("event_type") == "error", "del").otherwise("set").alias("op"), "value", "event_type")


@plan("SET", "GET", "MSET", "BATCH.SET", "BATCH.MSET", "BATCH.EXEC", "STOREX.*", "CACHEX.*", "ENTITY.*", "RECORD.*", "PROFILE.*", "DOC.UPDATE", "DOC.INSERT", "DOC.DELETE", sql="select user_id, arg_max(value, event_id) as value from events group by 1 having arg_max(event_type, event_id) <> 'error'")
def kv_latest(t: Tables) -> DataFrame:
    return kv.latest(_log(t), ["user_id"], "event_id", "op").select("user_id", "value")


@plan("SETNX", "MSETNX", "HSETNX", sql="select user_id, arg_min(value, event_id) as value from events group by 1")
def kv_first(t: Tables) -> DataFrame:
    return kv.first(_log(t), ["user_id"], "event_id").select("user_id", "value")


@plan("MGET", "BATCH.GET", "BATCH.MGET", "CACHE.BULKGET", sql="select w.pos, c_name from (select unnest([5, 999999999, 3, 5]) as k, unnest([0, 1, 2, 3]) as pos) w left join customer on c_custkey = k")
def kv_mget(t: Tables) -> DataFrame:
    wanted = t.spark.createDataFrame([(5, 0), (999999999, 1), (3, 2), (5, 3)], "c_custkey long, pos int")
    return kv.many(wanted, t.customer.select("c_custkey", "c_name"), "c_custkey", "pos").select("pos", "c_name")


@plan("KEYS", "SCAN", sql="select c_name from customer where regexp_matches(c_name, '^Customer#.*[13]7$')")
def kv_keys(t: Tables) -> DataFrame:
    return kv.scan(t.customer, "c_name", "Customer#*[13]7").select("c_name")


@plan("SCAN", "HSCAN", "SSCAN", sql="select c_name from customer where c_name like '%1' order by c_name limit 10 offset 5")
def kv_scan_page(t: Tables) -> DataFrame:
    return kv.scan(t.customer, "c_name", "*1", 5, 10).select("c_name")


@plan(
    "TTL", "PTTL", "EXPIRE", "PEXPIRE", "EXPIREAT", "PEXPIREAT", "EXPIRETIME", "PEXPIRETIME", "PERSIST", "SETEX", "PSETEX", "GETEX", "MEMO.CACHE", "MEMO.STATS",
    sql="""select event_id, case when event_type = 'view' then -1 when ts + interval 7 day < timestamp '2024-01-15' then -2 else date_sub('second', timestamp '2024-01-15', ts + interval 7 day) end as ttl from events where ts <= timestamp '2024-01-15'""",
)
def kv_ttl(t: Tables) -> DataFrame:
    now = F.lit("2024-01-15").cast("timestamp")
    expires = F.when(c("event_type") != "view", c("ts") + F.make_dt_interval(F.lit(7)))
    return _log(t).where(c("ts") <= now).select("event_id", kv.ttl(expires, now).alias("ttl"))


@plan("GETEX", "CACHE.*", "MEMO.*", sql="select event_id from events where event_type = 'view' or ts + interval 7 day >= timestamp '2024-01-15'")
def kv_alive(t: Tables) -> DataFrame:
    kept = _log(t).withColumn("expires", F.when(c("event_type") != "view", c("ts") + F.make_dt_interval(F.lit(7))))
    return kv.alive(kept, "expires", F.lit("2024-01-15").cast("timestamp")).select("event_id")


@plan("RENAME", "KEY.RENAME", "MOVE", "KEY.MOVE", sql="select case when n_name = 'NATION_3' then 'NATION_5' else n_name end as n_name, n_nationkey from nation where n_name <> 'NATION_5'")
def kv_rename(t: Tables) -> DataFrame:
    return kv.rename(t.nation.select("n_name", "n_nationkey"), "n_name", "NATION_3", "NATION_5")


@plan("RENAMENX", "KEY.RENAMENX", sql="select n_name, n_nationkey from nation")
def kv_renamenx(t: Tables) -> DataFrame:
    return kv.rename(t.nation.select("n_name", "n_nationkey"), "n_name", "NATION_3", "NATION_5", only_new=True)


@plan("COPY", "KEY.COPY", sql="select n_name, n_nationkey from nation union all select 'NATION_X', 3")
def kv_copy(t: Tables) -> DataFrame:
    return kv.copy(t.nation.select("n_name", "n_nationkey"), "n_name", "NATION_3", "NATION_X")


@plan("LRU.*", sql="select user_id, event_type from (select user_id, event_type, max(event_id) as last from events group by 1, 2) qualify row_number() over (partition by user_id order by last desc) <= 2")
def lru(t: Tables) -> DataFrame:
    last = t.events.groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    return kv.evict_each(last, "user_id", c("last"), 2, "event_type").select("user_id", "event_type")


@plan("KEY.FREQ", "KEY.IDLETIME", "KEY.OBJECT", "KEY.REFCOUNT", "KEY.ENCODE", "TYPE", "OBJECT", sql="select user_id, count(*) as freq, date_sub('second', max(ts), timestamp '2024-02-01') as idle from events group by 1 order by freq desc, user_id limit 20")
def lfu(t: Tables) -> DataFrame:
    use = t.events.groupBy("user_id").agg(F.count("*").alias("freq"), F.timestamp_diff("SECOND", F.max("ts"), F.lit("2024-02-01").cast("timestamp_ntz")).alias("idle"))
    return kv.evict(use, c("freq"), 20, "user_id")


@plan("DOC.FIND", "DOC.FINDONE", "DOC.INDEX", "DOC.DROPINDEX", "AUDIT.*", "AUDITX.*", "LOGX.SEARCH", "LOGX.WRITE", "LOGX.CLEAR", sql="select p_partkey, p_name from part where p_brand = 'Brand#12' and p_name like '%e%'")
def doc_find(t: Tables) -> DataFrame:
    return t.part.where((c("p_brand") == "Brand#12") & c("p_name").contains("e")).select("p_partkey", "p_name")


@plan("GRID.*", sql="select p_size as x, (p_partkey % 10)::int as y, count(*) as n from part where p_size between 10 and 20 group by 1, 2")
def grid_query(t: Tables) -> DataFrame:
    return t.part.where(c("p_size").between(10, 20)).groupBy(c("p_size").alias("x"), (c("p_partkey") % 10).cast("int").alias("y")).agg(F.count("*").alias("n"))


@plan("MVCC.*", "MULTI", "EXEC", "DISCARD", "TRANSX.*", sql="select user_id, arg_max(value, event_id) as value from events where event_id <= 500 group by 1 having arg_max(event_type, event_id) <> 'error'")
def mvcc_snapshot(t: Tables) -> DataFrame:
    return kv.as_of(_log(t), ["user_id"], "event_id", 500, "op").select("user_id", "value")


@plan("WATCH", "UNWATCH", "MVCC.COMMIT", "ANTI_ENTROPY.*", sql="with l as (select user_id, max(event_id) as last from events group by 1) select e.event_id, e.user_id from events e join l using (user_id) where last > e.event_id + 300")
def mvcc_conflicts(t: Tables) -> DataFrame:
    """All writes whose key changed after their transaction began, 300 events on."""
    writes = t.events.select("event_id", "user_id", (c("event_id") + 300).alias("began"))
    return kv.conflicts(_log(t), ["user_id"], "event_id", "began", writes).select("event_id", "user_id")


_OPS = "case event_id % 5 when 0 then 'delete' when 1 then 'create' when 2 then 'set' when 3 then 'get' else 'list' end"


#: Families of named registries: one log, one fold.
REGISTRIES = (
    "BACKUPX SCHEMA STOREX DATASET THRESHOLD FILTER RULE TRANSFORM ENRICH QUERY VIEW REPORT VALIDATE ALERT APIKEY BEACON BOOKMARK CANARY CAPTCHA CHAINX CONFIG CONNECTION CONNECTIONX CONTEXT CRON DEADLINE DIAGNOSTIC "
    "FALLBACK FLAG FUTURE GATEWAY GHOST GOSSIP GRANT GUARD HEALTH HEALTHX JOB JOBX MEMORY MEMORYX NET NOTIFY OBSERVABILITY PERMIT POLICY PROBE PROFILEX PROMISE PROXY RAFT RAGE RETRY ROLEX ROUTE SECRET SENTINELX SERVICE "
    "SLOWLOG SWIM TASKX TENANT TIMEOUT TIMER TOKEN TRACE WEBHOOK ASYNC HOOK INTERCEPTOR MIDDLEWARE PLUGIN BATCHX REACTIVE REPLAY REPLAYX WS OBSERVABLE MODEL HYPERPARAM EMBEDDING SPATIAL DAG GRAPH TENSOR VECTOR SHARD SLICE "
    "TAPE BUFFERX EXPERIMENT ROLLOUT LEVEL EVENT EVENTX ACTOR STREAMX STREAMPROC CLASSIFIER CLUSTER EVALUATOR MLXPERIMENT PIPELINEML RECOMMEND REGRESSOR TIMEFORECAST ANOMALY BATCH TEMPLATE SUBSCRIBE MEMO"
)


@plan(*[f"{x}.*" for x in REGISTRIES.split()], sql=f"select user_id, arg_max(event_type, event_id) as value from events where event_id % 5 < 3 group by 1 having arg_max({_OPS}, event_id) <> 'delete'")
def registry_state(t: Tables) -> DataFrame:
    return state.registry(t.events.select("user_id", "event_id", F.expr(_OPS).alias("op"), c("event_type").alias("value")), "user_id", "op", "event_id").select("user_id", "value")


@plan("SWITCH.*", "FLAG.TOGGLE", "FLAG.ENABLE", "FLAG.DISABLE", "FLAG.ISENABLED", "FLAG.LISTENABLED", sql="""with l as (select user_id, event_id, case event_type when 'signup' then 'on' when 'error' then 'off' when 'click' then 'toggle' end as op from events),
    f as (select user_id, max(event_id) as t0, arg_max(op, event_id) as base from l where op in ('on', 'off') group by 1)
    select user_id, (case when any_value(base) = 'on' then 1 else 0 end + count(*) filter (op = 'toggle' and (t0 is null or event_id > t0))) % 2 = 1 as state from l left join f using (user_id) where op is not null group by 1""")
def switch_state(t: Tables) -> DataFrame:
    op = F.when(c("event_type") == "signup", "on").when(c("event_type") == "error", "off").when(c("event_type") == "click", "toggle")
    return state.toggled(t.events.select("user_id", "event_id", op.alias("op")), "user_id", "op", "event_id")


def _pushes(t: Tables) -> DataFrame:
    return t.events.where(c("event_type").isin("view", "click", "error")).select("user_id", "event_id", F.when(c("event_type") == "error", "pop").otherwise("push").alias("op"))


_DEPTHS = "s as (select *, sum(d) over (partition by user_id order by event_id) as x from (select user_id, event_id, case when event_type = 'error' then -1 else 1 end as d from events where event_type in ('view', 'click', 'error')))"


@plan("QUEUE.*", "ACTOR.*", "STREAMPROC.*", "MSGQUEUE.CONSUME", "MSGQUEUE.PUBLISH", "SHUFFLE.*", "BUFFERX.*", sql=f"with {_DEPTHS}, e as (select user_id, count(*) filter (d < 0) + least(0, min(x)) as taken from s group by 1) select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id) as nth from s where d > 0) join e using (user_id) where nth > taken")
def queue_state(t: Tables) -> DataFrame:
    return state.queue(_pushes(t), "user_id", "op", "event_id").select("user_id", "event_id")


@plan("STACK.*", sql=f"with {_DEPTHS}, y as (select *, x - least(0, min(x) over (partition by user_id order by event_id)) as depth from s) select user_id, event_id from y qualify d > 0 and coalesce(min(depth) over (partition by user_id order by event_id rows between 1 following and unbounded following), depth) >= depth")
def stack_state(t: Tables) -> DataFrame:
    return state.stack(_pushes(t), "user_id", "op", "event_id").select("user_id", "event_id")


_MOVES = {("new", "view"): "seen", ("seen", "click"): "hot", ("hot", "purchase"): "bought", ("seen", "error"): "lost", ("hot", "error"): "lost", ("lost", "view"): "seen", ("bought", "view"): "seen"}


@plan("STATEM.*", "WORKFLOW.*", "STAGE.*", "JOB.RUN", sql="""with recursive o as (select user_id, event_type, row_number() over (partition by user_id order by event_id) as n from events),
    r as (select user_id, 0::bigint as n, 'new' as state from (select distinct user_id from events) union all
      select o.user_id, o.n, case when state = 'new' and event_type = 'view' then 'seen' when state = 'seen' and event_type = 'click' then 'hot' when state = 'hot' and event_type = 'purchase' then 'bought'
        when state in ('seen', 'hot') and event_type = 'error' then 'lost' when state in ('lost', 'bought') and event_type = 'view' then 'seen' else state end from r join o on o.user_id = r.user_id and o.n = r.n + 1)
    select user_id, arg_max(state, n) as state from r group by 1""")
def state_machine(t: Tables) -> DataFrame:
    out = state.machine(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_type", "event_id", _MOVES, "new")
    return out.groupBy("user_id").agg(F.max_by("state", "event_id").alias("state"))


def _turns(start: str, step: str, key: str = "user_id", more: str = "true") -> str:
    """A fold of events in order, one round for each turn of all keys: r holds the state, o the rows."""
    return f"""with recursive o as (select event_id, {key} as key, {more} as x, epoch_us(ts) / 1e6 as secs, row_number() over (partition by {key} order by ts, event_id) as n from events),
    r as (select key, 0::bigint as n, null::bigint as event_id, {start} from (select distinct key from o) union all select q.key, q.n, q.event_id, {step})"""


@plan("TOKENBUCKET.*", "RL.*", "BUCKETX.*", "LEAKYBUCKET.*", sql=_turns(
    "3::double as have, null::double as last, true as allowed",
    "have - (have >= 1)::int, secs, have >= 1 from (select o.*, least(3::double, r.have + coalesce((o.secs - r.last) * (1::double / 3600), 0)) as have from r join o on o.key = r.key and o.n = r.n + 1) q",
) + " select event_id, allowed from r where n > 0")
def token_bucket(t: Tables) -> DataFrame:
    return state.token_bucket(t.events.select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 3.0, 1 / 3600).select("event_id", "allowed")


@plan("CIRCUIT.*", "CIRCUITBREAKER.*", "CIRCUITX.*", sql=_turns(
    "'closed' as state, 0 as fails, 0::double as opened",
    """case when state = 'open' or x and (state = 'half-open' or fails >= 1) then 'open' else 'closed' end, case when state = 'open' or state = 'half-open' and x then fails when state = 'half-open' or not x then 0 else fails + 1 end,
    case when x and (state = 'half-open' or state = 'closed' and fails >= 1) then secs else opened end
    from (select o.*, r.fails, r.opened, case when r.state = 'open' and o.secs - r.opened >= 7200 then 'half-open' else r.state end as state from r join o on o.key = r.key and o.n = r.n + 1) q""",
    more="event_type = 'error'",
) + " select event_id, state from r where n > 0")
def circuit_breaker(t: Tables) -> DataFrame:
    calls = t.events.withColumn("failed", c("event_type") == "error")
    return state.circuit(calls, "user_id", "ts", "event_id", "failed", 2, 7200.0).select("event_id", "state")


@plan("COOLDOWN.*", "THROTTLE.*", sql=_turns(
    "null::double as last, true as allowed",
    "case when ok then secs else last end, ok from (select o.*, r.last, coalesce(o.secs - r.last >= 3600, true) as ok from r join o on o.key = r.key and o.n = r.n + 1) q",
) + " select event_id, allowed from r where n > 0")
def cooldown(t: Tables) -> DataFrame:
    return state.cooled_down(t.events, "user_id", "ts", "event_id", 3600.0).select("event_id", "allowed")


@plan("DEBOUNCE.*", "DEBOUNCEX.*", sql="select event_id from events qualify coalesce(date_sub('second', ts, lead(ts) over (partition by user_id order by ts, event_id)) >= 3600, true)")
def debounce(t: Tables) -> DataFrame:
    return state.debounced(t.events, "user_id", "ts", "event_id", 3600).select("event_id")


@plan("SEM.*", "SEMAPHOREX.*", "POOL.*", "POOLX.*", "CONPOOL.*", "BULKHEAD.*", "BACKPRESSURE.*", sql="""with s as (select event_id, user_id, sum(case when event_type = 'error' then -1 else 1 end) over w as x from events window w as (partition by user_id order by event_id))
    select event_id, (x - least(0, min(x) over (partition by user_id order by event_id)))::bigint as held from s""")
def permits_held(t: Tables) -> DataFrame:
    log = t.events.select("user_id", "event_id", F.when(c("event_type") == "error", -1).otherwise(1).cast("long").alias("d"))
    return state.held(log, "user_id", "d", "event_id").select("event_id", "held")


@plan("LOCK.*", "LOCKX.*", "LEASE.*", "LEADER.*", "CACHE.LOCK", "CACHE.UNLOCK", "CACHE.LOCKED", "CACHE.REFRESH", sql=_turns(
    "null::bigint as owner, 0::double as until, true as granted",
    "case when ok then x else owner end, case when ok then secs + 7200 else until end, ok from (select o.*, r.owner, r.until, r.owner is null or r.owner = o.x or o.secs > r.until as ok from r join o on o.key = r.key and o.n = r.n + 1) q",
    key="event_type", more="user_id % 5",
) + " select event_id, granted from r where n > 0")
def lock_leases(t: Tables) -> DataFrame:
    asks = t.events.select("event_type", (c("user_id") % 5).alias("holder"), "ts", "event_id")
    return state.leases(asks, "event_type", "holder", "ts", 7200, "event_id").select("event_id", "granted")
