"""Queries of sources, sinks, user code and pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scripts import Functions, Pipeline
from ..operators import kv, replay
from ..sources import files, oplog
from ..streaming.windows import folder
from .base import Tables, plan

c = F.col


@plan("BACKUP.*", "BACKUPX.*", "DUMP", "RESTORE", "KEY.DUMP", "KEY.RESTORE", "CACHE.EXPORT", "CACHE.IMPORT", "MIGRATE", sql="select c_custkey, c_name from customer")
def backup_restore(t: Tables) -> DataFrame:
    at = folder(t.spark)
    files.snapshot({"customer": t.customer.select("c_custkey", "c_name")}, at)
    return files.restore(t.spark, at, "customer")["customer"]


def _round_trip(fmt: str) -> None:
    def run(t: Tables) -> DataFrame:
        rows = t.nation.select("n_nationkey", "n_name")
        at = folder(t.spark)
        files.write(rows, at, fmt)
        return files.read(t.spark, at, fmt, rows.schema)

    plan("CACHE.EXPORT", "CACHE.IMPORT", name=f"file_{fmt}", sql="select n_nationkey, n_name from nation")(run)


for _fmt in ("parquet", "orc", "json", "csv"):
    _round_trip(_fmt)


@plan("COMPACT.*", sql="select count(*) as n, sum(l_quantity) as q from lineitem")
def compaction(t: Tables) -> DataFrame:
    at = folder(t.spark)
    files.write(t.lineitem.select("l_quantity").repartition(8), f"{at}/many")
    files.compact(t.spark, f"{at}/many", f"{at}/few", 2)
    return files.read(t.spark, f"{at}/few").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


@plan("SET", "FLUSHDB", "FLUSHALL", sql="select c_custkey::varchar as key, c_name as value from customer")
def command_log(t: Tables) -> DataFrame:
    """Commands written as RESP, read back and folded."""
    at = folder(t.spark)
    oplog.write(t.customer, at, "SET", "c_custkey", "c_name")
    log = oplog.read(t.spark, at).select(F.get("args", 0).cast("string").alias("key"), F.get("args", 1).cast("string").alias("value"), F.struct("file", "seq").alias("at"))
    return kv.latest(log, ["key"], "at").select("key", "value")


@plan("WARM.*", "CACHE.PREFETCH", "MEMO.WARM", sql="select count(*) as n from part where p_size > 40")
def cache_warm(t: Tables) -> DataFrame:
    return t.part.where("p_size > 40").agg(F.count("*").alias("n"))


@plan("NAMESPACE", "NAMESPACES", "NAMESPACEDEL", "SELECT", sql="select true as made")
def namespaces(t: Tables) -> DataFrame:
    t.spark.sql("CREATE DATABASE IF NOT EXISTS tidepool_ns")
    found = t.spark.catalog.databaseExists("tidepool_ns")
    t.spark.sql("DROP DATABASE IF EXISTS tidepool_ns")
    return t.spark.createDataFrame([(found and not t.spark.catalog.databaseExists("tidepool_ns"),)], "made boolean")


@plan("SCHEMA.*", sql="select count(*) as n from customer where c_acctbal > 0")
def schema_validate(t: Tables) -> DataFrame:
    """Rows that a schema and its condition accept."""
    return t.customer.to(t.spark.createDataFrame([], "c_custkey long, c_acctbal double").schema).where("c_acctbal > 0").agg(F.count("*").alias("n"))


@plan("VIEW.*", "QUERY.*", "REPORT.*", sql="select n_regionkey, count(*) as n from nation group by 1")
def view_query(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("tidepool_nation")
    return t.spark.sql("SELECT n_regionkey, count(*) AS n FROM tidepool_nation GROUP BY n_regionkey")


@plan("DATASET.*")
def dataset_split(t: Tables) -> DataFrame:
    """A stable split by hash of the key."""
    return t.customer.select("c_custkey", (F.pmod(F.xxhash64("c_custkey"), F.lit(100)) < 80).alias("train")).groupBy("train").agg(F.count("*").alias("n"))


@plan("FUNCTION", "FCALL", "FCALL_RO", "MODULE", "PLUGIN.*", sql="select p_partkey, p_retailprice * 1.2::double + 3 as value from part")
def function_call(t: Tables) -> DataFrame:
    fns = Functions(t.spark)
    fns.load("with_tax", "price DOUBLE, fee DOUBLE", "DOUBLE", "price * 1.2D + fee")
    return t.part.select("p_partkey", F.expr("with_tax(p_retailprice, 3.0D)").alias("value"))


@plan("EVAL", "EVALSHA", "SCRIPT", sql="select p_partkey, case when p_size > 20 then upper(p_name) else p_brand end as value from part")
def script_eval(t: Tables) -> DataFrame:
    fns = Functions(t.spark)
    sha = fns.script("if(p_size > 20, upper(p_name), p_brand)")
    return fns.evaluate(t.part, sha).select("p_partkey", "value")


@plan("PIPELINE.*", "PIPELINEX.*", "PIPELINEML.*", "MIDDLEWARE.*", "INTERCEPTOR.*", "HOOK.*", "BATCHX.*", "CHAINX.*", sql="select p_brand, count(*) as n, round(avg(p_retailprice) * 1.1, 2) as price from part where p_size > 10 group by 1")
def pipeline_steps(t: Tables) -> DataFrame:
    p = Pipeline("prices").add("keep", lambda df: df.where("p_size > 10")).add("group", lambda df: df.groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("price")))
    p.after.append(lambda df: df.withColumn("price", F.round(c("price") * 1.1, 2)))
    return p(t.part)


@plan("BATCH.SUBMIT", "BATCH.STATUS", "BATCH.LIST", "BATCH.CANCEL", "COMMAND", "PING", "ECHO", sql="select o_orderstatus as status, count(*) as n from orders group by 1")
def batch_status(t: Tables) -> DataFrame:
    return t.orders.groupBy(c("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


def _orders_log(t: Tables, op: str, *args: str) -> DataFrame:
    """Orders as commands, in the order of their keys."""
    return t.orders.select(c("o_orderkey").alias("seq"), F.lit(op).alias("op"), F.array(*[F.expr(a).cast("string").cast("binary") for a in args]).alias("args"))


@plan("HSET", "HMSET", sql="select o_custkey::varchar as key, o_orderpriority as field, arg_max(o_orderkey, o_orderkey)::varchar as value from orders group by 1, 2")
def replay_hashes(t: Tables) -> DataFrame:
    return replay.hashes(_orders_log(t, "HSET", "o_custkey", "o_orderpriority", "o_orderkey"))


@plan("INCRBY", "INCR", sql="select o_custkey::varchar as key, count(*)::varchar as value from orders group by 1")
def replay_counters(t: Tables) -> DataFrame:
    return replay.strings(_orders_log(t, "INCR", "o_custkey"))


@plan("SADD", sql="select distinct o_orderstatus as key, o_custkey::varchar as member from orders")
def replay_sets(t: Tables) -> DataFrame:
    return replay.sets(_orders_log(t, "SADD", "o_orderstatus", "o_custkey"))


@plan("ZADD", "ZINCRBY", sql="select o_orderstatus as key, o_custkey::varchar as member, sum(o_orderkey % 100)::double as score from orders group by 1, 2")
def replay_ranked(t: Tables) -> DataFrame:
    return replay.ranked_sets(_orders_log(t, "ZINCRBY", "o_orderstatus", "o_orderkey % 100", "o_custkey"))


@plan("RPUSH", sql="select o_custkey::varchar as key, row_number() over (partition by o_custkey order by o_orderkey)::int as pos, o_orderkey::varchar as value from orders")
def replay_lists(t: Tables) -> DataFrame:
    return replay.lists(_orders_log(t, "RPUSH", "o_custkey", "o_orderkey"))


@plan("RENAME", "RENAMENX", "KEY.RENAME", "KEY.RENAMENX", sql="""with o as (select o_orderkey as k, o_custkey as u, o_orderpriority = '1-URGENT' as urgent from orders), m as (select u % 7 as x, max(k) as k, arg_max(k % 3 = 0, k) as old from o where urgent group by 1)
    select u::varchar as key, max(k)::varchar as value from o group by u having not arg_max(urgent, k) union all select 'moved:' || x, k::varchar from m where not old
    union all select 'old:' || u % 7, max(k)::varchar from o where urgent and k % 3 = 0 group by u % 7""")
def replay_renames(t: Tables) -> DataFrame:
    """Each order sets its customer's key; urgent ones rename it, every third of them twice, onto keys that all share."""
    key = c("o_custkey").cast("string")
    moved, old = (F.concat(F.lit(f"{x}:"), (c("o_custkey") % 7).cast("string")) for x in ("moved", "old"))
    urgent = c("o_orderpriority") == "1-URGENT"
    step = lambda i, op, a, b, cond: F.when(cond, F.struct((c("o_orderkey") * 3 + i).alias("seq"), F.lit(op).alias("op"), F.array(a.cast("binary"), b.cast("binary")).alias("args")))
    steps = F.array_compact(F.array(step(0, "SET", key, c("o_orderkey").cast("string"), F.lit(True)), step(1, "RENAME", key, moved, urgent), step(2, "RENAME", moved, old, urgent & (c("o_orderkey") % 3 == 0))))
    return replay.strings(replay.renamed(t.orders.select(F.explode(steps).alias("x")).select("x.*")))
