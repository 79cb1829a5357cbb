"""A keyspace from its command log.

Rows of ``(seq, op, args)``, as ``sources.oplog`` reads them, become one table for each kind of value.
Each fold is a few groupBys: what comes before a key's last reset is left out, the last write of
each field or member wins, and increments after it are summed. seq orders all commands. A log holds the
commands that took effect, so a rename has a source and an increment meets a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

#: Commands that make a key vanish, whatever its kind.
GONE = ("DEL", "UNLINK", "GETDEL")
FLUSHES = ("FLUSHDB", "FLUSHALL")
RENAMES = ("RENAME", "RENAMENX")
#: Commands that put a string in place of whatever the key held.
REPLACES = ("SET", "SETEX", "PSETEX", "MSET")


def _arg(i: int) -> Column:
    return F.get("args", i).cast("string")


def _rows(log: DataFrame, *ops: str) -> DataFrame:
    return log.where(F.col("op").isin(*ops)).withColumn("key", _arg(0))


def single(log: DataFrame) -> DataFrame:
    """The log with a row for each key: deletes and MSET by key, SMOVE as SREM and SADD."""
    text = F.col("args").cast("array<string>")
    pairs = F.expr("transform(sequence(0, size(args) div 2 - 1), i -> struct('SET' as op, array(args[2 * i], args[2 * i + 1]) as args))")
    gone = F.transform(text, lambda k: F.struct(F.lit("DEL").alias("op"), F.array(k.cast("binary")).alias("args")))
    key = lambda i: F.get("args", i)
    move = F.array(F.struct(F.lit("SREM").alias("op"), F.array(key(0), key(2)).alias("args")), F.struct(F.lit("SADD").alias("op"), F.array(key(1), key(2)).alias("args")))
    same = F.array(F.struct("op", "args"))
    cases = F.when(F.col("op") == "MSET", pairs).when(F.col("op").isin(*GONE), gone).when(F.col("op") == "SMOVE", move).otherwise(same)
    return log.select("seq", F.explode(cases).alias("r")).select("seq", "r.op", "r.args")


def renamed(log: DataFrame) -> DataFrame:
    """The log as if each key had always had its last name, without RENAME and RENAMENX.

    A key lives from one delete, flush or rename to the next. A life that a rename ends goes on as a
    life of the new name; one that a delete or a rename onto its key ends is dropped. Lives, not rows,
    are followed, by doubling, so a chain of n renames takes log n rounds. Only keys that a rename
    names are numbered; rows of all others pass.
    """
    log = single(log)
    moves = log.where(F.col("op").isin(*RENAMES)).select("seq", _arg(0).alias("key"), _arg(1).alias("dest")).where("key <> dest")
    ends = moves.select("seq", "key", "dest").union(moves.select("seq", F.col("dest").alias("key"), F.lit(None).cast("string")))
    rows = log.where(~F.col("op").isin(*RENAMES)).withColumn("key", _arg(0))
    flush = F.col("op").isin(*FLUSHES)
    named = ends.select("key").distinct()
    stay, go = (rows.where(~flush).join(named, "key", how).select(*rows.columns) for how in ("left_anti", "left_semi"))
    none = F.lit(None).cast("string").alias("dest")
    ends = ends.union(go.where("op = 'DEL'").select("seq", "key", none).distinct()).union(rows.where(flush).select("seq").crossJoin(named).select("seq", "key", none))
    every = go.where("op <> 'DEL'").select("seq", "key", "op", "args", none, F.lit(0).alias("end")).unionByName(ends.select("*", F.lit(1).alias("end")), allowMissingColumns=True)
    lives = cut(every.withColumn("life", F.sum("end").over(Window.partitionBy("key").orderBy("seq", "end"))))
    # An end closes the life before it and opens its own; a moved life goes on in the one that the same rename opened.
    over = lives.where("end = 1")
    opened = over.where("dest IS NULL").select("seq", F.col("key").alias("dest"), F.col("life").alias("to"))
    path = over.select("seq", "key", "dest", (F.col("life") - 1).alias("life")).join(opened, ["seq", "dest"], "left").select("key", "life", "dest", "to")
    path = cut(path)
    while True:
        on = path.select(F.col("key").alias("dest"), F.col("life").alias("to"), F.col("dest").alias("dest2"), F.col("to").alias("to2"), F.lit(True).alias("further"))
        path = cut(path.join(on, ["dest", "to"], "left").select("key", "life", F.when(F.col("further"), F.col("dest2")).otherwise(F.col("dest")).alias("dest"), F.when(F.col("further"), F.col("to2")).otherwise(F.col("to")).alias("to"), "further"))
        more = path.where("further").limit(1).count()
        path = path.drop("further")
        if not more:
            break
    found = lives.where("end = 0").drop("dest").join(path.select("key", "life", "dest", F.lit(True).alias("over")), ["key", "life"], "left").where("over IS NULL OR dest IS NOT NULL")
    args = F.concat(F.array(F.coalesce("dest", "key").cast("binary")), F.expr("slice(args, 2, greatest(size(args) - 1, 0))"))
    # What is left of the named keys came after the last flush; for all other keys flushes stay in the log.
    return stay.union(rows.where(flush)).select("seq", "op", "args").union(found.select("seq", "op", args))


def resets(log: DataFrame) -> DataFrame:
    """(key, reset): the last command that deleted each key."""
    keys = log.where(F.col("op").isin(*GONE)).select("seq", F.explode(F.col("args").cast("array<string>")).alias("key"))
    return keys.groupBy("key").agg(F.max("seq").alias("reset"))


def _replaced(log: DataFrame) -> DataFrame:
    """(key, reset): the last command that made each key a string."""
    rows = log.where(F.col("op").isin(*REPLACES))
    keys = F.when(F.col("op") == "MSET", F.expr("transform(sequence(0, size(args) div 2 - 1), i -> cast(args[2 * i] as string))")).otherwise(F.array(_arg(0)))
    return rows.select("seq", F.explode(keys).alias("key")).groupBy("key").agg(F.max("seq").alias("reset"))


def _live(rows: DataFrame, log: DataFrame, text: bool = False) -> DataFrame:
    """Rows after the last delete of their key, or for other kinds than text its last SET; a flush deletes all. Row and reset meet by key after both are counted down."""
    flush = log.where(F.col("op").isin(*FLUSHES)).agg(F.max("seq").alias("flush"))
    ends = resets(log) if text else resets(log).union(_replaced(log)).groupBy("key").agg(F.max("reset").alias("reset"))
    out = rows.join(ends, "key", "left").crossJoin(F.broadcast(flush))  # one row
    return out.where((F.col("seq") > F.coalesce("reset", F.lit(-1))) & (F.col("seq") > F.coalesce("flush", F.lit(-1)))).drop("reset", "flush")


def strings(log: DataFrame) -> DataFrame:
    """(key, value) after SET, SETNX, MSET, SETEX, PSETEX, GETSET, APPEND, INCR, INCRBY, DECR and DECRBY.

    Steps and appends apply in the order of seq to the last value set. SETNX writes only keys that no other write has before it since the last delete.
    """
    pairs = log.where("op = 'MSET'").select("seq", F.lit("SET").alias("op"), F.explode(F.expr("transform(sequence(0, size(args) div 2 - 1), i -> array(args[2 * i], args[2 * i + 1]))")).alias("args"))
    rows = _live(_rows(log.select("seq", "op", "args").union(pairs), "SET", "SETNX", "SETEX", "PSETEX", "GETSET", "APPEND", "INCR", "INCRBY", "DECR", "DECRBY"), log, text=True)
    first = F.row_number().over(Window.partitionBy("key").orderBy("seq")) == 1
    rows = rows.withColumn("first", first).where("op <> 'SETNX' OR first")
    value = F.when(F.col("op").isin("SETEX", "PSETEX"), _arg(2)).otherwise(_arg(1))
    sets = rows.where(F.col("op").isin("SET", "SETNX", "SETEX", "PSETEX", "GETSET")).groupBy("key").agg(F.max("seq").alias("at"), F.max_by(value, F.col("seq")).alias("base"))
    later = rows.join(sets, "key", "left").where(F.col("at").isNull() | (F.col("seq") > F.col("at")))
    step = F.when(F.col("op") == "INCR", 1).when(F.col("op") == "DECR", -1).when(F.col("op") == "INCRBY", _arg(1).cast("long")).when(F.col("op") == "DECRBY", -_arg(1).cast("long")).cast("long")
    later = later.where(F.col("op").isin("APPEND", "INCR", "INCRBY", "DECR", "DECRBY")).select("key", "seq", step.alias("step"), F.when(F.col("op") == "APPEND", _arg(1)).alias("tail"))
    both = F.count("step") * F.count("tail") > 0
    mixed = later.groupBy("key").agg(both.alias("mixed")).where("mixed").select("key")
    # Steps commute with steps; only where appends stand between them does the order of the two matter.
    order = Window.partitionBy("key").orderBy("seq")
    turns = later.join(mixed, "key", "left_semi").withColumn("turn", F.coalesce(F.lag(F.col("tail").isNull()).over(order) != F.col("tail").isNull(), F.lit(True)).cast("int"))
    runs = turns.withColumn("run", F.sum("turn").over(order)).unionByName(later.join(mixed, "key", "left_anti").withColumns({"turn": F.lit(0), "run": F.lit(0).cast("long")}))
    tail = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("tail").isNotNull(), F.struct("seq", F.col("tail").alias("v"))))), lambda x: x["v"]), "")
    parts = runs.groupBy("key", "run").agg(F.sum("step").alias("steps"), tail.alias("tail")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("run", "steps", "tail"))).alias("parts"))

    def fold(value: Column, x: Column) -> Column:
        """A step counts on from a number or from nothing; on other text it fails and changes nothing."""
        number = F.when(F.coalesce(value, F.lit("")) == "", F.lit(0).cast("long")).otherwise(value.try_cast("long"))
        return F.when(x["steps"].isNull(), F.concat(F.coalesce(value, F.lit("")), x["tail"])).when(number.isNull(), value).otherwise((number + x["steps"]).cast("string"))

    out = sets.join(parts, "key", "full")
    none = F.array().cast("array<struct<run: bigint, steps: bigint, tail: string>>")
    return out.select("key", F.aggregate(F.coalesce("parts", none), F.col("base"), fold).alias("value"))


def _pairs(rows: DataFrame, start: int) -> DataFrame:
    """A row for each two arguments from ``start`` on."""
    cut = F.expr(f"transform(sequence(0, (size(args) - {start}) div 2 - 1), i -> struct(cast(args[{start} + 2 * i] as string) as a, cast(args[{start} + 2 * i + 1] as string) as b))")
    return rows.select("seq", "op", "key", F.explode(cut).alias("p")).select("seq", "op", "key", "p.a", "p.b")


def _each(rows: DataFrame, start: int = 1) -> DataFrame:
    return rows.select("seq", "op", "key", F.explode(F.slice(F.col("args").cast("array<string>"), F.lit(start + 1), F.size("args"))).alias("a"))


def hashes(log: DataFrame) -> DataFrame:
    """(key, field, value) after HSET, HMSET, HSETNX, HDEL and HINCRBY. A log holds HSETNX only where the field was new, so it writes like HSET."""
    puts = _pairs(_live(_rows(log, "HSET", "HMSET", "HSETNX"), log), 1)
    cuts = _each(_live(_rows(log, "HDEL"), log)).withColumn("b", F.lit(None).cast("string"))
    steps = _live(_rows(log, "HINCRBY"), log).select("seq", "key", _arg(1).alias("a"), _arg(2).cast("double").alias("d"))
    return _counted(puts.union(cuts), steps).select("key", F.col("a").alias("field"), "value")


def _counted(writes: DataFrame, steps: DataFrame) -> DataFrame:
    """(key, a, value): the last write, null for a removal, plus the steps after it."""
    last = writes.groupBy("key", "a").agg(F.max("seq").alias("at"), F.max_by("b", "seq").alias("base"))
    after = steps.join(last, ["key", "a"], "left").where(F.col("at").isNull() | (F.col("seq") > F.col("at"))).groupBy("key", "a").agg(F.sum("d").alias("steps"))
    both = last.join(after, ["key", "a"], "full").where("base IS NOT NULL OR steps IS NOT NULL")
    number = F.coalesce(F.col("base").try_cast("double"), F.lit(0.0)) + F.col("steps")
    whole = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))
    return both.select("key", "a", F.when(F.col("steps").isNotNull(), whole).otherwise(F.col("base")).alias("value"))


def sets(log: DataFrame) -> DataFrame:
    """(key, member) after SADD and SREM."""
    rows = _each(_live(_rows(log, "SADD", "SREM"), log))
    return rows.groupBy("key", "a").agg(F.max_by("op", "seq").alias("op")).where("op = 'SADD'").select("key", F.col("a").alias("member"))


def ranked_sets(log: DataFrame) -> DataFrame:
    """(key, member, score) after ZADD without options, ZREM and ZINCRBY."""
    puts = _pairs(_live(_rows(log, "ZADD"), log), 1).select("seq", "op", "key", F.col("b").alias("a"), F.col("a").alias("b"))
    cuts = _each(_live(_rows(log, "ZREM"), log)).withColumn("b", F.lit(None).cast("string"))
    steps = _live(_rows(log, "ZINCRBY"), log).select("seq", "key", _arg(2).alias("a"), _arg(1).cast("double").alias("d"))
    return _counted(puts.union(cuts), steps).select("key", F.col("a").alias("member"), F.col("value").cast("double").alias("score"))


def lists(log: DataFrame) -> DataFrame:
    """(key, pos, value) after RPUSH and LPUSH; positions grow from left to right. Pops are folds of ``state.queue`` and ``state.stack``."""
    rows = _live(_rows(log, "RPUSH", "LPUSH"), log)
    each = rows.select("seq", "op", "key", F.posexplode(F.slice("args", F.lit(2), F.size("args"))).alias("i", "v"))
    side = F.when(F.col("op") == "RPUSH", 1).otherwise(-1)
    nth = F.row_number().over(Window.partitionBy("key", "op").orderBy("seq", "i"))
    return each.select("key", (side * nth).alias("pos"), F.col("v").cast("string").alias("value"))


def streams(log: DataFrame) -> DataFrame:
    """(key, id, fields) after XADD with ids and XDEL."""
    added = _live(_rows(log, "XADD"), log).where(_arg(1) != "*")
    fields = F.expr("map_from_entries(transform(sequence(0, (size(args) - 2) div 2 - 1), i -> struct(cast(args[2 + 2 * i] as string), cast(args[3 + 2 * i] as string))))")
    gone = _each(_rows(log, "XDEL")).select("key", F.col("a").alias("id"))
    return added.select("key", _arg(1).alias("id"), fields.alias("fields")).join(gone, ["key", "id"], "left_anti")


def tables(log: DataFrame) -> dict[str, DataFrame]:
    """All kinds of value after every command of the log, renames, moves and changes of kind among them."""
    log = renamed(log)
    return {"strings": strings(log), "hashes": hashes(log), "sets": sets(log), "ranked_sets": ranked_sets(log), "lists": lists(log), "streams": streams(log)}
