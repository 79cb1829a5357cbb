"""Queries of math, date, array, codec, bit and validation functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as a
from ..functions import dates as d
from ..functions import maths as m
from .base import scalars


def c(name: str):
    return F.col(name)


_n = lambda: c("p_partkey") - 100
scalars(
    "part",
    "p_partkey",
    {
        "math_abs": ("MATH.ABS", lambda: F.abs(_n()), "abs(p_partkey - 100)"),
        "math_add": ("MATH.ADD", lambda: m.add(c("p_partkey"), c("p_size").cast("long"), F.lit(7).cast("long")), "p_partkey + p_size + 7"),
        "math_sub": ("MATH.SUB", lambda: m.sub(c("p_partkey"), c("p_size").cast("long"), F.lit(7).cast("long")), "p_partkey - p_size - 7"),
        "math_mul": ("MATH.MUL", lambda: m.mul(c("p_partkey"), c("p_size").cast("long")), "p_partkey * p_size"),
        "math_div": ("MATH.DIV", lambda: m.div(_n(), c("p_size") - 25), "case when p_size <> 25 then (trunc((p_partkey - 100)::double / (p_size - 25)))::bigint end"),
        "math_mod": ("MATH.MOD", lambda: m.mod(_n(), c("p_size").cast("long")), "case when p_size <> 0 then (p_partkey - 100) % p_size end"),
        "math_pow": ("MATH.POW", lambda: m.power(c("p_size"), 3), "pow(p_size, 3)"),
        "math_sqrt": ("MATH.SQRT", lambda: F.sqrt(c("p_retailprice")), "sqrt(p_retailprice)"),
        "math_floor": ("MATH.FLOOR", lambda: F.floor(c("p_retailprice") - 901).cast("double"), "floor(p_retailprice - 901)"),
        "math_ceil": ("MATH.CEIL", lambda: F.ceil(c("p_retailprice") - 901).cast("long"), "ceil(p_retailprice - 901)::bigint"),
        "math_round": ("MATH.ROUND", lambda: F.round(c("p_retailprice") - 901.05).cast("long"), "round(p_retailprice - 901.05)::bigint"),
        "math_max": ("MATH.MAX", lambda: F.greatest("p_partkey", c("p_size").cast("long")), "greatest(p_partkey, p_size)"),
        "math_min": ("MATH.MIN", lambda: F.least("p_partkey", c("p_size").cast("long")), "least(p_partkey, p_size)"),
        "math_expr": ("EVAL.EXPR", lambda: m.evaluate("(p_partkey + 2) * p_size - p_size ^ 2 / 4"), "((p_partkey + 2) * p_size - pow(p_size, 2) / 4)::double"),
        "math_random": ("MATH.RANDOM", lambda: m.random_between(1, 6), None),
    },
)
_o = lambda: c("o_orderdate").cast("timestamp")
scalars(
    "orders",
    "o_orderkey",
    {
        "timestamp_add_month": ("TIMESTAMP.ADD", lambda: d.add(_o(), "months", 1).cast("timestamp"), "o_orderdate + interval 1 month"),
        "timestamp_add_week": ("TIMESTAMP.ADD", lambda: d.add(_o(), "week", 2).cast("timestamp"), "o_orderdate + interval 14 day"),
        "timestamp_diff_days": ("TIMESTAMP.DIFF", lambda: d.diff(F.lit("1995-06-17").cast("timestamp"), _o(), "day"), "date_sub('day', timestamp '1995-06-17', o_orderdate)"),
        "timestamp_startof_month": ("TIMESTAMP.STARTOF", lambda: d.start_of(_o(), "month"), "date_trunc('month', o_orderdate)::timestamp"),
        "timestamp_startof_week": ("TIMESTAMP.STARTOF", lambda: d.start_of(_o(), "week"), "date_trunc('day', o_orderdate)::timestamp - to_days(dayofweek(o_orderdate)::int)"),
        "timestamp_endof_year": ("TIMESTAMP.ENDOF", lambda: d.end_of(_o(), "year"), "date_trunc('year', o_orderdate)::timestamp + interval 1 year - interval 1 second"),
        "timestamp_format": ("TIMESTAMP.FORMAT", lambda: d.fmt(_o(), "yyyy/MM/dd HH:mm"), "strftime(o_orderdate, '%Y/%m/%d %H:%M')"),
        "timestamp_parse": ("TIMESTAMP.PARSE", lambda: F.unix_seconds(d.parse((F.unix_seconds(_o()) + 1_000_000_000).cast("string"))), "epoch(o_orderdate)::bigint + 1000000000"),
        "timestamp_now": ("TIMESTAMP.NOW TIME", lambda: d.now().getField("s") > 0, "true"),
    },
)
_w = lambda: F.split("p_name", " ")
_l = lambda: F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ")
_j = lambda x: F.array_join(x, "|")
_W, _L = "str_split(p_name, ' ')", "str_split(concat_ws(' ', p_name, p_type, p_name), ' ')"
_x = lambda: F.element_at(_w(), 1)
_X = f"({_W})[1]"


def _s(sql: str) -> str:
    return f"array_to_string({sql}, '|')"


scalars(
    "part",
    "p_partkey",
    {
        "array_push": ("ARRAY.PUSH RPUSH RPUSHX SLICE.APPEND BUFFERX.WRITE TAPE.WRITE", lambda: _j(a.push(_l(), F.lit("x"), F.lit("y"))), _s(f"{_L} || ['x', 'y']")),
        "array_unshift": ("ARRAY.UNSHIFT LPUSH LPUSHX", lambda: _j(a.unshift(_l(), F.lit("x"), F.lit("y"))), _s(f"['y', 'x'] || {_L}")),
        "array_prepend": ("LMPUSH", lambda: _j(a.prepend(_l(), F.lit("x"), F.lit("y"))), _s(f"['x', 'y'] || {_L}")),
        "array_pop": ("ARRAY.POP RPOP", lambda: _j(a.pop(_l())), _s(f"{_L}[1:len({_L}) - 1]")),
        "array_shift": ("ARRAY.SHIFT LPOP LMPOP BLPOP BLMPOP BRPOP", lambda: _j(a.shift(_l())), _s(f"{_L}[2:]")),
        "array_slice": ("ARRAY.SLICE SLICE.GET BUFFERX.READ TAPE.READ TAPE.SEEK", lambda: _j(a.slice_(_l(), 1, 3)), _s(f"{_L}[2:3]")),
        "array_splice": ("ARRAY.SPLICE", lambda: _j(a.splice(_l(), 1, 2, F.lit("z"))), _s(f"{_L}[1:1] || ['z'] || {_L}[4:]")),
        "array_reverse": ("ARRAY.REVERSE", lambda: _j(F.reverse(_l())), _s(f"list_reverse({_L})")),
        "array_sort": ("ARRAY.SORT", lambda: _j(a.sort(_l(), True)), _s(f"list_reverse_sort({_L})")),
        "array_unique": ("ARRAY.UNIQUE", lambda: F.size(a.unique(_l())).cast("long"), f"len(list_distinct({_L}))"),
        "array_includes": ("ARRAY.INCLUDES", lambda: F.array_contains(_l(), "ring"), f"list_contains({_L}, 'ring')"),
        "array_indexof": ("ARRAY.INDEXOF", lambda: a.index_of(_l(), F.lit("ring")), f"(coalesce(list_position({_L}, 'ring'), 0) - 1)::bigint"),
        "array_lastindexof": ("ARRAY.LASTINDEXOF", lambda: a.last_index_of(_l(), _x()).cast("long"), f"(len({_L}) - list_position(list_reverse({_L}), {_X}))::bigint"),
        "array_intersect": ("ARRAY.INTERSECT", lambda: _j(F.sort_array(F.array_intersect(_l(), _w()))), _s(f"list_sort(list_distinct(list_filter({_L}, lambda v: list_contains({_W}, v))))")),
        "array_diff": ("ARRAY.DIFF", lambda: _j(a.diff(F.concat(_l(), _l()), _w())), _s(f"list_filter({_L} || {_L}, lambda v: not list_contains({_W}, v))")),
        "array_merge": ("ARRAY.MERGE", lambda: _j(F.concat(_l(), _w())), _s(f"{_L} || {_W}")),
        "array_flatten": ("ARRAY.FLATTEN", lambda: _j(F.flatten(F.array(_l(), _w()))), _s(f"flatten([{_L}, {_W}])")),
        "list_index": ("LINDEX", lambda: a.at(_l(), -2), f"{_L}[-2]"),
        "list_len": ("LLEN", lambda: F.size(_l()).cast("long"), f"len({_L})"),
        "list_range": ("LRANGE LTRIM", lambda: _j(a.range_(_l(), -3, -2)), _s(f"{_L}[len({_L}) - 2:len({_L}) - 1]")),
        "list_set": ("LSET", lambda: _j(a.set_at(_l(), 1, F.lit("new"))), _s(f"{_L}[1:1] || ['new'] || {_L}[3:]")),
        "list_insert": ("LINSERT", lambda: _j(a.insert(_l(), c("p_type"), F.lit("here"))), _s(f"{_W} || ['here', p_type] || {_W}")),
        "list_remove": ("LREM", lambda: _j(a.remove(_l(), _x(), -1)), _s(f"{_W} || [p_type] || {_W}[2:]")),
        "list_pos": ("LPOS", lambda: _j(a.positions(_l(), _x()).cast("array<string>")), _s(f"list_transform(list_filter(range(1, len({_L}) + 1), lambda i: {_L}[i] = {_X}), lambda i: (i - 1)::varchar)")),
        "list_move": ("LMOVE RPOPLPUSH BLMOVE BRPOPLPUSH", lambda: _j(F.concat(F.array(a.at(_l(), -1)), a.pop(_l()))), _s(f"[{_L}[-1]] || {_L}[1:len({_L}) - 1]")),
        "parallel_map": ("PARALLEL.MAP", lambda: _j(a.mapped(_l(), "upper")), _s(f"list_transform({_L}, lambda v: upper(v))")),
        "parallel_filter": ("PARALLEL.FILTER", lambda: F.size(a.kept(F.transform(_l(), F.length), "even")).cast("long"), f"len(list_filter({_L}, lambda v: length(v) % 2 = 0))"),
        "parallel_reduce": ("PARALLEL.REDUCE", lambda: a.reduced(F.transform(_l(), lambda v: F.length(v).cast("long")), "sum"), f"list_sum(list_transform({_L}, lambda v: length(v)))::bigint"),
        "parallel_exec": ("PARALLEL.EXEC", lambda: _j(F.array(F.upper("p_name"), F.reverse("p_name"))), "upper(p_name) || '|' || reverse(p_name)"),
    },
)
