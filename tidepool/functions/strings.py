"""String functions. Lengths are bytes; positions and slices are code points."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strlen(s: Column) -> Column:
    return F.octet_length(s)


def append(s: Column, suffix: Column | str) -> Column:
    return F.concat(s, suffix if isinstance(suffix, Column) else F.lit(suffix))


def slice_(s: Column, start: int, end: int) -> Column:
    """Inclusive range; negative places count from the end."""
    n = F.length(s)
    a = F.greatest(F.lit(0), F.lit(start) + (n if start < 0 else F.lit(0)))
    b = F.least(n - 1, F.lit(end) + (n if end < 0 else F.lit(0)))
    return F.when(b < a, "").otherwise(F.substring(s, a + 1, b - a + 1))


def set_range(s: Column, offset: int, value: str) -> Column:
    """Overwrite at an offset; what lies between is filled with NUL."""
    left = F.rpad(F.substring(s, 1, offset), offset, "\0") if offset else F.lit("")
    return F.concat(left, F.lit(value), F.substring(s, F.lit(offset + len(value) + 1), F.length(s)))


def index(s: Column, part: str) -> Column:
    return F.instr(s, part) - 1


def last_index(s: Column, part: str) -> Column:
    at = F.instr(F.reverse(s), part[::-1])
    return F.when(at == 0, -1).otherwise(F.length(s) - at - len(part) + 1)


def pad_left(s: Column, n: int, fill: str) -> Column:
    """Never truncates."""
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, fill[:1]))


def pad_right(s: Column, n: int, fill: str) -> Column:
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(s, n, fill[:1]))


def replace(s: Column, old: str, new: str, count: int | None = None) -> Column:
    """All, or the first count, occurrences."""
    if count is None:
        return F.replace(s, F.lit(old), F.lit(new))
    parts = F.split(s, _quoted(old), -1)
    k = F.least(F.lit(count), F.size(parts) - 1)
    head = F.array_join(F.slice(parts, F.lit(1), k + 1), new)
    tail = F.slice(parts, k + 2, F.size(parts))
    return F.concat_ws(old, F.array(head), tail)


def title(s: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))


def trim(s: Column, signs: str | None = None, side: str = "both") -> Column:
    kind = {"both": "BOTH", "left": "LEADING", "right": "TRAILING"}[side]
    by = F.lit(signs if signs is not None else " \t\n\r\x0b\x0c")
    return {"BOTH": F.btrim, "LEADING": F.ltrim, "TRAILING": F.rtrim}[kind](s, by)


def truncate(s: Column, n: int, suffix: str = "...") -> Column:
    """At most n code points, the suffix among them."""
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, max(0, n - len(suffix))), F.lit(suffix)))


def split(s: Column, separator: str) -> Column:
    return F.split(s, _quoted(separator), -1)


def words(s: Column) -> Column:
    return F.filter(F.split(s, r"\s+"), lambda w: w != "")


def lines(s: Column) -> Column:
    return F.split(s, "\n", -1)


def sanitize_html(s: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")]
    return reduce(lambda c, p: replace(c, *p), pairs, s)


def sanitize_json(s: Column) -> Column:
    pairs = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
    return reduce(lambda c, p: replace(c, *p), pairs, s)


def sanitize_sql(s: Column) -> Column:
    return reduce(lambda c, p: replace(c, *p), [("\\", "\\\\"), ("'", "''"), ('"', '""')], s)


def sanitize_string(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9 _-]", "")


def mask_card(s: Column) -> Column:
    return F.when(F.length(s) < 4, "****").otherwise(F.concat(F.lit("****-****-****-"), F.right(s, F.lit(4))))


def mask_phone(s: Column) -> Column:
    return F.when(F.length(s) < 4, "***").otherwise(F.concat(F.lit("***-***-"), F.right(s, F.lit(4))))


def mask_email(s: Column) -> Column:
    at = F.instr(s, "@")
    return F.when(at > 1, F.concat(F.lit("***"), F.substring(s, at, F.length(s)))).otherwise("***@***.***")


def mask_ip(s: Column) -> Column:
    parts = F.split(s, r"\.", -1)
    return F.when(F.size(parts) == 4, F.concat(F.element_at(parts, 1), F.lit(".***.***.***"))).otherwise("***.***.***.***")


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """{{ name }} gives way to the value; names that have none vanish."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(F.replace(out, F.lit("{{ " + name + " }}"), value), F.lit("{{" + name + "}}"), value)
    return F.regexp_replace(out, r"\{\{\s*\w+\s*\}\}", "")


def fmt(template: str, *values: Column) -> Column:
    """{} in turn, {n} by number."""
    parts, turn, out, i = [], 0, "", 0
    while i < len(template):
        end = template.find("}", i)
        if template[i] == "{" and end > 0 and (template[i + 1 : end] == "" or template[i + 1 : end].isdigit()):
            n = int(template[i + 1 : end]) if end > i + 1 else turn
            turn += end == i + 1
            parts += [F.lit(out), values[n].cast("string") if n < len(values) else F.lit(template[i : end + 1])]
            out, i = "", end + 1
        else:
            out, i = out + template[i], i + 1
    return F.concat(*parts, F.lit(out))


def diff_lines(a: Column, b: Column) -> Column:
    """Lines added, removed and unchanged, as counts of distinct lines."""
    x, y = lines(a), lines(b)
    return F.struct(F.size(F.array_except(y, x)).alias("added"), F.size(F.array_except(x, y)).alias("removed"), F.size(F.array_intersect(x, y)).alias("unchanged"))


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence; there is no built-in function for it."""

    def one(x: str | None, y: str | None) -> int | None:
        if x is None or y is None:
            return None
        row = [0] * (len(y) + 1)
        for c in x:
            last = 0
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
        return row[-1]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def _quoted(s: str) -> str:
    """As a regular expression that matches it alone."""
    return "".join("\\" + c if c in "\\.[]{}()*+?^$|" else c for c in s)
