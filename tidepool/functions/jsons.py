"""JSON documents as text. Paths are $.a.b[0]. Edits by path have no built-in function; they run on Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get(doc: Column, path: str = "$") -> Column:
    return F.get_json_object(doc, path)


def type_(doc: Column, path: str = "$") -> Column:
    v = F.try_parse_json(doc)
    t = F.schema_of_variant(F.variant_get(v, path, "variant"))
    return F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").when(t.isNotNull(), "number")


def keys(doc: Column, path: str = "$") -> Column:
    return F.json_object_keys(F.get_json_object(doc, path))


def array_length(doc: Column, path: str = "$") -> Column:
    return F.json_array_length(F.get_json_object(doc, path))


def diff(a: Column, b: Column) -> Column:
    """Top-level keys added, removed and changed."""
    x, y = F.from_json(a, "map<string,string>"), F.from_json(b, "map<string,string>")
    both = F.array_intersect(F.map_keys(x), F.map_keys(y))
    return F.struct(
        F.sort_array(F.array_except(F.map_keys(y), F.map_keys(x))).alias("added"),
        F.sort_array(F.array_except(F.map_keys(x), F.map_keys(y))).alias("removed"),
        F.sort_array(F.filter(both, lambda k: ~F.element_at(x, k).eqNullSafe(F.element_at(y, k)))).alias("changed"),
    )



def _edit(path: str, change: Callable[[Any], Any], remove: bool = False) -> Callable[[Column], Column]:
    way = [int(i) if i else k for k, i in re.findall(r"(?:^\$)?\.?([^.\[\]$]+)|\[(\d+)\]", path)]

    @F.pandas_udf(T.StringType())
    def run(docs: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                doc = json.loads(text)  # type: ignore[arg-type]
            except (TypeError, ValueError):
                return None
            if not way:
                return None if remove else json.dumps(change(doc), separators=(",", ":"))
            at = doc
            try:
                for step in way[:-1]:
                    at = at.setdefault(step, {}) if isinstance(at, dict) and not remove else at[step]
                if remove:
                    del at[way[-1]]
                elif isinstance(at, dict):
                    at[way[-1]] = change(at.get(way[-1]))
                else:
                    at[way[-1]] = change(at[way[-1]])
            except (KeyError, IndexError, TypeError):
                return text
            return json.dumps(doc, separators=(",", ":"))

        return docs.map(one)

    return run


def set_(doc: Column, path: str, value: Any) -> Column:
    return _edit(path, lambda _: value)(doc)


def delete(doc: Column, path: str) -> Column:
    return _edit(path, lambda x: x, remove=True)(doc)


def add_number(doc: Column, path: str, by: float) -> Column:
    return _edit(path, lambda x: (x or 0) + by)(doc)


def multiply_number(doc: Column, path: str, by: float) -> Column:
    return _edit(path, lambda x: (x or 0) * by)(doc)


def append_string(doc: Column, path: str, suffix: str) -> Column:
    return _edit(path, lambda x: (x or "") + suffix)(doc)


def append_array(doc: Column, path: str, *values: Any) -> Column:
    return _edit(path, lambda x: [*(x or []), *values])(doc)
