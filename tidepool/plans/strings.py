"""Queries of string functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import strings as s
from .base import Tables, plan, scalars


def c(name: str):
    return F.col(name)


scalars(
    "part",
    "p_partkey",
    {
        "str_len": ("STRLEN", lambda: s.strlen(c("p_name")).cast("long"), "strlen(p_name)::bigint"),
        "str_append": ("APPEND", lambda: s.append(c("p_name"), c("p_brand")), "p_name || p_brand"),
        "str_getrange": ("GETRANGE SUBSTR", lambda: s.slice_(c("p_name"), 2, -2), "substr(p_name, 3, length(p_name) - 3)"),
        "str_setrange": ("SETRANGE", lambda: s.set_range(c("p_name"), 2, "XY"), "substr(p_name, 1, 2) || 'XY' || substr(p_name, 5)"),
        "str_contains": ("STR.CONTAINS", lambda: F.contains(c("p_name"), F.lit("ing")), "contains(p_name, 'ing')"),
        "str_startswith": ("STR.STARTSWITH", lambda: F.startswith(c("p_name"), F.lit("red")), "starts_with(p_name, 'red')"),
        "str_endswith": ("STR.ENDSWITH", lambda: F.endswith(c("p_name"), F.lit("ring")), "suffix(p_name, 'ring')"),
        "str_index": ("STR.INDEX", lambda: s.index(c("p_name"), "e").cast("long"), "(instr(p_name, 'e') - 1)::bigint"),
        "str_lastindex": ("STR.LASTINDEX", lambda: s.last_index(c("p_name"), "e").cast("long"), "(case when instr(reverse(p_name), 'e') = 0 then -1 else length(p_name) - instr(reverse(p_name), 'e') end)::bigint"),
        "str_padleft": ("STR.PADLEFT", lambda: s.pad_left(c("p_name"), 12, "*"), "case when length(p_name) >= 12 then p_name else lpad(p_name, 12, '*') end"),
        "str_padright": ("STR.PADRIGHT", lambda: s.pad_right(c("p_name"), 12, "-"), "case when length(p_name) >= 12 then p_name else rpad(p_name, 12, '-') end"),
        "str_repeat": ("STR.REPEAT", lambda: F.repeat(c("p_brand"), F.lit(3)), "repeat(p_brand, 3)"),
        "str_replace": ("STR.REPLACE", lambda: s.replace(c("p_name"), "e", "3"), "replace(p_name, 'e', '3')"),
        "str_replace_first": ("STR.REPLACE", lambda: s.replace(c("p_name"), "e", "3", 1), "case when contains(p_name, 'e') then substr(p_name, 1, instr(p_name, 'e') - 1) || '3' || substr(p_name, instr(p_name, 'e') + 1) else p_name end"),
        "str_reverse": ("STR.REVERSE", lambda: F.reverse(c("p_name")), "reverse(p_name)"),
        "str_split": ("STR.SPLIT", lambda: F.array_join(s.split(c("p_name"), " "), "|"), "array_to_string(str_split(p_name, ' '), '|')"),
        "str_join": ("STR.JOIN", lambda: F.concat_ws("/", "p_brand", "p_type", "p_name"), "concat_ws('/', p_brand, p_type, p_name)"),
        "str_title": ("STR.TITLE", lambda: s.title(c("p_type")), "upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2))"),
        "str_trim": ("STR.TRIM", lambda: s.trim(c("p_name"), "sr"), "trim(p_name, 'sr')"),
        "str_trimleft": ("STR.TRIMLEFT", lambda: s.trim(c("p_name"), "sr", "left"), "ltrim(p_name, 'sr')"),
        "str_trimright": ("STR.TRIMRIGHT", lambda: s.trim(c("p_name"), "gt", "right"), "rtrim(p_name, 'gt')"),
        "str_truncate": ("STR.TRUNCATE", lambda: s.truncate(c("p_name"), 8), "case when length(p_name) <= 8 then p_name else substr(p_name, 1, 5) || '...' end"),
        "str_format": ("STR.FORMAT EVAL.FORMAT", lambda: s.fmt("{} <{1}> {0}", c("p_name"), c("p_brand")), "p_name || ' <' || p_brand || '> ' || p_name"),
        "str_template": ("EVAL.TEMPLATE TEMPLATE.*", lambda: s.fill("{{ name }}: {{size}} {{ none }}.", {"name": c("p_name"), "size": c("p_size").cast("string")}), "p_name || ': ' || p_size || ' .'"),
        "str_regex": ("EVAL.REGEX", lambda: c("p_brand").rlike("#1[0-9]$"), "regexp_matches(p_brand, '#1[0-9]$')"),
        "str_regexmatch": ("EVAL.REGEXMATCH", lambda: F.array_join(F.regexp_extract_all(c("p_name"), F.lit("[aeiou]"), F.lit(0)), ","), "array_to_string(regexp_extract_all(p_name, '[aeiou]'), ',')"),
        "str_regexreplace": ("EVAL.REGEXREPLACE", lambda: F.regexp_replace(c("p_name"), "[aeiou]+", "_"), "regexp_replace(p_name, '[aeiou]+', '_', 'g')"),
        "sanitize_html": ("SANITIZE.HTML", lambda: s.sanitize_html(F.concat(F.lit("<a href=\"x\">'&"), c("p_name"))), "'&lt;a href=&#34;x&#34;&gt;&#39;&amp;' || p_name"),
        "sanitize_sql": ("SANITIZE.SQL", lambda: s.sanitize_sql(F.concat(c("p_name"), F.lit("'\"\\"))), "p_name || '''''' || '\"\"' || '\\\\'"),
        "sanitize_string": ("SANITIZE.STRING", lambda: s.sanitize_string(F.concat(c("p_brand"), F.lit("!?-_"))), "regexp_replace(p_brand || '!?-_', '[^A-Za-z0-9 _-]', '', 'g')"),
        "mask_card": ("MASK.CARD", lambda: s.mask_card(c("p_partkey").cast("string")), "case when length(p_partkey::varchar) < 4 then '****' else '****-****-****-' || right(p_partkey::varchar, 4) end"),
        "mask_phone": ("MASK.PHONE", lambda: s.mask_phone(c("p_name")), "'***-***-' || right(p_name, 4)"),
        "mask_email": ("MASK.EMAIL", lambda: s.mask_email(F.concat("p_type", F.lit("@x.org"))), "'***@x.org'"),
        "mask_ip": ("MASK.IP", lambda: s.mask_ip(F.concat(c("p_size").cast("string"), F.lit(".1.2.3"))), "p_size || '.***.***.***'"),
        "lcs": ("LCS", lambda: s.lcs_length(c("p_brand"), F.reverse("p_brand")), None),
    },
)
scalars(
    "documents",
    "doc_id",
    {
        "str_words": ("STR.WORDS", lambda: F.size(s.words(c("text"))).cast("long"), "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))"),
        "str_lines": ("STR.LINES", lambda: F.size(s.lines(c("text"))).cast("long"), "len(str_split(text, chr(10)))"),
        "sanitize_json": ("SANITIZE.JSON", lambda: F.md5(s.sanitize_json(c("text"))), "md5(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t'))"),
    },
)


@plan(
    "DIFF.TEXT",
    sql="""
    with p as (select conv_id, str_split(max(case when turn = 0 then text end), chr(10)) as a, str_split(max(case when turn = 1 then text end), chr(10)) as b from conversations group by conv_id)
    select conv_id, len(list_distinct(list_filter(b, lambda x: not list_contains(a, x))))::int as added, len(list_distinct(list_filter(a, lambda x: not list_contains(b, x))))::int as removed,
      len(list_distinct(list_filter(a, lambda x: list_contains(b, x))))::int as unchanged from p where b is not null""",
)
def diff_text(t: Tables) -> DataFrame:
    at = lambda n: F.max(F.when(F.col("turn") == n, F.col("text")))
    pairs = t.conversations.groupBy("conv_id").agg(at(0).alias("a"), at(1).alias("b")).where("b is not null")
    return pairs.select("conv_id", s.diff_lines(c("a"), c("b")).alias("d")).select("conv_id", "d.*")
