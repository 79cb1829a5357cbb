"""Queries of hashes, objects, JSON, codecs, bitmaps and validators."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits as b
from ..functions import checks, codec
from ..functions import jsons as j
from ..functions import maps as m
from ..functions import vectors as v
from .base import Tables, crc32_sql, plan, scalars


def c(name: str):
    return F.col(name)


_h = lambda: F.create_map(F.lit("name"), c("c_name"), F.lit("segment"), c("c_mktsegment"), F.lit("nation"), c("c_nationkey").cast("string"))
_f = lambda: F.create_map(F.lit("bal"), c("c_acctbal"), F.lit("nation"), c("c_nationkey").cast("double"), F.lit("one"), F.lit(1.0))
_keys = lambda x: F.array_join(F.sort_array(F.map_keys(x)), ",")
_show = lambda x: F.array_join(F.transform(F.array_sort(F.map_entries(x)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
_ROW = "'name=' || c_name || ',nation=' || c_nationkey || ',segment=' || c_mktsegment"
_clock = lambda n: F.create_map(F.lit("a"), (c("c_custkey") % n).cast("int"), F.lit("b"), (c("c_custkey") % 3).cast("int"))
scalars(
    "customer",
    "c_custkey",
    {
        "hash_get": ("HGET OBJECT.GET ENTITY.GET PROFILE.GET RECORD.GET CHAINED.GET", lambda: F.element_at(_h(), "segment"), "c_mktsegment"),
        "hash_mget": ("HMGET OBJECT.PICK", lambda: _show(m.pick(_h(), "name", "segment")), "'name=' || c_name || ',segment=' || c_mktsegment"),
        "hash_set": ("HSET HMSET OBJECT.SET ENTITY.SET PROFILE.SET RECORD.ADD CHAINED.SET", lambda: _show(m.put(_h(), "nation", F.lit("x"))), "'name=' || c_name || ',nation=x,segment=' || c_mktsegment"),
        "hash_setnx": ("HSETNX", lambda: _show(m.put_new(_h(), "nation", F.lit("x"))), _ROW),
        "hash_del": ("HDEL OBJECT.DELETE OBJECT.OMIT HGETDEL CHAINED.DEL FEATURE.DEL", lambda: _show(m.drop(_h(), "nation", "other")), "'name=' || c_name || ',segment=' || c_mktsegment"),
        "hash_exists": ("HEXISTS OBJECT.HAS", lambda: F.map_contains_key(_h(), "email"), "false"),
        "hash_keys": ("HKEYS OBJECT.KEYS", lambda: _keys(_h()), "'name,nation,segment'"),
        "hash_vals": ("HVALS OBJECT.VALUES", lambda: F.array_join(F.sort_array(F.map_values(_h())), ","), "array_to_string(list_sort([c_name, c_mktsegment, c_nationkey::varchar]), ',')"),
        "hash_len": ("HLEN", lambda: F.size(_h()).cast("long"), "3::bigint"),
        "hash_strlen": ("HSTRLEN", lambda: F.octet_length(F.element_at(_h(), "segment")).cast("long"), "strlen(c_mktsegment)::bigint"),
        "hash_getall": ("HGETALL OBJECT.ENTRIES OBJECT.FROMENTRIES HGETEX", lambda: _show(_h()), _ROW),
        "hash_merge": ("OBJECT.MERGE", lambda: _show(m.merge(_h(), F.create_map(F.lit("name"), F.lit("n"), F.lit("zip"), F.lit("z")))), "'name=n,nation=' || c_nationkey || ',segment=' || c_mktsegment || ',zip=z'"),
        "hash_incrby": ("HINCRBY HINCRBYFLOAT FEATURE.INCR FEATURE.SET", lambda: F.element_at(m.increment(_f(), "nation", 2.5), "nation"), "c_nationkey + 2.5::double"),
        "feature_get": ("FEATURE.GET", lambda: F.element_at(_f(), "bal"), "c_acctbal"),
        "feature_vector": ("FEATURE.VECTOR", lambda: F.aggregate(F.map_values(_f()), F.lit(0.0), lambda t, x: t + x), "c_acctbal + c_nationkey + 1.0::double"),
        "feature_normalize": ("FEATURE.NORMALIZE", lambda: F.element_at(m.normalized(_f(), "l2"), "one"), "1.0 / sqrt(c_acctbal * c_acctbal + c_nationkey * c_nationkey + 1.0)"),
        "clock_compare": ("VECTOR_CLOCK.COMPARE VECTOR_CLOCK.GET VECTOR_CLOCK.CREATE", lambda: m.clock_compare(_clock(5), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(1))), "case when (c_custkey % 5 < 2 or c_custkey % 3 < 1) and (c_custkey % 5 > 2 or c_custkey % 3 > 1) then 'concurrent' when c_custkey % 5 < 2 or c_custkey % 3 < 1 then 'before' when c_custkey % 5 > 2 or c_custkey % 3 > 1 then 'after' else 'equal' end"),
        "clock_merge": ("VECTOR_CLOCK.MERGE VECTOR_CLOCK.INCREMENT", lambda: F.element_at(m.clock_merge(_clock(5), m.increment(_clock(4), "a", 1)), "a"), "greatest(c_custkey % 5, c_custkey % 4 + 1)::int"),
    },
)
_p = lambda: c("props")
_doc = lambda: F.concat(F.lit('{"a":{"b":[1,'), c("event_id").cast("string"), F.lit(']},"t":"'), c("event_type"), F.lit('","p":'), c("props"), F.lit("}"))
scalars(
    "events",
    "event_id",
    {
        "json_get": ("JSON.GET JSON.MGET EVAL.JSONPATH", lambda: j.get(_doc(), "$.a.b[1]"), "event_id::varchar"),
        "json_type": ("JSON.TYPE", lambda: j.type_(_doc(), "$.a"), "'object'"),
        "json_arrlen": ("JSON.ARRLEN", lambda: j.array_length(_doc(), "$.a.b").cast("long"), "2::bigint"),
        "json_objkeys": ("JSON.OBJKEYS", lambda: F.array_join(j.keys(_doc()), ","), "'a,t,p'"),
        "json_objlen": ("JSON.OBJLEN", lambda: F.size(j.keys(_p())).cast("long"), "len(json_keys(props))::bigint"),
        "json_strlen": ("JSON.STRLEN", lambda: F.octet_length(j.get(_doc(), "$.t")).cast("long"), "strlen(event_type)::bigint"),
        "json_set": ("JSON.SET JSON.MSET", lambda: j.get(j.set_(_doc(), "$.a.c", 7), "$.a.c"), "'7'"),
        "json_del": ("JSON.DEL", lambda: j.delete(_p(), "$.k"), "'{}'"),
        "json_numincrby": ("JSON.NUMINCRBY", lambda: j.get(j.add_number(_p(), "$.k", 5), "$.k").cast("long"), "(json_extract(props, '$.k')::bigint + 5)"),
        "json_nummultby": ("JSON.NUMMULTBY", lambda: j.get(j.multiply_number(_p(), "$.k", 3), "$.k").cast("long"), "(json_extract(props, '$.k')::bigint * 3)"),
        "json_strappend": ("JSON.STRAPPEND", lambda: j.get(j.append_string(_doc(), "$.t", "!"), "$.t"), "event_type || '!'"),
        "json_arrappend": ("JSON.ARRAPPEND", lambda: j.array_length(j.append_array(_doc(), "$.a.b", 8, 9), "$.a.b").cast("long"), "4::bigint"),
        "json_diff": ("DIFF.JSON", lambda: F.array_join(j.diff(_p(), F.concat(F.lit('{"k": 0, "n": '), c("event_id").cast("string"), F.lit("}"))).getField("added"), ","), "'n'"),
        "validate_json": ("VALIDATE.JSON", lambda: checks.valid(F.when(c("event_id") % 2 == 0, F.substring("props", 2, 99)).otherwise(c("props")), "json"), "event_id % 2 <> 0"),
    },
)
_t = lambda: c("p_name")
_key = "secret"
def _hmac_sql(algorithm: str) -> str:
    """Keyed digests in SQL, for hashes with blocks of 64 bytes."""
    inner, outer = ("".join(f"\\x{x ^ pad:02X}" for x in _key.encode().ljust(64, bytes(1))) for pad in (0x36, 0x5C))
    return f"{algorithm}('{outer}'::blob || unhex({algorithm}('{inner}'::blob || p_name::blob)))"


_BYTES = "[ord(ch)::bigint for ch in string_split(p_name, '') if ch <> '']"
_ADLER = f"((length(p_name) + list_sum([x * (length(p_name) - i + 1) for x, i in {_BYTES}])) % 65521 * 65536 + (1 + list_sum({_BYTES})) % 65521)::bigint"


scalars(
    "part",
    "p_partkey",
    {
        "digest_md5": ("DIGEST.MD5 CRYPTO.HASH", lambda: codec.digest(_t(), "MD5"), "md5(p_name)"),
        "digest_sha1": ("DIGEST.SHA1", lambda: codec.digest(_t(), "SHA-1"), "sha1(p_name)"),
        "digest_sha256": ("DIGEST.SHA256", lambda: codec.digest(_t(), "sha256"), "sha256(p_name)"),
        "digest_sha512": ("DIGEST.SHA512", lambda: codec.digest(_t(), "sha512"), None),
        "digest_crc32": ("DIGEST.CRC32", lambda: F.crc32(_t()), crc32_sql("p_name")),
        "digest_adler32": ("DIGEST.ADLER32", lambda: codec.adler32(_t()), _ADLER),
        "digest_hmac_md5": ("DIGEST.HMACMD5", lambda: codec.hmac(_key, _t(), "md5"), _hmac_sql("md5")),
        "digest_hmac_sha1": ("DIGEST.HMACSHA1", lambda: codec.hmac(_key, _t(), "sha1"), _hmac_sql("sha1")),
        "digest_hmac_sha256": ("DIGEST.HMACSHA256 DIGEST.HMAC CRYPTO.HMAC", lambda: codec.hmac(_key, _t(), "sha256"), _hmac_sql("sha256")),
        "digest_hmac_sha512": ("DIGEST.HMACSHA512", lambda: codec.hmac(_key, _t(), "sha512"), None),
        "base64_encode": ("DIGEST.BASE64ENCODE", lambda: F.base64(_t().cast("binary")), "to_base64(p_name::blob)"),
        "base64_decode": ("DIGEST.BASE64DECODE", lambda: F.unbase64(F.base64(_t().cast("binary"))).cast("string"), "p_name"),
        "hex_encode": ("DIGEST.HEXENCODE", lambda: F.lower(F.hex(_t())), "lower(hex(p_name::blob))"),
        "hex_decode": ("DIGEST.HEXDECODE", lambda: F.unhex(F.hex(_t())).cast("string"), "p_name"),
        "rle": ("COMPRESS.RLE COMPRESS.CUSTOM", lambda: codec.rle_encode(F.repeat(F.left(_t(), F.lit(1)), c("p_size"))), "p_size || left(p_name, 1)"),
        "rle_decode": ("DECOMPRESS.RLE", lambda: codec.rle_decode(codec.rle_encode(_t())), "p_name"),
        "compress": ("COMPRESS.LZ4 DECOMPRESS.LZ4 COMPRESSION.COMPRESS COMPRESSION.DECOMPRESS", lambda: codec.decompress(codec.compress(_t())), "p_name"),
        "compression_info": ("COMPRESSION.INFO", lambda: F.octet_length(codec.compress(F.repeat(_t(), F.lit(50)))) < 600, "true"),
        "msgpack": ("MSGPACK.ENCODE", lambda: F.hex(codec.msgpack(_t())), "upper(printf('%x', 160 + strlen(p_name)) || hex(p_name::blob))"),
        "msgpack_decode": ("MSGPACK.DECODE", lambda: codec.msgpack_decode(codec.msgpack(F.repeat(_t(), F.lit(9)))), "repeat(p_name, 9)"),
        "cbor": ("CBOR.ENCODE", lambda: F.hex(codec.cbor(_t())), "upper(case when strlen(p_name) < 24 then printf('%x', 96 + strlen(p_name)) else '78' || printf('%x', strlen(p_name)) end || hex(p_name::blob))"),
        "cbor_decode": ("CBOR.DECODE", lambda: codec.cbor_decode(codec.cbor(F.repeat(_t(), F.lit(9)))), "repeat(p_name, 9)"),
        "bson": ("BSON.ENCODE BSON.DECODE", lambda: F.octet_length(codec.bson("name", _t())).cast("long"), "(strlen(p_name) + 16)::bigint"),
        "csv_encode": ("CSV.ENCODE", lambda: codec.csv_row(_t(), F.concat(c("p_brand"), F.lit(',"x"'))), "p_name || ',\"' || p_brand || ',\"\"x\"\"\"'"),
        "csv_decode": ("CSV.DECODE", lambda: F.from_csv(codec.csv_row(F.lit("a,b"), _t()), F.lit("x string, y string")).getField("y"), "p_name"),
        "toml": ("TOML.ENCODE TOML.DECODE", lambda: codec.unpair(codec.pair(c("p_type"), _t(), "toml"), "toml").getField("value"), "p_name"),
        "yaml": ("YAML.ENCODE YAML.DECODE", lambda: codec.pair(c("p_type"), _t(), "yaml"), "p_type || ': ' || p_name"),
        "xml": ("XML.ENCODE XML.DECODE", lambda: codec.unpair(codec.pair(c("p_type"), _t(), "xml"), "xml").getField("key"), "p_type"),
        "url_encode": ("URL.ENCODE", lambda: F.url_encode(F.concat(_t(), F.lit("&=#"))), "replace(p_name, ' ', '+') || '%26%3D%23'"),
        "url_decode": ("URL.DECODE", lambda: F.url_decode(F.url_encode(F.concat(_t(), F.lit("&é")))), "p_name || '&é'"),
        "uuid_gen": ("UUID.GEN ID.CREATE", lambda: F.uuid().rlike(codec.UUID), "true"),
        "uuid_validate": ("UUID.VALIDATE", lambda: F.concat(F.lit("12345678-1234-4123-8123-"), F.lpad(c("p_partkey").cast("string"), 12, "0")).rlike(codec.UUID), "true"),
        "uuid_version": ("UUID.VERSION", lambda: F.substring(F.uuid(), 15, 1), "'4'"),
        "ulid": ("ULID.GEN ULID.EXTRACT", lambda: codec.ulid_millis(codec.ulid(c("p_partkey") + 1_700_000_000_000, _t())), "p_partkey + 1700000000000"),
        "snowflake": ("SNOWFLAKE.NEXT SNOWFLAKE.PARSE", lambda: codec.snowflake_parse(codec.snowflake(c("p_partkey") + 1_700_000_000_000, c("p_size"), F.lit(5))).getField("millis"), "p_partkey + 1700000000000"),
        "snowflake_node": ("SNOWFLAKE.PARSE", lambda: codec.snowflake_parse(codec.snowflake(c("p_partkey") + 1_700_000_000_000, c("p_size"), F.lit(5))).getField("node"), "p_size::bigint"),
        "bit_get": ("GETBIT", lambda: b.get(_t().cast("binary"), 9), "((ord(p_name[2]) >> 6) & 1)::int"),
        "bit_set": ("SETBIT", lambda: F.hex(b.set_(_t().cast("binary"), 7, 1)), "upper(printf('%x', ord(p_name[1]) | 1) || hex(p_name[2:]::blob))"),
        "bit_count": ("BITCOUNT", lambda: b.count(_t().cast("binary")).cast("long"), "list_sum(list_transform(range(1, length(p_name) + 1), lambda i: bit_count(ord(p_name[i]))))::bigint"),
        "bit_pos": ("BITPOS", lambda: b.position(_t().cast("binary"), 1).cast("long"), "1::bigint"),
        "bit_op": ("BITOP", lambda: F.hex(b.combine(_t().cast("binary"), _t().cast("binary"), "AND")), "hex(p_name::blob)"),
        "bit_not": ("BITOP", lambda: b.invert(b.invert(_t().cast("binary"))).cast("string"), "p_name"),
        "bit_field": ("BITFIELD", lambda: b.field(_t().cast("binary"), 8, 8), "ord(p_name[2])::bigint"),
        "validate_alpha": ("VALIDATE.ALPHA", lambda: checks.valid(c("p_type"), "alpha"), "regexp_matches(p_type, '^[A-Za-z]+$')"),
        "validate_alphanum": ("VALIDATE.ALPHANUM", lambda: checks.valid(_t(), "alphanum"), "regexp_matches(p_name, '^[A-Za-z0-9]+$')"),
        "validate_email": ("VALIDATE.EMAIL", lambda: checks.valid(F.concat(c("p_type"), F.when(c("p_size") > 25, "@a.org").otherwise("@a")), "email"), "p_size > 25"),
        "validate_float": ("VALIDATE.FLOAT", lambda: checks.valid(c("p_retailprice").cast("string"), "float"), "true"),
        "validate_int": ("VALIDATE.INT", lambda: checks.valid(F.concat(c("p_size").cast("string"), F.when(c("p_size") > 25, "x").otherwise("")), "int"), "p_size <= 25"),
        "validate_ip": ("VALIDATE.IP", lambda: checks.valid(F.concat(F.lit("10.0.0."), (c("p_size") * 10).cast("string")), "ip"), "p_size * 10 <= 255"),
        "validate_url": ("VALIDATE.URL", lambda: checks.valid(F.concat(F.when(c("p_size") > 25, "http").otherwise("ftp"), F.lit("://x.org/"), c("p_type")), "url"), "p_size > 25"),
        "validate_length": ("VALIDATE.LENGTH", lambda: checks.length_between(_t(), 8, 12), "strlen(p_name) between 8 and 12"),
        "validate_range": ("VALIDATE.RANGE VALIDATE.CHECK VALIDATE.CREATE", lambda: c("p_size").between(10, 20), "p_size between 10 and 20"),
        "threshold_check": ("THRESHOLD.CHECK THRESHOLD.SET", lambda: c("p_size") >= 30, "p_size >= 30"),
        "filter_apply": ("FILTER.APPLY FILTER.CREATE RULE.EVAL RULE.CREATE", lambda: F.expr("p_size > 10 AND p_type LIKE 'E%'"), "p_size > 10 and p_type like 'E%'"),
        "transform_apply": ("TRANSFORM.APPLY TRANSFORM.CREATE ENRICH.APPLY ENRICH.CREATE", lambda: F.expr("concat(upper(p_name), ':', p_size)"), "upper(p_name) || ':' || p_size"),
        "rollout_check": ("ROLLOUT.CHECK ROLLOUT.CREATE ROLLOUT.PERCENTAGE", lambda: checks.bucket(c("p_partkey"), 100) < 101, "true"),
        "experiment_assign": ("EXPERIMENT.ASSIGN EXPERIMENT.CREATE", lambda: checks.variant(c("p_partkey"), ["a", "b", "c"]).isin("a", "b", "c"), "true"),
    },
)
_e = lambda: v.double(c("embedding"))
_u = lambda: F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i.cast("double"))
_E, _U = "embedding::double[]", "range(1, 65)::double[]"
scalars(
    "embeddings",
    "vec_id",
    {
        "vector_cosine": ("SIMILARITY.COSINE VECTOR.SIMILARITY", lambda: F.round(v.cosine(_e(), _u()), 6), f"round(list_cosine_similarity({_E}, {_U}), 6)"),
        "vector_dot": ("SIMILARITY.DOTPRODUCT", lambda: F.round(v.dot(_e(), _u()), 6), f"round(list_dot_product({_E}, {_U}), 6)"),
        "vector_euclidean": ("SIMILARITY.EUCLIDEAN", lambda: F.round(v.euclidean(_e(), _u()), 6), f"round(list_distance({_E}, {_U}), 6)"),
        "vector_normalize": ("VECTOR.NORMALIZE", lambda: F.round(v.norm(v.normalize(_e())), 6), "1.0::double"),
        "vector_dimensions": ("VECTOR.DIMENSIONS VECTOR.GET EMBEDDING.GET", lambda: F.size("embedding").cast("long"), "len(embedding)::bigint"),
        "tensor_add": ("TENSOR.ADD", lambda: F.round(v.dot(v.add(_e(), _e()), _u()), 6), f"round(2 * list_dot_product({_E}, {_U}), 6)"),
        "tensor_matmul": ("TENSOR.MATMUL", lambda: F.round(F.get(v.matmul(_e(), _u(), 1, 64, 1), 0), 6), f"round(list_dot_product({_E}, {_U}), 6)"),
        "tensor_reshape": ("TENSOR.RESHAPE TENSOR.CREATE TENSOR.GET", lambda: F.round(F.get(F.get(v.reshape(_e(), 8), 2), 3), 6), f"round(({_E})[20], 6)"),
    },
)


@plan("VECTOR.MERGE", sql="select a.vec_id, round((a.embedding[1]::double + b.embedding[1]::double) / 2, 6) as first from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def vector_merge(t: Tables) -> DataFrame:
    a, other = t.embeddings, t.embeddings.select((c("vec_id") - 1).alias("vec_id"), v.double(c("embedding")).alias("o"))
    return a.join(other, "vec_id").select("vec_id", F.round(F.get(v.mean(_e(), c("o")), 0), 6).alias("first"))


@plan("SIMILARITY.JACCARD", sql="""select a.p_partkey, round(len(list_intersect(str_split(a.p_name, ' '), str_split(b.p_name, ' ')))::double / len(list_distinct(str_split(a.p_name, ' ') || str_split(b.p_name, ' '))), 6) as similarity
    from part a join part b on b.p_partkey = a.p_partkey + 1""")
def similarity_jaccard(t: Tables) -> DataFrame:
    other = t.part.select((c("p_partkey") - 1).alias("p_partkey"), c("p_name").alias("o"))
    return t.part.join(other, "p_partkey").select("p_partkey", F.round(v.jaccard(F.split("p_name", " "), F.split("o", " ")), 6).alias("similarity"))


def plain_hmac(text: str, algorithm: str) -> str:
    return hmac.new(_key.encode(), text.encode(), getattr(hashlib, algorithm)).hexdigest()
