"""Queries of sketches, places, vectors, text search, graphs and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as g
from ..operators import geo, graph, ml, search, sketches
from .base import Tables, plan, scalars

c = F.col


@plan("PFADD", "PFCOUNT", "PFMERGE", sql="select event_type, true as near from events group by 1")
def pfcount(t: Tables) -> DataFrame:
    """Sketches of days, merged by kind, against the exact count."""
    days = t.events.withColumn("day", F.to_date("ts"))
    est = sketches.hll_count(sketches.hll(days, ["event_type", "day"], "user_id"), ["event_type"])
    exact = t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("n"))
    return est.join(exact, "event_type").select("event_type", (F.abs(c("estimate") - c("n")) <= 0.05 * c("n")).alias("near"))


@plan("PFCOUNT", sql="select l_returnflag, true as near from lineitem group by 1")
def approx_distinct(t: Tables) -> DataFrame:
    both = t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("e"), F.countDistinct("l_partkey").alias("n"))
    return both.select("l_returnflag", (F.abs(c("e") - c("n")) <= 0.1 * c("n")).alias("near"))


def _md5(item: str, i: str) -> str:
    """``sketches.by_md5`` in SQL."""
    return f"('0x' || substr(md5({item} || ':' || {i}), 1, 15))::bigint"


_URGENT = "o_orderpriority = '1-URGENT'"
_BITS = f"b as (select distinct {_md5('o_custkey', 'i')} % 8192 as p from orders, (select unnest(range(3)) as i) where {_URGENT})"


@plan("BF.*", "BLOOMX.*", sql=f"with {_BITS} select c_custkey, bool_and({_md5('c_custkey', 'i')} % 8192 in (select p from b)) as maybe from customer, (select unnest(range(3)) as i) group by 1")
def bloom_filter(t: Tables) -> DataFrame:
    """Members and others asked of a filter so small that it errs; the SQL sets the same bits."""
    words = sketches.bloom(t.orders.where(_URGENT), "o_custkey", 8192, 3, sketches.by_md5)
    return sketches.bloom_contains(t.customer.select("c_custkey"), "c_custkey", words, 8192, 3, sketches.by_md5)


def _print(item: str) -> str:
    return f"{_md5(item, '0')} % 256 as bucket, ({_md5(item, '0')} >> 40) % 16 as print"


@plan("CF.*", sql=f"with a as (select o_custkey as k, 1 as n from orders union all select o_custkey, -1 from orders where {_URGENT}), p as (select {_print('k')}, sum(n) as n from a group by 1, 2) select c_custkey, coalesce(n, 0) > 0 as maybe from (select c_custkey, {_print('c_custkey')} from customer) left join p using (bucket, print)")
def cuckoo_filter(t: Tables) -> DataFrame:
    """Customers of orders are added, those of urgent ones deleted again, all asked."""
    added, gone = (sketches.fingerprints(o, "o_custkey", 256, 16, sketches.by_md5) for o in (t.orders, t.orders.where(_URGENT)))
    rows = added.union(gone.withColumn("n", -c("n"))).groupBy("bucket", "print").agg(F.sum("n").alias("n"))
    return sketches.fingerprints_contain(t.customer, "c_custkey", rows, 256, 16, sketches.by_md5)


@plan("CMS.*", "SKETCH.*", sql=f"with h as (select unnest(range(3)) as i), s as (select i, {_md5('l_suppkey', 'i')} % 32 as cell, count(*) as n from lineitem, h group by 1, 2), k as (select distinct l_suppkey from lineitem) select l_suppkey, min(n) as estimate from k, h, s where s.i = h.i and s.cell = {_md5('l_suppkey', 'h.i')} % 32 group by 1")
def count_min(t: Tables) -> DataFrame:
    """Estimates of a sketch so narrow that items share cells; the SQL counts the same cells."""
    cells = sketches.count_min(t.lineitem, "l_suppkey", 3, 32, hashed=sketches.by_md5)
    return sketches.count_min_query(t.lineitem, "l_suppkey", cells, 3, 32, sketches.by_md5)


@plan("TDIGEST.QUANTILE", "TDIGEST.ADD", "TDIGEST.CREATE", sql="select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.99), 6) as p99 from events group by 1")
def quantile(t: Tables) -> DataFrame:
    q = sketches.quantiles_exact(t.events, ["event_type"], "value", [0.5, 0.99])
    return q.select("event_type", F.round(F.get("quantiles", 0), 6).alias("p50"), F.round(F.get("quantiles", 1), 6).alias("p99"))


@plan("TDIGEST.MERGE", "TDIGEST.*")
def quantile_approx(t: Tables) -> DataFrame:
    return sketches.quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.9]).select("l_returnflag", F.posexplode("quantiles").alias("i", "value"))


@plan("TDIGEST.CDF", sql="select event_type, round(avg(case when value <= 20 then 1.0 else 0.0 end), 6) as cdf from events group by 1")
def quantile_cdf(t: Tables) -> DataFrame:
    return sketches.cdf(t.events, ["event_type"], "value", 20.0).select("event_type", F.round("cdf", 6).alias("cdf"))


@plan("TDIGEST.MIN", "TDIGEST.MAX", "TDIGEST.MEAN", "TDIGEST.INFO", "HISTOGRAM.MEAN", "HISTOGRAM.INFO", sql="select event_type, min(value) as low, max(value) as high, round(avg(value), 6) as mean from events group by 1")
def digest_info(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"))


@plan("HISTOGRAM.*", sql="select l_returnflag, (case when l_quantity < 5 then -1 when l_quantity >= 45 then 10 else floor((l_quantity - 5) / 4) end)::int as bucket, count(*) as n from lineitem group by 1, 2")
def histogram(t: Tables) -> DataFrame:
    return sketches.histogram(t.lineitem, ["l_returnflag"], "l_quantity", 5.0, 45.0, 4.0)


def places(t: Tables) -> DataFrame:
    """Customers spread over the globe by their key."""
    k = c("c_custkey")
    return t.customer.select(c("c_name").alias("member"), (((k * 37) % 1200) / 10.0 - 60).alias("lat"), (((k * 91) % 3600) / 10.0 - 180).alias("lon"))


_PLACES = "places as (select c_name as member, ((c_custkey * 37) % 1200) / 10.0::double - 60 as lat, ((c_custkey * 91) % 3600) / 10.0::double - 180 as lon from customer)"


def _haversine(lat: str, lon: str) -> str:
    return f"12742 * asin(sqrt(least(1, pow(sin(radians(lat - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians(lat)) * pow(sin(radians(lon - {lon}) / 2), 2))))"


@plan("GEORADIUS", "GEOSEARCH", "GEOSEARCHSTORE", "SPATIAL.NEARBY", "GEOADD", "SPATIAL.ADD", sql=f"with {_PLACES} select member, round({_haversine('10', '20')}, 3) as distance from places where {_haversine('10', '20')} <= 2500 and abs(lat - 10) <= 2500 / 111.0")
def geo_radius(t: Tables) -> DataFrame:
    return geo.radius(places(t), 10.0, 20.0, 2500.0).select("member", F.round("distance", 3).alias("distance"))


@plan("GEORADIUSBYMEMBER", sql=f"with {_PLACES}, m as (select lat as la, lon as lo from places where member = 'Customer#000000003') select member, round({_haversine('la', 'lo')}, 3) as distance from places, m where {_haversine('la', 'lo')} <= 2000")
def geo_radius_by_member(t: Tables) -> DataFrame:
    return geo.radius_by_member(places(t), "member", "Customer#000000003", 2000.0).select("member", F.round("distance", 3).alias("distance"))


@plan("SPATIAL.WITHIN", "GEO.BOUNDINGBOX", sql=f"with {_PLACES} select member, lat, lon from places where lat between -10 and 10 and lon between 0 and 90")
def geo_within(t: Tables) -> DataFrame:
    return geo.within(places(t), -10.0, 0.0, 10.0, 90.0)


@plan("GEOSEARCH", sql=f"with {_PLACES} select a.member as a_member, b.member as b_member from places a join (select member, lat as la, lon as lo from places) b on a.member < b.member and {_haversine('la', 'lo')} <= 800")
def geo_pairs(t: Tables) -> DataFrame:
    p = places(t)
    return geo.pairs_within(p, p, 800.0).where("a_member < b_member").select("a_member", "b_member")


@plan("GEODIST", "GEO.DISTANCE", "GEOPOS", sql=f"with {_PLACES} select member, round({_haversine('0', '0')} * 1000 / 1609.344, 4) as miles from places")
def geo_distance(t: Tables) -> DataFrame:
    return places(t).select("member", F.round(g.distance(F.lit(0.0), F.lit(0.0), c("lat"), c("lon"), "mi"), 4).alias("miles"))


def _geohash_sign(i: int) -> str:
    bits = [(f"{'yx'[k % 2 == 0]} >> {14 - k // 2}", 4 - j) for j, k in enumerate(range(5 * i, 5 * i + 5))]
    return f"substr('{g.BASE32}', (1 + " + " + ".join(f"((({b}) & 1) << {left})" for b, left in bits) + ")::bigint, 1)"


@plan("GEOHASH", "GEO.ENCODE", "GEO.DECODE", sql=f"with {_PLACES}, cells as (select member, least(32767, floor((lon + 180) / 360 * 32768))::bigint as x, least(32767, floor((lat + 90) / 180 * 32768))::bigint as y from places) select member, {' || '.join(map(_geohash_sign, range(6)))} as hash, true as near from cells")
def geohash(t: Tables) -> DataFrame:
    """The cell of each point, and that the cell's centre is near it."""
    h = places(t).withColumn("hash", g.geohash(c("lat"), c("lon"), 6)).withColumn("p", g.geohash_decode(c("hash"), 6))
    return h.select("member", "hash", ((F.abs(c("p.lat") - c("lat")) < 0.006) & (F.abs(c("p.lon") - c("lon")) < 0.006)).alias("near"))


_Q = [float(i % 7) - 3 for i in range(64)]


@plan("VECTOR.SEARCH", "EMBEDDING.SEARCH", "EMBEDDING.SIMILAR", "VECTOR.ADD", sql=f"select vec_id, round(list_cosine_similarity(embedding::double[], {_Q}::double[]), 6) as similarity from embeddings order by list_cosine_similarity(embedding::double[], {_Q}::double[]) desc, vec_id limit 10")
def vector_search(t: Tables) -> DataFrame:
    return ml.nearest(t.embeddings, "vec_id", "embedding", _Q, 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


@plan("VECTOR.STATS", sql="select label, count(*) as n, min(len(embedding))::int as dim from embeddings group by 1")
def vector_stats(t: Tables) -> DataFrame:
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("dim"))


_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 \\t\\n\\x0B\\f\\r]', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: length(w) > 1)"


@plan("FT.SEARCH", "FT.ADD", "FT.CREATE", "FT.GET", sql=f"select doc_id as id, len(list_intersect({_TOKENS}, ['the', 'token', 'apache', 'licensed'])) ::int as score from documents where len(list_intersect({_TOKENS}, ['the', 'token', 'apache', 'licensed'])) > 0")
def ft_search(t: Tables) -> DataFrame:
    return search.search(t.documents, "doc_id", "text", "The Token, Apache LICENSED!")


@plan("FT.SEARCH", "FT.INFO", sql=f"select doc_id as id, len(list_intersect({_TOKENS}, ['the', 'token', 'apache', 'licensed'])) as score from documents where len(list_intersect({_TOKENS}, ['the', 'token', 'apache', 'licensed'])) > 0")
def ft_search_index(t: Tables) -> DataFrame:
    return search.search_index(search.postings(t.documents, "doc_id", "text", "The Token, Apache LICENSED!"), "The Token, Apache LICENSED!")


@plan("FT.SEARCH", sql=f"""with d as (select doc_id as id, {_TOKENS} as words from documents), p as (select id, unnest(['token', 'apache']) as token, len(words) as n, words from d),
    h as (select id, token, n, len(list_filter(words, lambda w: w = token)) as tf from p), i as (select token, ln(1 + ((select count(*) from d) - count(*) + 0.5::double) / (count(*) + 0.5::double)) as idf from h where tf > 0 group by 1)
    select id, round(sum(idf * (tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * n / (select avg(len(words)) from d))))), 6) as score from h join i using (token) where tf > 0 group by 1 order by 2 desc, 1 limit 20""")
def ft_bm25(t: Tables) -> DataFrame:
    index = search.postings(t.documents, "doc_id", "text", "token apache")
    lengths = t.documents.select(c("doc_id").alias("id"), F.size(search.tokens(c("text"))).alias("n"))
    return search.bm25(index, lengths, "token apache").select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@plan("FT.AGGREGATE", "FT.TAGVALS", sql=f"select source, count(*) as n, avg(n_chars) as size from documents where list_contains({_TOKENS}, 'apache') group by 1")
def ft_aggregate(t: Tables) -> DataFrame:
    return t.documents.where(F.array_contains(search.tokens(c("text")), "apache")).groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("size"))


@plan("FT.DEL", "FT.DROPINDEX", "FT.ALIASADD", "FT.ALIASDEL", "FT._LIST", sql=f"select doc_id from documents where not list_contains({_TOKENS}, 'apache')")
def ft_del(t: Tables) -> DataFrame:
    return t.documents.where(~F.array_contains(search.tokens(c("text")), "apache")).select("doc_id")


@plan("TRIE.*", sql="with p as (select distinct p_name as w from part), x as (select w, unnest(range(1, length(w) + 1)) as i from p) select w[:i] as prefix, count(*) as words, sum(case when length(w) = i then 1 else 0 end)::bigint as ends from x group by 1")
def trie(t: Tables) -> DataFrame:
    return search.trie(t.part, "p_name")


@plan("TRIE.AUTOCOMPLETE", "TRIE.PREFIX", "TRIE.SEARCH", sql="select distinct p_name from part where starts_with(p_name, 'sm')")
def trie_autocomplete(t: Tables) -> DataFrame:
    return search.prefixed(t.part, "p_name", "sm").select("p_name").distinct()


scalars(
    "documents",
    "doc_id",
    {
        "nlp_tokenize": ("NLP.TOKENIZE", lambda: F.size(search.tokens(c("text"))).cast("long"), f"len({_TOKENS})"),
        "nlp_summarize": ("NLP.SUMMARIZE", lambda: search.summary(c("text")), "case when length(text) <= 100 then text else substr(text, 1, 100) || '...' end"),
        "nlp_entities": ("NLP.ENTITIES", lambda: F.size(search.entities(c("text"))), None),
        "sentiment": ("SENTIMENT.ANALYZE SENTIMENT.BATCH", lambda: search.sentiment(c("text")), "case when " + (d := f"len(list_filter({_TOKENS}, lambda w: w in {search.GOOD})) - len(list_filter({_TOKENS}, lambda w: w in {search.BAD}))") + f" > 0 then 'positive' when {d} < 0 then 'negative' else 'neutral' end"),
    },
)


@plan("NLP.KEYWORDS", sql=f"""with p as (select doc_id as id, token, count(*) as tf from (select doc_id, unnest({_TOKENS}) as token from documents) group by 1, 2), d as (select token, count(*) as df from p group by 1)
    select id, token, round(tf * ln((select count(*) from documents)::double / df), 6) as weight from p join d using (token) qualify row_number() over (partition by id order by round(tf * ln((select count(*) from documents)::double / df), 6) desc, token desc) <= 3""")
def nlp_keywords(t: Tables) -> DataFrame:
    return search.keywords(t.documents, "doc_id", "text", 3)


def edges(t: Tables) -> DataFrame:
    """Customers order parts, parts come from suppliers."""
    lines = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"))
    bought = lines.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("bought").alias("relation")).distinct()
    return bought.union(t.lineitem.select(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"), F.lit("from")).distinct())


_EDGES = "e as (select distinct 'c' || o_custkey as src, 'p' || l_partkey as dst, 'bought' as relation from lineitem join orders on l_orderkey = o_orderkey union all select distinct 'p' || l_partkey, 's' || l_suppkey, 'from' from lineitem)"


@plan("GRAPH.NEIGHBORS", "DAG.CHILDREN", "DAG.PARENTS", "GRAPH.QUERY", "GRAPH.GETNODE", "GRAPH.GETEDGE", sql=f"with {_EDGES} select src as node, dst as neighbor, relation from e where src in ('c1', 'c7', 'p5')")
def graph_neighbors(t: Tables) -> DataFrame:
    nodes = t.spark.createDataFrame([("c1",), ("c7",), ("p5",)], "node string")
    return graph.neighbors(edges(t), nodes, "node")


@plan("GRAPH.INFO", "DAG.LIST", sql=f"with {_EDGES}, x as (select src as node, 1 as o, 0 as i from e union all select dst, 0, 1 from e) select node, sum(o)::bigint as out, sum(i)::bigint as in from x group by 1")
def graph_degrees(t: Tables) -> DataFrame:
    return graph.degrees(edges(t))


@plan("GRAPH.DELNODE", "GRAPH.DELEDGE", sql=f"with {_EDGES} select src, dst from e where src not in ('p1', 'p2', 'c3') and dst not in ('p1', 'p2', 'c3')")
def graph_delnode(t: Tables) -> DataFrame:
    return graph.remove_nodes(edges(t), t.spark.createDataFrame([("p1",), ("p2",), ("c3",)], "node string")).select("src", "dst")


@plan("GRAPH.QUERY", sql=f"with recursive {_EDGES}, r as (select 'c1' as node, 0 as hops union select dst, hops + 1 from r join e on src = node where hops < 2) select node, min(hops) as hops from r group by 1")
def graph_reachable(t: Tables) -> DataFrame:
    return graph.reachable(edges(t), t.spark.createDataFrame([("c1",)], "node string"), 2)


@plan("DAG.TOPO", "DAG.ADDEDGE", "DAG.ADDNODE", sql=f"with {_EDGES} select node, max(level)::int as level from (select src as node, case when relation = 'bought' then 0 else 1 end as level from e union all select dst, case when relation = 'bought' then 1 else 2 end from e) group by 1 having node not like 'p%' or bool_or(level = 1)")
def dag_topo(t: Tables) -> DataFrame:
    bought = edges(t)
    return graph.levels(bought.join(bought.where("relation = 'bought'").select(c("dst").alias("src")).distinct(), "src", "left_semi").union(bought.where("relation = 'bought'")))


def _ranked(rounds: int) -> str:
    """Rounds of rank as common tables; the sum of shares of 0.85 and an even share of 0.15."""
    made = ["v as (select src as node from e union select dst from e), o as (select src, count(*) as d from e group by 1), r0 as (select node, 1::double / (select count(*) from v) as rank from v)"]
    for i in range(rounds):
        made.append(f"g{i} as (select dst as node, sum(rank / d) as got from e join o using (src) join r{i} on node = src group by 1), r{i + 1} as (select node, 0.15::double / (select count(*) from v) + 0.85::double * coalesce(got, 0) as rank from v left join g{i} using (node))")
    return ", ".join(made)


@plan("GRAPH.QUERY", sql=f"with {_EDGES}, {_ranked(5)} select node, round(rank, 9) as rank from r5 order by 2 desc, 1 limit 20")
def graph_pagerank(t: Tables) -> DataFrame:
    return graph.pagerank(edges(t), 5).select("node", F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "node").limit(20)


@plan("ANOMALY.DETECT", "ANOMALY.LEARN", sql="with s as (select event_type, avg(value) as m, stddev_pop(value) as d from events group by 1) select event_id, round((value - m) / d, 6) as z from events join s using (event_type) where abs((value - m) / d) > 2.5")
def anomaly_zscore(t: Tables) -> DataFrame:
    return ml.anomalies(t.events, "event_type", "value", 2.5).select("event_id", F.round("z", 6).alias("z"))


@plan("REGRESSOR.TRAIN", "REGRESSOR.PREDICT", "MODEL.TRAIN", "MODEL.PREDICT", sql="select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by 1")
def regressor(t: Tables) -> DataFrame:
    r = ml.regression(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return r.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"))


@plan("TIMEFORECAST.PREDICT", "TIMEFORECAST.TRAIN", sql="select event_id, round(avg(value) over (partition by event_type order by ts, event_id rows between 5 preceding and 1 preceding), 6) as forecast from events")
def forecast(t: Tables) -> DataFrame:
    return ml.moving_average(t.events, "event_type", ["ts", "event_id"], "value", 5).select("event_id", F.round("forecast", 6).alias("forecast"))


@plan("RECOMMEND.GET", "RECOMMEND.TRAIN", sql="with b as (select distinct l_suppkey % 10 as k, p_type, p_brand from lineitem join part on l_partkey = p_partkey), r as (select distinct l_orderkey, p_brand from lineitem join part on l_partkey = p_partkey) select a.p_brand as a, b.p_brand as b, count(*) as n from r a join r b on a.l_orderkey = b.l_orderkey and a.p_brand < b.p_brand group by 1, 2")
def recommend(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey"))
    return ml.together(rows, "l_orderkey", "p_brand", 1, 1000)


@plan("CLASSIFIER.TRAIN", "CLASSIFIER.PREDICT", "EVALUATOR.RUN", "EVALUATOR.METRICS", "MLXPERIMENT.METRICS", "MLXPERIMENT.COMPARE", sql="""with x as (select vec_id, label, unnest(embedding)::double as v, unnest(range(len(embedding))) as place from embeddings), m as (select label as guess, place, avg(v) as mean from x group by 1, 2),
    d as (select vec_id, label, guess, sum(pow(v - mean, 2)) as d from x join m using (place) group by 1, 2, 3), f as (select label, guess as predicted from d qualify row_number() over (partition by vec_id order by d, guess) = 1)
    select avg((label = predicted)::int) as accuracy, count(*) filter (label > 0 and predicted > 0) / count(*) filter (predicted > 0) as precision, count(*) filter (label > 0 and predicted > 0) / count(*) filter (label > 0) as recall from f""")
def classifier(t: Tables) -> DataFrame:
    model = ml.centroids(t.embeddings, "label", "embedding")
    found = ml.classify(t.embeddings, "vec_id", "embedding", model, "label").withColumnRenamed("label", "predicted")
    return ml.confusion(t.embeddings.join(found, "vec_id"), "label", "predicted")


@plan("CLUSTER.FIT", "CLUSTER.PREDICT", "CLUSTER.CENTROIDS")
def cluster(t: Tables) -> DataFrame:
    found, _ = ml.kmeans(t.embeddings, "vec_id", "embedding", 4, 3)
    return found.groupBy("cluster").agg(F.count("*").alias("n"))
