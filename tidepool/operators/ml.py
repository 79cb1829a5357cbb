"""Models that are aggregates: each trains by sums that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v


def nearest(store: DataFrame, id_col: str, vec_col: str, query: list[float], k: int) -> DataFrame:
    """Exact top k by cosine; a top-k per partition, then of those."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return store.select(id_col, v.cosine(v.double(F.col(vec_col)), q).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


def anomalies(df: DataFrame, by: str, value: str, limit: float) -> DataFrame:
    """Adds z of each value within its group; rows with abs(z) over the limit stay. Group statistics are joined, so no window gathers a group."""
    s = df.groupBy(by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return df.join(s, by).withColumn("z", F.when(F.col("__s") > 0, (F.col(value) - F.col("__m")) / F.col("__s"))).where(F.abs("z") > limit).drop("__m", "__s")


def regression(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least squares line of each group."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def moving_average(df: DataFrame, by: str, order: list[str], value: str, n: int) -> DataFrame:
    """Adds forecast: the mean of the n values before."""
    return df.withColumn("forecast", F.avg(value).over(Window.partitionBy(by).orderBy(*order).rowsBetween(-n, -1)))


def centroids(df: DataFrame, label: str, vec_col: str) -> DataFrame:
    """(label, place, mean): nearest-centroid model, one row for each place of the vector."""
    return df.select(label, F.posexplode(v.double(F.col(vec_col))).alias("place", "x")).groupBy(label, "place").agg(F.avg("x").alias("mean"))


def classify(df: DataFrame, id_col: str, vec_col: str, model: DataFrame, label: str) -> DataFrame:
    """(id, label) of the nearest centroid; model: centroids(), one vector for each label, broadcast after a count."""
    from .joins import small

    rows = model.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "mean"))), lambda x: x["mean"]).alias("__c"))
    d = df.select(id_col, v.double(F.col(vec_col)).alias("__v")).crossJoin(small(rows)).select(id_col, label, v.euclidean(F.col("__v"), F.col("__c")).alias("d"))
    return d.groupBy(id_col).agg(F.min_by(label, F.struct("d", label)).alias(label))


def kmeans(df: DataFrame, id_col: str, vec_col: str, k: int, rounds: int = 5) -> tuple[DataFrame, list[list[float]]]:
    """(id, cluster) and the centres. Each round is one pass of sums; k centres of fixed length reach the driver."""
    points = df.select(id_col, v.double(F.col(vec_col)).alias("v"))
    centres = [r[0] for r in points.orderBy(F.xxhash64(id_col), id_col).limit(k).select("v").collect()]

    def assigned() -> DataFrame:
        table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
        d = F.transform(table, lambda c: v.euclidean(F.col("v"), c))
        return points.withColumn("cluster", F.array_position(d, F.array_min(d)).cast("int") - 1)

    for _ in range(rounds):
        means = assigned().select("cluster", F.posexplode("v").alias("p", "x")).groupBy("cluster", "p").agg(F.avg("x").alias("m")).collect()
        new = {}
        for r in sorted(means, key=lambda r: (r.cluster, r.p)):
            new.setdefault(r.cluster, []).append(r.m)
        centres = [new.get(i, c) for i, c in enumerate(centres)]
    return assigned().select(id_col, "cluster"), centres


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, and precision and recall of truth > 0."""
    hit = (F.col(truth) > 0) & (F.col(predicted) > 0)
    count = lambda c: F.sum(c.cast("int"))
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"), (count(hit) / count(F.col(predicted) > 0)).alias("precision"), (count(hit) / count(F.col(truth) > 0)).alias("recall"))


def together(df: DataFrame, basket: str, item: str, least: int, most_in_basket: int) -> DataFrame:
    """(a, b, n): items bought together at least ``least`` times.

    Baskets of more than ``most_in_basket`` items are cut by item hash into parts that are paired with each other, so no task holds a whole one.
    """
    rows = df.select(F.col(basket).alias("__basket"), F.col(item).alias("i")).distinct()
    size = rows.groupBy("__basket").agg(F.ceil(F.count("*") / most_in_basket).cast("int").alias("__n"))
    parts = rows.join(size, "__basket").withColumn("__own", F.pmod(F.xxhash64("i"), F.col("__n")).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    parts = parts.select("__basket", "i", "__own", F.least("__own", "__other").alias("__x"), F.greatest("__own", "__other").alias("__y"))
    keys = ["__basket", "__x", "__y"]
    a, b = parts.select(*keys, F.col("i").alias("a"), F.col("__own").alias("__oa")), parts.select(*keys, F.col("i").alias("b"), F.col("__own").alias("__ob"))
    pairs = a.join(b, keys).where("a < b AND (__x = __y OR __oa <> __ob)")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
