"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of all words. It takes all its documents for as many epochs as the
target has room for; the rest of the budget goes to a sample without replacement. For that, each
document gets the key ``-ln(u) / q`` with u from a hash of its id and q its quality weight, the
documents of a source are sorted by key, and sizes are summed until the budget is used up. The
document on which it ends gives its first words only.

A source's budget ends at one place in its order. It is found by narrowing: sizes are summed over
ranges of the key, ``STEPS`` for each doubling, and prefix sums of these name the range on which the
budget ends; that range alone is cut again, until at most ``SORTED`` documents are left to sort. So
no task sorts a source or a fixed share of one, and texts aren't moved: each row compares its own
key with the place where its source ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

common.shipped(__name__)

#: Weights of the sources in their order, repeating; most epochs; ranges of a doubling of the key.
WEIGHTS, MOST, STEPS = (1, 2, 3), 3, 64
#: Documents of a source that are sorted in one task at most; cells of a range that is cut again; sources whose ends are broadcast at most.
SORTED, CELLS, BROADCAST_SOURCES = 1 << 17, 1024, 1 << 16
#: Signs that lower a text's quality weight.
SIGNS = "#$%&*@|<>{}[]^~_=+\\/!"
WORDS = r"[^\x20\x09-\x0D]+"


def quality(text: Column) -> Column:
    """1 to 16; falls by one for each sixtieth of the code points that are signs. Null and empty texts: 1."""
    n, plain = F.length(text).cast("long"), F.length(F.translate(text, SIGNS, "")).cast("long")
    share = F.floor((F.lit(60) * (n - plain)) / n)
    return F.when(n > 0, F.lit(16) - F.least(F.lit(15), share)).otherwise(F.lit(1)).cast("long")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with __rank from 0 in this order, by sorted ranges; what meets in one task is a count for each range."""
    parts = common.checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy("__part").agg(F.count("*").alias("n")).select(F.col("__part").alias("__p"), (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__rank", within).join(counts, F.col("__part") == F.col("__p")).withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__part", "__p", "__before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (none, name, size): adds num and den, whose quotient is the target.

    Shares stop at ``most`` times the size; what is over is shared by weight among the others
    until none is above. Products are exact. Each round is one sum over the sources.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("__rank"), F.lit(len(weights))) + 1).cast("int"))
    rows = common.checkpoint(ranked(sources, F.col("none"), F.col("name")).withColumn("w", weight.cast("decimal(10,0)")).drop("__rank"))
    total, free = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    rest = total

    def above(rest: int, free: int) -> Column:
        return F.col("w") * F.lit(rest).cast("decimal(20,0)") > F.lit(most).cast("decimal(5,0)") * F.col("size").cast("decimal(20,0)") * F.lit(free).cast("decimal(12,0)")

    while True:
        over = above(rest, free)
        held, now = rows.agg(F.coalesce(F.sum(F.when(over, F.col("size"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0))).first()
        if (total - most * held, now) == (rest, free):
            break
        rest, free = total - most * held, now
    over = above(rest, free)
    return rows.select(
        "none",
        "name",
        "size",
        F.when(over, F.lit(most) * F.col("size")).otherwise((F.col("w") * F.lit(rest)).cast("long")).alias("num"),
        F.when(over, F.lit(1)).otherwise(F.lit(max(int(free), 1))).cast("long").alias("den"),
    )


def hinted(sources: DataFrame) -> DataFrame:
    """To be broadcast, if there are few. sources: checkpointed, one row for each source."""
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def ends(rows: DataFrame, left: DataFrame, sorted_rows: int = SORTED) -> DataFrame:
    """(none, name, k, i, t, rest, copies): where each source's budget ends, in the order of key, id and tie.

    rows: (none, name, id, tie, size, key); left: (none, name, left), words that the budget has.
    copies rows, equal in the three, share the last rest words. Sources of size 0 have no end.
    """
    source = ["none", "name"]
    up_to = Window.partitionBy(*source).orderBy("cell")

    def crossed(cells: DataFrame) -> DataFrame:
        """(none, name, cell, left): the cell of each source on which its budget ends, and what is left there. cells: (none, name, cell, n, left)."""
        after = F.sum("n").over(up_to)
        reached = cells.withColumn("after", after).where("after > left")
        first = reached.groupBy(*source).agg(F.min_by(F.struct("cell", (F.col("left") - F.col("after") + F.col("n")).alias("left")), "cell").alias("x"))
        return common.checkpoint(first.select(*source, "x.*"))

    bucket = F.greatest(F.lit(-16 * STEPS), F.floor(F.log2("key") * STEPS)).cast("int")
    now = rows.where("size > 0").withColumn("cell", bucket)
    for column in ("key", "tie"):
        while True:
            cells = now.groupBy(*source, "cell").agg(F.sum("size").alias("n"))
            end = crossed(cells.join(left, source))
            now = common.checkpoint(now.join(hinted(end), [*source, "cell"]).drop("cell", "left"))
            left = end.select(*source, "left")
            spread = common.checkpoint(now.groupBy(*source).agg(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high"), F.count("*").alias("m")))
            now = now.join(hinted(spread), source)
            place = F.floor((F.col(column).cast("double") - F.col("low")) / (F.col("high") - F.col("low")) * CELLS)
            now = now.withColumn("cell", F.when((F.col("m") > sorted_rows) & (F.col("high") > F.col("low")), F.least(F.lit(CELLS - 1), place)).otherwise(0).cast("int")).drop("low", "high", "m")
            if spread.where(F.col("m") > sorted_rows).where("high > low").isEmpty():
                break
    # Rows equal in all are one here, so what is sorted is bounded by the different ones.
    equal = now.groupBy(*source, "key", "id", "tie").agg(F.sum("size").alias("n"), F.count("*").alias("copies"))
    order = Window.partitionBy(*source).orderBy("key", "id", "tie")
    reached = equal.withColumn("after", F.sum("n").over(order)).join(left, source).where("after > left")
    place = F.struct("key", "id", "tie")
    last = reached.groupBy(*source).agg(F.min_by(F.struct(F.col("key").alias("k"), F.col("id").alias("i"), F.col("tie").alias("t"), (F.col("left") - F.col("after") + F.col("n")).alias("rest"), "copies"), place).alias("x"))
    return last.select(*source, "x.*")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix:") -> DataFrame:
    """The rows of docs with size, source_size, target and taken (words the mix takes, repeats counted).

    Null texts have size 0 and take nothing; documents without a source are one source, the last.
    Very long texts count whole, and one on which a budget ends gives its first words. Ties of keys
    fall by id, then by a hash of the text; rows equal in all three share alike. A column of docs
    with one of the four names is replaced. Reruns agree. An empty table gives an empty one.
    """
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    text, digest = F.col(text_col), F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(names)],
        F.col(id_col).alias("id"),
        F.col(source_col).isNull().alias("none"),
        F.coalesce(source_col, F.lit("")).alias("name"),
        F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        quality(text).alias("q"),
        F.xxhash64(text).alias("tie"),
        (-F.log(u)).alias("e"),
    ).withColumn("key", F.col("e") / F.col("q"))
    narrow = common.checkpoint(rows.select("none", "name", "id", "tie", "size", "key"))
    shares = common.checkpoint(targets(narrow.groupBy("none", "name").agg(F.sum("size").alias("size")), weights, most).withColumnRenamed("size", "source_size"))
    shares = shares.withColumn("epochs", F.expr("coalesce(num div nullif(den * source_size, 0), 0)")).withColumn("left", F.expr("num div den") - F.col("epochs") * F.col("source_size"))
    found = common.checkpoint(shares.join(ends(narrow, shares.select("none", "name", "left")), ["none", "name"], "left"))
    here, end = F.struct("key", "id", "tie"), F.struct("k", "i", "t")
    part = F.when(F.col("copies").isNull(), 0).when(here < end, F.col("size")).when(here == end, F.least("size", F.expr("rest div copies"))).otherwise(0)
    taken = F.col("epochs") * F.col("size") + part
    out = rows.join(hinted(found), ["none", "name"])
    return out.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(names)], "size", "source_size", (F.col("num").cast("double") / F.col("den").cast("double")).alias("target"), taken.cast("long").alias("taken"))


#: The same rows in DuckDB.
SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    case when length(text) > 0 then 16 - least(15, floor(60 * (length(text) - length(translate(text, '#$%&*@|<>{}[]^~_=+\/!', ''))) / length(text))) else 1 end as q,
    -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0) as e
  from documents),
s as (
  select source, sum(size)::bigint as size, row_number() over (order by source nulls last) - 1 as r from d group by source),
w as (select source, size, (r % 3 + 1)::hugeint as w, 3 * size::hugeint as cap, sum(size) over ()::hugeint as total from s),
o as (
  select *, total - coalesce(sum(cap) over (order by cap::double / w, source rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(w) over (order by cap::double / w, source rows between current row and unbounded following) as free from w),
f as (
  select *, w * rest > cap * free as over from o),
g as (
  select total - coalesce(sum(cap) filter (over), 0) as rest, sum(w) filter (not over) as free from f group by total),
t as (
  select f.source, f.size as source_size, (case when over then cap else w * g.rest end)::bigint as num, (case when over then 1 else g.free end)::bigint as den from f, g),
p as (
  select doc_id, size, source_size, num, den, num // nullif(den * source_size, 0) as epochs,
    sum(size) over (partition by d.source order by e / q, doc_id rows between unbounded preceding and current row)::bigint - size as before
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, num::double / den::double as target,
  (coalesce(epochs, 0) * size + greatest(0, least(size, num // den - coalesce(epochs, 0) * source_size - before)))::bigint as taken from p
"""
