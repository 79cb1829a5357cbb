"""Text search, tries and small language helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9 of two or more, other signs dropped within words."""
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", "")
    return F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) > 1)


def postings(docs: DataFrame, id_col: str, text_col: str, query: str | None = None) -> DataFrame:
    """(token, id, tf): an inverted index; with a query, of its tokens only, so that no others are shuffled."""
    found = tokens(F.col(text_col))
    if query is not None:
        asked = tokens(F.lit(query))
        found = F.filter(found, lambda w: F.array_contains(asked, w))
    return docs.select(F.col(id_col).alias("id"), F.explode(found).alias("token")).groupBy("token", "id").agg(F.count("*").alias("tf"))


def search(docs: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """(id, score): documents with any query token; score is how many they have. No index is built: one scan, one filter."""
    asked = F.array_distinct(tokens(F.lit(query)))
    return docs.select(F.col(id_col).alias("id"), F.size(F.array_intersect(tokens(F.col(text_col)), asked)).alias("score")).where("score > 0")


def search_index(index: DataFrame, query: str) -> DataFrame:
    """The same from postings."""
    asked = index.sparkSession.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query)))).alias("token"))
    return index.join(F.broadcast(asked), "token").groupBy("id").agg(F.count("*").alias("score"))


def bm25(index: DataFrame, lengths: DataFrame, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) by BM25. lengths: (id, n)."""
    n, mean = lengths.agg(F.count("*"), F.avg("n")).first()
    asked = index.sparkSession.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query)))).alias("token"))
    hits = index.join(F.broadcast(asked), "token")
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.lit(mean or 1.0)))
    return hits.join(F.broadcast(df), "token").join(lengths, "id").groupBy("id").agg(F.sum(idf * tf).alias("score"))


def prefixed(words: DataFrame, word: str, prefix: str) -> DataFrame:
    """Words with a prefix; the filter reaches the scan."""
    return words.where(F.col(word).startswith(prefix))


def trie(words: DataFrame, word: str) -> DataFrame:
    """(prefix, words, ends): the nodes of a trie with the words below and at each."""
    return words.select(word).distinct().select(word, F.explode(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(F.col(word), F.lit(1), i))).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("words"), F.sum((F.col("prefix") == F.col(word)).cast("long")).alias("ends"))


def keywords(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, token, weight): top tokens of each document by tf-idf."""
    from .ranked import top

    index = postings(docs, id_col, text_col)
    n = docs.count()
    df = index.groupBy("token").agg(F.count("*").alias("df"))
    weighed = index.join(df, "token").withColumn("weight", F.round(F.col("tf") * F.log(F.lit(float(n)) / F.col("df")), 6))
    return top(weighed, "id", "token", "weight", k).select("id", "token", "weight")


def entities(text: Column) -> Column:
    """Runs of capitalised words that don't begin a sentence."""
    return F.regexp_extract_all(text, F.lit(r"(?<=[a-z,] )([A-Z][a-z]+(?: [A-Z][a-z]+)*)"), F.lit(1))


def summary(text: Column, n: int = 100) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("...")))


#: Words of feeling, for a count of good minus bad.
GOOD = ("good", "great", "love", "excellent", "happy", "best", "nice")
BAD = ("bad", "terrible", "hate", "awful", "sad", "worst", "stupid", "trash", "idiot", "disgusting")


def sentiment(text: Column) -> Column:
    words = tokens(text)
    count = lambda ws: F.size(F.filter(words, lambda w: w.isin(*ws)))
    d = count(GOOD) - count(BAD)
    return F.when(d > 0, "positive").when(d < 0, "negative").otherwise("neutral")
