"""Lexical and vector similarity."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def char_bm25(rows: DataFrame, key: str, text: str, query: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(key, score): BM25 of each text with characters as terms; those of the query count as often as they
    stand in it. A term in more than half of the texts has epsilon times the mean weight of all
    characters. Document frequencies are counted for every character; of the texts only numbers move."""
    c = F.coalesce(F.col(text), F.lit(""))
    wanted = Counter(query)
    size = rows.agg(F.count("*").alias("n"), F.avg(F.length(c)).alias("avgdl"))
    df = rows.select(F.explode(F.array_distinct(F.split(c, ""))).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(size)).select("c", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))  # one row
    # one row: the mean weight and the query's weights
    weights = idf.agg((epsilon * F.avg("idf")).alias("eps"), *[F.max(F.when(F.col("c") == x, F.col("idf"))).alias(f"w{i}") for i, x in enumerate(wanted)])
    joined = rows.select(key, c.alias("t")).crossJoin(F.broadcast(size)).crossJoin(F.broadcast(weights))
    score = F.lit(0.0)
    for i, (x, times) in enumerate(wanted.items()):
        tf = F.length("t") - F.length(F.replace(F.col("t"), F.lit(x), F.lit("")))
        w = F.when(F.col(f"w{i}") < 0, F.col("eps")).otherwise(F.col(f"w{i}"))
        score = score + F.coalesce(F.when(tf > 0, times * w * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.length("t") / F.col("avgdl")))), F.lit(0.0))
    return joined.select(key, score.alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of doubles; null where one has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def centroid(rows: DataFrame, vector: str, name: str = "centroid") -> DataFrame:
    """One row: the mean of the vectors, by position."""
    means = rows.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(name))  # as many as the vector has places
