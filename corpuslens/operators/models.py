"""Edges to models that run elsewhere: embeddings, zero-shot scores, remembered answers, rescue."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..functions.text import memo_key
from .rules import three_way


def embed(rows: DataFrame, text: str, load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], batch: int = 128) -> DataFrame:
    """rows with ``embedding`` by a model that ``load`` makes once a task."""
    shape = StructType([f for f in rows.schema.fields if f.name != "embedding"]).add("embedding", ArrayType(DoubleType()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in parts:
            texts = pdf[text].fillna("").tolist()
            made = [list(map(float, v)) for s in range(0, len(texts), batch) for v in model(texts[s : s + batch])]
            yield pdf.assign(embedding=made)[shape.names]

    return rows.mapInPandas(run, shape)


def margin(scores: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """The best positive label's score less the best negative one's; scores: a map by label."""
    best = lambda labels: F.greatest(*[F.coalesce(F.try_element_at(scores, F.lit(x)), F.lit(0.0)) for x in labels], F.lit(0.0))
    return best(positive) - best(negative)


def nli_status(m: Column, keep: float = 0.10, drop: float = 0.0) -> Column:
    return F.when(m >= keep, "KEEP").when(m <= drop, "DROP").otherwise("REVIEW")


def two_stage(first: Column, second: Column, keep: float = 0.10, drop: float = 0.0) -> Column:
    """struct(margin, status, calibrated): the first margin decides where it can; the second, taken on
    more labels, where the first lies between. A row without a second keeps its first."""
    unsure = nli_status(first, keep, drop) == "REVIEW"
    m = F.when(unsure, F.coalesce(second, first)).otherwise(first)
    return F.struct(m.alias("margin"), nli_status(m, keep, drop).alias("status"), (unsure & second.isNotNull()).alias("calibrated"))


def remembered(rows: DataFrame, text: str, memo: DataFrame, infer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows with margin and status, what is new to the memo). memo(key, margin, status, at): a key's
    latest line counts. infer gets each unknown text once, as (key, text), and gives (key, margin, status)."""
    keyed = rows.withColumn("key", memo_key(F.col(text)))
    known = memo.where("key IS NOT NULL").groupBy("key").agg(F.max_by(F.struct("margin", "status"), "at").alias("_m")).select("key", "_m.margin", "_m.status")
    asked = keyed.join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.substring(F.min(F.coalesce(F.col(text), F.lit(""))), 1, 256).alias("text"))
    new = infer(asked).select("key", "margin", "status")
    return keyed.join(known.unionByName(new), "key", "left").drop("key"), new


def rescue(rows: DataFrame, similarity: str, status: str, key: str, judge: Callable[[DataFrame], DataFrame], most: int = 200, share: float = 0.05) -> DataFrame:
    """rows with the best of the dropped ones judged once more: the nearest min(most, share of all
    rows, one at least) go to judge, which gives (key, nli_status, nli_score); what it keeps is up for
    REVIEW again. The number comes from a count of the rows in the same plan."""
    total = rows.agg(F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.count("*") * share))).alias("_n"))
    border = rows.where(F.col(status) == "DROP").orderBy(F.desc(similarity), key).limit(most).withColumn("_r", F.row_number().over(_all_by(similarity, key)))
    judged = judge(border.crossJoin(F.broadcast(total)).where("_r <= _n").drop("_r", "_n")).select(key, "nli_status", "nli_score")
    out = rows.drop("nli_status", "nli_score").join(judged, key, "left")
    return out.withColumn(status, F.when((F.col(status) == "DROP") & (F.col("nli_status") == "KEEP"), "REVIEW").otherwise(F.col(status)))


def _all_by(similarity: str, key: str):
    from pyspark.sql.window import Window as W

    return W.orderBy(F.desc(similarity), key)  # of at most ``most`` rows


def semantic_status(similarity: Column, quantiles: DataFrame | None = None, keep: float = 0.42, drop: float = 0.28) -> Column:
    """KEEP, REVIEW or DROP by similarity; with a row of quantiles (q20, q05) beside it the bounds adapt
    to them: the higher of keep and q20, the lower of drop and q05."""
    if quantiles is None:
        return three_way(similarity, F.lit(keep), F.lit(drop))
    return three_way(similarity, F.greatest(F.lit(keep), F.col("q20")), F.least(F.lit(drop), F.col("q05")))
