"""Order-sensitive operators: context links, duplicate handling, sampling, time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def link_context(units: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """prev and next texts within a document, empty at its edges."""
    w = W.partitionBy(doc).orderBy(order)
    return units.withColumn("prev", F.lag(text, 1, "").over(w)).withColumn("next", F.lead(text, 1, "").over(w))


def flag_duplicates(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """dup_flag on all but the first row of a key (null is a key of its own; a null order comes first).
    order tells a key's rows apart. The first ones are aggregated and joined back, so that a hot key's
    rows need not meet in one task."""
    keyed = rows.withColumn("_key", key)
    first = keyed.groupBy(F.col("_key").alias("_k")).agg(F.min(F.struct(order)).alias("_first"))
    marked = keyed.join(first, F.col("_key").eqNullSafe(F.col("_k")))
    return marked.withColumn("dup_flag", ~F.struct(order).eqNullSafe(F.col("_first"))).select(*rows.columns, "dup_flag")


def priority_dedup(rows: DataFrame, key: str, tier: str, order: str) -> DataFrame:
    """Per non-blank key the row of the highest tier, the earliest on ties, by a pre-aggregated
    minimum so that a hot key never meets in one task; blank keys all stay."""
    named = rows.where(F.coalesce(F.col(key), F.lit("")) != "")
    best = named.groupBy(key).agg(F.min(F.struct((-F.col(tier)).alias("t"), F.col(order).alias("o"))).alias("b")).select(F.col(key).alias("_k"), F.col("b.o").alias("_o"))
    kept = named.join(best, (F.col(key) == F.col("_k")) & (F.col(order) == F.col("_o")), "left_semi")
    return kept.unionByName(rows.where(F.coalesce(F.col(key), F.lit("")) == ""))


def dedup_losers(rows: DataFrame, key: str, tier: str, order: str, carry: Sequence[str]) -> DataFrame:
    """Rows that lose priority_dedup, with the winner's attributes as winner_*."""
    named = rows.where(F.coalesce(F.col(key), F.lit("")) != "")
    best = named.groupBy(key).agg(F.min(F.struct((-F.col(tier)).alias("t"), F.col(order).alias("o"), *[F.col(c).alias(f"w_{c}") for c in carry])).alias("b"))
    lost = named.join(best, key).where(F.col(order) != F.col("b.o"))
    return lost.select(*rows.columns, *[F.col(f"b.w_{c}").alias(f"winner_{c}") for c in carry])


def sessions(rows: DataFrame, doc: str, order: str, text: str, header: Column) -> DataFrame:
    """Transcript lines to (doc, speaker, content): a header line opens a turn."""
    w = W.partitionBy(doc).orderBy(order)
    marked = rows.where(F.trim(F.col(text)) != "").withColumn("_h", header).withColumn("_s", F.sum(F.col("_h").cast("int")).over(w))
    lines = F.transform(F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))), lambda x: x["t"])
    return marked.groupBy(doc, F.col("_s").alias("session")).agg(F.max(F.when(F.col("_h"), F.col(text))).alias("speaker"), F.array_join(lines, " ").alias("content"), F.count_if(~F.col("_h")).alias("n_lines"))


def numbered(rows: DataFrame, order: Sequence[str], name: str, buckets: int = 256) -> DataFrame:
    """rows numbered from 1 in the given order, by numbers within ranges of the first order column and
    the ranges' sizes, so that no window spans the table. The ranges' bounds are values of the rows
    with the smallest hashes, ``buckets`` of them at most; nulls come first."""
    first = F.col(order[0])
    drawn = rows.select(first.alias("v")).where("v IS NOT NULL").orderBy(F.xxhash64("v"), "v").limit(8 * buckets).distinct().orderBy("v").collect()
    cuts = [r["v"] for r in drawn][:: max(1, -(-len(drawn) // buckets))]
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= first)) if cuts else F.lit(0)
    placed = rows.withColumn("_range", F.when(first.isNull(), -1).otherwise(place))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_size"))
    start = F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    starts = sizes.select("_range", start.alias("_start"))
    return placed.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_own")).drop("_range", "_own", "_start")


def sample_rank(seed: str, key: Column) -> Column:
    """A deterministic shuffle: rows order by the hash of seed and key."""
    return F.md5(F.concat(F.lit(seed + ":"), key.cast("string")).cast("binary"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    return rows.orderBy(sample_rank(seed, F.col(key)), key).limit(n)


def stratified_sample(rows: DataFrame, strata: Sequence[str], key: str, quota: int, seed: str) -> DataFrame:
    """quota rows of each stratum."""
    w = W.partitionBy(*strata).orderBy(sample_rank(seed, F.col(key)), key)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= quota)


def quota_sample(rows: DataFrame, stratum: str, quotas: dict[str, int], key: str, total: int, seed: str) -> DataFrame:
    """Each stratum's quota, then a refill up to total from the rows not taken, all in hash order."""
    rank = sample_rank(seed, F.col(key))
    quota = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(stratum)), F.lit(0))
    ranked = rows.withColumn("rn", F.row_number().over(W.partitionBy(stratum).orderBy(rank, key))).withColumn("refill", (F.col("rn") > quota).cast("int"))
    return ranked.orderBy("refill", rank, key).limit(total).drop("rn")


def balanced_draw(rows: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows spread evenly over strata in hash order: round after round, one of each."""
    rank = sample_rank(seed, F.col(key))
    order = F.row_number().over(W.partitionBy(F.coalesce(F.nullif(F.trim(F.col(stratum)), F.lit("")), F.lit("_other"))).orderBy(rank, key))
    return rows.withColumn("round", order).orderBy("round", sample_rank(seed, F.col(stratum)), key).limit(n)


def cap_candidates(rows: DataFrame, label: str, score: str, key: str, column: str, cap: int, target: int) -> DataFrame:
    """The rows that greedy_capped with this one cap can reach: per label the best ``cap`` of each value,
    of null and empty ones, which have no cap, the best ``target``. With distinct keys the choice is
    that from all rows."""
    blank = F.coalesce(F.col(column), F.lit("")) == ""
    w = W.partitionBy(label, F.coalesce(F.col(column), F.lit(""))).orderBy(F.desc_nulls_last(F.nanvl(F.col(score), F.lit(None).cast("double"))), F.asc_nulls_last(key))
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.when(blank, target).otherwise(cap)).drop("_rn")


def greedy_capped(rows: DataFrame, label: str, score: str, key: str, caps: dict[str, int], target: int) -> DataFrame:
    """Per label, rows in score order while no capped column's value is used up, until target.

    The walk depends on its own choices, so each label's candidates meet in one task; callers pass
    the candidates, a bounded multiple of the quota."""

    def walk(pdf):
        used: dict = {c: {} for c in caps}
        take = []
        for row in pdf.sort_values([score, key], ascending=[False, True]).itertuples(index=False):
            if len(take) == target:
                break
            values = {c: getattr(row, c) for c in caps}
            if any(v not in (None, "") and used[c].get(v, 0) >= caps[c] for c, v in values.items()):
                continue
            for c, v in values.items():
                used[c][v] = used[c].get(v, 0) + 1
            take.append(getattr(row, key))
        return pdf[pdf[key].isin(take)]

    return rows.groupBy(label).applyInPandas(walk, rows.schema)


def moving_average(series: DataFrame, day: str, value: str, days: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """Over a dense calendar of (day, value), one for each value of ``by``; a missing day counts 0."""
    ends = series.groupBy(*by).agg(F.min(day).alias("lo"), F.max(day).alias("hi")).where("lo IS NOT NULL")
    calendar = ends.select(*by, F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"), F.expr("interval 1 day"))).alias(day))
    w = W.partitionBy(*by).orderBy(day).rowsBetween(1 - days, 0)  # one row a day
    dense = calendar.join(series, [*by, day], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))
    return dense.withColumn("ma", F.avg(value).over(w))


def time_bins(series: DataFrame, day: str, value: str, by: Sequence[str] = (), weeks: int = 1) -> DataFrame:
    """Mean value by bins of whole weeks, Monday to Sunday, counted from the week of 1970-01-05."""
    week = F.floor(F.datediff(F.to_date(day), F.lit("1970-01-05").cast("date")) / (7 * weeks))
    start = F.date_add(F.lit("1970-01-05").cast("date"), (week * 7 * weeks).cast("int"))
    return series.groupBy(start.alias("bin"), *by).agg(F.avg(value).alias(value)).withColumn("bin_end", F.date_add("bin", 7 * weeks - 1))


def daily_shares(rows: DataFrame, day: str, group: str, label: str, focus: Sequence[str]) -> DataFrame:
    """(day, group, label, n, share) of the labels in focus on every day on which a group has rows.
    label may hold one label or an array of them."""
    held = lambda x: F.array_contains(label, x) if dict(rows.dtypes)[label].startswith("array") else F.col(label) == x
    counted = rows.where(F.col(day).isNotNull()).groupBy(F.to_date(day).alias("day"), group).agg(F.count("*").alias("n"), *[F.count_if(held(x)).alias(f"_{i}") for i, x in enumerate(focus)])
    tall = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"_{i}").alias("hits")) for i, x in enumerate(focus)]))
    return counted.select("day", group, "n", tall.alias("t")).select("day", group, F.col("t.label").alias("label"), "n", (F.col("t.hits") / F.col("n")).alias("share"))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The upsert's result: the last row of each key."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
