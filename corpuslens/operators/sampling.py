"""Samples with quotas: validation sets, top-ups, seeds and gap filling, all by hashes of seed and key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import any_term
from .order import greedy_capped, sample_rank

PERIODS = ("within_3m", "within_6m", "over_6m")


def time_period(date: Column, anchor: str) -> Column:
    """How long before the anchor day a time lies, in whole days rounded down; times after it are near."""
    days = F.floor((F.unix_timestamp(F.lit(anchor).cast("timestamp")) - F.unix_timestamp(date.cast("timestamp"))) / 86400)
    return F.when(date.isNull(), "unknown").when(days < 90, PERIODS[0]).when(days < 180, PERIODS[1]).otherwise(PERIODS[2])


def _best(rows: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    w = W.partitionBy(*by).orderBy("_h", "_k")
    return rows.withColumn("_top", F.row_number().over(w)).where(F.col("_top") <= n).drop("_top")


def validation_sample(rows: DataFrame, group: str, source: str, period: str, key: str, quotas: dict[str, int], plain: Sequence[str], n: int, seed: str) -> DataFrame:
    """n rows of each group: of each source its quota, a third of it from each period and the rest from
    whatever the source has left; sources in ``plain`` without regard to periods. What the quotas leave
    of n, and the quota of a source that the group lacks, comes from any of its rows not taken.

    Only rows that can be taken are ranked together: the first by hash of each cell, as many as any
    step could ask for, so the last windows hold a few times n rows of a group. key is unique.
    """
    third = {s: q // 3 for s, q in quotas.items()}
    quota = lambda of: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.col(source)), F.lit(0))
    base = rows.withColumns({"_h": sample_rank(seed, F.col(key)), "_k": F.col(key)})
    most = max(quotas.values(), default=0)
    pool = reduce(DataFrame.unionByName, [_best(base, [group, source, period], most), _best(base, [group, source], 2 * most), _best(base, [group], 2 * n)])
    pool = pool.dropDuplicates(["_k"])
    cell = F.row_number().over(W.partitionBy(group, source, period).orderBy("_h", "_k"))
    even = ~F.col(source).isin(*plain) & F.col(period).isin(*PERIODS) & (cell <= quota(third))
    pool = pool.withColumn("_even", even)
    rank = F.row_number().over(W.partitionBy(group, source).orderBy(F.desc("_even"), "_h", "_k"))
    pool = pool.withColumn("_taken", rank <= quota(quotas))
    given = sum((F.max(F.when(F.col(source) == s, q).otherwise(0)).over(W.partitionBy(group)) for s, q in quotas.items()), F.lit(0))
    pool = pool.withColumn("_rest", n - given)
    extra = F.row_number().over(W.partitionBy(group).orderBy("_taken", "_h", "_k"))  # those not taken come first
    return pool.withColumn("_extra", extra).where(F.col("_taken") | (F.col("_extra") <= F.col("_rest"))).drop("_h", "_k", "_even", "_taken", "_rest", "_extra")


def top_up(rows: DataFrame, chosen: DataFrame, group: str, groups: Sequence[str], key: str, total: int, seed: str) -> DataFrame:
    """chosen and, until there are ``total`` rows, others of rows: what is missing is split evenly over
    the groups, the first ones getting the remainder, by hash order among rows not chosen yet."""
    missing = chosen.agg(F.greatest(F.lit(0), F.lit(total) - F.count("*")).alias("_missing"))
    place = {g: i for i, g in enumerate(groups)}
    nth = F.try_element_at(F.create_map(*[F.lit(x) for kv in place.items() for x in kv]), F.col(group))
    share = F.floor(F.col("_missing") / len(groups)) + (nth < F.col("_missing") % len(groups)).cast("int")
    rest = rows.where(F.col(group).isin(*groups)).join(chosen.select(key), key, "left_anti")
    rest = rest.withColumns({"_h": sample_rank(seed, F.col(key)), "_k": F.col(key)})
    more = _best(rest, [group], total).withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy("_h", "_k"))).crossJoin(F.broadcast(missing)).where(F.col("_n") <= share)  # one row
    return chosen.unionByName(more.select(*chosen.columns))


def pick_seeds(texts: DataFrame, text: str, order: str, buckets: Sequence[tuple[Sequence[str], float]], k: int, seed: str) -> DataFrame:
    """(text, bucket): seed texts, each bucket's share of k among the distinct texts with one of its
    terms, and texts in order of first occurrence (bucket -1) until there are k. A text may be the
    seed of several buckets."""
    distinct = texts.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.min(order).alias("_o"))
    picked = []
    for i, (terms, share) in enumerate(buckets):
        hits = distinct.where(any_term(F.col("text"), terms)).orderBy(sample_rank(f"{seed}:{i}", F.col("text")), "text").limit(int(share * k))
        picked.append(hits.select("text", F.lit(i).alias("bucket")))
    seeds = reduce(DataFrame.unionByName, picked)
    left = seeds.agg((F.lit(k) - F.count("*")).alias("_left"))
    back = distinct.join(seeds.select("text"), "text", "left_anti").orderBy("_o", "text").limit(k)
    back = back.withColumn("_i", F.row_number().over(W.orderBy("_o", "text"))).crossJoin(F.broadcast(left)).where("_i <= _left")  # k rows, one row
    return seeds.unionByName(back.select("text", F.lit(-1).alias("bucket")))


def draw_balanced(rows: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows spread evenly over strata (a blank one is a stratum of its own), and from the start again
    with ``again`` counting up, where there are fewer than n."""
    from .order import balanced_draw

    one = balanced_draw(rows, stratum, key, n, seed)
    ordered = one.withColumn("_i", F.row_number().over(W.orderBy("round", sample_rank(seed, F.col(stratum)), key)))  # n rows
    size = ordered.agg(F.count("*").alias("_size"))
    again = ordered.crossJoin(F.broadcast(size)).withColumn("again", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.lit(n) / F.col("_size")).cast("int") - 1))))
    return again.where(F.col("again") * F.col("_size") + F.col("_i") <= n).drop("_i", "_size")


def sample_score(text: Column, similarity: Column, margin: Column, gap_terms: dict[str, Sequence[str]], has_speaker: Column, has_target: Column, procedural: Column, role: Column) -> Column:
    """struct(score, reasons) of how useful a text is as a candidate: near a classifier's bounds, with
    terms of labels that are missing, with actors and issues, quoting or claiming, of a good length."""
    size = F.length(text)
    terms = [
        (similarity.between(0.45, 0.60), 2.0, "boundary_semantic"), (margin.between(0.05, 0.20), 1.5, "boundary_nli"),
        *[(any_term(text, words), 1.0, f"l2_{label}") for label, words in gap_terms.items()],
        (has_speaker, 1.0, "has_speaker"), (has_target, 0.8, "has_target"), (procedural, 0.5, "procedural"), (role == "quote", 1.5, "quote"), (role == "claim", 1.0, "claim"), (size.between(50, 200), 0.5, "good_length"),
    ]
    score = sum((F.when(cond, value).otherwise(0.0) for cond, value, _ in terms), F.lit(0.0))
    return F.struct(F.round(score, 2).alias("score"), F.concat_ws("|", *[F.when(cond, name) for cond, _, name in terms]).alias("reasons"))


# fixed values: how many candidates a gap asks for, and the caps by source and date, by the gap's size
OVERSAMPLE = ((20, 2.0), (50, 1.5), (None, 1.3))
CAPS = ((50, 3, 2), (80, 7, 4), (None, 10, 5))


def gap_sample(rows: DataFrame, gaps: dict[str, int], keywords: dict[str, Sequence[str]], text: str, score: str, key: str, source: str, date: str, seed: str) -> DataFrame:
    """Candidates for labels that are short of ``gaps`` examples, as (rows, target_l1).

    A label's candidates are the rows with one of its keywords, in whatever case, and, if those are
    fewer than three times the gap, others in hash order up to that number; without keywords, five
    times the gap in hash order. The best-scored are taken until the gap is oversampled, no more of
    one source and of one date than the caps; blank ones have none. Of a source and date the best few
    rows are enough for that walk, so only they meet in its task. A row may serve several labels.
    """
    made = []
    for label, gap in sorted(gaps.items(), key=lambda x: (-x[1], x[0])):
        words = keywords.get(label, ())
        low = F.lower(F.coalesce(F.col(text), F.lit("")))
        hit = any_term(low, [w.lower() for w in words]) if words else F.lit(False)
        base = rows.withColumn("_hit", hit)
        n_hits = base.agg(F.count_if("_hit").alias("_hits"))
        others = base.where(~F.col("_hit")).orderBy(sample_rank(f"{seed}:{label}", F.col(key)), key).limit((3 if words else 5) * gap)
        others = others.withColumn("_i", F.row_number().over(W.orderBy(sample_rank(f"{seed}:{label}", F.col(key)), key)))  # a few times the gap
        others = others.crossJoin(F.broadcast(n_hits)).where(F.col("_i") <= (3 if words else 5) * gap - F.col("_hits")).drop("_i", "_hits")  # one row
        found = base.where("_hit").unionByName(others).drop("_hit").withColumn("target_l1", F.lit(label))
        target = int(gap * next(f for upto, f in OVERSAMPLE if upto is None or gap <= upto))
        of_source, of_date = next((s, d) for upto, s, d in CAPS if upto is None or gap <= upto)
        blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
        cap = F.when(blank(source) & blank(date), target).when(blank(source), of_date).when(blank(date), of_source).otherwise(min(of_source, of_date))
        w = W.partitionBy(F.coalesce(F.col(source).cast("string"), F.lit("")), F.coalesce(F.col(date).cast("string"), F.lit(""))).orderBy(F.desc(score), key)
        found = found.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= cap).drop("_i")
        made.append(greedy_capped(found, "target_l1", score, key, {source: of_source, date: of_date}, target))
    return reduce(DataFrame.unionByName, made)


def top_share(rows: DataFrame, score: str, share: float = 0.3) -> DataFrame:
    """rows with ``top``: whether the score reaches that of rank int(n * (1 - share)) from below. Equal
    scores are counted together first, so the ranks are taken over distinct scores only."""
    counts = rows.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(W.orderBy(score))).withColumn("all", F.sum("n").over(W.partitionBy()))
    bound = upto.where(F.col("upto") > F.floor(F.col("all") * (1 - share))).agg(F.min(score).alias("_bound"))
    return rows.crossJoin(F.broadcast(bound)).withColumn("top", F.coalesce(F.col(score) >= F.col("_bound"), F.lit(False))).drop("_bound")  # one row
