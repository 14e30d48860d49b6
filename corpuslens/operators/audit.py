"""Audit of a labelled corpus against a validation set: profiles, flags, gates, tables, reports."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent, strip
from . import metrics as M


def valid_l1(rows: DataFrame, label: str = "L1_label") -> DataFrame:
    """Rows with a first label, trimmed."""
    trimmed = strip(F.coalesce(F.col(label).cast("string"), F.lit("")))
    return rows.withColumn(label, trimmed).where(F.col(label) != "")


def profile(rows: DataFrame, l1: str, l2: str) -> DataFrame:
    """One row over rows with a first label: their number, share of empty second sets, labels a row
    (a label given twice counts twice)."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.size(l2) == 0).cast("double")), F.lit(0.0)).alias("empty_rate"), F.coalesce(F.avg(F.size(l2)), F.lit(0.0)).alias("labels_per_row"))


def row_prevalence(rows: DataFrame, l2: str) -> DataFrame:
    """(label, n, prevalence): occurrences of each second label over the number of rows with a first one."""
    total = rows.agg(F.count("*").alias("_rows"))
    counts = rows.select(F.explode(l2).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("_rows")).alias("prevalence"))  # one row


def chi_square_p(chi2: float | None, dof: int) -> float | None:
    """Upper tail of the chi-square distribution: the regularised incomplete gamma function, by its
    series below the mean and by a continued fraction above."""
    if chi2 is None or dof < 1 or chi2 < 0:
        return None
    a, x = dof / 2, chi2 / 2
    if x == 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def homogeneity(a: DataFrame, b: DataFrame, label: str, n: str = "n") -> DataFrame:
    """Chi-square of two count frames over the union of their labels, as one row (chi2, dof, n, cramers_v,
    note): nulls and a note where fewer than two labels occur. One degree of freedom is corrected."""
    cells = a.select(F.lit("a").alias("r"), label, n).unionByName(b.select(F.lit("b").alias("r"), label, n)).where(F.col(n) > 0)
    both = M.chi_square(cells, "r", label, n, yates=True)
    few = F.col("dof") < 1
    return both.select(F.when(~few, F.col("chi2")).alias("chi2"), "dof", "n", F.when(~few, F.col("cramers_v")).alias("cramers_v"), F.when(few, "fewer than two labels").otherwise("").alias("note"))


def skew_flags(rows: DataFrame, dims: dict[str, str], l1: str, l2: str, min_n: int = 20, dominance: float = 0.75, skew: float = 4.0) -> DataFrame:
    """Per value of each dimension (name: column): rows, top first label and its share, greatest
    prevalence of a second label, and flags: dominant_L1, and skewed_L2_vs_slice_mean where that
    prevalence is over ``skew`` times the mean of the lesser ones. Small slices are left out."""
    slices = F.explode(F.array(*[F.struct(F.lit(d).alias("slice"), F.col(c).cast("string").alias("key")) for d, c in dims.items()]))
    tall = rows.select(slices.alias("s"), F.col(l1).alias("l1"), F.col(l2).alias("l2")).select("s.slice", "s.key", "l1", "l2")
    firsts = tall.groupBy("slice", "key", "l1").agg(F.count("*").alias("c")).groupBy("slice", "key").agg(F.sum("c").alias("n"), F.min(F.struct((-F.col("c")).alias("c"), "l1")).alias("t"))
    firsts = firsts.where(F.col("n") >= min_n)
    seconds = tall.select("slice", "key", F.explode("l2").alias("l2")).groupBy("slice", "key", "l2").agg(F.count("*").alias("c"))
    top = seconds.groupBy("slice", "key").agg(F.max("c").alias("top"), F.collect_list("c").alias("all"))  # a row has the label space's size
    lesser = F.filter("all", lambda c: c < F.col("top"))
    mean = F.aggregate(lesser, F.lit(0.0), lambda s, c: s + c) / F.size(lesser)
    top = top.select(F.col("slice").alias("_s"), F.col("key").alias("_k"), "top", F.when(F.size(lesser) > 0, mean).alias("mean"))
    j = firsts.join(top, (F.col("slice") == F.col("_s")) & F.col("key").eqNullSafe(F.col("_k")), "left")
    share, best = -F.col("t.c") / F.col("n"), F.coalesce(F.col("top") / F.col("n"), F.lit(0.0))
    skewed = F.col("top") / F.col("n") / (F.col("mean") / F.col("n") + 1e-9) > skew
    flags = F.concat_ws("|", F.when(share >= dominance, "dominant_L1"), F.when(skewed, "skewed_L2_vs_slice_mean"))
    return j.select("slice", "key", "n", F.col("t.l1").alias("top_L1"), share.alias("top_L1_share"), best.alias("max_L2_row_prev"), flags.alias("flags"))


def joint_counts(rows: DataFrame, l1: str, l2: str) -> DataFrame:
    return rows.select(F.col(l1).alias("L1"), F.explode(l2).alias("L2")).groupBy("L1", "L2").agg(F.count("*").alias("n"))


def low_prior_pairs(spark, fixed: Sequence[tuple[str, str]], extra: DataFrame | None = None) -> DataFrame:
    """Pairs of labels that should be rare: the fixed ones and those of a table with L1 and L2."""
    pairs = spark.createDataFrame([tuple(p) for p in fixed], "L1 string, L2 string")
    if extra is not None and {"L1", "L2"} <= set(extra.columns):
        pairs = pairs.unionByName(extra.select(strip(F.col("L1")).alias("L1"), strip(F.col("L2")).alias("L2")))
    return pairs


def joint_flags(corpus: DataFrame, validation: DataFrame | None, pairs: DataFrame, min_corpus: int = 20) -> DataFrame:
    """(L1, L2, reason, corpus_n, validation_n) from joint counts. Pairs of low prior are flagged
    whatever their counts, with a null where the validation set lacks one of the labels; others if
    the corpus has min_corpus of them and the validation set none, which then counts 0."""
    c = corpus.select("L1", "L2", F.col("n").alias("corpus_n"))
    given = pairs.distinct().join(c, ["L1", "L2"], "left")
    if validation is None:
        return given.select("L1", "L2", F.lit("theoretical_low_prior").alias("reason"), F.coalesce("corpus_n", F.lit(0)).alias("corpus_n"), F.lit(None).cast("long").alias("validation_n"))
    v = validation.select("L1", "L2", F.col("n").alias("validation_n"))
    known = v.agg(F.collect_set("L1").alias("_l1"), F.collect_set("L2").alias("_l2"))  # the label space
    cell = F.when(F.array_contains("_l1", F.col("L1")) & F.array_contains("_l2", F.col("L2")), F.coalesce("validation_n", F.lit(0)))
    theory = given.join(v, ["L1", "L2"], "left").crossJoin(F.broadcast(known)).select("L1", "L2", F.lit("theoretical_low_prior").alias("reason"), F.coalesce("corpus_n", F.lit(0)).alias("corpus_n"), cell.alias("validation_n"))  # one row
    unseen = c.where(F.col("corpus_n") >= min_corpus).join(v.where("validation_n > 0"), ["L1", "L2"], "left_anti")
    return theory.unionByName(unseen.select("L1", "L2", F.lit("zero_in_validation_high_in_corpus").alias("reason"), "corpus_n", F.lit(0).cast("long").alias("validation_n")))


def cell_samples(rows: DataFrame, flags: DataFrame, l1: str, l2: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each flagged pair of labels, in hash order."""
    from .order import sample_rank, stratified_sample

    tall = rows.withColumn("_l2", F.explode(F.array_distinct(l2)))
    wanted = flags.select(F.col("L1").alias("_a"), F.col("L2").alias("_b")).distinct()
    hit = tall.join(F.broadcast(wanted), (F.col(l1) == F.col("_a")) & (F.col("_l2") == F.col("_b")))
    return stratified_sample(hit, ["_a", "_b"], key, n, seed).orderBy("_a", "_b", sample_rank(seed, F.col(key)))


def gates(over_threshold: Sequence[str], warning: str, anomalies: int, flagged: int, stability: dict[str, float] | None = None, max_anomalies: int = 9999, max_flagged: int = 9999, without_stability: bool = False, force: bool = False) -> dict[str, Any]:
    """Whether the audit passes: no label over the threshold of drift, no warning of empty sets either
    way, no more anomalies and flagged cells than allowed; and whether tables may be made: if it
    passes and the labels are stable (shares of .85 and .80), or that is waived, or all is forced."""
    out: dict[str, Any] = {"over_threshold": list(over_threshold), "warn_high": warning == "high", "warn_low": warning == "low", "anomalies": anomalies, "flagged": flagged, "stable": None}
    out["passed"] = not over_threshold and warning not in ("high", "low") and anomalies <= max_anomalies and flagged <= max_flagged
    if stability is not None:
        out["stable"] = stability.get("l1_agreement", 0) >= 0.85 and stability.get("l2_share_stable", 0) >= 0.80
    out["descriptive_allowed"] = force or (out["passed"] and (out["stable"] is True or without_stability))
    return out


def empty_band(rate: Column, low: float = 0.18, high: float = 0.20) -> Column:
    """Whether a validation set's share of empty sets is outside what is usual."""
    return (rate < low) | (rate > high)


def manuscript_drift(drift: DataFrame, label: str) -> DataFrame:
    """A drift frame's shares and difference in per cent, to one place."""
    return drift.select(label, "n_a", percent(F.col("share_a")).alias("pct_a"), "n_b", percent(F.col("share_b")).alias("pct_b"), F.bround("diff_pp", 1).alias("diff_pp"))


def manuscript_slices(slices: DataFrame) -> DataFrame:
    """Slices for print: without the unknown candidate, shares in per cent."""
    return slices.where(~((F.col("slice") == "candidate") & (F.col("key") == "Unknown"))).select("slice", "key", "n", "top_L1", percent(F.col("top_L1_share")).alias("top_L1_share_pct"), percent(F.col("max_L2_row_prev")).alias("max_L2_row_prev_pct"))


def conditional(rows: DataFrame, true: str, pred: str, ref_l2: str, pred_l2: str) -> tuple[DataFrame, DataFrame]:
    """(confusion of the first labels where both second sets hold something, one row of subset size and
    of the labelled rows left out)."""
    labelled = rows.where((strip(F.coalesce(true, F.lit(""))) != "") & (strip(F.coalesce(pred, F.lit(""))) != ""))
    both = (F.size(ref_l2) > 0) & (F.size(pred_l2) > 0)
    counts = labelled.agg(F.count_if(both).alias("n_subset"), F.count_if(~both).alias("n_excluded"), F.avg(F.when(both, (F.col(true) == F.col(pred)).cast("double"))).alias("accuracy"))
    return M.confusion(labelled.where(both), true, pred), counts


def gap_totals(l1_gaps: DataFrame, l2_gaps: DataFrame, labels_per_row: float | None) -> DataFrame:
    """One row: the gaps' sums and how many rows would fill them, at so many second labels a row."""
    a, b = l1_gaps.agg(F.coalesce(F.sum("gap"), F.lit(0)).alias("l1_gap")), l2_gaps.agg(F.coalesce(F.sum("gap"), F.lit(0)).alias("l2_gap"))
    by_l2 = F.floor(F.col("l2_gap") / F.lit(float(labels_per_row))) if labels_per_row else F.col("l2_gap")
    return a.crossJoin(b).select("l1_gap", "l2_gap", by_l2.alias("by_l2"), F.greatest(F.col("l1_gap"), by_l2).alias("recommended"))  # one row each
