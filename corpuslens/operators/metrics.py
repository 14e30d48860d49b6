"""Label analytics on long frames: confusion, precision and recall, drift, co-occurrence, tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def value_counts(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, share); the total comes from the counts, not from the rows."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def confusion(rows: DataFrame, true: str, pred: str) -> DataFrame:
    """(true, pred, n) over the square of all labels, zeros included; rows with a blank on either side
    take no part."""
    own = rows.select(F.trim(F.col(true).cast("string")).alias("true"), F.trim(F.col(pred).cast("string")).alias("pred")).where((F.col("true") != "") & (F.col("pred") != ""))
    cells = own.groupBy("true", "pred").agg(F.count("*").alias("n"))
    labels = cells.select(F.col("true").alias("l")).union(cells.select("pred")).distinct()
    grid = labels.select(F.col("l").alias("true")).crossJoin(labels.select(F.col("l").alias("pred")))  # label space only
    return grid.join(cells, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def accuracy(cells: DataFrame) -> DataFrame:
    """One row from a confusion frame."""
    return cells.agg(F.sum("n").alias("n"), ratio(F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))


def precision_recall(cells: DataFrame) -> DataFrame:
    """Per label from a confusion frame: precision, recall, f1, support."""
    row = cells.groupBy(F.col("true").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    col = cells.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    p, r = ratio(F.col("hit"), F.col("predicted")), ratio(F.col("hit"), F.col("support"))
    return row.join(col, "label").select("label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def summary_f1(per_label: DataFrame) -> DataFrame:
    return per_label.agg(F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))


def multilabel_cells(rows: DataFrame, ref: str, pred: str) -> DataFrame:
    """(ref, pred, n): rows whose sets hold the pair."""
    pairs = rows.select(F.explode(F.array_distinct(ref)).alias("ref"), pred).select("ref", F.explode(F.array_distinct(pred)).alias("pred"))
    return pairs.groupBy("ref", "pred").agg(F.count("*").alias("n"))


def multilabel_scores(rows: DataFrame, ref: str, pred: str) -> DataFrame:
    """Binary precision, recall and f1 of each label."""
    a = rows.select(F.explode(F.array_distinct(ref)).alias("label")).groupBy("label").agg(F.count("*").alias("support"))
    b = rows.select(F.explode(F.array_distinct(pred)).alias("label")).groupBy("label").agg(F.count("*").alias("predicted"))
    c = rows.select(F.explode(F.array_intersect(ref, pred)).alias("label")).groupBy("label").agg(F.count("*").alias("hit"))
    j = a.join(b, "label", "full").join(c, "label", "left").fillna(0, ["support", "predicted", "hit"])
    p, r = ratio(F.col("hit"), F.col("predicted")), ratio(F.col("hit"), F.col("support"))
    return j.select("label", "support", "predicted", "hit", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def micro_macro(scores: DataFrame) -> DataFrame:
    """One row from ``multilabel_scores``: f1 over all labels' counts together, and their mean f1."""
    p, r = ratio(F.sum("hit"), F.sum("predicted")), ratio(F.sum("hit"), F.sum("support"))
    return scores.agg(p.alias("micro_p"), r.alias("micro_r"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1")).select(ratio(2 * F.col("micro_p") * F.col("micro_r"), F.col("micro_p") + F.col("micro_r")).alias("micro_f1"), "macro_f1")


def prediction_distribution(cells: DataFrame, by_count: bool = False) -> DataFrame:
    """(true, distribution) from pair counts (true, pred, n): "label:n, ..." in the labels' order, or the
    most frequent first."""
    item = F.struct((-F.col("n")).alias("o"), "pred", "n") if by_count else F.struct("pred", "n")
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(x["pred"], F.lit(":"), x["n"].cast("string")))
    return cells.where("n > 0").groupBy("true").agg(F.array_join(listed, ", ").alias("distribution"))


def drift(a: DataFrame, b: DataFrame, label: str, flag_pp: float = 10.0) -> DataFrame:
    """Shares of two samples over the union of labels, their difference in points, and a flag."""
    x = value_counts(a, label).select(label, F.col("n").alias("n_a"), F.col("share").alias("share_a"))
    y = value_counts(b, label).select(label, F.col("n").alias("n_b"), F.col("share").alias("share_b"))
    j = x.join(y, label, "full").fillna(0)
    diff = (F.col("share_a") - F.col("share_b")) * 100
    return j.withColumn("diff_pp", diff).withColumn("flag", F.abs(diff) > flag_pp)


def chi_square(cells: DataFrame, row: str, col: str, n: str = "n", yates: bool = False) -> DataFrame:
    """(chi2, dof, n, cramers_v) of a long contingency frame; columns without any count are left out.
    With yates, a table of one degree of freedom is corrected for continuity."""
    c = cells.groupBy(F.col(row).alias("_row"), F.col(col).alias("_col")).agg(F.sum(n).alias("_o"))
    r = c.groupBy("_row").agg(F.sum("_o").alias("_r"))
    k = c.groupBy("_col").agg(F.sum("_o").alias("_k")).where("_k > 0")
    t = c.agg(F.sum("_o").alias("_t"))
    full = r.crossJoin(k).crossJoin(t).join(c, ["_row", "_col"], "left").fillna(0, ["_o"])  # label space only
    e = F.col("_r") * F.col("_k") / F.col("_t")
    d = F.abs(F.col("_o") - e)
    less = d - F.least(F.lit(0.5), d)
    out = full.agg(F.sum(d * d / e).alias("plain"), F.sum(less * less / e).alias("less"), F.count_distinct("_row").alias("nr"), F.count_distinct("_col").alias("nc"), F.max("_t").alias("n"))
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    chi2 = F.when(F.lit(yates) & (dof == 1), F.col("less")).otherwise(F.col("plain"))
    low = F.least("nr", "nc") - 1
    return out.select(chi2.alias("chi2"), dof.alias("dof"), "n", F.when(low > 0, F.sqrt(chi2 / (F.col("n") * low))).alias("cramers_v"))


def cooccurrence(rows: DataFrame, labels: str, diagonal: bool = False, known: Sequence[str] | None = None) -> DataFrame:
    """(a, b, n), symmetric, of labels in one row's set; with the diagonal, a label with itself: its
    rows. known restricts the labels."""
    own = F.array_distinct(labels)
    one = rows.select((F.filter(own, lambda x: x.isin(*known)) if known is not None else own).alias("l"))
    pairs = one.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b"))
    return (pairs if diagonal else pairs.where("a <> b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def slice_flags(rows: DataFrame, dims: Sequence[str], label: str, min_n: int = 20, dominance: float = 0.75) -> DataFrame:
    """Per value of each dimension: size, top label and its share, flagged if it dominates."""
    tall = rows.select(label, F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])).alias("s")).select(label, "s.dim", "s.value")
    n = tall.groupBy("dim", "value", label).agg(F.count("*").alias("c"))
    top = n.groupBy("dim", "value").agg(F.sum("c").alias("n"), F.max(F.struct("c", label)).alias("t")).where(F.col("n") >= min_n)
    share = F.col("t.c") / F.col("n")
    return top.select("dim", "value", "n", F.col(f"t.{label}").alias("top_label"), share.alias("top_share"), (share >= dominance).alias("dominant"))


def prevalence_grid(rows: DataFrame, group: str, labels: str, label_space: DataFrame) -> DataFrame:
    """Share of each group's rows with a non-empty set that hold each label, zeros included."""
    own = rows.where(F.size(labels) > 0)
    base = own.groupBy(group).agg(F.count("*").alias("n"))
    hits = own.select(group, F.explode(F.array_distinct(labels)).alias("label")).groupBy(group, "label").agg(F.count("*").alias("hits"))
    grid = base.crossJoin(label_space.select("label"))  # label space only
    return grid.join(hits, [group, "label"], "left").select(group, "label", "n", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("prevalence"))


def label_gaps(rows: DataFrame, label: str, label_space: DataFrame, target: int) -> DataFrame:
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    j = label_space.select("label").join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
    return j.withColumn("gap", F.greatest(F.lit(0), F.lit(target) - F.col("n"))).where("gap > 0")


def error_reasons(confidence: Column, note: Column, l1_true: Column, l1_pred: Column, l2_true: Column, l2_pred: Column) -> Column:
    tags = F.array_compact(
        F.array(
            F.when(confidence == "low", "Low_Conf"), F.when(F.coalesce(F.trim(note), F.lit("")) != "", "Has_Note"),
            F.when(F.coalesce(l1_true, F.lit("nan")) != F.coalesce(l1_pred, F.lit("nan")), "Wrong_L1"),
            F.when((F.size(l2_true) > 0) & (F.size(F.array_intersect(l2_true, l2_pred)) == 0), "L2_No_Overlap"),
        )
    )
    return F.when(F.size(tags) > 0, F.array_join(tags, "|")).otherwise("Other")


def empty_warning(corpus: Column, validation: Column) -> Column:
    """high or low if the share of empty sets strays from the validation's."""
    return F.when((corpus > 0.30) & (corpus > validation + 0.10), "high").when((corpus < 0.10) & (corpus < validation - 0.08), "low").otherwise("ok")


def wide_shares(rows: DataFrame, group: str, label: str, groups: dict[str, str], label_space: DataFrame) -> DataFrame:
    """A row a label of the space: for each group (value: short name) n_ and pct_within_, in per cent of
    the group's rows, and n_total over them."""
    totals = rows.agg(*[F.count_if(F.col(group) == g).alias(f"_t_{s}") for g, s in groups.items()])
    counts = rows.groupBy(F.col(label).alias("label")).agg(*[F.count_if(F.col(group) == g).alias(f"n_{s}") for g, s in groups.items()])
    grid = label_space.select("label").join(counts, "label", "left").fillna(0).crossJoin(F.broadcast(totals))  # one row
    pct = [F.bround(100 * ratio(F.col(f"n_{s}"), F.col(f"_t_{s}")), 1).alias(f"pct_within_{s}") for s in groups.values()]
    return grid.select("label", *[f"n_{s}" for s in groups.values()], *pct, sum((F.col(f"n_{s}") for s in groups.values()), F.lit(0)).alias("n_total"))


def share_matrix(rows: DataFrame, group: str, label: str, label_space: DataFrame) -> DataFrame:
    """(group, label, share) of each group's rows over the whole label space, zeros included."""
    base = rows.groupBy(group).agg(F.count("*").alias("n"))
    hits = rows.groupBy(group, F.col(label).alias("label")).agg(F.count("*").alias("hits"))
    grid = base.crossJoin(label_space.select("label"))  # label space only
    return grid.join(hits, [group, "label"], "left").select(group, "label", ratio(F.coalesce("hits", F.lit(0)), F.col("n")).alias("share"))


def joint_wide(rows: DataFrame, l1: str, l2: str, l1_space: DataFrame, l2_order: Sequence[str]) -> DataFrame:
    """A row a first label of the space: its rows, and of each second label the share of them in per cent."""
    counts = rows.groupBy(F.col(l1).alias("label")).agg(F.count("*").alias("n"), *[F.count_if(F.array_contains(l2, x)).alias(f"_{i}") for i, x in enumerate(l2_order)])
    grid = l1_space.select("label").join(counts, "label", "left").fillna(0)
    return grid.select("label", "n", *[F.bround(100 * ratio(F.col(f"_{i}"), F.col("n")), 1).alias(x) for i, x in enumerate(l2_order)])


def trend_wide(rows: DataFrame, period: str, label: str, label_order: Sequence[str]) -> DataFrame:
    """A row a period: the share of each label among its rows, 0 where it has none."""
    return rows.groupBy(period).agg(*[F.avg((F.col(label) == x).cast("double")).alias(x) for x in label_order])


def trend_long(rows: DataFrame, period: str, labels: str) -> DataFrame:
    """(period, label, n, prevalence) of labels in arrays, over the period's rows."""
    base = rows.groupBy(period).agg(F.count("*").alias("rows"))
    hits = rows.select(period, F.explode(labels).alias("label")).groupBy(period, "label").agg(F.count("*").alias("n"))
    return hits.join(base, period).select(period, "label", "n", (F.col("n") / F.col("rows")).alias("prevalence"))


def unit_report(units: DataFrame, speakers: Column, procedural: Column) -> DataFrame:
    """One row: units, shares by role, with speakers and procedural ones."""
    return units.agg(F.count("*").alias("n_units"), *[F.avg((F.col("role") == r).cast("double")).alias(f"share_{r}") for r in ("quote", "claim", "context")], F.avg(speakers.cast("double")).alias("share_speaker"), F.avg(procedural.cast("double")).alias("share_procedural"))


def addition_rate(added: Column, of: Column) -> Column:
    return ratio(added, of)
