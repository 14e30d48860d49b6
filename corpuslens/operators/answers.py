"""Answers of a labelling model: parsing, joining with the rows asked about, error counts, stability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, label_code, strip


def l1_answer(content: Column, error: Column, valid: Sequence[str]) -> Column:
    """struct(label, reasoning, error) of a JSON answer with one label. An error that is given counts
    first; then no answer, then a label outside the codebook (an empty codebook allows all)."""
    raw = strip(F.coalesce(F.get_json_object(content, "$.L1"), F.lit("")))
    code = label_code(raw)
    known = code.isin(*valid) if valid else F.lit(True)
    said = F.coalesce(error, F.get_json_object(content, "$.error"))
    reason = F.when(said.isNotNull() & (said != ""), said).when(content.isNull(), "missing response").when(~known, "invalid L1 code").otherwise("")
    return F.struct(F.when((reason == "") & (code != ""), code).alias("label"), F.get_json_object(content, "$.L1_cot").alias("reasoning"), reason.alias("error"))


def l2_answer(content: Column, error: Column, valid: Sequence[str]) -> Column:
    """struct(labels, reasoning, error, dropped) of a JSON answer with a list of labels, as a cell with
    |. Labels outside the codebook are dropped and counted. No answer is no error: its cell is empty."""
    said = F.coalesce(error, F.get_json_object(content, "$.error"))
    raw = F.get_json_object(content, "$.L2")
    listed = F.from_json(F.when(F.coalesce(raw, F.lit("[]")).startswith("["), F.coalesce(raw, F.lit("[]"))), "array<string>")
    clean = F.filter(F.transform(listed, lambda x: strip(x)), lambda x: x != "")
    kept = F.filter(clean, lambda x: x.isin(*valid)) if valid else clean
    failed = said.isNotNull() & (said != "")
    reason = F.when(failed, said).when(listed.isNull(), "L2 field not a list").otherwise("")
    ok = reason == ""
    return F.struct(F.when(ok, F.array_join(kept, "|")).otherwise("").alias("labels"), F.get_json_object(content, "$.L2_cot").alias("reasoning"), reason.alias("error"), F.when(ok, F.size(clean) - F.size(kept)).otherwise(0).alias("dropped"))


def join_answers(reference: DataFrame, answers: DataFrame, key: str, l1_valid: Sequence[str] | None, l2_valid: Sequence[str] | None) -> DataFrame:
    """reference rows, all of them, with L1_label, L1_reasoning, L1_error and L2_labels, L2_reasoning,
    L2_error, L2_dropped for the layers given. answers(key, content, error) has one row a key."""
    joined = reference.join(answers.select(key, F.col("content").alias("_content"), F.col("error").alias("_error")), key, "left")
    if l1_valid is not None:
        a = l1_answer(F.col("_content"), F.col("_error"), l1_valid)
        joined = joined.withColumn("_a", a).withColumns({"L1_label": F.col("_a.label"), "L1_reasoning": F.col("_a.reasoning"), "L1_error": F.col("_a.error")}).drop("_a")
    if l2_valid is not None:
        a = l2_answer(F.col("_content"), F.col("_error"), l2_valid)
        joined = joined.withColumn("_a", a).withColumns({"L2_labels": F.col("_a.labels"), "L2_reasoning": F.col("_a.reasoning"), "L2_error": F.col("_a.error"), "L2_dropped": F.col("_a.dropped")}).drop("_a")
    return joined.drop("_content", "_error")


def error_counts(rows: DataFrame, error: str) -> DataFrame:
    """(error, n) of the rows that have one."""
    text = strip(F.coalesce(F.col(error), F.lit("")))
    return rows.where(text != "").groupBy(text.alias("error")).agg(F.count("*").alias("n"))


def answer_quality(rows: DataFrame) -> DataFrame:
    """One row of counts over ``join_answers``: rows, valid and failed first labels, empty second ones,
    rows that lost labels and how many they lost."""
    blank = strip(F.coalesce("L2_labels", F.lit(""))) == ""
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_if(F.coalesce("L1_label", F.lit("")) != "").alias("n_l1_valid"), F.count_if(F.coalesce("L1_error", F.lit("")) != "").alias("n_l1_error"),
        F.count_if(blank).alias("n_l2_empty"), F.count_if(F.col("L2_dropped") > 0).alias("n_l2_rows_dropped"), F.coalesce(F.sum("L2_dropped"), F.lit(0)).alias("n_l2_dropped"),
    )


def stability(rows: DataFrame, l1: Sequence[str], l2: Sequence[str], threshold: float = 0.80, l1_low: float = 0.85, l2_low: float = 0.80) -> DataFrame:
    """One row over repeated answers, label columns l1 and label arrays l2, one of each a run: share of
    rows on whose label all runs agree, mean of the least Jaccard of two runs, share of rows where it
    reaches the threshold, and whether a vote over the runs is advised."""
    first, *others = [F.nullif(F.col(c), F.lit("")) for c in l1]
    agree = first.isNotNull()
    for c in others:
        agree = agree & F.coalesce(first == c, F.lit(False))
    pairs = [jaccard(F.col(a), F.col(b)) for i, a in enumerate(l2) for b in l2[i + 1 :]]
    least = F.least(*pairs) if len(pairs) > 1 else pairs[0]
    one = rows.select(agree.alias("agree"), least.alias("j")).agg(
        F.count("*").alias("n"), F.coalesce(F.avg(F.col("agree").cast("double")), F.lit(0.0)).alias("l1_agreement"),
        F.coalesce(F.avg("j"), F.lit(0.0)).alias("l2_mean_min_jaccard"), F.coalesce(F.avg((F.col("j") >= threshold).cast("double")), F.lit(0.0)).alias("l2_share_stable"),
    )
    return one.withColumns({"vote_l1": F.col("l1_agreement") < l1_low, "vote_l2": F.col("l2_share_stable") < l2_low})


def majority(columns: Sequence[Column]) -> Column:
    """The label that most runs gave, the least of several; null where no run gave any."""
    given = F.array_compact(F.array(*columns))
    counted = F.transform(F.array_distinct(given), lambda x: F.struct((-F.size(F.filter(given, lambda y: y == x))).alias("n"), x.alias("x")))
    return F.array_min(counted)["x"]


def with_reference(rows: DataFrame, reference: DataFrame, columns: dict[str, str], order: str, keys: Sequence[str] = ("id", "sentence")) -> DataFrame:
    """rows with the reference's columns under new names, by the first of the keys that both have; the
    reference's first row of a key counts. Without a key, or without any of the columns, rows as they are."""
    key = next((k for k in keys if k in rows.columns and k in reference.columns), None)
    have = {a: b for a, b in columns.items() if a in reference.columns}
    if key is None or not have:
        return rows
    one = reference.groupBy(key).agg(F.min_by(F.struct(*[F.col(a).alias(b) for a, b in have.items()]), order).alias("_ref"))
    return rows.join(one, key, "left").select(*[rows[c] if c != key else F.col(key) for c in rows.columns], *[F.col(f"_ref.{b}").alias(b) for b in have.values()])


def compare_targets(annotated: DataFrame, candidates: DataFrame, order: str, key: str = "id", carry: Sequence[str] = ("target_l1", "sample_score", "score_reasons")) -> DataFrame:
    """Annotated rows with the candidates' target and whether they match; the first row of a key counts
    on either side."""
    first = lambda df, columns: df.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_r")).select(key, *[f"_r.{c}" for c in columns])
    left = first(annotated, [c for c in annotated.columns if c != key])
    right = first(candidates, [c for c in carry if c in candidates.columns])
    return left.join(right, key).withColumn("match", F.coalesce(F.col("target_l1") == F.col("L1_label"), F.lit(False)))


def merge_batches(batches: Sequence[DataFrame], order: str, key: str = "id") -> DataFrame:
    """The rows of several batches, with ``batch`` from 1: of one key the earliest batch's, there the first."""
    rows = None
    for i, b in enumerate(batches, 1):
        b = b.withColumn("batch", F.lit(i))
        rows = b if rows is None else rows.unionByName(b, allowMissingColumns=True)
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct("batch", order)).alias("_r"))
    return best.select(key, *[f"_r.{c}" for c in others])


def annotation_export(corpus: DataFrame, mine: DataFrame, annotator: str, key: str = "id") -> DataFrame:
    """All rows of the corpus with one annotator's labels, blank and not unsure where there are none."""
    own = mine.where(F.col("annotator_id") == annotator).select(F.col("utterance_id").alias("_u"), "l1_label", "l2_labels", "unsure")
    joined = corpus.join(own, F.col(key).cast("string") == F.col("_u"), "left").drop("_u")
    return joined.withColumns({"annotator_id": F.lit(annotator), "your_L1": F.coalesce("l1_label", F.lit("")), "your_L2": F.coalesce("l2_labels", F.lit("")), "unsure": F.coalesce("unsure", F.lit(False))}).drop("l1_label", "l2_labels")
