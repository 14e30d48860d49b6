"""Corpus pipeline: language, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``. Null texts have
no language and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate, jaccard_join, langid, packing, repeats
from corpuslens.llm.common import row_keys, scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SCORE = 0.5  # share of the text's windows' probability that the predicted language needs
MIN_WORDS = 51  # of a repeated passage


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages learned from the labelled ones; ``und`` and texts
    whose best language has a score below MIN_SCORE go."""
    net, classes = langid.train_language_model(docs)
    found = langid.identify_language(docs, net, classes, extra=["text", "lang", "source", "n_chars"])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles with Jaccard 0.8 or more: the one
    with the group's smallest doc_id. Rows without a doc_id and rows that share theirs are told apart
    (``row_keys``) and come after all others; a text without a word is alone and stays."""
    keyed = row_keys(docs.select(*COLUMNS))
    found = jaccard_join.jaccard_components(keyed.select(F.col("row_key").alias("doc_id"), "text"), k=5, percent=80)
    copies = found.where("component_id <> doc_id").select(F.col("doc_id").alias("copy"))
    return keyed.join(copies, keyed["row_key"] == copies["copy"], "left_anti").select(*COLUMNS)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes runs of MIN_WORDS words that start anywhere else too, whatever white space or case they
    have, and the white space between removed words; texts without a word, or left without one, go. A row per other row, whatever its doc_id;
    n_chars is that of the text that is left."""
    spans = repeats.repeated_word_spans(docs, MIN_WORDS)
    cut = repeats.cut_repeats(docs, spans, unit=repeats.WORDS, extra=["lang", "source"]).withColumnRenamed("kept", "text")
    cut = cut.where(F.translate("text", " \t\n\x0b\x0c\r", "") != "")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item: 0.8 or more of its five-word shingles. Rows
    without a doc_id are searched too."""
    keyed = row_keys(docs.select(*COLUMNS))
    kept = decontaminate.decontaminate(keyed.withColumnsRenamed({"doc_id": "given_id", "row_key": "doc_id"}), table(spark, sf_dir, "benchmark"))
    return kept.drop("doc_id").withColumnRenamed("given_id", "doc_id").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", repeated_passage_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name, [docs])
    return STAGES[-1][1](spark, docs, sf_dir)
