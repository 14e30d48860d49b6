"""The operators bound to the test tables: QUERIES and, where SQL expresses them, ORACLE_SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_text, jaccard_join, langid, line_quality, lm_score, packing, pu_quality, repeats
from .common import table


def _fold(of: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality_rules(table(spark, sf_dir, "documents")).drop("text")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"), _fold(5) == 1)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(_fold(4) == 2, F.lit(False))
    net, classes = langid.train_language_model(docs.where(~held))
    return langid.identify_language(docs, net, classes).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(_fold(5) == 0, F.lit(False))
    net = pu_quality.train_quality_model(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    return pu_quality.score_quality(docs, net).withColumn("held_out", held).select("doc_id", "held_out", "score", "predicted")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{odd}'), (-7L, 1L, 'assistant', '{odd}') AS t(conv_id, turn, role, text)")
    order = F.row_number().over(chat.Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    nodes = rows.unionByName(extra).withColumn("node_id", order)
    nodes = nodes.select(F.col("conv_id").alias("tree_id"), "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), F.lit(0.0).alias("score"), "role", "text")
    back = chat.read_back(chat.format_paths(nodes))
    loss = F.array_join("loss", "")
    return back.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")
    return found.withColumn("repeats", F.col("n_removed") > 0)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_lm_scoring, op3_html_extraction, op4_best_two_fit, op5_language_id, op6_quality_classifier, op7_chat_formatting, op8_suffix_array_dedup, op9_decontamination, op10_jaccard_join)
}

ORACLE_SQL: dict[str, str] = {
    "op7_chat_formatting": """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '|', '&#124;') AS er,
    replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '&#124;', '&amp;#124;') AS et FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(er) + length(et) + 12) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op9_decontamination": """
WITH d AS (SELECT doc_id, list_filter(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_filter(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b),
n AS (SELECT item_id, count(*) AS n_item_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_item_shingles, count(*) AS n_shared, count(*) / CAST(n_item_shingles AS DOUBLE) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item_shingles
HAVING 100 * count(*) >= 80 * n_item_shingles
""",
}
