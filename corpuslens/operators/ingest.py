"""Raw documents to documents with keys, dates and clean texts, and on to units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import segment
from .order import flag_duplicates, link_context

# fixed values: names that stand for a column, and the columns a document has
ALIASES = {"pub_time": "date", "pubDate": "date", "publish_time": "date", "Tweet Date": "date", "正文": "content", "text": "content", "body": "content", "Tweet Content": "content", "链接": "url", "link": "url"}
REQUIRED = ("doc_id", "source", "date", "title", "content", "url")


def normalize_columns(df: DataFrame, aliases: dict[str, str] = ALIASES, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Columns under their own names, missing ones empty, with date_std and date_parse_ok.

    An alias is used where the column itself is absent, the first one that is there. Only if every
    doc_id is blank do all rows get one from source, url, title and the content's beginning (the
    source as it is given, so the key begins with _ where that is blank).
    """
    for alias, name in aliases.items():
        if alias in df.columns and name not in df.columns:
            df = df.withColumnRenamed(alias, name)
    absent = [c for c in required if c not in df.columns]
    df = df.withColumns({c: F.lit("") for c in absent}) if absent else df
    df = df.withColumn("date_std", T.parse_date(F.col("date"))).withColumn("date_parse_ok", F.col("date_std").isNotNull())
    key = T.surrogate_key(F.col("source"), F.col("url"), F.col("title"), F.col("content"))
    if "doc_id" in absent:
        return df.withColumn("doc_id", key)
    blank = df.agg(F.coalesce(F.bool_and(F.coalesce(F.col("doc_id").cast("string") == "", F.lit(False))), F.lit(False)).alias("_no_ids"))
    return df.crossJoin(F.broadcast(blank)).withColumn("doc_id", F.when(F.col("_no_ids"), key).otherwise(F.col("doc_id").cast("string"))).drop("_no_ids")  # one row


def default_source(df: DataFrame, name: Column | str) -> DataFrame:
    """A blank source becomes the file's name."""
    return df.withColumn("source", F.when(F.col("source") == "", name).otherwise(F.col("source")))


def dual_text(df: DataFrame, content: str = "content", promo: Sequence[str] = ()) -> DataFrame:
    """content_orig, content_clean, content_norm (NFKC of the clean text) and clean_meta."""
    clean = T.light_clean(F.col(content), promo)
    df = df.withColumn("content_orig", F.coalesce(F.col(content), F.lit(""))).withColumn("_clean", clean).withColumn("content_clean", F.col("_clean.text"))
    meta = F.struct(*[F.col(f"_clean.{c}").alias(c) for c in ("url_removed", "html_removed", "promo_trim", "space_norm")])
    return df.withColumn("clean_meta", meta).withColumn("content_norm", segment.nfkc(F.col("content_clean"))).drop("_clean")


def enrich_units(units: DataFrame, text: str, actors: dict[str, str], categories: dict[str, str], procedural: Sequence[str], phases: Sequence[tuple[str, Sequence[str]]], quote: str, claim: str) -> DataFrame:
    """role, speakers (name, party), targets (term|category), proc_symbolic_flag, event_phase and unit_hash."""
    c = F.col(text)
    people = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("party")) for n, p in actors.items()])
    things = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).alias("c")) for t, k in categories.items()])
    return units.withColumns(
        {
            "role": T.unit_role(c, quote, claim),
            "speakers": F.filter(people, lambda x: F.contains(c, x["name"])),
            "targets": F.transform(F.filter(things, lambda x: F.contains(c, x["t"])), lambda x: F.concat_ws("|", x["t"], x["c"])),
            "proc_symbolic_flag": T.any_term(c, procedural),
            "event_phase": T.event_phase(c, phases),
            "unit_hash": F.md5(c.cast("binary")),
        }
    )


def documents_to_units(docs: DataFrame, order: str = "doc_id", min_chars: int = 10, **lexicon) -> tuple[DataFrame, DataFrame]:
    """(documents with doc_hash and doc_dup_flag, their units with context, roles and unit_dup_flag)
    from the output of ``dual_text``. Documents whose normalised text has under min_chars give none."""
    docs = flag_duplicates(docs.withColumn("doc_hash", F.md5(F.col("content_norm").cast("binary"))), F.col("doc_hash"), order).withColumnRenamed("dup_flag", "doc_dup_flag")
    long = docs.where(F.length(T.strip(F.col("content_norm"))) >= min_chars)
    units = segment.to_units(long, "doc_id", F.col("content_norm"))
    units = link_context(units, "doc_id", "idx", "sentence").join(docs.select("doc_id", "source", F.coalesce(F.col("date_std").cast("string"), F.col("date").cast("string")).alias("date")), "doc_id")
    units = enrich_units(units, "sentence", **lexicon)
    return docs, flag_duplicates(units, F.col("unit_hash"), "unit_id").withColumnRenamed("dup_flag", "unit_dup_flag")


def derived_columns(df: DataFrame, candidates, parties, source_types, blobs: Sequence[str] = ("source", "_source_file", "source_file")) -> DataFrame:
    """candidate, party, source_type, date and _period, each only where it is missing: candidate and
    party from the first of the blob columns that is there, source_type from _source_file."""
    if "candidate" not in df.columns:
        blob = next((F.col(c).cast("string") for c in blobs if c in df.columns), F.lit(""))
        df = df.withColumn("candidate", T.substring_label(blob, candidates, "Unknown"))
        df = df.withColumn("party", T.ordered_rules([(F.col("candidate") == c, p) for c, p in parties], "Unknown"))
    if "party" not in df.columns:
        df = df.withColumn("party", F.lit("Unknown"))
    if "source_type" not in df.columns:
        kind = T.substring_label(F.col("_source_file").cast("string"), source_types, "news") if "_source_file" in df.columns else F.lit("unknown")
        df = df.withColumn("source_type", kind)
    if "date" not in df.columns:
        df = df.withColumn("date", F.lit(""))
    return df.withColumn("_period", T.period(T.parse_date(F.col("date"))))


def format_candidates(rows: DataFrame, order: Sequence[str], candidates, parties, source_types, optional: Sequence[str] = ("role", "prev", "next", "speakers", "targets", "proc_symbolic_flag", "event_phase", "target_l1", "sample_score", "score_reasons", "unit_id", "source")) -> DataFrame:
    """Annotation candidates in their columns' order; id is the unit's, or else the row's number."""
    from .order import numbered

    rows = rows.withColumn("id", F.col("unit_id")) if "unit_id" in rows.columns else numbered(rows, order, "id")
    if "source_type" not in rows.columns:
        rows = rows.withColumn("source_type", T.substring_label(F.col("source"), source_types, "news"))
    if "candidate" not in rows.columns or "party" not in rows.columns:
        rows = derived_columns(rows.drop("candidate", "party"), candidates, parties, source_types, ("source",)).drop("_period")
    rows = rows if "date" in rows.columns else rows.withColumn("date", F.lit(""))
    return rows.select("id", "candidate", "party", "source_type", "date", "sentence", *[c for c in optional if c in rows.columns])
