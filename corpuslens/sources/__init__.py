"""Scans at the edges: CSV in several encodings, JSON lines, transcripts, guides, answers, run pointers."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import substring_label
from ..operators.order import sessions

# fixed values: encodings in the order of trial, and marks that no speaker's name has
ENCODINGS = ("utf-8-sig", "gbk", "gb2312", "gb18030", "big5")
MARKS = "[。！？，]"
UNIT = (
    "doc_id string, unit_id string, text string, role string, prev string, next string, speakers array<struct<name:string,party:string>>, targets array<string>, "
    "proc_symbolic_flag boolean, event_phase string, unit_hash string, unit_dup_flag boolean, source_meta struct<source:string,date:string>"
)


def _decode(raw: bytes, encodings: Sequence[str]) -> str | None:
    for e in encodings:
        try:
            return raw.decode(e)
        except UnicodeDecodeError:
            continue
    return None


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def read_csv_multi(spark: SparkSession, path: str, columns: Sequence[str] | None = None, encodings: Sequence[str] = ENCODINGS, glob: str = "*.csv", rows: int = 10_000) -> DataFrame:
    """(columns..., source_path), all strings, of CSV files with headers: each file by the first encoding
    that decodes it. Without ``columns`` those of one file's header are taken. Columns that a file lacks
    are null there. A file is one value of a scan, so it has to fit a task; ``undecodable`` lists the
    files that give no rows."""
    if columns is None:
        first = _files(spark, path, glob).orderBy("path").limit(1).collect()
        text = (_decode(bytes(first[0]["content"]), encodings) if first else None) or ""
        columns = [c.replace("\ufeff", "").strip() for c in next(csv.reader(io.StringIO(text)), [])]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, raw in zip(batch["path"], batch["content"], strict=True):
                reader = csv.reader(io.StringIO(_decode(bytes(raw), encodings) or "", newline=""))
                names = [c.replace("\ufeff", "").strip() for c in next(reader, [])]
                made: list[dict] = []
                for line in reader:
                    made.append({**dict(zip(names, line, strict=False)), "source_path": source})
                    if len(made) == rows:
                        yield pd.DataFrame(made).reindex(columns=[*columns, "source_path"]).astype(object).where(lambda x: x.notna(), None)
                        made = []
                if made:
                    yield pd.DataFrame(made).reindex(columns=[*columns, "source_path"]).astype(object).where(lambda x: x.notna(), None)

    shape = ", ".join(f"`{c}` string" for c in [*columns, "source_path"])
    return _files(spark, path, glob).mapInPandas(parse, shape)


def undecodable(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS, glob: str = "*.csv") -> DataFrame:
    """(path) of the files that no encoding decodes."""

    @F.pandas_udf("boolean")
    def fails(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: _decode(bytes(b), encodings) is None)

    return _files(spark, path, glob).where(fails("content")).select("path")


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, glob: str = "*.csv") -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes, by a schema or as it is inferred."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", "true").csv(path)


def read_strings(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """CSV as strings without nulls; BOM and spaces are stripped from headers."""
    df = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("recursiveFileLookup", "true").option("pathGlobFilter", glob).csv(path)
    named = df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])
    return named.fillna("")


def read_optional(spark: SparkSession, path: str | None, need: Sequence[str] = ()) -> tuple[DataFrame | None, list[str]]:
    """(a CSV table as strings or None where there is none, the needed columns that it lacks)."""
    if not path:
        return None, []
    try:
        df = read_strings(spark, path)
    except AnalysisException:
        return None, []
    return df, [c for c in need if c not in df.columns]


def read_guides(spark: SparkSession, paths: dict[str, str | None], need: dict[str, Sequence[str]]) -> tuple[dict[str, DataFrame], list[str]]:
    """(guides by name: codebooks, examples, case pools; notes on what is missing). A pool that lacks a
    column is left out, any other table stays."""
    found, notes = {}, []
    for name, path in paths.items():
        df, lacks = read_optional(spark, path, need.get(name, ()))
        if lacks:
            notes.append(f"{name}: missing columns {', '.join(lacks)}")
        if df is None:
            notes.append(f"{name}: none")
        elif not (lacks and name.endswith("pool")):
            found[name] = df
    return found, notes


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """Units from nested JSON lines, flat: text as sentence, source and date beside it, lists as JSON."""
    rows = spark.read.schema(UNIT).json(path)
    return rows.select("doc_id", "unit_id", F.col("text").alias("sentence"), "role", "prev", "next", F.to_json("speakers").alias("speakers"), F.to_json("targets").alias("targets"), "proc_symbolic_flag", "event_phase", "unit_hash", "unit_dup_flag", "source_meta.source", "source_meta.date")


def tag_source(df: DataFrame) -> DataFrame:
    """source_file and source_path from the file metadata of a scan."""
    return df.withColumn("source_file", F.col("_metadata.file_name")).withColumn("source_path", F.col("_metadata.file_path"))


def main_files(df: DataFrame, file: str = "source_file", ends: str = "_units.csv", without: Sequence[str] = ("_CONTEXT", "_DROPPED")) -> DataFrame:
    """Rows of main files: their names end as given and hold none of the marks of side files."""
    rows = df.where(F.col(file).endswith(ends))
    for mark in without:
        rows = rows.where(~F.contains(F.col(file), F.lit(mark)))
    return rows


def by_file_name(df: DataFrame, source_type: str, names: Sequence[tuple[Sequence[str], str]], parties: Sequence[tuple[str, str]], file: str = "source_file", date: Column | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rows of files whose names tell the candidate, with candidate, party and source_type; other files'
    rows go. date replaces the rows' own; aliases give columns that are missing."""
    for have, want in (aliases or {}).items():
        if have in df.columns and want not in df.columns:
            df = df.withColumn(want, F.col(have))
    candidate = substring_label(F.col(file), names, F.lit(None).cast("string"))
    party = F.when(F.col("candidate") == parties[0][0], parties[0][1])
    for c, p in parties[1:]:
        party = party.when(F.col("candidate") == c, p)
    df = df.withColumn("candidate", candidate).where("candidate IS NOT NULL").withColumn("party", party).withColumn("source_type", F.lit(source_type))
    return df if date is None else df.withColumn("date", date)


def tier(path: Column, rules: Sequence[tuple[str, int]], otherwise: int = 0) -> Column:
    """Corpus tier by the first part of a path that matches."""
    out = None
    for part, value in rules:
        hit = F.contains(F.lower(path), F.lit(part))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(otherwise)


def read_transcripts(spark: SparkSession, path: str, max_header: int = 20, marks: str = MARKS) -> DataFrame:
    """(path, session, speaker, content): a short line without marks opens a speaker's turn."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line"))
    return sessions(lines, "path", "pos", "line", (F.length("line") < max_header) & ~F.col("line").rlike(marks)).where("n_lines > 0")


def union_named(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_responses(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(custom_id, content, error) of response lines. Several paths are batches in their order: of one id
    the latest batch's line counts, of one path the last file's."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = union_named([spark.read.text(p).select("value", F.struct(F.lit(i).alias("batch"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("line")).alias("at")) for i, p in enumerate(paths)])
    content = F.get_json_object("value", "$.response.body.choices[0].message.content")
    rows = raw.select(F.coalesce(F.get_json_object("value", "$.custom_id"), F.lit("unknown")).alias("custom_id"), F.struct(content.alias("content"), F.get_json_object("value", "$").isNull().alias("broken")).alias("r"), "at")
    last = rows.groupBy("custom_id").agg(F.max_by("r", "at").alias("r")).select("custom_id", "r.content", "r.broken")
    bad = F.when(F.col("broken"), "JSON Parse Error").when(F.coalesce(F.trim("content"), F.lit("")) == "", "Empty content").when(F.get_json_object("content", "$").isNull(), "JSON Parse Error")
    return last.select("custom_id", F.when(bad.isNull(), F.col("content")).alias("content"), bad.alias("error"))


def read_memo(spark: SparkSession, path: str) -> DataFrame:
    """(key, margin, status, at) of remembered answers, broken lines left out; a later line of a file has a
    greater ``at``. None yet: no rows."""
    shape = "key string, margin double, status string"
    try:
        rows = spark.read.schema(shape).option("mode", "PERMISSIVE").json(path)
    except AnalysisException:
        return spark.createDataFrame([], shape + ", at long")
    return rows.where("key IS NOT NULL AND status IS NOT NULL").withColumn("at", F.monotonically_increasing_id())


def land_pages(spark: SparkSession, fetch: Callable[[str | None], tuple[list[str], str | None]], path: str, schema: str) -> DataFrame:
    """Rows of a listing that comes in pages: fetch(cursor) gives a page's JSON lines and the next cursor,
    None at the end. Each page is written as it comes, and the whole read back."""
    cursor: str | None = None
    while True:
        lines, cursor = fetch(cursor)
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)
        if cursor is None:
            return spark.read.schema(schema).json(path)


def resolve_run(spark: SparkSession, base: str, pointers: Sequence[str], results: Sequence[str]) -> str | None:
    """The first results file that exists in a folder that one of the pointer files names, in their
    order, or else in base itself."""

    def exists(path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    folders = []
    for name in pointers:
        if exists(f"{base}/{name}"):
            line = spark.read.text(f"{base}/{name}", wholetext=True).first()["value"].strip()
            folders.append(line if "://" in line or line.startswith("/") else f"{base}/{line}")
    return next((f"{folder}/{r}" for folder in [*folders, base] for r in results if exists(f"{folder}/{r}")), None)


from .sinks import write_by_status, write_requests  # noqa: E402, F401
