"""Shared plumbing: table access, scratch tables in the shared folder, Arrow buffers as numpy."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import spread

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; a small one, of fewer splits than cores, is dealt out to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Only a local session, whose executors
    are the driver, gets a folder of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corpuslens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(df: DataFrame, name: str, done: Sequence[DataFrame] = (), codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    The write's shuffle files go when it has ended, and so do the scratch tables ``done``, which
    nothing may read any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpuslens/{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["scratch_path"] = path
    discard(*done)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of scratch tables that nothing reads any more; other frames are left alone."""
    for df in frames:
        path = df.__dict__.pop("scratch_path", None)
        if path:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def join_skewed(rows: DataFrame, keys: DataFrame, on: Sequence[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined (inner, left_semi or left_anti) with keys: a scratch table with one row a key and, in
    ``weight``, how many of the rows have it.

    A key with over an eighth of a shuffle partition's share of the rows is sent to every task, so
    its rows stay where they are; there can be eight such keys a partition at most. The others meet
    by a shuffle.
    """
    total = keys.agg(F.sum(weight).alias("n")).first()["n"] or 0
    most = max(1, int(total) // (8 * shuffle_partitions(rows.sparkSession)))
    heavy, light = keys.where(F.col(weight) > most), keys.where(F.col(weight) <= most)
    rest = rows.join(F.broadcast(heavy.select(*on)), list(on), "left_anti").join(light, list(on), how)
    if how == "left_anti":
        return rest
    return rows.join(F.broadcast(heavy), list(on), how).unionByName(rest)


def row_keys(docs: DataFrame) -> DataFrame:
    """docs with row_key, a distinct long for every row: its doc_id, or for rows without one and for
    rows that share theirs a number of its own beyond all doc_ids. Where such rows exist the table is
    written once, so that the numbers stay."""
    given = docs.groupBy("doc_id").agg(F.count("*").alias("rows"))
    odd = scratch(given.where("doc_id IS NULL OR rows > 1"), "odd_ids")
    if odd.isEmpty():
        return docs.withColumn("row_key", F.col("doc_id"))
    odd_rows = F.col("doc_id").isNull() | F.col("odd_id").isNotNull()
    marked = docs.join(odd.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("odd_id")), F.col("doc_id") == F.col("odd_id"), "left")
    kept = scratch(marked.withColumn("is_odd", odd_rows).drop("odd_id").withColumn("place", F.monotonically_increasing_id()), "numbered", [odd])
    # a task's rows are numbered from place % 2 ** 33 on; one row a task comes to the driver
    task = F.shiftright("place", 33)
    ends = kept.where("is_odd").groupBy(task.alias("task")).agg(F.max(F.col("place").bitwiseAND((1 << 33) - 1)).alias("last")).orderBy("task").collect()
    bounds = kept.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = bounds["low"] or 0, bounds["high"] or 0
    starts, at = [], 0
    for r in ends:
        starts.append((r["task"], at))
        at += r["last"] + 1
    first = docs.sparkSession.createDataFrame(starts, "task long, first long")
    number = F.col("first") + F.col("place").bitwiseAND((1 << 33) - 1)
    key = F.lit(high) + 1 + number if high + 1 + at < 1 << 63 else F.lit(low) - 1 - number
    keyed = kept.withColumn("task", task).join(F.broadcast(first), "task", "left")
    return keyed.withColumn("row_key", F.when(F.col("is_odd"), key).otherwise(F.col("doc_id"))).select(*docs.columns, "row_key")


def trim() -> None:
    """Give freed memory back to the machine."""
    pa.default_memory_pool().release_unused()
    trim_heap = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim_heap:
        trim_heap(0)


def lean(run: Callable) -> Callable:
    """A mapInArrow function that trims when its task ends: the worker lives on, and the room is
    needed by whatever runs next in it or beside it."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column, nulls as empty texts, or the bytes of a binary column
    without nulls; no copy per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (large or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    kind = np.int64 if large else np.int32
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_groups(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def binary_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value a row: the bytes of consecutive runs of ``values``."""
    width = values.dtype.itemsize
    offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64) * width])
    data = np.ascontiguousarray(values).view(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
