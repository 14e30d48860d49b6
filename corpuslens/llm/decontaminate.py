"""Benchmark decontamination by MinHash containment, partitioned by item size, in DataFrame functions alone.

A text's shingles are ordered by one hash; a MinHash sketch is its smallest ones. An item of n
shingles whose containment in a document reaches the threshold t misses at most n - ceil(t n) of
them, so one of its n - ceil(t n) + 1 smallest must be in the document: sketches of that size, which
depends on the item's size, lose nothing. Items are partitioned by size, a class for each power of
two. A document is looked up only in the classes for which it is large enough, and there only with
its hashes up to the largest in the class's sketches, so short items do not widen the search for
long ones in documents too short for these, nor the other way round. Candidates are verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL = 16 << 20  # bytes that may be broadcast
ROW = 24  # bytes of a row of two or three numbers


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case; none for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), _UPPER + "\t\n\x0b\x0c\r", _UPPER.lower() + "     ")
    return F.filter(F.split(flat, " ", -1), lambda w: w != "")


def word_shingles(w: Column, k: int) -> Column:
    """Distinct k-word shingles as text; fewer words: the whole sequence as one; none: none."""
    n = F.size(w)
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(w, i + x) for x in range(k)]))
    return F.when(n >= k, F.array_distinct(many)).when(n > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))


def shingle_hashes(w: Column, k: int) -> Column:
    """Hashes of the same shingles, not made distinct. w holds hashes of the words."""
    n = F.size(w)
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + x) for x in range(k)]))
    # a short sequence is padded with nulls, which the hash passes over, so its length goes in
    return F.when(n >= k, many).when(n > 0, F.array(F.xxhash64(*[F.get(w, F.lit(x)) for x in range(k)], n))).otherwise(F.array().cast("array<bigint>"))


def _limited(df: DataFrame, size: int) -> DataFrame:
    """df, sent to every task if its measured size allows."""
    return F.broadcast(df) if size <= SMALL else df


def _up_to(size: Column, classes: list) -> Column:
    """The largest hash by which a document of that many shingles may be found; null if by none."""
    return F.greatest(F.lit(None).cast("long"), F.lit(None).cast("long"), *[F.when(size >= c["needs"], F.lit(c["top"])) for c in classes])


def contaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text, ...), items(item_id, text, ...) -> (doc_id, item_id, n_item_shingles,
    n_shared, containment): the pairs with 100 * shared >= percent * the item's shingles.

    Shingles are distinct, of k words in lower case; a text of fewer words is one shingle. Null, empty
    and blank texts match nothing; rows with null ids take no part. Rows that repeat an id count each
    for itself, and the pair's best is returned. Empty tables give no rows; other columns are ignored.
    """
    # words and their hashes get a projection of their own: a lambda would evaluate them for each element
    hashed = F.transform("w", lambda w: F.xxhash64(w)).alias("wh")
    own = items.where("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("w"))
    own = own.select("item_id", "w", hashed).select("item_id", word_shingles(F.col("w"), k).alias("sh"), F.array_sort(F.array_distinct(shingle_hashes(F.col("wh"), k))).alias("hs"))
    own = scratch(own.withColumn("n", F.size("sh")), "items").where("n > 0")
    own = own.withColumn("kept", F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1).withColumn("class", F.floor(F.log2("n")).cast("int"))
    need = F.ceil(F.col("n") * percent / 100)
    sketch = own.select("class", need.alias("needs"), F.explode(F.slice("hs", F.lit(1), F.col("kept"))).alias("hash"))
    sketch = scratch(sketch.groupBy("class", "hash").agg(F.min("needs").alias("needs")), "sketch")
    # a row a power of two
    classes = sketch.groupBy("class").agg(F.min("needs").alias("needs"), F.max("hash").alias("top"), F.count("*").alias("rows")).collect()
    shape = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"
    if not classes:
        return docs.sparkSession.createDataFrame([], shape)

    given = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("th"))
    some = given.select("doc_id", "th", words(F.col("text")).alias("w")).select("doc_id", "th", hashed)
    some = some.select("doc_id", "th", shingle_hashes(F.col("wh"), k).alias("hs")).select("doc_id", "th", "hs", _up_to(F.size("hs"), classes).alias("most"))
    # explode_outer: a filter inferred from explode would be pushed down and compute hs once more
    some = some.select("doc_id", "th", F.size("hs").alias("size"), F.explode_outer(F.filter("hs", lambda h: h <= F.col("most"))).alias("hash"))
    hits = some.join(_limited(sketch, ROW * sum(c["rows"] for c in classes)), "hash").where("size >= needs").select("doc_id", "th").distinct()
    hits = scratch(hits, "candidates")

    texts = given.join(_limited(hits, ROW * hits.count()), ["doc_id", "th"], "left_semi")
    exact = texts.select("doc_id", "th", words(F.col("text")).alias("w")).select("doc_id", "th", F.explode_outer(word_shingles(F.col("w"), k)).alias("shingle"))
    wanted = scratch(own.select("item_id", "n", F.explode("sh").alias("shingle")), "items")
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("shingle") + ROW), F.lit(0)).alias("n")).first()["n"]
    shared = exact.join(_limited(wanted, size), "shingle").groupBy("doc_id", "th", "item_id", "n").agg(F.count_distinct("shingle").alias("n_shared"))
    shared = shared.where(100 * F.col("n_shared") >= percent * F.col("n"))
    best = shared.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", "n")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.n").cast("long").alias("n_item_shingles"), F.col("m.n_shared").alias("n_shared"), (F.col("m.n_shared") / F.col("m.n")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that contain no item; those with a null id stay."""
    found = contaminated(docs, items, k, percent).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(found, docs["doc_id"] == found["bad_id"], "left_anti")
