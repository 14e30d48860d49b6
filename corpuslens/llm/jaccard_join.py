"""N-gram Jaccard self-join by token-combination prefixes.

Tokens are a document's distinct word shingles. Documents with the same token set form one class
and only its smallest id goes on. Tokens are ordered by document frequency, rare first. A set of n
tokens that is linked with another has at most d = n - ceil(t n) tokens that the other lacks, so the
first token they share is among its first d + 1; rare tokens there are indexed singly. Where the
first shared token is frequent, none of the rare ones is shared, and tokens of the frequent class are
indexed in pairs of neighbours: prefixes are extended until they hold two shared tokens more
than the two sets can differ in (at most D = (1 - t) / t n), so that between two consecutive shared
ones nothing else stands in either set. A set makes fewer than d + D + 2 signatures, whatever its length, and a
passage in a third of all documents makes no bucket unless it fills the documents. Candidates meet
the size and position bounds and are verified on whole sets, in rounds: every set with the pivot with
which it shares most buckets, then with the pivots of its other buckets, then with the most central
sets of each bucket (those whose buckets are fullest: copies of one text differ less from them
than from each other), then all pairs of a bucket. The later rounds take pairs that are still in different
components and whose sketches (the parity of the tokens in each of 256 classes) differ in no more
places than the linked sets may differ in tokens. Nothing is capped: links that could join
components are all verified. The frequency table knows tokens that a task meets twice; among others,
those of common words stand behind those of rare ones, else the chance meetings of common words fill
more and fuller buckets the larger a table is. The result is the components only: pairs already in one component are
skipped, so neither the links nor their number come out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, discard, doc_groups, lean, scratch, shuffle_partitions, text_buffers
from .components import connected_components
from .hashing import U, distinct_per_row, mix, shingles, word_hashes

SUMMARY = 65_536  # tokens that a task keeps counts of
FREQUENT_KEPT = 262_144  # the frequency table is sent to every task: 16 bytes an entry, 4 MB
SMALL = 500_000  # ids that may be broadcast, 4 MB
FLUSH = 500_000  # tokens counted together
SEEN = 200_000  # set ids by which a task knows the texts it has counted
CLASSES = 1 << 16  # of words, by hash: a task keeps a count of each, and all tasks get half a MB of ranks
PAIRS = 1 << 17  # pairs compared at a time, or as many as there are sets in them
BUCKET_BYTES = 16 << 20  # entries gathered in one task
SKETCH = 256  # bits
CENTRAL_ROUNDS = 2
BITS = [f"b{i}" for i in range(SKETCH // 64)]
ENTRY = np.dtype([("sig", "<u8"), ("doc", "<i8"), ("n", "<u4"), ("pos", "<i4"), ("before", "<i4")])


def word_groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after, words, row of each) of groups of rows."""
    data, offsets = text_buffers(column)
    for i, j in doc_groups(offsets):
        base = offsets[i]
        yield i, j, *word_hashes(data[base : offsets[j]], offsets[i : j + 1] - base)


def token_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after, tokens, row of each) of groups of rows; distinct tokens of each row."""
    for i, j, words, row in word_groups(column):
        sh, rw, _ = shingles(words, row, k)
        yield i, j, *distinct_per_row(sh, rw)


def ranked_tokens(words: np.ndarray, row: np.ndarray, k: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tokens of each row, row of each, how common its words are): the sum of the ranks of a
    token's words, which is the same wherever the token stands; 0 where a text has fewer than k words."""
    sh, rw, at = shingles(words, row, k)
    total = np.concatenate([[0], np.cumsum(rank[words & U(CLASSES - 1)], dtype=np.int64)])
    end = np.minimum(at + k, len(words))
    whole = (end - at == k) & (row[end - 1] == rw) if len(at) else np.empty(0, bool)
    return distinct_per_row(sh, rw, np.where(whole, total[end] - total[at], 0))


def set_ids(sh: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and a 128-bit id of each row's token set."""
    n = np.bincount(row, minlength=rows)
    out = []
    for salt in (U(0x1234567), U(0x89ABCDE)):
        total = np.concatenate([[U(0)], np.cumsum(mix(sh + salt), dtype=U)])
        ends = np.cumsum(n)
        out.append(mix(total[ends] - total[ends - n] + n.astype(U)).view(np.int64))
    return n, out[0], out[1]


def sketches(sh: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """A row of SKETCH bits for each row: the parity of its distinct tokens in each class. Two sets
    differ in at least as many tokens as their sketches differ in bits."""
    odd = np.bincount(row * SKETCH + ((sh >> U(24)) % U(SKETCH)).astype(np.int64), minlength=rows * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8).reshape(rows, SKETCH), axis=1).view(np.int64)


def _fold(token: np.ndarray, count: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A summary of frequent tokens with more tokens counted in: the SUMMARY largest counts, less the
    largest one left out. A count is too low by at most the tokens seen / SUMMARY."""
    t, c = np.unique(np.concatenate(more), return_counts=True)
    t, back = np.unique(np.concatenate([token, t]), return_inverse=True)
    c = np.bincount(back, weights=np.concatenate([count, c])).astype(np.int64)
    if len(c) > SUMMARY:
        c -= np.partition(c, -SUMMARY - 1)[-SUMMARY - 1]
    return t[c > 0], c[c > 0]


def _frequent(docs: DataFrame, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent tokens and their document counts, sorted by token; and a rank of each class of
    words, by how often its words occur.

    Each task sums up all its documents (equal sets once, as far as it remembers them) and reports
    tokens that it met twice or more, and the words of all documents by class. A token that is missing
    here may have a few documents in every task; its words tell whether that is likely, so such tokens
    stand behind those of rarer words. The tables only order tokens; any order gives the same result.
    """

    def count(batches):
        token, c, have, size, seen = np.empty(0, U), np.empty(0, np.int64), [], 0, set()
        common = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for i, j, words, row in word_groups(batch.column("text")):
                common += np.bincount((words & U(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
                sh, rw, _ = shingles(words, row, k)
                sh, rw = distinct_per_row(sh, rw)
                _, a, _ = set_ids(sh, rw, j - i)
                new = np.zeros(j - i, bool)
                for x, key in enumerate(a.tolist()):
                    if key not in seen:
                        seen.add(key)
                        new[x] = True
                if len(seen) > SEEN:
                    seen = set()
                have.append(sh[new[rw]])
                size += len(have[-1])
                if size > FLUSH:
                    token, c = _fold(token, c, have)
                    have, size = [], 0
        if have:
            token, c = _fold(token, c, have)
        full = np.flatnonzero(common)
        for word, keys, counts in ((False, token[c > 1].view(np.int64), c[c > 1]), (True, full, common[full])):
            yield pa.record_batch([pa.array(np.full(len(keys), word)), pa.array(keys), pa.array(counts)], ["word", "token", "c"])

    counts = docs.select("text").mapInArrow(lean(count), "word boolean, token long, c long").groupBy("word", "token").agg(F.sum("c").alias("c"))
    counts = scratch(counts.where(F.col("word") | (F.col("c") >= floor)), "counts")
    top = counts.where("NOT word").orderBy(F.desc("c"), "token").limit(FREQUENT_KEPT).toArrow()
    classes = counts.where("word").toArrow()
    discard(counts)
    token, c = top["token"].to_numpy().view(U), top["c"].to_numpy()
    order = np.argsort(token)
    rank = np.zeros(CLASSES, np.int64)
    rank[classes["token"].to_numpy()] = np.log2(classes["c"].to_numpy()) * 8
    return token[order], c[order], rank


def signatures(sh: np.ndarray, row: np.ndarray, often: np.ndarray, n: np.ndarray, percent: int, pair_from: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signatures by row, how many of each row, how many of these are single tokens, rare tokens of
    each row) of token sets of n tokens; often: each token's frequency."""
    order = np.lexsort((sh, often, row))
    sh, rare = sh[order], often[order] < pair_from
    rows = len(n)
    place = np.arange(len(sh)) - np.repeat(np.cumsum(n) - n, n)
    n_rare = np.bincount(row[rare], minlength=rows)
    least = -(-percent * n // 100)  # shared with any linked set
    lacks, differs = n - least, (100 - percent) * n // percent
    few = least < differs + 2  # too few shared tokens for a pair of neighbours: all are indexed singly
    single = (place < np.repeat(lacks + 1, n)) & (rare | np.repeat(few, n))
    # rare tokens are not shared here: they use up what the set may lack and differ in
    length = np.where(n_rare <= lacks, np.minimum(lacks + differs - 2 * n_rare + 2, n - n_rare), 0)
    nth = place - np.repeat(n_rare, n)  # among the frequent tokens
    pair = ~rare & (nth + 1 < np.repeat(length, n))
    at = np.flatnonzero(pair)
    sigs = np.concatenate([sh[single], mix(sh[at] * U(0xA0761D6478BD642F) + sh[at + 1])])
    owner = np.concatenate([row[single], row[at]])  # of row: sorted, as sh is
    back = np.argsort(owner, kind="stable")
    return sigs[back], np.bincount(owner, minlength=rows), np.bincount(row[single], minlength=rows), n_rare


def _signatures(docs: DataFrame, k: int, percent: int, frequent: tuple[np.ndarray, np.ndarray, np.ndarray], pair_from: int) -> DataFrame:
    known, count, rank = frequent

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, words, row in word_groups(batch.column("text")):
                sh, rw, common = ranked_tokens(words, row, k, rank)
                n, a, b = set_ids(sh, rw, j - i)
                bits = sketches(sh, rw, j - i)
                often = np.zeros(len(sh), np.int64)
                if len(known) and len(sh):
                    at = np.minimum(np.searchsorted(known, sh), len(known) - 1)
                    often = np.where(known[at] == sh, count[at], 0)
                often = (often << 20) + np.minimum(common, (1 << 20) - 1)  # among equals by the words
                sigs, counts, singles, rare = signatures(sh, rw, often, n, percent, pair_from << 20)
                yield pa.record_batch(
                    [ids.slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(a), pa.array(b), pa.array(counts.astype(np.int32)), pa.array(singles.astype(np.int32)), pa.array(rare.astype(np.int32)), binary_array(sigs, counts), *map(pa.array, np.ascontiguousarray(bits.T))],
                    ["doc_id", "n_shingles", "set_a", "set_b", "n_sigs", "n_single", "n_rare", "sigs", *BITS],
                )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_shingles long, set_a long, set_b long, n_sigs int, n_single int, n_rare int, sigs binary, " + ", ".join(f"{x} long" for x in BITS))


def _buckets(sets: DataFrame, buckets: int) -> DataFrame:
    """(sig, doc_id, n, pos, before, pivot, n2, pos2, before2) of signatures that two or more of the
    given sets have; the pivot is one of the sets with the signature, the same for all of them."""

    def scatter(batches):
        def out(have):
            e = np.concatenate(have)
            b = (e["sig"] % U(buckets)).astype(np.int32)
            order = np.argsort(b, kind="stable")
            n = np.bincount(b, minlength=buckets)
            full = np.flatnonzero(n)
            return pa.record_batch([pa.array(full.astype(np.int32)), binary_array(e[order], n[full])], ["bucket", "entries"])

        have, size = [], 0
        for batch in batches:
            blob = batch.column("sigs").cast(pa.large_binary())
            offs = np.frombuffer(blob.buffers()[1], np.int64)[blob.offset : blob.offset + len(blob) + 1]
            if not len(blob) or offs[-1] == offs[0]:
                continue
            counts = np.diff(offs) // 8
            e = np.empty(counts.sum(), ENTRY)
            e["sig"] = np.frombuffer(blob.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(U)
            e["doc"] = np.repeat(batch.column("doc_id").to_numpy(), counts)
            e["n"] = np.repeat(batch.column("n_shingles").to_numpy(), counts)
            nth = np.arange(len(e)) - np.repeat(np.cumsum(counts) - counts, counts)
            singles = np.repeat(batch.column("n_single").to_numpy(), counts)
            e["before"] = np.maximum(nth - singles, 0)
            e["pos"] = np.where(nth < singles, nth, np.repeat(batch.column("n_rare").to_numpy(), counts) + nth - singles)
            have.append(e)
            size += len(e)
            if size > 500_000:
                yield out(have)
                have, size = [], 0
        if have:
            yield out(have)

    def gather(batches):
        have = [np.frombuffer(x.as_buffer(), ENTRY) for batch in batches for x in batch.column("entries")]
        if not have:
            return
        e = np.concatenate(have)
        del have
        e = e[np.argsort(e["sig"], kind="stable")]
        same = e["sig"][1:] == e["sig"][:-1]
        e = e[np.r_[same, False] | np.r_[False, same]]
        e = e[np.lexsort((mix(e["doc"].astype(U)), e["sig"]))]
        first = np.flatnonzero(np.r_[True, e["sig"][1:] != e["sig"][:-1]]) if len(e) else np.empty(0, np.int64)
        lead = np.repeat(first, np.diff(np.r_[first, len(e)]))
        for s in range(0, len(e), 100_000):
            own, by = e[s : s + 100_000], e[lead[s : s + 100_000]]
            columns = [np.ascontiguousarray(own["sig"]).view(np.int64), *[x[f].astype(np.int64) for x in (own, by) for f in ("doc", "n", "pos", "before")]]
            yield pa.record_batch([pa.array(x) for x in columns], ["sig", "doc_id", "n", "pos", "before", "pivot", "n2", "pos2", "before2"])

    blobs = sets.select("doc_id", "n_shingles", "n_single", "n_rare", "sigs").mapInArrow(lean(scatter), "bucket int, entries binary")
    return blobs.repartitionById(buckets, "bucket").mapInArrow(lean(gather), "sig long, doc_id long, n long, pos long, before long, pivot long, n2 long, pos2 long, before2 long")


def _possible(percent: int):
    """Size and position bounds on a pair (n, pos, before | n2, pos2, before2) from one shared signature.

    A linked pair has a row for the first token that it shares, or for two neighbours where all the
    shared ones are frequent. At most ``before`` tokens (none before a single token, the frequent
    ones before a pair) of either set are shared ahead of pos, and what is left from there on must
    make up the overlap that their sizes require. Rows of other shared tokens may fail; the pair
    stays through that one.
    """
    n, m, p, q = (F.col(c) for c in ("n", "n2", "pos", "pos2"))
    most = F.least("before", "before2") + F.least(n - p, m - q)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * (n + m))


def _alike(percent: int):
    """Linked sets of n and n2 tokens differ in (100 - percent) / (100 + percent) of n + n2 at most."""
    differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"{x}_2"))) for x in BITS), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("n2"))


def _overlapping(pairs: DataFrame, sets: DataFrame, percent: int, column: str, kind: type) -> DataFrame:
    """Pairs whose sorted tokens overlap enough. Shortened tokens can only overlap more."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = min(int((q[at] == p).sum()), len(q))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col(column).alias("ta"))
    right = sets.select(F.col("doc_id").alias("b"), F.col(column).alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(lean(run), "a long, b long")


def _tokens(docs: DataFrame, ids: DataFrame, k: int, short: bool) -> DataFrame:
    """(doc_id, tokens): sorted tokens of the documents with the given ids; short: two bytes of each.

    ids is broadcast where it is small. Else all documents' short tokens, or the texts, are dealt out
    by id, whichever are less."""
    ids = scratch(ids, "ids")
    few = ids.count() <= SMALL

    def run(batches):
        for batch in batches:
            own = batch.column("doc_id")
            for i, j, sh, rw in token_sets(batch.column("text"), k):
                n = np.bincount(rw, minlength=j - i)
                kept = (sh >> U(48)).astype(np.uint16) if short else sh  # the highest bits, so still in order
                yield pa.record_batch([own.slice(i, j - i), binary_array(kept, n)], ["doc_id", "tokens"])

    made = lambda rows: rows.mapInArrow(lean(run), "doc_id long, tokens binary")
    if short and not few:
        one = made(docs).join(ids, "doc_id", "left_semi")
    else:
        one = made(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"))
    return scratch(one.dropDuplicates(["doc_id"]), "tokens", [ids])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, shorts: DataFrame, k: int, percent: int) -> DataFrame:
    """Whole sets are compared; first by two bytes of each token, which rules out nearly all others
    at a quarter of the traffic and never a link. pairs is a scratch table. Of shorts, only the sets
    that are in a pair are dealt out, unless these are many. Each pair carries a set's tokens along, so
    many pairs are compared in turns, and the files of one turn go before the next."""
    ends = scratch(_ends(pairs), "ends")
    sets = ends.count()
    own = shorts.join(F.broadcast(ends), "doc_id", "left_semi") if sets <= SMALL else shorts
    turns = max(1, -(-pairs.count() // max(PAIRS, sets)))
    turn = F.pmod(F.xxhash64("a", "b"), F.lit(turns))
    found = [scratch(_overlapping(pairs.where(turn == x), own, percent, "tokens", np.uint16), "likely") for x in range(turns)]
    likely = scratch(functools.reduce(DataFrame.unionByName, found), "likely", [ends, *found]) if turns > 1 else found[0]
    tokens = _tokens(docs, _ends(likely), k, False)
    return scratch(_overlapping(likely, tokens, percent, "tokens", U), "verified", [likely, tokens])


def _mixed(rows: DataFrame, sketch: DataFrame, of) -> DataFrame:
    """(sig, doc_id, n, pos, before, component, sketch) of the buckets whose sets are in two or more components."""
    member = of(rows, "doc_id", "component")
    mixed = member.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("sig")
    return scratch(member.join(mixed, "sig", "left_semi").join(sketch, "doc_id"), "mixed")


def _other(member: DataFrame) -> DataFrame:
    return member.select("sig", F.col("doc_id").alias("d2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("before").alias("before2"), F.col("component").alias("c2"), *[F.col(x).alias(f"{x}_2") for x in BITS])


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, frequent_floor: int = 16, pair_from: int = 1024) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id, same_set) a row per document.

    Linked: 100 * intersection >= percent * union of the k-word shingle sets (lower-cased words;
    fewer than k words: the whole sequence as one). component_id: smallest doc_id reachable;
    same_set: smallest doc_id with an equal set. Null, empty and blank texts have no shingles and
    stay alone. Rows with a null doc_id take no part and come back alone with null ids; repeated
    rows come back as often as they are given; doc_ids name texts, so of different texts with one
    doc_id one is compared for all of them (``common.row_keys`` tells such rows apart). An empty
    table gives no rows; other columns are ignored. Texts are used whole.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    frequent = _frequent(docs, k, frequent_floor)
    sets = scratch(_signatures(docs, k, percent, frequent, pair_from), "sets")
    real = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = scratch(real.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("same_set")), "classes")
    chosen = real.join(classes.select(F.col("same_set").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    entries = sets.agg(F.coalesce(F.sum("n_sigs"), F.lit(0)).alias("n")).first()["n"]
    buckets = scratch(_buckets(chosen, max(shuffle_partitions(spark), entries * ENTRY.itemsize // BUCKET_BYTES + 1)), "buckets")
    sketch = scratch(chosen.select("doc_id", *BITS), "sketches")
    base = sets.join(classes, ["n_shingles", "set_a", "set_b"], "left").select("doc_id", "n_shingles", "same_set")
    base = scratch(base, "base", [sets, classes])

    shorts = _tokens(docs, buckets.select("doc_id").distinct(), k, True)
    other_sketch = lambda name: sketch.select(F.col("doc_id").alias(name), *[F.col(x).alias(f"{x}_2") for x in BITS])
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    near = buckets.where(F.col("doc_id") != F.col("pivot")).where(_possible(percent))
    near = scratch(near.groupBy("doc_id", "n", "pivot", "n2").agg(F.count("*").alias("shared")), "near")
    best = near.groupBy("doc_id", "n").agg(F.max(F.struct("shared", F.xxhash64("pivot").alias("h"), "pivot", "n2")).alias("v"))
    best = best.select("doc_id", "n", "v.pivot", "v.n2").join(sketch, "doc_id").join(other_sketch("pivot"), "pivot").where(_alike(percent))
    first = scratch(best.select(*ordered("doc_id", "pivot")).distinct(), "pairs")
    links = scratch(_verified(first, docs, shorts, k, percent), "links")
    parts = connected_components(links)

    of = lambda rows, node, name: rows.join(parts.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))
    apart = of(of(near, "doc_id", "c1"), "pivot", "c2").where("c1 <> c2")
    second = apart.join(sketch, "doc_id").join(other_sketch("pivot"), "pivot").where(_alike(percent))
    second = scratch(second.select(*ordered("doc_id", "pivot")).distinct().join(first, ["a", "b"], "left_anti"), "pairs", [near])
    links = scratch(links.unionByName(_verified(second, docs, shorts, k, percent)), "links", [links])
    parts = connected_components(links)

    # what is left apart: the most central sets of each mixed bucket in turn, then all pairs. A set
    # that was held against its whole bucket leaves it; a pair that fails the position bound there
    # shares an earlier token, whose bucket it stays in.
    rows, done = buckets.select("sig", "doc_id", "n", "pos", "before"), first.unionByName(second)
    read = [buckets]
    for _ in range(CENTRAL_ROUNDS):
        member = _mixed(rows, sketch, of)
        discard(*read)
        central = member.join(member.groupBy("sig").agg(F.count("*").alias("size")), "sig").groupBy("doc_id").agg(F.sum("size").alias("weight"))
        lead = member.join(central, "doc_id").groupBy("sig").agg(F.max(F.struct("weight", "doc_id")).getField("doc_id").alias("doc_id"))
        lead = scratch(lead, "lead")
        pairs = member.join(_other(member.join(lead, ["sig", "doc_id"], "left_semi")), "sig").where("component <> c2").where(_possible(percent) & _alike(percent))
        pairs = scratch(pairs.select(*ordered("doc_id", "d2")).distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        links = scratch(links.unionByName(_verified(pairs, docs, shorts, k, percent)), "links", [links])
        parts = connected_components(links)
        rows, done = member.join(lead, ["sig", "doc_id"], "left_anti").select("sig", "doc_id", "n", "pos", "before"), done.unionByName(pairs)
        read = [member, lead]

    member = _mixed(rows, sketch, of)
    discard(*read)
    rest = member.join(_other(member), "sig").where("doc_id < d2 AND component <> c2").where(_possible(percent) & _alike(percent))
    rest = rest.select(F.col("doc_id").alias("a"), F.col("d2").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
    rest = scratch(rest, "pairs")
    links = scratch(links.unionByName(_verified(rest, docs, shorts, k, percent)), "links", [links])
    parts = connected_components(links)
    discard(member, sketch, shorts, rest)

    out = base.join(parts.withColumnRenamed("node", "same_set"), "same_set", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "same_set", "doc_id").alias("component_id"), F.coalesce("same_set", "doc_id").alias("same_set"))
