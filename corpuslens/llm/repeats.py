"""Removal of repeated strings, of bytes or of words, with sharded suffix arrays.

A text is a sequence of symbols: its bytes, or the hashes of its words. Every window of WINDOW symbols
contains an anchor: the leftmost smallest hash of a few symbols among its first WINDOW - CORE + 1
positions, which depends on the window alone. So two equal windows share an anchor whose CORE
following symbols are equal too. Anchors whose core occurs once anywhere are dropped; an anchor's
context (all symbols that any window round it can reach) that occurs twice or more is repeated as a
whole, and one of its copies goes on. Contexts that share a core but differ are dealt to shards that
hold all contexts of a core, suffix-sorted by induced sorting, and a window is repeated if its
permuted common prefix, or its successor's, reaches WINDOW. A shard has a bounded size; cores with
more than ``hot`` distinct contexts would break it, so their windows are compared by the counts of
128-bit hashes, whole intervals of windows first and single windows where an interval is in doubt:
the same windows are found either way. A core or context that a large share of all anchors has is
joined where its rows are (``join_skewed``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_groups, join_skewed, lean, scratch, shuffle_partitions, text_buffers
from .hashing import U, SpanHash, mix, word_hashes, word_spans
from .suffix_array import permuted_prefixes, suffix_array

BYTES, WORDS = "bytes", "words"
GRAM = {BYTES: 16, WORDS: 2}  # symbols of an anchor
CORE = {BYTES: 100, WORDS: 16}
STEP = {BYTES: 17, WORDS: 6}  # windows in an interval of a hot core
KIND = {BYTES: np.uint8, WORDS: np.uint64}
SHARD_BYTES = 3 << 19
KEY = ["doc_id", "th"]


def _sequence(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a group of texts and each text's first one. Words are compared in lower case."""
    if unit == BYTES:
        return data, offsets
    words, row = word_hashes(data, offsets)
    return words, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(offsets) - 1))])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th"))


def _anchors(data: np.ndarray, offsets: np.ndarray, window: int, core: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors in a group of texts, and each one's row."""
    n = len(data)
    width = window - core + 1
    hashes = SpanHash(data)
    at = np.arange(max(n - gram + 1, 0))
    value = np.full(-(-n // width) * width + width, np.iinfo(np.uint64).max, U)
    value[: len(at)] = (mix(hashes.raw(at, at + gram)) & ~U(0xFFFFFFFF)) | at.astype(U)
    blocks = value.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    lowest = np.minimum(behind[:n], ahead[width - 1 : n + width - 1])
    sizes = np.diff(offsets)
    last = np.repeat(offsets[1:] - window, sizes)
    valid = np.arange(n) <= last
    found = np.unique((lowest[valid] & U(0xFFFFFFFF)).astype(np.int64))
    return found, np.searchsorted(offsets, found, side="right") - 1


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    first = np.flatnonzero(new)
    return start[first], end[np.r_[first[1:] - 1, len(end) - 1]]


def _join_regions(regions: list[tuple]) -> tuple[list[np.ndarray], list[tuple]]:
    """Regions (key, start, symbols), where equal keys mean the same text, with those that overlap
    made one: the pieces, and the (key, start) of each."""
    by_text: dict = {}
    for key, start, symbols in regions:
        by_text.setdefault(key, []).append((start, symbols))
    pieces, where = [], []
    for key, own in by_text.items():
        own.sort(key=lambda x: x[0])
        parts, start, end = [], None, -1
        for s, symbols in own:
            if s > end:
                if parts:
                    pieces.append(np.concatenate(parts))
                    where.append((key, start))
                parts, start, end = [], s, s
            parts.append(symbols[end - s :])
            end = max(end, s + len(symbols))
        pieces.append(np.concatenate(parts))
        where.append((key, start))
    return pieces, where


def _shard_spans(regions: list[tuple], window: int, unit: str) -> list[tuple]:
    """Repeated spans among regions (key, start, symbols)."""
    pieces, where = _join_regions(regions)
    sizes = np.array([len(p) for p in pieces])
    begins = np.cumsum(sizes + 1) - sizes - 1
    ends = np.zeros(sizes.sum() + len(sizes), bool)  # after each piece stands a symbol that no text has
    ends[begins + sizes] = True
    symbols = np.concatenate(pieces)
    if unit == BYTES:
        t, k = np.full(len(ends), 0xFF, np.uint8), 256
        t[~ends] = symbols
    else:
        names, ranks = np.unique(symbols, return_inverse=True)
        t, k = np.zeros(len(ends), np.int64), len(names) + 1
        t[~ends] = ranks + 1
    sa = suffix_array(t, k)
    prefix = permuted_prefixes(t, sa)
    following = np.zeros(len(t), np.int64)
    following[sa[:-1]] = prefix[sa[1:]]
    room = np.repeat(begins + sizes, sizes + 1) - np.arange(len(t))
    hit = np.flatnonzero((np.maximum(prefix, following) >= window) & (room >= window))
    out = []
    if len(hit):
        piece = np.searchsorted(begins, hit, side="right") - 1
        cut = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (piece[1:] != piece[:-1])])
        for a, b in zip(cut, np.r_[cut[1:], len(hit)], strict=True):
            key, start = where[piece[a]]
            out.append((*key, int(start + hit[a] - begins[piece[a]]), int(start + hit[b - 1] - begins[piece[a]] + window)))
    return out


SPANS = "doc_id long, th long, s long, e long"


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "th", "s", "e"])


def _fetch(docs: DataFrame, members: DataFrame, window: int, core: int, unit: str) -> DataFrame:
    """(shard, h, doc_id, th, pos, start, symbols): each text's contexts, joined where one shard gets
    overlapping ones (then h and pos are those of the first)."""
    reach = window - core
    wanted = members.groupBy(*KEY).agg(F.collect_list(F.struct("shard", "pos", "h")).alias("at"))
    joined = _keyed(docs).alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.th") == F.col("w.th"))).select("d.doc_id", "d.th", "d.text", "w.at")

    def cut(batches):
        seen = set()
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for i, j in doc_groups(offsets):
                own, offs = _sequence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], unit)
                rows = []
                for x in range(i, j):
                    key = (batch.column("doc_id")[x].as_py(), batch.column("th")[x].as_py())
                    if key in seen:
                        continue
                    seen.add(key)
                    text = own[offs[x - i] : offs[x - i + 1]]
                    open_ = None
                    for shard, pos, h in sorted((p["shard"], p["pos"], p["h"]) for p in batch.column("at")[x].as_py()):
                        s, e = max(0, pos - reach), min(len(text), pos + window)
                        if open_ and open_[0] == shard and shard >= 0 and s <= open_[4]:
                            open_[4] = e
                            continue
                        if open_:
                            rows.append((open_, key, text[open_[3] : open_[4]].tobytes()))
                        open_ = [shard, h, pos, s, e]
                    if open_:
                        rows.append((open_, key, text[open_[3] : open_[4]].tobytes()))
                if rows:
                    yield pa.record_batch(
                        [pa.array(v, t) for v, t in (([r[0][0] for r in rows], pa.int64()), ([r[0][1] for r in rows], pa.int64()), ([r[1][0] for r in rows], pa.int64()), ([r[1][1] for r in rows], pa.int64()), ([r[0][2] for r in rows], pa.int64()), ([r[0][3] for r in rows], pa.int64()), ([r[2] for r in rows], pa.binary()))],
                        ["shard", "h", "doc_id", "th", "pos", "start", "symbols"],
                    )

    return joined.mapInArrow(lean(cut), "shard long, h long, doc_id long, th long, pos long, start long, symbols binary")


def _hot_spans(contexts: DataFrame, window: int, core: int, unit: str) -> tuple[DataFrame, list[DataFrame]]:
    """Repeated spans of contexts (h, doc_id, th, pos, start, symbols) by counts of window hashes, and
    the scratch tables that they are read from.

    A window that starts x symbols before its anchor is compared with those of the same x. Windows x
    in [u, v]: if all they cover together occurs twice, all are repeated; if what they have in
    common occurs once, none is; else each is counted.
    """
    reach, step, kind = window - core, STEP[unit], KIND[unit]

    def pair(raw, s, e):
        a, b = SpanHash(raw), SpanHash(raw, 1)
        return a.of(s, e).view(np.int64), b.of(s, e).view(np.int64)

    def intervals(batches):
        for batch in batches:
            out = {k: [] for k in ("row", "u", "v", "c1", "c2", "u1", "u2")}
            for x in range(batch.num_rows):
                raw = np.frombuffer(batch.column("symbols")[x].as_buffer(), kind)
                at = batch.column("pos")[x].as_py() - batch.column("start")[x].as_py()
                least, most = max(0, at + window - len(raw)), min(reach, at)
                u = np.arange(0, reach + 1, step)
                v = np.minimum(u + step - 1, reach)
                ok = (v >= least) & (u <= most)
                u, v = u[ok], v[ok]
                c1, c2 = pair(raw, at - u, at - v + window)
                whole = (u >= least) & (v <= most)
                w1, w2 = pair(raw, np.where(whole, at - v, 0), np.where(whole, at - u + window, 0))
                out["row"] += [x] * len(u)
                for k, z in (("u", u), ("v", v), ("c1", c1), ("c2", c2)):
                    out[k] += z.tolist()
                for k, z in (("u1", w1), ("u2", w2)):
                    out[k] += [int(y) if g else None for y, g in zip(z, whole, strict=True)]
            take = pa.array(out["row"], pa.int64())
            yield pa.record_batch([batch.column(c).take(take) for c in ("h", "doc_id", "th", "pos")] + [pa.array(out[k], pa.int64()) for k in ("u", "v", "c1", "c2", "u1", "u2")], ["h", "doc_id", "th", "pos", "u", "v", "c1", "c2", "u1", "u2"])

    nodes = scratch(contexts.select("h", "doc_id", "th", "pos", "start", "symbols").mapInArrow(lean(intervals), "h long, doc_id long, th long, pos long, u long, v long, c1 long, c2 long, u1 long, u2 long"), "nodes")
    count = lambda rows, keys, name: scratch(rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1"), name)
    all_, middle = ["h", "u", "u1", "u2"], ["h", "u", "c1", "c2"]
    whole, common = count(nodes.where("u1 IS NOT NULL"), all_, "equal"), count(nodes, middle, "common")
    sure = join_skewed(nodes, whole, all_, "rows", "left_semi")
    spans = sure.select("doc_id", "th", (F.col("pos") - F.col("v")).alias("s"), (F.col("pos") - F.col("u") + window).alias("e"))
    doubt = join_skewed(join_skewed(nodes, common, middle, "rows", "left_semi"), whole, all_, "rows", "left_anti")
    doubt = doubt.groupBy("h", *KEY, "pos").agg(F.collect_list("u").alias("us"))
    c, d = contexts.alias("c"), doubt.alias("d")
    again = c.join(d, F.col("c.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("c.th") == F.col("d.th")) & (F.col("c.h") == F.col("d.h")) & (F.col("c.pos") == F.col("d.pos"))).select("c.h", "c.doc_id", "c.th", "c.pos", "c.start", "c.symbols", "d.us")

    def singles(batches):
        for batch in batches:
            rows, xs, h1, h2 = [], [], [], []
            for x in range(batch.num_rows):
                raw = np.frombuffer(batch.column("symbols")[x].as_buffer(), kind)
                at = batch.column("pos")[x].as_py() - batch.column("start")[x].as_py()
                w = np.concatenate([np.arange(u, min(u + step, reach + 1)) for u in batch.column("us")[x].as_py()])
                w = w[(w >= max(0, at + window - len(raw))) & (w <= min(reach, at))]
                a, b = pair(raw, at - w, at - w + window)
                rows += [x] * len(w)
                xs += w.tolist()
                h1 += a.tolist()
                h2 += b.tolist()
            take = pa.array(rows, pa.int64())
            yield pa.record_batch([batch.column(c).take(take) for c in ("h", "doc_id", "th", "pos")] + [pa.array(k, pa.int64()) for k in (xs, h1, h2)], ["h", "doc_id", "th", "pos", "x", "h1", "h2"])

    ones = scratch(again.mapInArrow(lean(singles), "h long, doc_id long, th long, pos long, x long, h1 long, h2 long"), "windows")
    # a doubtful window may equal one inside a sure interval: those are counted with it
    near = ones.select("h").distinct()
    one_each = sure.groupBy("h", "u", "u1", "u2").agg(F.min(F.struct("doc_id", "th", "pos")).alias("m")).select("h", "m.doc_id", "m.th", "m.pos", "u").groupBy("h", *KEY, "pos").agg(F.collect_list("u").alias("us"))
    o = one_each.alias("d")
    sure_ctx = c.join(o, F.col("c.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("c.th") == F.col("d.th")) & (F.col("c.h") == F.col("d.h")) & (F.col("c.pos") == F.col("d.pos"))).select("c.h", "c.doc_id", "c.th", "c.pos", "c.start", "c.symbols", "d.us")
    known = sure_ctx.join(near, "h", "left_semi").mapInArrow(lean(singles), "h long, doc_id long, th long, pos long, x long, h1 long, h2 long")
    twice = count(ones.unionByName(known), ["h", "x", "h1", "h2"], "twice")
    found = join_skewed(ones, twice, ["h", "x", "h1", "h2"], "rows", "left_semi")
    spans = spans.unionByName(found.select("doc_id", "th", (F.col("pos") - F.col("x")).alias("s"), (F.col("pos") - F.col("x") + window).alias("e")))
    return spans, [nodes, whole, common, ones, twice]


def repeated_spans(docs: DataFrame, window: int = 400, hot: int = 512, core: int | None = None, unit: str = BYTES) -> DataFrame:
    """(doc_id, th, spans): spans, in symbols, covered by windows that start anywhere else too.

    docs(doc_id, text, ...); th is xxhash64(text) and names the row's text. Matches never cross
    documents. A text given in several rows, even with one doc_id, is repeated as a whole if it has
    ``window`` symbols. Null, empty and shorter texts have no spans and no row.
    """
    core = CORE[unit] if core is None else core
    reach, gram, width = window - core, GRAM[unit], KIND[unit]().itemsize

    def anchors(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for i, j in doc_groups(offsets):
                own, offs = _sequence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], unit)
                if not len(own) or (np.diff(offs) < window).all():
                    continue
                pos, row = _anchors(own, offs, window, core, gram)
                s, e = np.maximum(offs[row], pos - reach), np.minimum(offs[row + 1], pos + window)
                h = SpanHash(own).of(pos, pos + core)
                ctx = mix(SpanHash(own, 1).of(s, e) + (pos - s).astype(U) * U(0x2545F4914F6CDD1D))
                take = pa.array(row + i)
                yield pa.record_batch([batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(pos - offs[row]), pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64))], ["doc_id", "th", "pos", "h", "ctx"])

    found = scratch(_keyed(docs).mapInArrow(lean(anchors), "doc_id long, th long, pos long, h long, ctx long"), "anchors")
    again = scratch(found.groupBy("h").agg(F.count("*").alias("rows")).where("rows > 1"), "cores")
    found = scratch(join_skewed(found, again, ["h"], "rows", "left_semi"), "repeated", [found])
    contexts = scratch(found.groupBy("h", "ctx").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "pos")).alias("m")), "contexts", [again])
    whole = join_skewed(found, scratch(contexts.where("c > 1").select("h", "ctx", "c"), "copies"), ["h", "ctx"], "c", "left_semi")
    whole = scratch(whole.select("doc_id", "th", F.greatest(F.lit(0), F.col("pos") - reach).alias("s"), (F.col("pos") + window).alias("e")), "whole", [found])

    cores = contexts.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.xxhash64("m.doc_id", "m.th").cast("decimal(38,0)")).alias("who"))
    cores = scratch(cores.where("n > 1").select("h", "n", F.xxhash64("who", "n").alias("group")), "cores")
    crowd = cores.groupBy("group").agg(F.sum("n").alias("total")).where(F.col("total") * (window + reach) * width > 2 * SHARD_BYTES).select("group", F.lit(True).alias("large"))
    shard = F.when(F.col("n") > hot, F.lit(-1)).otherwise(F.shiftrightunsigned(F.when(F.col("large"), F.xxhash64("group", "h")).otherwise(F.col("group")), 1))
    dealt = scratch(cores.join(crowd, "group", "left").select("h", "n", shard.alias("shard")), "dealt", [cores])
    members = join_skewed(contexts.select("h", "m.doc_id", "m.th", "m.pos"), dealt, ["h"], "n")
    fetched = scratch(_fetch(docs, members, window, core, unit), "regions", [contexts, dealt])

    def sort_shards(batches):
        have, size, open_, own, shard = [], 0, [], 0, None
        for batch in batches:
            out = []
            for at, doc, th, start, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "th", "start", "symbols")), strict=True):
                if at != shard:
                    if have and size + own > SHARD_BYTES:
                        out += _shard_spans(have, window, unit)
                        have, size = [], 0
                    have, size = have + open_, size + own
                    open_, own, shard = [], 0, at
                open_.append(((doc, th), start, np.frombuffer(raw, KIND[unit])))
                own += len(raw)
            if out:
                yield _span_batch(out)
        for part in ([have, open_] if size + own > SHARD_BYTES else [have + open_]):
            if part:
                yield _span_batch(_shard_spans(part, window, unit))

    shards = fetched.where("shard >= 0").repartition(shuffle_partitions(docs.sparkSession), "shard").sortWithinPartitions("shard")
    sorted_ = shards.select("shard", "doc_id", "th", "start", "symbols").mapInArrow(lean(sort_shards), SPANS)
    hot_spans, read = _hot_spans(fetched.where("shard < 0"), window, core, unit)
    spans = whole.unionByName(sorted_).unionByName(hot_spans)
    return scratch(spans.groupBy(*KEY).agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans", [fetched, whole, *read])


def repeated_word_spans(docs: DataFrame, words: int = 51, hot: int = 512) -> DataFrame:
    """(doc_id, th, spans): spans, in words, of runs of ``words`` words that start anywhere else too.
    Words are compared in lower case; the white space between them does not count."""
    return repeated_spans(docs, words, hot, unit=WORDS)


def cut_repeats(docs: DataFrame, spans: DataFrame, keep_text: bool = True, unit: str = BYTES, extra: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, *extra): texts without the given spans.

    n_removed counts bytes. kept is the remaining bytes as text; a character cut in two, which spans
    of words never do, loses its other bytes. A row per input row, with its own columns ``extra``;
    without keep_text, kept is null. A null text counts as empty.
    """
    extra = [c for c in extra if c != "doc_id"]

    def run(batches):
        for batch in batches:
            rows = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = (text or "").encode()
                n = removed = 0
                kept = raw
                if own:
                    s, e = _merged(np.array([x["s"] for x in own]), np.array([x["e"] for x in own]))
                    if unit == WORDS:
                        begin, end, _ = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                        s, e = begin[s], end[np.minimum(e, len(end)) - 1]
                    e = np.minimum(e, len(raw))
                    n, removed = len(s), int((e - s).sum())
                    kept = b"".join(raw[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True))
                rows.append((len(raw), removed, n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.record_batch([batch.column("doc_id"), *columns, *[batch.column(f"x_{c}") for c in extra]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *extra])

    kinds = dict(docs.dtypes)
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), *[F.col(c).alias(f"x_{c}") for c in extra])
    d, s = own.alias("d"), spans.alias("s")
    joined = d.join(s, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & F.col("d.th").eqNullSafe(F.col("s.th")), "left").select("d.doc_id", "d.text", "s.spans", *[f"d.x_{c}" for c in extra])
    shape = ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string", *[f"`{c}` {kinds[c]}" for c in extra]])
    return joined.mapInArrow(lean(run), shape)


def remove_repeats(docs: DataFrame, window: int = 400, hot: int = 512, keep_text: bool = True) -> DataFrame:
    """Every byte covered by a ``window``-byte string that also starts anywhere else is removed."""
    return cut_repeats(docs, repeated_spans(docs, window, hot), keep_text)
