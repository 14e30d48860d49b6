"""Language-model scores of documents: word counts, and a causal self-attention model in numpy.

A text is its words in lower case and one end. The model reads the subword ids of the words (each
with a leading space) and predicts the class of the next id by one causal self-attention layer; an
id's share within its class comes from the counts of the whole training text. The most frequent
ids are classes of their own. Windows of CONTEXT ids overlap; each id is scored once, in the window
that gives it more context. Words become ids once: the ids are written to the shared folder, and counts,
training and scores read them. Training is local: tasks start from common weights, take steps on windows
of their part, and the weights are averaged. After a first round on some windows of every training
document, rounds of a bounded number of steps go over all windows, each of which is learned from once.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, doc_groups, lean, scratch, text_buffers
from .hashing import SpanHash, U, word_hashes, word_spans
from .packing import encoder, tokenizer_paths, word_ids

CONTEXT, OVERLAP, WIDTH = 32, 8, 32
INPUTS, OUTPUTS = 1024, 240  # most frequent ids that are classes of their own
END, START = 50257, 50258  # beyond the tokenizer's ids; all fit into two bytes
IDS = 50259
BATCH, RATE, ROUNDS = 64, 1e-2, (50, 800)  # windows a step, first round's rate, steps a task in the first round and in each of those that take all windows
GROUP = 1 << 22  # bytes of text whose distinct words are encoded together
EDGE = 80  # exp of as much, and of its negative, is a float
KNOWN_WORDS = 500_000  # counts that travel to every task: 16 bytes each, 8 MB
_ODD_SPACE = re.compile(r"[^\S ]")
_firsts: dict[tuple[str, str], np.ndarray] = {}


class CausalModel:
    """One causal self-attention layer with a residual, over input classes, to output classes in two steps:
    a group of classes, then a class (a slot) of that group. So a target costs twice the root of the classes.

    Keys are the inputs themselves and what follows the values is a residual: a second matrix on either
    side of the attention would only be multiplied by the first.
    """

    names = ("embed", "place", "wq", "wv", "top", "out")

    def __init__(self, inputs: int, outputs: int, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda *shape: r.normal(0, 0.2, shape).astype(np.float32)
        self.groups = max(1, round(outputs**0.5))
        self.slots = -(-outputs // self.groups)
        self.spare = self.groups * self.slots - outputs  # slots of the last group that are no class
        self.embed, self.place = f(inputs, WIDTH), f(CONTEXT, WIDTH)
        self.wq, self.wv = f(WIDTH, WIDTH), f(WIDTH, WIDTH)
        self.top, self.out = f(self.groups, WIDTH + 1), f(self.groups, self.slots, WIDTH + 1)  # a bias last
        self.top[:, -1] = self.out[:, :, -1] = 0
        self.seen = np.triu(np.ones((CONTEXT, CONTEXT), np.float32))  # by key and query

    def params(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.names]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.params():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def _weights(self, q: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights by key and query, their sums): not normalised. q: queries of a window's last places.
        Only where exp could leave the range of floats is each query's largest taken off first."""
        a = k @ q.transpose(0, 2, 1)
        seen = self.seen[:, CONTEXT - q.shape[1] :]
        if not (-EDGE < a.min() and a.max() < EDGE):
            a -= np.where(seen > 0, a, -np.inf).max(axis=1, keepdims=True)
            np.minimum(a, 0, out=a)
        np.exp(a, out=a)
        a *= seen
        return a, np.ones((1, CONTEXT), a.dtype) @ a

    def _grouped(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order of the targets by group, their groups in it, where each group's targets begin and end)."""
        group = (y // self.slots).astype(np.int16)
        order = np.argsort(group, kind="stable")
        return order, group[order], np.concatenate([[0], np.cumsum(np.bincount(group, minlength=self.groups))])

    def _scores(self, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of groups, and of the slots of each target's own group, less the largest; a column a
        target, by group. h: rows that end with a one."""
        t = self.top @ h.T
        z = np.empty((self.slots, len(h)), h.dtype)
        for g in range(self.groups):
            if ends[g] < ends[g + 1]:
                np.matmul(self.out[g], h[ends[g] : ends[g + 1]].T, out=z[:, ends[g] : ends[g + 1]])
        if self.spare:
            z[-self.spare :, ends[-2] :] = -np.inf
        t -= t.max(axis=0)
        z -= z.max(axis=0)
        return t, z

    def _side(self) -> np.ndarray:
        return np.concatenate([self.wq * self.embed.dtype.type(WIDTH**-0.5), self.wv], axis=1)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Queries, values, and inputs with a one, of each class and of each place: scoring adds two rows
        where training multiplies by the weights."""
        side = np.concatenate([self._side(), np.eye(WIDTH, WIDTH + 1, dtype=self.embed.dtype)], axis=1)
        of_place = self.place @ side
        of_place[:, -1] = 1
        return self.embed @ side, of_place

    def log_probs(self, c: np.ndarray, y: np.ndarray, real: np.ndarray, tables=None) -> np.ndarray:
        """Natural log probabilities of the real targets, in order; the output layer runs at these only,
        and queries at the last places only where no other is real in any window.
        tables: those of the weights as they are, made here if not given."""
        of_class, of_place = tables or self.tables()
        t = of_class.take(c, 0)
        t += of_place
        low = int(real.any(axis=0).argmax())
        k, v = t[:, :, 2 * WIDTH : 3 * WIDTH], t[:, :, WIDTH : 2 * WIDTH]
        a, total = self._weights(t[:, low:, :WIDTH], k)
        m = a.transpose(0, 2, 1) @ v
        m /= total.transpose(0, 2, 1)
        k[:, low:] += m
        y = y[real]
        order, group, ends = self._grouped(y)
        t, z = self._scores(t.reshape(-1, t.shape[-1])[np.flatnonzero(real)[order], 2 * WIDTH :], ends)
        nth = np.arange(len(y))
        got = t[group, nth] + z[y[order] % self.slots, nth]
        got -= np.log(np.exp(t, out=t).sum(axis=0) * np.exp(z, out=z).sum(axis=0))
        out = np.empty_like(got)
        out[order] = got
        return out

    def gradients(self, c: np.ndarray, y: np.ndarray, real: np.ndarray) -> list[np.ndarray]:
        """Of the real targets' mean negative log probability."""
        one, n, w = self.embed.dtype.type, len(c), WIDTH
        x = self.embed.take(c, 0)
        x += self.place
        flat, side = x.reshape(-1, w), self._side()
        qv = (flat @ side).reshape(n, CONTEXT, 2 * w)
        q, v = qv[:, :, :w], qv[:, :, w:]
        a, total = self._weights(q, x)
        a /= total
        m = a.transpose(0, 2, 1) @ v
        h = np.empty((n * CONTEXT, w + 1), x.dtype)
        np.add(flat, m.reshape(-1, w), out=h[:, :w])
        h[:, w] = 1
        at, y = np.flatnonzero(real), y[real]
        order, group, ends = self._grouped(y)
        at, h = at[order], h.take(at[order], 0)
        t, z = self._scores(h, ends)
        nth, share = np.arange(len(y)), one(1 / max(1, len(y)))
        for p, own in ((t, group), (z, y[order] % self.slots)):
            np.exp(p, out=p)
            p *= share / p.sum(axis=0)
            p[own, nth] -= share
        gtop, gout = t @ h, np.zeros_like(self.out)
        back = np.zeros((len(y) + 1, w), x.dtype)  # by target; the last row is for places without one
        np.matmul(t.T, self.top[:, :w], out=back[:-1])
        for g in range(self.groups):
            if ends[g] < ends[g + 1]:
                some = slice(ends[g], ends[g + 1])
                np.matmul(z[:, some], h[some], out=gout[g])
                back[some] += z[:, some].T @ self.out[g, :, :w]
        target = np.full(n * CONTEXT, len(y))
        target[at] = nth
        dh = back.take(target, 0).reshape(x.shape)
        da = v @ dh.transpose(0, 2, 1)
        da -= np.einsum("nij,nij->ni", dh, m)[:, None]  # each query's mean of da, by weight
        da *= a
        dqv = np.empty_like(qv)
        np.matmul(da.transpose(0, 2, 1), x, out=dqv[:, :, :w])
        np.matmul(a, dh, out=dqv[:, :, w:])
        dh += da @ q  # q is scaled already
        dx, dqv = dh.reshape(-1, w), dqv.reshape(-1, 2 * w)
        gside = flat.T @ dqv
        dx += dqv @ side.T
        order = np.argsort(c, axis=None, kind="stable")
        classes = c.ravel()[order]
        first = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]])
        gembed = np.zeros_like(self.embed)
        gembed[classes[first]] = np.add.reduceat(dx.take(order, 0), first)
        return [gembed, dh.sum(0), gside[:, :w] * one(w**-0.5), gside[:, w:], gtop, gout]


class Adam:
    def __init__(self, model: CausalModel, rate: float = 5e-3):
        self.model, self.rate, self.t = model, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in model.params()], [np.zeros_like(p) for p in model.params()]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        root = (1 - 0.99**self.t) ** 0.5
        rate, tiny = np.float32(self.rate * root / (1 - 0.9**self.t)), np.float32(1e-8 * root)
        for p, g, m, v in zip(self.model.params(), grads, self.m, self.v, strict=True):
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            v *= np.float32(0.99)
            g = g * g
            g *= np.float32(0.01)
            v += g
            np.sqrt(v, out=g)
            g += tiny
            np.divide(m, g, out=g)
            g *= rate
            p -= g


class Vocabulary:
    """Input and output classes of subword ids, and each id's log share of its output class."""

    def __init__(self, counts: np.ndarray):
        """counts: how often each id occurs in the training text."""
        order = np.argsort(-counts, kind="stable")
        tier = np.minimum(np.log2(counts + 1).astype(np.int64), 15)  # others: by frequency
        self.into, self.out = INPUTS + tier, OUTPUTS + tier
        self.into[order[:INPUTS]] = np.arange(INPUTS)
        self.out[order[:OUTPUTS]] = np.arange(OUTPUTS)
        self.into, self.out = self.into.astype(np.int16), self.out.astype(np.int16)
        self.inputs, self.outputs = INPUTS + 16, OUTPUTS + 16
        mass = counts + 0.5
        self.share = np.log(mass / np.bincount(self.out, weights=mass, minlength=self.outputs)[self.out])


def _spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray, paths) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each word) of the words at these places, as ``word_ids`` gives them.

    All are encoded in one text: a word's first id is then the only one whose bytes begin with a
    space. Where white space other than the space, or a special token, could join or split words,
    each is encoded alone.
    """
    if not len(start):
        return np.empty(0, np.uint16), np.empty(0, np.int64)
    length = end - start + 1
    at = np.cumsum(length) - length
    buffer = np.full(int(length.sum()), 32, np.uint8)
    inside = np.ones(len(buffer), bool)
    inside[at] = False
    buffer[inside] = data[np.arange(len(buffer)) + np.repeat(start - at - 1, length)][inside]
    text = buffer.tobytes().lower().decode("utf-8", "replace")
    special, fast = encoder(paths)
    if not _ODD_SPACE.search(text) and not any(t in text for t in special):
        ids = fast.encode_to_numpy(text, disallowed_special=())
        firsts = np.flatnonzero(_space_first(paths)[ids])
        if len(firsts) == len(start):
            return ids.astype(np.uint16), np.diff(firsts, append=len(ids))
    lists = word_ids(text[1:].split(" "), paths)
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.uint16, int(sizes.sum())), sizes


def _space_first(paths) -> np.ndarray:
    """Which ids' bytes begin with a space."""
    if paths not in _firsts:
        _, fast = encoder(paths)
        _firsts[paths] = np.zeros(IDS, bool)
        _firsts[paths][[i for i in range(fast.n_vocab) if fast.decode_single_token_bytes(i).startswith(b" ")]] = True
    return _firsts[paths]


def _subwords(data: np.ndarray, offsets: np.ndarray, paths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ids of each row, whether a token begins at an id): every row ends with END, a token."""
    start, end, row = word_spans(data, offsets)
    words, _ = word_hashes(data, offsets, spans=(start, end, row))
    rows = len(offsets) - 1
    _, first, back = np.unique(words, return_index=True, return_inverse=True)
    flat, sizes = _spelled(data, start[first], end[first], paths)
    begin = np.cumsum(sizes) - sizes
    length = sizes[back]
    out_at = np.cumsum(length) - length
    total = int(length.sum())
    src = np.arange(total) - np.repeat(out_at, length) + np.repeat(begin[back], length)
    per_row = np.bincount(row, weights=length, minlength=rows).astype(np.int64) if len(row) else np.zeros(rows, np.int64)
    ids = np.full(total + rows, END, np.uint16)
    ids[np.arange(total) + np.repeat(np.arange(rows), per_row)] = flat[src]
    token = np.zeros(len(ids), bool)
    token[out_at + row] = True
    token[np.cumsum(per_row + 1) - 1] = True
    return ids, per_row + 1, token


def _tokenised(docs: DataFrame, paths) -> DataFrame:
    """docs(doc_id, held_out, text) -> (doc_id, held_out, ids, begins), a row a row: the ids in two
    bytes each, and a bit for each that says whether a token begins there."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for i, j in doc_groups(offsets, GROUP):
                ids, sizes, token = _subwords(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], paths)
                width = (sizes + 7) // 8
                bits = np.zeros(int(width.sum()) * 8, bool)
                bits[np.flatnonzero(token) + np.repeat((np.cumsum(width) - width) * 8 - (np.cumsum(sizes) - sizes), sizes)[token]] = True
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i), binary_array(ids, sizes), binary_array(np.packbits(bits), width)], ["doc_id", "held_out", "ids", "begins"])

    return docs.mapInArrow(lean(run), "doc_id long, held_out boolean, ids binary, begins binary")


def _id_groups(batch: pa.RecordBatch):
    """(first row, rows, ids, ids of each row) of a batch, about half a million ids at a time."""
    data, offsets = text_buffers(batch.column("ids"))
    for i, j in doc_groups(offsets):
        yield i, j - i, data[offsets[i] : offsets[j]].view(np.uint16), np.diff(offsets[i : j + 1]) // 2


def _tokens(begins: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each token: a word is the ids that spell it, the end is END."""
    data, _ = text_buffers(begins)
    width = (sizes + 7) // 8
    at = np.flatnonzero(np.unpackbits(data))
    row = np.searchsorted(np.cumsum(width) * 8, at, side="right")
    start = at - ((np.cumsum(width) - width) * 8 - (np.cumsum(sizes) - sizes))[row]
    return SpanHash(ids).of(start, np.append(start[1:], len(ids))), row


def _batches(ids: np.ndarray, sizes: np.ndarray, overlap: int = OVERLAP, thin: int = 1, part: tuple[int, int] = (0, 1)):
    """(inputs, targets, real, row): overlapping windows in which each id is a real target once.
    thin: keep only the windows that _thinned names. part (which, of): keep every of-th window of a text,
    from a place that its size and first id tell; the parts 0 to of - 1 hold each window once."""
    step = CONTEXT - overlap
    counts = 1 + -(-np.maximum(sizes - CONTEXT, 0) // step)
    row = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    if thin > 1:
        kept = _thinned(row, thin)
        row, nth = row[kept], nth[kept]
    begin = np.cumsum(sizes) - sizes
    if part[1] > 1:
        kept = (nth + (sizes + ids[begin])[row]) % part[1] == part[0]
        row, nth = row[kept], nth[kept]
    at = nth[:, None] * step + np.arange(CONTEXT)
    real = (at < sizes[row][:, None]) & ((nth[:, None] == 0) | (np.arange(CONTEXT) >= overlap))
    place = begin[row][:, None] + np.minimum(at, (sizes[row] - 1)[:, None])
    target = ids[place]
    source = np.where(at == 0, START, ids[np.maximum(place - 1, 0)])
    return source, target, real, row


def _counts(ids: DataFrame) -> DataFrame:
    """(subword, key, c) of the ids that _tokenised made: how often each token (by its hash) and each
    subword id occurs."""

    def run(batches):
        have, sums, size, subwords = [], [], 0, np.zeros(IDS, np.int64)

        def merged():
            keys, back = np.unique(np.concatenate(have), return_inverse=True)
            return keys, np.bincount(back, weights=np.concatenate(sums)).astype(np.int64)

        def rows(subword: bool, keys: np.ndarray, c: np.ndarray):
            return pa.record_batch([pa.array(np.full(len(keys), subword)), pa.array(keys.view(np.int64)), pa.array(c)], ["subword", "key", "c"])

        for batch in batches:
            for i, n, own, sizes in _id_groups(batch):
                subwords += np.bincount(own, minlength=IDS)
                keys, c = np.unique(_tokens(batch.column("begins").slice(i, n), own, sizes)[0], return_counts=True)
                have.append(keys)
                sums.append(c)
                size += len(keys)
                if size > 1_000_000:
                    keys, c = merged()
                    if len(keys) > 500_000:
                        yield rows(False, keys, c)
                        have, sums, size = [], [], 0
                    else:
                        have, sums, size = [keys], [c], len(keys)
        if have:
            yield rows(False, *merged())
            some = np.flatnonzero(subwords)
            yield rows(True, some, subwords[some])

    return ids.select("ids", "begins").mapInArrow(lean(run), "subword boolean, key long, c long").groupBy("subword", "key").agg(F.sum("c").alias("c"))


def _thinned(row: np.ndarray, thin: int) -> np.ndarray:
    """Which windows are learned from: every thin-th of a document, one of each at least. row: each
    window's document; the first window differs from document to document."""
    counts = np.bincount(row)
    nth = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
    return nth % thin == row % np.minimum(thin, counts[row])


def _schedule(subwords: int, tasks: int, rounds: tuple[int, ...]) -> list[tuple[int, tuple[int, int]]]:
    """(thin, part) of each round, as _batches takes them: rounds of about so many steps a task on windows
    from all over each document, then as many of rounds[-1] steps as take every window once."""
    share = CONTEXT * BATCH * tasks
    of = max(1, -(-subwords // (share * rounds[-1])))
    return [(max(1, subwords // (share * steps)), (0, 1)) for steps in rounds[:-1]] + [(1, (which, of)) for which in range(of)]


def _train(ids: DataFrame, vocabulary: Vocabulary, subwords: int, rounds: tuple[int, ...]) -> CausalModel:
    """Rounds of local training and averaging, as _schedule gives them."""
    model = CausalModel(vocabulary.inputs, vocabulary.outputs)
    part = ids.select("ids")
    tasks = max(1, part.rdd.getNumPartitions())

    def learner(flat: np.ndarray, thin: int, which: tuple[int, int], rate: float):
        def run(batches):
            own = CausalModel(vocabulary.inputs, vocabulary.outputs)
            own.load(flat)
            adam, taken = Adam(own, rate), 0
            for batch in batches:
                for _, _, some, sizes in _id_groups(batch):
                    source, target, real, _ = _batches(some, sizes, 0, thin, which)
                    chosen = np.random.default_rng(taken).permutation(len(source))
                    for s in range(0, len(chosen), BATCH):
                        cut = chosen[s : s + BATCH]
                        adam.step(own.gradients(vocabulary.into[source[cut]], vocabulary.out[target[cut]], real[cut]))
                        taken += 1
            if taken:
                yield pa.record_batch([pa.array([int.from_bytes(np.random.bytes(1)) % 16], pa.int32()), pa.array([float(taken)]), pa.array([own.flat().astype(np.float64) * taken], pa.list_(pa.float64()))], ["bucket", "steps", "weights"])

        return lean(run)

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(w.values) for w in group["weights"]], axis=0)
        return pa.table({"bucket": pa.array([0], pa.int32()), "steps": [float(np.sum(group["steps"].to_numpy()))], "weights": pa.array([total], pa.list_(pa.float64()))})

    shape = "bucket int, steps double, weights array<double>"
    for nth, (thin, which) in enumerate(_schedule(subwords, tasks, rounds)):
        got = part.mapInArrow(learner(model.flat(), thin, which, RATE / min(1 + nth, 8)), shape).groupBy("bucket").applyInArrow(add, shape).toArrow()  # 16 rows at most
        if got.num_rows:
            model.load(np.sum([np.asarray(w.values) for w in got["weights"]], axis=0) / got["steps"].to_numpy().sum())
    return model


def score_documents(docs: DataFrame, held_out, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, n_subwords), a row per input row.

    held_out is a boolean column; all other rows train. In each of ``rounds`` but the last a task takes
    about that many steps of BATCH windows, spread over every one of its documents; then it takes every
    window of its documents once, in rounds of about rounds[-1] steps. base_score is the smoothed log10 unigram
    probability of the words and the end, score the model's. A null, empty or blank text is the
    end alone. Without training rows all counts are 0 and the model keeps its first weights. Other
    columns are ignored; rows that repeat an id score alike if their texts are equal.
    """
    given = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    ids = scratch(_tokenised(given, tokenizer_paths()), "ids", codec="zstd")
    learned = ids.where("NOT held_out")
    both = scratch(_counts(learned), "counts")
    counts = both.where("NOT subword").select(F.col("key").alias("token"), "c")
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, bottom = size["n"], np.log10(max(size["n"] + 0.5 * (size["v"] + 1), 0.5))
    # the counts up from some bound travel whole; the bound keeps them below KNOWN_WORDS
    steps = sorted((r["k"], r["count"]) for r in counts.groupBy(F.floor(F.log2("c") * 8).alias("k")).count().collect())
    bound, have = None, 0
    for k, n in reversed(steps):
        if have + n > KNOWN_WORDS:
            break
        bound, have = k, have + n
    frequent = F.lit(False) if bound is None else F.floor(F.log2("c") * 8) >= bound
    top = counts.where(frequent).toArrow()
    token = top["token"].to_numpy().view(U)
    order = np.argsort(token)
    token, c = token[order], top["c"].to_numpy()[order]
    got = both.where("subword").toArrow()  # the tokenizer's ids bound it
    subwords = np.zeros(IDS, np.int64)
    subwords[got["key"].to_numpy()] = got["c"].to_numpy()
    vocabulary = Vocabulary(subwords)
    model = _train(learned, vocabulary, int(subwords.sum()), rounds)
    ln10 = np.log(10)

    def run(batches):
        tables = model.tables()
        for batch in batches:
            for i, n, own, sizes in _id_groups(batch):
                source, target, real, wrow = _batches(own, sizes)
                score = np.zeros(n)
                # a text's first window has targets at all places, the others at their last
                for some in (real[:, 0], ~real[:, 0]):
                    at = np.flatnonzero(some)
                    for s in range(0, len(at), BATCH):
                        cut = at[s : s + BATCH]
                        y, own_real, where = target[cut], real[cut], wrow[cut]
                        lp = model.log_probs(vocabulary.into[source[cut]], vocabulary.out[y], own_real, tables) + vocabulary.share[y[own_real]]
                        part = np.bincount(np.repeat(where - where[0], own_real.sum(axis=1)), weights=lp)
                        score[where[0] : where[0] + len(part)] += part
                words, row = _tokens(batch.column("begins").slice(i, n), own, sizes)
                at = np.minimum(np.searchsorted(token, words), max(len(token) - 1, 0))
                found = token[at] == words if len(token) else np.zeros(len(words), bool)
                base = np.zeros(n) + np.bincount(row[found], weights=np.log10(c[at[found]] + 0.5) - bottom, minlength=n)
                rest = words[~found]
                per = np.bincount(row[~found], minlength=n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(rest.view(np.int64)))
                yield pa.record_batch(
                    [batch.column("doc_id").slice(i, n), batch.column("held_out").slice(i, n), pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row[found], minlength=n)), pa.array(base), pa.array(score / ln10), pa.array(sizes), lists],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_subwords", "rest"],
                )

    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_subwords long, rest array<long>"
    parts = scratch(ids.mapInArrow(lean(run), shape).withColumn("row", F.monotonically_increasing_id()), "parts", [ids])
    # words outside that table: their counts are joined, and come back as one row a document
    rare = parts.select("row", F.explode("rest").alias("token")).join(counts.where(~frequent), "token", "left")
    rare = rare.groupBy("row").agg(F.count("c").alias("more"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5) - F.lit(float(bottom))).alias("add"))
    out = parts.drop("rest").join(rare, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("add", F.lit(0.0))).alias("base_score"), "score", "n_subwords",
    )
