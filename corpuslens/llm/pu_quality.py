"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_groups, lean, text_buffers
from .hashing import mix, word_hashes, word_spans

_CLASS = np.zeros(256, np.int64)  # 0: other
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:", b"!?", b"#*$%&|<>", b"\"'()[]{}-_/@=+~^\\`"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[0x80:] = 10
N_CLASS = 11
FEATURES = N_CLASS + 7


def features(column) -> np.ndarray:
    """A row of counts and ratios for each whole text: byte classes, word lengths, repetition."""
    data, offsets = text_buffers(column)
    out = np.zeros((len(offsets) - 1, FEATURES))
    for i, j in doc_groups(offsets):
        own, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = j - i
        size = np.maximum(np.diff(offs), 1)
        row = np.repeat(np.arange(n), np.diff(offs))
        counts = np.bincount(row * N_CLASS + _CLASS[own], minlength=n * N_CLASS).reshape(n, N_CLASS)
        out[i:j, :N_CLASS] = counts / size[:, None]
        start, end, wr = word_spans(own, offs)
        words = np.bincount(wr, minlength=n)
        some = np.maximum(words, 1)
        length = (end - start).astype(float)
        mean = np.bincount(wr, weights=length, minlength=n) / some
        out[i:j, N_CLASS] = np.log1p(words)
        out[i:j, N_CLASS + 1] = mean
        out[i:j, N_CLASS + 2] = np.sqrt(np.maximum(np.bincount(wr, weights=length**2, minlength=n) / some - mean**2, 0))
        h, wr = word_hashes(own, offs)
        order = np.lexsort((h, wr))
        s, r = h[order], wr[order]
        new = np.r_[True, (s[1:] != s[:-1]) | (r[1:] != r[:-1])][: len(s)]
        distinct = np.bincount(r[new], minlength=n)
        out[i:j, N_CLASS + 3] = distinct / some
        out[i:j, N_CLASS + 4] = np.log1p(distinct) / np.log1p(some)
        twice = (h[1:] == h[:-1]) & (wr[1:] == wr[:-1])
        out[i:j, N_CLASS + 5] = np.bincount(wr[1:][twice], minlength=n) / some
        if len(h) > 1:
            pair = mix(h[:-1] + mix(h[1:]))
            pr = np.where(wr[1:] == wr[:-1], wr[1:], -1)
            order = np.lexsort((pair, pr))
            s, r = pair[order], pr[order]
            old = (s[1:] == s[:-1]) & (r[1:] == r[:-1]) & (r[1:] >= 0)
            out[i:j, N_CLASS + 6] = np.bincount(r[1:][old], minlength=n) / some
    return out


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


class PuNet:
    """A two-layer network; score is its estimated probability of class 1."""

    def __init__(self, seed: int = 5, hidden: int = 16):
        r = np.random.default_rng(seed)
        self.w1, self.b1 = r.normal(0, 0.4, (FEATURES, hidden)), np.zeros(hidden)
        self.w2, self.b2 = r.normal(0, 0.4, (hidden, 1)), np.zeros(1)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def params(self):
        return [self.w1, self.b1, self.w2, self.b2]

    def _inputs(self, f):
        return np.clip((f - self.mean) / self.scale, -6, 6)

    def _forward(self, x):
        h = np.tanh(x @ self.w1 + self.b1)
        return h, (h @ self.w2 + self.b2)[:, 0]

    def score(self, f: np.ndarray) -> np.ndarray:
        return _sigmoid(self._forward(self._inputs(f))[1])

    def _descend(self, positive: np.ndarray, unlabelled: np.ndarray, slopes, epochs: int, batch: int = 256, rate: float = 0.01, seed: int = 5) -> None:
        """Steps of Adam along the slopes(gp, gu) of a risk in the outputs for positive and unlabelled rows."""
        self.mean, self.scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
        p, u = self._inputs(positive), self._inputs(unlabelled)
        r = np.random.default_rng(seed)
        m, v, t = [np.zeros_like(a) for a in self.params()], [np.zeros_like(a) for a in self.params()], 0
        for _ in range(epochs):
            order = r.permutation(len(u))
            for s in range(0, len(u), batch):
                xu, xp = u[order[s : s + batch]], p[r.integers(0, len(p), batch)]
                (hp, gp), (hu, gu) = self._forward(xp), self._forward(xu)
                dp, du = slopes(gp, gu)
                grads = [0, 0, 0, 0]
                for x, h, d in ((xp, hp, dp), (xu, hu, du)):
                    back = (d[:, None] * self.w2.T) * (1 - h * h)
                    for k, g in enumerate((x.T @ back, back.sum(0), h.T @ d[:, None], d.sum()[None])):
                        grads[k] = grads[k] + g
                t += 1
                for a, g, m_, v_ in zip(self.params(), grads, m, v, strict=True):
                    m_ += 0.1 * (g - m_)
                    v_ += 0.001 * (g * g - v_)
                    a -= rate * (m_ / (1 - 0.9**t)) / (np.sqrt(v_ / (1 - 0.999**t)) + 1e-8)

    def contrast(self, positive: np.ndarray, unlabelled: np.ndarray, epochs: int = 20) -> None:
        """Learn to tell positive rows from unlabelled ones."""
        self._descend(positive, unlabelled, lambda gp, gu: ((_sigmoid(gp) - 1) / len(gp), _sigmoid(gu) / len(gu)), epochs)

    def train(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60) -> None:
        """Minimise prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]), l the logistic loss.
        Where a batch's second part falls below 0, its gradient is followed upwards instead."""

        def slopes(gp, gu):
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            if negative >= 0:
                return prior * (_sigmoid(gp) - 1) / len(gp) - prior * _sigmoid(gp) / len(gp), _sigmoid(gu) / len(gu)
            return prior * _sigmoid(gp) / len(gp), -_sigmoid(gu) / len(gu)

        self._descend(positive, unlabelled, slopes, epochs)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The share of the positive class among unlabelled rows, from positive and unlabelled rows alone.

    A classifier of the one against the other is fitted on half of both. On the other half, above
    any score, unlabelled rows can hold no more positives than there are rows; so the share is at
    most the ratio of the two tails, and the score is taken where the ratio's upper bound is least.
    """
    net = PuNet()
    net.contrast(positive[::2], unlabelled[::2])
    p, u = np.sort(net.score(positive[1::2])), np.sort(net.score(unlabelled[1::2]))
    if not len(p) or not len(u):
        return 0.5
    at = np.unique(p)
    tail_p = 1 - np.searchsorted(p, at) / len(p)
    tail_u = 1 - np.searchsorted(u, at) / len(u)
    slack = np.sqrt(np.log(4 / doubt) / (2 * len(u))) + np.sqrt(np.log(4 / doubt) / (2 * len(p)))
    best = int(np.argmin((tail_u + 1.01 * slack) / tail_p))
    return float(np.clip(tail_u[best] / tail_p[best], 0.01, 0.99))


def _sample(docs: DataFrame, labels: DataFrame, max_docs: int) -> pa.Table:
    """Features of at most max_docs texts of any sort and of max_docs texts with label 1 (columns
    ``any`` and ``positive`` say which), those of the smallest id hashes; 2 * max_docs rows at most."""
    h = F.xxhash64("doc_id", F.lit(3)).alias("h")
    marked = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    last = docs.select(h).orderBy("h").limit(max_docs).agg(F.max("h").alias("h")).first()["h"]
    some = docs.select("doc_id", h).join(marked, "doc_id", "left_semi").orderBy("h").limit(max_docs).select("doc_id", F.lit(True).alias("positive")).distinct()

    def run(batches):
        for batch in batches:
            f = features(batch.column("text"))
            yield pa.record_batch([batch.column("h"), batch.column("any"), batch.column("positive"), pa.array(list(f), pa.list_(pa.float64()))], ["h", "any", "positive", "f"])

    # some has at most max_docs rows of one number
    drawn = docs.select("doc_id", "text", h).join(F.broadcast(some), "doc_id", "left").select("text", "h", (F.col("h") <= F.lit(last)).alias("any"), F.coalesce("positive", F.lit(False)).alias("positive"))
    return drawn.where("any OR positive").mapInArrow(lean(run), "h long, any boolean, positive boolean, f array<double>").orderBy("h", "f").limit(2 * max_docs).toArrow()


def train_quality_model(docs: DataFrame, labels: DataFrame, max_docs: int = 6000) -> PuNet | None:
    """Trusted positives: texts with label 1. Unlabelled text: a sample of all rows, whatever their
    label; label 0 is used nowhere. The class prior is estimated from the two. None if there is no
    positive. Both samples are bounded by ``max_docs``; rows that share an id share their place in them."""
    got = _sample(docs, labels, max_docs)
    f = np.array(got["f"].to_pylist()).reshape(-1, FEATURES)
    positive, sampled = got["positive"].to_numpy().astype(bool), got["any"].to_numpy().astype(bool)
    if not positive.any() or not sampled.any():
        return None
    net = PuNet()
    net.prior = estimate_prior(f[positive], f[sampled])
    net.train(f[positive], f[sampled], net.prior)
    return net


def score_quality(docs: DataFrame, net: PuNet | None, threshold: float = 0.3) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, score, predicted): a row per input row, from the whole
    text alone. Null and empty texts have the features of no text. Without a model the score is 0."""

    def run(batches):
        for batch in batches:
            f = features(batch.column("text"))
            score = net.score(f) if net is not None else np.zeros(len(f))
            yield pa.record_batch([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, score double, predicted int")
