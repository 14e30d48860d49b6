"""Language identification by a byte-level convolutional network, trained and applied in numpy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_groups, lean, text_buffers

WINDOW = 256
WIDTHS = (2, 3, 4)
EMBED, FILTERS = 8, 8
_WORD = re.compile(r"[^\W\d_]")  # letters, and some numerals such as ² and ½


def has_letter(text: str | None) -> bool:
    """Whether any character is of a Unicode letter category."""
    return text is not None and any(m[0].isalpha() for m in _WORD.finditer(text))


class ByteConvNet:
    """Embedded bytes, filters of several widths, max pooling over the window, softmax."""

    def __init__(self, classes: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        span, out = max(WIDTHS), FILTERS * len(WIDTHS)
        self.mask = np.zeros((span * EMBED, out), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
        self.conv = (r.normal(0, 0.3, (span * EMBED, out)).astype(np.float32)) * self.mask
        self.bias = np.zeros(out, np.float32)
        self.dense = r.normal(0, 0.3, (out, classes)).astype(np.float32)
        self.shift = np.zeros(classes, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.dense, self.shift]

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.embed[x]
        n, length, _ = e.shape
        span = max(WIDTHS)
        view = np.lib.stride_tricks.sliding_window_view(e, span, axis=1)
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(n, length - span + 1, span * EMBED)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = self._columns(x)
        z = cols.reshape(-1, cols.shape[2]) @ self.conv
        z = z.reshape(cols.shape[0], cols.shape[1], -1)
        return z, cols, np.maximum(z.max(axis=1) + self.bias, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = self.pooled(x)[2] @ self.dense + self.shift
        h = np.exp(h - h.max(axis=1, keepdims=True))
        return h / h.sum(axis=1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 3e-3, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        m = [np.zeros_like(p) for p in self.params()]
        v = [np.zeros_like(p) for p in self.params()]
        t, span = 0, max(WIDTHS)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for s in range(0, len(x), batch):
                xb, yb = x[order[s : s + batch]], y[order[s : s + batch]]
                z, cols, h = self.pooled(xb)
                out = h @ self.dense + self.shift
                p = np.exp(out - out.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                d = p
                d[np.arange(len(yb)), yb] -= 1
                d /= len(yb)
                gh = (d @ self.dense.T) * (h > 0)
                top = z.argmax(axis=1)
                picked = cols[np.arange(len(xb))[:, None], top]
                gconv = np.einsum("nok,no->ko", picked, gh) * self.mask
                gcols = gh[:, :, None] * self.conv.T[None]
                gembed = np.zeros_like(self.embed)
                place = top[:, :, None] + np.arange(span)[None, None]
                np.add.at(gembed, xb[np.arange(len(xb))[:, None, None], place].ravel(), gcols.reshape(-1, EMBED))
                t += 1
                for p_, g, m_, v_ in zip(self.params(), (gembed, gconv, gh.sum(0), h.T @ d, d.sum(0)), m, v, strict=True):
                    m_ += 0.1 * (g - m_)
                    v_ += 0.001 * (g * g - v_)
                    p_ -= rate * (m_ / (1 - 0.9**t)) / (np.sqrt(v_ / (1 - 0.999**t)) + 1e-8)


def _windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded fixed-length windows that cover every text once: (windows, row, bytes in each)."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    first = np.repeat(offsets[:-1], counts) + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts))
    length = np.minimum(WINDOW, offsets[1:][row] - first)
    at = first[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < length[:, None]
    x = np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))].astype(np.int16) + 1, 0) if len(row) else np.zeros((0, WINDOW), np.int16)
    return x, row, length


def training_windows(docs: DataFrame, max_docs: int, per_doc: int):
    """(windows, language of each) of at most ``max_docs`` labelled texts, those of the smallest id
    hashes: ``per_doc`` windows from all over each text, or all that a shorter one has. Rows that
    share an id or have none share a hash; ``max_docs * per_doc`` windows come to the driver at most."""
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", F.xxhash64("doc_id", F.lit(11)).alias("h"))
    limit = known.select("h").orderBy("h").limit(max_docs).agg(F.max("h").alias("h")).first()["h"]
    if limit is None:
        return np.zeros((0, WINDOW), np.int16), []

    def cut(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for i, j in doc_groups(offsets):
                x, row, _ = _windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                total = np.bincount(row, minlength=j - i)[row]
                keep = rank * per_doc // np.maximum(total, 1) != (rank - 1) * per_doc // np.maximum(total, 1)
                yield pa.record_batch([pa.array([r.tobytes() for r in x[keep]], pa.binary()), batch.column("lang").take(pa.array(row[keep] + i)), batch.column("h").take(pa.array(row[keep] + i))], ["x", "lang", "h"])

    got = known.where(F.col("h") <= F.lit(limit)).select("text", "lang", "h").mapInArrow(lean(cut), "x binary, lang string, h long")
    got = got.orderBy("h", "x").limit(max_docs * per_doc).toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.int16).reshape(-1, WINDOW)
    return x, got["lang"].to_pylist()


def train_language_model(docs: DataFrame, max_docs: int = 2500, per_doc: int = 6) -> tuple[ByteConvNet | None, list[str]]:
    """The network and its languages, fitted on a bounded sample of the labelled rows of
    docs(doc_id, text, lang, ...): ``per_doc`` windows of each of ``max_docs`` texts. Null texts and
    languages teach nothing; without any labelled row there is no network and no language."""
    x, lang = training_windows(docs, max_docs, per_doc)
    classes = sorted(set(lang))
    if not classes:
        return None, []
    net = ByteConvNet(len(classes))
    net.train(x, np.searchsorted(classes, lang))
    return net, classes


def identify_language(docs: DataFrame, net: ByteConvNet | None, classes: list[str], extra: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, lang_pred, score, *extra): a row per input row.

    The whole text is cut into fixed windows; their probabilities are averaged by bytes. ``und``
    with score 0 for a null or empty text, one without a letter, or a model without classes.
    """
    extra = extra or []
    names = pa.array([*classes, "und"])

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            n = batch.num_rows
            p = np.zeros((n, max(len(classes), 1)))
            if net is not None:
                for i, j in doc_groups(offsets, 1 << 18):
                    x, row, length = _windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    for s in range(0, len(x), 512):
                        q = net.probabilities(x[s : s + 512]) * length[s : s + 512, None]
                        np.add.at(p, row[s : s + 512] + i, q)
            letters = np.array([has_letter(t) for t in batch.column("text").to_pylist()], bool)
            total = p.sum(axis=1)
            known = letters & (total > 0)
            best = np.where(known, p.argmax(axis=1), len(classes))
            score = np.where(known, p.max(axis=1) / np.maximum(total, 1e-300), 0.0)
            yield pa.record_batch([batch.column("doc_id"), names.take(pa.array(best)), pa.array(np.minimum(score, 1.0)), *[batch.column(c) for c in extra]], ["doc_id", "lang_pred", "score", *extra])

    kinds = dict(docs.select(*extra).dtypes)
    schema = ", ".join(["doc_id long", "lang_pred string", "score double", *[f"`{c}` {kinds[c]}" for c in extra]])
    return docs.select("doc_id", "text", *[c for c in extra if c not in ("doc_id", "text")]).mapInArrow(lean(run), schema)
