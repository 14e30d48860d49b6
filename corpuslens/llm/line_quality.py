"""Line-first quality rules: bad lines go, then documents that lost too much text."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_groups, lean, text_buffers
from .hashing import shingles, word_hashes, word_spans

SPACES = " \t\n\x0b\x0c\r"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ENDS = tuple(".!?…。！？:;\"'”’»)]")
_BOILERPLATE = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "accept cookies", "cookie policy", "we use cookies", "copyright ©", "click here", "sign in", "sign up", "log in", "read more", "share this", "share on", "enable javascript", "lorem ipsum")
SPREAD = 25  # a line is boilerplate if such phrases make up one character in so many
_SEPARATOR = re.compile(r"[|»›•→]|\s[>/]\s")
_MARK = re.compile(r"[#*$%&|<>]")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]{3}")


def line_fails(line: str) -> str | None:
    """The first rule that a line with words breaks: symbols, navigation, boilerplate, shouting or
    punctuation; None if it breaks none."""
    separators = 0
    if _MARK.search(line) or _SEPARATOR.search(line):
        words = len(line.split())
        separators = len(_SEPARATOR.findall(line))
        if separators * 4 > words:
            return "navigation"
        if len(_MARK.findall(line)) * 10 > words + 9:
            return "symbols"
    low = line.lower()
    if sum(len(x) * low.count(x) for x in _BOILERPLATE if x in low) * SPREAD >= len(line):
        return "boilerplate"
    if _CAPITALS.search(line):
        upper = sum(map(str.isupper, line))
        if upper > 5 and upper * 2 > sum(map(str.isalpha, line)):
            return "shouting"
    if not line.rstrip(SPACES).endswith(_ENDS):
        return "punctuation"
    return None


def _base(column) -> list[np.ndarray]:
    """words, characters in words, symbols and words in repeated 5-word windows, by row."""
    data, offsets = text_buffers(column)
    rows = len(offsets) - 1
    out = [np.zeros(rows, np.int64) for _ in range(4)]
    for i, j in doc_groups(offsets):
        base = offsets[i]
        own, offs = data[base : offsets[j]], offsets[i : j + 1] - base
        start, end, row = word_spans(own, offs)
        total = lambda flags, of=offs: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[of])
        out[0][i:j] = np.bincount(row, minlength=j - i)
        point = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80, dtype=np.int64)])
        out[1][i:j] = np.bincount(row, weights=point[end] - point[start], minlength=j - i).astype(np.int64) if len(row) else 0
        out[2][i:j] = total(_SYMBOL[own])
        words, row = word_hashes(own, offs, lower=False)
        sh, rw, at = shingles(words, row, 5, whole_if_short=False)
        order = np.lexsort((sh, rw))
        s, r = sh[order], rw[order]
        same = (s[1:] == s[:-1]) & (r[1:] == r[:-1])
        often = at[order[np.r_[same, False] | np.r_[False, same]]] if len(s) else at
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, often, 1)
        np.add.at(edge, often + 5, -1)
        covered = np.cumsum(edge[:-1]) > 0
        out[3][i:j] = np.bincount(row[covered], minlength=j - i)
    return out


def quality_rules(docs: DataFrame, max_lost_percent: int = 50) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, lines_removed, chars_removed, text).

    Every line with a word is held against ``line_fails``; failing lines leave the text (which is
    the returned text). A document is kept if it passes the base rules on its whole original text
    (10 words at least, 20 % of them at most in repeated 5-word windows) and loses no more than
    ``max_lost_percent`` of its characters in lines. Null, empty and blank texts count 0 everywhere
    and fail the base rules. A row per input row; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            n, chars, symbols, repeat = _base(batch.column("text"))
            dup, removed, lost, whole, texts = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                lines = [x for x in (text or "").split("\n")]
                real = [x for x in lines if x.strip(SPACES)]
                bad = {x for x in set(real) if line_fails(x)}
                dup.append(len(real) - len(set(real)))
                removed.append(sum(x in bad for x in real))
                lost.append(sum(len(x) for x in real if x in bad))
                whole.append(sum(map(len, real)))
                texts.append("\n".join(x for x in lines if x not in bad) if bad else text)
            failed = (n < 10) | (100 * repeat > 20 * n)
            kept = ~failed & (100 * np.array(lost, np.int64) <= max_lost_percent * np.array(whole, np.int64))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n), pa.array(chars), pa.array(symbols), pa.array(dup, pa.int64()), pa.array(repeat), pa.array(failed), pa.array(kept), pa.array(removed, pa.int64()), pa.array(lost, pa.int64()), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_removed", "chars_removed", "text"],
            )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lines_removed long, chars_removed long, text string"
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)
