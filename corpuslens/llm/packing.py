"""Packing of token pieces into fixed-length sequences by best two fit."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, scratch

END_ID = 2
SHARD_PIECES = 4096
_encoders: dict[str, tuple] = {}


def tokenizer_paths() -> tuple[str, str]:
    """The public byte-level BPE as a tokenizers file, and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_ids(text: str, paths: tuple[str, str]) -> list[int]:
    """Ids as the tokenizers file gives them. The ranks give the same ids several times faster; a
    text that holds a special token's string goes through the file itself."""
    special, fast = encoder(paths)
    if any(s in text for s in special):
        return _encoders[paths[0]][0].encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def encoder(paths: tuple[str, str]):
    """(strings of special tokens, encoder by the ranks), read once a process."""
    if paths[0] not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(paths[0])
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        with open(paths[1], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[paths[0]] = whole, special, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[paths[0]][1:]


def word_ids(words: list[str], paths: tuple[str, str]) -> list[list[int]]:
    """token_ids of each word with a leading space; special tokens are sought in all at once."""
    special, fast = encoder(paths)
    joined = " " + "\n ".join(words)
    if any(s in joined for s in special):
        return [token_ids(" " + w, paths) for w in words]
    return [fast.encode_ordinary(" " + w) for w in words]


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; every length is from 1 to capacity.

    A bin takes the longest piece that still fits, again and again. Then its smallest piece makes
    way for two unpacked ones if those fill the widened gap more tightly.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, n in enumerate(lengths.tolist()):
        stacks[n].append(i)
    left = np.array([len(s) for s in stacks])
    sizes = np.arange(capacity + 1)
    below = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # the longest available up to each size
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def take(n: int) -> None:
        nonlocal below
        left[n] -= 1
        if not left[n]:
            below = np.maximum.accumulate(np.where(left > 0, sizes, 0))

    b = 0
    while below[capacity]:
        own, gap = [], capacity
        while gap and (n := int(below[gap])):
            own.append(n)
            take(n)
            gap -= n
        if gap and len(own) > 1:
            room = gap + own[-1]
            first = sizes[1:room][left[1:room] > 0]
            second = below[room - first]
            # the same length twice needs two pieces of it
            alone = (second == first) & (left[first] < 2)
            second = np.where(alone, np.where(first > 1, below[np.maximum(first - 1, 0)], 0), second)
            both = np.where(second > 0, first + second, 0)
            if len(both) and both.max() > own[-1]:
                k = int(both.argmax())
                smallest = own.pop()
                for n in (int(first[k]), int(second[k])):
                    own.append(n)
                    take(n)
                left[smallest] += 1
                below = np.maximum.accumulate(np.where(left > 0, sizes, 0))
        at = 0
        for n in own:
            i = stacks[n].pop()
            where[i], offset[i] = b, at
            at += n
        b += 1
    return where, offset


def token_pieces(docs: DataFrame, capacity: int, paths: tuple[str, str]) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and the end id; one longer
    than capacity is cut into full pieces, the first of which may be shorter."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*token_ids(text or "", paths), END_ID], "<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                cuts = [0, *range(first, len(ids), capacity), len(ids)]
                for k in range(len(cuts) - 1):
                    raw = ids[cuts[k] : cuts[k + 1]].tobytes()
                    rows.append((doc, k, cuts[k], cuts[k + 1] - cuts[k], zlib.crc32(raw)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, capacity: int = 1024, paths: tuple[str, str] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Pieces are dealt by a hash to shards of about SHARD_PIECES, each packed by ``best_two_fit``; so
    many pieces fill all but the last few sequences. A null or empty text is the end id alone.
    Repeated rows and null ids are pieces like any others. An empty table gives no rows.
    """
    pieces = scratch(token_pieces(docs, capacity, paths or tokenizer_paths()), "pieces")
    shards = max(1, -(-pieces.count() // SHARD_PIECES))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        b, offset = best_two_fit(group["length"].to_numpy(), capacity)
        shard = group["shard"][0].as_py()
        return group.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(b + (shard << 32))).append_column("offset", pa.array(offset))

    return dealt.groupBy("shard").applyInArrow(pack, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
