"""Encoding of texts by a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's published pattern; within a word the adjacent pair of lowest rank merges
first, the leftmost of equal ones. A segment tree over the ranks of adjacent pairs holds that pair at its root; a
merge updates three leaves, so a word of n bytes takes O(n log n) however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Place of the vocabulary files; a parameter of every function that reads them.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Published pre-tokenisation pattern of the vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words a worker remembers, and the longest of them; others are merged afresh each time.
REMEMBERED, REMEMBERED_CHARS = 400_000, 48
NONE = 1 << 62


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merger:
    """Merges the bytes of one word."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}

    def pair(self, a: int, b: int) -> int:
        """Id, which is also the rank, of the token that a and b make; NONE if there is none."""
        found = self.pairs.get((a, b))
        if found is None:
            found = self.pairs[a, b] = self.ranks.get(self.token[a] + self.token[b], NONE)
        return found

    def merge(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        ids = [self.byte[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        size = 1 << (n - 1).bit_length()
        # a leaf is rank * size + place, so the least is the lowest rank, leftmost first
        none = NONE * size
        tree = [none] * (2 * size)
        pair = self.pair
        for i in range(n - 1):
            r = pair(ids[i], ids[i + 1])
            if r != NONE:
                tree[size + i] = r * size + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                least = a if a < b else b
                if tree[i] == least:
                    return
                tree[i] = least
                i >>= 1

        def rank_at(i: int) -> int:
            j = after[i]
            r = pair(ids[i], ids[j]) if j < n else NONE
            return none if r == NONE else r * size + i

        while tree[1] < none:
            rank, i = divmod(tree[1], size)
            j = after[i]
            ids[i] = rank
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            ids[j] = -1
            put(j, none)
            put(i, rank_at(i))
            if before[i] >= 0:
                put(before[i], rank_at(before[i]))
        return [x for x in ids if x >= 0]


class _Words(dict):
    """Word -> ids; remembers the words that come often."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.merger = Merger(ranks)

    def __missing__(self, word: str) -> list[int]:
        ids = self.merger.merge(word.encode("utf-8", "surrogatepass"))
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
                self.merger.pairs.clear()
            self[word] = ids
        return ids


def _encoder(ranks, key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, split = _Words(ranks.value), regex.compile(PATTERN).findall
        find = words.__getitem__
        for b in batches:
            flat, ends = [], [0]
            for t in b[text].to_pylist():
                if t:
                    flat.extend(chain.from_iterable(map(find, split(t))))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([b[key], ids], [key, "ids"])

    return run


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the text's token ids without special tokens; null and empty texts give an empty list.

    White space is encoded as it stands, strings that look like special tokens are ordinary text, other columns are
    not read, repeated rows come out as often as they come in.
    """
    # the vocabulary's size is fixed, about 50,000 entries
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    kind = dict(df.dtypes)[key]
    return df.select(key, F.col(text)).mapInArrow(_encoder(ranks, key, text), f"`{key}` {kind}, ids array<int>")
