"""Evaluation passages that leaked into documents, verbatim or with other parameters.

Texts are brought to templates: numbers, units and names become typed placeholders, as the text itself shows them (a
unit is what follows a number, a name has capitals within a sentence or is part of an identifier). Windows of a template
are hashed; the windows of the evaluation items make a table that the windows of the documents are joined with. For
windows that meet, the values in the slots are compared: equal values make a verbatim leak; other values that replace
each other one to one, the same everywhere in the window, make a re-parameterised one.

Each window has a template without names too, which depends on its lower-cased words only; so a passage is found in any
spelling. Items and documents stay on the executors; the driver holds a bitmap of fixed size of the items' hashes, which
spares documents' windows that no item has the join.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamspark.llm.words import words
from loamspark.session import materialize

#: Words that a passage must have in a row in common.
WINDOW = 12
#: Words of a window outside of slots that a re-parameterised passage must have in common.
LITERAL = 6
#: Log 2 of the bits in the bitmap of the items' window hashes.
MAP_BITS = 23
#: Windows of items that are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000
#: Words that aren't units though they follow a number (fixed values).
NOT_UNITS = frozenset("a an and are as at but by for from had has have if in into is it its more no not of on or so than that the their then they this to was we were when which while who will with".split())
VERBATIM, REPARAMETERISED = "verbatim", "reparameterised"
WORD, NUMBER, UNIT, NAME = range(4)

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_TOKEN = re.compile(r"[^\W_]+")
_INNER_CAPITAL = re.compile(r"[^\W\d_]*[a-zß-ÿ][A-Z]")
_SENTENCE_END = re.compile(r"[.!?:\n•|]")
_WINDOWS = "h long, words array<long>, slots array<long>, named boolean, literal int"


def kinds(text: str | None) -> tuple[list[str], list[int]]:
    """Words of a text, as words() has them, and what each is: WORD, NUMBER or NAME (units depend on the window)."""
    found = words(text)
    plain = [NUMBER if any(map(str.isdigit, w)) else WORD for w in found]
    raw = text if not text or text.isascii() else unicodedata.normalize("NFKC", text)
    spans = [m.span() for m in _TOKEN.finditer(raw or "")]
    if len(spans) != len(found):  # lower-casing changed what a word is; such a text shows no names
        return found, plain
    raw, before = f"{raw}  ", 0
    for i, (lo, hi) in enumerate(spans):
        if plain[i] == WORD:
            first = raw[lo - 1] if lo else " "
            glued = first in "_/`" or raw[hi] in "_/`" or (raw[hi] == "." and raw[hi + 1].isalnum()) or (first == "." and lo > 1 and raw[lo - 2].isalnum())
            if glued or (raw[lo:hi] != found[i] and (_INNER_CAPITAL.match(raw[lo:hi]) or (i and raw[lo].isupper() and not _SENTENCE_END.search(raw[before:lo])))):
                plain[i] = NAME
        before = hi
    return found, plain


def slots_agree(a: list[str], b: list[str]) -> str | None:
    """Of two windows with the same template: how their slots relate; None if values don't map one to one."""
    if a == b:
        return VERBATIM
    pairs = set(zip(a, b, strict=True))
    return REPARAMETERISED if len(pairs) == len(set(a)) == len(set(b)) else None


def _rolled(inner: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each WINDOW values in a row; the first value of a window is taken from `first`."""
    n = len(inner) - WINDOW + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(WINDOW if n > 0 else 0):
        out = out * _MULTIPLY + (inner if j else first)[j : j + n]
    return out ^ (out >> np.uint64(31))


class _Vocabulary(dict):
    """Word -> number; hash of each number, and whether it may be a unit."""

    def __init__(self) -> None:
        self.hashes, self.units = [], []

    def __missing__(self, word: str) -> int:
        self.hashes.append(xxhash.xxh64_intdigest(word))
        self.units.append(word.isalpha() and word not in NOT_UNITS)
        self[word] = len(self.hashes) - 1
        return self[word]


def _windows(key: str, bitmap=None):
    """Rows (key, h, words, slots, named, literal) of the windows of each text; of those in the bitmap if there is one.

    words are the hashes of all words of the window, slots of those in placeholders. A window with names comes with its
    template without names as well.
    """
    mark = [np.uint64(xxhash.xxh64_intdigest(x)) for x in ("", "<number>", "<unit>", "<name>")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint64)
        vocabulary = _Vocabulary()
        for b in batches:
            if len(vocabulary) > 500_000:
                vocabulary = _Vocabulary()
            texts = [kinds(t) for t in b["text"].to_pylist()]
            sizes = np.array([len(t[0]) for t in texts], np.int64)
            number = np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(t[0] for t in texts)), np.int64, int(sizes.sum()))
            kind = np.fromiter(chain.from_iterable(t[1] for t in texts), np.int8, len(number))
            if len(number) < WINDOW:
                continue
            word = np.array(vocabulary.hashes, np.uint64)[number]
            after = np.append(False, kind[:-1] == NUMBER) & np.array(vocabulary.units, bool)[number] & (kind != NUMBER)
            plain = np.where(kind == NUMBER, NUMBER, WORD)
            inner = np.where(after, UNIT, plain)
            place = lambda k: np.select([k == NUMBER, k == UNIT, k == NAME], mark[1:], word)
            text = np.repeat(np.arange(len(texts)), sizes)
            whole = text[: len(text) - WINDOW + 1] == text[WINDOW - 1 :]
            some = np.lib.stride_tricks.sliding_window_view
            for named in (False, True):
                k_inner, k_first = (np.where((k == WORD) & (kind == NAME), NAME, k) if named else k for k in (inner, plain))
                h = _rolled(place(k_inner), place(k_first))
                fit = whole & some(kind == NAME, WINDOW).any(1) if named else whole
                if bits is not None:
                    at = h & np.uint64((1 << MAP_BITS) - 1)
                    fit = fit & ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
                for at in np.array_split(np.nonzero(fit)[0], max(1, -(-int(fit.sum()) // 20_000))):
                    if not len(at):
                        continue
                    here = some(word, WINDOW)[at]
                    slot = some(k_inner, WINDOW)[at] != WORD
                    slot[:, 0] = k_first[at] != WORD
                    ends = np.append(0, np.cumsum(slot.sum(1))).astype(np.int32)
                    every = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * WINDOW), pa.array(here.ravel().view(np.int64)))
                    yield pa.record_batch(
                        [b[key].take(pa.array(text[at])), pa.array(h[at].view(np.int64)), every, pa.ListArray.from_arrays(pa.array(ends), pa.array(here[slot].view(np.int64))), pa.array(np.full(len(at), named)), pa.array(WINDOW - slot.sum(1), pa.int32())],
                        ["key", "h", "words", "slots", "named", "literal"],
                    )

    return run


def _bitmap(hashes: DataFrame) -> bytes:
    """The lowest bits of all hashes, as a bitmap of 2 ** MAP_BITS: at most as many rows as it has words are collected."""
    at = F.col("h").bitwiseAND((1 << MAP_BITS) - 1)
    rows = hashes.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h & 63 AS INT))")).alias("b")).collect()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for r in rows:
        out[r.w] = r.b
    return out.tobytes()


def _one_to_one(a: Column, b: Column) -> Column:
    """slots_agree() of two columns of slot values, beyond equality."""
    pairs = F.size(F.array_distinct(F.arrays_zip(a, b)))
    return (pairs == F.size(F.array_distinct(a))) & (pairs == F.size(F.array_distinct(b)))


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, verbatim, reparameterised): windows of each kind that a document shares with an item.

    Whole texts are searched; null, empty and shorter texts share nothing. Items without a row of WINDOW words leak
    nowhere. Equal windows of an item count once, equal windows of a document each time. Documents don't move but for
    windows that an item has; items given twice count once.
    """
    spark = documents.sparkSession
    long_enough = F.length("text") > 2 * WINDOW - 2
    table = items.where(F.col("item_id").isNotNull() & long_enough).select(F.col("item_id").cast("long").alias("item_id"), "text")
    table = materialize(table.mapInArrow(_windows("item_id"), f"key long, {_WINDOWS}").distinct().withColumnRenamed("key", "item_id"), "item-windows")
    shared = spark.sparkContext.broadcast(_bitmap(table.select("h")))
    docs = documents.where(long_enough).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # equal windows of a document meet in the task that read it, before they are joined
    windows = docs.mapInArrow(_windows("doc_id", shared), f"key long, {_WINDOWS}").groupBy("key", "h", "words", "slots", "named", "literal").agg(F.count(F.lit(1)).alias("times"))
    there = table.select("item_id", "h", "named", F.col("words").alias("of_words"), F.col("slots").alias("of_slots"))
    if table.count() <= BROADCAST_WINDOWS:
        there = F.broadcast(there)
    met = windows.join(there, ["h", "named"])
    same = F.col("words") == F.col("of_words")
    other = ~same & (F.col("literal") >= LITERAL) & _one_to_one(F.col("slots"), F.col("of_slots"))
    # a window that is verbatim without names is the same one with names; other parameters count once, by either
    counted = met.where(same & ~F.col("named") | other).groupBy(F.col("key").alias("doc_id"), "item_id", "words").agg(F.max("times").alias("times"), F.bool_or(same).alias("same"))
    times = lambda c: F.sum(F.when(c, F.col("times")).otherwise(0))
    return counted.groupBy("doc_id", "item_id").agg(times(F.col("same")).alias(VERBATIM), times(~F.col("same")).alias(REPARAMETERISED))
