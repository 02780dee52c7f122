"""Deduplication of new batches against everything accepted, by content-defined chunks.

A text's words are cut where a rolling hash over a word's bytes meets a mask, so an edit changes only the chunks it
touches. A persistent table leads from chunks to the records that hold them: records that share a chunk are candidates,
the bytes of their shared chunks decide whether they are compared, and the distinct words of those that are left give
the verdict. Short texts, all of whose chunks a few edits may hit, are found by their rarest words in the same table,
which misses none. Accepted records go into the table; a batch reads only the buckets of its own chunks.

No chunk is left out for being frequent: the records of one that many hold are compared where they also share one of
their rarest other words, which no match can do without, and in tiles of bounded size.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.llm.words import words
from loamspark.operators.rows import current_rows
from loamspark.session import exists, materialize, scratch, table

#: Texts match from this share of common distinct words on, given as a fraction of whole numbers.
SHARE = (7, 10)
#: Texts with fewer distinct words never match.
LEAST_WORDS = 6
#: A word ends a chunk with probability 1 / CUT, unless the word before it did.
CUT, SEED = 2, 11
#: Texts of at most so many distinct words, and those that may match them, are found by their rarest words as well.
SHORT = 15
#: Words whose frequency ranks them; the others are rarer and ranked by hash. Any ranking gives the same matches.
RANKED = 65_536
#: The frequencies come from one of so many texts.
RANK_SAMPLE = 64
#: Rows of one key that are compared at once; keys with more are split into tiles of about so many by so many rows.
HOT = 16_384
#: Keys beyond HOT are found by counting one of so many classes.
COUNTED = 16
#: Of frequent keys, the words that most holders have are found in one of so many records, a multiple of COUNTED.
HELD_SAMPLE = 256
#: Records for each bucket of a store.
BUCKET_RECORDS = 65_536
#: Days of new records are matched together until they have so many, or this share of what is known from the start, so
#: that the passes over a store don't multiply with it: results are those of one day after another.
PASS_RECORDS, PASS_SHARE = 65_536, 4
#: Least share of the smaller text's bytes in shared chunks.
COVERAGE = 0.02
#: Rows of (at most) 16 bytes that are broadcast; more are joined.
BROADCAST_ROWS = 1_000_000
#: Layout of a tag: number of distinct words (at most TOP_WORDS), then a bitmap of their hashes.
WORD_BITS, MAP_BITS = 8, 54
TOP_WORDS = (1 << WORD_BITS) - 1
#: Tables of hashes, in which hardly a value recurs, are written without dictionaries but for the words.
_PLAIN = {"compression": "zstd", "parquet.enable.dictionary": "false"}
_FEATURES_PLAIN = {"compression": "zstd", **{f"parquet.enable.dictionary#{c}": "false" for c in ("id", "at", "cls_a", "cls_b", "tag", "keys.list.element")}}
#: Partitions of a table that a task writes at once instead of sorting its rows by them; beyond that it sorts.
WRITERS = 8

_FEATURES = "cls_a long, cls_b long, tag long, size int, words array<int>, keys array<long>"


_MULTIPLY = 0x9E3779B97F4A7C15
_TURN = pow(_MULTIPLY, -1, 1 << 64)


class _Vocabulary(dict):
    """Word -> number; of each number: hash, whether it ends a chunk, bytes with the space."""

    def __init__(self) -> None:
        self.hashes, self.ends, self.sizes = [], [], []

    def __missing__(self, w: str) -> int:
        data = w.encode("utf-8", "surrogatepass")
        self.hashes.append(xxhash.xxh64_intdigest(data))
        self.ends.append(xxhash.xxh64_intdigest(data, SEED) % CUT == 0)
        self.sizes.append(len(data) + 1)
        self[w] = len(self.hashes) - 1
        return self[w]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def _chunks(hashes: np.ndarray, ends: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last word, key) of each chunk of texts in a row; first marks where a text begins.

    A key is the hash of the chunk's words in the upper bits, and its bytes in the lowest eight. Chunks have two words
    at least, but for a text's last one: of words in a row that could end a chunk, every other one does.
    """
    at = np.arange(len(hashes))
    run = np.maximum.accumulate(np.where(ends & (first | ~np.append(False, ends[:-1])), at, -1))
    # a chunk has just ended before a text's first word, and two words ago at least before any other run
    cuts = ends & ((at - run) % 2 == first[np.maximum(run, 0)])
    cuts |= np.append(first[1:], True)
    last = np.nonzero(cuts)[0]
    start = np.append(0, last[:-1] + 1)
    up, down = _powers(_MULTIPLY, len(hashes)), _powers(_TURN, len(hashes))
    total = np.append(np.uint64(0), np.cumsum(hashes * down, dtype=np.uint64))
    h = (total[last + 1] - total[start]) * up[last]
    held = np.append(0, np.cumsum(sizes))
    few = np.minimum(held[last + 1] - held[start], 255).astype(np.uint64)
    return last, (h ^ (h >> np.uint64(29))) & np.uint64(0xFFFFFFFFFFFFFF00) | few


def payload_text(payload: str | None) -> str | None:
    """The claim's text in a discarded payload; null for broken JSON and where there is none."""
    try:
        found = json.loads(payload)
        text = found.get("text")
        text = found.get("normalized_text") if text is None else text
    except (ValueError, TypeError, AttributeError, RecursionError):
        return None
    return text if isinstance(text, str) else None


def _lists(row: np.ndarray, flat: pa.Array, rows: int) -> pa.ListArray:
    """Lists of a flat column whose values belong to rows in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), flat)


def _groups_sorted(row: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by row, then by the other keys; place within the row)."""
    order = np.lexsort((*by[::-1], row))
    at = row[order]
    return order, np.arange(len(row)) - np.searchsorted(at, at)


def _sorted_hashes(row: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) by row and hash, each once: one number orders nearly all, and a full sort those it leaves open."""
    bits = np.uint64(max(1, rows.bit_length()))
    order = np.argsort(row.astype(np.uint64) << (np.uint64(64) - bits) | hashes >> bits)
    row, hashes = row[order], hashes[order]
    same = row[1:] == row[:-1]
    if (same & (hashes[1:] < hashes[:-1])).any():
        order = np.lexsort((hashes, row))
        row, hashes = row[order], hashes[order]
    once = np.append(True, ~same | (hashes[1:] != hashes[:-1]))[: len(row)]
    return row[once], hashes[once]


def _rarest(row: np.ndarray, words: np.ndarray, n: np.ndarray, ranks) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): so many of the rarest words of each short record that any match has one of them among its own."""
    num, den = SHARE
    some = np.nonzero((n * num <= SHORT * den)[row])[0]
    row, words = row[some], words[some]
    rank = np.zeros(len(words), np.int64)
    if ranks is not None and len(ranks[0]):
        known, counts = ranks
        w = (words >> np.uint64(32)).astype(np.int64)
        at = np.minimum(np.searchsorted(known, w), len(known) - 1)
        rank = np.where(known[at] == w, counts[at], 0)
    order, place = _groups_sorted(row, rank, words)
    row, words = row[order], words[order]
    keep = place < (n + (-n * num) // den + 1)[row]
    return row[keep], words[keep] & np.uint64(0xFFFFFFFFFFFFFF00) | np.uint64(255)


def _featurise(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary()
        for b in batches:
            texts = b["text"].to_pylist()
            if "payload" in b.schema.names:
                texts = [t if p is None else payload_text(p) for t, p in zip(texts, b["payload"].to_pylist(), strict=True)]
            if len(vocabulary) > 500_000:
                vocabulary = _Vocabulary()
            found = [words(t) for t in texts]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            number = np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
            hashes, ends, width = np.array(vocabulary.hashes, np.uint64)[number], np.array(vocabulary.ends, bool)[number], np.array(vocabulary.sizes, np.int64)[number]
            row = np.repeat(np.arange(len(found)), sizes)
            of, distinct = _sorted_hashes(row, hashes, len(found))
            enough = np.bincount(of, minlength=len(found)) >= LEAST_WORDS
            place = np.cumsum(enough) - 1
            keep = np.nonzero(enough)[0]
            distinct, of = distinct[enough[of]], place[of[enough[of]]]
            some = enough[row]
            hashes, ends, width, row = hashes[some], ends[some], width[some], place[row[some]]
            n, rows = np.bincount(of, minlength=len(keep)), len(keep)
            if not rows:
                continue
            starts = np.searchsorted(of, np.arange(rows))
            maps = np.bitwise_xor.reduceat(np.uint64(1) << distinct % np.uint64(MAP_BITS), starts)
            tags = (maps << np.uint64(WORD_BITS) | np.minimum(n, TOP_WORDS).astype(np.uint64)).view(np.int64)
            whole, cuts = distinct.tobytes(), (8 * np.append(starts, len(distinct))).tolist()
            cls = np.frombuffer(b"".join([xxhash.xxh128_digest(whole[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]), np.int64).reshape(-1, 2)
            last, keys = _chunks(hashes, ends, width, np.append(True, row[1:] != row[:-1]))
            rare_row, rare = _rarest(of, distinct, n, ranks.value if ranks else None)
            key_row, keys = _sorted_hashes(np.append(row[last], rare_row), np.append(keys, rare), rows)
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [
                    *[b[x].take(take) for x in ("id", "base", "at")], pa.array(cls[:, 0]), pa.array(cls[:, 1]), pa.array(tags), pa.array(np.bincount(row, width, rows).astype(np.int32)),
                    _lists(of, pa.array((distinct >> np.uint64(32)).astype(np.uint32).view(np.int32)), rows), _lists(key_row, pa.array(keys.view(np.int64)), rows),
                ],
                ["id", "base", "at", "cls_a", "cls_b", "tag", "size", "words", "keys"],
            )

    return run


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flat = [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) >> 32 for t in b["text"].to_pylist() for w in set(words(t))]
        yield pa.record_batch([pa.array(flat, pa.int64())], ["w"])


def word_ranks(texts: DataFrame):
    """Broadcast (words in order, frequencies) of the RANKED most frequent words in a sample of (id, text)."""
    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(RANK_SAMPLE)) == 0).select("text").mapInArrow(_word_hashes, "w long")
    rows = some.groupBy("w").count().where("count > 1").orderBy(F.desc("count"), "w").limit(RANKED).collect()  # bounded by RANKED
    rows.sort()
    return texts.sparkSession.sparkContext.broadcast((np.array([r.w for r in rows], np.int64), np.array([r["count"] for r in rows], np.int64)))


def records(texts: DataFrame, ranks=None) -> DataFrame:
    """Features of (id, base, at, text[, payload]); texts with fewer than LEAST_WORDS distinct words are left out.

    Records with the same set of distinct words are one class (cls_a, cls_b: 128 bits of hash). words holds 32 bits
    of each word's hash, keys those of its chunks and, for short texts, of its rarest words. ranks: word_ranks(), the
    same for all records of a store; none ranks words by their hashes.
    """
    cols = [c for c in ("id", "base", "at", "text", "payload") if c in texts.columns]
    return texts.where(F.col("id").isNotNull()).select(*cols).mapInArrow(_featurise(ranks), f"id string, base boolean, at long, {_FEATURES}")


CLS = ["cls_a", "cls_b"]


def _kept(df: DataFrame, label: str) -> DataFrame:
    """materialize(df) for tables of hashes."""
    return materialize(df, label, **_PLAIN)


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS rows of (at most) 16 bytes."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _one_of_each(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the first row of each class by (at, id), ids of the others). Only hashes move, and ids of classes with several."""
    several = _kept(rows.groupBy(*CLS).count().where("count > 1").select(*CLS), "several")
    if several.isEmpty():
        return rows, rows.select("id").where(F.lit(False))
    several = _small(several)
    first = rows.join(several, CLS, "left_semi").groupBy(*CLS).agg(F.min(F.struct("at", "id")).getField("id").alias("first"))
    copies = _kept(rows.select("id", *CLS).join(first, CLS).where("id <> first").select("id"), "copies")
    return rows.join(_small(copies), "id", "left_anti"), copies


def _limits() -> np.ndarray:
    """By (x, y) numbers of words: bits that the maps of matching texts differ in are fewer. 0: they never match."""
    num, den = SHARE
    x, y = np.ogrid[: TOP_WORDS + 1, : TOP_WORDS + 1]
    fewer = np.where(np.minimum(x, y) * den >= np.maximum(x, y) * num, (x + y) * (den - num) // (den + num) + 1, 0)
    fewer[TOP_WORDS], fewer[:, TOP_WORDS] = MAP_BITS + 1, MAP_BITS + 1
    return np.minimum(fewer, MAP_BITS + 1).astype(np.uint8)


#: Necessary conditions from sizes and word bitmaps of tags: no match is lost by them.
_LIMITS = _limits()
#: What a posting is to its tile: known, new, new to be compared with the others only, new for the others to compare.
KNOWN, NEW, SEEKING, SOUGHT = range(4)
#: A posting is a tag with its role in the two bits above.
_ROLE_BIT = WORD_BITS + MAP_BITS
#: Pairs that are compared at once: few enough to stay in a processor's cache.
_AT_ONCE = 1 << 17


def _posting(role: int) -> Column:
    return F.col("tag").bitwiseOR(F.lit(role - 4 * (role > 1)) * F.lit(1 << _ROLE_BIT).cast("long"))


def _pairs_of(k: np.ndarray, posting: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs (x new, y) of whole groups of postings of equal k, sorted by these."""
    starts = np.nonzero(np.append(True, k[1:] != k[:-1]))[0]
    sizes = np.diff(np.append(starts, len(k)))
    role, tag = posting >> np.uint64(_ROLE_BIT), posting & np.uint64((1 << _ROLE_BIT) - 1)
    n, maps = (tag & np.uint64(TOP_WORDS)).astype(np.int32), tag >> np.uint64(WORD_BITS)
    seeks, new = (role == NEW) | (role == SEEKING), role != KNOWN
    asked = np.add.reduceat(seeks.astype(np.int64), starts)

    def out(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        keep = (role[y] != SEEKING) & (x != y) & (~new[y] | (tag[x] <= tag[y]))
        x, y = x[keep], y[keep]
        return pa.record_batch([pa.array(tag[x].view(np.int64)), pa.array(tag[y].view(np.int64)), pa.array(new[y]), pa.array((k[x] & 255).astype(np.int32))], ["x", "y", "y_new", "n"])

    wide = asked * sizes > 4096
    for g in np.nonzero(wide)[0]:
        at, m = starts[g], sizes[g]
        every = maps[at : at + m]
        seeking = at + np.nonzero(seeks[at : at + m])[0]
        kinds, kind = np.unique(n[seeking], return_inverse=True)
        limits = _LIMITS[kinds[:, None], n[None, at : at + m]]
        step = max(1, _AT_ONCE // m)
        met = [i * m + np.flatnonzero(np.bitwise_count(maps[seeking[i : i + step], None] ^ every) < limits[kind[i : i + step]]) for i in range(0, len(seeking), step)]
        for i in range(0, len(met), 64):
            x, y = np.divmod(np.concatenate(met[i : i + 64]), m)
            yield out(seeking[x], at + y)
    group = np.repeat(np.arange(len(starts)), sizes)
    seeking = np.nonzero(seeks & ~wide[group] & (sizes[group] > 1))[0]
    ends = np.cumsum(sizes[group[seeking]])
    at = 0
    while at < len(seeking):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + _AT_ONCE)))
        some = seeking[at:to]
        m = sizes[group[some]]
        x = np.repeat(some, m)
        y = np.repeat(starts[group[some]] - (ends[at:to] - m - done), m) + np.arange(len(x))
        near = np.bitwise_count(maps[x] ^ maps[y]) < _LIMITS[n[x], n[y]]
        yield out(x[near], y[near])
        at = to


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (k, tag with role) sorted by k to pairs; a group has about 2 * HOT rows at most."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        now = [b["k"].to_numpy(), b["tag"].to_numpy()]
        now = now if held is None else [np.concatenate(z) for z in zip(held, now, strict=True)]
        last = int(np.searchsorted(now[0], now[0][-1]))
        held = [z[last:] for z in now]
        if last:
            yield from _pairs_of(now[0][:last], now[1][:last].view(np.uint64))
    if held is not None:
        yield from _pairs_of(held[0], held[1].view(np.uint64))


def _one_of(rows: DataFrame, n: int) -> DataFrame:
    """The rows of one of n tags; those of one of a multiple of n are among them."""
    return rows.where(F.pmod(F.xxhash64("tag"), F.lit(n)) == 0)


def _counted(some: DataFrame) -> DataFrame:
    """(k, n) of keys of one of COUNTED classes: about how many rows hold the keys that many do."""
    return some.select(F.explode("keys").alias("k")).groupBy("k").agg((F.count(F.lit(1)) * COUNTED).alias("n")).where(F.col("n") > COUNTED)


def _tiled(known: DataFrame, new: DataFrame, counts: DataFrame) -> DataFrame:
    """(k, tag with role) of postings (k, tag): keys with more than HOT are split so that each pair meets once.

    counts are (k, n, fresh): rows of keys and new rows of keys; keys that few hold may be missing. A tile's number is
    hashed into its key, whose lowest eight bits stay.
    """
    some = counts.groupBy("k").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("fresh"), F.col("n")).otherwise(0)).alias("fresh"))
    parts = lambda c: F.ceil(F.col(c) / F.lit(HOT)).cast("int")
    hot = _kept(some.where(F.col("all") > HOT).select("k", F.greatest(parts("fresh"), F.lit(1)).alias("rows"), parts("all").alias("cols")), "hot")
    most = hot.agg(F.max("rows")).first()[0]
    if most is None:
        plain = lambda df, role: df.select("k", _posting(role).alias("tag"))
        return plain(known, KNOWN).unionByName(plain(new, NEW))
    hot = _small(hot)
    known, new = known.join(hot, "k", "left"), new.join(hot, "k", "left")
    row, col = F.pmod(F.xxhash64("tag", F.lit(1)), F.col("rows")), F.pmod(F.xxhash64("tag", F.lit(2)), F.col("cols"))
    below = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    split = lambda tile: F.xxhash64("k", tile).bitwiseAND(F.lit(-256)).bitwiseOR(F.col("k").bitwiseAND(F.lit(255)))
    place = lambda k, role: F.struct(k.alias("k"), _posting(role).alias("tag"))
    seeking = F.transform(below("cols"), lambda j: place(split(row * F.col("cols") + j), SEEKING))
    sought = F.transform(below("rows"), lambda i: place(split(i * F.col("cols") + col), SOUGHT))
    new = new.select(F.explode(F.when(F.col("rows").isNull(), F.array(place(F.col("k"), NEW))).otherwise(F.concat(seeking, sought))).alias("p")).select("p.k", "p.tag")
    if most > 1:
        known = known.withColumn("row", F.explode(F.when(F.col("rows").isNull(), F.array(F.lit(0))).otherwise(below("rows"))))
    else:
        known = known.withColumn("row", F.lit(0))
    k = F.when(F.col("rows").isNull(), F.col("k")).otherwise(split(F.col("row") * F.col("cols") + col))
    return known.select(k.alias("k"), _posting(KNOWN).alias("tag")).unionByName(new)


def _hot_words(keys: np.ndarray):
    """(k, w): words of records that hold one of the keys; k is null for each word once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, k = _hot_hits(keys, b["keys"])
            flat, starts, n = b["words"].flatten().to_numpy(), *_spans(b["words"])
            of = np.repeat(np.arange(len(row)), n[row])
            w = flat[np.arange(len(of)) + np.repeat(starts[row] - (np.cumsum(n[row]) - n[row]), n[row])]
            yield pa.record_batch([pa.array(keys[k][of]), pa.array(w)], ["k", "w"])
            yield pa.record_batch([pa.nulls(len(flat), pa.int64()), pa.array(flat)], ["k", "w"])

    return run


def _spans(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of lists in their flattened values."""
    n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    return np.cumsum(n) - n, n


def _hot_hits(keys: np.ndarray, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index of the key) of the sorted keys that lists hold."""
    flat, (_, n) = lists.flatten().to_numpy(), _spans(lists)
    at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
    hit = np.nonzero(keys[at] == flat)[0]
    return np.repeat(np.arange(len(n)), n)[hit], at[hit]


def _split(shared):
    """(k, tag): postings of frequent keys of (tag, words, keys), each for some of the record's rarest words.

    Words that most holders of a key have (held) are passed over. Of two matching records, x has at least t of its n words
    in common with the other; whatever is held, one of the n - t + 1 rarest that aren't is among as many of the other,
    unless t of the words of both are held: records with so many held words meet once more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, known, counts = shared.value
        num, den = SHARE
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                row, k = _hot_hits(keys, b["keys"])
                if not len(row):
                    continue
                hit, row = np.unique(row, return_inverse=True)
                b = b.select(["tag", "words"]).take(pa.array(hit))
                flat, (starts, n) = b["words"].flatten().to_numpy().view(np.uint32).astype(np.int64), _spans(b["words"])
                i = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
                rank = np.where(known[i] == flat, counts[i], 0) if len(known) else np.zeros(len(flat), np.int64)
                flat = flat[np.lexsort((flat, rank, np.repeat(np.arange(len(n)), n)))]
                size = n[row]
                first = np.cumsum(size) - size
                of = np.repeat(np.arange(len(row)), size)
                w = flat[np.arange(len(of)) + np.repeat(starts[row] - first, size)]
                code = k[of] << 32 | w
                j = np.minimum(np.searchsorted(held, code), max(len(held) - 1, 0))
                free = held[j] != code if len(held) else np.ones(len(code), bool)
                place = np.cumsum(free) - free
                place -= place[np.minimum(first, len(place) - 1)][of]
                least = (size * num + den - 1) // den
                keep = free & (place < (size - least + 1)[of])
                full = np.nonzero(np.bincount(of, ~free, len(row)) >= least)[0]
                hit, w = np.append(of[keep], full), np.append(w[keep].astype(np.uint64), np.full(len(full), 1 << 33, np.uint64))
                h = (keys[k[hit]].view(np.uint64) ^ (w + np.uint64(1)) * np.uint64(_TURN)) * np.uint64(_MULTIPLY)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(_MULTIPLY)
                split = (h ^ (h >> np.uint64(29))) & np.uint64(0xFFFFFFFFFFFFFF00) | keys[k[hit]].view(np.uint64) & np.uint64(255)
                yield pa.record_batch([pa.array(split.view(np.int64)), b["tag"].take(pa.array(row[hit]))], ["k", "tag"])

    return run


def _refused(edges: DataFrame) -> DataFrame | None:
    """Of classes joined by (early, late) edges: those that match an accepted earlier one. Null if there is no edge.

    Each round accepts the classes with no undecided earlier neighbour and refuses their later neighbours, until no
    edge between undecided classes is left; as many rounds as the longest chain of decisions.
    """
    refused = None
    rounds = 0
    while not edges.isEmpty():
        waiting = edges.select(F.col("late").alias("early"), F.lit(True).alias("waits")).distinct()
        edges = _kept(edges.join(waiting, "early", "left"), f"round-{rounds}")
        out = edges.where("waits IS NULL").select(F.col("late").alias("c")).distinct()
        refused = out if refused is None else refused.unionByName(out)
        edges = edges.where("waits").drop("waits")
        for end in ("early", "late"):
            edges = edges.join(out.withColumnRenamed("c", end), end, "left_anti")
        edges = _kept(edges, f"edges-{rounds}")
        rounds += 1
    return None if refused is None else refused.distinct()


@contextmanager
def _writers(spark: SparkSession) -> Iterator[None]:
    """Let tasks write up to WRITERS partitions of a table at once, without a sort."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(WRITERS))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class ChunkStore:
    """What was accepted so far, in a folder: a table from chunks to records, and the records' features.

    Both tables are partitioned by buckets of their hashes; matching a batch reads the buckets of the batch's chunks
    and of its candidates only, and no text again. buckets should grow with the records that are expected; it is fixed
    when a store is begun.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 4) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _table(self, name: str, schema: str) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def chunks(self) -> DataFrame:
        """(k, tag, bucket): a row for each chunk of each class."""
        return self._table("chunks", "k long, tag long, bucket int")

    def accepted(self) -> DataFrame:
        """Features of all records that are known."""
        return self._table("records", f"id string, at long, {_FEATURES}, bucket int")

    def _sampled(self) -> DataFrame:
        """Words and keys of one of COUNTED classes."""
        return self._table("sampled", "tag long, words array<int>, keys array<long>")

    def append(self, rows: DataFrame, fresh: bool = False) -> None:
        """Accept records() rows as known; chunks of a class that is known already are not entered again.

        fresh says that each row is of a class of its own that isn't known.
        """
        path = f"{self.path}/incoming-{uuid.uuid4().hex}"
        with _writers(self.spark):
            rows.drop("base").withColumn("bucket", self._bucket("tag")).write.options(**_FEATURES_PLAIN).partitionBy("bucket").parquet(path)
        one = self.spark.read.schema(f"id string, at long, {_FEATURES}, bucket int").parquet(path)
        if not fresh:
            one, copies = _one_of_each(one)
            if exists(self.spark, f"{self.path}/records"):
                before = self.accepted().select(*CLS, "bucket")
                copies = copies.unionByName(one.join(before, [*CLS, "bucket"], "left_semi").select("id"))
                one = one.join(before, [*CLS, "bucket"], "left_anti")
            copies.write.mode("append").parquet(f"{self.path}/copies")
        keys = one.select(F.explode("keys").alias("k"), "tag").withColumn("bucket", self._bucket("k"))
        with _writers(self.spark):
            keys.write.options(**_PLAIN).mode("append").partitionBy("bucket").parquet(f"{self.path}/chunks")
        _one_of(one, COUNTED).select("tag", "words", "keys").write.options(**_PLAIN).mode("append").parquet(f"{self.path}/sampled")
        self._move(path, f"{self.path}/records")

    def _move(self, path: str, to: str) -> None:
        """Move the files of a partitioned table that is written whole into another."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = at(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for bucket in fs.listStatus(at(path)):
            if bucket.isDirectory():
                name = bucket.getPath().getName()
                fs.mkdirs(at(f"{to}/{name}"))
                for file in fs.listStatus(bucket.getPath()):
                    fs.rename(file.getPath(), at(f"{to}/{name}/{file.getPath().getName()}"))
        fs.delete(at(path), True)

    def _in_buckets(self, stored: DataFrame, wanted: DataFrame, c: str) -> DataFrame:
        """The rows of a stored table in the buckets of the wanted values: other partitions are not read."""
        hit = [r.b for r in wanted.select(self._bucket(c).alias("b")).distinct().collect()]  # at most `buckets`
        return stored.where(F.col("bucket").isin(hit) if hit else F.lit(False))

    def candidates(self, reps: DataFrame) -> DataFrame:
        """(x new, y, y_new, n): tags of classes that share n bytes in chunks, as far as their tags allow a match."""
        mine = reps.select(F.explode("keys").alias("k"), "tag")
        wanted = _kept(mine.select("k").distinct(), "keys")
        stored = self._in_buckets(self.chunks(), wanted, "k").select("k", "tag")
        counts = _counted(_one_of(reps, COUNTED)).withColumn("fresh", F.lit(True)).unionByName(_counted(self._sampled()).withColumn("fresh", F.lit(False)))
        counts = _kept(counts, "counts")
        hot = counts.groupBy("k").agg(F.sum("n").alias("n"), F.max("fresh").alias("fresh")).where(F.col("n") > HOT).where("fresh").select("k").collect()  # fewer than postings / HOT
        few, hot = wanted.count() <= BROADCAST_ROWS, np.sort(np.array([r.k for r in hot], np.int64))
        if len(hot):
            listed = F.broadcast(self.spark.createDataFrame([(int(k),) for k in hot], "k long"))
            wanted, mine, counts = (df.join(listed, "k", "left_anti") for df in (wanted, mine, counts))
            stored = stored if few else stored.join(listed, "k", "left_anti")
        if few:
            stored = stored.join(F.broadcast(wanted), "k", "left_semi")
        if len(hot):
            known, new, sizes = self._split_hot(hot, reps)
            stored, mine, counts = stored.unionByName(known), mine.unionByName(new), counts.unionByName(sizes)
        tiled = _tiled(stored, mine, counts).repartition("k").sortWithinPartitions("k")
        return tiled.mapInArrow(_compare, "x long, y long, y_new boolean, n int").groupBy("x", "y", "y_new").agg(F.sum("n").alias("n"))

    def _split_hot(self, keys: np.ndarray, reps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Postings of known and of new records that hold the sorted frequent keys, split by words, and their counts."""
        known = self.accepted().join(_small(self._table("copies", "id string")), "id", "left_anti")
        few = _one_of(self._sampled().unionByName(reps.select("tag", "words", "keys")), HELD_SAMPLE)
        held = _kept(few.mapInArrow(_hot_words(keys), "k long, w int").groupBy("k", "w").count(), "held-words")
        most = held.where("k IS NOT NULL").groupBy("k").agg(F.max("count").alias("most"))  # about the holders in the sample
        common = held.join(F.broadcast(most), "k").where("2 * count > most AND most > 7").select("k", "w").collect()  # a few for each key
        ranks = held.where("k IS NULL AND count > 1").orderBy(F.desc("count"), "w").limit(RANKED).select("w", "count").collect()  # bounded by RANKED
        at = np.searchsorted(keys, np.array([r.k for r in common], np.int64))
        codes = np.sort(at << 32 | np.array([r.w for r in common], np.int64) & 0xFFFFFFFF)
        ranked = sorted((r.w & 0xFFFFFFFF, r["count"]) for r in ranks)
        shared = self.spark.sparkContext.broadcast((keys, codes, np.array([w for w, _ in ranked], np.int64), np.array([n for _, n in ranked], np.int64)))
        split = lambda rows: rows.select("tag", "words", "keys").mapInArrow(_split(shared), "k long, tag long")
        new = _kept(split(reps), "split-new")
        old = split(known).join(_small(_kept(new.select("k").distinct(), "split-keys")), "k", "left_semi")
        old = _kept(old, "split-known")
        sizes = lambda df, fresh: df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COUNTED).withColumn("fresh", F.lit(fresh))
        return old, new, sizes(new, True).unionByName(sizes(old, False))

    def similar(self, reps: DataFrame) -> DataFrame:
        """(a, b, b_new): classes (structs) of a batch with those that match them, known ones and others of the batch."""
        met = _kept(self.candidates(reps), "candidates")
        look = lambda rows: rows.select(F.col("tag"), F.struct(*CLS).alias("cls"), "size", "words")
        mine = look(reps)
        wanted = _kept(met.where("NOT y_new").select(F.col("y").alias("tag")).distinct(), "wanted")
        # one record of each class: its copies have the same words
        known = self._in_buckets(self.accepted(), wanted, "tag").join(_small(wanted), "tag", "left_semi").join(_small(self._table("copies", "id string")), "id", "left_anti")
        known = look(known)
        named = lambda rows, side: rows.select(F.col("tag").alias(side), F.struct("cls", "size", "words").alias(f"{side}_of"))
        left = met.join(named(mine, "x"), "x")
        both = left.where("y_new").join(named(mine, "y"), "y").unionByName(left.where("NOT y_new").join(named(known, "y"), "y"))
        covered = both.where((F.col("x_of.cls") != F.col("y_of.cls")) & (F.col("n") >= COVERAGE * F.least("x_of.size", "y_of.size")))
        wx, wy = F.col("x_of.words"), F.col("y_of.words")
        common = F.size(F.array_intersect(wx, wy))
        num, den = SHARE
        return covered.where(common * (den + num) >= (F.size(wx) + F.size(wy)) * num).select(F.col("x_of.cls").alias("a"), F.col("y_of.cls").alias("b"), F.col("y_new").alias("b_new"))

    def add_batch(self, rows: DataFrame) -> DataFrame:
        """(id, known_id): matches of each record with all that is known before it, in the order of (at, id).

        A record becomes known only if nothing matched it. rows are records() with unique ids. An empty batch or store
        gives no matches; records of the batch are still matched with each other.
        """
        rows = materialize(rows.withColumn("base", F.lit(False)), "batch", **_FEATURES_PLAIN)
        reps, _ = _one_of_each(rows)
        pairs = _kept(self.similar(reps), "pairs")
        info = rows.groupBy(*CLS).agg(F.min(F.struct("at", "id")).alias("first"), F.count(F.lit(1)).alias("n")).select(F.struct(*CLS).alias("cls"), "first", "n")
        info = _kept(info, "classes")
        touched = pairs.where("NOT b_new").select("b.*").unionByName(info.select("cls.*")).distinct()
        ids = self.accepted().select(*CLS, F.col("id").alias("known_id")).join(_small(_kept(touched, "touched")), CLS, "left_semi")
        ids = _kept(ids.select(F.struct(*CLS).alias("cls"), "known_id"), "known-ids")
        blocked = pairs.where("NOT b_new").select(F.col("a").alias("cls")).unionByName(ids.select("cls")).distinct()
        free = _kept(info.join(blocked, "cls", "left_anti").select("cls", "first"), "free")
        first = lambda side: free.select(F.col("cls").alias(side), F.col("first").alias(f"{side}_first"))
        inner = pairs.where("b_new").join(first("a"), "a").join(first("b"), "b")
        ordered = F.col("a_first") < F.col("b_first")
        edges = inner.select(F.when(ordered, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(ordered, F.col("b")).otherwise(F.col("a")).alias("late")).distinct()
        refused = _refused(_kept(edges, "edges"))
        accepted = free if refused is None else free.join(refused.withColumnRenamed("c", "cls"), "cls", "left_anti")
        accepted = _kept(accepted.select("cls", "first"), "accepted")

        new = rows.select("id", F.struct("at", "id").alias("order"), F.struct(*CLS).alias("cls"))
        known = ids.select("cls", "known_id", F.lit(None).cast("struct<at:bigint,id:string>").alias("since"))
        known = known.unionByName(accepted.select("cls", F.col("first.id").alias("known_id"), F.col("first").alias("since")))
        reach = pairs.select(F.col("a").alias("cls"), F.col("b").alias("to")).unionByName(pairs.where("b_new").select(F.col("b").alias("cls"), F.col("a").alias("to")))
        # records of one class match it as well if it is known, or has several
        own = info.where("n > 1").select("cls").unionByName(ids.select("cls")).distinct()
        reach = reach.unionByName(own.select("cls", F.col("cls").alias("to"))).join(known.withColumnRenamed("cls", "to"), "to").select("cls", "known_id", "since")
        found = new.join(reach, "cls").where(F.col("since").isNull() | (F.col("since") < F.col("order"))).select("id", "known_id").distinct()
        found = _kept(found, "matches")
        self.append(rows.join(_small(accepted.select(F.col("first.id").alias("id"))), "id", "left_semi"), fresh=True)
        return found


def match_in_order(rows: DataFrame) -> DataFrame:
    """(id, known_id): matches of each new record, in the order of (at, id), with all that is known before it.

    rows are records(): base ones are known from the start; a new one becomes known only if nothing matched it. ids
    must be unique. An empty table gives no matches.
    """
    store = ChunkStore(rows.sparkSession, scratch(rows.sparkSession, "store"))
    store.append(rows.where("base"))
    return store.add_batch(rows.where("NOT base"))


def _current(rows: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """current_rows() by id; only ids with several rows are shuffled with their texts."""
    rows = rows.where("id IS NOT NULL").select("id", order, *[f for f in fields if f != order])
    several = _small(_kept(rows.groupBy("id").count().where("count > 1").select("id"), "several-rows"))
    return rows.join(several, "id", "left_anti").select("id", *fields).unionByName(current_rows(rows.join(several, "id", "left_semi"), "id", order, fields))


def claim_texts(items: DataFrame, discarded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, base, at, text, payload) of what is known from the start, and of dated discards."""
    null = lambda kind: F.lit(None).cast(kind)
    known = _current(items, "updated_at", ["text"])
    known = known.select("id", F.lit(True).alias("base"), null("long").alias("at"), "text", null("string").alias("payload"))
    rows = materialize(_current(discarded, "discarded_at", ["discarded_at", "payload"]), "discards")
    at = F.unix_micros(F.col("discarded_at").cast("timestamp"))
    rows = rows.select("id", at.isNull().alias("base"), at.alias("at"), null("string").alias("text"), F.coalesce("payload", F.lit("")).alias("payload"))
    return known.unionByName(rows.where("base")), rows.where("NOT base")


def passes(at: DataFrame, size: int) -> list[tuple[int, int]]:
    """[from, to) in microseconds of consecutive UTC days, taken together until they have `size` rows."""
    day = 86_400_000_000
    out, held = [], 0
    for r in at.groupBy(F.floor(F.col("at") / day).alias("d")).count().orderBy("d").collect():  # a row for each day
        out, held = ([*out, (r.d * day, (r.d + 1) * day)], r["count"]) if not out or held >= size else ([*out[:-1], (out[-1][0], (r.d + 1) * day)], held + r["count"])
    return out


def duplicate_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b), a < b: each discarded claim with all equal or nearly equal ones known before it.

    What is known from the start is entered into a ChunkStore; then the discards go through it, day after day.
    """
    known, new = claim_texts(table(spark, sf_dir, "memory_items"), table(spark, sf_dir, "memory_discarded"))
    items = table(spark, sf_dir, "memory_items").select("id", "text")
    ranks = word_ranks(items)
    size = items.count()
    store = ChunkStore(spark, scratch(spark, "store"), max(4, size // BUCKET_RECORDS))
    store.append(records(known, ranks))
    found = None
    for lo, hi in passes(new, max(PASS_RECORDS, size // PASS_SHARE)):
        more = store.add_batch(records(new.where((F.col("at") >= lo) & (F.col("at") < hi)), ranks))
        found = more if found is None else found.unionByName(more)
    if found is None:
        return spark.createDataFrame([], "id_a string, id_b string")
    return found.select(F.least("id", "known_id").alias("id_a"), F.greatest("id", "known_id").alias("id_b")).distinct()
