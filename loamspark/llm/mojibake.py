"""Texts that were decoded with the wrong character encoding, and their originals.

Segments of text are joined with near-twins on what is left of them without non-ASCII characters. Where twins differ,
their characters are aligned between the shared ASCII letters and digits, and each aligned pair votes for the
transformations (written in one encoding, read in another) that turn one into the other. The transformations that
twins bear out, together with the corpus's own words and characters as evidence, are then applied to all records.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamspark.session import materialize

#: Encodings that a transformation is sought among (fixed values).
SINGLE_BYTE = ["cp1252", "latin-1", "cp1251", "cp437", "cp850", "cp866", "mac_roman", "koi8-r", "iso8859-5", "iso8859-15", "cp1250"]
UTF8 = "utf-8"
#: Times that one transformation may have been applied in a row.
REPEATS = 2
#: ASCII letters and digits that a segment needs to be joined with twins.
SKELETON_LEAST = 12
#: Twin pairs that must bear a transformation out; documents that must hold a restored character or word.
LEAST_PAIRS, LEAST_DOCUMENTS = 2, 3
#: Distinct words of so many characters that bear a transformation out where twins can't, as in texts without ASCII.
LEAST_WORDS, LONG_WORD = 3, 4
#: A restored word must be in so many times as many distinct texts as the garbled one (single-byte transformations).
RATIO = 4
#: Learned words that go to the executors at once; beyond it they are joined.
BROADCAST_WORDS = 300_000

LOST = "�"
_CITED = re.compile(r"`[^`\n]*`")
_WORD = re.compile(r"[A-Za-z\x80-\U0010ffff]+")
_OTHER = re.compile(r"[^\x00-\x7f]")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_NOT_ALNUM = re.compile(r"[^A-Za-z0-9]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


@lru_cache(None)
def _reads(codec: str) -> list[str]:
    """Character of each byte; bytes that the encoding leaves open read as control characters."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@lru_cache(None)
def _writes(codec: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_reads(codec))))}


def _encode(text: str, codec: str) -> bytes | None:
    if codec == UTF8:
        return text.encode("utf-8", "surrogatepass")
    table = _writes(codec)
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def _decode(data: bytes, codec: str) -> str | None:
    if codec == UTF8:
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return None
    table = _reads(codec)
    return "".join([table[b] for b in data])


#: (written, read, times): written in one encoding, read in another, so many times in a row.
TRANSFORMATIONS = [(UTF8, d, n) for d in SINGLE_BYTE for n in range(1, REPEATS + 1)] + [(e, d, 1) for e in SINGLE_BYTE for d in SINGLE_BYTE if e != d]


def garble(text: str, written: str, read: str, times: int) -> str | None:
    for _ in range(times):
        data = _encode(text, written)
        text = None if data is None else _decode(data, read)
        if text is None:
            return None
    return text


def restore(text: str, written: str, read: str, times: int) -> str | None:
    for _ in range(times):
        data = _encode(text, read)
        text = None if data is None else _decode(data, written)
        if text is None:
            return None
    return text


def align(garbled: str, clean: str) -> list[tuple[str, str]]:
    """Differing stretches of two texts with the same ASCII letters and digits, cut at each of these."""
    a, b = _ALNUM.split(garbled), _ALNUM.split(clean)
    return [(x, y) for x, y in zip(a, b, strict=False) if x != y] if len(a) == len(b) else []


@lru_cache(200_000)
def explanations(garbled: str, clean: str) -> tuple[int, ...]:
    """Numbers of the transformations that make garbled of clean."""
    return tuple(i for i, t in enumerate(TRANSFORMATIONS) if garble(clean, *t) == garbled)


def segments(text: str) -> Iterator[tuple[int, str]]:
    """(key, segment) of a text: sentences with enough ASCII to find twins by, and the lines without, as one.

    The key hashes the segment's ASCII letters and digits; that of the lines without enough of them is the whole text's.
    """
    rest = []
    for line in text.split("\n"):
        if line.isascii():
            continue
        if len(_NOT_ALNUM.sub("", line)) < len(_OTHER.findall(line)):
            rest.append(line)
            continue
        for s in _SENTENCE.findall(line):
            if not s.isascii():
                skeleton = _NOT_ALNUM.sub("", s)
                if len(skeleton) >= SKELETON_LEAST:
                    yield xxhash.xxh64_intdigest(skeleton) - (1 << 63), s.strip()
    if rest:
        skeleton = _NOT_ALNUM.sub("", text)
        if len(skeleton) >= SKELETON_LEAST:
            yield xxhash.xxh64_intdigest("\n" + skeleton) - (1 << 63), "\n".join(rest)


def _segments(batches):
    for b in batches:
        rows = Counter(x for t in b["text"].to_pylist() for x in set(segments(_CITED.sub("", t))))
        yield pa.record_batch([pa.array([k for k, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.string()), pa.array(rows.values(), pa.int64())], ["key", "segment", "n"])


def _vote(batches):
    for b in batches:
        votes: Counter[int] = Counter()
        for x, y in zip(b["segment"].to_pylist(), b["twin"].to_pylist(), strict=True):
            seen = {i for pair in align(x, y) for i in explanations(*pair)}
            seen |= {i for pair in align(y, x) for i in explanations(*pair)}
            votes.update(seen)
        yield pa.record_batch([pa.array(list(votes), pa.int32()), pa.array(list(votes.values()), pa.int64())], ["transformation", "n"])


def learn_transformations(texts: DataFrame) -> list[tuple[str, str, int]]:
    """The transformations that at least LEAST_PAIRS pairs of twins bear out, the most frequent first.

    Which twin is the clean one isn't decided here: a transformation and its reverse may both be learned, and the
    frequency of the restored words decides later.
    """
    variants = texts.mapInArrow(_segments, "key long, segment string, n long").groupBy("key", "segment").agg(F.sum("n").alias("n"))
    variants = materialize(variants, "segments")
    twins = variants.groupBy("key").agg(F.max(F.struct("n", "segment")).alias("top"), F.count(F.lit(1)).alias("forms")).where("forms > 1")
    pairs = variants.join(twins, "key").select("segment", F.col("top.segment").alias("twin")).where("segment <> twin")
    votes = pairs.mapInArrow(_vote, "transformation int, n long").groupBy("transformation").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PAIRS)
    found = votes.orderBy(F.desc("n"), "transformation").collect()  # at most len(TRANSFORMATIONS) rows
    return [TRANSFORMATIONS[r.transformation] for r in found]


def words_of(text: str) -> set[str]:
    """Runs of letters that hold a non-ASCII character, outside of samples cited between backticks."""
    return {w for w in _WORD.findall(_CITED.sub("", text)) if not w.isascii()}


def _words(batches):
    """Of each word the rows (n) and the distinct texts (d) that hold it; texts come once, with their copies."""
    for b in batches:
        rows: Counter[str] = Counter()
        texts: Counter[str] = Counter()
        for t, copies in zip(b["text"].to_pylist(), b["copies"].to_pylist(), strict=True):
            held = words_of(t)
            texts.update(held)
            for w in held:
                rows[w] += copies
        yield pa.record_batch([pa.array(list(texts), pa.string()), pa.array([rows[w] for w in texts], pa.int64()), pa.array(list(texts.values()), pa.int64())], ["word", "n", "d"])


def _characters(batches):
    for b in batches:
        rows: Counter[str] = Counter()
        for w, n in zip(b["word"].to_pylist(), b["n"].to_pylist(), strict=True):
            for c in set(w):
                rows[c] += n
        yield pa.record_batch([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.int64())], ["c", "n"])


class Sequences:
    """Finds the stretches of a word that are UTF-8 read in another encoding."""

    def __init__(self, read: str, known: set[str]) -> None:
        chars = _reads(read)
        cls = lambda lo, hi: "[" + "".join(map(re.escape, chars[lo : hi + 1])) + "]"
        more = cls(0x80, 0xBF)
        self.find = re.compile(f"(?:{cls(0xC2, 0xDF)}{more}|{cls(0xE0, 0xEF)}{more}{{2}}|{cls(0xF0, 0xF4)}{more}{{3}})")
        self.read, self.known = read, known

    def _one(self, m: re.Match) -> str:
        c = restore(m.group(), UTF8, self.read, 1)
        return c if c is not None and c in self.known else m.group()

    def restore(self, word: str, times: int = REPEATS) -> str:
        for _ in range(times):
            made = self.find.sub(self._one, word)
            if made == word:
                break
            word = made
        return word


def _candidates(shared):
    """Of each word: what each transformation restores it to (-1: lost; sure: UTF-8, which shows itself)."""
    utf8 = [(i, t[1]) for i, t in enumerate(TRANSFORMATIONS) if t[0] == UTF8 and t[2] == 1]
    single = [(i, t) for i, t in enumerate(TRANSFORMATIONS) if t[0] != UTF8]

    def run(batches):
        sequences = [(i, Sequences(read, shared.value)) for i, read in utf8]
        for b in batches:
            out = []
            for w, n, d in zip(b["word"].to_pylist(), b["n"].to_pylist(), b["d"].to_pylist(), strict=True):
                if LOST in w:
                    out.append((w, n, d, None, -1, True))
                    continue
                for i, s in sequences:
                    made = s.restore(w)
                    if made != w:
                        out.append((w, n, d, made, i, True))
                if len(w) > 1 or w.isalpha():
                    for i, t in single:
                        made = restore(w, *t)
                        if made and made != w:
                            out.append((w, n, d, made, i, False))
            yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_()))], ["word", "n", "d", "made", "transformation", "sure"])

    return run


def learn_words(texts: DataFrame, learned: list[tuple[str, str, int]]) -> DataFrame:
    """(word, made, transformation, sure): garbled words and their originals; made is null where it is lost.

    A stretch of UTF-8 read otherwise shows itself if what it decodes to are characters that the corpus uses. A word
    under a single-byte transformation counts if the restored word is in LEAST_DOCUMENTS documents and in RATIO times
    as many distinct texts as the word itself, so that copies of a garbled text don't vote its words clean. Copies of
    the clean text count as well while the garbled word isn't in more distinct texts than the restored one. Texts without ASCII letters have no twins: a transformation that isn't learned
    counts as well if LEAST_WORDS distinct long words are restored to words of the corpus by it.
    """
    spark = texts.sparkSession
    once = texts.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    words = materialize(once.mapInArrow(_words, "word string, n long, d long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "words")
    chars = words.mapInArrow(_characters, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    known = spark.sparkContext.broadcast({r.c for r in chars.select("c").collect()})  # bounded by Unicode
    vocabulary = words.select(F.col("word").alias("made"), F.col("n").alias("made_n"), F.col("d").alias("made_d")).where(F.col("made_n") >= LEAST_DOCUMENTS)
    made = words.mapInArrow(_candidates(known), "word string, n long, d long, made string, transformation int, sure boolean")
    frequent = (F.col("made_d") >= RATIO * F.col("d")) | ((F.col("made_n") >= RATIO * F.col("n")) & (F.col("made_d") >= F.col("d")))
    made = materialize(made.join(vocabulary, "made", "left").where(F.col("sure") | frequent), "candidates")
    long = (F.length("made") >= LONG_WORD) & frequent
    borne = made.where(long).groupBy("transformation").agg(F.count_distinct("word").alias("k")).where(F.col("k") >= LEAST_WORDS)
    taken = {r.transformation for r in borne.collect()} | {-1}  # at most len(TRANSFORMATIONS) rows
    taken |= {i for i, t in enumerate(TRANSFORMATIONS) if t in set(learned) or t[0] == UTF8 and (*t[:2], REPEATS) in set(learned)}
    # of several originals the word in most distinct texts of the corpus, else the shortest
    score = F.coalesce((1 << 40) + F.col("made_d"), -F.length("made").cast("long"))
    best = F.max(F.struct(score.alias("score"), F.struct("made", "transformation", "sure").alias("m"))).getField("m").alias("m")
    return made.where(F.col("transformation").isin(*taken)).groupBy("word").agg(best).select("word", "m.*")


_PIECES = re.compile(r"(?<=[.!?])(?=\s)")
_RUN = re.compile(r"[^\x00-\x7f]+")


def _repair_piece(piece: str, table: dict) -> tuple[str, bool, bool]:
    """Piece with its garbled words restored; whether it had some; whether some are lost."""
    words = [w for w in _WORD.findall(_CITED.sub("", piece)) if not w.isascii()]
    got = [table[w] for w in words if w in table]
    if not got:
        return piece, False, False
    # one single-byte transformation took in the symbols of its sentence too
    whole = next((TRANSFORMATIONS[i] for made, i, sure in got if made is not None and not sure), None)

    def one(m: re.Match) -> str:
        made = table.get(m.group(), (None,))[0]
        return made or (_RUN.sub(lambda r: restore(r.group(), *whole) or r.group(), m.group()) if whole else m.group())

    parts, last = [], 0
    for m in _CITED.finditer(piece):
        parts += [_WORD.sub(one, piece[last : m.start()]), m.group()]
        last = m.end()
    return "".join([*parts, _WORD.sub(one, piece[last:])]), True, any(made is None for made, _, _ in got)


def repair(text: str, table: dict) -> tuple[str | None, bool]:
    """(original, garbled): text itself if it isn't garbled, null if some of it is lost."""
    if text.isascii():
        return text, False
    lines = [[(p, False, False) if p.isascii() else _repair_piece(p, table) for p in _PIECES.split(x)] for x in text.split("\n")]
    garbled = any(hit for x in lines for _, hit, _ in x)
    lost = any(gone for x in lines for _, _, gone in x)
    return (None if lost else "\n".join("".join(p for p, _, _ in x) for x in lines)), garbled


_REPAIRED = "doc_id long, original string"


def _emit(pairs) -> pa.RecordBatch:
    rows = [(d, made) for d, (made, garbled) in pairs if garbled]
    return pa.record_batch([pa.array([d for d, _ in rows], pa.int64()), pa.array([m for _, m in rows], pa.string())], ["doc_id", "original"])


def _repair_by(shared):
    def run(batches):
        for b in batches:
            yield _emit((d, repair(t, shared.value)) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True))

    return run


def _word_rows(batches):
    for b in batches:
        rows = [(d, w) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True) for w in words_of(t)]
        yield pa.record_batch([pa.array([d for d, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.string())], ["doc_id", "word"])


def _repair_own(batches):
    for b in batches:
        tables = [{m["word"]: (m["made"], m["transformation"], m["sure"]) for m in ms} for ms in b["learned"].to_pylist()]
        yield _emit((d, repair(t, m)) for d, t, m in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), tables, strict=True))


def garbled_documents(documents: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, original) of every document with a wrongly decoded stretch; original is null where it is lost.

    Null, empty and pure ASCII texts are never garbled; a sample cited between backticks doesn't count. Each row is
    judged by itself, so repeated rows come out as often as they come in. With no twins in the collection nothing but
    replacement characters can be told.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(r"[^\x00-\x7f]"))
    learned = learn_transformations(texts)
    words = materialize(learn_words(texts, learned), "learned")
    if words.count() <= broadcast_words:
        shared = spark.sparkContext.broadcast({r.word: (r.made, r.transformation, r.sure) for r in words.collect()})
        return texts.mapInArrow(_repair_by(shared), _REPAIRED)
    mine = texts.mapInArrow(_word_rows, "doc_id long, word string").join(words, "word")
    tables = mine.groupBy("doc_id").agg(F.collect_set(F.struct("word", "made", "transformation", "sure")).alias("learned"))
    return texts.join(tables, "doc_id").mapInArrow(_repair_own, _REPAIRED)


def _skeletons(batches):
    for b in batches:
        keys = [xxhash.xxh64_intdigest(_NOT_ALNUM.sub("", t)) - (1 << 63) for t in b["text"].to_pylist()]
        yield pa.record_batch([b["doc_id"], b["text"], pa.array(keys, pa.int64())], ["doc_id", "text", "key"])


def restored_documents(documents: DataFrame) -> DataFrame:
    """garbled_documents, with lost originals taken from a clean document that has the same ASCII letters and digits."""
    found = materialize(garbled_documents(documents), "garbled")
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") >= SKELETON_LEAST).mapInArrow(_skeletons, "doc_id long, text string, key long")
    lost = keyed.join(found.where("original IS NULL"), "doc_id", "left_semi").select("doc_id", "key")
    clean = keyed.join(lost.select("key").distinct(), "key", "left_semi").join(found, "doc_id", "left_anti")
    twin = lost.join(clean.groupBy("key").agg(F.min(F.struct("doc_id", "text")).getField("text").alias("twin")), "key").select("doc_id", "twin")
    return found.join(twin, "doc_id", "left").select("doc_id", F.coalesce("original", "twin").alias("original"))
