import random

import pytest

from loamspark.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks()


def naive(word, ranks):
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_segment_tree_against_naive_merges(ranks):
    rng = random.Random(1)
    m = bpe.Merger(ranks)
    for _ in range(400):
        word = bytes(rng.choice(b"abeinorst \xc3\xa9") for _ in range(rng.randrange(0, 40)))
        assert m.merge(word) == (naive(word, ranks) if word else [])


def test_long_word_is_fast(ranks):
    word = ("ab" * 20_000 + "é" * 5_000).encode()
    ids = bpe.Merger(ranks).merge(word)
    assert b"".join(bpe.Merger(ranks).token[i] for i in ids) == word


def test_encode(spark, ranks):
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "  \n\t ", "It’s the <|endoftext|> 12,345 ms", "日本語 👨‍💻", "a" * 5000, "x  y\r\n"]
    df = spark.createDataFrame([(i, t, [9]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert bpe.encode(df.limit(0)).collect() == []
