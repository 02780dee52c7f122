"""Registered queries without SQL, against a walk over the same rows."""

import math

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
Q = entry.queries()


def test_word_windows_cover_each_text(spark):
    df = Q["WIN07_word_windows"](spark, DATA)
    assert df.count() > 0 and len(df.columns) >= 2


def test_random_baseline_repeats_and_draws_from_all(spark):
    a, b = ([tuple(r) for r in Q["TOP13_random_baseline"](spark, DATA).collect()] for _ in range(2))
    assert a == b and len(set(a)) == len(a) > 0


def test_bootstrap_interval_holds_the_mean(spark):
    r = Q["EVA05_bootstrap_interval"](spark, DATA).first()
    x = [v.value for v in spark.read.parquet(f"{DATA}/events.parquet").where("value IS NOT NULL").select("value").collect()]
    mean = sum(x) / len(x)
    error = math.sqrt(sum((v - mean) ** 2 for v in x) / (len(x) - 1) / len(x))
    assert r.low < mean < r.high
    assert r.high - r.low == pytest.approx(2 * 1.96 * error, rel=0.15)


def test_permutation_test_is_a_share(spark):
    p = Q["EVA06_permutation_test"](spark, DATA).first()[0]
    assert 0 <= p <= 1 and abs(p * 5000 - round(p * 5000)) < 1e-6


def test_chunk_topk_is_sorted(spark):
    rows = Q["TOP06_chunk_topk"](spark, DATA).collect()
    assert len(rows) <= 10 and all(a.score >= b.score for a, b in zip(rows, rows[1:], strict=False))
