from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loamspark.operators import history

SCHEMA = "id string, entity string, property string, value string, first_seen timestamp, updated_at timestamp, leaf string, t string"
T0 = datetime(2025, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def us(hours):
    return 1735689600_000_000 + hours * 3_600_000_000


def run(spark, rows):
    # extra columns have names that the operator uses itself
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in history.attribute_history(df).select(*history.VERSION).collect())


def brute(rows):
    cur = {}
    for r in sorted(rows, key=lambda r: r[5] or T0):
        if r[0] is not None:
            cur[r[0]] = r
    slots = {}
    for i, e, p, v, fs, _ in cur.values():
        if all(x and x.strip(" \t\r\n") for x in (e, p, v)) and fs:
            key = tuple(" ".join(x.split()).lower() for x in (e, p))
            slots.setdefault(key, {}).setdefault(fs, []).append((i, " ".join(v.split())))
    out = []
    for key, times in slots.items():
        runs = []
        for fs in sorted(times):
            v = min(times[fs])[1]
            if not runs or runs[-1][0] != v:
                runs.append((v, fs))
        for k, (v, fs) in enumerate(runs):
            stamp = lambda x: round((x - datetime(1970, 1, 1)).total_seconds() * 1e6)
            out.append((*key, v, stamp(fs), stamp(runs[k + 1][1]) if k + 1 < len(runs) else -1))
    return sorted(out)


def test_versions_return_ties_and_blanks(spark):
    rows = [
        ("a", " Gate ", "Port", "80", at(0), at(0)),
        ("b", "gate", "port", "80", at(1), at(1)),
        ("c", "gate", "port", "81", at(2), at(2)),
        ("d", "GATE", "port", "80", at(3), at(3)),
        ("e", "gate", "port", "zz", at(3), at(3)),  # same moment, larger id
        ("f", "gate", "port", " \t", at(4), at(4)),
        ("g", None, "port", "1", at(4), at(4)),
        ("h", "gate", "port", "82", None, at(4)),
        ("c", "gate", "port", "81", at(2), at(2)),  # delivered twice
        (None, "gate", "port", "9", at(9), at(9)),
    ]
    assert run(spark, rows) == [("gate", "port", "80", us(0), us(2)), ("gate", "port", "80", us(3), -1), ("gate", "port", "81", us(2), us(3))]


def test_later_state_of_an_id_rewrites_old_versions(spark):
    # the second state comes after the older snapshot, so the version it replaces must be withdrawn
    rows = [("a", "x", "p", "old", at(0), at(0)), ("b", "x", "p", "next", at(5), at(1)), ("a", "x", "p", "new", at(0), at(24 * 100)), ("k", "y", "p", "1", at(0), at(0))]
    assert run(spark, rows) == brute(rows)


def test_hot_slot_against_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(f"i{n}", rng.choice(["hot", "hot", f"e{n % 7}"]), "p", f"v{rng.randrange(3)}", at(rng.randrange(3000)), at(rng.randrange(4000))) for n in range(1500)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_only_changed_leaves_are_found(spark):
    claims = spark.range(500).select(F.concat(F.lit("e"), "id").alias("entity"), F.lit("p").alias("property"), F.col("id").alias("t"), F.when(F.col("id") == 7, "new").otherwise("v").alias("value"), F.lit("v").alias("old_value"))
    claims = claims.withColumn("leaf", history.leaf_of(*history.SLOT))
    found = [r.leaf for r in history.changed_leaves(history.tree(history.leaf_digests(claims))).collect()]
    assert found == [r.leaf for r in claims.where("entity = 'e7'").select("leaf").collect()]
