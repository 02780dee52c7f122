from loamspark.llm import leakage
from loamspark.llm.words import words

PASSAGE = "After the trace rewrote its stale sandbox, 3 retry rows were silent and the ReplicaBuilder waited 12 ms more"


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(100 + k, t) for k, t in enumerate(items)], "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.verbatim > 0, r.reparameterised > 0) for r in leakage.leaks(d, i).collect()}


def test_words():
    assert words("Ｖolume_37 it’s 1.5²") == ["volume", "37", "it", "s", "1", "52"]
    assert words(None) == words(" _ ") == []


def test_verbatim_partial_and_reparameterised(spark):
    ws = PASSAGE.split()
    docs = [
        "x " + PASSAGE.upper() + " y",
        " ".join(ws[:12]),
        " ".join(ws[:11]),
        PASSAGE.replace("3", "77").replace("12", "45"),
        None, "", " ",
        PASSAGE.replace(" ", "\n—\n"),
        ("filler " * 20_000) + PASSAGE,
        PASSAGE,
        PASSAGE,
    ]
    got = run(spark, docs, [PASSAGE, None, "too short", PASSAGE])
    assert {k[0] for k, v in got.items() if v[0]} == {0, 1, 7, 8, 9, 10}
    assert {k[1] for k, v in got.items() if v[0]} == {100, 103}
    assert got[3, 100] == (False, True)
    assert (2, 100) not in got


def test_inconsistent_slots_are_no_leak():
    a = "the 3 of 3 and".split()
    assert leakage.slots_agree(a, "the 4 of 4 and".split()) == leakage.REPARAMETERISED
    assert leakage.slots_agree(a, "the 4 of 5 and".split()) is None
    assert leakage.slots_agree(a, a) == leakage.VERBATIM


def test_joined_and_empty(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", 40)
    assert {k for k, v in run(spark, [PASSAGE], [PASSAGE] * 5).items() if v[0]} == {(0, 100 + i) for i in range(5)}
    assert run(spark, [], [PASSAGE]) == {}
    assert run(spark, [PASSAGE], []) == {}
