from test_leakage import PASSAGE, run

from loamspark.llm import leakage


def test_other_names_units_and_identifiers_are_found(spark):
    item = "Latency of the gate fell from 4 ms to 51 ms once the ReplicaBuilder rotated the parser in store/bounded_handoff.md and stopped"
    docs = [
        item.replace("ReplicaBuilder", "ShardKeeper"),
        item.replace("ms", "furlongs"),
        item.replace("store/bounded_handoff.md", "panel/frozen_tenant.md"),
        item.replace("4 ms", "7 s").replace("51 ms", "88 s").replace("ReplicaBuilder", "GateWarden"),
        item.replace("Latency", "Price").replace("fell", "rose").replace("rotated", "cut").replace("stopped", "left"),
    ]
    got = run(spark, docs, [item])
    assert got == {(0, 100): (True, True), (1, 100): (True, True), (2, 100): (True, True), (3, 100): (False, True)}


def test_values_must_replace_each_other_one_to_one(spark):
    item = "we moved 3 rows to Berlin and then 3 rows from Berlin to the other cold store"
    got = run(spark, [item.replace("3", "5").replace("Berlin", "Madrid"), item.replace("3", "5", 1).replace("Berlin", "Madrid", 1)], [item])
    assert got[0, 100] == (False, True) and (1, 100) not in got


def test_a_passage_after_a_number_or_in_other_case_is_verbatim(spark):
    twelve = "seconds passed until the queue had dropped every last record of it"
    assert len(twelve.split()) == 12
    got = run(spark, [f"after 90 {twelve}", twelve.title(), f"{twelve[:1].upper()}{twelve[1:]}!", f"3 {twelve} 4"], [f"Some {twelve} at all."])
    assert {k[0] for k, v in got.items() if v[0]} == {0, 1, 2, 3}


def test_items_in_any_number_give_the_same_pairs(spark, monkeypatch):
    items = [PASSAGE.replace("stale", f"stale{'x' * i}") for i in range(6)]
    docs = [PASSAGE.replace("3", "8"), *items]
    want = run(spark, docs, items)
    for i, t in enumerate(items):
        assert {d: v for (d, _), v in run(spark, docs, [t]).items()} == {d: v for (d, k), v in want.items() if k == 100 + i}
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", 0)
    assert run(spark, docs, items) == want


def test_lower_casing_that_changes_words():
    found, kind = leakage.kinds("İstanbul andİx Fine")
    assert len(found) == len(kind)
