import pytest

from loamspark.llm import mojibake as m

CLEAN = ["La clé rejetée a été légèrement oubliée sans prévenir l’équipe", "Die gelöschte Übergabe ist für die nächste Prüfung größer geworden", "Owner said “the gate is strict” — and the panel agreed twice", "Агент сообщил о проверке таблицы и записи", "Почему задача закрыта после перезапуска"]


def corpus():
    docs = [(f"{t}. Note {k}" if k % 2 else t) for k in range(6) for t in CLEAN]
    return docs


def wrong(text, written, read):
    return "".join(m._reads(read)[b] for b in text.encode(written, "replace"))


CASES = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("cp1251", "cp1252"), ("cp1252", "cp850")]


def test_cases_are_found_and_restored(spark):
    docs = corpus()
    expect = {}
    for w, r in CASES:
        for t in CLEAN:
            try:
                t.encode(w)
            except UnicodeEncodeError:
                continue
            bad = wrong(t, w, r)
            if bad != t and (w == "utf-8" or (w == "cp1251") == any("а" <= c <= "я" for c in t)):
                expect[len(docs)] = t
                docs.append(bad)
    lost = len(docs)
    docs.append(CLEAN[0].encode("cp1252").decode("utf-8", "replace"))
    cited = len(docs)
    docs += ["The byte reads `Ã©` and `�` there", None, "", " \n", "plain", "x" * 200_000 + "é"]
    df = spark.createDataFrame([(i, t, "w") for i, t in enumerate(docs)], "doc_id long, text string, word string")
    got = {r.doc_id: r.original for r in m.restored_documents(df).collect()}
    assert set(expect) | {lost} == set(got)
    assert {i: got[i] for i in expect} == expect
    assert got[lost] == CLEAN[0]
    assert cited not in got


@pytest.mark.parametrize("limit", [0, 1_000])
def test_both_ways_agree(spark, limit):
    docs = corpus() + [wrong(CLEAN[0], "utf-8", "cp1252"), wrong(CLEAN[1], "utf-8", "cp1252"), f"{CLEAN[2]}. {wrong(CLEAN[0], 'utf-8', 'cp1252')}"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.original for r in m.garbled_documents(df, broadcast_words=limit).collect()}
    n = len(docs) - 3
    assert got == {n: CLEAN[0], n + 1: CLEAN[1], n + 2: f"{CLEAN[2]}. {CLEAN[0]}"}


def test_twice_and_alignment():
    once = wrong("é’", "utf-8", "cp1252")
    assert m.garble("é’", "utf-8", "cp1252", 2) == wrong(once, "utf-8", "cp1252")
    assert m.restore(wrong(once, "utf-8", "cp1252"), "utf-8", "cp1252", 2) == "é’"
    assert m.align("clÃ© rejetÃ©e", "clé rejetée") == [("Ã© ", "é "), ("Ã©", "é")]


def test_empty(spark):
    assert m.restored_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
