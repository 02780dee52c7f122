from loamspark.llm import mojibake as m

CLEAN = ["La clé rejetée a été légèrement oubliée sans prévenir le siège", "Die gelöschte Übergabe ist für die nächste Prüfung größer geworden"]


def wrong(text, written, read):
    return "".join(m._reads(read)[b] for b in text.encode(written))


def test_copies_of_a_garbled_text_do_not_vote_it_clean(spark):
    docs = [f"{t}. Note number {k}" for t in CLEAN for k in range(8)]
    clean = len(docs)
    for t in CLEAN:
        docs += [wrong(t, "cp1252", "cp850")] * 60
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.original for r in m.garbled_documents(df).collect()}
    assert got == {i: CLEAN[(i - clean) // 60] for i in range(clean, len(docs))}
