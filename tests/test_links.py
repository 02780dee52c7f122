import itertools
import random

from loamspark.operators import graph, joins
from loamspark.operators.rows import numbered

PAIRS = [("enabled", "disabled"), ("must", "must not"), ("use ", "avoid ")]


def rows(seed, n):
    rng = random.Random(seed)
    words = ["enabled", "disabled", "must", "must not", "use it", "avoid it", "ring", "Retry"]
    out = []
    for i in range(n):
        text = None if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 3)))
        out.append((f"i{i:03}", rng.choice([None, "a", "b", "c"]), text, rng.choice([None, "1", "2"]), rng.choice([None, "x", "y"])))
    return out


SCHEMA = "id string, entity string, text string, value string, agent string"


def counted(pairs):
    out = {}
    for a, b in pairs:
        out[a] = out.get(a, 0) + 1
        out[b] = out.get(b, 0) + 1
    return out


def test_opposite_links_against_all_pairs(spark):
    data = rows(1, 120)
    opposed = lambda s, t: any((x in s and y in t) or (y in s and x in t) for x, y in PAIRS)
    want = counted((a[0], b[0]) for a, b in itertools.combinations(data, 2) if a[1] and a[1] == b[1] and a[2] is not None and b[2] is not None and opposed(a[2].lower(), b[2].lower()))
    got = {r.id: r.links for r in joins.opposite_links(spark.createDataFrame(data, SCHEMA), "id", "entity", "text", PAIRS).collect()}
    assert got == want


def test_disputed_against_all_pairs(spark):
    data = rows(2, 150)
    want = counted((a[0], b[0]) for a, b in itertools.combinations(data, 2) if a[1] and a[1] == b[1] and a[4] != b[4] and a[3] != b[3])
    got = {r.id: r.links for r in joins.disputed(spark.createDataFrame(data, SCHEMA), ["entity"], "agent", "value", "id").collect()}
    assert got == want


def grams(text):
    out = set()
    for w in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        w = f"  {w} "
        out |= {w[i : i + 3] for i in range(len(w) - 2)}
    return out


def test_similar_texts_against_all_pairs(spark):
    rng = random.Random(3)
    base = ["the stale snapshot of the early deployment ring", "retry budget of the lazy planner is forty seconds"]
    data = []
    for i in range(140):
        t = rng.choice(base)
        if rng.random() < 0.7:
            t = t.replace(rng.choice("aeo"), rng.choice("aeoé"), 1)
        if rng.random() < 0.2:
            t = t.upper()
        data.append((f"i{i:03}", rng.choice([None, "e", "f"]), rng.choice([None, "", t, t, t]), rng.choice([None, "1", "2"]), "x"))
    pairs = []
    for a, b in itertools.combinations(data, 2):
        if a[1] and a[1] == b[1] and a[2] and b[2] and a[3] != b[3]:
            x, y = grams(a[2]), grams(b[2])
            if len(x & y) * 100 > 85 * len(x | y):
                pairs.append((a[0], b[0]))
    got = {r.id: r.links for r in joins.similar_texts(spark.createDataFrame(data, SCHEMA), "id", "entity", "text", "value", 85).collect()}
    assert got == counted(pairs) and got
    assert joins.similar_texts(spark.createDataFrame([], SCHEMA), "id", "entity", "text", "value", 85).collect() == []


def test_similar_texts_in_tiles(spark, monkeypatch):
    """Groups beyond a tile give the same, and the last plan is small: the whole in one plan took the driver's memory."""
    rng = random.Random(4)
    data = []
    for i in range(120):
        t = list("the stale snapshot of the early deployment ring keeps its retry budget")
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice("qxz")
        data.append((f"i{i:03}", rng.choice(["e", "e", "e", "f"]), "".join(t), rng.choice([None, "1", "2"]), "x"))
    pairs = []
    for a, b in itertools.combinations(data, 2):
        x, y = grams(a[2]), grams(b[2])
        if a[1] == b[1] and a[3] != b[3] and len(x & y) * 100 > 85 * len(x | y):
            pairs.append((a[0], b[0]))
    monkeypatch.setattr(joins, "TILE", 16, raising=False)
    found = joins.similar_texts(spark.createDataFrame(data, SCHEMA), "id", "entity", "text", "value", 85)
    assert {r.id: r.links for r in found.collect()} == counted(pairs) and pairs
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 6


def test_calls_are_resolved_in_order(spark):
    chunks = [
        ("1", "a.py", "function", "a.run", "a", "def run(x):\n    helper(x)\n    b.only(x)\n    self.skip()\n    both()\n    obj.deep(x)\n    run(x)", None, None, None),
        ("2", "a.py", "function", "a.helper", "a", "def helper(x):\n    return (", None, None, None),
        ("3", "b.py", "function", "b.only", "b", None, None, "1", None),
        ("4", "b.py", "function", "b.both", "b", "", None, None, None),
        ("5", "c.py", "function", "c.both", "c", "def both():\n    helper()", None, None, None),
        ("6", "c.py", "method", "c.K.deep", "c", "    def deep(self):\n        pass", None, None, "K"),
        ("7", "c.py", "class", "c.K", "c", None, None, None, None),
        ("8", "c.py", "module", "c", "c", None, ["os.path", "os", "b"], None, None),
    ]
    df = spark.createDataFrame(chunks, "id string, file_path string, chunk_type string, qualified_name string, module_name string, body string, imports array<string>, parent_chunk_id string, class_name string")
    f = df.where("chunk_type IN ('function', 'method')")
    got = {tuple(r) for r in graph.resolved_calls(graph.calls_in(f), f).collect()}
    # helper in its module, b.only exactly, both in two modules, deep by its last part, run not of itself
    assert got == {("a.run", "a.helper"), ("a.run", "b.only"), ("a.run", "c.K.deep"), ("c.both", "a.helper")}
    kinds = {(r.src, r.dst, r.type) for r in graph.code_graph(df).collect()}
    assert {("a.run", "b.only", "CONTAINS"), ("c.K", "c.K.deep", "HAS_METHOD"), ("c.py", "os", "IMPORTS"), ("c.py", "b", "IMPORTS"), ("c.py", "c.K", "DEFINES"), ("a.run", "c.K.deep", "CALLS")} <= kinds
    assert graph.code_graph(df.limit(0)).collect() == []


def test_numbered_equals_one_window(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot"] * 8 + ["b", None]), i * 3 - 100) for i in range(500)]
    rng.shuffle(data)
    got = {(r.g, r.o): r.n for r in numbered(spark.createDataFrame(data, "g string, o long"), "g", "o", "n").collect()}
    for g in ("hot", "b", None):
        mine = sorted(o for h, o in data if h == g)
        assert [got[g, o] for o in mine] == list(range(1, len(mine) + 1))
    assert numbered(spark.createDataFrame([], "g string, o long"), "g", "o", "n").collect() == []
