import random
import re

from vacantia.llm import decontam

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def toks(t):
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, width=10):
    out = []
    for i, t in docs:
        w, hit, names = toks(t), set(), set()
        for name, text in items:
            q = toks(text)
            n = min(width, len(q))
            for a in range(len(q) - n + 1) if n else []:
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[a : a + n]:
                        hit.update(range(p, p + n))
                        names.add(str(name))
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


def data():
    rng = random.Random(3)
    vocab = [f"v{k}" for k in range(9)] + ["É", "the", "of", "x9"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 10, 14, 30])))) for k in range(24)] + [(99, None), (100, "zebra!Crossing"), (3, "of of of")]
    docs = []
    for k in range(40):
        t = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t) + 1) : 0] = (rng.choice(items)[1] or "").split()
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(t)))
    return docs + [(7, docs[7][1]), (50, None), (51, ""), (52, "ZEBRA crossing zebra"), (None, "of of of"), (53, "a" * 50_000 + " zebra crossing")], items


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 0, "z") for i, t in docs], "doc_id long, text string, id int, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(d, b, **kw).collect()), key=str)


def test_against_brute_force(spark):
    docs, items = data()
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    docs, items = data()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    monkeypatch.setattr(decontam, "CANDIDATES", 5)
    assert run(spark, docs, items) == brute(docs, items)


def test_pieces_of_long_items_and_an_index_of_all_words(spark, monkeypatch):
    docs, items = data()
    monkeypatch.setattr(decontam, "PIECE", 3)
    monkeypatch.setattr(decontam, "VOCABULARY", 4)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
    assert run(spark, docs, items) == brute(docs, items)


def test_ids_of_any_type(spark):
    docs, items = data()
    d = spark.createDataFrame([(f"d{i}", t) for i, t in docs], "doc_id string, text string")
    got = decontam.contamination(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == brute([(f"d{i}", t) for i, t in docs], items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [])]


def test_proximity(spark):
    docs = [(1, "rare x x of x the"), (2, "rare " + "x " * 30 + "of the"), (3, "of the"), (4, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, "the rare of")], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in decontam.proximity(d, b, slop=6).collect()}
    assert got == {1: ["5"], 2: [], 3: [], 4: []}


def test_items_without_id_count(spark, monkeypatch):
    """As in the query's SQL: their windows hit, together they are one item, and they have no name."""
    docs, items = [(1, "see the lazy dog run"), (2, "a lazy dog or a quick fox"), (3, "nothing")], [(None, "lazy dog"), (None, "dog run"), (4, "quick fox")]
    want = [(1, 5, 3, [None]), (2, 7, 4, ["4", None]), (3, 1, 0, [])]
    assert run(spark, docs, items) == want
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 9)
    assert run(spark, docs, items) == want
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: r["items"] for r in decontam.proximity(d, b).collect()} == {1: [None], 2: ["4", None], 3: []}
