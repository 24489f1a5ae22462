import random
import re

from vacantia.llm.minhash import near_duplicates

SCHEMA = "doc_id long, text string, id long, n string, bands int"


def brute(rows, width, pct):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    comp = {i: i for i in sets}
    ids = sorted(sets)

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                comp[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def texts():
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(60)] + ["Éa", "ß", "The"]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 8, 40, 90]))]
        for _ in range(rng.choice([1, 2, 25])):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 6)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((n, (" " if n % 2 else "\n").join(t)))
            n += 1
    return rows + [(n, ""), (n + 1, None), (n + 2, " \t\n"), (n + 3, "the THE"), (n + 4, "THE the"), (n + 5, "x" * 100_000)]


def test_against_brute_force(spark):
    rows = texts()
    random.Random(1).shuffle(rows)
    for width in (2, 5):
        df = spark.createDataFrame([(i, t, -1, "c", 3) for i, t in rows], SCHEMA)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, width=width).collect()}
        assert got == brute(rows, width, 80)


def test_blocks_of_large_buckets(spark, monkeypatch):
    from vacantia.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 150)
    rows = texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == brute(rows, 2, 80)


def test_ids_that_are_no_numbers(spark, monkeypatch):
    from vacantia.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = [(f"id-{i:04}", t) for i, t in texts()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), width=2).collect()}
    assert got == brute(rows, 2, 80)


def test_repeats_null_ids_and_empty_table(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (1, "a b c d"), (None, "a b c d"), (7, "q r s")]
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect())
    assert got == [(-1, -1, True), (1, 1, True), (3, 1, False), (3, 1, False), (7, 7, True)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
