import hashlib
import math
import re
from collections import defaultdict

from vacantia.llm.mixing import mix_sources


def targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest, w = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        t = {s: 3 * sizes[s] if s in capped else rest * weight[s] / w for s in order}
        over = {s for s in order if s not in capped and t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


def brute(rows):
    by = defaultdict(list)
    for i, text, source in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        u = (int(hashlib.md5(f"mix:{(hashlib.md5(text.encode()).hexdigest() if text is not None else '') if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        q = max(0.1, 1 - abs(len(text) / size - 6) / 12) if size else 0.1
        by[source].append((-math.log(u) / q, i, size))
    t, out = targets({s: sum(x[2] for x in v) for s, v in by.items()}), []
    for s, v in by.items():
        n = sum(x[2] for x in v)
        e = min(3, math.floor(t[s] / n)) if n else 0
        rest, before = t[s] - e * n, 0
        for _, i, size in sorted(v, key=lambda x: (x[0], -1 if x[1] is None else x[1])):
            out.append((i, size, n, round(t[s], 6), size * (e + (2 * before + size <= 2 * rest))))
            before += size
    return sorted(out, key=str)


def rows():
    r = [(k, "word " * (1 + k * 7 % 50) + "longerwords" * (k % 3), "big") for k in range(300)]
    r += [(1000 + k, "tiny text here", "small") for k in range(3)] + [(2000 + k, "a b c d " * k, None) for k in range(40)] + [(3000 + k, "ß é " * 9, "é") for k in range(30)]
    return r + [(4000, None, "big"), (4001, "", "empty"), (None, "no id", "big"), (5000, "x " * 20_000, "a"), (5000, "x " * 20_000, "a")]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*r, 7, "k") for r in rows()], "doc_id long, text string, source string, size int, cell string")
    got = sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mix_sources(df).collect()), key=str)
    assert got == brute(rows())
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mix_sources(df.repartition(5)).collect()), key=str) == got


def test_takes_come_near_targets(spark):
    big = [(k, "w " * (1 + k % 9), f"s{k % 4}") for k in range(4000)]
    got = mix_sources(spark.createDataFrame(big, "doc_id long, text string, source string")).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 9 for s in target)


def test_rows_without_ids_are_drawn_apart(spark):
    """No one key for all rows without an id: about the budget is taken, not the first rows by size."""
    r = [(None, f"w{k} " * (1 + k % 5), "a") for k in range(2000)] + [(k, "w " * 3, "b") for k in range(500)]
    got = mix_sources(spark.createDataFrame(r, "doc_id long, text string, source string")).filter("source = 'a'").collect()
    want = [x for x in brute(r) if x[2] == sum(1 + k % 5 for k in range(2000))]
    assert sorted((x.size, x.taken) for x in got) == sorted((x[1], x[4]) for x in want)
    assert len({x.size for x in got if x.taken}) == 5


def test_edge_is_cut_again(spark, monkeypatch):
    """With one cell for a whole source, the parts and the order within one part still give the same mix."""
    from vacantia.llm import mixing

    monkeypatch.setattr(mixing, "CELLS", 0.01)
    monkeypatch.setattr(mixing, "PARTS", 64)
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mix_sources(df).collect()), key=str) == brute(rows())


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    one = mix_sources(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in one] == [(0, 0.0, 0)]
