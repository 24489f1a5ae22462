import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from vacantia.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, place string"


def brute(convs):
    """Every node by its sequence, from whole conversations {id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, ids in members.items():
        under = [x for x in members if x[: len(node)] == node]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members) for x in under)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        ends = ",".join(map(str, sorted(c for c in ids if tuple(convs[c]) == node)))
        children = sum(len(x) == len(node) + 1 for x in under)
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(spark, convs, local, turnless=()):
    rows = [(c, k, r, t, 5, "x") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    turns = trie.turns_of(spark.createDataFrame(rows, SCHEMA).repartition(4))
    lengths = trie.lengths_of(turns)
    if turnless:
        lengths = lengths.union(spark.createDataFrame([(c, 0) for c in turnless], "conv long, length long"))
    return sorted(map(tuple, trie.prefix_trie(turns, lengths, local=local).collect()), key=str)


def random_convs(n=60, seed=2):
    rng = random.Random(seed)
    convs = {}
    for c in rng.sample(range(-50, 5000), n):
        convs[c] = [(rng.choice("ab"), rng.choice(("x", "é", "yy"))) for _ in range(rng.randrange(1, 9))]
    for c in range(9000, 9030):
        convs[c] = [("system", "hot"), ("user", "hot"), ("a", "end")]
    for c in range(9030, 9050):
        convs[c] = [("system", "hot"), ("user", f"own {c}")]
    return convs


@pytest.mark.parametrize("local", [1, 7, 10**6])
def test_against_brute_force(spark, local):
    convs = random_convs()
    assert made(spark, convs, local, turnless=(77_000, -99)) == brute(convs | {77_000: [], -99: []})


def test_deep_conversations_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "STEPS", 3)
    line = [("u", f"turn {k % 7}") for k in range(90)]
    convs = {1: line, 2: line[:70] + [("u", "other")] * 9, 3: line[:70], 4: line[:5], 5: line[:5], 6: [("u", "turn 1"), ("u", "turn 0")], 7: line[:4] + [line[5], line[4]]}
    assert made(spark, convs, 10) == brute(convs)


def test_nulls_ties_and_repeats(spark):
    rows = [(1, 0, None, None, 1, "x"), (1, None, "u", "first", 1, "x"), (None, 0, "u", "lost", 1, "x"), (2, None, "u", "first", 1, "x"), (2, 3, "", "", 1, "x"), (2, 3, "", "", 1, "x"), (3, 1, "b", "t", 1, "x"), (3, 1, "a", "t", 1, "x"), (4, 1, "a", "t", 1, "x"), (4, 1, "b", "t", 1, "x")]
    turns = trie.turns_of(spark.createDataFrame(rows, SCHEMA))
    got = sorted(map(tuple, trie.prefix_trie(turns, trie.lengths_of(turns)).collect()), key=str)
    tie = sorted([("a", "t"), ("b", "t")], key=lambda x: hashlib.sha256(f"{len(x[0])}:{x[0]}{x[1]}".encode()).digest())
    assert got == brute({1: [("u", "first"), ("", "")], 2: [("u", "first"), ("", ""), ("", "")], 3: tie, 4: tie})


def test_only_turnless_and_none(spark):
    none = trie.turns_of(spark.createDataFrame([], SCHEMA))
    assert trie.prefix_trie(none, trie.lengths_of(none)).collect() == []
    (r,) = trie.prefix_trie(none, spark.createDataFrame([(5, 0), (3, 0)], "conv long, length long")).collect()
    assert tuple(r) == (3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())


def test_centroid_rollup_on_random_forests():
    rng = np.random.default_rng(7)
    for n in (1, 2, 30, 3000):
        parent = np.array([-1 if k == 0 or rng.random() < 0.02 else rng.integers(max(0, k - 4), k) for k in range(n)])
        depth, size = np.zeros(n, dtype=int), rng.integers(1, 9, n)
        weights = rng.integers(0, 100, (n, 2))
        want = weights.copy()
        for k in range(n):
            depth[k] = depth[parent[k]] + 1 if parent[k] >= 0 else 3
        for k in reversed(range(n)):
            if parent[k] >= 0:
                size[parent[k]] += size[k]
                want[parent[k]] += want[k]
        mixed = rng.permutation(n)
        back = np.argsort(mixed)
        shuffled = np.array([-1 if parent[k] < 0 else back[parent[k]] for k in mixed])
        assert np.array_equal(trie.centroid_rollup(shuffled, depth[mixed], size[mixed], weights[mixed]), want[mixed])


def test_digest_of_many_pieces(spark, monkeypatch):
    ids = list(range(-300, 30_000, 7))
    ends = spark.createDataFrame([(1, 2, c) for c in ids] + [(1, 3, 5)], "owner long, depth long, conv long").repartition(9)
    got = {(r.owner, r.depth): r.sha for r in trie._digests(ends).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (1, 3): hashlib.sha256(b"5").hexdigest()}
