import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vacantia.llm import lm


def toks(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]


def fold(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7


def rows():
    rng = random.Random(2)
    vocab = ["The", "of", "é", "x"] + [f"w{k}" for k in range(30)]
    chain = lambda n: " ".join(vocab[min(int(rng.expovariate(0.15)), len(vocab) - 1)] if k % 2 else vocab[k % 7] for k in range(n))
    return [(k, chain(rng.randrange(0, 40))) for k in range(300)] + [(5, "the of"), (None, "no id"), (900, None), (901, ""), (902, "Z" * 70_000)]


def model(rows):
    train = [(i, toks(t)) for i, t in rows if fold(i) != 2]
    c1 = Counter(w for _, ws in train for w in ws)
    c2 = Counter(p for _, ws in train for p in zip([None, *ws[:-1]], ws, strict=True))
    return c1, c2, sum(c1.values()), len(c1)


def test_base_scores_and_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_LEAST", 4000)
    monkeypatch.setattr(lm, "BLOCK_ROOT", 1)
    data = rows()
    got = lm.lm_scores(spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, block int")).collect()
    c1, c2, n, v = model(data)
    want = sorted(((i, fold(i) == 2, len(toks(t)), sum(c1[w] > 0 for w in toks(t)), n, round(sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in toks(t)), 6)) for i, t in data), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score <= 0 for r in got)


@pytest.mark.parametrize("order", [2, 3])
def test_scores_against_brute_force(spark, monkeypatch, order):
    data = rows()
    weights = {}
    learn = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a: weights.setdefault("w", learn(*a)))
    monkeypatch.setattr(lm, "BLOCK_LEAST", 3000)
    monkeypatch.setattr(lm, "BLOCK_ROOT", 1)
    df = spark.createDataFrame([(str(i) if i is not None else None, t) for i, t in data], "doc_id string, text string").repartition(3)
    got = {(r.doc_id, r.n_tokens): r.score for r in lm.lm_scores(df, order=order).collect()}
    c1, c2, n, v = model(data)
    train = [toks(t) for i, t in data if fold(i) != 2]
    c3 = Counter(x for ws in train for x in zip([None, None, *ws[:-2]], [None, *ws[:-1]], ws))
    bucket = lambda c: min(1 + int(math.log2(c)), lm.CLASSES - 1) if c else 0
    w = weights["w"]
    for i, t in data:
        total, ws = 0, toks(t)
        for k, x in enumerate(ws):
            a, b = (ws[k - 2] if k > 1 else None), (ws[k - 1] if k else None)
            pair = c2[a, b] if k and order == 3 else 0
            at = lm.CLASSES + bucket(pair) if pair else bucket(c1[b])
            p = w[2, at] * c1[x] / n + w[3, at] / (v + 1)
            p += w[1, at] * c2[b, x] / c1[b] if c1[b] else 0
            p += w[0, at] * c3[a, b, x] / pair if pair else 0
            total += math.log10(p)
        assert got[None if i is None else str(i), len(ws)] == pytest.approx(total, abs=1e-6)


def cell(before, pair_before, word, pair, triple):
    level = lambda p: int(lm._level(np.array([float(p)]))[0])
    out = int(lm._context_class(np.array([before]), np.array([pair_before]))[0])
    for p in (triple / pair_before if pair_before else 0, pair / before if before else 0, 1 / word if word else 0):
        out = out * 256 + level(min(p, 1))
    return out


def test_em_finds_the_better_part():
    w = lm.learn_weights(np.array([cell(64, 0, 2, 64, 0), cell(4, 0, 500, 0, 0), cell(64, 16, 2, 1, 16)]), np.array([100.0] * 3), 1000, 50)
    assert w[1, 7] > 0.9 and w[2, 3] > 0.9 and w[0, lm.CLASSES + 5] > 0.9
    assert np.allclose(w.sum(axis=0), 1)


def test_em_against_plain_rounds():
    rng = np.random.default_rng(8)
    cells = {}
    for _ in range(60):
        code = cell(*(int(rng.integers(0, n)) for n in (30, 9, 50, 9, 5)))
        cells[code] = cells.get(code, 0) + 1
    got = lm.learn_weights(np.array(list(cells)), np.array(list(cells.values()), dtype=float), 900, 80)
    grid = lambda x: 2 ** (-(x - 1) / lm.GRID) if x else 0.0
    w = {}
    for _ in range(lm.EM_ROUNDS):
        sums = {}
        for code, n in cells.items():
            once, pair, triple = (grid(code >> 8 * k & 255) for k in range(3))
            at = code >> 24
            old = w.get(at) or ([0, 0, 0.9, 0.1] if at == 0 else [0, 0.4, 0.5, 0.1] if at < lm.CLASSES else [0.2, 0.3, 0.4, 0.1])
            p = [triple, pair, (1 / once if once else 0) / 900, 1 / 81]
            each = [a * b for a, b in zip(old, p)]
            for k in range(4):
                sums.setdefault(at, [0.0] * 4)[k] += n * each[k] / sum(each)
        w = {at: [x / sum(v) for x in v] for at, v in sums.items()}
    for at, v in w.items():
        v = [max(v[0], 0), max(v[1], 0), max(v[2], 1e-6), max(v[3], 1e-6)]
        assert np.allclose(got[:, at], np.array(v) / sum(v), atol=1e-9)


def test_empty(spark):
    assert lm.lm_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimates_end_at_one_where_keys_are_shared():
    assert lm._ratio(np.array([5.0, 1.0, 3.0]), np.array([2.0, 4.0, 0.0])).tolist() == [1.0, 0.25, 0.0]
