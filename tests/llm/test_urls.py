import re

import numpy as np

from vacantia.llm import urls as U


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1:] if fits else None)


URLS = [
    None, "", "no scheme/x", "http://", "http://Example.ORG/es/1?q#f", "https://a.example.org/en/12", "x://example.org/en/2", "x://badexample.org/es/", "x://org", "x://org/", "x://a.com/fr/1", "x://a.com/de/", "x://com/fr", "x://a.net/es/",
    "x://É.com?x=/fr/", "x://a.com#/fr/", "x://u://y.org/", "x://" + "a" * 90_000 + ".net/" + "b/" * 20_000, "http://cheap-pills9.net/x?a=1&b=2",
]


def test_rules_against_brute_force(spark):
    df = spark.createDataFrame([(k % 7, u, "k") for k, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    rows = U.judge_urls(df).collect()
    want = sorted(((k % 7, *brute(u)[:2], *(brute(u)[2] or (None, None))) for k, u in enumerate(URLS * 2)), key=str)
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in rows), key=str)
    assert got == want
    assert {r.verdict for r in rows} <= {"allow", "block"}
    assert all(0 <= r.block_score <= 1 for r in rows if r.rule is None)


def test_trees_learn_lexical_features(spark):
    rng = np.random.default_rng(0)
    spam = [f"http://cheap-{rng.integers(1e6)}-pills.biz/{rng.integers(1e9)}?a=1&b={k}&c=3" for k in range(300)]
    ham = [f"https://www.{'abcdefgh'[k % 8] * 4}site.net/en/article" for k in range(300)]
    labelled = spark.createDataFrame([(u, "block") for u in spam[:200]] + [(u, "allow") for u in ham[:200]], "url string, verdict string")
    df = spark.createDataFrame(list(enumerate(spam[200:] + ham[200:])), "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge_urls(df, rules=(), labelled=labelled).collect()}
    assert np.mean([(got[k] == "block") == (k < 100) for k in got]) > 0.97


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x://a.net/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in U.judge_urls(df).collect()} == {"allow"}
    assert U.judge_urls(df.limit(0)).collect() == []


def plain_features(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else url
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, _, path = rest.partition("/")
    labels = host.split(".")
    p = [url.count(c) / len(url) for c in set(url)]
    return [
        len(url), len(host), len(path), sum(bool(x) for x in path.split("/")), len(re.findall("[0-9]", url)) / max(len(url), 1), -sum(x * np.log2(x) for x in p), len(query.split("&")) if query else 0, len(query),
        len(labels), len(labels[-1]), host.count("-"), len(re.findall("[0-9]", host)), max(map(len, labels)), int(bool(re.search("[0-9]/*$", path))), len(fragment),
    ]


def test_features_against_plain_python(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    from pyspark.sql import functions as F

    for r in df.select("url", U.features(F.col("url")).alias("x"), U.suffix_of(F.col("url")).alias("s")).collect():
        assert np.allclose(r.x, plain_features(r.url)), (r.url or "")[:80]
        rest = (r.url or "").split("://", 1)[-1]
        assert r.s == re.match("[^/?#]*", rest)[0].lower().split(".")[-1]


def plain_trees(x, y):
    """Boosting by trying every split of every node; probabilities of the training rows."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, U.BINS + 1)[1:-1])) for c in x.T]
    b = [[int(sum(v > e for e in edges[k])) for k, v in enumerate(row)] for row in x]
    rate = min(max(sum(y) / len(y), 1e-3), 1 - 1e-3)
    f = [float(np.log(rate / (1 - rate)))] * len(y)
    for _ in range(U.TREES):
        p = [1 / (1 + np.exp(-v)) for v in f]
        node = [0] * len(y)
        for at in range(2**U.DEPTH - 1):
            mine = [i for i in range(len(y)) if node[i] == at]
            g, h = sum(y[i] - p[i] for i in mine), sum(p[i] * (1 - p[i]) for i in mine)
            best, choice = 1e-6, None
            for k in range(x.shape[1]):
                for cut in range(U.BINS - 1):
                    left = [i for i in mine if b[i][k] <= cut]
                    if len(left) < U.LEAST_LEAF or len(mine) - len(left) < U.LEAST_LEAF:
                        continue
                    gl, hl = sum(y[i] - p[i] for i in left), sum(p[i] * (1 - p[i]) for i in left)
                    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                    if gain > best + 1e-12:
                        best, choice = gain, (k, cut)
            if choice:
                for i in mine:
                    node[i] = 2 * at + 1 + (b[i][choice[0]] > choice[1])
        for leaf in set(node):
            own = [i for i in range(len(y)) if node[i] == leaf]
            step = U.RATE * sum(y[i] - p[i] for i in own) / (sum(p[i] * (1 - p[i]) for i in own) + 1)
            for i in own:
                f[i] += step
    return 1 / (1 + np.exp(-np.array(f)))


def test_trees_against_plain_boosting(monkeypatch):
    monkeypatch.setattr(U, "TREES", 4)
    monkeypatch.setattr(U, "BINS", 8)
    monkeypatch.setattr(U, "LEAST_LEAF", 2.0)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (60, 3)).astype(float) + rng.random((60, 3))
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 6)).astype(float)
    assert np.allclose(U.Trees(x, y).probability(x), plain_trees(x, y), atol=1e-9)


def test_sample_is_the_smallest_hashes(spark):
    rows = [(f"http://h{k}.net/{k}", "block" if k % 3 else "allow") for k in range(3000)]
    df = spark.createDataFrame(rows * 2, "url string, verdict string")
    asked = []

    class Spy(U.UrlModel):
        def __init__(self, x, suffixes, blocked):
            asked.append((len(x), int(blocked.sum())))
            super().__init__(x, suffixes, blocked)

    whole, U.UrlModel = U.UrlModel, Spy
    try:
        U.learn(df, sample=500)
        U.learn(df, sample=5000)
    finally:
        U.UrlModel = whole
    assert asked[0][0] == 500 and asked[1] == (3000, 2000)
