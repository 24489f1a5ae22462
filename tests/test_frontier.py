import heapq
import itertools
import os
import random

import pytest

from vacantia.operators import frontier
from vacantia.plans import QUERIES

SF = "/root/testdata/sf0.001"


def simulate(seeds, pages, max_pages, max_depth):
    """One heap an employer."""
    out = []
    for employer in {e for e, _ in seeds}:
        count, queue, visited, n = itertools.count(), [], set(), 0
        for _, url in sorted((e, u) for e, u in seeds if e == employer):
            heapq.heappush(queue, (-frontier.SEED, next(count), url, 0, None))
        while queue and n < max_pages:
            _, _, url, depth, parent = heapq.heappop(queue)
            if url in visited:
                continue
            visited.add(url)
            final, state, links = pages.get(url, (url, "not_captured", []))
            final = final or url
            if final != url and final in visited:
                continue
            visited.add(final)
            out.append((employer, n, url, final, state, depth, parent))
            n += 1
            if state == "ok":
                for u, score in links or []:
                    if u and u not in visited and depth + 1 <= max_depth:
                        heapq.heappush(queue, (-score, next(count), u, depth + 1, final))
    return sorted(out)


@pytest.mark.parametrize(("max_pages", "max_depth"), [(9, 3), (30, 1)])
def test_equals_a_heap(spark, max_pages, max_depth):
    rng = random.Random(max_pages)
    urls = [f"http://h/{k}" for k in range(60)]
    pages = {u: (rng.choice((u, u, u, rng.choice(urls), None)), rng.choice(("ok", "ok", "ok", "http_error")), [(rng.choice([*urls, None, "http://lost/"]), rng.choice((1.0, 5.0, 5.0, 250.0))) for _ in range(rng.randrange(6))]) for u in urls[:55]}
    pages[urls[3]] = (None, "ok", None)
    seeds = [(f"e{k}", rng.choice(urls)) for k in range(12)] + [("e0", urls[7]), ("none", "http://lost/")]
    seeds = sorted(set(seeds))
    df = spark.createDataFrame([(u, *r) for u, r in pages.items()], "url string, final_url string, state string, links array<struct<url:string,score:double>>")
    got = frontier.discover(spark.createDataFrame([*seeds, (None, "x"), ("y", None)], "employer string, url string"), df, max_pages=max_pages, max_depth=max_depth)
    assert sorted((r.employer, r.place, r.requested_url, r.url, r.state, r.depth, r.parent) for r in got.collect()) == simulate(seeds, pages, max_pages, max_depth)


def test_without_seeds(spark):
    df = spark.createDataFrame([], "url string, final_url string, state string, links array<struct<url:string,score:double>>")
    assert frontier.discover(spark.createDataFrame([], "employer string, url string"), df).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_query_equals_a_heap(spark):
    keys = sorted(r.page_id for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id").collect())
    n = len(keys)
    pages = {f"p{k}": (f"p{k - k % 11}" if k % 11 == 3 else f"p{k}", "http_error" if k % 13 == 5 else "ok", [(f"p{(k * 3 + 1) % n}", k * 37 % 100), (f"p{(k * 5 + 2) % n}", k * 53 % 100), (f"p{(k + 10) % n}", 50)]) for k in keys}
    want = simulate([(k, f"p{k}") for k in keys if k < 10], pages, 6, 3)
    got = QUERIES["ot35_frontier"](spark, SF).collect()
    assert sorted((r.employer, r.place, r.requested_url, r.url, r.state, r.depth, r.parent) for r in got) == want


def sequential(plan, budget):
    cache, settled, spent, out = set(), set(), 0, []
    for stage in range(3):
        left = budget - spent
        limit = min(budget, spent + (left if stage == 2 else max(1, left * 2 // 3)))
        for company, _, _, query, resolves in sorted((r for r in plan if r[2] == stage), key=lambda r: (r[1], r[0])):
            if company in settled:
                continue
            runs = query not in cache and spent < limit
            if runs:
                cache.add(query)
                spent += 1
            out.append((company, stage, query, runs, query in cache))
            if query in cache and resolves:
                settled.add(company)
    return sorted(out)


@pytest.mark.parametrize("budget", [0, 1, 2, 7, 40, 1000])
def test_budget_equals_the_sequential_rule(spark, budget):
    rng = random.Random(budget)
    ranks = rng.sample(range(40), 40)
    plan = [(k, ranks[k], s, f"q{rng.randrange(50)}", rng.random() < 0.3) for k in range(40) for s in range(3)]
    got = frontier.budgeted_searches(spark.createDataFrame(plan, "company int, rank int, stage int, query string, resolves boolean"), budget)
    assert sorted(map(tuple, got.collect())) == sequential(plan, budget)
