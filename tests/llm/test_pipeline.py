import random

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def data(spark, tmp_path):
    rng = random.Random(6)
    syl = {"xx": "ta ko mi ru ne lo".split(), "yy": "sch ung ber ö tz ein".split()}
    text = lambda lang, n: " ".join("".join(rng.choice(syl[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    item = text("xx", 14)
    rows = [(k, text(lang, rng.randrange(20, 80)), lang, f"s{k % 3}") for k in range(160) for lang in [("xx", "yy")[k % 2]]]
    words = rows[10][1].split()
    rows += [(500, rows[10][1], "xx", "s0"), (501, " ".join(words[:-1]) + " end", "xx", "s1")]
    rows += [(600, "mi " + item + " ta", "xx", "s2"), (601, text("xx", 30) + " write a.b@c.org now", "xx", "s0"), (700, None, "xx", "s0"), (701, "123 456", None, "s1"), (None, text("yy", 30), None, None)]
    rows += [(601, rows[-4][1], "xx", "s0")]
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows


def test_stages(spark, tmp_path):
    rows = data(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
        kept.append({r.doc_id: r for r in docs.collect()})
    language, dedup, clean, masked = kept
    everyone = {r[0] for r in rows}
    assert everyone - set(language) == {700, 701}
    assert set(language) - set(dedup) <= {500, 501} and 500 not in dedup and 10 in dedup
    assert set(dedup) - set(clean) == {600}
    assert set(masked) == set(clean) and masked[601].text.endswith("write [EMAIL] now") and masked[601].n_chars == len(masked[601].text)
    assert docs.count() == len(masked)
    mixed = P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    sizes = {s: sum(len(r.text.split()) for r in masked.values() if r.source == s) for s in {r.source for r in masked.values()}}
    for s in sizes:
        taken = [r for r in mixed if r.source == s]
        assert abs(sum(r.size for r in taken) - taken[0].target) <= 80
        assert max(r.epoch for r in taken) <= 3


def test_unlike_texts_under_one_id_stay(spark, tmp_path):
    words = lambda k: " ".join(f"w{(k * 7919 + j * 104729) % 5000}" for j in range(40))
    rows = [(1, words(1), "xx", "a"), (1, words(2), "xx", "b"), (2, words(1), "xx", "c"), (None, words(3), "xx", "a"), (None, words(3) + " end", None, "a"), (None, None, None, None), (42, words(4), "xx", None), (42, words(4), "xx", None), (7, "", None, "z")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], SCHEMA)
    got = sorted((str(r.doc_id), r.text or "", r.source or "") for r in P.near_dedup(spark, docs, str(tmp_path)).collect())
    assert [x[0] for x in got] == sorted(["1", "1", "None", "None", "42", "7"]) and ("1", rows[0][1], "a") in got and ("1", rows[1][1], "b") in got  # which of the copies without an id stays is set by their digest
    item = " ".join(words(2).split()[5:16])
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = P.decontaminate(spark, docs, str(tmp_path)).collect()
    assert sorted(r.text or "" for r in clean) == sorted((t or "") for _, t, _, _ in rows if t != rows[1][1])


def test_run_is_the_stages(spark, tmp_path):
    data(spark, tmp_path)
    a = sorted((r.doc_id or -1, r.epoch) for r in P.run(spark, str(tmp_path)).collect())
    assert a == sorted((r.doc_id or -1, r.epoch) for r in P.run(spark, str(tmp_path)).collect()) and len(a) > 100


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
