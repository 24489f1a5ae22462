import random
import zlib

import numpy as np

from vacantia.llm import langid

SYL = {"xx": "ta ko mi ru ne".split(), "yy": "sch ung ber ö tz".split(), "zz": "αβ γδ λο".split()}


def rows(n=400):
    rng = random.Random(4)
    word = lambda lang: "".join(rng.choice(SYL[lang]) for _ in range(rng.randrange(1, 4)))
    out = [(k, " ".join(word(lang) for _ in range(rng.randrange(3, 60))), lang) for k in range(n) for lang in [rng.choice(list(SYL))]]
    return out + [(9000, None, "xx"), (9001, "", "yy"), (9002, "123 !?", "xx"), (9003, "tako miru neta", None), (None, "schung ber", None), (9004, "TAKO " * 30_000, None), (9005, "qqqq wwww jjjj vvvv " * 40, None)]


def test_held_out_accuracy_and_rejection(spark):
    df = spark.createDataFrame([(*r, 0.5, "k") for r in rows()], "doc_id long, text string, lang string, score double, held_out string")
    got = {r.doc_id: r for r in langid.identify(df, langid.learn(df)).collect()}
    truth = {i: lang for i, _, lang in rows() if lang and i < 9000}
    held = [i for i in truth if got[i].held_out]
    assert len(held) > 50
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.98
    assert not any(got[i].rejected for i in truth)
    for i in (9000, 9001, 9002):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[9003].lang_pred == "xx" and got[9004].lang_pred == "xx" and got[None].lang_pred == "yy"
    assert got[9005].rejected
    assert all(0 <= r.score <= 1 for r in got.values())


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 64**3, 500))
    m = langid.KneserNey(grams, rng.integers(1, 9, len(grams)))
    for context in [int(grams[0]) // 64, 5 * 64 + 7, 63 * 64 + 63]:
        assert abs(np.exp(m.log_p(context * 64 + np.arange(64))).sum() - 1) < 1e-4


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(df, langid.learn(df)).collect()] == ["und"]
    assert langid.identify(df.limit(0), langid.learn(df.limit(0))).collect() == []


def test_labelled_junk_does_not_lift_the_limit(spark):
    """Junk with a label in the calibration fold, few rows or many: junk stays rejected and texts stay accepted."""
    rng = random.Random(5)
    junk = lambda: " ".join(rng.choice(["tako", "miru", "neta", "qjvw", "wqjx"]) for _ in range(60))
    calibrates = [i for i in range(20_000, 21_000) if zlib.crc32(str(i).encode()) % langid.FOLDS == langid.CALIBRATES]
    for odd in (1, 12):
        data = [*rows(), *((i, junk(), "xx") for i in calibrates[:odd]), (9100, junk(), None), (9101, "tako miru " * 20, None)]
        df = spark.createDataFrame(data, "doc_id long, text string, lang string")
        got = {r.doc_id: r for r in langid.identify(df, langid.learn(df)).collect()}
        assert got[9100].lang_pred == "xx" and got[9100].rejected
        assert not got[9101].rejected and not any(got[i].rejected for i, _, lang in rows() if lang and i < 9000)


def test_rare_scripts_keep_their_letters(spark):
    """Two languages of one script stay apart, however many letters the others use up."""
    rng = random.Random(7)
    common = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 80))
    words = {"zh": common, "el": "αβγδεζηθικλμ", "he": "אבגדהוזחטיכל", "hy": "աբգդեզէըթժիլ", "ja": "ぁあぃいぅうぇえぉおかが"}
    data = []
    for k in range(600):
        lang = "zh" if k < 400 else rng.choice(["el", "he", "hy", "ja"])
        data.append((k, " ".join("".join(rng.choice(words[lang]) for _ in range(4)) for _ in range(25)), lang))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, langid.learn(df)).collect() if r.held_out}
    assert {lang for i, _, lang in data if i in got} == set(words)
    assert all(got[i].lang_pred == lang for i, _, lang in data if i in got)


def test_against_plain_kneser_ney():
    """Every trigram over a small alphabet, seen or not, against the formula written with dictionaries."""
    size, rng = 7, np.random.default_rng(3)
    grams = np.unique(rng.integers(0, size**3, 90))
    counts = rng.integers(1, 6, len(grams))
    c3 = {(g // 49, g // 7 % 7, g % 7): int(n) for g, n in zip(grams.tolist(), counts, strict=True)}
    before2 = {}  # symbols seen before each pair, then before each symbol
    for x, y, z in c3:
        before2.setdefault((y, z), set()).add(x)
    n2 = {k: len(v) for k, v in before2.items()}
    n1 = {}
    for _, z in n2:
        n1[z] = n1.get(z, 0) + 1

    def discount(values):
        one, two = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return min(max(one / (one + 2 * two), 0.1), 0.9) if one else 0.5

    d3, d2, d1 = discount(c3.values()), discount(n2.values()), discount(n1.values())

    def p1(z):
        total = sum(n1.values())
        return max(n1.get(z, 0) - d1, 0) / total + d1 * len(n1) / total / size

    def p2(y, z):
        own = {k: v for k, v in n2.items() if k[0] == y}
        total = sum(own.values())
        return p1(z) if not total else max(n2.get((y, z), 0) - d2, 0) / total + d2 * len(own) / total * p1(z)

    def p3(x, y, z):
        own = {k: v for k, v in c3.items() if k[:2] == (x, y)}
        total = sum(own.values())
        return p2(y, z) if not total else max(c3.get((x, y, z), 0) - d3, 0) / total + d3 * len(own) / total * p2(y, z)

    got = np.exp(langid.KneserNey(grams, counts, size).log_p(np.arange(size**3)))
    want = [p3(x, y, z) for x in range(size) for y in range(size) for z in range(size)]
    assert np.allclose(got, want, rtol=1e-5)
