import hashlib
import random
import re

import numpy as np

from vacantia.llm import _text, imatch

NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def rows():
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(3000)] + ["É", "ß"]
    out = [(k * 3, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 300)))) for k in range(120)]
    return out + [(1, out[5][1]), (2, None), (4, ""), (5, "ß𝒳é"), (7, "zz " * 30_000), (7, "zz " * 30_000)]


def run(spark, data):
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, part string").repartition(7)
    return imatch.fingerprints(df).select(*NAMES).collect()


def test_edited_texts_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(imatch, "PART_BYTES", 20_000)
    data = rows()
    got = run(spark, data)
    order = sorted(((i, t or "") for i, t in data), key=lambda r: -r[0])
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by_text = {}
    for r in got:
        text = next(t or "" for i, t in order if i == r.doc_id)
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(set(by_text.values())) == len(by_text)
    long = [r for r in got if r.n_chars > 300 and r.doc_id != 7]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.9
    assert np.mean([r.near_edited for r in long]) > 0.2 > np.mean([r.near_next for r in long])


def test_lexicon_is_the_band(spark):
    df = spark.createDataFrame([(k, f"all some{k % 4} own{k} all") for k in range(40)], "doc_id long, text string")
    assert len(imatch.lexicon(df, low=0.1, high=0.5)) == 4
    assert len(imatch.lexicon(df, low=0.1, high=1.0)) == 5


M = 2**64 - 1


def mix(x):
    for shift, times in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> shift)) * times & M
    return x ^ (x >> 33)


def word_hash(word):
    raw = word.encode()
    return mix((sum(int(_text._BYTE[b]) * pow(_text._STEP, k, 2**64) for k, b in enumerate(raw)) + len(raw)) & M)


def plain_marks(words, known, levels):
    """{(level, draw): hash} of a document by sets."""
    hashes = {word_hash(w) for w in words}
    own = (hashes & known) or hashes
    out = {}
    for draw in range(imatch.DRAWS):
        x = [mix(h ^ int(imatch._SALTS[draw])) for h in own]
        for level in range(levels):
            inside = [v for v in x if v < ((1 << 64 >> level) - 1)]
            if inside:
                out[level, draw] = max(1, mix(sum(mix((v + draw + 1) & M) for v in inside) & M))
    return out


def plain_likeness(a, b, levels):
    top = bottom = 0.0
    for level in range(levels):
        draws = range(imatch.DRAWS)
        filled = [d for d in draws if (level, d) in a or (level, d) in b]
        w = (imatch.DRAWS - len(filled)) / imatch.DRAWS
        w = max(w, 1 / imatch.DRAWS) if level == levels - 1 else w
        top += w * sum(a.get((level, d)) == b.get((level, d)) for d in filled)
        bottom += w * len(filled)
    return min(top / max(bottom, 1e-9), 0.999)


def test_fingerprints_against_plain_sets(spark):
    """Fingerprints and likenesses of all documents by dictionaries: band by counting documents, subsets and hashes one word at a time."""
    rng = random.Random(4)
    data = [(k, " ".join(f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(rng.randrange(1, 120)))) for k in range(150)] + [(500, "?!"), (501, "solo")]
    order = sorted(data, reverse=True)
    sets = {t: set(re.findall(r"[^\W_]+", t)) for _, t in data}
    df = {}
    for _, t in data:
        for w in sets[t]:
            df[w] = df.get(w, 0) + 1
    n = len(data)
    known = {word_hash(w) for w, c in df.items() if max(2, int(np.ceil(imatch.LOW * n))) <= c <= max(2, int(imatch.HIGH * n))}
    levels = max(imatch.LEVELS, max(map(len, sets.values())).bit_length() + 1)
    got = {r.doc_id: r for r in run(spark, data)}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        cut = imatch.edited(t, nxt)
        a, b, c = (plain_marks(set(re.findall(r"[^\W_]+", x)), known, levels) for x in (t, cut, nxt))
        for text, marks, name in ((t, a, "fingerprint"), (cut, b, "edited_fingerprint")):
            telling = [lv for lv in range(levels) if lv == levels - 1 or any((lv, d) not in marks for d in range(imatch.DRAWS))]
            spelled = f"{telling[0]:02x}:" + "".join(f"{lv * imatch.DRAWS + d:03x}{marks[lv, d]:016x}" for lv in telling for d in range(imatch.DRAWS) if (lv, d) in marks)
            assert got[i][name] == (spelled if marks else "text:" + hashlib.sha256(text.encode()).hexdigest())
        assert abs(got[i].near_edited - (1.0 if got[i].fingerprint == got[i].edited_fingerprint else plain_likeness(a, b, levels))) < 1e-9
        assert abs(got[i].near_next - plain_likeness(a, c, levels)) < 1e-9


def test_likeness_is_near_the_jaccard_similarity():
    rng, known = random.Random(9), None
    errors = []
    for share in (0.1, 0.33, 0.6, 0.9):
        for k in range(40):
            words = [f"x{k}y{j}" for j in range(300)]
            other = words[: int(300 * share)] + [f"z{k}y{j}" for j in range(300 - int(300 * share))]
            known = known if known is not None else np.empty(0, dtype=np.uint64)
            texts = [" ".join(rng.sample(x, len(x))).encode() for x in (words, other)]
            marks = imatch._marks(*imatch._arrow(texts), known, 12)
            jaccard = len(set(words) & set(other)) / len(set(words) | set(other))
            errors.append(imatch._likeness(marks[:1], marks[1:], np.array([False]))[0] - jaccard)
    assert -0.08 < np.mean(errors) < 0.03 and np.std(errors) < 0.15


def test_one_and_none(spark):
    (r,) = run(spark, [(1, "abcd")])
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert run(spark, []) == []


def test_near_copies_of_a_third_of_all_rows(spark):
    """A group's words stay in the lexicon: its members are alike, whole or with one word changed, and unlike others."""
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(2000)]
    text = lambda: [rng.choice(vocab) for _ in range(80)]
    core, data = text(), []
    for k in range(300):
        words = list(core) if k < 100 else text()
        if 50 <= k < 100:
            words[rng.randrange(80)] = f"own{k}"
        data.append((k, " ".join(words)))
    got = {r.doc_id: r for r in run(spark, data)}
    assert not any(r.fingerprint.startswith("text:") for r in got.values())
    assert np.mean([got[k].near_next for k in range(51, 100)]) > 0.6
    assert np.mean([got[k].near_next for k in range(101, 300)]) < 0.2
    assert np.mean([got[k].near_edited for k in range(102, 300)]) > 0.2
    bare = {r.doc_id: r for r in run(spark, [(k, f"a b c d e f g h i j k l m n o p q{k}") for k in range(20)])}
    assert np.mean([bare[k].near_next for k in range(1, 20)]) > 0.4


def test_half_edit_of_over_ten_thousand_lexicon_words(spark):
    """The likeness of an edited text does not fall with its length."""
    rng = random.Random(6)
    data = [(k, f"short{k} text{k}") for k in range(100, 140)]
    for k in range(6):
        words = [f"d{k}w{j}" for j in range(11_000)]
        data.append((50 - k, " ".join(words)))
        data.append((10 - k, " ".join(rng.sample(words, len(words)))))  # puts the words into the band
    got = {r.doc_id: r for r in run(spark, data)}
    assert np.mean([got[50 - k].near_edited for k in range(5)]) > 0.12
    assert max(got[50 - k].near_next for k in range(5)) < 0.05
