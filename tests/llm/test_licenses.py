import random
import re

from vacantia.llm import licenses as L

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(text):
    w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = sorted((p, label) for phrase, label in L.BASE_PHRASES.items() for q in [phrase.split()] for p in range(len(w)) if w[p : p + len(q)] == q)
    starts = [p for p, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    None, "", "no words: ... !", "Under the MIT License. under,the\nmit-license", "cc by nc cc by nc by nc", "É Apache License, Version 2.0 under the mit licenses",
    "xunder the mit license", "under the mit", "license under the mit license", "ß " * 40_000 + "CC-BY-NC", "Apache License Version 2" * 3,
]


def test_base_against_brute_force(spark):
    df = spark.createDataFrame([(k, t, 5, "c") for k, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, id string").repartition(3)
    got = {r.doc_id: tuple(r)[1:6] for r in L.scan_licenses(df).collect()}
    assert got == {k: brute(t) for k, t in enumerate(TEXTS)}


def test_expressions():
    value = lambda s: L.evaluate(L.to_rpn(L.tokens(s)))
    assert L.to_rpn(L.tokens("MIT OR GPL-2.0 WITH x AND BSD-3-Clause")) == ["MIT", "GPL-2.0", "x", "with", "BSD-3-Clause", "and", "or"]
    assert value("MIT OR GPL-2.0-only") == ({"mit", "gpl"}, 3)
    assert value("(MIT OR GPL-3.0) AND CC-BY-NC-4.0 is what") == ({"mit", "gpl", "cc-by-nc"}, 0)
    assert value("GPL-2.0 WITH Classpath-exception-2.0") == ({"gpl"}, 2)
    assert value("Apache-2.0 */ more") == ({"apache-2"}, 3)
    assert value("(mit or") == ({"mit"}, 3)
    assert value("") is None and value(") x") is None and value("nonsense") == (set(), 0)


def test_identifiers_outside_the_families_are_their_own_labels(spark):
    texts = ["SPDX-License-Identifier: LicenseRef-Foo", "SPDX-License-Identifier: Beerware-2.0-only OR MIT", "SPDX-License-Identifier: GPL-2.0 WITH Odd-exception-1.0", "SPDX-License-Identifier: whatever you like"]
    got = L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert [(r.labels, r.openness) for r in sorted(got)] == [("licenseref-foo", "restricted"), ("beerware-2.0,mit", "permissive"), ("gpl", "weak copyleft"), ("", None)]


def test_labels_and_score(spark):
    texts = ["// SPDX-License-Identifier: (MIT OR Apache-2.0)\nx", "GNU Lesser General Public License v3", "plain", "under the MIT license. All rights reserved"]
    got = L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert [(r.labels, r.openness, r.score) for r in sorted(got)] == [("apache-2,mit", "permissive", 0.95), ("lgpl", "weak copyleft", 0.6), ("", None, 0.0), ("mit,proprietary", "restricted", 0.96)]
    assert L.scan_licenses(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_long_and_wrapped_expressions(spark):
    long = "(" + " OR ".join(["BSD-3-Clause"] * 60) + ") AND (ISC OR MIT)"
    texts = [
        f"SPDX-License-Identifier: {long} AND Apache-2.0", "# SPDX-License-Identifier: (MIT OR\n#   Apache-2.0) AND ISC\n# Zlib", "/* SPDX-License-Identifier: (MIT\r\n *\n * AND GPL-2.0) */",
        "SPDX-License-Identifier: (MIT OR\n */\nGPL-2.0 and", "SPDX-License-Identifier: (MIT OR Apache-2.0\nand some words", "SPDX-License-Identifier: MIT\nOR GPL-2.0", "SPDX-License-Identifier: ((MIT OR ISC)\nAND (Zlib OR\nBSD-2-Clause))",
    ]
    got = L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert [(r.labels, r.openness) for r in sorted(got)] == [
        ("apache-2,bsd,isc,mit", "permissive"), ("apache-2,isc,mit", "permissive"), ("gpl,mit", "copyleft"), ("mit", "permissive"), ("apache-2,mit", "permissive"), ("mit", "permissive"), ("bsd,isc,mit,zlib", "permissive"),
    ]


def family(name):
    low = name.lower()
    for prefix, label, n in L.FAMILIES:
        if low == prefix or low.startswith((prefix + "-", prefix + ".")) or (low.startswith(prefix) and low[len(prefix) : len(prefix) + 1].isdigit()):
            return {label}, n
    if not any(c in "-." or c.isdigit() for c in low):
        return set(), 0
    for end in ("-only", "-or-later"):
        low = low.removesuffix(end)
    return {low.rstrip("+")}, 0


def descend(words):
    """A licence expression by recursive descent: or over and over with over operands."""

    def operand():
        if words[0] != "(":
            return family(words.pop(0))
        words.pop(0)
        value = level("or")
        words.pop(0)
        return value

    def level(op):
        below = {"or": lambda: level("and"), "and": lambda: level("with"), "with": operand}[op]
        value = below()
        while words and words[0].lower() == op:
            words.pop(0)
            other = below()
            if op == "with":
                value = value[0], value[1] + (value[1] in (1, 2))
            else:
                value = value[0] | other[0], (max if op == "or" else min)(value[1], other[1])
        return value

    return level("or")


def test_labels_against_a_plain_scan(spark):
    rng = random.Random(12)
    names = ["MIT", "GPL-2.0", "Apache-2.0", "LGPL-3.0-only", "SSPL-1.0", "0BSD", "Unknown-1", "MPL-2.0", "CDDL-1.0"]

    def expression(depth):
        if depth == 0 or rng.random() < 0.3:
            return [rng.choice(names)]
        if rng.random() < 0.2:
            return [rng.choice(names), "WITH", "Some-exception"]
        inner = expression(depth - 1) + [rng.choice(["AND", "OR", "or"])] + expression(depth - 1)
        return ["(", *inner, ")"] if rng.random() < 0.5 else inner

    texts, want = [], []
    for _ in range(300):
        parts, finds, sorts = [], [], set()
        for _ in range(rng.randrange(4)):
            kind = rng.choice(["tag", "notice", "base", "plain"])
            if kind == "tag":
                e = expression(3)
                parts.append("SPDX-License-Identifier: " + " ".join(e))
                value = descend(list(e))
                if value[0]:
                    finds.append(value)
                    sorts.add("tag")
            elif kind == "notice":
                phrase = rng.choice([p for p in L.NOTICES if not any(q != p and q in p for q in [*L.NOTICES, *L.BASE_PHRASES])])
                finds.append(({L.NOTICES[phrase]}, L.OPENNESS[L.NOTICES[phrase]] if L.NOTICES[phrase] in L.OPENNESS else 0))
                sorts.add("notice")
                parts.append(phrase.title().replace(" ", rng.choice([" ", ", ", "-"])))
            elif kind == "base":
                phrase = rng.choice(list(L.BASE_PHRASES))
                finds.append(({L.BASE_PHRASES[phrase]}, L.OPENNESS[L.BASE_PHRASES[phrase]]))
                sorts.add("base")
                parts.append(phrase.upper())
            else:
                parts.append("some words here")
        texts.append("\n".join(parts))
        doubt = 1.0
        for k in sorts:
            doubt *= 1 - L.CONFIDENCE[k]
        want.append((",".join(sorted(set().union(*(f[0] for f in finds)))), L.CLASSES[min(f[1] for f in finds)] if finds else None, round(1 - doubt, 4)))
    got = L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for r in got:
        assert (r.labels, r.openness, r.score) == want[r.doc_id], texts[r.doc_id]
