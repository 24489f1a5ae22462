import re

from pyspark.sql import functions as F

from vacantia.llm import pii

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for r, (kind, pattern) in enumerate(RAW.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), r, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


TEXTS = [
    None, "", "no data", "mail é a.b+c@x-y.example.org, or a@b.c_d@e.f and x@y", "999.1.2.3.4 1.2.3.4.5.6.7.8 0010.0.0.255 256.1.1.1 1.2.3",
    "card 4465758382889437 4465-7583-8288-9437 1234 5678 9012 3456 0000000000000000 4304158793483661 12345", "+1 (663) 555-6869. +49.30.1234567890123456 ++1 22222222 3 + 1",
    "𝒳𝒳 a@b.co 𝒳 1.1.1.1 ß4465758382889437", "+1 4465758382889437 9", "1" * 30_000, "a" * 60_000 + " " + "b." * 20_000 + "@", "x@" + "y." * 3000 + "z", "1 " * 20_000, "@.@.@a@b.c.@d.e", "a@b.c" * 50, "+1" + "-" * 5000 + "2",
]


def test_base_spans(spark):
    df = spark.createDataFrame([(k % 5, t, "clash") for k, t in enumerate(TEXTS)], "doc_id long, text string, m string")
    rows = pii.find_pii(df).select("text", pii.spelled(F.expr("filter(pii, x -> x.r < 4)")).alias("got")).collect()
    for r in rows:
        assert r.got == ",".join(base(r.text)), (r.text or "")[:60]


def test_checksums_and_context(spark):
    texts = ["pay to DE89 3704 0044 0532 0130 00 now", "DE89370400440532013000", "DE88370400440532013000", "ssn 123-45-6789", "part 123-45-6789", "card 4465758382889437", "serial 4465758382889437"]
    rows = pii.find_pii(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [[(x.kind, x.score) for x in r.pii] for r in rows] == [[("iban", 0.9)], [("iban", 0.9)], [], [("ssn", 0.6)], [], [("card", 1.0)], [("card", 0.5)]]


def test_mask(spark):
    df = spark.createDataFrame([("é a@b.co, 1.1.1.1!", 1), (None, 2), ("+4465758382889437, +1 (663) 555-6869 9 end", 3), ("clean", 4)], "text string, doc_id int")
    assert [r.text for r in pii.mask_pii(df).collect()] == ["é [EMAIL], [IP]!", None, "+[CARD], [PHONE] end", "clean"]
    assert pii.find_pii(df.limit(0)).collect() == []


def test_many_matches(spark):
    """More matches than a block of the walk holds, in texts longer than a piece; masks agree with a plain loop."""
    texts = ["é " + " ".join(f"u{k}@x.org 10.0.{k % 300}.1" for k in range(3000)), "x" * 5000 + " a@b.co " + "y" * 5000 + " 1.1.1.1", "𝒳" * 4095 + " a@b.co", 'token = "' + "ab12" * 10 + '" end']
    rows = pii.mask_pii(pii.find_pii(spark.createDataFrame([(t, t) for t in texts], "raw string, text string"))).collect()
    for r in rows:
        want = base(r.raw)
        assert [f"{x.kind}:{x.s}:{x.e}" for x in r.pii if x.r < 4] == want
        at, out = 0, ""
        for x in r.pii:
            assert r.raw[x.s : x.e] == x.m
            out, at = (out + r.raw[at : x.s] + f"[{x.kind.upper()}]", x.e) if x.s >= at else (out, max(at, x.e))
        assert r.text == out + r.raw[at:]
    assert rows[3].text == "[SECRET] end" and rows[3].pii[0].score == 0.9
