"""The queries of this subpackage over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import chat, decontam, imatch, langid, licenses, lm, minhash, mixing, pii, trie, urls, warc, whitening
from vacantia.operators.storage import checkpoint, drop, shared_dir

_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=2, similarity=80)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    spans = F.col("pii")
    base = F.filter(spans, lambda x: x["r"] < 4)
    return found.select("doc_id", *[pii.count_of(spans, k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")], F.sha2(pii.spelled(base), 256).alias("base_sha256"), pii.spelled(spans).alias("spans"), F.size(spans).cast("bigint").alias("n_spans"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(_table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("mask", lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"))), ",")
    return chat.rotate_perspectives(_table(spark, sf_dir, "conversations")).withColumn("mask", spans)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


#: The first turns that a rebuilt conversation takes of another: crc32 of its id modulo this.
_HEADS = 9


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``turns_of`` with every conversation's first h turns taken from conversation c - c % 5, and all conversations' lengths."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % _HEADS
    lengths = trie.lengths_of(turns)
    bases = lengths.select(F.col("conv").alias("base"), F.col("length").alias("base_length"))
    heads = turns.filter(F.col("place") < _HEADS - 1).select(F.col("conv").alias("base"), "place", "digest", "bytes")
    plan = lengths.select("conv", F.col("length").alias("own"), h.alias("h"), (F.col("conv") - F.col("conv") % 5).alias("base")).join(bases, "base", "left")
    plan = plan.withColumn("taken", F.least("h", F.coalesce("base_length", F.lit(0)))).withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    taken = plan.join(heads, "base").filter(F.col("place") < F.col("h")).select("conv", "place", "digest", "bytes", "length")
    kept = turns.drop("length").join(plan.select("conv", "h", "taken", "length"), "conv").filter(F.col("place") >= F.col("h"))
    kept = kept.select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "bytes", "length")
    return taken.union(kept), plan.select("conv", "length")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = checkpoint(trie.turns_of(_table(spark, sf_dir, "conversations")), "trie-placed")
    out = trie.prefix_trie(*_rebuilt(turns))
    drop(turns)
    return out


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    return whitening.components_of(whitening.whiten(vectors, model), model)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/vacantia/warc-{uuid.uuid4().hex}"
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    records = checkpoint(warc.reassemble(warc.read_records(spark, path), payload=False).drop("payload"), "warc-records")
    drop(spark.read.text(path))
    return warc.resolved(records).drop("complete")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_benchmark_decontamination, op3_pii, op4_lm_scoring, op5_mixing, op6_license_scans, op7_fingerprints, op8_url_filters, op9_chat_formatting, op10_language_id, op11_prefix_trie, op12_whitening, op13_warc, pipeline,
    )
}

_OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACED}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
      ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, hash(unnest(s)) AS g FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
          JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          WHERE 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
          GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM reach r JOIN both_ways l ON r.y = l.x)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.y)::BIGINT AS component_id, n.doc_id = min(r.y) AS kept
FROM n JOIN reach r ON r.x = n.doc_id GROUP BY n.doc_id, n.n
"""

_OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i : i + least(10, len(w)) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
p AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
m AS (SELECT p.doc_id, p.k, p.i, bw.item_id FROM p JOIN bw ON bw.k = p.k AND bw.g = array_to_string(p.w[p.i : p.i + p.k - 1], ' ')),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS pos FROM m) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _sql_spans(kind: str, rank: int, pattern: str, valid: str) -> str:
    return f"""{kind} AS (SELECT doc_id, text, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(m := m[i],
      s := list_sum(list_transform(p[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0)))) AS x,
      '{kind}' AS kind, {rank} AS r FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM t)),
{kind}_ok AS (SELECT doc_id, text, kind, r, x.s::BIGINT AS s, (x.s + length(x.m))::BIGINT AS e FROM (SELECT *, x.m AS m, regexp_replace(x.m, '[^0-9]', '', 'g') AS d, replace(x.m, ' ', '') AS q FROM {kind}) WHERE {valid})"""


_PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_LUHN_SQL = "length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[-i]::INT ELSE (2 * d[-i]::INT) // 10 + (2 * d[-i]::INT) % 10 END)) % 10 = 0"
_MOD97_SQL = "length(q) BETWEEN 15 AND 34 AND (list_reduce(list_prepend(0, list_transform(range(1, length(q) + 1), lambda i: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', (q[5:] || q[1:4])[i])::INT - 1)), lambda a, v: (a * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97)) = 1"
_SSN_NEAR = "lower(text[greatest(x.s - 40, 0) + 1 : x.s] || ' ' || text[x.s + length(x.m) + 1 : x.s + length(x.m) + 20])"
_SSN_SQL = f"regexp_matches({_SSN_NEAR}, '(^|[^a-z])(ssn|social|security|tax)([^a-z]|$)') AND NOT regexp_matches({_SSN_NEAR}, '(^|[^a-z])(version|release|isbn|serial|example|sample)([^a-z]|$)')"
_KINDS_SQL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", f"regexp_full_match(m, '{_PART}([.]{_PART}){{3}}')"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN_SQL),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b", _MOD97_SQL),
    ("secret", r'(?:token|secret|key|password) ?[=:] ?"[A-Za-z0-9+/_=-]{16,}"', "true"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", _SSN_SQL),
)
_OP3 = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),\n"
    + ",\n".join(_sql_spans(k, r, p, v) for r, (k, p, v) in enumerate(_KINDS_SQL))
    + ",\na AS ("
    + " UNION ALL ".join(f"SELECT doc_id, kind, r, s, e FROM {k}_ok" for k, _, _ in _KINDS_SQL)
    + """),
g AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) FILTER (r < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) AS spans, count(*) AS n_spans FROM a GROUP BY 1)
SELECT t.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0)::BIGINT AS n_spans FROM t LEFT JOIN g USING (doc_id)"""
)

_OP5 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACED}'))::BIGINT AS size, length(text) AS n,
           (('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, md5(text), ''))[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
k AS (SELECT *, -ln(u) / CASE WHEN size > 0 THEN greatest(0.1, 1 - abs(n::DOUBLE / size - 6) / 12) ELSE 0.1 END AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
c AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w, coalesce(sum(3 * source_size) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
      FROM s WINDOW o AS (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, w * max((total - cap_before)::DOUBLE / (all_w - w_before)) OVER ()) AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
      sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + (2 * upto - size <= 2 * rest)::INT))::BIGINT AS taken FROM r
"""

_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
_OP9 = rf"""
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), sha256(coalesce(text, ''))) - 1 AS place FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
x AS (SELECT t.conv_id, perspective, place // 64 AS chunk, place, role = perspective AS own,
      '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || {_ESCAPED.format("translate(role, chr(13) || chr(10), '  ')")} END || chr(10) AS head,
      {_ESCAPED.format("text")} || '<|im_end|>' || chr(10) AS body FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
y AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, chunk ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM x),
c AS (SELECT conv_id, perspective, chunk, count(*)::BIGINT AS n_turns, string_agg(head || body, '' ORDER BY place) AS rendered,
      coalesce(string_agg((off + length(head))::BIGINT || ':' || (off + length(head) + length(body) - 1)::BIGINT, ',' ORDER BY place) FILTER (own), '') AS mask FROM y GROUP BY 1, 2, 3)
SELECT conv_id, perspective, chunk, n_turns, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, rendered, mask FROM c
"""

_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length({0}) + 1), lambda i: [ascii(substr({0}, i::INT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"
_OP11 = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, strlen(text) AS bytes, sha256(strlen(role) || ':' || role || text) AS g, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) - 1 AS place FROM t),
p AS (SELECT c, c - c % 5 AS base, {_CRC32.format("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM o)),
r AS (SELECT p.c, place, g, bytes, 0 AS own FROM p JOIN o ON o.c = p.base AND o.place < p.h UNION ALL SELECT p.c, place, g, bytes, 1 FROM p JOIN o ON o.c = p.c AND o.place >= p.h),
d AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY own, place) AS depth FROM r),
k AS (SELECT c, depth, bytes, sha256(string_agg(g, '' ) OVER (PARTITION BY c ORDER BY depth)) AS key FROM d UNION ALL SELECT c, 0, 0, '' FROM p),
n AS (SELECT depth, key, min(c) AS owner, count(*) AS n_convs, max(bytes) AS bytes FROM k GROUP BY 1, 2),
a AS (SELECT k.c, k.depth, n.owner, max(k.depth) OVER (PARTITION BY k.c) AS len FROM k JOIN n ON k.depth = n.depth AND k.key = n.key),
e AS (SELECT owner, depth, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM a WHERE depth = len GROUP BY 1, 2),
f AS (SELECT n.owner, n.depth, n_convs, (n_convs - 1) * bytes AS saved, up.owner AS parent FROM n LEFT JOIN a up ON up.c = n.owner AND up.depth = n.depth - 1),
b AS (SELECT parent AS owner, depth - 1 AS depth, count(*) AS n_children FROM f WHERE depth > 0 GROUP BY 1, 2),
s AS (SELECT a.owner, a.depth, sum(f.saved) AS saved, count(*) FILTER (b.owner IS NULL) AS n_leaves FROM f JOIN a ON a.c = f.owner AND a.depth <= f.depth LEFT JOIN b ON b.owner = f.owner AND b.depth = f.depth GROUP BY 1, 2)
SELECT f.owner AS conv_id, f.depth::BIGINT AS depth, parent AS parent_conv_id, f.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM f JOIN s USING (owner, depth) LEFT JOIN b USING (owner, depth) LEFT JOIN e USING (owner, depth)
"""
_BASE32 = "list_reduce(list_transform(range(0, 8), lambda g: list_reduce(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * g + 1, 5))::BIGINT >> b) & 31)::INT + 1, 1)), lambda a, x: a || x)), lambda a, x: a || x)"
_OP13 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS k, first_value(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to FROM r
"""

SQL = {
    "op1_minhash_near_dedup": _OP1,
    "op2_benchmark_decontamination": _OP2,
    "op3_pii": _OP3,
    "op5_mixing": _OP5,
    "op9_chat_formatting": _OP9,
    "op11_prefix_trie": _OP11,
    "op13_warc": _OP13,
}
