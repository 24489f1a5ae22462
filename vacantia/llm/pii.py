"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

Everything is a Column expression: the pieces between matches (``split``) and
the matches (``regexp_extract_all``) of a pattern alternate, so their lengths
give each match's place in code points without a shuffle.

The patterns are the plain ones with possessive quantifiers and look-behind
added where these only save time: a run of digits or of address characters
that fails is not tried again from each of its characters, so long runs cost
linear time and constant stack.

Defined cases: null text has no spans; rows are independent of each other, so
repeated rows, null ids and columns of any name need no care.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap test that a text must pass for the pattern to be tried.
    hint: str
    #: SQL over m, the matched string.
    valid: str
    #: Score of a valid match before its context is looked at.
    score: float
    #: Words that raise the score if they stand near.
    context: str
    #: Whether valid matches are reported whatever their score.
    always: bool


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + "
    f"element_at(array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9), "
    f"1 + int(substring({_DIGITS}, -i, 1)) + if(i % 2 = 0, 10, 0))) % 10 = 0"
)
_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_IBAN = "replace(m, ' ', '')"
_TURNED = f"concat(substring({_IBAN}, 5), substring({_IBAN}, 1, 4))"
_VALUE = f"(instr('{_ALPHABET}', substring({_TURNED}, i, 1)) - 1)"
_MOD97 = f"aggregate(sequence(1, length({_IBAN})), 0, (a, i) -> (a * if({_VALUE} > 9, 100, 10) + {_VALUE}) % 97) = 1"

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "true", 0.9, "e-?mail|mail|contact|write", True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]\.[0-9]", f"m rlike '^{_PART}([.]{_PART}){{3}}$'", 0.6, "ip|address|host|server", True),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){11}", f"length({_DIGITS}) between 12 and 19 and {_LUHN}", 0.8, "card|visa|credit|debit|payment", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", f"length({_DIGITS}) between 9 and 15", 0.6, "phone|tel|call|mobile|fax", True),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b", r"[A-Z]{2}[0-9]{2}[ A-Z0-9]", f"length({_IBAN}) between 15 and 34 and {_MOD97}", 0.9, "iban|account|bank|konto", False),
    Kind("secret", r'(?:token|secret|key|password) ?[=:] ?"[A-Za-z0-9+/_=-]{16,}"', r'[=:] ?"', "true", 0.9, "api|auth|credential|login|access", True),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", r"[0-9]-[0-9]{2}-[0-9]", "true", 0.3, "ssn|social|security|tax", False),
)
#: Code points of a piece in which a text is cut for looking up places, and matches that are appended to one array.
CHUNK, STEPS = 2048, 512
#: Code points before a span (and half as many behind it) in which context words count.
REACH = 40
RAISE, LOWER, THRESHOLD = 0.3, 0.3, 0.5
#: Words that speak against personal data.
AGAINST = "version|release|isbn|serial|example|sample"


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def _bind(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _chunks(text: str) -> str:
    """SQL for the text in pieces of ``CHUNK`` code points."""
    return f"regexp_extract_all({text}, r'(?s).{{1,{CHUNK}}}', 0)"


def _piece(chunks: str, a: str, b: str) -> str:
    """SQL for the text's code points [a, b), in time of their number and not of the text's length."""
    held = f"array_join(slice({chunks}, int(({a}) div {CHUNK}) + 1, int(({b} - 1) div {CHUNK}) - int(({a}) div {CHUNK}) + 1), '')"
    return f"if({b} > {a}, substring({held}, int(({a}) % {CHUNK}) + 1, {b} - ({a})), '')"


def _blocks(rows: str) -> str:
    """SQL for an array in blocks of ``STEPS`` elements (one empty block for an empty array)."""
    return f"transform(sequence(0, greatest(int((size({rows}) - 1) div {STEPS}), 0)), b -> slice({rows}, b * {STEPS} + 1, {STEPS}))"


def _found(kind: Kind, rank: int, text: str) -> str:
    """SQL for an array of struct(s, e, r, kind, m): the valid matches of one kind with their places.

    Places are added up in blocks, then over the blocks, so that appending to arrays stays cheap however many matches a text has.
    """
    pattern = _quoted(kind.pattern)
    valid = kind.valid.replace("(m,", "(z.m,").replace("m rlike", "z.m rlike")
    step = f"named_struct('s', a.at + z.gap, 'e', a.at + z.gap + length(z.m), 'r', {rank}, 'kind', '{kind.name}', 'm', z.m)"
    none = "cast(array() as array<struct<s:int,e:int,r:int,kind:string,m:string>>)"
    # One piece stands before each match; the last piece, after all matches, is paired with null.
    pairs = f"zip_with(regexp_extract_all({text}, {pattern}, 0), split({text}, {pattern}, -1), (m, gap) -> named_struct('m', m, 'gap', length(gap)))"
    walk = (
        f"aggregate(y, named_struct('at', 0, 'out', {none}), "
        f"(a, z) -> named_struct('at', a.at + z.gap + coalesce(length(z.m), 0), 'out', if(z.m is not null and {valid}, concat(a.out, array({step})), a.out)))"
    )
    before = "aggregate(w, named_struct('at', 0, 'all', cast(array() as array<int>)), (a, k) -> named_struct('at', a.at + k.at, 'all', concat(a.all, array(a.at))), a -> a.all)"
    moved = "transform(k.out, x -> named_struct('s', x.s + off, 'e', x.e + off, 'r', x.r, 'kind', x.kind, 'm', x.m))"
    placed = _bind(pairs, "p", _bind(f"transform({_blocks('p')}, y -> {walk})", "w", f"flatten(zip_with(w, {before}, (k, off) -> {moved}))"))
    return f"CASE WHEN {text} rlike {_quoted(kind.hint)} THEN {placed} ELSE {none} END"


def find_pii(docs: DataFrame, *, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``docs`` with ``out_col``: array<struct<s, e, r, kind, m, score>> ordered by start, then kind.

    s and e are code points (e exclusive), r is the kind's rank in ``KINDS``, m the matched text.
    Kinds that are not reported always need a score of ``THRESHOLD`` after context.
    """
    text, out = "`" + text_col.replace("`", "``") + "`", "`" + out_col.replace("`", "``") + "`"
    arrays = F.expr("array_sort(concat(" + ", ".join(_found(k, r, text) for r, k in enumerate(KINDS)) + "))")
    near = f"lower(concat({_piece('c', f'greatest(x.s - {REACH}, 0)', 'x.s')}, ' ', {_piece('c', 'x.e', f'(x.e + {REACH // 2})')}))"
    base = "CASE x.kind " + " ".join(f"WHEN '{k.name}' THEN {k.score}D" for k in KINDS) + " END"
    words = "CASE x.kind " + " ".join(f"WHEN '{k.name}' THEN near rlike '(^|[^a-z])({k.context})([^a-z]|$)'" for k in KINDS) + " END"
    score = f"round(greatest(0D, least(1D, {base} + if({words}, {RAISE}D, 0D) - if(near rlike '(^|[^a-z])({AGAINST})([^a-z]|$)', {LOWER}D, 0D))), 2)"
    always = ", ".join(f"'{k.name}'" for k in KINDS if k.always)
    row = _bind(near, "near", f"named_struct('s', x.s, 'e', x.e, 'r', x.r, 'kind', x.kind, 'm', x.m, 'score', {score})")
    scored = _bind(_chunks(text), "c", f"filter(transform({out}, x -> {row}), x -> x.kind in ({always}) or x.score >= {THRESHOLD})")
    none = "cast(array() as array<struct<s:int,e:int,r:int,kind:string,m:string,score:double>>)"
    return docs.withColumn(out_col, arrays).withColumn(out_col, F.expr(f"CASE WHEN size({out}) > 0 THEN {scored} ELSE {none} END"))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def mask_pii(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in brackets; overlapping spans become one, named for the first."""
    text, spans = "`" + text_col.replace("`", "``") + "`", "__pii"
    # Each block of spans begins where the spans before it end; within a block the pieces are appended.
    step = (
        f"if(x.s >= a.at, named_struct('at', x.e, 'out', concat(a.out, array({_piece('c', 'a.at', 'x.s')}, concat('[', upper(x.kind), ']')))), "
        "named_struct('at', greatest(a.at, x.e), 'out', a.out))"
    )
    begin = "if(k = 0, 0, array_max(slice(ends, 1, k)))"
    parts = f"transform(y, (part, k) -> aggregate(part, named_struct('at', {begin}, 'out', cast(array() as array<string>)), (a, x) -> {step}, a -> array_join(a.out, '')))"
    whole = f"concat(array_join({parts}, ''), {_piece('c', 'array_max(ends)', f'greatest(array_max(ends), length({text}))')})"
    masked = _bind(_chunks(text), "c", _bind(_blocks(spans), "y", _bind("transform(y, part -> array_max(transform(part, x -> x.e)))", "ends", whole)))
    return find_pii(docs, text_col=text_col, out_col=spans).withColumn(text_col, F.expr(f"CASE WHEN size({spans}) > 0 THEN {masked} ELSE {text} END")).drop(spans)
