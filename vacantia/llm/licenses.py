"""Licence scans: an Aho-Corasick automaton over words, and licence expressions by shunting-yard.

The automaton runs over the documents' words joined by single spaces and finds identifier tags and notice
phrases at word starts.  The text behind an identifier tag is parsed as a licence expression;
``or`` is as open as its most open side, ``and`` as its most closed.

Defined cases: null text is empty: no words, no labels, score 0; overlapping and repeated phrases all count;
rows are independent, so repeated rows, null ids and other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm._text import ALNUM, slices, words

#: Phrases whose places are reported, and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice phrases of common licences (words as they stand in the notices).
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "redistribution and use in source and binary forms": "bsd",
    "gnu affero general public license": "agpl",
    "gnu lesser general public license": "lgpl",
    "gnu general public license": "gpl",
    "mozilla public license": "mpl",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "redistributions of source code must retain the above copyright notice": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this software is provided as is without any express or implied warranty": "zlib",
    "apache software license": "apache-2",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "gnu free documentation license": "gfdl",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution no derivatives": "cc-by-nd",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons zero": "cc0",
    "cc by nd": "cc-by-nd",
    "dedicated to the public domain": "public-domain",
    "open data commons open database license": "odbl",
    "do what the fuck you want to public license": "wtfpl",
    "no part of this publication may be reproduced": "proprietary",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: Identifier prefixes in expressions, the label of each, and how open it is (3: permissive, 2: weak copyleft, 1: copyleft, 0: restricted).
FAMILIES = (
    ("mit", "mit", 3), ("apache-2", "apache-2", 3), ("bsd", "bsd", 3), ("isc", "isc", 3), ("unlicense", "unlicense", 3), ("cc0", "cc0", 3), ("zlib", "zlib", 3),
    ("cc-by-nc", "cc-by-nc", 0), ("cc-by-nd", "cc-by-nd", 0), ("cc-by-sa", "cc-by-sa", 1), ("cc-by", "cc-by", 3),
    ("mpl", "mpl", 2), ("lgpl", "lgpl", 2), ("epl", "epl", 2), ("agpl", "agpl", 1), ("gpl", "gpl", 1), ("proprietary", "proprietary", 0),
    ("eupl", "eupl", 1), ("gfdl", "gfdl", 1), ("bsl", "bsl", 3), ("artistic", "artistic", 3), ("public-domain", "public-domain", 3), ("odbl", "odbl", 1), ("wtfpl", "wtfpl", 3), ("0bsd", "bsd", 3), ("cddl", "cddl", 2),
    ("ms-pl", "ms-pl", 2), ("ofl", "ofl", 2), ("osl", "osl", 1), ("python", "python", 3), ("psf", "python", 3), ("postgresql", "postgresql", 3), ("ncsa", "ncsa", 3), ("busl", "busl", 0), ("sspl", "sspl", 0), ("elastic", "elastic", 0),
)
OPENNESS = {label: n for _, label, n in FAMILIES}
CLASSES = ("restricted", "copyleft", "weak copyleft", "permissive")
#: How sure a find of each sort makes that the text states a licence.
CONFIDENCE = {"tag": 0.95, "base": 0.9, "notice": 0.6}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*)")
#: A line break, and the comment mark that the next line may begin with.
_BREAK = re.compile(r"(?:[ \t\r]*\n[ \t]*(?:/{2,}!?|#+|;+|--+|%+|!+|\*+(?!/))?)+")
_LEAD = re.compile(r"[ \t:=\"']*")


def tokens(text: str, at: int = 0, stop: int | None = None) -> list[str]:
    """The longest grammatical run of operands, operators and parentheses at the beginning of text[at:stop].

    It goes on over line breaks while a parenthesis is open; if that is never closed, it ends with its first line.
    """
    out, depth, operand, line = [], 0, True, None
    stop = len(text) if stop is None else stop
    while True:
        m = _TOKEN.match(text, at, stop)
        if not m and depth and (over := _BREAK.match(text, at, stop)):
            line = len(out) if line is None else line
            m = _TOKEN.match(text, over.end(), stop)
        if not m:
            break
        t = m[1]
        if t == "(":
            if not operand:
                break
            depth += 1
        elif t == ")":
            if operand or not depth:
                break
            depth -= 1
        elif t.lower() in PRECEDENCE:
            if operand:
                break
            operand = True
        else:
            if not operand:
                break
            operand = False
        out.append(t)
        at = m.end()
        if not depth:
            line = None  # lines within closed parentheses stay
    if line is not None:
        out = out[:line]
        depth = out.count("(") - out.count(")")
    while out and (out[-1] == "(" or out[-1].lower() in PRECEDENCE):
        depth -= out.pop() == "("
    return out + [")"] * depth


def to_rpn(expression: list[str]) -> list[str]:
    """Shunting-yard: operands in order, each operator after its two sides; ``with`` binds closest, then ``and``, then ``or``."""
    out, stack = [], []
    for t in expression:
        low = t.lower()
        if low in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
        elif t == "(":
            stack.append(t)
        elif t == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            out.append(t)
    return out + stack[::-1]


def identifier(name: str) -> str | None:
    """The label of an identifier outside the families: its name without version suffixes; None for what is only a word (no hyphen, dot or digit)."""
    return re.sub(r"(?:-only|-or-later|\++)$", "", name) if re.search(r"[-.0-9]", name) else None


def evaluate(rpn: list[str]) -> tuple[set[str], int] | None:
    """Labels of the licences (an unknown identifier is its own label, and restricted), and how open the expression is; None for an empty expression."""
    stack: list[tuple[set[str], int]] = []
    for t in rpn:
        if t in PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            if t == "with":  # an exception opens a copyleft licence by one step
                stack.append((left[0], left[1] + (left[1] in (1, 2))))
            else:
                stack.append((left[0] | right[0], (max if t == "or" else min)(left[1], right[1])))
        else:
            low = t.lower()
            known = next(((label, n) for prefix, label, n in FAMILIES if low == prefix or low.startswith((prefix + "-", prefix + ".")) or (low.startswith(prefix) and low[len(prefix) :][:1].isdigit())), None)
            stack.append(({known[0]}, known[1]) if known else ({own} if (own := identifier(low)) else set(), 0))
    return stack[-1] if stack else None


def _automaton(base: dict[str, str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    kinds: dict[str, list] = {}
    for phrase, label in base.items():
        kinds.setdefault(phrase, []).append(("base", label))
    for phrase, label in NOTICES.items():
        kinds.setdefault(phrase, []).append(("notice", label))
    kinds.setdefault(TAG, []).append(("tag", ""))
    for phrase, found in kinds.items():
        a.add_word(f" {phrase} ", (len(phrase) + 2, len(phrase.split()), found))
    a.make_automaton()
    return a


_DDL = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, openness string, score double"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64()]


def _scan(automaton, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    w = words(data, offsets, ALNUM)
    n = w.counts()
    owner = np.repeat(np.arange(len(n)), n)
    lengths = w.ends - w.starts
    # Each word follows a space, each document ends with one: phrases cannot reach over two documents.
    head = np.cumsum(lengths + 1) - lengths + owner
    joined = np.full(int(lengths.sum()) + len(lengths) + len(n), 32, dtype=np.uint8)
    inner = np.repeat(head - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    source = np.repeat(w.starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    body = data[source]
    joined[inner] = np.where((body >= 65) & (body <= 90), body + 32, body)
    base, found, text = {}, {}, None
    for end, (size, count, kinds) in automaton.iter(joined.tobytes().decode("latin-1")):
        k = int(np.searchsorted(head, end - size + 2))
        d = int(owner[k])
        for kind, label in kinds:
            if kind == "base":
                base.setdefault(d, []).append((k - int(w.first[d]), label))
            if kind == "tag":
                at = int(w.ends[k + count - 1])
                stop = int(offsets[d + 1])
                text = data.tobytes().decode("latin-1") if text is None else text  # a character a byte: tokens are ASCII
                value = evaluate(to_rpn(tokens(text, _LEAD.match(text, at, stop).end(), stop)))
                if value and value[0]:
                    found.setdefault(d, []).append(("tag", *value))
            else:
                found.setdefault(d, []).append((kind, {label}, OPENNESS.get(label, 0)))
    out = []
    for d, total in enumerate(n):
        places, finds = base.get(d, []), found.get(d, [])
        doubt = 1.0
        for kind in {f[0] for f in finds}:
            doubt *= 1 - CONFIDENCE[kind]
        starts = [p for p, _ in places]
        out.append(
            (
                int(total), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})),
                ",".join(sorted(set().union(*(f[1] for f in finds)))), CLASSES[min(f[2] for f in finds)] if finds else None, round(1 - doubt, 4),
            )
        )
    return out


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, openness, score) for each row of ``docs``.

    base phrases (default ``BASE_PHRASES``) are counted at all their places; ``labels`` adds the licences of notices and
    of tagged expressions; ``openness`` is that of the most closed find, null without any.
    """
    phrases = dict(BASE_PHRASES if base is None else base)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(phrases)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                columns = zip(*_scan(automaton, data, offsets), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], names=["id", *(x.split()[0] for x in _DDL.split(", "))])

    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, {_DDL}").withColumnRenamed("id", id_col)
