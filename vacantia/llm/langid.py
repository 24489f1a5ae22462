"""Language identification by interpolated Kneser-Ney character trigrams.

One model a language, counted over all labelled documents of the fitting folds; n-grams are
kept as sorted arrays of hashes with log probabilities and back-off weights, and
looked up by binary search.  A text's language is that of the lowest cross-entropy for
each symbol.  The entropies of a calibration fold under their label's model give each language's
median and spread (from the median absolute deviation), counted over all rows of the label, so odd
labelled rows do not move the limit, nor does the number of rows.

Symbols are all letters of the fitting texts (lower-cased), one for any letter not among them, and one for
a run of anything else.  A model holds the distinct trigrams seen, so it grows with the scripts of its
language (tens of thousands for an alphabet, more for Chinese), hardly with the documents.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and is
rejected; so is every text if no labelled text has a letter; ties go to the first language in order; null ids count as
the empty string in the fold rule; equal rows get equal answers; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm._text import U64, mix, slices

#: Distinct n-grams that a counting task, or a worker's table of looked-up trigrams, holds at once.
HELD = 2_000_000
#: Folds of crc32(id as text): 0 is held out, 1 calibrates, the others fit.
HELD_OUT, CALIBRATES, FOLDS = 0, 1, 5
#: A doubt of so many symbols at most: longer texts differ among themselves, not by chance alone.
STEADY = 100
#: Scores take no more than so many symbols as independent evidence.
EVIDENCE = 40
#: A text is rejected beyond so many robust standard deviations (in nats by the root of symbols, FLOOR at least) above its language's median.
LIMIT, FLOOR = 15.0, 0.5
#: Steps in which the calibration counts entropies and deviations.
STEP = 1e-3


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of each text with two zeros before it, and the texts' bounds."""
    body = data.tobytes()
    texts = ["\0\0" + body[a:b].decode("utf-8", "replace").lower() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.cumsum([0, *map(len, texts)])


def _size(alphabet: np.ndarray) -> int:
    """Symbols of an alphabet; its last is that of letters it does not have.  At most 2**21, so trigrams fit 63 bits."""
    return int(alphabet.max()) + 1


def _trigrams(data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram of each symbol after a text's start, the texts' bounds in these, and the letters in each text."""
    points, bounds = _code_points(data, offsets)
    symbol, size = alphabet[points], _size(alphabet)
    letters = np.add.reduceat((symbol > 0).astype(np.int64), bounds[:-1]) if len(points) else np.zeros(len(offsets) - 1, dtype=np.int64)
    keep = np.ones(len(symbol), dtype=bool)
    keep[1:] = (symbol[1:] > 0) | (symbol[:-1] > 0)
    keep[bounds[:-1]] = keep[bounds[:-1] + 1] = True  # the start
    at = np.cumsum(keep)
    s = symbol[keep].astype(np.int64)
    first = at[bounds[:-1]] - 1
    gram = np.zeros(len(s), dtype=np.int64)
    gram[2:] = (s[:-2] * size + s[1:-1]) * size + s[2:]
    real = np.ones(len(s), dtype=bool)
    real[first] = real[first + 1] = False
    ends = np.append(first[1:], len(s))
    counts = ends - first - 2
    return gram[real], np.concatenate([[0], np.cumsum(counts)]), letters


def _hash(gram: np.ndarray, order: int) -> np.ndarray:
    return mix(gram.astype(np.uint64) + U64(order << 32))


class Table:
    """Values by n-gram: hashes in order, found by binary search."""

    def __init__(self, grams: np.ndarray, order: int, values: np.ndarray):
        h = _hash(grams, order)
        by = np.argsort(h)
        self.order, self.hashes, self.values = order, h[by], values[by].astype(np.float32)

    def get(self, grams: np.ndarray, missing: float) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(grams), missing, dtype=np.float32)
        h = _hash(grams, self.order)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.values[at], np.float32(missing))


def _discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return min(max(one / (one + 2 * two), 0.1), 0.9) if one else 0.5


class KneserNey:
    """One language's interpolated model from trigram counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, size: int = 64):
        self.size = size
        by = np.argsort(grams)
        grams, c3 = grams[by].astype(np.int64), counts[by].astype(float)
        pairs, after2 = np.unique(grams % (size * size), return_counts=True)  # how many symbols stand before each pair
        ones, after1 = np.unique(pairs % size, return_counts=True)
        d1, d2, d3 = _discount(after1), _discount(after2), _discount(c3)
        p1 = np.full(size, d1 * len(ones) / size / max(after1.sum(), 1) if len(ones) else 1 / size)
        p1[ones] += (after1 - d1) / max(after1.sum(), 1)
        self.one = np.log(p1)
        c1, at2, n2 = np.unique(pairs // size, return_inverse=True, return_counts=True)
        t2 = np.bincount(at2, weights=after2, minlength=len(c1))
        g2 = d2 * n2 / t2
        p2 = (after2 - d2) / t2[at2] + g2[at2] * p1[pairs % size]
        c2, at3, n3 = np.unique(grams // size, return_inverse=True, return_counts=True)
        t3 = np.bincount(at3, weights=c3, minlength=len(c2))
        g3 = d3 * n3 / t3
        p3 = (c3 - d3) / t3[at3] + g3[at3] * p2[np.searchsorted(pairs, grams % (size * size))]
        self.three, self.two = Table(grams, 3, np.log(p3)), Table(pairs, 2, np.log(p2))
        self.back3, self.back2 = Table(c2, 2, np.log(g3)), Table(c1, 1, np.log(g2))

    def log_p(self, gram: np.ndarray) -> np.ndarray:
        size = self.size
        pair = gram % (size * size)
        lower = self.two.get(pair, np.nan)
        lower = np.where(np.isnan(lower), self.back2.get(pair // size, 0.0) + self.one[pair % size], lower)
        full = self.three.get(gram, np.nan)
        return np.where(np.isnan(full), self.back3.get(gram // size, 0.0) + lower, full)


class Model:
    def __init__(self, alphabet: np.ndarray, models: dict[str, KneserNey]):
        self.alphabet, self.langs = alphabet, sorted(models)
        self.models = [models[x] for x in self.langs]
        self.mean = np.zeros(len(self.langs))
        self.spread, self.limit = np.ones(len(self.langs)), np.full(len(self.langs), np.inf)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_seen", "_log_p")}

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy (nats a symbol) of each text under each language, symbols, and letters."""
        gram, bounds, letters = _trigrams(data, offsets, self.alphabet)
        distinct, at = np.unique(gram, return_inverse=True)
        if not hasattr(self, "_seen") or len(self._seen) * max(1, len(self.langs)) > HELD:
            self._seen, self._log_p = np.empty(0, dtype=np.int64), np.empty((len(self.langs), 0), dtype=np.float32)
        new = distinct[~np.isin(distinct, self._seen, assume_unique=True)]
        if len(new):
            seen, more = np.concatenate([self._seen, new]), [m.log_p(new) for m in self.models]
            by = np.argsort(seen)
            self._seen, self._log_p = seen[by], np.concatenate([self._log_p, np.array(more, dtype=np.float32).reshape(len(self.langs), len(new))], axis=1)[:, by]
        log_p = self._log_p[:, np.searchsorted(self._seen, distinct)]
        n = np.diff(bounds)
        out = np.zeros((len(self.langs), len(n)))
        full = np.flatnonzero(n)
        for k in range(len(self.langs) if len(full) else 0):
            out[k, full] = -np.add.reduceat(log_p[k][at].astype(np.float64), bounds[full]) / n[full]
        return out, n, letters

    def deviation(self, lang: np.ndarray, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (entropy - self.mean[lang]) * np.sqrt(np.minimum(n, STEADY)) / self.spread[lang]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        x, n, letters = self.entropies(data, offsets)
        if not self.langs:
            return ["und"] * len(n), np.zeros(len(n)), np.ones(len(n), dtype=bool)
        best = x.argmin(axis=0)
        low = x[best, np.arange(len(n))]
        score = 1 / np.exp(-(x - low) * np.minimum(n, EVIDENCE)).sum(axis=0)
        none = letters == 0
        rejected = none | (self.deviation(best, low, n) > self.limit[best])
        return ["und" if z else self.langs[k] for k, z in zip(best, none, strict=True)], np.where(none, 0.0, score), rejected


def _sum_by(batches: Iterator[pa.RecordBatch], index, langs: bool):
    """Partial counts of one task: (lang, key, n), from index(data, offsets) -> (keys, bounds)."""
    totals: dict[str, list] = {}
    held = 0

    def summed(lang):
        keys, counts = (np.concatenate(x) for x in zip(*totals[lang], strict=True))
        key, at = np.unique(keys, return_inverse=True)
        return key, np.bincount(at, weights=counts, minlength=len(key)).astype(np.int64)

    def flush():
        for lang in totals:
            key, n = summed(lang)
            for a in range(0, len(key), 100_000):
                part = key[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part.astype(np.int64)), pa.array(n[a : a + 100_000])], names=["lang", "key", "n"])
        totals.clear()

    for batch in batches:
        names = batch.column(1).to_pylist() if langs else None
        for lo, hi, data, offsets in slices(batch.column(0)):
            keys, bounds = index(data, offsets)
            own = names[lo:hi] if langs else [""]
            owner = np.repeat(np.arange(hi - lo), np.diff(bounds)) if langs else np.zeros(len(keys), dtype=np.int64)
            for lang in dict.fromkeys(own):
                found = np.unique(keys[np.array([x == lang for x in own])[owner]], return_counts=True)
                totals.setdefault(lang, []).append(found)
                held += len(found[0])
            if held > HELD:
                for lang in totals:
                    totals[lang] = [summed(lang)]
                held = sum(len(x[0][0]) for x in totals.values())
                if held > HELD // 2:
                    yield from flush()
                    held = 0
    yield from flush()


_COUNTS = "lang string, key bigint, n bigint"


def _gathered(text: DataFrame, job) -> pa.Table:
    """Counts summed over all tasks: one row for each distinct key of a language."""
    return text.mapInArrow(job, _COUNTS).groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from all rows with a language whose fold is not held out."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(F.col(id_col)) != HELD_OUT))
    text = known.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), fold(F.col(id_col)).alias("fold"))
    fitting = text.filter(F.col("fold") != CALIBRATES).drop("fold")

    def points(batches):
        def letters(data, offsets):
            p, _ = _code_points(data, offsets)
            return p[_is_letter()[p]], None

        yield from _sum_by(batches, letters, False)

    seen = _gathered(fitting.select("text"), points)
    key = np.sort(seen["key"].to_numpy())
    alphabet = np.where(_is_letter(), len(key) + 1, 0).astype(np.int32)
    alphabet[key] = np.arange(1, len(key) + 1)

    def grams(batches):
        yield from _sum_by(batches, lambda d, o: _trigrams(d, o, alphabet)[:2], True)

    counted = _gathered(fitting, grams)
    names = np.array(counted["lang"].to_pylist(), dtype=object)
    model = Model(alphabet, {x: KneserNey(counted["key"].to_numpy()[names == x], counted["n"].to_numpy()[names == x], _size(alphabet)) for x in dict.fromkeys(names)})
    if model.langs:
        _calibrate(model, text.filter(F.col("fold") == CALIBRATES).drop("fold"))
    return model


def _calibrate(model: Model, text: DataFrame) -> None:
    sc = text.sparkSession.sparkContext

    def run(job):
        held, place = sc.broadcast(model), {x: k for k, x in enumerate(model.langs)}

        def task(batches):
            for batch in batches:
                names = batch.column(1).to_pylist()
                for lo, hi, data, offsets in slices(batch.column(0)):
                    x, n, letters = held.value.entropies(data, offsets)
                    k = np.array([place.get(w, -1) for w in names[lo:hi]], dtype=np.int64)
                    ok = np.flatnonzero((letters > 0) & (k >= 0))
                    yield from job(held.value, k[ok], x[k[ok], ok], n[ok])

        return task

    def measured(value):
        """Each language's median of value(model, lang, entropy, n) over all calibration rows: counts of STEP, not rows, reach the driver."""

        def values(m, k, own, n):
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(np.floor(value(m, k, own, n) / STEP).astype(np.int64))], names=["k", "step"])

        steps: dict[int, list] = {}
        for r in text.mapInArrow(run(values), "k bigint, step bigint").groupBy("k", "step").agg(F.count("*").alias("rows")).collect():
            steps.setdefault(r.k, []).append((r.step, r.rows))
        for k, found in steps.items():
            step, rows = np.array(sorted(found)).T
            yield k, (step[np.searchsorted(np.cumsum(rows), rows.sum() / 2)] + 0.5) * STEP

    for k, x in measured(lambda m, k, own, n: own):
        model.mean[k] = x
    for k, x in measured(lambda m, k, own, n: np.abs(m.deviation(k, own, n))):  # spread is still 1
        model.spread[k], model.limit[k] = max(x / 0.6745, FLOOR), LIMIT


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, held_out, lang_pred, score, rejected) for each row, and the columns named in ``keep``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # the distinct trigrams of each language
    rows = docs.select(F.col(text_col).alias("__text"), F.col(id_col).alias("__id"), (fold(F.col(id_col)) == HELD_OUT).alias("held_out"), *[F.col(c).alias(f"__keep_{c}") for c in keep])

    def predict(batches):
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(0)):
                lang, score, rejected = held.value.predict(data, offsets)
                rest = [batch.column(k).slice(lo, hi - lo) for k in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(lang), pa.array(score), pa.array(rejected)], names=[*batch.schema.names[1:], "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    out = rows.mapInArrow(predict, f"{schema}, lang_pred string, score double, rejected boolean")
    return out.select(F.col("__id").alias(id_col), "held_out", "lang_pred", "score", "rejected", *[F.col(f"__keep_{c}").alias(c) for c in keep])
