"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

A rule (verdict, host, path) fits its host and all subdomains if the URL's path starts with the rule's path; the longest
host and path wins.  URLs that a rule judges are the labelled examples of the trees (or those
of ``labelled``); at most ``sample`` of them, those with the smallest hashes, are
gathered to grow the trees.  Host, path, rule and features are Column expressions; only the trees run in Python, on Arrow batches of numbers.
Without ``labelled`` the trees carry the rules over to hosts that no rule names, and know no more than these do.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no rule, and is judged by the
trees; without labelled URLs everything is allowed; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Labelled URLs that the trees are grown from, at most.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 40, 3, 0.2, 32, 5.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What stands behind the first ``://``; empty without one."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null; for rule lists written out in code."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


FEATURES = ("length", "host length", "path length", "depth", "digit ratio", "entropy", "parameters", "query length", "host labels", "suffix length", "hyphens in host", "digits in host", "longest label", "path ends in digits", "fragment", "suffix block rate")


def _parts(url: Column) -> tuple[Column, Column, Column, Column]:
    """Host, path, query and fragment as the features take them: a URL without ``://`` begins with its host."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(url)
    main, fragment = F.regexp_extract(rest, "(?s)^[^#]*", 0), F.regexp_extract(rest, "(?s)^[^#]*#(.*)", 1)
    place, query = F.regexp_extract(main, "(?s)^[^?]*", 0), F.regexp_extract(main, "(?s)^[^?]*[?](.*)", 1)
    return F.regexp_extract(place, "(?s)^[^/]*", 0), F.regexp_extract(place, "(?s)^[^/]*/(.*)", 1), query, fragment


def suffix_of(url: Column) -> Column:
    """The host's last label, lower-cased; empty for null."""
    return F.substring_index(F.lower(_parts(F.coalesce(url, F.lit("")))[0]), ".", -1)


def features(url: Column) -> Column:
    """array<double> of ``FEATURES`` but the suffix's rate, which is learned; a null URL is empty."""
    url = F.coalesce(url, F.lit(""))
    host, path, query, fragment = _parts(url)
    labels = F.split(host, "[.]")
    size = F.length(url)
    share = lambda c: (size - F.length(F.replace(url, c, F.lit("")))) / F.length(c) / size
    entropy = F.aggregate(F.array_distinct(F.regexp_extract_all(url, F.lit("(?s)."), F.lit(0))), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    parameters = F.when(query == "", 0).otherwise(F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit(""))) + 1)
    values = (
        size, F.length(host), F.length(path), F.regexp_count(path, F.lit("[^/]+")), F.regexp_count(url, F.lit("[0-9]")) / F.greatest(size, F.lit(1)), F.when(size > 0, entropy).otherwise(0.0), parameters, F.length(query),
        F.size(labels), F.length(F.substring_index(host, ".", -1)), F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))), F.regexp_count(host, F.lit("[0-9]")), F.array_max(F.transform(labels, F.length)),
        path.rlike("[0-9]/*$").cast("int"), F.length(fragment),
    )
    return F.array(*[v.cast("double") for v in values])


def _matrix(rows: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Feature arrays as a matrix of one row each."""
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(FEATURES) - 1)


class Trees:
    """Boosted regression trees on the logistic loss, grown level by level over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(rate / (1 - rate))), []
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        f = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node, splits = np.zeros(len(y), dtype=np.int64), {}
            for at in range(2**DEPTH - 1):
                mine = np.flatnonzero(node == at)
                split = self._best(binned[mine], g[mine], h[mine]) if len(mine) else None
                if split:
                    splits[at] = split
                    node[mine] = 2 * at + 1 + (binned[mine, split[0]] > split[1])
            leaves = {int(k): RATE * float(g[node == k].sum() / (h[node == k].sum() + 1.0)) for k in np.unique(node)}
            f += np.array([leaves[k] for k in node.tolist()])
            self.trees.append((splits, leaves))

    @staticmethod
    def _best(b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        best, choice = 1e-6, None
        whole = g.sum() ** 2 / (h.sum() + 1)
        for k in range(b.shape[1]):
            gl, hl, nl = (np.cumsum(np.bincount(b[:, k], weights=w, minlength=BINS))[:-1] for w in (g, h, np.ones(len(g))))
            gr, hr, nr = g.sum() - gl, h.sum() - hl, len(g) - nl
            gain = np.where((nl >= LEAST_LEAF) & (nr >= LEAST_LEAF), gl**2 / (hl + 1) + gr**2 / (hr + 1) - whole, 0)
            if gain.max(initial=0) > best:
                best, choice = gain.max(), (k, int(gain.argmax()))
        return choice

    def probability(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        f = np.full(len(x), self.base)
        for splits, leaves in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for at in sorted(splits):
                mine = node == at
                k, cut = splits[at]
                node[mine] = 2 * at + 1 + (binned[mine, k] > cut)
            f += np.array([leaves.get(k, 0.0) for k in range(2 ** (DEPTH + 1))])[node]
        return 1 / (1 + np.exp(-f))


class UrlModel:
    """Probability that a URL is to be blocked, from its features and its suffix."""

    def __init__(self, rows: np.ndarray, suffixes: list[str], blocked: np.ndarray):
        y = blocked.astype(float)
        self.prior, self.suffixes, self.trees = float(y.mean()) if len(y) else 0.0, {}, None
        if len(y):
            names, at = np.unique(np.array(suffixes, dtype=object), return_inverse=True)
            own, all_ = np.bincount(at, weights=y), np.bincount(at)
            self.suffixes = dict(zip(names, ((own + 5 * self.prior) / (all_ + 5)).tolist(), strict=True))  # shrunk to the mean
            self.trees = Trees(self._whole(rows, suffixes), y)

    def _whole(self, rows: np.ndarray, suffixes: list[str]) -> np.ndarray:
        return np.column_stack([rows, [self.suffixes.get(s, self.prior) for s in suffixes]])

    def probability(self, rows: np.ndarray, suffixes: list[str]) -> np.ndarray:
        if self.trees is None or not len(rows):
            return np.zeros(len(rows))
        return self.trees.probability(self._whole(rows, suffixes))


#: The hash that samples URLs has so many values.
_DRAWS = 1 << 40


def learn(labelled: DataFrame, *, url_col: str = "url", verdict_col: str = "verdict", sample: int = SAMPLE) -> UrlModel:
    """Trees from at most ``sample`` distinct labelled URLs: those with the smallest hashes.

    The URLs are counted first, and only those below a threshold that ``sample`` of them are expected to pass are sent.
    """
    rows = labelled.select(F.col(url_col).alias("url"), (F.col(verdict_col) == "block").alias("y")).filter("url is not null and y is not null").distinct()
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("url"), F.lit(_DRAWS)))
    n = rows.count()
    if n > sample:
        rows = rows.filter(F.col("draw") < int(_DRAWS * min(1.0, sample / n * (1 + 5 / sample**0.5))))
    got = rows.select("url", "y", "draw", features(F.col("url")).alias("x"), suffix_of(F.col("url")).alias("suffix")).toArrow()
    got = got.sort_by([("draw", "ascending"), ("url", "ascending"), ("y", "ascending")]).slice(0, sample)
    return UrlModel(_matrix(got["x"]), got["suffix"].to_pylist(), np.array(got["y"].to_pylist(), dtype=bool))


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """(id_col, host, path, rule, verdict, block_score) for each row of ``pages``; block_score is null where a rule judges."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).select("id", "url", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict"))
    model = learn(rows.filter("rule is not null") if labelled is None else labelled, sample=sample)
    held = pages.sparkSession.sparkContext.broadcast(model)  # TREES trees, and suffixes of the sample
    open_ = F.col("verdict").isNull()
    rows = rows.select("id", "host", "path", "rule", "verdict", F.when(open_, features(F.col("url"))).alias("x"), F.when(open_, suffix_of(F.col("url"))).alias("suffix"))

    def judge(batches):
        for batch in batches:
            mine = batch.filter(pc.is_null(batch.column(4)))
            p = held.value.probability(_matrix(mine.column(5)), mine.column(6).to_pylist())
            score = np.full(batch.num_rows, np.nan)
            score[batch.column(4).is_null().to_numpy(zero_copy_only=False)] = p
            score = pa.array(score, from_pandas=True)
            verdict = pc.coalesce(batch.column(4), pc.if_else(pc.greater_equal(score, 0.5), "block", "allow"))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), verdict, score], names=["id", "host", "path", "rule", "verdict", "block_score"])

    return rows.mapInArrow(judge, f"id {rows.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string, block_score double").withColumnRenamed("id", id_col)
