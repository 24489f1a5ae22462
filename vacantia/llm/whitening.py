"""Embedding whitening by shifted CholeskyQR.

Entries are taken on an integer grid (``floor(grid * c) + offset``), so sums and deviations from the mean are exact.  The rows,
centred before anything is multiplied, form a tall matrix X that is never gathered:

1. One pass adds up rows and entries (exact integers).
2. Each Gram pass solves the rows against the triangular factors so far, Q = X inv(R), and adds up Q'Q block by block; the driver
   factors it, R' = chol(Q'Q + shift), and composes R := R' R.  The first pass is shifted, so that Cholesky cannot break down on
   ill-conditioned rows; later ones only if they would.  Passes end when Q'Q is the identity to ``ORTHOGONAL``, or after ``PASSES``.
3. The singular values and right vectors of R are those of X: eigenvalues s^2 / n and components of the covariance.  No
   covariance matrix of ill-conditioned rows is ever decomposed, so small components are as exact as large ones.
4. A last pass projects every row; another measures how far the whitened covariance is from the identity.

Tasks hand on one d x d block each; blocks are added in groups of ``FAN`` on executors, twice, and the driver adds what is left
(a 4096th of the tasks, 8 d^2 bytes each).  The dimension d is the bound: R travels with the tasks (32 KB at 64, 32 MB at 2048).

Defined cases: a vector that is null or has null, NaN or infinite entries, or entries whose grid value needs more than 53 bits, is left out; so are
vectors of another length than the most frequent one (of equally frequent ones the longest); rows with a null or repeated id are
rows as any other; directions of no variance (eigenvalue under ``NOTHING`` of the largest) have no component, so constant
rows, a single row, or no rows give no result rows; a deviation beyond 64 bits is null in ``deviation`` and exact in
``deviation_text``; the largest entry of a component is positive.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Gram passes at most, and the largest entry of Q'Q - I that ends them.
PASSES, ORTHOGONAL = 6, 1e-9
#: Eigenvalues below this share of the largest are none.
NOTHING = 1e-24
#: Blocks added up in one group; rows of a block.
FAN, ROWS = 64, 4096
_LIMIT = float(1 << 53)
_LOW = (1 << 26) - 1


def _entries(column: pa.Array, grid: int, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows that can be used, the rows' lengths and starts, and all grid values (those that cannot be used are 0)."""
    offsets = column.offsets.to_numpy()
    scaled = np.floor(column.values.to_numpy(zero_copy_only=False) * float(grid))
    bad = ~(np.abs(scaled) < _LIMIT)
    upto = np.concatenate([[0], np.cumsum(bad)])
    good = column.is_valid().to_numpy(zero_copy_only=False) & (upto[offsets[1:]] == upto[offsets[:-1]])
    return good, np.diff(offsets), offsets[:-1], np.where(bad, 0, scaled).astype(np.int64) + offset


def _rows(column: pa.Array, d: int, grid: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are of the fit list, and their grid values as a matrix."""
    good, lengths, starts, x = _entries(column, grid, offset)
    taken = np.flatnonzero(good & (lengths == d))
    return taken, x[starts[taken][:, None] + np.arange(d)]


def _table(name: str, n: int, data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"name": [name], "n": pa.array([n], pa.int64()), "data": pa.array([data.tobytes()], pa.binary())})


def _collected(partials: DataFrame, kind) -> dict[str, tuple[int, np.ndarray]]:
    """The sums of (name, n, data) by name: in groups of ``FAN`` tasks, of ``FAN`` such groups, and on the driver."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py(), dtype=kind) for x in table.column("data")], axis=0)
        n = sum(table.column("n").to_pylist())
        return pa.table({"name": table.column("name")[:1], "part": table.column("part")[:1], "n": pa.array([n], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})

    level = partials.withColumn("part", F.spark_partition_id().cast("bigint"))
    for _ in range(2):
        level = level.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("name", "part").applyInArrow(add, "name string, part bigint, n bigint, data binary")
    out: dict[str, tuple[int, np.ndarray]] = {}
    for r in level.collect():
        n, data = out.get(r["name"], (0, 0))
        out[r["name"]] = (n + r["n"], data + np.frombuffer(r["data"], dtype=kind))
    return out


def _counter(grid: int, offset: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            good, lengths, starts, x = _entries(batch.column(0), grid, offset)
            for d in np.unique(lengths[good]):
                rows = x[starts[good & (lengths == d)][:, None] + np.arange(d)]
                sums = np.concatenate([(rows >> 26).sum(axis=0), (rows & _LOW).sum(axis=0)])  # halves, so that no sum overflows
                n, before = found.get(int(d), (0, 0))
                found[int(d)] = (n + len(rows), before + sums)
        for d, (n, sums) in found.items():
            yield _table(str(d), n, sums)

    return count


def solved(rows: np.ndarray, r: np.ndarray, block: int = 32) -> np.ndarray:
    """``rows @ inv(r)`` for an upper triangular ``r``, by substitution, ``block`` columns at a time."""
    q = rows.astype(np.float64)
    for a in range(0, len(r), block):
        b = min(a + block, len(r))
        q[:, a:b] -= q[:, :a] @ r[:a, a:b]
        for j in range(a, b):
            q[:, j] = (q[:, j] - q[:, a:j] @ r[a:j, j]) / r[j, j]
    return q


def shifted_cholesky(gram: np.ndarray, rows: int, shifted: bool) -> np.ndarray:
    """Upper triangular R with R'R = gram + shift; the shift covers the rounding of the Gram matrix, and grows until the factor exists."""
    d = len(gram)
    least = 11 * d * (min(rows, ROWS) + d + 1) * np.finfo(np.float64).eps / 2 * max(np.trace(gram), np.finfo(np.float64).tiny)
    shift = least if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(least, shift * 100)


@dataclass
class Whitening:
    """n rows with exact sums; components as rows, falling eigenvalues, and each one's share of the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    passes: int
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n: the whole part of the mean goes in integers."""
        whole, rest = self._mean()
        return (x - whole) - rest / self.n

    def _mean(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([s // self.n for s in self.sums], dtype=np.int64), np.array([s % self.n for s in self.sums], dtype=np.int64)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - sums)^2, exactly."""
        whole, rest = self._mean()
        y = x - whole
        most, d = int(np.abs(y).max(initial=0)), max(1, x.shape[1])
        if ((most + 1) * self.n) ** 2 * d < 1 << 63:
            return ((y * self.n - rest) ** 2).sum(axis=1).tolist()
        if most < 1 << 24 and d < 1 << 13 and self.n < 1 << 48:  # n^2 sum y^2 - 2 n sum y rest + sum rest^2, rest in halves
            squares, high, low = (y * y).sum(axis=1), (y * (rest >> 24)).sum(axis=1), (y * (rest & ((1 << 24) - 1))).sum(axis=1)
            own = sum(r * r for r in rest.tolist())
            return [self.n * self.n * s - 2 * self.n * ((h << 24) + w) + own for s, h, w in zip(squares.tolist(), high.tolist(), low.tolist(), strict=True)]
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)


def _gram(model: Whitening, d: int, grid: int, offset: int, prepare: Callable[[np.ndarray], np.ndarray], width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, sums = 0, np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            _, x = _rows(batch.column(0), d, grid, offset)
            for k in range(0, len(x), ROWS):
                q = prepare(x[k : k + ROWS])
                n, total, sums = n + len(q), total + q.T @ q, sums + q.sum(axis=0)
        if n:
            yield _table("gram", n, np.vstack([total, sums]))

    return task


_PARTIAL = "name string, n bigint, data binary"


def fit(vectors: DataFrame, *, vector_col: str = "embedding", components: int = COMPONENTS, grid: int = GRID, offset: int = OFFSET) -> Whitening | None:
    """The whitening of all usable vectors; None if there are none."""
    v = vectors.select(F.col(vector_col).cast("array<double>").alias("v"))
    lengths = _collected(v.mapInArrow(_counter(grid, offset), _PARTIAL), np.int64)
    if not lengths:
        return None
    d = max((n, int(name)) for name, (n, _) in lengths.items())[1]
    n, halves = lengths[str(d)]
    sums = [(int(h) << 26) + int(w) for h, w in zip(halves[:d], halves[d:], strict=True)]
    model = Whitening(n, sums, np.empty((0, d)), np.empty(0), np.empty(0), 0)
    if d == 0:
        return model
    r, gram = np.eye(d), np.eye(d)
    factors: list[np.ndarray] = []
    for k in range(PASSES):
        done = tuple(factors)

        def prepare(x: np.ndarray, done=done) -> np.ndarray:
            q = model.centred(x)
            for f in done:
                q = solved(q, f)
            return q

        found = _collected(v.mapInArrow(_gram(model, d, grid, offset, prepare, d), _PARTIAL), np.float64)
        gram = found["gram"][1].reshape(d + 1, d)[:d]
        gram = (gram + gram.T) / 2
        model.passes = k + 1
        if k and np.abs(gram - np.eye(d)).max() < ORTHOGONAL or k == PASSES - 1 or not gram.any():
            break
        factor = shifted_cholesky(gram, n, shifted=k == 0)
        factors.append(factor)
        r = factor @ r
    # The last Gram matrix is the identity, or has directions of no variance: its root joins the composition either way.
    values, turned = np.linalg.eigh(gram)
    _, s, right = np.linalg.svd((np.sqrt(np.maximum(values, 0))[:, None] * turned.T) @ r)
    e = s**2 / n
    keep = min(components, int((e > NOTHING * e[0]).sum()) if e[0] > 0 else 0)
    right = right[:keep]
    signs = np.sign(right[np.arange(keep), np.abs(right).argmax(axis=1)]) if keep else np.empty(0)
    model.components, model.eigenvalues, model.explained = right * signs[:, None], e[:keep], e[:keep] / e.sum() if keep else e[:0]
    if keep:
        cov_n, block = _collected(v.mapInArrow(_gram(model, d, grid, offset, model.project, keep), _PARTIAL), np.float64)["gram"]
        block = block.reshape(keep + 1, keep)
        mean = block[keep] / cov_n
        model.identity_error = float(np.abs(block[:keep] / cov_n - np.outer(mean, mean) - np.eye(keep)).max())
    return model


def whiten(vectors: DataFrame, model: Whitening | None, *, id_col: str = "vec_id", vector_col: str = "embedding", grid: int = GRID, offset: int = OFFSET) -> DataFrame:
    """(id_col, n, deviation, deviation_text, whitened array<double>) of each usable vector; no rows where there are no components."""
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType
    schema = f"id {kind.simpleString()}, n bigint, deviation_text string, whitened array<double>"
    if model is None or not len(model.components):
        out = spark.createDataFrame([], schema)
    else:
        d = model.components.shape[1]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                taken, x = _rows(batch.column(1), d, grid, offset)
                y = model.project(x) if len(x) else np.empty((0, len(model.components)))
                lists = pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32), pa.array(y.ravel()))
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0).take(pa.array(taken)), "n": pa.array(np.full(len(x), model.n)), "deviation_text": pa.array([str(v) for v in model.deviations(x)], pa.string()), "whitened": lists,
                })

        out = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(task, schema)
    return out.select(F.col("id").alias(id_col), "n", F.expr("try_cast(deviation_text as bigint)").alias("deviation"), "deviation_text", "whitened")


def components_of(whitened: DataFrame, model: Whitening | None, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector and component: (id_col, component, n, deviation, whitened, explained, identity_error)."""
    shares = F.array(*[F.lit(float(x)) for x in (model.explained if model else ())]) if model and len(model.explained) else F.array().cast("array<double>")
    rows = whitened.select(id_col, "n", "deviation", F.posexplode("whitened").alias("at", "value"))
    return rows.select(
        id_col, (F.col("at") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"), F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )
