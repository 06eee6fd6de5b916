"""Whitening of vectors by their leading principal components, found by spectrum slicing.

1. Entries become whole numbers; the fit list is each distinct vector once, a written
   table. Its size and sums are exact. The covariance, divisor n, is summed from centred
   vectors, a matrix per task, and has the square of the dimension entries: the one thing
   besides the sums that reaches the driver, whatever the number of rows.
2. Spectrum slicing: the inertia of an LDL' factorisation of the covariance less a shift
   counts the eigenvalues above that shift. Bisection on these counts isolates each leading
   eigenvalue in an interval of its own.
3. Rayleigh quotient iteration starts in the interval and converges cubically. A result
   outside the interval halves it further and starts again.
4. Counts just below and just above each result certify its number. Equal eigenvalues
   share an interval down to rounding; their vectors are kept orthogonal.

Every row is then projected and scaled. The covariance of the whitened fit list is measured
once more from all of it and compared with the identity.

Rows whose vector is null or holds null or non-finite entries are dropped; a null id is kept,
and repeated rows each keep theirs, though the fit counts their vector once. Vectors shorter
than the longest are filled with zeros. There are as many components as asked for, but no
more than the dimension; one without variance has a null ``whitened``, counts for nothing in
``identity_error``, and without any variance ``explained`` is null. A deviation beyond 64 bits
is null. Entries beyond 64 bits after scaling stop at their ends. An empty table gives no
rows. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyhouse.llm.vectors import widened
from tallyhouse.session import materialize

COMPONENTS = 4
SCALE = 256
_EPS = float(np.finfo(np.float64).eps)


@dataclass
class Whitening:
    """n vectors with exact ``sums`` per dimension, leading ``values`` and unit ``vectors`` (one a row)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def floor(self) -> float:
        """Variance that cannot be told from rounding."""
        return 16 * _EPS * len(self.sums) * self.trace

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of rows of whole numbers, a column a component; NaN without variance."""
        mean = np.array([s / self.n for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > self.floor, 1 / np.sqrt(np.abs(self.values)), np.nan)
        return (widened(x, len(mean)).astype(np.float64) - mean) @ self.vectors.T * scale


def scaled(table: DataFrame, vector_col: str, *kept, scale: int = SCALE) -> DataFrame:
    """The columns ``kept`` and x: entries times ``scale``, rounded down, of usable rows."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    rows = table.select(*kept, F.col(vector_col).cast("array<double>").alias("_v"))
    rows = rows.where(F.col("_v").isNotNull() & ~F.exists("_v", bad))
    return rows.withColumn("x", F.transform("_v", lambda v: F.floor(v * scale).cast("long"))).drop("_v")


def whole(column) -> np.ndarray:
    """A column of lists of longs as rows, shorter ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """How many rows there are, and the exact sum of every dimension."""
    n = fit.count()
    parts = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    return n, [int(r.s) for r in parts.orderBy("i").collect()]  # one row a dimension


def covariance(fit: DataFrame, n: int, mean: np.ndarray, values: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Of ``values`` of every row about ``mean``, divisor ``n``. A task adds up its own matrix."""
    size = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            part = values(whole(batch.column(0))) - mean
            total += part.T @ part
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i * size + j, pa.int64()), pa.array(total[i, j])], names=["cell", "v"])

    # only the square of the dimension comes back
    found = fit.select("x").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((size, size))
    for r in found:
        out[r.cell // size, r.cell % size] = out[r.cell % size, r.cell // size] = r.v / n
    return out


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``a`` lie above ``shift``: the positive
    inertia of the blocks D of an LDL' factorisation, pivots of one or two rows chosen
    by size so that none is lost to a small pivot."""
    m = a - shift * np.eye(len(a))
    positive, bound = 0, (1 + np.sqrt(17)) / 8
    while len(m):
        size = len(m)
        p = int(np.abs(np.diag(m)).argmax())
        off = np.abs(np.tril(m, -1))
        r, c = divmod(int(off.argmax()), size) if size > 1 else (0, 0)
        if size == 1 or abs(m[p, p]) >= bound * off[r, c]:
            pivot = [p]
            positive += int(m[p, p] > 0)
        else:
            pivot = [c, r]  # such a block has one positive and one negative eigenvalue
            positive += 1
        rest = np.setdiff1d(np.arange(size), pivot)
        block, cross = m[np.ix_(pivot, pivot)], m[np.ix_(rest, pivot)]
        if not block.any():  # nothing is left but zeros
            break
        m = m[np.ix_(rest, rest)] - cross @ np.linalg.solve(block, cross.T)
        m = (m + m.T) / 2
    return positive


def _apart(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for v in found:
            x = x - (v @ x) * v
    return x


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and a unit vector of each."""
    size = len(a)
    norm = float(np.abs(a).sum(axis=1).max()) if size else 0.0
    tight = 8 * _EPS * max(size, 1) * norm
    counts: dict[float, int] = {}

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(a, shift)
        return counts[shift]

    values, vectors = [], []
    for number in range(1, min(k, size) + 1):
        if norm == 0:
            vectors.append(np.eye(size)[number - 1])
            values.append(0.0)
            continue
        # all eigenvalues lie within the norm; earlier counts narrow the start
        high = min(s for s in [norm * 1.001, *counts] if s > 0 and counts.get(s, 0) < number)
        low = max([-norm * 1.001, *(s for s, c in counts.items() if c >= number)])
        while high - low > tight and not (count(low) == number and count(high) == number - 1):
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) >= number else (low, middle)
        start = _apart(np.cos(np.arange(1, size + 1) * (number + 0.5)), vectors)
        while True:
            value, x = _rayleigh(a, (low + high) / 2, start, vectors if high - low <= tight else [], tight)
            # numbered right if its counts say so; equal eigenvalues differ by rounding only
            if high - low <= tight or low - tight <= value <= high + tight and count(value - tight) >= number > count(value + tight):
                break
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) >= number else (low, middle)
        x = _apart(x, vectors)
        vectors.append(x / np.linalg.norm(x))
        values.append(float(vectors[-1] @ a @ vectors[-1]))
    return np.array(values), np.array(vectors).reshape(len(values), size)


def _rayleigh(a: np.ndarray, shift: float, x: np.ndarray, apart: list[np.ndarray], tight: float) -> tuple[float, np.ndarray]:
    """One eigenpair: two steps of inverse iteration at ``shift``, then the quotient is the shift."""
    eye, value, settled = np.eye(len(a)), shift, False
    for step in range(40):
        at = shift if step < 2 else value
        try:
            y = np.linalg.solve(a - at * eye, x)
        except np.linalg.LinAlgError:
            y = np.full(len(a), np.inf)
        if not (np.isfinite(y).all() and np.abs(y).max() < 1e150):  # the shift is an eigenvalue to the last digit
            y = np.linalg.solve(a - (at + tight) * eye, x)
        y = _apart(y / np.linalg.norm(y), apart)
        x = y / np.linalg.norm(y)
        value = float(x @ a @ x)
        if settled:
            break
        settled = step > 1 and np.linalg.norm(a @ x - value * x) <= tight  # one step more polishes it
    return value, x


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """From a table of distinct vectors x; None if it is empty."""
    n, sums = exact_sums(fit)
    if not n:
        return None
    cov = covariance(fit, n, np.array([s / n for s in sums]), lambda x: widened(x, len(sums)).astype(np.float64))
    return Whitening(n, sums, *leading(cov, components), float(np.trace(cov)))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    k = model.values > model.floor
    if not k.any():
        return 0.0

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int(k.sum()))
        for batch in batches:
            total += model.project(whole(batch.column(0)))[:, k].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total)], names=["i", "v"])

    found = fit.select("x").mapInArrow(summed, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    mean = np.array([r.v / model.n for r in found.orderBy("i").collect()])
    cov = covariance(fit, model.n, mean, lambda x: model.project(x)[:, k])
    return float(np.abs(cov - np.eye(len(cov))).max())


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Per row the exact sum of squares of n * x less the sums."""
    sums = np.array(model.sums, dtype=object)
    reach = model.n * max((int(np.abs(x.astype(object)).max()) if x.size else 0), 1) + max(map(abs, model.sums), default=0)
    if reach * reach * max(len(sums), 1) < 2**63:
        part = model.n * x - sums.astype(np.int64)
        return (part * part).sum(axis=1).tolist()
    exact = [int(d) for d in ((model.n * x.astype(object) - sums) ** 2).sum(axis=1)]
    return [d if d < 2**63 else None for d in exact]


def whiten(spark: SparkSession, table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per usable row: the id, n, deviation, whitened (one value a component), and alike for
    all rows explained (one a component) and identity_error."""
    fit = materialize(spark, scaled(table, vector_col).distinct(), "distinct-vectors")
    model = fit_whitening(fit, components)
    rows = scaled(table, vector_col, F.col(id_col).alias("vec_id"))
    kind = table.schema[id_col].dataType
    doubles = pa.list_(pa.float64())
    schema = pa.schema([
        ("vec_id", to_arrow_type(kind)), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", doubles), ("explained", doubles), ("identity_error", pa.float64()),
    ])
    ddl = f"vec_id {kind.simpleString()}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if model is None:
        return spark.createDataFrame([], ddl)
    error = identity_error(fit, model)
    shares = (model.values / model.trace).tolist() if model.trace > 0 else [None] * len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = widened(whole(batch.column(1)), len(model.sums))
            size = len(x)
            white = [[None if np.isnan(v) else v for v in row] for row in model.project(x).tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(schema[0].type), pa.array([model.n] * size, pa.int64()), pa.array(deviations(x, model), pa.int64()),
                    pa.array(white, doubles), pa.array([shares] * size, doubles), pa.array([error] * size),
                ],
                schema=schema,
            )

    return rows.mapInArrow(run, ddl)
