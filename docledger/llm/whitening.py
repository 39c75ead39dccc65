"""Whitening of embeddings by shifted CholeskyQR.

Each entry c becomes the whole number x = floor(1024 c) + 100000. The matrix X of all rows,
centred by its exact means, is orthogonalised without ever being held: a pass over the rows
sums the Gram matrix of X times the inverses of the triangular factors found so far (row
blocks are solved against each factor in turn inside the tasks), and the Cholesky factor of
that small matrix is the next one. The first Gram matrix gets a shift of the size of its
rounding error, so that its factor exists for any condition; later ones need none, or a small
one where directions without variance remain. Two or three passes leave X = Q R with Q
orthonormal and R the product of the factors. With R = U diag(s) W', the columns of W are the
eigenvectors of the covariance, s^2 / n its eigenvalues, and sqrt(n) Q U is X whitened.

Rows whose vector is null, empty, or holds null or non-finite entries are left out, and so are
those with an entry of 2^42 or more, whose x no double holds exactly. Vectors of different
lengths are tables of their own, each with its own n. Directions without variance (fewer rows
than dimensions, equal rows, constant dimensions) are no components: a single vector, or equal
ones, give no rows. Repeated rows and ids count as often as they occur; an empty table gives
an empty result. `deviation` is null where it exceeds a long; `deviation_exact` has it then.
What the driver holds is two d x d matrices for each length d.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import tidy
from docledger.llm.vectors import matrices

SCALE, OFFSET = 1024, 100_000
#: Entries from here on are left out.
LARGEST = float(1 << 42)
#: Rows that meet in one matrix product.
ROWS_AT_ONCE = 4096
#: How far from the identity the Gram matrix of an orthonormal Q may be; passes at most.
CLOSE, PASSES = 1e-11, 8
ROUNDING = float(np.finfo(np.float64).eps) / 2
DIGITS = Context(prec=60)


@dataclass
class Basis:
    """What is known of the vectors of one length."""

    n: int
    base: np.ndarray  # whole part of the means
    rest: np.ndarray  # n times what the means have beyond `base`, whole numbers below n
    factors: list[np.ndarray] = field(default_factory=list)
    trace: float = 0.0
    turn: np.ndarray | None = None  # from Q to whitened components
    eigenvalues: np.ndarray | None = None
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest / self.n

    def orthogonal(self, x: np.ndarray) -> np.ndarray:
        """Rows of Q: the centred rows, solved against one factor after the other."""
        rows = self.centred(x)
        for factor in self.factors:
            rows = solved(rows, factor)
        return rows

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.orthogonal(x) @ self.turn

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over the dimensions of (n x - S)^2."""
        apart = x - self.base
        largest = float(np.abs(apart).max(initial=0)) * self.n + self.n
        if largest**2 * x.shape[1] < 2.0**62:
            own = apart * self.n - self.rest
            return (own * own).sum(axis=1).tolist()
        own = apart.astype(object) * self.n - self.rest.astype(object)
        return (own * own).sum(axis=1).tolist()


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows times the inverse of the upper triangular `factor`, column by column."""
    out = np.empty(rows.shape, order="F")
    for j in range(len(factor)):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def whole_numbers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of x) of the usable vectors, by length, in blocks of bounded size."""
    for rows, matrix in matrices(column):
        fits = (np.abs(matrix) < LARGEST).all(axis=1)
        rows, matrix = rows[fits], matrix[fits]
        for at in range(0, len(rows), ROWS_AT_ONCE):
            x = np.floor(matrix[at : at + ROWS_AT_ONCE] * SCALE).astype(np.int64) + OFFSET
            yield rows[at : at + ROWS_AT_ONCE], x


def means(vectors: DataFrame) -> dict[int, Basis]:
    """Number and exact sums of the vectors of each length; a row per length and dimension."""

    @tidy
    def run(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for _, x in whole_numbers(batch.column("embedding")):
                own = sums.setdefault(x.shape[1], [0, [0] * x.shape[1]])
                own[0] += len(x)
                high, low = (x >> 26).sum(axis=0).tolist(), (x & ((1 << 26) - 1)).sum(axis=0).tolist()
                own[1] = [s + (h << 26) + l for s, h, l in zip(own[1], high, low, strict=True)]
        for size, (n, totals) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([size] * size, pa.int32()),
                    pa.array(range(size), pa.int32()),
                    pa.array([n] * size, pa.int64()),
                    pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0)),
                ],
                ["size", "dim", "n", "total"],
            )

    parts = vectors.mapInArrow(run, "size int, dim int, n long, total decimal(38,0)")
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for row in parts.groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        found.setdefault(row["size"], {})[row["dim"]] = (row["n"], int(row["total"]))
    bases = {}
    for size, dims in found.items():
        n = dims[0][0]
        pairs = [divmod(dims[j][1], n) for j in range(size)]
        bases[size] = Basis(n, np.array([q for q, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64))
    return bases


def gram_matrices(
    vectors: DataFrame, bases: dict[int, Basis], rows_of: Callable[[Basis, np.ndarray], np.ndarray]
) -> dict[int, np.ndarray]:
    """Sums over all rows of the outer products of `rows_of`, by length of vector.

    A task sends one value for each cell of the upper triangle, whatever its rows.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(bases)  # d x d, by the method

    @tidy
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in whole_numbers(batch.column("embedding")):
                basis = shared.value.get(x.shape[1])
                if basis is not None:
                    rows = rows_of(basis, x)
                    sums[x.shape[1]] = sums.get(x.shape[1], 0.0) + rows.T @ rows
        for size, total in sums.items():
            a, b = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(a), size, np.int32)),
                    pa.array((a * len(total) + b).astype(np.int64)),
                    pa.array(total[a, b]),
                ],
                ["size", "cell", "value"],
            )

    parts = vectors.mapInArrow(run, "size int, cell long, value double")
    cells: dict[int, dict[int, float]] = {}
    for row in parts.groupBy("size", "cell").agg(F.sum("value").alias("value")).collect():
        cells.setdefault(row["size"], {})[row["cell"]] = row["value"]
    found = {}
    for size, values in cells.items():
        width = round((np.sqrt(8 * len(values) + 1) - 1) / 2)
        matrix = np.zeros((width, width))
        for cell, value in values.items():
            matrix[divmod(cell, width)] = matrix[divmod(cell, width)[::-1]] = value
        found[size] = matrix
    return found


def next_factor(gram: np.ndarray, first: bool) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix, shifted where rounding asks for it."""
    size = len(gram)
    shift = 11 * size * (size + 1) * ROUNDING * float(np.trace(gram))
    if not first and np.linalg.eigvalsh(gram)[0] > shift:
        shift = 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(size)).T
        except np.linalg.LinAlgError:
            shift = max(shift * 100, ROUNDING * float(np.trace(gram)))


def settled(gram: np.ndarray) -> np.ndarray | None:
    """Which eigenvalues of the Gram matrix of Q are one, if all others are next to nothing."""
    values = np.linalg.eigvalsh(gram)
    real = values > 0.5
    close = CLOSE if real.all() else 1e-8
    done = np.abs(values[real] - 1).max(initial=0) <= close and values[~real].max(initial=0) <= 1e-3
    return real if done else None


def fit(vectors: DataFrame, components: int = 8) -> dict[int, Basis]:
    """Components of the vectors of each length, those without any variance left out."""
    bases = means(vectors)
    open_ = dict(bases)
    for turn in range(PASSES + 1):
        if not open_:
            break
        grams = gram_matrices(vectors, open_, Basis.orthogonal)
        for size, gram in grams.items():
            basis = open_[size]
            if turn == 0:
                basis.trace = float(np.trace(gram)) / basis.n
                if basis.trace == 0:
                    del bases[size], open_[size]
                    continue
            real = settled(gram) if turn > 1 else None
            if real is None and turn < PASSES:
                basis.factors.append(next_factor(gram, turn == 0))
                continue
            rank = int(real.sum()) if real is not None else size
            product = np.eye(size)
            for factor in basis.factors:
                product = factor @ product
            left, values, _ = np.linalg.svd(product)
            kept = min(rank, components)
            basis.turn = left[:, :kept] * np.sqrt(basis.n)
            basis.eigenvalues = values[:kept] ** 2 / basis.n
            del open_[size]
    if bases:
        for size, gram in gram_matrices(vectors, bases, _with_one).items():
            mean = gram[:-1, -1] / bases[size].n
            covariance = gram[:-1, :-1] / bases[size].n - np.outer(mean, mean)
            bases[size].identity_error = float(np.abs(covariance - np.eye(len(mean))).max())
    return bases


def _with_one(basis: Basis, x: np.ndarray) -> np.ndarray:
    """Whitened rows and a column of ones, whose products are the sums."""
    return np.concatenate([basis.whitened(x), np.ones((len(x), 1))], axis=1)


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """One row per usable vector and component, numbered by falling eigenvalue."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    bases = fit(vectors.select("embedding"), components)
    shared = vectors.sparkSession.sparkContext.broadcast(bases)  # d x d, by the method

    @tidy
    def run(batches):
        for batch in batches:
            for rows, x in whole_numbers(batch.column("embedding")):
                basis = shared.value.get(x.shape[1])
                if basis is None:
                    continue
                found = basis.whitened(x)
                count = found.shape[1]
                exact = np.repeat(np.array(basis.deviations(x), object), count).tolist()
                explained = basis.eigenvalues / basis.trace
                rows_out = len(rows) * count
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(rows, count))),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(rows_out, basis.n, np.int64)),
                        pa.array([e if e < 1 << 63 else None for e in exact], pa.int64()),
                        pa.array(found.ravel()),
                        pa.array(np.tile(explained, len(rows))),
                        pa.array(np.full(rows_out, basis.identity_error)),
                        pa.array([DIGITS.create_decimal(e) if e < 10**38 else None for e in exact], pa.decimal128(38, 0)),
                        pa.array(np.tile(basis.eigenvalues, len(rows))),
                    ],
                    COLUMNS,
                )

    return vectors.select("vec_id", "embedding").mapInArrow(
        run,
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double, deviation_exact decimal(38,0), eigenvalue double",
    )


COLUMNS = [
    "vec_id",
    "component",
    "n",
    "deviation",
    "whitened",
    "explained",
    "identity_error",
    "deviation_exact",
    "eigenvalue",
]
