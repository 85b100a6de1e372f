"""Operator 12: embedding whitening with eigenpairs from contour integrals (FEAST, Polizzi 2009).

Vectors become integers; sums and centred products over the different vectors are
added up by Spark.  The covariance has as many rows as the vectors have entries, so
it fits the driver, whatever the number of vectors.  Its eigenvalues are counted by
the inertia of shifted matrices, which cuts the spectrum in intervals of few.  In
each, a quadrature around the interval of solves with complex shifted matrices
projects a block of vectors onto the interval's eigenspace, Rayleigh-Ritz takes the
eigenpairs out of it, and their number must be the one that inertia counted.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm.common import table, written
from linework.operators.ranks import free_names

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this size count as this size, so that whole numbers stay within 41 bits.
LARGEST = 2.0**34
#: Most eigenvalues sought in one interval, directions beyond those, and quadrature points.
BLOCK, SPARE, POINTS = 8, 8, 8
#: Residuals that end the iteration, and the least share of the trace that a component may have.
TOLERANCE, LEAST_SHARE = 1e-14, 1e-13


def whole_numbers(rows: DataFrame, vector: str) -> DataFrame:
    """rows whose vector has entries, all of them finite, with that vector as whole numbers (see op12's contract)."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    number = lambda c: F.floor(SCALE * F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long") + SHIFT
    return rows.where(F.col(f"`{vector}`").isNotNull() & (F.size(v) > 0) & fine).withColumn(vector, F.transform(v, number))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(rows: DataFrame, run, width: int) -> np.ndarray:
    """The sum over all tasks of the rows (i, values) that run gives, as a matrix of `width` columns; tasks add up their own rows first."""
    parts = rows.mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    found = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((1 + max((r["i"] for r in found), default=-1), width))
    for r in found:
        out[r["i"], r["j"]] = r["v"]
    return out


def products(rows: DataFrame, column: str, centre, width: int) -> np.ndarray:
    """The sum of outer products of centre(vectors) with themselves."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x = centre(matrix(batch.column(0)))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    return summed(rows.select(column), run, width)


def negatives(a: np.ndarray) -> int:
    """Negative eigenvalues of a symmetric matrix: the inertia of its LDL' factors with pivots of one or two rows (Bunch and Kaufman)."""
    a, n, i, found = a.copy(), len(a), 0, 0
    ratio = (1 + 17**0.5) / 8
    while i < n:
        below = np.abs(a[i + 1 :, i])
        most = below.max(initial=0.0)
        two = False
        if abs(a[i, i]) < ratio * most:
            r = i + 1 + int(below.argmax())
            row = np.abs(a[r, i:])
            row[r - i] = 0
            other = row.max()
            if abs(a[i, i]) * other < ratio * most * most:
                two = abs(a[r, r]) < ratio * other
                s = i + 1 if two else i
                a[[s, r]] = a[[r, s]]
                a[:, [s, r]] = a[:, [r, s]]
        step = 2 if two else 1
        if two:
            found += 1  # such a pivot has one eigenvalue of each sign
        elif a[i, i] < 0:
            found += 1
        if two or a[i, i] != 0:
            c = a[i + step :, i : i + step]
            a[i + step :, i + step :] -= c @ np.linalg.solve(a[i : i + step, i : i + step], c.T)
        i += step
    return found


def contour_step(v: np.ndarray, low: float, high: float, block: np.ndarray) -> np.ndarray:
    """block filtered by a quadrature over the circle through low and high: near 1 for eigenvalues within, near 0 for those outside."""
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    for angle, w in zip(np.pi * (1 + nodes) / 2, weights):
        turn = radius * np.exp(1j * angle)
        # The lower half of the circle gives the conjugates.
        out += w / 2 * (turn * np.linalg.solve((centre + turn) * np.eye(len(v)) - v, block)).real
    return out


def interval_pairs(v: np.ndarray, low: float, high: float, count: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The count eigenpairs between low and high; fails if they are not found."""
    block = np.random.default_rng(7).standard_normal((len(v), min(len(v), count + SPARE)))
    norm, met = np.abs(v).sum(axis=1).max(), 0
    for _ in range(rounds):
        basis, _ = np.linalg.qr(contour_step(v, low, high, block))
        values, turned = np.linalg.eigh(basis.T @ v @ basis)
        block = basis @ turned
        wanted = np.argsort(np.maximum(np.maximum(low - values, values - high), 0), kind="stable")[:count]
        left = np.linalg.norm(v @ block[:, wanted] - block[:, wanted] * values[wanted], axis=0).max()
        slack = 1e-12 * norm
        inside = int(((values[wanted] > low - slack) & (values[wanted] < high + slack)).sum())
        met = met + 1 if left <= TOLERANCE * norm * len(v) ** 0.5 and inside == count else 0
        if met == 2:
            return values[wanted], block[:, wanted]
    raise ArithmeticError(f"{count} eigenvalues are between {low} and {high}; the iteration found {inside} (residual {left})")


def leading_pairs(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The wanted largest eigenvalues, falling, and their unit eigenvectors as columns."""
    n, wanted = len(v), min(wanted, len(v))
    high = np.abs(v).sum(axis=1).max() * (1 + 1e-9)
    if high == 0:
        return np.zeros(wanted), np.eye(n)[:, :wanted]
    low = -1e-6 * high
    above = lambda s: n - negatives(v - s * np.eye(n))
    todo, values, vectors = [(low, high, above(low), above(high))], [], []
    if todo[0][2:] != (n, 0):
        raise ArithmeticError("the matrix is no covariance")
    while todo:
        a, b, over_a, over_b = todo.pop()
        if over_b >= wanted or over_a == over_b:
            continue
        if over_a - over_b > BLOCK and b - a > 1e-11 * high:
            # Golden cuts, as halves of round numbers may hit eigenvalues.
            middle = a + (b - a) * 0.381966
            over = above(middle)
            todo += [(a, middle, over_a, over), (middle, b, over, over_b)]
            continue
        e, u = interval_pairs(v, a, b, over_a - over_b)
        values.append(e)
        vectors.append(u)
    values, vectors = np.concatenate(values), np.concatenate(vectors, axis=1)
    order = np.argsort(-values, kind="stable")[:wanted]
    # One more Rayleigh-Ritz step over all intervals makes their vectors orthogonal to each other.
    basis, _ = np.linalg.qr(vectors[:, order])
    values, turned = np.linalg.eigh(basis.T @ v @ basis)
    return values[::-1], (basis @ turned)[:, ::-1]


@dataclass
class Whitening:
    """What the fit list gave: n and S, eigenvalues and vectors (columns) that can be whitened, the trace, and the measured error."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: whole numbers less the rounded mean, then the rest of the mean."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        return (x - whole) - rest

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The sum of (n*x - S)^2 per row, exact; null where it is beyond a long."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums))
        y = x - np.array(whole, dtype=np.int64)
        about = (((y.astype(np.float64)) * self.n - np.array(rest, dtype=np.float64)) ** 2).sum(axis=1)
        large = np.flatnonzero(about > 9e18)
        y[large] = 0
        out = ((y * self.n - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1)
        exact = out.tolist()
        for i in large.tolist():
            d = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[i], self.sums))
            exact[i] = d if d < 1 << 63 else None
        return pa.array(exact, pa.int64())

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.vectors) / np.sqrt(self.values)


def fit_whitening(vectors: DataFrame, column: str, components: int = COMPONENTS) -> Whitening | None:
    """The whitening fitted on the different vectors of whole_numbers(); None without any.

    Vectors of another length than most (of equals, the longer) take no part.  A
    component of no variance cannot be whitened and is left out.
    """
    fit = written(vectors.select(F.col(f"`{column}`").alias("x")).distinct(), "fit")
    lengths = fit.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return None
    d, n = lengths["d"], lengths["n"]
    fit = fit.where(F.size("x") == d)
    sums = {r["j"]: int(r["s"]) for r in fit.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).collect()}
    model = Whitening(n, [sums[j] for j in range(d)], np.zeros(0), np.zeros((d, 0)), 0.0)
    covariance = products(fit, "x", model.centred, d) / n
    covariance = (covariance + covariance.T) / 2
    model.trace = float(np.trace(covariance))
    values, found = leading_pairs(covariance, components)
    kept = values > LEAST_SHARE * max(model.trace, 1e-300)
    model.values, model.vectors = values[kept], found[:, kept]
    k = int(kept.sum())
    if k:
        model.identity_error = float(np.abs(products(fit, "x", model.whitened, k) / n - np.eye(k)).max())
    return model


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, model: Whitening | None = None) -> tuple[DataFrame, Whitening | None]:
    """rows that whole_numbers() keeps, with deviation (long) and whitened (an array, a number per component), and the fitted model.

    Repeated vectors count once in the fit and are all returned.  Rows of another length
    than most are dropped, too.  Columns of rows called like the results (in any case)
    are replaced.  No vectors give no rows.
    """
    x = free_names(rows, "x__")[0]
    names = [c for c in rows.columns if c.lower() not in ("deviation", "whitened")]
    numbers = rows.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{vector}`").alias(x))
    numbers = whole_numbers(numbers, x)
    model = model or fit_whitening(numbers, x, components)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in numbers.schema if f.name != x], "deviation long, whitened array<double>"])
    if model is None:
        return rows.sparkSession.createDataFrame([], schema), None

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                values = matrix(batch.column(batch.num_columns - 1))
                white = np.ascontiguousarray(model.whitened(values))
                ends = np.arange(len(values) + 1, dtype=np.int32) * white.shape[1]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], model.deviations(values), pa.ListArray.from_arrays(pa.array(ends), pa.array(white.ravel()))], names=[*names, "deviation", "whitened"])

    return numbers.where(F.size(x) == len(model.sums)).mapInArrow(run, schema), model


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found, model = whiten(rows)
    n, trace, error = (model.n, model.trace, model.identity_error) if model else (0, 1.0, 0.0)
    share = F.element_at(F.array(*[F.lit(float(e) / trace) for e in (model.values if model is not None and len(model.values) else [0.0])]), F.col("component"))
    long = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).withColumn("component", (F.col("at") + 1).cast("int"))
    return long.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
