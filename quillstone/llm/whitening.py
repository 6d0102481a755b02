"""Whitening of embeddings from exact covariances: integers cut into limbs, multiplied as float64 matrices.

A vector's entries become integers x = floor(scale * entry). The fit list is each different x vector once; copies, however many,
are taken together before the shuffle. With n vectors and the sums S of each dimension, every task multiplies y = n * x - S, which
is n times the centred vector and an integer: y is cut into limbs of `LIMB` bits, so that a product of two limbs summed over a
block of `ROWS` vectors stays below 2**53 and a float64 matrix product of limbs is exact in any order. Products are put together
as big integers, written in digits of 32 bits, and Spark adds the digits up over all tasks. So the covariance is exact whatever
the partitions; the driver gets two numbers a dimension and one matrix of dimensions, divides once and takes eigenvectors.

Rows whose vector is null, empty, or holds null or non-finite entries are left out; entries whose x passes a long are held to
its bounds. Vectors of different lengths are fits of their own. Components whose variance is nothing beside the first's (rounding)
are not returned: a fit of one vector has none. Repeated rows give repeated results; no rows give no rows. Columns other than
vec_id and embedding are not read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm._io import cut, forget

#: Bits of a limb and vectors of a block: 2 * 20 + 12 < 53.
LIMB = 20
ROWS = 4096
_DIGIT = 32


def integers(df: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and x, the vectors as longs; without rows that hold no usable vector."""
    v = F.col("embedding").cast("array<double>")
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(v, lambda c: F.coalesce(c, F.lit(float("nan"))).between(-1.8e308, 1.7976931348623157e308))
    top = float(1 << 63)
    whole = lambda c: F.when(c >= top, F.lit((1 << 63) - 1)).when(c <= -top, F.lit(-(1 << 63))).otherwise(F.floor(c).cast("long"))
    return df.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: whole(c * scale)).alias("x"))


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """float64 matrices of numbers from 0 to 2**LIMB - 1 (the last one's are signed and as small), lowest first: y is their sum,
    each times 2**LIMB more than the one before."""
    out = []
    while True:
        if y.dtype == object or not len(y) or np.abs(y).max() >= 1 << LIMB:
            low = y & ((1 << LIMB) - 1)
            out.append(low.astype(np.float64))
            y = y >> LIMB
            if y.dtype == object and all(abs(v) < 1 << 62 for v in y.flat):
                y = y.astype(np.int64)
            if len(y):
                continue
        out.append(y.astype(np.float64))
        return out


def gram(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers."""
    d = y.shape[1]
    total = np.zeros((d, d), object)
    for lo in range(0, len(y), ROWS):
        parts = limbs(y[lo : lo + ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[i:], i):
                exact = (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
                total += exact if i == j else exact + exact.T
    return total


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, as longs where they fit, else as Python integers."""
    if not len(x):
        return np.zeros(x.shape, np.int64)
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(abs(s) for s in sums)
    if most < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def _digits(value: int, many: int) -> list[int]:
    """value in digits of 32 bits, the last one signed."""
    return [(value >> _DIGIT * k) & ((1 << _DIGIT) - 1) if k < many - 1 else value >> _DIGIT * k for k in range(many)]


def covariance(vectors: DataFrame, d: int, n: int, sums: list[int]) -> list[list[Fraction]]:
    """The exact covariance (divisor n) of the vectors x of length d."""
    # n**3 times a covariance entry of longs has fewer bits than this.
    many = 2 + (2 * (64 + n.bit_length()) + n.bit_length()) // _DIGIT

    def multiply(batches):
        total = np.zeros((d, d), object)
        for batch in batches:
            total += gram(centred(_matrix(batch.column(0), d), n, sums))
        rows = [[i, j, *_digits(int(total[i, j]), many)] for i in range(d) for j in range(i, d) if total[i, j]]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.int64()) for k in range(many + 2)],
                ["i", "j", *[f"d{k}" for k in range(many)]],
            )

    names = [f"d{k}" for k in range(many)]
    parts = vectors.select("x").mapInArrow(multiply, "i long, j long, " + ", ".join(f"{c} long" for c in names))
    # Digits stay far below a long's bounds: 2**32 a task.
    out = [[Fraction(0)] * d for _ in range(d)]
    for r in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r.i][r.j] = out[r.j][r.i] = Fraction(sum(r[c] << _DIGIT * k for k, c in enumerate(names)), n**3)
    return out


def principal(V: list[list[Fraction]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues by falling size, unit eigenvectors as columns (their largest entry positive), and the trace.

    The matrix is scaled by a power of two, so that no entry overflows or vanishes when rounded."""
    trace = sum((V[i][i] for i in range(len(V))), Fraction(0))
    if not trace:
        return np.zeros(0), np.zeros((len(V), 0)), 0.0
    shift = trace.numerator.bit_length() - trace.denominator.bit_length()
    scale = Fraction(2) ** shift
    values, axes = np.linalg.eigh(np.array([[float(v / scale) for v in row] for row in V]))
    values, axes = values[::-1], axes[:, ::-1]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(0)[None], 0) < 0, -1.0, 1.0)
    kept = values > values[0] * len(V) * np.finfo(float).eps
    return values[kept] * float(scale), axes[:, kept], float(trace)


class Fit:
    """n, sums, values, axes (one column a component) and trace of the fit list of vectors of one length."""

    def __init__(self, vectors: DataFrame, d: int, components: int):
        total = [F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(d)]
        row = vectors.agg(F.count("*").alias("n"), *total).first()
        self.d, self.n, self.sums = d, row["n"], [int(row[f"s{i}"] or 0) for i in range(d)]
        values, axes, self.trace = principal(covariance(vectors, d, self.n, self.sums)) if self.n else (np.zeros(0), np.zeros((d, 0)), 0.0)
        self.values, self.axes = values[:components], axes[:, :components]

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Rows of centred vectors y on the components, each at variance one."""
        return (y.astype(np.float64) / self.n) @ (self.axes / np.sqrt(self.values))


def _identity_error(vectors: DataFrame, fit: Fit) -> float:
    """The largest entry by which the covariance of the whitened fit list differs from the identity, measured over all vectors.

    Sums of the components and of their products; the means are taken off the products in the end, and are nothing but rounding."""
    k = len(fit.values)

    def add(batches):
        one, two = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = fit.whitened(centred(_matrix(batch.column(0), fit.d), fit.n, fit.sums))
            one, two = one + z.sum(0), two + z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([[*one, *two.ravel()]], pa.list_(pa.float64()))], ["t"])

    sums = vectors.select("x").mapInArrow(add, "t array<double>")
    row = sums.agg(*[F.sum(F.get("t", F.lit(i))).alias(f"t{i}") for i in range(k + k * k)]).first()
    mean = np.array([row[f"t{i}"] for i in range(k)]) / fit.n
    two = np.array([row[f"t{k + i}"] for i in range(k * k)]).reshape(k, k) / fit.n
    return float(np.abs(two - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(y: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; null where a long can't hold one."""
    if y.dtype != object and len(y) and int(np.abs(y).max()) ** 2 * y.shape[1] < 1 << 63:
        return (y * y).sum(1).tolist()
    found = [sum(int(v) ** 2 for v in row) for row in y]
    return [s if s < 1 << 63 else None for s in found]


def whiten(df: DataFrame, components: int = 4, scale: float = 256.0) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integers(df, scale)
    distinct = cut(rows.select("x").distinct(), "vectors")
    out = []
    for (d,) in distinct.select(F.size("x").alias("d")).distinct().orderBy("d").collect():  # one row a length
        vectors = distinct.filter(F.size("x") == d)
        fit = Fit(vectors, d, components)
        k = len(fit.values)
        if not k:
            continue
        error = _identity_error(vectors, fit)

        def project(batches, fit=fit, k=k, error=error):
            for batch in batches:
                m = batch.num_rows
                y = centred(_matrix(batch.column(1), fit.d), fit.n, fit.sums)
                each = np.repeat(np.arange(m), k)
                columns = [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, fit.n)),
                    pa.array(_deviations(y), pa.int64()).take(pa.array(each)),
                    pa.array(fit.whitened(y).ravel()),
                    pa.array(np.tile(fit.values / fit.trace, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([(c.split()[0], a.type) for c, a in zip(schema.split(", "), columns, strict=True)]))

        out.append(rows.filter(F.size("x") == d).mapInArrow(project, schema))
    forget(distinct)
    result = df.sparkSession.createDataFrame([], schema)
    for part in out:
        result = result.unionByName(part)
    return result
