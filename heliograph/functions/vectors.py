"""Vector functions over array<float>, in double arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CURRENT_MODELS, LEAST_NORM, OLDER_MODELS, Similarity

#: ends of the five groups of a descriptor of 512 places; other lengths are in proportion (fixed values)
GROUPS = (0, 192, 256, 320, 448, 512)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also where body uses it for each element of an array."""
    return F.transform(F.array(value), body)[0]


def literal(vector: Iterable[float]) -> Column:
    """A constant vector; one text instead of a literal for each place, which the optimiser folds."""
    return F.split(F.lit(",".join(repr(float(x)) for x in vector)), ",").cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; a longer vector's tail counts as against nothing."""
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm2(v: Column | str) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def finite(v: Column | str) -> Column:
    return F.forall(_c(v), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def usable(v: Column | str, model: Column | str | None, dimensions: int) -> Column:
    """A vector that search may use: a known model, full length, finite, and not nothing."""
    known = F.lit(True) if model is None else F.coalesce(_c(model).isin(*CURRENT_MODELS, *OLDER_MODELS), F.lit(False))
    good = (F.size(_c(v)) == dimensions) & finite(v) & (norm2(v) >= LEAST_NORM)
    return known & F.coalesce(good, F.lit(False))


def _divided(v: Column, length: Column, kind: str = "double") -> Column:
    return let(length, lambda n: F.transform(v, lambda x: (x.cast("double") / n).cast(kind)))


def normalized(v: Column | str, strict: bool = False) -> Column:
    """The vector at length 1; strict: an error, else null, where that is undefined."""
    wrong = F.raise_error(F.lit("This vector has no direction")).cast("array<double>") if strict else F.lit(None).cast("array<double>")
    return F.when(finite(v) & (norm2(v) >= LEAST_NORM), _divided(_c(v), F.sqrt(norm2(v)))).otherwise(wrong)


def normalized_or_zero(v: Column | str, good: Column, dimensions: int) -> Column:
    return F.when(good, _divided(_c(v), F.sqrt(norm2(v)), "float")).otherwise(F.array_repeat(F.lit(0.0).cast("float"), dimensions))


def parts(kind: Similarity, dimensions: int) -> list[tuple[int, int]]:
    """(start, length) of the groups that a focus looks at."""
    e = [x * dimensions // 512 for x in GROUPS]
    if kind is Similarity.SHAPE:
        return [(e[1], e[2] - e[1]), (e[3], e[5] - e[3])]
    if kind is Similarity.COLOR:
        return [(0, e[1]), (e[2], e[3] - e[2])]
    return [(0, dimensions)]


def focused(v: Column | str, kind: Similarity, dimensions: int) -> Column:
    """The groups of a focus, side by side."""
    return F.concat(*[F.slice(_c(v), start + 1, length) for start, length in parts(kind, dimensions)])


def projected(v: Column | str, kind: Similarity, dimensions: int) -> Column:
    """The focused groups at length 1 (nothing stays nothing); whole vectors unchanged."""
    if kind in (Similarity.SUBJECT, Similarity.APPEARANCE):
        return F.transform(_c(v), lambda x: x.cast("double"))
    zeros = lambda own: F.transform(own, lambda x: F.lit(0.0))
    return let(focused(v, kind, dimensions), lambda own: let(norm2(own), lambda n: F.when(n > LEAST_NORM, _divided(own, F.sqrt(n))).otherwise(zeros(own))))


def focused_similarity(a: Column | str, b: Column | str, kind: Similarity, dimensions: int) -> Column:
    """Cosine over the groups of a focus, without projecting either side."""
    both = lambda x, y: let(norm2(x), lambda m: let(norm2(y), lambda n: F.when((m > LEAST_NORM) & (n > LEAST_NORM), dot(x, y) / F.sqrt(m * n)).otherwise(F.lit(0.0))))
    return let(focused(a, kind, dimensions), lambda x: let(focused(b, kind, dimensions), lambda y: both(x, y)))


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are lists of so many places, and those as a matrix of doubles (a null place is no number)."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    whole = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False)
    flat = vectors.filter(whole).flatten().to_numpy(zero_copy_only=False)
    return whole.to_numpy(zero_copy_only=False), flat.reshape(-1, width)


def _sums(products: np.ndarray) -> np.ndarray:
    """The sum of each row, place by place from the first: to the bit what SQL and ``dot`` have, so that ties are the same."""
    total = np.zeros(len(products))
    for column in products.T:
        total += column
    return total


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length 1, and which of them had a direction; the others are zeros."""
    n = _sums(m * m)
    good = np.isfinite(n) & (n >= LEAST_NORM)
    return np.where(good[:, None], m / np.sqrt(np.where(good, n, 1.0))[:, None], 0.0), good


def scored(vector: Column | str, known: Column, query: Iterable[float], dimensions: int, kind: Similarity = Similarity.SUBJECT) -> Column:
    """Struct of available (as ``usable``, where known holds) and score: the inner product of the vector at length 1, or of its focus, and a query; 0 where unavailable.

    A batch of rows is one matrix, read once, in place of an expression for each place of a vector.
    """
    q = np.asarray(list(query), float)
    spans = parts(kind, dimensions) if kind in (Similarity.SHAPE, Similarity.COLOR) else None

    @F.arrow_udf("available boolean, score double")
    def run(vectors: pa.Array, known: pa.Array) -> pa.Array:
        whole, m = _matrix(vectors, dimensions)
        finite = np.isfinite(m).all(axis=1)
        unit, good = _unit(np.where(finite[:, None], m, 0.0))
        unit = unit.astype(np.float32).astype(float)  # vectors are kept in single precision
        if spans is not None:
            unit = _unit(np.concatenate([unit[:, a : a + n] for a, n in spans], axis=1))[0]
        width = min(unit.shape[1], len(q))
        available, scores = np.zeros(len(whole), bool), np.zeros(len(whole))
        available[whole] = good & finite
        scores[whole] = _sums(unit[:, :width] * q[:width])
        available &= known.fill_null(False).to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays([pa.array(available), pa.array(np.where(available, scores, 0.0))], names=["available", "score"])

    return run(_c(vector), known)


def products(vector: Column | str, bank: list[list[float]]) -> Column:
    """The inner products with each vector of a bank, to 9 places, from one matrix multiplication a batch; null where the length is another."""
    width = len(bank[0]) if bank else 0
    b = np.asarray(bank, float).reshape(len(bank), width)

    @F.arrow_udf("array<double>")
    def run(vectors: pa.Array) -> pa.Array:
        whole, m = _matrix(vectors, width)
        ends = np.r_[0, np.cumsum(np.where(whole, len(b), 0))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, mask=np.r_[~whole, False]), pa.array(np.round(m @ b.T, 9).ravel()))

    return run(_c(vector))


def unpack(blob: Column | str) -> Column:
    """Little-endian float32 bytes as array<float> (null where the length does not fit)."""

    @F.arrow_udf("array<float>")
    def decode(blobs: pa.Array) -> pa.Array:
        blobs = blobs.cast(pa.binary())
        sizes = pc.binary_length(blobs).fill_null(0).to_numpy(zero_copy_only=False)
        bad = pc.or_(blobs.is_null(), pa.array(sizes % 4 != 0))
        whole = pc.if_else(bad, pa.scalar(b"", pa.binary()), blobs)
        ends = np.r_[0, np.cumsum(np.where(bad.to_numpy(zero_copy_only=False), 0, sizes) // 4)].astype(np.int32)
        offsets = pa.array(ends, mask=np.r_[bad.to_numpy(zero_copy_only=False), False])
        return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(whole.to_pylist()), "<f4")))

    return decode(_c(blob))


def pack(v: Column | str) -> Column:
    """array<float> as little-endian float32 bytes."""

    @F.arrow_udf("binary")
    def encode(vectors: pa.Array) -> pa.Array:
        vectors = vectors.cast(pa.list_(pa.float32()))
        bounds = vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
        data = np.ascontiguousarray(vectors.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False), "<f4").tobytes()
        spans = np.r_[0, np.cumsum(np.where(vectors.is_null().to_numpy(zero_copy_only=False), 0, np.diff(bounds)))]
        return pa.array([None if null else data[4 * a : 4 * b] for null, a, b in zip(vectors.is_null().to_pylist(), spans, spans[1:], strict=False)], pa.binary())

    return encode(_c(v))
