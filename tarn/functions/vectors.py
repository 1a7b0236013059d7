"""Vectors from text, offline and the same on every machine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_DIM = 768
VECTOR = T.ArrayType(T.DoubleType())


def once(function):
    """Keep the optimizer from evaluating a costly function a second time.

    A filter on the result, also one that Spark infers from an explode, would otherwise be pushed
    below it together with a copy of the call.
    """
    return function.asNondeterministic()


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def token_buckets(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Bucket of every token: its first 32 md5 bits modulo ``dim``."""
    return F.transform(
        tokens(text),
        lambda t: F.pmod(
            F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(dim)
        ).cast("int"),
    )


def matrix_of(vectors: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column as a matrix, without an object per row; every list must have the same length."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if not len(vectors):
        return np.empty((0, dim or 0))
    dim = int(np.nan_to_num(lengths[0])) if dim is None else dim
    wrong = np.flatnonzero(lengths != dim)
    if len(wrong):
        raise ValueError(f"expected {dim} values, found {int(np.nan_to_num(lengths[wrong[0]]))}")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def lists_of(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive values cut into lists of the given lengths."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def hashed_vector(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Token counts per bucket, scaled to length one; no tokens give the zero vector.

    Splitting and hashing stay in the JVM. Only the small integer arrays go to numpy, which counts a
    whole batch at once: no built-in counts into ``dim`` slots in time linear in the tokens.
    """

    @F.arrow_udf(VECTOR)
    def unit_counts(buckets: pa.Array) -> pa.Array:
        lengths = pc.list_value_length(buckets).to_numpy(zero_copy_only=False)
        slots = np.repeat(np.arange(len(buckets)) * dim, lengths) + buckets.flatten().to_numpy()
        counts = np.bincount(slots, minlength=len(buckets) * dim).reshape(-1, dim).astype(float)
        norms = np.sqrt((counts * counts).sum(axis=1))
        units = counts / np.where(norms > 0, norms, 1.0)[:, None]
        return lists_of(units.ravel(), np.full(len(buckets), dim))

    return once(unit_counts)(token_buckets(F.coalesce(text, F.lit("")), dim))


def numeric_vector(*columns: Column) -> Column:
    """Numeric columns as one vector."""
    return F.array(*[c.cast("double") for c in columns])


def checked_vector(vector: Column, dim: int) -> Column:
    """The vector as doubles; any other length than ``dim`` fails the query."""
    wrong = F.concat(F.lit(f"expected {dim} values, found "), F.size(vector).cast("string"))
    return F.when(F.size(vector) == dim, vector.cast(VECTOR)).otherwise(F.raise_error(wrong))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two array columns on the same row; NULL if either is all zeros."""
    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)

    lengths = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return dot(left, right) / F.nullif(lengths, F.lit(0.0))


def _pair_cosines(left: pa.Array, right: pa.Array) -> pa.Array:
    """Cosine of the lists on each row, as :func:`cosine`: NULL for lists of zeros, with nulls or of unequal lengths."""
    sizes = [pc.fill_null(pc.list_value_length(side), -1).to_numpy(zero_copy_only=False) for side in (left, right)]
    found, known = np.zeros(len(left)), np.zeros(len(left), bool)
    for size in np.unique(sizes[0][(sizes[0] == sizes[1]) & (sizes[0] > 0)]).tolist():
        at = np.flatnonzero((sizes[0] == size) & (sizes[1] == size))
        flat = [(side if len(at) == len(side) else side.take(pa.array(at))).flatten() for side in (left, right)]
        a, b = (pc.cast(f, pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size) for f in flat)
        lengths = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
        usable = lengths != 0
        for f in flat:
            if f.null_count:
                usable &= f.is_valid().to_numpy(zero_copy_only=False).reshape(-1, size).all(axis=1)
        found[at] = np.einsum("ij,ij->i", a, b) / np.where(usable, lengths, 1.0)
        known[at] = usable
    return pa.array(found, mask=~known)


def register_functions(spark: SparkSession, in_expressions: bool = False) -> None:
    """Make ``cosine(a, b)`` callable from SQL.

    Whole batches of pairs go to numpy, which multiplies them several times as fast as a higher-order function. In conditions of
    outer joins, where Spark takes no Python function, ``in_expressions`` gives the same as a plain expression.
    """
    if not in_expressions:
        spark.sql("DROP TEMPORARY FUNCTION IF EXISTS cosine")
        spark.udf.register("cosine", F.arrow_udf(_pair_cosines, T.DoubleType()))
        return
    spark.sql("DROP TEMPORARY FUNCTION IF EXISTS cosine")  # a function of the one kind does not replace one of the other
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0.0D, (s, x) -> s + x)"
    lengths = f"sqrt({dot.format('a', 'a')}) * sqrt({dot.format('b', 'b')})"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE "
        f"RETURN {dot.format('a', 'b')} / nullif({lengths}, 0.0D)"
    )
