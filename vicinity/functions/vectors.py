"""Vector columns: validation, normalisation, cosine of two columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _doubles(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(v), lambda x: x * x)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two columns of one row; null when either vector is zero."""
    product = norm(a) * norm(b)
    return F.when(product > 0, dot(a, b) / product)


def normalize(v: Column | str) -> Column:
    """Vector of unit length; a zero vector is left as it is."""
    length = norm(v)
    return F.when(
        length > 0, F.transform(_doubles(v), lambda x: x / length)
    ).otherwise(_doubles(v))


def pool_normalize(tokens: DataFrame, keys, vector: str = "embedding") -> DataFrame:
    """Mean over the vectors of each key, scaled to unit length.

    Sums are taken per dimension, so partial sums are combined before the shuffle and
    no group of vectors is ever gathered.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    long = tokens.select(*keys, F.posexplode(_doubles(vector)).alias("dim", "value"))
    mean = long.groupBy(*keys, "dim").agg(F.avg("value").alias("value"))
    pooled = mean.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("cells")
    )
    return pooled.select(*keys, normalize(F.col("cells.value")).alias(vector))


def vector_problem(embedding: Column | str, dim: int) -> Column:
    """Why a vector cannot be stored, or null when it can."""
    v = F.col(embedding) if isinstance(embedding, str) else embedding
    return (
        F.when(v.isNull(), "missing")
        .when(F.size(v) == 0, "empty")
        .when(F.size(v) != dim, "size_mismatch")
    )


def validate_chunks(chunks: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Storable chunks, and the others with the ``reason`` they were turned down."""
    problem = vector_problem("embedding", dim)
    return (
        chunks.filter(problem.isNull()),
        chunks.withColumn("reason", problem).filter(F.col("reason").isNotNull()),
    )
