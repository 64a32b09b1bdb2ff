"""Vectors: column expressions for any size, and Arrow batch functions for the hot paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    # the norm is bound to a name: within the inner function it would be taken again for each number
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))[0]


def truncate(v: Column, dims: int) -> Column:
    """The first dims numbers at unit length; an error for shorter vectors."""
    return normalise(F.when(F.size(v) < dims, F.raise_error(F.lit(f"vector shorter than {dims}"))).otherwise(F.slice(v, 1, dims)))


def finite(v: Column) -> Column:
    """Null, NaN and infinite numbers as 0."""
    return F.transform(v, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x.cast("double")))


def has_non_finite(v: Column) -> Column:
    return F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def sanitise(df: DataFrame, v: str) -> DataFrame:
    """If any vector holds a non-finite number, these become 0 and every vector is brought to unit length; else df as it
    is. The flag is one row."""
    flag = F.broadcast(df.agg(F.coalesce(F.bool_or(has_non_finite(F.col(v))), F.lit(False)).alias("_any")))
    return df.crossJoin(flag).withColumn(v, F.when(F.col("_any"), normalise(finite(F.col(v)))).otherwise(F.col(v).cast("array<double>"))).drop("_any")


def sign_words(v: Column, dims: int) -> Column:
    """Sign bits (x >= 0) packed into 32-bit words."""
    words = [
        F.aggregate(F.slice(v, i + 1, 32), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1) + F.when(x >= 0, 1).otherwise(0).cast("long"))
        for i in range(0, dims, 32)
    ]
    return F.array(*words)


def sign_string(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: F.when(x >= 0, F.lit("1")).otherwise(F.lit("0"))), "")


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two packed codes differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x.cast("int"))
