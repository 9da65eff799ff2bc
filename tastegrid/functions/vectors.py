"""Column expressions over vectors, and grouped vector means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0.0 where either vector has length zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(F.try_divide(dot(a, b), size))


def unit(vec: str = "features", out: str = "unit"):
    """A frame transform: adds the vector scaled to length 1, in doubles; a zero vector stays as it is."""
    def apply(df: DataFrame) -> DataFrame:
        wide = F.col(vec).cast("array<double>")
        return (df.withColumn("_norm", norm(wide))
                .withColumn(out, F.transform(wide, lambda x: x / F.when(F.col("_norm") == 0, 1.0).otherwise(F.col("_norm")))).drop("_norm"))
    return apply


def width_of(vecs: DataFrame, vec: str = "features") -> int:
    """The most elements of a vector; one number reaches the driver."""
    return max(0, vecs.agg(F.max(F.size(vec))).first()[0] or 0)


def mean_units(df: DataFrame, width: int, by: str = "user_id", vec: str = "features", out: str = "mean") -> DataFrame:
    """(by, out, n): mean of the vectors scaled to length 1, and their number, per key. A vector goes to its key as it
    was given and is scaled and added there: one row per vector, not one per position."""
    near = df.filter(F.size(vec) > 0).select(by, vec).repartition(by)
    size = F.size(vec)
    sums = unit(vec, "_unit")(near).groupBy(by).agg(
        *[F.avg(F.get("_unit", F.lit(i))).alias(f"_{i}") for i in range(width)], F.max(size).alias("_size"), F.count(F.lit(1)).alias("n"))
    return sums.select(by, F.slice(F.array(*[f"_{i}" for i in range(width)]).cast("array<double>"), F.lit(1), F.col("_size")).alias(out), "n")


def known_sum(a: Column) -> Column:
    """Sum of the elements that are not null; null if there is none."""
    known = F.filter(a, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x))


def as_json(vec: Column | str, digits: int = 3) -> Column:
    vec = F.col(vec) if isinstance(vec, str) else vec
    return F.to_json(F.transform(vec, lambda x: F.round(x, digits) + F.lit(0.0)))
