"""Delimited and parquet rating files: readers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RATING_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("rating", T.DoubleType()),
])


def read_ratings(spark: SparkSession, path: str | list[str], schema: T.StructType = RATING_SCHEMA,
                 header: bool = True, encoding: str = "UTF-8", sentinel: float | None = None,
                 fmt: str = "csv") -> DataFrame:
    """Read rating rows with a declared schema, so no extra pass infers one.

    ``header=False`` reads positional files; ``sentinel`` names the number that stands
    for "not rated" in any double column and becomes null.
    """
    if fmt == "parquet":
        df = spark.read.schema(schema).parquet(*([path] if isinstance(path, str) else path))
    else:
        df = spark.read.schema(schema).option("encoding", encoding).csv(path, header=header)
    if sentinel is not None:
        from tastegrid.operators.cleaning import sentinel_to_null
        doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
        df = sentinel_to_null(df, doubles, sentinel)
    return df


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "ignore") -> None:
    """Write once: with ``ignore`` an existing table is left as it is."""
    writer = df.write.mode(mode)
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)
