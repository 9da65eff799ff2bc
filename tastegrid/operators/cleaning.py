"""Cleaning, reshaping, sampling and indexing of rating tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.session import stage


def sentinel_to_null(df: DataFrame, cols: list[str], sentinel: float = 99.0) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in cols})


def drop_null_ratings(df: DataFrame, value: str = "rating") -> DataFrame:
    return df.filter(F.col(value).isNotNull())


def unknown_cells(df: DataFrame, value: str = "rating") -> DataFrame:
    return df.filter(F.col(value).isNull())


def clean_ratings(df: DataFrame, value: str = "rating", title: str = "title") -> DataFrame:
    """Keep rows with a known rating of at least 0 and a known title."""
    return df.filter(F.col(value).isNotNull() & (F.col(value) >= 0) & F.col(title).isNotNull())


def fill_null_text(df: DataFrame, cols: list[str] = ("title", "genres")) -> DataFrame:
    return df.fillna("", subset=list(cols))


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def dataset_profile(df: DataFrame, user: str = "user_id", item: str = "item_id",
                    exact: bool = True) -> DataFrame:
    """Rows, columns, distinct users and items; ``exact=False`` uses sketches."""
    distinct = F.countDistinct if exact else F.approx_count_distinct
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"),
                  distinct(user).alias("n_users"), distinct(item).alias("n_items"))


def unpivot_wide(df: DataFrame, id_cols: list[str], item_cols: list[str],
                 item: str = "item_id", value: str = "rating") -> DataFrame:
    """Wide to long; the item column keeps the number inside the column name."""
    long = df.unpivot(id_cols, item_cols, item, value)
    return long.withColumn(item, F.regexp_extract(F.col(item), r"(\d+)$", 1).cast("int"))


def pivot_matrix(df: DataFrame, items: list, fill: float | None = None, user: str = "user_id",
                 item: str = "item_id", value: str = "rating", prefix: str = "") -> DataFrame:
    """Long to user × item with the mean of duplicates. ``items`` is an explicit report
    list, so the plan knows its columns and needs no extra job to discover them."""
    out = df.groupBy(user).pivot(item, items).agg(F.avg(value))
    out = out.toDF(user, *[f"{prefix}{i}" for i in items])
    return out if fill is None else out.fillna(fill)


def first_per_key(df: DataFrame, key: str | list[str], *order: Column | str) -> DataFrame:
    """One row per key, chosen by an explicit order so the pick is repeatable."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_pos", F.row_number().over(w)).filter("_pos = 1").drop("_pos")


def _key_hash(keys: list[str], seed: int) -> Column:
    """Hex digest of the key: uniform, and the same however the rows are partitioned."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42,
                    keys: list[str] = ("user_id", "item_id"), method: str = "hash") -> DataFrame:
    if method == "random":
        return df.sample(fraction=fraction, seed=seed)
    bar = format(min(int(fraction * 2**32), 2**32), "09x")
    return df.filter(F.concat(F.lit("0"), F.substring(_key_hash(list(keys), seed), 1, 8)) < bar)


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "user_id") -> DataFrame:
    """Exactly n rows at random: a distributed top-n by key hash, no full sort."""
    return df.orderBy(_key_hash([key], seed), key).limit(n)


def split(df: DataFrame, train_tenths: int = 8, method: str = "modulo", seed: int = 42,
          user: str = "user_id", item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Train and test. The modulo split depends on the pair alone, so it survives
    repartitioning and recomputation; ``random`` is Spark's seeded ``randomSplit``."""
    if method == "random":
        return tuple(df.randomSplit([train_tenths / 10, 1 - train_tenths / 10], seed))
    part = split_part(train_tenths, user, item)
    return df.filter(part == "train"), df.filter(part == "test")


def split_part(train_tenths: int = 8, user: str = "user_id", item: str = "item_id") -> Column:
    """'train' or 'test' as a column, for work on both parts in one pass."""
    slot = (F.col(user) * 31 + F.col(item) * 17) % 10
    return F.when(slot < train_tenths, "train").otherwise("test")


def dense_index(df: DataFrame, col: str = "user_id", index: str = "idx") -> DataFrame:
    """Distinct numeric ids numbered 0..n-1 in id order, without a one-task global sort.

    Ids go to value ranges cut at approximate quantiles; each range is numbered on its
    own and shifted by the number of ids in the ranges before it. Only the range
    boundaries and counts (one number per shuffle partition) reach the driver.
    """
    spark = df.sparkSession
    ids = stage(df.select(col).where(F.col(col).isNotNull()).distinct(), "ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    probs = [i / parts for i in range(1, parts)]
    inner = sorted(set(ids.approxQuantile(col, probs, 0.25 / parts))) if probs else []
    splits = [float("-inf"), *inner, float("inf")]
    if len(splits) > 2:
        ranged = Bucketizer(splits=splits, inputCol=col, outputCol="_range").transform(ids)
    else:
        ranged = ids.withColumn("_range", F.lit(0.0))
    sizes = {int(r["_range"]): r["count"] for r in ranged.groupBy("_range").count().collect()}
    shifts = [sum(sizes.get(j, 0) for j in range(i)) for i in range(len(splits) - 1)]
    shift = F.element_at(F.array(*[F.lit(s).cast("long") for s in shifts]),
                         F.col("_range").cast("int") + 1)
    w = Window.partitionBy("_range").orderBy(col)
    return ranged.select(col, (shift + F.row_number().over(w) - 1).alias(index))


def id_dictionary(ids: DataFrame, col: str, index: str = "idx") -> DataFrame:
    """(col, index): distinct ids of any sortable type numbered 0..n-1 in their order (text by its bytes); null has none.

    Spark cuts the ids into ranges of its own sampling, one partition each. They are written with their range, so that
    ranges, counts and numbers agree even if a task runs twice; each range is numbered by itself and
    shifted by the counts of the ranges before it, one number per shuffle partition."""
    known = ids.select(col).filter(F.col(col).isNotNull()).distinct()
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stage(known.repartitionByRange(parts, col).withColumn("_range", F.spark_partition_id()), "dictionary")
    sizes = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per shuffle partition
    shift = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    own = Window.partitionBy("_range").orderBy(col)
    return cut.withColumn("_at", F.row_number().over(own) - 1).join(shift, "_range").select(
        col, (F.col("_shift") + F.col("_at")).alias(index))


def surrogate_row_id(df: DataFrame, key: str, row_id: str = "row_id") -> DataFrame:
    """Number rows 1..n in the order of a unique key."""
    numbers = dense_index(df, key, "_idx")
    return df.join(numbers, key).withColumn(row_id, F.col("_idx") + 1).drop("_idx")


def matrix_profile(df: DataFrame, user: str = "user_id", item: str = "item_id",
                   value: str = "rating") -> DataFrame:
    """Cells, non-zeros, sparsity and storage: 8 bytes per dense cell, 8 + 4 per entry."""
    base = df.agg((F.countDistinct(user) * F.countDistinct(item)).alias("cells"),
                  F.count_if(F.col(value) != 0).alias("nonzeros"),
                  F.count(F.lit(1)).alias("_entries"))
    return base.select(
        "cells", "nonzeros", (1 - F.col("nonzeros") / F.col("cells")).alias("sparsity"),
        (F.col("cells") * 8).alias("dense_bytes"), (F.col("_entries") * 12).alias("sparse_bytes"),
        (1 - F.col("_entries") * 12 / (F.col("cells") * 8)).alias("byte_reduction"))


def coo_entries(df: DataFrame, user: str = "user_id", item: str = "item_id",
                value: str = "rating") -> DataFrame:
    """(row, col, value) with dense indices; duplicate cells are summed first, so the
    index joins see one row per cell."""
    cells = df.groupBy(user, item).agg(F.sum(value).alias("value"))
    return (cells.join(dense_index(df, user, "row"), user).join(dense_index(df, item, "col"), item)
            .select("row", "col", "value"))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
