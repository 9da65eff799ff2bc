"""Rating-shaped views over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.session import stage

# The order priorities that serve as the columns of the wide view.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
WIDE_COLS = [f"p{i}" for i in range(1, len(PRIORITIES) + 1)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """For costly work per row on a plain scan: use all cores where the files give fewer
    splits than that. With enough splits, as on any large input, nothing is shuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def user_key(user: str = "user_id") -> Column:
    """A text id for a user."""
    return F.concat(F.lit("u"), F.col(user).cast("string")).alias("user_key")


def item_key(item: str = "item_id") -> Column:
    """An id for an item that no int holds."""
    return (F.col(item).cast("long") + F.lit(1 << 40)).alias("item_key")


# Order lines that one task sorts or groups: where the session's shuffle partitions would hold more, there are more of them.
PER_TASK = 2_000_000


def line_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Shuffle partitions for work on all order lines; None where the session's are enough."""
    need = -(-table(spark, sf_dir, "lineitem").count() // PER_TASK)
    return need if need > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def rating_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line; a user may rate an item more than once."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    if tasks := line_tasks(spark, sf_dir):
        lines, orders = lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
                    F.ceil(F.col("l_quantity") / 10.0).cast("int").alias("rating"),
                    "o_orderpriority"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer ratings 1..5, one row per (user, item)."""
    lines, tasks = rating_lines(spark, sf_dir), line_tasks(spark, sf_dir)
    if tasks:
        lines = lines.repartition(tasks, "user_id", "item_id")
    return lines.groupBy("user_id", "item_id").agg(F.max("rating").alias("rating"))


def kept_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings written once, for jobs that read them several times: the join and the
    grouping behind them run a single time."""
    return stage(ratings(spark, sf_dir), "ratings")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"),
        F.concat_ws("|", "p_type", "p_brand").alias("genres"))


def factors(spark: SparkSession, sf_dir: str, as_given: bool = False) -> DataFrame:
    """Given vectors, used as user and as item factors under the same id; as doubles, or of the type they have."""
    vec = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), (vec if as_given else vec.cast("array<double>")).alias("features"))


def vectors(spark: SparkSession, sf_dir: str, as_given: bool = False) -> DataFrame:
    """A given vector for every user and item, that of its id modulo the number of vectors."""
    given = factors(spark, sf_dir, as_given)
    ids = (table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
           .union(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))).distinct())
    n = given.agg(F.count(F.lit(1))).scalar()
    return (ids.withColumn("at", F.pmod("id", n)).join(given.withColumnRenamed("id", "at"), "at").select("id", "features"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user, one column per priority, null = not rated."""
    return rating_lines(spark, sf_dir).groupBy("user_id").agg(*[
        F.max(F.when(F.col("o_orderpriority") == p, F.col("rating").cast("double"))).alias(c)
        for p, c in zip(PRIORITIES, WIDE_COLS)])


def nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings with metadata, with missing and negative values planted by item id."""
    item = F.col("item_id")
    return (ratings(spark, sf_dir).join(items(spark, sf_dir), "item_id", "left")
            .select("user_id", "item_id",
                    F.when(item % 11 == 0, None).when(item % 13 == 0, -1)
                    .otherwise(F.col("rating")).cast("double").alias("rating"),
                    F.when(item % 17 != 0, F.col("title")).alias("title"), "genres"))
