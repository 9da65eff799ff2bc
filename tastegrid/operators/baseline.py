"""Global baseline: overall mean plus user and item bias."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def biases(train: DataFrame, user: str = "user_id", item: str = "item_id",
           value: str = "rating") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mean, user biases, item biases). Plain aggregates with map-side combine: a
    user or item with most of the rows still sends one partial row per task."""
    mu = train.agg(F.avg(value).alias("mu"))
    m = mu.scalar()
    users = train.groupBy(user).agg((F.avg(value) - m).alias("b_u"))
    items = train.groupBy(item).agg((F.avg(value) - m).alias("b_i"))
    return mu, users, items


def baseline(pairs: DataFrame, train: DataFrame, fit_on: str = "train", default: float | None = None,
             user: str = "user_id", item: str = "item_id", value: str = "rating",
             est: str = "est") -> DataFrame:
    """``mu + b_u + b_i`` for each pair; null where the user or item is unseen, unless
    ``default`` gives the bias to use. ``fit_on='self'`` fits on the pairs themselves.
    The bias tables are left to runtime join selection: broadcast when they turn out
    small, otherwise shuffled with skewed partitions split."""
    mu, users, items = biases(pairs if fit_on == "self" else train, user, item, value)
    b_u, b_i = F.col("b_u"), F.col("b_i")
    if default is not None:
        b_u, b_i = F.coalesce(b_u, F.lit(default)), F.coalesce(b_i, F.lit(default))
    return (pairs.join(users, user, "left").join(items, item, "left")
            .withColumn(est, mu.scalar() + b_u + b_i).drop("b_u", "b_i"))


def mean_center(df: DataFrame, by: str = "user_id", value: str = "rating",
                out: str = "centered") -> DataFrame:
    """Rating minus the key's mean. The mean is aggregated and joined back, not taken
    over a window, so a key with most of the rows is not bound to one task."""
    means = df.groupBy(by).agg(F.avg(value).alias("_mean"))
    return df.join(means, by).withColumn(out, F.col(value) - F.col("_mean")).drop("_mean")
