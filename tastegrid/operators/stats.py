"""Means, popularity, histograms, densities and error metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def global_mean(df: DataFrame, value: str = "rating", name: str = "mean_rating") -> DataFrame:
    return df.agg(F.avg(value).alias(name))


def group_mean(df: DataFrame, by: str = "user_id", value: str = "rating",
               name: str = "mean_rating") -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias(name))


def item_popularity(df: DataFrame, item: str = "item_id", min_count: int = 1) -> DataFrame:
    return df.groupBy(item).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def popularity(df: DataFrame, min_count: int = 1, form: str = "fraction", item: str = "item_id",
               value: str = "rating") -> DataFrame:
    """Popularity in 0..1 per item: count ÷ max, log1p ratio, or positive count ÷ max.
    0.0 for all when no item counts (no positive rating). The maximum is a scalar subquery
    on the counts; nothing visits the driver."""
    if form == "positive":
        counts = df.groupBy(item).agg(F.count_if(F.col(value) > 0).alias("n"))
    else:
        counts = item_popularity(df, item, min_count)
    top = counts.agg(F.max("n")).scalar()
    size = F.log1p(top) if form == "log" else top.cast("double")
    pop = F.coalesce(F.try_divide(F.log1p("n") if form == "log" else F.col("n").cast("double"), size), F.lit(0.0))
    return counts.withColumn("popularity", pop)


def histogram(df: DataFrame, col: str = "rating", bins: int = 10) -> DataFrame:
    """Equal-width counts between min and max, empty bins included, last bin closed."""
    x = F.col(col).cast("double")
    vals = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    lo, hi = vals.agg(F.min("x")).scalar(), vals.agg(F.max("x")).scalar()
    width = (hi - lo) / bins
    pos = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)))
    counts = vals.groupBy(pos.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return (frame.join(counts, "bin", "left")
            .select("bin", (lo + F.col("bin") * width).alias("lower"),
                    (lo + (F.col("bin") + 1) * width).alias("upper"),
                    F.coalesce("n", F.lit(0)).alias("n")))


MOMENTS = 12  # powers kept per bin
REACH = 8.5   # bandwidths beyond which the kernel, below 2.1e-16, is left out


def density(df: DataFrame, col: str = "rating", grid_points: int = 50) -> DataFrame:
    """Gaussian kernel density on an even grid, Scott bandwidth h, from binned moments.

    Values go to bins half a bandwidth wide; a bin keeps the sums of the powers of (x - centre) / h, made before the
    shuffle, and each bin meets the grid points within ``REACH``. With s = (x - centre) / h and t = (point - centre) / h,
    exp(-(t - s)² / 2) = exp(-t² / 2) · Σ s^k / k! · He_k(t); as |s| <= 1/4 and |He_k(t)| · exp(-t² / 2) is at most
    1.09 · sqrt(k!), what ``MOMENTS`` powers leave out is below 4e-12 per value, and the density's error below 2e-12 / h.
    Constant data has no bandwidth: the density is null there. No values: no rows."""
    x = F.col(col).cast("double")
    vals = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    stat = vals.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_samp("x").alias("sd"),
                    F.count(F.lit(1)).alias("n"))
    lo, hi = stat.select("lo").scalar(), stat.select("hi").scalar()
    n = stat.select("n").scalar()
    h = stat.select(F.col("sd") * F.pow("n", F.lit(-0.2))).scalar()
    step = (hi - lo) / (grid_points - 1)
    bins = _moments(vals, lo, h)
    at = lo + F.col("point") * step
    first = F.ceil(F.try_divide(F.col("centre") - REACH * h - lo, step))
    last = F.floor(F.try_divide(F.col("centre") + REACH * h - lo, step))
    first, last = F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(grid_points - 1)).cast("int")
    near = F.when(first <= last, F.sequence(first, last))
    met = bins.withColumn("point", F.explode(near)).withColumn("t", (at - F.col("centre")) / h)
    sums = met.groupBy("point").agg(F.sum(_hermite_sum("m", "t")).alias("k"))
    frame = stat.filter("n > 0").select(F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))).alias("point"))
    return frame.join(sums, "point", "left").select(
        F.col("point").cast("long").alias("point"), at.alias("x"),
        F.try_divide(F.coalesce("k", F.lit(0.0)), n * h * F.sqrt(F.lit(2.0) * F.pi())).alias("density"))


def _moments(vals: DataFrame, lo: Column, h: Column) -> DataFrame:
    """(bin, centre, m): sums of s^k / k! for k below ``MOMENTS`` over the values ``x`` of each bin of width h / 2."""
    here = vals.filter(h > 0).withColumn("bin", F.floor((F.col("x") - lo) / (h / 2)))
    here = here.withColumn("centre", lo + (F.col("bin") + 0.5) * (h / 2)).withColumn("s", (F.col("x") - F.col("centre")) / h)
    sums = [F.sum(F.pow("s", F.lit(k)) / math.factorial(k)).alias(f"m{k}") for k in range(MOMENTS)]
    return here.groupBy("bin", "centre").agg(*sums).select("bin", "centre", F.array(*[f"m{k}" for k in range(MOMENTS)]).alias("m"))


def _hermite_sum(m: str, t: str) -> Column:
    """exp(-t² / 2) · Σ m[k] · He_k(t), by He_(k+1)(t) = t · He_k(t) - k · He_(k-1)(t)."""
    zero = F.struct(F.col(t).alias("t"), F.lit(0.0).alias("k"), F.lit(1.0).alias("now"), F.lit(0.0).alias("before"), F.lit(0.0).alias("sum"))

    def add(acc, one):
        return F.struct(acc.t.alias("t"), (acc.k + 1).alias("k"), (acc.t * acc.now - acc.k * acc.before).alias("now"),
                        acc.now.alias("before"), (acc["sum"] + one * acc.now).alias("sum"))
    return F.exp(F.col(t) * F.col(t) * -0.5) * F.aggregate(m, zero, add, lambda acc: acc["sum"])


def argmin(df: DataFrame, metric: str, tie_break: str = "k") -> DataFrame:
    """The row with the least metric, the first one on ties."""
    return df.orderBy(F.col(metric), F.col(tie_break)).limit(1)


def rmse_of(value: str | Column = "rating", pred: str | Column = "est") -> Column:
    v, p = (F.col(c) if isinstance(c, str) else c for c in (value, pred))
    return F.sqrt(F.avg(F.pow(v - p, F.lit(2))))


def mae_of(value: str | Column = "rating", pred: str | Column = "est") -> Column:
    v, p = (F.col(c) if isinstance(c, str) else c for c in (value, pred))
    return F.avg(F.abs(v - p))


def rmse(df: DataFrame, pred: str = "est", value: str = "rating") -> DataFrame:
    return df.agg(rmse_of(value, pred).alias("rmse"))


def mae(df: DataFrame, pred: str = "est", value: str = "rating") -> DataFrame:
    return df.agg(mae_of(value, pred).alias("mae"))


def model_report(metrics: dict[str, DataFrame]) -> DataFrame:
    """One (model, metric, value) table from one-row frames of metrics."""
    parts = []
    for model, one in metrics.items():
        long = one.select(*[F.col(c).cast("double").alias(c) for c in one.columns])
        parts.append(long.unpivot([], long.columns, "metric", "value")
                     .select(F.lit(model).alias("model"), "metric", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
