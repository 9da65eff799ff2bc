"""ALS models: fit, tuning, predictions, candidate pools and factor lookups."""

from __future__ import annotations

import gc
from dataclasses import dataclass

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.functions.vectors import dot
from tastegrid.operators.cleaning import id_dictionary
from tastegrid.operators.pruned import pruned_topn
from tastegrid.session import drop_path, kept_path, shared_dir, stage


EVERY = 2  # iterations between checkpoints: shuffle files of earlier ones are deleted there
PER_BLOCK = 5_000_000  # ratings: a task holds the vectors of a block's; Spark's ten blocks are the least


def _estimator(user: str, item: str, value: str, seed: int, kind: type[ALS] = ALS, every: int = EVERY, **params) -> ALS:
    return kind(userCol=user, itemCol=item, ratingCol=value, coldStartStrategy="drop",
                implicitPrefs=False, seed=seed, checkpointInterval=every, **params)


class _OneByOne(ALS):
    """Models whose factors are read from the shared folder, so that the shuffle files and cached blocks of a fit can go as
    it ends: the driver's garbage collection deletes them, and a model of Spark's holds on to them. A model's files go when
    the next is fitted; by then it has been judged."""

    def _fit(self, dataset: DataFrame) -> ALSModel:
        spark = dataset.sparkSession
        while self.kept:
            drop_path(spark, self.kept.pop())
        path = kept_path(spark, "als")
        super()._fit(dataset).write().save(path)
        self.kept.append(path)
        gc.collect()  # Python's references first
        spark._jvm.System.gc()
        return ALSModel.load(path)


def als_fit(train: DataFrame, rank: int = 10, reg: float = 0.1, iters: int = 10,
            nonnegative: bool = True, seed: int = 42, user: str = "user_id", item: str = "item_id",
            value: str = "rating") -> ALSModel:
    """Explicit-feedback ALS. Ids must fit in int. The checkpoint folder is set so that
    fits cut their lineage there and drop the shuffle files behind it."""
    shared_dir(train.sparkSession)
    return _estimator(user, item, value, seed, rank=rank, regParam=reg, maxIter=iters,
                      nonnegative=nonnegative).fit(train)


def als_tune(train: DataFrame, ranks: list[int] = (10, 20), regs: list[float] = (0.1, 0.5),
             iters: list[int] = (10,), folds: int = 3, parallelism: int = 1, nonnegative: bool = False,
             seed: int = 42, user: str = "user_id", item: str = "item_id",
             value: str = "rating") -> tuple[ALSModel, DataFrame]:
    """Grid × k-fold cross-validation on RMSE: best model and (rank, reg, iters, rmse, best)."""
    shared_dir(train.sparkSession)
    train = stage(train, "train")  # read once, used by folds × grid fits
    blocks = max(10, -(-train.count() // PER_BLOCK))
    als = _estimator(user, item, value, seed, _OneByOne, 1, nonnegative=nonnegative, numUserBlocks=blocks, numItemBlocks=blocks)
    als.kept = []
    grid = (ParamGridBuilder().addGrid(als.rank, list(ranks)).addGrid(als.regParam, list(regs))
            .addGrid(als.maxIter, list(iters)).build())
    judge = RegressionEvaluator(metricName="rmse", labelCol=value, predictionCol="prediction")
    fitted = CrossValidator(estimator=als, estimatorParamMaps=grid, evaluator=judge,
                            numFolds=folds, parallelism=parallelism, seed=seed).fit(train)
    scores = [float(m) for m in fitted.avgMetrics]
    rows = [(int(p[als.rank]), float(p[als.regParam]), int(p[als.maxIter]), m, m == min(scores))
            for p, m in zip(grid, scores)]
    table = train.sparkSession.createDataFrame(rows, "rank int, reg double, iters int, rmse double, best boolean")
    return fitted.bestModel, table


def als_predict(model: ALSModel, pairs: DataFrame, est: str = "est") -> DataFrame:
    return model.transform(pairs).withColumnRenamed("prediction", est)


def als_candidates(model: ALSModel, pool: int = 100, users: DataFrame | None = None,
                   user: str = "user_id", item: str = "item_id") -> DataFrame:
    """(user, item, score): each user's best ``pool`` items, seen ones included. A cohort
    is ranked by itself, as a filter would not pass through the ranking. Rows are those of ``recommendForAllUsers``:
    scores are sums of floats, and of equal ones the higher ids are taken. That method sorts ``pool`` rows per user and
    block of 4,096 items on disk; here only each task's best leave it."""
    known = model.userFactors
    if users is not None:
        known = known.join(users.select(F.col(user).cast("int").alias("id")).distinct(), "id", "left_semi")
    top = pruned_topn(known.select(F.col("id").alias("l"), F.col("features").alias("vec")),
                      model.itemFactors.select((-F.col("id").cast("long")).alias("r"), F.col("features").alias("vec")), pool, floats=True)
    return top.select(F.col("l").alias(user), (-F.col("r")).alias(item), "score")


def factors_lookup(model: ALSModel, ids: DataFrame, side: str = "item", id_col: str = "id") -> DataFrame:
    """(id, features) of the listed ids; an unknown id has no row."""
    f = model.itemFactors if side == "item" else model.userFactors
    wanted = ids.select(F.col(id_col).cast("int").alias("id")).distinct()
    return f.join(wanted, "id", "left_semi").select(
        F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"))


def dot_predict(pairs: DataFrame, user_factors: DataFrame, item_factors: DataFrame,
                user: str = "user_id", item: str = "item_id", est: str = "est") -> DataFrame:
    """User vector · item vector for the pairs whose two ids have vectors. Vectors travel in the type they have and are
    multiplied as doubles."""
    u = user_factors.select(F.col("id").alias(user), F.col("features").alias("_u"))
    v = item_factors.select(F.col("id").alias(item), F.col("features").alias("_v"))
    return pairs.join(u, user).join(v, item).withColumn(est, dot(F.col("_u").cast("array<double>"), F.col("_v").cast("array<double>"))).drop("_u", "_v")


def dot_topn(user_factors: DataFrame, item_factors: DataFrame, n: int, seen: DataFrame | None = None,
             user: str = "user_id", item: str = "item_id") -> DataFrame:
    """(user, item, score, rank): best n items per user from any two factor tables."""
    out = pruned_topn(user_factors.select(F.col("id").alias("l"), F.col("features").alias("vec")),
                      item_factors.select(F.col("id").alias("r"), F.col("features").alias("vec")), n,
                      None if seen is None else seen.select(F.col(user).alias("l"), F.col(item).alias("r")))
    return out.select(F.col("l").alias(user), F.col("r").alias(item), "score", "rank")


@dataclass
class KeyedALS:
    """A fitted model whose ids are numbers of two dictionaries, (id, idx) each, and its results under the true ids."""

    model: ALSModel
    users: DataFrame
    items: DataFrame
    user: str = "user_id"
    item: str = "item_id"

    def factors(self, side: str = "item") -> DataFrame:
        """(id, features) under the true ids."""
        known, made = (self.items, self.model.itemFactors) if side == "item" else (self.users, self.model.userFactors)
        return known.join(made.withColumnRenamed("id", "idx"), "idx").select("id", F.col("features").cast("array<double>").alias("features"))

    def predict(self, pairs: DataFrame, est: str = "est") -> DataFrame:
        """``pairs`` with an estimate; as with Spark's model, pairs with an unseen id have no row."""
        return dot_predict(pairs, self.factors("user"), self.factors("item"), self.user, self.item, est)

    def topn(self, n: int, seen: DataFrame | None = None) -> DataFrame:
        """(user, item, score, rank): the best n items of every user but those in ``seen``; equal scores by ascending item."""
        sides = [s.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"))
                 for s in (self.model.userFactors, self.model.itemFactors)]
        if seen is not None:
            seen = self._numbered(seen.select(self.user, self.item))
        top = dot_topn(*sides, n, seen, "_u", "_i")
        u, i = self.users.select(F.col("id").alias(self.user), F.col("idx").alias("_u")), self.items.select(F.col("id").alias(self.item), F.col("idx").alias("_i"))
        return top.join(u, "_u").join(i, "_i").select(self.user, self.item, "score", "rank")

    def _numbered(self, rows: DataFrame) -> DataFrame:
        u, i = self.users.select(F.col("id").alias(self.user), F.col("idx").alias("_u")), self.items.select(F.col("id").alias(self.item), F.col("idx").alias("_i"))
        return rows.join(u, self.user).join(i, self.item).drop(self.user, self.item)


def als_fit_any(train: DataFrame, user: str = "user_id", item: str = "item_id", value: str = "rating", **params) -> KeyedALS:
    """``als_fit`` for ids of any sortable type, text and long ones included. The dictionaries keep the ids' order,
    so equal scores rank as the ids do. Rows with a null id are left out. Over 2^31 - 1 ids of a
    side raise an error, as Spark's ALS takes int ids."""
    sides = []
    for col in (user, item):
        known = stage(id_dictionary(train, col).withColumnRenamed(col, "id"), "dictionary")
        if known.count() > (1 << 31) - 1:
            raise ValueError(f"ALS takes at most 2^31 - 1 ids: {col}")
        sides.append(known)
    keyed = KeyedALS(None, *sides, user, item)
    rows = keyed._numbered(train.select(user, item, value)).select(F.col("_u").cast("int").alias("_u"), F.col("_i").cast("int").alias("_i"), value)
    keyed.model = als_fit(rows, user="_u", item="_i", value=value, **params)
    return keyed
