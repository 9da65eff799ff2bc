"""SVD and ALS on planted low-rank ratings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.operators import als, ranking, stats, svd


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(200, 3)) * [3, 2, 1] @ rng.normal(size=(3, 100)) + rng.normal(size=(200, 100)) * 0.01
    mask = rng.random(a.shape) < 0.5
    return a, mask


def frame(spark, a, mask):
    u, i = np.nonzero(mask)
    rows = [(int(x) * 7 + 1, int(y) * 3, float(a[x, y])) for x, y in zip(u, i)]
    return spark.createDataFrame(rows, "user_id long, item_id long, rating double").repartition(4)


def test_factors_match_numpy_and_are_orthonormal(spark, planted):
    a, _ = planted
    f = svd.truncated_svd(frame(spark, a, np.ones_like(a, bool)), 3)
    want = np.linalg.svd(a, compute_uv=False)[:3]
    assert np.allclose(f.sigma, want, rtol=1e-6)
    for side in (f.users, f.items):
        x = np.array([r["features"] for r in side.collect()])
        assert np.allclose(x.T @ x, np.eye(3), atol=1e-7)


def test_masked_matrix_is_the_zero_filled_one(spark, planted):
    a, mask = planted
    filled = np.where(mask, a, 0)
    f = svd.truncated_svd(frame(spark, a, mask), 5)
    assert np.allclose(f.sigma, np.linalg.svd(filled, compute_uv=False)[:5], rtol=1e-3)


def test_insample_error_falls_and_full_rank_rebuilds(spark, planted):
    a, mask = planted
    small, m = a[:30, :8], mask[:30, :8]
    df = frame(spark, small, m)
    f = svd.truncated_svd(df, 8, oversample=0)
    assert abs(sum(s * s for s in f.sigma) - float((small[m] ** 2).sum())) < 1e-6
    full = np.linalg.svd(np.where(m, small, 0))
    for row in svd.svd_curve(df, f, [1, 2, 4, 8]).collect():
        k = row["k"]
        back = full[0][:, :k] * full[1][:k] @ full[2][:k]
        assert abs(row["rmse"] - np.sqrt(((back - small)[m] ** 2).mean())) < 1e-6
    worst = svd.svd_predict(df, f).agg(F.max(F.abs(F.col("est") - F.col("rating")))).first()[0]
    assert worst < 1e-7


def test_svd_topn_excludes_seen_and_orders_by_prediction(spark, planted):
    a, mask = planted
    df = frame(spark, a, mask)
    f = svd.truncated_svd(df, 3, center=True)
    means = stats.group_mean(df)
    top = svd.svd_topn(f, df, n=4, user_mean=means)
    assert top.join(df, ["user_id", "item_id"], "left_semi").count() == 0
    assert top.groupBy("user_id").count().agg(F.min("count"), F.max("count")).first() == (4, 4)
    again = svd.svd_predict(top.select("user_id", "item_id", F.col("est").alias("shown")), f, means)
    assert again.agg(F.max(F.abs(F.col("est") - F.col("shown")))).first()[0] < 1e-7


def test_same_factors_whatever_the_partitions(spark, planted):
    a, mask = planted
    df = frame(spark, a, mask)
    one, many = (svd.truncated_svd(df.repartition(n), 3) for n in (1, 16))
    assert np.allclose(one.sigma, many.sigma, rtol=1e-9)


def test_als_recovers_planted_ratings(spark, planted):
    a, mask = planted
    df = frame(spark, a, mask)
    hidden = frame(spark, a, ~mask)
    m = als.als_fit(df, rank=3, reg=0.01, nonnegative=False)
    err = stats.rmse(als.als_predict(m, hidden)).first()[0]
    assert err < 0.5 < a.std()
    cohort = df.select("user_id").distinct().orderBy("user_id").limit(3)
    pool = als.als_candidates(m, 20, cohort)
    assert pool.count() == 60 and pool.select("user_id").distinct().count() == 3
    unseen = ranking.anti_seen(pool, df)
    assert unseen.join(df, ["user_id", "item_id"], "left_semi").count() == 0
    ids = spark.createDataFrame([(0,), (3,), (10**6,)], "id long")
    assert als.factors_lookup(m, ids).count() == 2  # an unknown id has no row


def test_tuning_marks_the_least_error(spark, planted):
    a, mask = planted
    df = frame(spark, a, mask)
    model, grid = als.als_tune(df, ranks=[1, 3], regs=[0.01], iters=[5], folds=2)
    best = grid.filter("best").first()
    assert best["rank"] == 3 == model.rank and best["rmse"] == grid.agg(F.min("rmse")).first()[0]


def test_argmin_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 2.0)], "k int, rmse double")
    assert stats.argmin(df, "rmse").first()["k"] == 1


def test_als_on_text_and_long_ids(spark):
    """Text users and items beyond int: estimates near a planted rank-one table, lists without seen items, null ids left out."""
    rows = [(f"name {u}", 2**40 + i, float((1 + u % 3) * (1 + i % 2))) for u in range(30) for i in range(20) if (u * 7 + i) % 4]
    train = spark.createDataFrame([*rows, (None, 2**40, 9.0), ("name 1", None, 9.0)], "who string, what long, stars double")
    fitted = als.als_fit_any(train, "who", "what", "stars", rank=3, reg=0.01)
    assert {r.id for r in fitted.factors("user").collect()} == {r[0] for r in rows}
    assert {r.id for r in fitted.factors("item").collect()} == {r[1] for r in rows}
    wanted = [(f"name {u}", 2**40 + i) for u in range(30) for i in range(20) if not (u * 7 + i) % 4]
    pairs = spark.createDataFrame([*wanted, ("nobody", 2**40), (None, 2**40)], "who string, what long")
    got = {(r.who, r.what): r.est for r in fitted.predict(pairs).collect()}
    assert set(got) == set(wanted)
    assert all(abs(e - (1 + int(w.split()[1]) % 3) * (1 + (i - 2**40) % 2)) < 0.3 for (w, i), e in got.items())
    top = fitted.topn(5, train).collect()
    assert {(r.who, r.what) for r in top} == set(wanted) and len(top) == len(wanted)
    assert all(abs(r.score - got[(r.who, r.what)]) < 1e-6 for r in top)


def test_als_drops_the_shuffle_files_of_earlier_iterations(spark, planted):
    import re
    import time

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = (files.apply(k).getName() for k in range(files.size()))
        return {m[1] for m in map(re.compile(r"shuffle_(\d+)_").match, names) if m}
    df = frame(spark, *planted).withColumn("user_id", F.col("user_id").cast("int"))
    before = shuffles()
    model = als.als_fit(df, rank=2, iters=20, nonnegative=False)
    model.userFactors.count()
    for _ in range(20):
        left = len(shuffles() - before)
        if left <= 14:
            break
        time.sleep(0.5)
    assert left <= 14  # 42 or so are made


def test_given_float_vectors_stay_floats_and_are_multiplied_as_doubles(spark):
    from tastegrid.sources import views
    given = views.vectors(spark, "/root/testdata/sf0.001", as_given=True)
    assert given.schema["features"].dataType.elementType.simpleString() == "float"
    rng = np.random.default_rng(5)
    u, v = rng.normal(size=(2, 64)).astype(np.float32) * 1000
    f = spark.createDataFrame([(1, u.tolist()), (2, v.tolist())], "id long, features array<float>")
    pairs = spark.createDataFrame([(1, 2)], "user_id long, item_id long")
    got = als.dot_predict(pairs, f, f).first()["est"]
    want = 0.0
    for x, y in zip(u.tolist(), v.tolist()):
        want += x * y
    assert got == want


def test_pools_are_those_of_spark_without_its_ranking(spark, planted, monkeypatch):
    from pyspark.ml.recommendation import ALSModel
    df = frame(spark, *planted)
    m = als.als_fit(df, rank=10)
    recs = m.recommendForAllUsers(30).select("user_id", F.inline("recommendations")).collect()
    want = {(r.user_id, r.item_id, r.rating) for r in recs}
    monkeypatch.delattr(ALSModel, "recommendForAllUsers")
    monkeypatch.delattr(ALSModel, "recommendForUserSubset")
    got = als.als_candidates(m, 30)
    assert got.dtypes == [("user_id", "bigint"), ("item_id", "bigint"), ("score", "double")]
    assert {tuple(r) for r in got.collect()} == want and len(want) == 200 * 30
    cohort = spark.createDataFrame([(8,), (15,), (15,), (10**6,)], "user_id long")
    assert {tuple(r) for r in als.als_candidates(m, 30, cohort).collect()} == {r for r in want if r[0] in (8, 15)}


def test_tuning_drops_the_shuffle_files_of_earlier_fits(spark, planted):
    import time
    df = frame(spark, *planted).withColumn("user_id", F.col("user_id").cast("int"))

    def files():
        left = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {left.apply(k).getName().split("_")[1] for k in range(left.size()) if left.apply(k).getName().startswith("shuffle_")}
    before = files()
    model, grid = als.als_tune(df, ranks=[1, 2], regs=[0.1], iters=[3], folds=2)
    for _ in range(20):
        left = len(files() - before)
        if left <= 12:
            break
        time.sleep(0.5)
    assert left <= 12  # 5 fits, each of which left several
    assert grid.count() == 2 and model.itemFactors.count() == planted[0].shape[1] and model.getColdStartStrategy() == "drop"
