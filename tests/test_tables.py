import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastegrid.functions import text as tx
from tastegrid.operators import cleaning, ranking, stats
from tastegrid.operators.baseline import baseline, biases, mean_center
from tastegrid.plans import tables
from tastegrid.sources import views
from tastegrid.sources.files import read_ratings, write_table

N = None
# 5 × 5 toy: users 1..5, columns i1..i5
TOY = [(1, 5.0, 4.0, N, 3.0, 1.0), (2, 3.0, N, 2.0, N, 5.0), (3, N, 2.0, 4.0, N, 3.0),
       (4, 1.0, N, 5.0, 4.0, N), (5, N, 5.0, 3.0, 2.0, N)]


@pytest.fixture()
def toy(spark):
    return spark.createDataFrame(TOY, "user_id long, i1 double, i2 double, i3 double, i4 double, i5 double")


def test_unpivot_and_pivot_return_the_matrix(toy):
    long = cleaning.unpivot_wide(toy, ["user_id"], [f"i{k}" for k in range(1, 6)])
    assert long.count() == 25 and cleaning.unknown_cells(long).count() == 9
    back = cleaning.pivot_matrix(cleaning.drop_null_ratings(long), [1, 2, 3, 4, 5], prefix="i")
    assert sorted(map(tuple, back.collect())) == TOY


def test_pivot_takes_the_mean_of_duplicates(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 1, 4.0)], "user_id long, item_id int, rating double")
    assert tuple(cleaning.pivot_matrix(df, [1, 2], fill=0.0).first()) == (1, 3.0, 0.0)


def test_latin1_headerless_and_sentinel(spark, tmp_path):
    path = tmp_path / "names.csv"
    path.write_bytes("book_id,name\n1,Café\n".encode("latin1"))
    schema = T.StructType([T.StructField("book_id", T.LongType()), T.StructField("name", T.StringType())])
    assert read_ratings(spark, str(path), schema, encoding="ISO-8859-1").first()["name"] == "Café"
    wide = tmp_path / "wide.csv"
    wide.write_text("1,99,-3.5\n2,4.25,99\n")
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])
    got = read_ratings(spark, str(wide), schema, header=False, sentinel=99.0)
    assert sorted(map(tuple, got.collect())) == [(1, None, -3.5), (2, 4.25, None)]


def test_write_once(spark, tmp_path):
    path = os.path.join(tmp_path, "t")
    one = spark.createDataFrame([(1, 2, 3.0)], "user_id long, item_id long, rating double")
    write_table(one, path)
    write_table(one.union(one), path)
    assert read_ratings(spark, path).count() == 1


@pytest.mark.parametrize("parts", [1, 16])
def test_dense_index_and_row_ids_ignore_partitioning(spark, parts):
    ids = [3, -5, 2**40, 17, 17, 99, 0] + list(range(1000, 1500))
    df = spark.createDataFrame([(i,) for i in ids], "user_id long").repartition(parts)
    got = {r["user_id"]: r["idx"] for r in cleaning.dense_index(df).collect()}
    assert got == {u: n for n, u in enumerate(sorted(set(ids)))}
    rows = cleaning.surrogate_row_id(df.distinct(), "user_id").agg(F.min("row_id"), F.max("row_id")).first()
    assert tuple(rows) == (1, len(set(ids)))


@pytest.mark.parametrize("ids, kind", [
    (["b", "a", "B", "", "ab", "\u00e9", "z" * 3000, "\U0001F600", "a"] + [f"k{i}" for i in range(700)], "string"),
    ([2**62, -2**62, 2**53, 2**53 + 1, 0, 0], "long"), ([7] * 5, "long"), ([], "string")])
def test_id_dictionary_keeps_the_order_of_any_ids(spark, ids, kind):
    df = spark.createDataFrame([(i,) for i in [*ids, None]], f"name {kind}").repartition(5)
    got = {r["name"]: r["idx"] for r in cleaning.id_dictionary(df, "name").collect()}
    order = sorted(set(ids), key=lambda i: i.encode() if kind == "string" else i)
    assert got == {i: n for n, i in enumerate(order)}


def test_samples_and_splits_do_not_depend_on_partitioning(spark):
    df = spark.range(2000).select((F.col("id") % 50).alias("user_id"), F.floor(F.col("id") / 50).alias("item_id"))
    a = cleaning.sample_fraction(df, 0.3)
    assert sorted(a.collect()) == sorted(cleaning.sample_fraction(df.repartition(16), 0.3).collect())
    assert 450 < a.count() < 750 and cleaning.sample_fraction(df, 1.0).count() == 2000
    assert cleaning.sample_n(df.select("user_id").distinct(), 7).count() == 7
    for method in ("modulo", "random"):
        train, test = cleaning.split(df, method=method)
        assert train.count() + test.count() == 2000 and 1450 < train.count() < 1750


def test_rank_keeps_ties_and_exact_does_not(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([9.0, 8.0, 7.0, 7.0, 7.0, 1.0])], "user_id long, item_id long, score double")
    assert ranking.topn(df, 3, ties="rank").count() == 5
    assert [r["item_id"] for r in ranking.topn(df, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_candidates_minus_seen(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    seen = spark.createDataFrame([(1, i) for i in range(1, 4)], "user_id long, item_id int")
    left = ranking.anti_seen(ranking.candidate_cells(users, [1, 2, 3]), seen)
    assert sorted(map(tuple, left.collect())) == [(2, 1), (2, 2), (2, 3)]
    with pytest.raises(ValueError):
        ranking.candidate_cells(users, list(range(2000)))


def test_histogram_closes_the_last_bin_and_keeps_empty_ones(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 0.5, 1.0, 9.9, 10.0]], "rating double")
    assert [r["n"] for r in stats.histogram(df, bins=10).orderBy("bin").collect()] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 2]


def test_density_integrates_to_most_of_one(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("rating"))
    d = stats.density(df, grid_points=100)
    assert 0.85 < d.agg(F.sum("density")).first()[0] * 9 / 99 < 1.0


def test_density_equals_the_sum_over_all_values(spark):
    """Against the plain sum, on far outliers too; rows after binning are bounded by the range in half bandwidths."""
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=4000), np.r_[rng.normal(size=500), 1e4], rng.exponential(size=3000) * 1e-3, rng.integers(0, 5, 900).astype(float)):
        df = spark.createDataFrame(pd.DataFrame({"rating": x}))
        got = np.array([r.density for r in stats.density(df).orderBy("point").collect()])
        h = x.std(ddof=1) * len(x) ** -0.2
        grid = np.linspace(x.min(), x.max(), 50)
        want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
        assert np.abs(got - want).max() < 1e-11 / h
        bins = stats._moments(df.select(F.col("rating").alias("x")), F.lit(float(x.min())), F.lit(float(h))).count()
        assert bins <= np.ptp(x) / (h / 2) + 1
    assert stats.density(spark.createDataFrame([], "rating double")).count() == 0
    assert stats.density(spark.createDataFrame([(None,), (None,)], "rating double")).count() == 0


def test_baseline_by_hand(spark, toy):
    long = cleaning.drop_null_ratings(cleaning.unpivot_wide(toy, ["user_id"], [f"i{k}" for k in range(1, 6)]))
    train, test = long.filter("item_id < 5"), long.filter("item_id = 5")
    mu = train.agg(F.avg("rating")).first()[0]
    assert biases(train)[0].first()["mu"] == mu
    got = {r["user_id"]: r["est"] for r in baseline(test, train).collect()}
    assert set(got) == {1, 2, 3} and all(x is None for x in got.values())  # item 5 is not in train
    got = {r["user_id"]: r["est"] for r in baseline(test, train, default=0.0).collect()}
    assert abs(got[1] - 4.0) < 1e-12  # user 1 rated 5, 4 and 3
    own = baseline(test, train, fit_on="self").filter("user_id = 1").first()["est"]
    assert abs(own - 1.0) < 1e-12


def test_centred_means_are_zero(spark, toy_ratings):
    df = spark.createDataFrame(toy_ratings, "user_id long, item_id long, rating int")
    worst = mean_center(df).groupBy("user_id").agg(F.abs(F.avg("centered")).alias("m")).agg(F.max("m")).first()[0]
    assert worst < 1e-12


def test_text_functions(spark):
    df = spark.createDataFrame([("Toy Story (1995)!", "Adventure|Sci-Fi"), ("A b", "")], "title string, genres string")
    rows = df.select(tx.feature_text().alias("f"), tx.tokens(tx.feature_text()).alias("t")).collect()
    assert rows[0]["f"] == "toy story 1995 adventure sci-fi" and rows[0]["t"] == ["toy", "story", "1995", "adventure", "sci", "fi"]
    assert rows[1]["f"] == "a b" and rows[1]["t"] == []


def test_more_shuffle_partitions_where_lines_are_many(spark, tmp_path, monkeypatch):
    """No task holds more order lines than the bound, however few shuffle partitions the session has."""
    lines = [(k % 90 if k % 7 else None, k % 13 if k % 11 else None, float(k % 50)) for k in range(600)]
    orders = [(k, k % 17 if k % 5 else None, "5-LOW") for k in range(80)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    user = {k: u for k, u, _ in orders}
    want = {(user[k], i) for k, i, _ in lines if k in user}
    best = {}
    for k, i, q in lines:
        if k in user:
            best[user[k], i] = max(best.get((user[k], i), 0), math.ceil(q / 10))
    for bound, tasks in ((600, None), (20, 30)):
        monkeypatch.setattr(views, "PER_TASK", bound)
        assert views.line_tasks(spark, str(tmp_path)) == tasks
        got = tables.union_distinct(spark, str(tmp_path))
        rated = views.ratings(spark, str(tmp_path))
        if tasks:
            for df in (got, rated):
                assert df._jdf.queryExecution().executedPlan().toString().count("30), REPARTITION_BY_NUM") >= 3
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(want) and set(rows) == want
        assert {(r.user_id, r.item_id): r.rating for r in rated.collect()} == best
