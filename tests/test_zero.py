"""Zero vectors, zero ratings and constant columns give defined values, not errors."""

from pyspark.sql import functions as F

from tastegrid.functions import vectors
from tastegrid.operators import knn, stats


def test_similarity_of_zero_ratings_is_zero(spark):
    train = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.0), (2, 1, 3.0), (2, 2, 4.0)], "user_id int, item_id int, rating double")
    assert [r.sim for r in knn.similarity(train).collect()] == [0.0]


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(vectors.cosine("a", "b").alias("c")).first().c == 0.0
    assert df.transform(vectors.unit("a")).first().unit == [0.0, 0.0]


def test_density_of_constant_data_is_null(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "rating double")
    assert all(r.density is None for r in stats.density(df).collect())


def test_popularity_without_positive_rating(spark):
    df = spark.createDataFrame([(1, -1.0), (2, 0.0)], "item_id int, rating double")
    got = stats.popularity(df, form="positive").select(F.max("popularity").alias("p")).first().p
    assert got == 0.0
