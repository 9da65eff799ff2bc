"""Baselines, neighbourhoods, SVD and ALS over the rating view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastegrid.functions.vectors import norm
from tastegrid.operators import als, cleaning, knn, ranking, stats, svd
from tastegrid.operators.baseline import baseline, biases, mean_center
from tastegrid.plans.registry import query, r
from tastegrid.plans.tables import CATALOG, cells
from tastegrid.session import stage
from tastegrid.sources import views as v

SCALE = (1.0, 5.0)


def parts(spark, sf):
    """Ratings, train and test."""
    ratings = v.kept_ratings(spark, sf)
    return ratings, *cleaning.split(ratings)


def tagged(ratings):
    return ratings.withColumn("part", cleaning.split_part())


# --- global baseline -------------------------------------------------------------------


@query("raw_mean_rmse", """SELECT part, round(sqrt(AVG(pow(rating - m, 2))), 6) AS rmse FROM
    (SELECT part, rating, AVG(rating) OVER (PARTITION BY part) AS m FROM base_est) GROUP BY part""")
def raw_mean_rmse(spark, sf):
    labelled = tagged(v.kept_ratings(spark, sf))
    means = labelled.groupBy("part").agg(F.avg("rating").alias("est"))
    return labelled.join(means, "part").groupBy("part").agg(r(stats.rmse_of(), "rmse"))


@query("user_item_bias", """SELECT 'user' AS side, user_id AS id, round(m - mu, 6) AS bias FROM user_mean CROSS JOIN mu
    UNION ALL SELECT 'item', item_id, round(m - mu, 6) FROM item_mean CROSS JOIN mu""")
def user_item_bias(spark, sf):
    _, train, _ = parts(spark, sf)
    _, users, items = biases(train)
    return cleaning.union_all(users.select(F.lit("user").alias("side"), F.col("user_id").alias("id"), r("b_u", "bias")),
                              items.select(F.lit("item").alias("side"), F.col("item_id").alias("id"), r("b_i", "bias")))


@query("baseline_estimate", "SELECT part, user_id, item_id, rating, round(est, 6) AS est FROM base_est")
def baseline_estimate(spark, sf):
    ratings, train, _ = parts(spark, sf)
    return baseline(tagged(ratings), train).select("part", "user_id", "item_id", "rating", r("est", "est"))


@query("baseline_rmse", """SELECT part, round(sqrt(AVG(pow(rating - est, 2))), 6) AS rmse, COUNT(*) AS n, COUNT(est) AS known
    FROM base_est GROUP BY part""")
def baseline_rmse(spark, sf):
    ratings, train, _ = parts(spark, sf)
    return (baseline(tagged(ratings), train).groupBy("part")
            .agg(r(stats.rmse_of(), "rmse"), F.count(F.lit(1)).alias("n"), F.count("est").alias("known")))


def cell_parts(spark, sf):
    c = stage(cells(spark, sf), "cells")
    train, test = cleaning.split(cleaning.drop_null_ratings(c))
    return train, test, cleaning.unknown_cells(c)


@query("baseline_unknowns", "SELECT user_id, item_id, round(est, 6) AS est FROM cell_est WHERE part = 'unknown'")
def baseline_unknowns(spark, sf):
    train, _, unknown = cell_parts(spark, sf)
    return baseline(unknown, train).select("user_id", "item_id", r("est", "est"))


@query("baseline_matrix", "SELECT user_id, " + ", ".join(
    f"MAX(CASE WHEN item_id = {i} THEN round(est, 2) END) AS p{i}" for i in range(1, 6)) + " FROM cell_est GROUP BY user_id")
def baseline_matrix(spark, sf):
    train, test, unknown = cell_parts(spark, sf)
    est = baseline(cleaning.union_all(train, test, unknown), train).withColumn("est", F.round("est", 2))
    return cleaning.pivot_matrix(est, CATALOG, value="est", prefix="p")


@query("mean_center", """SELECT r.user_id, r.item_id, r.rating, round(r.rating - m.m, 6) + 0.0 AS centered FROM ratings r
    JOIN (SELECT user_id, AVG(rating) AS m FROM ratings GROUP BY user_id) m ON m.user_id = r.user_id""")
def mean_centered(spark, sf):
    return mean_center(v.kept_ratings(spark, sf)).select("user_id", "item_id", "rating", r("centered", "centered"))


# --- neighbourhoods ----------------------------------------------------------------------


@query("user_similarity", "SELECT a AS user_a, b AS user_b, common, sim FROM user_sim")
def user_similarity(spark, sf):
    _, train, _ = parts(spark, sf)
    return knn.similarity(train, "user").withColumnsRenamed({"a": "user_a", "b": "user_b"})


@query("item_similarity", "SELECT a AS item_a, b AS item_b, common, sim FROM item_sim")
def item_similarity(spark, sf):
    _, train, _ = parts(spark, sf)
    return knn.similarity(train, "item").withColumnsRenamed({"a": "item_a", "b": "item_b"})


def knn_test(spark, sf, axis, kind, scale=SCALE):
    _, train, test = parts(spark, sf)
    sim = stage(knn.similarity(train, axis), "sim")
    est = knn.knn_predict(test, train, sim, axis, kind, scale=scale)
    return test.join(est, ["user_id", "item_id"])


def _knn_out(df):
    return df.select("user_id", "item_id", "rating", r("est", "est"), "neighbours")


_KNN_SQL = "SELECT user_id, item_id, rating, round(est, 6) AS est, neighbours FROM {}"


@query("knn_basic_predict", _KNN_SQL.format("knn_basic"))
def knn_basic_predict(spark, sf):
    return _knn_out(knn_test(spark, sf, "user", "basic"))


@query("knn_means_user_predict", _KNN_SQL.format("knn_user"))
def knn_means_user_predict(spark, sf):
    return _knn_out(knn_test(spark, sf, "user", "means"))


@query("knn_means_item_predict", _KNN_SQL.format("knn_item"))
def knn_means_item_predict(spark, sf):
    return _knn_out(knn_test(spark, sf, "item", "means"))


def _topn_sql(own: str, other: str, near: str, a: str, b: str) -> str:
    """All unseen pairs by brute force: votes, fallbacks and rank."""
    return f"""WITH votes AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {own}_id, {other}_id ORDER BY sim DESC, nb) AS rn
      FROM (SELECT n.{a} AS {own}_id, t.{other}_id, n.{b} AS nb, n.sim, t.rating - m.m AS c FROM {near} n
        JOIN train t ON t.{own}_id = n.{b} JOIN {own}_mean m ON m.{own}_id = n.{b} WHERE n.sim > 0)),
    est AS (SELECT {own}_id, {other}_id, SUM(sim*c)/SUM(sim) AS e, COUNT(*) AS k FROM votes WHERE rn <= 40
      GROUP BY {own}_id, {other}_id),
    scored AS (SELECT u.user_id, i.item_id, COALESCE(k, 0) AS neighbours, round(CASE WHEN um.m IS NULL OR im.m IS NULL THEN mu
        ELSE {own[0]}m.m + COALESCE(e, 0) END, 8) AS est
      FROM (SELECT DISTINCT user_id FROM ratings) u CROSS JOIN (SELECT DISTINCT item_id FROM ratings) i CROSS JOIN mu
      ANTI JOIN ratings s ON s.user_id = u.user_id AND s.item_id = i.item_id
      LEFT JOIN user_mean um ON um.user_id = u.user_id LEFT JOIN item_mean im ON im.item_id = i.item_id
      LEFT JOIN est e ON e.user_id = u.user_id AND e.item_id = i.item_id)
    SELECT user_id, item_id, est, neighbours, rn AS rank FROM (SELECT *, ROW_NUMBER() OVER
      (PARTITION BY user_id ORDER BY est DESC, item_id) AS rn FROM scored) WHERE rn <= 5"""


def _knn_topn(spark, sf, axis):
    ratings, train, _ = parts(spark, sf)
    sim = stage(knn.similarity(train, axis), "sim")
    return knn.knn_topn(train, sim, n=5, axis=axis, seen=ratings).select(
        "user_id", "item_id", r("est", "est", 8), "neighbours", "rank")


@query("knn_user_topn", _topn_sql("user", "item", "near_user", "u", "v"))
def knn_user_topn(spark, sf):
    return _knn_topn(spark, sf, "user")


@query("knn_item_topn", _topn_sql("item", "user", "near_item", "i", "j"))
def knn_item_topn(spark, sf):
    return _knn_topn(spark, sf, "item")


@query("knn_rmse_compare", " UNION ALL ".join(
    f"SELECT '{m}' AS model, round(sqrt(AVG(pow(rating - est, 2))), 6) AS rmse, COUNT(*) AS n FROM {t}"
    for m, t in (("basic", "knn_basic"), ("user_means", "knn_user"), ("item_means", "knn_item"))))
def knn_rmse_compare(spark, sf):
    _, train, test = parts(spark, sf)
    sims = {axis: stage(knn.similarity(train, axis), "sim") for axis in ("user", "item")}
    out = []
    for model, axis, kind in (("basic", "user", "basic"), ("user_means", "user", "means"), ("item_means", "item", "means")):
        est = knn.knn_predict(test, train, sims[axis], axis, kind, scale=SCALE)
        out.append(test.join(est, ["user_id", "item_id"])
                   .agg(r(stats.rmse_of(), "rmse"), F.count(F.lit(1)).alias("n"))
                   .select(F.lit(model).alias("model"), "rmse", "n"))
    return cleaning.union_all(*out)


# --- truncated SVD -----------------------------------------------------------------------

K = 6
# Numbers of factors on the error curves; one fit at the largest serves all.
CURVE = [1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 300]


def _user_means(train):
    return stats.group_mean(train, "user_id")


@query("svd_factors")
def svd_factors(spark, sf):
    """Values with the lengths of their vectors (1 on both sides)."""
    _, train, _ = parts(spark, sf)
    f = svd.truncated_svd(train, K)

    def lengths(side, name):
        return (side.select(F.posexplode("features").alias("factor", "x"))
                .groupBy("factor").agg(r(F.sqrt(F.sum(F.col("x") * F.col("x"))), name)))
    sigma = spark.createDataFrame(list(enumerate(f.sigma)), "factor int, sigma double")
    return sigma.join(lengths(f.users, "u_norm"), "factor").join(lengths(f.items, "v_norm"), "factor")


@query("svd_predict")
def svd_predict(spark, sf):
    _, train, test = parts(spark, sf)
    return svd.svd_predict(test, svd.truncated_svd(train, K)).select("user_id", "item_id", "rating", r("est", "est"))


@query("svd_insample_curve")
def svd_insample_curve(spark, sf):
    """Error against k on the fitted data, raw and centred."""
    ratings, _, _ = parts(spark, sf)
    centered = stage(mean_center(ratings, out="c").select("user_id", "item_id", F.col("c").alias("rating")), "centered")
    out = []
    for name, data in (("raw", ratings), ("centered", centered)):
        f = svd.truncated_svd(data, CURVE[-1])
        out.append(svd.svd_curve(data, f, CURVE).select(F.lit(name).alias("ratings"), "k", "rmse", "mae"))
    return cleaning.union_all(*out)


def _holdout_curve(spark, sf):
    _, train, test = parts(spark, sf)
    means = stage(_user_means(train), "means")

    def center(df):
        return df.join(means, "user_id").select(
            "user_id", "item_id", (F.col("rating") - F.col("mean_rating")).alias("rating"))
    f = svd.truncated_svd(center(train), CURVE[-1])
    return svd.svd_curve(center(test), f, CURVE)


@query("svd_holdout_curve")
def svd_holdout_curve(spark, sf):
    return _holdout_curve(spark, sf)


@query("svd_best_k")
def svd_best_k(spark, sf):
    curve = stage(_holdout_curve(spark, sf), "curve")
    return cleaning.union_all(*[stats.argmin(curve, m).select(F.lit(m).alias("metric"), "k", "rmse", "mae")
                                for m in ("rmse", "mae")])


@query("svd_topn")
def svd_topn(spark, sf):
    """Best unseen items by centred fit plus the user's own mean, names attached."""
    ratings, train, _ = parts(spark, sf)
    f = svd.truncated_svd(train, K, center=True)
    top = svd.svd_topn(f, ratings, n=5, user_mean=_user_means(train))
    return (top.join(v.items(spark, sf), "item_id", "left")
            .select("user_id", "item_id", r("est", "est"), "rank", "title", "genres"))


@query("svd_denormalise")
def svd_denormalise(spark, sf):
    _, train, test = parts(spark, sf)
    f = svd.truncated_svd(train, K, center=True)
    return svd.svd_predict(test, f, _user_means(train)).select("user_id", "item_id", "rating", r("est", "est"))


@query("svd_full_rank_identity", """SELECT user_id, CAST(item_id AS BIGINT) AS item_id, round(rating, 6) AS rebuilt,
    round(SUM(rating * rating) OVER (), 3) AS energy FROM cells WHERE rating IS NOT NULL""")
def svd_full_rank_identity(spark, sf):
    """Full rank rebuilds the input, and the squared values add up to the squared ratings."""
    known = stage(cleaning.drop_null_ratings(cells(spark, sf)).withColumn("item_id", F.col("item_id").cast("long")), "cells")
    f = svd.truncated_svd(known, len(CATALOG), oversample=0, max_passes=2)
    energy = round(sum(s * s for s in f.sigma), 3)
    return svd.svd_predict(known, f).select("user_id", "item_id", r("est", "rebuilt"), F.lit(energy).alias("energy"))


# --- ALS ---------------------------------------------------------------------------------


@query("als_fit")
def als_fit(spark, sf):
    """Learned vectors of all items with their lengths."""
    _, train, _ = parts(spark, sf)
    m = als.als_fit(train)
    f = m.itemFactors.select(F.col("id").cast("long").alias("item_id"), F.col("features").cast("array<double>").alias("features"))
    return f.select("item_id", F.size("features").alias("rank"), norm("features").alias("norm"))


@query("als_grid_cv")
def als_grid_cv(spark, sf):
    _, train, _ = parts(spark, sf)
    return als.als_tune(train)[1]


@query("als_grid_cv_full")
def als_grid_cv_full(spark, sf):
    """The whole grid of 18: ranks, regularisations and iterations."""
    _, train, _ = parts(spark, sf)
    return als.als_tune(train, ranks=[10, 15, 20], regs=[0.01, 0.1, 0.5], iters=[5, 10])[1]


@query("als_best_params")
def als_best_params(spark, sf):
    _, train, _ = parts(spark, sf)
    return als.als_tune(train)[1].filter("best").select("rank", "reg", "iters", "rmse")


@query("als_predict")
def als_predict(spark, sf):
    _, train, test = parts(spark, sf)
    return als.als_predict(als.als_fit(train), test).select("user_id", "item_id", "rating", "est")


@query("als_predict_all_pairs")
def als_predict_all_pairs(spark, sf):
    """Every user with every column of the wide view, minus known cells. Catalogs too long
    to enumerate are ranked by als_recommend_all instead."""
    known = stage(cleaning.drop_null_ratings(cells(spark, sf)), "cells")
    m = als.als_fit(known, rank=3)
    cands = ranking.candidate_cells(known.select("user_id").distinct(), CATALOG)
    return als.als_predict(m, ranking.anti_seen(cands, known))


@query("als_recommend_all")
def als_recommend_all(spark, sf):
    _, train, _ = parts(spark, sf)
    return als.als_candidates(als.als_fit(train))


def unseen_topn(model, seen, n):
    """The n best items per user among those the user has not rated: seen pairs are masked
    before the ranking, so no pool can run short."""
    users, items = ([s.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"))
                     for s in (model.userFactors, model.itemFactors)])
    return als.dot_topn(users, items, n, seen)


@query("als_unseen")
def als_unseen(spark, sf):
    _, train, test = parts(spark, sf)
    seen = ranking.seen_pairs(train, test)
    return unseen_topn(als.als_fit(train), seen, 100).select("user_id", "item_id", "score")


@query("als_topn")
def als_topn(spark, sf):
    ratings, train, _ = parts(spark, sf)
    top = unseen_topn(als.als_fit(train), ratings, 5)
    return top.join(v.items(spark, sf), "item_id", "left").select("user_id", "item_id", "score", "rank", "title", "genres")


def keyed_model(spark, sf):
    """Ratings under text and long ids, and the model fitted on their train part."""
    ratings, train, test = (df.select(v.user_key(), v.item_key(), "rating") for df in parts(spark, sf))
    return ratings, test, als.als_fit_any(train, "user_key", "item_key")


@query("als_predict_any_id")
def als_predict_any_id(spark, sf):
    _, test, fitted = keyed_model(spark, sf)
    return fitted.predict(test).select("user_key", "item_key", "rating", "est")


@query("als_topn_any_id")
def als_topn_any_id(spark, sf):
    ratings, _, fitted = keyed_model(spark, sf)
    return fitted.topn(5, ratings)


@query("factors_lookup")
def factors_lookup(spark, sf):
    """Item vectors of all items that someone rated 5."""
    _, train, _ = parts(spark, sf)
    wanted = train.filter("rating = 5").select(F.col("item_id").alias("id"))
    return als.factors_lookup(als.als_fit(train), wanted)


@query("dot_predict", """SELECT t.user_id, t.item_id, t.rating, round(list_dot_product(u.features, v.features), 6) AS est
    FROM ratings t JOIN vectors_of_all u ON u.id = t.user_id JOIN vectors_of_all v ON v.id = t.item_id""")
def dot_predict(spark, sf):
    f = v.vectors(spark, sf, as_given=True)
    return als.dot_predict(v.ratings(spark, sf), f, f).select("user_id", "item_id", "rating", r("est", "est"))


@query("dot_topn", "SELECT user_id, item_id, score, rank FROM cf_top")
def dot_topn(spark, sf):
    """Best unseen items by given factors over all users and items."""
    users, items, ratings = cf_sides(spark, sf)
    return als.dot_topn(users, items, 5, ratings).select("user_id", "item_id", r("score", "score", 8), "rank")


def cf_sides(spark, sf):
    """User factors, item factors, ratings."""
    f, ratings = v.vectors(spark, sf), v.kept_ratings(spark, sf)
    users = f.join(ratings.select(F.col("user_id").alias("id")).distinct(), "id", "left_semi")
    items = f.join(v.items(spark, sf).select(F.col("item_id").alias("id")), "id", "left_semi")
    return users, items, ratings
