"""Content scores, list quality, re-ranking, hybrid lists and explanation inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastegrid.operators import als, cleaning, content, hybrid, quality, ranking, stats, svd
from tastegrid.operators.baseline import baseline
from tastegrid.plans.models import cf_sides, parts, tagged, unseen_topn
from tastegrid.plans.registry import query, r
from tastegrid.plans.tables import DOC_TOKENS, JSON_VEC
from tastegrid.session import stage
from tastegrid.sources import views as v

ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0)


def liked_of(ratings, bar: int = 4):
    return ratings.filter(F.col("rating") >= bar)


def weights_of(spark, sf):
    texts = content.item_text(v.items(spark, sf))
    return stage(content.term_weights(texts), "weights")


# --- accuracy and list quality -------------------------------------------------------------


@query("metric_rmse", """SELECT part, round(sqrt(AVG(pow(rating - est, 2))), 6) AS rmse FROM base_est GROUP BY part""")
def metric_rmse(spark, sf):
    ratings, train, _ = parts(spark, sf)
    return baseline(tagged(ratings), train).groupBy("part").agg(r(stats.rmse_of(), "rmse"))


@query("metric_mae", """SELECT part, round(AVG(abs(rating - est)), 6) AS mae FROM base_est GROUP BY part""")
def metric_mae(spark, sf):
    ratings, train, _ = parts(spark, sf)
    return baseline(tagged(ratings), train).groupBy("part").agg(r(stats.mae_of(), "mae"))


def top_lists(spark, sf, ratings=None):
    """Each user's five highest rated items."""
    ratings = v.kept_ratings(spark, sf) if ratings is None else ratings
    return ranking.topn(ratings, 5, "rating").select("user_id", "item_id", "rank")


@query("metric_novelty", """SELECT 'fraction' AS form, user_id, round(AVG(1 - popularity), 6) AS novelty, COUNT(*) AS matched
      FROM lists JOIN popular USING (item_id) GROUP BY user_id
    UNION ALL SELECT 'log', user_id, round(AVG(1 - popularity_log), 6), COUNT(*) FROM lists JOIN popular USING (item_id)
      GROUP BY user_id
    UNION ALL SELECT 'positive', user_id, round(AVG(1 - popularity), 6), COUNT(*) FROM lists JOIN
      (SELECT item_id, n / MAX(n) OVER () AS popularity FROM (SELECT item_id, COUNT(*) FILTER (rating > 0) AS n
       FROM nullable GROUP BY item_id)) USING (item_id) GROUP BY user_id""")
def metric_novelty(spark, sf):
    ratings = v.kept_ratings(spark, sf)
    lists = top_lists(spark, sf, ratings)
    sources = {"fraction": ratings, "log": ratings, "positive": v.nullable(spark, sf)}
    return cleaning.union_all(*[
        quality.novelty(lists, stats.popularity(src, form=form))
        .select(F.lit(form).alias("form"), "user_id", r("novelty", "novelty"), "matched")
        for form, src in sources.items()])


@query("metric_diversity", """SELECT user_id, round(CASE WHEN COUNT(b.item_id) = 0 THEN 1.0
      ELSE 1 - AVG(list_dot_product(x.v, y.v)) END, 6) + 0.0 AS diversity
    FROM lists a LEFT JOIN lists b USING (user_id) JOIN units x ON x.item_id = a.item_id
    LEFT JOIN units y ON y.item_id = b.item_id WHERE a.item_id < b.item_id GROUP BY user_id
    UNION ALL SELECT user_id, 1.0 FROM lists GROUP BY user_id HAVING COUNT(*) = 1""")
def metric_diversity(spark, sf):
    return quality.diversity(top_lists(spark, sf), v.vectors(spark, sf, as_given=True)).select("user_id", r("diversity", "diversity"))


@query("metric_serendipity", """SELECT l.user_id, round(AVG(1 - list_dot_product(x.v, y.v)), 6) + 0.0 AS serendipity
    FROM lists l JOIN units x ON x.item_id = l.item_id LEFT JOIN (SELECT user_id, item_id AS liked_id, v FROM ratings
      JOIN units USING (item_id) WHERE rating > 4) y ON y.user_id = l.user_id GROUP BY l.user_id""")
def metric_serendipity(spark, sf):
    ratings = v.kept_ratings(spark, sf)
    return quality.serendipity(top_lists(spark, sf, ratings), ratings.filter("rating > 4"), v.vectors(spark, sf, as_given=True)).select(
        "user_id", r("serendipity", "serendipity"))


@query("item_serendipity", """SELECT t.user_id, t.item_id, round(COALESCE(s, 1.0), 6) + 0.0 AS serendipity FROM test t LEFT JOIN (
    SELECT t.user_id, t.item_id, AVG(1 - list_dot_product(a.v, b.v)) AS s FROM test t JOIN train l ON l.user_id = t.user_id
    AND l.rating >= 4 JOIN units a ON a.item_id = t.item_id JOIN units b ON b.item_id = l.item_id
    GROUP BY t.user_id, t.item_id) USING (user_id, item_id)""")
def item_serendipity(spark, sf):
    _, train, test = parts(spark, sf)
    return quality.item_serendipity(test.select("user_id", "item_id"), liked_of(train), v.vectors(spark, sf, as_given=True)).select(
        "user_id", "item_id", r("serendipity", "serendipity"))


def _item_div_sql(extra: str) -> str:
    return f"""SELECT t.user_id, t.item_id, round(COALESCE(s, 1.0), 6) + 0.0 AS diversity FROM ratings t LEFT JOIN (
    SELECT t.user_id, t.item_id, AVG(1 - list_dot_product(a.v, b.v)) AS s FROM ratings t JOIN lists l
    ON l.user_id = t.user_id {extra} JOIN units a ON a.item_id = t.item_id JOIN units b ON b.item_id = l.item_id
    GROUP BY t.user_id, t.item_id) USING (user_id, item_id)"""


def _item_diversity(spark, sf, exclude_self):
    ratings = v.kept_ratings(spark, sf)
    return quality.item_diversity(ratings.select("user_id", "item_id"), top_lists(spark, sf, ratings),
                                  v.vectors(spark, sf, as_given=True), exclude_self).select(
        "user_id", "item_id", r("diversity", "diversity"))


@query("item_diversity", _item_div_sql(""))
def item_diversity(spark, sf):
    return _item_diversity(spark, sf, False)


@query("item_diversity_others", _item_div_sql("AND l.item_id <> t.item_id"))
def item_diversity_others(spark, sf):
    return _item_diversity(spark, sf, True)


def _reranked(spark, sf):
    users, items, ratings = cf_sides(spark, sf)
    before = stage(als.dot_topn(users, items, 5, ratings).select("user_id", "item_id", "rank"), "before")
    liked = liked_of(ratings)
    return users, items, ratings, before, liked, quality.rerank_all(users, items, before, liked, ratings)


@query("rerank_weighted", "SELECT user_id, item_id, adjusted_score, rank FROM reranked")
def rerank_weighted(spark, sf):
    return _reranked(spark, sf)[-1].select("user_id", "item_id", r("adjusted_score", "adjusted_score", 8), "rank")


@query("rerank_candidates", """SELECT user_id, item_id, adjusted_score, rn AS rank FROM (SELECT *, ROW_NUMBER() OVER
      (PARTITION BY user_id ORDER BY adjusted_score DESC, item_id) AS rn FROM (
        SELECT c.user_id, c.item_id, round(0.5 * c.rating + 0.4 * COALESCE(s, 1.0) + 0.1 * COALESCE(d, 1.0), 6) AS adjusted_score
        FROM ratings c LEFT JOIN (SELECT t.user_id, t.item_id, AVG(1 - list_dot_product(a.v, b.v)) AS s FROM ratings t
            JOIN liked l ON l.user_id = t.user_id JOIN units a ON a.item_id = t.item_id JOIN units b ON b.item_id = l.item_id
            GROUP BY t.user_id, t.item_id) USING (user_id, item_id)
          LEFT JOIN (SELECT t.user_id, t.item_id, AVG(1 - list_dot_product(a.v, b.v)) AS d FROM ratings t
            JOIN lists l ON l.user_id = t.user_id JOIN units a ON a.item_id = t.item_id JOIN units b ON b.item_id = l.item_id
            GROUP BY t.user_id, t.item_id) USING (user_id, item_id))) WHERE rn <= 5""")
def rerank_candidates(spark, sf):
    """Re-ranking of a given candidate table (here the rated pairs) by its column scores."""
    ratings, f = v.kept_ratings(spark, sf), v.vectors(spark, sf, as_given=True)
    scored = quality.item_diversity(quality.item_serendipity(ratings, liked_of(ratings), f), top_lists(spark, sf, ratings), f)
    scored = scored.withColumn("adjusted_score", F.round(
        F.col("rating") * 0.5 + F.col("serendipity") * 0.4 + F.col("diversity") * 0.1, 6))
    return ranking.topn(scored, 5, "adjusted_score").select("user_id", "item_id", "adjusted_score", "rank")


def _quality_sql(stage_name: str, lists: str) -> str:
    return f"""SELECT '{stage_name}' AS stage, round((SELECT AVG(1 - popularity_log) FROM {lists} JOIN popular USING (item_id)), 6) AS novelty,
    round((SELECT AVG(d) FROM (SELECT 1 - AVG(list_dot_product(x.v, y.v)) AS d FROM {lists} a JOIN {lists} b
      ON a.user_id = b.user_id AND a.item_id < b.item_id JOIN units x ON x.item_id = a.item_id
      JOIN units y ON y.item_id = b.item_id GROUP BY a.user_id)), 6) AS diversity,
    round((SELECT AVG(s) FROM (SELECT AVG(1 - list_dot_product(x.v, y.v)) AS s FROM {lists} a JOIN liked l USING (user_id)
      JOIN units x ON x.item_id = a.item_id JOIN units y ON y.item_id = l.item_id GROUP BY user_id)), 6) AS serendipity"""


@query("rerank_before_after", _quality_sql("before", "cf_top") + " UNION ALL " + _quality_sql("after", "reranked"))
def rerank_before_after(spark, sf):
    users, items, ratings, before, liked, after = _reranked(spark, sf)
    after = stage(after.select("user_id", "item_id", "rank"), "after")
    pop = stage(stats.popularity(ratings, form="log"), "popularity")
    out = []
    for name, lists in (("before", before), ("after", after)):
        listed = lists.join(pop, "item_id").agg(F.avg(1 - F.col("popularity")).alias("x"))
        per_user = quality.diversity(lists, items).join(quality.serendipity(lists, liked, items), "user_id")
        out.append(per_user.agg(F.avg("diversity").alias("d"), F.avg("serendipity").alias("s")).select(
            F.lit(name).alias("stage"), r(listed.scalar(), "novelty"), r("d", "diversity"), r("s", "serendipity")))
    return cleaning.union_all(*out)


@query("model_report", """SELECT 'global mean' AS model, 'rmse' AS metric, round(sqrt(AVG(pow(rating - mu, 2))), 6) AS value FROM test CROSS JOIN mu
    UNION ALL SELECT 'global mean', 'mae', round(AVG(abs(rating - mu)), 6) FROM test CROSS JOIN mu
    UNION ALL SELECT 'baseline', 'rmse', round(sqrt(AVG(pow(rating - est, 2))), 6) FROM base_est WHERE part = 'test'
    UNION ALL SELECT 'baseline', 'mae', round(AVG(abs(rating - est)), 6) FROM base_est WHERE part = 'test'
    UNION ALL SELECT 'top rated', 'novelty', round((SELECT AVG(n) FROM (SELECT AVG(1 - popularity_log) AS n FROM lists
      JOIN popular USING (item_id) GROUP BY user_id)), 6)
    UNION ALL SELECT 'top rated', 'diversity', round((SELECT AVG(d) FROM (SELECT 1 - AVG(list_dot_product(x.v, y.v)) AS d
      FROM lists a JOIN lists b ON a.user_id = b.user_id AND a.item_id < b.item_id JOIN units x ON x.item_id = a.item_id
      JOIN units y ON y.item_id = b.item_id GROUP BY a.user_id
      UNION ALL SELECT 1.0 FROM lists GROUP BY user_id HAVING COUNT(*) = 1)), 6)
    UNION ALL SELECT 'top rated', 'serendipity', round((SELECT AVG(s) FROM (SELECT AVG(1 - list_dot_product(x.v, y.v)) AS s
      FROM lists a JOIN liked l USING (user_id) JOIN units x ON x.item_id = a.item_id JOIN units y ON y.item_id = l.item_id
      GROUP BY user_id)), 6)""")
def model_report(spark, sf):
    ratings, train, test = parts(spark, sf)
    f, lists = v.vectors(spark, sf, as_given=True), top_lists(spark, sf, ratings)
    errors = [stats.rmse_of().alias("rmse"), stats.mae_of().alias("mae")]
    pop = stats.popularity(ratings, form="log")
    lists_quality = (quality.novelty(lists, pop).join(quality.diversity(lists, f), "user_id", "left")
                     .join(quality.serendipity(lists, liked_of(ratings), f), "user_id", "left"))
    report = stats.model_report({
        "global mean": test.withColumn("est", train.agg(F.avg("rating")).scalar()).agg(*errors),
        "baseline": baseline(test, train).agg(*errors),
        "top rated": lists_quality.agg(*[F.avg(m).alias(m) for m in ("novelty", "diversity", "serendipity")])})
    return report.select("model", "metric", r("value", "value"))


@query("model_comparison")
def model_comparison(spark, sf):
    """Held-out errors of both fitted models beside the simple ones, and the quality of the fitted models' lists
    of unseen items, each judged by its own item vectors."""
    ratings, train, test = parts(spark, sf)
    errors = [stats.rmse_of().alias("rmse"), stats.mae_of().alias("mae")]
    means = stage(stats.group_mean(train, "user_id"), "means")
    model, f = als.als_fit(train), svd.truncated_svd(train, 6, center=True)
    pop, liked = stats.popularity(ratings, form="log"), liked_of(ratings)
    vectors = stage(model.itemFactors.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features")), "als")
    fitted = {
        "als": (als.als_predict(model, test), unseen_topn(model, ratings, 5), vectors),
        "svd": (svd.svd_predict(test, f, means), svd.svd_topn(f, ratings, n=5, user_mean=means), f.items)}
    table = {"global mean": test.withColumn("est", train.agg(F.avg("rating")).scalar()).agg(*errors),
             "baseline": baseline(test, train).agg(*errors)}
    for name, (estimates, lists, items) in fitted.items():
        lists = stage(lists.select("user_id", "item_id", "rank"), name)
        table[f"{name} errors"] = estimates.agg(*errors)
        per_user = (quality.novelty(lists, pop).join(quality.diversity(lists, items), "user_id", "left")
                    .join(quality.serendipity(lists, liked, items), "user_id", "left"))
        table[f"{name} lists"] = per_user.agg(*[F.avg(m).alias(m) for m in ("novelty", "diversity", "serendipity")])
    report = stats.model_report(table)
    return report.select(F.regexp_replace("model", " (errors|lists)$", "").alias("model"), "metric", r("value", "value"))


# --- content -------------------------------------------------------------------------------


@query("item_text_features", "SELECT item_id, title, genres, features FROM texts")
def item_text_features(spark, sf):
    return content.item_text(v.items(spark, sf))


@query("term_counts", "SELECT item_id, token, tf FROM counts")
def term_counts(spark, sf):
    return content.term_counts(content.item_text(v.items(spark, sf)))


@query("tfidf_weights", "SELECT item_id, token, round(weight, 6) AS weight FROM weights")
def tfidf_weights(spark, sf):
    return content.term_weights(content.item_text(v.items(spark, sf))).select("item_id", "token", r("weight", "weight"))


@query("tfidf_documents", f"""WITH toks AS (SELECT doc_id, unnest({DOC_TOKENS}) AS token FROM documents),
    tfs AS (SELECT doc_id, token, COUNT(*) AS tf FROM toks GROUP BY doc_id, token),
    raws AS (SELECT doc_id, token, tf * (ln((1.0 + (SELECT COUNT(*) FROM documents)) / (1 + df)) + 1) AS raw FROM tfs
      JOIN (SELECT token, COUNT(*) AS df FROM tfs GROUP BY token) USING (token) WHERE token NOT IN (SELECT word FROM stop_words))
    SELECT doc_id, token, round(raw / sqrt(SUM(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM raws""")
def tfidf_documents(spark, sf):
    docs = v.spread(v.table(spark, sf, "documents").select("doc_id", "text"))
    return content.term_weights(docs, item="doc_id", text="text").select("doc_id", "token", r("weight", "weight"))


@query("item_content_similarity", """WITH h AS (SELECT a.item_id, b.item_id AS other_id, SUM(a.weight * b.weight) AS score
      FROM weights a JOIN weights b ON a.token = b.token AND a.item_id <> b.item_id GROUP BY a.item_id, b.item_id),
    s AS (SELECT a.item_id, b.item_id AS other_id, round(COALESCE(h.score, 0.0), 8) AS score FROM items a
      JOIN items b ON a.item_id <> b.item_id LEFT JOIN h ON h.item_id = a.item_id AND h.other_id = b.item_id)
    SELECT item_id, other_id, score, rn AS rank FROM (SELECT *, ROW_NUMBER() OVER
      (PARTITION BY item_id ORDER BY score DESC, other_id) AS rn FROM s) WHERE rn <= 5""")
def item_content_similarity(spark, sf):
    return content.similar_items(weights_of(spark, sf), v.items(spark, sf)).select(
        "item_id", "other_id", r("score", "score", 8), "rank")


@query("user_profile", "SELECT user_id, token, round(weight, 6) AS weight FROM profile")
def user_profile(spark, sf):
    return content.user_profile(liked_of(v.kept_ratings(spark, sf)), weights_of(spark, sf), v.items(spark, sf)).select(
        "user_id", "token", r("weight", "weight"))


@query("content_score", """WITH p AS (SELECT user_id, token, SUM(weight) / MAX(n) AS weight FROM train JOIN weights USING (item_id)
      JOIN (SELECT user_id, COUNT(*) AS n FROM train WHERE rating >= 4 GROUP BY user_id) USING (user_id)
      WHERE rating >= 4 GROUP BY user_id, token)
    SELECT t.user_id, t.item_id, round(COALESCE(s, 0.0), 6) AS content_score FROM test t LEFT JOIN (
      SELECT t.user_id, t.item_id, SUM(w.weight * p.weight) AS s FROM test t JOIN weights w ON w.item_id = t.item_id
      JOIN p ON p.user_id = t.user_id AND p.token = w.token GROUP BY t.user_id, t.item_id) USING (user_id, item_id)""")
def content_score(spark, sf):
    _, train, test = parts(spark, sf)
    weights = weights_of(spark, sf)
    profile = content.user_profile(liked_of(train), weights, v.items(spark, sf))
    return content.content_score(test.select("user_id", "item_id"), profile, weights).select(
        "user_id", "item_id", r("content_score", "content_score"))


def _content_topn_sql(weights: str, profile: str, seen: str) -> str:
    return f"""WITH hit AS (SELECT p.user_id, w.item_id, SUM(p.weight * w.weight) AS s FROM {profile} p JOIN {weights} w USING (token)
      GROUP BY p.user_id, w.item_id),
    scored AS (SELECT u.user_id, i.item_id, round(COALESCE(s, 0.0), 8) AS score FROM (SELECT DISTINCT user_id FROM ratings) u
      CROSS JOIN items i ANTI JOIN {seen} x ON x.user_id = u.user_id AND x.item_id = i.item_id
      LEFT JOIN hit h ON h.user_id = u.user_id AND h.item_id = i.item_id)
    SELECT user_id, item_id, score, rn AS rank FROM (SELECT *, ROW_NUMBER() OVER
      (PARTITION BY user_id ORDER BY score DESC, item_id) AS rn FROM scored) WHERE rn <= 5"""


@query("content_topn", _content_topn_sql("weights", "profile", "liked"))
def content_topn(spark, sf):
    ratings = v.kept_ratings(spark, sf)
    return content.content_topn(ratings.select("user_id"), liked_of(ratings), weights_of(spark, sf), v.items(spark, sf)).select(
        "user_id", "item_id", r("score", "score", 8), "rank")


@query("content_topn_counts", _content_topn_sql("(SELECT item_id, token, CAST(tf AS DOUBLE) AS weight FROM counts)", """(
      SELECT user_id, token, SUM(tf) / MAX(n) AS weight FROM liked JOIN counts USING (item_id)
      JOIN (SELECT user_id, COUNT(*) AS n FROM liked GROUP BY user_id) USING (user_id) GROUP BY user_id, token)""", "ratings"))
def content_topn_counts(spark, sf):
    """Raw counts instead of TF-IDF, and all rated items left out."""
    ratings, items = v.kept_ratings(spark, sf), v.items(spark, sf)
    counts = stage(content.term_weights(content.item_text(items), "count"), "counts")
    return content.content_topn(ratings.select("user_id"), liked_of(ratings), counts, items, exclude=ratings).select(
        "user_id", "item_id", r("score", "score", 8), "rank")


# --- hybrid and explanations -----------------------------------------------------------------


def _hybrid(spark, sf, alphas=(0.5,), sides=None):
    """Lists of every user with ratings, over all items; the given vectors or ``sides``."""
    ratings, items = v.kept_ratings(spark, sf), v.items(spark, sf)
    users, rights = sides(ratings) if sides else (v.factors(spark, sf),) * 2
    weights = weights_of(spark, sf)
    profile = stage(content.user_profile(liked_of(ratings), weights, items), "profile")
    return users, rights, ratings, hybrid.hybrid(
        users, rights, profile, weights, ratings.select("user_id"), items, ratings, alphas)


def _hybrid_cols():
    return [r("cf_score", "cf_score", 8), r("content_score", "content_score"), r("hybrid_score", "hybrid_score", 8)]

_HYBRID_SQL = """SELECT user_id, item_id, {}cf_score, round(content_score, 6) AS content_score,
    hybrid_score, rank FROM hybrid WHERE rank <= 5 {}"""


@query("hybrid_score", _HYBRID_SQL.format("", "AND alpha = 0.5"))
def hybrid_score(spark, sf):
    return _hybrid(spark, sf)[-1].select("user_id", "item_id", *_hybrid_cols(), "rank")


@query("hybrid_alpha_sweep", _HYBRID_SQL.format("alpha, ", ""))
def hybrid_alpha_sweep(spark, sf):
    return _hybrid(spark, sf, ALPHAS)[-1].select("user_id", "item_id", "alpha", *_hybrid_cols(), "rank")


@query("hybrid_als")
def hybrid_als(spark, sf):
    """The blend with fitted ALS scores over all unseen items."""
    def fitted(ratings):
        m = als.als_fit(ratings)
        return [side.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"))
                for side in (m.userFactors, m.itemFactors)]
    top = _hybrid(spark, sf, sides=fitted)[-1]
    return top.join(v.items(spark, sf), "item_id").select("user_id", "item_id", "title", "genres", *_hybrid_cols(), "rank")


def _vectors_sql(lists: str, table: str = "factors") -> str:
    return f"""SELECT l.user_id, COALESCE(MAX(u.vec), 'null') AS user_vector,
    '{{' || string_agg('"' || l.item_id || '":' || COALESCE(v.vec, 'null'), ',' ORDER BY l.rank) || '}}' AS item_vectors FROM {lists} l
    LEFT JOIN (SELECT id, {JSON_VEC} AS vec FROM {table}) v ON v.id = l.item_id
    LEFT JOIN (SELECT id, {JSON_VEC} AS vec FROM {table}) u ON u.id = l.user_id GROUP BY l.user_id"""


@query("latent_vectors_json", _vectors_sql("lists", "vectors_of_all"))
def latent_vectors_json(spark, sf):
    f = v.vectors(spark, sf)
    return hybrid.latent_vectors_json(top_lists(spark, sf), f, f)


@query("explain_prompts", f"""WITH recs AS (SELECT * FROM hybrid WHERE rank <= 5 AND alpha = 0.5),
    vectors AS ({_vectors_sql("recs")}),
    rec_text AS (SELECT user_id, string_agg('- ' || title || ' (' || genres || ') ' || printf('%.3f', round(content_score, 3)),
      chr(10) ORDER BY rank) AS t FROM recs JOIN items USING (item_id) GROUP BY user_id),
    liked_text AS (SELECT user_id, string_agg('- ' || title || ' (' || genres || ')', chr(10) ORDER BY rn) AS t FROM
      (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS rn FROM liked) JOIN items USING (item_id)
      GROUP BY user_id)
    SELECT r.user_id, 'Latent vectors of the user: ' || user_vector || chr(10) || 'Latent vectors of the items: ' || item_vectors
      || chr(10) || 'Top recommendations:' || chr(10) || r.t || chr(10) || 'Top liked items:' || chr(10) || COALESCE(l.t, '(none)')
      || chr(10) || 'Blend: score = content * 0.5 + collaborative * 0.5' || chr(10)
      || 'Explain the user''s preferences, the effect of the blend, why these items fit, and which other items to consider.' AS prompt
    FROM rec_text r JOIN vectors USING (user_id) LEFT JOIN liked_text l ON l.user_id = r.user_id""")
def explain_prompts(spark, sf):
    users, items, ratings, recs = _hybrid(spark, sf)
    recs = stage(recs, "recs")
    vectors = hybrid.latent_vectors_json(recs, users, items)
    return hybrid.explain_prompts(recs, liked_of(ratings), vectors, v.items(spark, sf))
