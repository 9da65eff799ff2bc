"""Sources, cleaning, joins, aggregates, ranking and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastegrid.functions import text as tx
from tastegrid.functions.vectors import as_json, cosine, dot
from tastegrid.operators import cleaning, ranking, stats
from tastegrid.operators.baseline import mean_center
from tastegrid.operators.svd import Factors, svd_curve
from tastegrid.plans.registry import query, r
from tastegrid.session import scratch_path
from tastegrid.sources import views as v
from tastegrid.sources.files import read_ratings, write_table

# --- sources and sinks ---------------------------------------------------------------


@query("scan_ratings", "SELECT user_id, item_id, CAST(rating AS DOUBLE) AS rating FROM ratings")
def scan_ratings(spark, sf):
    path = scratch_path(spark, "ratings-csv")
    write_table(v.ratings(spark, sf), path)
    return read_ratings(spark, path)


@query("scan_headerless", "SELECT * FROM wide")
def scan_headerless(spark, sf):
    path = scratch_path(spark, "wide-csv")
    v.wide(spark, sf).fillna(99.0).write.csv(path, header=False)
    schema = T.StructType([T.StructField("_c0", T.LongType())] +
                          [T.StructField(f"_c{i}", T.DoubleType()) for i in range(1, len(v.WIDE_COLS) + 1)])
    return read_ratings(spark, path, schema, header=False, sentinel=99.0).toDF("user_id", *v.WIDE_COLS)


@query("sink_roundtrip", """SELECT * FROM nullable WHERE rating IS NOT NULL AND rating >= 0 AND title IS NOT NULL""")
def sink_roundtrip(spark, sf):
    clean = cleaning.clean_ratings(v.nullable(spark, sf))
    path = scratch_path(spark, "clean-csv")
    write_table(clean, path)
    write_table(clean.limit(0), path)  # the table exists, so this leaves it as it is
    return read_ratings(spark, path, clean.schema)


@query("inline_table", """SELECT o_orderpriority, weight, COUNT(*) AS n_orders FROM orders
    JOIN (VALUES ('1-URGENT', 5.0), ('2-HIGH', 4.0), ('3-MEDIUM', 3.0), ('4-NOT SPECIFIED', 2.0), ('5-LOW', 1.0))
      t(p, w) ON o_orderpriority = p CROSS JOIN (SELECT 1) CROSS JOIN LATERAL (SELECT CAST(w AS DOUBLE) AS weight)
    GROUP BY o_orderpriority, weight""")
def inline_table(spark, sf):
    weights = spark.createDataFrame([(p, float(5 - i)) for i, p in enumerate(v.PRIORITIES)],
                                    "o_orderpriority string, weight double")
    return (v.table(spark, sf, "orders").join(weights, "o_orderpriority")
            .groupBy("o_orderpriority", "weight").agg(F.count(F.lit(1)).alias("n_orders")))


# --- cleaning and reshaping ----------------------------------------------------------


@query("project_rename", "SELECT item_id AS book_id, user_id AS reader_id, rating AS score FROM lines")
def project_rename(spark, sf):
    return (v.rating_lines(spark, sf).drop("o_orderpriority")
            .withColumnsRenamed({"user_id": "reader_id", "item_id": "book_id", "rating": "score"})
            .select("book_id", "reader_id", "score"))


@query("sentinel_to_null", "SELECT * FROM wide")
def sentinel_to_null(spark, sf):
    return cleaning.sentinel_to_null(v.wide(spark, sf).fillna(99.0), v.WIDE_COLS)


@query("surrogate_row_id", "SELECT o_orderkey, o_custkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS row_id FROM orders")
def surrogate_row_id(spark, sf):
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return cleaning.surrogate_row_id(orders, "o_orderkey")


@query("unpivot_wide", "SELECT * FROM cells")
def unpivot_wide(spark, sf):
    return cleaning.unpivot_wide(v.wide(spark, sf), ["user_id"], v.WIDE_COLS)


@query("pivot_matrix", "SELECT user_id, " + ", ".join(
    f"round(COALESCE(AVG(CASE WHEN o_orderpriority LIKE '{i}%' THEN rating END), 0.0), 6) AS p{i}"
    for i in range(1, 6)) + " FROM lines GROUP BY user_id")
def pivot_matrix(spark, sf):
    lines = v.rating_lines(spark, sf).withColumn("item_id", F.substring("o_orderpriority", 1, 1).cast("int"))
    m = cleaning.pivot_matrix(lines, [1, 2, 3, 4, 5], fill=0.0, prefix="p")
    return m.select("user_id", *[r(c, c) for c in v.WIDE_COLS])


def cells(spark, sf):
    return cleaning.unpivot_wide(v.wide(spark, sf), ["user_id"], v.WIDE_COLS)


@query("drop_null_ratings", "SELECT * FROM cells WHERE rating IS NOT NULL")
def drop_null_ratings(spark, sf):
    return cleaning.drop_null_ratings(cells(spark, sf))


@query("unknown_cells", "SELECT user_id, item_id FROM cells WHERE rating IS NULL")
def unknown_cells(spark, sf):
    return cleaning.unknown_cells(cells(spark, sf)).select("user_id", "item_id")


@query("null_counts", "SELECT " + ", ".join(f"COUNT(*) FILTER ({c} IS NULL) AS {c}" for c in
       ("user_id", "item_id", "rating", "title", "genres")) + " FROM nullable")
def null_counts(spark, sf):
    return cleaning.null_counts(v.nullable(spark, sf))


@query("dataset_profile", """SELECT COUNT(*) AS n_rows, CAST(3 AS BIGINT) AS n_columns,
    COUNT(DISTINCT user_id) AS n_users, COUNT(DISTINCT item_id) AS n_items FROM ratings""")
def dataset_profile(spark, sf):
    return cleaning.dataset_profile(v.ratings(spark, sf))


@query("clean_ratings", "SELECT * FROM nullable WHERE rating >= 0 AND title IS NOT NULL")
def clean_ratings(spark, sf):
    return cleaning.clean_ratings(v.nullable(spark, sf))


@query("fill_null_text", """SELECT user_id, item_id, rating, COALESCE(title, '') AS title,
    COALESCE(genres, '') AS genres FROM nullable""")
def fill_null_text(spark, sf):
    return cleaning.fill_null_text(v.nullable(spark, sf))


@query("dedupe_by_key", """SELECT item_id, title, genres FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id
    ORDER BY title NULLS LAST, genres NULLS LAST) AS rn FROM nullable) WHERE rn = 1""")
def dedupe_by_key(spark, sf):
    meta = v.nullable(spark, sf).select("item_id", "title", "genres")
    return cleaning.first_per_key(meta, "item_id", F.col("title").asc_nulls_last(), F.col("genres").asc_nulls_last())


@query("distinct_ids", """SELECT 'user' AS side, user_id AS id FROM (SELECT DISTINCT user_id FROM ratings)
    UNION ALL SELECT 'item', item_id FROM (SELECT DISTINCT item_id FROM ratings)""")
def distinct_ids(spark, sf):
    lines = v.rating_lines(spark, sf)
    users = lines.select("user_id").distinct().select(F.lit("user").alias("side"), F.col("user_id").alias("id"))
    items = lines.select("item_id").distinct().select(F.lit("item").alias("side"), F.col("item_id").alias("id"))
    return users.union(items)


@query("sample_fraction", """SELECT * FROM ratings
    WHERE substr(md5(user_id || '|' || item_id || '|42'), 1, 8) < '80000000'""")
def sample_fraction(spark, sf):
    return cleaning.sample_fraction(v.ratings(spark, sf), 0.5)


@query("sample_n_users", """SELECT user_id FROM (SELECT DISTINCT user_id FROM lines)
    ORDER BY md5(user_id || '|42'), user_id LIMIT 100""")
def sample_n_users(spark, sf):
    return cleaning.sample_n(v.rating_lines(spark, sf).select("user_id").distinct(), 100)


@query("dense_index", """SELECT user_id, ROW_NUMBER() OVER (ORDER BY user_id) - 1 AS idx
    FROM (SELECT DISTINCT user_id FROM lines)""")
def dense_index(spark, sf):
    return cleaning.dense_index(v.rating_lines(spark, sf), "user_id")


@query("id_dictionary", """SELECT user_key, ROW_NUMBER() OVER (ORDER BY user_key) - 1 AS idx
    FROM (SELECT DISTINCT 'u' || user_id AS user_key FROM lines)""")
def id_dictionary(spark, sf):
    """Text ids numbered in the order of their bytes."""
    return cleaning.id_dictionary(v.rating_lines(spark, sf).select(v.user_key()), "user_key")


@query("train_test_split", """SELECT 'train' AS part, * FROM train UNION ALL SELECT 'test', * FROM test""")
def train_test_split(spark, sf):
    return v.ratings(spark, sf).withColumn("part", cleaning.split_part())


@query("matrix_profile", """SELECT cells, nonzeros, round(1 - nonzeros / cells, 6) AS sparsity,
    cells * 8 AS dense_bytes, entries * 12 AS sparse_bytes, round(1 - entries * 12 / (cells * 8), 6) AS byte_reduction
    FROM (SELECT COUNT(DISTINCT user_id) * COUNT(DISTINCT item_id) AS cells,
      COUNT(*) FILTER (rating <> 0) AS nonzeros, COUNT(*) AS entries FROM ratings)""")
def matrix_profile(spark, sf):
    return cleaning.matrix_profile(v.ratings(spark, sf)).select(
        "cells", "nonzeros", r("sparsity", "sparsity"), "dense_bytes", "sparse_bytes",
        r("byte_reduction", "byte_reduction"))


@query("coo_entries", """SELECT u.row, i.col, CAST(SUM(rating) AS BIGINT) AS value FROM lines
    JOIN (SELECT user_id, ROW_NUMBER() OVER (ORDER BY user_id) - 1 AS row FROM (SELECT DISTINCT user_id FROM lines)) u
      USING (user_id)
    JOIN (SELECT item_id, ROW_NUMBER() OVER (ORDER BY item_id) - 1 AS col FROM (SELECT DISTINCT item_id FROM lines)) i
      USING (item_id) GROUP BY u.row, i.col""")
def coo_entries(spark, sf):
    return cleaning.coo_entries(v.rating_lines(spark, sf))


# --- joins and sets --------------------------------------------------------------------


@query("join_metadata_left", "SELECT user_id, item_id, rating, title, genres FROM ratings LEFT JOIN items USING (item_id)")
def join_metadata_left(spark, sf):
    return v.ratings(spark, sf).join(v.items(spark, sf), "item_id", "left").select(
        "user_id", "item_id", "rating", "title", "genres")


@query("join_inner", """SELECT l.user_id, l.item_id, l.rating, round(m.m, 6) AS rating_mean,
    round(list_dot_product(f.features, f.features), 6) AS sq_norm FROM ratings l
    JOIN (SELECT user_id, AVG(rating) AS m FROM ratings GROUP BY user_id) m ON m.user_id = l.user_id
    JOIN factors f ON f.id = l.item_id""")
def join_inner(spark, sf):
    ratings, f = v.kept_ratings(spark, sf), v.factors(spark, sf)
    means = stats.group_mean(ratings, "user_id", name="rating_mean")
    joined = ratings.join(means, "user_id").join(f, F.col("item_id") == F.col("id"))
    return joined.select("user_id", "item_id", "rating", r("rating_mean", "rating_mean"),
                         r(dot("features", "features"), "sq_norm"))


@query("join_lookup", """SELECT r.user_id, r.item_id, round(m.m, 6) AS item_mean FROM test r
    LEFT JOIN (SELECT item_id, AVG(rating) AS m FROM train WHERE rating >= 4 GROUP BY item_id HAVING COUNT(*) > 8) m
    ON m.item_id = r.item_id""")
def join_lookup(spark, sf):
    train, test = cleaning.split(v.kept_ratings(spark, sf))
    means = (train.filter("rating >= 4").groupBy("item_id")
             .agg(F.avg("rating").alias("m"), F.count(F.lit(1)).alias("c")).filter("c > 8"))
    return test.join(means, "item_id", "left").select("user_id", "item_id", r("m", "item_mean"))


CATALOG = [1, 2, 3, 4, 5]


@query("anti_join_seen", """SELECT user_id, item_id FROM cells ANTI JOIN
    (SELECT user_id, item_id FROM cells WHERE rating IS NOT NULL) s USING (user_id, item_id)""")
def anti_join_seen(spark, sf):
    known = cleaning.drop_null_ratings(cells(spark, sf))
    cands = ranking.candidate_cells(v.wide(spark, sf).select("user_id"), CATALOG)
    return ranking.anti_seen(cands, known)


@query("cross_join_candidates", """SELECT user_id, CAST(item_id AS INT) AS item_id FROM
    (SELECT DISTINCT user_id FROM lines) CROSS JOIN (VALUES (1), (2), (3), (4), (5)) t(item_id)""")
def cross_join_candidates(spark, sf):
    return ranking.candidate_cells(v.rating_lines(spark, sf).select("user_id").distinct(), CATALOG)


@query("unseen_counts", """SELECT u.user_id, COUNT(*) AS unseen FROM (SELECT DISTINCT user_id FROM ratings) u
    CROSS JOIN items i ANTI JOIN ratings s ON s.user_id = u.user_id AND s.item_id = i.item_id GROUP BY u.user_id""")
def unseen_counts(spark, sf):
    """How many of all items each user has not rated: catalog size minus known ratings."""
    items = v.items(spark, sf)
    known = v.ratings(spark, sf).join(items, "item_id", "left_semi")
    return (known.groupBy("user_id")
            .agg((items.agg(F.count(F.lit(1))).scalar() - F.count(F.lit(1))).alias("unseen")))


@query("semi_join_in_list", """SELECT user_id, item_id, rating, item_id IN (SELECT item_id FROM items
    WHERE genres LIKE 'ECONOMY|%') AS listed FROM ratings""")
def semi_join_in_list(spark, sf):
    ratings = v.kept_ratings(spark, sf)
    wanted = v.items(spark, sf).filter(F.col("genres").startswith("ECONOMY|")).select("item_id")
    return cleaning.union_all(
        ratings.join(wanted, "item_id", "left_semi").select("user_id", "item_id", "rating", F.lit(True).alias("listed")),
        ratings.join(wanted, "item_id", "left_anti").select("user_id", "item_id", "rating", F.lit(False).alias("listed")))


@query("union_all", """SELECT user_id, item_id, CAST(rating AS DOUBLE) AS rating FROM ratings
    UNION ALL SELECT user_id, CAST(item_id AS BIGINT), rating FROM cells WHERE rating IS NOT NULL""")
def union_all(spark, sf):
    long = v.ratings(spark, sf).withColumn("rating", F.col("rating").cast("double"))
    known = cleaning.drop_null_ratings(cells(spark, sf)).withColumn("item_id", F.col("item_id").cast("long"))
    return cleaning.union_all(long, known)


@query("union_distinct", "SELECT DISTINCT user_id, item_id FROM lines")
def union_distinct(spark, sf):
    train, test = cleaning.split(v.rating_lines(spark, sf))
    return ranking.seen_pairs(train, test, tasks=v.line_tasks(spark, sf))


@query("set_difference", "SELECT user_id, item_id FROM cells WHERE rating IS NULL")
def set_difference(spark, sf):
    cands = ranking.candidate_cells(v.wide(spark, sf).select("user_id"), CATALOG)
    return cands.subtract(cleaning.drop_null_ratings(cells(spark, sf)).select("user_id", "item_id"))


# --- aggregates ------------------------------------------------------------------------


@query("global_mean", "SELECT round(AVG(rating), 6) AS mean_rating FROM ratings")
def global_mean(spark, sf):
    return stats.global_mean(v.ratings(spark, sf)).select(r("mean_rating", "mean_rating"))


@query("group_mean", """SELECT 'user' AS side, user_id AS id, round(AVG(rating), 6) AS mean_rating FROM ratings GROUP BY user_id
    UNION ALL SELECT 'item', item_id, round(AVG(rating), 6) FROM ratings GROUP BY item_id""")
def group_mean(spark, sf):
    ratings = v.kept_ratings(spark, sf)
    return cleaning.union_all(*[
        stats.group_mean(ratings, f"{s}_id").select(F.lit(s).alias("side"), F.col(f"{s}_id").alias("id"),
                                                   r("mean_rating", "mean_rating")) for s in ("user", "item")])


@query("item_popularity", "SELECT item_id, COUNT(*) AS n FROM ratings GROUP BY item_id HAVING COUNT(*) > 1")
def item_popularity(spark, sf):
    return stats.item_popularity(v.ratings(spark, sf), min_count=2)


@query("positive_count", """SELECT item_id, n, round(n / MAX(n) OVER (), 6) AS popularity FROM
    (SELECT item_id, COUNT(*) FILTER (rating > 0) AS n FROM nullable GROUP BY item_id)""")
def positive_count(spark, sf):
    return stats.popularity(v.nullable(spark, sf), form="positive").select("item_id", "n", r("popularity", "popularity"))


@query("popularity_norm", """SELECT item_id, round(popularity, 6) AS popularity_norm,
    round(popularity_log, 6) AS popularity_norm_log FROM popular""")
def popularity_norm(spark, sf):
    ratings = v.kept_ratings(spark, sf)
    log = stats.popularity(ratings, form="log").select("item_id", r("popularity", "popularity_norm_log"))
    return stats.popularity(ratings).join(log, "item_id").select(
        "item_id", r("popularity", "popularity_norm"), "popularity_norm_log")


@query("rating_histogram", """WITH c AS (SELECT round(r.rating - m.m, 6) AS x FROM ratings r JOIN
      (SELECT user_id, AVG(rating) AS m FROM ratings GROUP BY user_id) m ON m.user_id = r.user_id),
    b AS (SELECT MIN(x) AS lo, MAX(x) AS hi, (MAX(x) - MIN(x)) / 20 AS w FROM c)
    SELECT CAST(bin AS BIGINT) AS bin, round(lo + bin * w, 6) AS lower, round(lo + (bin + 1) * w, 6) AS upper,
      COUNT(x) AS n FROM range(20) g(bin) CROSS JOIN b LEFT JOIN c ON least(floor((x - lo) / w), 19) = bin
    GROUP BY bin, lo, w""")
def rating_histogram(spark, sf):
    centered = mean_center(v.kept_ratings(spark, sf)).select(F.round("centered", 6).alias("centered"))
    h = stats.histogram(centered, "centered", 20)
    return h.select("bin", r("lower", "lower"), r("upper", "upper"), F.col("n").cast("long").alias("n"))


@query("rating_density", """WITH c AS (SELECT round(r.rating - m.m, 6) AS x FROM ratings r JOIN
      (SELECT user_id, AVG(rating) AS m FROM ratings GROUP BY user_id) m ON m.user_id = r.user_id),
    b AS (SELECT MIN(x) AS lo, (MAX(x) - MIN(x)) / 49 AS w, COUNT(*) AS n,
      stddev_samp(x) * pow(COUNT(*), -0.2) AS h FROM c),
    d AS (SELECT x, COUNT(*) AS c FROM c GROUP BY x)
    SELECT CAST(point AS BIGINT) AS point, round(lo + point * w, 6) AS x,
      round(SUM(d.c * exp(-0.5 * pow((lo + point * w - d.x) / h, 2))) / (MAX(n) * MAX(h) * sqrt(2 * pi())), 6) AS density
    FROM range(50) g(point) CROSS JOIN b CROSS JOIN d GROUP BY point, lo, w""")
def rating_density(spark, sf):
    centered = mean_center(v.kept_ratings(spark, sf)).select(F.round("centered", 6).alias("centered"))
    return stats.density(centered, "centered", 50).select("point", r("x", "x"), r("density", "density"))


@query("grid_argmin", """WITH s AS (SELECT t.rating, u.features AS u, v.features AS v FROM test t
      LEFT JOIN factors u ON u.id = t.user_id LEFT JOIN factors v ON v.id = t.item_id),
    g AS (SELECT k, sqrt(AVG(pow(rating - COALESCE(list_dot_product(u[1:k], v[1:k]), 0), 2))) AS rmse,
      AVG(abs(rating - COALESCE(list_dot_product(u[1:k], v[1:k]), 0))) AS mae
      FROM s CROSS JOIN (VALUES (4), (8), (16), (32), (64)) t(k) GROUP BY k)
    SELECT CAST(k AS BIGINT) AS k, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM g ORDER BY rmse, k LIMIT 1""")
def grid_argmin(spark, sf):
    _, test = cleaning.split(v.ratings(spark, sf))
    f = v.factors(spark, sf)
    curve = svd_curve(test, Factors(f, [1.0] * 64, f, 0), [4, 8, 16, 32, 64])
    return stats.argmin(curve, "rmse").select("k", r("rmse", "rmse"), r("mae", "mae"))


# --- ranking ---------------------------------------------------------------------------


@query("topn_rank_ties", """SELECT * FROM (SELECT user_id, item_id, rating,
    RANK() OVER (PARTITION BY user_id ORDER BY rating DESC) AS rank FROM ratings) WHERE rank <= 5""")
def topn_rank_ties(spark, sf):
    return ranking.topn(v.ratings(spark, sf), 5, "rating", ties="rank")


@query("topn_exact", """SELECT * FROM (SELECT user_id, item_id, rating,
    ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS rank FROM ratings) WHERE rank <= 5""")
def topn_exact(spark, sf):
    return ranking.topn(v.ratings(spark, sf), 5, "rating")


@query("topn_single_user", "SELECT * FROM ratings WHERE user_id = 1 ORDER BY rating DESC, item_id LIMIT 5")
def topn_single_user(spark, sf):
    return ranking.topn_single_user(v.ratings(spark, sf), 1, 5, "rating")


@query("order_by_score", """SELECT item_id, round(AVG(rating), 6) AS mean_rating FROM ratings GROUP BY item_id
    ORDER BY mean_rating DESC, item_id""")
def order_by_score(spark, sf):
    return (stats.group_mean(v.ratings(spark, sf), "item_id").select("item_id", r("mean_rating", "mean_rating"))
            .orderBy(F.col("mean_rating").desc(), "item_id"))


@query("topn_with_names", """SELECT t.*, title, genres FROM (SELECT user_id, item_id, rating,
    ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS rank FROM ratings) t
    LEFT JOIN items USING (item_id) WHERE rank <= 5""")
def topn_with_names(spark, sf):
    top = ranking.topn(v.ratings(spark, sf), 5, "rating")
    return (top.join(v.items(spark, sf), "item_id", "left")
            .select("user_id", "item_id", "rating", "rank", "title", "genres").orderBy("user_id", "rank"))


@query("head_list", """SELECT * FROM (SELECT 'user' AS side, user_id AS id, NULL AS title, NULL AS genres
      FROM (SELECT DISTINCT user_id FROM ratings) ORDER BY user_id LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'item', item_id, title, genres FROM items ORDER BY item_id LIMIT 10)""")
def head_list(spark, sf):
    users = v.ratings(spark, sf).select("user_id").distinct().orderBy("user_id").limit(10)
    items = v.items(spark, sf).orderBy("item_id").limit(10)
    none = F.lit(None).cast("string")
    return cleaning.union_all(
        users.select(F.lit("user").alias("side"), F.col("user_id").alias("id"), none.alias("title"), none.alias("genres")),
        items.select(F.lit("item").alias("side"), F.col("item_id").alias("id"), "title", "genres"))


# --- scalar functions --------------------------------------------------------------------


@query("fn_math", """SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS root,
    round(abs(l_quantity - 25), 6) AS dist, round(ln(1 + l_quantity), 6) AS log1p,
    round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem""")
def fn_math(spark, sf):
    q = F.col("l_quantity")
    return v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r(F.sqrt(q), "root"), r(F.abs(q - 25), "dist"), r(F.log1p(q), "log1p"),
        r(F.col("l_extendedprice") * (1 - F.col("l_discount")), "net", 4))


@query("fn_cast", "SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority FROM orders")
def fn_cast(spark, sf):
    return v.table(spark, sf, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"))


@query("fn_null", """SELECT user_id, item_id, rating IS NULL AS missing, COALESCE(rating, 0.0) AS filled,
    NULLIF(rating, -1) AS valid, title IS NOT NULL AND rating >= 0 AS usable FROM nullable""")
def fn_null(spark, sf):
    c = F.col("rating")
    return v.nullable(spark, sf).select(
        "user_id", "item_id", c.isNull().alias("missing"), F.coalesce(c, F.lit(0.0)).alias("filled"),
        F.nullif(c, F.lit(-1.0)).alias("valid"), (F.col("title").isNotNull() & (c >= 0)).alias("usable"))


@query("fn_text_clean", """SELECT item_id, regexp_replace(lower(title), '[^a-z0-9\\s]', '', 'g') AS title_clean,
    lower(replace(genres, '|', ' ')) AS genres_clean, trim(regexp_replace(lower(title), '[^a-z0-9\\s]', '', 'g') || ' '
    || lower(replace(genres, '|', ' '))) AS features FROM items""")
def fn_text_clean(spark, sf):
    return v.items(spark, sf).select("item_id", tx.clean_title("title").alias("title_clean"),
                                     tx.clean_genres("genres").alias("genres_clean"), tx.feature_text().alias("features"))


DOC_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}')"


@query("fn_tokenize", f"""SELECT doc_id, CAST(len({DOC_TOKENS}) AS INT) AS n_tokens,
    md5(array_to_string({DOC_TOKENS}, ' ')) AS digest FROM documents""")
def fn_tokenize(spark, sf):
    toks = tx.tokens("text")
    docs = v.spread(v.table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.size(toks).alias("n_tokens"),
                                                  F.md5(F.array_join(toks, " ")).alias("digest"))


@query("fn_explode_struct", """SELECT l_orderkey, l_linenumber, l_partkey AS item, l_quantity AS rating FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey, l_discount FROM lineitem""")
def fn_explode_struct(spark, sf):
    def pair(item, rating):
        return F.struct(F.col(item).alias("item"), F.col(rating).alias("rating"))
    nested = v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.array(pair("l_partkey", "l_quantity"), pair("l_suppkey", "l_discount")).alias("recommendations"))
    return nested.select("l_orderkey", "l_linenumber", F.explode("recommendations").alias("rec")).select(
        "l_orderkey", "l_linenumber", F.col("rec.item").alias("item"), F.col("rec.rating").alias("rating"))


JSON_VEC = "CAST(to_json(list_transform(features, lambda x: round(x, 3) + 0.0)) AS VARCHAR)"


@query("fn_to_json", f"SELECT id, {JSON_VEC} AS vector FROM factors")
def fn_to_json(spark, sf):
    return v.factors(spark, sf).select("id", as_json("features").alias("vector"))


@query("fn_cosine", """SELECT a.id, round(list_dot_product(a.features, b.features), 6) AS dot,
    round(list_cosine_similarity(a.features, b.features), 6) AS cosine FROM factors a JOIN factors b ON b.id = a.id + 1""")
def fn_cosine(spark, sf):
    f = v.factors(spark, sf)
    nxt = f.select((F.col("id") - 1).alias("id"), F.col("features").alias("other"))
    return f.join(nxt, "id").select("id", r(dot("features", "other"), "dot"), r(cosine("features", "other"), "cosine"))
