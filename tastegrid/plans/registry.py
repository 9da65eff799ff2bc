"""Named queries over the given tables, each with the SQL that states the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.functions.text import default_stop_words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return fn
    return add


def r(c: Column | str, name: str, digits: int = 6) -> Column:
    """Rounded output column; adding zero turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, digits) + F.lit(0.0)).alias(name)


def _stop_values() -> str:
    words = sorted({w.strip() for w in default_stop_words() if w.strip()})
    return ", ".join("('" + w.replace("'", "''") + "')" for w in words)


# Views the SQL texts may name; only those a text uses are put in front of it.
VIEWS: dict[str, str] = {
    "lines": """SELECT o_custkey AS user_id, l_partkey AS item_id,
        CAST(CEIL(l_quantity / 10.0) AS INT) AS rating, o_orderpriority
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "ratings": "SELECT user_id, item_id, MAX(rating) AS rating FROM lines GROUP BY user_id, item_id",
    "train": "SELECT * FROM ratings WHERE (user_id*31 + item_id*17) % 10 < 8",
    "test": "SELECT * FROM ratings WHERE (user_id*31 + item_id*17) % 10 >= 8",
    "items": "SELECT p_partkey AS item_id, p_name AS title, p_type || '|' || p_brand AS genres FROM part",
    "factors": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS features FROM embeddings",
    # every user and item has a given vector: that of its id modulo their number
    "vectors_of_all": """SELECT i.id, CAST(e.embedding AS DOUBLE[]) AS features
        FROM (SELECT c_custkey AS id FROM customer UNION SELECT p_partkey FROM part) i
        JOIN embeddings e ON e.vec_id = i.id % (SELECT COUNT(*) FROM embeddings)""",
    "units": """SELECT id AS item_id, list_transform(features, lambda x: x / sqrt(list_dot_product(features, features))) AS v
        FROM vectors_of_all""",
    "wide": "SELECT user_id, " + ", ".join(
        f"MAX(CASE WHEN o_orderpriority = '{p}' THEN CAST(rating AS DOUBLE) END) AS p{i}"
        for i, p in enumerate(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], 1))
        + " FROM lines GROUP BY user_id",
    "cells": " UNION ALL ".join(
        f"SELECT user_id, CAST({i} AS INT) AS item_id, p{i} AS rating FROM wide" for i in range(1, 6)),
    "nullable": """SELECT user_id, item_id, CAST(CASE WHEN item_id % 11 = 0 THEN NULL WHEN item_id % 13 = 0 THEN -1
        ELSE rating END AS DOUBLE) AS rating, CASE WHEN item_id % 17 <> 0 THEN title END AS title, genres
        FROM ratings LEFT JOIN items USING (item_id)""",
    "lists": """SELECT user_id, item_id, rn AS rank FROM (SELECT user_id, item_id, ROW_NUMBER() OVER
        (PARTITION BY user_id ORDER BY rating DESC, item_id) AS rn FROM ratings) WHERE rn <= 5""",
    "liked": "SELECT user_id, item_id, rating FROM ratings WHERE rating >= 4",
    "stop_words": f"SELECT word FROM (VALUES {_stop_values()}) t(word)",
    "texts": """SELECT item_id, title, genres, trim(regexp_replace(lower(COALESCE(title, '')), '[^a-z0-9\\s]', '', 'g')
        || ' ' || lower(replace(COALESCE(genres, ''), '|', ' '))) AS features FROM items""",
    "tokens": """SELECT item_id, unnest(regexp_extract_all(features, '[a-z0-9_]{2,}')) AS token FROM texts""",
    "counts": "SELECT item_id, token, COUNT(*) AS tf FROM tokens GROUP BY item_id, token",
    "raw_weights": """SELECT c.item_id, c.token, tf * (ln((1.0 + (SELECT COUNT(*) FROM texts)) / (1 + df)) + 1) AS raw
        FROM counts c JOIN (SELECT token, COUNT(*) AS df FROM counts GROUP BY token) USING (token)
        WHERE token NOT IN (SELECT word FROM stop_words)""",
    "weights": """SELECT item_id, token, raw / sqrt(SUM(raw * raw) OVER (PARTITION BY item_id)) AS weight
        FROM raw_weights""",
    "profile": """SELECT user_id, token, SUM(weight) / MAX(n_liked) AS weight
        FROM liked JOIN weights USING (item_id)
        JOIN (SELECT user_id, COUNT(*) AS n_liked FROM liked JOIN items USING (item_id) GROUP BY user_id) USING (user_id)
        GROUP BY user_id, token""",
    "cf_all": """SELECT u.id AS user_id, v.id AS item_id, round(list_dot_product(u.features, v.features), 8) AS score
        FROM vectors_of_all u CROSS JOIN vectors_of_all v WHERE u.id IN (SELECT user_id FROM ratings)
        AND v.id IN (SELECT item_id FROM items)""",
    "cf_unseen": """SELECT * FROM cf_all ANTI JOIN ratings USING (user_id, item_id)""",
    "cf_top": """SELECT user_id, item_id, score, rn AS rank FROM (SELECT *, ROW_NUMBER() OVER
        (PARTITION BY user_id ORDER BY score DESC, item_id) AS rn FROM cf_unseen) WHERE rn <= 5""",
    "cand_scores": """SELECT u.user_id, i.item_id, COALESCE(c.score, 0.0) AS cf_score, COALESCE(t.content, 0.0) AS content_score
        FROM (SELECT DISTINCT user_id FROM ratings) u CROSS JOIN items i ANTI JOIN ratings x ON x.user_id = u.user_id AND x.item_id = i.item_id
        LEFT JOIN (SELECT u.id AS user_id, v.id AS item_id, list_dot_product(u.features, v.features) AS score FROM factors u CROSS JOIN factors v) c
          ON c.user_id = u.user_id AND c.item_id = i.item_id
        LEFT JOIN (SELECT p.user_id, w.item_id, SUM(w.weight * p.weight) AS content FROM profile p JOIN weights w USING (token)
          GROUP BY p.user_id, w.item_id) t ON t.user_id = u.user_id AND t.item_id = i.item_id""",
    "hybrid": """SELECT user_id, item_id, alpha, round(cf_score, 8) + 0.0 AS cf_score, content_score, hybrid_score,
        ROW_NUMBER() OVER (PARTITION BY user_id, alpha ORDER BY hybrid_score DESC, item_id) AS rank
        FROM (SELECT user_id, item_id, CAST(alpha AS DOUBLE) AS alpha, cf_score, content_score,
          round(alpha * content_score + (1 - alpha) * cf_score, 8) + 0.0 AS hybrid_score
          FROM cand_scores CROSS JOIN (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) a(alpha))""",
    "user_sim": """SELECT a.user_id AS a, b.user_id AS b, COUNT(*) AS common,
        round(SUM(a.rating*b.rating) / sqrt(CAST(SUM(a.rating*a.rating) AS DOUBLE) * SUM(b.rating*b.rating)), 8) AS sim
        FROM train a JOIN train b ON a.item_id = b.item_id AND a.user_id < b.user_id
        GROUP BY a.user_id, b.user_id HAVING COUNT(*) >= 2""",
    "item_sim": """SELECT a.item_id AS a, b.item_id AS b, COUNT(*) AS common,
        round(SUM(a.rating*b.rating) / sqrt(CAST(SUM(a.rating*a.rating) AS DOUBLE) * SUM(b.rating*b.rating)), 8) AS sim
        FROM train a JOIN train b ON a.user_id = b.user_id AND a.item_id < b.item_id
        GROUP BY a.item_id, b.item_id HAVING COUNT(*) >= 2""",
    "near_user": "SELECT a AS u, b AS v, sim FROM user_sim UNION ALL SELECT b, a, sim FROM user_sim",
    "near_item": "SELECT a AS i, b AS j, sim FROM item_sim UNION ALL SELECT b, a, sim FROM item_sim",
    "user_mean": "SELECT user_id, AVG(rating) AS m FROM train GROUP BY user_id",
    "item_mean": "SELECT item_id, AVG(rating) AS m FROM train GROUP BY item_id",
    "mu": "SELECT AVG(rating) AS mu FROM train",
    "votes_user": """SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, item_id ORDER BY sim DESC, v) AS rn FROM (
        SELECT t.user_id, t.item_id, n.v, n.sim, r.rating, r.rating - m.m AS centered FROM test t
        JOIN train r ON r.item_id = t.item_id JOIN near_user n ON n.u = t.user_id AND n.v = r.user_id
        JOIN user_mean m ON m.user_id = r.user_id WHERE n.sim > 0)""",
    "votes_item": """SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, item_id ORDER BY sim DESC, j) AS rn FROM (
        SELECT t.user_id, t.item_id, n.j, n.sim, r.rating - m.m AS centered FROM test t
        JOIN train r ON r.user_id = t.user_id JOIN near_item n ON n.i = t.item_id AND n.j = r.item_id
        JOIN item_mean m ON m.item_id = r.item_id WHERE n.sim > 0)""",
    "knn_basic": """SELECT t.user_id, t.item_id, t.rating, greatest(1, least(5, COALESCE(e, mu))) AS est,
        COALESCE(k, 0) AS neighbours FROM test t CROSS JOIN mu LEFT JOIN (SELECT user_id, item_id,
        SUM(sim*rating)/SUM(sim) AS e, COUNT(*) AS k FROM votes_user WHERE rn <= 40 GROUP BY user_id, item_id)
        USING (user_id, item_id)""",
    "knn_user": """SELECT t.user_id, t.item_id, t.rating, COALESCE(k, 0) AS neighbours,
        greatest(1, least(5, CASE WHEN um.m IS NULL OR im.m IS NULL THEN mu ELSE um.m + COALESCE(e, 0) END)) AS est
        FROM test t CROSS JOIN mu LEFT JOIN user_mean um ON um.user_id = t.user_id
        LEFT JOIN item_mean im ON im.item_id = t.item_id LEFT JOIN (SELECT user_id, item_id,
        SUM(sim*centered)/SUM(sim) AS e, COUNT(*) AS k FROM votes_user WHERE rn <= 40 GROUP BY user_id, item_id) v
        ON v.user_id = t.user_id AND v.item_id = t.item_id""",
    "knn_item": """SELECT t.user_id, t.item_id, t.rating, COALESCE(k, 0) AS neighbours,
        greatest(1, least(5, CASE WHEN um.m IS NULL OR im.m IS NULL THEN mu ELSE im.m + COALESCE(e, 0) END)) AS est
        FROM test t CROSS JOIN mu LEFT JOIN user_mean um ON um.user_id = t.user_id
        LEFT JOIN item_mean im ON im.item_id = t.item_id LEFT JOIN (SELECT user_id, item_id,
        SUM(sim*centered)/SUM(sim) AS e, COUNT(*) AS k FROM votes_item WHERE rn <= 40 GROUP BY user_id, item_id) v
        ON v.user_id = t.user_id AND v.item_id = t.item_id""",
    "base_est": """SELECT s.part, s.user_id, s.item_id, s.rating, mu + (um.m - mu) + (im.m - mu) AS est
        FROM (SELECT 'train' AS part, * FROM train UNION ALL SELECT 'test', * FROM test) s CROSS JOIN mu
        LEFT JOIN user_mean um ON um.user_id = s.user_id LEFT JOIN item_mean im ON im.item_id = s.item_id""",
    "cell_part": """SELECT *, CASE WHEN rating IS NULL THEN 'unknown' WHEN (user_id*31 + item_id*17) % 10 < 8
        THEN 'train' ELSE 'test' END AS part FROM cells""",
    "cell_est": """SELECT c.*, mu + (um.m - mu) + (im.m - mu) AS est FROM cell_part c
        CROSS JOIN (SELECT AVG(rating) AS mu FROM cell_part WHERE part = 'train')
        LEFT JOIN (SELECT user_id, AVG(rating) AS m FROM cell_part WHERE part = 'train' GROUP BY user_id) um
          ON um.user_id = c.user_id
        LEFT JOIN (SELECT item_id, AVG(rating) AS m FROM cell_part WHERE part = 'train' GROUP BY item_id) im
          ON im.item_id = c.item_id""",
    "popular": """SELECT item_id, n, n * 1.0 / MAX(n) OVER () AS popularity,
        ln(1.0 + n) / ln(1.0 + MAX(n) OVER ()) AS popularity_log
        FROM (SELECT item_id, COUNT(*) AS n FROM ratings GROUP BY item_id)""",
    "adjusted": """SELECT f.user_id, f.item_id, round(0.5 * list_dot_product(u.features, v.features)
          + 0.4 * (1 - COALESCE(l.cos, 0)) + 0.1 * (1 - COALESCE(t.cos, 0)), 8) AS adjusted_score
        FROM cf_unseen f JOIN vectors_of_all u ON u.id = f.user_id JOIN vectors_of_all v ON v.id = f.item_id
        LEFT JOIN liked_cos l ON l.user_id = f.user_id AND l.item_id = f.item_id
        LEFT JOIN list_cos t ON t.user_id = f.user_id AND t.item_id = f.item_id""",
    "liked_cos": """SELECT f.user_id, f.item_id, AVG(list_dot_product(a.v, b.v)) AS cos FROM cf_unseen f
        JOIN liked l ON l.user_id = f.user_id JOIN units a ON a.item_id = f.item_id
        JOIN units b ON b.item_id = l.item_id GROUP BY f.user_id, f.item_id""",
    "list_cos": """SELECT f.user_id, f.item_id, AVG(list_dot_product(a.v, b.v)) AS cos FROM cf_unseen f
        JOIN cf_top l ON l.user_id = f.user_id JOIN units a ON a.item_id = f.item_id
        JOIN units b ON b.item_id = l.item_id GROUP BY f.user_id, f.item_id""",
    "reranked": """SELECT user_id, item_id, adjusted_score, rn AS rank FROM (SELECT *, ROW_NUMBER() OVER
        (PARTITION BY user_id ORDER BY adjusted_score DESC, item_id) AS rn FROM adjusted) WHERE rn <= 5""",
}


def with_views(sql: str) -> str:
    """Put the views a text names, and those they name in turn, in front of it."""
    own = set(re.findall(r"^\s*(?:WITH\s+)?(\w+) AS \(", sql))
    need: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in need and name not in own and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(VIEWS[name])
                need.append(name)
    visit(sql)
    need = list(dict.fromkeys(need))
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in need)
    body = sql.strip()
    if body.startswith("WITH "):
        return f"WITH {head},\n{body[5:]}" if head else body
    return f"WITH {head}\n{body}" if head else body
