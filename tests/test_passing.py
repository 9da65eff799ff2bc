"""Products of pairs of ids against brute force, and what they shuffle."""

import numpy as np
from pyspark.sql import functions as F

from tastegrid.operators import passing, quality


def shuffled(spark):
    return sum(e.totalShuffleWrite() for e in _list(spark._jsc.sc().statusStore().executorList(False)))


def _list(seq):
    return [seq.apply(k) for k in range(seq.size())]


def test_item_scores_send_no_vector_per_pair(spark):
    rng = np.random.default_rng(3)
    users, items = 300, 100
    v = rng.normal(size=(items, 64)).astype(np.float32)
    vecs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, features array<float>")
    cands = spark.createDataFrame([(u, i, 1.0) for u in range(users) for i in range(items)], "user_id long, item_id int, rating double")
    lists = spark.createDataFrame([(u, (7 * u + 11 * k) % items) for u in range(users) for k in range(4)], "user_id long, item_id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = {(r.user_id, r.item_id): r.diversity for r in quality.item_diversity(cands, lists, vecs, True).collect()}
        assert shuffled(spark) - before < users * items * 64 * 4 / 2  # half of a vector per pair
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    assert len(got) == users * items
    for u in (0, 17, 299):
        own = [(7 * u + 11 * k) % items for k in range(4)]
        for i in range(items):
            others = [j for j in own if j != i]
            assert abs(got[u, i] - (1 - np.mean([unit[i] @ unit[j] for j in others]))) < 1e-9


def test_nulls_lengths_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(passing, "RIGHTS", 2)
    monkeypatch.setattr(passing, "PAIRS", 3)
    pairs = spark.createDataFrame([("a", 1, 0), ("a", 1, 0), ("a", 2, 1), ("b", 3, 2), ("b", 4, 3), (None, 1, 4), ("a", None, 5), ("z", 1, 6), ("b", 9, 7), ("a", 5, 8)],
                                  "u string, i int, k int")
    lefts = spark.createDataFrame([("a", [1.0, 0.0], 2), ("b", [0.0, None], 1), (None, [1.0, 0.0], 9)], "id string, vec array<double>, n long")
    rights = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 1.0]), (4, [1.0]), (5, [1.0, None]), (None, [1.0, 0.0])], "id long, features array<float>")

    def rows(df):
        return sorted((r.k, None if r["_cos"] is None else round(r["_cos"], 6), r["_n"]) for r in df.collect())
    want = [(0, 0.6, 2), (0, 0.6, 2), (1, 0.0, 2), (1, 1.0, 2), (2, None, 1), (3, None, 1), (4, None, None), (5, None, 2), (6, None, None), (7, None, 1), (8, None, 2)]
    assert rows(passing.unit_products(pairs, lefts, rights, "u", "i")) == want
    none = passing.unit_products(pairs, lefts, rights.limit(0), "u", "i").collect()
    assert len(none) == 10 and all(r["_cos"] is None for r in none)
    assert passing.unit_products(pairs.limit(0), lefts, rights, "u", "i").collect() == []


def test_a_row_is_given_once_per_task(spark):
    sent = spark.createDataFrame([(k, f"s{k}") for k in range(5)], "a int, x string").coalesce(1)
    held = spark.createDataFrame([(k, f"h{k}") for k in range(7)], "b int, y string").repartition(3)
    got = passing.crossed(sent, held, ("a", "b")).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for a in range(5) for b in range(7)} and len(got) == 35
    tasks = len({r.task for r in got})
    assert sorted(r.y for r in got if r.y) == [f"h{k}" for k in range(7)]
    assert sorted(r.x for r in got if r.x) == sorted(tasks * [f"s{k}" for k in range(5)])
    for r in got:
        assert (r.x is not None) == (r["_h"] == 0) and (r.y is not None) == (r["_s"] == 0)


def test_blocks_cross_to_python_once(spark):
    """Both packed sides of a product reach a task once, not once per pair of blocks."""
    from tastegrid.operators import blocks
    rng = np.random.default_rng(0)
    lefts = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rng.normal(size=(400, 8)))], "l long, vec array<double>")
    rights = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rng.normal(size=(400, 8)))], "r long, vec array<double>")
    plan = blocks.dense_topn(lefts, rights, 3, size=32)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN (_s" in plan and "CASE WHEN (_h" in plan
