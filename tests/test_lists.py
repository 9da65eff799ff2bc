"""List quality, re-ranking, content and hybrid scores on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.operators import content, hybrid, quality, stats

# unit vectors at 0, 60, 90 and 180 degrees
ANGLES = {1: 0, 2: 60, 3: 90, 4: 180}


@pytest.fixture(scope="module")
def vecs(spark):
    return spark.createDataFrame([(i, [2 * math.cos(math.radians(d)), 2 * math.sin(math.radians(d))]) for i, d in ANGLES.items()],
                                 "id long, features array<double>")


def pairs(spark, rows):
    return spark.createDataFrame(rows, "user_id long, item_id long")


def cos(a, b):
    return math.cos(math.radians(ANGLES[a] - ANGLES[b]))


def test_diversity_and_serendipity(spark, vecs):
    lists = pairs(spark, [(1, 1), (1, 2), (1, 3), (2, 4)])
    liked = pairs(spark, [(1, 4), (1, 2)])
    d = {r["user_id"]: r["diversity"] for r in quality.diversity(lists, vecs).collect()}
    assert abs(d[1] - (1 - (cos(1, 2) + cos(1, 3) + cos(2, 3)) / 3)) < 1e-12 and d[2] == 1.0
    s = {r["user_id"]: r["serendipity"] for r in quality.serendipity(lists, liked, vecs).collect()}
    want = np.mean([1 - cos(a, b) for a in (1, 2, 3) for b in (4, 2)])
    assert abs(s[1] - want) < 1e-12 and s[2] is None


def test_item_scores(spark, vecs):
    cands = pairs(spark, [(1, 1), (1, 3), (1, 99), (2, 1)])
    lists, liked = pairs(spark, [(1, 1), (1, 2)]), pairs(spark, [(1, 4), (1, 3)])
    s = {(r["user_id"], r["item_id"]): r["serendipity"] for r in quality.item_serendipity(cands, liked, vecs).collect()}
    assert abs(s[1, 1] - np.mean([1 - cos(1, 4), 1 - cos(1, 3)])) < 1e-12
    assert s[1, 99] == 1.0 and s[2, 1] == 1.0  # no vector, no liked item
    for own, want in ((False, np.mean([0, 1 - cos(1, 2)])), (True, 1 - cos(1, 2))):
        d = {(r["user_id"], r["item_id"]): r["diversity"] for r in quality.item_diversity(cands, lists, vecs, own).collect()}
        assert abs(d[1, 1] - want) < 1e-12 and d[2, 1] == 1.0
        assert abs(d[1, 3] - np.mean([1 - cos(3, 1), 1 - cos(3, 2)])) < 1e-12


def test_novelty_counts_only_known_items(spark):
    pop = spark.createDataFrame([(1, 0.5), (2, 0.1), (3, 1.0)], "item_id long, popularity double")
    row = quality.novelty(pairs(spark, [(1, 1), (1, 2), (1, 77)]), pop).first()
    assert abs(row["novelty"] - 0.7) < 1e-12 and row["matched"] == 2


def test_rerank_all_equals_scoring_every_pair(spark):
    rng = np.random.default_rng(3)
    uf = spark.createDataFrame([(u, [float(x) for x in rng.normal(size=4)]) for u in range(5)], "id long, features array<double>")
    vf = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(30)], "id long, features array<double>")
    lists = pairs(spark, [(u, i) for u in range(4) for i in range(u, u + 3)])
    liked = pairs(spark, [(u, i) for u in range(3) for i in range(10, 14)])
    seen = pairs(spark, [(u, i) for u in range(5) for i in range(10, 15)])
    got = quality.rerank_all(uf, vf, lists, liked, seen, n=6).select("user_id", "item_id", "rank")
    every = pairs(spark, [(u, i) for u in range(5) for i in range(30) if not 10 <= i < 15])
    from tastegrid.operators.als import dot_predict
    scored = quality.item_diversity(quality.item_serendipity(dot_predict(every, uf, vf), liked, vf), lists, vf)
    want = quality.rerank(scored, n=6).select("user_id", "item_id", "rank")
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(
        [(1, "The Red Ring!", "Drama|Sci-Fi"), (2, "blue ring", "Drama"), (3, None, "Comedy"), (4, "x", None), (1, "zzz", "other")],
        "item_id long, title string, genres string")


def test_tfidf_by_hand(spark, catalog):
    texts = content.item_text(catalog)
    assert {r["item_id"]: r["features"] for r in texts.collect()} == {
        1: "the red ring drama sci-fi", 2: "blue ring drama", 3: "comedy", 4: "x"}
    w = {(r["item_id"], r["token"]): r["weight"] for r in content.term_weights(texts).collect()}
    assert (1, "the") not in w and (4, "x") not in w
    rare, shared = math.log(5 / 2) + 1, math.log(5 / 3) + 1
    assert abs(w[2, "ring"] - shared / math.sqrt(rare**2 + 2 * shared**2)) < 1e-12
    assert abs(w[3, "comedy"] - 1) < 1e-12
    counts = content.term_weights(texts, "count")
    assert counts.filter("token = 'the'").count() == 1


def test_content_scores_and_lists(spark, catalog):
    texts = content.item_text(catalog)
    items = texts.select("item_id")
    w = content.term_weights(texts)
    liked = pairs(spark, [(1, 2), (1, 3), (1, 500)])  # item 500 has no metadata
    profile = content.user_profile(liked, w, items)
    weights = {(r["item_id"], r["token"]): r["weight"] for r in w.collect()}
    sim = sum(weights[1, t] * weights[2, t] for t in ("ring", "drama"))
    scores = content.content_score(pairs(spark, [(1, 1), (1, 4), (2, 1)]), profile, w)
    got = {(r["user_id"], r["item_id"]): r["content_score"] for r in scores.collect()}
    assert abs(got[1, 1] - sim / 2) < 1e-12 and got[1, 4] == 0.0 and got[2, 1] == 0.0
    users = spark.createDataFrame([(1,), (2,)], "user_id long")  # user 2 has liked nothing
    top = content.content_topn(users, liked, w, items, n=3)
    order = {u: [r["item_id"] for r in top.filter(F.col("user_id") == u).orderBy("rank").collect()] for u in (1, 2)}
    assert order == {1: [1, 4], 2: [1, 2, 3]}
    best = content.similar_items(w, items, 1)
    assert {r["item_id"]: r["other_id"] for r in best.collect()} == {1: 2, 2: 1, 3: 1, 4: 1}


def test_alpha_zero_and_one_give_the_two_orders(spark, catalog):
    texts = content.item_text(catalog)
    w = content.term_weights(texts)
    profile = content.user_profile(pairs(spark, [(1, 2)]), w, texts)
    mine = spark.createDataFrame([(1, [1.0])], "id long, features array<double>")
    theirs = spark.createDataFrame([(1, [0.1]), (2, [9.0]), (3, [0.9]), (4, [0.5])], "id long, features array<double>")
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    top = hybrid.hybrid(mine, theirs, profile, w, users, texts, pairs(spark, [(1, 2)]), (0.0, 1.0), n=3)
    order = {(u, a): [r["item_id"] for r in top.filter((F.col("alpha") == a) & (F.col("user_id") == u)).orderBy("rank").collect()]
             for a in (0.0, 1.0) for u in (1, 2)}
    assert order[1, 0.0] == [3, 4, 1] and order[1, 1.0] == [1, 3, 4]
    assert order[2, 0.0] == [1, 2, 3]  # no vector, nothing liked: the lowest ids


def test_blends_of_several_blocks_equal_brute_force(spark):
    """Every alpha's lists from one pass: ties go to the lower id, pairs left out stay out, no keys or no vector count 0."""
    from tastegrid.operators import blocks
    rng = np.random.default_rng(8)
    words_l, words_r = (rng.integers(0, 3, (m, 12)) * (rng.random((m, 12)) < 0.3) for m in (50, 70))
    vec_l, vec_r = rng.integers(-2, 3, (50, 4)).astype(float), rng.integers(-2, 3, (70, 4)).astype(float)
    vec_l[:5], vec_r[60:] = 0.0, 0.0

    def entries(words, name):
        at = np.argwhere(words)
        return spark.createDataFrame([(int(i), int(k), float(words[i, k])) for i, k in at], f"{name} long, key long, w double")

    def side(vec, name):
        return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], f"{name} long, vec array<double>")
    gone = {(int(l), int(r)) for l, r in rng.integers(0, 50, (300, 2))}
    alphas = (0.0, 0.3, 0.5, 1.0)
    top = blocks.blend_topn(entries(words_l, "l"), entries(words_r, "r"), side(vec_l, "l"), side(vec_r, "r"), 4, alphas,
                            exclude=spark.createDataFrame(sorted(gone), "l long, r long"), size=16).collect()
    got = {(x.l, x.a, x["rank"]): (x.r, x.score) for x in top}
    for k, a in enumerate(alphas):
        score = np.round(a * (words_l @ words_r.T) + (1 - a) * (vec_l @ vec_r.T), 8)
        for l in range(50):
            best = sorted((-score[l, r], r) for r in range(70) if (l, r) not in gone)[:4]
            assert [got[l, k, i + 1] for i in range(4)] == [(r, -s) for s, r in best]
    assert len(got) == 50 * 4 * 4


def test_user_who_rated_the_best_hundred_still_gets_a_list(spark):
    mine = spark.createDataFrame([(1, [1.0])], "id long, features array<double>")
    theirs = spark.createDataFrame([(i, [float(200 - i)]) for i in range(120)], "id long, features array<double>")
    items = theirs.select(F.col("id").alias("item_id"))
    none = spark.createDataFrame([], "user_id long, token string, weight double")
    words = spark.createDataFrame([(0, "x", 1.0)], "item_id long, token string, weight double")
    top = hybrid.hybrid(mine, theirs, none, words, mine.select(F.col("id").alias("user_id")), items,
                        pairs(spark, [(1, i) for i in range(100)]), n=5)
    assert [r["item_id"] for r in top.orderBy("rank").collect()] == [100, 101, 102, 103, 104]


def test_block_pairs_meet_without_a_shuffle_per_pair(spark):
    """Blocks of both sides meet in a Cartesian product; repeated and negative ids and several tasks keep the lists of brute force."""
    from tastegrid.operators import blocks
    rng = np.random.default_rng(3)
    words_l, words_r = (rng.integers(1, 4, (m, 30)) * (rng.random((m, 30)) < 0.2) for m in (300, 500))

    def entries(words, name):
        return spark.createDataFrame([(int(i) - 200, int(k), float(words[i, k])) for i, k in np.argwhere(words)], f"{name} long, key long, w double")

    def ids(m, name):
        return spark.createDataFrame([(i - 200,) for i in range(m)], f"{name} long")
    gone = {(int(l) - 200, int(r) - 200) for l, r in rng.integers(0, 300, (2000, 2))}
    top = blocks.sparse_topn(entries(words_l, "l"), entries(words_r, "r"), ids(300, "l"), ids(500, "r"), 3,
                             exclude=spark.createDataFrame(sorted(gone), "l long, r long"), size=20)
    assert "CartesianProduct" in top._jdf.queryExecution().toString()
    got = {(x.l, x["rank"]): (x.r, x.score) for x in top.collect()}
    score = words_l @ words_r.T
    for l in range(300):
        best = sorted((-score[l, r], r - 200) for r in range(500) if (l - 200, r - 200) not in gone)[:3]
        assert [got[l - 200, i + 1] for i in range(3)] == [(r, -s) for s, r in best]
    assert len(got) == 900


def test_list_quality_sends_one_row_per_vector(spark):
    """Means of unit vectors without a row per position; float vectors, a zero vector, a null one and a user without any."""
    from tastegrid.operators import quality
    given = {1: [3.0, 4.0], 2: [0.0, 2.0], 3: [0.0, 0.0], 4: None, 5: [1.0, 0.0]}
    vecs = spark.createDataFrame(list(given.items()), "id long, features array<float>")
    lists = pairs(spark, [(1, 1), (1, 2), (2, 5), (3, 4), (4, 1), (4, 3)])
    liked = pairs(spark, [(1, 5), (1, 4), (2, 1), (2, 2)])
    made = quality.diversity(lists, vecs)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    assert {x.user_id: round(x.diversity, 9) for x in made.collect()} == {1: 0.2, 2: 1.0, 4: 1.5}
    got = {x.user_id: x.serendipity for x in quality.serendipity(lists, liked, vecs).collect()}
    assert {u: s if s is None else round(s, 9) for u, s in got.items()} == {1: 0.7, 2: 0.7, 4: None}
    got = {(x.user_id, x.item_id): round(x.serendipity, 9) for x in quality.item_serendipity(lists, liked, vecs).collect()}
    assert got == {(1, 1): 0.4, (1, 2): 1.0, (2, 5): 0.7, (3, 4): 1.0, (4, 1): 1.0, (4, 3): 1.0}


def test_long_masks_are_not_widened(monkeypatch):
    """A vector row beside 500 long mask rows: the parts stay small."""
    import pyarrow as pa

    from tastegrid.operators import blocks
    n = 500
    batch = pa.RecordBatch.from_pydict({
        "at": pa.array([0] + [1] * n, pa.int64()), "kind": pa.array([0] + [2] * n, pa.int32()), "key": pa.array([-1] + list(range(n)), pa.int64()),
        "slots": pa.array([[0]] + [list(range(2_000))] * n, pa.list_(pa.int32())), "ids": pa.array([[0]] + [[0] * 2_000] * n, pa.list_(pa.int64())),
        "ws": pa.array([[0.0]] + [[0.0] * 2_000] * n, pa.list_(pa.float64())), "vec": pa.array([[1.0] * 128] + [None] * n, pa.list_(pa.float64()))})
    sizes = [sum(c.nbytes for c in part.values()) for part in blocks._unpack(batch)]
    assert max(sizes) < 50 << 20


def test_prompt_text(spark, catalog, vecs):
    items = content.item_text(catalog)
    recs = spark.createDataFrame([(1, 2, 1, 0.25, 0.5), (1, 3, 2, 0.0, 0.5)], "user_id long, item_id long, rank long, content_score double, alpha double")
    liked = spark.createDataFrame([(1, 1, 5), (1, 4, 4)], "user_id long, item_id long, rating int")
    vectors = hybrid.latent_vectors_json(recs, vecs, vecs)
    assert vectors.first()["user_vector"] == "[2.0,0.0]"
    assert vectors.first()["item_vectors"] == '{"2":[1.0,1.732],"3":[0.0,2.0]}'
    text = hybrid.explain_prompts(recs, liked, vectors, items).first()["prompt"]
    assert "- blue ring (Drama) 0.250\n-  (Comedy) 0.000" in text
    assert text.index("The Red Ring! (Drama|Sci-Fi)") < text.index("- x ()")
    assert "content * 0.5 + collaborative * 0.5" in text
    assert "0.250" not in hybrid.explain_prompts(recs, liked, vectors, items, include_content=False).first()["prompt"]


def test_report_has_one_row_per_metric(spark):
    one = spark.createDataFrame([(1.0, 2.0)], "rmse double, mae double")
    assert stats.model_report({"a": one, "b": one}).count() == 4


def test_texts_are_counted_where_they_are_read(spark):
    """No shuffle of words where ids differ; texts of one id, and those of a null id, are counted together as before."""
    def shuffled(df):
        return "Exchange" in df._jdf.queryExecution().executedPlan().toString()
    alone = spark.createDataFrame([(1, "red fish red"), (2, "fish"), (3, None), (4, "")], "item_id long, features string")
    got = content.term_counts(alone)
    assert not shuffled(got)
    assert {tuple(r) for r in got.collect()} == {(1, "red", 2), (1, "fish", 1), (2, "fish", 1)}
    again = alone.union(spark.createDataFrame([(1, "Red sky"), (None, "sky red"), (None, "red")], "item_id long, features string")).repartition(3)
    rows = [tuple(r) for r in content.term_counts(again).collect()]
    assert sorted(rows, key=str) == sorted([(1, "red", 3), (1, "fish", 1), (1, "sky", 1), (2, "fish", 1), (None, "red", 2), (None, "sky", 1)], key=str)
    weights = content.term_weights(again, stop_words=[])
    idf = {w: math.log(8 / (1 + d)) + 1 for w, d in (("red", 2), ("fish", 2), ("sky", 2))}
    length = math.sqrt((3 * idf["red"]) ** 2 + idf["fish"] ** 2 + idf["sky"] ** 2)
    got = {(r.item_id, r.token): r.weight for r in weights.collect()}
    want = {(1, "red"): 3 * idf["red"] / length, (1, "fish"): idf["fish"] / length, (1, "sky"): idf["sky"] / length, (2, "fish"): 1.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert weights._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # lengths are not joined back
