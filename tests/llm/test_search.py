"""Ranked search against a plain loop over all documents and items."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.llm import lexical_search, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(x for _, c in held for x in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10 ** 9 * c[x] // (1000 * c[x] + 12 * m))
                        for x in terms(text) if x in c)
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(rows, key=lambda r: r[:3])[:k], 1)]
    return Counter(out)


def got(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def rows_of(spark, name, key):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(key, "text").collect()]


def test_query_on_whole_table(spark):
    want = plain(rows_of(spark, "documents", "doc_id"), rows_of(spark, "benchmark", "item_id"))
    assert got(queries.op13_lexical_search(spark, SF)) == want and want


def test_odd_rows(spark, odd_rows, odd_docs):
    items = [(1, "One TWO two"), (2, None), (3, ""), (None, "changed É été"), (4, "a ab ab"), (5, "--- ..."), (4, "same id"),
             (4, "same id"), (6, "漢字 👍🏽 x²½"), (7, " ".join(t for _, t in odd_rows[:6] if t)), (2 ** 62, "line apache 2 0")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("item", "doc_id", "rank", "terms", "n")})
    docs = odd_docs.withColumns({c: F.lit(1) for c in ("codes", "tf", "item", "score", "rank")})
    for k in (1, 3, 20):
        assert got(lexical_search.search(docs, table, k)) == plain(odd_rows, items, k)


def test_no_rows(spark, no_docs, odd_docs):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    for docs, some in ((no_docs, items), (odd_docs, items.limit(0)), (no_docs, items.limit(0))):
        out = lexical_search.search(docs, some)
        assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("k", [5, 20])
def test_ties_groups_and_tiles(spark, monkeypatch, k):
    """Many equal scores, several groups of items, several tiles of items and of their vocabulary."""
    monkeypatch.setattr(lexical_search, "GROUP_TERMS", 150)
    monkeypatch.setattr(lexical_search, "TILE_ITEMS", 5)
    monkeypatch.setattr(lexical_search, "TILE_TERMS", 7)
    monkeypatch.setattr(lexical_search, "TILE_CELLS", 100)
    rng = random.Random(2)
    docs = [(rng.randrange(10 ** 6), " ".join(f"w{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(rng.choice([0, 1, 2, 2, 2, 40]))))
            for _ in range(700)]
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(12)))) for i in range(40)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    out = lexical_search.search(table, spark.createDataFrame(items, "item_id long, text string"), k)
    assert got(out) == plain(docs, items, k)


def test_partial_sums_stay_exact():
    rng = np.random.default_rng(3)
    weight = rng.integers(1, 30_000, 400).astype(float)
    items = [(i, np.sort(rng.choice(400, 300, replace=False)), rng.integers(1, 9, 300).astype(float)) for i in range(9)]
    for most in (1 << 53, 1 << 40):
        for tile in lexical_search.tiles(items, weight, most):
            assert all((w.sum(axis=0) * lexical_search.IMPACT < most).all() for _, w in tile.parts)
            assert sum(w.sum() for _, w in tile.parts) == sum((weight[c] * n).sum() for _, c, n in items)
    with pytest.raises(ValueError):
        lexical_search.tiles([(0, np.array([0]), np.array([1e12]))], weight)
