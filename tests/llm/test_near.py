"""Min-max hashing against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.llm import minmax_hash, queries

SF = "/root/testdata/sf0.001"


def shingles(t, width=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    if len(w) < width:
        return frozenset([b" ".join(w)] if w else [])
    return frozenset(b" ".join(w[k:k + width]) for k in range(len(w) - width + 1))


def plain(rows, percent=85, width=3):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    for k, s in enumerate(sets):
        both = Counter(o for x in s for o in where[x] if o < k)
        for o, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                root[find(k)] = find(o)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    out = []
    for k, (i, _) in enumerate(rows):
        c = least.get(find(k)) if sets[k] else i
        out.append((i, len(sets[k]), c, c == i))
    return Counter(out)


def test_query_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(map(tuple, queries.op12_minmax_hash(spark, SF).collect()))
    assert got == plain(rows) and any(not r[3] for r in got)


def test_odd_rows(spark, odd_rows, odd_docs):
    docs = odd_docs.withColumns({c: F.lit(1) for c in ("n", "h", "bands", "sig", "root", "component_id", "_root", "data")})
    assert Counter(map(tuple, minmax_hash.near_copies(docs).collect())) == plain(odd_rows)


def test_no_rows(spark, no_docs):
    got = minmax_hash.near_copies(no_docs)
    assert got.collect() == [] and got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    with pytest.raises(ValueError):
        minmax_hash.near_copies(no_docs, share=0.8512)


def families(seed, n):
    """Texts around the bound: copies with words changed, cut and appended; chains; a family that links only
    through its middle; templates that do not link."""
    rng = random.Random(seed)

    def prose(k):
        return [f"w{rng.randrange(4000)}" for _ in range(k)]
    rows = []
    for _ in range(n):
        base = prose(rng.choice([5, 12, 40, 150, 400]))
        rows.append(base)
        for _ in range(rng.randrange(6)):
            copy, kind = list(rows[-1] if rng.random() < 0.4 else base), rng.random()
            if kind < 0.5:
                for _ in range(max(1, int(len(copy) * rng.choice([0.01, 0.02, 0.03, 0.05])))):
                    copy[rng.randrange(len(copy))] = f"w{rng.randrange(4000)}"
            elif kind < 0.75:
                copy = copy[:max(3, int(len(copy) * rng.choice([0.8, 0.85, 0.9, 0.97])))]
            else:
                copy += prose(max(1, int(len(copy) * rng.choice([0.05, 0.1, 0.17, 0.2]))))
            rows.append(copy)
    middle = prose(300)
    rows.append(middle)
    for _ in range(60):
        copy = list(middle)
        for k in rng.sample(range(300), 12):
            copy[k] = f"v{rng.randrange(10 ** 9)}"
        rows.append(copy)
    rng.shuffle(rows)
    return [(i * 7 + 3, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("bucket,members", [(minmax_hash.BUCKET, minmax_hash.MEMBERS), (20, 6_000)])
def test_families(spark, monkeypatch, bucket, members):
    """Whole groups, and groups cut into blocks."""
    monkeypatch.setattr(minmax_hash, "BUCKET", bucket)
    monkeypatch.setattr(minmax_hash, "MEMBERS", members)
    rows = families(4, 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert Counter(map(tuple, minmax_hash.near_copies(docs).collect())) == plain(rows)


def test_estimate_is_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(2000):
        both, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (200, 30, 40))
        v = minmax_hash.min_max([np.unique(np.append(both, a)), np.unique(np.append(both, b))], 64)
        errors.append((v[0] == v[1]).mean() - 200 / 270)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < (200 / 270 * 70 / 270 / 128) ** 0.5 * 1.05


def test_links_on_sets_are_exact():
    a = np.arange(100, dtype=np.uint64)
    for n, linked in ((85, True), (84, False)):
        x, y = minmax_hash.by_sets(np.array([100, n]), [a.tobytes(), a[:n].tobytes()], 0.85)
        assert (len(x) == 1) is linked
