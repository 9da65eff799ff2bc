"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"


def plain_runs(w, min_length=24, exponent=3):
    out = []
    for q in range(1, len(w) // 2 + 1):
        k = 0
        while k < len(w) - q:
            e = k
            while e < len(w) - q and w[e] == w[e + q]:
                e += 1
            length = e - k + q
            if length >= max(min_length, exponent * q):
                part = w[k:k + length]
                if not any(part[:-d] == part[d:] for d in range(1, q)):
                    out.append((k, length, q))
            k = e + 1
    return sorted(out)


def plain_row(i, words, runs):
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {k for a, n, q in runs for k in range(a + q, a + n)}
    kept = b" ".join(x for k, x in enumerate(words) if k not in gone)
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def planted(i, t):
    w = (t or "").encode().split()
    h = zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_random_words_over_few_letters(letters):
    rng = np.random.default_rng(letters)
    for trial in range(150):
        n = int(rng.integers(0, 90))
        code = rng.integers(0, letters, n)
        if trial % 3 == 0 and n > 10:  # with periodic middles
            p = int(rng.integers(1, 8))
            code[5:] = code[5 + np.arange(n - 5) % p]
        for min_length, exponent in ((2, 2), (6, 3), (24, 3), (9, 2)):
            got = [tuple(r) for r in periodic_runs.runs_of(np.append(code, -1), min_length, exponent).tolist()]
            assert got == plain_runs(code.tolist(), min_length, exponent), (code, min_length, exponent)


def test_fibonacci_word():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    got = [tuple(r) for r in periodic_runs.runs_of(np.array([*b, -1]), 4, 2).tolist()]
    assert got == plain_runs(b, 4, 2) and len(got) > 100


def test_no_text_with_a_repeat_is_left_out():
    rng = np.random.default_rng(0)
    code = rng.integers(0, 3, 4000)
    owner = np.repeat(np.arange(100), 40)
    out = periodic_runs.repeats_inside(code, owner, 100, 5)
    for k in range(100):
        w = code[owner == k].tolist()
        if len({tuple(w[j:j + 5]) for j in range(36)}) < 36:
            assert out[k]


def test_query_on_whole_table(spark):
    rows = spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text").collect()
    want = []
    for i, t in rows:
        w = planted(i, t)
        if len(w) <= 1500:
            want.append(plain_row(i, w, plain_runs(w)))
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(rows) and [got[r[0]] for r in want] == want
    assert sum(r[1] > 0 for r in want) > 5


def test_odd_rows(spark, odd_rows, odd_docs):
    rng = random.Random(3)
    phrase = "again and again the same seven words"
    rows = [*odd_rows, (30, (phrase + " ") * 5), (31, "x " + (phrase + " ") * 3000 + "y"), (None, (phrase + "\n") * 4),
            (32, " ".join(rng.choice("ab") for _ in range(600)))]
    extra = spark.createDataFrame([(i, t) for i, t in rows[len(odd_rows):]], "doc_id long, text string")
    docs = odd_docs.withColumns({c: F.lit(1) for c in ("runs", "collapsed", "_best", "period")}).unionByName(extra, allowMissingColumns=True)
    got = periodic_runs.run_digests(periodic_runs.periodic_runs(docs)).collect()
    def own(t):
        w = (t or "").encode().split()
        if w[:1] == [b"x"] and len(w) > 20_000:
            return [(1, 21_000, 7)]
        return [(0, 3000, 1)] if t == "ab " * 3000 else plain_runs(w) if len(w) < 2000 else []
    want = Counter(plain_row(i, (t or "").encode().split(), own(t)) for i, t in rows)
    assert Counter(map(tuple, got)) == want


def test_no_rows(spark, no_docs):
    got = periodic_runs.run_digests(periodic_runs.periodic_runs(no_docs))
    assert got.collect() == [] and got.columns[:2] == ["doc_id", "n_runs"]
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(no_docs, exponent=1)
