"""Substring and near-duplicate operators against brute force, on odd rows and a small table."""

import hashlib
import re
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tastegrid.llm import fm_index, repeats, simhash, suffix_dedup
from tastegrid.llm.components import components

SF = "/root/testdata/sf0.001"


def ordered(rows):
    """By doc_id, nulls first, then by the hash that Spark's xxhash64 gives."""
    def h(t):
        x = 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42)
        return x - (1 << 64) if x >> 63 else x
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h(r[1])))


def sf_rows(spark):
    return [tuple(r) for r in spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text").collect()]


def words_kept(rows, width=20):
    seen, out = set(), []
    for i, t in ordered(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            x = tuple(w[k:k + width])
            if x in seen:
                gone[k:k + width] = [True] * width
            seen.add(x)
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(a for a, g in zip(w, gone) if not g)).hexdigest()))
    return Counter(out)


def bytes_kept(rows, width=200):
    raws = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k:k + width] for _, b in raws for k in range(len(b) - width + 1))
    out = []
    for i, b in raws:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - width + 1):
            if count[b[k:k + width]] > 1:
                gone[k] += 1
                gone[k + width] -= 1
        g = np.cumsum(gone)[:-1] > 0
        out.append((i, len(b), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()),
                    hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()))
    return Counter(out)


def test_op1_odd_rows(odd_docs, odd_rows):
    assert Counter(tuple(r) for r in fm_index.substring_dedup(odd_docs).collect()) == words_kept(odd_rows)


def test_op1_table(spark):
    rows = sf_rows(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in fm_index.substring_dedup(docs).collect()) == words_kept(rows)


def test_op1_hot_anchor_and_small_shards(spark):
    """Thousands of different segments around one anchor, more than a shard takes."""
    rng = np.random.default_rng(1)
    passage = " ".join(f"p{k}" for k in range(24))
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10_000, 15)) + " " + passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 10_000, 15)))
            for i in range(300)]
    docs = spark.createDataFrame([(i, i, t) for i, t in rows], "_key long, doc_id long, text string")
    ranges = repeats.repeated_ranges(docs, True, 20, 5, fm_index.later_windows, True, shard=40)
    got = {r.key: repeats.covered(54, [x.asDict() for x in r.parts]).sum() for r in
           ranges.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("parts")).collect()}
    want = {i: n for (i, _, n, _), _ in words_kept(rows).items() if n}
    assert got == want and len(want) == 299


def test_op1_passages(odd_docs):
    found = fm_index.repeated_passages(odd_docs).filter("doc_id = 2").collect()
    assert [(r.first_word, r.n_words) for r in found] == [(0, 90)]


def test_op8_odd_rows(odd_docs, odd_rows):
    assert Counter(tuple(r) for r in suffix_dedup.suffix_dedup(odd_docs).collect()) == bytes_kept(odd_rows)


def test_op8_table(spark):
    rows = sf_rows(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in suffix_dedup.suffix_dedup(docs).collect()) == bytes_kept(rows)


def test_op8_hot_anchor_small_shards_and_disk(spark):
    rng = np.random.default_rng(2)
    passage = "".join(chr(97 + k) for k in rng.integers(0, 26, 230))
    rows = [(i, "".join(chr(97 + k) for k in rng.integers(0, 26, 150)) + passage + "".join(chr(97 + k) for k in rng.integers(0, 26, 150)))
            for i in range(120)]
    docs = spark.createDataFrame([(i, i, t) for i, t in rows], "_key long, doc_id long, text string")
    match = partial(suffix_dedup.shared_windows, budget=4_096)
    ranges = repeats.repeated_ranges(docs, False, 200, 40, match, False, shard=25)
    got = {r.key: int(repeats.covered(530, [x.asDict() for x in r.parts]).sum()) for r in
           ranges.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("parts")).collect()}
    assert got == {i: n for (i, _, n, _, _), _ in bytes_kept(rows).items() if n} and len(got) == 120


@pytest.mark.parametrize("words", [True, False])
def test_crowded_anchors_gather_in_no_shard(spark, words):
    """A passage just over the width in 400 contexts: no shard may get its windows, and the result stays exact."""
    rng = np.random.default_rng(6)
    passage = " ".join(f"p{k}" for k in range(21)) if words else "".join(chr(97 + k) for k in rng.integers(0, 26, 205))
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) + " " + passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)))
            for i in range(400)]
    docs = spark.createDataFrame([(i, i, t) for i, t in rows], "_key long, doc_id long, text string")
    inner = fm_index.later_windows if words else suffix_dedup.shared_windows

    def match(content, *rest):
        assert len(content) <= 60, f"{len(content)} segments in a shard of 20"
        return inner(content, *rest)
    ranges = repeats.repeated_ranges(docs, words, 20 if words else 200, 5 if words else 40, match, words, shard=20)
    size = {i: len(t.split()) if words else len(t.encode()) for i, t in rows}
    got = {r.key: int(repeats.covered(size[r.key], [x.asDict() for x in r.parts]).sum()) for r in
           ranges.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("parts")).collect()}
    want = {r[0]: r[2] for r in (words_kept(rows) if words else bytes_kept(rows)) if r[2]}
    assert got == want and len(want) == (399 if words else 400)


def test_induced_suffix_array():
    rng = np.random.default_rng(0)
    for trial in range(200):
        t = rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(1, 120))).astype(np.uint8)
        if trial % 5 == 0:
            t[rng.random(len(t)) < 0.3] = 0
        budget = [1 << 20, 64][trial % 2]
        assert suffix_dedup.induced_suffix_array(t, 200, budget).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tobytes())


def shares_brute(text, order, width):
    raw = text.tobytes()
    return [k > 0 and max(a, order[k - 1]) + width <= len(raw) and raw[a:a + width] == raw[order[k - 1]:order[k - 1] + width]
            for k, a in enumerate(order)]


def test_common_prefix():
    """On texts with long repeats, whose neighbours in the order form chains, and on orders that form none."""
    rng = np.random.default_rng(8)
    for trial in range(120):
        t = rng.integers(97, 97 + int(rng.integers(1, 27)), int(rng.integers(3, 200))).astype(np.uint8)
        t = np.concatenate([t, t[int(rng.integers(0, len(t))):], t[:int(rng.integers(1, len(t)))], t])
        t[rng.random(len(t)) < rng.choice([0, 0.01, 0.1])] = rng.choice([0, 98, 255])
        order = suffix_dedup.induced_suffix_array(t, 200) if trial % 3 else rng.permutation(len(t))
        for width in (8, 24, 200):
            assert suffix_dedup.common_prefix(t, order, width).tolist() == shares_brute(t, order.tolist(), width)


def near_segments(n, size=300):
    """Segments as a shard gets them: passages in four contexts each."""
    rng = np.random.default_rng(9)
    words = [rng.integers(97, 123, int(k)).astype(np.uint8) for k in rng.integers(2, 11, 3_000)]

    def prose(n):
        return np.concatenate([np.append(words[k], 32) for k in rng.integers(0, len(words), n // 3)])[:n].astype(np.uint8)
    out = []
    for _ in range(n // 4):
        passage = prose(size)
        out += [np.concatenate([prose(30), passage, prose(30)]) for _ in range(4)]
    return out


class Sorts:
    """Numpy, counting the numbers that are sorted."""

    def __init__(self):
        self.n = 0

    def __getattr__(self, name):
        return getattr(np, name)

    def argsort(self, a, **how):
        self.n += len(a)
        return np.argsort(a, **how)

    def lexsort(self, keys):
        self.n += sum(map(len, keys))
        return np.lexsort(keys)


def test_op8_shard_sorts_little(monkeypatch):
    """Per byte of a shard 2.7 numbers are sorted (before: 6.9), as what is settled is not sorted again."""
    content = near_segments(1_000)
    keys, size = np.arange(len(content)), np.array([len(c) for c in content])
    sorts = Sorts()
    monkeypatch.setattr(suffix_dedup, "np", sorts)
    found = suffix_dedup.shared_windows(content, size - 199, keys, np.zeros(len(content), int), 200)
    assert all(f[30:131].all() and not f[:15].any() and not f[146:].any() for f in found)
    assert sorts.n < 4 * size.sum()


@pytest.mark.parametrize("words", [True, False])
def test_scan_holds_short_arrays(spark, monkeypatch, words):
    """Texts are scanned in steps whose arrays fit a processor's cache, and segments do not depend on the steps."""
    rng = np.random.default_rng(10)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, int(rng.integers(0, 60))))) for i in range(400)]
    rows += [(400, ""), (401, "a" * 199), (402, "a" * 200), (403, "b" * 5_000), (404, None), (405, "x y " * 2_000)]
    docs = spark.createDataFrame(rows, "_key long, text string").coalesce(1)
    width, gram = (20, 5) if words else (200, 40)
    got = {}
    for step in (repeats.STEP, 3_000):
        monkeypatch.setattr(repeats, "STEP", step)
        got[step] = {r.key: r for r in repeats._segment_rows(docs, words, width, gram).collect()}
    assert repeats.STEP < 1 << 17 and len(got[3_000]) == len(rows) and len(set(map(str, got.values()))) == 1
    # One text by itself, windows by brute force: the least hash of the runs inside, the leftmost of equal ones.
    for i in (3, 7, 401, 402, 405):
        u = repeats.Units([rows[i][1]], words)
        g = repeats.run_hashes(u.values, gram)[0].view(np.int64).tolist() if len(u.raw) >= width else []
        high = [x & ~((1 << 21) - 1) & (1 << 64) - 1 for x in g]
        places = [min(range(k, k + width - gram + 1), key=high.__getitem__) for k in range(len(u.raw) - width + 1)]
        new = [k for k in range(len(places)) if k == 0 or places[k] != places[k - 1]]
        r = got[3_000][i]
        assert (r.start, r.anchor) == (new, [g[places[k]] for k in new]) and sum(r.windows) == len(places)


def test_merged_ranges():
    rows = [[(5, 9), (0, 3), (3, 4), (5, 9)], None, [], [(2, 8), (4, 6), (9, 10)], [(0, 2 ** 31 - 1)]]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    column = pa.array([r if r is None else [{"start": a, "end": b} for a, b in r] for r in [[(1, 7)], *rows]], kind)[1:]
    first, start, end = (x.tolist() for x in repeats.merged(column))
    assert [list(zip(start[a:b], end[a:b])) for a, b in zip(first, first[1:])] == [
        [(0, 4), (5, 9)], [], [], [(2, 8), (9, 10)], [(0, 2 ** 31 - 1)]]
    assert repeats.merged(pa.array([None, []], kind))[0].tolist() == [0, 0, 0]


def test_drop_repeats_keeps_first_and_columns(odd_docs, odd_rows):
    out = suffix_dedup.drop_repeats(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == len(odd_rows)
    text = {r.doc_id: r for r in out.filter("doc_id < 20").collect()}
    assert text[3].text == dict(odd_rows)[3] and text[4].text == "" and text[4].n_chars == 0 and text[6].text is None
    assert len(text[2].text) < 300


def simhash_brute(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op2_odd_rows(odd_docs, odd_rows):
    fps = [(i, simhash_brute(t)) for i, t in odd_rows]
    root = list(range(len(fps)))
    for _ in range(len(fps)):
        for a in range(len(fps)):
            for b in range(len(fps)):
                if bin(fps[a][1] ^ fps[b][1]).count("1") <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    want = Counter((i, f"{f:016x}", least.get(root[k])) for k, (i, f) in enumerate(fps))
    assert Counter(tuple(r) for r in simhash.near_duplicates(odd_docs).collect()) == want


@pytest.mark.parametrize("radius, group, small", [(4, 32_768, 64), (3, 32_768, 64), (10, 32_768, 64), (4, 20, 4)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, radius, group, small):
    """Also with probe groups too large for one task, which are compared by pairs of blocks."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(0)
    rows = [int(x) for x in rng.integers(-2**63, 2**63 - 1, 200)]
    for b in rows[:40]:
        for _ in range(int(rng.integers(1, 30))):
            y = b & (2**64 - 1)
            for k in rng.integers(0, 64, int(rng.integers(1, 9))):
                y ^= 1 << int(k)
            rows.append(simhash.signed(y))
    rows = sorted(set(rows))
    f = np.array(rows, np.int64).view(np.uint64)
    root = list(range(len(f)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1:]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    marks = spark.createDataFrame([(x, x, 0) for x in rows], "node long, fp long, check long")
    got = {x.node: x.root for x in components(simhash.link(marks, radius)).collect()}
    assert all(got.get(x, x) == rows[find(k)] for k, x in enumerate(rows))


def test_keep_first_drops_copies(odd_docs):
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert 3 in ids and not {4, 5, 20} & set(ids)
    assert {1, 2, 9, 10, 12, 13, 14, 15, 16, 22} <= set(ids)


def test_keep_first_finds_all_edits_at_the_bar(spark):
    """Copies with a passage appended, cut or replaced or with scattered words changed, just above and well below the bar."""
    rng = np.random.default_rng(3)

    def words(n):
        return [f"w{x}" for x in rng.zipf(1.3, n) % 50_000]

    def shingles(w):
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}

    def like(a, b):
        return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))

    def edited(w, how, much):
        n = max(1, int(len(w) * much))
        if how == "append":
            return w + words(n)
        if how == "cut":
            return w[:-n]
        if how == "replace":
            return w[:len(w) // 2] + words(n) + w[len(w) // 2 + n:]
        out = list(w)
        for k in range(0, len(w), max(1, int(1 / much))):
            out[k] = "changed"
        return out
    rows, copies, others = [], set(), set()
    for how, most in (("append", 0.24), ("cut", 0.19), ("replace", 0.1), ("words", 0.02)):
        for n in (60, 200, 700):
            for _ in range(25):
                base = words(n)
                near = next((x for f in (1, 0.9, 0.8, 0.6, 0.3) if like(base, x := edited(base, how, most * f)) >= 0.8), None)
                far = words(n // 2) + base[n // 2:]
                rows += [(len(rows), base), (len(rows) + 1, near or base), (len(rows) + 2, far)]
                copies.add(len(rows) - 2)
                if like(base, far) < 0.75:
                    others.add(len(rows) - 1)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_first(docs).collect()}
    assert len(copies) == 300 and not copies & kept
    assert len(others) > 250 and others <= kept


def test_keep_first_links_members_that_miss_the_least_one(spark):
    """A chain of windows over one text: ends are far apart, neighbours near."""
    rng = np.random.default_rng(4)
    w = [f"w{x}" for x in rng.integers(0, 10**6, 600)]
    docs = spark.createDataFrame([(i, " ".join(w[10 * i:10 * i + 200])) for i in range(40)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_first(docs).collect()] == [0]


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}


def test_empty_tables(no_docs):
    assert fm_index.substring_dedup(no_docs).collect() == []
    assert suffix_dedup.suffix_dedup(no_docs).collect() == []
    assert suffix_dedup.drop_repeats(no_docs).collect() == []
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.keep_first(no_docs).collect() == []
    assert simhash.one_of_each(no_docs).collect() == []


def morse(n, a, b):
    return "".join((a, b)[k.bit_count() & 1] for k in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_patterned_words_are_told_apart(spark, n):
    """Thue-Morse words and their complements, on which power sums modulo 2 ** 64 are equal."""
    rng = np.random.default_rng(n)
    rows = []
    for a, b in ("ab", "ae", "xy", "01"):
        head, tail = (" ".join(f"w{x}" for x in rng.integers(0, 10 ** 6, 25)) for _ in range(2))
        rows += [(len(rows), f"{head} {morse(n, a, b)} {tail}"), (len(rows) + 1, f"{head} {morse(n, b, a)} {tail}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in fm_index.substring_dedup(docs).collect()) == words_kept(rows)
    assert Counter(tuple(r) for r in suffix_dedup.suffix_dedup(docs).collect()) == bytes_kept(rows)
    whole = [(k, morse(n, *p)) for k, p in enumerate(("ab", "ba", "ea", "ae"))]
    assert simhash.keep_first(spark.createDataFrame(whole, "doc_id long, text string")).count() == 4


def test_one_of_each_keeps_columns(odd_docs, odd_rows):
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() < len(odd_rows)
    ids = [r.doc_id for r in kept.collect()]
    assert {1, 2, 3, 9, 10, 12, 13, 14, 15, 16, 22} <= set(ids) and not {4, 5, 7, 8, 20} & set(ids)
