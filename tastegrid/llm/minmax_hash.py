"""Near copies by min-max hashing: each permutation gives a set's least and greatest value, so that half the hash
evaluations fill a signature.

Both ends of a permutation agree between two sets with the chance of their Jaccard similarity, and the
share of agreeing values estimates it with less variance than as many minima would. Values are cut into bands; sets
that agree on a band meet in its bucket. At similarity 0.85 a band of 8 agrees with chance 0.27, so all
48 miss a pair with chance 2.4e-7. The search narrows in three steps, each of which copies nothing that the
next does not need:

1. equal sets become one node (128-bit identity), and only nodes that share a bucket go on;
2. in each bucket, signatures of one byte per value are compared, and nodes whose estimate is at most
   five standard deviations below the bound are joined to clusters;
3. each cluster's full sets meet once, and exact intersections decide. A set found linked is not compared
   again, so a group of copies costs about its size; nothing is emitted but links that connect new sets.

Buckets and clusters too large for a task are cut into blocks, each two of which meet in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.components import components
from tastegrid.llm.texts import identified, slices
from tastegrid.session import stage

BANDS, ROWS = 48, 8
# Values of the signature that go to the buckets, one byte each.
SIGNED = 128
# Signatures of one bucket, and set members of one cluster, that a task holds; larger ones are cut into blocks.
BUCKET = 16_384
MEMBERS = 3_000_000
UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the text's word shingles, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(UPPER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(size) - size
    end = start[width - 1:] + size[width - 1:] - 1
    pieces = [joined[a:b] for a, b in zip(start[:len(end)].tolist(), end.tolist())]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(0)), np.uint64, len(pieces)))


def min_max(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """One row per set (none empty) of least values, then greatest values, under each permutation."""
    rng = np.random.default_rng(17)
    factor = rng.integers(0, 1 << 63, permutations, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    mask = rng.integers(0, 1 << 63, permutations, np.int64).astype(np.uint64)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    first, flat = np.cumsum(size) - size, np.concatenate(sets)
    out = np.empty((len(sets), 2 * permutations), np.uint64)
    for k in range(permutations):
        x = (flat ^ mask[k]) * factor[k]
        x ^= x >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(x, first)
        out[:, permutations + k] = np.maximum.reduceat(x, first)
    return out


def signatures(rows: DataFrame, width: int, bands: int, size: int) -> DataFrame:
    """(_key, n, h, h2, bands, sig) of ``rows`` (_key, text): the set's size, identity, band hashes and bytes."""
    permutations = bands * size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.random.default_rng(29).permutation(2 * permutations)  # a band mixes both ends of many permutations
        places = np.random.default_rng(31).integers(0, 1 << 63, size, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        for keys, texts in slices(batches, 1 << 19):
            sets = [shingle_set(t, width) for t in texts]
            whole = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            some = [s for s in sets if len(s)]
            lists, sigs = iter(()), iter(())
            if some:
                values = min_max(some, permutations)[:, order]
                sigs = iter([v.tobytes() for v in (values[:, :SIGNED] >> np.uint64(24)).astype(np.uint8)])
                mixed = np.zeros((len(some), bands), np.uint64)
                for j in range(size):
                    x = values[:, j::size][:, :bands] * places[j]
                    mixed = (mixed ^ x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                lists = iter(mixed.view(np.int64).tolist())
            halves = np.array([[w & (1 << 64) - 1, w >> 64] for w in whole], np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({
                "_key": pa.array(keys, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int32()),
                "h": pa.array(halves[:, 0]), "h2": pa.array(halves[:, 1]),
                "bands": pa.array([next(lists) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                "sig": pa.array([next(sigs) if len(s) else None for s in sets], pa.binary())})
    return rows.select("_key", "text").mapInArrow(run, "_key long, n int, h long, h2 long, bands array<long>, sig binary")


def spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect all of n members whom any links connect. ``near(k, left)`` tells which of the
    members ``left`` are linked with k; a member found is not compared again."""
    left, a, b = np.arange(n), [], []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            k = queue.pop()
            hit = near(k, left)
            if hit.any():
                found, left = left[hit], left[~hit]
                a.append(np.full(len(found), k))
                b.append(found)
                queue.extend(found.tolist())
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def by_signature(least: float) -> Callable:
    """Links of a bucket: size and byte signatures leave a similarity of at least ``least`` open."""
    def linked(n: np.ndarray, data: list[bytes], share: float):
        sig = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
        need, percent = least * sig.shape[1], round(share * 100)

        def near(k, left):
            alike = np.minimum(n[left], n[k]) * 100 >= percent * np.maximum(n[left], n[k])
            alike[alike] = (sig[left[alike]] == sig[k]).sum(axis=1) >= need
            return alike
        return spanning(len(n), near)
    return linked


def by_sets(n: np.ndarray, data: list[bytes], share: float):
    """Links of a cluster: the exact intersections of the sets, in whole numbers."""
    code = np.unique(np.frombuffer(b"".join(data), np.uint64), return_inverse=True)[1]
    first = np.cumsum(n) - n
    mark = np.zeros(int(code.max()) + 1, bool)
    percent = round(share * 100)

    def near(k, left):
        alike = np.minimum(n[left], n[k]) * 100 >= percent * np.maximum(n[left], n[k])
        some = left[alike]
        if len(some):
            own = code[first[k]:first[k] + n[k]]
            mark[own] = True
            size = n[some]
            start = np.cumsum(size) - size
            at = np.repeat(first[some] - start, size) + np.arange(int(size.sum()))
            both = np.add.reduceat(mark[code[at]].astype(np.int64), start)
            mark[own] = False
            alike[alike] = 100 * both >= percent * (n[k] + size - both)
        return alike
    return spanning(len(n), near)


def in_groups(dealt: DataFrame, linked: Callable, share: float) -> DataFrame:
    """(a, b) of each group's links. ``dealt``: (g, node, n, data); a group meets in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(rows):
            node = np.array([r[1] for r in rows])
            # Most members of a family lie near its middle: larger sets first tend to find it sooner.
            order = np.argsort(-np.array([r[2] for r in rows]), kind="stable")
            a, b = linked(np.array([rows[k][2] for k in order], np.int64), [rows[k][3] for k in order], share)
            return node[order][a], node[order][b]

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)], names=["a", "b"])
        held, found, size = [], [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and row[0] != held[0][0]:
                    if len(held) > 1:
                        found.append(group(held))
                        size += len(found[-1][0])
                        if size > 1 << 16:
                            yield out(found)
                            found, size = [], 0
                    held = []
                held.append(row)
        if len(held) > 1:
            found.append(group(held))
        if found:
            yield out(found)
    return (dealt.select("g", "node", "n", "data").repartition("g").sortWithinPartitions("g", "node")
            .mapInArrow(run, "a long, b long"))


def blocked(dealt: DataFrame, weight, bound: int) -> DataFrame:
    """``dealt`` (g, node, n, data) with each group whose summed ``weight`` exceeds ``bound`` cut into blocks by
    a hash of the node: a new group for each two blocks, so that any two members still meet."""
    heavy = stage(dealt.groupBy("g").agg(F.sum(weight).cast("long").alias("w")).filter(F.col("w") > bound)
                  .select("g", F.ceil(F.col("w") * 2 / bound).cast("long").alias("blocks")), "heavy")
    if not heavy.limit(1).count():
        return dealt
    cut = dealt.join(heavy, "g").withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = cut.select(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "node", "n", "data")
    return dealt.join(heavy, "g", "left_anti").select("g", "node", "n", "data").union(pairs)


def near_copies(docs: DataFrame, share: float = 0.85, width: int = 3, bands: int = BANDS, size: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``: sets of distinct ``width``-word
    shingles with at least ``share`` (in whole per cent) of their union in common are linked, ``component_id`` is the
    least doc_id reachable, and ``kept`` tells whether that is the row's own.

    A text of fewer words is one shingle. Null and blank texts have no shingle, link with nothing and keep their own
    doc_id, as do rows that share one. A row without doc_id has the id of its component, null if that has none; repeated
    rows share a component and are all kept or all not. Other columns are not read."""
    if abs(share * 100 - round(share * 100)) > 1e-9:
        raise ValueError("share counts whole per cent")
    keyed, key = identified(docs)
    rows = keyed.select(F.col(key).alias("_key"), F.col("text").cast("string").alias("text"))
    marks = stage(signatures(rows, width, bands, size), "signatures")
    nodes = stage(marks.filter("n > 0").groupBy("h", "h2").agg(F.min("_key").alias("node")), "nodes")

    full = stage(marks.join(nodes.select(F.col("node").alias("_key")), "_key", "left_semi"), "nodes")
    probes = full.select(F.col("_key").alias("node"), F.explode("bands").alias("g"))
    shared = stage(probes.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("g"), "buckets")
    met = stage(probes.join(shared, "g"), "met")
    dealt = met.join(full.select(F.col("_key").alias("node"), "n", F.col("sig").alias("data")), "node").select("g", "node", "n", "data")
    spread = (share * (1 - share) / min(SIGNED, bands * size)) ** 0.5
    open_ = in_groups(blocked(dealt, F.lit(1), BUCKET), by_signature(share - 5 * spread), share)
    clusters = stage(components(open_), "clusters")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, 1 << 19):
            found = [shingle_set(t, width) for t in texts]
            yield pa.RecordBatch.from_pydict({"node": pa.array(ids, pa.int64()), "n": pa.array([len(s) for s in found], pa.int32()),
                                              "data": pa.array([s.tobytes() for s in found], pa.binary())})
    wanted = rows.join(clusters.select(F.col("node").alias("_key")), "_key", "left_semi").select("_key", "text")
    gathered = stage(wanted.mapInArrow(sets, "node long, n int, data binary").join(clusters, "node")
                     .select(F.col("root").alias("g"), "node", "n", "data"), "sets")
    links = in_groups(blocked(gathered, F.col("n"), MEMBERS), by_sets, share)
    roots = stage(components(links), "roots")

    named = nodes.join(roots, "node", "left").select("h", "h2", F.coalesce("root", "node").alias("_root"))
    every = stage(marks.select("_key", "n", "h", "h2").join(stage(named, "named"), ["h", "h2"], "left"), "every")
    ids = stage(keyed.select(F.col(key).alias("_key"), F.col("doc_id").cast("long").alias("doc_id")).join(every, "_key")
                .select("doc_id", F.col("n").cast("long").alias("n_shingles"), "_root"), "ids")
    least = stage(ids.filter("_root IS NOT NULL").groupBy("_root").agg(F.min("doc_id").alias("_least")), "least")
    found = ids.join(least, "_root", "left").withColumn(
        "component_id", F.when(F.col("_root").isNull(), F.col("doc_id")).otherwise(F.col("_least")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = """WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM words),
nodes AS (SELECT s, min(doc_id) AS node, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
members AS (SELECT node, n, unnest(s) AS x FROM nodes),
pairs AS (
  SELECT a.node AS a, b.node AS b FROM members a JOIN members b ON a.x = b.x AND a.node < b.node
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT node, node AS r FROM nodes UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.r),
roots AS (SELECT node, min(r) AS root FROM reach GROUP BY node)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(roots.root, sets.doc_id) AS component_id,
  coalesce(roots.root, sets.doc_id) = sets.doc_id AS kept
FROM sets LEFT JOIN nodes ON nodes.s = sets.s LEFT JOIN roots ON roots.node = nodes.node"""
