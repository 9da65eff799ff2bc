"""SimHash near-duplicate links by the generalised pigeonhole principle.

Fingerprints within ``radius`` bits of each other agree, in at least one part of the bits, up to
that part's own threshold, if the thresholds add up to radius - parts + 1. Bits that vary
together form a part; a dynamic programme over the parts picks the thresholds that leave the fewest
estimated candidates and probes. A threshold of t means probing with every choice of t bits
of the part left out, so all probes are equalities under a mask and meet in a sort.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.components import components
from tastegrid.llm.minmax_hash import near_copies
from tastegrid.llm.texts import identified, slices, two_columns
from tastegrid.session import stage

BITS = 64
SEED = 42
# Fingerprints of one probe value that one task compares; larger groups are compared by pairs of blocks.
GROUP = 32_768
SMALL = 64
# Cost of sending one probe, in comparisons.
ROW = 200


def simhash(text: str, width: int = 4, distinct: bool = False) -> int:
    """Signed 64-bit fingerprint of a text's word shingles, repeats included unless ``distinct``; 0
    without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        start = np.cumsum(size) - size
        end = start[width - 1:] + size[width - 1:] - 1
        shingles = [joined[a:b] for a, b in zip(start[:len(end)].tolist(), end.tolist())]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    if distinct:
        h = np.unique(h)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65_536):
        part = h[at:at + 65_536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 4, key: str = "doc_id") -> DataFrame:
    """(key, fp) of every row; null and blank texts have fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            yield pa.RecordBatch.from_pydict({key: pa.array(ids, pa.int64()),
                                              "fp": pa.array([simhash(t, width) for t in texts], pa.int64())})
    return docs.select(key, "text").mapInArrow(run, f"{key} long, fp long")


def bit_sums(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each two bits, how many have both set: 4,096 sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = np.frombuffer(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), np.uint8)
            bits = np.unpackbits(x.reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(-1, BITS * BITS), pa.int32()),
                                          "n": pa.array([n, *total.ravel().astype(np.int64).tolist()], pa.int64())})
    rows = fps.select("fp").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    sums = {r.k: r.n for r in rows}
    return sums.get(-1, 0), np.array([sums.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of near equal size: each starts with the two bits left that vary together most
    and takes the bit most correlated with what it holds."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, -1)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        own = sorted(left)
        a, b = divmod(int(np.argmax(corr[np.ix_(own, own)])), len(own))
        part = [own[a], own[b]] if size > 1 else [own[a]]
        left -= set(part)
        while len(part) < size:
            rest = sorted(left)
            part.append(rest[int(np.argmax(corr[np.ix_(rest, part)].sum(axis=1)))])
            left.discard(part[-1])
        out.append(sorted(part))
    return out


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def plan(fps: DataFrame, radius: int, part_counts: tuple[int, ...] = (3, 4, 5)) -> list[int]:
    """The masks under which close fingerprints are equal. Pairs equal on each part are counted
    over all fingerprints; leaving bits out multiplies that count by the bits' own chances to agree."""
    n, both = bit_sums(fps)
    if n < 2:
        return []
    p = np.diag(both) / n
    agree = p * p + (1 - p) ** 2
    layouts = {m: group_bits(n, both, m) for m in part_counts}
    masks = {(m, i): sum(1 << b for b in part) for m, parts in layouts.items() for i, part in enumerate(parts)}
    keys = list(masks)
    probe = F.explode(F.array(*[F.struct(F.lit(k).alias("v"), F.col("fp").bitwiseAND(F.lit(signed(masks[key]))).alias("x"))
                                for k, key in enumerate(keys)])).alias("p")
    same = (fps.select(probe).groupBy("p.v", "p.x").count().groupBy("v")
            .agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect())
    pairs = {keys[r.v]: r.pairs for r in same}
    best = None
    for m, parts in layouts.items():
        # Least cost of the first parts by the thresholds spent so far; -1 leaves a part out.
        spent: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for i, part in enumerate(parts):
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in spent.items():
                for t in range(-1, min(radius, len(part) - 1, 3) + 1):
                    extra = 0.0
                    if t >= 0:
                        gain = sum(1 / agree[b] for b in part) ** t / max(1, [1, 1, 2, 6][t])
                        extra = ROW * n * comb(len(part), t) + max(pairs[(m, i)], n * n / 2.0 ** (len(part) + 1)) * gain
                    if used + t not in step or cost + extra < step[used + t][0]:
                        step[used + t] = (cost + extra, [*chosen, t])
            spent = step
        # More than needed is allowed: thresholds are capped for small parts.
        for used, (cost, chosen) in spent.items():
            if used >= radius - m + 1 and (best is None or cost < best[0]):
                best = (cost, m, chosen)
    if best is None:
        raise ValueError("no thresholds reach this radius")
    _, m, chosen = best
    return [masks[(m, i)] & ~sum(1 << b for b in out)
            for i, t in enumerate(chosen) if t >= 0 for out in combinations(layouts[m][i], t)]


def differing(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64))


def _stars(node: np.ndarray, fp: np.ndarray, check: np.ndarray, radius: int, check_radius: int):
    """Spanning stars of one group's links, as (root, member) arrays. A member found is not compared
    again, so a dense group costs about its size and a loose one half its square."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left) > 1:
        queue, found, left = [left[0]], [left[:1]], left[1:]
        while queue and len(left):
            k = queue.pop()
            near = differing(fp[left], fp[k]) <= radius
            if check_radius < BITS:
                near &= differing(check[left], check[k]) <= check_radius
            if near.any():
                hit, left = left[near], left[~near]
                found.append(hit)
                queue.extend(hit)
        if len(found) > 1:
            members = node[np.concatenate(found)]
            root = members.min()
            b.append(members[members != root])
            a.append(np.full(len(b[-1]), root))
    return a, b


def _compare(dealt: DataFrame, radius: int, check_radius: int, limit: int | None) -> DataFrame:
    """(kind, g, a, fp, check): rows of kind 0 are links, ``a`` to ``fp`` as nodes; rows of kind 1
    are the members of groups of over ``limit`` rows. ``dealt``: (g, node, fp, check), sorted by g in
    each partition."""
    names = ["kind", "g", "a", "fp", "check"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind, g, a, fp, check):
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(
                pa.array(np.broadcast_to(x, n).astype(np.int64)) for x in (g, a, fp, check))], names=names)

        def groups(g, *cols):
            """Links of whole groups: all small ones at once, larger ones one by one."""
            node, fp, check = cols
            cut = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            size = np.diff(np.append(cut, len(g)))
            # Small groups side by side: each row against those up to the group's end.
            small = (size > 1) & (size <= SMALL)
            left = np.repeat(size[small], size[small])
            at = np.repeat(cut[small], size[small]) + np.arange(len(left)) - np.repeat(np.cumsum(size[small]) - size[small], size[small])
            left = np.repeat(cut[small] + size[small], size[small]) - at
            for d in range(1, SMALL):
                on = left > d
                at, left = at[on], left[on]
                if not len(at):
                    break
                near = at[(differing(fp[at], fp[at + d]) <= radius)]
                near = near[differing(check[near], check[near + d]) <= check_radius]
                if len(near):
                    yield out(0, 0, node[near], node[near + d], 0)
            for at, n in zip(cut[size > SMALL].tolist(), size[size > SMALL].tolist()):
                a, b = _stars(node[at:at + n], fp[at:at + n], check[at:at + n], radius, check_radius)
                if a:
                    yield out(0, 0, np.concatenate(a), np.concatenate(b), 0)

        held, large = [np.empty(0, np.int64)] * 4, None
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if large is not None:
                n = int(np.searchsorted(new[0], large, "right"))
                if n:
                    yield out(1, *(x[:n] for x in new))
                if n == len(new[0]):
                    continue
                new, large = [x[n:] for x in new], None
            held = [np.concatenate(x) for x in zip(held, new)]
            last = int(np.searchsorted(held[0], held[0][-1], "left"))
            if last:
                yield from groups(*(x[:last] for x in held))
                held = [x[last:] for x in held]
            if limit and len(held[0]) > limit:
                yield out(1, *held)
                large, held = held[0][0], [np.empty(0, np.int64)] * 4
        if len(held[0]):
            yield from groups(*held)
    return dealt.select("g", "node", "fp", "check").mapInArrow(run, "kind int, g long, a long, fp long, check long")


def link(marks: DataFrame, radius: int = 4, check_radius: int = BITS) -> DataFrame:
    """(a, b): enough links to connect all nodes that any links connect. ``marks``: (node, fp, check)
    with few repeats; two nodes link if their ``fp`` differ in at most ``radius`` bits and their
    ``check`` in at most ``check_radius``.

    Each probe value's group is compared in one task, where a set found connected is not
    compared twice. A group of over ``GROUP`` members is cut into blocks by a hash of the node, and each
    two blocks are compared in a task of their own."""
    masks = plan(marks, radius)
    if not masks:
        return marks.sparkSession.createDataFrame([], "a long, b long")
    probes = F.explode(F.array(*[F.struct(F.lit(k).alias("v"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("x"))
                                 for k, m in enumerate(masks)])).alias("p")
    dealt = marks.select("node", "fp", "check", probes).select(F.xxhash64("p.v", "p.x").alias("g"), "node", "fp", "check")
    found = stage(_compare(dealt.repartition("g").sortWithinPartitions("g"), radius, check_radius, GROUP).distinct(), "links")
    links = found.filter("kind = 0").select("a", F.col("fp").alias("b"))
    hot = found.filter("kind = 1")
    if hot.limit(1).count():
        blocks = hot.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / (GROUP // 2)).alias("n"))
        own = F.pmod(F.xxhash64("a", F.lit(1)), F.col("n"))
        pairs = hot.join(blocks, "g").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        pairs = pairs.select(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).alias("g"),
                             F.col("a").alias("node"), "fp", "check")
        more = _compare(pairs.repartition("g").sortWithinPartitions("g"), radius, check_radius, None)
        links = links.union(more.select("a", F.col("fp").alias("b")))
    return links


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``: fingerprints at most
    ``radius`` bits apart are linked, and ``component_id`` is the least doc_id reachable. Null and blank texts have
    fingerprint zero and link like any other; repeated rows stay and share a component; a row
    without doc_id has that of its component (null if it has none at all)."""
    marks = stage(fingerprints(two_columns(docs), width), "fingerprints")
    distinct = stage(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    nodes = distinct.select(F.col("fp").alias("node"), "fp", F.lit(0).cast("long").alias("check"))
    roots = components(link(nodes, radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marks.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """``docs`` with one row of each component of ``near_duplicates``: that of least doc_id, with all its
    columns. Null and blank texts share fingerprint zero. Rows of one doc_id are rows of their own; of rows alike in
    all, one stays."""
    keyed, key = identified(docs)
    named = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), radius, width)
    gone = named.filter("doc_id <> component_id").select(F.col("doc_id").alias(key))
    return keyed.join(gone, key, "left_anti").drop(key).select(*docs.columns)


def keep_first(docs: DataFrame, share: float = 0.8, width: int = 5) -> DataFrame:
    """``docs`` without near copies by the similarity of their shingles, for which 64 bits are too few: at 0.8
    fingerprints differ in up to 18 bits. Min-max hashing proposes and exact sets decide; a band of 6 values agrees at 0.8
    with chance 0.26, so 48 bands miss a pair with chance 5e-7. Of each group the row of least doc_id stays, with all
    its columns. Texts without words are equal to each other. Rows of one doc_id are rows of their own; of rows
    alike in all, one stays."""
    keyed, key = identified(docs)
    named = stage(near_copies(keyed.select(F.col(key).alias("doc_id"), "text"), share, width, bands=48, size=6), "near")
    blank = named.filter("n_shingles = 0")
    least = blank.agg(F.min("doc_id")).first()[0]
    gone = named.filter("NOT kept").union(blank.filter(F.col("doc_id") != F.lit(least))).select(F.col("doc_id").alias(key))
    return keyed.join(gone, key, "left_anti").drop(key).select(*docs.columns)
