"""Document fingerprints by randomised edit embedding.

A text is walked once: at every step the character under the cursor is written down, and a random bit
shared by all texts, drawn for the step and the character, says whether the cursor moves on. Two
texts at a small edit distance fall back into step soon after each edit, so what they write down
differs in few places: edit distance becomes Hamming distance. A fingerprint samples the walk: the
steps are dealt to slots at random, and each slot keeps the symbol of its step of least priority
among those before the text's end. The sample of a slot is thus the same step for two texts of near
equal length, whatever their length.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.components import components
from tastegrid.llm.texts import two_columns
from tastegrid.session import stage

SLOTS = 128
PERIOD = 1 << 13
# Characters that one task walks at once; a longer text is walked by itself.
WALK_CHARS = 12_000_000
# Members of a bucket, or of one side of a pair of its blocks, that a task holds against each other.
BUCKET_BLOCK = 4096


class Walk:
    """The shared random choices. All follow from the seed, so every task makes the same."""

    def __init__(self, seed: int = 7):
        self.seed = seed
        rng = np.random.default_rng(seed)
        self.moves = rng.integers(0, 2, (PERIOD, 256)).astype(np.int64)
        self.moves[:, 0] = 0  # the end of a text holds the cursor
        self.symbol = rng.integers(1, 16, 256).astype(np.uint8)
        self.slot, self.least = np.empty(0, np.int16), np.full(SLOTS, 2.0)

    def _grow(self, steps: int) -> None:
        """slot[t]: the slot whose sample step t replaces, or -1. Drawn in blocks with their own seeds, each added to
        those before with the least priority so far of every slot, so it does not depend on the texts met before."""
        block = 1 << 16
        parts = [self.slot]
        for k in range(len(self.slot) // block, -(-steps // block)):
            rng = np.random.default_rng((self.seed, k))
            own, priority = rng.integers(0, SLOTS, block), rng.random(block)
            part = np.full(block, -1, np.int16)
            for s in range(SLOTS):
                at = np.flatnonzero(own == s)
                best = np.minimum.accumulate(np.append(self.least[s], priority[at]))
                new = at[best[1:] < best[:-1]]
                part[new] = s
                self.least[s] = best[-1]
            parts.append(part)
        if len(parts) > 1:
            self.slot = np.concatenate(parts)

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """One row of symbols per text; 0 where a slot has no step."""
        out = np.zeros((len(texts), SLOTS), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        code = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        flat = (((code * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(255) + np.uint32(1)).astype(np.uint8)
        ends = np.cumsum(size + 1) - 1
        flat[ends] = 0
        who = np.flatnonzero(size)
        pos, end = (ends - size)[who], ends[who]
        t = 0
        while len(who):
            self._grow(t + 256)
            slots = self.slot[t:t + 256].tolist()
            for k in range(256):
                c = flat[pos]
                if slots[k] >= 0:
                    on = c > 0
                    out[who[on], slots[k]] = self.symbol[c[on]]
                pos += self.moves[(t + k) % PERIOD][c]
            t += 256
            alive = pos < end
            if not alive.all():
                who, pos, end = who[alive], pos[alive], end[alive]
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal symbols among the slots that either side has; 1 for two empty texts."""
    either = (a > 0) | (b > 0)
    n = either.sum(axis=-1)
    return np.where(n == 0, 1.0, ((a == b) & either).sum(axis=-1) / np.maximum(n, 1))


def written(fp: np.ndarray) -> list[str]:
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    return [digits[row].tobytes().decode() for row in fp]


def fingerprints(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, fingerprint): one row per row; a null text is empty, whose fingerprint is all zeros."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(seed)
        for rows in _chunks(batches):
            fp = walk.fingerprints([r[-1] for r in rows])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "fingerprint": written(fp)})
    return two_columns(docs).mapInArrow(run, "doc_id long, fingerprint string")


def _chunks(batches) -> Iterator[list[tuple]]:
    """Rows as tuples, the text last, in lists of about WALK_CHARS characters."""
    rows, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for row in zip(*(part.column(k).to_pylist() for k in range(part.num_columns))):
                rows.append((*row[:-1], row[-1] or ""))
                size += len(rows[-1][-1])
                if size >= WALK_CHARS:
                    yield rows
                    rows, size = [], 0
    if rows:
        yield rows


def _with_next(docs: DataFrame) -> DataFrame:
    """(part, turn, ord, h, doc_id, text), sorted by the first four in each partition: ranges of
    doc_id (null first), each followed by the row after it as turn 1. Range borders are the least doc_ids of
    ranges cut at about equal counts, so the row after a range is the first row of the next; the last range gets the very
    first row. Only borders, one per range, reach the driver."""
    spark = docs.sparkSession
    ranged = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("ord"), F.xxhash64("text").alias("h"), "doc_id", "text")
    first = ranged.agg(F.min(F.struct("ord", "h")).alias("f"), F.count(F.lit(1)).alias("n")).first()
    if not first.n:
        return ranged.select(F.lit(0).alias("part"), F.lit(0).alias("turn"), "ord", "h", "doc_id", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * n
    borders = sorted(set(ranged.filter(F.col("ord") > first.f.ord).stat.approxQuantile(
        "ord", [k / ranges for k in range(1, ranges)], 0.1 / ranges)) if ranges > 1 else [])
    # Quantiles come as doubles, which round ids beyond 2 ** 53: each range's least id is its true border.
    rough = np.array(sorted({min(int(b), (1 << 63) - 1) for b in borders}), np.int64)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ords = b.column(0).to_numpy(zero_copy_only=False)
            part = np.searchsorted(rough, ords, "right")
            least = np.full(len(rough) + 1, (1 << 63) - 1, np.int64)
            np.minimum.at(least, part, ords)
            own = np.unique(part)
            yield pa.RecordBatch.from_pydict({"part": pa.array(own.astype(np.int32)), "ord": pa.array(least[own])})
    least = ranged.select("ord").mapInArrow(parts, "part int, ord long").groupBy("part").agg(F.min("ord").alias("ord")).collect()
    cuts = np.array(sorted(r.ord for r in least)[1:], np.int64)
    start = (first.f.ord, first.f.h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ords, h = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            part = np.searchsorted(cuts, ords, "right")
            before = (part > 0) & (ords == cuts[np.maximum(part - 1, 0)]) if len(cuts) else np.zeros(len(part), bool)
            wrap = (ords == start[0]) & (h == start[1])
            for keep, to, turn in ((np.ones(len(part), bool), part, 0), (before, part - 1, 1), (wrap, np.full(len(part), len(cuts)), 1)):
                if keep.any():
                    rows = b.filter(pa.array(keep))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to[keep].astype(np.int32)), pa.array(np.full(rows.num_rows, turn, np.int32)), *rows.columns],
                        names=["part", "turn", "ord", "h", "doc_id", "text"])
    return ranged.mapInArrow(run, "part int, turn int, ord long, h long, doc_id long, text string").repartition(
        n, "part").sortWithinPartitions("part", "turn", "ord", "h")


def edited_likeness(docs: DataFrame, share: int = 4, seed: int = 7) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one
    row per row of ``docs``. The edited text has its last ``n_chars // share`` code points replaced by
    as many first ones (or all) of the next row by doc_id; the last row's next is the first. A null text is
    empty, a null doc_id comes first, rows of one doc_id are ordered by text hash."""
    dealt = _with_next(two_columns(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(seed)

        def out(rows):
            pairs = [k for k in range(len(rows) - 1) if rows[k][0] == rows[k + 1][0] and rows[k][1] == 0]
            own = walk.fingerprints([r[-1] for r in rows])
            edited = []
            for k in pairs:
                t, q = rows[k][-1], len(rows[k][-1]) // share
                edited.append(t[:len(t) - q] + rows[k + 1][-1][:q])
            changed = walk.fingerprints(edited)
            at = np.array(pairs, np.int64)
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array([rows[k][4] for k in pairs], pa.int64()),
                "n_chars": pa.array([len(rows[k][-1]) for k in pairs], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                "fingerprint": pa.array(written(own[at]), pa.string()),
                "edited_fingerprint": pa.array(written(changed), pa.string()),
                "near_edited": pa.array(likeness(own[at], changed), pa.float64()),
                "near_next": pa.array(likeness(own[at], own[at + 1]), pa.float64())})
        held: list = []
        for rows in _chunks(batches):
            yield out(held + rows)
            held = rows[-1:]
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")


def banding(threshold: float, recall: float = 0.99, most: int = 64) -> tuple[int, int]:
    """(bands, width): the widest bands of which at most ``most`` find a pair at ``threshold`` with the given chance."""
    for width in range(SLOTS // 4, 1, -1):
        agree = threshold ** width
        bands = 1 if agree >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-agree)) if agree > 1e-12 else most + 1
        if bands <= most:
            return bands, width
    return most, 1


def _forest(fp: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that join the rows of ``fp`` as all links between ``left`` and ``right`` rows would. A row is held only
    against rows not joined to it yet, so a bucket of near copies costs little more than one look at each."""
    group, links = np.arange(len(fp)), []
    for i in left:
        open_ = right[group[right] != group[i]]
        if len(open_):
            for j in open_[likeness(fp[open_], fp[i]) >= threshold]:
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    links.append((int(i), int(j)))
    return links


def near_links(marks: DataFrame, threshold: float = 0.8, bands: int | None = None, width: int | None = None, seed: int = 7,
               block: int = BUCKET_BLOCK) -> DataFrame:
    """(a, b): links between the different fingerprints of ``marks`` (fingerprint) that have the same components as all
    pairs at ``threshold`` or more that meet in a bucket. A bucket of more than ``block`` members is first held against its
    least one; the members that are not linked to it are held against all, in pairs of blocks, one pair to a
    group of rows. A bucket met through equal hashes of different bands adds comparisons and no links."""
    rule = banding(threshold)
    bands, width = bands or rule[0], width or rule[1]
    rng = np.random.default_rng(seed + 1)
    chosen = [sorted(rng.choice(SLOTS, width, replace=False).tolist()) for _ in range(bands)]
    distinct = stage(marks.select("fingerprint").distinct().withColumn("node", F.xxhash64("fingerprint")), "distinct")
    keys = F.array(*[F.xxhash64(F.lit(k), F.concat(*[F.substring("fingerprint", s + 1, 1) for s in c])) for k, c in enumerate(chosen)])
    # Only hashes travel until the buckets of one member are gone.
    probes = distinct.select("node", F.explode(keys).alias("bucket"))
    loads = probes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stage(probes.join(loads, "bucket").join(distinct, "node").select("bucket", "n", "fingerprint"), "members")
    same = F.expr("""aggregate(sequence(1, length(fingerprint)), struct(0 AS s, 0 AS n), (acc, i) -> struct(
        acc.s + IF(substring(fingerprint, i, 1) = substring(other, i, 1) AND substring(other, i, 1) <> '0', 1, 0) AS s,
        acc.n + IF(substring(fingerprint, i, 1) <> '0' OR substring(other, i, 1) <> '0', 1, 0) AS n))""")
    large = members.filter(F.col("n") > block)
    least = large.groupBy("bucket").agg(F.min("fingerprint").alias("other"))
    held = stage(large.join(least, "bucket").withColumn("v", same).withColumn(
        "near", (F.col("v.n") > 0) & (F.col("v.s") >= threshold * F.col("v.n"))), "held")
    to_least = held.filter("near AND fingerprint <> other").select(F.col("other").alias("a"), F.col("fingerprint").alias("b"))
    # The rest of a large bucket, in blocks, against all its blocks; the whole of a small one against itself.
    rest = held.filter("NOT near").groupBy("bucket").agg(F.count(F.lit(1)).alias("rest"))
    dealt = held.join(rest, "bucket").withColumns({
        "blocks": F.ceil(F.col("n") / block).cast("int"), "parts": F.ceil(F.col("rest") / block).cast("int"),
        "h": F.xxhash64("fingerprint", F.lit(seed))})
    rights = dealt.withColumn("y", F.pmod("h", "blocks").cast("int")).withColumn(
        "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("bucket", "x", "y", F.lit(1).alias("side"), "fingerprint")
    lefts = dealt.filter("NOT near").withColumn("x", F.pmod("h", "parts").cast("int")).withColumn(
        "y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", "x", "y", F.lit(0).alias("side"), "fingerprint")
    small = members.filter(F.col("n") <= block).select("bucket", F.lit(-1).alias("x"), F.lit(-1).alias("y"), F.lit(1).alias("side"), "fingerprint")
    digits = np.zeros(256, np.uint8)
    digits[np.frombuffer(b"0123456789abcdef", np.uint8)] = np.arange(16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(keys, sides, texts):
            fp = digits[np.frombuffer("".join(texts).encode(), np.uint8)].reshape(len(texts), SLOTS)
            side = np.array(sides)
            right = np.flatnonzero(side == 1)
            left = np.flatnonzero(side == 0) if keys[1] >= 0 else right
            return [(texts[i], texts[j]) for i, j in _forest(fp, left, right, threshold) if texts[i] != texts[j]]
        held_key, sides, texts = None, [], []
        for b in batches:
            out = []
            for *key, side, text in zip(*(b.column(k).to_pylist() for k in range(5))):
                if key != held_key:
                    if held_key is not None:
                        out += linked(held_key, sides, texts)
                    held_key, sides, texts = key, [], []
                sides.append(side)
                texts.append(text)
            yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in out], pa.string()), "b": pa.array([p[1] for p in out], pa.string())})
        if held_key is not None:
            out = linked(held_key, sides, texts)
            yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in out], pa.string()), "b": pa.array([p[1] for p in out], pa.string())})
    grouped = rights.union(lefts).union(small).repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return grouped.mapInArrow(run, "a string, b string").union(to_least).distinct()


def similar(docs: DataFrame, threshold: float = 0.8, bands: int | None = None, width: int | None = None, seed: int = 7,
            block: int = BUCKET_BLOCK) -> DataFrame:
    """(doc_id, group_id): groups of rows with like fingerprints, by bit-sampled banding. A band is a random choice
    of ``width`` slots; fingerprints equal on a band meet in a bucket, all of a bucket are verified at
    ``threshold`` (see ``near_links``), and groups follow the links. By default bands are as wide as a chance of 0.99 to find
    a pair at the threshold allows. Equal fingerprints are always one group; rows without doc_id belong to
    the group of their fingerprint."""
    marks = stage(fingerprints(docs, seed), "fingerprints")
    roots = components(near_links(marks, threshold, bands, width, seed, block))
    distinct = marks.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    named = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint"))
    ids = named.groupBy("root").agg(F.min("least").alias("group_id"))
    return marks.join(named.join(ids, "root").select("fingerprint", "group_id"), "fingerprint").select("doc_id", "group_id")
