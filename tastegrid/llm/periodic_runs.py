"""Runs of repeated phrases inside a text, by uniting suffix classes in the order of descending common prefixes.

Suffixes of a text that share their first l words are a class, an interval of its suffix array. Taking the array's
neighbours by falling common prefix l (Kruskal's order) unites classes; each keeps its positions in order.
Two positions that become neighbours in the united class at a distance d of at most l are the two
halves of a square of period d, and no shorter period fits, as a position between them would have been united
before. Such seeds are extended to both sides to whole runs. A run of length L and period q has its
first square's seed at l = L - q, so common prefixes below the least such value cannot seed a wanted run:
texts that repeat no window of that many words hold no run at all, and sort no suffixes.

A text is handled whole in one task, with about 8 bytes per word and doubling step. Everything is compared by
exact word codes; hashes only choose which texts to look at (equal windows have equal hashes).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.texts import slices, two_columns

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def least_prefix(min_length: int, exponent: int) -> int:
    """The least common prefix that the first seed of a wanted run has, whatever its period."""
    return min(max(min_length - d, (exponent - 1) * d) for d in range(1, min_length + 1))


def repeats_inside(code: np.ndarray, owner: np.ndarray, texts: int, window: int) -> np.ndarray:
    """Which texts may hold some window of ``window`` words twice; none that does is left out."""
    h, size = code.astype(np.uint64) * MULTIPLIER, 1
    while size * 2 <= window and len(h) > size:
        a, b = h[:-size], h[size:]
        h = (a ^ (a >> np.uint64(29))) * MULTIPLIER + (b ^ (b >> np.uint64(31)))
        size *= 2
    out = np.zeros(texts, bool)
    if size * 2 <= window:
        return out
    own = owner[:len(h)]
    whole = own == owner[size - 1:]
    h, own = h[whole], own[whole]
    h = h ^ (own.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    out[own[order[1:][same]]] = True
    return out


def rank_levels(code: np.ndarray) -> list[np.ndarray]:
    """Ranks of the substrings of 1, 2, 4, ... units at every position, until all differ."""
    rank = np.unique(code, return_inverse=True)[1].astype(np.int64)
    levels, size, n = [rank], 1, len(code)
    while n and int(rank.max()) + 1 < n:
        follow = np.zeros(n, np.int64)
        follow[:-size] = rank[size:] + 1
        rank = np.unique(rank * (n + 1) + follow, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        size *= 2
    return levels


def common_after(levels: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many units agree from ``p`` and from ``q`` on."""
    n, a, b = len(levels[0]), p.copy(), q.copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(a, b) < n
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        a[same] += 1 << k
        b[same] += 1 << k
    return a - p


def common_before(levels: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many units agree before ``p`` and before ``q``."""
    a, b = p.copy(), q.copy()
    for k in range(len(levels) - 1, -1, -1):
        x, y = a - (1 << k), b - (1 << k)
        same = (np.minimum(x, y) >= 0) & (levels[k][np.maximum(x, 0)] == levels[k][np.maximum(y, 0)])
        a[same], b[same] = x[same], y[same]
    return p - a


def seeds(suffixes: np.ndarray, prefix: np.ndarray, floor: int, wanted: Callable[[int, int], bool]) -> tuple[list, list]:
    """(position, distance) of positions that become neighbours in a class. ``prefix[i]``: common units of
    suffixes i and i + 1 of the array. The union-find keeps each class by the ends of its interval."""
    edges = np.flatnonzero(prefix >= floor)
    edges = edges[np.argsort(-prefix[edges], kind="stable")]
    first_of: dict[int, int] = {}   # right end -> left end
    last_of: dict[int, int] = {}    # left end -> right end
    members: dict[int, list[int]] = {}  # left end -> positions in order
    at, by = [], []
    for i, shared in zip(edges.tolist(), prefix[edges].tolist()):
        left, right = first_of.pop(i, i), last_of.pop(i + 1, i + 1)
        a = members.pop(left, None) or [int(suffixes[i])]
        b = members.pop(i + 1, None) or [int(suffixes[i + 1])]
        if len(a) < len(b):
            a, b = b, a
        if len(b) * 8 > len(a):
            a = sorted(a + b)
        else:
            for p in b:
                insort(a, p)
        for p in b:
            k = bisect_left(a, p)
            if k and wanted(p - a[k - 1], shared):
                at.append(a[k - 1])
                by.append(p - a[k - 1])
            if k + 1 < len(a) and wanted(a[k + 1] - p, shared):
                at.append(p)
                by.append(a[k + 1] - p)
        last_of[left], first_of[right], members[left] = right, left, a
    return at, by


def runs_of(code: np.ndarray, min_length: int, exponent: int) -> np.ndarray:
    """Rows (start, length, period) by start and period. ``code``: word codes; texts side by side are parted by
    codes that occur once."""
    levels = rank_levels(code)
    n = len(code)
    if not n:
        return np.empty((0, 3), np.int64)
    suffixes = np.empty(n, np.int64)
    suffixes[levels[-1]] = np.arange(n)
    prefix = common_after(levels, suffixes[:-1], suffixes[1:])

    def wanted(distance: int, shared: int) -> bool:
        return shared >= (exponent - 1) * distance and shared + distance >= min_length
    at, by = seeds(suffixes, prefix, least_prefix(min_length, exponent), wanted)
    p, d = np.array(at, np.int64), np.array(by, np.int64)
    start = p - common_before(levels, p, p + d)
    length = p + d + common_after(levels, p, p + d) - start
    return np.unique(np.stack([start, length, d], axis=1), axis=0)[:, [0, 1, 2]]


def periodic_runs(docs: DataFrame, min_length: int = 24, exponent: int = 3,
                  rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) of every row: all stretches of consecutive words with smallest period q, as long
    as they go, of at least ``min_length`` words and ``exponent`` periods, as (start, length, period) by start and
    period, and the text's words without those that a run holds after its first period, joined by
    one space. ``rewrite`` may change the words of a row before.

    Words are parted by space and tab to carriage return. A null or blank text has no word, no run and an empty
    collapsed text; repeated rows and null ids stay as they are; other columns are not read."""
    if min_length < 2 or exponent < 2:
        raise ValueError("a run has two periods at least")
    window = least_prefix(min_length, exponent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
            if rewrite is not None:
                words = [rewrite(i, w) for i, w in zip(ids, words)]
            size = np.fromiter(map(len, words), np.int64, len(words))
            code = pd.factorize(np.array([w for x in words for w in x], object))[0].astype(np.int64) if size.sum() else np.empty(0, np.int64)
            owner = np.repeat(np.arange(len(words)), size)
            begin = np.cumsum(size) - size
            found: dict[int, np.ndarray] = {}
            look = np.flatnonzero(repeats_inside(code, owner, len(words), window))
            if len(look):
                # Codes of a text are its own, and each text ends in a code that occurs once.
                ends = np.cumsum(size[look] + 1)
                base = int(code.max()) + 1
                line = np.concatenate([np.append(code[begin[k]:begin[k] + size[k]] + j * base, -1 - j) for j, k in enumerate(look)])
                rows = runs_of(line, min_length, exponent)
                text = np.searchsorted(ends, rows[:, 0], "right")
                rows[:, 0] -= (ends - size[look] - 1)[text]
                cut = np.searchsorted(text, np.arange(len(look) + 1))
                found = {int(k): rows[a:b] for k, a, b in zip(look, cut[:-1], cut[1:]) if b > a}
            runs, collapsed = [], []
            for k, w in enumerate(words):
                rows = found.get(k)
                if rows is None:
                    runs.append([])
                else:
                    turn = np.zeros(len(w) + 1, np.int64)
                    np.add.at(turn, rows[:, 0] + rows[:, 2], 1)
                    np.add.at(turn, rows[:, 0] + rows[:, 1], -1)
                    w = [x for x, gone in zip(w, (np.cumsum(turn[:-1]) > 0).tolist()) if not gone]
                    runs.append([{"start": a, "length": b, "period": c} for a, b, c in rows.tolist()])
                collapsed.append(b" ".join(w).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(runs, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                 pa.array(collapsed, pa.string())], names=["doc_id", "runs", "collapsed"])
    return two_columns(docs).mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of ``periodic_runs``: the
    run of greatest length / period, compared as whole numbers (ties: least start, then period), and digests."""
    more = "r.length * best.period > best.length * r.period"
    best = F.expr(f"aggregate(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>), "
                  f"(best, r) -> CASE WHEN best IS NULL OR {more} THEN r ELSE best END)")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"),
                                                                   r.period.cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length DIV _best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
