"""Substring dedup with suffix arrays by external induced sorting.

Each shard of ``repeats`` sorts the suffixes of its segments. The suffixes that begin a descent
(left-most S) are named by their substrings and sorted recursively on the names; from their order all others
follow: a queue by first symbol hands out suffix tuples in order and takes in the tuples of the suffixes one place to
the left, first upwards, then downwards. The queue holds positions in arrays up to a budget and beyond it in
files, read back in order. The shard's text, types and order stay in memory, which the bound on a shard's segments
keeps small. Neighbours of the finished order are compared afterwards, in steps of eight bytes up to the width that decides
and once for each run of places whose neighbours follow each other too.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.repeats import covered, merged, repeated_ranges, unsqueezed_bytes, with_ranges
from tastegrid.llm.texts import identified, key_free_select

QUEUE_BYTES = 96 << 20
# Segments of one shard: about 1.7 MB of text, whose arrays take about 150 MB in the task.
SHARD = 6_000


class DiskQueue:
    """A priority queue of positions by a small integer priority; equal priorities keep their order. Over
    ``budget`` bytes the largest priorities' arrays go to files in the task's temporary folder."""

    def __init__(self, budget: int = QUEUE_BYTES):
        self.budget, self.held, self.folder = budget, 0, None
        self.arrays: dict[int, list[np.ndarray]] = {}
        self.files: dict[int, str] = {}

    def push(self, priority: np.ndarray, items: np.ndarray) -> None:
        if not len(items):
            return
        order = np.argsort(priority, kind="stable")
        priority, items = priority[order], items[order]
        cut = np.flatnonzero(np.append(True, priority[1:] != priority[:-1]))
        for p, part in zip(priority[cut].tolist(), np.split(items, cut[1:])):
            self.arrays.setdefault(p, []).append(part)
            self.held += part.nbytes
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="induced-")
        for p in list(self.arrays):
            path = self.files.setdefault(p, os.path.join(self.folder.name, str(p)))
            with open(path, "ab") as f:
                for a in self.arrays[p]:
                    a.tofile(f)
            del self.arrays[p]
        self.held = 0

    def pop(self, priority: int, dtype=np.int64) -> np.ndarray:
        """All items of one priority, in the order they came."""
        parts = []
        path = self.files.pop(priority, None)
        if path:
            parts.append(np.fromfile(path, dtype))
            os.unlink(path)
        for a in self.arrays.pop(priority, []):
            parts.append(a)
            self.held -= a.nbytes
        return np.concatenate(parts) if parts else np.empty(0, dtype)

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for S: smaller than the suffix to its right. The last is S by the end mark after it."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
    step[-1] = -1
    known = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(known[::-1])[::-1]
    return step[nearest] > 0


def _refined(rank: np.ndarray, some: np.ndarray, order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """New ranks of the places ``some``, which are whole groups of equal rank: ``order`` sorts them by rank and then by what
    tells equal ones apart, ``new`` tells where another value begins in it. A rank counts the lower places."""
    r = rank[some[order]]
    at = np.arange(len(some))
    head = np.append(True, r[1:] != r[:-1])
    out = np.empty(len(some), np.int64)
    out[order] = r + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
    return out


def _doubled(names: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of the names that stand at ``lms``; the last levels of the recursion, where names are
    too many for a queue by symbol. Each round joins two ranks, or three where they fit a number, and looks only at names still
    equal that cover less than ``depth`` bytes. Exact for at least those."""
    n, rank, done = len(names), names.copy(), 1
    base = n + 1
    fold = 3 if base < 1 << 21 else 2
    while True:
        covers = np.full(n, depth)
        covers[:n - done] = lms[done:] - lms[:n - done]
        some = np.flatnonzero((np.bincount(rank, minlength=n)[rank] > 1) & (covers < depth))
        if not len(some):
            return rank
        key = rank[some]
        after = np.append(rank + 1, 0)
        for k in range(1, fold):
            key = key * base + after[np.minimum(some + k * done, n)]
        order = np.argsort(key)
        s = key[order]
        rank[some] = _refined(rank, some, order, np.append(True, s[1:] != s[:-1]))
        done *= fold
        if done >= n:
            return rank


def _words8(text: np.ndarray) -> np.ndarray:
    """For each place the next eight symbols as one number, high first; symbols must be bytes."""
    pad = np.append(text.astype(np.uint8), np.zeros(8, np.uint8))
    return np.ndarray(len(text), ">u8", pad, strides=(1,)).astype(np.uint64)


def _name(text: np.ndarray, eight: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names, in order, of the substrings from each left-most S place to the next one: how many are lower. They are told apart
    eight bytes at a time among those still equal. A substring that ends where another goes on is the larger one, as the
    other falls there; the one that the text's end closes is the smallest."""
    size = np.diff(np.append(lms, len(text))) + 1
    name, offset, some = np.zeros(len(lms), np.int64), 0, np.arange(len(lms))
    while len(some):
        left = size[some] - offset
        keep = np.clip(left, 0, 8)
        at = lms[some] + offset
        part = np.where((at < len(text)) & (keep > 0), eight[np.minimum(at, len(text) - 1)], np.uint64(0))
        # What lies behind the end is filled with ones.
        part |= np.where(keep == 8, np.uint64(0), ~np.uint64(0) >> (8 * np.minimum(keep, 7)).astype(np.uint64))
        rest = 8 - keep
        if some[-1] == len(lms) - 1 and offset < size[-1] <= offset + 8:
            rest[-1] = -1
        first = name[some]
        order = np.argsort(part) if not offset else np.lexsort((rest, part, first))
        a, b, c = first[order], part[order], rest[order]
        if not offset and ((b[1:] == b[:-1]) & (c[1:] != c[:-1])).any():
            order = np.lexsort((rest, part))
            b, c = part[order], rest[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]))
        name[some] = _refined(name, some, order, new)
        offset += 8
        # Whole groups of equal names, all of them as long as this or longer.
        some = np.flatnonzero((size >= offset) & (np.bincount(name, minlength=len(name))[name] > 1))
        if not (size[some] > offset).any():
            break
    return name


def induced_suffix_array(text: np.ndarray, depth: int, budget: int = QUEUE_BYTES) -> np.ndarray:
    """Suffix order of a byte text, exact for at least the first ``depth`` bytes."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    is_s = suffix_types(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms):
        rank = _doubled(_name(text, _words8(text), lms), lms, depth)
        lms = lms[np.argsort(rank * len(lms) + np.arange(len(lms)))]
    lms_at = np.searchsorted(text[lms], np.arange(257)) if len(lms) else np.zeros(257, np.int64)
    size = np.bincount(text, minlength=256)
    begin = np.append(0, np.cumsum(size))
    out = np.empty(n, np.int64)
    l_size = np.zeros(256, np.int64)
    symbol = text.astype(np.int16)

    def left_of(items: np.ndarray, s_type: bool) -> tuple[np.ndarray, np.ndarray]:
        before = items[items > 0] - 1
        before = before[is_s[before] == s_type]
        return symbol[before], before

    up = DiskQueue(budget)
    # The last suffix is of type L and the least of its symbol's.
    up.push(symbol[n - 1:n], np.array([n - 1]))
    for c in range(256):
        items, at = up.pop(c), begin[c]
        while len(items):
            out[at:at + len(items)] = items
            at += len(items)
            d, before = left_of(items, False)
            same = d == c
            up.push(d[~same], before[~same])
            items = before[same]
        l_size[c] = at - begin[c]
        stars = lms[lms_at[c]:lms_at[c + 1]]
        up.push(*left_of(stars, False))
    up.close()
    down = DiskQueue(budget)
    for c in range(255, -1, -1):
        items, at = down.pop(c), begin[c + 1]
        while len(items):
            out[at - len(items):at] = items[::-1]
            at -= len(items)
            d, before = left_of(items, True)
            same = d == c
            down.push(d[~same], before[~same])
            items = before[same]
        down.push(*left_of(out[begin[c]:begin[c] + l_size[c]][::-1], True))
    down.close()
    return out


def common_prefix(text: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """For each suffix in order, whether it shares ``width`` bytes with the one before. Where two neighbouring places
    have neighbouring predecessors, the first shares one byte more than the second, if their own bytes are equal: prefixes are counted
    only for the last place of such a chain."""
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    chained = before[1:] == before[:-1] + 1
    ends = np.flatnonzero(np.append(~chained, True) & (before >= 0))
    eight, bounds = _words8(text), np.uint64(1) << np.arange(0, 64, 8, np.uint64)
    size = np.zeros(len(ends), np.int64)
    room = n - np.maximum(ends, before[ends])
    live = np.arange(len(ends))
    for k in range(0, width, 8):
        live = live[room[live] > k]
        a, b = ends[live] + k, before[ends[live]] + k
        equal = 8 - np.searchsorted(bounds, eight[a] ^ eight[b], "right")
        size[live] = k + equal
        live = live[equal == 8]
    # From each place on, the first that differs from its predecessor's, or the chain's end.
    place = np.arange(n)
    till = np.where(text == text[before], n, place)
    till[ends], till[order[0]] = ends, order[0]
    till = np.minimum.accumulate(till[::-1])[::-1]
    more = np.zeros(n, np.int64)
    more[ends] = np.minimum(size, room)
    return (till + more[till] - place >= width)[order]


def shared_windows(content: list[np.ndarray], windows: np.ndarray, keys: np.ndarray, starts: np.ndarray, width: int,
                   budget: int = QUEUE_BYTES, later: bool = False) -> list[np.ndarray]:
    """For each segment, which of its windows also stand elsewhere in the shard, or with ``later``,
    elsewhere before it by key and place. Places that begin no window do not count."""
    size = np.array([len(c) for c in content])
    text = np.concatenate(content)
    order = induced_suffix_array(text, width, budget)
    owner = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    begins = (np.arange(len(text)) - first[owner]) < windows[owner]
    # Only beginnings of windows are held against each other; between two of them the chain must not break.
    shares = common_prefix(text, order, width)
    mark = begins[order]
    place = order[mark]
    group = np.cumsum(~shares)[mark]
    cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    # Two places of one (key, position), from two segments of the shard, are one window.
    at = np.unique(keys, return_inverse=True)[1].astype(np.int64)[owner[place]] << 32 | starts[owner[place]] + place - first[owner[place]]
    least = np.repeat(np.minimum.reduceat(at, cut), np.diff(np.append(cut, len(at))))
    hit = np.zeros(len(text), bool)
    if later:  # not the first of each group, in any segment that holds it
        hit[place] = at != least
    else:
        hit[place] = np.repeat(np.maximum.reduceat(at, cut), np.diff(np.append(cut, len(at)))) != least
    return [h[:w] for h, w in zip(np.split(hit, np.cumsum(size)[:-1]), windows)]


def repeated_bytes(docs: DataFrame, width: int = 200, gram: int = 40, first_stays: bool = False) -> DataFrame:
    """(key, start, end) over the bytes of ``docs`` (_key, doc_id, text): ranges covered by strings of ``width`` bytes
    that start anywhere else too, or with ``first_stays`` earlier."""
    match = partial(shared_windows, later=True) if first_stays else shared_windows
    return repeated_ranges(docs, False, width, gram, match, first_stays, SHARD)


def suffix_dedup(docs: DataFrame, width: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of ``docs``. A byte goes if a string of
    ``width`` bytes covers it that starts anywhere else too. A null text is empty; a text shorter than
    ``width`` loses nothing; rows of one doc_id, repeated ones too, are documents of their own."""
    docs = key_free_select(*identified(docs))
    joined = with_ranges(docs, repeated_bytes(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, spans, digest = [], [], [], []
            first, start, end = (x.tolist() for x in merged(batch.column(3)))
            for k, raw in enumerate(unsqueezed_bytes(batch.column(2))):
                begins, ends = start[first[k]:first[k + 1]], end[first[k]:first[k + 1]]
                n.append(len(raw))
                gone.append(sum(ends) - sum(begins))
                spans.append(len(begins))
                digest.append(hashlib.sha256(b"".join(raw[a:b] for a, b in zip([0, *ends], [*begins, len(raw)]))).hexdigest())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(1), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, width: int = 200) -> DataFrame:
    """``docs`` with the repeated bytes cut from their texts, all other columns and all rows kept: of equal strings
    of ``width`` bytes the first by doc_id and place stays. Cuts are drawn in to whole characters; n_chars, where
    the table has it, follows. A null text stays null."""
    keyed, key = identified(docs)
    ranges = repeated_bytes(key_free_select(keyed, key), width, first_stays=True)
    lists = ranges.distinct().groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("start", "end")).alias("_ranges"))
    joined = keyed.join(lists, key, "left").select(*docs.columns, F.col("_ranges").alias("_cut_ranges"))
    at, kind = docs.columns.index("text"), docs.schema["text"].dataType.simpleString()

    def cut(text, ranges):
        raw = text.encode("utf-8", "surrogatepass")
        out = covered(len(raw), ranges)
        inner = (np.frombuffer(raw, np.uint8) & 0xC0) == 0x80  # bytes inside a character
        lead = np.flatnonzero(~inner)
        whole = np.logical_and.reduceat(out, lead) if len(lead) else out
        gone = np.repeat(whole, np.diff(np.append(lead, len(raw))))
        return np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if r is None or t is None else cut(t, r)
                     for t, r in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])
    out = joined.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns and kind == "string":
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
