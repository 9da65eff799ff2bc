"""Substring dedup with compressed FM-indexes.

Each shard of ``repeats`` gets an index over its segments: the Burrows-Wheeler transform of their words, kept in
a wavelet matrix of packed bits with sampled counts. The shard's segments are streamed against it by
backward search, all windows at once; a window leaves as soon as its interval holds only itself, and
those that reach ``width`` words have an interval of all places where the window stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tastegrid.llm.repeats import Units, covered, repeated_ranges, unsqueezed, with_ranges
from tastegrid.llm.texts import identified, key_free_select


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of an integer text by doubling, exact for the first ``depth`` symbols."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, done = len(text), 1
    order = np.argsort(rank, kind="stable")
    while done < depth:
        after = np.zeros(n, np.int64)
        after[:n - done] = rank[done:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(0, s[1:] != s[:-1]))
        rank = new
        done *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


class WaveletMatrix:
    """Counts of a symbol before a place, in one rank query per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        cur = symbols.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            bit = (cur >> b) & 1
            packed = np.packbits(np.append(bit.astype(np.uint8), np.zeros(64 + -len(bit) % 64, np.uint8)), bitorder="little").view("<u8")
            counts = np.append(0, np.cumsum(np.bitwise_count(packed).astype(np.int64))).astype(np.uint32)
            self.levels.append((packed, counts))
            self.zeros.append(len(bit) - int(bit.sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        # After the last level equal symbols stand together; where each begins.
        self.begin = np.zeros(sigma + 1, np.int64)
        cut = np.flatnonzero(np.append(True, cur[1:] != cur[:-1])) if len(cur) else np.empty(0, np.int64)
        self.begin[cur[cut]] = cut

    def before(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        i = place
        for k, (packed, counts) in enumerate(self.levels):
            word = i >> 6
            ones = counts[word].astype(np.int64) + np.bitwise_count(
                packed[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            bit = (symbol >> (self.bits - 1 - k)) & 1
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
        return i - self.begin[symbol]


class FMIndex:
    """Backward search over integer sequences, joined by separators."""

    def __init__(self, sequences: list[np.ndarray], depth: int):
        joined = np.concatenate([np.append(s, np.uint64(0)) for s in sequences])
        size = np.array([len(s) for s in sequences])
        ends = np.cumsum(size + 1) - 1
        alphabet, text = np.unique(joined, return_inverse=True)
        text = text.astype(np.int64) + 1
        text[ends] = 0
        self.text, self.first = text, ends - size
        self.sigma = len(alphabet) + 1
        self.order = sorted_suffixes(text, depth)
        self.wavelet = WaveletMatrix(text[self.order - 1], self.sigma)
        self.smaller = np.append(0, np.cumsum(np.bincount(text, minlength=self.sigma)))

    def intervals(self, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, low, high): of the patterns of ``width`` symbols at the given places, those that
        stand at two places or more, with their intervals in suffix order."""
        who = np.arange(len(start))
        c = self.text[start + width - 1]
        low, high = self.smaller[c], self.smaller[c + 1]
        for back in range(width - 2, -1, -1):
            on = high - low > 1
            who, low, high = who[on], low[on], high[on]
            c = self.text[start[who] + back]
            both = self.wavelet.before(np.concatenate([c, c]), np.concatenate([low, high]))
            low, high = self.smaller[c] + both[:len(c)], self.smaller[c] + both[len(c):]
        on = high - low > 1
        return who[on], low[on], high[on]


def later_windows(content: list[np.ndarray], windows: np.ndarray, keys: np.ndarray, starts: np.ndarray, width: int) -> list[np.ndarray]:
    """For each segment, which of its windows also stand earlier in the shard, by key and place."""
    index = FMIndex(content, width)
    owner = np.repeat(np.arange(len(windows)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = index.first[owner] + inside
    out = np.zeros(len(owner), bool)
    which, low, high = index.intervals(begin, width)
    if len(which):
        # Order of all places by (key, position); places that begin no window come last.
        turn = np.full(len(index.text), np.iinfo(np.int64).max)
        turn[begin[np.lexsort((starts[owner] + inside, keys[owner]))]] = np.arange(len(begin))
        in_order = turn[index.order]
        lows, at = np.unique(low, return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[at] = high
        cuts = np.column_stack([lows, highs]).ravel()
        if cuts[-1] == len(in_order):
            in_order = np.append(in_order, np.iinfo(np.int64).max)
        first = np.minimum.reduceat(in_order, cuts)[::2]
        mine = turn[begin[which]]
        # Places of one (key, position) in two segments of the shard are the same window.
        home_key, home_at = keys[owner], starts[owner] + inside
        by_turn = np.empty(len(begin), np.int64)
        by_turn[turn[begin]] = np.arange(len(begin))
        f = by_turn[first[at]]
        out[which] = (mine > first[at]) & ((home_key[f] != home_key[which]) | (home_at[f] != home_at[which]))
    return np.split(out, np.cumsum(windows)[:-1])


def repeated_words(docs: DataFrame, width: int = 20, gram: int = 5) -> DataFrame:
    """(key, start, end) over the words of ``docs`` (_key, doc_id, text): ranges covered by windows
    that also start earlier."""
    return repeated_ranges(docs, True, width, gram, later_windows, first_stays=True)


def substring_dedup(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per row of ``docs``. A word goes if a window of ``width``
    words covers it that also starts earlier, by doc_id and place; what stays is judged on the input. A null text
    has no words, and neither it nor a text shorter than a window loses any. A null doc_id comes first;
    rows of one doc_id follow each other by text hash, as documents of their own."""
    docs = key_free_select(*identified(docs))
    joined = with_ranges(docs, repeated_words(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, gone, digest = [], [], [], []
            for doc_id, text, ranges in zip(batch.column(1).to_pylist(), unsqueezed(batch.column(2)), batch.column(3).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                out = covered(len(words), ranges)
                kept = words if not ranges else [w for w, g in zip(words, out.tolist()) if not g]
                ids.append(doc_id)
                n.append(len(words))
                gone.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n, pa.int64()),
                                              "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def repeated_passages(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, first_word, n_words, passage): the removed passages themselves, merged."""
    docs = key_free_select(*identified(docs))
    joined = with_ranges(docs, repeated_words(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, ranges in zip(batch.column(1).to_pylist(), unsqueezed(batch.column(2)), batch.column(3).to_pylist()):
                if not ranges:
                    continue
                u = Units([text], True)
                edge = np.diff(covered(len(u.starts), ranges).astype(np.int8), prepend=0, append=0)
                for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                    raw = u.coded[0][u.starts[a]:u.ends[b - 1]]
                    rows.append((doc_id, a, b - a, raw.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([r[0] for r in rows], pa.int64()), "first_word": pa.array([r[1] for r in rows], pa.int64()),
                "n_words": pa.array([r[2] for r in rows], pa.int64()), "passage": pa.array([r[3] for r in rows], pa.string())})
    return joined.mapInArrow(run, "doc_id long, first_word long, n_words long, passage string")
