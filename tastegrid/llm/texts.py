"""Helpers shared by the text operators: row keys, bounded slices of Arrow batches, and
numpy word segmentation by Unicode class."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.session import stage

# Characters of text that one step of a task holds as numpy arrays (a longer text is a step of its own).
SLICE_CHARS = 1 << 20
LETTER, NUMBER, OTHER, SPACE, END = 1, 2, 0, 3, 4


def hash_share(rows: DataFrame, h: Column, wanted: int, n: int) -> DataFrame:
    """About ``wanted`` of ``n`` rows, those of least hash share, at most twice as many: a bounded sample for
    fitting that no task has to gather and sort."""
    share = int(min(1.0, wanted / max(n, 1)) * (1 << 30))
    return rows.filter(F.pmod(h, F.lit(1 << 30)) < share).limit(2 * wanted)


def two_columns(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a unique long key, and the key's column name, one that ``docs`` does not hold.
    The key orders the rows by doc_id (nulls first) and, for rows of one doc_id, by text hash. Where
    doc_id is unique and never null it is the key itself and nothing moves; otherwise the rows
    are sorted and written once, as a generated key must not change when a task runs again."""
    key = "_row_key"
    while key in docs.columns:
        key += "_"
    n, known, most = docs.groupBy("doc_id").count().agg(
        F.sum("count"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("count"))), F.max("count")).first()
    if not n or (known == n and most == 1):
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ordered.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def key_free_select(keyed: DataFrame, key: str) -> DataFrame:
    """(_key, doc_id, text) of an ``identified`` table."""
    return keyed.select(F.col(key).alias("_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def slices(batches: Iterable[pa.RecordBatch], chars: int = SLICE_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) in slices of about ``chars`` characters; a null text is the empty text."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids.append(i)
                texts.append(t or "")
                size += len(texts[-1])
                if size >= chars:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def pieces(batch: pa.RecordBatch, column: int, size: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of about ``size`` bytes of text, one row at least."""
    total = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)))
    at = 0
    while at < batch.num_rows:
        till = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
        yield batch.slice(at, till - at)
        at = till


def unicode_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space, other."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(len(out)):
        k = kinds.get(unicodedata.category(chr(c))[0])
        if k:
            out[c] = k
    # The code points with the Unicode property White_Space.
    for a, b in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                 (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a:b + 1] = SPACE
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def span_sums(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint spans in order: each code is mixed with its place in the span before the sum, so that
    no pattern of the codes makes sums cancel as powers of one base do."""
    n = len(code)
    begin = np.zeros(n, np.int64)
    begin[starts] = starts
    place = np.arange(n) - np.maximum.accumulate(begin)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(code.astype(np.uint64) | (place.astype(np.uint64) << np.uint64(21))), out=total[1:])
    return mixed((total[ends] - total[starts]) ^ (ends - starts).astype(np.uint64))


class Words:
    """Words of a slice of texts: ``hashes`` (64 bits over the characters and their places), ``starts`` and
    ``ends`` in ``joined``, and ``first``: the number of words before each text."""

    def __init__(self, texts: list[str], classes: np.ndarray, join_space: bool, single_numbers: bool, keep_space: bool):
        self.joined = "\n".join(texts) + "\n"
        code = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1  # the separators
        cls = classes[code]
        cls[ends] = END
        nxt = np.append(cls[1:], END)
        start = np.ones(n, bool)
        start[1:] = cls[1:] != cls[:-1]
        start[1:] |= cls[1:] == END
        if single_numbers:
            start |= cls == NUMBER
        if join_space:
            last = np.flatnonzero((cls == SPACE) & (nxt != SPACE) & (nxt != END))
            start[last] = True
            start[last[code[last] == 32] + 1] = False
        self._contractions(code, cls, nxt, start)
        at = np.flatnonzero(start)
        till = np.append(at[1:], n)
        keep = cls[at] != END
        if not keep_space:
            keep &= cls[at] != SPACE
        self.starts, self.ends = at[keep], till[keep]
        self.first = np.searchsorted(self.starts, np.append(0, ends + 1))
        self.hashes = span_sums(code, self.starts, self.ends)

    @staticmethod
    def _contractions(code, cls, nxt, start) -> None:
        """'s 't 'm 'd 're 've 'll after an apostrophe that begins a word are words of their own."""
        at = np.flatnonzero((code == 39) & start & (nxt == LETTER))
        if not len(at):
            return
        pad = np.append(code, [0, 0]).astype(np.uint32)
        pad_cls = np.append(cls, [END, END])
        a, b = pad[at + 1], pad[at + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, size in ((at[one], 2), (at[two], 3)):
            start[hit + 1] = False
            after = hit + size
            after = after[after < len(start)]
            start[after[pad_cls[after] == LETTER]] = True

    def text(self, k: int) -> str:
        return self.joined[self.starts[k]:self.ends[k]]


class Memo:
    """A bounded table from word hash to a row of an append-only store, as sorted arrays."""

    def __init__(self, limit: int = 1_500_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.hashes, self.rows, self.n = np.empty(0, np.uint64), np.empty(0, np.int64), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.rows[at], -1)

    def add(self, h: np.ndarray) -> np.ndarray:
        """New rows for hashes not yet held."""
        rows = np.arange(self.n, self.n + len(h))
        self.n += len(h)
        order = np.argsort(h)
        at = np.searchsorted(self.hashes, h[order])
        self.hashes, self.rows = np.insert(self.hashes, at, h[order]), np.insert(self.rows, at, rows[order])
        return rows
