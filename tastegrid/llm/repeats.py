"""Where long passages repeat across a corpus: shards in which equal windows meet.

A window is ``width`` consecutive units (words or bytes) of one document. Its anchor is the least hash of
the ``gram``-unit runs inside it, so equal windows have equal anchors wherever they stand. Consecutive
windows with one anchor position form a segment. Only segments whose anchor occurs again can hold
a repeated window. Segments equal as a whole are settled by their hash; one copy of each that shares
its anchor with different segments is sent, with its content, to the shard of its anchor, where an
index over the shard's segments finds the windows they have in common. The windows of an anchor with too many different
segments for one shard are settled one by one as equal segments are: counted by their hashes, of 128 bits, before the
shuffle, and without content, so that a passage in any number of contexts gathers in no task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.texts import SLICE_CHARS, mixed, pieces, slices, span_sums
from tastegrid.session import stage

# Segments of one shard, and of one anchor before its windows are dealt singly.
SHARD = 20_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
# Characters that a scan holds as numbers at once, so that its arrays stay in the processor's cache.
STEP = 1 << 16
MIXED = mixed(np.arange(256, dtype=np.uint8))
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True  # fixed values: the bytes that part words


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of ``base``, modulo 2 ** 64."""
    out = np.full(n, base)
    out[:1] = 1
    return np.cumprod(out, out=out)


POWERS, INVERSES = powers(BASE, 2 * STEP), powers(INVERSE, 2 * STEP)


class Hashes:
    """64-bit hashes of any span of a sequence of values, from running sums. Sums of powers cancel on patterned
    sequences, so longer spans are hashed over the mixed hashes of the short runs in them (``run_hashes``)."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        few = n < len(POWERS)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * (POWERS[:n] if few else powers(BASE, n)), out=self.total[1:])
        self.inverse = INVERSES if few else powers(INVERSE, n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._mixed((self.total[end] - self.total[start]) * self.inverse[start], (end - start).astype(np.uint64))

    def runs(self, size: int) -> np.ndarray:
        """The hashes of all spans of ``size`` values, by start."""
        n = len(self.total) - size
        return self._mixed((self.total[size:] - self.total[:n]) * self.inverse[:n], np.uint64(size))

    @staticmethod
    def _mixed(h: np.ndarray, size: np.ndarray | np.uint64) -> np.ndarray:
        factor = np.array(0xD6E8FEB86659FD93, np.uint64)
        h ^= size * factor
        h ^= h >> np.uint64(32)
        h *= factor
        return h ^ (h >> np.uint64(29))


def run_hashes(values: np.ndarray, gram: int) -> tuple[np.ndarray, Hashes]:
    """The hashes of all runs of ``gram`` values, and hashes of spans of such runs: a span of n values is one
    of n - gram + 1 runs."""
    runs = Hashes(values).runs(gram)
    return runs, Hashes(mixed(runs))


class Units:
    """The units of a slice of texts: ``values`` (64 bits each), ``raw`` (what a shard gets of them) and
    ``first``, the number of units before each text. For words also their byte spans."""

    def __init__(self, texts: list[str] | list[bytes], words: bool):
        self.coded = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
        size = np.fromiter(map(len, self.coded), np.int64, len(texts))
        if not words:
            self.raw = np.frombuffer(b"".join(self.coded), np.uint8)
            self.first = np.append(0, np.cumsum(size))
            return
        flat = np.frombuffer(b" ".join([*self.coded, b""]), np.uint8)
        begins = np.append(0, np.cumsum(size + 1))
        inside = ~BLANK[flat]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.raw = span_sums(flat, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, begins)
        self.begins = begins

    @property
    def values(self) -> np.ndarray:
        return MIXED[self.raw] if self.raw.dtype == np.uint8 else self.raw


def segments(units: Units, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor, segment hash) of all segments of the slice; starts count
    units from the beginning of the slice."""
    n = len(units.raw)
    if n < width:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + tuple(np.empty(0, np.uint64) for _ in range(2))
    g, spans = run_hashes(units.values, gram)
    low = np.uint64((1 << 21) - 1)
    least = (g & ~low) | (np.arange(len(g), dtype=np.uint64) & low)  # equal hashes: the leftmost
    reach, need = 1, width - gram + 1
    while reach < need:
        step = min(reach, need - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    # A segment ends where the anchor changes, at a text's end and behind its last window.
    begins, ends = units.first[:-1], units.first[1:]
    new = np.append(True, least[1:] != least[:-1])
    for edge in (begins, np.maximum(ends - width + 1, begins)):
        new[edge[edge < len(new)]] = True
    cut = np.flatnonzero(new)
    windows = np.diff(np.append(cut, len(new)))
    text = np.searchsorted(units.first, cut, "right") - 1
    keep = cut + width <= ends[text]
    text, cut, windows = text[keep], cut[keep], windows[keep]
    place = cut + (((least[cut] & low).astype(np.int64) - cut) & int(low))
    return text, cut, windows, g[place], spans.spans(cut, cut + windows + width - gram)


def _segment_rows(docs: DataFrame, words: bool, width: int, gram: int) -> DataFrame:
    """(key, start, windows, anchor, seg) with the segments of each document as arrays. Texts are scanned once, and
    what is found is written."""
    def scan(keys: list, texts: list[str]) -> pa.RecordBatch:
        u = Units(texts, words)
        text, start, windows, anchor, seg = segments(u, width, gram)
        cut = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(
            pa.ListArray.from_arrays(cut, pa.array(x)) for x in
            ((start - u.first[text]).astype(np.int32), windows.astype(np.int32), anchor.view(np.int64), seg.view(np.int64)))],
            names=["key", "start", "windows", "anchor", "seg"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for keys, texts in slices(batches, STEP):
            held.append(scan(keys, texts))
            size += sum(map(len, texts))
            if size >= SLICE_CHARS:
                yield pa.concat_batches(held)
                held, size = [], 0
        if held:
            yield pa.concat_batches(held)
    return stage(docs.select("_key", "text").mapInArrow(
        run, "key long, start array<int>, windows array<int>, anchor array<long>, seg array<long>"), "scanned")


def squeezed(docs: DataFrame) -> DataFrame:
    """(_key, doc_id, text) with texts compressed one by one, for joins that move all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in pieces(batch, 2, 1 << 22):
                texts = [None if t is None else press(t.encode("utf-8", "surrogatepass")) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary())], names=["_key", "doc_id", "text"])
    return docs.select("_key", F.col("_key").alias("doc_id") if "doc_id" not in docs.columns else "doc_id", "text").mapInArrow(
        run, "_key long, doc_id long, text binary")


def unsqueezed_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 of the texts of a ``squeezed`` column; a null text is the empty text."""
    open_ = zstandard.ZstdDecompressor().decompress
    return [b"" if t is None else open_(t) for t in column.to_pylist()]


def unsqueezed(column: pa.Array) -> list[str]:
    """The texts of a ``squeezed`` column; a null text is the empty text."""
    return [t.decode("utf-8", "surrogatepass") for t in unsqueezed_bytes(column)]


Matcher = Callable[[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, int], list[np.ndarray]]


def repeated_ranges(docs: DataFrame, words: bool, width: int, gram: int, match: Matcher, first_stays: bool,
                    shard: int = SHARD) -> DataFrame:
    """(key, start, end): ranges of units covered by repeated windows; ranges may overlap. ``docs``:
    (_key, text), keys unique. With ``first_stays`` the first window of equal ones, by key and place, is not repeated.
    ``match(segments, windows, keys, starts, width)`` tells the repeated windows of each segment of a shard."""
    spark = docs.sparkSession
    scanned = _segment_rows(docs, words, width, gram)
    rows = scanned.select("key", F.inline(F.arrays_zip("start", "windows", "anchor", "seg")))
    # Written before they are joined: Spark splits a hot anchor's rows only between two plain shuffles.
    again = stage(scanned.select(F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "anchors")
    flagged = stage(rows.join(again, "anchor"), "segments")
    place = F.struct("key", "start")
    kinds = stage(flagged.groupBy("anchor", "seg").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n"),
                                                       F.first("windows").alias("windows")), "kinds")
    crowd = stage(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("d")).filter("d > 1"), "crowds")
    sent = stage(kinds.join(crowd, "anchor").select("anchor", "d", F.col("at.key").alias("key"), F.col("at.start").alias("start"), "windows"), "sent")
    few, many = F.col("d") <= shard, F.col("d") > shard
    shards = max(1, -(-sent.filter(few).count() // shard))
    same = flagged.join(kinds.filter("n > 1").select("anchor", "seg", "at"), ["anchor", "seg"])
    if first_stays:
        same = same.filter(place != F.col("at"))
    settled = same.select("key", "start", (F.col("start") + F.col("windows") + (width - 1)).alias("end"))

    def named(part):
        wanted = sent.filter(part).groupBy("key").agg(F.collect_list(F.struct("start", "windows", "anchor")).alias("parts"))
        return squeezed(docs).select(F.col("_key").alias("key"), "text").join(wanted, "key").select("key", "text", "parts")

    def contents(batches: Iterator[pa.RecordBatch]):
        """(anchor, key, start, windows, units) of every segment wanted."""
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                u = Units(unsqueezed_bytes(part.column(1)), words)
                offsets = part.column(2).offsets.to_numpy()
                flat = part.column(2).flatten()
                lists = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(3)]
                for k, key in enumerate(part.column(0).to_pylist()):
                    span = slice(offsets[k] - offsets[0], offsets[k + 1] - offsets[0])
                    for start, n, anchor in zip(*(x[span].tolist() for x in lists)):
                        yield anchor, key, start, n, u.raw[u.first[k] + start:u.first[k] + start + n + width - 1]

    def window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=["h", "h2", "key", "start"])
        held, size = [], 0
        for anchor, key, start, n, units in contents(batches):
            own = np.arange(n)
            h, h2 = (run_hashes(mixed(units ^ units.dtype.type(salt)), gram)[1].spans(own, own + width - gram + 1).view(np.int64)
                     for salt in (0, 0x5A))
            held.append((h, h2 ^ anchor, np.full(n, key, np.int64), (start + own).astype(np.int32)))
            size += n
            if size > 1 << 17:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_pydict({
                "anchor": pa.array([r[0] for r in rows], pa.int64()), "key": pa.array([r[1] for r in rows], pa.int64()),
                "start": pa.array([r[2] for r in rows], pa.int32()), "windows": pa.array([r[3] for r in rows], pa.int32()),
                "content": pa.array([r[4] for r in rows], pa.binary())})
        held, size = [], 0
        for *row, units in contents(batches):
            held.append((*row, units.tobytes()))
            size += len(held[-1][4])
            if size > 1 << 22:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)
    dealt = (named(few).mapInArrow(fetch, "anchor long, key long, start int, windows int, content binary")
             .select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard"), "key", "start", "windows", "content")
             .repartition("shard").sortWithinPartitions("shard"))
    kind = np.uint64 if words else np.uint8

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(held):
            keys, starts, windows = (np.array(x) for x in held[:3])
            content = [np.frombuffer(c, kind) for c in held[3]]
            found = match(content, windows, keys, starts, width)
            size = windows
            hit = np.concatenate([*found, np.empty(0, bool)])
            owner = np.repeat(np.arange(len(size)), size)
            inside = np.arange(len(hit)) - np.repeat(np.cumsum(size) - size, size)
            edge = np.ones(len(hit), bool)
            edge[1:] = (owner[1:] != owner[:-1]) | (hit[1:] != hit[:-1])
            cut = np.flatnonzero(edge)
            till = np.append(cut[1:], len(hit))
            cut, till = cut[hit[cut]], till[hit[cut]]
            who = owner[cut]
            begin = starts[who] + inside[cut]
            return pa.RecordBatch.from_pydict({"key": pa.array(keys[who].astype(np.int64)), "start": pa.array(begin.astype(np.int32)),
                                               "end": pa.array((begin + (till - cut) + width - 1).astype(np.int32))})
        held, now = ([], [], [], []), None
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(5)]
            for row in zip(*cols):
                if row[0] != now and now is not None:
                    yield one(held)
                    held = ([], [], [], [])
                now = row[0]
                for x, v in zip(held, row[1:]):
                    x.append(v)
        if now is not None:
            yield one(held)
    found = settled.union(dealt.mapInArrow(find, "key long, start int, end int"))
    if not crowd.filter(many).limit(1).count():
        return found
    single = stage(named(many).mapInArrow(window_hashes, "h long, h2 long, key long, start int").distinct(), "windows")
    first = stage(single.groupBy("h", "h2").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    hit = single.join(first, ["h", "h2"])
    if first_stays:
        hit = hit.filter(place != F.col("at"))
    return found.union(hit.select("key", "start", (F.col("start") + width).alias("end")))


def covered(n: int, ranges: list[dict] | None) -> np.ndarray:
    """Which of n units some range covers."""
    turn = np.zeros(n + 1, np.int64)
    for r in ranges or []:
        turn[r["start"]] += 1
        turn[r["end"]] -= 1
    return np.cumsum(turn[:-1]) > 0


def merged(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, start, end) of a column of lists of ranges: row k's ranges in order, those that touch or overlap as one,
    are ``first[k]`` to ``first[k + 1]``; a null list is empty."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, row = column.flatten(), np.repeat(np.arange(len(size)) << 32, size)
    start, end = (row + flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    apart = start[1:] > end[:-1]
    start, end = start[np.append(True, apart)[:len(start)]], end[np.append(apart, True)[:len(end)]]
    return np.searchsorted(start, np.arange(len(size) + 1) << 32), start & 0xFFFFFFFF, end & 0xFFFFFFFF


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(_key, doc_id, text, ranges) of every document, its text ``squeezed``; ranges that touch or overlap are merged per
    document in the task that reads them, and so are the few that come twice, once by hash and once from a shard."""
    lists = ranges.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    return squeezed(docs).join(lists.withColumnRenamed("key", "_key"), "_key", "left").select("_key", "doc_id", "text", "ranges")
