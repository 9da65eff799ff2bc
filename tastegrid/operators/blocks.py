"""Blocked pair computations: similarities, neighbour votes and top-N without a pair table.

Some results compare every left id with every right id that shares a key with it (two
users rating the same item, a user profile and an item text sharing a token). Joining on
the key would ship one row per pair, and a key holding a third of all rows would make
that quadratic. Here both sides are cut into blocks of bounded size; Spark routes each
row to the block pairs that need it, sorts each block pair by key, and a task streams
through it, holding only block × block accumulators. Only reduced results leave a task:
finished similarities, predictions for requested pairs, or the best n per id and block.

Similarities (``gram``) route the rows of each key, packed as arrays never longer than a block, at most once per
opposite block, and only to blocks that hold the key. Votes and top-N, whose universes meet in every block pair,
shuffle each side once: a block becomes one row, and the rows of both sides meet in a Cartesian product that reads
them where they were written. A task holds a few blocks of the side that is ranked, lets many blocks of the other side
pass, and keeps the best n of each id, so only these are shuffled again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.operators.passing import crossed
from tastegrid.session import stage

BLOCK = 2048           # ids per block: bounds the accumulators in a task
VOTE_BLOCK = 1024      # smaller where a pair may hold up to k neighbours
PAIR_CHUNK = 1 << 21   # pairs expanded at a time inside a task
HEAVY = 32             # a key reaching 1/32 of a block pair's cells is added as a matrix product
SPARSE = 32            # where sharing a key is so rare among all pairs, pairs are joined on their keys
COLUMNS = 128          # such keys per matrix product

L_UNIVERSE, R_UNIVERSE, MASK, L_ENTRY, R_ENTRY = range(5)
ROWS_AT_ONCE = 1 << 20  # unpacked rows a task looks at together
ENTRIES = 1 << 20      # entries of a packed block, unless one id has more
# A null id takes the first slot of its block, as id -1 without entries, and the last id of that block is not ranked: kept
# as it was before blocks were packed (REPLY_r03.md).
NULL = -(1 << 63)
SLACK = 1e-7           # scores are rounded to 8 digits
HELD, STREAM = 8, 256  # packed blocks that a task holds, and blocks of the other side that pass them


def _number(ids: DataFrame, total: int, size: int) -> int:
    """Enough blocks to bound a task, and for small inputs enough to use the cores."""
    cores = ids.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(total / size), min(math.isqrt(4 * cores), math.ceil(total / 256)))


class Blocked:
    """Ids spread evenly over ``n`` blocks: (id, block, slot in block). The ids are written
    once, unless ``kept`` says they are, as counting and every placement read them."""

    def __init__(self, ids: DataFrame, col: str, size: int = BLOCK, kept: bool = False):
        ids = ids.select(col) if kept else stage(ids.select(col), "ids")
        total = ids.count()
        self.total, self.n = total, _number(ids, total, size)
        spread = ids.withColumn("block", F.pmod(F.xxhash64(col), F.lit(self.n)).cast("int"))
        w = Window.partitionBy("block").orderBy(col)  # at most about `size` ids per block
        self.table = spread.withColumn("slot", F.row_number().over(w) - 1)
        self.col = col
        mean = total / self.n
        self.slots = int(mean + 6 * math.sqrt(mean)) + 8  # first allocation in tasks; grows if short

    def place(self, df: DataFrame, col: str, b: str, slot: str) -> DataFrame:
        t = self.table.select(F.col(self.col).alias(col), F.col("block").alias(b), F.col("slot").alias(slot))
        return df.join(t, col)


_PACK = ["lb", "rb", "kind", "key", "slots", "ids", "ws"]


def _packed(df: DataFrame, *by: str) -> DataFrame:
    """(by..., slots, ids, ws): the rows of a key and block as arrays of at most block length."""
    p = df.groupBy(*by).agg(F.collect_list(F.struct(
        F.col("slot").cast("int").alias("slot"), F.col("id").cast("long").alias("id"),
        F.col("w").cast("double").alias("w"))).alias("p"))
    return p.select(*by, F.col("p.slot").alias("slots"), F.col("p.id").alias("ids"), F.col("p.w").alias("ws"))


def _self_entries(entries: DataFrame, blk: Blocked) -> DataFrame:
    """Both sides of a table against itself with one join: rows go left to blocks from
    their own on, and right to blocks up to their own."""
    placed = blk.place(entries, "id", "own", "slot")
    at = placed.groupBy("key").agg(F.collect_set("own").alias("at"))
    own = F.col("own")

    def to(b, kind):
        return F.struct(F.least(own, b).alias("lb"), F.greatest(own, b).alias("rb"), kind.alias("kind"))
    targets = F.concat(
        F.transform("at", lambda b: to(b, F.when(b < own, R_ENTRY).otherwise(L_ENTRY))),
        F.array(to(own, F.lit(R_ENTRY))))
    return (_packed(placed, "key", "own").join(at, "key")
            .select(F.col("key").cast("long").alias("key"), "slots", "ids", "ws", F.inline(targets)).select(*_PACK))


def run_blocks(parts: list[DataFrame], task: BlockTask, lblk: Blocked, rblk: Blocked,
               groups: int | None = None) -> DataFrame:
    """Route rows to block pairs, sort each by key, and stream it through the task."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    total = lblk.n * rblk.n
    # `at` packs the block pair, then whether entries have begun, then hash bits of the
    # key, so that comparing one long settles almost every comparison of the sort
    low = 62 - total.bit_length()
    group = F.col("lb").cast("long") * rblk.n + F.col("rb")
    at = (F.shiftleft(group, low + 1)
          .bitwiseOR(F.shiftleft((F.col("kind") >= L_ENTRY).cast("long"), low))
          .bitwiseOR(F.xxhash64("key").bitwiseAND(F.lit((1 << low) - 1))))
    spark = rows.sparkSession
    tasks = min(groups or total, max(4 * spark.sparkContext.defaultParallelism,
                                     int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = (rows.withColumn("at", at).repartition(tasks, "lb", "rb").drop("lb", "rb")
            .sortWithinPartitions("at", "key", "kind"))
    task.shift, task.width, task.hint = low, rblk.n, (lblk.slots, rblk.slots)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _stream(batches, task)
    return rows.mapInArrow(stream, task.schema)


# --- both sides packed, one row per block ---------------------------------------------

_SIDE = ["block", "ids", "means", "vecs", "keys", "slots", "ws", "pair_slots", "pair_ids"]
_SIDE_SCHEMA = "block int, ids binary, means binary, vecs binary, keys binary, slots binary, ws binary, pair_slots binary, pair_ids binary"


def _pack_side(ids: DataFrame, entries: DataFrame | None, pairs: DataFrame | None, col: str, other: str, size: int) -> tuple[DataFrame, int, int]:
    """One row per block of ``ids`` (col[, w][, vec]): its ids in order with their values, its ``entries``
    (col, key, w) in the order of keys, and the other ids of its ``pairs``. Blocks hold about ``size`` ids and ``ENTRIES``
    entries. Also their number and the slots to expect in one."""
    def shaped(df, kind, other, w):
        vec = F.col("vec").cast("array<double>") if "vec" in df.columns else F.lit(None).cast("array<double>")
        return df.select(
            F.coalesce(F.col(col).cast("long"), F.lit(NULL)).alias("id"), F.lit(kind).alias("kind"), other.cast("long").alias("other"), w.cast("double").alias("w"), vec.alias("vec"))
    total = ids.count()
    n = _number(ids, total, size)
    entries, pairs = (df if df is None else df.filter(F.col(col).isNotNull()) for df in (entries, pairs))
    rows = shaped(ids, 0, F.lit(0), F.col("w") if "w" in ids.columns else F.lit(0.0))
    if entries is not None:
        entries = stage(entries.select(col, "key", "w"), "entries")
        n = max(n, min(total, -(-entries.count() // ENTRIES)))
        rows = rows.union(shaped(entries, 1, F.col("key"), F.col("w")))
    if pairs is not None:
        rows = rows.union(shaped(pairs.filter(F.col(other).isNotNull()), 2, F.col(other), F.lit(0.0)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.nullif("id", F.lit(NULL))), F.lit(n)).cast("int"))

    def one(key, t):
        kind, id_, far, w = (t.column(c).to_numpy() for c in ("kind", "id", "other", "w"))
        own = np.flatnonzero(kind == 0)
        own = own[np.argsort(id_[own], kind="stable")]
        known = id_[own]
        if not len(own):
            return pa.table({c: pa.array([], pa.int32() if c == "block" else pa.binary()) for c in _SIDE})

        def slots(k):
            """Rows of kind ``k`` with the slots of their ids; a repeated id has several."""
            at = np.flatnonzero(kind == k)
            first = np.searchsorted(known, id_[at])
            reps = np.searchsorted(known, id_[at], "right") - first
            step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            return np.repeat(at, reps), (np.repeat(first, reps) + step).astype(np.int32)
        vec = t.column("vec").combine_chunks().take(pa.array(own))
        width = vec.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        vecs = np.zeros((len(own), width.max()))
        if vecs.size:
            vecs[width > 0] = vec.flatten().to_numpy(zero_copy_only=False).reshape(int((width > 0).sum()), -1)
        e, e_slot = slots(1)
        order = np.lexsort((e_slot, far[e]))
        p, p_slot = slots(2)
        w = np.where(id_ == NULL, 0.0, w)
        vecs[known == NULL] = 0.0
        parts = [known, w[own], vecs, far[e][order], e_slot[order], w[e][order], p_slot, far[p]]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()),
                         **{c: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for c, x in zip(_SIDE[1:], parts)}})
    mean = total / n
    return stage(rows.groupBy("block").applyInArrow(one, _SIDE_SCHEMA), "side"), n, int(mean + 6 * math.sqrt(mean)) + 8


class _Side:
    """A packed block inside a task."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids, self.means, vecs, self.keys, self.slots, self.ws, self.pair_slots, self.pair_ids = (
            np.frombuffer(row[c], t) for c, t in zip(_SIDE[1:], (np.int64, float, float, np.int64, np.int32, float, np.int32, np.int64)))
        self.vecs = vecs.reshape(len(self.ids), -1)
        self.size = int((self.ids != NULL).sum())
        self.first = np.searchsorted(self.ids, self.ids)  # the first slot of a repeated id
        self.new = np.r_[True, self.keys[1:] != self.keys[:-1]][:len(self.keys)]
        self.kinds = self.keys[self.new]

    def shared(self, other: _Side) -> np.ndarray:
        """Entries whose key is in the other block too."""
        if not len(self.keys) or not len(other.keys):
            return np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(other.kinds, self.kinds), len(other.kinds) - 1)
        return np.flatnonzero((other.kinds[place] == self.kinds)[np.cumsum(self.new) - 1])


class _Kept:
    """The best n per id (and per ``a``) of what the pairs of one held block gave, equal scores by ascending other id.
    ``bar``: no lower score can be among them."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, n: int, by: list[str], other: str, score: str, places: int):
        self.ids, self.first, self.n, self.by, self.other, self.score = ids, first, n, by, other, score
        self.bar, self.found, self.held, self.trimmed = np.full((places, len(ids)), -np.inf), [], 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.found.append({c: batch.column(c).to_numpy() for c in batch.schema.names})
        self.held += batch.num_rows
        if not self.trimmed or self.held > 2 * self.trimmed:
            self.trim()

    def trim(self) -> None:
        rows = {c: np.concatenate([f[c] for f in self.found]) for c in self.found[0]}
        order = np.lexsort((rows[self.other], -rows[self.score], *(rows[c] for c in reversed(self.by))))
        rows = {c: x[order] for c, x in rows.items()}
        new = np.zeros(len(order), bool)
        for c in self.by:
            new[1:] |= rows[c][1:] != rows[c][:-1]
        new[:1] = True
        start = np.flatnonzero(new)
        place = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
        last = place == self.n - 1
        at = rows["a"][last] if "a" in rows else 0
        self.bar[at, np.searchsorted(self.ids, rows[self.by[0]][last])] = rows[self.score][last]
        self.bar = self.bar[:, self.first]
        keep = place < self.n
        self.found, self.held = [{c: x[keep] for c, x in rows.items()}], int(keep.sum())
        self.trimmed = max(self.held, 1024)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            self.trim()
            yield from _emit(list(self.found[0]), *self.found[0].values())


def run_product(lefts: tuple, rights: tuple, task: BlockTask, n: int | None = None, by: tuple[str, ...] = ("l",),
                score: str = "score", places: int = 1) -> DataFrame:
    """The task's rows for every pair of a packed left and a packed right block. With ``n``, only the best n per ``by``
    of each task."""
    (left, n_left, l_slots), (right, n_right, r_slots) = lefts, rights
    hold = by[0]
    held, n_held, sent, n_sent = (left, n_left, right, n_right) if hold == "l" else (right, n_right, left, n_left)
    other = "r" if hold == "l" else "l"
    task.hint = (l_slots, r_slots)
    cores = left.sparkSession.sparkContext.defaultParallelism
    groups = max(min(n_held, 4 * cores), -(-n_held // HELD))
    runs = max(1, -(-n_sent // STREAM), min(n_sent, 4 * cores // groups))

    def stream(batches):
        task.bar, kept, sides, passing = None, {}, {}, None
        for batch in batches:
            for k in range(batch.num_rows):
                here, there = batch.column(f"{hold}_block")[k].as_py(), batch.column(f"{other}_block")[k].as_py()

                def side(which, k=k, batch=batch):
                    return _Side({c: batch.column(f"{which}_{c}")[k].as_py() for c in _SIDE})
                if here not in sides:
                    sides[here] = side(hold)
                    kept[here] = None if n is None else _Kept(sides[here].ids, sides[here].first, n, list(by), other, score, places)
                if passing is None or passing.block != there:
                    passing = side(other)
                task.bar = None if n is None else kept[here].bar
                for out in task.meet(*((sides[here], passing) if hold == "l" else (passing, sides[here]))):
                    if n is None:
                        yield out
                    else:
                        kept[here].add(out)
        for k in kept.values():
            if k is not None:
                yield from k.batches()

    def named(df, which):
        return df.select(*[F.col(c).alias(f"{which}_{c}") for c in _SIDE])
    sent, held = (named(df, which).repartitionByRange(parts, f"{which}_block") for df, which, parts in ((sent, other, runs), (held, hold, groups)))
    # a block crosses to Python once per task; those already there are known by their numbers
    out = crossed(sent, held, ("l_block", "r_block")).mapInArrow(stream, task.schema)
    return out.withColumns({c: F.when(F.col(c) == NULL, -1).otherwise(F.col(c)) for c in "lr"})


# --- inside tasks -------------------------------------------------------------------

def _unpack(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    """Packed rows as flat columns, a bounded number at a time. Rows with a vector and rows
    without never share a part, so a long mask is not widened to the vectors' width."""
    size = batch.column("slots").value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    has = np.zeros(len(size), bool)
    if "vec" in batch.schema.names:
        has = batch.column("vec").value_lengths().fill_null(0).to_numpy(zero_copy_only=False) > 0
    turns = np.append(np.flatnonzero(has[1:] != has[:-1]) + 1, len(size))
    a = 0
    while a < len(size):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + ROWS_AT_ONCE, side="right")))
        b = min(b, int(turns[np.searchsorted(turns, a, side="right")]))
        part, n = batch.slice(a, b - a), size[a:b]
        cols = {c: np.repeat(part.column(c).to_numpy(), n) for c in ("at", "kind", "key")}
        for c, name in (("slot", "slots"), ("id", "ids"), ("w", "ws")):
            cols[c] = part.column(name).flatten().to_numpy(zero_copy_only=False)
        if "vec" in batch.schema.names:
            v = part.column("vec")
            width = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            out = np.zeros((len(width), width.max()))
            if out.size:
                out[width > 0] = v.flatten().to_numpy(zero_copy_only=False).reshape(int((width > 0).sum()), -1)
            cols["vec"] = np.repeat(out, n, axis=0)
        a = b
        yield cols


def _join(a: dict, b: dict) -> dict:
    out = {}
    for n in b:
        x, y = a[n], b[n]
        if n == "vec" and x.shape[1] != y.shape[1]:  # a batch without vectors has width 0
            width = max(x.shape[1], y.shape[1])
            x, y = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (x, y))
        out[n] = np.concatenate([x, y])
    return out


def _stream(batches, task):
    carry, current = None, None
    for cols in (part for batch in batches for part in _unpack(batch)):
        if carry is not None:
            if carry["at"][-1] == cols["at"][0] and carry["key"][-1] == cols["key"][0]:
                cols = _join(carry, cols)
            else:
                current = yield from _consume(carry, current, task)
        at, key = cols["at"], cols["key"]
        new = (at[1:] != at[:-1]) | (key[1:] != key[:-1])
        ends = np.flatnonzero(new)
        cut = int(ends[-1]) + 1 if len(ends) else 0  # the last key may go on in the next batch
        carry = {n: c[cut:] for n, c in cols.items()}
        if cut:
            current = yield from _consume({n: c[:cut] for n, c in cols.items()}, current, task)
    if carry is not None:
        current = yield from _consume(carry, current, task)
    if current is not None:
        yield from task.finish()


def _consume(cols, current, task):
    group = cols["at"] >> (task.shift + 1)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(group)]):
        here = int(group[a])
        if here != current:
            if current is not None:
                yield from task.finish()
            task.start(*divmod(here, task.width))
            current = here
        part = {n: c[a:b] for n, c in cols.items()}
        kind = part["kind"]
        for k, side in ((L_UNIVERSE, "l"), (R_UNIVERSE, "r")):
            at = np.flatnonzero(kind == k)
            if len(at):
                task.universe(side, {n: c[at] for n, c in part.items()})
        at = np.flatnonzero(kind == MASK)
        if len(at):
            task.mask(part["slot"][at], part["key"][at])
        at = np.flatnonzero(kind >= L_ENTRY)
        if len(at):
            _expand({n: c[at] for n, c in part.items()}, task)
    return current


def _expand(e, task):
    """All (left, right) combinations under each key, a bounded number at a time."""
    key, slot, w, is_l = e["key"], e["slot"], e["w"], e["kind"] == L_ENTRY
    if "id" in e:
        task.ids("l", slot[is_l], e["id"][is_l])
        task.ids("r", slot[~is_l], e["id"][~is_l])
    run = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    n_r = np.bincount(run[~is_l], minlength=run[-1] + 1)
    if task.channels:  # keys that fill much of the block go in as whole columns
        n_l = np.bincount(run[is_l], minlength=run[-1] + 1)
        heavy = n_l * n_r * HEAVY > task.acc.shape[0] * task.acc.shape[1]
        if heavy.any():
            for k in np.flatnonzero(heavy):
                a, b = np.searchsorted(run, [k, k + 1])
                lk = is_l[a:b]
                task.column(slot[a:b][lk], w[a:b][lk], slot[a:b][~lk], w[a:b][~lk])
            light = ~heavy[run]
            if not light.any():
                return
            key, slot, w, is_l = key[light], slot[light], w[light], is_l[light]
            run = np.cumsum(np.r_[0, key[1:] != key[:-1]])
            n_r = np.bincount(run[~is_l], minlength=run[-1] + 1)
    li, ri = np.flatnonzero(is_l), np.flatnonzero(~is_l)
    first, reps = (np.cumsum(n_r) - n_r)[run[li]], n_r[run[li]]
    done = np.cumsum(reps)
    a = 0
    while a < len(li):
        base = done[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(done, base + PAIR_CHUNK, side="right")))
        rep = reps[a:b]
        left = np.repeat(li[a:b], rep)
        step = np.arange(len(left)) - np.repeat(np.cumsum(rep) - rep, rep)
        right = ri[np.repeat(first[a:b], rep) + step]
        if len(left):
            task.pairs(slot[left], slot[right], key[left], w[left], w[right])
        a = b


class BlockTask:
    """Accumulates one block pair at a time; arrays grow with the slots seen."""

    schema: str
    # each channel sums f(left weight) · g(right weight) over shared keys
    channels: list = []
    acc = bar = None

    def start(self, lb: int, rb: int) -> None:
        self.same = lb == rb
        self.heavy = []
        l, r = self.hint
        self.id = {"l": np.full(l, -1, np.int64), "r": np.full(r, -1, np.int64)}
        self.default = {"l": np.zeros(l), "r": np.zeros(r)}
        self.vec = {"l": None, "r": None}
        self.masked = np.zeros((l, r), bool)
        if self.acc is not None and self.acc.shape[:2] == (l, r):
            self.acc.fill(0.0)
        else:
            self.acc = np.zeros((l, r, len(self.channels)))

    def meet(self, l: _Side, r: _Side):
        """What one pair of packed blocks gives."""
        self.start(l.block, r.block)
        self.size = l.size, r.size
        for name, side in (("l", l), ("r", r)):
            self.universe(name, {"slot": np.arange(len(side.ids)), "id": side.ids, "w": side.means, "vec": side.vecs})
        if len(l.pair_ids):  # a repeated id has several slots
            at = np.searchsorted(r.ids, l.pair_ids)
            reps = np.searchsorted(r.ids, l.pair_ids, "right") - at
            for k in range(int(reps.max())):
                more = reps > k
                self.mask(l.pair_slots[more], at[more] + k)
        a, b = l.shared(r), r.shared(l)
        if len(a):
            key = np.r_[l.keys[a], r.keys[b]]
            order = np.argsort(key, kind="stable")
            _expand({"key": key[order], "slot": np.r_[l.slots[a], r.slots[b]][order], "w": np.r_[l.ws[a], r.ws[b]][order],
                     "kind": np.repeat([L_ENTRY, R_ENTRY], [len(a), len(b)])[order]}, self)
        yield from self.finish()

    def _fit(self, l: int, r: int) -> None:
        have = self.masked.shape
        if l <= have[0] and r <= have[1]:
            return
        want = tuple(h if n <= h else max(n, h + h // 4) for n, h in zip((l, r), have))
        grow = [(0, want[0] - have[0]), (0, want[1] - have[1])]
        self.masked = np.pad(self.masked, grow)
        self.acc = np.pad(self.acc, [*grow, (0, 0)])

    def ids(self, side: str, slots, ids) -> None:
        if not len(slots):
            return
        need = int(slots.max()) + 1
        if need > len(self.id[side]):
            extra = max(need - len(self.id[side]), len(self.id[side]) // 4)
            self.id[side] = np.r_[self.id[side], np.full(extra, -1, np.int64)]
            self.default[side] = np.r_[self.default[side], np.zeros(extra)]
        self.id[side][slots] = ids
        self._fit(*((need, 0) if side == "l" else (0, need)))

    def universe(self, side: str, rows) -> None:
        self.ids(side, rows["slot"], rows["id"])
        self.default[side][rows["slot"]] = rows["w"]
        if "vec" in rows and rows["vec"].shape[1]:
            v = rows["vec"]
            if self.vec[side] is None:
                self.vec[side] = np.zeros((0, v.shape[1]))
            short = len(self.id[side]) - len(self.vec[side])
            self.vec[side] = np.pad(self.vec[side], ((0, short), (0, 0)))
            self.vec[side][rows["slot"]] = v

    def mask(self, lslot, rslot) -> None:
        self._fit(int(lslot.max()) + 1, int(rslot.max()) + 1)
        self.masked[lslot, rslot] = True

    def pairs(self, l, r, key, lw, rw) -> None:
        flat = (l.astype(np.int64) * self.acc.shape[1] + r) * len(self.channels)
        cells = self.acc.reshape(-1)
        for c, (f, g) in enumerate(self.channels):
            np.add.at(cells, flat + c, f(lw) * g(rw))

    def column(self, l, lw, r, rw) -> None:
        self.heavy.append((l, lw, r, rw))
        if len(self.heavy) == COLUMNS:
            self.add_columns()

    def add_columns(self) -> None:
        if not self.heavy:
            return
        for c, (f, g) in enumerate(self.channels):
            left = np.zeros((self.acc.shape[0], len(self.heavy)))
            right = np.zeros((len(self.heavy), self.acc.shape[1]))
            for i, (l, lw, r, rw) in enumerate(self.heavy):
                left[l, i], right[i, r] = f(lw), g(rw)
            self.acc[:, :, c] += left @ right
        self.heavy = []

    def finish(self):
        raise NotImplementedError

    def _size(self) -> tuple[int, int]:
        """Ids of the universes; their slots run from 0 without gaps, in id order."""
        return self.size

    def _best(self, score: np.ndarray, n: int, per: str = "l", place: int = 0):
        """Slots and values, rounded to 8 digits, of the best n per id of side ``per``, by (score desc, id asc), but for
        those below the ``bar`` of what the task has. Changes ``score``: masked pairs are left out."""
        score[self.masked[:score.shape[0], :score.shape[1]]] = -np.inf
        bar = np.full(score.shape[per == "r"], -np.inf) if self.bar is None else self.bar[place, :score.shape[per == "r"]]
        short = np.flatnonzero(bar == -np.inf)
        if len(short):  # the n-th of the pair itself
            part = score[short] if per == "l" else score[:, short].T
            if part.shape[1] > n:
                bar = bar.copy()
                bar[short] = -np.partition(-part, n - 1, axis=1)[:, n - 1]
        # scores that round to the same 8 digits are ties
        keep = (score >= (bar[:, None] if per == "l" else bar[None]) - SLACK) & (score > -np.inf)
        own, other = np.nonzero(keep) if per == "l" else np.nonzero(keep.T)
        v = np.round(score[own, other] if per == "l" else score[other, own], 8)
        order = np.lexsort((other, -v, own))
        own, other, v = own[order], other[order], v[order]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
        keep = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)])) < n
        own, other, v = own[keep], other[keep], v[keep]
        return (other, own, v) if per == "r" else (own, other, v)


def _emit(schema_names: list[str], *arrays):
    if len(arrays[0]):
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=schema_names)


class GramTask(BlockTask):
    """n, Σxy, Σx², Σy² over shared keys; a pair leaves once, when all its keys are in."""

    schema = "a long, b long, common long, xy double, xx double, yy double"
    channels = [(np.ones_like, np.ones_like), (np.copy, np.copy), (np.square, np.ones_like), (np.ones_like, np.square)]

    def __init__(self, min_support: int):
        self.min_support = min_support

    def finish(self):
        self.add_columns()
        enough = self.acc[:, :, 0] > self.min_support - 0.5
        if self.same:
            enough &= np.tri(*enough.shape, k=-1, dtype=bool).T  # each pair of a block once
        l, r = np.nonzero(enough)
        n, xy, xx, yy = self.acc[l, r].T
        a, b = self.id["l"][l], self.id["r"][r]
        swap = a > b
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        xx, yy = np.where(swap, yy, xx), np.where(swap, xx, yy)
        yield from _emit(["a", "b", "common", "xy", "xx", "yy"], a, b, np.rint(n).astype(np.int64), xy, xx, yy)


class SparseTopTask(BlockTask):
    """Dot products over shared keys; best n right ids per left id of the block."""

    schema = "l long, r long, score double"
    channels = [(np.copy, np.copy)]

    def __init__(self, n: int, exclude_self: bool = False):
        self.n, self.exclude_self = n, exclude_self

    def finish(self):
        self.add_columns()
        nl, nr = self._size()
        if nl and nr:
            score = self.acc[:nl, :nr, 0]
            if self.exclude_self:
                _, l, r = np.intersect1d(self.id["l"][:nl], self.id["r"][:nr], return_indices=True)
                score[l, r] = -np.inf
            l, r, v = self._best(score, self.n)
            yield from _emit(["l", "r", "score"], self.id["l"][l], self.id["r"][r], v)


class BlendTopTask(BlockTask):
    """Sparse products over shared keys and vector products of the same block pair, each computed once; for every
    ``a`` of ``alphas`` the best n right ids per left id by a · sparse + (1 - a) · dense."""

    schema = "l long, a int, r long, score double"
    channels = [(np.copy, np.copy)]

    def __init__(self, n: int, alphas: tuple[float, ...]):
        self.n, self.alphas = n, alphas

    def finish(self):
        self.add_columns()
        nl, nr = self._size()
        if nl and nr:
            sparse = self.acc[:nl, :nr, 0]
            dense = None if self.vec["l"] is None or self.vec["r"] is None else self.vec["l"][:nl] @ self.vec["r"][:nr].T
            for k, a in enumerate(self.alphas):
                score = a * sparse
                if dense is not None:
                    score += (1.0 - a) * dense
                l, r, v = self._best(score, self.n, place=k)
                yield from _emit(["l", "a", "r", "score"], self.id["l"][l], np.full(len(l), k, np.int32), self.id["r"][r], v)


class DenseTopTask(BlockTask):
    """Vector products of two blocks in one matrix product; best n per left id."""

    schema = "l long, r long, score double"

    def __init__(self, n: int):
        self.n = n

    def finish(self):
        nl, nr = self._size()
        if nl and nr:
            score = np.zeros((nl, nr)) if self.vec["l"] is None or self.vec["r"] is None else self.vec["l"][:nl] @ self.vec["r"][:nr].T
            score += self.default["l"][:nl, None] + self.default["r"][None, :nr]
            l, r, v = self._best(score, self.n)
            yield from _emit(["l", "r", "score"], self.id["l"][l], self.id["r"][r], v)


class NeighbourTask(BlockTask):
    """Weighted votes of the k most similar neighbours (ties: lowest id).

    Left ids are the entities compared (a), keys their neighbours, right ids the other
    side of the rating. ``shift`` is the mean of a (0 for plain votes); a pair without a
    neighbour gets ``fallback`` of a, and the overall mean if a or the right id is new.
    """

    BUFFER = 1 << 22

    def __init__(self, k: int, min_k: int, basic: bool, mu: float, n: int | None, per: str,
                 scale: tuple[float, float] | None):
        self.k, self.min_k, self.basic, self.mu = k, min_k, basic, mu
        self.n, self.per, self.scale = n, per, scale
        self.schema = "l long, r long, est double, neighbours long"

    def start(self, lb, rb) -> None:
        super().start(lb, rb)
        self.kept, self.held = [], 0

    def pairs(self, l, r, key, lw, rw) -> None:
        # masked pairs are the wanted ones for prediction, the seen ones for top-n
        want = self.masked[l, r] if self.n is None else ~self.masked[l, r]
        code = l[want].astype(np.int64) << 32 | r[want]
        self.kept.append((code, lw[want], key[want], rw[want]))
        self.held += len(code)
        if self.held > self.BUFFER:
            self._compress()

    def _compress(self) -> None:
        code, s, key, v = (np.concatenate(c) for c in zip(*self.kept))
        order = np.lexsort((key, -s, code))
        code, s, key, v = code[order], s[order], key[order], v[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        pos = np.arange(len(code)) - np.repeat(first, np.diff(np.r_[first, len(code)]))
        keep = pos < self.k
        self.kept = [(code[keep], s[keep], key[keep], v[keep])]
        self.held = int(keep.sum())

    def finish(self):
        nl, nr = self._size()
        if not nl or not nr:
            return
        code, avg, cnt = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        if self.held:
            self._compress()
            full, s, _, v = self.kept[0]
            first = np.flatnonzero(np.r_[True, full[1:] != full[:-1]])
            code = full[first]
            avg = np.add.reduceat(s * v, first) / np.add.reduceat(s, first)
            cnt = np.diff(np.r_[first, len(full)])
        if self.n is None:
            l, r = np.nonzero(self.masked)
            pos = np.searchsorted(code, l.astype(np.int64) << 32 | r)
            pos = np.where(pos < len(code), pos, 0)
            hit = code[pos] == (l.astype(np.int64) << 32 | r) if len(code) else np.zeros(len(l), bool)
            avg, cnt = (np.where(hit, a[pos], 0) if len(code) else np.zeros(len(l), a.dtype) for a in (avg, cnt))
            v = self._estimate(self.default["l"][l], self.default["r"][r], avg, cnt)
            yield from self._out(l, r, v, cnt)
            return
        # every pair starts from its fallback; pairs with neighbours are overwritten
        est = self._estimate(self.default["l"][:nl, None], self.default["r"][None, :nr], 0.0, np.int64(0))
        votes = np.zeros(est.shape, np.int32)
        l, r = code >> 32, code & 0xFFFFFFFF
        est[l, r] = self._estimate(self.default["l"][l], self.default["r"][r], avg, cnt)
        votes[l, r] = cnt
        l, r, v = self._best(est, self.n, self.per)
        yield from self._out(l, r, v, votes[l, r])

    def _estimate(self, mean_l, mean_r, avg, cnt):
        """Universe weights are the means of each id, NaN for ids without training ratings."""
        shift = 0.0 if self.basic else mean_l
        est = np.where(cnt >= self.min_k, shift + avg, self.mu if self.basic else mean_l)
        est = np.where(np.isnan(mean_l) | np.isnan(mean_r), self.mu, est)
        return np.clip(est, *self.scale) if self.scale else est

    def _out(self, l, r, est, cnt):
        yield from _emit(["l", "r", "est", "neighbours"], self.id["l"][l], self.id["r"][r], est,
                         np.asarray(cnt, np.int64))


# --- jobs ---------------------------------------------------------------------------

def gram(entries: DataFrame, min_support: int = 2, size: int = BLOCK) -> DataFrame:
    """(a, b, common, xy, xx, yy) for ids a < b that share at least ``min_support`` keys.
    ``entries`` is (id, key, w) with one row per (id, key).

    Blocks cost a cell for every pair of ids. Where few pairs share a key, they are formed key by key instead, and rows are
    as many as shared keys."""
    blk = Blocked(entries.select("id").distinct(), "id", size)
    n = F.col("n").cast("double")
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(n * (n - 1) / 2)).first()[0] or 0.0
    if shared * SPARSE < blk.total * (blk.total - 1) / 2:
        left = entries.select("key", F.col("id").cast("long").alias("a"), F.col("w").alias("x"))
        right = entries.select("key", F.col("id").cast("long").alias("b"), F.col("w").alias("y"))
        x, y = F.col("x"), F.col("y")
        return (left.join(right, "key").filter("a < b").groupBy("a", "b")
                .agg(F.count(F.lit(1)).alias("common"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
                .filter(F.col("common") >= min_support))
    return run_blocks([_self_entries(entries, blk)], GramTask(min_support), blk, blk, blk.n * (blk.n + 1) // 2)


def _best_overall(per_block: DataFrame, n: int, by: str = "l", other: str = "r", score: str = "score") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(other))
    return (per_block.withColumn("rank", F.row_number().over(w).cast("long"))
            .filter(F.col("rank") <= n))


def _sides(left: DataFrame | None, right: DataFrame | None, lefts: DataFrame, rights: DataFrame, pairs: DataFrame | None,
           size: int) -> tuple[tuple, tuple]:
    """Both sides packed; the left blocks hold the ``pairs``."""
    return (_pack_side(stage(lefts, "lefts"), left, pairs, "l", "r", size), _pack_side(stage(rights, "rights"), right, None, "r", "l", size))


def sparse_topn(left: DataFrame, right: DataFrame, lefts: DataFrame, rights: DataFrame, n: int,
                exclude: DataFrame | None = None, exclude_self: bool = False,
                size: int = BLOCK) -> DataFrame:
    """(l, r, score, rank): best n of all ``rights`` for each of ``lefts`` by the dot product
    of sparse rows (l, key, w) and (r, key, w); pairs sharing no key score 0."""
    sides = _sides(left, right, lefts, rights, exclude, size)
    return _best_overall(run_product(*sides, SparseTopTask(n, exclude_self), n), n)


def blend_topn(left: DataFrame, right: DataFrame, lefts: DataFrame, rights: DataFrame, n: int, alphas: tuple[float, ...],
               exclude: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """(l, a, r, score, rank): best n of all ``rights`` (r, vec) for each of ``lefts`` (l, vec) and each place ``a`` in
    ``alphas``, by alpha · product of sparse rows (l, key, w) and (r, key, w) + (1 - alpha) · product of vectors.
    Both products are made once, whatever the number of alphas. All vectors of both sides have one length."""
    found = run_product(*_sides(left, right, lefts, rights, exclude, size), BlendTopTask(n, alphas), n, ("l", "a"), places=len(alphas))
    best = Window.partitionBy("l", "a").orderBy(F.col("score").desc(), F.col("r"))
    return found.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= n)


def dense_topn(lefts: DataFrame, rights: DataFrame, n: int, exclude: DataFrame | None = None,
               size: int = BLOCK) -> DataFrame:
    """(l, r, score, rank): best n of all ``rights`` (r, vec[, w]) for each of ``lefts``
    (l, vec[, w]) by vector product plus both offsets ``w``."""
    return _best_overall(run_product(*_sides(None, None, lefts, rights, exclude, size), DenseTopTask(n), n), n)


def _joined_votes(sims: DataFrame, votes: DataFrame, lefts: DataFrame, rights: DataFrame, pairs: DataFrame, k: int, min_k: int,
                  basic: bool, mu: float, scale: tuple[float, float] | None) -> DataFrame:
    """The estimates of ``NeighbourTask`` for ``pairs``, by a join on the key: for votes that few of all pairs have."""
    wanted = pairs.select(F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r")).dropna().distinct()
    near = (sims.select(F.col("l").cast("long").alias("l"), "key", F.col("w").alias("s"))
            .join(votes.select(F.col("r").cast("long").alias("r"), "key", F.col("w").alias("v")), "key").join(wanted, ["l", "r"], "left_semi"))
    place = F.row_number().over(Window.partitionBy("l", "r").orderBy(F.desc("s"), "key"))
    found = (near.withColumn("place", place).filter(F.col("place") <= k).groupBy("l", "r")
             .agg((F.sum(F.col("s") * F.col("v")) / F.sum("s")).alias("avg"), F.count(F.lit(1)).alias("n")))
    mean_l, mean_r = (df.select(F.col(c).cast("long").alias(c), F.col("w").alias(f"mean_{c}")) for df, c in ((lefts, "l"), (rights, "r")))
    n, mean = F.coalesce("n", F.lit(0).cast("long")), F.col("mean_l")
    overall = F.lit(mu).cast("double")
    est = F.when(n >= min_k, F.coalesce("avg", F.lit(0.0)) + (F.lit(0.0) if basic else mean)).otherwise(overall if basic else mean)
    est = F.when(F.isnan("mean_l") | F.isnan("mean_r"), overall).otherwise(est)
    if scale:
        est = F.greatest(F.least(est, F.lit(float(scale[1]))), F.lit(float(scale[0])))
    return (wanted.join(found, ["l", "r"], "left").join(mean_l, "l").join(mean_r, "r")
            .select("l", "r", est.alias("est"), n.alias("neighbours")))


def neighbour_votes(sims: DataFrame, votes: DataFrame, lefts: DataFrame, rights: DataFrame,
                    pairs: DataFrame, k: int, min_k: int, basic: bool, mu: float,
                    n: int | None = None, per: str = "l",
                    scale: tuple[float, float] | None = None, size: int | None = None) -> DataFrame:
    """(l, r, est, neighbours) from similarities (l, key, w) and votes (r, key, w).
    Without ``n``: an estimate for each of ``pairs``. With ``n``: the best n per id of side
    ``per`` among all pairs except ``pairs``. Universes carry the means in ``w``."""
    size = size or (BLOCK if n is None else VOTE_BLOCK)
    lefts, rights = stage(lefts, "lefts"), stage(rights, "rights")
    sims, votes = sims.join(lefts.select("l"), "l", "left_semi"), votes.join(rights.select("r"), "r", "left_semi")
    if n is None:
        at = sims.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("n")).join(
            votes.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("m")), "key")
        if (at.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0.0) * SPARSE < float(lefts.count()) * rights.count():
            return _joined_votes(sims, votes, lefts, rights, pairs, k, min_k, basic, mu, scale)
    sides = _sides(sims, votes, lefts, rights, pairs, size)
    task = NeighbourTask(k, min_k, basic, mu, n, per, scale)
    if n is None:
        return run_product(*sides, task)
    out = run_product(*sides, task, n, (per,), "est")
    return _best_overall(out, n, *(("l", "r") if per == "l" else ("r", "l")), score="est")
