"""Pairs of ids and their vectors without a vector per pair in a shuffle.

Pairs are packed by chunks of their left ids, together with what those ids have. The vectors of the right ids are packed
apart and pass every chunk in a Cartesian product, which reads them where they were written. A packed row crosses to Python
once per task, however many it meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.session import drop_stage, stage

PAIRS, LEFTS = 1 << 19, 1 << 14  # of a chunk
RIGHTS = 1 << 14                 # vectors of a packed row
GATHER = 2_000_000               # numbers that a task gathers at once


def crossed(sent: DataFrame, held: DataFrame, always: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``sent`` with every row of ``held``, in turn; names of columns differ. Both are numbered from 0 in their
    partitions, _s and _h. But for the columns ``always``, a sent row is given with the first held row only and a held row with
    the first sent row only, and null elsewhere."""
    here = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # place in the partition
    both = sent.withColumn("_s", here).crossJoin(held.withColumn("_h", here).hint("shuffle_replicate_nl"))

    def once(df, other):
        return [c if c in always else F.when(F.col(other) == 0, F.col(c)).alias(c) for c in df.columns]
    return both.select("_s", "_h", *once(sent, "_h"), *once(held, "_s"))


def met(sent: DataFrame, held: DataFrame, work: Callable[[Iterator], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` over (sent row, place of the held row, held row or None) for all rows of ``sent``, in turn, and of one
    partition of ``held``; a held row is given with the first sent row only. Names of columns differ."""
    s_cols, h_cols = sent.columns, held.columns

    def turns(batches):
        passing = None
        for b in batches:
            s, h = b.column("_s").to_numpy(), b.column("_h").to_numpy()
            for k in range(b.num_rows):
                if h[k] == 0:
                    passing = b.slice(k, 1).select(s_cols)
                yield passing, int(h[k]), b.slice(k, 1).select(h_cols) if s[k] == 0 else None

    def stream(batches):
        yield from work(turns(batches))
    return crossed(sent, held).mapInArrow(stream, schema)


def _ipc(t: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def _ragged(col) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of a column as rows of a matrix, and their lengths; -1 for those that are null or hold a null."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    x = np.zeros((len(size), int(size.max()) if len(size) else 0), np.float32 if pa.types.is_float32(col.type.value_type) else np.float64)
    row = np.repeat(np.arange(len(size)), size)
    x[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat.to_numpy(zero_copy_only=False)
    size[np.unique(row[flat.is_null().to_numpy(zero_copy_only=False)])] = -1
    size[col.is_null().to_numpy(zero_copy_only=False)] = -1
    return x, size


def unit_products(pairs: DataFrame, lefts: DataFrame, rights: DataFrame, left: str, right: str, out: str = "_cos", count: str = "_n") -> DataFrame:
    """``pairs`` with the product of the vector of the ``left`` id in ``lefts`` (id, vec, n; one row per id) with the vector of the
    ``right`` id in ``rights`` (id, features) scaled to length 1, and n; null without one of them or where their lengths differ.
    A pair has a row per vector of its right id, and one without any."""
    own = []
    if not hasattr(pairs, "_staged"):
        pairs = stage(pairs, "pairs")
        own.append(pairs)
    lefts = stage(lefts, "lefts")
    own.append(lefts)

    def common(a, b):  # the type in which both are compared
        return a.limit(0).union(b.limit(0)).schema[0].dataType
    l_kind, r_kind = common(pairs.select(left), lefts.select("id")), common(pairs.select(right), rights.select("id"))
    chunks = max(1, -(-pairs.count() // PAIRS), -(-lefts.count() // LEFTS), pairs.sparkSession.sparkContext.defaultParallelism)
    runs = max(1, -(-rights.count() // RIGHTS))
    names = pairs.columns

    def dealt(col, n):
        return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
    # a null id meets nothing and goes with its other id
    l_id, r_id = F.col(left).cast(l_kind), F.col(right).cast(r_kind)
    rows = (pairs.withColumns({"_l": l_id, "_r": r_id}).withColumn("_run", dealt("_r", runs))
            .withColumn("_chunk", F.when(F.col("_l").isNull(), dealt("_r", chunks)).otherwise(dealt("_l", chunks))))
    given = lefts.filter("id is not null").select(F.col("id").cast(l_kind).alias("_id"), F.col("vec").alias("_vec"), F.col("n").cast("long").alias("_count"))

    def pack(t, own):
        if not t.num_rows:
            return pa.table({"h_rows": pa.array([], pa.binary()), "h_vecs": pa.array([], pa.binary())})
        order = np.argsort(t.column("_run").to_numpy(), kind="stable")
        place = pc.index_in(t.column("_l"), value_set=own.column("_id").combine_chunks())
        t = t.append_column("_place", place).take(pa.array(order)).select([*names, "_r", "_run", "_place"])
        return pa.table({"h_rows": pa.array([_ipc(t)], pa.binary()), "h_vecs": pa.array([_ipc(own.select(["_vec", "_count"]))], pa.binary())})
    held = (rows.repartition(chunks, "_chunk").groupBy("_chunk")
            .cogroup(given.withColumn("_chunk", dealt("_id", chunks)).repartition(chunks, "_chunk").groupBy("_chunk"))
            .applyInArrow(pack, "h_rows binary, h_vecs binary"))

    def vectors(key, t):
        return pa.table({"s_run": pa.array([key[0].as_py()], pa.int32()), "s_vecs": pa.array([_ipc(t.select(["id", "features"]))], pa.binary())})
    some = rights.select(F.col("id").cast(r_kind).alias("id"), "features").filter("id is not null and features is not null").withColumn("run", dealt("id", runs))
    packed = stage(some.groupBy("run").applyInArrow(vectors, "s_run int, s_vecs binary"), "vectors")
    # one row more, so that pairs pass something where there are no vectors
    sent = packed.union(pairs.sparkSession.range(1).select(F.lit(-1).alias("s_run"), F.lit(None).cast("binary").alias("s_vecs"))).coalesce(1)

    def unpacked(col):
        return pa.ipc.open_stream(col[0].as_buffer()).read_all()

    def against(t, vec, size, n, ids, units, width):
        """Pairs ``t`` of a run with the vectors of the run."""
        code = ids.dictionary_encode()
        order = np.argsort(code.indices.to_numpy(), kind="stable")
        start = np.searchsorted(code.indices.to_numpy()[order], np.arange(len(code.dictionary) + 1))
        at = pc.index_in(t.column("_r"), value_set=code.dictionary).combine_chunks()
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        copies = np.where(at >= 0, start[at + 1] - start[at], 1) if len(at) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(at)), copies)
        step = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
        hit = np.flatnonzero(at[row] >= 0)
        right_ = np.full(len(row), -1)
        right_[hit] = order[start[at[row[hit]]] + step[hit]]
        place = t.column("_place").combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[row]
        good = np.flatnonzero((place >= 0) & (right_ >= 0))
        good = good[size[place[good]] == width[right_[good]]]
        good = good[size[place[good]] >= 0]
        cos, known = np.zeros(len(row)), np.zeros(len(row), bool)
        known[good] = True
        wide = min(vec.shape[1], units.shape[1])
        for a in range(0, len(good), max(1, GATHER // max(wide, 1))):
            g = good[a:a + max(1, GATHER // max(wide, 1))]
            cos[g] = np.einsum("ij,ij->i", vec[place[g], :wide], units[right_[g], :wide])
        t = t.take(pa.array(row))
        n = n.take(pa.array(place, mask=place < 0))
        return t.select(names).append_column(out, pa.array(cos, mask=~known)).append_column(count, n).to_batches()

    def work(turns):
        chunk, left_over, seen = [], [], None
        for passing, k, row in turns:
            if row is not None:
                t, own = unpacked(row.column("h_rows")), unpacked(row.column("h_vecs"))
                runs_ = t.column("_run").to_numpy()
                n = own.column("_count").combine_chunks()
                chunk.append((t, np.searchsorted(runs_, np.arange(runs + 1)), *_ragged(own.column("_vec")), n))
                left_over.append(np.ones(runs, bool))
            if k == 0:
                run = passing.column("s_run")[0].as_py()
                if run >= 0:
                    some = unpacked(passing.column("s_vecs"))
                    x, width = _ragged(some.column("features"))
                    x = x.astype(np.float64)
                    length = np.sqrt(np.einsum("ij,ij->i", x, x))
                    seen = some.column("id").combine_chunks(), x / np.where(length == 0, 1.0, length)[:, None], width
            if run >= 0:
                t, first, vec, size, n = chunk[k]
                left_over[k][run] = False
                yield from against(t.slice(first[run], first[run + 1] - first[run]), vec, size, n, *seen)
        for (t, first, vec, size, n), missing in zip(chunk, left_over):
            none = pa.array([], t.column("_r").type), np.zeros((0, 0)), np.zeros(0, np.int64)
            for run in np.flatnonzero(missing):
                if first[run + 1] > first[run]:
                    yield from against(t.slice(first[run], first[run + 1] - first[run]), vec, size, n, *none)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    found = stage(met(sent, held, work, f"{kinds}, `{out}` double, `{count}` long"), "products")
    drop_stage(packed, *own)
    return found
