"""Shards of near equal bytes by a k-d tree over row metadata.

Each node is split at the weighted quantile, by bytes, of its widest dimension, until the leaves
are as many as the target bytes ask for. Rows of equal value in that dimension are ordered by a row hash,
so a value held by a third of all rows is split like any other. Quantiles come from histograms that narrow to
the bucket of the cut, for all nodes of a level in one pass; per pass and node one row reaches
the driver. The finished tree is a Column expression over the row's own metadata, so rows need no
join to get their shard.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.session import stage

ROW_BYTES = 8  # what a row costs besides its text
DIM_BITS, HASH_BITS, STEP_BITS = 20, 43, 12
KEY_BITS = DIM_BITS + HASH_BITS


@dataclass
class Node:
    leaves: int
    first: int  # number of its first leaf
    dim: str | None = None
    cut: int | None = None  # rows with a lower key go left
    left: Node | None = None
    right: Node | None = None


def size_column(text: str = "text") -> Column:
    """UTF-8 bytes plus the row's own cost; a null text has none."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + ROW_BYTES


def _dims(docs: DataFrame) -> dict[str, Column]:
    """The metadata dimensions, each scaled to 0 .. 2**20 - 1: doc_id (scaled between its ends),
    size (logarithm), and language and source where the table has them (a hash orders them)."""
    top = (1 << DIM_BITS) - 1
    ends = docs.agg(F.min("doc_id").cast("double").alias("lo"), F.max("doc_id").cast("double").alias("hi")).first()
    lo, width = ends.lo or 0.0, max((ends.hi or 0.0) - (ends.lo or 0.0), 1.0)
    out = {"doc_id": F.coalesce((F.col("doc_id").cast("double") - lo) / width * top, F.lit(0.0)),
           "size": F.least(F.log2(F.col("size").cast("double")) / 40 * top, F.lit(float(top)))}
    for name in ("lang", "source"):
        if name in docs.columns:
            out[name] = F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(1 << DIM_BITS))
    return {k: v.cast("long") for k, v in out.items()}


def _table(docs: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with size, crc and row hash, and the dimension expressions over it."""
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "size": size_column(),
                             "text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))})
    docs = docs.withColumn("_hash", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 64 - HASH_BITS))
    return docs, _dims(docs)


def _key(dim: str) -> Column:
    return F.shiftleft(F.col(f"_d_{dim}"), HASH_BITS).bitwiseOR(F.col("_hash"))


def _walk(node: Node, at_leaf) -> Column:
    if node.left is None:
        return at_leaf(node)
    return F.when(_key(node.dim) < node.cut, _walk(node.left, at_leaf)).otherwise(_walk(node.right, at_leaf))


def _by_node(nodes: list[Node], value) -> Column:
    """The value of the node that a row is in, by node number."""
    out = F.lit(None)
    for k, n in enumerate(nodes):
        out = F.when(F.col("_node") == k, value(n)).otherwise(out)
    return out


def build_tree(rows: DataFrame, dims: list[str], leaves: int) -> Node:
    """The tree over staged metadata ``rows``: size, _hash and one ``_d_`` column per dimension."""
    root = Node(leaves, 0)
    while True:
        numbers: dict[int, int] = {}
        active: list[Node] = []

        def number(n: Node) -> Column:
            if n.leaves > 1:
                numbers[id(n)] = len(active)
                active.append(n)
            return F.lit(numbers.get(id(n))).cast("int")
        inside = rows.withColumn("_node", _walk(root, number))
        if not active:
            return root
        inside = inside.filter("_node IS NOT NULL")
        stat = {r["_node"]: r for r in inside.groupBy("_node").agg(F.sum("size").alias("w"), *[
            (F.max(f"_d_{d}") - F.min(f"_d_{d}")).alias(d) for d in dims]).collect()}
        for k, n in enumerate(active):
            n.dim = max(dims, key=lambda d: stat[k][d]) if k in stat else dims[0]
        inside = inside.withColumn("_k", _by_node(active, lambda n: _key(n.dim)))
        # Per node: lower end of the bucket that holds the cut, its bits, and the bytes below it.
        low, below = [0] * len(active), [0] * len(active)
        target = [(stat[k].w if k in stat else 0) * (n.leaves // 2) / n.leaves for k, n in enumerate(active)]
        bits = KEY_BITS
        while bits > 0:
            width = max(bits - STEP_BITS, 0)
            at = {id(n): low[k] for k, n in enumerate(active)}
            off = F.col("_k") - _by_node(active, lambda n: F.lit(at[id(n)]))
            hist = (inside.withColumn("_off", off).filter((F.col("_off") >= 0) & (F.col("_off") < F.lit(1 << bits if bits < 63 else (1 << 63) - 1)))
                    .groupBy("_node", F.shiftright("_off", width).alias("bucket")).agg(F.sum("size").alias("w")))
            run = F.sum("w").over(Window.partitionBy("_node").orderBy("bucket"))
            goal = F.lit(0.0)
            for k in range(len(active)):
                goal = F.when(F.col("_node") == k, F.lit(float(target[k] - below[k]))).otherwise(goal)
            crossing = (hist.withColumn("run", run).filter(F.col("run") >= goal).groupBy("_node")
                        .agg(F.min(F.struct("bucket", "run", "w")).alias("c")).collect())
            heaviest = 0.0
            for r in crossing:
                k = r["_node"]
                low[k] += r.c.bucket << width
                below[k] += r.c.run - r.c.w
                heaviest = max(heaviest, r.c.w / max(stat[k].w, 1))
                # The nearer end of the bucket is the cut, unless a further pass narrows it.
                nearer = below[k] + r.c.w - target[k] <= target[k] - below[k]
                active[k].cut = low[k] + (1 << width if nearer else 0)
            bits = width
            if heaviest < 1e-4:
                break
        for n in active:
            n.cut = min(n.cut or 0, (1 << 63) - 1)
            n.left = Node(n.leaves // 2, n.first)
            n.right = Node(n.leaves - n.leaves // 2, n.first + n.leaves // 2)


def shard_columns(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``docs`` with size, text_crc32 and shard. ``leaves``, or as many as ``target_bytes`` asks
    for. Null texts have 0 bytes; a null doc_id, language or source is a value like any other; rows alike in all
    go to the same shard; an empty table gives no rows."""
    table, dims = _table(docs)
    meta = stage(table.select("size", "_hash", *[c.alias(f"_d_{d}") for d, c in dims.items()]), "metadata")
    if leaves is None:
        total = meta.agg(F.sum("size")).first()[0] or 0
        leaves = max(1, ceil(total / target_bytes))
    root = build_tree(meta, list(dims), leaves)
    table = table.withColumns({f"_d_{d}": c for d, c in dims.items()})
    return table.withColumn("shard", _walk(root, lambda n: F.lit(n.first))).drop(*[f"_d_{d}" for d in dims])


def kd_shards(docs: DataFrame, leaves: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row. Slots are counted by
    shard and hash part, so that no shard is one task."""
    slim = stage(shard_columns(docs, leaves).select("doc_id", "size", "text_crc32", "_hash", "shard"), "shards")
    parts = max(64, ceil(slim.count() / leaves / 2000))
    rows = slim.withColumn("_part", F.pmod("_hash", F.lit(parts)))
    counts = rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "_part", (F.sum("n").over(
        Window.partitionBy("shard").orderBy("_part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_hash", "doc_id", "text_crc32", "size")) - 1
    return (rows.withColumn("own", own).join(before, ["shard", "_part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                    (F.col("before") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def write_shards(docs: DataFrame, path: str, target_bytes: int) -> None:
    """Write all columns of ``docs`` as Parquet, one folder per shard of about ``target_bytes``."""
    out = shard_columns(docs.drop("shard"), target_bytes=target_bytes)
    out.select(*[c for c in docs.columns if c != "shard"], "shard").write.partitionBy("shard").parquet(path)
