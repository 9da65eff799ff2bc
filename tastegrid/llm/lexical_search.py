"""Ranked lexical search of all items against all documents by dense blocked matrix products.

Items form tiles with a compact vocabulary of their own; a task turns its documents' impacts on that vocabulary
into dense tiles and multiplies both by BLAS in float64. All factors are whole numbers, an impact is below
10^6, and vocabulary tiles are cut so that no partial sum reaches 2^53: each product is exact and is added
as a 64-bit integer. A tile's best k keep every row that ties with the k-th until ids have decided.

Documents are read twice at most: the first pass writes their counts of the items' terms, from which Spark
sums document frequencies; the second scores what was written. Items go in groups of a bounded number of
terms, so what the driver and each task hold of them does not grow with the benchmark.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.llm.texts import identified, slices
from tastegrid.session import stage

# Terms of the items of one group, repeats in one item aside.
GROUP_TERMS = 500_000
TILE_ITEMS = 64
TILE_TERMS = 4_096
TILE_CELLS = 2_000_000
EXACT = 1 << 53
IMPACT = 1_000_000
PART = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Tile(NamedTuple):
    items: np.ndarray     # item numbers
    parts: list           # (codes, weights: codes x items) per vocabulary tile


def terms(text: str | None) -> list[bytes]:
    """Maximal stretches of ASCII letters and digits and of all that is not ASCII; A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(PART).split()


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, terms, counts) of (item, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in slices(batches):
            found = [Counter(terms(t)) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "item": pa.array(keys, pa.int64()), "terms": pa.array([list(c) for c in found], pa.list_(pa.binary())),
                "counts": pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))})
    return items.mapInArrow(run, "item long, terms array<binary>, counts array<long>")


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, codes, tf): the number of all terms and the counts of those in the vocabulary."""
    shared, known = docs.sparkSession.sparkContext.broadcast(vocabulary), max(len(vocabulary), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.get
        for ids, texts in slices(batches):
            lists = [terms(t) for t in texts]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            codes = np.fromiter((c for words in lists for c in map(find, words, repeat(-1))), np.int64, int(size.sum()))
            owner = np.repeat(np.arange(len(lists)), size)
            held, tf = np.unique(owner[codes >= 0] * known + codes[codes >= 0], return_counts=True)
            cut = np.searchsorted(held, np.arange(len(lists) + 1) * known).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(size), pa.ListArray.from_arrays(cut, pa.array((held % known).astype(np.int32))),
                 pa.ListArray.from_arrays(cut, pa.array(tf.astype(np.int64)))], names=["doc_id", "n", "codes", "tf"])
    return docs.mapInArrow(run, "doc_id long, n long, codes array<int>, tf array<long>")


def _document_frequencies(postings: DataFrame, known: int) -> np.ndarray:
    """Documents holding each code: added up in each task, then by code across tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(known, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=known)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": pa.array(some.astype(np.int32)), "df": pa.array(total[some])})
    out = np.zeros(known, np.int64)
    for r in postings.select("codes").mapInArrow(run, "code int, df long").groupBy("code").agg(F.sum("df").alias("df")).collect():
        out[r.code] = r.df
    return out


def tiles(items: list[tuple[int, np.ndarray, np.ndarray]], weight: np.ndarray, most: int = EXACT) -> list[Tile]:
    """Item tiles of (item, codes, counts). A vocabulary tile ends before any item's partial sum could reach ``most``."""
    out = []
    for at in range(0, len(items), TILE_ITEMS):
        part = items[at:at + TILE_ITEMS]
        codes = np.unique(np.concatenate([c for _, c, _ in part]))
        whole = np.zeros((len(codes), len(part)))
        for j, (_, c, n) in enumerate(part):
            whole[np.searchsorted(codes, c), j] = weight[c] * n
        if whole.max(initial=0) * IMPACT >= most:
            raise ValueError("an item repeats a term too often for an exact product")
        cuts, total = [0], np.zeros(len(part))
        for k in range(len(codes)):
            if k - cuts[-1] >= TILE_TERMS or (total + whole[k]).max() * IMPACT >= most:
                cuts.append(k)
                total[:] = 0
            total += whole[k]
        cuts.append(len(codes))
        out.append(Tile(np.array([i for i, _, _ in part]), [(codes[a:b], whole[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]))
    return out


class Best:
    """The best k of each item of a tile: greatest score, then least id; rows without id come last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.rows = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in range(items)]

    def add(self, scores: np.ndarray, ids: np.ndarray, without: np.ndarray) -> None:
        for j, old in enumerate(self.rows):
            own = scores[:, j]
            at = np.flatnonzero(own >= (old[0][-1] if len(old[0]) == self.k else 1))
            if len(at) > self.k:
                at = at[own[at] >= np.partition(own[at], len(at) - self.k)[len(at) - self.k]]
            if len(at):
                score, i, w = (np.concatenate(x) for x in zip(old, (own[at], ids[at], without[at])))
                order = np.lexsort((i, w, -score))[:self.k]
                self.rows[j] = score[order], i[order], w[order]


def _scored(postings: DataFrame, plan: list[Tile], known: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the best k of each partition for each item."""
    shared = postings.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        best = [Best(len(t.items), k) for t in plan]
        column = np.full(known, -1, np.int64)
        rows = max(1, TILE_CELLS // max((len(c) for t in plan for c, _ in t.parts), default=1))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                n = part.column(1).to_numpy()
                m = 100 - 25 + (25 * n * n_docs) // n_terms
                codes, tf = part.column(2), part.column(3)
                held = np.diff(codes.offsets.to_numpy())
                owner = np.repeat(np.arange(part.num_rows), held)
                codes, tf = codes.flatten().to_numpy(), tf.flatten().to_numpy()
                impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[owner])
                without = part.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = part.column(0).fill_null(0).to_numpy()
                for tile, top in zip(plan, best):
                    total = np.zeros((part.num_rows, len(tile.items)), np.int64)
                    for own, weights in tile.parts:
                        column[own] = np.arange(len(own))
                        at_column = column[codes]
                        inside = at_column >= 0
                        dense = np.zeros((part.num_rows, len(own)))
                        dense[owner[inside], at_column[inside]] = impact[inside]
                        column[own] = -1
                        total += (dense @ weights).astype(np.int64)
                    top.add(total, ids, without)
        found = [(i, *r) for t, b in zip(plan, best) for i, r in zip(t.items.tolist(), b.rows) if len(r[0])]
        if found:
            size = [len(r[1]) for r in found]
            score, ids, without = (np.concatenate([r[c] for r in found]) for c in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([r[0] for r in found], size).astype(np.int64)),
                                              pa.array(ids, pa.int64(), mask=without), pa.array(score)], names=["item", "doc_id", "score"])
    return postings.select("doc_id", "n", "codes", "tf").mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): for every row of ``items`` (item_id, text) the ``k`` rows of ``docs`` of highest
    score above 0, equal scores by ascending doc_id, rows without doc_id last.

    With N documents that hold a term, L terms in all, n terms in a document, df documents with a term and tf of its
    occurrences in one, a term weighs w = floor(1000 ln((2N + 2) / (2df + 1))), m = 75 + 25nN div L, and the score
    sums w * ((10^9 tf) div (1000 tf + 12m)) over the item's terms, repeats included. Null and blank texts hold no
    term and rank nowhere; an item without terms has no rows. Repeated rows of either table rank as rows of their own;
    other columns are not read."""
    spark = docs.sparkSession
    keyed, key = identified(items.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    named = keyed.select(F.col(key).alias("item"), F.col("doc_id").alias("item_id"))
    listed = stage(_item_terms(keyed.select(F.col(key).alias("item"), "text")).filter(F.size("terms") > 0), "items")
    groups = -(-(listed.agg(F.sum(F.size("terms"))).first()[0] or 0) // GROUP_TERMS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = spark.createDataFrame([], "item long, doc_id long, score long")
    for g in range(groups):
        own = listed.filter(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).collect()
        vocabulary: dict[bytes, int] = {}
        coded = [(r.item, np.array([vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r.terms]), np.array(r.counts, float)) for r in own]
        if not coded:
            continue
        postings = stage(_postings(texts, vocabulary), "postings")
        n_docs, n_terms = postings.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        df = _document_frequencies(postings, len(vocabulary))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], float)
        plan = tiles(coded, weight)
        best = _scored(postings.filter(F.size("codes") > 0), plan, len(vocabulary), n_docs, n_terms, k)
        found = found.union(best)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(named, "item").select("item_id", "rank", "doc_id", "score")


SQL = """WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM benchmark),
counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM docs) GROUP BY doc_id, term),
wanted AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(t) AS term FROM items) GROUP BY item_id, term),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM docs WHERE len(t) > 0),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM counts, total GROUP BY term, n_docs),
lengths AS (SELECT doc_id, 100 - 25 + ((25 * len(t) * n_docs) // n_terms) AS m FROM docs, total WHERE len(t) > 0),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20"""
