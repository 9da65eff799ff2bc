"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed covers a window of ``WINDOW`` words through a fixed mask that ignores every third of them. Seeds are taken at
every word, so the mask falls on a passage in all three phases and one of them ignores any given substituted
word. Test and training windows with equal masked hashes are hits; a hit is verified on the
words around it: of the best passage of at least ``LEAST`` words that holds the window a given share must be equal place by
place, so that words beyond an excerpt's ends are no misses. A bitmap over the test seeds, sized by their number up to
2 ** ``MOST_BITS``, goes to the scan first, so only positions that may hit leave it; the join that follows is exact at
any size of the benchmark.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.texts import identified
from tastegrid.session import stage

MASK = "11011011011"  # words looked at; pairs, so that a seed is made of four pair hashes
WINDOW = len(MASK)
PAIRS = [k for k in range(WINDOW - 1) if MASK[k:k + 2] == "11"]
AROUND = 4  # words looked at on each side of a window
SHARE = 0.8
LEAST = WINDOW  # words of the shortest excerpt that is found
BITS, MOST_BITS = 20, 23  # the bitmap has 2 ** BITS bits, more from 2 ** (BITS - 3) seeds on, 1 MB at most


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; one empty word for a text without any."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def _hashed(rows: DataFrame) -> DataFrame:
    """Adds _h, the word hashes, and _p, those of each word with the next."""
    rows = rows.withColumn("_h", F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).drop("text")
    return rows.withColumn("_p", F.transform("_h", lambda x, i: F.xxhash64(x, F.get(F.col("_h"), i + 1))))


def _seed(at: Column) -> Column:
    return F.xxhash64(*[F.get(F.col("_p"), at + k) for k in PAIRS])


def _places() -> Column:
    return F.when(F.size("_h") >= WINDOW, F.sequence(F.lit(0), F.size("_h") - WINDOW)).otherwise(F.array().cast("array<int>"))


def _bits(seeds: int) -> int:
    """Eight bits or more for each seed, as far as the bound allows."""
    return min(MOST_BITS, max(BITS, (8 * seeds - 1).bit_length()))


def _slot(seed: Column, bits: int) -> tuple[Column, Column]:
    slot = F.shiftrightunsigned(seed, 64 - bits)
    return F.shiftright(slot, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))


def _around(at: Column) -> Column:
    return F.transform(F.sequence(F.lit(-AROUND), F.lit(WINDOW + AROUND - 1)), lambda k: F.get(F.col("_h"), at + k))


def _passages(least: int) -> list[tuple[int, int]]:
    """(first place, words) of the passages of ``least`` words or more that hold the window, the widest first."""
    ends = [(a, b) for a in range(AROUND, -1, -1) for b in range(AROUND, -1, -1) if WINDOW + a + b >= least]
    return [(AROUND - a, WINDOW + a + b) for a, b in ends] or [(0, WINDOW + 2 * AROUND)]


def _reaches(known: Column, share: float, least: int) -> Column:
    """Whether ``share`` of the words of some passage of at least ``least`` words that holds the window are
    equal. ``known``: 1, 0 or, beyond an end of either text, null by place."""
    def enough(part: Column) -> Column:
        seen = F.filter(part, lambda x: x.isNotNull())
        return F.aggregate(seen, F.lit(0), lambda acc, x: acc + x) >= share * F.size(seen)
    return reduce(or_, [enough(F.slice(known, first + 1, n)) for first, n in _passages(least)])


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(key, doc_id, item_id, place): the verified hits. ``docs``: (key, doc_id, text)."""
    items = _hashed(benchmark.select("item_id", "text")).select("item_id", "_h", "_p", F.explode(_places()).alias("_at"))
    seeds = stage(items.select("item_id", _around(F.col("_at")).alias("item_words"), _seed(F.col("_at")).alias("seed")).distinct(), "seeds")
    bits = _bits(seeds.count())
    word, bit = _slot(F.col("seed"), bits)
    # At most 2 ** (MOST_BITS - 6) longs; a literal, as a function over arrays takes no subquery.
    held = {r.w: r.b for r in seeds.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).collect()}
    bitmap = F.split(F.lit(",".join(str(held.get(k, 0)) for k in range(1 << (bits - 6)))), ",").cast("array<bigint>")

    def may_hit(i: Column) -> Column:
        w, b = _slot(_seed(i), bits)
        return F.get(bitmap, w).bitwiseAND(b) != 0
    scan = _hashed(docs.select("key", "doc_id", "text"))
    places = scan.select("key", "doc_id", "_h", "_p", F.explode(F.filter(_places(), may_hit)).alias("place"))
    at = F.col("place")
    hits = places.select("key", "doc_id", "place", _around(at).alias("doc_words"), _seed(at).alias("seed"))
    met = hits.join(seeds, "seed")
    both = F.zip_with("doc_words", "item_words", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), (a == b).cast("int")))
    return met.withColumn("_both", both).filter(_reaches(F.col("_both"), share, least)).select("key", "doc_id", "item_id", "place").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, n_windows, first_word, end_word): every document with a passage of a benchmark item or an excerpt of
    ``least`` words from inside one, ``n_windows`` verified windows between two of its words. Documents and items shorter than a
    window have none, null texts no words; rows of one doc_id count as one document, repeated items as one;
    a null doc_id or item_id is kept."""
    rows = docs.select(F.col("doc_id").alias("key"), "doc_id", F.col("text").cast("string").alias("text"))
    return (leaks(rows, benchmark, share, least).groupBy("doc_id", "item_id")
            .agg(F.countDistinct("place").alias("n_windows"), F.min("place").cast("long").alias("first_word"),
                 (F.max("place") + WINDOW).cast("long").alias("end_word")))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no passage of the benchmark, nor an excerpt of ``least`` words
    from inside an item."""
    keyed, key = identified(docs)
    rows = keyed.select(F.col(key).alias("key"), "doc_id", F.col("text").cast("string").alias("text"))
    found = stage(leaks(rows, benchmark, share, least).select(F.col("key").alias(key)).distinct(), "leaks")
    return keyed.join(found, key, "left_anti").select(*docs.columns)


def _sql() -> str:
    masked = "concat_ws(' ', " + ", ".join(f"w[i + {k + 1}]" for k in range(WINDOW) if MASK[k] == "1") + ")"
    wide = "[" + ", ".join(f"CASE WHEN i + {k + 1} >= 1 THEN w[i + {k + 1}] END" for k in range(-AROUND, WINDOW + AROUND)) + "]"

    def side(table: str, key: str) -> str:
        return f"""SELECT {key}, i, {wide} AS around, {masked} AS seed
          FROM (SELECT {key}, w, UNNEST(range(0, len(w) - {WINDOW - 1})) AS i FROM (SELECT {key}, string_split(trim(
            regexp_replace(lower(COALESCE(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM {table}) t1) t2"""
    passages = " OR ".join(f"list_sum(same[{first + 1}:{first + n}]) >= {SHARE} * list_count(same[{first + 1}:{first + n}])"
                           for first, n in _passages(LEAST))
    return f"""WITH d AS ({side('documents', 'doc_id')}), b AS ({side('benchmark', 'item_id')}),
      hit AS (SELECT DISTINCT d.doc_id, b.item_id, d.i, list_transform(list_zip(d.around, b.around),
          lambda p: CASE WHEN p[1] = p[2] THEN 1 WHEN p[1] <> p[2] THEN 0 END) AS same
        FROM d JOIN b ON d.seed = b.seed)
      SELECT doc_id, item_id, COUNT(DISTINCT i) AS n_windows, MIN(i) AS first_word, MAX(i) + {WINDOW} AS end_word FROM hit
      WHERE {passages} GROUP BY doc_id, item_id"""


SQL = _sql()
