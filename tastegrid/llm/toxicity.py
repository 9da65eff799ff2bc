"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier learns from confirmed toxic examples and unlabelled text. The risk of unlabelled
text as negative, less the share of it that the class prior puts down to hidden positives, is kept
from going below zero, so a flexible model cannot win by denying them. Features are a text's
distinct words and word beginnings; numpy trains on a bounded sample on the driver, and every
whole text is scored in the tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.texts import hash_share, slices, two_columns
from tastegrid.session import stage

WORD = re.compile(r"[^\W\d_]+")
FOLDS = 5
# Bounds (on average; twice as many at most) of the training sample: rows confirmed toxic, and unlabelled rows.
POSITIVES, UNLABELLED = 2_000, 6_000
# A feature is learnt if it is in so many sample texts, and more frequent among the positive ones by
# so many standard errors.
MIN_DOCS, MIN_Z = 5, 3.0


def features(text: str) -> set[str]:
    """Distinct lower-case words, and ^ with the first four and five letters of longer ones."""
    words = set(WORD.findall(text.lower()))
    out = set(words)
    out.update(["^" + w[:4] for w in words if len(w) > 4])
    out.update(["^" + w[:5] for w in words if len(w) > 5])
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text modulo 5 is 0; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int, prior: float,
               rounds: int = 250, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the logistic loss under the non-negative risk
    prior·P(+) + max(0, U(−) − prior·P(−)). Where the bracket is negative, the step goes up its gradient."""
    rows = positive + unlabelled
    size = np.array([len(r) for r in rows])
    col = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    is_p = np.arange(len(rows)) < len(positive)
    n_p, n_u = max(len(positive), 1), max(len(unlabelled), 1)
    w, b = np.zeros(width), math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, w[col], len(rows))
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        loss_neg = np.logaddexp(0, z)
        bracket = loss_neg[~is_p].sum() / n_u - prior * loss_neg[is_p].sum() / n_p
        g_pos = np.where(is_p, prior * (p - 1) / n_p, 0)  # of the positives as positives
        g_neg = np.where(is_p, -prior * p / n_p, p / n_u)  # of the bracket
        g = g_pos + g_neg if bracket >= 0 else -g_neg
        grad = np.append(np.bincount(col, g[row], width) + (decay * w if bracket >= 0 else 0), g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[dict[str, float], float]:
    """Weights by feature, and the bias. Labels come only from rows that are not held out: the
    confirmed toxic ones, and the prior, which is their share of all labelled rows. The unlabelled sample
    is drawn from the same rows without looking at the label. Both samples take rows by a share of the id
    hash that meets the bounds on average. Without a confirmed example every
    score is the prior, at most 0.49."""
    spark = docs.sparkSession
    known = (labels.filter(~held_out() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max("toxic").cast("int").alias("toxic")))
    n, toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    prior = min(max((toxic or 0) / max(n, 1), 1e-4), 0.9)
    if not toxic:
        return {}, math.log(min(prior, 0.49) / (1 - min(prior, 0.49)))
    pick = known.withColumn("o", F.xxhash64("doc_id"))
    sample = (hash_share(pick.filter("toxic = 1"), F.col("o"), positives, toxic).select("doc_id", F.lit(1).alias("y"))
              .union(hash_share(pick, F.xxhash64("o"), unlabelled, n).select("doc_id", F.lit(0).alias("y"))))
    chosen = two_columns(docs).join(sample, "doc_id").select(F.col("y").cast("long").alias("doc_id"), "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ys, texts in slices(batches):
            yield pa.RecordBatch.from_pydict({"y": pa.array(ys, pa.int64()), "f": pa.array([sorted(features(t)) for t in texts], pa.list_(pa.string()))})
    read_sample = stage(chosen.mapInArrow(read, "y long, f array<string>"), "sample")
    n_p, n_u = (read_sample.filter(f"y = {y}").count() for y in (1, 0))
    if not n_p or not n_u:  # the labelled rows' texts are not in the table
        return {}, math.log(min(prior, 0.49) / (1 - min(prior, 0.49)))
    in_p, in_u = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    share = (F.col("p") + F.col("u")) / F.lit(n_p + n_u)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-12)
    vocab = [r.f for r in read_sample.select("y", F.explode("f").alias("f")).groupBy("f").agg(in_p.alias("p"), in_u.alias("u"))
             .filter((F.col("p") + F.col("u") >= MIN_DOCS) & (z >= MIN_Z)).select("f").orderBy("f").collect()]
    place = spark.sparkContext.broadcast({f: k for k, f in enumerate(vocab)})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = place.value
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"y": batch.column(0), "f": pa.array(
                [[at[f] for f in fs if f in at] for fs in batch.column(1).to_pylist()], pa.list_(pa.int32()))})
    rows = read_sample.mapInArrow(number, "y long, f array<int>").orderBy("y", "f").collect()
    sides = [[np.array(r.f, np.int64) for r in rows if r.y == y] for y in (1, 0)]
    w, b = train_nnpu(sides[0], sides[1], len(vocab), prior)
    return {f: float(x) for f, x in zip(vocab, w) if abs(x) > 1e-3}, b


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: the score of its whole text. A null text is
    empty and has the bias alone; repeated rows and null ids stay. Weights, at most one per
    feature of the bounded sample, travel with the tasks."""
    weights, bias = fit(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.value
        known = frozenset(weight)
        for ids, texts in slices(batches):
            z = [bias + math.fsum(weight[f] for f in known.intersection(features(t))) for t in texts]
            score = [1 / (1 + math.exp(-min(max(x, -50.0), 50.0))) for x in z]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})
    scored = two_columns(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not predicted toxic. A null text stays."""
    weights, bias = fit(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("boolean")
    def clean(texts):
        weight = model.value
        known = frozenset(weight)
        return texts.map(lambda t: bias + math.fsum(weight[f] for f in known.intersection(features(t or ""))) < 0)
    return docs.filter(clean(F.coalesce(F.col("text").cast("string"), F.lit(""))))
