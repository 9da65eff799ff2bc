"""Candidate sets, anti joins and top-N lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A catalog longer than this is never enumerated per user; use operators.blocks.
CATALOG_LIMIT = 1000


def candidate_cells(users: DataFrame, catalog: list, item: str = "item_id") -> DataFrame:
    """Every user with every item of a short fixed catalog, e.g. the columns of a wide
    file. Each user row fans out in place: no shuffle and no cross join."""
    if len(catalog) > CATALOG_LIMIT:
        raise ValueError("catalog too long to enumerate; rank it with operators.blocks")
    return users.select("*", F.explode(F.array(*[F.lit(i) for i in catalog])).alias(item))


def seen_pairs(*frames: DataFrame, user: str = "user_id", item: str = "item_id", tasks: int | None = None) -> DataFrame:
    """Union of rated pairs, each pair once; ``tasks``: shuffle partitions, where the session's are too few."""
    out = frames[0].select(user, item)
    for f in frames[1:]:
        out = out.union(f.select(user, item))
    return (out.repartition(tasks, user, item) if tasks else out).distinct()


def anti_seen(cands: DataFrame, *seen: DataFrame, user: str = "user_id",
              item: str = "item_id") -> DataFrame:
    """Candidates minus pairs the user has rated. Anti joins need no distinct."""
    for s in seen:
        cands = cands.join(s.select(user, item), [user, item], "left_anti")
    return cands


def topn(df: DataFrame, n: int = 5, score: str | Column = "score", ties: str = "exact",
         tie_break: str = "item_id", by: str = "user_id", rank: str = "rank") -> DataFrame:
    """Top n rows per key. ``ties='rank'`` keeps all rows tied at the cut.

    The rank filter is pushed below the shuffle as a group limit, so even a key with
    most of the rows sends at most n (plus ties) of them per task.
    """
    score = F.col(score) if isinstance(score, str) else score
    if ties == "rank":
        pos = F.rank().over(Window.partitionBy(by).orderBy(score.desc()))
    else:
        pos = F.row_number().over(Window.partitionBy(by).orderBy(score.desc(), F.col(tie_break)))
    return df.withColumn(rank, pos.cast("long")).filter(F.col(rank) <= n)


def topn_single_user(df: DataFrame, user_id: int, n: int = 5, score: str = "score",
                     user: str = "user_id", tie_break: str = "item_id") -> DataFrame:
    return df.filter(F.col(user) == user_id).orderBy(F.col(score).desc(), tie_break).limit(n)
