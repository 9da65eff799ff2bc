import random

import pytest

CLASHING = ["key", "start", "end", "node", "fp", "check", "ids", "shard", "size", "_key", "_row_key", "words", "seg", "anchor", "place"]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, repeated ids, shared passages, copies."""
    rng = random.Random(5)
    shared, line = prose(rng, 90), prose(rng, 25)
    base = prose(rng, 150)
    near = base.split(" ")
    near[70] = "changed"
    rows = [(1, prose(rng, 60) + "\n" + shared), (2, shared + " " + prose(rng, 40)), (3, base), (4, base), (5, " ".join(near)),
            (6, None), (7, ""), (8, " \t\n "), (9, "One two"), (10, line + " " + line + " " + line), (11, prose(rng, 20) + "  " + line.upper()),
            (12, prose(rng, 30_000)), (13, "a" * 6_000), (14, "ab " * 3_000), (15, prose(rng, 19)), (16, "l'été d'où we'll 're  \n x²½ 漢字 👍🏽"),
            (None, shared), (None, None), (20, base), (20, base), (21, "same id, one text"), (21, "same id, other text"),
            (22, "Licensed under the Apache License, Version 2.0.\n" + prose(rng, 30)), (23, "\x85 　\x1c " + line)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    from pyspark.sql import functions as F
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in odd_rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
