"""Column expressions for item text."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens are runs of two or more word characters; titles keep only
# lower-case letters, digits and white space; genres are separated by this character.
TOKEN_PATTERN = r"(?U)\b\w\w+\b"
TITLE_STRIP = r"[^a-z0-9\s]"
GENRE_DELIMITER = "|"


def clean_title(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(c), TITLE_STRIP, "")


def clean_genres(c: Column | str) -> Column:
    return F.lower(F.replace(F.col(c) if isinstance(c, str) else c, F.lit(GENRE_DELIMITER), F.lit(" ")))


def feature_text(title: str = "title", genres: str = "genres") -> Column:
    return F.trim(F.concat_ws(" ", clean_title(title), clean_genres(genres)))


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), F.lit(0))


def default_stop_words() -> list[str]:
    """Spark's own English list, kept as a text file so that plain SQL can use it too."""
    with open(os.path.join(os.path.dirname(__file__), "stop_words.txt"), encoding="utf-8") as f:
        return [w.strip() for w in f if w.strip() and not w.startswith("#")]
