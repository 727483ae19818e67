"""Scalar column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
NO_GENRES = "(no genres listed)"
TITLE_YEAR_PATTERN = r"\((\d{4})\)\s*$"
TOP_K_MIN, TOP_K_MAX = 1, 500
BATCH_MIN, BATCH_MAX = 1, 100


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_genres(genres: str | Column) -> Column:
    """Pipe-separated genres → trimmed list without empties and the no-genre sentinel; null → []."""
    parts = F.transform(F.split(F.coalesce(_col(genres), F.lit("")), r"\|"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") & (x != NO_GENRES))


def movie_year(title: str | Column) -> Column:
    """Release year from a trailing "(yyyy)" in the title, null when absent."""
    raw = F.regexp_extract(_col(title), TITLE_YEAR_PATTERN, 1)
    return F.when(raw == "", F.lit(None)).otherwise(raw).cast("int")


def popularity_score(num_ratings: str | Column) -> Column:
    return F.log1p(_col(num_ratings).cast("double"))


def sigmoid_score(score: str | Column, digits: int = 4) -> Column:
    """round(1/(1+exp(-s)), digits); -inf gives 0.0."""
    s = _col(score).cast("double")
    return F.round(1.0 / (1.0 + F.exp(-s)), digits)


def title_contains(title: str | Column, query: str) -> Column:
    """Case-insensitive substring test; null title → false."""
    return F.coalesce(F.lower(_col(title)).contains(query.lower()), F.lit(False))


def title_truncate(title: str | Column, width: int = 30) -> Column:
    return F.substring(_col(title), 1, width)


def safe_f1(precision: str | Column, recall: str | Column) -> Column:
    p, r = _col(precision), _col(recall)
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2.0 * p * r / (p + r))


def epoch_to_timestamp(seconds: str | Column) -> Column:
    return F.timestamp_seconds(_col(seconds))


def valid_top_k(top_k: str | Column) -> Column:
    k = _col(top_k)
    return k.isNotNull() & (k >= TOP_K_MIN) & (k <= TOP_K_MAX)


def valid_batch_size(n_users: str | Column) -> Column:
    n = _col(n_users)
    return n.isNotNull() & (n >= BATCH_MIN) & (n <= BATCH_MAX)
