"""Descriptive statistics of rating tables (the exploratory analysis, as Spark jobs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.functions import parse_genres, title_truncate
from rankfold.operators.ordering import quantiles, positions, running_totals
from rankfold.operators.prep import interaction_edges, kcore_edges, sparsity_expr


def rating_histogram(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def rating_cdf(ratings: DataFrame) -> DataFrame:
    """(rating, n, cum_n, cdf): share of rows with rating <= value, per distinct value."""
    hist = rating_histogram(ratings)
    cum = running_totals(hist, ["rating"], ["n"])
    n_all = hist.agg(F.sum("n")).first()[0] or 0
    return cum.select(
        "rating",
        "n",
        F.col("n_cum").cast("bigint").alias("cum_n"),
        F.round(F.col("n_cum") / F.lit(float(max(n_all, 1))), 6).alias("cdf"),
    )


def rating_summary(ratings: DataFrame) -> DataFrame:
    return ratings.agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.round(F.avg("rating"), 6).alias("mean"),
        F.round(F.percentile("rating", 0.5), 6).alias("median"),
        F.count_distinct("userId").cast("bigint").alias("n_users"),
        F.count_distinct("movieId").cast("bigint").alias("n_items"),
    )


def activity_summary(ratings: DataFrame, key: str, low: int, high: int | None = None) -> DataFrame:
    """Rows per key: count, mean, median, max, share below ``low`` (and at/above ``high``)."""
    per = ratings.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    aggs = [
        F.count(F.lit(1)).cast("bigint").alias("n_keys"),
        F.round(F.avg("c"), 6).alias("mean"),
        F.round(F.percentile("c", 0.5), 6).alias("median"),
        F.max("c").cast("bigint").alias("max"),
        F.sum(F.when(F.col("c") < low, 1).otherwise(0)).cast("bigint").alias("n_below"),
        F.round(F.avg((F.col("c") < low).cast("double")), 6).alias("share_below"),
    ]
    if high is not None:
        aggs += [
            F.sum(F.when(F.col("c") >= high, 1).otherwise(0)).cast("bigint").alias("n_at_or_above"),
            F.round(F.avg((F.col("c") >= high).cast("double")), 6).alias("share_at_or_above"),
        ]
    return per.agg(*aggs)


def activity_rank(ratings: DataFrame, key: str) -> DataFrame:
    """Rank-size table: (key, n, rank) with rank 1 = most active (ties by key)."""
    per = ratings.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    ranked = positions(per, [F.col("n").desc(), F.col(key).asc()], out="_p")
    return ranked.select(key, "n", (F.col("_p") + 1).alias("rank"))


def top_items(ratings: DataFrame, movies: DataFrame, n: int = 20, width: int = 30) -> DataFrame:
    """Top-n items by rating count with title and short title (TakeOrderedAndProject)."""
    counts = ratings.groupBy("movieId").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    top = counts.orderBy(F.col("n").desc(), F.col("movieId").asc()).limit(n)
    return top.join(movies.select("movieId", "title"), "movieId", "left").select(
        "movieId", "n", "title", title_truncate("title", width).alias("short_title")
    )


def genre_rows(movies: DataFrame) -> DataFrame:
    """(movieId, genre): one row per parsed genre."""
    return movies.select("movieId", F.explode(parse_genres("genres")).alias("genre"))


def genre_counts(movies: DataFrame) -> DataFrame:
    return genre_rows(movies).groupBy("genre").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def genre_ratings(movies: DataFrame, ratings: DataFrame) -> DataFrame:
    """Per genre: mean rating and rating count (genres left-joined to ratings), plus the
    unweighted mean of the genre means."""
    g = genre_rows(movies)
    r = ratings.select("movieId", "rating")
    per = g.join(r, "movieId", "left").groupBy("genre").agg(
        F.avg("rating").alias("_mean"), F.count("rating").cast("bigint").alias("n")
    )
    # one row per genre: a window over the whole (vocabulary-sized) table is bounded
    mom = F.avg("_mean").over(Window.partitionBy())
    return per.select(
        "genre", F.round("_mean", 6).alias("mean_rating"), "n", F.round(mom, 6).alias("mean_of_means")
    )


def to_ts(col: str) -> F.Column:
    return F.timestamp_seconds(F.col(col))


def monthly_volume(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy(F.to_date(F.date_trunc("month", to_ts("timestamp"))).alias("month")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n")
    )


def quarterly_rating(ratings: DataFrame) -> DataFrame:
    """Mean rating per calendar quarter, every quarter between the first and last one
    (empty quarters → null), labelled by the quarter's last day."""
    q = F.to_date(F.date_trunc("quarter", to_ts("timestamp")))
    per = ratings.groupBy(q.alias("q")).agg(F.avg("rating").alias("_m"))
    bounds = per.agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    # one row per quarter of the observed span: bounded by the time range
    spine = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 3 months"))).alias("q"))
    return spine.join(per, "q", "left").select(
        F.last_day(F.add_months("q", 2)).alias("quarter_end"), F.round("_m", 6).alias("mean_rating")
    )


def sparsity(ratings: DataFrame, user_col: str = "userId", item_col: str = "movieId") -> DataFrame:
    agg = ratings.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_ratings"),
        F.count_distinct(user_col).cast("bigint").alias("n_users"),
        F.count_distinct(item_col).cast("bigint").alias("n_items"),
    )
    return agg.withColumn(
        "sparsity", F.round(sparsity_expr(F.col("n_ratings"), F.col("n_users"), F.col("n_items")), 6)
    )


def threshold_sweep(ratings: DataFrame, thresholds: list[tuple[int, int]]) -> DataFrame:
    """k-core size and sparsity for several (min_user, min_item) settings.

    A core with larger thresholds lies inside one with smaller ones, so each setting starts from
    the edges of the largest finished setting below it; sizes come from the edges.
    """
    done: dict[tuple[int, int], DataFrame] = {}
    out = None
    for mu, mi in sorted(thresholds):
        below = [t for t in done if t[0] <= mu and t[1] <= mi]
        start = done[max(below)] if below else interaction_edges(ratings)
        edges = done[mu, mi] = kcore_edges(start, mu, mi).edges
        agg = edges.agg(
            F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint").alias("n_ratings"),
            F.count_distinct("userId").cast("bigint").alias("n_users"),
            F.count_distinct("movieId").cast("bigint").alias("n_items"),
        )
        row = agg.select(
            F.lit(mu).alias("min_user_ratings"), F.lit(mi).alias("min_item_ratings"), "*",
            F.round(sparsity_expr(F.col("n_ratings"), F.col("n_users"), F.col("n_items")), 6).alias("sparsity"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long describe table: (feature, stat, value) with count, mean, std, min, 25/50/75%, max.

    Quartiles are exact with linear interpolation (:func:`ordering.quantiles`)."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {pairs}) AS (feature, x)")
    moments = long.groupBy("feature").agg(
        F.count("x").cast("double").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"),
    )
    wide = moments.join(quantiles(long, "x", (0.25, 0.5, 0.75), ["feature"]), "feature", "left")
    named = [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("25%", "q0"), ("50%", "q1"), ("75%", "q2"), ("max", "max")]
    stacked = ", ".join(f"'{stat}', `{column}`" for stat, column in named)
    return wide.selectExpr("feature", f"stack({len(named)}, {stacked}) AS (stat, value)").select(
        "feature", "stat", F.round("value", 6).alias("value")
    )


def correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every column pair (rows with any null dropped): long form."""
    clean = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    aggs = [F.corr(a, b).alias(f"{a}|{b}") for a in cols for b in cols]
    wide = clean.agg(*aggs)
    pairs = ", ".join(f"'{a}', '{b}', `{a}|{b}`" for a in cols for b in cols)
    return wide.selectExpr(f"stack({len(cols) ** 2}, {pairs}) AS (col_a, col_b, corr)").select(
        "col_a", "col_b", F.round("corr", 6).alias("corr")
    )
