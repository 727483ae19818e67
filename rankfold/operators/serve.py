"""Batch versions of the serving paths: enrichment, popular fallback, routing, batches.

The reference answers one HTTP request at a time; here a *request table* is
answered in one job.  Known users get model lists, unknown users the popular
fallback; every list is enriched with title and genres.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.functions import parse_genres, sigmoid_score
from rankfold.operators.prep import BROADCAST_NODES, few
from rankfold.session import materialize

FALLBACK_SIZE = 100  # fixed value: length of the list of popular items


def enrich(
    recs: DataFrame,
    movie_map: DataFrame,
    movies: DataFrame,
    item_col: str = "movie_idx",
    items: DataFrame | None = None,
) -> DataFrame:
    """Attach original movie id, title (default "Movie <id>") and parsed genres (default []).

    Ids, titles and genres are joined and parsed once for each item, so the lists meet one table.
    ``items``: the different items of ``recs`` where a written table has them; if these are few, what
    belongs to them is broadcast and the lists are not shuffled.
    """
    ids = movie_map.select(F.col("encoded_id").cast("bigint").alias("_item"), F.col("original_id").alias("_id"))
    meta = movies.select(F.col("movieId").alias("_id"), F.col("title").alias("_title"), parse_genres(F.col("genres")).alias("_genres"))
    if items is not None:
        wanted = materialize(items.select(F.col(item_col).cast("bigint").alias("_item")).where("_item IS NOT NULL").distinct(), "listed-items")
        n_wanted = wanted.count()
        wanted = few(wanted, n_wanted)
        ids = ids.join(wanted, "_item", "left_semi")
    # an item outside the map is its own movie
    other = meta.withColumn("_item", F.col("_id").cast("bigint")).join(ids.select("_item"), "_item", "left_anti")
    if items is not None:
        other = other.join(wanted, "_item", "left_semi")
    known = ids.join(meta, "_id", "left").select("_item", "_id", "_title", "_genres").unionByName(other)
    if items is not None and n_wanted <= BROADCAST_NODES:
        written = materialize(known, "listed-movies")  # movies can repeat: counted before they are broadcast
        known = few(written, written.count())
    movie_id = F.coalesce(F.col("_id"), F.col(item_col).cast("bigint"))
    return recs.join(known, F.col(item_col).cast("bigint") == F.col("_item"), "left").select(
        *[c for c in recs.columns if c != item_col],
        movie_id.alias("movie_id"),
        F.coalesce(F.col("_title"), F.concat(F.lit("Movie "), movie_id.cast("string"))).alias("title"),
        F.coalesce(F.col("_genres"), F.array().cast("array<string>")).alias("genres"),
    )


def popular_fallback(
    seen: DataFrame,
    movie_map: DataFrame,
    movies: DataFrame,
    size: int = FALLBACK_SIZE,
    item_col: str = "movie_idx",
    user_col: str = "user_idx",
) -> DataFrame:
    """Top ``size`` items by number of distinct users who saw them; score = round(count/max, 6).

    ``(fb_rank, movie_id, title, score, genres)``; ties by item ascending.
    """
    counts = seen.select(user_col, item_col).distinct().groupBy(item_col).agg(F.count(F.lit(1)).alias("_cnt"))
    top = counts.orderBy(F.col("_cnt").desc(), F.col(item_col).asc()).limit(size)  # TakeOrderedAndProject
    # the overall maximum is the first entry of the top list: windows over <= size rows
    ranked = top.select(
        item_col,
        F.round(F.col("_cnt") / F.max("_cnt").over(Window.partitionBy()), 6).alias("score"),
        # at most `size` rows: a global window over them is bounded
        F.row_number().over(Window.orderBy(F.col("_cnt").desc(), F.col(item_col).asc())).alias("fb_rank"),
    )
    return enrich(ranked, movie_map, movies, item_col)


def route_requests(requests: DataFrame, user_map: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Flag each request as warm (known user → user_idx) or cold (unknown user)."""
    m = user_map.select(F.col("original_id").alias(user_col), F.col("encoded_id").alias("user_idx"))
    return requests.join(m, user_col, "left").withColumn("cold_start", F.col("user_idx").isNull())


def answer_requests(
    requests: DataFrame,
    user_map: DataFrame,
    model_recs: DataFrame,
    fallback: DataFrame,
    movie_map: DataFrame,
    movies: DataFrame,
) -> DataFrame:
    """One row per (request, position): warm requests get the model list with a sigmoid
    score, cold requests the fallback list; both cut to the request's ``top_k``.

    ``requests``: (request_id, user_id, top_k).  ``model_recs``: (user_idx, movie_idx, score, rank)
    holding at least max(top_k) ranks per user; ``fallback`` as many.
    """
    routed = route_requests(requests, user_map)
    warm = (
        routed.where(~F.col("cold_start"))
        .join(model_recs, "user_idx")
        .where(F.col("rank") <= F.col("top_k"))
        .select("request_id", "user_id", F.col("rank").cast("int").alias("rank"), "movie_idx",
                sigmoid_score("score").alias("score"), F.lit(False).alias("cold_start"))
    )
    warm = enrich(warm, movie_map, movies)
    # the fallback is as long as the largest top_k (<= 500 by validation): a small equi-join on rank
    cold = (
        routed.where(F.col("cold_start"))
        .select("request_id", "user_id", F.explode(F.sequence(F.lit(1), F.col("top_k"))).alias("rank"))
        .join(F.broadcast(fallback.withColumnRenamed("fb_rank", "rank")), "rank")
        .select("request_id", "user_id", F.col("rank").cast("int").alias("rank"), "movie_id", "title",
                "score", "genres", F.lit(True).alias("cold_start"))
    )
    return warm.select(*cold.columns).unionByName(cold)


def similar_items(
    vectors: DataFrame,
    n: int,
    item_col: str = "item_idx",
    vec_col: str = "vec",
) -> DataFrame:
    """Top-``n`` cosine neighbours of every item (self excluded), score = sigmoid(cosine).

    Zero-norm candidates use norm 1, a zero-norm target gets no list (reference rules).
    """
    from rankfold.operators.vectors import blocked_topk  # noqa: PLC0415

    cos = blocked_topk(vectors, n, item_col, vec_col)
    return cos.select(
        item_col,
        "neighbor",
        F.round("cosine", 6).alias("cosine"),
        sigmoid_score("cosine").alias("score"),
        "rank",
    )
