"""User, item and genre features as long-form tables (never densified)."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.functions import movie_year, parse_genres, popularity_score
from rankfold.operators.ordering import dense_index
from rankfold.session import materialize


def item_genres(movies: DataFrame, movie_map: DataFrame) -> DataFrame:
    """(movie_idx, genre) for the movies present in the id map."""
    m = movie_map.select(F.col("original_id").alias("movieId"), F.col("encoded_id").alias("movie_idx"))
    return movies.join(m, "movieId").select("movie_idx", F.explode(parse_genres("genres")).alias("genre"))


def genre_vocabulary(movies: DataFrame) -> DataFrame:
    """(genre, genre_id): sorted distinct parsed genres; null genre strings contribute nothing."""
    g = movies.where(F.col("genres").isNotNull()).select(F.explode(parse_genres("genres")).alias("genre"))
    return dense_index(g, "genre", original="genre", encoded="genre_id")


def implicit_interactions(train: DataFrame, threshold: float) -> DataFrame:
    """(user_idx, movie_idx, explicit, implicit): explicit = highest rating of the pair,
    implicit = 1 when it reaches ``threshold`` (pairs below it are absent from the 0/1 matrix)."""
    pairs = train.groupBy("user_idx", "movie_idx").agg(F.max("rating").alias("explicit"))
    return pairs.select(
        "user_idx", "movie_idx", "explicit", (F.col("explicit") >= threshold).cast("int").alias("implicit")
    )


def interaction_nnz(interactions: DataFrame) -> DataFrame:
    """Long (kind, idx, nnz): non-zeros per user row and per item column."""
    u = interactions.groupBy("user_idx").agg(F.count(F.lit(1)).cast("bigint").alias("nnz"))
    i = interactions.groupBy("movie_idx").agg(F.count(F.lit(1)).cast("bigint").alias("nnz"))
    return u.select(F.lit("user").alias("kind"), F.col("user_idx").alias("idx"), "nnz").unionByName(
        i.select(F.lit("item").alias("kind"), F.col("movie_idx").alias("idx"), "nnz")
    )


def user_features(train: DataFrame) -> DataFrame:
    """(user_idx, avg_rating, num_ratings, rating_std); std is the sample std (null for one row)."""
    return train.groupBy("user_idx").agg(
        F.avg("rating").alias("avg_rating"),
        F.count(F.lit(1)).cast("bigint").alias("num_ratings"),
        F.stddev_samp("rating").alias("rating_std"),
    )


def user_genre_pref(train: DataFrame, genres: DataFrame) -> DataFrame:
    """(user_idx, genre, pref): share of the user's rated (movie, genre) rows in each genre."""
    rows = train.select("user_idx", "movie_idx").join(genres, "movie_idx")
    per = rows.groupBy("user_idx", "genre").agg(F.count(F.lit(1)).alias("_c"))
    tot = rows.groupBy("user_idx").agg(F.count(F.lit(1)).alias("_t"))
    return per.join(tot, "user_idx").select("user_idx", "genre", (F.col("_c") / F.col("_t")).alias("pref"))


def mean_genre_pref(prefs: DataFrame, n_users: int) -> DataFrame:
    """Mean preference per genre over all users (a user without the genre counts as 0)."""
    return prefs.groupBy("genre").agg((F.sum("pref") / F.lit(float(max(n_users, 1)))).alias("mean_pref"))


def item_features(train: DataFrame, items: DataFrame, movies: DataFrame, movie_map: DataFrame) -> DataFrame:
    """(movie_idx, avg_rating, num_ratings, popularity_score, year) for every item of the universe."""
    per = train.groupBy("movie_idx").agg(
        F.avg("rating").alias("avg_rating"), F.count(F.lit(1)).alias("_n")
    )
    m = movie_map.select(F.col("original_id").alias("movieId"), F.col("encoded_id").alias("movie_idx"))
    years = movies.join(m, "movieId").select("movie_idx", movie_year("title").alias("year"))
    return (
        items.join(per, "movie_idx", "left")
        .join(years, "movie_idx", "left")
        .select(
            "movie_idx",
            "avg_rating",
            F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("num_ratings"),
            popularity_score(F.coalesce(F.col("_n"), F.lit(0))).alias("popularity_score"),
            "year",
        )
    )


# bytes of texts whose words a task counts
TEXT_BYTES = 32 << 20
#: most frequent terms whose document frequencies are broadcast
BROADCAST_TERMS = 1 << 17


def term_counts(texts: DataFrame, words_of: Callable[[DataFrame], DataFrame], item_col: str = "movieId", term_col: str = "tag") -> DataFrame:
    """(item, term, tf), written: the words of each item's ``text`` rows.

    The texts, much smaller than their words one by one, are shuffled by item and counted there.  An
    item with more text than ``TEXT_BYTES`` is dealt to several tasks, whose counts are summed afterwards.
    """
    sizes = materialize(texts.groupBy(item_col).agg(F.sum(F.length("text").cast("long") * 2).alias("_bytes")), "text-sizes")
    total = sizes.agg(F.sum("_bytes")).first()[0] or 0
    shares = sizes.where(F.col("_bytes") > TEXT_BYTES).select(item_col, F.ceil(F.col("_bytes") / TEXT_BYTES).cast("int").alias("_parts"))
    # at most one such item for each TEXT_BYTES of texts
    dealt = texts.join(F.broadcast(shares), item_col, "left").withColumn("_part", F.pmod(F.xxhash64("text"), F.coalesce("_parts", F.lit(1))))
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, -(-total // TEXT_BYTES))
    dealt = dealt.select(item_col, "_part", F.col("_parts").isNotNull().alias("_long"), "text").repartition(parts, item_col, "_part")
    words = words_of(dealt).groupBy(item_col, "_part", "_long", term_col).agg(F.count(F.lit(1)).alias("tf"))
    counted = materialize(words.sortWithinPartitions(item_col, term_col), "tfidf-counts")
    whole = counted.where(~F.col("_long")).select(item_col, term_col, "tf")
    if not shares.isEmpty():
        long = counted.where("_long").groupBy(item_col, term_col).agg(F.sum("tf").alias("tf"))
        whole = whole.unionByName(materialize(long, "tfidf-long"))
    return whole


def text_tfidf(texts: DataFrame, words_of: Callable[[DataFrame], DataFrame], item_col: str = "movieId", term_col: str = "tag") -> DataFrame:
    """:func:`tag_tfidf` of the words of (item, text)."""
    return weigh_terms(term_counts(texts, words_of, item_col, term_col), item_col, term_col)


def tag_tfidf(tags: DataFrame, item_col: str = "movieId", term_col: str = "tag", count_col: str | None = None) -> DataFrame:
    """(item, term, tfidf): raw counts × smooth idf ln((1+N)/(1+df)) + 1, rows L2-normalised.

    N = number of items with at least one tag.  Term counts combine map-side, so a term
    present in every item (or one item holding a third of all tags) stays a partial sum.
    ``count_col``: the input is already pre-aggregated with this multiplicity column.
    """
    n = F.sum(count_col) if count_col else F.count(F.lit(1))
    return weigh_terms(materialize(tags.groupBy(item_col, term_col).agg(n.alias("tf")), "tfidf-tf"), item_col, term_col)


def weigh_terms(tf: DataFrame, item_col: str, term_col: str) -> DataFrame:
    """:func:`tag_tfidf` of written counts (item, term, tf).

    The frequencies of the most frequent terms are broadcast: only the rows of the other, rare terms are
    shuffled by term, and all rows once by item.
    """
    n_docs = tf.select(item_col).distinct().count()  # scalar read from the written table
    df = materialize(tf.groupBy(term_col).agg(F.count(F.lit(1)).alias("df")), "tfidf-df")
    # the least frequency at which no more than BROADCAST_TERMS terms are as frequent or more
    per_df = df.groupBy("df").count()
    at_least = per_df.select("df", F.sum("count").over(Window.orderBy(F.col("df").desc())).alias("n"))  # one row for each frequency
    cut = at_least.where(F.col("n") <= BROADCAST_TERMS).agg(F.min("df")).first()[0]
    rare = df if cut is None else df.where(F.col("df") < cut)
    parts = [tf.join(rare, term_col)] if cut is None or not rare.isEmpty() else []
    if cut is not None:
        parts.append(tf.join(F.broadcast(df.where(F.col("df") >= cut)), term_col))
    weight = F.col("tf") * (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)
    w = reduce(DataFrame.unionByName, [p.select(item_col, term_col, "tf", "df") for p in parts])
    norms = w.groupBy(item_col).agg(F.sqrt(F.sum(weight * weight)).alias("_norm"))
    # counts are sent, which compress better than their weights
    return w.join(norms, item_col).select(item_col, term_col, (weight / F.col("_norm")).alias("tfidf"))


def bm25_weight(
    interactions: DataFrame,
    n_rows: int,
    k1: float = 100.0,
    b: float = 0.8,
    row_col: str = "user_idx",
    col_col: str = "movie_idx",
    value_col: str | None = None,
) -> DataFrame:
    """BM25 re-weighting of a sparse matrix given as (row, col[, value]) entries.

    idf(col) = ln(N) - ln(1 + nnz(col)) with N = ``n_rows`` (rows of the universe);
    length_norm(row) = (1 - b) + b * rowsum / mean rowsum (mean over all N rows);
    w = v * (k1 + 1) / (k1 * length_norm + v) * idf.
    """
    v = F.col(value_col).cast("double") if value_col else F.lit(1.0)
    x = interactions.select(row_col, col_col, v.alias("_v"))
    total = x.agg(F.sum("_v")).first()[0] or 0.0
    avg_len = total / n_rows if n_rows else 1.0
    rows = x.groupBy(row_col).agg(F.sum("_v").alias("_rs"))
    cols = x.groupBy(col_col).agg(F.count(F.lit(1)).alias("_df"))
    ln_n = math.log(n_rows) if n_rows > 0 else 0.0
    return (
        x.join(rows, row_col)
        .join(cols, col_col)
        .select(
            row_col,
            col_col,
            (
                F.col("_v") * (k1 + 1.0)
                / (k1 * ((1.0 - b) + b * F.col("_rs") / F.lit(avg_len)) + F.col("_v"))
                * (F.lit(ln_n) - F.log1p(F.col("_df").cast("double")))
            ).alias("bm25"),
        )
    )


def item_feature_matrix(item_map: DataFrame, movies: DataFrame, vocab: DataFrame) -> DataFrame:
    """Identity + genre features with L1-normalised rows: (item_idx, feature_id, weight).

    Feature ids: the item's own index for its identity feature, n_items + genre_id for
    genres; every feature of an item weighs 1 / (1 + number of its different genres).
    """
    n_items = item_map.count()
    items = item_map.select(F.col("original_id").alias("movieId"), F.col("encoded_id").alias("item_idx"))
    ig = movies.join(items, "movieId").select("item_idx", F.explode(parse_genres("genres")).alias("genre"))
    genre_feats = ig.join(vocab, "genre").select("item_idx", (F.lit(n_items) + F.col("genre_id")).alias("feature_id")).distinct()
    identity = items.select("item_idx", F.col("item_idx").alias("feature_id"))
    feats = identity.unionByName(genre_feats)
    size = feats.groupBy("item_idx").agg(F.count(F.lit(1)).alias("_k"))
    return feats.join(size, "item_idx").select(
        "item_idx", F.col("feature_id").cast("int").alias("feature_id"), (1.0 / F.col("_k")).alias("weight")
    )
