"""Registered exploratory statistics, scalar-function and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold import functions as fn
from rankfold.operators import features as FE
from rankfold.operators import prep
from rankfold.operators import stats as ST
from rankfold.plans import stages as P
from rankfold.plans import sql as S
from rankfold.plans.catalog import r6, register
from rankfold.session import materialize
from rankfold.sources import tables

GL = (
    "list_filter(list_transform(string_split(coalesce({g}, ''), '|'), lambda x: trim(x)), "
    "lambda x: x <> '' AND x <> '(no genres listed)')"
)
GENRE_ROWS = f"genre_rows AS (SELECT movieId, unnest({GL.format(g='genres')}) AS genre FROM movies)"
ITEM_GENRES = (
    f"item_genres AS (SELECT mm.encoded_id AS movie_idx, unnest({GL.format(g='m.genres')}) AS genre "
    "FROM movies m JOIN movie_map mm ON m.movieId = mm.original_id)"
)
TO_TS = 'epoch_ms("timestamp" * 1000)'

# ------------------------------------------------------------ scalar functions (P-series)


@register(
    "parse_genres",
    S.with_ctes(
        f"SELECT movieId, CAST(generate_subscripts(g, 1) - 1 AS BIGINT) AS genre_pos, unnest(g) AS genre "
        f"FROM (SELECT movieId, {GL.format(g='genres')} AS g FROM movies)"
    ),
)
def q_parse_genres(spark, sf):
    m = P.movies(spark, sf)
    return m.select("movieId", F.posexplode(fn.parse_genres("genres")).alias("genre_pos", "genre")).select(
        "movieId", F.col("genre_pos").cast("bigint").alias("genre_pos"), "genre"
    )


@register(
    "genre_vocabulary",
    S.with_ctes(
        f"SELECT genre, CAST(row_number() OVER (ORDER BY genre) - 1 AS INTEGER) AS genre_id "
        f"FROM (SELECT DISTINCT genre FROM (SELECT unnest({GL.format(g='genres')}) AS genre FROM movies "
        f"WHERE genres IS NOT NULL))"
    ),
)
def q_genre_vocabulary(spark, sf):
    return FE.genre_vocabulary(P.movies(spark, sf))


@register(
    "movie_year",
    S.with_ctes(
        r"SELECT movieId, TRY_CAST(nullif(regexp_extract(title, '\((\d{4})\)\s*$', 1), '') AS INTEGER) AS year "
        "FROM movies"
    ),
)
def q_movie_year(spark, sf):
    return P.movies(spark, sf).select("movieId", fn.movie_year("title").alias("year"))


@register(
    "title_search",
    S.with_ctes("SELECT movieId, title FROM movies WHERE coalesce(contains(lower(title), 'widget'), false)"),
)
def q_title_search(spark, sf):
    return P.movies(spark, sf).where(fn.title_contains("title", "Widget")).select("movieId", "title")


@register(
    "epoch_parts",
    S.with_ctes(
        f"""SELECT userId, movieId, "timestamp",
                  CAST({TO_TS} AS DATE) AS date,
                  CAST(date_trunc('month', {TO_TS}) AS DATE) AS month,
                  CAST(date_trunc('quarter', {TO_TS}) AS DATE) AS quarter
           FROM ratings"""
    ),
)
def q_epoch_parts(spark, sf):
    ts = fn.epoch_to_timestamp("timestamp")
    return P.ratings(spark, sf).select(
        "userId",
        "movieId",
        "timestamp",
        F.to_date(ts).alias("date"),
        F.to_date(F.date_trunc("month", ts)).alias("month"),
        F.to_date(F.date_trunc("quarter", ts)).alias("quarter"),
    )


@register(
    "relevant_items",
    S.with_ctes(
        f"SELECT DISTINCT user_idx, movie_idx FROM test WHERE rating >= {S.EVAL_THRESHOLD!r}e0", prepared=True
    ),
)
def q_relevant_items(spark, sf):
    from rankfold.operators.metrics import relevant_items  # noqa: PLC0415

    return relevant_items(P.part(spark, sf, "test"), S.EVAL_THRESHOLD)


@register(
    "implicit_interactions",
    S.with_ctes(
        f"SELECT user_idx, movie_idx, max(rating) AS explicit, "
        f"CAST(max(rating) >= {S.IMPLICIT_THRESHOLD!r}e0 AS INTEGER) AS implicit FROM train GROUP BY user_idx, movie_idx",
        prepared=True,
    ),
)
def q_implicit_interactions(spark, sf):
    return FE.implicit_interactions(P.part(spark, sf, "train"), S.IMPLICIT_THRESHOLD)


# ------------------------------------------------------------ joins (J-series)


@register(
    "surviving_movies",
    S.with_ctes(
        "SELECT m.movieId, m.title, m.genres, mm.encoded_id AS movie_idx "
        "FROM movies m JOIN movie_map mm ON m.movieId = mm.original_id",
        prepared=True,
    ),
)
def q_surviving_movies(spark, sf):
    mm = P.encoded(spark, sf).movie_map.select(
        F.col("original_id").alias("movieId"), F.col("encoded_id").alias("movie_idx")
    )
    # the semi-join and the left join of the reference collapse into one inner join
    return P.movies(spark, sf).join(mm, "movieId").select("movieId", "title", "genres", "movie_idx")


@register(
    "surviving_tags",
    S.with_ctes(
        'SELECT userId, movieId, tag, "timestamp" FROM tags '
        "WHERE movieId IN (SELECT original_id FROM movie_map) AND userId IN (SELECT original_id FROM user_map)",
        prepared=True,
    ),
)
def q_surviving_tags(spark, sf):
    return tables.words_of(surviving_texts(spark, sf)).select("userId", "movieId", "tag", "timestamp")


def surviving_texts(spark, sf):
    """The texts of movies and users that are left: their few (user, movie) pairs meet the id maps and then
    the texts, which are cut into words last."""
    enc = P.encoded(spark, sf)
    texts = tables.tag_texts(spark, sf)
    pairs = (
        texts.select("userId", "movieId").distinct()
        .join(enc.movie_map.select(F.col("original_id").alias("movieId")), "movieId", "left_semi")
        .join(enc.user_map.select(F.col("original_id").alias("userId")), "userId", "left_semi")
    )
    pairs = materialize(pairs, "tagged-pairs")
    n_pairs = pairs.count()
    # the texts stream past a hash table of the pairs: neither sorted nor held
    kept = F.broadcast(pairs) if n_pairs <= prep.BROADCAST_NODES else pairs.hint("shuffle_hash")
    return texts.join(kept, ["userId", "movieId"], "left_semi")


# ------------------------------------------------------------ aggregates (A-series)


@register("rating_histogram", S.with_ctes("SELECT rating, count(*) AS n FROM ratings GROUP BY rating"))
def q_rating_histogram(spark, sf):
    return ST.rating_histogram(P.ratings(spark, sf)).select("rating", F.col("n").cast("bigint").alias("n"))


@register(
    "rating_cdf",
    S.with_ctes(
        "SELECT rating, n, CAST(sum(n) OVER (ORDER BY rating) AS BIGINT) AS cum_n, "
        "round(sum(n) OVER (ORDER BY rating) / sum(n) OVER ()::DOUBLE, 6) AS cdf "
        "FROM (SELECT rating, count(*) AS n FROM ratings GROUP BY rating)"
    ),
)
def q_rating_cdf(spark, sf):
    return ST.rating_cdf(P.ratings(spark, sf)).select(
        "rating", F.col("n").cast("bigint").alias("n"), "cum_n", "cdf"
    )


@register(
    "rating_summary",
    S.with_ctes(
        "SELECT CAST(count(*) AS BIGINT) AS n, round(avg(rating), 6) AS mean, "
        "round(quantile_cont(rating, 0.5), 6) AS median, CAST(count(DISTINCT userId) AS BIGINT) AS n_users, "
        "CAST(count(DISTINCT movieId) AS BIGINT) AS n_items FROM ratings"
    ),
)
def q_rating_summary(spark, sf):
    return ST.rating_summary(P.ratings(spark, sf))


def _activity_sql(key: str, low: int, high: int | None) -> str:
    extra = ""
    if high is not None:
        extra = (
            f", CAST(sum(CASE WHEN c >= {high} THEN 1 ELSE 0 END) AS BIGINT) AS n_at_or_above, "
            f"round(avg(CAST(c >= {high} AS DOUBLE)), 6) AS share_at_or_above"
        )
    return S.with_ctes(
        f"SELECT CAST(count(*) AS BIGINT) AS n_keys, round(avg(c), 6) AS mean, "
        f"round(quantile_cont(c, 0.5), 6) AS median, CAST(max(c) AS BIGINT) AS max, "
        f"CAST(sum(CASE WHEN c < {low} THEN 1 ELSE 0 END) AS BIGINT) AS n_below, "
        f"round(avg(CAST(c < {low} AS DOUBLE)), 6) AS share_below{extra} "
        f"FROM (SELECT {key}, count(*) AS c FROM ratings GROUP BY {key})"
    )


@register("user_activity", _activity_sql("userId", 20, 100))
def q_user_activity(spark, sf):
    return ST.activity_summary(P.ratings(spark, sf), "userId", 20, 100)


@register("item_activity", _activity_sql("movieId", 10, None))
def q_item_activity(spark, sf):
    return ST.activity_summary(P.ratings(spark, sf), "movieId", 10)


@register(
    "activity_rank",
    S.with_ctes(
        "SELECT userId, n, CAST(row_number() OVER (ORDER BY n DESC, userId) AS BIGINT) AS rank "
        "FROM (SELECT userId, CAST(count(*) AS BIGINT) AS n FROM ratings GROUP BY userId)"
    ),
)
def q_activity_rank(spark, sf):
    return ST.activity_rank(P.ratings(spark, sf), "userId")


@register(
    "top_rated_items",
    S.with_ctes(
        "SELECT t.movieId, t.n, m.title, substr(m.title, 1, 30) AS short_title FROM "
        "(SELECT movieId, CAST(count(*) AS BIGINT) AS n FROM ratings GROUP BY movieId "
        " ORDER BY n DESC, movieId LIMIT 20) t LEFT JOIN movies m ON m.movieId = t.movieId"
    ),
)
def q_top_rated_items(spark, sf):
    return ST.top_items(P.ratings(spark, sf), P.movies(spark, sf), 20)


@register(
    "genre_counts",
    S.with_ctes("SELECT genre, CAST(count(*) AS BIGINT) AS n FROM genre_rows GROUP BY genre", GENRE_ROWS),
)
def q_genre_counts(spark, sf):
    return ST.genre_counts(P.movies(spark, sf))


@register(
    "genre_ratings",
    S.with_ctes(
        "SELECT genre, round(m, 6) AS mean_rating, n, round(avg(m) OVER (), 6) AS mean_of_means FROM "
        "(SELECT g.genre, avg(r.rating) AS m, CAST(count(r.rating) AS BIGINT) AS n "
        " FROM genre_rows g LEFT JOIN ratings r ON r.movieId = g.movieId GROUP BY g.genre)",
        GENRE_ROWS,
    ),
)
def q_genre_ratings(spark, sf):
    return ST.genre_ratings(P.movies(spark, sf), P.ratings(spark, sf))


@register(
    "monthly_volume",
    S.with_ctes(
        f"SELECT CAST(date_trunc('month', {TO_TS}) AS DATE) AS month, CAST(count(*) AS BIGINT) AS n "
        "FROM ratings GROUP BY 1"
    ),
)
def q_monthly_volume(spark, sf):
    return ST.monthly_volume(P.ratings(spark, sf))


@register(
    "quarterly_rating",
    S.with_ctes(
        "SELECT CAST(last_day(s.q + INTERVAL 2 MONTH) AS DATE) AS quarter_end, round(p.m, 6) AS mean_rating "
        "FROM (SELECT CAST(unnest(generate_series(min(q)::TIMESTAMP, max(q)::TIMESTAMP, INTERVAL 3 MONTH)) AS DATE) AS q "
        "      FROM per) s LEFT JOIN per p ON p.q = s.q",
        f"per AS (SELECT CAST(date_trunc('quarter', {TO_TS}) AS DATE) AS q, avg(rating) AS m FROM ratings GROUP BY 1)",
    ),
)
def q_quarterly_rating(spark, sf):
    return ST.quarterly_rating(P.ratings(spark, sf))


def _sparsity_select(src: str, extra: str = "") -> str:
    return (
        f"SELECT {extra}CAST(count(*) AS BIGINT) AS n_ratings, CAST(count(DISTINCT userId) AS BIGINT) AS n_users, "
        f"CAST(count(DISTINCT movieId) AS BIGINT) AS n_items, "
        f"round(CASE WHEN count(DISTINCT userId) = 0 OR count(DISTINCT movieId) = 0 THEN 1.0 "
        f"ELSE 1.0 - count(*) / (count(DISTINCT userId) * count(DISTINCT movieId))::DOUBLE END, 6) AS sparsity "
        f"FROM {src}"
    )


@register("sparsity", S.with_ctes(_sparsity_select("ratings")))
def q_sparsity(spark, sf):
    return ST.sparsity(P.ratings(spark, sf))


SWEEP = [(5, 5), (10, 5), (20, 10), (50, 20)]


@register(
    "threshold_sweep",
    S.with_ctes(
        " UNION ALL ".join(
            _sparsity_select(f"s{mu}_{mi}_core", f"{mu} AS min_user_ratings, {mi} AS min_item_ratings, ")
            for mu, mi in SWEEP
        ),
        *[c for mu, mi in SWEEP for c in S.kcore_ctes(f"s{mu}_{mi}", "ratings", mu, mi)],
    ),
)
def q_threshold_sweep(spark, sf):
    return ST.threshold_sweep(P.ratings(spark, sf), SWEEP)


@register(
    "interaction_nnz",
    S.with_ctes(
        "SELECT 'user' AS kind, user_idx AS idx, CAST(count(*) AS BIGINT) AS nnz FROM implicit_train GROUP BY user_idx "
        "UNION ALL SELECT 'item' AS kind, movie_idx AS idx, CAST(count(*) AS BIGINT) AS nnz FROM implicit_train "
        "GROUP BY movie_idx",
        prepared=True,
    ),
)
def q_interaction_nnz(spark, sf):
    return FE.interaction_nnz(P.implicit_train(spark, sf))


@register(
    "item_popularity",
    S.with_ctes(
        "SELECT movie_idx, pop, round(pop / max(pop) OVER ()::DOUBLE, 6) AS share_of_max FROM pop",
        "pop AS (SELECT m.encoded_id AS movie_idx, CAST(coalesce(c.pop, 0) AS BIGINT) AS pop FROM movie_map m "
        "LEFT JOIN (SELECT movie_idx, count(*) AS pop FROM implicit_train GROUP BY movie_idx) c "
        "ON c.movie_idx = m.encoded_id)",
        prepared=True,
    ),
)
def q_item_popularity(spark, sf):
    from rankfold.operators.recommend import item_popularity  # noqa: PLC0415

    pop = item_popularity(P.implicit_train(spark, sf), P.item_universe(spark, sf))
    mx = pop.agg(F.max("pop")).first()[0] or 1
    return pop.select("movie_idx", "pop", F.round(F.col("pop") / F.lit(float(mx)), 6).alias("share_of_max"))


# ------------------------------------------------------------ features


UF_SQL = "uf AS (SELECT user_idx, avg(rating) AS avg_rating, CAST(count(*) AS BIGINT) AS num_ratings, stddev_samp(rating) AS rating_std FROM train GROUP BY user_idx)"


@register(
    "user_features",
    S.with_ctes(
        "SELECT user_idx, round(avg_rating, 6) AS avg_rating, num_ratings, round(rating_std, 6) AS rating_std FROM uf",
        UF_SQL,
        prepared=True,
    ),
)
def q_user_features(spark, sf):
    uf = FE.user_features(P.part(spark, sf, "train"))
    return uf.select("user_idx", r6("avg_rating").alias("avg_rating"), "num_ratings", r6("rating_std").alias("rating_std"))


PREF_SQL = (
    "pref AS (SELECT p.user_idx, p.genre, p.c / t.t::DOUBLE AS pref FROM "
    "(SELECT tr.user_idx, g.genre, count(*) AS c FROM train tr JOIN item_genres g ON g.movie_idx = tr.movie_idx "
    " GROUP BY tr.user_idx, g.genre) p JOIN "
    "(SELECT tr.user_idx, count(*) AS t FROM train tr JOIN item_genres g ON g.movie_idx = tr.movie_idx "
    " GROUP BY tr.user_idx) t ON t.user_idx = p.user_idx)"
)


def _prefs(spark, sf):
    enc = P.encoded(spark, sf)
    return FE.user_genre_pref(P.part(spark, sf, "train"), FE.item_genres(P.movies(spark, sf), enc.movie_map))


@register(
    "user_genre_pref",
    S.with_ctes("SELECT user_idx, genre, round(pref, 6) AS pref FROM pref", ITEM_GENRES, PREF_SQL, prepared=True),
)
def q_user_genre_pref(spark, sf):
    return _prefs(spark, sf).select("user_idx", "genre", r6("pref").alias("pref"))


@register(
    "mean_genre_pref",
    S.with_ctes(
        "SELECT genre, round(sum(pref) / (SELECT count(DISTINCT user_idx) FROM train)::DOUBLE, 6) AS mean_pref "
        "FROM pref GROUP BY genre",
        ITEM_GENRES,
        PREF_SQL,
        prepared=True,
    ),
)
def q_mean_genre_pref(spark, sf):
    n_users = P.part(spark, sf, "train").select("user_idx").distinct().count()
    return FE.mean_genre_pref(_prefs(spark, sf), n_users).select("genre", r6("mean_pref").alias("mean_pref"))


IF_SQL = (
    "itf AS (SELECT mm.encoded_id AS movie_idx, p.avg_rating, CAST(coalesce(p.n, 0) AS BIGINT) AS num_ratings, "
    "ln(1 + coalesce(p.n, 0)) AS popularity_score, "
    r"TRY_CAST(nullif(regexp_extract(m.title, '\((\d{4})\)\s*$', 1), '') AS INTEGER) AS year "
    "FROM movie_map mm LEFT JOIN (SELECT movie_idx, avg(rating) AS avg_rating, count(*) AS n FROM train "
    "GROUP BY movie_idx) p ON p.movie_idx = mm.encoded_id LEFT JOIN movies m ON m.movieId = mm.original_id)"
)


def _item_features(spark, sf):
    enc = P.encoded(spark, sf)
    return FE.item_features(P.part(spark, sf, "train"), P.item_universe(spark, sf), P.movies(spark, sf), enc.movie_map)


@register(
    "item_features",
    S.with_ctes(
        "SELECT movie_idx, round(avg_rating, 6) AS avg_rating, num_ratings, round(popularity_score, 6) AS popularity_score, year FROM itf",
        IF_SQL,
        prepared=True,
    ),
)
def q_item_features(spark, sf):
    return _item_features(spark, sf).select(
        "movie_idx", r6("avg_rating").alias("avg_rating"), "num_ratings",
        r6("popularity_score").alias("popularity_score"), "year",
    )


@register(
    "item_genre_multihot",
    S.with_ctes("SELECT DISTINCT movie_idx, genre, 1 AS flag FROM item_genres", ITEM_GENRES, prepared=True),
)
def q_item_genre_multihot(spark, sf):
    enc = P.encoded(spark, sf)
    return FE.item_genres(P.movies(spark, sf), enc.movie_map).distinct().withColumn("flag", F.lit(1))


DESCRIBE_COLS = ["avg_rating", "num_ratings", "rating_std"]
_STATS = {
    "count": "CAST(count({c}) AS DOUBLE)",
    "mean": "avg({c})",
    "std": "stddev_samp({c})",
    "min": "CAST(min({c}) AS DOUBLE)",
    "25%": "quantile_cont({c}, 0.25)",
    "50%": "quantile_cont({c}, 0.5)",
    "75%": "quantile_cont({c}, 0.75)",
    "max": "CAST(max({c}) AS DOUBLE)",
}


@register(
    "describe_features",
    S.with_ctes(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, '{s}' AS stat, round(CAST({e.format(c=c)} AS DOUBLE), 6) AS value FROM uf"
            for c in DESCRIBE_COLS
            for s, e in _STATS.items()
        ),
        UF_SQL,
        prepared=True,
    ),
)
def q_describe_features(spark, sf):
    return ST.describe(FE.user_features(P.part(spark, sf, "train")), DESCRIBE_COLS)


CORR_COLS = ["avg_rating", "num_ratings", "popularity_score", "year"]


@register(
    "feature_correlation",
    S.with_ctes(
        " UNION ALL ".join(
            f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM clean"
            for a in CORR_COLS
            for b in CORR_COLS
        ),
        IF_SQL,
        "clean AS (SELECT CAST(avg_rating AS DOUBLE) AS avg_rating, CAST(num_ratings AS DOUBLE) AS num_ratings, "
        "CAST(popularity_score AS DOUBLE) AS popularity_score, CAST(year AS DOUBLE) AS year FROM itf "
        "WHERE avg_rating IS NOT NULL AND year IS NOT NULL)",
        prepared=True,
    ),
)
def q_feature_correlation(spark, sf):
    return ST.correlation(_item_features(spark, sf), CORR_COLS)


TFIDF_SQL = [
    "stags AS (SELECT movieId, tag FROM tags WHERE movieId IN (SELECT original_id FROM movie_map) "
    "AND userId IN (SELECT original_id FROM user_map))",
    "tf AS (SELECT movieId, tag, count(*) AS tf FROM stags GROUP BY movieId, tag)",
    "dfq AS (SELECT tag, count(*) AS df FROM tf GROUP BY tag)",
    "w AS (SELECT tf.movieId, tf.tag, tf.tf * (ln((1.0 + (SELECT count(DISTINCT movieId) FROM tf)) / (1.0 + dfq.df)) + 1.0) AS w "
    "FROM tf JOIN dfq ON dfq.tag = tf.tag)",
]


@register(
    "tag_tfidf",
    S.with_ctes(
        "SELECT w.movieId, w.tag, round(w.w / n.norm, 6) AS tfidf FROM w JOIN "
        "(SELECT movieId, sqrt(sum(w * w)) AS norm FROM w GROUP BY movieId) n ON n.movieId = w.movieId",
        *TFIDF_SQL,
        prepared=True,
    ),
)
def q_tag_tfidf(spark, sf):
    texts = surviving_texts(spark, sf).select("movieId", "text")
    return FE.text_tfidf(texts, tables.words_of).select("movieId", "tag", r6("tfidf").alias("tfidf"))


@register(
    "bm25_weight",
    S.with_ctes(
        "SELECT x.user_idx, x.movie_idx, round(1.0 * (100.0 + 1.0) / (100.0 * ((1.0 - 0.8) + 0.8 * r.rs / "
        "((SELECT count(*) FROM implicit_train) / (SELECT count(*) FROM user_map)::DOUBLE)) + 1.0) "
        "* (ln((SELECT count(*) FROM user_map)) - ln(1 + c.df)), 6) AS bm25 "
        "FROM implicit_train x JOIN (SELECT user_idx, count(*) AS rs FROM implicit_train GROUP BY user_idx) r "
        "ON r.user_idx = x.user_idx JOIN (SELECT movie_idx, count(*) AS df FROM implicit_train GROUP BY movie_idx) c "
        "ON c.movie_idx = x.movie_idx",
        prepared=True,
    ),
)
def q_bm25_weight(spark, sf):
    n_users = P.encoded(spark, sf).user_map.count()
    return FE.bm25_weight(P.implicit_train(spark, sf), n_users, 100.0, 0.8).select(
        "user_idx", "movie_idx", r6("bm25").alias("bm25")
    )


@register(
    "random_split",
    S.with_ctes(
        'SELECT userId, movieId, rating, "timestamp", CASE WHEN pos < ceil(0.2e0 * n) THEN \'test\' ELSE \'train\' END AS split '
        "FROM (SELECT *, row_number() OVER (ORDER BY h, userId, movieId, \"timestamp\", rating) - 1 AS pos, "
        "count(*) OVER () AS n FROM (SELECT *, CAST(('0x' || substr(md5(concat_ws('|', '42', CAST(userId AS VARCHAR), "
        "CAST(movieId AS VARCHAR), CAST(\"timestamp\" AS VARCHAR), CAST(rating AS VARCHAR))), 1, 8)) AS BIGINT) AS h "
        "FROM ratings))"
    ),
)
def q_random_split(spark, sf):
    # read by the key counts and by both parts of the split: joined and written once
    rows = materialize(P.ratings(spark, sf), "split-ratings")
    return prep.random_split(
        rows, ("userId", "movieId", "timestamp", "rating"), 0.2, S.SEED
    ).select("userId", "movieId", "rating", "timestamp", "split")


@register(
    "reference_sample",
    S.with_ctes(
        'SELECT rating, "timestamp", user_idx, movie_idx FROM train ORDER BY '
        "CAST(('0x' || substr(md5(concat_ws('|', '42', CAST(user_idx AS VARCHAR), CAST(movie_idx AS VARCHAR), "
        "CAST(\"timestamp\" AS VARCHAR))), 1, 8)) AS BIGINT), user_idx, movie_idx, \"timestamp\", rating LIMIT 10000",
        prepared=True,
    ),
)
def q_reference_sample(spark, sf):
    train = P.part(spark, sf, "train")
    keyed = train.withColumn("_h", prep.hash_key(S.SEED, "user_idx", "movie_idx", "timestamp"))
    return (
        keyed.orderBy("_h", "user_idx", "movie_idx", "timestamp", "rating")
        .limit(10_000)
        .select("rating", "timestamp", "user_idx", "movie_idx")
    )

