"""Shared preparation stages for the registered queries, memoised per session.

Stages that end in an action (k-core convergence counts, split boundaries) are
checkpointed once per (application, data folder, parameters) so that many queries
over the same folder reuse them instead of re-running the loop.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.operators import prep
from rankfold.plans import sql as S
from rankfold.session import checkpoint, materialize, release
from rankfold.sources import tables

_MEMO: dict[tuple, Any] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and modification times below the folder: rewritten data get new stages."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001 - Hadoop filesystem call
    path = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)))


def _memo(spark: SparkSession, sf_dir: str, key: tuple, build: Callable[[], Any]) -> Any:
    full = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir), *key)
    if full not in _MEMO:
        _MEMO[full] = build()
    return _MEMO[full]


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ratings(spark, sf_dir)


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.movies(spark, sf_dir)


def core(
    spark: SparkSession,
    sf_dir: str,
    min_user: int = S.DEFAULT_MIN_USER,
    min_item: int = S.DEFAULT_MIN_ITEM,
) -> prep.KCoreResult:
    def build() -> prep.KCoreResult:
        # the ratings view (a fact-table join) is read twice: for the edge counts and for
        # the final filter; recomputing the join measured cheaper than writing it here
        res = prep.kcore(ratings(spark, sf_dir), min_user, min_item)
        return prep.KCoreResult(materialize(res.ratings, "core"), res.passes)

    return _memo(spark, sf_dir, ("core", min_user, min_item), build)


def encoded(spark: SparkSession, sf_dir: str) -> prep.Encoded:
    def build() -> prep.Encoded:
        enc = prep.encode_ids(core(spark, sf_dir).ratings)
        return prep.Encoded(checkpoint(enc.ratings), enc.user_map, enc.movie_map)

    return _memo(spark, sf_dir, ("encoded",), build)


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return checkpoint(prep.temporal_split(encoded(spark, sf_dir).ratings, S.TRAIN_FRAC, S.VAL_FRAC))

    return _memo(spark, sf_dir, ("split",), build)


def part(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return split(spark, sf_dir).where(F.col("split") == name).drop("split")


def implicit_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (user_idx, movie_idx) train pairs with a rating >= the implicit threshold, written once:
    the counts, the lists and the masks of seen items all read them."""

    def build() -> DataFrame:
        # a pair's best rating reaches the threshold if any of its rows does
        liked = part(spark, sf_dir, "train").where(F.col("rating") >= S.IMPLICIT_THRESHOLD)
        return materialize(liked.select("user_idx", "movie_idx").distinct(), "implicit-train")

    return _memo(spark, sf_dir, ("implicit_train",), build)


def user_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, sf_dir).user_map.select(F.col("encoded_id").alias("user_idx"))


def item_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, sf_dir).movie_map.select(F.col("encoded_id").alias("movie_idx"))


def n_items(spark: SparkSession, sf_dir: str) -> int:
    return _memo(spark, sf_dir, ("n_items",), lambda: encoded(spark, sf_dir).movie_map.count())


class Bundle:
    """The factorisation dataset: users of ``ratings``, items of ``movies`` (items
    without ratings kept), seeded 80/20 row split, distinct train/test pairs."""

    def __init__(self, user_map: DataFrame, item_map: DataFrame, split_rows: DataFrame):
        self.user_map = user_map
        self.item_map = item_map
        self.split_rows = split_rows

    def pairs(self, name: str) -> DataFrame:
        return self.split_rows.where(F.col("split") == name).select("user_idx", "item_idx").distinct()


def bundle(spark: SparkSession, sf_dir: str) -> Bundle:
    from rankfold.operators.ordering import dense_index  # noqa: PLC0415

    def build() -> Bundle:
        # read by the id maps, the key counts and both parts of the split: written once, with the split's hash
        key_cols = ("userId", "movieId", "timestamp", "rating")
        r = materialize(ratings(spark, sf_dir).withColumn(prep.SPLIT_KEY, prep.hash_key(S.SEED, *key_cols)), "bundle-ratings")
        user_map = checkpoint(dense_index(r, "userId"))
        item_map = checkpoint(dense_index(movies(spark, sf_dir), "movieId"))
        rows = prep.split_keyed(r, key_cols, 0.2)
        um = user_map.select(F.col("original_id").alias("userId"), F.col("encoded_id").alias("user_idx"))
        im = item_map.select(F.col("original_id").alias("movieId"), F.col("encoded_id").alias("item_idx"))
        mapped = rows.join(um, "userId").join(im, "movieId").select("user_idx", "item_idx", "rating", "split")
        whole = Bundle(user_map, item_map, checkpoint(mapped))
        release(r)
        return whole

    return _memo(spark, sf_dir, ("bundle",), build)
