"""One interface for every recommender: fit on prepared tables, recommend from the fitted ones.

A recommender has a name, its default parameters and ``fit(data, params)``, which returns the tables
it scores from and how to score them: ``ranking`` (one order of the items for everybody),
``random`` (a seeded permutation per user) or ``vectors`` (user and item vectors).  The tables can be
saved, loaded and scored without the training data.  Register another model with
:func:`register_recommender`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.operators import features as FE
from rankfold.operators import hybrid as H
from rankfold.operators import models as MD
from rankfold.operators import recommend as R
from rankfold.session import materialize, release


@dataclass(frozen=True)
class Prepared:
    """Training data with dense ids: ``ratings`` (user_idx, movie_idx, rating) and ``seen`` pairs
    (user_idx, movie_idx) of the training part; maps (original_id, encoded_id)."""

    ratings: DataFrame
    seen: DataFrame
    user_map: DataFrame
    movie_map: DataFrame
    movies: DataFrame

    @property
    def users(self) -> DataFrame:
        return self.user_map.select(F.col("encoded_id").alias("user_idx"))

    @property
    def items(self) -> DataFrame:
        return self.movie_map.select(F.col("encoded_id").alias("movie_idx"))


@dataclass(frozen=True)
class Fitted:
    """Tables and parameters of a fitted model; ``params`` are those that were applied."""

    model_type: str
    scoring: str
    tables: dict[str, DataFrame]
    params: dict = field(default_factory=dict)

    def recommend(self, n: int, users: DataFrame | None = None) -> DataFrame:
        """(user_idx, movie_idx, score, rank): the n best unseen items of each user."""
        return score_tables(self.scoring, self.tables, self.params, n, users)


@dataclass(frozen=True)
class Recommender:
    name: str
    defaults: dict
    build: Callable[[Prepared, dict], tuple[str, dict[str, DataFrame]]]

    def fit(self, data: Prepared, **params) -> Fitted:
        unknown = sorted(set(params) - set(self.defaults))
        if unknown:
            raise ValueError(f"{self.name} has no parameter {', '.join(unknown)}")
        applied = {**self.defaults, **params}
        scoring, tables = self.build(data, applied)
        return Fitted(self.name, scoring, tables, applied)


RECOMMENDERS: dict[str, Recommender] = {}


def register_recommender(recommender: Recommender) -> Recommender:
    RECOMMENDERS[recommender.name] = recommender
    return recommender


def recommender(name: str) -> Recommender:
    if name not in RECOMMENDERS:
        raise ValueError(f"Unknown model type '{name}' (expected one of {', '.join(RECOMMENDERS)})")
    return RECOMMENDERS[name]


def score_tables(scoring: str, tables: dict[str, DataFrame], params: dict, n: int, users: DataFrame | None = None) -> DataFrame:
    """Lists from a model's tables, fitted here or loaded."""
    users = tables["users"] if users is None else users
    if scoring == "random":
        return R.recommend_random(users, tables["seen"], n, tables["items"].count(), seed=int(params["seed"]))
    if scoring == "ranking":
        return R.recommend_from_ranking(users, tables["ranking"], tables["seen"], n, tables["ranking"].count())
    if scoring == "vectors":
        vectors = tables["user_vectors"].join(users.select("user_idx").distinct(), "user_idx", "left_semi")
        return MD.recommend_scored(vectors, tables["item_vectors"], tables["seen"], n, cosine=bool(params.get("cosine", False)))
    raise ValueError(f"unknown scoring '{scoring}'")


def decode(recs: DataFrame, user_map: DataFrame, movie_map: DataFrame) -> DataFrame:
    """Lists with the original ids: (userId, movieId, score, rank).  The maps, one row for each user or
    movie, are shuffled at every size: loaded from Parquet, their file size says little about their rows."""
    users = user_map.select(F.col("original_id").alias("userId"), F.col("encoded_id").alias("user_idx"))
    movies = movie_map.select(F.col("original_id").alias("movieId"), F.col("encoded_id").alias("movie_idx"))
    return recs.join(users.hint("merge"), "user_idx").join(movies.hint("merge"), "movie_idx").select("userId", "movieId", "score", "rank")


# ------------------------------------------------------------------ the models


def _random(data: Prepared, params: dict):
    return "random", {"users": data.users, "items": data.items, "seen": data.seen}


def _popularity(data: Prepared, params: dict):
    return "ranking", {"users": data.users, "ranking": R.popularity_ranking(data.seen, data.items), "seen": data.seen}


def content_vectors(data: Prepared) -> tuple[DataFrame, DataFrame]:
    """Rating-weighted genre profiles of the users and unit genre vectors of the items."""
    vocab = FE.genre_vocabulary(data.movies)
    genres = FE.item_genres(data.movies, data.movie_map)
    item_vectors = MD.genre_item_vectors(genres, vocab, data.items)
    g = genres.join(vocab, "genre").select("movie_idx", "genre_id").distinct()
    size = g.groupBy("movie_idx").agg(F.count(F.lit(1)).alias("_g"))
    weights = g.join(size, "movie_idx").select("movie_idx", "genre_id", (1.0 / F.sqrt("_g")).alias("w"))
    return MD.user_profiles(data.ratings, weights, vocab.count()), item_vectors


def _content(data: Prepared, params: dict):
    users, items = content_vectors(data)
    # whatever a user rated counts as seen, liked or not
    seen = data.ratings.select("user_idx", "movie_idx").distinct()
    return "vectors", {"users": data.users, "user_vectors": users, "item_vectors": items, "seen": seen}


def bm25_pairs(data: Prepared) -> DataFrame:
    """(user_idx, movie_idx, weight): BM25 weights of the seen pairs."""
    return FE.bm25_weight(data.seen, data.user_map.count(), 100.0, 0.8).select("user_idx", "movie_idx", F.col("bm25").alias("weight"))


def als_fit(params: dict) -> MD.AlsFit:
    return MD.AlsFit(
        rank=int(params["factors"]), reg=float(params["regularization"]), iterations=int(params["iterations"]), alpha=float(params["alpha"]), seed=int(params["seed"])
    )


def als_tables(data: Prepared, factors: tuple[DataFrame, DataFrame], params: dict) -> dict[str, DataFrame]:
    """What implicit ALS scores from; a pair's confidence is 1 + alpha * weight."""
    users, items = factors
    # users and items without interactions score zero, as in the dense factor matrices
    zero = F.array_repeat(F.lit(0.0), int(params["factors"]))
    whole = lambda ids, vecs, key: ids.join(vecs, key, "left").select(key, F.coalesce(F.col("vec").cast("array<double>"), zero).alias("vec"))
    return {
        "users": data.users, "user_vectors": whole(data.users, users, "user_idx"), "item_vectors": whole(data.items, items, "movie_idx"), "seen": data.seen,
    }


def als_fitted(data: Prepared, weights: DataFrame, params: list[dict]) -> list[Fitted]:
    """A fit for each of ``params`` on one table of weights."""
    fits = MD.als_fits(weights, [als_fit(p) for p in params], value_col="weight")
    return [Fitted("als", "vectors", als_tables(data, factors, p), p) for factors, p in zip(fits, params, strict=True)]


def _als(data: Prepared, params: dict):
    weights = materialize(bm25_pairs(data), "als-weights")  # counted and fitted
    fitted = als_fitted(data, weights, [params])[0]
    release(weights)
    return "vectors", fitted.tables


def hybrid_params(params: dict) -> H.HybridParams:
    return replace(H.HybridParams(), **{k: type(getattr(H.HybridParams(), k))(v) for k, v in params.items()})


def with_bias(users: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """p · q + b as one product: [p, 1] · [q, b]."""
    return (
        users.select("user_idx", F.concat("vec", F.array(F.lit(1.0))).alias("vec")),
        items.select(F.col(items.columns[0]), F.concat("vec", F.array(F.col("bias"))).alias("vec")),
    )


def _hybrid(data: Prepared, params: dict):
    hp = hybrid_params(params)
    features = FE.item_feature_matrix(data.movie_map, data.movies, FE.genre_vocabulary(data.movies))
    pairs = data.seen.select("user_idx", F.col("movie_idx").alias("item_idx"))
    model = H.fit_hybrid(pairs, features, data.users, data.movie_map.count(), hp)
    users, items = with_bias(model.users, H.item_representations(features, model.features, hp.no_components))
    return "vectors", {
        "users": data.users, "user_vectors": users, "item_vectors": items.withColumnRenamed("item_idx", "movie_idx"), "seen": data.seen,
        "item_features": features, "feature_vectors": model.features,
    }


register_recommender(Recommender("random", {"seed": 42}, _random))
register_recommender(Recommender("popularity", {}, _popularity))
register_recommender(Recommender("content", {"cosine": True}, _content))
# fixed values: the experiment notebook's ALS configuration
register_recommender(Recommender("als", {"factors": 100, "regularization": 0.01, "iterations": 15, "alpha": 40.0, "seed": 42}, _als))
register_recommender(Recommender("hybrid", {k: getattr(H.HybridParams(), k) for k in H.HybridParams.__dataclass_fields__}, _hybrid))
