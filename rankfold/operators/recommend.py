"""Recommendation jobs that score *all* users in one distributed plan.

Common output: ``(user_idx, movie_idx, score, rank)`` with rank 1..n.

Seen-item exclusion never builds a user × catalogue product.  The first ``n`` unseen entries of a
global ranking lie among its first ``n + s`` for a user with ``s`` seen items, so only seen items in that
head of the ranking matter: what is counted of them for each user is how many lie between two unseen
entries, which gives the positions of the list (:func:`recommend_from_ranking`).  The random
baseline walks a permutation of its own for each user and skips what the user has seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfold.operators.ordering import positions
from rankfold.operators.prep import few


def top_k_per_user(
    scored: DataFrame,
    k: int | str,
    user_col: str = "user_idx",
    item_col: str = "movie_idx",
    score_col: str = "score",
    rank_col: str = "rank",
) -> DataFrame:
    """Keep each user's ``k`` best rows by (score desc, item asc); ``k`` may be a column name."""
    w = Window.partitionBy(user_col).orderBy(F.col(score_col).desc(), F.col(item_col).asc())
    limit = F.col(k) if isinstance(k, str) else F.lit(k)
    return scored.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= limit)


def item_popularity(interactions: DataFrame, items: DataFrame, item_col: str = "movie_idx") -> DataFrame:
    """(item, pop) for every item of the universe; pop = number of interactions (0 if none)."""
    counts = interactions.groupBy(item_col).agg(F.count(F.lit(1)).alias("pop"))
    return items.join(counts, item_col, "left").select(
        item_col, F.coalesce(F.col("pop"), F.lit(0)).cast("bigint").alias("pop")
    )


def popularity_ranking(interactions: DataFrame, items: DataFrame, item_col: str = "movie_idx") -> DataFrame:
    """(item, pop, score, prank): global ranking by pop desc, item asc; score = pop / max(pop)."""
    pop = item_popularity(interactions, items, item_col)
    ranked = positions(pop, [F.col("pop").desc(), F.col(item_col).asc()], out="prank")
    max_pop = pop.agg(F.max("pop")).first()[0] or 0
    denom = float(max_pop) if max_pop > 0 else 1.0
    return ranked.select(item_col, "pop", (F.col("pop") / F.lit(denom)).alias("score"), "prank")


def _skipped(seen: DataFrame, head: DataFrame, n: int, user_col: str, item_col: str) -> DataFrame:
    """(user, gaps): for each number ``d`` < n of unseen entries, how many seen ones follow directly
    after the ``d``-th unseen entry of the ranking's head.

    Only a user's seen entries before its n-th unseen one are kept, and of these one count for each d.
    """
    met = seen.select(user_col, item_col).join(head.select(item_col, "prank"), item_col).select(user_col, "prank")
    w = Window.partitionBy(user_col).orderBy("prank")
    ahead = met.withColumn("_d", F.col("prank") - F.dense_rank().over(w) + 1).where(F.col("_d") < n)
    # entries with the same d are neighbours; repeated pairs count once
    runs = ahead.groupBy(user_col, "_d").agg((F.max("prank") - F.min("prank") + 1).alias("_c"))
    return runs.groupBy(user_col).agg(F.collect_list(F.struct(F.col("_d").alias("d"), F.col("_c").alias("c"))).alias("_gaps"))


def recommend_from_ranking(
    users: DataFrame,
    ranking: DataFrame,
    seen: DataFrame,
    n: int,
    n_items: int,
    exclude_seen: bool = True,
    user_col: str = "user_idx",
    item_col: str = "movie_idx",
) -> DataFrame:
    """First ``n`` entries of one global ranking per user, skipping the user's seen items."""
    ranking = ranking.select(item_col, "score", "prank")
    n = max(n, 0)
    lists = users.select(user_col)
    head_rows = min(n_items, n)
    position = F.col("_j").cast("bigint")
    if exclude_seen:
        max_seen = seen.groupBy(user_col).count().agg(F.max("count")).first()[0] or 0
        head_rows = min(n_items, n + max_seen)
        gaps = _skipped(seen, few(ranking.where(F.col("prank") < head_rows), head_rows), n, user_col, item_col)
        lists = lists.join(gaps, user_col, "left")
        before = F.filter("_gaps", lambda g: g["d"] <= F.col("_j"))
        position = position + F.coalesce(F.aggregate(before, F.lit(0).cast("bigint"), lambda acc, g: acc + g["c"]), F.lit(0))
    ranks = F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")
    wanted = lists.withColumn("_j", F.explode(ranks)).select(user_col, (F.col("_j") + 1).alias("rank"), position.alias("prank"))
    head = few(ranking.where(F.col("prank") < head_rows), head_rows)
    return wanted.where(F.col("prank") < n_items).join(head, "prank").select(user_col, item_col, "score", "rank")


def recommend_popular(
    users: DataFrame,
    items: DataFrame,
    interactions: DataFrame,
    n: int,
    n_items: int,
    exclude_seen: bool = True,
) -> DataFrame:
    """Popularity baseline: most popular unseen items; score = pop / max pop."""
    ranking = popularity_ranking(interactions, items)
    return recommend_from_ranking(users, ranking, interactions, n, n_items, exclude_seen)


# steps of walks held at a time
WALK_ELEMENTS = 1 << 20


def _walk(user_col: str, item_col: str, n: int, n_items: int, prime: int):
    """The first ``n`` unseen items of each user's walk.  Some steps beyond ``n`` are tried first, and twice
    as many again for the users who have not found ``n`` items by then."""

    def found(a: np.ndarray, b: np.ndarray, steps: int, seen_at: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        items = (a[:, None] * np.arange(steps) + b[:, None]) % prime
        keys = np.arange(len(a))[:, None] * prime + items
        known = np.repeat(np.arange(len(a)), np.diff(seen_at)) * prime + seen
        free = (items < n_items) & ~np.isin(keys, known)
        rank = np.cumsum(free, axis=1)
        return items, np.where(free & (rank <= n), rank, 0), rank[:, -1] >= n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            users, lists = batch.column(user_col), batch.column("_seen")
            a, b = batch.column("_a").to_numpy(), batch.column("_b").to_numpy()
            at, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            todo, steps = np.arange(len(a)), min(n + 8, prime)
            while len(todo) and n > 0:
                late = []
                size = max(1, WALK_ELEMENTS // steps)
                for first in range(0, len(todo), size):
                    rows = todo[first : first + size]
                    counts = at[rows + 1] - at[rows]
                    seen_at = np.concatenate([[0], np.cumsum(counts)])
                    own = flat[np.arange(seen_at[-1]) + np.repeat(at[rows] - seen_at[:-1], counts)]
                    items, ranks, full = found(a[rows], b[rows], steps, seen_at, own)
                    done = full | (steps >= prime)
                    late.append(rows[~done])
                    r, c = np.nonzero((ranks > 0) & done[:, None])
                    yield pa.RecordBatch.from_arrays(
                        [users.take(pa.array(rows[r])), pa.array(items[r, c].astype(np.int32)), pa.array(ranks[r, c].astype(np.int32))], names=[user_col, item_col, "rank"]
                    )
                todo, steps = np.concatenate(late), min(2 * steps, prime)

    return run


def next_prime(n: int) -> int:
    def is_prime(p: int) -> bool:
        if p < 2:
            return False
        d = 2
        while d * d <= p:
            if p % d == 0:
                return False
            d += 1
        return True

    p = max(2, n)
    while not is_prime(p):
        p += 1
    return p


def recommend_random(
    users: DataFrame,
    interactions: DataFrame,
    n: int,
    n_items: int,
    seed: int = 42,
    exclude_seen: bool = True,
    user_col: str = "user_idx",
    item_col: str = "movie_idx",
) -> DataFrame:
    """Random baseline: ``n`` unseen items per user, score 1/n.

    Each user walks its own permutation ``t -> (a_u*t + b_u) mod P`` of [0, P) with P the
    smallest prime >= n_items and (a_u, b_u) from md5(seed, user).  Values >= n_items are
    skipped, so the first ``n + s + (P - n_items)`` steps always hold ``n + s`` items; a walk ends with
    its ``n``-th unseen item — no user × catalogue product is formed.
    """
    if n_items <= 0:
        return users.select(user_col).withColumn(item_col, F.lit(None).cast("int")).limit(0)
    P = next_prime(n_items)

    def h(tag: str) -> F.Column:
        text = F.concat_ws("|", F.lit(str(seed)), F.lit(tag), F.col(user_col).cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")

    walks = users.select(
        F.col(user_col), (F.lit(1) + F.pmod(h("a"), F.lit(P - 1))).alias("_a"), F.pmod(h("b"), F.lit(P)).alias("_b")
    )
    none = F.array().cast("array<bigint>")
    if exclude_seen:  # one list for each user, no longer than the catalogue where pairs do not repeat
        lists = interactions.where(F.col(item_col).between(0, n_items - 1)).groupBy(user_col).agg(F.collect_list(F.col(item_col).cast("bigint")).alias("_seen"))
        walks = walks.join(lists.hint("merge"), user_col, "left").withColumn("_seen", F.coalesce("_seen", none))
    else:
        walks = walks.withColumn("_seen", none)
    user = T.StructField(user_col, users.schema[user_col].dataType)
    schema = T.StructType([user, T.StructField(item_col, T.IntegerType()), T.StructField("rank", T.IntegerType())])
    return walks.mapInArrow(_walk(user_col, item_col, n, n_items, P), schema).select(user_col, item_col, F.lit(1.0 / n if n else 0.0).alias("score"), "rank")
