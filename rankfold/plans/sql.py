"""DuckDB oracle SQL: the recommender views and the preparation chain as CTEs.

Each oracle query is ``WITH <views and stages> <query>``; DuckDB inlines or
materialises only the CTEs a query references.  The definitions mirror
``rankfold.sources.tables`` and ``rankfold.plans.stages`` one to one.
"""

from __future__ import annotations

# fixed values shared with the Spark side
DEFAULT_MIN_USER = 20
DEFAULT_MIN_ITEM = 10
DEEP_MIN_USER = 28
DEEP_MIN_ITEM = 20
KCORE_UNROLL = 12
TRAIN_FRAC = 0.70
VAL_FRAC = 0.15
IMPLICIT_THRESHOLD = 3.0
EVAL_THRESHOLD = 3.5
TOP_K = 10
SEED = 42

BASE_VIEWS = {
    "ratings": """ratings AS (
  SELECT CAST(o.o_custkey AS BIGINT) AS userId,
         CAST(l.l_partkey AS BIGINT) AS movieId,
         CAST(ceil(l.l_quantity / 5) / 2 AS DOUBLE) AS rating,
         CAST(epoch(l.l_shipdate) AS BIGINT) AS "timestamp"
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)""",
    "movies": """movies AS (
  SELECT CAST(p_partkey AS BIGINT) AS movieId,
         p_name || ' (' || CAST(p_size + 1950 AS VARCHAR) || ')' AS title,
         CASE WHEN p_size = 1 THEN '(no genres listed)'
              ELSE p_type || '|' || replace(p_name, ' ', '|') END AS genres
  FROM part)""",
    "tags": r"""tags AS (
  SELECT CAST(w.doc_id % (SELECT count(*) FROM customer) AS BIGINT) AS userId,
         CAST(w.doc_id % (SELECT count(*) FROM part) AS BIGINT) AS movieId,
         w.tag, CAST(w.doc_id AS BIGINT) AS "timestamp"
  FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS tag
        FROM documents) w
  WHERE w.tag <> '')""",
    "item_vectors": """item_vectors AS (
  SELECT CAST(vec_id AS BIGINT) AS item_idx, embedding AS vec, label FROM embeddings)""",
    "request_log": """request_log AS (
  SELECT CAST(event_id AS BIGINT) AS request_id, ts, CAST(user_id AS BIGINT) AS user_id,
         event_type,
         CASE WHEN event_type IN ('click', 'view', 'error') THEN '/recommend'
              WHEN event_type = 'purchase' THEN '/similar'
              WHEN event_type = 'signup' THEN '/recommend/batch' END AS endpoint,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
         event_type = 'signup' AS cold_start,
         CAST(value AS DOUBLE) AS latency_ms,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS top_k,
         props
  FROM events)""",
}


def kcore_ctes(prefix: str, source: str, min_user: int, min_item: int, passes: int = KCORE_UNROLL) -> list[str]:
    """Unrolled fixed point of the k-core filter; ``{prefix}_core`` holds the surviving rows."""
    ctes = [
        f"{prefix}_e0 AS MATERIALIZED (SELECT userId, movieId, count(*) AS w FROM {source} GROUP BY userId, movieId)"
    ]
    for i in range(1, passes + 1):
        ctes.append(
            f"{prefix}_u{i} AS MATERIALIZED (SELECT * FROM {prefix}_e{i-1} WHERE userId IN "
            f"(SELECT userId FROM {prefix}_e{i-1} GROUP BY userId HAVING sum(w) >= {min_user}))"
        )
        ctes.append(
            f"{prefix}_e{i} AS MATERIALIZED (SELECT * FROM {prefix}_u{i} WHERE movieId IN "
            f"(SELECT movieId FROM {prefix}_u{i} GROUP BY movieId HAVING sum(w) >= {min_item}))"
        )
    ctes.append(
        f"{prefix}_core AS (SELECT r.* FROM {source} r "
        f"WHERE r.userId IN (SELECT userId FROM {prefix}_e{passes}) "
        f"AND r.movieId IN (SELECT movieId FROM {prefix}_e{passes}) "
        # the unrolled passes must have reached the fixed point
        f"AND CASE WHEN (SELECT count(*) FROM {prefix}_e{passes}) <> (SELECT count(*) FROM {prefix}_e{passes - 1}) "
        f"THEN error('{prefix}: the core still shrinks after {passes} passes') ELSE true END)"
    )
    return ctes


PREP_CTES = [
    *kcore_ctes("kc", "ratings", DEFAULT_MIN_USER, DEFAULT_MIN_ITEM),
    """user_map AS MATERIALIZED (
  SELECT userId AS original_id, CAST(row_number() OVER (ORDER BY userId) - 1 AS INTEGER) AS encoded_id
  FROM (SELECT DISTINCT userId FROM kc_core))""",
    """movie_map AS MATERIALIZED (
  SELECT movieId AS original_id, CAST(row_number() OVER (ORDER BY movieId) - 1 AS INTEGER) AS encoded_id
  FROM (SELECT DISTINCT movieId FROM kc_core))""",
    """encoded AS (
  SELECT c.rating, c."timestamp", um.encoded_id AS user_idx, mm.encoded_id AS movie_idx
  FROM kc_core c JOIN user_map um ON c.userId = um.original_id
                 JOIN movie_map mm ON c.movieId = mm.original_id)""",
    f"""split AS MATERIALIZED (
  SELECT rating, "timestamp", user_idx, movie_idx,
         CASE WHEN pos < floor(n * {TRAIN_FRAC!r}e0) THEN 'train'
              WHEN pos < floor(n * ({TRAIN_FRAC!r}e0 + {VAL_FRAC!r}e0)) THEN 'val'
              ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY "timestamp", user_idx, movie_idx, rating) - 1 AS pos,
               count(*) OVER () AS n FROM encoded))""",
    "train AS (SELECT * FROM split WHERE split = 'train')",
    "val AS (SELECT * FROM split WHERE split = 'val')",
    "test AS (SELECT * FROM split WHERE split = 'test')",
    f"""implicit_train AS MATERIALIZED (
  SELECT user_idx, movie_idx FROM train GROUP BY user_idx, movie_idx
  HAVING max(rating) >= {IMPLICIT_THRESHOLD!r}e0)""",
    "n_items AS (SELECT count(*) AS n FROM movie_map)",
]


def with_ctes(body: str, *extra: str, prepared: bool = False) -> str:
    ctes = list(BASE_VIEWS.values())
    if prepared:
        ctes += PREP_CTES
    ctes += list(extra)
    return "WITH " + ",\n".join(ctes) + "\n" + body
