"""Readers for the driver tables and the recommender views derived from them.

Every reader selects only the columns the view needs, so the Parquet scan's
``ReadSchema`` carries just those columns and filters applied later are pushed
into the scan by Catalyst.

View definitions (the DuckDB oracle uses the same definitions, see
``rankfold.plans.sql``):

* ``ratings``  ← lineitem ⋈ orders: userId = o_custkey, movieId = l_partkey,
  rating = ceil(l_quantity / 5) / 2, timestamp = epoch seconds of l_shipdate
* ``movies``   ← part: title = "p_name (1950 + p_size)", genres pipe-joined from
  p_type and the words of p_name, "(no genres listed)" when p_size = 1
* ``tags``     ← documents: one row per word of the lower-cased text,
  userId = doc_id mod #customers, movieId = doc_id mod #parts, timestamp = doc_id
* ``item_vectors`` ← embeddings
* ``request_log``  ← events
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# fixed values: token pattern for tags (runs of letters), no-genre sentinel
TAG_TOKEN_SPLIT = r"[^\p{L}]+"
NO_GENRES = "(no genres listed)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(col_name: str) -> Column:
    """Seconds since 1970 of a TIMESTAMP_NTZ column (no time-zone dependence)."""
    return F.expr(
        f"CAST(timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {col_name}) AS BIGINT)"
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(orders, li.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").cast("bigint").alias("userId"),
        F.col("l_partkey").cast("bigint").alias("movieId"),
        (F.ceil(F.col("l_quantity") / 5) / 2).cast("double").alias("rating"),
        epoch_seconds("l_shipdate").alias("timestamp"),
    )


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    return part.select(
        F.col("p_partkey").cast("bigint").alias("movieId"),
        F.concat(F.col("p_name"), F.lit(" ("), (F.col("p_size") + 1950).cast("string"), F.lit(")")).alias(
            "title"
        ),
        F.when(F.col("p_size") == 1, F.lit(NO_GENRES))
        .otherwise(F.concat(F.col("p_type"), F.lit("|"), F.regexp_replace("p_name", " ", "|")))
        .alias("genres"),
    )


def tag_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(userId, movieId, text, timestamp): the documents whose words are the tags."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # scalar table sizes (one number each)
    n_cust = table(spark, sf_dir, "customer").count()
    n_part = table(spark, sf_dir, "part").count()
    return docs.select(
        (F.col("doc_id") % F.lit(n_cust)).cast("bigint").alias("userId"),
        (F.col("doc_id") % F.lit(n_part)).cast("bigint").alias("movieId"),
        "text",
        F.col("doc_id").cast("bigint").alias("timestamp"),
    )


def words_of(texts: DataFrame) -> DataFrame:
    """One row ``tag`` per word of the lower-cased ``text``, in its place."""
    columns = [F.explode(F.split(F.lower("text"), TAG_TOKEN_SPLIT)).alias("tag") if c == "text" else F.col(c) for c in texts.columns]
    return texts.select(*columns).where(F.col("tag") != "")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_of(tag_texts(spark, sf_dir))


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("item_idx"),
        F.col("embedding").alias("vec"),
        F.col("label"),
    )


def request_log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """One row per served request, shaped like the service's request events."""
    ev = events if events is not None else table(spark, sf_dir, "events")
    return shape_request_log(ev)


def container_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log as containers write it: container and service names, a null ``timestamp``
    from the decoded message, and the client's user agent."""
    return shape_container_log(request_log(spark, sf_dir))


def shape_container_log(log: DataFrame) -> DataFrame:
    """:func:`container_log` of a request log (batch or streaming)."""
    et = F.col("event_type")
    name = F.when(et == "purchase", F.lit("recsys-mlflow-1")).when(et == "view", F.lit("recsys-redis-1")).otherwise(F.lit("recsys-api-1"))
    return log.select(
        name.alias("container_name"), et.alias("event"), F.split_part(name, F.lit("-"), F.lit(2)).alias("service"),
        F.concat(F.lit("client/"), (F.col("user_id") % 7).cast("string")).alias("user_agent"), F.lit(None).cast("string").alias("timestamp"),
        "request_id", "ts", "user_id", "endpoint", "status", "latency_ms", *[c for c in ("props", "k", "corrupt") if c in log.columns and "corrupt" in log.columns],
    )


# fixed values: event type → endpoint of the request log view
ENDPOINT_EVENTS = {
    "/recommend": ("click", "view", "error"),
    "/similar": ("purchase",),
    "/recommend/batch": ("signup",),
}
ERROR_EVENT = "error"
COLD_START_EVENT = "signup"


def endpoint_in(*endpoints: str) -> Column:
    """Predicate on the source column (pushed into the Parquet scan) equal to
    ``endpoint IN endpoints`` on the shaped log."""
    events = sorted({e for ep in endpoints for e in ENDPOINT_EVENTS.get(ep, ())})
    return F.col("event_type").isin(*events) if events else F.lit(False)


def status_is(status: str) -> Column:
    """Source-column form of ``status = <status>`` (pushed into the scan)."""
    return (F.col("event_type") == ERROR_EVENT) if status == "error" else (
        F.col("event_type").isNotNull() & (F.col("event_type") != ERROR_EVENT)
    )


def shape_request_log(ev: DataFrame) -> DataFrame:
    et = F.col("event_type")
    return ev.select(
        F.col("event_id").cast("bigint").alias("request_id"),
        F.col("ts"),
        F.col("user_id").cast("bigint").alias("user_id"),
        et.alias("event_type"),
        F.when(et.isin(*ENDPOINT_EVENTS["/recommend"]), F.lit("/recommend"))
        .when(et.isin(*ENDPOINT_EVENTS["/similar"]), F.lit("/similar"))
        .when(et.isin(*ENDPOINT_EVENTS["/recommend/batch"]), F.lit("/recommend/batch"))
        .alias("endpoint"),
        F.when(et == ERROR_EVENT, F.lit("error")).otherwise(F.lit("success")).alias("status"),
        (et == COLD_START_EVENT).alias("cold_start"),
        F.col("value").cast("double").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("top_k"),
        F.col("props"),
    )
