"""File sources and sinks: raw CSV inputs, Parquet outputs, model tables, run records.

Schemas are fixed (no inference).  Every write goes to a folder path (Hadoop
filesystem), so the same code works on local disk and on shared cluster storage.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfold.operators.prep import PreprocessingError

RATINGS_SCHEMA = T.StructType([
    T.StructField("userId", T.LongType()),
    T.StructField("movieId", T.LongType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("timestamp", T.LongType()),
])
MOVIES_SCHEMA = T.StructType([
    T.StructField("movieId", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("genres", T.StringType()),
])
TAGS_SCHEMA = T.StructType([
    T.StructField("userId", T.LongType()),
    T.StructField("movieId", T.LongType()),
    T.StructField("tag", T.StringType()),
    T.StructField("timestamp", T.LongType()),
])
_BAD = "_bad_line"
SCHEMAS = {"ratings.csv": RATINGS_SCHEMA, "movies.csv": MOVIES_SCHEMA, "tags.csv": TAGS_SCHEMA}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm  # noqa: SLF001 - Hadoop filesystem check
    conf = spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


@dataclass(frozen=True)
class CheckedCsv:
    """A raw file apart: ``rows`` of its schema, and ``bad`` (line, content) of the lines that do not
    fit it (a value of another type, too few or too many values).  Line 1 is the header."""

    rows: DataFrame
    bad: DataFrame


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, content): the lines of the files below ``path`` with their numbers in their file.

    A file is read in blocks; a block's lines are consecutive, so a line's number is its place in the
    block after the lines of the blocks before it, of which there is one row each."""
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("content")
    )
    sizes = text.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return text.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "content")


def check_csv(spark: SparkSession, path: str, schema: T.StructType) -> CheckedCsv:
    """Parse every line with ``schema``; lines that do not fit are kept as they are."""
    whole = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    parsed = F.from_csv("content", whole.simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    lines = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("content"))
    # the header is the first line of a file's first block; blank lines are no rows
    header = ",".join(f.name for f in schema.fields)
    plain = F.trim(F.col("content"))
    data = lines.where((plain != "") & ~((F.col("block") == 0) & (F.regexp_replace(plain, '[" ]', "") == header)))
    rows = data.select(parsed.alias("r")).where(F.col(f"r.{_BAD}").isNull()).select(*[F.col(f"r.{f.name}") for f in schema.fields])
    numbered = _numbered_lines(spark, path).where((F.trim("content") != "") & (F.col("line") > 1))
    bad = numbered.where(parsed[_BAD].isNotNull()).select("line", "content")
    return CheckedCsv(rows, bad)


def load_raw_csv(spark: SparkSession, raw_dir: str, filename: str, schema: T.StructType | None = None, bad_lines: str = "raise") -> DataFrame:
    """Read one raw CSV with a header and a fixed schema; a missing file raises.

    ``bad_lines``: "raise" counts the lines that do not fit the schema and raises with their number
    and the first of them; "skip" leaves them out (:func:`check_csv` returns them).  No line becomes a
    row of nulls.  Files without a known schema are read as strings."""
    path = f"{raw_dir.rstrip('/')}/{filename}"
    if not _exists(spark, path):
        raise PreprocessingError(f"no input file at {path}")
    schema = schema or SCHEMAS.get(filename)
    if schema is None:
        return spark.read.option("header", True).csv(path)
    if bad_lines not in ("raise", "skip"):
        raise ValueError(f"bad_lines is 'raise' or 'skip', not {bad_lines!r}")
    checked = check_csv(spark, path, schema)
    if bad_lines == "raise":
        found = checked.bad.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line", "content")).alias("first")).first()
        if found["n"]:
            raise PreprocessingError(f"{found['n']} lines of {path} do not fit its columns, the first is line {found['first']['line']}: {found['first']['content']}")
    return checked.rows


def load_raw_data(spark: SparkSession, raw_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ratings, movies and tags tables of a raw folder.  Tags may be absent: the folder is
    listed for them, and an empty table of their schema takes their place."""
    required = [load_raw_csv(spark, raw_dir, f"{name}.csv") for name in ("ratings", "movies")]
    optional = spark.createDataFrame([], TAGS_SCHEMA)
    if _exists(spark, f"{raw_dir.rstrip('/')}/tags.csv"):
        optional = load_raw_csv(spark, raw_dir, "tags.csv")
    return (*required, optional)


def save_parquet(df: DataFrame, path: str) -> None:
    """Overwrite ``path`` with ``df`` as Parquet (parents are created by the writer)."""
    df.write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise PreprocessingError(f"Parquet input not found: {path}") from e


# ----------------------------------------------------------------- model as tables


class ModelTableError(RuntimeError):
    """A model folder is missing, incomplete or of the wrong type."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm  # noqa: SLF001 - Hadoop filesystem call
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001


def model_versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, manifest path) of the published versions, the oldest first."""
    _, p, fs = _files(spark, f"{path.rstrip('/')}/manifests")
    if not fs.exists(p):
        return []
    names = [status.getPath() for status in fs.listStatus(p)]
    return sorted((int(n.getName().removesuffix(".json")), str(n)) for n in names if n.getName().endswith(".json"))


def _publish(spark: SparkSession, root: str, manifest: dict) -> int:
    """Write the manifest under the next free number.  A file that exists is never overwritten, so of
    two writers that choose one number the second goes on to the next."""
    number = (model_versions(spark, root) or [(0, "")])[-1][0] + 1
    while True:
        jvm, p, fs = _files(spark, f"{root}/manifests/{number:09d}.json")
        _, partial, _ = _files(spark, f"{root}/manifests/_{manifest['version']}.part")
        out = fs.create(partial, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if not fs.exists(p) and fs.rename(partial, p):
            return number
        number += 1


def save_model_tables(spark: SparkSession, path: str, model_type: str, tables: dict[str, DataFrame],
                      params: dict | None = None) -> int:
    """Save a model as a new version and return its number.

    Every version is a folder of its own, one Parquet folder for each table.  The manifest that names
    it is written last, in one step: readers see the previous version until then, whole, and a save
    that stops halfway leaves nothing that is ever read."""
    root = path.rstrip("/")
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/versions/{version}/{name}")
    manifest = {
        "version": version, "model_type": model_type, "created_at": dt.datetime.now(dt.UTC).replace(tzinfo=None).isoformat(), "params": params or {},
        "tables": sorted(tables),
    }
    return _publish(spark, root, manifest)


def load_model_tables(spark: SparkSession, path: str, expected_type: str | None = None, version: int | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """The manifest of the latest published version (or of ``version``), its type checked, and its tables."""
    root = path.rstrip("/")
    found = model_versions(spark, root)
    if not found:
        raise ModelTableError(f"no published model in {root}")
    chosen = dict(found).get(version) if version is not None else found[-1][1]
    if chosen is None:
        raise ModelTableError(f"no version {version} in {root}")
    meta = json.loads("".join(r[0] for r in spark.read.text(chosen, wholetext=True).collect()))
    if expected_type is not None and meta["model_type"] != expected_type:
        raise ModelTableError(f"Model type '{meta['model_type']}' is not supported here (expected '{expected_type}')")
    return meta, {name: spark.read.parquet(f"{root}/versions/{meta['version']}/{name}") for name in meta["tables"]}


def prune_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the latest ``keep`` versions and what unfinished saves left; returns the folders
    deleted.  Not while a save is running."""
    root = path.rstrip("/")
    found = model_versions(spark, root)
    kept = set()
    for _, manifest in found[-keep:]:
        kept.add(json.loads("".join(r[0] for r in spark.read.text(manifest, wholetext=True).collect()))["version"])
    for _, manifest in found[:-keep]:
        _, p, fs = _files(spark, manifest)
        fs.delete(p, False)
    _, folder, fs = _files(spark, f"{root}/versions")
    gone = [status.getPath() for status in fs.listStatus(folder) if status.getPath().getName() not in kept] if fs.exists(folder) else []
    for p in gone:
        fs.delete(p, True)
    return len(gone)


# ----------------------------------------------------------------- run records

RUNS_SCHEMA = (
    "run_id string, model_type string, params string, metrics map<string,double>, trained_at timestamp_ntz, "
    "git_sha string, version string, training_time_s double"
)


def record_run(spark: SparkSession, runs_path: str, model_type: str, params: dict, metrics: dict[str, float],
               training_time_s: float, git_sha: str = "unknown", version: str = "0") -> str:
    """Append one run row (metrics rounded to 6 places) to the Parquet ``runs`` table."""
    run_id = uuid.uuid4().hex
    row = [(run_id, model_type, json.dumps(params, sort_keys=True),
            {k: round(float(v), 6) for k, v in metrics.items()},
            dt.datetime.now(dt.UTC).replace(tzinfo=None), git_sha, version, round(training_time_s, 3))]
    spark.createDataFrame(row, RUNS_SCHEMA).coalesce(1).write.mode("append").parquet(runs_path)
    return run_id


def best_run(spark: SparkSession, runs_path: str, metric: str) -> DataFrame:
    """The run with the highest value of ``metric`` (one row; ties by latest)."""
    runs = spark.read.parquet(runs_path)
    key = F.struct(F.element_at("metrics", metric).alias("m"), F.col("trained_at"))
    return runs.agg(F.max_by(F.struct(*runs.columns), key).alias("best")).select("best.*")
