"""Session construction and lineage truncation.

Lineage is cut with reliable ``checkpoint()`` into the shared folder named by
``spark.checkpoint.dir``.  On a cluster that setting must come from the cluster
configuration; only a local master (tests, bench) may fall back to a fresh
scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # bounded broadcast: AQE converts a join to broadcast only below this size
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # reliable checkpoint files are removed once no DataFrame references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
# a local master needs no address that other machines can reach
LOCAL_CONF = {"spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1"}

ARROW_BATCH_BYTES = 8 << 20

_SHIPPED = "_rankfold_shipped"
_WRITTEN_PATH = "_rankfold_path"


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "rankfold",
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    builder = SparkSession.builder.appName(app_name).master(master)
    conf = dict(DEFAULT_CONF)
    if master.startswith("local["):
        conf |= LOCAL_CONF
        conf["spark.sql.shuffle.partitions"] = str(int(cpus))
        conf["spark.driver.memory"] = os.environ.get("RANKFOLD_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure_session(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once for each Spark context, so that
    functions run there wherever the driver was started from."""
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="rankfold-py-"), "rankfold_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    setattr(sc, _SHIPPED, True)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting one only where it is unset.

    Order: an already-active checkpoint dir, then ``spark.checkpoint.dir`` from the
    session conf, and only for a local master a new scratch folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; a cluster run needs a shared checkpoint folder"
            )
        configured = tempfile.mkdtemp(prefix="rankfold-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def configure_session(spark: SparkSession) -> None:
    """Runtime settings the results depend on: epoch seconds ↔ calendar fields in UTC; and small
    Arrow batches, since some rows are arrays of several MB.  Everything else (AQE, partitions,
    memory) is left to the cluster's configuration."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def materialize(df: DataFrame, name: str = "table", compression: str | None = None, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back; with ``partition_by``, a
    folder for each value of that column.

    For iterative jobs: the result is a plain file scan with no retained origin plan,
    so a loop whose step reads the previous step twice does not grow its plan.
    """
    root = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{root}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path, compression=compression, partitionBy=partition_by)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    setattr(written, _WRITTEN_PATH, path)
    return written


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`materialize` returned, once nothing will read them."""
    for df in tables:
        path = getattr(df, _WRITTEN_PATH, None)
        if path:
            delete_files(df.sparkSession, path)


def drop_written_tables(spark: SparkSession) -> None:
    """Delete the Parquet step tables this application wrote with :func:`materialize`.
    Call only when no DataFrame of the session will read them again."""
    delete_files(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables")


def delete_files(spark: SparkSession, name: str) -> None:
    """Delete a file or folder of any Hadoop filesystem, if it exists."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001 - Hadoop filesystem call
    path = jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    if fs.exists(path):
        fs.delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
