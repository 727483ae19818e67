"""Sessions: workers find the package from any folder; written tables can be deleted."""

import os
import subprocess
import sys
import tempfile
import textwrap

import pytest

from rankfold import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_worker_functions_run_from_a_foreign_folder():
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
        import __spark_entry__ as E
        print("ROWS", E.queries()["similar_items"](spark, "/root/testdata/sf0.001").count())
    """)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    out = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(prefix="rankfold-foreign-"), env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS " in out.stdout and int(out.stdout.rpartition("ROWS ")[2]) > 0, out.stderr[-2000:]


def test_release_deletes_only_its_own_table(spark):
    a, b = (session.materialize(spark.range(n), "release") for n in (3, 4))
    session.release(a, spark.range(5))
    assert b.count() == 4
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(getattr(a, session._WRITTEN_PATH)).count()


def test_a_cluster_needs_a_shared_checkpoint_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):
            return Conf()

    spark = type("Spark", (), {"sparkContext": Context(), "conf": Conf()})()
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.ensure_checkpoint_dir(spark)
