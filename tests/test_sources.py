"""Sources and sinks: CSV with fixed schemas, optional tags, Parquet, model tables, runs."""

import tempfile

import pytest

from rankfold.operators.prep import PreprocessingError
from rankfold.sources import files


@pytest.fixture()
def raw_dir():
    # reference's tiny CSV pair: 10 ratings, 5 users, 4 movies, one without genres
    d = tempfile.mkdtemp(prefix="rankfold-raw-")
    with open(f"{d}/ratings.csv", "w") as f:
        f.write("userId,movieId,rating,timestamp\n")
        rows = [(1, 1, 4.0), (1, 2, 3.5), (2, 1, 5.0), (2, 3, 2.0), (3, 2, 4.5),
                (3, 4, 3.0), (4, 1, 1.0), (4, 4, 4.0), (5, 3, 3.5), (5, 2, 2.5)]
        for i, (u, m, r) in enumerate(rows):
            f.write(f"{u},{m},{r},{1000 + i}\n")
    with open(f"{d}/movies.csv", "w") as f:
        f.write("movieId,title,genres\n1,A (1995),Action|Comedy\n2,B (2000),Drama\n3,C (2001),Action\n"
                "4,D (1999),(no genres listed)\n")
    return d


def test_load_raw_data_without_tags(spark, raw_dir):
    ratings, movies, tags = files.load_raw_data(spark, raw_dir)
    assert ratings.count() == 10 and movies.count() == 4
    assert tags.count() == 0 and tags.columns == ["userId", "movieId", "tag", "timestamp"]
    assert dict(ratings.dtypes)["timestamp"] == "bigint"


def test_missing_file_raises(spark, raw_dir):
    with pytest.raises(PreprocessingError):
        files.load_raw_csv(spark, raw_dir, "nope.csv")


def test_parquet_roundtrip(spark, raw_dir):
    ratings, _, _ = files.load_raw_data(spark, raw_dir)
    out = tempfile.mkdtemp(prefix="rankfold-out-") + "/deep/ratings"
    files.save_parquet(ratings, out)
    assert files.read_parquet(spark, out).count() == 10


def test_model_tables_type_check(spark, raw_dir):
    _, movies, _ = files.load_raw_data(spark, raw_dir)
    path = tempfile.mkdtemp(prefix="rankfold-model-")
    files.save_model_tables(spark, path, "popularity", {"movies": movies}, {"n": 10})
    meta, tables = files.load_model_tables(spark, path, "popularity")
    assert meta["params"] == {"n": 10} and tables["movies"].count() == 4
    with pytest.raises(files.ModelTableError):
        files.load_model_tables(spark, path, "hybrid")


def test_runs_best(spark):
    path = tempfile.mkdtemp(prefix="rankfold-runs-") + "/runs"
    files.record_run(spark, path, "popularity", {}, {"precision_at_k": 0.1234567}, 1.0)
    files.record_run(spark, path, "random", {}, {"precision_at_k": 0.01}, 1.0)
    best = files.best_run(spark, path, "precision_at_k").first()
    assert best.model_type == "popularity" and best.metrics["precision_at_k"] == 0.123457


def test_bad_lines_are_reported_by_number_and_content(spark, raw_dir):
    with open(f"{raw_dir}/ratings.csv", "a") as f:
        f.write('6,1,four,1000\n\n7,1,3.0,1000\n8,1,2.0\n"9","1","2.5","1000"\n10,1,2.0,1000,extra\n')
    checked = files.check_csv(spark, f"{raw_dir}/ratings.csv", files.RATINGS_SCHEMA)
    assert sorted(map(tuple, checked.bad.collect())) == [(12, "6,1,four,1000"), (15, "8,1,2.0"), (17, "10,1,2.0,1000,extra")]
    assert checked.rows.count() == 12 and checked.rows.where("rating IS NULL OR userId IS NULL").isEmpty()
    with pytest.raises(PreprocessingError, match="3 lines .* line 12: 6,1,four,1000"):
        files.load_raw_csv(spark, raw_dir, "ratings.csv")
    assert files.load_raw_csv(spark, raw_dir, "ratings.csv", bad_lines="skip").count() == 12


def test_lines_are_numbered_across_blocks(spark):
    d = tempfile.mkdtemp(prefix="rankfold-raw-")
    with open(f"{d}/ratings.csv", "w") as f:
        f.write("userId,movieId,rating,timestamp\n")
        for i in range(20_000):
            f.write(f"{i},1,{'bad' if i % 3001 == 7 else '2.5'},1000\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        checked = files.check_csv(spark, f"{d}/ratings.csv", files.RATINGS_SCHEMA)
        assert sorted(r.line for r in checked.bad.collect()) == [i + 2 for i in range(20_000) if i % 3001 == 7]
        assert checked.rows.count() == 20_000 - 7
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_readers_never_see_half_a_model(spark, raw_dir):
    _, movies, _ = files.load_raw_data(spark, raw_dir)
    path = tempfile.mkdtemp(prefix="rankfold-model-")
    first = files.save_model_tables(spark, path, "popularity", {"movies": movies, "users": movies.limit(1)}, {"n": 1})

    class Stops:
        @property
        def write(self):
            raise RuntimeError("the job was killed")

    with pytest.raises(RuntimeError):
        files.save_model_tables(spark, path, "popularity", {"movies": movies.limit(2), "users": Stops()}, {"n": 2})
    meta, tables = files.load_model_tables(spark, path, "popularity")
    assert meta["params"] == {"n": 1} and tables["movies"].count() == 4 and tables["users"].count() == 1
    # a reader that loaded the first version keeps it while the next one is published
    second = files.save_model_tables(spark, path, "popularity", {"movies": movies.limit(3)}, {"n": 3})
    assert second == first + 1 and tables["movies"].count() == 4
    meta, tables = files.load_model_tables(spark, path)
    assert meta["params"] == {"n": 3} and tables["movies"].count() == 3
    assert files.load_model_tables(spark, path, version=first)[0]["params"] == {"n": 1}
    assert files.prune_versions(spark, path, keep=1) == 2
    assert files.load_model_tables(spark, path)[1]["movies"].count() == 3
    with pytest.raises(files.ModelTableError):
        files.load_model_tables(spark, path, version=first)


def test_two_writers_publish_two_versions(spark, raw_dir):
    path = tempfile.mkdtemp(prefix="rankfold-model-")
    one = files._publish(spark, path, {"version": "a"})
    assert files._publish(spark, path, {"version": "b"}) == one + 1
    assert [n for n, _ in files.model_versions(spark, path)] == [one, one + 1]


def test_folder_without_a_published_model(spark):
    with pytest.raises(files.ModelTableError):
        files.load_model_tables(spark, tempfile.mkdtemp())
