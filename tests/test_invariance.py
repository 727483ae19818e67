"""Results do not depend on the number of shuffle partitions (1 vs 8)."""

import pytest

import __spark_entry__ as E

NAMES = ["temporal_split", "random_split", "recommend_random", "recommend_popular", "similar_items", "rating_cdf"]


@pytest.mark.parametrize("name", NAMES)
def test_partition_count_invariance(spark, small_dir, name):
    from rankfold.plans import stages

    out = []
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        stages._MEMO.clear()
        df = E.queries()[name](spark, small_dir)
        out.append(sorted(tuple(r) for r in df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    stages._MEMO.clear()
    assert out[0] == out[1]
