import zlib

import pytest
from cases import awkward, documents
from pyspark.sql import functions as F

from rankfold.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 100, 257, 4096])
def test_permutation_in_spark_equals_the_formula(spark, n):
    rows = spark.range(n).select(F.col("id").alias("row"))
    got = {r.row: r.position for r in sharding.permuted(rows, "row", n, "position").collect()}
    assert sorted(got.values()) == list(range(n))
    if n > 1:
        assert got == {i: sharding.position_of(i, n) for i in range(n)}
        assert all(sharding.row_at(p, n) == i for i, p in got.items())


def test_shards_of_awkward_documents(spark):
    rows = awkward()
    got = sharding.assign_shards(documents(spark, rows), 3).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows
    )
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(3)}
    assert all(x == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_same_rows_same_shards_in_any_layout(spark):
    docs = documents(spark, awkward())
    one = sorted(map(str, sharding.assign_shards(docs.coalesce(1), 4).drop("row").collect()))
    assert one == sorted(map(str, sharding.assign_shards(docs.repartition(7, "text"), 4).drop("row").collect()))


def test_empty_table(spark):
    assert sharding.assign_shards(documents(spark, []), 8).count() == 0
