"""Distributed order statistics against plain pandas."""

import numpy as np
import pandas as pd

from rankfold.operators.ordering import dense_index, positions, running_totals


def test_positions_total_order(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.integers(0, 20, 500), "b": rng.integers(0, 5, 500)})
    df = spark.createDataFrame(pdf).repartition(7)
    out = positions(df, ["a", "b"], out="pos", num_partitions=5).toPandas()
    assert sorted(out["pos"]) == list(range(500))
    out = out.sort_values("pos")
    assert (out[["a", "b"]].to_numpy() == pdf.sort_values(["a", "b"])[["a", "b"]].to_numpy()).all()


def test_dense_index_contiguous(spark):
    df = spark.createDataFrame([(x,) for x in [5, 3, 3, 9, 100, 5]], "v long")
    m = dense_index(df, "v").orderBy("encoded_id").collect()
    assert [r.original_id for r in m] == [3, 5, 9, 100]
    assert [r.encoded_id for r in m] == [0, 1, 2, 3]


def test_running_totals_grouped(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 300), "t": rng.permutation(300), "v": rng.random(300)})
    df = spark.createDataFrame(pdf)
    out = running_totals(df, ["t"], ["v"], group_cols=["g"], num_partitions=4).toPandas()
    exp = pdf.sort_values(["g", "t"]).assign(v_cum=lambda d: d.groupby("g")["v"].cumsum())
    got = out.sort_values(["g", "t"])
    assert np.allclose(got["v_cum"].to_numpy(), exp["v_cum"].to_numpy())


def test_running_totals_shuffle_and_write_the_rows_once(spark):
    """Rows are written as files with their sums; only one offset row per partition is joined to them."""
    rows = [(g, t, 1.0) for g, n in (("a", 900), (None, 700), ("b", 5)) for t in range(n)]
    df = spark.createDataFrame(rows, "g string, t int, v double")
    out = running_totals(df, ["t"], ["v"], group_cols=["g"], num_partitions=6)
    assert out.columns == ["g", "t", "v", "v_cum"]
    assert sorted(((r.g or "", r.t, r.v_cum) for r in out.collect())) == sorted((g or "", t, t + 1.0) for g, t, _ in rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert "LogicalRDD" not in plan and "parquet" in plan
    executed = out._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert "SortMergeJoin" not in executed and "BroadcastHashJoin" in executed
    assert running_totals(df.limit(0), ["t"], ["v"], group_cols=["g"]).count() == 0
    assert [r.v_cum for r in running_totals(df.where("g = 'b'"), ["t"], ["v"], num_partitions=3).orderBy("t").collect()] == [1.0, 2.0, 3.0, 4.0, 5.0]
