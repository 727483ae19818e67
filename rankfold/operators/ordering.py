"""Global order statistics without a single-partition window.

``Window.orderBy`` without ``partitionBy`` moves every row into one task.  The
helpers here range-partition the rows instead, write that layout (so a
recomputation after a lost executor sees the same partition bounds), and add
per-partition offsets that are computed over a table with a row or two per partition
and broadcast: the rows themselves are shuffled and written once.

* :func:`positions`       0-based position of each row in a total order
* :func:`running_totals`  running sums of value columns inside groups, in order
* :func:`dense_index`     contiguous 0-based ids of the distinct values of a column
* :func:`quantiles`       exact interpolated quantiles from value counts
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfold.session import materialize

ColumnLike = str | Column


def _ranged(df: DataFrame, order: Sequence[ColumnLike], num_partitions: int | None) -> DataFrame:
    """Range-partition and sort by ``order``, tag rows with the partition id.  To be written before it is
    read twice: range bounds come from sampling.

    Without ``num_partitions`` the ranges follow the size of the data: adaptive execution merges
    small neighbours.
    """
    ranges = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    return ranges.sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id())


def positions(
    df: DataFrame,
    order: Sequence[ColumnLike],
    out: str = "pos",
    num_partitions: int | None = None,
) -> DataFrame:
    """Append ``out`` = 0-based position of each row in the total order ``order``.

    Rows that tie on every ordering column get distinct consecutive positions; which
    of the tied rows gets which is immaterial because they are equal on ``order``.
    """
    at = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)
    ranged = materialize(_ranged(df, order, num_partitions).withColumn("_mid", at), "positions")
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a global window here is over at most num_partitions rows
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        ranged.join(F.broadcast(offsets), "_pid")
        .withColumn(out, (F.col("_off") + F.col("_mid")).cast("bigint"))
        .drop("_pid", "_mid", "_off")
    )


def dense_index(
    df: DataFrame,
    col: str,
    original: str = "original_id",
    encoded: str = "encoded_id",
    num_partitions: int | None = None,
) -> DataFrame:
    """Contiguous 0-based INT ids for the distinct non-null values of ``col``, in sorted order."""
    distinct = df.select(F.col(col).alias(original)).where(F.col(original).isNotNull()).distinct()
    return positions(distinct, [original], out=encoded, num_partitions=num_partitions).select(
        original, F.col(encoded).cast("int").alias(encoded)
    )


def _same(a: object, b: object) -> bool:
    return a == b or bool(pd.isna(a) and pd.isna(b))


def _cumsum_batches(group_cols: list[str], value_cols: list[str], out_cols: list[str]):
    """Running sums inside a partition; ``_edge`` marks its first row (1), its last (2), or both (3)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry_key: tuple | None = None
        carry = np.zeros(len(value_cols))
        held: pd.DataFrame | None = None
        for pdf in batches:
            if pdf.empty:
                continue
            vals = pdf[value_cols].astype("float64")
            if group_cols:
                cums = vals.groupby([pdf[g] for g in group_cols], sort=False, dropna=False).cumsum()
                first_key = tuple(pdf[g].iloc[0] for g in group_cols)
                if carry_key is not None and all(map(_same, first_key, carry_key)):
                    same = np.ones(len(pdf), dtype=bool)
                    for g, k in zip(group_cols, first_key, strict=True):
                        same &= (pdf[g].isna() if pd.isna(k) else pdf[g] == k).to_numpy(dtype=bool, na_value=False)
                    cums.loc[same, :] = cums.loc[same, :].to_numpy() + carry
                last_key = tuple(pdf[g].iloc[-1] for g in group_cols)
            else:
                cums = vals.cumsum() + carry
                last_key = ()
            out = pdf.copy()
            for src, dst in zip(value_cols, out_cols, strict=True):
                out[dst] = cums[src].to_numpy()
            out["_edge"] = np.zeros(len(out), dtype=np.int32)
            if carry_key is None:
                out.iloc[0, -1] = 1
            carry_key, carry = last_key, cums.iloc[-1].to_numpy()
            if held is not None:
                yield held
            held = out
        if held is not None:
            held.iloc[-1, -1] += 2
            yield held

    return run


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    value_cols: Sequence[str],
    group_cols: Sequence[str] = (),
    suffix: str = "_cum",
    num_partitions: int | None = None,
) -> DataFrame:
    """Append ``<v><suffix>`` = inclusive running sum of each value column within
    ``group_cols`` in ``order`` (as DOUBLE).

    Layout: range partitions over (group, order); inside each partition a vectorised
    cumulative sum (Arrow batches, state carried across the batches of one partition), written
    once.  Only the group at the beginning of a partition can have rows in earlier ones: their sums
    are offsets with one row per partition, broadcast.  No group is ever gathered into one task
    unless it fits one range.
    """
    group_cols = list(group_cols)
    value_cols = list(value_cols)
    out_cols = [f"{v}{suffix}" for v in value_cols]
    ranged = _ranged(df, [*group_cols, *order], num_partitions)
    schema = T.StructType(
        [
            *ranged.schema.fields,
            *[T.StructField(c, T.DoubleType(), True) for c in out_cols],
            T.StructField("_edge", T.IntegerType(), True),
        ]
    )
    local = materialize(ranged.mapInPandas(_cumsum_batches(group_cols, value_cols, out_cols), schema), "totals")
    # the sum of a partition's last group, which the next partitions may go on with, counts from behind
    # the partition; the first row of a partition asks for what is before it
    edges = local.where("_edge > 0").select(
        "_pid", "_edge", *group_cols, *[F.when(F.col("_edge") >= 2, F.col(o)).otherwise(0.0).alias(f"_t_{v}") for v, o in zip(value_cols, out_cols, strict=True)]
    )
    marks = edges.select("*", F.explode(F.when(F.col("_edge") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array("_edge"))).alias("_side"))
    earlier = Window.partitionBy(*group_cols).orderBy("_pid", "_side").rowsBetween(Window.unboundedPreceding, -1)
    # a side of 1 adds nothing to the sums of others
    adding = [F.when(F.col("_side") == 2, F.col(f"_t_{v}")).otherwise(0.0) for v in value_cols]
    offsets = marks.select(
        F.col("_pid").alias("_at_pid"), "_side", *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group_cols)],
        *[F.sum(x).over(earlier).alias(f"_o_{v}") for v, x in zip(value_cols, adding, strict=True)],
    ).where("_side = 1").drop("_side")
    match = F.col("_pid") == F.col("_at_pid")
    for i, g in enumerate(group_cols):
        match &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = local.join(F.broadcast(offsets), match, "left")
    return joined.select(
        *df.columns,
        *[(F.col(o) + F.coalesce(F.col(f"_o_{v}"), F.lit(0.0))).alias(o) for v, o in zip(value_cols, out_cols, strict=True)],
    )


def quantiles(df: DataFrame, value: str, qs: Sequence[float], group_cols: Sequence[str] = ()) -> DataFrame:
    """Per group: ``n`` (non-null values) and ``q0``, ``q1``, ... with linear interpolation between
    the two values around position q * (n - 1).

    Value counts are summed before the shuffle and their running sums are distributed, so a
    group with very many values is never held in one task.
    """
    group_cols = list(group_cols)
    v = F.col(value).cast("double").alias("_v")
    counts = df.select(*group_cols, v).where(F.col("_v").isNotNull()).groupBy(*group_cols, "_v").agg(F.count(F.lit(1)).alias("_c"))
    summed = running_totals(counts, ["_v"], ["_c"], group_cols=group_cols)
    totals = summed.groupBy(*group_cols).agg(F.max("_c_cum").alias("n"))
    if group_cols:
        placed = summed.join(totals, group_cols)
    else:
        placed = summed.withColumn("n", F.lit(totals.first()[0]))
    picks = []
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("n") - 1)
        picks += [
            F.min(F.when(F.col("_c_cum") > F.floor(at), F.col("_v"))).alias(f"_lo{i}"),
            F.min(F.when(F.col("_c_cum") > F.ceil(at), F.col("_v"))).alias(f"_hi{i}"),
        ]
    found = placed.groupBy(*group_cols).agg(F.max("n").alias("n"), *picks)
    return found.select(
        *group_cols,
        F.col("n").cast("bigint").alias("n"),
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (F.lit(float(q)) * (F.col("n") - 1) - F.floor(F.lit(float(q)) * (F.col("n") - 1))))
            .alias(f"q{i}")
            for i, q in enumerate(qs)
        ],
    )
