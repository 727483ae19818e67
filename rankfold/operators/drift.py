"""Column drift between a reference and a current table.

Each column has one test, given by name or chosen by the preset of the drift library the
reference calls [lib]:

* ``wasserstein``    W1 / population std of the reference (std floored at 0.001), drift at >= 0.1
* ``jensenshannon``  square root of the divergence (natural log), drift at >= 0.1
* ``ks``             two-sample Kolmogorov-Smirnov, asymptotic p-value < 0.05
* ``chisquare``      Pearson against the reference shares, p-value < 0.05
* ``z``              two-sample proportions test of a column with two values, p-value < 0.05

The preset takes a distance for references of more than 1000 rows and a p-value otherwise
[ours: asymptotic instead of exact]; numeric columns with more than 5 different reference
values count as continuous.  Pass ``tests`` to fix the test of a column whatever the size of
the table.  String and boolean columns are categories.  The dataset drifts when the share of
drifted columns reaches ``drift_share`` (0.5).

Everything is computed from histograms (:func:`histogram`), which can be kept per hour and merged: the
work is linear in the histogram of the reference and those of the reports, however many there are.
``z`` is for columns of at most two reference values and null for others.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold.operators.ordering import running_totals
from rankfold.session import materialize

# fixed values of the preset
BIG_REFERENCE_ROWS = 1000
FEW_UNIQUE = 5
DISTANCE_THRESHOLD = 0.1
P_VALUE_THRESHOLD = 0.05
STD_FLOOR = 0.001
DRIFT_SHARE = 0.5


CONTINUOUS_TESTS = ("wasserstein", "ks")
CATEGORY_TESTS = ("jensenshannon", "chisquare", "z")


def _is_category(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column] in ("string", "boolean")


def histogram(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., feature, value, category, n): counts of every value of every column (nulls dropped);
    numbers are in ``value``, strings and booleans in ``category``."""
    keep = keep or []
    stacked = ", ".join(
        f"'{c}', CAST(NULL AS DOUBLE), CAST(`{c}` AS STRING)" if _is_category(df, c) else f"'{c}', CAST(`{c}` AS DOUBLE), CAST(NULL AS STRING)"
        for c in columns
    )
    long = df.selectExpr(*keep, f"stack({len(columns)}, {stacked}) AS (feature, value, category)").where(
        F.col("value").isNotNull() | F.col("category").isNotNull()
    )
    return long.groupBy(*keep, "feature", "value", "category").agg(F.count(F.lit(1)).alias("n"))


def merge_histograms(histograms: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Histograms of parts (hours, folders, runs) as the histogram of the whole, for each ``keep``."""
    return histograms.groupBy(*(keep or []), "feature", "value", "category").agg(F.sum("n").alias("n"))


def histogram_statistics(reference: DataFrame, current: DataFrame, group: str | None = None) -> DataFrame:
    """Per column (and report key): n_ref, n_cur, n_unique_ref, std_ref, wasserstein_raw, ks, js, chi2, z, dof
    from a histogram of the reference and one of the current data, the latter for each report.

    The reference is not copied for the reports: it is merged once with the values of all reports, in
    value order, which gives its share F and the integral of F up to each of them.  Between two
    neighbouring values of a report its own share c is constant, and F crosses c at most once; where,
    comes from a second merge in the order of shares.  Values that only the reference has enter the
    sums as a whole: what they would add depends on their total share alone."""
    g = [group] if group else []
    value = ["feature", "value", "category"]
    ref_totals = reference.groupBy("feature").agg(
        F.sum("n").alias("n_ref"), F.count(F.lit(1)).alias("n_unique_ref"), F.sum(F.col("n") * F.col("value")).alias("_s1"),
        F.sum(F.col("n") * F.col("value") * F.col("value")).alias("_s2"), F.min("value").alias("_lo"), F.max("value").alias("_hi"),
    )
    cur_totals = current.groupBy(*g, "feature").agg(F.sum("n").alias("n_cur"), F.count(F.lit(1)).alias("_values"))
    # reference counts at all values of either side
    both = reference.select(*value, F.col("n").alias("c_ref")).unionByName(current.select(*value, F.lit(0).cast("bigint").alias("c_ref")))
    counted = both.groupBy(*value).agg(F.sum("c_ref").alias("c_ref")).join(ref_totals.select("feature", "n_ref", "_lo"), "feature")
    counted = counted.withColumn("_w", F.coalesce(F.col("c_ref") * (F.col("value") - F.col("_lo")), F.lit(0.0)))
    merged = running_totals(counted, ["value", "category"], ["c_ref", "_w"], group_cols=["feature"])
    points = merged.select(
        *value, "c_ref", (F.col("c_ref") / F.col("n_ref")).alias("p"), (F.col("c_ref_cum") / F.col("n_ref")).alias("f"),
        ((F.col("value") - F.col("_lo")) * F.col("c_ref_cum") / F.col("n_ref") - F.col("_w_cum") / F.col("n_ref")).alias("area"),
    )
    shared = current.join(cur_totals, [*g, "feature"]).withColumn("one", F.lit(1))
    placed = running_totals(shared, ["value", "category"], ["n", "one"], group_cols=[*g, "feature"])
    known = points.select(F.col("feature").alias("_f"), F.col("value").alias("_v"), F.col("category").alias("_c"), "c_ref", "p", "f", "area")
    own = materialize(
        placed.join(known, (F.col("feature") == F.col("_f")) & F.col("value").eqNullSafe(F.col("_v")) & F.col("category").eqNullSafe(F.col("_c"))).select(
            *g, *value, "n", "n_cur", "_values", F.col("one_cum").cast("bigint").alias("at"), (F.col("n_cum") / F.col("n_cur")).alias("c"), "c_ref", "p", "f", "area"
        ),
        "drift-own",
    )
    after = own.select(*g, "feature", (F.col("at") - 1).alias("at"), F.col("value").alias("next"), F.col("area").alias("next_area"), (F.col("f") - F.col("p")).alias("next_f"))
    # the first reference value at which its share reaches c
    levels = points.where("value IS NOT NULL AND c_ref > 0").select("feature", F.col("f").alias("level"), F.lit(1).alias("_ref"), F.lit(1).alias("one"), "value", "area", *[F.lit(None).cast(own.schema[k].dataType).alias(k) for k in g], F.lit(None).cast("bigint").alias("at"))
    asked = own.where("value IS NOT NULL").select("feature", F.col("c").alias("level"), F.lit(0).alias("_ref"), F.lit(0).alias("one"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("area"), *g, "at")
    ordered = running_totals(levels.unionByName(asked), ["level", "_ref"], ["one"], group_cols=["feature"])
    reached = ordered.where("_ref = 1").select("feature", F.col("one_cum").cast("bigint").alias("_k"), F.col("value").alias("cross"), F.col("area").alias("cross_area"))
    crossing = ordered.where("_ref = 0").select("feature", (F.col("one_cum") + 1).cast("bigint").alias("_k"), *g, "at").join(reached, ["feature", "_k"])
    rows = own.join(after, [*g, "feature", "at"], "left").join(crossing.drop("_k"), [*g, "feature", "at"], "left").join(ref_totals, "feature")

    a, b, c, p = F.col("value"), F.col("next"), F.col("c"), F.col("p")
    q = F.col("n") / F.col("n_cur")
    m = (p + q) / 2.0
    kl = lambda share: F.when(share > 0, share * F.log(share / m)).otherwise(0.0)
    x = F.least(F.greatest(F.coalesce("cross", b), a), b)
    area_x = F.when(x <= a, F.col("area")).when(x >= b, F.col("next_area")).otherwise(F.col("cross_area"))
    between = c * (x - a) - (area_x - F.col("area")) + (F.col("next_area") - area_x) - c * (b - x)
    whole_area = F.col("_hi") - F.col("_lo") - (F.col("_s1") / F.col("n_ref") - F.col("_lo"))
    beyond = F.when(F.col("_hi") > a, F.col("_hi") - a - (whole_area - F.col("area"))).otherwise(0.0)
    last = F.col("at") == F.col("_values")
    expected = p * F.col("n_cur")
    pooled = (F.col("c_ref") + F.col("n")) / (F.col("n_ref") + F.col("n_cur"))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n_ref") + 1 / F.col("n_cur")))
    sums = rows.groupBy(*g, "feature").agg(
        F.sum(F.when(last, beyond).otherwise(between) + F.when(F.col("at") == 1, F.col("area")).otherwise(0.0)).alias("wasserstein_raw"),
        F.max(F.greatest(F.abs(F.col("f") - c), F.abs(F.col("next_f") - c), F.when(F.col("at") == 1, F.col("f") - p))).alias("ks"),
        (F.sum(0.5 * kl(p) + 0.5 * kl(q)) + 0.5 * F.log(F.lit(2.0)) * (1 - F.sum(p))).alias("_jsd"),
        (F.sum(F.when(expected > 0, (F.col("n") - expected) ** 2 / expected - expected).otherwise(0.0)) + F.max("n_cur")).alias("chi2"),
        F.max(F.when(spread > 0, F.abs(p - q) / spread).otherwise(0.0)).alias("_z"),
    )
    # two proportions, for columns of at most two reference values: also those that the report lacks
    few = reference.join(ref_totals.where("n_unique_ref <= 2").select("feature", "n_ref"), "feature").join(cur_totals, "feature")
    theirs = current.select(*[F.col(k).alias(f"_{k}") for k in g], F.col("feature").alias("_f"), F.col("value").alias("_v"), F.col("category").alias("_c"))
    same = [F.col(k) == F.col(f"_{k}") for k in g] + [F.col("feature") == F.col("_f"), F.col("value").eqNullSafe(F.col("_v")), F.col("category").eqNullSafe(F.col("_c"))]
    lacking = few.join(theirs, reduce(Column.__and__, same), "left_anti").withColumn("pool", F.col("n") / (F.col("n_ref") + F.col("n_cur")))
    alone = F.sqrt(F.col("pool") * (1 - F.col("pool")) * (1 / F.col("n_ref") + 1 / F.col("n_cur")))
    missed = lacking.groupBy(*g, "feature").agg(F.max(F.when(F.col("pool") < 1, F.col("n") / F.col("n_ref") / alone)).alias("_missed"))
    start = cur_totals.drop("_values") if g else ref_totals.select("feature").join(cur_totals.drop("_values"), "feature", "left")
    var = F.col("_s2") / F.col("n_ref") - (F.col("_s1") / F.col("n_ref")) ** 2
    return start.join(ref_totals, "feature").join(sums, [*g, "feature"], "left").join(missed, [*g, "feature"], "left").select(
        *g,
        "feature",
        F.col("n_ref").cast("bigint").alias("n_ref"),
        F.coalesce("n_cur", F.lit(0)).cast("bigint").alias("n_cur"),
        F.col("n_unique_ref").cast("bigint").alias("n_unique_ref"),
        F.sqrt(F.greatest(var, F.lit(0.0))).alias("std_ref"),
        F.greatest("wasserstein_raw", F.lit(0.0)).alias("wasserstein_raw"),
        "ks",
        F.sqrt(F.greatest(F.col("_jsd"), F.lit(0.0))).alias("js"),
        "chi2",
        F.when(F.col("n_unique_ref") <= 2, F.greatest("_z", "_missed")).alias("z"),
        (F.col("n_unique_ref") - 1).cast("bigint").alias("dof"),
    )


def column_statistics(reference: DataFrame, current: DataFrame, columns: list[str], group: str | None = None) -> DataFrame:
    """:func:`histogram_statistics` of two tables; ``current`` carries the report key."""
    return histogram_statistics(
        materialize(histogram(reference, columns), "drift-ref"), materialize(histogram(current, columns, [group] if group else []), "drift-cur"), group
    )


def _ks_p_value(d: float, n: int, m: int) -> float:
    """Asymptotic two-sample Kolmogorov–Smirnov p-value."""
    if n == 0 or m == 0:
        return 1.0
    en = math.sqrt(n * m / (n + m))
    lam = (en + 0.12 + 0.11 / en) * d
    if lam < 1e-3:
        return 1.0
    s = sum(2 * (-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    return min(max(s, 0.0), 1.0)


def _chi2_sf(x: float, dof: int) -> float:
    """Upper tail of chi-square: regularised upper incomplete gamma Q(dof/2, x/2)."""
    if dof <= 0:
        return 1.0
    a, z = dof / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    if z < a + 1:  # series for P, then Q = 1 - P
        term = total = 1.0 / a
        k = a
        for _ in range(500):
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1.0 - total * math.exp(-z + a * math.log(z) - math.lgamma(a)))
    # continued fraction for Q (Lentz)
    b = z + 1 - a
    c = 1 / 1e-300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1 / d
        h *= d * c
    return min(1.0, math.exp(-z + a * math.log(z) - math.lgamma(a)) * h)


def drift_columns(reference: DataFrame, current: DataFrame, columns: list[str], threshold: float = DISTANCE_THRESHOLD,
                  group: str | None = None, tests: dict[str, str] | None = None) -> DataFrame:
    """Per column: test, statistic and threshold.  ``tests`` names the test of a column; columns
    it leaves out follow the preset."""
    tests = tests or {}
    for column, test in tests.items():
        if test not in (*CONTINUOUS_TESTS, *CATEGORY_TESTS):
            raise ValueError(f"unknown drift test {test!r} of column {column!r}")
        if column in columns and test in CONTINUOUS_TESTS and _is_category(reference, column):
            raise ValueError(f"column {column!r} is a category; {test!r} needs numbers")
    return tested(column_statistics(reference, current, columns, group), [c for c in columns if _is_category(reference, c)], threshold, group, tests)


def tested(
    st: DataFrame, categories: list[str], threshold: float = DISTANCE_THRESHOLD, group: str | None = None, tests: dict[str, str] | None = None
) -> DataFrame:
    """Each column's test on the statistics of :func:`histogram_statistics`."""
    tests = tests or {}
    wass = F.col("wasserstein_raw") / F.greatest(F.col("std_ref"), F.lit(STD_FLOOR))
    big = F.col("n_ref") > BIG_REFERENCE_ROWS
    continuous = ~F.col("feature").isin(categories) & (F.col("n_unique_ref") > FEW_UNIQUE)
    test = (
        F.when(big & continuous, F.lit("wasserstein")).when(big, F.lit("jensenshannon")).when(continuous, F.lit("ks"))
        .when(F.col("n_unique_ref") > 2, F.lit("chisquare")).otherwise(F.lit("z"))
    )
    for column, name in tests.items():
        test = F.when(F.col("feature") == column, F.lit(name)).otherwise(test)
    by_test = {"wasserstein": wass, "jensenshannon": F.col("js"), "ks": F.col("ks"), "chisquare": F.col("chi2"), "z": F.col("z")}
    statistic = F.lit(None).cast("double")
    for name, value in by_test.items():
        statistic = F.when(F.col("stattest") == name, value).otherwise(statistic)
    distance = F.col("stattest").isin("wasserstein", "jensenshannon")
    return st.withColumn("stattest", test).withColumn("_statistic", statistic).select(
        *([group] if group else []),
        "feature", "n_ref", "n_cur", "n_unique_ref", "stattest",
        F.round("_statistic", 6).alias("statistic"),
        F.round(F.col("ks"), 6).alias("ks_statistic"),
        "dof",
        "_statistic",
        F.when(distance, F.lit(threshold)).otherwise(F.lit(P_VALUE_THRESHOLD)).alias("threshold"),
    )


def finalize_small_tests(cols: DataFrame) -> DataFrame:
    """Add the drift flag; p-values where the test has one.

    The table has one row per column (bounded by the column count), so the p-value
    helpers run in a Pandas UDF over that tiny table.
    """
    @F.pandas_udf("double")
    def p_value(test: pd.Series, x: pd.Series, dof: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        for t, v, k, a, b in zip(test, x, dof, n, m, strict=True):
            if t == "ks":
                out.append(_ks_p_value(float(v), int(a), int(b)))
            elif t == "chisquare":
                out.append(_chi2_sf(float(v), int(k)))
            elif t == "z":
                out.append(math.erfc(float(v) / math.sqrt(2.0)))
            else:
                out.append(float("nan"))
        return pd.Series(out, dtype="float64")

    pv = p_value("stattest", "_statistic", "dof", "n_ref", "n_cur")
    distance = F.col("stattest").isin("wasserstein", "jensenshannon")
    drifted = F.when(distance, F.col("_statistic") >= F.col("threshold")).otherwise(pv < F.col("threshold"))
    return cols.withColumn("drifted", drifted).drop("_statistic")


def drift_summary(columns_df: DataFrame, drift_share: float = DRIFT_SHARE, group: str | None = None) -> DataFrame:
    """Dataset drift: share of drifted columns and the flag (share >= drift_share)."""
    g = [group] if group else []
    return columns_df.groupBy(*g).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_columns"),
        F.sum(F.col("drifted").cast("int")).cast("bigint").alias("n_drifted"),
        F.max("n_ref").alias("reference_rows"),
        F.max("n_cur").alias("current_rows"),
    ).select(
        *g, "n_columns", "n_drifted",
        F.round(F.col("n_drifted") / F.col("n_columns"), 6).alias("drift_score"),
        (F.col("n_drifted") / F.col("n_columns") >= drift_share).alias("drift_detected"),
        "reference_rows", "current_rows",
    )


def common_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    """Columns present in both tables, in the reference's order."""
    cur = set(current.columns)
    return [c for c in reference.columns if c in cur]
