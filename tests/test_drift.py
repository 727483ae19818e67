"""Drift: identical tables do not drift, a shifted column does."""

import numpy as np
import pandas as pd

from rankfold.operators import drift as D


def _tables(spark, shift):
    rng = np.random.default_rng(0)
    ref = pd.DataFrame({"x": rng.normal(size=2000), "c": rng.integers(0, 3, 2000).astype(float)})
    cur = pd.DataFrame({"x": rng.normal(size=1500) + shift, "c": rng.integers(0, 3, 1500).astype(float)})
    return spark.createDataFrame(ref), spark.createDataFrame(cur)


def test_no_drift_on_same_distribution(spark):
    ref, cur = _tables(spark, 0.0)
    cols = D.finalize_small_tests(D.drift_columns(ref, cur, ["x", "c"]))
    rows = {r.feature: r for r in cols.collect()}
    assert rows["x"].stattest == "wasserstein" and rows["c"].stattest == "jensenshannon"
    assert not rows["x"].drifted and not rows["c"].drifted
    assert D.drift_summary(cols).first().drift_detected is False


def test_shift_drifts(spark):
    ref, cur = _tables(spark, 1.0)
    rows = {r.feature: r for r in D.finalize_small_tests(D.drift_columns(ref, cur, ["x", "c"])).collect()}
    assert rows["x"].drifted
    assert 0.8 < rows["x"].statistic < 1.2  # W1 of a unit shift / std 1


def test_small_reference_uses_p_values(spark):
    rng = np.random.default_rng(1)
    ref = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=300)}))
    cur = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=300) + 2.0}))
    r = D.finalize_small_tests(D.drift_columns(ref, cur, ["x"])).first()
    assert r.stattest == "ks" and r.drifted


def test_grouped_reports_equal_single_reports(spark):
    """Per-report statistics equal a standalone drift computation for that report."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    ref = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=1500)}))
    cur_pdf = pd.DataFrame({"x": np.r_[rng.normal(size=1200), rng.normal(size=1300) + 0.5],
                            "g": ["a"] * 1200 + ["b"] * 1300})
    cur = spark.createDataFrame(cur_pdf)
    grouped = {r.g: r for r in D.finalize_small_tests(
        D.drift_columns(ref, cur, ["x"], group="g")).collect()}
    for g in ("a", "b"):
        single = D.finalize_small_tests(D.drift_columns(ref, cur.where(F.col("g") == g), ["x"])).first()
        assert grouped[g].statistic == single.statistic
        assert grouped[g].drifted == single.drifted
    assert grouped["b"].drifted and not grouped["a"].drifted


def test_named_tests_on_strings_and_flags(spark):
    rng = np.random.default_rng(4)
    ref = pd.DataFrame({"s": rng.choice(["a", "b", "c"], 400), "f": rng.random(400) < 0.5, "x": rng.normal(size=400)})
    cur = pd.DataFrame({"s": rng.choice(["a", "b", "c"], 400, p=[0.7, 0.2, 0.1]), "f": rng.random(400) < 0.52, "x": rng.normal(size=400)})
    tests = {"s": "chisquare", "f": "z", "x": "wasserstein"}
    rows = {r.feature: r for r in D.finalize_small_tests(
        D.drift_columns(spark.createDataFrame(ref), spark.createDataFrame(cur), ["s", "f", "x"], tests=tests)).collect()}
    assert {c: r.stattest for c, r in rows.items()} == tests
    assert rows["s"].drifted and rows["f"].drifted == (rows["f"].statistic > 1.959964) and not rows["x"].drifted
    p, q = ref.f.mean(), cur.f.mean()
    pool = (ref.f.sum() + cur.f.sum()) / 800
    assert abs(rows["f"].statistic - abs(p - q) / np.sqrt(pool * (1 - pool) / 200)) < 1e-6
    expected = ref.s.value_counts(normalize=True) * 400
    assert abs(rows["s"].statistic - ((cur.s.value_counts() - expected) ** 2 / expected).sum()) < 1e-6


def test_a_number_test_on_strings_is_refused(spark):
    import pytest

    t = spark.createDataFrame([("a",)], "s string")
    with pytest.raises(ValueError):
        D.drift_columns(t, t, ["s"], tests={"s": "ks"})
    with pytest.raises(ValueError):
        D.drift_columns(t, t, ["s"], tests={"s": "nope"})


def _direct(ref, cur):
    """Wasserstein distance, KS, Jensen-Shannon and chi-square over all values of both sides."""
    values = np.unique(np.concatenate([ref, cur]))
    p = np.array([(ref == v).mean() for v in values])
    q = np.array([(cur == v).mean() for v in values])
    f, c = np.cumsum(p), np.cumsum(q)
    m = (p + q) / 2
    kl = lambda x: np.sum(np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / m), 0))
    e = p * len(cur)
    n = q * len(cur)
    return (
        np.sum(np.abs(f - c)[:-1] * np.diff(values)), np.max(np.abs(f - c)), np.sqrt(max(0.5 * kl(p) + 0.5 * kl(q), 0)),
        np.sum(((n - e) ** 2 / np.where(e > 0, e, 1))[e > 0]),
    )


def test_statistics_match_direct_computation_for_many_reports(spark):
    """Ties, values on one side only, reports left, right and inside of the reference's range."""
    rng = np.random.default_rng(9)
    ref = np.round(rng.normal(size=300) * 4)
    reports = {f"r{i}": np.round(rng.normal(size=int(n)) * w + s, d) for i, (n, w, s, d) in enumerate(
        [(50, 4, 0, 0), (1, 0, 3, 0), (30, 1, 50, 0), (30, 1, -50, 1), (200, 9, 2, 2), (7, 0, 0, 0), (2, 30, 0, 0)])}
    current = spark.createDataFrame([(g, float(x)) for g, xs in reports.items() for x in xs] + [("r0", None)], "g string, x double")
    got = {r.g: r for r in D.column_statistics(spark.createDataFrame([(float(x),) for x in ref] + [(None,)], "x double"), current, ["x"], "g").collect()}
    assert set(got) == set(reports)
    for g, xs in reports.items():
        w, ks, js, chi2 = _direct(ref, xs)
        r = got[g]
        assert np.allclose([r.wasserstein_raw, r.ks, r.js, r.chi2], [w, ks, js, chi2], atol=1e-9), g
        assert r.n_ref == 300 and r.n_cur == len(xs) and abs(r.std_ref - ref.std()) < 1e-9


def test_hourly_histograms_merge_to_the_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(int(h), float(x), str(s)) for h, x, s in zip(rng.integers(0, 5, 400), rng.integers(0, 9, 400), rng.choice(["a", "b"], 400), strict=True)]
    df = spark.createDataFrame(rows, "hour int, x double, s string")
    merged = D.merge_histograms(D.histogram(df, ["x", "s"], ["hour"]))
    assert sorted(map(tuple, merged.collect()), key=str) == sorted(map(tuple, D.histogram(df, ["x", "s"]).collect()), key=str)


def test_a_flag_value_that_a_report_lacks_counts(spark):
    ref = spark.createDataFrame([(i % 4 == 0,) for i in range(400)], "f boolean")
    cur = spark.createDataFrame([(False,)] * 100, "f boolean")
    r = D.column_statistics(ref, cur, ["f"]).first()
    pool = 400 * 0.75 + 100
    pool = pool / 500
    assert abs(r.z - 0.25 / np.sqrt(pool * (1 - pool) * (1 / 400 + 1 / 100))) < 1e-9
