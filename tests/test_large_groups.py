"""Statistics of large groups, which come as different values and their counts, against those of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.operators import stats as S


def _pairs(n, seed=1):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 40, n) / 8, rng.integers(2, 40, n) / 8


def _counted(v):
    return np.unique(v, return_counts=True)


def test_counts_tell_what_rows_do():
    x, y = _pairs(6000)
    want, got = S.paired_test(x - y, x, y, 2000), S.counted_test(_counted(x - y), _counted(x), _counted(y), 2000)
    low, high = "bootstrap_ci95_low", "bootstrap_ci95_high"  # of other resamples
    assert all(got[k] == (pytest.approx(v, rel=1e-9) if isinstance(v, float) else v) for k, v in want.items() if k not in (low, high))
    assert [got[low], got[high]] == pytest.approx([want[low], want[high]], abs=0.15 * (want[high] - want[low]))
    same = np.full(6000, 0.5)
    for d in (same * 0, same):
        want, got = (f(*z, 10) for f, z in ((S.paired_test, (d, d, d * 0)), (S.counted_test, map(_counted, (d, d, d * 0)))))
        assert {k: v for k, v in got.items() if v == v} == {k: v for k, v in want.items() if v == v}


def test_large_groups_reach_tasks_as_counts(spark, monkeypatch):
    x, y = _pairs(6100)
    rows = [("a" if i < 6000 else None, i, float(p), float(q)) for i, (p, q) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "g string, i int, x double, y double")
    want = {r.g: r.asDict() for r in S.paired_tests(df, ["g"], "i", resamples=500).collect()}
    monkeypatch.setattr(S, "GROUP_ROWS", 1000)
    got = {r.g: r.asDict() for r in S.paired_tests(df, ["g"], "i", resamples=500).collect()}
    assert got[None] == want[None] and set(got) == set(want)  # the small group by its rows, draws and all
    assert all(got["a"][k] == (pytest.approx(v, rel=1e-9) if isinstance(v, float) else v) for k, v in want["a"].items() if not k.startswith("bootstrap"))
    v = df.select("g", "i", F.col("x").alias("value"))
    low, high = S.bootstrap_table(v, ["g"], "i", resamples=500).where("g = 'a'").select("ci95_low", "ci95_high").first()
    assert low < x[:6000].mean() < high and high - low == pytest.approx(3.92 * x.std() / 6000**0.5, rel=0.2)
