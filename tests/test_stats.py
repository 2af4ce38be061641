"""Statistics against textbook values and brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwork.operators import stats as S


def test_t_distribution():
    assert S.t_p(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert S.t_p(0.0, 5) == pytest.approx(1.0)
    assert S.t_p(12.706, 1) == pytest.approx(0.05, abs=1e-4)


def test_wilcoxon_exact():
    assert S.wilcoxon(np.array([1.0, 2, 3, 4, 5])) == pytest.approx((0.0, 0.0625))
    stat, p = S.wilcoxon(np.array([6.0, 8, 14, 16, 23, 24, 28, 29, 41, -48, 49, 56, 60, -67, 75]))
    assert stat == 24 and p == pytest.approx(0.04126, abs=1e-4)
    assert S.wilcoxon(np.zeros(4)) == (0.0, 1.0)


def test_shapiro_textbook():
    """Weights of eleven men, the example of the method's authors."""
    w, p = S.shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.002)


def test_normality_names():
    rng = np.random.default_rng(0)
    assert S.normality(np.array([1.0]))[2] == "not_enough_data" and S.normality(np.ones(9))[2] == "constant"
    assert S.normality(rng.normal(size=6000))[2] == "dagostino_k2" and S.normality(rng.normal(size=6000))[1] > 0.001
    assert S.normality(rng.exponential(size=6000))[1] < 1e-6 and S.normality(rng.exponential(size=100))[1] < 1e-4


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=12), st.lists(st.integers(-3, 3), min_size=1, max_size=12))
def test_delta(x, y):
    brute = sum((a > b) - (a < b) for a in x for b in y) / (len(x) * len(y))
    assert S.delta(np.array(x, float), np.array(y, float)) == pytest.approx(brute)


def test_paired_edges():
    nan = math.nan
    none = S.paired_test(np.array([nan]), np.array([nan]), np.array([1.0]))
    assert none["n_pairs"] == 0 and none["stat_note"] == "no_valid_pairs"
    one = S.paired_test(np.array([1.0]), np.array([2.0]), np.array([1.0]))
    assert one["std_diff"] == 0.0 and math.isnan(one["paired_t_p"])
    zero = S.paired_test(np.zeros(3), np.ones(3), np.ones(3))
    assert zero["degenerate_diff"] and zero["wilcoxon_p"] == 1.0 and zero["stat_note"] == "all_differences_zero" and math.isnan(zero["paired_t_p"])
    full = S.paired_test(np.array([1.0, 2, 4]), np.array([1.0, 2, 4]), np.zeros(3), 100)
    assert full["cohen_dz"] == pytest.approx(np.mean([1, 2, 4]) / np.std([1, 2, 4], ddof=1)) and full["rank_biserial"] == 1.0


def test_holm(spark):
    df = spark.createDataFrame([(0, 0.01), (1, None), (2, 0.04), (3, 0.03)], "i int, p double")
    got = [r.h for r in S.holm(df, "p", "h").orderBy("i").collect()]
    assert got[1] is None and [got[0], got[2], got[3]] == pytest.approx([0.03, 0.06, 0.06])


def test_sql_statistics_agree(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, 40) / 4, rng.integers(0, 6, 40) / 4
    df = spark.createDataFrame([(1, i, float(a), float(b), float(a - b)) for i, (a, b) in enumerate(zip(x, y))], "g int, i int, x double, y double, diff double")
    t = S.paired_tests(df, ["g"], "i").first()
    r = S.signed_ranks(df, ["g"]).first()
    v = df.select("g", F.explode(F.array(F.struct(F.lit(True).alias("is_x"), F.col("x").alias("value")), F.struct(F.lit(False).alias("is_x"), F.col("y").alias("value")))).alias("z")).select("g", "z.*")
    assert (r.rank_biserial, r.wilcoxon_stat) == pytest.approx((t.rank_biserial, t.wilcoxon_stat))
    assert S.cliffs_delta(v, ["g"]).first().cliffs_delta == pytest.approx(t.cliffs_delta)
    d = df.agg(S.cohen_dz(F.col("diff")).alias("dz"), S.t_statistic(F.col("diff")).alias("t")).first()
    assert (d.dz, d.t) == pytest.approx((t.cohen_dz, t.paired_t_stat))
    assert t.bootstrap_ci95_low <= t.mean_diff <= t.bootstrap_ci95_high
