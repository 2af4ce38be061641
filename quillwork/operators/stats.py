"""Paired inferential statistics.

What SQL can say (means, effect sizes, ranks, Holm) comes as Columns and windows; what needs resampling or exact null
distributions is numpy over one group of pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EVALUATION, SEED

RESULT = (
    "n_pairs long, mean_diff double, median_diff double, std_diff double, cohen_dz double, cliffs_delta double, rank_biserial double, "
    "paired_t_stat double, paired_t_p double, wilcoxon_stat double, wilcoxon_p double, bootstrap_ci95_low double, bootstrap_ci95_high double, "
    "normality_stat double, normality_p double, normality_test string, degenerate_diff boolean, stat_note string"
)
NAMES = [f.split()[0] for f in RESULT.split(", ")]
FLAT = 1e-12
#: Rows of a group that one task takes as they are; of a larger one it gets the different values and how often they come.
GROUP_ROWS = 20_000


# in SQL


def cohen_dz(diff: Column) -> Column:
    """Aggregate: mean over deviation, null for fewer than two values or without deviation."""
    sd = F.stddev_samp(diff)
    return F.when(sd > FLAT, F.avg(diff) / sd)


def t_statistic(diff: Column) -> Column:
    """Aggregate: the statistic of the paired t-test."""
    return cohen_dz(diff) * F.sqrt(F.count(diff))


def average_rank(by: list[str], value: Column) -> Column:
    """Ranks within ``by``, equal values sharing the mean of theirs."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0)


def signed_ranks(pairs: DataFrame, by: list[str], diff: str = "diff") -> DataFrame:
    """One row a group: rank sums of the positive and the negative differences, rank-biserial correlation and Wilcoxon's statistic; zeros are
    left out."""
    d = pairs.where(F.col(diff).isNotNull() & (F.col(diff) != 0))
    d = d.withColumn("_r", average_rank(by, F.abs(F.col(diff))))
    up, down = (F.sum(F.when(c, F.col("_r")).otherwise(0.0)) for c in (F.col(diff) > 0, F.col(diff) < 0))
    return d.groupBy(*by).agg(up.alias("w_plus"), down.alias("w_minus")).withColumns(
        {
            "rank_biserial": (F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus")),
            "wilcoxon_stat": F.least("w_plus", "w_minus"),
        }
    )


def cliffs_delta(values: DataFrame, by: list[str], value: str = "value", first: str = "is_x") -> DataFrame:
    """One row a group: (pairs with x > y less those with x < y) over all pairs, from ranks.  ``first`` marks the x."""
    v = values.where(F.col(value).isNotNull()).withColumn("_r", average_rank(by, F.col(value)))
    n, m = F.count_if(F.col(first)), F.count_if(~F.col(first))
    wins = F.sum(F.when(F.col(first), F.col("_r"))) - n * (n + 1) / F.lit(2.0)
    return v.groupBy(*by).agg(F.when((n > 0) & (m > 0), 2 * wins / (n * m) - 1).alias("cliffs_delta"))


def holm(rows: DataFrame, p: str, out: str, by: list[str] = ()) -> DataFrame:
    """``rows`` with Holm's correction of p over the whole table (or each ``by``); missing values stay so and don't count.

    The p-values of a report are its rows of (model, file, metric), a bounded number.
    """
    known = Window.partitionBy(*by, F.col(p).isNull())
    order = known.orderBy(p).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = (F.count(p).over(known) - F.row_number().over(known.orderBy(p)) + 1) * F.col(p)
    rows = rows.withColumn("_step", step)
    return rows.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("_step").over(order)))).drop("_step")


# in numpy


def bootstrap_ci(v: np.ndarray, n: int = EVALUATION.test_resamples, seed: int = SEED) -> tuple[float, float]:
    """95 % interval of the mean, from n resamples."""
    v = np.asarray(v, float)
    v = v[~np.isnan(v)]
    if not len(v):
        return math.nan, math.nan
    if len(v) == 1:
        return float(v[0]), float(v[0])
    rng = np.random.default_rng(seed)
    step = max(1, 2_000_000 // len(v))
    means = np.concatenate([v[rng.integers(0, len(v), (min(step, n - k), len(v)))].mean(1) for k in range(0, n, step)])
    return tuple(np.quantile(means, (0.025, 0.975)).tolist())


def resampled(v: np.ndarray, c: np.ndarray, n: int = EVALUATION.test_resamples, seed: int = SEED) -> tuple[float, float]:
    """``bootstrap_ci`` of the different values v that come c times each: how often a resample has each of them is drawn at once.

    The resamples have the same distribution, but they are other ones than those of ``bootstrap_ci``, which go by the order of the rows.
    """
    size = int(c.sum())
    if not size:
        return math.nan, math.nan
    if len(v) == 1:
        return float(v[0]), float(v[0])
    if 8 * len(v) > size:  # nearly all differ: drawing each is cheaper
        return bootstrap_ci(np.repeat(v, c), n, seed)
    rng = np.random.default_rng(seed)
    step = max(1, 2_000_000 // len(v))
    means = np.concatenate([rng.multinomial(size, c / size, min(step, n - k)) @ v / size for k in range(0, n, step)])
    return tuple(np.quantile(means, (0.025, 0.975)).tolist())


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p(t: float, df: int) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def ranks(v: np.ndarray) -> np.ndarray:
    """Average ranks."""
    _, at, count = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[at]


def wilcoxon(diff: np.ndarray) -> tuple[float, float]:
    """Statistic and two-sided p of the signed ranks, zeros left out: exact for up to 50 differences without ties, else by the
    normal approximation corrected for ties."""
    d = diff[diff != 0]
    n = len(d)
    if not n:
        return 0.0, 1.0
    r = ranks(np.abs(d))
    up, down = float(r[d > 0].sum()), float(r[d < 0].sum())
    stat = min(up, down)
    ties = np.unique(np.abs(d), return_counts=True)[1]
    if n <= 50 and (ties == 1).all() and n == len(diff):
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k]
        return stat, float(min(1.0, 2 * ways[: int(stat) + 1].sum() / 2.0**n))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48
    return stat, (2 * normal_tail(abs(stat - mean) / math.sqrt(var)) if var > 0 else 1.0)


def _quantile(p: float) -> float:
    """Of the normal distribution, by bisection then Newton's method."""
    low, high = -40.0, 40.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - normal_tail(mid) < p else (low, mid)
    return (low + high) / 2


def shapiro(v: np.ndarray) -> tuple[float, float]:
    """Shapiro and Wilk's W and its p, for 3 to 5000 values, by Royston's approximation (AS R94)."""
    x = np.sort(v)
    n = len(x)
    m = np.array([_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        u, mm = 1 / math.sqrt(n), float(m @ m)
        last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[-1] / math.sqrt(mm)], u)
        a = np.empty(n)
        if n > 5:
            next_ = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(mm)], u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * next_**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[1], a[-2] = -next_, next_
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[0], a[-1] = -last, last
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 1e-99
        y = -math.log(g - y)
        mu, s = np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        k = math.log(n)
        mu, s = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    return w, normal_tail((y - mu) / s)


def dagostino(v: np.ndarray) -> tuple[float, float]:
    """D'Agostino and Pearson's K squared and its p."""
    d = v - v.mean()
    return _k_squared(len(v), *((d**k).mean() for k in (2, 3, 4)))


def _k_squared(n: int, m2: float, m3: float, m4: float) -> tuple[float, float]:
    y = m3 / m2**1.5 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b - 1)) - 1
    alpha = math.sqrt(2 / (w2 - 1))
    z1 = math.asinh(y / alpha) / math.sqrt(0.5 * math.log(w2))
    e = 3 * (n - 1) / (n + 1)
    x = (m4 / m2**2 - e) / math.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5)))
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + math.sqrt(1 + 4 / s**2))
    ratio = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs(ratio) ** (1 / 3), ratio)) / math.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return k2, math.exp(-k2 / 2)


def normality(v: np.ndarray) -> tuple[float, float, str]:
    if len(v) < 3:
        return math.nan, math.nan, "not_enough_data"
    if np.ptp(v) <= FLAT:
        return math.nan, math.nan, "constant"
    return (*shapiro(v), "shapiro") if len(v) <= 5000 else (*dagostino(v), "dagostino_k2")


def delta(x, y):
    """Cliff's delta; missing values are dropped on either side alone."""
    x, y = x[~np.isnan(x)], np.sort(y[~np.isnan(y)])
    if not len(x) or not len(y):
        return math.nan
    return float((np.searchsorted(y, x, "left") - (len(y) - np.searchsorted(y, x, "right"))).sum() / (len(x) * len(y)))


def paired_test(diff: np.ndarray, x: np.ndarray, y: np.ndarray, resamples: int = EVALUATION.test_resamples, seed: int = SEED) -> dict:
    """All of RESULT for one group of pairs."""
    d = np.asarray(diff, float)
    d = d[~np.isnan(d)]
    n = len(d)
    out = dict.fromkeys(NAMES, math.nan) | {"n_pairs": n, "normality_test": "not_run", "degenerate_diff": False, "stat_note": ""}
    if not n:
        return out | {"stat_note": "no_valid_pairs"}
    out |= {"mean_diff": d.mean(), "median_diff": float(np.median(d)), "std_diff": d.std(ddof=1) if n > 1 else 0.0}
    out["cliffs_delta"] = delta(np.asarray(x, float), np.asarray(y, float))
    some = d[d != 0]
    if len(some):
        r = ranks(np.abs(some))
        out["rank_biserial"] = float((r[some > 0].sum() - r[some < 0].sum()) / r.sum())
    else:
        out["rank_biserial"] = 0.0
    if n == 1:
        return out | {"stat_note": "single_pair"}
    out["bootstrap_ci95_low"], out["bootstrap_ci95_high"] = bootstrap_ci(d, resamples, seed)
    if np.ptp(d) <= FLAT or out["std_diff"] <= FLAT:
        zero = bool((np.abs(d) <= FLAT).all())
        note = "all_differences_zero" if zero else "constant_difference"
        return out | {"degenerate_diff": True, "stat_note": note, "normality_test": "constant"} | ({"wilcoxon_stat": 0.0, "wilcoxon_p": 1.0} if zero else {})
    out["cohen_dz"] = out["mean_diff"] / out["std_diff"]
    out["paired_t_stat"] = out["cohen_dz"] * math.sqrt(n)
    out["paired_t_p"] = t_p(out["paired_t_stat"], n - 1)
    out["wilcoxon_stat"], out["wilcoxon_p"] = wilcoxon(d)
    out["normality_stat"], out["normality_p"], out["normality_test"] = normality(d)
    return out


def counted_test(d: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], resamples: int = EVALUATION.test_resamples, seed: int = SEED) -> dict:
    """``paired_test`` of a large group, from its different differences, x and y, ascending, and how often each comes."""
    v, c = d
    n = int(c.sum())
    out = dict.fromkeys(NAMES, math.nan) | {"n_pairs": n, "normality_test": "not_run", "degenerate_diff": False, "stat_note": ""}
    if n <= 5000:  # few of many rows have a difference
        return paired_test(np.repeat(v, c), np.repeat(*x), np.repeat(*y), resamples, seed)
    up_to = np.cumsum(c)
    middle = v[np.searchsorted(up_to, [(n - 1) // 2, n // 2], "right")]
    mean = float(v @ c) / n
    out |= {"mean_diff": mean, "median_diff": float(middle.mean()), "std_diff": math.sqrt(float((v - mean) ** 2 @ c) / (n - 1))}
    (vx, cx), (vy, cy) = x, y
    if len(vx) and len(vy):
        below = np.concatenate([[0], np.cumsum(cy)])
        less, not_more = below[np.searchsorted(vy, vx, "left")], below[np.searchsorted(vy, vx, "right")]
        wins = (less - (below[-1] - not_more)).astype(float)
        out["cliffs_delta"] = float(wins @ cx) / (float(cx.sum()) * float(cy.sum()))
    some = v != 0
    m = int(c[some].sum())
    ties = np.zeros(0)
    up = down = 0.0
    if m:
        sizes, at = np.unique(np.abs(v[some]), return_inverse=True)
        ties = np.bincount(at, c[some].astype(float), len(sizes))
        rank = (np.cumsum(ties) - (ties - 1) / 2)[at]
        up, down = (float(rank[sign] @ c[some][sign]) for sign in (v[some] > 0, v[some] < 0))
    out["rank_biserial"] = (up - down) / (up + down) if m else 0.0
    out["bootstrap_ci95_low"], out["bootstrap_ci95_high"] = resampled(v, c, resamples, seed)
    if np.ptp(v) <= FLAT or out["std_diff"] <= FLAT:
        zero = bool((np.abs(v) <= FLAT).all())
        note = "all_differences_zero" if zero else "constant_difference"
        return out | {"degenerate_diff": True, "stat_note": note, "normality_test": "constant"} | ({"wilcoxon_stat": 0.0, "wilcoxon_p": 1.0} if zero else {})
    out["cohen_dz"] = mean / out["std_diff"]
    out["paired_t_stat"] = out["cohen_dz"] * math.sqrt(n)
    out["paired_t_p"] = t_p(out["paired_t_stat"], n - 1)
    out["wilcoxon_stat"] = min(up, down)
    var = m * (m + 1) * (2 * m + 1) / 24 - float((ties**3 - ties).sum()) / 48
    out["wilcoxon_p"] = 2 * normal_tail(abs(out["wilcoxon_stat"] - m * (m + 1) / 4) / math.sqrt(var)) if var > 0 else 1.0
    out["normality_stat"], out["normality_p"] = _k_squared(n, *(float((v - mean) ** k @ c) / n for k in (2, 3, 4)))
    return out | {"normality_test": "dagostino_k2"}


def _by_size(rows: DataFrame, sizes: DataFrame, small, large) -> DataFrame:
    """``small`` of the groups of at most GROUP_ROWS rows and ``large`` of the others, each a function of their rows; ``sizes`` has a row a group, with
    its number of rows, or more, as ``_n``."""
    most = sizes.agg(F.min("_n").alias("a"), F.max("_n").alias("z")).first()
    if most.z is None or most.z <= GROUP_ROWS:
        return small(rows)
    if most.a > GROUP_ROWS:
        return large(rows)
    by = [c for c in sizes.columns if c != "_n"]

    def of(some: Column) -> DataFrame:
        groups = sizes.where(some).select(*[F.col(c).alias(f"_g_{c}") for c in by])
        on = F.lit(True)
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        return rows.join(F.broadcast(groups), on, "left_semi")

    return small(of(F.col("_n") <= GROUP_ROWS)).unionByName(large(of(F.col("_n") > GROUP_ROWS)))


def group_sizes(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("_n"))


def paired_tests(pairs: DataFrame, by: list[str], order: str, x: str = "x", y: str = "y", resamples: int = EVALUATION.test_resamples, sizes: DataFrame | None = None) -> DataFrame:
    """RESULT for each group of ``pairs``; the rows are put in order first, so resampling is reproducible.  Missing numbers come as nulls.

    A group is one comparison of one metric over the papers of a test set.  Of one of more than GROUP_ROWS pairs only the different values and
    their counts reach a task; ``sizes`` tells what the groups have at most, where that is cheaper than to count them.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        out = paired_test(a - b, a, b, resamples)
        row = {c: pdf[c].iloc[0] for c in by} | {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in out.items()}
        return pd.DataFrame([row])

    schema = ", ".join(f"{c} {kinds[c]}" for c in by)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v", kind="stable")
        of = [(p["v"].to_numpy(float), p["c"].to_numpy(np.int64)) for p in (pdf[pdf["side"] == k] for k in "dxy")]
        out = counted_test(*of, resamples)
        row = {c: pdf[c].iloc[0] for c in by} | {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in out.items()}
        return pd.DataFrame([row])

    def counted(rows: DataFrame) -> DataFrame:
        a, b = F.col(x).cast("double"), F.col(y).cast("double")
        sides = F.array(*[F.struct(F.lit(k).alias("side"), F.when(~F.isnan(v), v).alias("v")) for k, v in (("d", a - b), ("x", a), ("y", b))])
        rows = rows.select(*by, F.explode(sides).alias("_s")).groupBy(*by, "_s.side", "_s.v").agg(F.count("_s.v").alias("c"))
        return rows.groupBy(*by).applyInPandas(count, f"{schema}, {RESULT}")

    return _by_size(pairs, group_sizes(pairs, by) if sizes is None else sizes, lambda rows: rows.groupBy(*by).applyInPandas(go, f"{schema}, {RESULT}"), counted)


def bootstrap_table(values: DataFrame, by: list[str], order: str, value: str = "value", resamples: int = EVALUATION.summary_resamples, sizes: DataFrame | None = None) -> DataFrame:
    """``by`` with ci95_low and ci95_high of the mean; of a group of more than GROUP_ROWS rows only the different values and their counts reach a task."""
    kinds = {f.name: f.dataType.simpleString() for f in values.schema}

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = bootstrap_ci(pdf.sort_values(order, kind="stable")[value].to_numpy(float), resamples)
        return pd.DataFrame([{c: pdf[c].iloc[0] for c in by} | {"ci95_low": low, "ci95_high": high}])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v", kind="stable").dropna(subset="v")
        low, high = resampled(pdf["v"].to_numpy(float), pdf["c"].to_numpy(np.int64), resamples)
        return pd.DataFrame([{c: pdf[c].iloc[0] for c in by} | {"ci95_low": low, "ci95_high": high}])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "ci95_low double", "ci95_high double"])

    def counted(rows: DataFrame) -> DataFrame:
        v = rows.groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
        return v.groupBy(*by).applyInPandas(count, schema)

    # missing values are counted too, so that the values need not be made for it
    return _by_size(values.where(F.col(value).isNotNull()), group_sizes(values, by) if sizes is None else sizes, lambda rows: rows.groupBy(*by).applyInPandas(go, schema), counted)
