"""Report tables over metric records.

Metrics are melted to long form first, so a table costs one shuffle on its keys however many metrics it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_div
from . import metrics as M
from . import stats as S
from .places import places

GROUP = "architecture train_setting model_key condition test_file".split()
LENGTHS = [f"{s}_{u}" for s in ("source", "target", "prediction") for u in ("words", "tokens", "tokens_model_tokenizer")]
RISKS = [f"{s}_truncated_risk{k}" for s in ("source", "target") for k in ("", "_model_tokenizer")]
COMPACT = [m for m in M.CORE if m != "rougeLsum"]


def numeric(name: str, kind: str) -> Column:
    """A column as double; what is no number is missing, NaN too, and a boolean 0 or 1."""
    c = F.col(f"`{name}`")
    d = c.cast("int").cast("double") if kind == "boolean" else F.expr(f"try_cast(`{name}` AS double)") if kind == "string" else c.cast("double")
    return F.when(~F.isnan(d), d)


def melt(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``keys``, metric, value: one row a record and metric; missing values are left out."""
    kinds = dict(rows.dtypes)
    all_ = F.array(*[F.struct(F.lit(m).alias("metric"), numeric(m, kinds[m]).alias("value")) for m in metrics])
    return rows.select(*keys, F.explode(all_).alias("x")).select(*keys, "x.metric", "x.value").where("value is not null")


def retrieval_columns(rows: DataFrame) -> list[str]:
    """The evaluator's retrieval measures among the columns, by name."""
    names = [f"{m}@" for m in ("precision", "recall", "hit", "ndcg")]
    return sorted(c for c in rows.columns if c.startswith(("context_", "retrieval_")) and (c.endswith("_mrr") or any(f"_{n}" in c for n in names)))


def _wide(long_: DataFrame, by: list[str], aggs: dict[str, Column], metrics: list[str]) -> DataFrame:
    """A column for each metric and aggregate."""
    return long_.groupBy(*by).agg(*[a.alias(f"{m}_{name}") for m in metrics for name, a in ((n, f(m)) for n, f in aggs.items())])


def _of(f):
    return lambda m: f(F.when(F.col("metric") == m, F.col("value")))


def summary(rows: DataFrame, metrics: list[str], by: list[str] = GROUP, order: str = "paper_id", bootstrap: bool = True) -> DataFrame:
    """n, and of each metric mean, std (0 for one value), median, 95th percentile, min, max and the bootstrap interval of the mean, by group."""
    long_ = melt(rows, [*by, order], metrics)
    aggs = {
        "mean": _of(F.avg), "std": _of(lambda c: F.when(F.count(c) > 0, F.coalesce(F.stddev_samp(c), F.lit(0.0)))), "median": _of(F.median),
        "p95": _of(lambda c: F.percentile(c, F.lit(0.95))), "min": _of(F.min), "max": _of(F.max),
    }
    out = rows.groupBy(*by).agg(F.count("*").alias("n"))
    out = _nullsafe_join(out, _wide(long_, by, aggs, metrics), by)
    if bootstrap:
        ci = S.bootstrap_table(long_, [*by, "metric"], order, sizes=S.group_sizes(rows, by))
        low, high = ((lambda m, c=c: F.max(F.when(F.col("metric") == m, F.col(c)))) for c in ("ci95_low", "ci95_high"))
        out = _nullsafe_join(out, _wide(ci, by, {"ci95_low": low, "ci95_high": high}, metrics), by)
    return out.orderBy(*by)


def _nullsafe_join(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    b = b.select(*[F.col(c).alias(f"_r_{c}") for c in by], *[c for c in b.columns if c not in by])
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return a.join(b, on, "left").drop(*[f"_r_{c}" for c in by])


def compact(rows: DataFrame, metrics: list[str] = COMPACT, by: list[str] = GROUP) -> DataFrame:
    """n and the means of the main metrics."""
    present = [m for m in metrics if m in rows.columns]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(numeric(m, dict(rows.dtypes)[m])).alias(f"{m}_mean") for m in present]).orderBy(*by)


def truncation(rows: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """n; min, mean, 95th percentile and max of the nine lengths; count and rate of the four risks."""
    aggs = [F.count("*").alias("n")]
    for c in LENGTHS:
        aggs += [F.min(c).alias(f"{c}_min"), F.avg(c).alias(f"{c}_mean"), F.percentile(F.col(c), F.lit(0.95)).alias(f"{c}_p95"), F.max(c).alias(f"{c}_max")]
    for c in RISKS:
        aggs += [F.sum(F.col(c).cast("int")).alias(f"{c}_n"), F.avg(F.col(c).cast("int")).alias(f"{c}_rate")]
    return rows.groupBy(*by).agg(*aggs).orderBy(*by)


def retrieval(rows: DataFrame, by: tuple[str, ...] = ("condition", "test_file", "train_setting", "model_key")) -> DataFrame:
    """n; mean and std (0 for one value) of the retrieval measures."""
    aggs = [F.count("*").alias("n")]
    for c in retrieval_columns(rows):
        v = F.col(f"`{c}`")
        aggs += [F.avg(v).alias(f"{c}_mean"), F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias(f"{c}_std")]
    return rows.groupBy(*by).agg(*aggs).orderBy(*by)


def align(x: DataFrame, y: DataFrame, on: str = "paper_id_norm", value: str = "value", positional: bool = False) -> DataFrame:
    """``(on, x, y, diff)`` of the rows of equal id; with ``positional`` and no such row, of rows of equal place in the order of their ids."""
    a, b = x.select(on, F.col(value).alias("x")), y.select(on, F.col(value).alias("y"))
    both = a.join(b, on)
    if positional and both.isEmpty():
        a, b = (places(t.withColumn("_all", F.lit(0)), "_all", [on], "_p").drop("_all") for t in (a, b))
        both = a.join(b.drop(on), "_p").drop("_p")
    return both.withColumn("diff", F.col("x") - F.col("y"))


def _sides(long_: DataFrame, keys: list[str], is_x: Column, is_y: Column) -> DataFrame:
    """x and y of each of ``keys``, metric and paper that has both: one shuffle brings them together."""
    both = long_.groupBy(*keys, "metric", "paper_id_norm").agg(
        F.max(F.when(is_x, F.col("value"))).alias("x"), F.max(F.when(is_y, F.col("value"))).alias("y"), F.max(is_x).alias("hx"), F.max(is_y).alias("hy")
    )
    return both.where("hx and hy")


def _compare(both: DataFrame, rows: DataFrame, keys: list[str], names: tuple[str, str], comparison: Column, tests: bool = True) -> DataFrame:
    """Tests of x against y for each of ``keys`` and metric, of the records ``rows``; without ``tests`` the number of pairs and the means alone."""
    n = [] if tests else [F.count("*").alias("n_pairs")]
    out = both.groupBy(*keys, "metric").agg(*n, F.avg("x").alias(f"mean_{names[0]}"), F.avg("y").alias(f"mean_{names[1]}"))
    new = {"comparison": comparison, "metric_direction": M.direction(F.col("metric"))}
    if not tests:
        return out.withColumns(new)
    # a group has no more pairs than its file has records
    out = S.paired_tests(both, [*keys, "metric"], "paper_id_norm", sizes=S.group_sizes(rows, keys)).join(out, [*keys, "metric"]).withColumns(new)
    return S.holm(S.holm(out, "paired_t_p", "paired_t_p_holm"), "wilcoxon_p", "wilcoxon_p_holm")


def noiseaware_against_clean(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Noise-aware less clean-matched training, by architecture and test file."""
    long_ = melt(rows, ["architecture", "test_file", "condition", "train_setting", "paper_id_norm"], metrics)
    x, y = F.col("train_setting") == "noiseaware", F.col("train_setting") == "clean_matched"
    by = ["architecture", "test_file", "condition"]
    return _compare(
        _sides(long_, by, x, y), rows, by, ("noiseaware", "clean_matched"), F.lit("noiseaware_minus_clean_matched")
    ).withColumn("positive_means", F.lit("noiseaware_higher"))


def degradation(rows: DataFrame, metrics: list[str], tests: bool = True) -> DataFrame:
    """Each noisy test file less the clean one, by model; with retention and degradation (and without ``tests`` those and the number of pairs alone)."""
    keys = ["model_key", "architecture", "train_setting"]
    kinds, files = dict(rows.dtypes), ["test_file", "condition"]
    clean = F.col("condition") == "clean"
    names = [f"_m{k}" for k in range(len(metrics))]
    wide = rows.select(*keys, *files, "paper_id_norm", *[numeric(m, kinds[m]).alias(c) for m, c in zip(metrics, names)])
    # one shuffle brings all records of a paper together, with all metrics
    paper = wide.groupBy(*keys, "paper_id_norm").agg(
        F.collect_list(F.when(~clean, F.struct(*files, *names))).alias("noisy"), *[F.max(F.when(clean, F.col(c))).alias(f"{c}y") for c in names]
    )
    both = paper.select(*keys, "paper_id_norm", F.explode("noisy").alias("n"), *[f"{c}y" for c in names])
    both = both.groupBy(*keys, F.col("n.test_file").alias("test_file"), F.col("n.condition").alias("condition"), "paper_id_norm").agg(
        *[F.max(f"n.{c}").alias(c) for c in names], *[F.max(f"{c}y").alias(f"{c}y") for c in names]
    )
    told = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("x"), F.col(f"{c}y").alias("y")) for m, c in zip(metrics, names)])
    both = both.select(*keys, *files, "paper_id_norm", F.explode(told).alias("m")).select(*keys, *files, "paper_id_norm", "m.*").where("x is not null and y is not null")
    out = _compare(both, rows, [*keys, *files], ("noisy", "clean"), F.lit("noisy_minus_clean_test"), tests)
    a = F.col("mean_clean") - F.col("mean_noisy")
    return out.withColumns(
        {
            "retention_rate": safe_div(F.col("mean_noisy"), F.col("mean_clean")), "absolute_degradation": a,
            "relative_degradation": safe_div(a, F.col("mean_clean")), "negative_mean_diff_means": F.lit("noisy_lower"),
        }
    )


def additive_against_substitutive(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Additive less substitutive noise of the same difficulty, by model."""
    keys = ["model_key", "architecture", "train_setting"]
    long_ = melt(rows.where(F.col("condition").rlike("_(additive|substitutive)$")), [*keys, "condition", "paper_id_norm"], metrics)
    long_ = long_.withColumn("difficulty", F.substring_index("condition", "_", 1))
    x, y = F.col("condition").endswith("_additive"), F.col("condition").endswith("_substitutive")
    name = F.concat(F.col("difficulty"), F.lit("_additive_minus_substitutive"))
    of = rows.where(F.col("condition").rlike("_(additive|substitutive)$")).withColumn("difficulty", F.substring_index("condition", "_", 1))
    return _compare(_sides(long_, [*keys, "difficulty"], x, y), of, [*keys, "difficulty"], ("additive", "substitutive"), name).withColumn("positive_means", F.lit("additive_higher"))
