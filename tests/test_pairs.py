"""All pairs met block by block, against the same from one row a pair."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.operators import noise as N
from quillwork.operators import pairs
from quillwork.operators import vectors as V


def _tables(spark, odd=True):
    """Documents with many equal scores, and among them vectors that are missing, of another length, or without a number."""
    rng = np.random.default_rng(3)
    some = rng.normal(size=(40, 4)).round(2)
    docs = [(i, some[i % 40].tolist(), f"s{i % 7}") for i in range(300)]
    if odd:
        docs += [(300, None, "s0"), (301, [1.0, 2.0], "s1"), (302, [1.0, None, 0.0, 0.0], None), (303, [1.0, math.nan, 0.0, 0.0], "s2"), (-1, [0.0] * 4, "s3")]
    queries = [(f"q{i}", some[3 * i].tolist(), f"s{i % 7}") for i in range(9)]
    if odd:
        queries += [("short", [0.5, 0.5], "s1"), ("none", None, "s2"), ("nan", [math.nan, 0.0, 0.0, 0.0], None)]
    q = spark.createDataFrame(queries, "query_id string, embedding array<double>, own_source string")
    return q, spark.createDataFrame(docs, "doc_id long, embedding array<double>, source_doc_id string")


def _rows(df):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("k", [1, 3, 50, 400])
def test_search_is_that_of_all_rows(spark, k, monkeypatch):
    monkeypatch.setattr(pairs, "QUERY_BLOCK", 1000)
    q, docs = _tables(spark)
    names = ("query_id", "doc_id", "score", "rank")
    got = V.search(q, docs, k).select(*names)
    assert _rows(got) == _rows(V.top_k(V.scores(q, docs), k).select(*names))
    assert not any(x in got._jdf.queryExecution().toString() for x in ("NestedLoop", "Cartesian"))  # no row a pair


@pytest.mark.parametrize("mode", list(N.MODES))
def test_vector_band_is_the_band_of_all_rows(spark, mode):
    q, docs = _tables(spark)
    assert _rows(N.vector_band(q, docs, mode)) == _rows(N.band(V.scores(q, docs), mode).select("query_id", "doc_id", "score"))


@pytest.mark.parametrize("mode", [*N.MODES, "mixed_easy_hard"])
@pytest.mark.parametrize("few", [64, 0])
def test_vector_sample_is_the_sample_of_all_rows(spark, mode, few, monkeypatch):
    monkeypatch.setattr(pairs, "FEW", few)  # 0: counts alone, to the last key
    q, docs = _tables(spark)
    papers = q.withColumnRenamed("query_id", "paper_id")
    clean = V.search(q, docs, 3).select(F.col("query_id").alias("paper_id"), "doc_id")
    asked = papers.select("paper_id", F.col("paper_id").alias("query_id"), "own_source")
    want = N.sample(asked, docs.select("doc_id", "source_doc_id"), V.scores(q, docs), mode, 2, clean=clean)
    got = N.vector_sample(papers, docs, mode, 2, clean=clean)
    assert _rows(got) == _rows(want.select(*got.columns)) and got.count() == 24


def test_halves_round_as_in_sql(spark):
    """Scores that lie on a half of the last digit, where a matrix product may fall on either side."""
    v = [(k, [(2 * k + 1) / 2e6, 0.0]) for k in range(-60, 60)]
    docs = spark.createDataFrame(v, "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.5])], "query_id long, embedding array<double>")
    assert _rows(V.search(q, docs, 120).select("doc_id", "score")) == _rows(V.scores(q, docs).select("doc_id", "score"))


def test_gold_needs_only_what_is_ranked(spark):
    from quillwork.operators import assemble as A

    df = spark.createDataFrame([([1, 2, 3], [2, 7, 8, 9], [2], 4)], "r array<int>, g array<int>, few array<int>, n int")
    a, b = df.select(A.gold_at_k(F.col("r"), F.col("g"), 3).alias("a"), A.gold_at_k(F.col("r"), F.col("few"), 3, F.col("n")).alias("b")).first()
    assert a == b and a.recall == 0.25
