"""Vector scores, exact top-k, maximal marginal relevance, retrieval."""

from __future__ import annotations

import re
import zlib
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BUILD, SEED
from ..functions import text as T
from . import pairs


#: Queries that are sent to every executor together.
QUERY_BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null unless both have the same length."""
    product = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    return F.when(F.size(a) == F.size(b), product)


def normalized(v: Column) -> Column:
    """The vector at length 1; one of zeros stays."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0))


class Encoder(Protocol):
    """Texts to vectors of one length; a model can be plugged in here."""

    def encode(self, text: Column) -> Column: ...


class HashedWords:
    """Counts of tokens in buckets of their checksum, at length 1: an encoder that needs no model."""

    def __init__(self, buckets: int = 64):
        self.buckets = buckets

    def vectors(self, texts: pa.Array) -> pa.Array:
        """One text at a time is a Python string, and the numbers go as one array."""
        n, pattern = self.buckets, re.compile(T.TOKEN)
        out = np.zeros((len(texts), n))
        for i, t in enumerate(texts):
            at = [zlib.crc32(w.lower().encode()) % n for w in pattern.findall(t.as_py() or "")]
            out[i] = np.bincount(at, minlength=n) if at else 0
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * n), pa.array(out.reshape(-1)))

    def encode(self, text: Column) -> Column:
        def vectors(texts):
            return self.vectors(texts)

        # said here, since hints of this module are strings
        vectors.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        return F.arrow_udf(vectors, "array<double>")(text)


def scores(queries: DataFrame, docs: DataFrame, digits: int = 6) -> DataFrame:
    """``(query_id, doc_id, score)`` of every query against every document.

    Queries are the templates or probes of a run.  So many that one array of them suits an executor are sent to all;
    more of them go in blocks, each block meeting the documents in its turn, so no row ever holds them all.
    """
    q = queries.select(F.struct("query_id", F.col("embedding").alias("v")).alias("q"), (F.pmod(F.xxhash64("query_id"), F.lit(_blocks(queries)))).alias("b"))
    blocks = q.groupBy("b").agg(F.collect_list("q").alias("qs"))  # QUERY_BLOCK queries each, on average
    met = docs.select("doc_id", F.col("embedding").alias("d")).join(F.broadcast(blocks) if _blocks(queries) == 1 else blocks)
    met = met.select("doc_id", "d", F.explode("qs").alias("q"))
    return met.select("q.query_id", "doc_id", F.round(dot(F.col("q.v"), F.col("d")), digits).alias("score"))


def _blocks(queries: DataFrame) -> int:
    return max(1, -(-queries.count() // QUERY_BLOCK))


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best of each query with their rank from 1; equal scores by id."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Exact search by inner product; vectors of another length than the query's are an error."""
    if k < 0:
        raise ValueError("k must not be negative")
    if not 0 < k <= pairs.QUERY_BLOCK:  # a task has k pairs of each query of a block
        return top_k(scores(queries, docs), k)
    return top_k(pairs.nearest(queries, docs, k), k)


def _mmr(scores_: np.ndarray, vectors: np.ndarray, k: int, weight: float) -> list[int]:
    sims = np.round(vectors @ vectors.T, 6)
    chosen: list[int] = []
    for _ in range(min(k, len(scores_))):
        most = sims[:, chosen].max(1) if chosen else np.zeros(len(scores_))
        value = np.round(weight * scores_ - (1 - weight) * most, 9)
        value[chosen] = -np.inf
        chosen.append(int(value.argmax()))
    return chosen


def mmr(candidates: DataFrame, k: int, weight: float = BUILD.mmr_lambda) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: k of each query's candidates (query_id, doc_id, score, embedding), each the best mix of relevance and
    distance to those chosen before; of equals the one with the higher score, then the smaller id."""
    if not 0 <= weight <= 1:
        raise ValueError("the weight must lie in 0 to 1")
    kind = {f.name: f.dataType.simpleString() for f in candidates.schema}

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        at = _mmr(pdf["score"].to_numpy(float), np.array(pdf["embedding"].tolist(), float), k, weight)
        out = pdf.loc[at, ["query_id", "doc_id", "score"]]
        return out.assign(rank=np.arange(1, len(at) + 1))

    return candidates.groupBy("query_id").applyInPandas(
        go, f"query_id {kind['query_id']}, doc_id {kind['doc_id']}, score double, rank int"
    )


def retrieve(queries: DataFrame, docs: DataFrame, k: int = BUILD.final_k, weight: float = BUILD.mmr_lambda, candidates: int | None = None) -> DataFrame:
    """MMR over the top candidates: five times k of them, and 50 at least."""
    if k <= 0:
        raise ValueError("k must be positive")
    best = search(queries, docs, candidates or max(5 * k, 50))
    return mmr(best.join(docs.select("doc_id", "embedding"), "doc_id"), k, weight)


def negatives(docs: DataFrame, exclude: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """n documents that are not excluded, at random by a keyed hash."""
    rest = docs.join(exclude.select("doc_id"), "doc_id", "left_anti")
    return rest.orderBy(T.keyed(seed, F.col("doc_id"), "negative"), "doc_id").limit(n)


def hard_negatives(
    queries: DataFrame, docs: DataFrame, n: int, exclude: DataFrame | None = None, candidates: int = 50, skip: int = 5, seed: int = SEED
) -> DataFrame:
    """For each query n at random of its nearest ``candidates``, without the ``skip`` nearest and the excluded."""
    near = search(queries, docs, candidates).where(F.col("rank") > skip)
    if exclude is not None:
        near = near.join(exclude.select("doc_id"), "doc_id", "left_anti")
    pick = F.row_number().over(Window.partitionBy("query_id").orderBy(T.keyed(seed, F.col("query_id"), F.col("doc_id"), "hard"), "doc_id"))
    return near.withColumn("pick", pick).where(F.col("pick") <= n)


def training_contexts(
    queries: DataFrame, docs: DataFrame, final_k: int = BUILD.final_k, noise_k: int = BUILD.noise_k, hard: bool = False, seed: int = SEED
) -> DataFrame:
    """``(query_id, doc_id, relevant, pos)``: each query's MMR choice and negatives, shuffled by key.  Hard negatives come from the ranks right behind."""
    good = retrieve(queries, docs, final_k).select("query_id", "doc_id", F.lit(1).alias("relevant"))
    if hard:
        near = search(queries, docs, 50).where(F.col("rank") > final_k)
    else:
        near = scores(queries, docs)
    bad = near.select("query_id", "doc_id").join(good, ["query_id", "doc_id"], "left_anti")
    pick = F.row_number().over(Window.partitionBy("query_id").orderBy(T.keyed(seed, F.col("query_id"), F.col("doc_id"), "context"), "doc_id"))
    bad = bad.withColumn("_pick", pick).where(F.col("_pick") <= noise_k).select("query_id", "doc_id", F.lit(0).alias("relevant"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(T.keyed(seed, F.col("query_id"), F.col("doc_id"), "shuffle"), "doc_id"))
    return good.unionByName(bad).withColumn("pos", order)
