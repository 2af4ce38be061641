"""Every query against every document without a row for each pair.

Queries go to all tasks in blocks; a task meets its documents with a block by matrix products and keeps what is asked for: the best of each
query, counts of its scores by ranges, or the pairs between two scores.  A count of a range in each task, summed and made finer round by
round, gives any order statistic of a query exactly, so no task holds all scores of a query and none is shuffled or kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from .places import kept

#: Queries that are sent to every task together; of these and of a task's documents so many meet in one matrix.
QUERY_BLOCK, ROWS, COLUMNS = 1024, 128, 4096
#: Ranges that one round splits a range into; pairs in all ranges of a query, on average, that end the rounds.
BINS, FEW = 2048, 64
#: Counts that a task has at most before it sums them up.
HELD = 4_000_000


# scores


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of that length as rows, and which rows are such; the others (missing, of another length, with a missing number) are zeros."""
    good = pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), size))
    flat = pc.list_flatten(column.filter(pa.array(good)))
    if len(flat):
        values = flat.cast("float64").to_numpy(zero_copy_only=False).reshape(-1, size)
        out[good] = values
        if flat.null_count:
            lost = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, size).any(1)
            good[np.flatnonzero(good)[lost]] = False
            out[~good] = 0
    return out, good


def _sums(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Inner products of rows, added in the order of the vector, as ``vectors.dot`` adds them."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * d[:, j]
    return out


def _half_up(v: float, digits: int) -> float:
    return float(Decimal(repr(v)).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))


def _units(v: np.ndarray, digits: int) -> np.ndarray:
    """v in whole units of the last digit, halves away from zero as Spark's round() has them."""
    t = v * 10.0**digits
    out = np.rint(t)
    for i in np.flatnonzero(np.abs(t - out) > 0.5 - 1e-6 - 1e-15 * np.abs(t)):
        out[i] = _half_up(float(v[i]), digits)
    return out


def _error(q: np.ndarray, d: np.ndarray) -> float:
    """How far a matrix product may lie from the sum in order."""
    longest = [float(np.sqrt(np.nan_to_num((x * x).sum(1), posinf=0.0).max(initial=0.0))) for x in (q, d)]
    return 4e-16 * q.shape[1] * longest[0] * longest[1]


def _all_units(q: np.ndarray, d: np.ndarray, digits: int) -> np.ndarray:
    """Of each q and d the score in whole units; a matrix product decides where it lies far enough from a half."""
    s = q @ d.T
    t = s * 10.0**digits
    out = np.rint(t)
    t -= out
    np.abs(t, out=t)
    near = t > 0.5 - 1e-6 - _error(q, d) * 10.0**digits
    if near.any():
        i, j = np.nonzero(near)
        out[i, j] = _units(_sums(q[i], d[j]), digits)
    return out


class Block:
    """Queries of one length of vector (0: without a usable one), as a task gets them."""

    def __init__(self, ids: pa.Array, first: int, vectors: np.ndarray, usable: bool, source: pa.Array | None, barred: list | None):
        self.ids, self.first, self.vectors, self.usable = ids, first, vectors, usable
        self.source, self.barred = source, barred


def _blocks(queries: DataFrame, source: str | None = None, barred: str | None = None) -> list[Block]:
    """The queries (query_id, embedding) in blocks, numbered from 0 on; ``source`` names what a document must not have, ``barred`` a list of
    ids of documents."""
    table = queries.select("query_id", "embedding", *[c for c in (source, barred) if c]).toArrow().combine_chunks()
    column = lambda name: table[name].combine_chunks() if isinstance(table[name], pa.ChunkedArray) else table[name]
    ids, v = column("query_id"), column("embedding")
    size = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
    out, first = [], 0
    usable = np.zeros(len(v), bool)
    parts: list[tuple[np.ndarray, np.ndarray, bool]] = []
    for n in np.unique(size[size >= 0]):
        x, good = _vectors(v, int(n))
        usable |= good
        at = np.flatnonzero(good)
        parts += [(at[k : k + QUERY_BLOCK], x[at[k : k + QUERY_BLOCK]], True) for k in range(0, len(at), QUERY_BLOCK)]
    at = np.flatnonzero(~usable)
    parts += [(at[k : k + QUERY_BLOCK], np.zeros((len(at[k : k + QUERY_BLOCK]), 0)), False) for k in range(0, len(at), QUERY_BLOCK)]
    for at, x, good in parts:
        take = lambda c: c.take(pa.array(at))  # noqa: B023, E731
        out.append(Block(take(ids), first, x, good, take(column(source)) if source else None, take(column(barred)).to_pylist() if barred else None))
        first += len(at)
    return out


def _each_block(queries: list[Block], docs: DataFrame, go: Callable[[Block, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    sc = docs.sparkSession.sparkContext

    def of(b: Block) -> DataFrame:
        sent = sc.broadcast(b)
        return docs.mapInArrow(lambda batches: go(sent.value, batches), schema)

    if not queries:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, map(of, queries))


def _tasks(docs: DataFrame) -> int:
    return max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // 65_536))


# the best of each query


class _Best:
    """The k best pairs of each query of a block so far; of equal scores the documents that came first."""

    def __init__(self, n: int, k: int):
        self.k, self.key, self.at = k, np.full((n, k), -np.inf), np.full((n, k), -1)

    def add(self, rows: np.ndarray, keys: np.ndarray, at: np.ndarray) -> None:
        if not len(rows):
            return
        touched = np.unique(rows)
        old = self.at[touched] >= 0
        r = np.concatenate([np.repeat(touched, old.sum(1)), rows])
        key = np.concatenate([self.key[touched][old], keys])
        a = np.concatenate([self.at[touched][old], at])
        order = np.lexsort((a, -key, r))
        r, key, a = r[order], key[order], a[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        some = rank < self.k
        self.key[touched], self.at[touched] = -np.inf, -1
        self.key[r[some], rank[some]], self.at[r[some], rank[some]] = key[some], a[some]


_LARGE = np.finfo(float).max


def nearest(queries: DataFrame, docs: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """``(query_id, doc_id, score)``: the k best of each query in each task; the best of all are among them.

    As in an ORDER BY score DESC, doc_id: NaN is the greatest score, a missing one (no vector, another length) the least.
    """
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("doc_id", docs.schema["doc_id"].dataType), StructField("score", DoubleType())])
    names = to_arrow_schema(schema)
    rows = docs.select("doc_id", "embedding").repartition(_tasks(docs), "doc_id").sortWithinPartitions("doc_id")
    unit = 10.0**-digits

    def go(b: Block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ids, seen = _Best(len(b.ids), k), [], 0
        for batch in batches:
            ids.append(batch.column(0))
            x, good = _vectors(batch.column(1), b.vectors.shape[1]) if b.usable else (None, np.zeros(len(batch), bool))
            for c in range(0, len(batch), COLUMNS):
                ok = np.flatnonzero(good[c : c + COLUMNS])
                d = x[c + ok] if len(ok) else np.zeros((0, 0))
                odd = seen + c + np.flatnonzero(~good[c : c + COLUMNS])
                for q in range(0, len(b.ids), ROWS):
                    own = slice(q, min(q + ROWS, len(b.ids)))
                    if len(ok):
                        _meet(best, b.vectors[own], d, q, seen + c + ok, digits, unit)
                    if len(odd):
                        open_ = q + np.flatnonzero(best.at[own, -1] < 0)
                        few = odd[:k]  # of missing scores only the first k can count
                        best.add(np.repeat(open_, len(few)), np.full(len(open_) * len(few), -np.inf), np.tile(few, len(open_)))
            seen += len(batch)
        if not ids:
            return
        all_ids = pa.concat_arrays(ids)
        for q in range(0, len(b.ids), ROWS):
            r, c = np.nonzero(best.at[q : q + ROWS] >= 0)
            key = best.key[q + r, c]
            score = np.where(np.isposinf(key), np.nan, np.where(np.abs(key) == _LARGE, np.sign(key) * np.inf, key))
            yield pa.RecordBatch.from_arrays(
                [b.ids.take(pa.array(q + r)).cast(names.field(0).type), all_ids.take(pa.array(best.at[q + r, c])).cast(names.field(1).type), pa.array(score, mask=np.isneginf(key))], schema=names
            )

    return _each_block(_blocks(queries), rows, go, schema)


def _meet(best: _Best, q: np.ndarray, d: np.ndarray, first: int, at: np.ndarray, digits: int, unit: float) -> None:
    s = q @ d.T
    least = best.key[first : first + len(q), -1].copy()
    full = best.at[first : first + len(q), -1] >= 0
    margin = 0.4 * unit - _error(q, d)
    if not full.all():
        # the k-th of this part is among the best till now, and all above it, equals after rounding too
        if s.shape[1] > best.k:
            with np.errstate(invalid="ignore"):
                kth = np.partition(np.where(np.isnan(s), np.inf, s), s.shape[1] - best.k, axis=1)[:, s.shape[1] - best.k]
            least = np.where(full, least, kth - 2 * unit)
        else:
            least = np.where(full, least, -np.inf)
    bound = np.where(full, least + margin, least - _error(q, d))
    i, j = np.nonzero(~(s < bound[:, None]))  # NaN too
    v = _sums(q[i], d[j])
    finite = np.isfinite(v)
    key = np.where(np.isnan(v), np.inf, np.where(finite, 0.0, np.sign(v) * _LARGE))
    key[finite] = _units(v[finite], digits) / 10.0**digits
    best.add(first + i, key, at[j])


# order statistics of each query's scores


class _Units:
    """How a task of ``Ordered`` gets at the units of its pairs."""

    def __init__(self, digits: int, own: bool, begin: dict[int, int], reach: int, doc_type: pa.DataType):
        self.digits, self.own, self.begin, self.reach, self.doc_type = digits, own, begin, reach, doc_type

    def parts(self, b: Block, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.RecordBatch, int]]:
        """First query, units (queries x documents; NaN where the pair is left out), places, batch and the first document's row in it."""
        missing = -(10.0**self.digits)
        place_of = {v: k for k, v in enumerate(b.source.unique().to_pylist()) if v is not None} if self.own else {}
        own = np.array([place_of.get(v, -1) for v in b.source.to_pylist()]) if self.own else None
        named: dict = {}
        for i, ids in enumerate(b.barred or []):
            for x in ids or []:
                named.setdefault(x, []).append(i)
        wanted = pa.array(list(named), self.doc_type) if named else None
        for batch in batches:
            names = batch.schema.names
            at = batch.column(names.index("_at")).to_numpy()
            places = np.array([self.begin[p] for p in (at >> 33).tolist()], np.int64) + (at & ((1 << 33) - 1))
            x, good = _vectors(batch.column(1), b.vectors.shape[1]) if b.usable else (np.zeros((len(batch), 0)), np.zeros(len(batch), bool))
            source = None
            if self.own:
                told = pc.dictionary_encode(batch.column(2))
                code = np.array([place_of.get(v, -2) for v in told.dictionary.to_pylist()] + [-2])
                source = code[pc.fill_null(told.indices, len(code) - 1).to_numpy(zero_copy_only=False)]
            barred = []
            if wanted is not None:
                barred = [(i, int(j)) for j in np.flatnonzero(pc.is_in(batch.column(0), value_set=wanted).to_numpy(zero_copy_only=False)) for i in named[batch.column(0)[int(j)].as_py()]]
            for c in range(0, len(batch), COLUMNS):
                d, ok = x[c : c + COLUMNS], good[c : c + COLUMNS]
                for q in range(0, len(b.ids), ROWS):
                    v = b.vectors[q : q + ROWS]
                    if b.usable:
                        with np.errstate(invalid="ignore", over="ignore"):
                            u = _all_units(v, d, self.digits)
                        if not ok.all():
                            u[:, ~ok] = missing
                        if np.isnan(u.sum()) or np.isinf(u).any():
                            u[np.isnan(u)] = missing
                            np.clip(u, -self.reach, self.reach, out=u)
                    else:
                        u = np.full((len(v), len(d)), missing)
                    if self.own:
                        u[own[q : q + ROWS, None] == source[None, c : c + COLUMNS]] = np.nan
                    for i, j in barred:
                        if q <= i < q + ROWS and c <= j < c + COLUMNS:
                            u[i - q, j - c] = np.nan
                    yield q, u, places[c : c + COLUMNS], batch, c


class Ordered:
    """Documents (doc_id, embedding, and a source) with their place in the order of their ids, kept, and the queries in blocks.

    A missing score counts as -1, NaN too.  A pair's key is its score in units, from the least on, with ``placed`` keys then the document's place, so that no two keys of
    a query are the same.
    """

    def __init__(self, queries: DataFrame, docs: DataFrame, digits: int = 6, own: str | None = None, barred: str | None = None):
        self.digits = digits
        self.own = own
        self.blocks = _blocks(queries, own, barred)
        self.queries = sum(len(b.ids) for b in self.blocks)
        self.query_type, self.doc_type = queries.schema["query_id"].dataType, docs.schema["doc_id"].dataType
        rows = docs.select("doc_id", "embedding", *(["source_doc_id"] if own else []))
        rows = rows.repartitionByRange(_tasks(docs), "doc_id").sortWithinPartitions("doc_id").withColumn("_at", F.monotonically_increasing_id())
        rows = kept(rows)
        sizes = {r.p: (r.n, r.m) for r in rows.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n"), F.max(_square("embedding")).alias("m")).collect()}
        begin, n = {}, 0
        for p in sorted(sizes):  # a row a task
            begin[p], n = n, n + sizes[p][0]
        self.n = n
        self.docs, self.begin = rows, begin
        longest = max([float(np.sqrt((b.vectors**2).sum(1)[np.isfinite((b.vectors**2).sum(1))].max(initial=0.0))) for b in self.blocks if b.usable], default=0.0)
        most = max([m for _, m in sizes.values() if m is not None and np.isfinite(m)], default=0.0)
        #: Units lie within this, but for infinite scores, which count as one more.
        self.reach = int(np.ceil(max(1.0, longest * float(np.sqrt(most))) * 10.0**digits * (1 + 1e-9))) + 2
        if self.width(True) >= 1 << 52:
            raise ValueError("the vectors are too long for scores of so many digits")
        self.how = _Units(digits, own is not None, begin, self.reach, to_arrow_schema(StructType([StructField("x", self.doc_type)])).field(0).type)

    def width(self, placed: bool) -> int:
        """Number of keys."""
        return (2 * self.reach + 1) * (max(self.n, 1) if placed else 1)

    def unit(self, key: np.ndarray, placed: bool) -> np.ndarray:
        return key // (max(self.n, 1) if placed else 1) - self.reach

    def _count(self, first: bool, ranges: dict[int, np.ndarray], width: int, placed: bool) -> DataFrame:
        """``(query, bins, counts)`` of each task: how many keys of the query lie in each part of its ranges (all keys, if it is the first round)."""
        schema = StructType([StructField("query", LongType()), StructField("bins", BinaryType()), StructField("counts", BinaryType())])
        names = to_arrow_schema(schema)
        part = -(-width // BINS)
        n, reach, how = max(self.n, 1) if placed else 1, self.reach, self.how
        sent = self.docs.sparkSession.sparkContext.broadcast(ranges)

        def go(b: Block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = {} if first else sent.value
            codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            fresh: list[np.ndarray] = []
            held = 0
            table = np.zeros((len(b.ids), BINS), np.int64) if first else None

            def summed() -> None:
                nonlocal codes, counts, held
                if fresh:
                    new, m = np.unique(np.concatenate(fresh), return_counts=True)
                    codes, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
                    counts = np.bincount(at, np.concatenate([counts, m]).astype(float), len(codes)).astype(np.int64)
                    fresh.clear()
                    held = 0

            for q, u, places, _, _ in how.parts(b, batches):
                if first:
                    u += reach
                    if n > 1:
                        u *= n
                        u += places
                    u += 0.5  # so that a quotient lies well within its part
                    u /= part
                    u[np.isnan(u)] = -1.0
                    bins = u.astype(np.int64)
                    bins += (np.arange(len(u)) * (BINS + 1) + 1)[:, None]
                    table[q : q + len(u)] += np.bincount(bins.ravel(), minlength=len(u) * (BINS + 1)).reshape(-1, BINS + 1)[:, 1:]
                    continue
                begins = [mine.get(b.first + q + k, ()) for k in range(len(u))]
                for r in range(max(map(len, begins), default=0)):
                    begin = np.array([x[r] if r < len(x) else -1 for x in begins], np.int64)
                    has = begin >= 0
                    low = np.where(has, begin // n - reach, np.inf)
                    high = np.where(has, (begin + width - 1) // n - reach, -np.inf)
                    i, j = np.nonzero((u >= low[:, None]) & (u <= high[:, None]))
                    key = (u[i, j] + reach).astype(np.int64) * n + (places[j] if placed else 0) - begin[i]
                    some = (key >= 0) & (key < width)
                    fresh.append(((q + i[some]).astype(np.int64) * 64 + r) * BINS + key[some] // part)
                    held += len(fresh[-1])
                if held > HELD:
                    summed()
            if first:
                r, c = np.nonzero(table)
                codes, counts = r * BINS + c, table[r, c]
                span = BINS
            else:
                summed()
                span = 64 * BINS
            owner = codes // span
            ends = np.searchsorted(owner, np.arange(len(b.ids) + 1))
            rows = [(b.first + k, (codes[x:y] - k * span).astype(np.int32).tobytes(), counts[x:y].tobytes()) for k, (x, y) in enumerate(zip(ends, ends[1:])) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([row[c] for row in rows], names.field(c).type) for c in range(3)], schema=names)

        return _each_block(self.blocks, self.docs, go, schema)

    def _pairs(self, ranges: dict[int, np.ndarray], width: int, placed: bool) -> DataFrame:
        """``(query, keys)`` of each task: the keys within the ranges."""
        schema = StructType([StructField("query", LongType()), StructField("bins", BinaryType()), StructField("counts", BinaryType())])
        names = to_arrow_schema(schema)
        n, reach, how = max(self.n, 1) if placed else 1, self.reach, self.how
        sent = self.docs.sparkSession.sparkContext.broadcast(ranges)

        def go(b: Block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for q, u, places, _, _ in how.parts(b, batches):
                begins = [sent.value.get(b.first + q + k, ()) for k in range(len(u))]
                who, keys = [], []
                for r in range(max(map(len, begins), default=0)):
                    begin = np.array([x[r] if r < len(x) else -1 for x in begins], np.int64)
                    low = np.where(begin >= 0, begin // n - reach, np.inf)
                    high = np.where(begin >= 0, (begin + width - 1) // n - reach, -np.inf)
                    i, j = np.nonzero((u >= low[:, None]) & (u <= high[:, None]))
                    key = (u[i, j] + reach).astype(np.int64) * n + (places[j] if placed else 0)
                    some = (key >= begin[i]) & (key < begin[i] + width)
                    who.append(i[some]), keys.append(key[some])
                if who and sum(map(len, who)):
                    w, k = np.concatenate(who), np.concatenate(keys)
                    order = np.argsort(w, kind="stable")
                    w, k = w[order], k[order]
                    at = np.unique(w)
                    x, y = np.searchsorted(w, at), np.searchsorted(w, at, "right")
                    yield pa.RecordBatch.from_arrays([pa.array(b.first + q + at, pa.int64()), pa.array([k[s:e].tobytes() for s, e in zip(x, y)], pa.binary()), pa.array([b""] * len(at), pa.binary())], schema=names)

        return _each_block(self.blocks, self.docs, go, schema)

    def select(self, ranks: Callable[[int, int], list[int]], placed: bool) -> tuple[dict[int, list[tuple[int, int, int, int]]], dict[int, int]]:
        """By query its ``(rank, key, keys below, keys equal)`` of the ranks from 0 that ``ranks(query, number of its pairs)`` names, and that number.

        Each round counts the keys of a query by at most 2048 parts of each range that a rank lies in.
        """
        state: dict[int, list[list[int]]] = {}
        total: dict[int, int] = {}
        width, first = self.width(placed), True
        while True:
            part = -(-width // BINS)
            ranges = {} if first else {i: np.unique([t[1] for t in targets]) for i, targets in state.items()}
            if any(len(r) > 64 for r in ranges.values()):
                raise ValueError("too many ranks of a query")
            few = not first and sum(_inside(t) for t in state.values()) <= FEW * max(len(state), 1)
            if few and width > 1:
                rows = _grouped(self._pairs(ranges, width, placed), _sorted_keys(state))
            else:
                rows = _grouped(self._count(first, ranges, width, placed), _narrowed(None if first else state, ranks, part))
            told: dict[int, list[list[int]]] = {}
            for r in rows.toArrow().to_pylist():
                told[r["query"]] = np.frombuffer(r["bins"], np.int64).reshape(-1, 4).tolist()
                if first:
                    total[r["query"]] = int(np.frombuffer(r["counts"], np.int64)[0])
            state = told
            if few and width > 1 or part == 1:
                return {i: [tuple(t) for t in targets] for i, targets in state.items()}, total
            width, first = part, False

    def between(self, low: np.ndarray, high: np.ndarray) -> DataFrame:
        """``(query_id, doc_id, score)`` of the pairs whose units lie from ``low`` to ``high`` of their query (by number)."""
        schema = StructType([StructField("query_id", self.query_type), StructField("doc_id", self.doc_type), StructField("score", DoubleType())])
        names = to_arrow_schema(schema)
        sent, how = self.docs.sparkSession.sparkContext.broadcast((np.asarray(low, float), np.asarray(high, float))), self.how

        def go(b: Block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, z = sent.value
            for q, u, _, batch, c in how.parts(b, batches):
                own = slice(b.first + q, b.first + q + len(u))
                i, j = np.nonzero((u >= a[own, None]) & (u <= z[own, None]))
                v = u[i, j]
                score = v / 10.0**how.digits
                far = np.abs(v) >= how.reach
                if far.any():
                    score[far] = np.sign(v[far]) * np.inf
                yield pa.RecordBatch.from_arrays([b.ids.take(pa.array(q + i)).cast(names.field(0).type), batch.column(0).take(pa.array(c + j)).cast(names.field(1).type), pa.array(score)], schema=names)

        return _each_block(self.blocks, self.docs, go, schema)

    def placed(self) -> DataFrame:
        """The documents with their ``place``."""
        begin = F.create_map(*[F.lit(x).cast("long") for p in self.begin.items() for x in p]) if self.begin else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
        return self.docs.withColumn("place", F.element_at(begin, F.shiftright("_at", 33).cast("long")) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))


def _square(c: str):
    return F.aggregate(F.filter(c, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def _inside(targets: list[list[int]]) -> int:
    """Pairs in the different ranges."""
    return sum({t[1]: t[3] for t in targets}.values())


_TOLD = StructType([StructField("query", LongType()), StructField("bins", BinaryType()), StructField("counts", BinaryType())])


def _grouped(parts: DataFrame, finish: Callable[[int, list[tuple[bytes, bytes]]], tuple[bytes, bytes]]) -> DataFrame:
    """``finish`` of each query's rows, which all tasks sent; one query at a time is in memory."""
    names = to_arrow_schema(_TOLD)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []

        def made() -> pa.RecordBatch:
            a, z = finish(last, rows)
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([a], pa.binary()), pa.array([z], pa.binary())], schema=names)

        for batch in batches:
            for i, a, z in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if i != last and rows:
                    yield made()
                    rows = []
                last = i
                rows.append((a, z))
        if rows:
            yield made()

    return parts.repartition(2 * parts.sparkSession.sparkContext.defaultParallelism, "query").sortWithinPartitions("query").mapInArrow(go, _TOLD)


def _narrowed(state: dict[int, list[list[int]]] | None, ranks: Callable[[int, int], list[int]], part: int):
    """To the part of its range that each rank lies in: rows (rank, first key, keys below, keys in it)."""

    def finish(i: int, rows: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
        codes = np.concatenate([np.frombuffer(a, np.int32) for a, _ in rows]).astype(np.int64)
        counts = np.concatenate([np.frombuffer(z, np.int64) for _, z in rows])
        codes, at = np.unique(codes, return_inverse=True)
        counts = np.bincount(at, counts.astype(float)).astype(np.int64)
        total = int(counts.sum())
        if state is None:
            targets = [[r, 0, 0, total] for r in ranks(i, total)]
        else:
            targets = state[i]
        begins = np.unique([t[1] for t in targets]).tolist()
        out = []
        for rank, begin, below, _ in targets:
            k = begins.index(begin) if state is not None else 0
            own = slice(*np.searchsorted(codes, (k * BINS, (k + 1) * BINS)))
            up = np.cumsum(counts[own])
            x = int(np.searchsorted(up, rank - below, "right"))
            out.append([rank, begin + int(codes[own][x] - k * BINS) * part, below + int(up[x] - counts[own][x]), int(counts[own][x])])
        return np.array(out, np.int64).tobytes(), np.array([total], np.int64).tobytes()

    return finish


def _sorted_keys(state: dict[int, list[list[int]]]):
    def finish(i: int, rows: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
        keys = np.sort(np.concatenate([np.frombuffer(a, np.int64) for a, _ in rows]))
        out = []
        for rank, begin, below, _ in state[i]:
            x = int(np.searchsorted(keys, begin)) + rank - below
            key = int(keys[x])
            low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            out.append([rank, key, rank - (x - int(low)), int(high - low)])
        return np.array(out, np.int64).tobytes(), b""

    return finish


def shares(size: int, wanted: tuple[float, ...]) -> list[tuple[int, int, float]]:
    """Of each share the two places round it among ``size`` ordered values, and how far it lies from the first to the second."""
    out = []
    for s in wanted:
        at = s * (size - 1)
        low = int(np.floor(at))
        out.append((low, min(low + 1, size - 1), at - low))
    return out


def bounds(pairs: Ordered, bands: tuple[tuple[float | None, float], ...], digits: int = 9) -> dict[int, tuple[int, int, int, int]]:
    """By query ``(lowest unit, highest unit, pairs below, pairs within)`` of the first of the bands (from one share of its scores to another) that has pairs, else the last."""
    ends = tuple(s for b in bands for s in b if s is not None)

    def ranks(_: int, size: int) -> list[int]:
        return [p for a, z, _ in shares(size, ends) for p in (a, z)]

    found, sizes = pairs.select(ranks, False)
    out = {}
    for i, told in found.items():
        size = sizes[i]
        at = {}
        for k, (s, (_, _, part)) in enumerate(zip(ends, shares(size, ends))):
            (_, ka, below_a, same_a), (_, kz, below_z, same_z) = told[2 * k], told[2 * k + 1]
            a, z = (int(pairs.unit(x, False)) for x in (ka, kz))
            va, vz = a / 10.0**pairs.digits, z / 10.0**pairs.digits
            v = float(Decimal(repr(va + (vz - va) * part)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
            at[s] = ((a, below_a) if v <= va else (z, below_z), (z, below_z + same_z) if v >= vz else (a, below_a + same_a))
        for low, high in bands:
            first = at[low][0] if low is not None else (-pairs.reach, 0)
            last = at[high][1]
            if last[1] > first[1]:
                break
        out[i] = (first[0], last[0], first[1], max(last[1] - first[1], 0))
    return out
