"""Near-dedup with SimHash and navigable small worlds.

1. Every text gives its set of five-word shingles, of those a SimHash of 128 bits and ``KEYS`` minima; texts with
   equal sets are one node from here on.
2. Nodes go to the shards of their minima, so that near copies meet in at least one of them all but
   surely (0.2 ** KEYS for a similarity of 0.8).  A minimum that very many nodes share is cut in
   blocks that are compared two by two, so no shard grows with the corpus and no pair is left out.
3. In a shard every node searches: a small group by comparing all, a large one through a navigable small-world graph over the
   Hamming distance, whose beams are widened till a sample of the queries finds what exact search finds.
4. The nearest of what was found is verified by the Jaccard similarity of the whole sets; verified edges are unioned.
5. A second, exact pass over the shards, for blocks over each two of them, gives the pairs that lie in different components so far; they are verified and
   unioned too.  So a group of thousands of copies costs a few edges each, and no link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, documents, maybe_among
from .shingles import batches, mix, release, shingle_sets

#: Minima of a node, each a shard that it goes to.
KEYS = 8
#: Bits of the SimHash in which candidates may differ: a similarity of 0.8 gives 19 of 128 on average, with deviation 4.
BITS = 34
SIMILARITY = 0.8
#: Edges that a node proposes in the first pass; the second is exact for what they leave open.
NEAREST = 4
#: Nodes of a key, about, at most; beyond them its blocks are compared two by two.
GROUP = 2048
#: Groups up to this size are searched by comparing all.
EXACT = 128
#: Least share of the exact neighbours that the audited queries of a graph must find.
RECALL = 0.99

FEATURES = "doc_id {id}, d1 long, d2 long, hi long, lo long, keys array<long>"
SETS = "d1 long, d2 long, shingles array<int>"
_LANES = np.uint64(0x0101010101010101)


def simhash(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64 bits for each text: bit b is set if it is in more than half of the shingles.

    Eight counters share a word, so runs of at most 255 shingles are added at once.
    """
    many = np.diff(start)
    pieces = -(-many // 255)
    first = np.repeat(start[:-1], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    out = np.zeros(len(many), np.uint64)
    if not len(first):
        return out
    full = np.flatnonzero(many)
    seg = (np.cumsum(pieces) - pieces)[full]
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, first)
        each = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), seg, axis=0)
        ones = each * 2 > many[full, None]
        for j in range(8):
            out[full] |= ones[:, j].astype(np.uint64) << np.uint64(8 * j + k)
    return out


def _digest(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """128 bits of each set of shingles, 0 for an empty one."""
    out = np.zeros((len(start) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(start))
    for r in range(2):
        if len(full):
            out[full, r] = np.add.reduceat(mix(h + np.uint64(0xDA942042E4DD58B5 * (r + 1) % 2**64)), start[full])
    return out.view(np.int64)


def features(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest, SimHash and minima of every text."""
    for pdf in batch:
        for first, texts in batches(list(pdf["text"])):
            h, start = shingle_sets(texts)
            full = np.flatnonzero(np.diff(start))
            keys = np.zeros((len(texts), KEYS), np.uint64)
            if len(full):
                for r in range(KEYS):
                    keys[full, r] = np.minimum.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D * (r + 1) % 2**64)), start[full])
            digest = _digest(h, start)
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].iloc[first : first + len(texts)].to_numpy(),
                    "d1": digest[:, 0],
                    "d2": digest[:, 1],
                    "hi": simhash(h, start).view(np.int64),
                    "lo": simhash(mix(h + np.uint64(0xE7037ED1A0B428DB)), start).view(np.int64),
                    "keys": list(keys.view(np.int64)),
                }
            )
    release()


def shingled(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest and set of shingles, as their upper 32 bits, of every text."""
    for pdf in batch:
        for _, texts in batches(list(pdf["text"])):
            h, start = shingle_sets(texts)
            digest, small = _digest(h, start), (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
            sets = [small[a:b] for a, b in zip(start[:-1], start[1:])]
            yield pd.DataFrame({"d1": digest[:, 0], "d2": digest[:, 1], "shingles": sets})
    release()


class SmallWorld:
    """A navigable small-world graph over codes of 128 bits, built in growing batches."""

    def __init__(self, codes: np.ndarray, degree: int = 12, seed: int = 0):
        self.codes, self.degree = codes, degree
        n = len(codes)
        self.order = np.random.default_rng(seed).permutation(n)
        self.links = np.full((n, 2 * degree), -1, np.int64)
        done = min(n, 2 * degree)
        head = self.order[:done]
        for i in head:
            near = head[head != i][: 2 * degree]
            self.links[i, : len(near)] = near
        while done < n:
            new = self.order[done : done + min(done, 512)]
            found, far = self.search(new, 2 * degree)
            near = found[:, :degree]
            self.links[new, :degree] = near
            self._back(np.repeat(new, degree), near.ravel(), far[:, :degree].ravel())
            done += len(new)

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.codes[a] ^ self.codes[b]).sum(-1, dtype=np.int64)

    def _back(self, source: np.ndarray, target: np.ndarray, far: np.ndarray) -> None:
        """Links from the targets back, in the second half of their slots; the nearest stay."""
        ok = target >= 0
        source, target, far = source[ok], target[ok], far[ok]
        hit = np.unique(target)
        old = self.links[hit, self.degree :]
        t0, s0 = np.repeat(hit, self.degree), old.ravel()
        ok = s0 >= 0
        t0, s0 = t0[ok], s0[ok]
        t, s = np.concatenate((t0, target)), np.concatenate((s0, source))
        d = np.concatenate((self.distance(t0, s0), far))
        o = np.lexsort((d, t))
        t, s = t[o], s[o]
        rank = np.arange(len(t)) - np.searchsorted(t, t)
        keep = rank < self.degree
        self.links[t[keep], self.degree + rank[keep]] = s[keep]

    def search(self, query: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest ``beam`` nodes that each query node reaches, itself left out, and their distances; -1 fills up."""
        n = len(query)
        entry = self.order[: min(beam, 2 * self.degree)]
        ids = np.full((n, beam), -1, np.int64)
        far = np.full((n, beam), 1 << 20, np.int64)
        ids[:, : len(entry)] = entry
        far[:, : len(entry)] = self.distance(query[:, None], entry[None, :])
        seen = ids < 0
        live = np.arange(n)
        while len(live):
            open_ = np.where(seen[live], 1 << 20, far[live])
            pick = open_.argmin(1)
            go = open_[np.arange(len(live)), pick] < (1 << 20)
            live, pick = live[go], pick[go]
            if not len(live):
                break
            seen[live, pick] = True
            next_ = self.links[ids[live, pick]]
            new = (next_ >= 0) & ~(next_[:, :, None] == ids[live][:, None, :]).any(2)
            d = np.where(new, self.distance(query[live][:, None], next_), 1 << 20)
            i = np.concatenate((ids[live], np.where(new, next_, -1)), 1)
            f = np.concatenate((far[live], d), 1)
            s = np.concatenate((seen[live], ~new), 1)
            o = np.argsort(f, axis=1, kind="stable")[:, :beam]
            ids[live], far[live], seen[live] = (np.take_along_axis(x, o, 1) for x in (i, f, s))
        self_ = ids == query[:, None]
        far[self_], ids[self_] = 1 << 20, -1
        o = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(ids, o, 1), np.take_along_axis(far, o, 1)


def exact_neighbours(codes: np.ndarray, query: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (query, other) within ``bits``, and their distance; in blocks of queries."""
    out = []
    for k in range(0, len(query), 256):
        q = query[k : k + 256]
        d = np.bitwise_count(codes[q][:, None, :] ^ codes[None, :, :]).sum(-1, dtype=np.int16)
        d[np.arange(len(q)), q] = 999
        i, j = np.nonzero(d <= bits)
        out.append((q[i], j, d[i, j]))
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest(codes: np.ndarray, bits: int = BITS, most: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each node of a group with at most ``most`` of its neighbours within ``bits``."""
    n = len(codes)
    every = np.arange(n)
    if n <= EXACT:
        a, b, d = exact_neighbours(codes, every, bits)
    else:
        world, beam = SmallWorld(codes), 24
        audit = np.random.default_rng(1).choice(n, min(n, 64), replace=False)
        qa, qb, _ = exact_neighbours(codes, audit, bits)
        truth = set(zip(qa.tolist(), qb.tolist()))
        while True:
            ids, far = world.search(audit, beam)
            i, j = np.nonzero((far <= bits) & (ids >= 0))
            got = truth & set(zip(audit[i].tolist(), ids[i, j].tolist()))
            wanted = sum(min(c, most) for c in np.unique(qa, return_counts=True)[1])
            if sum(min(c, most) for c in np.unique([p[0] for p in got], return_counts=True)[1]) >= RECALL * wanted or beam >= n // 4:
                break
            beam *= 2
        if beam >= n // 4:
            a, b, d = exact_neighbours(codes, every, bits)
        else:
            ids, far = world.search(every, beam)
            i, j = np.nonzero((far <= bits) & (ids >= 0))
            a, b, d = every[i], ids[i, j], far[i, j]
    o = np.lexsort((b, d, a))
    a, b = a[o], b[o]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < most
    return a[keep], b[keep]


def _search(second: bool):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "node"], kind="stable")
        codes = pdf[["hi", "lo"]].to_numpy().view(np.uint64)
        node, part = pdf["node"].to_numpy(), pdf["part"].to_numpy()
        key = pdf["key"].to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        two = edge[:-1][np.diff(edge) == 2]  # most groups are pairs
        near = np.bitwise_count(codes[two] ^ codes[two + 1]).sum(-1) <= BITS
        left, right = [two[near]], [two[near] + 1]
        for s, e in zip(edge[:-1], edge[1:]):
            if e - s > 2:
                a, b = exact_neighbours(codes[s:e], np.arange(e - s))[:2] if second else nearest(codes[s:e])
                if second:
                    a, b = a[(new := a < b)], b[new]
                    other = part[s + a] != part[s + b]
                    a, b = a[other], b[other]
                left.append(s + a)
                right.append(s + b)
        a, b = np.concatenate(left), np.concatenate(right)
        if second:
            other = part[a] != part[b]
            a, b = a[other], b[other]
        a, b = node[a], node[b]
        swap = a > b
        return pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b)}).drop_duplicates()

    return search


def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.empty(len(a))
    for i, (x, y) in enumerate(zip(a, b)):
        both = np.concatenate((x, y))
        both.sort()
        same = np.count_nonzero(both[1:] == both[:-1])
        out[i] = same / (len(both) - same)
    return pd.Series(out)


def verify(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose sets of shingles have at least that Jaccard similarity."""
    jaccard = F.pandas_udf(lambda a, b: _jaccard(a, b), "double")
    size = F.size
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        # sets of too different size can't be that similar
        .where(F.least(size("x"), size("y")) >= similarity * F.greatest(size("x"), size("y")))
    )
    return both.select("a", "b", jaccard("x", "y").alias("jaccard")).where(F.col("jaccard") >= similarity)


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, shingles)`` of the ``wanted`` nodes, made anew from one text of each; few other texts are shuffled."""
    named = nodes.join(wanted, "node", "left_semi")
    ids = named.select(F.col("first_id").alias("_qw_id")).distinct()
    some = maybe_among(docs, "doc_id", ids, "_qw_id").where("_qw_maybe").drop("_qw_maybe")
    texts = some.join(ids, F.col("doc_id").eqNullSafe(F.col("_qw_id")), "left_semi")
    found = texts.select("text").mapInPandas(shingled, SETS).join(named.select("node", "d1", "d2"), ["d1", "d2"])
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))  # ids may repeat


def _placed(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """``(key, node, hi, lo, ring)``: each node under each of its minima.

    A minimum of more than ``group`` nodes is cut in blocks of about half of that, and each two of its blocks are a key of their
    own, so all its pairs meet.  ``ring`` marks the keys of a block and the next one; all other minima have it too.
    """
    rows = nodes.where("d1 <> 0 or d2 <> 0").select("node", "hi", "lo", F.posexplode("keys").alias("r", "key"))
    rows = rows.withColumn("key", F.xxhash64("r", "key")).drop("r")
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group)
    counts = checkpoint(counts.select("key", F.ceil(2 * F.col("n") / group).alias("blocks")))
    if counts.isEmpty():
        return rows.withColumn("ring", F.lit(True))
    # a hot key has more than group nodes, so there are few; the rows stay where they are
    rows = rows.join(F.broadcast(counts), "key", "left").withColumn("b", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")))
    light = rows.where("blocks is null").select("key", "node", "hi", "lo", F.lit(True).alias("ring"))
    hot = rows.where("blocks is not null").withColumn("c", F.explode(F.sequence(F.expr("0L"), F.col("blocks") - 1))).where("b <> c")
    ring = (F.pmod(F.col("c") - F.col("b"), F.col("blocks")) == 1) | (F.pmod(F.col("b") - F.col("c"), F.col("blocks")) == 1)
    hot = hot.select(F.xxhash64("key", F.least("b", "c"), F.greatest("b", "c")).alias("key"), "node", "hi", "lo", ring.alias("ring"))
    return light.unionByName(hot)


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The features of every row, and the class of each of their nodes."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    feats = checkpoint(d.mapInPandas(features, FEATURES.format(id=kind)))
    nodes = feats.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("hi", "lo", "keys")])
    nodes = checkpoint(nodes.withColumn("node", F.monotonically_increasing_id()))
    placed = checkpoint(_placed(nodes))
    shards = max(1, -(-placed.count() // 8192))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(shards)))
    links = sets = None
    for second in (False, True):
        rows = placed.where("ring").withColumn("part", F.expr("0L")) if not second else (
            placed.join(connected_components(links, "a", "b").withColumnRenamed("component", "part"), "node", "left")
            .withColumn("part", F.coalesce("part", "node"))
        )
        pairs = rows.select("shard", "key", "node", "hi", "lo", "part").groupBy("shard").applyInPandas(_search(second), "a long, b long")
        pairs = checkpoint(pairs.distinct())
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        if sets is not None:  # the first pass found a neighbour of nearly all of them
            wanted = wanted.join(sets, "node", "left_anti")
        more = checkpoint(_sets(d, nodes, wanted))
        sets = more if sets is None else sets.unionByName(more)
        found = checkpoint(verify(pairs, sets).select("a", "b"))
        links = found if links is None else links.unionByName(found)
    part = connected_components(links, "a", "b")
    named = nodes.select("d1", "d2", "node").join(part, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("part"))
    return feats, named


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, class_id, class_size)`` of every row: classes are the components of the links between texts whose
    five-word shingles have a Jaccard similarity of 0.8 or more, named by their smallest id.

    Case and punctuation don't count.  Texts of fewer than five words are alike if their words are equal; texts without
    words, null ones too, are one class.  Rows may repeat an id, each keeps its class; a null id comes last.
    An empty table gives an empty result.
    """
    feats, named = _classes(docs, id_col, text_col)
    rows = feats.select("doc_id", "d1", "d2").join(named, ["d1", "d2"])
    classes = rows.groupBy("part").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(classes, "part").select("doc_id", "class_id", "class_size")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each class one row with the smallest id stays.

    Only the dropped ids are joined, with the rows that a bit table doesn't tell from them.  Ids should tell the rows apart: of rows that repeat id and text one stays, and an id is
    dropped only if no row of it stays.
    """
    classes = checkpoint(near_classes(docs, id_col, text_col))
    stays = F.col("doc_id").eqNullSafe(F.col("class_id"))
    ids = classes.groupBy("doc_id").agg(F.max(stays).alias("stays"), F.count("*").alias("n"))
    dropped = ids.where(~F.col("stays")).select(F.col("doc_id").alias("_qw_id"))
    marked = maybe_among(docs, id_col, dropped, "_qw_id")
    kept = marked.where("_qw_maybe").join(dropped, F.col(id_col).eqNullSafe(F.col("_qw_id")), "left_anti")
    kept = marked.where("not _qw_maybe").unionByName(kept).drop("_qw_maybe")
    again = ids.where("stays and n > 1").select(F.col("doc_id").alias("_qw_id"))
    if not again.isEmpty():
        same = F.col(id_col).eqNullSafe(F.col("_qw_id"))
        one = kept.join(again, same, "left_semi").dropDuplicates([id_col, text_col])
        kept = kept.join(again, same, "left_anti").unionByName(one)
    return kept


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; nulls, empty, very long and repeated texts and ids as ``near_classes`` says."""
    return near_classes(documents(spark, sf_dir))
