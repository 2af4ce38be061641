"""Toxicity by lexicon induction.

1. Toxic and neutral seed terms come from a bounded sample of labelled documents.
2. Over all documents, the words that stand near toxic seeds clearly more often than chance would put them there are
   candidates; with the seeds they are the nodes of the graph.
3. Over all documents, the nodes that stand near each other are counted, near copies once; positive pointwise mutual information, each
   node's strongest links of it, makes the word graph.
4. Random walks that restart at the toxic, and at the neutral, seeds visit the nodes; the share of the toxic walk's visits
   is a word's polarity and alone makes its weight, whether a label ever touched the word or not.
5. The polar words in a text make its score, calibrated on the sample.

Counts are whole numbers and the walks are summed in fixed point, so a rerun or another partitioning gives equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, documents, stored, text_of
from .shingles import batches, mix, release, shingle_hashes, word_hashes

#: Labelled documents of each class that the seeds and the calibration are learned from, at most.
SAMPLE = 10_000
#: Neutral seeds, at most; the toxic ones are as many as are clear.
SEEDS = 512
#: Documents of the sample, near copies once, that have a seed, at least.
LEAST = 4
#: Signed root of the likelihood ratio from which a word is a toxic seed; chance alone gives it to one word in 100,000.
CLEAR = 4.2
#: The same for candidates, of which there are as many as words in the corpus; and documents of theirs, at least.
SURE, MET = 5.0, 3
#: Nodes after a node, and their distance in words, that count as near.
NEAR, REACH = 8, 40
#: Nodes in documents that are worked on together.
TERMS = 150_000
#: Strongest links of a node.
LINKS = 32
#: Chance that a walk goes on, its steps, and the units of its fixed point.
ON, STEPS, UNITS = 0.7, 8, 10**15
#: Weight from which a word is in the lexicon.
POLAR = 0.3
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """Whether the labels of a row must not be learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


@dataclass(frozen=True)
class Lexicon:
    """Hashes of polar words, ascending, their weights in 0 to 1, and the calibration."""

    words: np.ndarray
    weight: np.ndarray
    coefficient: np.ndarray

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Summed weight and its density, both as logarithms; 0 for a text without polar words."""
        out = np.zeros((len(texts), 2))
        if not len(self.words):
            return out
        for first, part in batches(texts):
            h, count = word_hashes(part)
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            w = np.where(self.words[at] == h, self.weight[at], 0.0)
            total = np.diff(np.concatenate(([0.0], np.cumsum(w)))[np.concatenate(([0], np.cumsum(count)))])
            total = np.maximum(np.round(total, 6), 0)
            out[first : first + len(part), 0] = np.log1p(total)
            out[first : first + len(part), 1] = np.log1p(1000 * total / np.maximum(count, 1))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficient[1:] + self.coefficient[0], -30, 30)))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Id, text and label of at most SAMPLE rows of each class that may be learned from, in the order of a hash of the id."""
    l = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    l = l.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = [l.where(F.col("toxic") == c).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(SAMPLE) for c in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    rows = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.select("doc_id", "toxic", "text")


def minima(words: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Four minima of the hashes of each text's shingles; near copies share most, texts without words have their own zeros."""
    h, many = shingle_hashes(words, count)
    out = np.zeros((len(count), 4), np.uint64)
    full = np.flatnonzero(many)
    if len(full):
        start = (np.cumsum(many) - many)[full]
        for k in range(4):
            out[full, k] = np.minimum.reduceat(mix(h ^ np.uint64(0x2545F4914F6CDD1D * (k + 1) % 2**64)), start)
    return out


MINIMA = "m0 long, m1 long, m2 long, m3 long"


def _with_minima(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batch:
        for first, part in batches(list(pdf["text"])):
            m = _signed(minima(*word_hashes(part)))
            yield pdf.iloc[first : first + len(part)][["doc_id", "toxic", "text"]].assign(**{f"m{k}": m[:, k] for k in range(4)})


def one_of_copies(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (all of ``order``, m0 to m3), of those that share two minima the first in ``order``.

    Every round is an aggregate that combines before its shuffle, so a text copied by a third of all rows is no task's burden.
    """
    names = [*order, "m0", "m1", "m2", "m3"]
    for k in range(4):
        rows = rows.groupBy(f"m{k}", f"m{(k + 1) % 4}", *(["toxic"] if "toxic" in order else [])).agg(F.min(F.struct(*names)).alias("x"))
        rows = rows.select(*[F.col(f"x.{c}").alias(c) for c in names])
    return rows


def term_counts(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of either class that have a word, by hash of the word."""
    for pdf in batch:
        for first, part in batches(list(pdf["text"])):
            h, count = word_hashes(part)
            h, doc, _ = _by_word(h, np.repeat(np.arange(len(part)), count))
            toxic = pdf["toxic"].to_numpy()[first + doc]
            word, at = np.unique(h, return_index=True)
            if len(word):
                bad = np.add.reduceat(toxic.astype(np.int64), at)
                yield pd.DataFrame({"word": _signed(word), "bad": bad, "all": np.diff(np.append(at, len(h)))})


def _by_word(h: np.ndarray, doc: np.ndarray, mark: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The distinct pairs of word and document, by word; and whether ``mark`` is set at any place of each."""
    o = np.lexsort((doc, h))
    h, doc = h[o], doc[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    if mark is not None and len(h):
        mark = np.logical_or.reduceat(mark[o], np.flatnonzero(new))
    return h[new], doc[new], mark


def _surprise(k: Column, n: Column, rate: Column | float) -> Column:
    """Signed root of the likelihood ratio of k hits among n against the rate."""
    part = lambda k, of: F.when(k > 0, k * F.log(k / (n * of))).otherwise(0.0)
    return F.round(F.signum(k / n - rate) * F.sqrt(F.greatest(F.lit(0.0), 2 * (part(k, rate) + part(n - k, 1 - rate)))), 9)


def judged(counts: DataFrame, n_bad: int, n_good: int) -> DataFrame:
    """``counts`` and what the labels say of each word: 1 toxic seed, -1 neutral, 0 neither."""
    bad, good = F.col("bad"), F.col("all") - F.col("bad")
    odds = F.log((bad + 0.5) / (n_bad - bad + 0.5)) - F.log((good + 0.5) / (n_good - good + 0.5))
    z = _surprise(bad, F.col("all"), n_bad / (n_bad + n_good))
    clear = (z > CLEAR) & (F.round(odds, 9) > 2.5)
    return counts.where(F.col("all") >= LEAST).withColumn("says", F.when(clear, 1).when((z < 1) | (odds < 0.5), -1).otherwise(0))


def near_terms(seeds: np.ndarray):
    """Documents of each word, those where it stands near another toxic seed (hashes, ascending), and 64 bits, of which each such
    document's text sets one that near copies mostly share; a row without a word has the sums."""

    def count(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batch:
            for _, part in batches(list(pdf["text"])):
                h, many = word_hashes(part)
                if not len(h):
                    continue
                doc = np.repeat(np.arange(len(part)), many)
                at = np.minimum(np.searchsorted(seeds, h), len(seeds) - 1)
                place = np.flatnonzero(seeds[at] == h)
                near = np.zeros(len(h), bool)
                if len(place):
                    here = np.arange(len(h))
                    for side, shift in (("left", -1), ("right", 0)):  # the last seed before a word, the first one after it
                        k = np.searchsorted(place, here, side) + shift
                        other = place[np.clip(k, 0, len(place) - 1)]
                        near |= (k >= 0) & (k < len(place)) & (np.abs(other - here) <= REACH) & (doc[other] == doc) & (other != here)
                bit = np.left_shift(np.uint64(1), minima(h, many)[:, 0] & np.uint64(63))
                h, doc, near = _by_word(h, doc, near)
                word, start = np.unique(h, return_index=True)
                docs = np.diff(np.append(start, len(h)))
                met = np.add.reduceat(near.astype(np.int64), start)
                bits = np.bitwise_or.reduceat(np.where(near, bit[doc], np.uint64(0)), start)
                yield pd.DataFrame({"word": pd.array(_signed(word), "Int64"), "docs": docs, "met": met, "bits": _signed(bits)})
                yield pd.DataFrame({"word": pd.array([None], "Int64"), "docs": [docs.sum()], "met": [met.sum()], "bits": [0]})
        release()

    return count


def candidates(docs: DataFrame, seeds: np.ndarray) -> DataFrame:
    """``word`` of those that stand near the toxic seeds in more of all documents than chance would have it."""
    seen = docs.select(text_of("text").alias("text")).mapInPandas(near_terms(seeds), "word long, docs long, met long, bits long")
    seen = seen.groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("met").alias("met"), F.bit_or("bits").alias("bits"))
    # the sums' row comes along; of the others only those that meet seeds in enough texts
    seen = checkpoint(seen.where((F.col("met") >= MET) & (F.col("word").isNull() | (F.bit_count("bits") >= MET))))
    all_ = seen.where("word is null").first()
    if all_ is None:
        return seen.select("word").limit(0)
    return seen.where("word is not null").where(_surprise(F.col("met"), F.col("docs"), all_["met"] / all_["docs"]) > SURE).select("word")


def mentions(nodes: np.ndarray, kind: str):
    """The nodes (hashes, ascending) of each document that has two, in order, each with its distance from the one before; with the text's
    digest and minima.  A distance beyond REACH is as good as any other."""
    small, name = (np.int16, "short") if len(nodes) < 1 << 15 else (np.int32, "int")

    def read(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batch:
            for first, part in batches(list(pdf["text"])):
                h, many = word_hashes(part)
                at = np.minimum(np.searchsorted(nodes, h), len(nodes) - 1)
                place = np.flatnonzero(nodes[at] == h)
                doc = np.repeat(np.arange(len(part)), many)[place]
                edge = np.searchsorted(doc, np.arange(len(part) + 1))
                some = np.flatnonzero(np.diff(edge) > 1)
                if len(some):
                    gap, term = np.minimum(np.diff(place, prepend=place[0]), REACH + 1).astype(np.int8), at[place].astype(small)
                    m = _signed(minima(h, many))[some]
                    begin = np.cumsum(many) - many
                    order = (np.arange(len(h)) - np.repeat(begin, many)).astype(np.uint64)
                    digest = _signed(mix(np.add.reduceat(mix(h + order), begin[many > 0])))[np.searchsorted(np.flatnonzero(many), some)]
                    yield pd.DataFrame(
                        {
                            "doc_id": pdf["doc_id"].iloc[first + some].to_numpy(), "digest": digest, **{f"m{k}": m[:, k] for k in range(4)},
                            "gap": [gap[edge[d] : edge[d + 1]] for d in some], "term": [term[edge[d] : edge[d + 1]] for d in some],
                        }
                    )
        release()

    return read, f"doc_id {kind}, digest long, {MINIMA}, gap array<tinyint>, term array<{name}>"


def near_pairs(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents where two nodes, ``i < j``, stand near each other."""
    for pdf in batch:
        many = pdf["term"].map(len).to_numpy()
        # documents that are worked on together, so that what a batch needs is bounded
        part = np.cumsum(many) // TERMS
        edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else []
        for x, y in zip(edge[:-1], edge[1:]):
            if many[x:y].sum() < 2:
                continue
            term, place = (np.concatenate(pdf[c].to_numpy()[x:y]) for c in ("term", "gap"))
            place = np.cumsum(place, dtype=np.int64)
            doc = np.repeat(np.arange(y - x), many[x:y])
            found = []
            for s in range(1, NEAR + 1):
                a, b = term[:-s].astype(np.int64), term[s:].astype(np.int64)
                ok = (doc[:-s] == doc[s:]) & (place[s:] - place[:-s] <= REACH) & (a != b)
                found.append(np.stack((np.minimum(a, b)[ok], np.maximum(a, b)[ok], doc[:-s][ok])))
            i, j, d = np.concatenate(found, 1)
            o = np.lexsort((d, j, i))
            i, j, d = i[o], j[o], d[o]
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (d[1:] != d[:-1])
            i, j = i[new], j[new]
            first = np.ones(len(i), bool)
            first[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            at = np.flatnonzero(first)
            yield pd.DataFrame({"i": i[at], "j": j[at], "n": np.diff(np.append(at, len(i)))})
    release()


def graph(pairs: DataFrame) -> DataFrame:
    """``(i, j, p)``: the steps of a walk, from the counts ``n`` of near pairs.

    The counts are lessened by their own error, so one document makes no link; a link stays that is
    among the LINKS strongest of both its nodes, else common words of a small language, alike near to all of it, would link its toxic ones.
    """
    both = checkpoint(pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "n")))
    margin = checkpoint(both.groupBy("i").agg(F.sum("n").alias("m")))
    total = margin.agg(F.sum("m")).first()[0] or 1
    rated = both.join(margin, "i").join(margin.select(F.col("i").alias("j"), F.col("m").alias("mj")), "j")
    pmi = F.round(F.log((F.col("n") - F.sqrt("n")) * total / (F.col("m") * F.col("mj"))), 9)
    rated = rated.where("n > 1").select("i", "j", pmi.alias("w")).where("w > 0")
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("w"), "j"))
    best = rated.withColumn("rank", rank).where(F.col("rank") <= LINKS).drop("rank")
    best = best.join(best.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"])
    # whole units of the weights sum alike in any order
    best = best.withColumn("w", F.round(F.col("w") * 1_000_000).cast("long"))
    out = best.groupBy("i").agg(F.sum("w").alias("s"))
    return checkpoint(best.join(out, "i").select("i", "j", (F.col("w") / F.col("s")).alias("p")))


def polarity(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """``(i, polarity)`` of the ``nodes`` (i, says) that a walk visits: the toxic walk's share of the visits."""
    n = {r["says"]: r["count"] for r in nodes.groupBy("says").count().collect()}
    start = [F.when(F.col("says") == s, UNITS // max(n.get(s, 0), 1)).otherwise(0).cast("long").alias(c) for s, c in ((1, "t"), (-1, "c"))]
    start = checkpoint(nodes.select("i", *start))
    again = start.select("i", *[F.floor(F.col(c) * (1 - ON)).alias(c) for c in "tc"])
    at = start
    for _ in range(STEPS):
        gone = at.join(steps, "i").select(F.col("j").alias("i"), *[F.floor(F.col(c) * F.col("p") * ON).alias(c) for c in "tc"])
        at = again.unionByName(gone).groupBy("i").agg(*[F.sum(c).alias(c) for c in "tc"])
    return checkpoint(at.where("t + c > 0").select("i", F.round(F.col("t") / (F.col("t") + F.col("c")), 6).alias("polarity")))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge, both classes of equal weight."""
    x = np.hstack((np.ones((len(x), 1)), x))
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-4 * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(b))
        b = b - np.linalg.solve(h, g)
    return b


NONE = Lexicon(np.empty(0, np.uint64), np.empty(0), np.array([-30.0, 0, 0]))


def polar_words(docs: DataFrame, says: DataFrame, n: int) -> pd.DataFrame:
    """``word`` (hash), ``says`` and ``polarity`` of every node that a walk visits, from ``docs`` (doc_id, text) and the words that
    the labels of ``n`` documents judge (word, all, says)."""
    toxic = np.sort(says.where("says = 1").select("word").toPandas()["word"].to_numpy().view(np.uint64))  # words of the bounded sample
    if not len(toxic):
        return pd.DataFrame({"word": [], "says": [], "polarity": []})
    # neutral words of a tenth of the sample or more link everything
    often = (F.col("says") == -1) & (F.col("all") > max(20, n // 10))
    more = candidates(docs, toxic).join(says.select("word", "says", often.alias("often")), "word", "left").where("often is null or not often")
    more = more.select("word", F.coalesce("says", F.lit(0)).alias("says"))
    neutral = says.where((F.col("says") == -1) & ~often).orderBy(F.desc("all"), "word").limit(SEEDS).select("word", "says")
    nodes = says.where("says = 1").select("word", "says").unionByName(neutral).unionByName(more).distinct().toPandas()
    nodes["h"] = nodes["word"].to_numpy().view(np.uint64)
    nodes = nodes.sort_values("h", ignore_index=True)
    read, schema = mentions(nodes["h"].to_numpy(), docs.schema["doc_id"].dataType.simpleString())
    found = docs.select("doc_id", text_of("text").alias("text")).mapInPandas(read, schema)
    found = stored(found.withColumn("row", F.monotonically_increasing_id()))
    rows = one_of_copies(found.select("doc_id", "digest", "row", "m0", "m1", "m2", "m3"), ["doc_id", "digest", "row"])
    pairs = found.join(rows.select("row"), "row", "left_semi").select("gap", "term").mapInPandas(near_pairs, "i long, j long, n long")
    steps = graph(pairs.groupBy("i", "j").agg(F.sum("n").alias("n")))
    named = docs.sparkSession.createDataFrame(pd.DataFrame({"i": np.arange(len(nodes)), "says": nodes["says"].astype(int)}), "i long, says int")
    p = polarity(named, steps).toPandas()
    return nodes.iloc[p["i"]].assign(polarity=p["polarity"].to_numpy())[["word", "says", "polarity"]].sort_values("word", ignore_index=True)


def weights(words: pd.DataFrame) -> np.ndarray:
    """0 to 1 by polarity: from midway between the neutral seeds' upper end and the toxic seeds' middle, up to the latter.

    Neutral seeds keep their label, 0; a toxic seed that the walks don't bear out falls out too.
    """
    p, says = words["polarity"].to_numpy(float), words["says"].to_numpy()
    if not (says == 1).any():
        return np.zeros(len(p))
    high = np.median(p[says == 1])
    cut = (high + (np.quantile(p[says == -1], 0.95) if (says == -1).any() else 0)) / 2
    return np.where(says == -1, 0, np.clip((p - cut) / max(high - cut, 1e-9), 0, 1)).round(6)


def induce(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The lexicon of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Rows of ``labels`` that are held out, or have a null, are not read; of repeated ones the toxic counts.  Without labelled
    documents of both classes, or without a word that tells them apart, the lexicon is empty and every score 0.  Near copies teach once.
    """
    d = docs.select("doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    rows = sample(d, labels).mapInPandas(_with_minima, f"doc_id {kind}, toxic int, text string, {MINIMA}")
    rows = checkpoint(one_of_copies(rows, ["toxic", "doc_id", "text"]).select("toxic", "text"))
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return NONE
    counts = rows.mapInPandas(term_counts, "word long, bad long, all long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("all").alias("all"))
    words = polar_words(d, checkpoint(judged(counts, n[1], n[0])), n[0] + n[1])
    weight = weights(words)
    if not (weight > POLAR).any():
        return NONE
    h = words["word"].to_numpy(np.int64).view(np.uint64)[weight > POLAR]
    o = np.argsort(h)
    lexicon = Lexicon(h[o], weight[weight > POLAR][o], np.zeros(3))
    seen = rows.mapInPandas(_features(lexicon), "x double, y double, toxic int").groupBy("x", "y", "toxic").count().toPandas()
    seen = seen.sort_values(["x", "y", "toxic"])  # at most 2 * SAMPLE rows
    x, t = np.repeat(seen[["x", "y"]].to_numpy(), seen["count"], 0), np.repeat(seen["toxic"].to_numpy(), seen["count"])
    return Lexicon(lexicon.words, lexicon.weight, np.round(_logistic(x, t), 6))


def _features(lexicon: Lexicon):
    def go(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batch:
            x = lexicon.features(list(pdf["text"]))
            yield pd.DataFrame({"x": x[:, 0], "y": x[:, 1], "toxic": pdf["toxic"]})

    return go


def score(text: Column, lexicon: Lexicon) -> Column:
    """Score of a text, 0 to 1; a null or empty text has no polar words and the lowest score."""

    def go(batch: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batch:
            yield pd.Series(np.round(lexicon.score(list(s)), 6))
        release()

    return F.pandas_udf(go, "double")(text)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, in their own columns.

    Each row is judged by its own text: repeated rows, and rows with a null or repeated id, each stay or go; other columns, of whatever
    name, are only passed on.  Null and empty texts stay, very long ones are read whole.  An empty table gives an empty one.
    """
    lexicon = induce(docs, labels)
    return docs.where(score(F.col("text"), lexicon) < threshold)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``documents``, as ``induce`` and ``score`` say.

    Repeated rows are scored alike, a null or empty text has the lowest score, a null id counts as the empty one in ``held_out``.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    lexicon = induce(docs, documents(spark, sf_dir, "labels"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), lexicon).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
