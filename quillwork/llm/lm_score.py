"""Masked pseudo-likelihood of documents.

A small network predicts every word from the two on either side of it; a document's score is the sum of
the log-probabilities of its words, each given the others.  The most frequent words have an id, the rest fall into classes by
their hash; the network gives the probability of the id, two softmaxes in chain, and the counts of the whole corpus that
of a word within its class.

Every document trains in one of the rounds.  Documents are spread over buckets by a hash of text and id, and each bucket trains
on its documents in the order of their hashes, so the parameters don't depend on how the input is partitioned.  The buckets' parameters are
averaged by the number of words after each round, in two levels, so no task holds more than a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, documents
from .shingles import batches, mix, release, word_hashes

#: Words with an id of their own, classes of the others, and the base of the two digits of an id.
WORDS, OTHERS, BASE = 960, 64, 32
VOCABULARY = WORDS + OTHERS
#: Places, by hash, that the words of the classes are counted at over the whole corpus; rare words may share one.
PLACES = 1 << 20
#: Places that come to the driver as one value.
SPAN = 1 << 12
#: Places of the window, relative to the word.
WINDOW = (-2, -1, 1, 2)
HIDDEN = 24
ROUNDS, BATCH, RATE, SEED = 2, 8192, 0.05, 42
#: Words of a bucket, about, and words that are worked on together.
BUCKET, BLOCK = 4_000_000, 200_000
#: Buckets whose parameters one task averages, and pieces that the parameters are cut in.
FAN_IN, PIECES = 256, 8
#: Hashes counted at once.
HELD = 4_000_000

SHAPES = {
    "e": (len(WINDOW) * (VOCABULARY + 1), HIDDEN), "b": (HIDDEN,), "w1": (HIDDEN, BASE), "b1": (BASE,), "w2": (HIDDEN, BASE), "u": (BASE, BASE),
}


def word_totals(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[np.ndarray] = []

    def flush() -> pd.DataFrame:
        word, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pd.DataFrame({"word": word.view(np.int64), "n": n})

    for pdf in batch:
        for _, part in batches(list(pdf["text"])):
            held.append(word_hashes(part)[0])
            if sum(map(len, held)) > HELD:
                yield flush()
    if held:
        yield flush()


class Words:
    """Ids of words: by falling frequency, then the classes of the rest; and the rest's shares of their class."""

    def __init__(self, hashes: np.ndarray, places: np.ndarray):
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        total = (places + 0.5).reshape(-1, OTHERS).sum(0)
        self.log_share = np.log((places + 0.5) / np.tile(total, PLACES // OTHERS)).astype(np.float32)

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids, and the logarithm of the share of the word in its class, 0 for a word with an id of its own."""
        place = (mix(h) & np.uint64(PLACES - 1)).astype(np.int64)
        other, log = WORDS + place % OTHERS, self.log_share[place].astype(np.float64)
        if not len(self.hashes):
            return other, log
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        own = self.hashes[at] == h
        return np.where(own, self.order[at], other), np.where(own, 0.0, log)


def windows(ids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Rows of the embedding for the places round each word; a place beyond the document has one of its own."""
    n, pad = len(ids), max(map(abs, WINDOW))
    doc = np.repeat(np.arange(len(count)), count)
    x = np.concatenate((np.full(pad, -1), ids, np.full(pad, -1)))
    d = np.concatenate((np.full(pad, -1), doc, np.full(pad, -1)))
    out = np.empty((n, len(WINDOW)), np.int32)
    for k, w in enumerate(WINDOW):
        at = slice(pad + w, pad + w + n)
        out[:, k] = np.where(d[at] == doc, x[at], VOCABULARY) + k * (VOCABULARY + 1)
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


class Network:
    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = {k: v.astype(np.float32).reshape(SHAPES[k]) for k, v in parameters.items()}

    @classmethod
    def start(cls, frequency: np.ndarray) -> Network:
        """Small random embeddings; the biases give each word the share that it has of the corpus."""
        rng = np.random.default_rng(SEED)
        p = {k: rng.normal(0, 0.05, s) for k, s in SHAPES.items()}
        f = (frequency + 0.5).reshape(BASE, BASE)
        p["b"] = np.zeros(HIDDEN)
        p["b1"] = np.log(f.sum(1) / f.sum())
        p["u"] = np.log(f / f.sum(1, keepdims=True))
        return cls(p)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in SHAPES])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        at = np.cumsum([0, *(int(np.prod(s)) for s in SHAPES.values())])
        return cls({k: flat[a:b] for k, a, b in zip(SHAPES, at, at[1:])})

    def forward(self, window: np.ndarray, ids: np.ndarray):
        p = self.p
        h = p["e"][window[:, 0]]
        for k in range(1, window.shape[1]):
            h = h + p["e"][window[:, k]]
        h = np.tanh(h + p["b"])
        first, second = np.divmod(ids, BASE)
        one = _softmax(h @ p["w1"] + p["b1"])
        two = _softmax(h @ p["w2"] + p["u"][first])
        return h, first, second, one, two

    def log_probabilities(self, window: np.ndarray, ids: np.ndarray) -> np.ndarray:
        _, first, second, one, two = self.forward(window, ids)
        row = np.arange(len(ids))
        return np.log(one[row, first].astype(np.float64) + 1e-30) + np.log(two[row, second].astype(np.float64) + 1e-30)

    def train(self, window: np.ndarray, ids: np.ndarray, squares: dict[str, np.ndarray]) -> None:
        """One step of gradient descent with rates that fall per parameter."""
        p = self.p
        h, first, second, one, two = self.forward(window, ids)
        n, row = len(ids), np.arange(len(ids))
        one[row, first] -= 1
        two[row, second] -= 1
        dh = (one @ p["w1"].T + two @ p["w2"].T) * (1 - h * h)
        order = np.argsort(first, kind="stable")
        edge = np.flatnonzero(np.diff(first[order], prepend=-1))
        du = np.zeros_like(p["u"])
        du[first[order[edge]]] = np.add.reduceat(two[order], edge)
        for k, g in (("w1", h.T @ one), ("b1", one.sum(0)), ("w2", h.T @ two), ("u", du), ("b", dh.sum(0))):
            self._step(p[k], squares[k], g / n, ...)
        rows = window.ravel(order="F")
        order = np.argsort(rows, kind="stable")
        edge = np.flatnonzero(np.diff(rows[order], prepend=-1))
        self._step(p["e"], squares["e"], np.add.reduceat(dh[order % n], edge) / n, rows[order[edge]])

    @staticmethod
    def _step(value: np.ndarray, square: np.ndarray, g: np.ndarray, at) -> None:
        square[at] += g * g
        value[at] -= RATE * g / (np.sqrt(square[at]) + 1e-6)


def encoder(words: Words):
    """The ids of every text, the sum of its words' log-shares in their classes, and a hash of all its words."""

    def go(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batch:
            for first, part in batches(list(pdf["text"])):
                h, count = word_hashes(part)
                ids, log = words.ids(h)
                edge = np.concatenate(([0], np.cumsum(count)))
                full = np.flatnonzero(count)
                key, within = np.zeros(len(part), np.uint64), np.zeros(len(part))
                if len(full):
                    place = (np.arange(len(h)) - np.repeat(edge[:-1], count)).astype(np.uint64)
                    key[full] = mix(np.add.reduceat(mix(h + place * np.uint64(0x9E3779B97F4A7C15)), edge[full]))
                    within[full] = np.add.reduceat(log, edge[full])
                small = ids.astype(np.int16)
                yield pd.DataFrame(
                    {
                        "doc_id": pdf["doc_id"].iloc[first : first + len(part)].to_numpy(), "key": key.view(np.int64), "within": within,
                        "ids": [small[a:b] for a, b in zip(edge[:-1], edge[1:])],
                    }
                )
        release()

    return go


def encoded(docs: DataFrame, words: Words, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, key, within, ids, bucket)``, each bucket a partition in the order of its hashes."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInPandas(encoder(words), f"doc_id {kind}, key long, within double, ids array<short>")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "doc_id"), F.lit(buckets)).cast("int"))
    return checkpoint(rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "key", "doc_id"))


def blocks(batch: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Bucket, rows, ids and number of words of runs of documents that begin with the bucket, wherever Arrow cut."""
    held, size, now = [], 0, None

    def flush():
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids = rows.column("ids")
        return now, rows, ids.flatten().to_numpy().astype(np.int64), np.diff(ids.offsets.to_numpy())

    for b in batch:
        bucket, words = b.column("bucket").to_numpy(), b.column("ids").value_lengths().to_numpy()
        start = 0
        for i in range(len(bucket)):
            if held or i > start:
                if bucket[i] != now or size + words[i] > BLOCK:
                    if i > start:
                        held.append(b.slice(start, i - start))
                    yield flush()
                    held, size, start = [], 0, i
            now = bucket[i]
            size += words[i]
        if len(bucket) > start:
            held.append(b.slice(start))
    if held:
        yield flush()


def trainer(start: np.ndarray, turn: int):
    """Trains each bucket on the documents whose turn it is; gives the parameters, in pieces."""

    def go(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, squares, seen, now = None, None, 0, None

        def done():
            pieces = np.array_split(net.flat(), PIECES)
            columns = [pa.array(range(PIECES), pa.int64()), pa.array([now] * PIECES, pa.int64()), pa.array([seen] * PIECES, pa.int64()), pa.array(pieces, pa.list_(pa.float32()))]
            return pa.RecordBatch.from_arrays(columns, ["piece", "part", "n", "values"])

        for bucket, rows, ids, count in blocks(batch):
            if bucket != now:
                if seen:
                    yield done()
                net, seen, now = Network.of(start), 0, bucket
                squares = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
            turns = rows.column("key").to_numpy().view(np.uint64) % np.uint64(ROUNDS) == turn
            window = windows(ids, count)
            mine = np.flatnonzero(np.repeat(turns, count))
            mine = mine[np.random.default_rng(len(mine)).permutation(len(mine))]
            for k in range(0, len(mine), BATCH):
                at = mine[k : k + BATCH]
                net.train(window[at], ids[at], squares)
            seen += len(mine)
        if seen:
            yield done()
        release()

    return go


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("part")
    n = pdf["n"].to_numpy()
    total = np.zeros(len(pdf["values"].iloc[0]))
    for w, v in zip(n, pdf["values"]):
        total += w * v.astype(np.float64)
    return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "part": [pdf["part"].iloc[0]], "n": [n.sum()], "values": [(total / n.sum()).astype(np.float32)]})


def count(docs: DataFrame, text_col: str = "text") -> tuple[Words, np.ndarray]:
    """The words of all texts of ``docs`` and the frequency of each id."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    totals = checkpoint(texts.mapInPandas(word_totals, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    top = totals.orderBy(F.desc("n"), "word").limit(WORDS).toPandas()
    hashes = np.sort(top["word"].to_numpy().view(np.uint64))

    def places(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batch:
            h = pdf["word"].to_numpy().view(np.uint64)
            rest = ~np.isin(h, hashes)
            yield pd.DataFrame({"place": (mix(h[rest]) & np.uint64(PLACES - 1)).astype(np.int64), "n": pdf["n"].to_numpy()[rest]})

    def dense(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(SPAN)
        out[pdf["place"].to_numpy() % SPAN] = pdf["n"]
        return pd.DataFrame({"span": [pdf["place"].iloc[0] // SPAN], "n": [out.tobytes()]})

    at = totals.mapInPandas(places, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    # PLACES / SPAN rows, together PLACES doubles
    at = at.groupBy(F.shiftright("place", SPAN.bit_length() - 1)).applyInPandas(dense, "span long, n binary").toPandas()
    n = np.zeros((PLACES // SPAN, SPAN))
    for span, part in at.itertuples(index=False):
        n[span] = np.frombuffer(part)
    n = n.ravel()
    f = np.zeros(VOCABULARY)
    f[: len(top)] = top["n"]
    f[WORDS:] = n.reshape(-1, OTHERS).sum(0)
    return Words(top["word"].to_numpy().view(np.uint64), n), f


def train(rows: DataFrame, frequency: np.ndarray) -> Network:
    """The network of all ``encoded`` rows."""
    net = Network.start(frequency)
    schema = "piece long, part long, n long, values array<float>"
    for turn in range(ROUNDS):
        parts = rows.select("bucket", "key", "ids").mapInArrow(trainer(net.flat(), turn), schema)
        some = parts.groupBy("piece", F.floor(F.col("part") / FAN_IN)).applyInPandas(_average, schema)
        mean = some.groupBy("piece").applyInPandas(_average, schema).toPandas()  # PIECES rows
        if len(mean):
            net = Network.of(np.concatenate(mean.sort_values("piece")["values"].to_list()))
    return net


def _buckets(frequency: np.ndarray) -> int:
    return max(1, -(-int(frequency.sum()) // BUCKET))


def fit(docs: DataFrame) -> tuple[Words, Network]:
    """The words and the network of all texts of ``docs`` (doc_id, text).

    Rows that repeat count as often; null and empty texts teach nothing.  An empty table gives a network that knows no word.
    """
    words, f = count(docs)
    return words, train(encoded(docs, words, _buckets(f)), f)


def scorer(parameters: np.ndarray):
    def go(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.of(parameters)
        for _, rows, ids, many in blocks(batch):
            window = windows(ids, many)
            log = np.concatenate([np.zeros(0), *(net.log_probabilities(window[k : k + BATCH], ids[k : k + BATCH]) for k in range(0, len(ids), BATCH))])
            total, full = np.zeros(len(many)), np.flatnonzero(many)
            if len(full):
                total[full] = np.add.reduceat(log, (np.cumsum(many) - many)[full])
            total = np.round(total + rows.column("within").to_numpy(), 3)
            columns = [rows.column("doc_id"), pa.array(many.astype(np.int64)), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "log_probability"])
        release()

    return go


def _scores(rows: DataFrame, net: Network) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.select("bucket", "doc_id", "within", "ids").mapInArrow(scorer(net.flat()), f"doc_id {kind}, n_words long, log_probability double")
    return out.withColumn("per_word", F.when(F.col("n_words") > 0, F.round(F.col("log_probability") / F.col("n_words"), 6)))


def score(docs: DataFrame, words: Words, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, log_probability, per_word)`` of every row.

    A text without words, or null, has the sum 0 and no mean; repeated rows each get the same score, null ids too.  Long texts
    are read whole.  Other columns, of whatever name, are not read; an empty table gives an empty result.
    """
    size = docs.select(F.sum(F.length(F.col(text_col).cast("string"))).alias("n")).first()[0] or 0
    return _scores(encoded(docs, words, max(1, -(-size // (8 * BUCKET))), id_col, text_col), net)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of all ``documents`` under the network of all ``documents``; rows as ``score`` says."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    words, f = count(docs)
    rows = encoded(docs, words, _buckets(f))
    return _scores(rows, train(rows, f))
