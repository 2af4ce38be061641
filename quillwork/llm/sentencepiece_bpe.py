"""SentencePiece encoding with seeded merge-dropout, and its decoding.

The model's pieces and scores drive an agenda of candidate merges: the best candidate is merged, the leftmost of equals,
until none is left.  A keyed hash of the candidate skips some of them, so the same text gets other segmentations under
other keys, and the same one under the same key.  All decode to the text.

No piece has a space behind another character, so words are encoded on their own, many at a time, and
the segmentations of a variant are remembered.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .shingles import mix, release

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SEED = 42
#: Share of the candidates that is skipped, and segmentations that a word has at most.
DROPOUT, VARIANTS = 0.1, 4
#: Segmentations that a Python worker remembers: up to half of them of its latest texts, the others of those before.
REMEMBERED = 600_000
#: Words whose agendas run side by side, and characters of text that are encoded at once.
TOGETHER, AT_ONCE = 4096, 3 << 20
#: Words longer than this go through the agenda one by one.
LONG = 64
_NONE = np.int64(-(1 << 40))


class Pieces:
    """The model's merges as a table: which two pieces make which, and with what score."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i).replace("▁", " ") for i in plain}
        self.id_of = {t: i for i, t in text.items()}
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.raw = {i: t.encode() for i, t in text.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        # the same one after the other, with the size and the begin of each
        self.raw_size = np.array([len(self.raw.get(i, b"")) for i in range(n)], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.raw_bytes = np.frombuffer(b"".join(self.raw.get(i, b"") for i in range(n)), np.uint8)
        self.symbol = np.arange(0x110000, dtype=np.int32) + n  # by code point; those without a piece of their own come behind all
        for t, i in self.id_of.items():
            if len(t) == 1:
                self.symbol[ord(t)] = i
        merges = [
            (self.id_of[t[:k]] * n + self.id_of[t[k:]], i)
            for i, t in text.items() for k in range(1, len(t)) if t[:k] in self.id_of and t[k:] in self.id_of
        ]
        merges.sort()
        self.pair = np.array([m[0] for m in merges], np.int64)
        self.made = np.array([m[1] for m in merges], np.int64)
        self.score = np.array([round(sp.get_score(int(i))) for i in self.made], np.int64)
        inner = {t[k] for t in text.values() for k in range(1, len(t)) if t[k - 1].isalnum()}
        ends = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in inner)
        e = re.escape(ends)
        # a run of letters ends before what no piece has behind a letter; else a word goes up to the next space
        self.word = re.compile(rf"\n|\ *[^\W_]+(?=[{e} \n]|\Z)|\ *[^ \n]+|\ +" if ends else r"\n|\ *[^ \n]+|\ +")

    def symbols(self, word: str) -> list[int]:
        """The id of each character, behind all ids if it has none."""
        return self.symbol[np.frombuffer(word.encode("utf-32-le"), np.uint32)].tolist()

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and piece of each merge; no score if there is no such merge."""
        left, right = left.astype(np.int64), right.astype(np.int64)
        key = np.where((left >= 0) & (right >= 0) & (left < self.size) & (right < self.size), left * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.score[at], _NONE), self.made[at]

    def ids(self, symbols: list[int]) -> list[int]:
        out = []
        for s in symbols:
            if s < self.size:
                out.append(s)
            else:
                out += [self.byte[b] for b in chr(s - self.size).encode()]
        return out

    def join(self, ids: bytes) -> bytes:
        """What 32-bit ids stand for."""
        at = np.frombuffer(ids, np.int32)
        size = self.raw_size[at]
        end = np.cumsum(size)
        return self.raw_bytes[np.repeat(self.raw_at[at] - end + size, size) + np.arange(end[-1] if len(at) else 0)].tobytes()

    def decode(self, ids) -> str:
        """The text that the ids are a segmentation of."""
        return self.join(np.asarray(ids, np.int32).tobytes())[1:].decode()


@lru_cache(2)
def pieces(path: str = MODEL) -> Pieces:
    return Pieces(path)


def word_key(word: str, seed: int, variant: int) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), (seed * 1_000_003 + variant) & (2**64 - 1))


def skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the candidate that joins start to middle with middle to end is skipped in the word of that key."""
    h = mix(key ^ mix((start.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)))
    return (h >> np.uint64(11)).astype(np.float64) < dropout * 2.0**53


def agenda(p: Pieces, word: str, key: int, dropout: float) -> list[int]:
    """One word through a heap of candidates."""
    sym = p.symbols(word)
    start, end = list(range(len(sym))), list(range(1, len(sym) + 1))
    before, after = [i - 1 for i in range(len(sym))], [i + 1 for i in range(len(sym) - 1)] + [-1]
    heap: list[tuple[int, int, int, int, int]] = []
    k = np.array([key], np.uint64)

    def push(left: list[int], right: list[int]) -> None:
        score, made = p.lookup(np.array([sym[i] for i in left]), np.array([sym[i] for i in right]))
        at = [np.array([x[i] for i in y]) for x, y in ((start, left), (start, right), (end, right))]
        out = skipped(k, *at, dropout) if dropout > 0 else np.zeros(len(left), bool)
        for i, j, s, m, o in zip(left, right, score.tolist(), made.tolist(), out):
            if s > _NONE and not o:
                heapq.heappush(heap, (-s, start[i], start[j], end[j], m))

    if len(sym) > 1:
        push(list(range(len(sym) - 1)), list(range(1, len(sym))))
    while heap:
        _, i, j, e, made = heapq.heappop(heap)
        if sym[i] < 0 or sym[j] < 0 or after[i] != j or end[j] != e:
            continue  # one of its sides has been merged since
        sym[i], sym[j], end[i], after[i] = made, -1, e, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        near = [(a, b) for a, b in ((before[i], i), (i, after[i])) if a >= 0 and b >= 0]
        if near:
            push([a for a, _ in near], [b for _, b in near])
    return p.ids([s for s in sym if s >= 0])


def together(p: Pieces, words: list[str], keys: list[int], dropout: float) -> list[bytes]:
    """Words of at most LONG characters through their agendas side by side; the ids of each as 32-bit integers."""
    n = len(words)
    length = np.fromiter(map(len, words), np.int64, n)
    size = int(length.max())
    sym = np.full((n, size + 1), -1, np.int32)
    sym[np.arange(size + 1) < length[:, None]] = p.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
    live, now = np.arange(n), sym.copy()
    bound = np.tile(np.arange(size + 2, dtype=np.int16), (n, 1))  # where each symbol begins; the next one's begin is its end
    key = np.array(keys, np.uint64)[:, None]
    score, made = p.lookup(now[:, :-1], now[:, 1:])
    if dropout > 0:
        score = np.where(skipped(key, bound[:, :-2], bound[:, 1:-1], bound[:, 2:], dropout), _NONE, score)

    def without(a: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        keep = np.ones(a.shape, bool)
        keep[row, at] = False
        return a[keep].reshape(len(a), -1)

    while True:
        best = score.argmax(1)
        go = score[np.arange(len(live)), best] > _NONE
        if not go.all():
            sym[live[~go], : now.shape[1]], sym[live[~go], now.shape[1] :] = now[~go], -1
            live, best, now, bound, key, score, made = (x[go] for x in (live, best, now, bound, key, score, made))
        if not len(live):
            break
        # each word that is left loses a symbol, so all stay of one width
        row = np.arange(len(live))
        now[row, best] = made[row, best]
        now, bound = without(now, row, best + 1), without(bound, row, best + 1)
        score, made = without(score, row, best), without(made, row, best)
        for side in (best - 1, best):
            r = np.flatnonzero((side >= 0) & (side < score.shape[1]))
            c = side[r]
            x, m = p.lookup(now[r, c], now[r, c + 1])
            if dropout > 0:
                x = np.where(skipped(key[r, 0], bound[r, c], bound[r, c + 1], bound[r, c + 2], dropout), _NONE, x)
            score[r, c], made[r, c] = x, m
    there = sym >= 0
    flat = sym[there].astype(np.int32).tobytes()
    at = np.concatenate(([0], 4 * np.cumsum(there.sum(1)))).tolist()
    out = [flat[i:j] for i, j in zip(at, at[1:])]
    for i in np.flatnonzero((sym >= p.size).any(1)).tolist():
        out[i] = np.array(p.ids(sym[i][there[i]].tolist()), np.int32).tobytes()
    return out


class Encoder:
    """Encodes texts; remembers the segmentations of words.  Those of words and of texts are checked to decode."""

    def __init__(self, path: str = MODEL, seed: int = SEED, dropout: float = DROPOUT):
        self.p, self.seed, self.dropout = pieces(path), seed, dropout
        self.known: list[dict[str, bytes]] = [{} for _ in range(VARIANTS)]
        self.older: list[dict[str, bytes]] = [{} for _ in range(VARIANTS)]

    def learn(self, variant: int, words: set[str]) -> None:
        known, older = self.known[variant], self.older[variant]
        new = words - known.keys()
        if len(known) + len(new) > REMEMBERED // (2 * VARIANTS):
            known, older, new = {}, known, words
            self.known[variant], self.older[variant] = known, older
        again = new & older.keys()
        known.update((w, older[w]) for w in again)
        new = sorted(new - again, key=len)
        for k in range(0, len(new), TOGETHER):
            part = new[k : k + TOGETHER]
            keys = [word_key(w, self.seed, variant) for w in part]
            if len(part[-1]) <= LONG:
                found = together(self.p, part, keys, self.dropout)
            else:
                found = [np.array(agenda(self.p, w, key, self.dropout), np.int32).tobytes() for w, key in zip(part, keys)]
            if self.p.join(b"".join(found)) != "".join(part).encode():
                raise AssertionError("a segmentation does not decode to its word")
            known.update(zip(part, found))

    def encode(self, texts: list[str | None], variants: list[int]) -> list[np.ndarray | None]:
        return [x for x, _ in self.both_ways(texts, variants)]

    def both_ways(self, texts: list[str | None], variants: list[int]) -> list[tuple[np.ndarray | None, int | None]]:
        """The ids of each text, and the CRC-32 of what they decode to, which is the text."""
        split = [[] if not t else self.p.word.findall(" " + t) for t in texts]
        wanted: dict[int, set[str]] = {}
        for v, words in zip(variants, split):
            wanted.setdefault(v, set()).update(words)
        for v, words in wanted.items():
            self.learn(v, words)
        out = []
        for t, v, words in zip(texts, variants, split):
            if t and "".join(words) != " " + t:
                raise AssertionError("the words of a text do not make it up")
            if t is None:
                out.append((None, None))
                continue
            ids = b"".join(map(self.known[v].__getitem__, words))
            text = self.p.join(ids)[1:]
            if text != t.encode():
                raise AssertionError("the ids of a text do not decode to it")
            out.append((np.frombuffer(ids, np.int32), zlib.crc32(text)))
        return out


@lru_cache(1)
def encoder_of(path: str, seed: int, dropout: float) -> Encoder:
    """The encoder of this process; what it remembers serves the next tasks too."""
    return Encoder(path, seed, dropout)


def encoded(path: str, seed: int, dropout: float):
    def go(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, seed, dropout)
        for rows in batch:
            sizes = pc.fill_null(pc.utf8_length(rows["text"]), 0).to_numpy(zero_copy_only=False)
            begin = size = 0
            for i in range(len(rows) + 1):
                if i == len(rows) or size > AT_ONCE:
                    part = rows.slice(begin, i - begin)  # only its texts are Python's at a time
                    done = encoder.both_ways(part["text"].to_pylist(), part["variant"].to_pylist())
                    none = np.array([x is None for x, _ in done], bool)
                    count = np.array([0 if x is None else len(x) for x, _ in done], np.int32)
                    ends = np.concatenate((np.zeros(1, np.int32), np.cumsum(count, dtype=np.int32)))
                    flat = np.concatenate([np.empty(0, np.int32)] + [x for x, _ in done if x is not None])
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(none))
                    crc = pa.array([c for _, c in done], pa.int64())
                    yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(count, pa.int64(), mask=none), ids, crc], ["doc_id", "n_pieces", "ids", "decoded_crc32"])
                    begin, size = i, 0
                if i < len(rows):
                    size += int(sizes[i])
        release()

    return go


def both_ways(docs: DataFrame, path: str = MODEL, seed: int = SEED, dropout: float = DROPOUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_pieces, ids, decoded_crc32)`` of every row; the ids are decoded, checked to give the text again, and the
    CRC-32 of what they gave is kept.

    The id chooses the variant, so reruns agree.  A null text has null ids, an empty one none.  A text's own
    U+2581 becomes three byte pieces and so survives.  Other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(VARIANTS)).cast("int").alias("variant"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encoded(path, seed, dropout), f"doc_id {kind}, n_pieces long, ids array<int>, decoded_crc32 long")


def encode(docs: DataFrame, path: str = MODEL, seed: int = SEED, dropout: float = DROPOUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_pieces, ids)`` of ``both_ways``, with its checks."""
    return both_ways(docs, path, seed, dropout, id_col, text_col).drop("decoded_crc32")


def decode(encoded_rows: DataFrame, path: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` of rows that ``encode`` made."""

    def go(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(path)
        for pdf in batch:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [None if x is None else p.decode(x) for x in pdf["ids"]]})

    kind = encoded_rows.schema["doc_id"].dataType.simpleString()
    return encoded_rows.select("doc_id", "ids").mapInPandas(go, f"doc_id {kind}, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, each row for itself; null and empty texts have no pieces, very long ones are encoded whole."""
    return both_ways(documents(spark, sf_dir))
