"""Word shingles of many texts at once, in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words of a shingle.
WORDS = 5
#: Bytes of text that are worked on together; what a batch needs beside them is a fixed multiple.
BATCH_BYTES = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True
_WORD[128:] = True
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def release() -> None:
    """Gives memory that is free back to the system, as a worker lives on beside the executor after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def batches(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts in lower case, as bytes, each with the place of its first."""
    out, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = (t or "").lower().encode("utf-8", "surrogatepass")
        if out and size + len(b) > BATCH_BYTES:
            yield first, out
            out, size, first = [], 0, i
        out.append(b)
        size += len(b)
    if out:
        yield first, out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and the number of words of each text.

    Words are runs of letters, digits, the underscore and bytes of other scripts.
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    is_word = _WORD[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False])).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    count = np.diff(np.searchsorted(begin, np.concatenate(([0], np.cumsum(lengths)))))
    if not len(begin):
        return np.empty(0, np.uint64), count
    size = end - begin
    at = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(size.sum(), dtype=np.int64) - np.repeat(at, size)
    power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
    h = np.add.reduceat((buf[is_word].astype(np.uint64) + np.uint64(1)) * power[place], at)
    return mix(h ^ size.astype(np.uint64)), count


def shingle_hashes(words: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every shingle of each text in the text's order, repeated ones too, and how many each text has."""
    many = np.where(count > 0, np.maximum(count - WORDS + 1, 1), 0)
    doc = np.repeat(np.arange(len(count)), many)
    last = np.cumsum(count)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(last - count, many)
    h = np.zeros(len(at), np.uint64)
    padded = np.concatenate((words, np.zeros(WORDS, np.uint64)))
    for j in range(WORDS):
        h += np.where(at + j < last[doc], padded[at + j], np.uint64(0)) * _PLACE[j]
    return mix(h), many


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, one text after the other; and where each text begins.

    A text of fewer than five words has one shingle of all its words; one without words has none.
    """
    h, many = shingle_hashes(*word_hashes(texts))
    doc = np.repeat(np.arange(len(texts)), many)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))
