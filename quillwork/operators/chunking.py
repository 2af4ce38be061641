"""Cutting texts into overlapping chunks.

The word-window chunker is a closed form and stays in SQL functions.  The section-aware one packs sentences one after the
other, each depending on what the last left over; it runs on Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHUNKING
from ..functions import text as T

CHUNK = (
    "chunk_id int, section string, text string, word_count int, original_word_count int, truncated_for_model boolean, "
    "section_index int, chunk_index_in_section int, chunking_method string"
)

#: Characters of texts whose chunks a task holds before it gives them out.
HELD_CHARACTERS = 1_000_000


def window_count(n: Column, size: int = CHUNKING.max_words, overlap: int = CHUNKING.overlap_words, least: int = CHUNKING.min_words) -> Column:
    """Number of windows of a text of n words: one each ``size - overlap`` words till the end is reached; a last one of fewer than
    ``least`` words counts only if it is the first."""
    step = size - overlap
    k = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0))
    return F.when(n <= 0, 0).otherwise(k + 1 - F.when((k > 0) & (n - k * step < least), 1).otherwise(0)).cast("int")


def word_windows(
    docs: DataFrame, text: Column, size: int = CHUNKING.max_words, overlap: int = CHUNKING.overlap_words, least: int = CHUNKING.min_words
) -> DataFrame:
    """``docs`` once a window, with its ``pos``, ``text`` and ``word_count``; no row for a text without words."""
    overlap = min(max(overlap, 0), size - 1)
    step = size - overlap
    w = docs.withColumn("_words", T.words(T.normalize_space(text)))
    w = w.withColumn("_n", window_count(F.size("_words"), size, overlap, least)).where("_n > 0")
    w = w.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    part = F.slice("_words", F.col("pos") * step + 1, F.lit(size))
    return w.withColumns({"text": F.array_join(part, " "), "word_count": F.size(part)}).drop("_words", "_n")


def needs_fallback(chunks: Column, text: Column) -> Column:
    """Whether too few chunks came of a text that is long enough for more."""
    return (chunks < CHUNKING.fallback_below_chunks) & (T.word_count(text) >= CHUNKING.fallback_from_words)


def sections(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """``(key, section_index, section, text)``: lines between headings.  A heading right after another replaces it;
    lines before the first are the Body; sections of fewer than ten words are left out, the others numbered from 0.
    """
    lines = docs.select(key, F.posexplode(F.split(T.text_of(text), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]")).alias("pos", "raw"))
    lines = lines.select(key, "pos", T.normalize_space(F.col("raw")).alias("line")).where("line <> ''")
    lines = lines.withColumn("heads", T.looks_like_heading(F.col("line")))
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns(
        {"s": F.sum(F.col("heads").cast("int")).over(so_far), "title": F.last(F.when(F.col("heads"), F.col("line")), True).over(so_far)}
    )
    body = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    out = lines.where(~F.col("heads")).groupBy(key, "s").agg(F.first("title").alias("title"), F.array_join(body, " ").alias("text"))
    out = out.where(T.word_count(F.col("text")) >= CHUNKING.min_section_words)
    title = T.clean_heading(F.col("title"))
    return out.select(
        key, (F.row_number().over(Window.partitionBy(key).orderBy("s")) - 1).alias("section_index"),
        F.when(F.col("title").isNull() | (title == ""), "Body").otherwise(title).alias("section"), "text",
    )


# The section-aware chunker, for one text.  ``sections`` above and ``section_list`` here follow the same rules.

_HEADING = re.compile(r"(?:\d+(?:\.\d+){0,3}|[IVXLCDM]+)[):.]?\s+([a-zA-Z].+)$")
_SENTENCE = re.compile(r"(?<=[!.?])\s+(?=[(\[0-9A-Z])")


def flat(text: str | None) -> str:
    # str.split() takes the no-break space for white space too
    return " ".join(re.sub(r"\\n|/n", " ", text or "").split())


def is_heading(line: str) -> bool:
    c, w = CHUNKING, line.split()
    if not line or len(line) > c.heading_chars or (line.endswith(".") and len(w) > 3) or len(w) > c.heading_words + 2:
        return False
    if m := _HEADING.match(line):
        return len(m[1].split()) <= c.heading_words
    if line.isupper() and 2 <= len(w) <= 10 or line.lower().strip(" .:") in T.SECTION_NAMES:
        return True
    lettered = [x for x in w if any(map(str.isalpha, x))]
    return len(w) <= 10 and bool(lettered) and sum(x[0].isupper() for x in lettered) >= c.title_share * len(lettered)


def heading_title(line: str) -> str:
    if m := _HEADING.match(line):
        return flat(m[1]).strip(" .:")
    return line.title() if line.isupper() else line.strip(" .:")


def section_list(text: str | None) -> list[tuple[str, str]]:
    out: list[tuple[str, list[str]]] = [("Body", [])]
    for line in map(flat, (text or "").splitlines()):
        if line and is_heading(line):
            out.append((heading_title(line) or "Body", []))
        elif line:
            out[-1][1].append(line)
    joined = [(title, flat(" ".join(lines))) for title, lines in out]
    return [(title, body) for title, body in joined if len(body.split()) >= CHUNKING.min_section_words]


def pack(parts: list[tuple[str, str]], most: int = CHUNKING.max_words, overlap: int = CHUNKING.overlap_words) -> list[dict]:
    """Chunks of the sections: sentences are packed up to ``most`` words; the last ``overlap`` words lead the next chunk.

    A window that is too small when the next sentence doesn't fit is not a chunk of its own, unless the document has none
    yet, but still lends its last words; what is left at the end of a section always is one.
    """
    most = max(20, min(most, CHUNKING.hard_max_words))
    overlap = max(0, min(overlap, most - 1))
    out: list[dict] = []
    for index, (title, body) in enumerate(parts):
        window: list[str] = []
        in_section = 0

        def emit(force: bool) -> list[str]:
            nonlocal in_section
            if force or len(window) >= CHUNKING.min_words or not out:
                kept = window[: CHUNKING.hard_max_words]
                out.append(
                    {
                        "chunk_id": len(out), "section": title or "Body", "text": " ".join(kept), "word_count": len(kept),
                        "original_word_count": len(kept), "truncated_for_model": False, "section_index": index,
                        "chunk_index_in_section": in_section, "chunking_method": "rule_window",
                    }
                )
                in_section += 1
            return window[-overlap:] if overlap else []

        for sentence in _SENTENCE.split(flat(body)):
            w = sentence.split()
            for k in range(0, len(w), most):
                piece = w[k : k + most]
                if window and len(window) + len(piece) > most:
                    window = emit(False)
                if len(window) + len(piece) > most:
                    window = []
                window = window + piece
        if window:
            emit(True)
    return out


def window_list(text: str | None, size: int = CHUNKING.max_words, overlap: int = CHUNKING.overlap_words, least: int = CHUNKING.min_words) -> list[dict]:
    w, out, start = flat(text).split(), [], 0
    while start < len(w):
        part = w[start : start + size]
        if len(part) >= least or not out:
            out.append(
                {
                    "chunk_id": len(out), "section": "Fallback", "text": " ".join(part), "word_count": len(part), "original_word_count": len(part),
                    "truncated_for_model": False, "section_index": 0, "chunk_index_in_section": len(out), "chunking_method": "fallback_word_window",
                }
            )
        if start + size >= len(w):
            break
        start += size - overlap
    return out


def chunk_text(text: str | None) -> list[dict]:
    """Section-aware chunks; word windows instead where those are too few and the windows more."""
    parts = section_list(text)
    if not parts and flat(text):
        parts = [("Body", flat(text))]
    out = pack(parts)
    n = len(flat(text).split())
    if len(out) < CHUNKING.fallback_below_chunks and n >= CHUNKING.fallback_from_words:
        windows = window_list(text)
        if len(windows) > len(out):
            return windows
    return out


_CHUNKS = f"chunk_uid string, source_doc_id string, {CHUNK}"
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of batches of (key, text), some texts at a time, however large a batch is."""
    names = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in _CHUNKS.split(", ")])
    for batch in batches:
        rows: list[dict] = []
        size = 0
        for k, t in zip(batch.column(0), batch.column(1)):  # one text at a time is a Python string
            k, t = k.as_py(), t.as_py()
            rows += [{"source_doc_id": k, "chunk_uid": f"{k}_{c['chunk_id']}"} | c for c in chunk_text(t)]
            size += len(t or "")
            if size >= HELD_CHARACTERS:
                yield pa.RecordBatch.from_pylist(rows, names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, names)


def chunk_documents(docs: DataFrame, key: str = "paper_id", text: str = "article") -> DataFrame:
    """``(chunk_uid, source_doc_id, chunk fields)`` of every text; a text without words has no row."""
    return docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(chunk_batches, _CHUNKS)


def chunk_statistics(chunks: DataFrame, docs: DataFrame, key: str = "paper_id") -> DataFrame:
    """One row: papers, chunks, their least, median, mean and greatest number a paper, papers with at least one and three."""
    per = docs.select(F.col(key).cast("string").alias("k")).join(chunks.groupBy(F.col("source_doc_id").alias("k")).count(), "k", "left")
    n = F.coalesce("count", F.lit(0))
    return per.agg(
        F.count("*").alias("n_papers"), F.sum(n).alias("n_chunks"), F.min(n).alias("min_chunks"), F.median(n).alias("median_chunks"),
        F.round(F.avg(n), 6).alias("mean_chunks"), F.max(n).alias("max_chunks"), F.count_if(n >= 1).alias("at_least_1"), F.count_if(n >= 3).alias("at_least_3"),
    )


def with_least_chunks(docs: DataFrame, chunks: DataFrame, least: int, key: str = "paper_id") -> DataFrame:
    """The documents that have at least so many chunks."""
    enough = chunks.groupBy("source_doc_id").count().where(F.col("count") >= least)
    return docs.join(enough, F.col(key).cast("string") == F.col("source_doc_id"), "left_semi")


def chunk_documents_capped(chunks: DataFrame, most: int = CHUNKING.hard_max_words) -> DataFrame:
    """Chunks as documents: at most ``most`` words each, empty ones left out, with the length before and a flag."""
    n = T.word_count(F.col("text"))
    out = chunks.withColumns({"original_word_count": n, "text": T.truncate_words(F.col("text"), most)})
    out = out.withColumns({"word_count": T.word_count(F.col("text")), "truncated_for_model": F.col("original_word_count") > most})
    return out.where("text <> ''")
