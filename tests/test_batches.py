"""Python functions over batches hold a bounded part of what they make."""

import pyarrow as pa
import pytest

from quillwork.operators import chunking as C
from quillwork.operators import vectors as V


def test_chunks_of_a_batch_come_in_parts():
    texts = [None, "", *(" ".join(f"w{(i * 7 + k) % 101}" for k in range(700)) for i in range(1000))]
    given = []
    batch = pa.RecordBatch.from_pydict({"key": [str(i) for i in range(len(texts))], "text": texts})
    for part in C.chunk_batches(iter([batch])):
        assert sum(map(len, part.column("text").to_pylist())) < 2 * C.HELD_CHARACTERS
        given += part.to_pylist()
    assert [(r["source_doc_id"], r["text"]) for r in given] == [(str(i), c["text"]) for i, t in enumerate(texts) for c in C.chunk_text(t)]
    assert len(list(C.chunk_batches(iter([batch])))) > 2


def test_vectors_are_one_array():
    got = V.HashedWords(8).vectors(pa.array(["a b a", None, "", "a"]))
    assert isinstance(got, pa.ListArray) and len(got.values) == 32  # no object a row
    a, none, empty, one = got.to_pylist()
    assert sum(x * x for x in a) == pytest.approx(1) and none == empty == [0.0] * 8 and sorted(one)[-1] == 1.0


def test_a_paper_is_chunked_once(spark):
    from pyspark.sql import functions as F

    from quillwork.plans import build as B

    papers = spark.createDataFrame([(f"p{i}", f"w{i} " * (200 * i)) for i in range(1, 6)], "paper_id string, article string")
    sizes = [len(C.chunk_text(r.article)) for r in papers.collect()]
    for least in (1, 3):
        got = B.chunk_table(papers, V.HashedWords(), least)
        assert got.select("source_doc_id").distinct().count() == sum(x >= least for x in sizes) and got.agg(F.min("word_count")).first()[0] > 0
        assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == (1 if least == 1 else 0)  # kept, where it is used twice
