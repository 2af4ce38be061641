"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillwork.llm import exact_dedup, line_dedup, lm_score, mixing, sentencepiece_bpe, sharding, simhash_dedup, spotsigs, toxicity, url_filter

LONG = "lorem ipsum dolor " * 20_000
ROWS = [
    (1, "one two  three four five six", "en", "a", 9), (2, "one two\tthree four five six", "en", "a", 9), (2, "one two\tthree four five six", "en", "a", 9),
    (3, None, None, None, None), (4, "", "en", "b", 0), (None, "null id here now with words", "en", "b", 3), (5, LONG, "de", None, 1), (6, "x", "en", "a", 1),
    (7, " \n  ", "en", "c", 3), (8, "Äpfel 😀 ▁ und  mehr\n\nÄpfel", "de", "c", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "keep_id kept group_size text_sha256 size taken target shard slot row class_id component score predicted node key sig _qw_h variant ids n".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_exact_dedup(docs, none):
    for hot in (4096, 1):  # also with every text split
        got = {(r.doc_id, r.text): r for r in exact_dedup.exact_dedup(docs, hot=hot).collect()}
        kept = exact_dedup.exact_dedup(docs, hot=hot).where("kept").select("doc_id").collect()
        assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 5, 6, 7, 8] and len(kept) == 7
        r = got[2, "one two\tthree four five six"]
        assert (r.keep_id, r.group_size) == (1, 3) and r.text_sha256 == hashlib.sha256(b"one two three four five six").hexdigest()
        assert got[4, ""].keep_id == 3 and got[None, "null id here now with words"].keep_id is None
    assert exact_dedup.exact_dedup(none).count() == 0


def test_sharding(docs, none):
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(ROWS) and len({(r.shard, r.slot) for r in got}) == len(ROWS)
    sizes = [sum(r.shard == k for r in got) for k in range(4)]
    assert max(sizes) - min(sizes) <= 1 and all({r.slot for r in got if r.shard == k} == set(range(sizes[k])) for k in range(4))
    by = {r.doc_id: r for r in got}
    assert (by[3].size, by[3].text_crc32) == (1, 0) and by[8].text_crc32 == zlib.crc32(ROWS[9][1].encode()) and by[8]["size"] == len(ROWS[9][1].encode()) + 1
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, sharding.shard(docs.repartition(5), 4).collect()), key=repr)
    assert sharding.shard(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1000])
def test_permutation(spark, n):
    got = spark.range(n).select(sharding.permute(spark, F.col("id"), n).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 3 * r["size"] for r in got)
    for s in {r.source for r in got}:
        rows = [r for r in got if r.source == s]
        assert sum(r.taken for r in rows) == int(rows[0].target + 0.5) and sum(r["size"] for r in rows) == rows[0].source_size
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_targets():
    assert mixing.targets([("a", 10), ("b", 100)]) == {"a": 30.0, "b": 80.0}
    assert mixing.targets([(None, 60), ("a", 60), ("b", 60)]) == {"a": 30.0, "b": 60.0, None: 90.0}
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_near_classes(docs, none):
    got = {r.doc_id: r for r in simhash_dedup.near_classes(docs).collect()}
    assert got[2].class_id == 1 and got[1].class_size == 3 and got[4].class_id == 3 and got[7].class_id == 3 and got[5].class_id == 5 and got[None].class_size == 1
    kept = simhash_dedup.without_near_copies(docs)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 5, 6, 8] and kept.columns == docs.columns
    assert simhash_dedup.near_classes(none).count() == 0


def test_spotsigs(docs, none):
    got = [r for r in spotsigs.compare_with_next(docs).collect()]
    assert len(got) == len(ROWS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[4].fingerprint == by[3].fingerprint == "" and by[4].near_next == 1.0
    text, after = ROWS[9][1], " \n  "
    edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
    assert by[8].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and by[8].n_chars == len(text)
    assert spotsigs.compare_with_next(none).count() == 0 and spotsigs.similar(none).count() == 0


def test_encoding(docs, none):
    rows = sentencepiece_bpe.encode(docs)
    got = {r.doc_id: r for r in rows.collect()}
    assert got[3].ids is None and got[4].ids == [] and got[3].n_pieces is None
    back = {r.doc_id: r.text for r in sentencepiece_bpe.decode(rows).collect()}
    assert all(back[i] == t for i, t, *_ in ROWS)
    assert sentencepiece_bpe.encode(none).count() == 0


def test_line_dedup(docs, none):
    got = {r.doc_id: r for r in line_dedup.fuzzy_lines(docs).where("doc_id is not null").collect()}
    assert (got[8].n_lines, got[8].n_kept, got[8].dropped) == (3, 3, []) and got[3].n_lines == 1 and got[1].n_kept == 1
    assert sum(r.n_kept for r in line_dedup.fuzzy_lines(docs).where("doc_id = 2").collect()) == 0
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.count() == len(ROWS) and kept.columns == docs.columns  # rows that repeat an id don't multiply
    assert line_dedup.fuzzy_lines(none).count() == 0 and line_dedup.without_repeated_lines(none).columns == docs.columns


def test_lm_score(docs, none):
    words, net = lm_score.fit(docs)
    got = {r.doc_id: r for r in lm_score.score(docs, words, net).collect()}
    assert got[3].log_probability == 0 and got[3].per_word is None and got[1].per_word < 0 and got[5].n_words == 60_000
    assert lm_score.score(none, *lm_score.fit(none)).count() == 0


def test_sentencepiece_decodes_in_the_query(docs, monkeypatch):
    got = {r.doc_id: r.decoded_crc32 for r in sentencepiece_bpe.both_ways(docs).collect()}
    assert got == {i: None if t is None else zlib.crc32(t.encode()) for i, t, *_ in ROWS}
    e = sentencepiece_bpe.Encoder()
    e.encode(["some words"], [0])
    e.known[0][" words"] = e.known[0][" some"]
    with pytest.raises(AssertionError, match="ids of a text"):
        e.encode(["some words"], [0])
    good = sentencepiece_bpe.together
    monkeypatch.setattr(sentencepiece_bpe, "together", lambda *x: [good(*x)[0][:0], *good(*x)[1:]])
    with pytest.raises(AssertionError, match="segmentation"):
        sentencepiece_bpe.Encoder().encode(["some words"], [0])


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (5, None), (6, 0)], "doc_id long, toxic int")
    assert toxicity.without_toxic(docs, labels).count() == len(ROWS)
    assert toxicity.without_toxic(none, labels.limit(0)).columns == docs.columns
    # with a real lexicon: nulls, ties, repeated rows and a text of many words beside it
    def text(i, more):
        rng = random.Random(i)
        w = [f"w{rng.randrange(150)}" for _ in range(40)]
        for x in rng.sample(more, len(more) // 2):
            w.insert(rng.randrange(10, 30), x)
        return " ".join(w)

    bad = [(100 + i, text(i, "idiot scum moron clown trash loser".split()), "en", "a", 1) for i in range(60)]
    good = [(200 + i, text(200 + i, []), "en", "a", 1) for i in range(90)]
    rows = spark.createDataFrame([*ROWS, *bad, *good, *bad[:2]], SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES})
    labels = spark.createDataFrame([(i, 1) for i, *_ in bad] + [(i, 0) for i, *_ in good] + [(200, None), (None, 1), (100, 1)], "doc_id long, toxic int")
    lexicon = toxicity.induce(rows, labels)
    assert len(lexicon.words)
    kept = toxicity.without_toxic(rows, labels)
    assert kept.columns == rows.columns and kept.where("doc_id >= 200").count() == 90 and kept.where("doc_id between 100 and 199").count() == 0
    assert kept.where("doc_id is null or doc_id < 100").count() == len(ROWS)
    assert toxicity.without_toxic(rows.limit(0), labels).count() == 0


def test_url_filter(spark):
    rows = [(1, None, None), (1, None, None), (2, "no url", "<link"), (3, "http://A.example.ORG/es/x?y#z", ""), (4, "http://q.com", "x" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = sorted(url_filter.filter_urls(pages).collect(), key=lambda r: r.page_id)
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.org", "/es/x", "example.org/es/", "block"), ("q.com", "", None, "allow"),
    ]
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_stages(spark, docs, none, data):
    for given in (docs, none):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, data)
            if name != "sentencepiece":
                assert out.columns == given.columns, name
            now = out
        assert now.count() == (0 if given is none else now.count())
