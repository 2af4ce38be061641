"""Chunking, vectors, distractors, assembly, metrics, reports, readers and writers."""

import json
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwork.operators import assemble as A
from quillwork.operators import chunking as C
from quillwork.operators import metrics as M
from quillwork.operators import noise as N
from quillwork.operators import reports as P
from quillwork.operators import vectors as V
from quillwork.sources import readers, writers


@pytest.mark.parametrize("n, chunks", [(0, 0), (1, 1), (150, 1), (151, 1), (159, 1), (160, 2), (270, 2), (279, 2), (280, 3)])
def test_window_count(spark, n, chunks):
    text = " ".join(map(str, range(n)))
    df = spark.createDataFrame([(1, text)], "k int, t string")
    got = [r.text for r in C.word_windows(df, F.col("t")).orderBy("pos").collect()]
    assert len(got) == chunks and got == [c["text"] for c in C.window_list(text)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 900))
def test_windows_lose_only_a_short_tail(n):
    words = set(map(str, range(n)))
    got = {w for c in C.window_list(" ".join(map(str, range(n)))) for w in c["text"].split()}
    assert len(words - got) < 40


def test_section_chunks():
    text = "1. Introduction\n" + "Alpha beta gamma. " * 60 + "\nMETHODS USED\n" + "One two three four. " * 5 + "\nRESULTS HERE\nshort one"
    parts = C.section_list(text)
    assert [t for t, _ in parts] == ["Introduction", "Methods Used"]
    chunks = C.pack(parts)
    assert [c["section"] for c in chunks] == ["Introduction", "Introduction", "Methods Used"]
    assert all(c["word_count"] <= 150 for c in chunks) and [c["chunk_id"] for c in chunks] == [0, 1, 2]
    assert chunks[1]["text"].split()[:30] == chunks[0]["text"].split()[-30:]
    assert C.chunk_text("") == [] and C.chunk_text(None) == []


def test_sections_agree(spark):
    text = "lead words here and more of them to count ten words.\nI. Intro\nRELATED WORK\n" + "body text of it. " * 9
    df = spark.createDataFrame([("d", text)], "k string, t string")
    got = [(r.section, r.text) for r in C.sections(df, "k", F.col("t")).orderBy("section_index").collect()]
    assert got == C.section_list(text)


def _vectors(spark):
    rows = [(i, [float(i == 0), float(i == 1), 0.5 * (i == 2) + 0.1 * i]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    return spark.createDataFrame([(7, [1.0, 0.2, 0.1])], "query_id long, embedding array<double>"), docs


def test_top_k_and_mmr(spark):
    q, docs = _vectors(spark)
    top = V.search(q, docs, 3).orderBy("rank").collect()
    assert [r.doc_id for r in top] == [0, 1, 2] and top[0].score == pytest.approx(1.0)
    assert V.search(q, docs, 99).count() == 5 and V.search(q, docs, 0).count() == 0
    only = V.retrieve(q, docs, 3, weight=1.0).orderBy("rank").collect()
    assert [r.doc_id for r in only] == [0, 1, 2]  # relevance alone is top-k
    with pytest.raises(ValueError):
        V.mmr(docs, 3, 2.0)
    hard = V.hard_negatives(q, docs, 2, skip=2)
    assert {r.doc_id for r in hard.collect()} <= {2, 3, 4}
    assert V.training_contexts(q, docs, 2, 2).count() == 4


def test_bands_and_statuses(spark):
    s = spark.createDataFrame([(1, i, i / 100) for i in range(101)] + [(1, 999, float("nan"))], "query_id int, doc_id int, score double")
    easy, hard = (N.band(s, m).agg(F.min("score"), F.max("score")).first() for m in ("cross_doc_easy", "cross_doc_hard"))
    assert 0.69 <= easy[0] <= 0.71 and 0.94 <= easy[1] <= 0.96 and hard[0] == -1.0 and hard[1] <= 0.1
    with pytest.raises(ValueError):
        N.band(s, "other")
    x = spark.range(1).select(N.status(F.lit("cross_doc_easy"), F.lit(2), F.lit(1), F.lit(9), F.lit(9)), N.status(F.lit("odd"), F.lit(2), F.lit(1), F.lit(9), F.lit(9))).first()
    assert tuple(x) == ("cross_doc_easy_partial", "invalid_noise_mode:odd")


def test_distractors_are_of_other_sources(spark):
    papers = spark.createDataFrame([(f"p{i}", 0) for i in range(6)], "paper_id string, query_id int")
    pool = spark.createDataFrame([(f"p{i}_{k}", f"p{i}") for i in range(6) for k in range(2)], "doc_id string, source_doc_id string")
    clean = spark.createDataFrame([("p0", "p1_0"), ("p0", "p2_1")], "paper_id string, doc_id string")
    got = N.sample(papers, pool, None, "cross_document", 10, clean=clean).collect()
    by = {p: {r.doc_id for r in got if r.paper_id == p} for p in ("p0", "p3")}
    assert by["p0"] == {f"p{i}_{k}" for i in range(1, 6) for k in range(2)} - {"p1_0", "p2_1"}
    assert by["p3"] == {f"p{i}_{k}" for i in (0, 1, 2, 4, 5) for k in range(2)}
    assert N.sample(papers, pool, None, "cross_document", 2).groupBy("paper_id").count().where("count <> 2").isEmpty()


def test_target_filter(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [("a", words(19)), ("a", words(20)), ("a", words(512)), ("a", words(513)), ("", ""), ("a", None)]
    df = spark.createDataFrame(rows, "article string, target string")
    got = [r.r for r in df.select(A.drop_reason(F.col("article"), F.col("target")).alias("r")).collect()]
    assert got == ["too_short", None, None, "too_long", "empty_article", "empty_target"]


def test_pools():
    assert A.pool_range("heldout_train_tail", 100, 40, 30) == (40, 70)
    assert A.pool_range("legacy_train_pool", 100, 40, 30) == (0, 30)
    for bad in (("heldout_train_tail", 30, 40, 10), ("other", 10, 1, 1), ("heldout_train_tail", 100, 40, -1)):
        with pytest.raises(ValueError):
            A.pool_range(*bad)
    with pytest.raises(ValueError):
        A.pool_range("heldout_train_tail", 100, 40, 10, 20)
    with pytest.raises(ValueError):
        A.disjoint((0, 10), (9, 12))
    assert A.unique_request(0) == 0 and A.unique_request(10, 1.35) == 1013


def test_positions(spark):
    df = spark.createDataFrame([(x,) for x in (5, -3, 1000, 7, 8)], "id long")
    assert [r.pos for r in A.positions(df, "id").orderBy("id").collect()] == [0, 1, 2, 3, 4]
    assert [r.id for r in A.position_range(df, "id", 1, 3).orderBy("id").collect()] == [5, 7]


def test_examples_and_rejects(spark):
    df = spark.createDataFrame([("q", ["a b", " "], "t"), ("q", [" "], "t"), ("q", ["a"], "")], "q string, c array<string>, t string")
    good, bad = A.examples(df, F.col("q"), F.col("c"), F.col("t"))
    assert good.first().input_text == "summarize: question: q context: a b"
    assert sorted(r.reject_reason for r in bad.collect()) == ["empty_contexts", "empty_target"]


def test_controls_and_schema(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("", 3)], "paper_id string, n int")
    b = spark.createDataFrame([("x", 4), ("y", 5)], "paper_id string, n int")
    got = A.unique_controls(a, b, 2, "n").collect()
    assert [(r.paper_id, r.n, r.clean_control_source) for r in got] == [("x", 1, "primary"), ("y", 5, "extra")]
    with pytest.raises(ValueError):
        A.unique_controls(a, b, 3, "n")
    assert A.repeated_controls(a, 3).count() == 9
    u = A.one_schema(a, spark.createDataFrame([(None, ["c"])], "noise_mode string, context_chunk_ids array<string>")).collect()
    assert all(r.noise_mode == "clean" and r.context_chunk_ids is not None for r in u)
    assert A.marked(u and A.one_schema(a, spark.createDataFrame([("m",)], "noise_mode string")), "substitutive").where("noise_mode = 'm_substitutive'").count() == 1


def test_budget(spark):
    df = spark.createDataFrame([(["w " * 300, "v " * 50, "u " * 10],)], "c array<string>")
    got = df.select(A.fit_contexts(F.col("c"), 260, 220, 32).alias("x")).first().x
    assert [len(t.split()) for t in got] == [220, 40]


@pytest.mark.parametrize(
    "flags, mrr, hit1, p3, r3, n3",
    [([1, 1, 1], 1, 1, 1, 1, 1), ([0, 0, 1], 1 / 3, 0, 1 / 3, 1, 0.5), ([0, 0], 0, 0, 0, 0, 0), ([0, 1, 1, 0, 1], 0.5, 0, 2 / 3, 2 / 3, (1 / 1.584962500721156 + 0.5) / (1.5 + 1 / 1.584962500721156))],
)
def test_flags(spark, flags, mrr, hit1, p3, r3, n3):
    df = spark.createDataFrame([(flags,)], "f array<int>")
    m = df.select(M.flags_at_k(F.col("f")).alias("m")).first().m.asDict()
    assert [m["mrr"], m["hit@1"], m["precision@3"], m["recall@3"], m["ndcg@3"]] == pytest.approx([mrr, hit1, p3, r3, n3])


def test_published_shares(spark):
    """A context of three own chunks and two distractors: precision at 5 is 0.6, and recall at 1 a third of hit at 1."""
    df = spark.createDataFrame([([1, 0, 1, 0, 1],)], "f array<int>")
    m = df.select(M.flags_at_k(F.col("f")).alias("m")).first().m.asDict()
    assert m["precision@5"] == pytest.approx(0.6) and m["recall@1"] == pytest.approx(m["hit@1"] / 3) and m["ndcg@5"] == m["ndcg@10"]


def test_record_metrics(spark):
    row = ("the source of Big Data in 2020 words", "Big Data of 2020", "Big Data words words", [1, 0, 1], [1, 1], 2, 5)
    df = spark.createDataFrame([row, (None, None, None, [], None, None, None)], "input_text string, target_text string, prediction_text string, context_hit_flags array<int>, retrieved_hit_flags array<int>, num_noise_chunks int, num_contexts int")
    a, b = M.record_metrics(df).collect()
    assert a.entity_f1_ref == 1 and a.source_supported_entity_rate == 1 and a.noise_chunk_ratio == pytest.approx(0.4) and a["context_recall@3"] == 1
    assert a.distinct_1 == pytest.approx(0.75) and a.number_recall_ref == 0 and a.rouge1 > 0 and a.bertscore_f1 is None
    assert b.source_supported_entity_rate is None and b.unsupported_entity_rate == 0 and b.novel_2gram_ratio == 1 and b.context_mrr is None and b.noise_chunk_ratio is None


def test_alignment(spark):
    x = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "paper_id_norm string, value double")
    y = spark.createDataFrame([("c", 3.0)], "paper_id_norm string, value double")
    assert P.align(x, y).count() == 0
    assert P.align(x, y, positional=True).first().diff == -2.0


def test_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\tc\n\tx\nlone\n d \t e\n")
    assert [tuple(r) for r in readers.tab_separated(spark, str(tmp_path / "t.tsv")).collect()] == [("a", "b"), ("d", "e")]
    df = spark.createDataFrame([("i", "t"), ("", "t"), ("j", None)], "input_text string, target_text string")
    p = str(tmp_path / "x")
    assert writers.json_lines(df, p) and not writers.json_lines(df, p, overwrite=False)
    assert readers.json_lines(spark, p, limit=2).count() == 2
    sets = readers.data_set(spark, p, p)
    assert sets["train"].count() == 1
    v = readers.validate(df).first()
    assert (v.n, v.empty_input, v.empty_target) == (3, 1, 1)
    writers.csv(df.withColumn("l", F.array(F.lit(1))), str(tmp_path / "c"))
    writers.manifest(spark, {"a": [1]}, str(tmp_path / "m.json"))
    assert '"a"' in (tmp_path / "m.json").read_text()
    assert writers.workbook({"s": df}, str(tmp_path / "b"))
    cells = spark.createDataFrame([("[1, 2]",), (" ",), ("x{",)], "c string").select(readers.json_cell(F.col("c"), "array<int>").alias("x")).collect()
    assert [r.x for r in cells] == [[1, 2], None, None]


def test_arrow_files(spark, tmp_path):
    import pyarrow as pa

    t = pa.table({"article": ["a", "b"], "abstract": [["x", " "], ["y"]]})
    with pa.OSFile(str(tmp_path / "data.arrow"), "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
        w.write_table(t)
    got = readers.papers(readers.arrow_table(spark, str(tmp_path))).collect()
    assert [(r.article, r.abstract) for r in got] == [("a", "x"), ("b", "y")]


def test_data_set_files(spark, tmp_path):
    df = spark.createDataFrame([("test", "additive", "cross_doc_easy"), ("test", "clean", "clean"), ("train", "clean", "clean")], "split string, noise_design string, noise_mode string")
    writers.data_set(df, str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    assert [writers.data_file(table, n).count() for n in ("test_noisy_easy", "test_clean", "train", "test_noisy_hard")] == [1, 1, 1, 0]


def test_evaluation_end_to_end(spark, tmp_path):
    from quillwork.plans import evaluate as E

    models = [E.Model("bart_noise", "BART", "noiseaware"), E.Model("bart_clean", "BART", "clean_matched")]
    files = ("test_clean.jsonl", "test_noisy_easy_additive.jsonl", "test_noisy_easy_substitutive.jsonl")
    for m in models:
        for k, f in enumerate(files):
            rows = [(f"test_{i}", f"Alice met Bob in Paris {i}. They spoke of models number {i}.", f"Alice met Bob {i}.", f"Alice met {'Bob' if (i + k) % 2 else 'Eve'} {i}.", [1, 0], [1]) for i in range(12)]
            df = spark.createDataFrame(rows, "paper_id string, input_text string, target_text string, prediction_text string, context_hit_flags array<int>, retrieved_hit_flags array<int>")
            df.write.json(E.prediction_path(str(tmp_path / "in"), m, f))
    got = E.predictions(spark, str(tmp_path / "in"), models, files)
    made = E.evaluate(got, str(tmp_path / "out"), bootstrap=False)
    assert {r["n"] for r in made["summary"].collect()} == {12} and made["compact"].count() == 6
    assert {r["comparison"] for r in made["degradation"].collect()} == {"noisy_minus_clean_test"}
    assert {r["condition"] for r in made["truncation"].collect()} == {"clean", "easy_additive", "easy_substitutive"}
    assert spark.read.option("header", True).csv(str(tmp_path / "out/records.csv")).count() == 72
    assert (tmp_path / "out/config.json").exists() and all((tmp_path / f"out/{name}.csv").exists() for name in made)
    with pytest.raises(FileNotFoundError):
        E.predictions(spark, str(tmp_path / "in"), models)


def test_prediction_hook(spark, tmp_path):
    from quillwork.plans import evaluate as E

    rows = spark.createDataFrame([("a", "one two three"), ("b", "")], "paper_id string, input_text string")
    m = E.Model("k", "T5", "clean_matched")
    first = lambda texts: texts.str.split().str[0].fillna("")
    assert E.predict(rows, str(tmp_path), m, "test_clean.jsonl", first) and not E.predict(rows, str(tmp_path), m, "test_clean.jsonl", first)
    got = E.predictions(spark, str(tmp_path), [m], ("test_clean.jsonl",))
    assert {(r.paper_id, r.prediction_text, r.architecture) for r in got.collect()} == {("a", "one", "T5"), ("b", "", "T5")}


def test_cells_and_sections(spark, tmp_path):
    cells = spark.createDataFrame([('{"a": 1}',), ("plain \"text",), (" ",), (None,), ("[1, 2]",)], "c string")
    assert [r.v for r in cells.select(readers.json_cell_or_text(F.col("c")).cast("string").alias("v")).collect()] == ['{"a":1}', 'plain "text', None, None, "[1,2]"]
    absent = readers.validate_file(spark, str(tmp_path / "none.jsonl")).first()
    assert absent["exists"] is False and absent["n"] is None
    row = spark.createDataFrame([("Method", "text"), (None, "text")], "s string, t string").select(A.with_section(F.col("s"), F.col("t")).alias("x")).collect()
    assert [r.x for r in row] == ["[Method] text", "text"]


def _papers(n, words=700):
    return [(i, " ".join(f"w{(i * 31 + k * k) % 997}" for k in range(words)), " ".join(f"w{(i + k) % 97}" for k in range(30))) for i in range(n)]


@pytest.mark.parametrize("control", ["repeat", "unique"])
def test_data_set_end_to_end(spark, tmp_path, control):
    from quillwork.plans import build as B

    papers = lambda n: spark.createDataFrame(_papers(n), "doc_id long, article string, abstract string")
    o = B.Options(train_limit=3, valid_limit=2, test_limit=2, noise_pool_limit=3, test_pool_offset=7, control=control)
    table = B.build_data_set(papers(40), papers(20), papers(3), str(tmp_path), o=o)
    n = {name: spark.read.json(str(tmp_path / f"{name}.jsonl")).count() for name in writers.FILES}
    assert n["train"] == n["train_noiseaware"] == n["train_clean_matched"] == 9 and n["valid"] == n["valid_clean_matched"] == 6
    assert n["test_clean"] == n["test_noisy_easy"] == n["test_noisy_hard_substitutive"] == 2
    test = table.where("split = 'test'").collect()
    pool = {f"train_{k}" for k in range(7, 10)}
    for r in test:
        own = [s for s, h in zip(r["context_source_doc_ids"], r["context_hit_flags"]) if h]
        other = [s for s, h in zip(r["context_source_doc_ids"], r["context_hit_flags"]) if not h]
        assert set(own) == {r["paper_id"]} and set(other) <= pool and len(other) == r["num_noise_chunks"] == (0 if r["noise_mode"] == "clean" else 2)
        assert len(own) == (1 if r["noise_design"] == "substitutive" else 3) and r["retrieval_hits@3"] == len(own)
        assert r["context_precision@5"] == pytest.approx(len(own) / len(r["context_chunk_ids"]))
    if control == "unique":
        ids = [r.paper_id for r in table.where("train_setting = 'clean_matched' and split = 'train'").collect()]
        assert len(set(ids)) == 9
    told = [json.loads((tmp_path / f"{name}.json").read_text()) for name in ("options", "target_filter", "noise_pool", "test_noise_pool", "checks", "manifest")]
    assert told[2]["begin"] == 3 and told[3]["begin"] == 7 and told[4]["train"]["n"] == 9 and set(told[5]["files"]) == set(writers.FILES)
