"""The data-set build as one plan: filter, chunk, encode, retrieve, distract, assemble; and all splits, controls and files of it."""

from __future__ import annotations

import argparse
import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BUILD, K_VALUES, QUERIES, SEED
from ..functions import text as T
from ..operators import assemble as A
from ..operators import chunking as C
from ..operators import noise as N
from ..operators import vectors as V
from ..operators.places import kept
from ..sources import readers, writers


def chunk_table(papers: DataFrame, encoder: V.Encoder, least: int = BUILD.min_chunks) -> DataFrame:
    """Chunks with their vectors, of the papers (paper_id, article) that have at least ``least``."""
    chunks = C.chunk_documents_capped(C.chunk_documents(papers))
    if least > 1:  # a paper with chunks has one
        chunks = kept(chunks)  # counted and taken, and cut once
        enough = chunks.groupBy("source_doc_id").count().where(F.col("count") >= least).select("source_doc_id")
        chunks = chunks.join(enough, "source_doc_id", "left_semi")
    return chunks.withColumn("embedding", encoder.encode(F.col("text"))).withColumn("doc_id", F.col("chunk_uid"))


def clean_contexts(papers: DataFrame, chunks: DataFrame, encoder: V.Encoder, k: int = BUILD.final_k) -> DataFrame:
    """``(paper_id, query_id, doc_id, source_doc_id, score, rank)``: each paper's own chunks by MMR for its query."""
    spark = papers.sparkSession
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string").withColumn("_q", encoder.encode(F.col("query")))
    asked = papers.select("paper_id", T.choose_query(F.col("paper_id")).alias("query")).join(F.broadcast(queries), "query")  # three rows
    scored = asked.join(chunks.select("source_doc_id", "doc_id", "embedding"), F.col("paper_id") == F.col("source_doc_id"))
    scored = scored.withColumn("score", F.round(V.dot(F.col("_q"), F.col("embedding")), 6))
    best = V.top_k(scored, max(5 * k, 50), by=("paper_id",))
    chosen = V.mmr(best.select(F.col("paper_id").alias("query_id"), "doc_id", "score", "embedding"), k)
    ids = asked.select("paper_id", "query_id")
    out = chosen.withColumnRenamed("query_id", "paper_id").join(ids, "paper_id")
    return out.withColumn("source_doc_id", F.col("paper_id"))


def pool_scores(pool: DataFrame, encoder: V.Encoder) -> DataFrame:
    """``(query_id, doc_id, score)`` of every chunk of the pool, once for each of the three queries."""
    queries = pool.sparkSession.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    return V.scores(queries.withColumn("embedding", encoder.encode(F.col("query"))), pool)


def build(papers: DataFrame, pool: DataFrame, split: str, encoder: V.Encoder | None = None, design: str = "additive", least: int = BUILD.min_chunks, modes: tuple[str, ...] | None = None) -> DataFrame:
    """Example rows of ``papers`` (paper_id, article, abstract): a clean one each, an easy and a hard noisy one where
    distractors were found (or one of the ``modes``).  ``pool`` (paper_id, article) is where those come from; ids must differ across both.

    Each row has the counts and measures of what was retrieved (``retrieval_``) and of its whole context (``context_``) against the paper's chunks."""
    encoder = encoder or V.HashedWords()
    papers = papers.withColumn("split", F.lit(split)).where(A.drop_reason(F.col("article"), F.col("abstract")).isNull())
    chunks = kept(chunk_table(papers, encoder, least))
    distractors = kept(chunk_table(pool, encoder, 1))
    k = BUILD.final_k if design == "additive" else BUILD.substitutive_clean_k
    asked = kept(clean_contexts(papers, chunks, encoder, k))
    gold = chunks.groupBy(F.col("source_doc_id").alias("paper_id")).agg(F.sort_array(F.collect_list("doc_id")).alias("relevant_chunk_ids"))
    found = asked.groupBy("paper_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "source_doc_id", "score"))), lambda x: x).alias("r")
    )
    scored = kept(pool_scores(distractors, encoder))
    texts = chunks.select("doc_id", "text").unionByName(distractors.select("doc_id", "text"))
    modes = modes or (("clean", "cross_doc_easy", "cross_doc_hard") if design == "additive" else ("cross_doc_easy", "cross_doc_hard"))
    parts = []
    for mode in modes:
        if mode == "clean":
            noise = asked.select("paper_id", "doc_id", "source_doc_id", F.lit(1).alias("pick")).limit(0)
        else:
            noise = N.sample(asked.select("paper_id", "query_id").distinct(), distractors, scored, mode, clean=asked.select("paper_id", "doc_id"))
        context = N.contexts(asked, noise, shuffle=mode != "clean")
        if mode != "clean":
            context = context.where("has_noise")
        told = context.select("paper_id", F.posexplode("context_ids").alias("pos", "doc_id")).join(texts, "doc_id")
        told = told.groupBy("paper_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("contexts"))
        rows = papers.join(context, "paper_id").join(told, "paper_id").join(found, "paper_id").join(gold, "paper_id")
        rows, _ = A.examples(rows, T.choose_query(F.col("paper_id")), F.col("contexts"), F.col("abstract"))
        some = F.lit(1)  # a row with distractors had vectors and scores
        status = N.status(F.lit(mode), F.lit(0 if mode == "clean" else BUILD.noise_k), F.col("num_noise"), some, some)
        rows = rows.select(
            "input_text", "target_text", "paper_id", "split", F.lit("clean" if mode == "clean" else "noisy").alias("sample_type"),
            F.lit(mode).alias("noise_mode"), status.alias("noise_source"), F.size("context_ids").alias("num_contexts"), F.col("num_noise").alias("num_noise_chunks"),
            F.col("r.doc_id").alias("retrieved_chunk_ids"), F.col("r.source_doc_id").alias("retrieved_source_doc_ids"), F.col("r.score").alias("retrieved_scores"),
            "relevant_chunk_ids", F.filter("context_ids", lambda x, i: F.get(F.col("hit_flags"), i) == 0).alias("noise_chunk_ids"), F.col("context_ids").alias("context_chunk_ids"), F.col("context_sources").alias("context_source_doc_ids"),
            F.col("hit_flags").alias("context_hit_flags"), F.transform("r", lambda _: F.lit(1)).alias("retrieved_hit_flags"),
        )
        rows = A.retrieval_payload(rows, "retrieved_chunk_ids", "retrieved_source_doc_ids", "retrieved_scores", "relevant_chunk_ids")
        rows = A.retrieval_payload(rows.withColumn("_scores", F.array().cast("array<double>")), "context_chunk_ids", "context_source_doc_ids", "_scores", "relevant_chunk_ids", "context_")
        rows = rows.drop("_scores", "context_scores")
        # the retrieval's measures under their short names too
        rows = rows.withColumns({f"{m}@{k}": F.col(f"`retrieval_{m}@{k}`") for m in ("precision", "recall") for k in K_VALUES})
        parts.append(A.marked(rows, "clean" if mode == "clean" else design))
    return A.one_schema(*parts)


def gated(rows: DataFrame, easy: float = 1.0, hard: float = 1.0, seed: int = SEED) -> DataFrame:
    """Clean rows, and each noisy one with the chance of its mode."""
    keep = F.when(F.col("noise_mode").contains("easy"), N.gate(F.col("paper_id"), easy, "easy", seed))
    return rows.where(F.coalesce(keep.when(F.col("noise_mode").contains("hard"), N.gate(F.col("paper_id"), hard, "hard", seed)), F.lit(True)))


@dataclass(frozen=True)
class Options:
    """What a data set is built with."""

    train_limit: int = BUILD.train_limit
    valid_limit: int = BUILD.valid_limit
    test_limit: int = BUILD.test_limit
    noise_pool_limit: int = BUILD.noise_pool_limit
    test_pool_offset: int = BUILD.test_pool_offset
    min_chunks: int = BUILD.min_chunks
    easy: float = 1.0
    hard: float = 1.0
    control: str = "repeat"
    copies: int = 3
    seed: int = SEED


def _numbered(papers: DataFrame, split: str, order: str) -> DataFrame:
    """The papers that may be used, with their position and an id of split and position."""
    usable = kept(papers.where(A.drop_reason(F.col("article"), F.col("abstract")).isNull()))
    rows = A.positions(usable, order)
    return kept(rows.select(F.concat(F.lit(f"{split}_"), F.col("pos").cast("string")).alias("paper_id"), "pos", "article", "abstract"))


def _controls(rows: DataFrame, more, o: Options) -> DataFrame:
    """Clean rows of the size of the noise-aware ones: each repeated, or of ``more`` papers."""
    clean = rows.where("sample_type = 'clean'")
    if o.control == "repeat":
        return A.repeated_controls(clean, o.copies)
    wanted, have = rows.count(), clean.count()
    return A.unique_controls(clean, more(A.unique_request(wanted - have)), wanted)


def build_data_set(train: DataFrame, valid: DataFrame, test: DataFrame, out: str, order: str = "doc_id", encoder: V.Encoder | None = None, o: Options = Options()) -> DataFrame:
    """Builds all splits of ``train``, ``valid`` and ``test`` (``order``, article, abstract) below ``out``: the table, the JSON-lines files of
    ``writers.FILES`` and six files of metadata.  Returns the table.

    Distractors of training and validation come from training papers behind the training's, those of the test from
    other papers still; none of the ranges may overlap.
    """
    if o.control not in ("repeat", "unique"):
        raise ValueError(f"no such control: {o.control}")
    spark = train.sparkSession
    raw = {"train": train, "validation": valid, "test": test}
    numbered = {name: _numbered(rows, name, order) for name, rows in raw.items()}
    total = numbered["train"].count()
    pool_at = A.pool_range("heldout_train_tail", total, o.train_limit, o.noise_pool_limit)
    test_at = A.pool_range("heldout_train_tail", total, o.train_limit, o.noise_pool_limit, o.test_pool_offset)
    extra_at = max(pool_at[1], test_at[1])  # papers of the unique controls
    A.disjoint((0, min(o.train_limit, total)), pool_at, test_at)

    def part(name: str, begin: int, end: int) -> DataFrame:
        return numbered[name].where((F.col("pos") >= begin) & (F.col("pos") < end)).drop("pos")

    pools = {"train": part("train", *pool_at), "test": part("train", *test_at)}
    pools["validation"] = pools["train"]
    parts = []
    for name, limit, extra in (("train", o.train_limit, extra_at), ("validation", o.valid_limit, o.valid_limit)):
        rows = kept(gated(build(part(name, 0, limit), pools[name], name, encoder, least=o.min_chunks), o.easy, o.hard, o.seed))

        def more(n: int) -> DataFrame:
            return build(part(name, extra, extra + n), pools[name].limit(0), f"{name}_clean_extra", encoder, least=o.min_chunks, modes=("clean",))  # noqa: B023

        parts += [rows.withColumn("train_setting", F.lit("noiseaware")), _controls(rows, more, o).withColumn("split", F.lit(name))]
    for design in ("additive", "substitutive"):
        parts.append(gated(build(part("test", 0, o.test_limit), pools["test"], "test", encoder, design, o.min_chunks), o.easy, o.hard, o.seed))
    writers.data_set(A.one_schema(*parts), f"{out}/table")
    table = spark.read.parquet(f"{out}/table")
    files = {name: f"{out}/{name}.jsonl" for name in writers.FILES}
    for name, path in files.items():
        writers.json_lines(writers.data_file(table, name), path)
    told = lambda rows: [r.asDict() for r in rows.collect()]  # noqa: E731  a row a split, reason or file
    reports = [
        A.filter_report(rows, F.lit(name), F.col("abstract"), A.drop_reason(F.col("article"), F.col("abstract"))) for name, rows in raw.items()
    ]
    filtered = told(reports[0].unionByName(reports[1]).unionByName(reports[2]))
    checks = {name: told(readers.validate(spark.read.json(path)) if writers.data_file(table, name).count() else readers.validate(table.limit(0)))[0] for name, path in files.items()}
    pool_meta = {"mode": "heldout_train_tail", "train_papers": total, "train_limit": o.train_limit}
    control_meta = {"mode": o.control, "copies": o.copies if o.control == "repeat" else 1, "unique_paper_ids": o.control == "unique"}
    metadata = {
        "options": dataclasses.asdict(o), "target_filter": {"rows": filtered}, "noise_pool": {**pool_meta, "begin": pool_at[0], "end": pool_at[1]},
        "test_noise_pool": {**pool_meta, "begin": test_at[0], "end": test_at[1]}, "checks": checks,
        "manifest": {
            "files": files, "clean_control": control_meta, "target_filter": filtered, "checks": checks, "k_values": K_VALUES, "final_k": BUILD.final_k,
            "noise_k": BUILD.noise_k, "substitutive_clean_k": BUILD.substitutive_clean_k, "seed": o.seed,
        },
    }
    for name, content in metadata.items():
        writers.manifest(spark, content, f"{out}/{name}.json")
    return table


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    for name in ("train", "valid", "test"):
        p.add_argument(name, help=f"table of the {name} papers (article, abstract)")
    p.add_argument("out")
    p.add_argument("--order", default="doc_id", help="whole-number column that orders the papers")
    for f in dataclasses.fields(Options):
        p.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=f.default)
    a = vars(p.parse_args(argv))
    spark = SparkSession.builder.getOrCreate()
    tables = [readers.papers(readers.arrow_table(spark, a[name])) for name in ("train", "valid", "test")]
    build_data_set(*tables, a["out"], a["order"], o=Options(**{f.name: a[f.name] for f in dataclasses.fields(Options)}))


if __name__ == "__main__":
    main()
