"""Queries over the test tables, one for each operator, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SEED, TOKENS_PER_WORD
from ..functions import rouge as R
from ..functions import text as T
from ..operators import assemble as A
from ..operators import chunking as C
from ..operators import metrics as M
from ..operators import noise as N
from ..operators import reports as P
from ..operators import stats as S
from ..operators import vectors as V
from ..operators.places import kept
from ..sources import readers
from . import build as B
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "text", "lang", "source")


def _r(c, n: int = 6):
    return F.round(c, n)


# scans, filters, limits


@query(f"SELECT lang, count(*) AS n_docs, sum(n) AS n_words, round(avg(n), 6) AS mean_words, max(n) AS max_words FROM (SELECT lang, {O.count_words('text')} AS n FROM documents) GROUP BY lang")
def word_stats(spark, d):
    n = T.word_count(F.col("text"))
    return _docs(spark, d).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_words"), _r(F.avg(n)).alias("mean_words"), F.max(n).alias("max_words"))


_TARGET = O.first_words("text", 600)


@query(f"""
SELECT split, reason, count(*) AS papers, min(n) AS min_words, round(avg(n), 6) AS mean_words, max(n) AS max_words FROM (
  SELECT source AS split, n, CASE WHEN {O.space("text")} = '' THEN 'empty_article' WHEN t = '' THEN 'empty_target' WHEN n < 20 THEN 'too_short' WHEN n > 512 THEN 'too_long' ELSE 'kept' END AS reason
  FROM (SELECT *, {O.count_words("t")} AS n FROM (SELECT *, {_TARGET} AS t FROM documents))
) GROUP BY split, reason""")
def target_length_filter(spark, d):
    docs = _docs(spark, d).withColumn("target", T.truncate_words(F.col("text"), 600))
    return A.filter_report(docs, F.col("source"), F.col("target"), A.drop_reason(F.col("text"), F.col("target")))


@query(f"""
SELECT count(*) AS rows, sum((a = 0)::INT) AS empty_input, sum((b = 0)::INT) AS empty_target, min(a) AS input_min, round(avg(a), 6) AS input_mean, round(quantile_cont(a, 0.95), 6) AS input_p95,
  max(a) AS input_max, min(b) AS target_min, round(avg(b), 6) AS target_mean, round(quantile_cont(b, 0.95), 6) AS target_p95, max(b) AS target_max
FROM (SELECT {O.count_words("text")} AS a, {O.count_words(O.first_words("text", 60))} AS b FROM documents)""")
def jsonl_profile(spark, d):
    return readers.profile(_docs(spark, d).withColumn("abstract", T.truncate_words(F.col("text"), 60)), "text", "abstract", None)


@query(f"""
SELECT count(*) AS n, sum(({O.space("text")} = '')::INT) AS empty_input, sum((b = 0)::INT) AS empty_target, min(b) AS target_min, round(avg(b), 6) AS target_mean, max(b) AS target_max
FROM (SELECT text, {O.count_words(O.first_words("text", 60))} AS b FROM documents)""")
def jsonl_validate(spark, d):
    return readers.validate(_docs(spark, d).withColumn("abstract", T.truncate_words(F.col("text"), 60)), "text", "abstract")


@query(f"SELECT doc_id, md5({O.space('text')}) AS article, md5({O.first_words('text', 60)}) AS abstract FROM documents WHERE {O.space('text')} <> ''")
def paper_fields(spark, d):
    rows = _docs(spark, d).select("doc_id", T.normalize_space(F.col("text")).alias("article"), F.array(T.truncate_words(F.col("text"), 60), F.lit(" ")).alias("abstract"))
    return readers.papers(rows).select("doc_id", F.md5(F.col("article").cast("binary")).alias("article"), F.md5(F.col("abstract").cast("binary")).alias("abstract"))


@query(f"SELECT doc_id FROM documents WHERE {O.space('text')} <> '' AND {O.space('lang')} <> ''")
def non_empty_filter(spark, d):
    return A.non_empty(_docs(spark, d), "text", "lang").select("doc_id")


@query("SELECT doc_id, pos FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) WHERE pos >= 100 AND pos < 400")
def noise_pool_range(spark, d):
    docs = _docs(spark, d).select("doc_id")
    begin, end = A.pool_range("heldout_train_tail", 1_000_000_000, train_limit=100, limit=300)
    A.disjoint((0, 100), (begin, end))
    return A.position_range(docs, "doc_id", begin, end).select("doc_id", "pos")


@query(f"SELECT doc_id, ({O.number(O.lit(str(SEED)), 'doc_id::VARCHAR', O.lit('easy'))} / 4294967296.0) < 0.3 AS easy FROM documents")
def bernoulli_gate(spark, d):
    return _docs(spark, d).select("doc_id", N.gate(F.col("doc_id").cast("string"), 0.3, "easy").alias("easy"))


@query("SELECT lang, source, 'additive' AS noise_design, 'cross_doc_easy' AS noise_mode, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT lang, source, 'substitutive', 'cross_doc_easy_substitutive', count(*) FROM documents GROUP BY ALL")
def noise_design_marks(spark, d):
    rows = _docs(spark, d).withColumn("noise_mode", F.lit("cross_doc_easy"))
    return A.marked(rows, "additive").unionByName(A.marked(rows, "substitutive")).groupBy("lang", "source", "noise_design", "noise_mode").agg(F.count("*").alias("n"))


# text


@query(f"SELECT doc_id, len({O.tokens('text')}) AS n_tokens, len(list_distinct({O.tokens('text')})) AS n_distinct FROM documents")
def tokens_profile(spark, d):
    t = T.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query(f"SELECT doc_id, md5({O.space('text')}) AS h, len({O.space('text')}) AS n FROM documents")
def normalized_space(spark, d):
    t = T.normalize_space(F.col("text"))
    return _docs(spark, d).select("doc_id", F.md5(t.cast("binary")).alias("h"), F.char_length(t).alias("n"))


@query(f"SELECT doc_id, {O.first_words('text', 40)} AS head FROM documents")
def truncated_words(spark, d):
    return _docs(spark, d).select("doc_id", T.truncate_words(F.col("text"), 40).alias("head"))


@query(f"SELECT doc_id, i AS piece, array_to_string(w[i * 150 + 1:i * 150 + 150], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 149) // 150)) AS i FROM (SELECT doc_id, {O.words(O.space('text'))} AS w FROM documents))")
def overlong_pieces(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.split_overlong(F.col("text"), 150)).alias("piece", "text"))


_LINES = f"SELECT doc_id, pos, {O.space('raw')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


@query(f"SELECT doc_id, pos, {O.heading('line')} AS heading FROM ({_LINES})")
def heading_lines(spark, d):
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", T.looks_like_heading(F.col("line")).alias("heading"))


@query(f"""
WITH l AS (SELECT *, {O.heading("line")} AS h FROM ({_LINES}) WHERE line <> ''),
s AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM l),
t AS (SELECT doc_id, s, string_agg(line, ' ' ORDER BY pos) AS text FROM s WHERE NOT h GROUP BY doc_id, s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS section_index, md5(text) AS h FROM t WHERE {O.count_words("text")} >= 10""")
def section_parse(spark, d):
    s = C.sections(_docs(spark, d), "doc_id", F.col("text"))
    return s.select("doc_id", "section_index", F.md5(F.col("text").cast("binary")).alias("h"))


@query(f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS h FROM (SELECT doc_id, {O.sentences('text')} AS s FROM documents)")
def sentences(spark, d):
    s = T.split_sentences(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|").cast("binary")).alias("h"))


@query(f"SELECT doc_id, array_to_string({O.entities('text')}, '|') AS entities, len({O.entities('text')}) AS n FROM documents")
def entities(spark, d):
    e = T.entities(F.col("text"))
    return _docs(spark, d).select("doc_id", F.array_join(e, "|").alias("entities"), F.size(e).alias("n"))


@query()
def numbers(spark, d):
    e = T.numbers(F.col("text"))
    return _docs(spark, d).select("doc_id", F.array_join(e, "|").alias("numbers"), F.size(e).alias("n"))


@query(f"SELECT doc_id, {O.query('doc_id::VARCHAR')} AS query FROM documents")
def chosen_query(spark, d):
    return _docs(spark, d).select("doc_id", T.choose_query(F.col("doc_id").cast("string")).alias("query"))


@query(f"SELECT doc_id, floor(round({O.count_words('text')} * 1.3::DOUBLE, 6))::BIGINT AS n FROM documents")
def token_estimate(spark, d):
    return _docs(spark, d).select("doc_id", T.token_estimate(F.col("text")).alias("n"))


_IDS = "(SELECT doc_id, (['test_additive_', 'test_substitutive_', 'validation_clean_extra_', 'train_clean_extra_', 'train_'])[doc_id % 5 + 1] || doc_id AS pid FROM documents)"


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(pid, '^test_(additive|substitutive)_', 'test_'), '^validation_clean_extra_', 'validation_'), '^train_clean_extra_', 'train_') AS paper_id FROM {_IDS}")
def paper_id_norm(spark, d):
    prefix = F.array(*map(F.lit, ("test_additive_", "test_substitutive_", "validation_clean_extra_", "train_clean_extra_", "train_")))
    pid = F.concat(F.element_at(prefix, (F.col("doc_id") % 5 + 1).cast("int")), F.col("doc_id"))
    return _docs(spark, d).select("doc_id", T.normalize_paper_id(pid).alias("paper_id"))


_FILES = [*T.CONDITIONS, "other"]


@query(f"""SELECT file, CASE stem {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.CONDITIONS.items())} ELSE stem END AS condition, count(*) AS n FROM (
SELECT 'out/' || stem || '.jsonl' AS file, stem FROM (SELECT ([{", ".join(map(O.lit, _FILES))}])[doc_id % {len(_FILES)} + 1] AS stem FROM documents)) GROUP BY ALL""")
def condition_dim(spark, d):
    stem = F.element_at(F.array(*map(F.lit, _FILES)), (F.col("doc_id") % len(_FILES) + 1).cast("int"))
    rows = _docs(spark, d).select(F.concat(F.lit("out/"), stem, F.lit(".jsonl")).alias("file"))
    return rows.groupBy("file", T.condition_from_filename(F.col("file")).alias("condition")).agg(F.count("*").alias("n"))


# chunks

_CHUNKS = f"""(SELECT doc_id, lang, pos, w[120 * pos + 1:120 * pos + 150] AS c FROM (SELECT *, unnest(range(0, greatest(ceil((len(w) - 150) / 120.0)::INT, 0) + 1)) AS pos
FROM (SELECT doc_id, lang, {O.words(O.space("text"))} AS w FROM documents)) WHERE len(w) > 0 AND (pos = 0 OR len(w) - 120 * pos >= 40))"""


@query(f"SELECT doc_id, pos, len(c) AS word_count, md5(array_to_string(c, ' ')) AS h FROM {_CHUNKS}")
def fallback_chunks(spark, d):
    c = C.word_windows(_docs(spark, d), F.col("text"))
    return c.select("doc_id", "pos", "word_count", F.md5(F.col("text").cast("binary")).alias("h"))


@query(f"SELECT lang, count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks, sum(len(c)) AS n_words FROM {_CHUNKS} GROUP BY lang")
def chunk_count_summary(spark, d):
    """The first slice of the build: scan, count, filter, windows, aggregate."""
    c = C.word_windows(_docs(spark, d), F.col("text"))
    # each document has exactly one first window, so no distinct count is needed
    return c.groupBy("lang").agg(F.count_if(F.col("pos") == 0).alias("n_docs"), F.count("*").alias("n_chunks"), F.sum("word_count").alias("n_words"))


@query(f"SELECT doc_id, count(*) AS n FROM {_CHUNKS} GROUP BY doc_id HAVING count(*) >= 3")
def min_chunks_filter(spark, d):
    n = C.window_count(F.size(T.words(T.normalize_space(F.col("text")))))
    return _docs(spark, d).select("doc_id", n.alias("n")).where("n >= 3")


@query(f"SELECT doc_id, n < 3 AND {O.count_words('text')} >= 120 AS needed FROM documents JOIN (SELECT doc_id, count(*) AS n FROM {_CHUNKS} GROUP BY doc_id) USING (doc_id)")
def fallback_needed(spark, d):
    n = C.window_count(F.size(T.words(T.normalize_space(F.col("text")))))
    return _docs(spark, d).where(n > 0).select("doc_id", C.needs_fallback(n, F.col("text")).alias("needed"))


@query()
def rule_chunks(spark, d):
    return C.chunk_documents(_docs(spark, d), "doc_id", "text")


@query()
def chunk_statistics(spark, d):
    docs = _docs(spark, d)
    return C.chunk_statistics(C.chunk_documents(docs, "doc_id", "text"), docs, "doc_id")


# vectors and distractors

_SCORES = f"""(SELECT q.vec_id AS query_id, q.label AS query_label, e.vec_id AS doc_id, e.label, e.embedding, round({O.dot("q.embedding", "e.embedding")}, 6) AS score
FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)"""
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {_SCORES})"


def _vectors(spark, d):
    """Every hundredth vector is a query, against all."""
    e = _t(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))
    return queries, e.select(F.col("vec_id").alias("doc_id"), "label", "embedding")


@query(f"SELECT query_id, doc_id, score, rank FROM {_RANKED} WHERE rank <= 10")
def vector_topk(spark, d):
    queries, pool = _vectors(spark, d)
    return V.search(queries, pool, 10).select("query_id", "doc_id", "score", "rank")


_MMR = f"""
WITH c AS MATERIALIZED (SELECT query_id, doc_id, score, rank, embedding FROM {_RANKED} WHERE rank <= 50),
s AS MATERIALIZED (SELECT a.query_id, a.rank AS r, b.rank AS o, round({O.dot("a.embedding", "b.embedding")}, 6) AS sim FROM c a JOIN c b ON a.query_id = b.query_id),
one AS (SELECT query_id, 1 AS rank, arg_max(rank, (round(0.5 * score, 9), -rank)) AS r FROM c GROUP BY query_id),
v2 AS (SELECT c.query_id, c.rank AS r, round(0.5 * c.score - 0.5 * s.sim, 9) AS v FROM c JOIN one USING (query_id) JOIN s ON s.query_id = c.query_id AND s.r = c.rank AND s.o = one.r WHERE c.rank <> one.r),
two AS (SELECT query_id, 2 AS rank, arg_max(r, (v, -r)) AS r FROM v2 GROUP BY query_id),
v3 AS (SELECT c.query_id, c.rank AS r, round(0.5 * c.score - 0.5 * greatest(s.sim, z.sim), 9) AS v FROM c JOIN one USING (query_id) JOIN two USING (query_id)
  JOIN s ON s.query_id = c.query_id AND s.r = c.rank AND s.o = one.r JOIN s z ON z.query_id = c.query_id AND z.r = c.rank AND z.o = two.r WHERE c.rank NOT IN (one.r, two.r)),
three AS (SELECT query_id, 3 AS rank, arg_max(r, (v, -r)) AS r FROM v3 GROUP BY query_id)
SELECT x.query_id, c.doc_id, c.score, x.rank FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three) x JOIN c ON c.query_id = x.query_id AND c.rank = x.r"""


@query(_MMR)
def mmr_select(spark, d):
    queries, pool = _vectors(spark, d)
    return V.retrieve(queries, pool, 3)


@query(f"""SELECT query_id, doc_id, score, pick FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {O.key(O.lit(str(SEED)), "query_id::VARCHAR", "doc_id::VARCHAR", O.lit("hard"))}, doc_id) AS pick
FROM {_RANKED} WHERE rank > 5 AND rank <= 50) WHERE pick <= 4""")
def hard_negatives(spark, d):
    queries, pool = _vectors(spark, d)
    return V.hard_negatives(queries, pool, 4).select("query_id", "doc_id", "score", "pick")


@query(f"SELECT vec_id AS doc_id FROM embeddings WHERE vec_id % 100 <> 0 ORDER BY {O.key(O.lit(str(SEED)), 'vec_id::VARCHAR', O.lit('negative'))}, vec_id LIMIT 20")
def random_negatives(spark, d):
    queries, pool = _vectors(spark, d)
    return V.negatives(pool.select("doc_id"), queries.select(F.col("query_id").alias("doc_id")), 20)


def _band_sql(mode: str, scores: str = _SCORES) -> str:
    (a, b), (c, e) = N.MODES[mode]
    low = lambda x: f"score >= round(quantile_cont(score, {x}) OVER w, 9) AND " if x else ""
    return f"""(SELECT query_id, doc_id, score, label FROM (SELECT *, max(narrow) OVER (PARTITION BY query_id) AS found FROM (
    SELECT *, {low(a)}score <= round(quantile_cont(score, {b}) OVER w, 9) AS narrow, {low(c)}score <= round(quantile_cont(score, {e}) OVER w, 9) AS wide
    FROM {scores} WINDOW w AS (PARTITION BY query_id))) WHERE CASE WHEN found THEN narrow ELSE wide END)"""


@query(f"SELECT query_id, doc_id, score FROM {_band_sql('cross_doc_easy')}")
def percentile_band_easy(spark, d):
    return N.vector_band(*_vectors(spark, d), "cross_doc_easy")


@query(f"SELECT query_id, doc_id, score FROM {_band_sql('cross_doc_hard')}")
def percentile_band_hard(spark, d):
    return N.vector_band(*_vectors(spark, d), "cross_doc_hard")


def _sample_sql(mode: str) -> str:
    """Two distractors of each query: of another label and none of its three nearest; the band is that of the documents that are left."""
    s = O.lit(str(SEED))
    h = lambda j: O.number(s, "query_id::VARCHAR", O.lit(mode), O.lit(str(j)))
    rows = f"(SELECT s.* FROM {_RANKED} s WHERE label <> query_label AND rank > 3)"
    return f"""(WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) - 1 AS place, count(*) OVER (PARTITION BY query_id) AS size FROM {_band_sql(mode, rows)}),
drawn AS (SELECT *, CASE WHEN size > 1 THEN {h(0)} % (size - 1) ELSE 0 END AS a, {h(1)} % size AS b FROM numbered)
SELECT query_id AS paper_id, doc_id, label, CASE WHEN place = a THEN 1 ELSE 2 END AS pick FROM drawn WHERE place = a OR size > 1 AND place = CASE WHEN b = a THEN size - 1 ELSE b END)"""


def _papers(spark, d, k=3):
    queries, pool = _vectors(spark, d)
    pool = pool.select("doc_id", F.col("label").cast("string").alias("source_doc_id"), "embedding")
    near = V.search(queries, pool, k).join(pool.drop("embedding"), "doc_id")
    clean = kept(near.select(F.col("query_id").cast("string").alias("paper_id"), "query_id", "doc_id", "source_doc_id", "score", "rank"))
    papers = queries.select(F.col("query_id").cast("string").alias("paper_id"), "embedding", F.col("query_label").cast("string").alias("own_source"))
    return papers, pool, clean


@query(f"SELECT paper_id::VARCHAR AS paper_id, doc_id, pick FROM {_sample_sql('cross_doc_easy')}")
def noise_sample(spark, d):
    papers, pool, clean = _papers(spark, d)
    return N.vector_sample(papers, pool, "cross_doc_easy", 2, clean=clean).select("paper_id", "doc_id", "pick")


_MIXED = f"{O.number(O.lit(str(SEED)), 'paper_id::VARCHAR', O.lit('coin'))} % 2"


@query(f"SELECT paper_id::VARCHAR AS paper_id, doc_id, pick FROM {_sample_sql('cross_doc_easy')} WHERE {_MIXED} = 0 UNION ALL SELECT paper_id::VARCHAR, doc_id, pick FROM {_sample_sql('cross_doc_hard')} WHERE {_MIXED} = 1")
def noise_sample_mixed(spark, d):
    papers, pool, clean = _papers(spark, d)
    return N.vector_sample(papers, pool, "mixed_easy_hard", 2, clean=clean).select("paper_id", "doc_id", "pick")


def _context_sql(mode: str, k: int) -> str:
    return f"""SELECT paper_id::VARCHAR AS paper_id, string_agg(doc_id::VARCHAR, '|' ORDER BY o) AS ids, string_agg(hit::VARCHAR, '|' ORDER BY o) AS flags FROM (
SELECT query_id AS paper_id, doc_id, rank AS o, 1 AS hit FROM {_RANKED} WHERE rank <= {k} UNION ALL SELECT paper_id, doc_id, pick + 1000000, 0 FROM {_sample_sql(mode)}) GROUP BY paper_id"""


def _contexts(spark, d, mode, k):
    papers, pool, clean = _papers(spark, d)
    noise = N.vector_sample(papers, pool, mode, 2, clean=clean)
    c = N.contexts(clean.where(F.col("rank") <= k), noise)
    return c.select("paper_id", F.array_join(F.col("context_ids").cast("array<string>"), "|").alias("ids"), F.array_join(F.col("hit_flags").cast("array<string>"), "|").alias("flags"))


@query(_context_sql("cross_doc_hard", 3))
def additive_context(spark, d):
    return _contexts(spark, d, "cross_doc_hard", 3)


@query(_context_sql("cross_doc_easy", 1))
def substitutive_context(spark, d):
    return _contexts(spark, d, "cross_doc_easy", 1)


@query(f"""SELECT doc_id, CASE WHEN a <> '' THEN {O.first_words("'summarize: question: ' || q || ' context: ' || a || ' ' || b", 950)} END AS input_text, {O.first_words("text", 512)} AS target_text
FROM (SELECT doc_id, text, {O.query("doc_id::VARCHAR")} AS q, {O.first_words("text", 180)} AS a, {O.first_words("reverse(text)", 180)} AS b FROM documents) WHERE a <> ''""")
def assemble_input(spark, d):
    docs = _docs(spark, d)
    good, _ = A.examples(docs, T.choose_query(F.col("doc_id").cast("string")), F.array("text", F.reverse("text")), F.col("text"))
    return good.select("doc_id", "input_text", "target_text")


_FLAGS = f"(SELECT query_id, list(label ORDER BY rank) AS labels, list((label = query_label)::INT ORDER BY rank) AS f FROM {_RANKED} WHERE rank <= 10 GROUP BY query_id)"


@query(f"""SELECT r.query_id, k, len(ids[1:k]) AS retrieved, len(list_filter(ids[1:k], lambda x: list_contains(gold, x))) AS hits,
round(len(list_filter(ids[1:k], lambda x: list_contains(gold, x))) / greatest(len(ids[1:k]), 1), 6) AS precision, round(len(list_filter(ids[1:k], lambda x: list_contains(gold, x))) / greatest(len(gold), 1), 6) AS recall
FROM (SELECT query_id, list(doc_id ORDER BY rank) AS ids FROM {_RANKED} WHERE rank <= 10 GROUP BY query_id) r
JOIN (SELECT q.vec_id AS query_id, list(e.vec_id) AS gold FROM embeddings e JOIN embeddings q ON q.label = e.label AND q.vec_id % 100 = 0 GROUP BY q.vec_id) g USING (query_id), (VALUES (1), (3), (5), (10)) x(k)""")
def precision_recall_gold(spark, d):
    queries, pool = _vectors(spark, d)
    # of the relevant ones a list needs those that it has and their number
    sizes = pool.groupBy(F.col("label").alias("query_label")).agg(F.count("*").alias("size"))
    asked = queries.select("query_id", "query_label").distinct().join(sizes, "query_label")
    asked = asked.groupBy("query_id").agg(F.sum("size").alias("size"), F.collect_list("query_label").alias("labels"))
    labels = pool.groupBy("doc_id").agg(F.collect_set("label").alias("own"))
    top = V.search(queries, pool, 10).join(labels, "doc_id").join(asked, "query_id").withColumn("gold", F.when(F.arrays_overlap("own", "labels"), F.col("doc_id")))
    top = top.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ids"), F.collect_list("gold").alias("gold"), F.first("size").alias("size"))
    at = F.array(*[F.struct(F.lit(k).alias("k"), A.gold_at_k(F.col("ids"), F.col("gold"), k, F.col("size")).alias("m")) for k in (1, 3, 5, 10)])
    rows = top.select("query_id", F.explode(at).alias("x"))
    return rows.select("query_id", "x.k", "x.m.retrieved", "x.m.hits", _r(F.col("x.m.precision")).alias("precision"), _r(F.col("x.m.recall")).alias("recall"))


def _flag_sql(k: int) -> str:
    t, n = f"f[1:{k}]", "greatest(list_sum(f), 1)"
    dcg = f"coalesce(list_sum(list_transform(range(1, len({t}) + 1), lambda i: f[i] / log2(i + 1))), 0)"
    idcg = f"list_sum(list_transform(range(1, least({n}, {k})::BIGINT + 1), lambda i: 1 / log2(i + 1)))"
    return (
        f"(coalesce(list_sum({t}), 0) > 0)::DOUBLE AS hit_{k}, round({O.div(f'list_sum({t})', f'len({t})')}, 6) AS precision_{k}, "
        f"round({O.div(f'list_sum({t})', n)}, 6) AS recall_{k}, round({O.div(dcg, idcg)}, 6) AS ndcg_{k}"
    )


@query(f"SELECT query_id, round(CASE WHEN list_position(f, 1) > 0 THEN 1.0 / list_position(f, 1) ELSE 0 END, 6)::DOUBLE AS mrr, {', '.join(map(_flag_sql, (1, 3, 5, 10)))} FROM {_FLAGS}")
def retrieval_flags_metrics(spark, d):
    return _flag_rows(spark, d)


def _flag_rows(spark, d):
    queries, pool = _vectors(spark, d)
    top = V.search(queries, pool, 10).join(pool.select("doc_id", "label"), "doc_id").join(queries.select("query_id", "query_label"), "query_id")
    hit = F.struct("rank", (F.col("label") == F.col("query_label")).cast("int").alias("h"))
    rows = top.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(hit)), lambda x: x["h"]).alias("f"))
    rows = rows.select("query_id", M.flags_at_k(F.col("f")).alias("m"))
    names = {"mrr": "mrr"} | {f"{m}_{k}": f"{m}@{k}" for k in (1, 3, 5, 10) for m in ("hit", "precision", "recall", "ndcg")}
    return rows.select("query_id", *[_r(F.col("m").getField(c)).alias(n) for n, c in names.items()])


@query()
def encoded_documents(spark, d):
    v = V.HashedWords().encode(F.col("text"))
    return _docs(spark, d).select("doc_id", F.transform(v, lambda x: F.round(x, 6)).alias("embedding"))


@query()
def build_examples(spark, d):
    docs = _docs(spark, d).select(F.concat(F.lit("test_"), F.col("doc_id")).alias("paper_id"), F.col("text").alias("article"), T.truncate_words(F.col("text"), 60).alias("abstract"), "doc_id")
    return B.build(docs.where("doc_id % 2 = 0").drop("doc_id"), docs.where("doc_id % 2 = 1").drop("doc_id"), "test")


# records

# every answer of a conversation is a prediction, the turn before it the target, all other turns the source; all whole
_REC = """(SELECT c.conv_id * 1000 + c.turn AS doc_id, string_agg(coalesce(o.text, ''), chr(10) ORDER BY o.turn) AS input_text, coalesce(max(CASE WHEN o.turn = c.turn - 1 THEN o.text END), '') AS target_text,
coalesce(c.text, '') AS prediction_text FROM conversations c JOIN conversations o ON o.conv_id = c.conv_id AND o.turn <> c.turn WHERE c.role = 'assistant' GROUP BY c.conv_id, c.turn, c.text)"""


def _records(spark, d):
    c = _t(spark, d, "conversations").withColumn("text", T.text_of(F.col("text")))
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    # told by numbers: a filter of the list would get into the join's condition, for which Spark makes code that looks for the turn on the wrong side
    rows = c.where("role = 'assistant'").join(turns, "conv_id").where("low <> turn or high <> turn").withColumn("others", F.filter("turns", lambda x: x["turn"] != F.col("turn")))
    target = F.get(F.filter("others", lambda x: x["turn"] == F.col("turn") - 1), F.lit(0))["text"]
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.array_join(F.col("others.text"), "\n").alias("input_text"),
        T.text_of(target).alias("target_text"), F.col("text").alias("prediction_text"),
    )


_LEX = f"(SELECT *, {O.ngrams('p', 2)} AS p2, {O.ngrams('p', 3)} AS p3, {O.ngrams('s', 2)} AS s2, {O.ngrams('s', 3)} AS s3 FROM (SELECT *, {O.tokens('prediction_text')} AS p, {O.tokens('input_text')} AS s FROM {_REC}))"
_CONTENT = "list_distinct(list_filter(p, lambda t: len(t) >= 4))"


@query(f"SELECT doc_id, round({O.div('len(list_distinct(p))', 'len(p)')}, 6) AS distinct_1, round({O.div('len(list_distinct(p2))', 'len(p2)')}, 6) AS distinct_2, round({O.div('len(p2) - len(list_distinct(p2))', 'len(p2)')}, 6) AS repetition_2gram_rate FROM {_LEX}")
def ngram_distinct(spark, d):
    return M.lexical(_records(spark, d)).select("doc_id", *[_r(F.col(c)).alias(c) for c in ("distinct_1", "distinct_2", "repetition_2gram_rate")])


def _copy_sql(n: int) -> str:
    c = O.div(f"len(list_intersect(p{n}, s{n}))", f"len(list_distinct(p{n}))")
    return f"round({c}, 6) AS source_copy_{n}gram_rate, round(1 - {c}, 6) AS novel_{n}gram_ratio"


@query(f"SELECT doc_id, {_copy_sql(2)}, {_copy_sql(3)} FROM {_LEX}")
def copy_novel_ngrams(spark, d):
    return M.lexical(_records(spark, d)).select("doc_id", *[_r(F.col(c)).alias(c) for n in (2, 3) for c in (f"source_copy_{n}gram_rate", f"novel_{n}gram_ratio")])


@query(f"SELECT doc_id, round({O.div(f'len(list_intersect({_CONTENT}, s))', f'len({_CONTENT})')}, 6) AS source_token_support_rate FROM {_LEX}")
def source_token_support(spark, d):
    return M.lexical(_records(spark, d)).select("doc_id", _r(F.col("source_token_support_rate")).alias("source_token_support_rate"))


@query(f"""SELECT doc_id, round(coalesce(list_avg(list_transform(list_filter(list_transform({O.plain_sentences("prediction_text")}, lambda s: list_distinct(list_filter({O.tokens("s")}, lambda t: len(t) >= 4))),
lambda t: len(t) > 0), lambda t: len(list_intersect(t, have)) / len(t))), 0), 6) AS support FROM (SELECT *, {O.tokens("input_text")} AS have FROM {_REC})""")
def sentence_support(spark, d):
    return _records(spark, d).select("doc_id", _r(T.sentence_support(F.col("prediction_text"), F.col("input_text"))).alias("support"))


_E = f"(SELECT doc_id, {O.entities('prediction_text')} AS p, {O.entities('target_text')} AS t, {O.entities('input_text')} AS s FROM {_REC})"


@query(f"""SELECT doc_id, round({O.div("len(list_intersect(p, t))", "len(p)")}, 6) AS entity_precision_ref, round({O.div("len(list_intersect(p, t))", "len(t)")}, 6) AS entity_recall_ref,
round({O.div(f"2 * len(list_intersect(p, t))", "len(p) + len(t)")}, 6) AS entity_f1_ref, len(list_intersect(p, s)) AS supported_entity_count, len(p) - len(list_intersect(p, s)) AS unsupported_entity_count,
round(CASE WHEN len(p) > 0 THEN len(list_intersect(p, s)) / len(p) END, 6) AS source_supported_entity_rate, round({O.div("len(p) - len(list_intersect(p, s))", "len(p)")}, 6) AS unsupported_entity_rate,
len(p) AS prediction_entity_count, len(t) AS reference_entity_count, len(list_intersect(p, t)) AS entity_overlap_ref_count,
round(CASE WHEN len(t) > 0 THEN len(list_intersect(t, s)) / len(t) END, 6) AS reference_entity_source_coverage FROM {_E}""")
def entity_overlap(spark, d):
    rates = ("entity_precision_ref", "entity_recall_ref", "entity_f1_ref", "source_supported_entity_rate", "unsupported_entity_rate", "reference_entity_source_coverage")
    counts = ("supported_entity_count", "unsupported_entity_count", "prediction_entity_count", "reference_entity_count", "entity_overlap_ref_count")
    return M.entity_block(_records(spark, d)).select("doc_id", *counts, *[_r(F.col(c)).alias(c) for c in rates])


@query()
def number_overlap(spark, d):
    names = [f"number_{m}_ref" for m in ("precision", "recall", "f1")] + ["number_source_supported_rate", "unsupported_number_rate", "supported_number_count", "unsupported_number_count"]
    return M.number_block(_records(spark, d)).select("doc_id", *names)


def _tok(side: str, rate: float) -> str:
    return f"floor(round({O.count_words(side)} * {rate}::DOUBLE, 6))::BIGINT"


@query(f"""SELECT doc_id, source_words, source_tokens, model_tokens, source_tokens > 1024 AS truncated, model_tokens > 1024 AS truncated_model, round({O.div("p", "model_tokens")}, 6) AS compression, round({O.div("p", "t")}, 6) AS length_ratio FROM (
SELECT doc_id, {O.count_words("input_text")} AS source_words, {_tok("input_text", 1.43)} AS source_tokens, {_tok("input_text", 1.82)} AS model_tokens, {_tok("prediction_text", 1.82)} AS p, {_tok("target_text", 1.82)} AS t FROM {_REC})""")
def truncation_flags(spark, d):
    m = M.lengths(_records(spark, d), F.lit("t5"))
    return m.select(
        "doc_id", "source_words", "source_tokens", F.col("source_tokens_model_tokenizer").alias("model_tokens"), F.col("source_truncated_risk").alias("truncated"),
        F.col("source_truncated_risk_model_tokenizer").alias("truncated_model"), _r(F.col("compression_ratio_pred_over_source_tokens")).alias("compression"),
        _r(F.col("length_ratio_pred_over_target_tokens")).alias("length_ratio"),
    )


def _rouge_sql(n: int) -> str:
    tok = lambda c: f"list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"
    gram = lambda c: O.ngrams(tok(c), n)
    return f"""WITH r AS (SELECT doc_id, {gram("prediction_text")} AS p, {gram("target_text")} AS t FROM {_REC}),
p AS (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(p) AS g FROM r) GROUP BY ALL), t AS (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(t) AS g FROM r) GROUP BY ALL),
o AS (SELECT doc_id, sum(least(p.c, t.c)) AS n FROM p JOIN t USING (doc_id, g) GROUP BY doc_id)
SELECT doc_id, round({O.div("coalesce(n, 0)", "len(p)")}, 6) AS precision, round({O.div("coalesce(n, 0)", "len(t)")}, 6) AS recall, round({O.div("2 * coalesce(n, 0)", "len(p) + len(t)")}, 6) AS f FROM r LEFT JOIN o USING (doc_id)"""


def _rouge(spark, d, n):
    r = _records(spark, d).select("doc_id", R.rouge_n(F.col("prediction_text"), F.col("target_text"), n).alias("r"))
    return r.select("doc_id", *[_r(F.col(f"r.{x}")).alias(x) for x in ("precision", "recall", "f")])


@query(_rouge_sql(1))
def rouge1(spark, d):
    return _rouge(spark, d, 1)


@query(_rouge_sql(2))
def rouge2(spark, d):
    return _rouge(spark, d, 2)


@query()
def rouge_stemmed(spark, d):
    names = [f"rouge{x}{y}" for x in ("1", "2", "L", "Lsum") for y in ("", "_precision", "_recall")]
    return M.rouge_block(_records(spark, d)).select("doc_id", *[_r(F.col(c)).alias(c) for c in names])


@query()
def record_metrics(spark, d):
    flags = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: ((F.col("doc_id") + i) % 3 == 0).cast("int"))
    rows = _records(spark, d).withColumns({"context_hit_flags": flags, "retrieved_hit_flags": F.slice(flags, 1, 3), "num_noise_chunks": F.lit(2), "num_contexts": F.lit(5)})
    return M.record_metrics(rows).drop("input_text", "target_text", "prediction_text")


@query()
def corpus_rouge(spark, d):
    return M.corpus_rouge(_records(spark, d))


@query(f"SELECT round(2 / 5.0, 6)::DOUBLE AS noise_chunk_ratio, count(*) AS n FROM documents WHERE doc_id % 2 = 0 HAVING count(*) > 0 UNION ALL SELECT NULL, count(*) FROM documents WHERE doc_id % 2 = 1 HAVING count(*) > 0")
def noise_chunk_ratio(spark, d):
    rows = _docs(spark, d).select("doc_id", F.lit(5).alias("num_contexts"), F.when(F.col("doc_id") % 2 == 0, "2").otherwise("none").alias("num_noise_chunks"))
    rows = rows.withColumns({c: F.array().cast("array<int>") for c in ("context_hit_flags", "retrieved_hit_flags")})
    return M.retrieval_block(rows).groupBy(_r(F.col("noise_chunk_ratio")).alias("noise_chunk_ratio")).agg(F.count("*").alias("n"))


# control rows, schema, order


@query("SELECT doc_id, unnest(range(0, 3)) AS copy, 3 AS copies FROM documents")
def clean_control_repeat(spark, d):
    return A.repeated_controls(_docs(spark, d).select("doc_id")).select("doc_id", F.col("clean_control_copy_id").alias("copy"), F.col("clean_control_num_copies").alias("copies"))


@query("""SELECT paper_id, CASE WHEN f = 0 THEN 'primary' ELSE 'extra' END AS origin FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY f, doc_id) AS r FROM (
SELECT doc_id, source || '_' || lang AS paper_id, 0 AS f FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, source || '_' || lang, 1 FROM documents WHERE doc_id % 3 <> 0)) WHERE r = 1 ORDER BY f, doc_id LIMIT 60""")
def clean_control_unique(spark, d):
    rows = _docs(spark, d).select("doc_id", F.concat_ws("_", "source", "lang").alias("paper_id"))
    out = A.unique_controls(rows.where("doc_id % 3 = 0"), rows.where("doc_id % 3 <> 0"), 60, "doc_id", check=False)
    return out.select("paper_id", F.col("clean_control_source").alias("origin"))


@query("SELECT doc_id, lang, NULL AS source, 'clean' AS noise_mode FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL, source, 'cross_doc_hard' FROM documents WHERE doc_id % 2 = 1")
def schema_unify(spark, d):
    docs = _docs(spark, d)
    a = docs.where("doc_id % 2 = 0").select("doc_id", "lang")
    b = docs.where("doc_id % 2 = 1").select("doc_id", "source", F.lit("cross_doc_hard").alias("noise_mode"))
    return A.one_schema(a, b).select("doc_id", "lang", "source", "noise_mode")


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY {O.key(O.lit(str(SEED)), 'doc_id::VARCHAR', O.lit('shuffle'))}, doc_id) AS place FROM documents")
def shuffled_order(spark, d):
    order = Window.partitionBy("source").orderBy(T.keyed(SEED, F.col("doc_id"), "shuffle"), "doc_id")
    return _docs(spark, d).select("doc_id", F.row_number().over(order).alias("place"))


_WORDS = f"least({O.count_words(O.space('text'))}, 220)"


@query(f"""SELECT doc_id, CASE WHEN w = 0 THEN 0 WHEN 6 * w <= 900 THEN 6 ELSE 900 // w + (900 % w >= 32)::INT END AS n,
CASE WHEN 6 * w <= 900 THEN 6 * w WHEN 900 % w >= 32 THEN 900 ELSE 900 // w * w END AS words FROM (SELECT doc_id, {_WORDS} AS w FROM documents)""")
def context_budget(spark, d):
    parts = F.array(*[F.col("text")] * 6)
    fitted = A.fit_contexts(parts)
    return _docs(spark, d).select("doc_id", F.size(fitted).alias("n"), F.size(T.words(F.array_join(fitted, " "))).alias("words"))


# reports

_MODELS = [("bart_clean", "bart", "clean_matched"), ("bart_noise", "bart", "noiseaware"), ("t5_clean", "t5", "clean_matched"), ("t5_noise", "t5", "noiseaware")]
_CONDITIONS = ["clean", "easy_additive", "hard_additive", "easy_substitutive", "hard_substitutive"]
_METRICS = ["distinct_1", "unsupported_entity_rate", "score"]
_KEYED = f"{O.number('model_key', 'condition', 'doc_id::VARCHAR')}"
_EVAL = f"""(SELECT *, CASE WHEN h % 17 = 0 THEN NULL ELSE round((h % 1000) / 1000.0 + CASE WHEN condition = 'clean' THEN 0.2 ELSE 0 END, 6) END::DOUBLE AS score, (h // 1000 % 11 / 10.0)::DOUBLE AS distinct_1, (h // 20000 % 5 / 4.0)::DOUBLE AS unsupported_entity_rate FROM (
SELECT doc_id, 'p' || doc_id AS paper_id, m.*, c.condition, 'test_' || c.condition || '.jsonl' AS test_file, {O.count_words("text")} AS words, {_KEYED} AS h
FROM documents, (VALUES {", ".join(map(str, _MODELS))}) m(model_key, architecture, train_setting), (VALUES {", ".join(f"('{c}')" for c in _CONDITIONS)}) c(condition)))"""


def _evaluated(spark, d):
    """Records of four models under five conditions, their metrics a hash."""
    models = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(m, ("model_key", "architecture", "train_setting"))]) for m in _MODELS])
    rows = _docs(spark, d).select("doc_id", T.word_count(F.col("text")).alias("words"), F.explode(models).alias("m"))
    rows = rows.select("doc_id", "words", "m.*", F.explode(F.array(*map(F.lit, _CONDITIONS))).alias("condition"))
    h = F.col("h")
    rows = rows.withColumn("h", T.keyed_number(F.col("model_key"), F.col("condition"), F.col("doc_id")))
    score = F.round((h % 1000) / 1000.0 + F.when(F.col("condition") == "clean", 0.2).otherwise(0.0), 6)
    return rows.withColumns(
        {
            "paper_id": F.concat(F.lit("p"), "doc_id"), "paper_id_norm": F.concat(F.lit("p"), "doc_id"), "test_file": F.concat(F.lit("test_"), "condition", F.lit(".jsonl")),
            "score": F.when(h % 17 != 0, score), "distinct_1": F.floor(h / 1000) % 11 / 10.0, "unsupported_entity_rate": F.floor(h / 20000) % 5 / 4.0,
        }
    )


def _stat_sql(m: str) -> str:
    return f"round(avg({m}), 6) AS {m}_mean, round(coalesce(stddev_samp({m}), 0), 6) AS {m}_std, round(median({m}), 6) AS {m}_median, round(quantile_cont({m}, 0.95), 6) AS {m}_p95, min({m}) AS {m}_min, max({m}) AS {m}_max"


@query(f"SELECT architecture, train_setting, model_key, condition, test_file, count(*) AS n, {', '.join(map(_stat_sql, _METRICS))} FROM {_EVAL} GROUP BY ALL")
def summary_tables(spark, d):
    out = P.summary(_evaluated(spark, d), _METRICS, bootstrap=False)
    return out.select(*P.GROUP, "n", *[_r(F.col(c)).alias(c) for c in out.columns if c not in (*P.GROUP, "n")])


@query()
def summary_with_intervals(spark, d):
    return P.summary(_evaluated(spark, d), _METRICS)


@query(f"SELECT architecture, train_setting, model_key, condition, test_file, count(*) AS n, round(avg(distinct_1), 6) AS distinct_1_mean, round(avg(unsupported_entity_rate), 6) AS unsupported_entity_rate_mean FROM {_EVAL} GROUP BY ALL")
def compact_table(spark, d):
    out = P.compact(_evaluated(spark, d))
    return out.select(*P.GROUP, "n", *[_r(F.col(c)).alias(c) for c in out.columns if c.endswith("_mean")])


@query(f"""SELECT architecture, condition, count(*) AS n, min(words) AS words_min, round(avg(words), 6) AS words_mean, round(quantile_cont(words, 0.95), 6) AS words_p95, max(words) AS words_max, sum((t > 1024)::INT) AS risk_n, round(avg((t > 1024)::INT), 6) AS risk_rate
FROM (SELECT *, floor(round(words * CASE architecture WHEN 't5' THEN 1.82 ELSE 1.43 END::DOUBLE, 6)) AS t FROM {_EVAL}) GROUP BY ALL""")
def truncation_summary(spark, d):
    rate = F.when(F.col("architecture") == "t5", TOKENS_PER_WORD["t5"]).otherwise(TOKENS_PER_WORD["bart"])
    tok = F.floor(F.round(F.col("words") * rate, 6))
    rows = _evaluated(spark, d).withColumns({c: F.col("words") if c.endswith("words") else tok for c in P.LENGTHS})
    rows = rows.withColumns({c: (tok > 1024) if c.startswith("source") else (tok > 512) for c in P.RISKS})
    out = P.truncation(rows, ["architecture", "condition"])
    return out.select(
        "architecture", "condition", "n", F.col("source_words_min").alias("words_min"), _r(F.col("source_words_mean")).alias("words_mean"), _r(F.col("source_words_p95")).alias("words_p95"),
        F.col("source_words_max").alias("words_max"), F.col("source_truncated_risk_model_tokenizer_n").alias("risk_n"), _r(F.col("source_truncated_risk_model_tokenizer_rate")).alias("risk_rate"),
    )


@query(f"SELECT condition, test_file, train_setting, model_key, count(*) AS n, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS std FROM {_EVAL} GROUP BY ALL")
def retrieval_summary(spark, d):
    out = P.retrieval(_evaluated(spark, d).withColumnRenamed("score", "context_ndcg@3"))
    return out.select("condition", "test_file", "train_setting", "model_key", "n", _r(F.col("`context_ndcg@3_mean`")).alias("mean"), _r(F.col("`context_ndcg@3_std`")).alias("std"))


_PAIRS = f"(SELECT a.model_key, a.condition, a.doc_id, a.score AS x, b.score AS y, a.score - b.score AS diff FROM {_EVAL} a JOIN {_EVAL} b ON a.doc_id = b.doc_id AND a.model_key = b.model_key AND a.condition <> 'clean' AND b.condition = 'clean' AND a.score IS NOT NULL AND b.score IS NOT NULL)"


def _pairs(spark, d):
    rows = _evaluated(spark, d).where("score is not null").select("model_key", "condition", "doc_id", "score")
    clean = rows.where("condition = 'clean'").select("model_key", "doc_id", F.col("score").alias("y"))
    both = rows.where("condition <> 'clean'").withColumnRenamed("score", "x").join(clean, ["model_key", "doc_id"])
    return both.withColumn("diff", F.round(F.col("x") - F.col("y"), 9))


_BY = ["model_key", "condition"]


@query(f"SELECT model_key, condition, count(*) AS n, round(avg(diff) / stddev_samp(diff), 6) AS cohen_dz FROM {_PAIRS} GROUP BY ALL")
def cohen_dz(spark, d):
    return _pairs(spark, d).groupBy(*_BY).agg(F.count("*").alias("n"), _r(S.cohen_dz(F.col("diff"))).alias("cohen_dz"))


@query(f"SELECT model_key, condition, round(avg(diff) / (stddev_samp(diff) / sqrt(count(*))), 5) AS t FROM {_PAIRS} GROUP BY ALL")
def paired_t(spark, d):
    return _pairs(spark, d).groupBy(*_BY).agg(_r(S.t_statistic(F.col("diff")), 5).alias("t"))


@query(f"SELECT a.model_key, a.condition, round(avg(sign(a.x - b.y)), 6) AS cliffs_delta FROM {_PAIRS} a JOIN {_PAIRS} b USING (model_key, condition) GROUP BY ALL")
def cliffs_delta(spark, d):
    both = F.array(F.struct(F.lit(True).alias("is_x"), F.col("x").alias("value")), F.struct(F.lit(False).alias("is_x"), F.col("y").alias("value")))
    v = _pairs(spark, d).select(*_BY, F.explode(both).alias("z")).select(*_BY, "z.*")
    return S.cliffs_delta(v, _BY).select(*_BY, _r(F.col("cliffs_delta")).alias("cliffs_delta"))


_RANKS = f"(SELECT model_key, condition, diff, rank() OVER (PARTITION BY model_key, condition ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY model_key, condition, abs(diff)) - 1) / 2.0 AS r FROM (SELECT model_key, condition, round(diff, 9) AS diff FROM {_PAIRS}) WHERE diff <> 0)"


@query(f"SELECT model_key, condition, round(sum(r * sign(diff)) / sum(r), 6)::DOUBLE AS rank_biserial, least(sum(CASE WHEN diff > 0 THEN r ELSE 0 END), sum(CASE WHEN diff < 0 THEN r ELSE 0 END))::DOUBLE AS wilcoxon_stat FROM {_RANKS} GROUP BY ALL")
def signed_rank_statistics(spark, d):
    out = S.signed_ranks(_pairs(spark, d), _BY)
    return out.select(*_BY, _r(F.col("rank_biserial")).alias("rank_biserial"), "wilcoxon_stat")


@query("""SELECT doc_id, p, CASE WHEN p IS NOT NULL THEN least(1.0, max((m - r + 1) * p) OVER (ORDER BY p, doc_id ROWS UNBOUNDED PRECEDING)) END AS p_holm FROM (
SELECT doc_id, p, count(p) OVER () AS m, row_number() OVER (ORDER BY p, doc_id) AS r FROM (SELECT doc_id, CASE WHEN quality = 1 THEN (doc_id * 7919 % 10007 / 10007.0 / 1000.0)::DOUBLE END AS p FROM labels))""")
def holm(spark, d):
    p = F.when(F.col("quality") == 1, F.col("doc_id") * 7919 % 10007 / 10007.0 / 1000.0)
    return S.holm(_t(spark, d, "labels").select("doc_id", p.alias("p")), "p", "p_holm")


@query()
def bootstrap_ci(spark, d):
    rows = _evaluated(spark, d).select(*_BY, "doc_id", F.col("score").alias("value"))
    return S.bootstrap_table(rows, _BY, "doc_id")


@query(f"SELECT architecture, condition, round(avg(x), 6) AS mean_noiseaware, round(avg(y), 6) AS mean_clean_matched, count(*) AS n FROM (SELECT a.architecture, a.condition, a.score AS x, b.score AS y FROM {_EVAL} a JOIN {_EVAL} b ON a.doc_id = b.doc_id AND a.architecture = b.architecture AND a.condition = b.condition AND a.train_setting = 'noiseaware' AND b.train_setting = 'clean_matched' AND a.score IS NOT NULL AND b.score IS NOT NULL) GROUP BY ALL")
def paired_noise_vs_clean(spark, d):
    out = P.noiseaware_against_clean(_evaluated(spark, d), ["score"])
    return out.select("architecture", "condition", _r(F.col("mean_noiseaware")).alias("mean_noiseaware"), _r(F.col("mean_clean_matched")).alias("mean_clean_matched"), F.col("n_pairs").alias("n"))


@query(f"SELECT model_key, condition, count(*) AS n, round(avg(x), 6) AS mean_noisy, round(avg(y), 6) AS mean_clean, round({O.div('avg(x)', 'avg(y)')}, 6) AS retention_rate, round(avg(y) - avg(x), 6) AS absolute_degradation, round({O.div('avg(y) - avg(x)', 'avg(y)')}, 6) AS relative_degradation FROM {_PAIRS} GROUP BY ALL")
def robustness_degradation(spark, d):
    out = P.degradation(_evaluated(spark, d), ["score"], tests=False)  # none of these columns is of a test
    names = ("mean_noisy", "mean_clean", "retention_rate", "absolute_degradation", "relative_degradation")
    return out.select("model_key", "condition", F.col("n_pairs").alias("n"), *[_r(F.col(c)).alias(c) for c in names])


@query(f"SELECT a.model_key, split_part(a.condition, '_', 1) AS difficulty, count(*) AS n, round(avg(a.score), 6) AS mean_additive, round(avg(b.score), 6) AS mean_substitutive FROM {_EVAL} a JOIN {_EVAL} b ON a.doc_id = b.doc_id AND a.model_key = b.model_key AND ends_with(a.condition, '_additive') AND b.condition = replace(a.condition, 'additive', 'substitutive') AND a.score IS NOT NULL AND b.score IS NOT NULL GROUP BY ALL")
def additive_vs_substitutive(spark, d):
    out = P.additive_against_substitutive(_evaluated(spark, d), ["score"])
    return out.select("model_key", "difficulty", F.col("n_pairs").alias("n"), _r(F.col("mean_additive")).alias("mean_additive"), _r(F.col("mean_substitutive")).alias("mean_substitutive"))


@query()
def paired_tests(spark, d):
    return P.degradation(_evaluated(spark, d), _METRICS)


@query(f"SELECT paper_id AS paper_id_norm, x, y, round(x - y, 9) AS diff FROM (SELECT a.paper_id, a.distinct_1 AS x, b.distinct_1 AS y FROM {_EVAL} a JOIN {_EVAL} b ON a.paper_id = b.paper_id AND a.model_key = 'bart_clean' AND b.model_key = 't5_clean' AND a.condition = 'clean' AND b.condition = 'clean')")
def aligned_groups(spark, d):
    rows = _evaluated(spark, d).where("condition = 'clean'").withColumnRenamed("distinct_1", "value")
    out = P.align(rows.where("model_key = 'bart_clean'"), rows.where("model_key = 't5_clean'"), positional=True)
    return out.withColumn("diff", F.round("diff", 9))
