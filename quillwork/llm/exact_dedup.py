"""Exact dedup by content sort.

Spark samples splitters and range-partitions the rows by the first bytes of their normalised text and a
hash of all of it; an external sort within each partition places equals adjacent; the window that
follows compares each whole text with its neighbour's and so finds the runs of equals.  The sample
that the driver sees has bounded keys, however long the texts are.

A text with very many copies is split beforehand: its hash is counted with map-side combination, and
its rows are salted into sub-runs of about ``HOT`` rows, whose minima and sizes are then combined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, checkpoint, documents, text_of

#: A text with more copies than this, and than N / HOT_TEXTS, is split into sub-runs of about that size.
HOT = 4096
#: So many texts can be hot at most, which bounds what is broadcast.
HOT_TEXTS = 100_000
#: Bytes of the text that take part in the choice of a range.
PREFIX = 48


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of each row.

    Texts are equal when identical after each run of white space became one space; null counts as
    empty.  The row with the smallest id stays, a null id last; of rows that repeat that id with
    equal text exactly one stays.  Columns of the input that have the name of a result column are
    replaced.  An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    d = docs.select(*names).withColumn("_qw_norm", F.regexp_replace(text_of(text_col), SPACE, " "))
    d = d.withColumn("_qw_h", F.xxhash64("_qw_norm"))
    limit = max(hot, docs.count() // HOT_TEXTS)
    counts = d.groupBy("_qw_h").agg(F.count("*").alias("_qw_c")).where(F.col("_qw_c") > limit)
    heavy = checkpoint(counts)
    split = not heavy.isEmpty()
    # a constant would be folded away in the window but not in the ranges, which would then not do for it
    place = ["_qw_pre", "_qw_h"]
    if split:
        d = d.join(F.broadcast(heavy), "_qw_h", "left")  # HOT_TEXTS rows at most
        parts = F.coalesce(F.ceil(F.col("_qw_c") / limit), F.lit(1))
        salt = F.when(F.col("_qw_c").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit(7), id_col), parts))
        d = d.withColumn("_qw_salt", salt.cast("int"))
        place.append("_qw_salt")
    d = d.withColumn("_qw_pre", F.substring("_qw_norm", 1, PREFIX))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = d.repartitionByRange(n, *place)
    run = Window.partitionBy(*place, "_qw_norm")
    first = run.orderBy(F.col(id_col).asc_nulls_last())
    out = ranged.select(
        *names, *place[1:],
        F.sha2("_qw_norm", 256).alias("text_sha256"),
        F.row_number().over(first).alias("_qw_rn"),
        F.min(id_col).over(run).alias("_qw_min"),
        F.count("*").over(run).alias("_qw_n"),
    )
    if not split:
        return out.select(
            *names, F.col("_qw_min").alias("keep_id"), F.col("_qw_n").alias("group_size"),
            (F.col("_qw_rn") == 1).alias("kept"), "text_sha256",
        )
    best = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_qw_salt").alias("salt")))
    whole = (
        d.where(F.col("_qw_c").isNotNull())
        .groupBy("_qw_h", "_qw_norm")
        .agg(best.alias("_qw_best"), F.count("*").alias("_qw_all"))
        .select("_qw_h", F.sha2("_qw_norm", 256).alias("text_sha256"), "_qw_best", "_qw_all")
    )
    # the texts whose hash is hot: HOT_TEXTS rows, and a few whose hash collides
    out = out.join(F.broadcast(checkpoint(whole)), ["_qw_h", "text_sha256"], "left")
    is_hot = F.col("_qw_all").isNotNull()
    return out.select(
        *names,
        F.when(is_hot, F.col("_qw_best.id")).otherwise(F.col("_qw_min")).alias("keep_id"),
        F.coalesce("_qw_all", "_qw_n").alias("group_size"),
        ((F.col("_qw_rn") == 1) & (~is_hot | (F.col("_qw_salt") == F.col("_qw_best.salt")))).alias("kept"),
        "text_sha256",
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; nulls, empty and repeated texts and ids as ``exact_dedup`` says."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH n AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
