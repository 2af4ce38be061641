"""Mixing sources to target weights.

Every document gets a hash-random key.  The key's leading bits cut a source into ranges of about
``BLOCK`` documents, each sorted on its own; the sums of the ranges before a range (one row a range) and
the running sum within it make the prefix sum of token counts within the source.  The target is
taken in whole epochs, then the last epoch is cut at the word where the budget ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, checkpoint, documents, text_of, word_count

#: Documents of a range of keys, on average; a source of any size is spread over as many ranges as it needs.
BLOCK = 8192
#: No source is taken more often than this.
EPOCHS = 3
SEED = 42


def targets(sizes: list[tuple[str | None, int]], epochs: int = EPOCHS) -> dict[str | None, float]:
    """Target of each source: weights 1, 2, 3, repeating in order of code points, null last.

    Together the sources share the sum of the sizes.  What is above ``epochs`` times a source's size is shared
    anew by weight among those below, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: i % 3 + 1 for i, (s, _) in enumerate(order)}
    most = {s: epochs * n for s, n in order}
    rest, open_, got = float(sum(n for _, n in order)), [s for s, _ in order], {}
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most[s]]
        if not full:
            return got | {s: unit * weight[s] for s in open_}
        for s in full:
            got[s] = float(most[s])
            rest -= most[s]
        open_ = [s for s in open_ if s not in got]
    return got


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = EPOCHS, seed: int = SEED
) -> DataFrame:
    """One row a document: id, source, size, source_size, target, taken.

    Size is the number of words; null and blank texts have none and nothing of them is taken.  Rows that are
    alike in id, source and size are interchangeable, so their order shows in the sums alone.
    The number of sources must suit the driver; a null source is one of its own.  An empty
    table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"),
    ).withColumn("_qw_key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary")))
    rows = checkpoint(rows)
    found = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("c")).collect()
    want = targets([(r.source, r.n) for r in found], epochs)
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(r.source, r.n, want[r.source], max(1, -(-r.c // BLOCK))) for r in found],
        "_qw_source string, source_size long, target double, _qw_blocks long",
    )
    rows = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_qw_source"))).drop("_qw_source")
    lead = F.conv(F.substring("_qw_key", 1, 8), 16, 10).cast("long")  # 32 bits
    rows = rows.withColumn("_qw_block", F.shiftright(lead * F.col("_qw_blocks"), 32))
    range_ = Window.partitionBy("source", "_qw_block")
    inside = range_.orderBy("_qw_key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "_qw_block").agg(F.sum("size").alias("_qw_sum"))
    ranges = Window.partitionBy("source").orderBy("_qw_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        F.col("source").alias("_qw_s"), F.col("_qw_block").alias("_qw_b"), F.coalesce(F.sum("_qw_sum").over(ranges), F.lit(0)).alias("_qw_before")
    )
    here = F.col("source").eqNullSafe(F.col("_qw_s")) & (F.col("_qw_block") == F.col("_qw_b"))
    start = F.col("_qw_before") + F.coalesce("_qw_in", F.lit(0))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.call_function("div", budget, F.greatest("source_size", F.lit(1)))).otherwise(0)
    rest = F.col("_qw_budget") - F.col("_qw_whole") * F.col("source_size")
    return (
        rows.withColumn("_qw_in", F.sum("size").over(inside))
        .join(before, here)
        .withColumn("_qw_start", start)
        .withColumn("_qw_budget", budget)
        .withColumn("_qw_whole", whole)
        .withColumn("taken", F.col("_qw_whole") * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - F.col("_qw_start"))))
        .select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix has them: each row as often as it is taken, in its own columns.

    The document at which a source's budget ends comes with the words that are still in it; a document
    of which nothing is taken is left out.  The ids must tell the documents apart; rows that repeat an id
    with a text of equal size are taken alike.
    """
    names = docs.columns
    taken = mix(docs, id_col, text_col, source_col, epochs, seed).where("taken > 0")
    taken = taken.groupBy("doc_id", "source", "size").agg(F.max("taken").alias("_qw_taken"))
    d = docs.withColumn("_qw_size", word_count(text_col))
    same = d[id_col].eqNullSafe(taken["doc_id"]) & d[source_col].eqNullSafe(taken["source"]) & (d["_qw_size"] == taken["size"])
    both = d.join(taken, same).select(*[d[c] for c in names], "_qw_size", "_qw_taken")
    times = F.ceil(F.col("_qw_taken") / F.col("_qw_size")).cast("int")
    left = F.col("_qw_taken") - (F.col("_qw_copy") - 1) * F.col("_qw_size")
    body = F.regexp_replace(text_of(text_col), "^" + SPACE, "")
    after = F.element_at(F.split(body, SPACE, (left + 1).cast("int")), -1)
    cut = F.substring(body, F.lit(1), F.char_length(body) - F.char_length(after))
    return both.withColumn("_qw_copy", F.explode(F.sequence(F.lit(1), times))).select(
        *[F.when(left < F.col("_qw_size"), cut).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in names]
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; null, empty, long and repeated texts, and null sources, as ``mix`` says."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
  md5('{SEED}:' || coalesce(doc_id::VARCHAR, '-')) AS key FROM documents),
w AS (SELECT *, (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1 AS weight, {EPOCHS} * n AS most FROM (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source)),
-- in this order sources fill up one after the other, until one stays below its limit
f AS (SELECT *, most / weight AS level, ((sum(n) OVER ()) - coalesce(sum(most) OVER before, 0))::DOUBLE / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0))::DOUBLE AS unit
  FROM w WINDOW before AS (ORDER BY most / weight, weight, source COLLATE "binary" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, n, CASE WHEN unit * weight > most THEN most::DOUBLE ELSE (SELECT arg_min(unit, level) FROM f WHERE unit * weight <= most) * weight END AS target FROM f),
r AS (SELECT d.doc_id, d.size, t.n AS source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
  + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - start)))::BIGINT AS taken FROM r"""
