"""Sharding by a Feistel permutation of the global row numbers.

The rows get their number in the order of the ids, by a distributed prefix sum.  A mixed-radix
Feistel network over a x b >= N cells permutes the numbers; a cell from N on is sent through the
network again (cycle walking) until it falls below N.  Place p gives shard p mod k and slot p div k, so both
can be computed from the row number alone, and the sizes of the shards differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, checkpoint, crc_sql, documents, row_numbers, text_of

ROUNDS = 4
SEED = 42
SHARDS = 16


def _noise(v: Column, i: Column, seed: int) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(seed), i, v).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("long"))


def sides(n: int) -> tuple[int, int]:
    """The near-square a x b that holds n cells and fewer than a more."""
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def feistel(x: Column, n: int, seed: int = SEED) -> Column:
    """One pass of the network over the a x b cells that hold 0 to n - 1; a permutation of them."""
    a, b = sides(n)

    def step(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + _noise(s["r"], i, seed), F.lit(a)).cast("long")
        right = F.pmod(s["r"] + _noise(s["l"], i, seed), F.lit(b)).cast("long")
        turn = i % 2 == 0
        return F.struct(F.when(turn, left).otherwise(s["l"]).alias("l"), F.when(turn, s["r"]).otherwise(right).alias("r"))

    start = F.struct((x % a).cast("long").alias("l"), _div(x, a).alias("r"))
    steps = F.array(*[F.lit(i) for i in range(2 * ROUNDS)])
    return F.aggregate(steps, start, step, lambda s: s["l"] + s["r"] * a)


def longest_walk(spark: SparkSession, n: int, seed: int = SEED) -> int:
    """The most passes that any number below n needs, found from the fewer than a cells beyond n."""
    a, b = sides(n)
    out, passes = spark.range(n, a * b).toDF("p"), 1
    while not out.isEmpty():
        out = checkpoint(out.select(feistel(F.col("p"), n, seed).alias("p")).where(F.col("p") >= n))
        passes += 1
        if passes > a * b - n + 1:  # what is left goes round among the cells beyond n, and no row comes there
            break
    return passes


def permute(spark: SparkSession, row: Column, n: int, seed: int = SEED) -> Column:
    """The place from 0 to n - 1 of row number ``row``."""
    again = longest_walk(spark, n, seed) - 1
    place = feistel(row, n, seed)
    if again:
        walk = F.array(*[F.lit(i) for i in range(again)])
        place = F.aggregate(walk, place, lambda p, _: F.when(p < n, p).otherwise(feistel(p, n, seed)))
    return place


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: id, size, text_crc32, row, shard and slot.

    Size is the number of bytes of the text and 1; a null text has none.  Rows are numbered by id,
    a null id first, then by checksum and size; rows equal in all three are alike, so their order shows
    nowhere.  Other columns are not read.  An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text_of(text_col)).cast("long") + 1).alias("size"),
        F.crc32(text_of(text_col).cast("binary")).cast("long").alias("text_crc32"),
    )
    spark = docs.sparkSession
    numbered = row_numbers(rows, [F.col("doc_id").asc_nulls_first()], "row", [F.col("text_crc32"), F.col("size")])
    n = max(1, docs.count())
    place = numbered.withColumn("_qw_p", permute(spark, F.col("row"), n, seed))
    return place.select(
        "doc_id", "size", "text_crc32", "row",
        (F.col("_qw_p") % shards).cast("int").alias("shard"),
        _div(F.col("_qw_p"), shards).alias("slot"),
    )


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` under the law ``rows``: null, empty, long and repeated texts as ``shard`` says."""
    return shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _half(k: int, side: str) -> str:
    """One half round: the one side moves by a hash of the other."""
    a, b = ("l", "r") if side == "l" else ("r", "l")
    noise = f"('0x' || substr(md5('{SEED}:{k}:' || {b}), 1, 8))::BIGINT"
    return f"({a} + {noise}) % {'a' if side == 'l' else 'b'} AS {a}, {b}"


def _pass(source: str) -> str:
    """One pass of the network over ``source`` (doc_id, size, text_crc32, row, n, a, b, p)."""
    keep = "doc_id, size, text_crc32, row, n, a, b"
    out = f"SELECT {keep}, p % a AS l, p // a AS r FROM {source}"
    for k in range(2 * ROUNDS):
        out = f"SELECT {keep}, {_half(k, 'lr'[k % 2])} FROM ({out})"
    return f"SELECT {keep}, l + r * a AS p FROM ({out})"


OP3_SQL = f"""WITH RECURSIVE crc AS MATERIALIZED {CRC_TABLE_SQL},
d AS MATERIALIZED (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc_sql("encode(coalesce(text, ''))")} AS text_crc32 FROM documents, crc),
s AS (SELECT *, floor(sqrt(greatest(n - 1, 0)))::BIGINT + 1 AS a FROM (SELECT count(*) AS n FROM d)),
numbered AS MATERIALIZED (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row, n, a, greatest(1, (n + a - 1) // a) AS b FROM d, s),
walk AS ({_pass("(SELECT *, row AS p FROM numbered)")} UNION ALL {_pass("(SELECT * FROM walk WHERE p >= n)")})
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {SHARDS})::INTEGER AS shard, p // {SHARDS} AS slot, NULL::INTEGER AS grown_shard FROM walk WHERE p < n"""
