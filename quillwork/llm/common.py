"""What the operators of this package share: checkpoints, global row numbers, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One run of the white space that the contracts name: space, tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Longs of the bit table that tells which rows may be wanted; it is sent to every task.
SLOTS = 1 << 17


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where none is set a temporary folder serves, but only in local mode: on a cluster
    a folder of one machine would not survive it.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillwork-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: columns are compressed, and only those that are needed are read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def text_of(c: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def word_count(c: str | Column) -> Column:
    """Number of runs of other characters than white space; 0 for null."""
    trimmed = F.regexp_replace(text_of(c), SPACE, " ")
    return F.when(F.trim(trimmed) == "", 0).otherwise(
        F.size(F.split(F.trim(trimmed), " "))
    ).cast("long")


def maybe_among(rows: DataFrame, name: str, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` and a boolean ``_qw_maybe``: false only where the value of ``name`` is none of ``key`` of ``wanted``, a null one too.

    A bit table of SLOTS longs goes to all tasks, so a join of the others alone need not shuffle all rows; the more are wanted, the more bits
    are set, but none is lost.
    """

    def place(c: str) -> tuple[Column, Column]:
        h = F.xxhash64(c)
        return h.bitwiseAND(SLOTS - 1), F.call_function("shiftleft", F.expr("1L"), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int"))

    slot, bit = place(key)
    table = wanted.groupBy(slot.alias("_qw_slot")).agg(F.bit_or(bit).alias("_qw_bits"))
    slot, bit = place(name)
    found = rows.withColumn("_qw_slot", slot).join(F.broadcast(table), "_qw_slot", "left")
    maybe = F.coalesce(F.col("_qw_bits").bitwiseAND(bit) != 0, F.lit(False))
    return found.withColumn("_qw_maybe", maybe).select(*rows.columns, "_qw_maybe")


def row_numbers(df: DataFrame, order: list[Column], name: str, ties: list[Column] = ()) -> DataFrame:
    """``df`` and its global row number from 0 under ``order`` then ``ties``.

    Range partitions are sorted on their own; the sizes of the partitions before give each
    one's first number.  Only one row a partition goes through the prefix sum.  The sorted rows are
    checkpointed first, since a second evaluation could choose other splitters.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpoint(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order, *ties).withColumn("_qw_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_qw_at", 33)
    sizes = placed.groupBy(part.alias("_qw_part")).agg(F.count("*").alias("_qw_n"))
    # one row a partition: a single task is enough for its running sum
    before = sizes.selectExpr(
        "_qw_part", "sum(_qw_n) over (order by _qw_part rows between unbounded preceding and 1 preceding) AS _qw_before"
    )
    return (
        placed.withColumn("_qw_part", part)
        .join(F.broadcast(before), "_qw_part")  # as many rows as there are shuffle partitions
        .withColumn(name, F.coalesce("_qw_before", F.lit(0)) + F.col("_qw_at").bitwiseAND((1 << 33) - 1))
        .drop("_qw_at", "_qw_part", "_qw_before")
    )


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Large-star and small-star steps in turn, till nothing changes: every step is an aggregate that
    combines before its shuffle and a join that adaptive execution may split, so a hub
    with a third of all edges is never one task's work.  Loops and repeated edges are allowed; a
    null end drops the edge.
    """
    x, y = F.col(a), F.col(b)
    loops = edges.where(x == y).select(x.alias("u"), y.alias("v"))
    now = checkpoint(
        edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    )
    nodes = loops.unionByName(now)
    mark = None
    while True:
        found = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if (found.n, found.h) == mark:
            break
        mark = (found.n, found.h)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(root, "u")
        now = checkpoint(
            kept.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(kept.select("u", F.col("m").alias("v")))
            .distinct()
        )
    ends = nodes.select(F.col("u").alias("node")).unionByName(nodes.select(F.col("v").alias("node"))).distinct()
    return ends.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


#: SQL: the 256 remainders of the CRC-32, and the checksum of a blob by them (``t``).
CRC_TABLE_SQL = """(SELECT list(t ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) u(i)))"""


def crc_sql(blob: str) -> str:
    """The CRC-32 of ``blob`` where ``t`` is at hand."""
    octets = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])))"
