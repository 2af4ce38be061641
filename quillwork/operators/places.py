"""Places of rows in the order of their groups, without a task that holds a group."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in the folder that ``spark.checkpoint.dir`` names; one of this machine serves in local mode alone."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quillwork-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def places(rows: DataFrame, group: str, order: list[Column | str], name: str = "place") -> DataFrame:
    """``rows`` and the place of each, from 0, in its group under ``order``.

    Rows are sorted by ranges of group and order; what the ranges before hold of a group gives a range's first place.  The sorted rows are
    kept first, since a second evaluation could choose other ranges.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    rows = kept(rows).withColumn("_range", F.shiftright("_at", 33))
    # one row a range and group: a group's begin and, over the ranges before, its number of rows
    parts = rows.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = parts.alias("x").join(parts.select(F.col(group).alias("_group"), F.col("_range").alias("_other"), F.col("_n").alias("_m")).alias("y"),
                                   F.col(f"x.{group}").eqNullSafe(F.col("_group")) & (F.col("_other") < F.col("_range")), "left")
    before = before.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_other"), "_first").agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_before"))
    both = rows.join(before, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_other")))
    return both.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_group", "_other", "_first", "_before")
