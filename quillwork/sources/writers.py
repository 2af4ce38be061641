"""Writers: JSON lines, CSV, manifests, and the data set as one table by condition."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EVALUATION
from ..operators.assemble import one_schema


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def json_lines(rows: DataFrame, path: str, unify: bool = True, overwrite: bool = True) -> bool:
    """Writes one JSON object a line, nulls too; with ``unify`` the list columns are never null.  Without ``overwrite`` what is there stays, and
    False says so."""
    if not overwrite and exists(rows.sparkSession, path):
        return False
    (one_schema(rows) if unify else rows).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return True


def csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; arrays and structs as JSON."""
    nested = [c for c, k in rows.dtypes if k.startswith(("array", "struct", "map"))]
    rows.withColumns({c: F.to_json(f"`{c}`") for c in nested}).write.mode("overwrite").option("header", True).csv(path)


def workbook(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """A sheet for each table, at most so many rows of the records; as a folder of CSV files where no workbook writer is installed."""
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        out = {}
        for name, t in tables.items():
            out[name] = f"{path}/{name}"
            csv(t.limit(EVALUATION.xlsx_rows), out[name])
        return out
    import pandas as pd

    with pd.ExcelWriter(path) as book:
        for name, t in tables.items():
            t.limit(EVALUATION.xlsx_rows).toPandas().to_excel(book, sheet_name=name[:31], index=False)
    return dict.fromkeys(tables, path)


def manifest(spark: SparkSession, content: dict, path: str) -> None:
    """A small JSON file, through the session's file system."""
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(content, indent=2, ensure_ascii=False, default=str).encode()))
    out.close()


#: The files of a data set, and which split, training setting, design and mode each holds.
FILES = {
    "train": ("train", "noiseaware", None, None), "train_noiseaware": ("train", "noiseaware", None, None), "train_clean_matched": ("train", "clean_matched", None, None),
    "valid": ("validation", "noiseaware", None, None), "valid_noiseaware": ("validation", "noiseaware", None, None),
    "valid_clean_matched": ("validation", "clean_matched", None, None), "test_clean": ("test", None, "clean", None),
    "test_noisy_easy": ("test", None, "additive", "easy"), "test_noisy_hard": ("test", None, "additive", "hard"),
    "test_noisy_easy_additive": ("test", None, "additive", "easy"), "test_noisy_hard_additive": ("test", None, "additive", "hard"),
    "test_noisy_easy_substitutive": ("test", None, "substitutive", "easy"), "test_noisy_hard_substitutive": ("test", None, "substitutive", "hard"),
}


def data_set(rows: DataFrame, path: str) -> None:
    """All example rows (split, noise_design, noise_mode) as one Parquet table by split and design."""
    one_schema(rows).write.mode("overwrite").partitionBy("split", "noise_design").parquet(path)


def data_file(table: DataFrame, name: str) -> DataFrame:
    """The rows of one file of the data set; partitions it doesn't need are not read."""
    split, setting, design, level = FILES[name]
    rows = table.where(F.col("split") == split)
    if setting and "train_setting" in table.columns:
        rows = rows.where(F.col("train_setting") == setting)
    if design:
        rows = rows.where(F.col("noise_design") == design)
    return rows.where(F.col("noise_mode").contains(level)) if level else rows
