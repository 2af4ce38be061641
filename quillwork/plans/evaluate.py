"""The evaluation as one plan: predictions of all models and test files, their metrics, eight tables and a workbook."""

from __future__ import annotations

import argparse
import dataclasses
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EVALUATION, SEED
from ..functions import text as T
from ..operators import metrics as M
from ..operators import reports as P
from ..sources import readers, writers

TEST_FILES = tuple(f"{name}.jsonl" for name in T.CONDITIONS if name not in ("test_noisy_easy", "test_noisy_hard"))


@dataclass(frozen=True)
class Model:
    """A summariser whose predictions are evaluated."""

    key: str
    architecture: str
    train_setting: str


def prediction_path(folder: str, model: Model, test_file: str) -> str:
    return f"{folder}/{model.key}__{test_file.rsplit('/', 1)[-1].rsplit('.', 1)[0]}.jsonl"


def predict(rows: DataFrame, out: str, model: Model, test_file: str, predictor, overwrite: bool = False) -> bool:
    """Writes the predictions of ``rows`` (input_text and more) by a plugged-in ``predictor``, which takes a series of inputs and gives one of texts;
    False if they are there already."""
    def go(inputs: pd.Series) -> pd.Series:
        return pd.Series(list(predictor(inputs)), dtype=object)

    told = rows.withColumn("prediction_text", F.pandas_udf(go, "string")(F.col("input_text")))
    told = told.withColumns({"model_key": F.lit(model.key), "architecture": F.lit(model.architecture), "train_setting": F.lit(model.train_setting), "test_file": F.lit(test_file)})
    return writers.json_lines(told, prediction_path(out, model, test_file), unify=False, overwrite=overwrite)


def predictions(spark: SparkSession, folder: str, models: list[Model], test_files: tuple[str, ...] = TEST_FILES, limit: int | None = None) -> DataFrame:
    """The prediction rows of every model and test file, with the columns that say whose they are; an error if a file is missing."""
    parts = []
    for m in models:
        for name in test_files:
            path = prediction_path(folder, m, name)
            if not writers.exists(spark, path):
                raise FileNotFoundError(f"no predictions in {path}")
            rows = readers.json_lines(spark, path, limit=limit)
            parts.append(rows.withColumns({"model_key": F.lit(m.key), "architecture": F.lit(m.architecture), "train_setting": F.lit(m.train_setting), "test_file": F.lit(name)}))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows


def records(rows: DataFrame, stemmed: bool = True, scorer=None) -> DataFrame:
    """The metric record of each prediction row; what a row lacks of flags and counts is empty."""
    lacks = {
        "context_hit_flags": F.array().cast("array<int>"), "retrieved_hit_flags": F.array().cast("array<int>"),
        "num_noise_chunks": F.lit(None).cast("int"), "num_contexts": F.lit(None).cast("int"),
    }
    rows = rows.withColumns({c: v for c, v in lacks.items() if c not in rows.columns})
    rows = rows.withColumns({"condition": T.condition_from_filename(F.col("test_file")), "paper_id_norm": T.normalize_paper_id(F.col("paper_id").cast("string"))})
    return M.record_metrics(rows, F.lower(F.col("architecture")), stemmed, scorer)


def tables(rows: DataFrame, bootstrap: bool = True) -> dict[str, DataFrame]:
    """The reports over metric records."""
    metrics = list(dict.fromkeys([m for m in M.CORE if m in rows.columns] + P.retrieval_columns(rows)))
    return {
        "compact": P.compact(rows), "summary": P.summary(rows, metrics, bootstrap=bootstrap), "noiseaware_against_clean": P.noiseaware_against_clean(rows, metrics),
        "degradation": P.degradation(rows, metrics), "additive_against_substitutive": P.additive_against_substitutive(rows, metrics),
        "retrieval": P.retrieval(rows), "truncation": P.truncation(rows),
    }


def evaluate(rows: DataFrame, out: str, stemmed: bool = True, scorer=None, bootstrap: bool = True, options: dict | None = None) -> dict[str, DataFrame]:
    """Writes the options, the records, each table and the workbook below ``out``; returns the tables as read back.

    The records are computed once: the tables read what has been written.
    """
    spark = rows.sparkSession
    writers.manifest(spark, {**dataclasses.asdict(EVALUATION), "seed": SEED, **(options or {})}, f"{out}/config.json")
    records(rows, stemmed, scorer).write.mode("overwrite").parquet(f"{out}/records")
    done = spark.read.parquet(f"{out}/records")
    writers.csv(done, f"{out}/records.csv")
    made = tables(done, bootstrap)
    for name, table in made.items():
        table.write.mode("overwrite").parquet(f"{out}/tables/{name}")
    made = {name: spark.read.parquet(f"{out}/tables/{name}") for name in made}
    for name, table in made.items():
        writers.csv(table, f"{out}/{name}.csv")
    writers.workbook({**made, "records": done}, f"{out}/workbook.xlsx")
    return made


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("predictions", help="folder of <model>__<test file>.jsonl")
    p.add_argument("out")
    p.add_argument("--model", action="append", required=True, metavar="KEY:ARCHITECTURE:SETTING")
    p.add_argument("--test-file", action="append")
    p.add_argument("--limit", type=int)
    p.add_argument("--plain-tokens", action="store_true", help="ROUGE without stems")
    p.add_argument("--no-bootstrap", action="store_true")
    a = p.parse_args(argv)
    models = [Model(*m.split(":")) for m in a.model]
    spark = SparkSession.builder.getOrCreate()
    rows = predictions(spark, a.predictions, models, tuple(a.test_file or TEST_FILES), a.limit)
    evaluate(rows, a.out, not a.plain_tokens, bootstrap=not a.no_bootstrap, options={"models": [dataclasses.asdict(m) for m in models], "limit": a.limit})


if __name__ == "__main__":
    main()
