"""Readers: papers, tab-separated and JSON lines, and profiles of what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as types_

from ..functions import text as T


def papers(rows: DataFrame, article: str = "article", abstract: str = "abstract") -> DataFrame:
    """``(article, abstract)`` cleaned, lists joined by newline and by space, without rows where either is empty.

    ``rows`` comes of any reader that Spark has (Parquet, ORC, JSON); other columns stay.
    """
    kinds = dict(rows.dtypes)
    clean = {
        c: T.clean_field(F.col(c), joint, kinds[c].startswith("array")) for c, joint in ((article, "\n"), (abstract, " "))
    }
    return rows.withColumns(clean).where((F.col(article) != "") & (F.col(abstract) != ""))


def arrow_table(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Parquet, or Arrow IPC files, each read where its task runs; ``split`` names a folder of a data set that has several."""
    if split and not path.rstrip("/").endswith(".parquet"):
        path = f"{path.rstrip('/')}/{split}"
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    import pyarrow as pa

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(path)
    first = files.select("content").first()
    if first is None:
        raise FileNotFoundError(f"no Arrow files in {path}")

    def opened(content: bytes) -> pa.RecordBatchReader:
        source = pa.BufferReader(content)
        try:
            return pa.ipc.open_stream(source)
        except pa.ArrowInvalid:
            return pa.ipc.open_file(source).read_all().to_reader()

    from pyspark.sql.pandas.types import from_arrow_schema

    schema = from_arrow_schema(opened(first.content).schema)

    def go(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                yield from opened(content)

    return files.select("content").mapInArrow(go, schema)


def tab_separated(spark: SparkSession, path: str) -> DataFrame:
    """The first two fields of lines that have two, trimmed, neither empty; no quoting."""
    parts = F.split(F.col("value"), "\t")
    rows = spark.read.text(path).where(F.size(parts) >= 2)
    rows = rows.select(F.trim(parts[0]).alias("article"), F.trim(parts[1]).alias("abstract"))
    return rows.where("article <> '' AND abstract <> ''")


def json_lines(spark: SparkSession, path: str, schema: types_.StructType | str | None = None, limit: int | None = None) -> DataFrame:
    """One row a line that is not blank; the first ``limit`` of the files if given."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    rows = reader.json(path)
    return rows if limit is None else rows.limit(limit)


def data_set(spark: SparkSession, train: str, valid: str, text: str = "input_text", target: str = "target_text") -> dict[str, DataFrame]:
    """Training and validation rows whose text and target are not blank; an error if a file is missing or has none."""
    out = {}
    for name, path in (("train", train), ("validation", valid)):
        rows = spark.read.json(path)
        missing = {text, target} - set(rows.columns)
        if missing:
            raise ValueError(f"{path} has no {sorted(missing)}")
        rows = rows.where((T.normalize_space(F.col(text), False) != "") & (T.normalize_space(F.col(target), False) != ""))
        if rows.isEmpty():
            raise ValueError(f"{path} has no rows that are not blank")
        out[name] = rows
    return out


def json_cell(c: Column, kind: str) -> Column:
    """A cell that holds JSON, as ``kind``; null if it is blank or can't be read so."""
    return F.from_json(F.when(F.trim(c) != "", c), kind)


def json_cell_or_text(c: Column) -> Column:
    """A cell that holds JSON as a variant; one that can't be read as such as a variant of its text, a blank one null."""
    text = F.when(F.trim(c) != "", c)
    quoted = F.to_json(F.struct(text.alias("t")))  # {"t":"..."}
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.substring(quoted, F.lit(6), F.length(quoted) - 6)))


def profile(rows: DataFrame, text: str, target: str, most: int | None = 200_000) -> DataFrame:
    """One row: rows, empty texts and targets, and the least, mean, 95th percentile and greatest number of words of each.

    At most the first ``most`` rows are looked at, as it is a quick look; None looks at all.
    """
    few = rows if most is None else rows.limit(most)
    n = {"input": T.word_count(F.col(text)), "target": T.word_count(F.col(target))}
    few = few.select(*[c.alias(k) for k, c in n.items()])
    aggs = [F.count("*").alias("rows")] + [F.count_if(F.col(k) == 0).alias(f"empty_{k}") for k in n]
    for k in n:
        aggs += [F.min(k).alias(f"{k}_min"), F.round(F.avg(k), 6).alias(f"{k}_mean"), F.round(F.percentile(k, F.lit(0.95)), 6).alias(f"{k}_p95"), F.max(k).alias(f"{k}_max")]
    return few.agg(*aggs)


def validate_file(spark: SparkSession, path: str, text: str = "input_text", target: str = "target_text") -> DataFrame:
    """``validate`` of a JSON-lines file, with ``exists``; of an absent one there is that and no count."""
    from .writers import exists

    if exists(spark, path):
        return validate(spark.read.json(path), text, target).withColumn("exists", F.lit(True))
    nothing = validate(spark.createDataFrame([], f"{text} string, {target} string"), text, target)
    return nothing.select(*[F.lit(None).cast(k).alias(c) for c, k in nothing.dtypes], F.lit(False).alias("exists"))


def validate(rows: DataFrame, text: str = "input_text", target: str = "target_text") -> DataFrame:
    """One row: rows, empty texts and targets, and the least, mean and greatest number of target words."""
    words = T.word_count(F.col(target))
    return rows.agg(
        F.count("*").alias("n"), F.count_if(T.normalize_space(F.col(text), False) == "").alias("empty_input"),
        F.count_if(words == 0).alias("empty_target"), F.min(words).alias("target_min"), F.round(F.avg(words), 6).alias("target_mean"), F.max(words).alias("target_max"),
    )
