"""Selecting papers and pools, and assembling the rows of the data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BUILD, INPUTS, K_VALUES, SEED, TARGETS
from ..functions import text as T


def drop_reason(article: Column, target: Column, least: int = TARGETS.min_words, most: int = TARGETS.max_words) -> Column:
    """Why a paper is dropped, null if it stays; the first reason counts."""
    n = T.word_count(target)
    return (
        F.when(T.normalize_space(article, False) == "", "empty_article")
        .when(T.normalize_space(target, False) == "", "empty_target")
        .when(n < least, "too_short")
        .when(n > most, "too_long")
    )


def filter_report(papers: DataFrame, split: Column, target: Column, reason: Column) -> DataFrame:
    """One row a split and reason (kept, or why not): papers, and the least, mean and greatest number of target words."""
    rows = papers.select(split.alias("split"), F.coalesce(reason, F.lit("kept")).alias("reason"), T.word_count(target).alias("n"))
    return rows.groupBy("split", "reason").agg(
        F.count("*").alias("papers"), F.min("n").alias("min_words"), F.round(F.avg("n"), 6).alias("mean_words"), F.max("n").alias("max_words")
    )


def non_empty(rows: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        rows = rows.where(T.normalize_space(F.col(c), False) != "")
    return rows


def positions(papers: DataFrame, order: str, by: str | None = None) -> DataFrame:
    """``papers`` with ``pos`` from 0, by ``order``; within ``by`` if given.  Without it the numbers come from range partitions
    and the sums of those before, so no task sorts all rows."""
    if by:
        return papers.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
    n = int(papers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = papers.agg(F.min(order).alias("a"), F.max(order).alias("z")).first()
    if width.a is None:
        return papers.withColumn("pos", F.lit(0).cast("long")).limit(0)
    step = max(1, -(-(int(width.z) - int(width.a) + 1) // (4 * n)))
    part = F.floor((F.col(order) - int(width.a)) / step)
    rows = papers.withColumn("_part", part)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # 4 n rows at most
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return rows.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn("pos", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def position_range(papers: DataFrame, order: str, begin: int, end: int) -> DataFrame:
    """The papers at positions begin to end - 1."""
    return positions(papers, order).where((F.col("pos") >= begin) & (F.col("pos") < end))


def pool_range(mode: str, total: int, train_limit: int = BUILD.train_limit, limit: int = BUILD.noise_pool_limit, offset: int | None = None) -> tuple[int, int]:
    """Positions of the papers that distractors come from.

    ``heldout_train_tail`` starts behind the training papers, or at ``offset``, and must not reach into them;
    ``legacy_train_pool`` is the training papers themselves.
    """
    if limit < 0 or (offset or 0) < 0:
        raise ValueError("limit and offset must not be negative")
    if mode == "legacy_train_pool":
        return 0, min(limit, total)
    if mode != "heldout_train_tail":
        raise ValueError(f"no such mode: {mode}")
    begin = train_limit if offset is None else offset
    end = min(begin + limit, total)
    if begin >= total or end <= begin:
        raise ValueError("the pool is empty: it begins behind the last paper")
    if begin < min(train_limit, total):
        raise ValueError("the pool overlaps the training papers")
    return begin, end


def disjoint(*ranges: tuple[int, int]) -> None:
    """An error if two of the ranges overlap."""
    taken = sorted(r for r in ranges if r[1] > r[0])
    for (_, end), (begin, _) in zip(taken, taken[1:]):
        if begin < end:
            raise ValueError(f"ranges overlap at {begin}")


def input_text(query: Column, contexts: Column, prefix: str = "summarize", most: int | None = None) -> Column:
    """The model's input: prefix, question and the contexts that are not blank, each cut, then cut as a whole."""
    chosen = contexts if most is None else F.slice(contexts, 1, max(most, 0))
    cut = F.filter(F.transform(chosen, lambda c: T.truncate_words(c, INPUTS.context_words)), lambda c: c != "")
    whole = F.concat_ws(" ", F.lit(f"{prefix}: question:"), T.truncate_words(query, INPUTS.query_words), F.lit("context:"), F.array_join(cut, " "))
    return F.when(F.size(cut) > 0, T.truncate_words(whole, INPUTS.input_words))


def examples(rows: DataFrame, query: Column, contexts: Column, target: Column, prefix: str = "summarize") -> tuple[DataFrame, DataFrame]:
    """``rows`` with input_text and target_text; and those that can't be examples, with the reason."""
    cut = T.truncate_words(target, INPUTS.target_words)
    # told from the begin of the texts, so that the filter doesn't assemble them
    reason = F.when(T.blank(target), "empty_target").when(~F.coalesce(F.exists(contexts, lambda c: ~T.blank(c)), F.lit(False)), "empty_contexts")
    good = rows.where(reason.isNull()).withColumns({"input_text": input_text(query, contexts, prefix), "target_text": cut})
    return good, rows.withColumn("reject_reason", reason).where("reject_reason is not null")


def gold_at_k(ranked: Column, relevant: Column, k: int, size: Column | None = None) -> Column:
    """retrieved, hits, precision over what was retrieved and recall over all relevant ones, among the first k.

    With their number as ``size``, ``relevant`` may hold only those that are ranked."""
    top = F.slice(ranked, 1, k)
    hits = F.size(F.filter(top, lambda x: F.array_contains(relevant, x)))
    return F.struct(
        F.size(top).alias("retrieved"), hits.alias("hits"),
        (hits / F.greatest(F.size(top), F.lit(1))).alias("precision"), (hits / F.greatest(F.size(relevant) if size is None else size, F.lit(1))).alias("recall"),
    )


def retrieval_payload(rows: DataFrame, ids: str, sources: str, scores: str, relevant: str, prefix: str = "retrieval_", ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """``rows`` with the hit flags, the counts and the four measures at each k (``{prefix}hits@3`` and so on)."""
    new = {
        f"{prefix}hit_flags": F.transform(F.col(ids), lambda x: F.array_contains(F.col(relevant), x).cast("int")),
        f"num_{prefix}chunks": F.size(ids), f"num_{prefix}sources": F.size(F.array_distinct(sources)), f"num_{prefix}relevant": F.size(relevant),
        f"{prefix}scores": F.transform(F.col(ids), lambda _, i: F.get(F.col(scores), i)),
    }
    for k in ks:
        at = gold_at_k(F.col(ids), F.col(relevant), k)
        new |= {f"{prefix}{name}@{k}": at[name] for name in ("retrieved", "hits", "precision", "recall")}
    return rows.withColumns(new)


def repeated_controls(clean: DataFrame, copies: int = 3) -> DataFrame:
    """Each clean row so many times, with the number of its copy: as many rows as the noise-aware training has."""
    return clean.withColumn("clean_control_copy_id", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumns(
        {"clean_control_num_copies": F.lit(copies), "train_setting": F.lit("clean_matched"), "matched_to_noiseaware_rows": F.lit(True)}
    )


def unique_request(needed: int, oversample: float = BUILD.oversample) -> int:
    """How many extra papers to ask for, so that enough stay."""
    return 0 if needed <= 0 else max(int(needed * max(oversample, 1.0)) + 1000, needed)


def unique_controls(primary: DataFrame, extra: DataFrame, desired: int, order: str = "paper_id", check: bool = True) -> DataFrame:
    """``desired`` clean rows of different papers: those of ``primary`` first, then ``extra``; the first row of each id that is not blank.
    An error if there are too few."""
    rows = primary.withColumn("_from", F.lit(0)).unionByName(extra.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    rows = rows.where(F.trim(T.text_of(F.col("paper_id"))) != "")
    first = F.row_number().over(Window.partitionBy("paper_id").orderBy("_from", order))
    rows = rows.withColumn("_first", first).where("_first = 1").orderBy("_from", order, "paper_id").limit(desired)
    if check and (found := rows.count()) < desired:
        raise ValueError(f"only {found} of {desired} papers differ")
    source = F.when(F.col("_from") == 0, "primary").otherwise("extra")
    return rows.withColumns(
        {
            "clean_control_mode": F.lit("unique"), "clean_control_source": source, "clean_control_uses_unique_paper_ids": F.lit(True),
            "clean_control_copy_id": F.lit(0), "clean_control_num_copies": F.lit(1), "train_setting": F.lit("clean_matched"),
            "matched_to_noiseaware_rows": F.lit(True),
        }
    ).drop("_from", "_first")


def marked(rows: DataFrame, design: str) -> DataFrame:
    """``rows`` with their noise design; substitutive ones say so in their mode."""
    if design not in ("clean", "additive", "substitutive"):
        raise ValueError(f"no such design: {design}")
    mode = F.col("noise_mode")
    mode = F.lit("clean") if design == "clean" else F.when(mode.endswith("_substitutive"), mode).otherwise(F.concat(mode, F.lit("_substitutive"))) if design == "substitutive" else mode
    return rows.withColumns({"noise_design": F.lit(design), "noise_mode": mode})


LIST_COLUMNS = (
    "noise_chunk_ids noise_source_doc_ids retrieved_chunk_ids retrieved_source_doc_ids retrieved_scores retrieved_hit_flags "
    "relevant_chunk_ids context_chunk_ids context_source_doc_ids context_hit_flags"
).split()
DEFAULTS = {"num_noise_chunks": 0, "noise_source": "none", "noise_mode": "clean"}
_ELEMENT = {"retrieved_scores": "double", "retrieved_hit_flags": "int", "context_hit_flags": "int"}


def one_schema(*parts: DataFrame) -> DataFrame:
    """All rows with the columns of all parts, in order of their first appearance; lists default to empty ones, the mode to clean."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    new = {c: F.coalesce(F.col(c), F.array().cast(f"array<{_ELEMENT.get(c, 'string')}>")) for c in LIST_COLUMNS if c in rows.columns}
    new |= {c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items() if c in rows.columns}
    return rows.withColumns(new) if new else rows


def shuffled(rows: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """The rows in a reproducible order."""
    return rows.orderBy(T.keyed(seed, F.col(key), "shuffle"), key)


def with_section(section: Column, text: Column) -> Column:
    """A chunk's text behind its section's title in brackets, where there is one."""
    title = T.normalize_space(section, False)
    return F.when(title != "", F.concat(F.lit("["), title, F.lit("] "), text)).otherwise(text)


def fit_contexts(contexts: Column, budget: int = 900, each: int = 220, least: int = 32) -> Column:
    """The contexts, each cut to ``each`` words, that fit the budget; the first that doesn't is cut to what is left if that is ``least`` words or more."""
    cut = F.transform(contexts, lambda c: T.truncate_words(c, each))
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        n = F.size(T.words(c))
        rest = F.lit(budget) - a["n"]
        fits = ~a["full"] & (n <= rest)
        part = ~a["full"] & (n > rest) & (rest >= least)
        head = F.array_join(F.slice(T.words(c), F.lit(1), F.greatest(rest, F.lit(0))), " ")
        out = F.when(fits & (n > 0), F.concat(a["out"], F.array(c))).when(part, F.concat(a["out"], F.array(head))).otherwise(a["out"])
        return F.struct(F.when(fits, a["n"] + n).otherwise(a["n"]).alias("n"), (a["full"] | (n > rest)).alias("full"), out.alias("out"))

    return F.aggregate(cut, start, step, lambda a: a["out"])
