"""Metrics of single predictions.  Each block is a list of Column expressions over shared token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EVALUATION, K_VALUES, TOKENS_PER_WORD
from ..functions import rouge as R
from ..functions import text as T

LOWER_IS_BETTER = ("absolute_degradation", "relative_degradation", "repetition_2gram_rate", "unsupported_entity_rate", "unsupported_number_rate")
CORE = (
    [f"rouge{x}" for x in ("1", "2", "L", "Lsum")] + "bertscore_f1 entity_f1_ref source_supported_entity_rate unsupported_entity_rate number_f1_ref unsupported_number_rate".split()
    + "source_token_support_rate sentence_support_proxy distinct_1 distinct_2 repetition_2gram_rate novel_2gram_ratio".split()
)


def direction(metric: Column) -> Column:
    return F.when(metric.isin(*LOWER_IS_BETTER), "lower_is_better").otherwise("higher_is_better")


def lengths(rows: DataFrame, family: Column | None = None) -> DataFrame:
    """Words and subword tokens of source, target and prediction; risk of truncation; length ratios.

    ``family`` names the model's tokenizer (a key of TOKENS_PER_WORD); the common one is bart's.
    """
    own = F.lit(TOKENS_PER_WORD["bart"])
    if family is not None:
        for name, rate in TOKENS_PER_WORD.items():
            own = F.when(family == name, F.lit(rate)).otherwise(own)
    new: dict[str, Column] = {}
    for side, c in (("source", "input_text"), ("target", "target_text"), ("prediction", "prediction_text")):
        n = T.word_count(F.col(c))
        new[f"{side}_words"] = n
        new[f"{side}_tokens"] = F.floor(F.round(n * F.lit(TOKENS_PER_WORD["bart"]), 6)).cast("long")
        new[f"{side}_tokens_model_tokenizer"] = F.floor(F.round(n * own, 6)).cast("long")
    rows = rows.withColumns(new)
    risk = {
        f"{side}_truncated_risk{kind}": F.col(f"{side}_tokens{kind}") > most
        for side, most in (("source", EVALUATION.max_source_tokens), ("target", EVALUATION.max_target_tokens))
        for kind in ("", "_model_tokenizer")
    }
    p, s, t = (F.col(f"{x}_tokens_model_tokenizer") for x in ("prediction", "source", "target"))
    return rows.withColumns(risk | {"compression_ratio_pred_over_source_tokens": T.safe_div(p, s), "length_ratio_pred_over_target_tokens": T.safe_div(p, t)})


def lexical(rows: DataFrame) -> DataFrame:
    """Distinct n-grams, repetition, copies from the source and support by it."""
    rows = rows.withColumns({"_p": T.tokens(F.col("prediction_text")), "_s": T.tokens(F.col("input_text"))})
    rows = rows.withColumns({f"_{x}{n}": T.ngrams(F.col(f"_{x}"), n) for x in "ps" for n in (2, 3)})
    new = {
        "distinct_1": T.safe_div(F.size(F.array_distinct("_p")), F.size("_p")),
        "distinct_2": T.safe_div(F.size(F.array_distinct("_p2")), F.size("_p2")),
        "repetition_2gram_rate": T.safe_div(F.size("_p2") - F.size(F.array_distinct("_p2")), F.size("_p2")),
    }
    for n in (2, 3):
        copied = T.safe_div(F.size(F.array_intersect(f"_p{n}", f"_s{n}")), F.size(F.array_distinct(f"_p{n}")))
        new |= {f"source_copy_{n}gram_rate": copied, f"novel_{n}gram_ratio": 1 - copied}
    content = F.array_distinct(F.filter("_p", lambda t: F.char_length(t) >= 4))
    new["source_token_support_rate"] = T.safe_div(F.size(F.array_intersect(content, F.col("_s"))), F.size(content))
    new["sentence_support_proxy"] = T.sentence_support(F.col("prediction_text"), F.col("input_text"))
    return rows.withColumns(new).drop("_p", "_s", "_p2", "_p3", "_s2", "_s3")


def _faithful(rows: DataFrame, kind: str, find) -> DataFrame:
    rows = rows.withColumns({"_p": find(F.col("prediction_text")), "_t": find(F.col("target_text")), "_s": find(F.col("input_text"))})
    o = T.set_overlap(F.col("_p"), F.col("_t"))
    n, ok = F.size("_p"), F.size(F.array_intersect("_p", "_s"))
    new = {f"{kind}_{m}_ref": o[m] for m in ("precision", "recall", "f1")} | {
        f"supported_{kind}_count": ok, f"unsupported_{kind}_count": n - ok,
        # without any prediction the supported share is unknown, the unsupported one 0
        "source_supported_entity_rate" if kind == "entity" else "number_source_supported_rate": F.when(n > 0, ok / n),
        f"unsupported_{kind}_rate": T.safe_div(n - ok, n),
    }
    if kind == "entity":
        new |= {
            "prediction_entity_count": n, "reference_entity_count": F.size("_t"), "entity_overlap_ref_count": o["overlap_count"],
            "reference_entity_source_coverage": F.when(F.size("_t") > 0, F.size(F.array_intersect("_t", "_s")) / F.size("_t")),
        }
    return rows.withColumns(new).drop("_p", "_t", "_s")


def entity_block(rows: DataFrame) -> DataFrame:
    return _faithful(rows, "entity", T.entities)


def number_block(rows: DataFrame) -> DataFrame:
    return _faithful(rows, "number", T.numbers)


def flags_at_k(flags: Column, ks: tuple[int, ...] = K_VALUES) -> Column:
    """mrr, and hit, precision, recall and ndcg at each k, of binary flags by rank.  Recall is over the hits in the list itself."""
    total = F.greatest(F.aggregate(flags, F.lit(0), lambda a, x: a + x.cast("int")), F.lit(1))
    at = F.array_position(flags, 1)
    out = [F.when(at > 0, 1.0 / at).otherwise(0.0).alias("mrr")]
    for k in ks:
        top = F.slice(flags, 1, k)
        hits = F.aggregate(top, F.lit(0), lambda a, x: a + x.cast("int"))
        gain = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        dcg = gain(F.transform(top, lambda x, i: x / F.log2(i + F.lit(2.0))))
        ideal = gain(F.transform(F.sequence(F.lit(1), F.least(total, F.lit(k))), lambda i: 1 / F.log2(i + F.lit(1.0))))
        out += [
            (hits > 0).cast("double").alias(f"hit@{k}"), T.safe_div(hits, F.size(top)).alias(f"precision@{k}"),
            T.safe_div(hits, total).alias(f"recall@{k}"), T.safe_div(dcg, ideal).alias(f"ndcg@{k}"),
        ]
    return F.struct(*out)


def retrieval_block(rows: DataFrame, ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """The measures of the context's and the retrieval's flags, null where there are none; they replace the builder's columns of the same
    name.  And the share of distractors."""
    for kind, flags in (("context", "context_hit_flags"), ("retrieval", "retrieved_hit_flags")):
        rows = rows.withColumn("_f", F.when(F.size(flags) > 0, flags_at_k(F.col(flags), ks)))
        names = ["mrr", *(f"{m}@{k}" for m in ("hit", "precision", "recall", "ndcg") for k in ks)]
        rows = rows.withColumns({f"{kind}_{n}": F.col("_f").getField(n) for n in names})
    n, of = F.expr("try_cast(num_noise_chunks AS double)"), F.expr("try_cast(num_contexts AS double)")
    return rows.withColumn("noise_chunk_ratio", F.when(n.isNotNull() & of.isNotNull(), T.safe_div(n, of))).drop("_f")


def rouge_block(rows: DataFrame, stemmed: bool = True) -> DataFrame:
    rows = rows.withColumn("_r", R.rouge(F.col("prediction_text"), F.col("target_text"), stemmed))
    new = {}
    for name, x in (("rouge1", "r1"), ("rouge2", "r2"), ("rougeL", "rl"), ("rougeLsum", "rs")):
        new |= {name: F.col(f"_r.{x}f"), f"{name}_precision": F.col(f"_r.{x}p"), f"{name}_recall": F.col(f"_r.{x}r")}
    return rows.withColumns(new).drop("_r")


def bertscore_block(rows: DataFrame, scorer=None) -> DataFrame:
    """Columns of a plugged-in scorer (prediction and target columns to a struct of p, r, f1), else nulls."""
    if scorer is None:
        return rows.withColumns({f"bertscore_{x}": F.lit(None).cast("double") for x in ("p", "r", "f1")})
    rows = rows.withColumn("_b", scorer(F.col("prediction_text"), F.col("target_text")))
    return rows.withColumns({f"bertscore_{x}": F.col(f"_b.{x}") for x in ("p", "r", "f1")}).drop("_b")


def record_metrics(rows: DataFrame, family: Column | None = None, stemmed: bool = True, scorer=None) -> DataFrame:
    """All metrics of each prediction row (input_text, target_text, prediction_text, the flags and counts)."""
    rows = bertscore_block(rouge_block(rows, stemmed), scorer)
    return retrieval_block(number_block(entity_block(lexical(lengths(rows, family)))))


def corpus_rouge(rows: DataFrame) -> DataFrame:
    """Mean F of the four scores, in percent, rounded to four places."""
    r = rouge_block(rows)
    return r.agg(*[F.round(100 * F.avg(f"rouge{x}"), 4).alias(f"rouge{x}") for x in ("1", "2", "L", "Lsum")])
