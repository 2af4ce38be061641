"""Text functions as Column expressions; nothing here leaves the JVM.

White space, words and digits are Unicode-aware, as they are in the tools whose results these match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CHUNKING, QUERIES, SEED

SECTION_NAMES = sorted(
    "abstract acknowledgements acknowledgments appendix background conclusion conclusions discussion evaluation experiment experiments".split()
    + "introduction limitations method methodology methods references results".split()
    + ["future work", "literature review", "related work"]
)
_RUN = "[0-9A-Za-z]+"
_NAME = "[A-Z][-0-9A-Za-z]+"
TOKEN = f"{_RUN}(?:['-]{_RUN})?"
ENTITY = rf"{_NAME}(?:(?U:\s)+{_NAME}){{0,5}}"
NUMBER = r"(?U)(?<![\w])\p{Nd}+(?:[.]\p{Nd}+)?%?(?![\w])"
ENTITY_STOP = ["a", "an", "for", "in", "the", "this", "we"]
_HEADING = r"^(?:\d+(?:\.\d+){0,3}|[IVXLCDM]+)[):.]?(?U:\s)+([a-zA-Z].+)$"
NBSP = "\u00a0"


def text_of(c: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def words(c: Column) -> Column:
    """Runs of other characters than white space."""
    return F.filter(F.split(text_of(c), r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def normalize_space(c: Column, mend_newlines: bool = True) -> Column:
    """One space for each run of white space, none at the ends.

    ``mend_newlines`` also takes a written ``\\n`` and ``/n`` for a newline, which changes words such as and/nor.
    """
    t = F.replace(text_of(c), F.lit(NBSP), F.lit(" "))
    if mend_newlines:
        t = F.replace(F.replace(t, F.lit("\\n"), F.lit("\n")), F.lit("/n"), F.lit("\n"))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def truncate_words(c: Column, most: int, mend_newlines: bool = True) -> Column:
    """The first ``most`` words of the flattened text."""
    # what is behind the last word wanted stays in one piece
    return F.array_join(F.slice(F.split(normalize_space(c, mend_newlines), " ", most + 1), 1, most), " ")


def blank(c: Column) -> Column:
    """Whether nothing is left of a text once its space is normalised; looks no further than the first character that is."""
    return text_of(c).rlike(r"(?U)^(?:[\s\x{a0}]|\\n|/n)*$")


def clean_field(c: Column, joint: str, is_list: bool = False) -> Column:
    """A raw field: a list's trimmed, non-blank items joined, or a string with its written newlines as spaces."""
    if is_list:
        return F.coalesce(F.array_join(F.filter(F.transform(c, lambda x: F.trim(text_of(x))), lambda x: x != ""), joint), F.lit(""))
    return F.btrim(F.replace(F.replace(text_of(c), F.lit("\\n"), F.lit(" ")), F.lit("/n"), F.lit(" ")), F.lit(" \t\r\n"))


def split_overlong(sentence: Column, most: int) -> Column:
    """Pieces of at most ``most`` words."""
    w = words(normalize_space(sentence))
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(most))
    pieces = F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(most)), " "))
    return F.when(F.size(w) > 0, pieces).otherwise(F.array().cast("array<string>"))


def looks_like_heading(line: Column) -> Column:
    """Whether a line reads as a section heading; the first rule that applies decides."""
    t = normalize_space(line)
    w = words(t)
    n = F.size(w)
    title = F.regexp_extract(t, _HEADING, 1)
    upper = (F.upper(t) == t) & t.rlike(r"\p{Lu}")
    lettered = F.filter(w, lambda x: x.rlike(r"\p{L}"))
    capital = F.size(F.filter(lettered, lambda x: x.rlike(r"^\p{Lu}")))
    return (
        F.when((t == "") | (F.char_length(t) > CHUNKING.heading_chars), False)
        .when(t.endswith(".") & (n > 3), False)
        .when(n > CHUNKING.heading_words + 2, False)
        .when(t.rlike(_HEADING), F.size(words(title)) <= CHUNKING.heading_words)
        .when(upper & n.between(2, 10), True)
        .when(F.btrim(F.lower(t), F.lit(" .:")).isin(SECTION_NAMES), True)
        .when((n <= 10) & (F.size(lettered) > 0), capital >= CHUNKING.title_share * F.size(lettered))
        .otherwise(False)
    )


def clean_heading(line: Column) -> Column:
    """A heading without its number and outer punctuation; capitals become title case."""
    t = normalize_space(line)
    upper = (F.upper(t) == t) & t.rlike(r"\p{Lu}")
    return (
        F.when(t.rlike(_HEADING), F.btrim(normalize_space(F.regexp_extract(t, _HEADING, 1)), F.lit(" .:")))
        .when(upper, F.initcap(F.lower(t)))
        .otherwise(F.btrim(t, F.lit(" .:")))
    )


def split_sentences(c: Column) -> Column:
    """Sentences end in ``.!?`` before white space and a capital, a digit or an opening bracket."""
    parts = F.split(normalize_space(c), r"(?U)(?<=[!.?])\s+(?=[(\[0-9A-Z])")
    return F.filter(parts, lambda s: s != "")


def plain_sentences(c: Column) -> Column:
    """Sentences end in ``.!?`` before any white space."""
    parts = F.transform(F.split(text_of(c), r"(?U)(?<=[!.?])\s+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits, with one inner hyphen or apostrophe, in lower case."""
    return F.regexp_extract_all(F.lower(_ascii_only(c)), F.lit(TOKEN.replace("A-Z", "")), F.lit(0))


def _ascii_only(c: Column) -> Column:
    # lower() may turn a letter beyond ASCII into an ASCII one, which the pattern must not see
    return F.regexp_replace(text_of(c), "[\u0130\u212a]", "\u00a0")


def ngrams(tok: Column, n: int) -> Column:
    """Contiguous runs of n tokens, each joined by spaces; none if there are fewer."""
    many = F.greatest(F.size(tok) - n + 1, F.lit(0))
    out = F.slice(tok, F.lit(1), many)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(tok, F.lit(k + 1), many), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def entities(c: Column) -> Column:
    """Runs of up to six capitalised words, distinct, in lower case and sorted."""
    found = F.transform(F.regexp_extract_all(text_of(c), F.lit(ENTITY), F.lit(0)), lambda e: F.lower(normalize_space(e, False)))
    return F.sort_array(F.array_distinct(F.filter(found, lambda e: (F.char_length(e) >= 2) & ~e.isin(ENTITY_STOP))))


def numbers(c: Column) -> Column:
    """Whole numbers, decimals and percentages that no word character adjoins, distinct and sorted."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(text_of(c), F.lit(NUMBER), F.lit(0))))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, and 0 for b = 0 or where either is missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return safe_div(2 * p * r, p + r)


def set_overlap(pred: Column, ref: Column) -> Column:
    """Precision, recall, F1 and counts of two sets (arrays without repeats)."""
    both = F.size(F.array_intersect(pred, ref))
    p, r = safe_div(both, F.size(pred)), safe_div(both, F.size(ref))
    return F.struct(
        p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"),
        F.size(pred).alias("pred_count"), F.size(ref).alias("ref_count"), both.alias("overlap_count"),
    )


def sentence_support(prediction: Column, source: Column) -> Column:
    """Mean share, over the predicted sentences that have tokens of four characters or more, of those that the source has."""
    content = F.filter(
        F.transform(plain_sentences(prediction), lambda s: F.array_distinct(F.filter(tokens(s), lambda t: F.char_length(t) >= 4))),
        lambda t: F.size(t) > 0,
    )

    def mean(content: Column, had: Column) -> Column:
        shares = F.transform(content, lambda t: F.size(F.array_intersect(t, had)) / F.size(t))
        return F.aggregate(shares, F.lit(0.0), lambda a, x: a + x, lambda a: safe_div(a, F.size(content)))

    # bound one after the other by lambdas: the sentences once, the source's tokens once, then only those of them that the sentences have
    bound = F.array(F.struct(content.alias("c"), tokens(source).alias("s")))
    bound = F.transform(bound, lambda x: F.struct(x["c"].alias("c"), F.array_intersect(F.flatten(x["c"]), x["s"]).alias("had")))
    return F.transform(bound, lambda x: mean(x["c"], x["had"]))[0]


def normalize_paper_id(c: Column) -> Column:
    """Ids of derived rows as those of their papers.  An extra training paper gets the id of another one, so
    training rows must not be joined on it."""
    for pattern, to in (("^test_(additive|substitutive)_", "test_"), ("^validation_clean_extra_", "validation_"), ("^train_clean_extra_", "train_")):
        c = F.regexp_replace(c, pattern, to)
    return c


CONDITIONS = {
    "test_noisy_easy": "easy_additive", "test_noisy_easy_additive": "easy_additive",
    "test_noisy_easy_substitutive": "easy_substitutive", "test_noisy_hard": "hard_additive",
    "test_noisy_hard_additive": "hard_additive", "test_noisy_hard_substitutive": "hard_substitutive", "test_clean": "clean",
}


def condition_from_filename(c: Column) -> Column:
    """The condition that a test file holds, else the file's stem."""
    stem = F.regexp_replace(F.substring_index(c, "/", -1), r"(?<=.)\.[^.]*$", "")
    out = stem
    for name, condition in CONDITIONS.items():
        out = F.when(stem == name, condition).otherwise(out)
    return out


def keyed(*parts: Column | str | int) -> Column:
    """A reproducible hexadecimal key of the parts; its order is a shuffle."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def keyed_number(*parts: Column | str | int) -> Column:
    """A reproducible whole number below 2 ** 32."""
    return F.conv(F.substring(keyed(*parts), 1, 8), 16, 10).cast("long")


def keyed_share(*parts: Column | str | int) -> Column:
    """A reproducible number from 0 on, below 1."""
    return keyed_number(*parts) / F.lit(float(1 << 32))


def choose_query(paper_id: Column, several: bool = True, seed: int = SEED) -> Column:
    """One of the query templates, chosen by the id."""
    if not several:
        return F.lit(QUERIES[0])
    return F.element_at(F.array(*map(F.lit, QUERIES)), (keyed_number(seed, paper_id) % len(QUERIES) + 1).cast("int"))


def token_estimate(c: Column, per_word: float = 1.3) -> Column:
    """Subword tokens to expect, rounded down."""
    return F.floor(F.round(word_count(c) * F.lit(per_word), 6)).cast("long")
