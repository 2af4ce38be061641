"""Text functions against hand-made cases."""

import pytest
from pyspark.sql import functions as F

from quillwork.functions import rouge as R
from quillwork.functions import text as T
from quillwork.functions.porter import stem


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(f(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize("text, n", [(None, 0), ("", 0), ("  ", 0), (" a\tb\nc ", 3), ("a b", 2)])
def test_word_count(spark, text, n):
    assert one(spark, T.word_count, text) == n


def test_written_newlines_become_spaces(spark):
    assert one(spark, T.normalize_space, "and/nor\\n x  y") == "and or x y"
    assert one(spark, lambda c: T.normalize_space(c, False), "and/nor") == "and/nor"


def test_truncation(spark):
    assert one(spark, lambda c: T.truncate_words(c, 2), " a  b c") == "a b"
    assert one(spark, lambda c: T.split_overlong(c, 2), "a b c") == ["a b", "c"]
    assert one(spark, lambda c: T.split_overlong(c, 2), None) == []


@pytest.mark.parametrize(
    "line, is_heading",
    [
        ("1. Introduction", True), ("IV) Results here", True), ("I like cats", True), ("RELATED WORK", True), ("methods:", True), ("This is a long sentence.", False),
        ("", False), ("a" * 121, False), ("x " * 15, False), ("2.1 " + "w " * 13, False), ("lower case words here", False), ("Title Case Words here", True), ("123", False),
    ],
)
def test_headings(spark, line, is_heading):
    from quillwork.operators.chunking import flat, is_heading as plain

    assert one(spark, T.looks_like_heading, line) is is_heading
    assert plain(flat(line)) is is_heading


def test_clean_heading(spark):
    assert one(spark, T.clean_heading, "2.1. Our method:") == "Our method"
    assert one(spark, T.clean_heading, "RELATED WORK") == "Related Work"


def test_tokens_and_ngrams(spark):
    assert one(spark, T.tokens, "It's state-of-the-art, X1") == ["it's", "state-of", "the-art", "x1"]
    assert one(spark, lambda c: T.ngrams(T.tokens(c), 2), "a b c") == ["a b", "b c"]
    assert one(spark, lambda c: T.ngrams(T.tokens(c), 2), "a") == []


def test_entities_and_numbers(spark):
    assert one(spark, T.entities, "The iPhone of New  York and IBM. We saw A") == ["ibm", "new york", "phone"]
    assert one(spark, T.numbers, "In 2020 we had 3.5% of x7 and 123.131.152") == ["123.131", "152", "2020", "3.5%"]


def test_support(spark):
    assert one(spark, T.sentence_support, "Alpha beta. To be. Gamma!", "alpha gamma") == pytest.approx(0.75)
    assert one(spark, T.sentence_support, "", "x") == 0.0


def test_ids_and_conditions(spark):
    assert one(spark, T.normalize_paper_id, "train_clean_extra_7") == "train_7"
    assert one(spark, T.normalize_paper_id, "test_additive_7") == "test_7"
    assert one(spark, T.condition_from_filename, "a/test_noisy_hard.jsonl") == "hard_additive"
    assert one(spark, T.condition_from_filename, "mine.jsonl") == "mine"


@pytest.mark.parametrize(
    "word, root",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"),
        ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("triplicate", "triplic"),
        ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controlling", "control"),
    ],
)
def test_porter(word, root):
    assert stem(word) == root


def test_rouge(spark):
    s = R.rouge_scores("the cat sat on the mat", "the cat is on the mat", False)
    assert s[:3] == pytest.approx([5 / 6] * 3) and s[6:9] == pytest.approx([5 / 6] * 3)
    assert s[3:6] == pytest.approx([3 / 5] * 3)
    # lines count for Lsum only
    a, b = "w1 w2\nw3 w4", "w3 w4\nw1 w2"
    s = R.rouge_scores(a, b, False)
    assert s[8] == pytest.approx(0.5) and s[11] == pytest.approx(1.0)
    r = one(spark, lambda p, t: R.rouge_n(p, t, 1), "a a b", "a b b")
    assert (r.precision, r.recall) == pytest.approx((2 / 3, 2 / 3))
    assert R.rouge_scores(None, "x") == [0.0] * 12
