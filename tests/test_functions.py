"""Column functions on literal inputs."""

import math

import pytest
from pyspark.sql import functions as F

from sitesieve.functions import arrays, text
from sitesieve.functions import votes as on_lists


def one(spark, value, schema, column):
    return spark.createDataFrame([(value,)], f"v {schema}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("domain,expected", [
    ("bakery.at", "bakery"), ("bakery.photography", "bakery"), ("shop.bakery.co.at", "shop.bakery.co"),
    ("localhost", "localhost"), ("", ""), (".at", ""),
])
def test_strip_last_label(spark, domain, expected):
    assert one(spark, domain, "string", text.strip_last_label(F.col("v"))) == expected


def test_strip_last_label_strict_drops_a_character_without_dot(spark):
    assert one(spark, "localhost", "string", text.strip_last_label(F.col("v"), strict=True)) == "localhos"


@pytest.mark.parametrize("values,expected", [
    (["a.be", "b.be"], "a.be b.be"), ([], ""), (None, ""), (["a", None], "a None"),
])
def test_join_list(spark, values, expected):
    assert one(spark, values, "array<string>", text.join_list(F.col("v"))) == expected


def test_letters_and_digits(spark):
    assert one(spark, "My-Site_2Ü.x", "string", text.letters_and_digits(F.col("v"))) == "mysite2x"


def test_count_tag(spark):
    assert one(spark, "abacaba", "string", text.count_tag(F.col("v"), "a")) == 4
    assert one(spark, "aaaa", "string", text.count_tag(F.col("v"), "aa")) == 2
    with pytest.raises(ValueError):
        text.count_tag(F.col("v"), "")


def test_model_text(spark):
    rows = [("old mill", "Bread", "Open from six."), ("river walk", "", "Two hours."), (None, None, "x")]
    df = spark.createDataFrame(rows, "d string, m string, b string")
    got = [r[0] for r in df.select(text.model_text(F.col("d"), F.col("m"), F.col("b"))).collect()]
    assert got == ["old mill. Bread Open from six.", "river walk.  Two hours.", ".  x"]


def test_terms_are_lower_case_without_accents(spark):
    got = one(spark, "Été.BE  a b ﬁn plain.com", "string", text.terms(F.col("v")))
    assert got == ["ete.be", "a", "b", "fin", "plain.com"]


@pytest.mark.parametrize("size", [0, 1, 3, 4, 5, 8, 11])
def test_chunks_join_to_the_whole_and_are_full_but_for_the_last(spark, size):
    values = [10 * i for i in range(size)]
    parts = one(spark, values, "array<int>", arrays.chunks(F.col("v"), 4))
    assert [x for p in parts for x in p] == values
    assert all(len(p) == 4 for p in parts[:-1]) and all(0 < len(p) <= 4 for p in parts)


def test_flatten(spark):
    assert one(spark, [[7], [], [8, 9]], "array<array<int>>", F.flatten("v")) == [7, 8, 9]


@pytest.mark.parametrize("inner", [0, 1, 300, 509, 510, 511, 700, 1019, 1020, 1021, 2500])
def test_windows(spark, inner):
    """One window if all fits, else the first and the last inner tokens between the same marks; padding is 1."""
    body = list(range(1000, 1000 + inner))
    got = one(spark, [0, *body, 2], "array<int>", arrays.windows(F.col("v")))
    shown = [body] if inner <= 510 else [body[:510], body[-510:]]
    assert len(got) == len(shown)
    for window, part in zip(got, shown):
        blank = 510 - len(part)
        assert window["input_ids"] == [0, *part, 2] + [1] * blank
        assert window["attention_mask"] == [1] * (len(part) + 2) + [0] * blank


@pytest.mark.parametrize("n", [0, 1, 5, 6, 7, 11, 12, 13, 14, 40])
def test_windows_of_outer_tokens_equal_windows_of_all(spark, n):
    """Cutting the middle before encoding must not change any window (width 8)."""
    from sitesieve.operators.tokens import marked

    values = list(range(10, 10 + n))
    whole = arrays.windows(marked(F.col("v")), 8)
    cut = arrays.windows(marked(arrays.outer_tokens(F.col("v"), 8)), 8)
    assert one(spark, values, "array<int>", whole) == one(spark, values, "array<int>", cut)


def test_softmax_entropy_argmax(spark):
    logits = [1.0, 3.0, 3.0, -700.0]
    powers = [math.exp(x - 3) for x in logits]
    probs = [p / sum(powers) for p in powers]
    got = one(spark, logits, "array<double>", arrays.softmax(F.col("v")))
    assert got == pytest.approx(probs)
    assert one(spark, logits, "array<double>", arrays.argmax(F.col("v"))) == 1
    expected = -sum(p * math.log(p) for p in probs if p > 0)
    assert one(spark, probs, "array<double>", arrays.entropy(F.col("v"))) == pytest.approx(expected)
    assert one(spark, [2.0, 0.0], "array<double>", arrays.entropy(F.col("v"))) == pytest.approx(0.0)
    assert one(spark, [3.0, 3.0], "array<double>", arrays.entropy(F.col("v"))) == pytest.approx(math.log(2))


@pytest.mark.parametrize("labels,top,majority,unanimous", [
    (["A", "B", "A"], "A", True, False), (["A", "A", "A"], "A", True, True), (["B", "A"], "B", False, False),
    (["A"], "A", True, True), (["C", "B", "B", "C", "A"], "C", False, False),
])
def test_vote_functions(spark, labels, top, majority, unanimous):
    v = F.col("v")
    assert one(spark, labels, "array<string>", on_lists.majority(v)) == top
    assert one(spark, labels, "array<string>", on_lists.has_majority(v)) is majority
    assert one(spark, labels, "array<string>", on_lists.is_unanimous(v)) is unanimous


def test_positive_votes(spark):
    assert one(spark, [1, 0, 1], "array<int>", on_lists.positive_votes(F.col("v"))) == 2
