from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import facts, scores
from lexiloom.functions import text as tx
from lexiloom.operators import gate
from lexiloom.operators.multiset import multiset_except, multiset_minus
from lexiloom.operators.packing import estimate, split_text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "value"),
    [("1,234.50", "1234.5"), ("1.234,50", "1234.5"), ("1,234", "1234"), ("12,5", "12.5"), ("0.50", "0.5"), ("-0", "0"), ("+7", "7"), ("-3.10", "-3.1"), ("1.2.3", "123"), ("12345678901234567890123", "12345678901234567890123"), ("007", "7")],
)
def test_canonical_number(spark, raw, value):
    assert one(spark, facts.canonical_number(F.col("r")), r=raw) == value


def test_number_keys_skip_references_and_read_units(spark):
    got = one(spark, facts.number_keys(F.col("t")), t="Figure 3.2 shows 12% of $5 and 10 kg, 7 USD")
    assert got == ["12|%||", "5||$|", "10|||KG", "7||USD|"]


def test_reference_labels_share_types_across_languages(spark):
    assert one(spark, facts.reference_keys(F.col("t")), t="See Fig. 2 and Bảng 4.1, Chương X") == ["FIGURE:2", "TABLE:4.1", "CHAPTER:X"]
    assert one(spark, facts.reference_keys(F.col("t")), t="thư mục C:\\work") == []


def test_multiset_minus_is_counter_subtraction(spark):
    a, b = list("abacada"), list("aabx")
    rows = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    left, right = rows.select(multiset_minus(F.col("a"), F.col("b")), multiset_minus(F.col("b"), F.col("a"))).first()
    assert Counter(left) == Counter(a) - Counter(b)
    assert Counter(right) == Counter(b) - Counter(a)
    long = lambda xs: spark.createDataFrame([(1, k, i) for i, k in enumerate(xs)], "g int, k string, i int")
    got = multiset_except(long(a), long(b), ["g"], "k", "i").collect()
    assert Counter(r["k"] for r in got) == Counter(a) - Counter(b)


@pytest.mark.parametrize(
    ("source", "target", "codes"),
    [
        ("A cat.", "", {"EMPTY_TRANSLATION"}),
        ("It is not so.", "It is so.", {"NEGATION_LOSS"}),
        ("Costs 5 kg", "Costs 6 kg", {"NUMBER_MISMATCH", "NUMBER_ADDITION"}),
        ("Go on.", "Go on. Why?", {"CONTENT_ADDITION"}),
        ('"Hi," he said.', 'Hi," he said.', {"QUOTE_UNBALANCED"}),
        ("See https://a.b/c.", "See https://a.b/d.", {"URL_MISMATCH", "URL_ADDITION", "TECHNICAL_TOKEN_MISMATCH"}),
        ("Go on.", "Go on. 漢", {"FOREIGN_SCRIPT_CONTAMINATION"}),
        ("x" * 120, "x", {"LENGTH_ANOMALY"}),
        ("We left without it.", "We left it.", {"NEGATION_RISK"}),
        ("Plain text here.", "Plain text here.", set()),
        (None, None, {"EMPTY_TRANSLATION"}),
    ],
)
def test_gate_codes(spark, source, target, codes):
    rows = spark.createDataFrame([(source, target)], "s string, t string")
    got = rows.select(gate.gate_issues(F.col("s"), F.col("t"), "en").alias("i")).first()["i"]
    assert {i["code"] for i in got} == codes


def test_gate_language_rules(spark):
    rows = spark.createDataFrame([("Either party may leave.", "Cả hai bên và the người đi.")], "s string, t string")
    got = {i["code"] for i in rows.select(gate.gate_issues(F.col("s"), F.col("t"), "vi").alias("i")).first()["i"]}
    assert {"QUANTIFIER_SHIFT", "ENGLISH_RESIDUE"} <= got


def test_hyphenation_and_lines(spark):
    assert one(spark, tx.join_lines(F.col("t")), t="an invest-\nment in a long-\nterm plan\nof Austro-\nHungary") == "an investment in a long-term plan of Austro-Hungary"


def test_normalize_safely_keeps_code(spark):
    assert one(spark, tx.normalize_safely(F.col("t")), t='a\r\n\n\n\n"b"  c') == "a\n\n“b” c"
    assert one(spark, tx.normalize_safely(F.col("t")), t='`x` "b"') == '`x` "b"'


@pytest.mark.parametrize(("text", "term", "hit"), [("The cats sat", "cat", True), ("concatenate", "cat", False), ("Được phép", "được", True), ("a.b", "a.b", True), ("", "x", False), ("x", " ", False)])
def test_terms_are_whole_words(spark, text, term, hit):
    assert one(spark, tx.has_term(F.col("t"), F.col("k")), t=text, k=term) is hit


def test_risk_levels(spark):
    got = spark.range(1).select(scores.risk_score(F.lit("If you must not, however"), F.lit("x"), F.lit("legal"), F.lit(1), F.array(F.lit("NEGATION_RISK")), F.lit(3)).alias("r")).first()["r"]
    assert got == 1.0


def test_token_estimate_agrees_with_python(spark):
    for t in ("", "a", "Một câu, hai câu!", 'He said: "no" (twice).'):
        assert one(spark, tx.token_estimate(F.col("t")), t=t) == estimate(t)


def test_split_text_loses_nothing_but_blanks():
    t = "One two three. " * 40 + "word " * 300
    parts = split_text(t, 60)
    assert " ".join(parts).split() == t.split()
    assert all(estimate(p) <= 60 for p in parts)
