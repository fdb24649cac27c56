"""The gate's and the risk's shortcuts: nothing is computed twice, and what is looked at first never hides what a pattern finds."""

import random
import re
import time

from pyspark.sql import functions as F

from lexiloom.functions import facts, scores
from lexiloom.functions import text as tx
from lexiloom.operators import gate

PIECES = (
    "not", "don't", "CAN’T", "cannot", "1don't", "No  longer", "knot", "without", "If", "as a result", "elif", "The", "the", "'and'", "of", "Anna", "Fig. 3.2", "Section K", "which a", "ch. 4-b", "Hình 2:", "ſ",
    "http://a.b/c?", "WWW.x.y", "a_b", "U.S.", "A1", "`x y`", "?", "“", '"', "漢", "　", "été", "Đây", "không", "phải", "(discipline)", "Discipline", "3.", "\n", " ", "l'eau", "—", "is",
)


def texts(n):
    rng = random.Random(7)
    return ["", *PIECES, *("".join(p + rng.choice((" ", " ", "  ", "", ". ", ", ")) for p in rng.choices(PIECES, k=rng.randrange(2, 14))) for _ in range(n))]


def test_shortcuts_find_what_the_patterns_find(spark):
    d = spark.createDataFrame([(t,) for t in texts(1500)], "t string")
    t = F.col("t")
    negation = (
        r"(?i)\b(?:no\s+longer|must\s+not|should\s+not|may\s+not|did\s+not|does\s+not|is\s+not|are\s+not|was\s+not|were\s+not|"
        r"cannot|can['’]?t|never|none|neither|nor|not)\b|\b[A-Za-z]+n['’]t\b"
    )
    part, word = f"[{gate.PARTING}]", "|".join(gate.RESIDUE)
    gap = f"['‘’]*{part}+['‘’]*"
    title = rf"((?:^|(?<=[{gate.PARTING}'‘’]))\p{{Lu}}[^{gate.PARTING}]*?)((?:{gap}(?:{word}))+)(?={gap}\p{{Lu}})"
    prose = F.regexp_replace(F.regexp_replace(t, tx.TECHNICAL, " "), tx.URL, " ")
    left = F.regexp_extract_all(F.regexp_replace(prose, title, "$1 "), F.lit(rf"(?:^|(?<={part}))['‘’]*({word})(?=['‘’]*(?:{part}|$))"), F.lit(1))
    opening = rf"(?:^|(?<=[.!?…:;]\s)|(?<=[“\"(]))({'|'.join(gate.OPENINGS)})\s+(?=[a-zà-ỹđ])"
    plain = F.regexp_replace(F.regexp_replace(t, "`[^`]*`", " "), facts.IDENTIFIER, " ")
    pairs = [
        (t.rlike(negation), facts.negates(t)),
        (tx.matches(t, facts.REFERENCE), F.when(t.rlike(facts.IN_REFERENCE), tx.matches(t, facts.REFERENCE)).otherwise(F.array().cast("array<string>"))),
        (F.size(tx.matches(t, facts.REFERENCE)), F.size(facts.reference_keys(t))),
        (tx.matches(t, f"[{''.join(tx.CJK_RANGES)}]"), tx.matches(t, tx.CJK)),
        (tx.count_of(t, "[\"“”]"), tx.count_chars(t, gate.QUOTES)),
        (F.transform(tx.matches(t, tx.URL), lambda x: F.regexp_replace(x, r"[.,;:!?]+$", "")), tx.urls(t)),
        (F.array_sort(F.array_distinct(F.concat(left, F.regexp_extract_all(prose, F.lit(opening), F.lit(1))))), gate.residue(t)),
        (F.transform(tx.matches(plain, facts.LANGUAGE_WORD), F.lower), facts.language_words(t)),
        (t.rlike(r"(?i)\b(if|unless|only if|provided that|except when)\b"), t.rlike(scores.SENSITIVE["CONDITION"][0])),
        (t.rlike(r"(?i)\b(because|because of|therefore|thus|consequently|as a result)\b"), t.rlike(scores.SENSITIVE["CAUSALITY"][0])),
    ]
    rows = d.select("t", *[c for p in pairs for c in p]).collect()
    for i in range(len(pairs)):
        assert [(r[0], r[2 * i + 1]) for r in rows] == [(r[0], r[2 * i + 2]) for r in rows], i
    assert all(any(r[2 * i + 2] for r in rows) for i in range(len(pairs)))


def test_residue_is_built_once(spark):
    found = str(gate.gate_issues(F.col("a"), F.col("b"), codes=("ENGLISH_RESIDUE",))._jc.toString())
    assert found.count("obody") == str(gate.residue(F.col("b"))._jc.toString()).count("obody") + str(gate.foreign_words(F.col("a"), F.col("b"))._jc.toString()).count("obody")


def test_names_do_not_cut_the_source_again(spark):
    """Many capitalised words, each of which is looked up among the source's words: the source is cut once, not once a word."""
    letters = "bcdfgh"
    names = ["Zw" + a + b + c + d + e for a in letters for b in letters for c in letters for d in letters for e in letters][:6000]
    d = spark.createDataFrame([(" ".join(names) + " zwbbbbb" + " x" * 200_000, " ".join(names))], "a string, b string")
    began = time.perf_counter()
    assert d.select(gate.foreign_words(F.col("a"), F.col("b"))).first()[0] == ["Zwbbbbb"]
    assert time.perf_counter() - began < 30


def test_long_runs_keep_no_frame_for_each_word(spark):
    """Java's pattern keeps a frame on the stack for each round of a group that it may have to give back; some thousand of them end an executor."""
    n = 20_000
    runs = ["Anna" + " and" * n + " Bob", "Anna" + " and" * n, "Anna" + " and" * n + " bob", "1" + ",2" * n, "Table 1" + ".2" * n, "fig a" + "-b" * n, "a" + "-b" * n, "x /" + "a/" * n, "x a" + ".b" * n + "()"]
    d = spark.createDataFrame(list(enumerate(runs)), "i int, t string").repartition(1)
    t = F.col("t")
    row = {r["i"]: r for r in d.select("i", gate.residue(t).alias("left"), facts.number_keys(t).alias("numbers"), facts.reference_keys(t).alias("refs"), facts.language_words(t).alias("words"), tx.technical_tokens(t).alias("tokens"), tx.matches(t, gate.LABEL).alias("labels"), gate.gate_issues(t, t).alias("issues")).collect()}
    assert [row[i]["left"] for i in range(3)] == [[], ["and"], ["and"]]
    assert row[3]["numbers"] == ["1" + "2" * n + "|||"] and row[4]["refs"] == ["TABLE:1" + ".2" * n] and row[4]["labels"] == [runs[4]]
    assert row[5]["refs"] == ["FIGURE:A" + "-B" * n] and row[6]["words"] == [runs[6]]
    assert row[7]["tokens"] == [runs[7][2:]] and row[8]["tokens"] == [runs[8][2:]]
    assert "ENGLISH_RESIDUE" not in [i["code"] for i in row[0]["issues"]] and "ENGLISH_RESIDUE" in [i["code"] for i in row[1]["issues"]]


def test_patterns_that_give_nothing_back_find_the_same(spark):
    """The patterns of long runs, held against those that may give back what they took."""
    rng = random.Random(8)
    bits = ("Table", "Fig.", "Section", "Figure", " ", " ", " 1", ".2", ".23", ",5", "-b", "-B7", "a", "é", "_", "/", "/a", ":/", "()", ".", ".b", "x", "%", " kg", "'t", "́", "٣", "ſ", "\n", "`")
    d = spark.createDataFrame([("".join(rng.choices(bits, k=rng.randrange(2, 12))),) for _ in range(6000)], "t string")
    t = F.col("t")
    pairs = [(tx.matches(t, re.sub(r"([*+])\+", r"\1", p).replace(r"(?:\.\d+\b)*", r"(?:\.\d+)*")), tx.matches(t, p)) for p in (facts.NUMBER, facts.REFERENCE, facts.LANGUAGE_WORD, tx.TECHNICAL, gate.LABEL)]
    rows = d.select("t", *[c for p in pairs for c in p]).collect()
    for i in range(len(pairs)):
        assert [(r[0], r[2 * i + 1]) for r in rows] == [(r[0], r[2 * i + 2]) for r in rows], i
        assert any(r[2 * i + 2] for r in rows), i
