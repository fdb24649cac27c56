"""Queries and operators over whole tables: no row, line or part of a text is left out."""

import random
import re

import pytest

from lexiloom import catalog
from lexiloom.operators import nodes, terms
from lexiloom.plans import fixtures


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables of a few documents whose lines are longer than 400 characters."""
    long = "word " * 120
    rows = [(i, f"{long}{i}\n\nshort {i}\n{long}the end", "s", "fr" if i % 2 else "en", 10) for i in range(1, 25)]
    path = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_pairs_hold_every_line(spark, small):
    assert fixtures.pairs(spark, small).count() == 24 * 3


def test_gate_report_and_provider_run_cover_long_lines(spark, small):
    empty = catalog.QUERIES["gate_report"](spark, small).where("issue_type = 'EMPTY_TRANSLATION'").first()
    assert empty["nodes"] == sum((i + pos) % 12 == 10 for i in range(1, 25) for pos in (0, 2, 3))
    assert sum(r["nodes"] for r in catalog.QUERIES["provider_run"](spark, small).collect()) == 24 * 3


def test_heading_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    some = ["".join(rng.choice("ab c") for _ in range(rng.randrange(1, 9))) for _ in range(70)]
    rows = [(rng.choice("pq"), str(i), rng.choice(["x", "y", "z", "xy", None]), t) for i, t in enumerate([*some, "intro", "introduction", "the hou", "the house", "", None])]
    rows += [("p", "i1", "x", "intro"), ("p", "i2", "y", "introduction"), ("p", "i3", "x", "the hou"), ("p", "i4", "z", "the house")]

    def pairs():
        norm = [(p, n, s, " ".join((t or "").lower().split())) for p, n, s, t in rows]
        for p, n, s, t in norm:
            for q, m, os_, ot in norm:
                if p == q and n != m and t and s and os_ and (t == ot or (len(t) >= 3 and t in ot)) and s not in os_ and os_ not in s:
                    yield n, m

    got = terms.duplicated_headings(spark.createDataFrame(rows, "project_id string, node_id string, source_text string, target_text string"))
    assert sorted(map(tuple, got.collect())) == sorted(pairs())
    assert {("i1", "i2"), ("i3", "i4")} <= set(pairs())


def test_heading_duplicates_compare_whole_renderings(spark, tmp_path):
    """The sixth of one heading stands, after more than twelve characters, in another's."""
    part = "a long opening of words "
    rows = [(7, part + "x" * 120, "s", "en", 1), (12, "see " + part + "again", "s", "en", 1), (24, "a long openers", "s", "en", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in catalog.QUERIES["heading_duplicates"](spark, str(tmp_path)).collect()] == [("7:0", "12:0")]


def test_rebuilt_structure_counts_words_of_whole_lines(spark, small):
    got = {r["doc_id"]: r["total_words"] for r in catalog.QUERIES["rebuilt_structure"](spark, small).collect()}
    header = 2  # stays in a document of one page; its page number goes
    assert got == {i: header + 121 + 2 + 122 for i in range(1, 25)}


def test_rule_mining_reads_long_lines(spark, small):
    r = catalog.QUERIES["rule_mining"](spark, small).first()
    assert (r["avoid"], r["prefer"], r["occurrences"]) == ("the", "this", 24)


def test_style_lint_reads_whole_renderings(spark, tmp_path):
    rows = [(12, "x " * 300 + "để có thể", "s", "en", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["rule"]: r["findings"] for r in catalog.QUERIES["style_lint"](spark, str(tmp_path)).collect()}
    assert found["DE_CO_THE"] == 1 and found["LONG_SENTENCE"] == 1


def test_nested_has_a_row_for_each_chapter(spark):
    rows = [("p", "c1", 0, 1, "b", "y"), ("p", "c1", 0, 0, "a", "x"), ("p", "c2", 1, 0, "c", "z"), ("q", "c1", 0, 0, "d", "w")]
    n = spark.createDataFrame(rows, "project_id string, chapter_id string, chapter_index int, order_index int, node_id string, content string")
    chapters = n.select("project_id", "chapter_id", "chapter_index").distinct()
    got = nodes.nested(chapters, n).orderBy("project_id", "chapter_index").collect()
    assert [(r["project_id"], r["chapter_id"], [x["node_id"] for x in r["nodes"]]) for r in got] == [("p", "c1", ["a", "b"]), ("p", "c2", ["c"]), ("q", "c1", ["d"])]


def test_no_window_sorts_the_nodes_of_a_project(spark):
    n = spark.createDataFrame([("p", c, i, f"{c}:{i}") for c in (2, 1) for i in (1, 0)] + [(None, None, 0, "x")], "project_id string, chapter_index int, node_index int, node_id string")
    got = nodes.number_nodes(n)
    assert {r["node_id"]: r["order_index"] for r in got.collect()} == {"1:0": 0, "1:1": 1, "2:0": 2, "2:1": 3, "x": 0}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"row_number\(\) windowspecdefinition\(project_id#\d+, chapter_index#\d+,", plan)
