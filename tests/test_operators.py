from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import caches, issues, lint, metrics, mining, nodes, packing, retrieval, structure, terms
from lexiloom.sources import readers
from lexiloom.streaming import events as ev


def test_margins_and_order(spark):
    pages = spark.createDataFrame([(1, p, 600.0, 842.0) for p in range(1, 10)], "doc_id int, page_number int, width double, height double")
    rows = []
    for p in range(1, 10):
        rows += [(1, p, 0, "text", "Running head", 40.0, 20.0, 560.0, 40.0, 9.0, False, None), (1, p, 1, "text", f"Body {p}", 40.0, 200.0, 560.0, 220.0, 11.0, False, None), (1, p, 2, "text", str(p), 40.0, 800.0, 560.0, 820.0, 9.0, False, None)]
    rows.append((1, 1, 3, "text", "CHAPTER 1: Start", 40.0, 100.0, 560.0, 120.0, 22.0, True, None))
    b = spark.createDataFrame(rows, "doc_id int, page_number int, block_id int, type string, text string, x0 double, y0 double, x1 double, y1 double, font_size double, is_bold boolean, heading_level int")
    out = structure.rebuild(b, pages).orderBy("node_no").collect()
    assert [r["content"] for r in out] == ["CHAPTER 1: Start", *[f"Body {p}" for p in range(1, 10)]]
    assert {r["chapter_id"] for r in out} == {"chapter_0001"}
    assert out[0]["node_type"] == "heading"


def test_two_columns_read_left_then_right(spark):
    pages = spark.createDataFrame([(1, 1, 600.0, 842.0)], "doc_id int, page_number int, width double, height double")
    at = [(1, 320.0, 100.0, 560.0), (2, 40.0, 100.0, 280.0), (3, 320.0, 200.0, 560.0), (4, 40.0, 200.0, 280.0), (5, 40.0, 50.0, 560.0)]
    b = spark.createDataFrame([(1, 1, i, x0, y, x1) for i, x0, y, x1 in at], "doc_id int, page_number int, block_id int, x0 double, y0 double, x1 double")
    assert [r["block_id"] for r in structure.reading_order(b, pages).orderBy("reading_pos").collect()] == [5, 2, 4, 1, 3]


def test_table_rows_use_a_running_mean(spark):
    cells = spark.createDataFrame([("t", 0.0, 0.0, "a"), ("t", 50.0, 8.0, "b"), ("t", 0.0, 14.0, "c"), ("t", 0.0, 40.0, "d")], "table_id string, x double, y double, text string")
    got = structure.table_rows(cells).first()
    assert got["rows"] == [["a", "c", "b"], ["d", "", ""]]
    assert got["confidence"] == 0.40


def test_rolling_context_skips_what_does_not_fit(spark):
    rows = [("c", i, i, "w " * n) for i, n in enumerate((100, 200, 10, 5, 1))]
    n = spark.createDataFrame(rows, "chapter_id string, node_id int, order_index int, content string")
    got = {r["node_id"]: r["context"] for r in nodes.rolling_context(n, k=3, budget=200).collect()}
    assert got == {0: [], 1: ["0"], 2: ["0"], 3: ["0", "2"], 4: ["1"]}


def test_merge_next_keeps_the_last(spark):
    n = spark.createDataFrame([("c", "a", 0, "x"), ("c", "b", 1, "y"), ("c", "d", 2, "z")], "chapter_id string, node_id string, order_index int, content string")
    got = nodes.merge_next(n, spark.createDataFrame([("a",), ("d",)], "node_id string")).collect()
    assert {(r["node_id"], r["content"]) for r in got} == {("a", "x y"), ("d", "z")}


def test_patch_ignores_nulls(spark):
    cur = spark.createDataFrame([(1, "a", "b")], "k int, x string, y string")
    assert nodes.patch(cur, spark.createDataFrame([(1, None, "c")], "k int, x string, y string"), "k").first() == (1, "a", "c")


def test_upsert_prefers_new_and_latest(spark):
    t = spark.createDataFrame([("k", 9, "old")], "k string, ts int, v string")
    n = spark.createDataFrame([("k", 1, "new1"), ("k", 2, "new2"), (None, 1, "null")], "k string, ts int, v string")
    assert {(r["k"], r["v"]) for r in issues.upsert(t, n, ["k"], "ts").collect()} == {("k", "new2"), (None, "null")}


def test_issue_resolution_policy(spark):
    i = spark.createDataFrame([("a", "NUMBER_MISMATCH"), ("b", "NUMBER_MISMATCH"), ("a", "MEANING"), ("b", "MEANING")], "node_id string, issue_type string")
    left = spark.createDataFrame([("a", "NUMBER_MISMATCH")], "node_id string, code string")
    r = spark.createDataFrame([("a", "FAIL", False, 1), ("a", "PASS", True, 2)], "node_id string, status string, is_passed boolean, reviewed_at int")
    got = {(x["node_id"], x["issue_type"]): (x["resolution"], x["qa_error"]) for x in issues.resolve(i, left, r).collect()}
    assert got == {("a", "NUMBER_MISMATCH"): ("OPEN", None), ("b", "NUMBER_MISMATCH"): ("RESOLVED", None), ("a", "MEANING"): ("RESOLVED", None), ("b", "MEANING"): ("OPEN", "MISSING_REVIEW")}


def test_glossary_forms_and_domains(spark):
    g = spark.createDataFrame(
        [(" API ", "x", "y", None, None, "tech", None, False), ("api", "z", None, None, None, None, "HARD", True), ("dog", "d", None, ["D"], None, None, None, None)],
        "source_term string, target_term string, preferred_target string, allowed_variants array<string>, category string, domain string, lock_level string, locked boolean",
    )
    e = terms.entry_form(g)
    assert {(r["source_term"], r["target"], r["domain"], r["lock_level"]) for r in e.collect()} == {("API", "y", "TECH", "SOFT"), ("api", "z", "GENERAL", "HARD"), ("dog", "d", "GENERAL", "HARD")}
    assert {r["source_term"] for r in terms.for_domain(e, "tech").collect()} == {"API", "dog"}


def test_missed_soft_terms_yield_to_longer_ones(spark):
    n = spark.createDataFrame([("n", "a data base here", "x")], "node_id string, source_text string, target_text string")
    e = spark.createDataFrame([("data", "d", [], "SOFT"), ("data base", "db", [], "SOFT")], "source_term string, target string, allowed_variants array<string>, lock_level string")
    assert [r["source_term"] for r in terms.missed_soft_terms(n, e).collect()] == ["data base"]


def test_edit_hunks():
    assert mining.edit_hunks("we use the old thing now", "we use the new thing now") == [("old", "new")]
    assert mining.edit_hunks("a b c", "x y z") == []
    assert mining.edit_hunks("it is “clear” to us", "it is “plain” to us") == [("clear", "plain")]
    assert mining.edit_hunks("The big dog (ran) home", "the large dog (ran) home") == [("big", "large")]
    assert mining.edit_hunks("đi qua\u0301 nhanh rồi", "đi n\u00e0y nhanh rồi") == [("qu\u00e1", "n\u00e0y")]
    assert mining.edit_hunks("một cách rõ ràng thì tốt hơn", "rõ thì tốt hơn") == [("một cách rõ ràng", "rõ")]
    assert mining.edit_hunks("we use 12 things here", "we use 13 things here") == []


def test_lint_rules_find_seeded_phrases(spark):
    rows = [("a", "", "Việc này được làm bởi họ."), ("b", "", "Cô ấy nói rằng cô ấy đi."), ("c", "He left.", "Nó đi."), ("d", "It left.", "Nó đi."), ("e", "", None)]
    got = {(r["node_id"], r["rule"]) for r in lint.lint(spark.createDataFrame(rows, "node_id string, source_text string, target_text string")).collect()}
    assert got == {("a", "PASSIVE_BY_AGENT"), ("b", "REPEATED_SUBJECT_RANG"), ("c", "NO_FOR_PERSON")}
    assert lint.rules_table(spark).count() == len(lint.RULES)


def test_packing_isolates_tables_and_headings(spark):
    rows = [("c", str(i), i, k, "word " * 20) for i, k in enumerate(("paragraph", "paragraph", "heading", "table", "paragraph"))]
    n = spark.createDataFrame(rows, "chapter_id string, node_id string, order_index int, node_type string, content string")
    got = {r["node_id"]: r["chunk_no"] for r in packing.pack(n, 100).collect()}
    assert got == {"0": 1, "1": 1, "2": 2, "3": 3, "4": 4}


def test_signature_tells_lists_apart(spark):
    r = spark.range(1).select(*[caches.signature(*[F.lit(x) for x in xs]).alias(str(i)) for i, xs in enumerate((("a", "bc"), ("ab", "c"), ("a", "b", "c"), ("", "abc")))]).first()
    assert len(set(r)) == 4


def test_preferences_and_counts(spark):
    rows = spark.createDataFrame([("A", "A"), ("draw", "B"), ("B", None), ("?", "A")], "preference string, candidate_side string")
    assert metrics.preferences(rows).first() == (3, 0.3333, 0.3333, 0.0)
    lib = spark.createDataFrame([("x",), ("x",)], "domain string")
    assert retrieval.library_counts(lib).first()["examples"] == 2


def test_readers(spark, tmp_path):
    (tmp_path / "my_book.md").write_text("# Title\n\nline one\nline two\n\n##### deep")
    assert readers.uploads(spark, str(tmp_path)).first()["title"] == "My Book"
    d = spark.createDataFrame([(1, "# Title\n\nline one\nline two\n\n##### deep")], "doc_id int, text string")
    got = [(r["type"], r["heading_level"], r["text"]) for r in readers.text_blocks(d).orderBy("block_no").collect()]
    assert got == [("heading", 1, "Title"), ("text", None, "line one line two"), ("heading", 4, "deep")]
    p = spark.createDataFrame([(1, "<h1>A<p>b <b>c</b><script>x</script><p>d<img alt='i'>"), (2, None)], "page_id long, html string")
    assert [(r["type"], r["text"]) for r in readers.html_blocks(p).orderBy("block_no").collect()] == [("heading", "A"), ("text", "b c"), ("image", "i"), ("text", "d")]


def test_glossary_csv_round_trip(spark, tmp_path):
    g = spark.createDataFrame([("a", "b", "b", ["x", "y,z"], "c", "d", "", "", True, False, "HARD", "n")], "source_term string, target_term string, preferred_target string, allowed_variants array<string>, category string, domain string, sense_hint string, part_of_speech string, preserve_original boolean, locked boolean, lock_level string, notes string")
    readers.write_glossary(g, str(tmp_path / "g"))
    back = readers.read_glossary(spark, str(tmp_path / "g")).first()
    assert (back["source_term"], back["allowed_variants"], back["preserve_original"], back["locked"]) == ("a", ["x", "y,z"], True, False)


def test_render_escapes(spark):
    n = spark.createDataFrame([("p", "c", "n0", 0, "heading", 2, "a<b", ""), ("p", "c", "n1", 1, "paragraph", None, "x", "y\nz")], "project_id string, chapter_id string, node_id string, order_index int, node_type string, level int, source_text string, target_text string")
    assert readers.chapters_html(readers.render(n)).first()["html"] == '<h2 id="n0">a&lt;b</h2>\n<p id="n1">y<br>z</p>'


@pytest.fixture
def event_files(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, i // 6, (i % 6) * 10), i % 2, "click", float(i), "{}") for i in range(12)]
    e = spark.createDataFrame(rows, ev.SCHEMA)
    e.where("event_id < 6").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    e.where("event_id >= 6").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    return e, str(tmp_path)


def test_stream_agrees_with_batch_and_restarts(spark, event_files):
    e, at = event_files
    stream = lambda: ev.tumbling(ev.timed(spark.readStream.schema(ev.SCHEMA).option("recursiveFileLookup", True).parquet(f"{at}/in")))
    stream().writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start().awaitTermination()
    batch = ev.tumbling(ev.timed(e))
    assert {tuple(r) for r in spark.table("tumbling").collect()} == {tuple(r) for r in batch.collect()}
    dedup = ev.deduplicated(ev.timed(spark.readStream.schema(ev.SCHEMA).option("recursiveFileLookup", True).parquet(f"{at}/in"))).select("event_id")
    ev.run_once(dedup, f"{at}/cp", f"{at}/out")
    ev.run_once(dedup, f"{at}/cp", f"{at}/out")
    assert spark.read.parquet(f"{at}/out").count() == 12


def test_stateful_telemetry(spark, event_files):
    e, at = event_files
    s = ev.telemetry(spark.readStream.schema(ev.SCHEMA).option("recursiveFileLookup", True).parquet(f"{at}/in"))
    s.writeStream.outputMode("update").format("memory").queryName("telemetry").trigger(availableNow=True).start().awaitTermination()
    got = {r["user_id"]: (r["last_value"], r["seen"]) for r in spark.sql("select user_id, max_by(last_value, seen) last_value, max(seen) seen from telemetry group by user_id").collect()}
    assert got == {0: (10.0, 6), 1: (11.0, 6)}


@pytest.mark.parametrize("few", [2_000, 2])
def test_terms_meet_texts_alike_however_many(spark, monkeypatch, few):
    from lexiloom.operators import terms

    monkeypatch.setattr(terms, "FEW", few)
    nodes_ = spark.createDataFrame([(f"n{i}", t) for i, t in enumerate(["The cats sat", "a cat. A dog", "walked by the lake side", None, "", "catalogue of lakes", "Being king-size", "The THE the"])], "node_id string, content string")
    listed = spark.createDataFrame([("cat", 1), ("walk", 2), ("lake side", 3), ("lake", 4), ("the", 5), ("!!", 6), ("be", 7), ("king", 8), ("dog", 9)], "term string, id int")
    got = {(r["node_id"], r["id"]) for r in terms.term_hits(nodes_, listed, "content", "term").collect()}
    assert got == {("n0", 1), ("n0", 5), ("n1", 1), ("n1", 9), ("n2", 2), ("n2", 3), ("n2", 4), ("n2", 5), ("n5", 4), ("n6", 7), ("n6", 8), ("n7", 5)}


def test_examples_are_the_same_by_list_and_by_join(spark, monkeypatch):
    from lexiloom.operators import retrieval

    kinds, domains = ("paragraph", "heading", "quote"), ("LEGAL", "GENERAL", "POETRY")
    n = spark.createDataFrame([(i, domains[i % 3], ("NATURAL", "FAITHFUL")[i % 2], kinds[i % 3], "word then, and " * (i % 7)) for i in range(40)], "node_id int, domain string, mode string, node_type string, source_text string")
    lib = spark.createDataFrame([(i, domains[i % 2], kinds[i % 3], [("NATURAL", "FAITHFUL")[i % 2]], ("formal", "plain")[i % 2], ["sentence_split"] if i % 5 else [], "same text " * (i % 6)) for i in range(60)], "example_id int, domain string, node_type string, modes array<string>, register string, patterns array<string>, source string")
    told = lambda: sorted(tuple(r) for r in retrieval.few_shot(n, lib, 3).collect())
    by_list = told()
    monkeypatch.setattr(retrieval, "LIBRARY", 10)
    assert told() == by_list and len(by_list) == 120
