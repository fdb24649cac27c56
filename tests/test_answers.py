"""Rules that SQL cannot say, against examples and plain Python: answers, residue, entities, lint, languages, HTML, packing, prompts."""

import difflib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexiloom import catalog
from lexiloom.functions import answers, facts, scores
from lexiloom.operators import address, gate, lint, mining, packing, prompts, records, reviews
from lexiloom.session import table
from lexiloom.sources import readers

SF = "/root/testdata/sf0.001"


def many(spark, values, f):
    d = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, a string" + (", b string" if isinstance(values[0], tuple) else ""))
    return [r["r"] for r in d.select("i", f(*[F.col(c) for c in d.columns[1:]]).alias("r")).orderBy("i").collect()]


def test_answer_text(spark):
    cases = {
        '{"translation": "Xin chào"}': "Xin chào",
        '```json\n{"text": "a\\nb"}\n```': "a\nb",
        "{“vietnamese”: “có”}": "có",
        '{"translation": "a "b" c", "x"}': "a",
        "  plain text \nNote: nothing": "plain text",
        "Câu.\n\nLưu ý: bỏ": "Câu.",
        "```\nfenced\n```": "fenced",
        '{"other": 1}': '{"other": 1}',
        '{"text": 5, "result": "r"}': "r",
        "": "",
    }
    assert many(spark, list(cases), answers.answer_text) == list(cases.values())


def test_answer_items(spark):
    cases = {
        '{"translations": [{"node_id": "1", "text": " a "}, {"id": 2, "translation": "b"}]}': [("1", "a"), ("2", "b")],
        '[{"node_id": "1", "vietnamese": "x"}, {"text": "no id"}, "text"]': [("1", "x")],
        '{"n1": "x", "n2": {"text": "y"}, "status": "ok"}': [("n1", "x"), ("n2", "y")],
        'Here: {"nodes": [{"id": "1", "text": "x",},],} bye': [("1", "x")],
        '{"translations": [{"node_id": "1", "text": "a \\"q\\""} {"node_id": "2", "text": "b"': [("1", 'a "q"')],
        '{"text": "t", "id": "9"} and {"text": "u", "id": "8"}': [("9", "t"), ("8", "u")],
        "nothing": [],
        "": [],
    }
    assert [[tuple(x) for x in r] for r in many(spark, list(cases), answers.answer_items)] == list(cases.values())


def test_long_answers(spark):
    """A broken answer of a long text is read whole; patterns do not recurse for each character."""
    plain = 'word "q" ' * 300 + "x" * 200_000
    told = plain.replace('"', '\\"')
    got = many(spark, [f'{{"translations": [{{"node_id": "1", "text": "{told}"}} oops', f'{{"translation": "{told}" oops}}'], lambda c: F.struct(answers.answer_items(c).alias("i"), answers.answer_text(c).alias("t")))
    assert got[0]["i"][0]["text"] == plain and got[1]["t"] == plain


def test_repeats(spark):
    loop = "một câu dài đúng ba mươi chữ, "
    assert len(loop) == 30
    texts = ["a\n\nb\na\nb", "X. Y. X. Y. Z.", "One. Two.", (loop * 5) + "end", "aa bb"]
    got = many(spark, texts, answers.without_repeats)
    assert got[0] == "a\n\nb" and got[1] == "X. Y. Z." and got[2] == "One. Two." and got[4] == "aa bb"
    assert got[3] == loop + "end"


def test_cleaned(spark):
    cases = {
        '{"translation": "Anh nói，em nghe。"}': "Anh nói, em nghe.",
        "Translation: Xin chào !": "Xin chào!",
        'He said "yes".': "He said “yes”.",
        "a,,b.....c": "a, b... c",
        "x ,.y": "x. y",
        "Đây là: văn bản": "văn bản",
    }
    assert many(spark, list(cases), answers.cleaned) == list(cases.values())


def test_small_answer_rules(spark):
    assert many(spark, [('"Xin chào"', "Hello"), ('"Anh," cô nói. "Em"', "x"), ("“a”", '"a"'), ('"', "x")], answers.unwrapped) == ["Xin chào", '"Anh," cô nói. "Em"', "“a”", '"']
    assert many(spark, [("Chương 1: Mở đầu", "Opening"), ("Chương 1: Mở đầu", "Chapter 1: Opening"), ("Nhà\n\nAnh về", "Home"), ("Chương 2:", "x")], answers.heading_line) == ["Mở đầu", "Chương 1: Mở đầu", "Nhà", "Chương 2:"]
    assert many(spark, ["x" * 40, "x" * 2000, "x" * 90000, ""], answers.output_cap) == [256, 1064, 2048, 256]


def test_residue_and_foreign_words(spark):
    cases = {
        "Anh nobody chạm vào piano": ["nobody"],
        "Psychology and Religion là sách": [],
        "Journey of the Magi hay": [],
        "Since sinh và tử dường như": ["Since"],
        "The Road Less Traveled": [],
        "anh ấy said rồi, and 'the'": ["and", "said", "the"],
        "`and the` /usr/and/the/ http://a.org/the": [],
        None: [],
    }
    assert many(spark, list(cases), lambda c: gate.residue(F.coalesce(c, F.lit("")))) == list(cases.values())
    words = {
        ("A strong man", "người Strong và mạnh"): ["Strong"],
        ("Freud", "ông Freud nói individul Therapeut passively"): ["individul", "passively"],
        ("x", "học máy (machine learning) email iPhone xiv NASA"): [],
        ("the word conscious", "từ “conscious” có gốc"): [],
        ("x", "từ “conscious” có gốc"): ["conscious"],
        ("x", "Kitô ôxy thanh nghiêng"): [],
    }
    assert many(spark, list(words), gate.foreign_words) == list(words.values())
    d = spark.createDataFrame([("x", "parable discipline")], "a string, b string")
    assert d.select(gate.foreign_words(F.col("a"), F.col("b"), F.array(F.lit("parable")))).first()[0] == ["discipline"]


def test_gate_builds_only_wanted_codes(spark):
    d = spark.createDataFrame([("p", "1", "It is not 5 kg, see Figure 2.", "Nó là 6 kg “x, xem Figure 3 and the.")], "project_id string, node_id string, source_text string, target_text string")
    every = {r["issue_type"] for r in gate.issues(d).collect()}
    assert {"NUMBER_MISMATCH", "NUMBER_ADDITION", "REFERENCE_MISMATCH", "REFERENCE_ADDITION", "QUOTE_UNBALANCED", "ENGLISH_RESIDUE", "NEGATION_LOSS"} <= every
    for codes in (("NUMBER_MISMATCH",), ("NEGATION_LOSS", "ENGLISH_RESIDUE"), ()):
        assert {r["issue_type"] for r in gate.issues(d, codes=codes).collect()} == every & set(codes)


def test_quality_score(spark):
    d = spark.createDataFrame([("a", "x" * 200, "y"), ("b", "It is not 5.", "")], "node_id string, s string, t string")
    r = {x["node_id"]: tuple(x["q"]) for x in d.select("node_id", scores.quality_score(gate.gate_issues(F.col("s"), F.col("t"), "en")).alias("q")).collect()}
    assert r == {"a": (0.9, False), "b": (0.75, True)}


def test_source_entities(spark):
    cases = {
        "He met Anna Karenina in Paris today, then NASA called.": [("Anna Karenina", "OTHER"), ("NASA", "ACRONYM"), ("Paris", "OTHER")],
        "The United Nations met. Chapter 3 ends here with more words now.": [("United Nations", "OTHER")],
        "Home": [],
        "SECTION IV and API-2 of it are very long texts.": [("API-2", "ACRONYM"), ("IV", "ACRONYM"), ("SECTION IV", "OTHER")],
    }
    assert [[tuple(x) for x in r] for r in many(spark, list(cases), mining.source_entities)] == list(cases.values())


def brute_hunks(before, after):
    def words(text):
        out = []
        for w in unicodedata.normalize("NFC", text).split():
            while w and not (w[0].isalnum() or w[0] == "_"):
                w = w[1:]
            while w and not (w[-1].isalnum() or w[-1] == "_"):
                w = w[:-1]
            out += [w.casefold()] if w else []
        return out

    a, b = words(before), words(after)
    if not a or not b or a == b:
        return []
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    if m.ratio() < 0.5:
        return []
    changes = [list(o[1:]) for o in m.get_opcodes() if o[0] != "equal"]
    at = 0
    while at + 1 < len(changes):
        if changes[at + 1][0] - changes[at][1] <= 1:
            nxt = changes.pop(at + 1)
            changes[at][1], changes[at][3] = nxt[1], nxt[3]
        else:
            at += 1
    out = []
    for i, j, k, m_ in changes:
        x, y = a[i:j], b[k:m_]
        if 0 < len(x) <= 4 and len(y) <= 4 and (y or len(x) > 1) and not any(c.isdigit() for w in x + y for c in w):
            p = (" ".join(x), " ".join(y))
            if p[0] != p[1]:
                out.append(p)
    return out


def test_edit_hunks_by_brute_force(spark):
    rng = random.Random(5)
    for _ in range(400):
        a = [rng.choice("a b c d “e” f9 G, (h) ... Ée E\u0301e -".split()) for _ in range(rng.randrange(2, 14))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(3)] = [rng.choice("x y z 7".split()) for _ in range(rng.randrange(3))]
        assert mining.edit_hunks(" ".join(a), " ".join(b)) == brute_hunks(" ".join(a), " ".join(b)), (a, b)
    got = {(r["avoid"], r["prefer"]): r["occurrences"] for r in catalog.QUERIES["rule_mining"](spark, SF).groupBy("avoid", "prefer").agg(F.sum("occurrences").alias("occurrences")).collect()}
    want = {}
    for r in table(spark, SF, "documents").collect():
        for line in r["text"].split("\n"):
            for p in set(brute_hunks(line, re.sub(r"\bthe\b", "this", line, flags=re.ASCII))):
                want[p] = want.get(p, 0) + 1
    assert got == want and sum(want.values()) > 50


def test_lint_spans_forms_and_downgrades(spark):
    text = unicodedata.normalize("NFD", "Một hai ba bốn việc này được làm bởi họ rồi nhé.")
    d = spark.createDataFrame([("1", "he", text), ("2", "she", "Nó về."), ("3", "it", "Nó về."), ("4", "x", "những sự khác biệt và các sự chậm trễ đó đó"), ("5", "x", "từ " * 61)], "node_id string, source_text string, target_text string")
    found = {(r["node_id"], r["rule"], r["severity"]): r["span"] for r in lint.lint(d).collect()}
    span = found["1", "PASSIVE_BY_AGENT", "WARNING"]
    assert "được làm bởi" in span and len("được làm bởi") + 12 < len(span) <= len("được làm bởi") + 24
    assert ("2", "NO_FOR_PERSON", "INFO") in found and ("3", "NO_FOR_PERSON", "INFO") not in found
    assert ("4", "DUPLICATED_FUNCTION_WORD", "WARNING") in found and found["4", "PLURAL_SU_NOUN", "WARNING"].count("chậm") == 1
    assert found["5", "LONG_SENTENCE", "INFO"].endswith("…")
    assert {r["severity"] for r in lint.lint(d, "LEGAL").where("type IN ('PASSIVE_VOICE', 'NOMINALIZATION', 'SENTENCE_FLOW')").collect()} == {"INFO"}
    v = {r["node_id"]: (r["score"], r["status"], r["failed"]) for r in lint.verdicts(d, lint.lint(d)).collect()}
    assert v["2"] == (0.8, "PASS", []) and v["1"] == (0.675, "FAIL", ["PASSIVE_VOICE"])


def test_style_lint_counts(spark):
    """Every seeded phrase is found as often as it was put in."""
    n = sum(1 for r in table(spark, SF, "documents").collect() for i, x in enumerate(r["text"].split("\n")) if x.strip(" ") and i % 6 == 0)
    found = {r["rule"]: r["findings"] for r in catalog.QUERIES["style_lint"](spark, SF).collect()}
    assert found["PASSIVE_BY_AGENT"] == n


def test_language_scores_by_brute_force(spark):
    word = re.compile(r"[A-Za-zÀ-ỹĐđ]+(?:[-'][A-Za-zÀ-ỹĐđ]+)*")
    ident = re.compile(facts.IDENTIFIER.replace("(?U)", ""))
    got = {r["doc_id"]: r for r in catalog.QUERIES["language_scores"](spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(got) == len(docs) and {r["lang"] for r in docs} > {"en", "fr"}
    same = 0
    for r in docs:
        ws = [w.lower() for w in word.findall(ident.sub(" ", re.sub("`[^`]*`", " ", r["text"])))]
        want = [len(ws)] + [sum(w in set(facts.STOPWORDS[x]) for w in ws) for x in ("en", "fr", "de", "es")]
        same += want == [got[r["doc_id"]][c] for c in ("n_words", "en_hits", "fr_hits", "de_hits", "es_hits")]
    assert same == len(docs)


def test_html_blocks(spark):
    page = "<html><head><style>p{}</style></head><body><h1>A <b>b</b></h1><p>one\n two<br>x</p><div>free</div><ul><li>no</li></ul><p>open<h3>c &amp; d</h3><img alt='pic'><script>p()</script><p> </p></body>"
    got = [(r["block_no"], r["type"], r["heading_level"], r["text"]) for r in readers.html_blocks(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("block_no").collect()]
    assert got == [(1, "heading", 1, "A b"), (2, "text", None, "one two x"), (3, "text", None, "open"), (4, "heading", 3, "c & d"), (5, "image", None, "pic")]
    found = catalog.QUERIES["html_blocks"](spark, SF).groupBy("type").agg(F.count("*").alias("n")).collect()
    pages = table(spark, SF, "pages").collect()
    assert {r["type"]: r["n"] for r in found}.get("heading", 0) == sum(len(re.findall(r"<h[1-6][^>]*>\s*[^<\s]", p["html"])) for p in pages)


def test_split_long_keeps_every_word(spark):
    src = {f"{r['doc_id']}:{i}": x for r in table(spark, SF, "documents").collect() for i, x in enumerate(r["text"].split("\n")) if packing.estimate(x) > 120}
    parts = {}
    for r in catalog.QUERIES["split_long"](spark, SF).collect():
        parts.setdefault(r["node_id"], []).append((r["part"], r["text"]))
    assert parts.keys() == src.keys()
    for k, ps in parts.items():
        texts = [t for _, t in sorted(ps)]
        assert " ".join(texts).split() == src[k].split() and all(packing.estimate(t) <= 120 or len(t.split()) == 1 for t in texts)


def test_split_layout_is_lossless(spark):
    texts = ["One. Two; three:\n\nFour five.\nSix " * 9, "\n\nlead", "word " * 80, "a\n\n\n\nb " * 40, "no end"]
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "node_id string, content string")
    parts = packing.split_layout(d, 30)
    got = {r["node_id"]: r["joined"] for r in packing.rejoin(parts).collect()}
    assert {k: v.split() for k, v in got.items()} == {str(i): t.split() for i, t in enumerate(texts) if packing.estimate(t) > 30}
    assert got["0"] == texts[0] and got["3"] == texts[3]


def test_pack_requests_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(c, f"{c}:{i}", i, rng.choice(["paragraph"] * 6 + ["heading", "table", "footnote", "image", None]), "word " * rng.randrange(1, 60)) for c in "ab" for i in range(40)]
    got = {r["node_id"]: r["chunk_no"] for r in packing.pack_requests(spark.createDataFrame(rows, "chapter_id string, node_id string, order_index int, node_type string, content string"), window=900, fixed=700, per_node=5).collect()}
    want, no, held, shut, chapter = {}, 0, 0, True, None
    for c, i, _, kind, text in rows:
        if kind == "image":
            continue
        if c != chapter:
            chapter, no, shut, held = c, 0, True, 0
        t = packing.estimate(text) + 5
        alone = t > 200 or kind in ("table", "footnote")
        if shut or alone or kind == "heading" or held + t > 200:
            no, held = no + 1, 0
        held, shut = held + t, alone
        want[i] = no
    assert got == want


def test_prompts_are_trimmed_in_order(spark):
    entry = "word " * 10
    sections = {s: [entry] * 3 for s in prompts.HEADERS}
    d = spark.createDataFrame([(1, *sections.values()), (2, *[[entry] if s in ("task", "source") else None for s in sections])], "request_id int, " + ", ".join(f"{s} array<string>" for s in sections))
    cost = packing.estimate(entry)
    keep = 20  # entries of 33 that fit
    r = {x["request_id"]: x for x in prompts.budgeted(d, window=int(cost * keep / 0.6) + 1).withColumn("prompt", prompts.prompt()).collect()}
    assert r[1]["fits"] and r[1]["dropped"] == {"examples": 3, "style_notes": 3, "document": 3, "chapter": 3, "following": 1}
    assert r[1]["examples"] == [] and len(r[1]["following"]) == 2 and len(r[1]["previous"]) == 3
    assert "[EXAMPLES]" not in r[1]["prompt"] and r[1]["prompt"].startswith("[TASK]\n") and r[1]["prompt_tokens"] == 20 * cost
    assert r[2]["dropped"] == {} and r[2]["fits"]
    tight = prompts.budgeted(d, window=20).where("request_id = 1").first()
    assert not tight["fits"] and len(tight["source"]) == 3 and tight["dropped"]["entities"] == 3


def test_chapter_memory(spark):
    import json

    good = {"summary": "s", "tone": "t", "entities": [{"source": "A", "preferred": "B"}], "key_concepts": ["x"], "pronoun_notes": [], "terminology": [], "important_facts": [], "style_notes": []}
    bad = [{**good, "extra": 1}, {k: v for k, v in good.items() if k != "tone"}, {**good, "entities": ["x"]}, {**good, "key_concepts": ["x"] * 16}, {**good, "summary": 5}, {**good, "entities": [{"source": "A"}]}]
    assert many(spark, [json.dumps(x) for x in (good, *bad)] + ["no"], reviews.memory_is_valid) == [True] + [False] * 7


def test_commit_is_all_or_nothing_per_node(spark):
    n = spark.createDataFrame([(1, "c", None, "PENDING", None), (2, "c", "old", "TRANSLATED", 3)], "node_id int, content string, target_text string, status string, version int")
    c = spark.createDataFrame([(1, "x", 1, "h", "s", "g", "v", True, True), (2, "y", 1, "i", "s", "g", "v", True, False), (2, "z", 2, "j", "s", "g", "v", False, True), (9, "q", 1, "k", "s", "g", "v", True, True)], "node_id int, target_text string, saved_at int, source_hash string, style_hash string, glossary_hash string, prompt_version string, gate_passed boolean, approved boolean")
    memory = spark.createDataFrame([("h", "s", "g", "v", "older", 0), ("z", "s", "g", "v", "keep", 0)], "source_hash string, style_hash string, glossary_hash string, prompt_version string, cached_text string, created_at int")
    after, versions, mem = records.commit(c, n, memory)
    assert sorted((r["node_id"], r["target_text"], r["status"], r["version"]) for r in after.collect()) == [(1, "x", "TRANSLATED", 1), (2, "old", "TRANSLATED", 3)]
    assert [(r["node_id"], r["version_number"]) for r in versions.collect()] == [(1, 1)]
    assert {r["source_hash"]: r["cached_text"] for r in mem.collect()} == {"h": "x", "z": "keep", "k": "q"}


def test_small_records(spark):
    t = spark.createDataFrame([("a", "ACTIVE"), ("b", "CANDIDATE")], "id string, status string")
    c = spark.createDataFrame([("a", "disabled"), ("b", "GONE")], "id string, status string")
    assert {r["id"]: r["status"] for r in records.set_status(t, c, "id", records.RULE_STATUSES).collect()} == {"a": "DISABLED", "b": "CANDIDATE"}
    g = spark.createDataFrame([("HARD", "x", "b"), ("HARD", "x", "a"), ("SOFT", "y", "c")], "lock_level string, source_term string, target string")
    assert {r["lock_level"]: r["terms"] for r in records.lock_maps(g).collect()} == {"HARD": {"x": "a"}, "SOFT": {"y": "c"}}
    assert many(spark, ["hãy tóm tắt", "please summarize", "giữ nguyên", "omit it", None], records.conflicts) == [True, True, False, True, False]
    f = spark.createDataFrame([("p", "/b.txt", "txt", 2), ("p", "/a.epub", "epub", 1), ("q", "/c.md", "md", 1)], "project_id string, path string, extension string, uploaded_at int")
    assert sorted((r["path"], r["reader"]) for r in records.first_documents(f).collect()) == [("/a.epub", "epub"), ("/c.md", "text")]
    p = spark.createDataFrame([("p", None, "NEW"), ("q", 2, "NEW")], "project_id string, version int, stage string")
    got = records.confirm_structure(p, spark.createDataFrame([("p",)], "project_id string"))
    assert {r["project_id"]: (r["version"], r["stage"]) for r in got.collect()} == {"p": (1, "STRUCTURE_CONFIRMED"), "q": (2, "NEW")}
    i = records.add_issues(spark.createDataFrame([("n", "OPEN", "ERROR")], "node_id string, status string, severity string"), spark.createDataFrame([("m",)], "node_id string"))
    assert sorted(map(tuple, i.collect())) == [("m", "OPEN", "WARNING"), ("n", "OPEN", "ERROR")]
    rules = spark.createDataFrame([("p", "a", "b", 3), ("p", "c", "", 2)], "project_id string, avoid string, prefer string, occurrences int")
    assert [r["line"] for r in records.rule_lines(rules).collect()] == ['- Avoid "a", use "b" (corrected 3 times).', '- Avoid "c"; it can mostly be left out (corrected 2 times).']
    assert spark.range(1).select(records.same_sets(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1), F.lit(1)))).first()[0]


def test_reader_terms(spark):
    n = spark.createDataFrame([("1", "p", "As you know.", "Như bạn biết."), ("2", "p", "As you know.", "Như quý vị biết."), ("3", "p", "He knows.", "quý vị"), ("4", "p", "You see.", "“quý vị” – thấy")], "node_id string, project_id string, source_text string, target_text string")
    r = spark.createDataFrame([("p", "các bạn")], "project_id string, reader string")
    assert [tuple(x) for x in address.reader_mismatches(n, r).collect()] == [("2", "quý vị")]


@pytest.mark.parametrize("name", ["cleaned_answers", "lint_verdicts", "gate_report", "provider_run"])
def test_whole_tables_are_read(spark, name):
    docs = table(spark, SF, "documents")
    got = catalog.QUERIES[name](spark, SF)
    if name == "cleaned_answers":
        assert got.count() == docs.count()
    if name in ("lint_verdicts", "provider_run"):
        every = sum(1 for r in docs.collect() for x in r["text"].split("\n") if x.strip(" "))
        assert sum(r["nodes"] for r in got.collect()) == every
    if name == "gate_report":
        assert {r["issue_type"] for r in got.collect()} >= {"EMPTY_TRANSLATION", "WRONG_TARGET_LANGUAGE", "ENGLISH_RESIDUE", "FOREIGN_SCRIPT_CONTAMINATION", "NEGATION_LOSS"}


def test_small_review_rules(spark):
    issue = "array<struct<code:string,severity:string>>"
    d = spark.createDataFrame([(1, [("ENGLISH_RESIDUE", "ERROR")]), (2, [("NUMBER_MISMATCH", None)]), (3, [("X", "info")])], f"i int, x {issue}")
    got = [tuple(r) for r in d.orderBy("i").select(reviews.tries_short_prompt(F.col("x")), F.size(reviews.blocking(F.col("x")))).collect()]
    assert got == [(True, 1), (False, 1), (False, 0)]
    f = lambda *w: reviews.policy_signature(F.lit(0.35), F.lit(0.65), F.lit(2), F.array(*map(F.lit, w)))
    a, b, c = spark.range(1).select(f("x", "Y", "X"), f("y", "x"), f("x")).first()
    assert a == b != c
    p = spark.createDataFrame([(True, True, "PASS", False, None), (True, True, "PASS", True, True), (True, False, "PASS", False, None), (False, True, "PASS", False, None), (True, True, "FAIL", False, None)], "a boolean, l boolean, s string, r boolean, v boolean")
    assert [r[0] for r in p.select(reviews.publication(*[F.col(x) for x in "alsrv"])).collect()] == ["APPROVED", "KEEP_ORIGINAL", "NEEDS_REVIEW", "NEEDS_REVIEW", "NEEDS_REVIEW"]


def test_loops_and_blanks_equal_their_patterns(spark):
    """Loops are found without trying a pattern on every character, with the same texts left."""
    rng = random.Random(4)
    phrase = lambda n: "".join(rng.choices("ab é𝒳\n", k=n))
    texts = ["", "a", " \u0085", " a \u0085", "a\u2028 \n", "\x0b a \x1f ", " " * 130, "x" * 300, "One. Two. One. Two. Three. Two.", "A.  A. B", "a.\u0085 b.\tc. d. c."]
    texts += [phrase(rng.randrange(80)) + phrase(n) * rng.randrange(1, 4) + phrase(rng.randrange(80)) for n in range(20, 66) for _ in range(3)]
    d = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    t = F.col("t")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    loops = t
    for n in range(60, 20, -5):
        loops = F.regexp_replace(loops, rf"(?s)(?!\s{{{n - 14},}})(.{{{n}}})\1+", "$1")
    notes = F.concat(t, F.lit(" \n\u0085\n  Notes - x"), t)
    noted = strip(F.regexp_replace(notes, r"(?isu)\n*\s*(?:Lưu\s*[Ýý]|Ghi\s*chú|Chú\s*thích|Note|Notes)\s*[:\-].*$", ""))
    found = d.select(strip(t), answers.stripped(t), strip(loops).alias("l"), answers.without_loops(t), noted, answers.without_remarks(notes), F.split(t, r"(?<=[.!?])\s+"), F.split(t, r"\s(?<=[.!?]\s)\s*"))
    for r in found.collect():
        assert all(r[i] == r[i + 1] for i in (0, 2, 4, 6))
    blocks = lambda x: F.regexp_extract_all(x, F.lit("(?s).{5}"), F.lit(0))
    asked = d.select(F.coalesce(answers._may_loop(blocks(t)), F.lit(False)).alias("may"), (loops != t).alias("has"), F.length(t).alias("n")).collect()
    assert all(r["may"] for r in asked if r["has"]) and sum(r["may"] for r in asked if r["n"] and not r["has"]) < 20


def test_many_repeated_sentences(spark):
    """More sentences than are looked at in one part, most of them repeated."""
    rng = random.Random(6)
    for n in (3, 64, 65, 66, 400):
        own = [rng.choice(("A.", "B.", "C.", "Dd e.")) for _ in range(n)]
        kept = []
        for s in own:
            if s not in kept[-2:]:
                kept.append(s)
        assert many(spark, [" ".join(own)], answers.unique_sentences) == [" ".join(kept)]
    assert many(spark, ["A. " * 200], answers.unique_sentences) == ["A."]
