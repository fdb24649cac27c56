"""Operators at work on many like rows: the same results, without meeting all of them."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from lexiloom import stages
from lexiloom.operators import gate, lint, packing, retrieval, structure, terms


def _memory(spark, texts):
    rows = [(i, f"p{i % 2}", "GENERAL" if i % 3 else "LEGAL", t) for i, t in enumerate(texts)]
    m = spark.createDataFrame(rows, "memory_id long, project_id string, domain string, source_text string")
    same = {"document_type": F.lit("BOOK"), "mode": F.lit("NATURAL"), "node_type": F.lit("paragraph")}
    n = m.where("memory_id % 20 = 0").select(F.col("memory_id").alias("node_id"), "project_id", F.lit("GENERAL").alias("domain"), "source_text").withColumns(same)
    return n, m.withColumns(same | {"quality_status": F.lit("USER_APPROVED"), "scope": F.lit("PROJECT"), "source_patterns": F.array(F.lit("sentence_merge"))})


def _brute_force(texts, k=3):
    words = [set(re.findall(r"\w+", t.lower())) for t in texts]
    out = {}
    for q in range(0, len(texts), 20):
        scored = []
        for i in range(q % 2, len(texts), 2):
            merge = bool(re.search(r"\band\b", texts[q]))
            s = (70 if i % 3 else 0) + 61 + 12 * merge + min(20, 3 * len(words[q] & words[i])) + max(0, 10 - abs(len(words[q]) - len(words[i])) // 4)
            scored.append((-s, i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_style_memory_meets_few_rows_and_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(90)]
    texts = [" ".join(rng.choices(vocabulary, weights=[90 // (i + 1) + 1 for i in range(90)], k=rng.choice((0, 2, 3, 5, 8, 20, 60)))) + rng.choice(("", " and so")) for i in range(900)]
    n, m = _memory(spark, texts)
    for first in (1, 4, 32):
        got = {}
        for r in retrieval.style_memory(n, m, first=first).orderBy("node_id", "rank").collect():
            got.setdefault(r["node_id"], []).append((r["memory_id"], r["score"]))
        assert got == _brute_force(texts), first


def test_style_memory_asks_no_more_of_a_larger_memory(spark):
    def asked(size):
        n, m = _memory(spark, [f"one two three four five six seven eight n{i}" for i in range(size)])
        before = set(stages.STAGED)
        assert retrieval.style_memory(n.where("node_id < 200"), m).count() == 30
        (path,) = [p for p in stages.STAGED - before if "/style-asked-" in p]
        return spark.read.parquet(path).count()

    assert asked(400) == asked(4000) == 0


def test_context_leaks_leave_sentences_that_meet_nothing(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    draw = lambda n, k: [". ".join(" ".join(rng.choices(words, k=rng.choice((1, 5, 6, 9, 12)))) for _ in range(3)) for _ in range(n)]
    earlier = draw(40, 3)
    texts = draw(150, 3) + [e.replace("w1 ", "q ", 1) for e in earlier] + ["unlike words that nobody has written before now"] * 500 + [None, ""]
    n = spark.createDataFrame(list(enumerate(texts)), "node_id long, text string")
    e = spark.createDataFrame(list(enumerate(earlier)), "id long, text string")
    before = set(stages.STAGED)
    got = {tuple(r) for r in gate.context_leaks(n, e).collect()}
    kept = sum(spark.read.parquet(p).where("a_id >= 190").count() for p in stages.STAGED - before if "a_id" in spark.read.parquet(p).columns)
    assert kept == 0 and got == {tuple(r) for r in gate.context_leaks(n, e, known=1).collect()}
    cut = lambda t: [(s, set(re.findall(r"\w+", s))) for s in re.split(r"(?<=[.!?…])\s+|\n+", t or "") if s.strip()]
    old = [(i, w) for i, t in enumerate(earlier) for _, w in cut(t)]
    want = {(i, s, min(hits)) for i, t in enumerate(texts) for s, w in cut(t) if len(w) >= 6 for hits in [[j for j, o in old if len(w & o) >= 0.8 * len(w | o)]] if hits}
    assert got == want and len(got) > 20


def test_parts_are_put_together_as_before_and_cut_once(spark):
    def whole(units, budget):  # each sum measured anew
        out = []
        for unit, gap in units:
            if out and (not out[-1][0].strip() or not unit.strip() or packing.estimate(out[-1][0] + out[-1][1] + unit) <= budget):
                out[-1] = out[-1][0] + out[-1][1] + unit, gap
            else:
                out.append((unit, gap))
        return out

    rng = random.Random(3)
    piece = lambda: "".join(rng.choices("ab.é \n漢, ", k=rng.choice((0, 1, 2, 5))))
    for _ in range(3000):
        units = [(piece(), rng.choice((" ", "\n", "", " ", "x"))) for _ in range(12)]
        assert packing._merged(units, 12) == whole(units, 12)
    d = spark.createDataFrame([(1, "one two. " * 400)], "node_id long, content string")
    parts = packing.split_layout(d, 60)
    plan = packing.rejoin(parts, F.count("*").alias("n"))
    assert plan.first()["joined"] == "one two. " * 400 and plan._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_letters_of_a_rule_are_in_all_that_it_finds(spark):
    assert all(unicodedata.normalize("NFC", x) == x and not x.isascii() for groups in lint.LETTERS.values() for g in groups for x in g)
    words = sorted({w for _, _, _, p in lint.RULES for w in re.findall(r"[^\W\d_]+", re.sub(r"\\.|\{[^}]*\}|\(\?[a-z<!=:]+", " ", p)) if len(w) > 1})
    rng = random.Random(2)
    turn = lambda w: rng.choice((w, w, w.upper(), w.capitalize()))
    texts = [" ".join(turn(w) for w in rng.choices(words, k=12)) for _ in range(1500)]
    for _, _, _, p in lint.RULES:  # and runs of each pattern's own words, so that every rule hits
        own = re.findall(r"[^\W\d_]+|,", re.sub(r"\\s\+|\\.|\{[^}]*\}|\(\?[a-z<!=:]+", " ", p))
        texts += [" ".join(turn(w) for w in own[i : i + n]) for i in range(len(own)) for n in range(2, 8)]
        texts += [" ".join(turn(w) for w in rng.choices(own, k=5)) for _ in range(150)]
    n = spark.createDataFrame([(i, "He said so.", t) for i, t in enumerate(texts)], "node_id long, source_text string, target_text string")
    bare = tuple((r, k, s, f"(?:{p})") for r, k, s, p in lint.RULES)  # patterns that no letters are known of
    found = lint.lint(n)
    rows = lambda df: sorted((r["node_id"], r["rule"]) for r in df.collect())
    got = rows(found)
    assert got == rows(lint.lint(n, rules=bare)) and len({r for _, r in got}) >= 24


def test_headings_meet_by_few_grams_and_equal_brute_force(spark):
    """Renderings of 1 to 80 characters, cut from each other, of two projects; the short ones in passes of five."""
    rng = random.Random(8)
    whole = [" ".join(rng.choices(["the", "house", "öf", "𝒳y", "a", "garden"], k=rng.randrange(1, 16))) for _ in range(60)]
    cut = [t[i : i + rng.randrange(1, 40)] for t in whole for i in (0, rng.randrange(len(t)))]
    rows = [(rng.choice("pq"), str(i), rng.choice(["x", "y", "xy", ""]), t) for i, t in enumerate(whole + cut)] + [(None, "n", "x", whole[0]), ("p", "m", None, whole[0])]
    norm = [(p, n, s, " ".join(t.split())) for p, n, s, t in rows if p and s and t.strip()]
    want = sorted((n, m) for p, n, s, t in norm for q, m, z, o in norm if p == q and n != m and (t == o or (len(t) >= 3 and t in o)) and s not in z and z not in s)
    before = set(stages.STAGED)
    got = terms.duplicated_headings(spark.createDataFrame(rows, "project_id string, node_id string, source_text string, target_text string"), at_once=5)
    assert sorted(map(tuple, got.collect())) == want
    (path,) = [p for p in stages.STAGED - before if "/heading-grams-" in p]
    assert spark.read.parquet(path).count() < sum(len(t) for *_, t in set(norm)) / 3


def test_totals_of_a_rebuilding_need_no_long_texts(spark):
    rng, n = random.Random(2), 40
    head, mark = "A running head " * 12, "7 | " + "x " * 90
    rows = []
    for p in range(1, n):
        texts = [(head, 20.0), (rng.choice([head, mark, f"{p}", None]), 800.0), (rng.choice(["CHAPTER 3", "word " * rng.randrange(1, 60), head, "a-\nb " * 40, ""]), 200.0), ("SHORT", 300.0)]
        rows += [(p % 3, p, i, "text", t, 40.0, y, 560.0, y + 15.0, rng.choice([11.0, 22.0]), True, None) for i, (t, y) in enumerate(texts)]
    b = spark.createDataFrame(rows, "doc_id int, page_number int, block_id int, type string, text string, x0 double, y0 double, x1 double, y1 double, font_size double, is_bold boolean, heading_level int")
    pages = b.select("doc_id", "page_number", F.lit(600.0).alias("width"), F.lit(842.0).alias("height")).distinct()
    want = structure.totals(structure.rebuild(b, pages))
    got = structure.rebuilt_totals(b, pages)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("sha2")  # the hash is made below every join, where texts are read
