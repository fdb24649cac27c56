"""Assembly of requests in steps, and packing by the assembled request, against plain Python."""

import json
import random

from lexiloom.operators import packing, prompts

MEMORY = "struct<summary:string,entities:array<string>,terminology:array<string>,pronoun_notes:array<string>,tone:string,style_notes:array<string>,facts:array<string>>"
PROFILE = "struct<document_type:string,source_domain:string,source_audience:string,source_tone:string,source_register:string,style_observations:array<string>,source_summary:string>"
TERM = "array<struct<source_term:string,preferred_target:string>>"
SCHEMA = (
    f"request_id long, payload string, document {PROFILE}, chapter {MEMORY}, rolling array<struct<node_id:string,source:string,translation:string>>, entities array<struct<source:string,target:string>>, soft {TERM}, "
    f"style array<struct<source:string,translation:string>>, shots array<struct<example_id:string,source:string,target:string>>, hard {TERM}, system string, compact_system string, contract string, rules array<string>, window int, most_source int"
)


def est(t):
    return packing.estimate(t)


def plain(r):
    """The rule, a step after the other, each time from the whole request."""
    spaced = lambda x: json.dumps(x, ensure_ascii=False)
    tight = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    doc, chap, steps = dict(r["document"]), dict(r["chapter"]), []
    limit, big = r["window"], max(256, r["window"] // 6)
    shot = lambda e: spaced({k: e[k] for k in ("source", "target")})
    shots = [e for e in r["shots"] or [] if e["example_id"] or est(shot(e)) <= big]
    if len(shots) < len(r["shots"] or []):
        steps.append("few_shot_drop_emergency")
    now = {"document": tight(doc), "chapter": tight(chap), "rolling": list(r["rolling"] or []), "entities": list(r["entities"] or []), "soft": list(r["soft"] or []), "style": list(r["style"] or []), "shots": shots, "system": r["system"]}
    source = est(r["payload"])
    reserved, margin = max(320, min(1400, int(source * 1.35) + 128)), max(220, int(limit * 0.06))

    def total():
        parts = [est(now["system"]), est(now["document"]), est(now["chapter"]), est(spaced([dict(x) for x in now["rolling"]])), est(spaced({x["source"]: x["target"] for x in now["entities"]})), est(spaced([dict(x) for x in now["soft"]]))]
        parts += [est(spaced([dict(x) for x in now["style"]])), est("[" + ", ".join(map(shot, now["shots"])) + "]"), est(spaced([dict(x) for x in r["hard"] or []])), est(r["contract"]) + 72 + est("\n".join(r["rules"] or []))]
        return sum(parts) + source + reserved + margin

    def step(name, change):
        change()
        if name not in steps:
            steps.append(name)

    cut = lambda m, keep: tight({k: m[k] if n is None else m[k][:n] for k, n in keep.items()})
    for name, m, of in (("document", doc, prompts.DOCUMENT_LEVELS), ("chapter", chap, prompts.CHAPTER_LEVELS)):
        for i, keep in enumerate(of, 1):
            if total() > limit:
                step(f"{name}_memory_compact_{i}", lambda: now.update({name: cut(m, keep)}))  # noqa: B023
    for key, name, at, least in (("rolling", "rolling_context_oldest", 0, 1), ("entities", "entity_decisions_optional", -1, 0), ("soft", "soft_glossary_optional", -1, 0), ("style", "style_memory_oldest", 0, 1), ("shots", "few_shot_reduce", -1, 1)):
        while total() > limit and len(now[key]) > least:
            step(name, lambda: now[key].pop(at))  # noqa: B023
    if total() > limit and len(now["shots"]) == 1 and est(shot(now["shots"][0])) > big:
        step("few_shot_drop_emergency", now["shots"].clear)
    if total() > limit and len(now["style"]) == 1 and est(spaced(dict(now["style"][0]))) > big:
        step("style_memory_drop_emergency", now["style"].clear)
    if total() > limit and r["compact_system"] and r["compact_system"] != now["system"]:
        step("optional_style_notes", lambda: now.update(system=r["compact_system"]))
    return now, steps, total(), source


def made(rng, i):
    words = lambda n: " ".join(rng.choice(["word", "an,", "über", "\"q\"", "x.y", "日本", "end."]) for _ in range(rng.randrange(n + 1)))
    some = lambda n, f: [f(k) for k in range(rng.randrange(n + 1))]
    long = 200 if i % 9 == 0 else 20
    return {
        "request_id": i, "payload": words(150), "document": {k: words(4) for k in ("document_type", "source_domain", "source_audience", "source_tone", "source_register")} | {"style_observations": some(9, lambda _: words(6)), "source_summary": words(300)},
        "chapter": {"summary": words(350), "entities": some(14, lambda _: words(3)), "terminology": some(14, lambda _: words(3)), "pronoun_notes": some(10, lambda _: words(5)), "tone": words(80), "style_notes": some(8, lambda _: words(5)), "facts": some(5, lambda _: words(9))},
        "rolling": some(5, lambda k: {"node_id": f"n{k}", "source": words(30), "translation": words(30)}), "entities": some(8, lambda k: {"source": f"{k}{words(2)}", "target": words(2)}), "soft": some(8, lambda k: {"source_term": f"s{k}", "preferred_target": words(3)}),
        "style": some(4, lambda _: {"source": words(long), "translation": words(long)}), "shots": some(4, lambda k: {"example_id": f"e{k}" if rng.random() < 0.8 else None, "source": words(long * 2), "target": words(long * 2)}), "hard": some(4, lambda k: {"source_term": f"h{k}", "preferred_target": words(2)}),
        "system": words(60), "compact_system": words(10) or None, "contract": words(20), "rules": some(3, lambda _: words(6)), "window": rng.randrange(900, 2600), "most_source": rng.choice([100, 400, 4000]),
    }


def test_assembly_equals_the_steps_played_out(spark):
    rng = random.Random(5)
    rows = [made(rng, i) for i in range(400)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = {r["request_id"]: r for r in prompts.assemble(d).collect()}
    last = set()
    for r in rows:
        now, steps, total, source = plain(r)
        g = got[r["request_id"]]
        assert list(dict.fromkeys(g["trim_steps"])) == steps, r["request_id"]
        assert (g["tokens"]["total"], g["tokens"]["source"]) == (total, source)
        assert json.loads(g["document"]) == json.loads(now["document"]) and json.loads(g["chapter"]) == json.loads(now["chapter"])
        for c in ("rolling", "entities", "soft", "style", "shots"):
            assert [x.asDict() for x in g[c]] == [dict(x) for x in now[c]], c
        assert g["system"] == now["system"]
        room = min(r["most_source"], max(0, r["window"] - (total - source)))
        assert (g["tokens"]["available_source"], g["tokens"]["fits"]) == (room, total <= r["window"] and source <= room)
        last |= set(steps[-1:])
    assert last == set(prompts.STEPS)


def test_assembly_of_nothing(spark):
    none = dict.fromkeys(("document", "chapter", "rolling", "entities", "soft", "style", "shots", "hard", "system", "compact_system", "contract", "rules", "payload"))
    d = spark.createDataFrame([none | {"request_id": 1, "window": 2000, "most_source": 9}], SCHEMA)
    r = prompts.assemble(d).first()
    assert (r["trim_steps"], r["tokens"]["source"], r["tokens"]["fits"]) == ([], 0, True)
    assert prompts.assemble(d.limit(0)).count() == 0


def test_chunks_take_what_their_request_holds(spark):
    rng = random.Random(2)
    terms = [("alpha", "ALPHA"), ("beta", "BETA two"), ("gamma", "GAMMA")]
    text = lambda n: " ".join(rng.choice(["word", "alpha", "beta,", "gamma.", "é\n"] + ["w"] * 12) for _ in range(n))
    rows = [(c, f"{c}{i:03}", i, rng.choice(["paragraph"] * 8 + ["heading", "table", "footnote", "image", None]), text(rng.choice([3, 30, 90, 400]))) for c in ("a", "b", None) for i in range(60)]
    rows.append(("z", "z0", 0, "paragraph", None))
    contexts, fixed, window, most = (200, 90, 20), 100, 1300, 500

    def request(held):
        blocks = " ".join("{ " + f'"node_id": "{n}", "type": "{k or "paragraph"}", "text": {json.dumps(t or "", ensure_ascii=False)}' + " }," for _, n, _, k, t in held)
        source = est("[ " + blocks.removesuffix(",") + " ]")
        words = set(" ".join(t or "" for *_, t in held).lower().replace(",", " ").replace(".", " ").split())
        kept = [{"source_term": s, "preferred_target": t} for s, t in terms if s in words]
        rest = fixed + est(json.dumps(kept)) + source + max(320, min(1400, int(source * 1.35) + 128)) + max(220, int(window * 0.06))
        level = next((i for i, c in enumerate(contexts) if rest + c <= window), -1) if source <= most else -1
        return source, rest + contexts[level], level

    want, held, chapter, no = {}, [], object(), 0

    def close():
        for x in held:
            want[x[1]] = (no, *request(held))
        held.clear()

    for row in sorted((r for r in rows if r[3] != "image"), key=lambda r: (r[0] or "", r[2])):
        if row[0] != chapter:
            close()
            chapter, no = row[0], 0
        if held and (held[0][3] in ("table", "footnote") or row[3] in ("heading", "table", "footnote") or request([*held, row])[2] < 0 or request(held)[2] < 0):
            close()
        no += not held
        held.append(row)
    close()
    d = spark.createDataFrame(rows, "chapter_id string, node_id string, order_index int, node_type string, content string")
    g = spark.createDataFrame(terms, "source_term string, target string")
    got = {r["node_id"]: (r["chunk_no"], r["source_tokens"], r["total_tokens"], r["level"]) for r in packing.pack_assembled(d, g, contexts, fixed, window, most).collect()}
    assert got == want
    assert {v[3] for v in want.values()} == {-1, 0, 1, 2}
    assert packing.pack_assembled(d.limit(0), g).count() == 0


def test_segments_by_brute_force(spark):
    rng = random.Random(7)
    pieces = ["word ", "a, ", "end. ", "two; ", "\n", "\n\n", "\t", "  ", "é ", "long" * 20 + " ", "x.y "]
    texts = {str(i): "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 900))) for i in range(40)} | {"w": "w" * 900, "q": "“" * 4000, "e": "", "n": None, "l": "\n\nlead", "s": "short"}
    window, fixed, first, depth = 900, 100, 40, 3

    def total(source, context):
        return fixed + max(220, int(window * 0.06)) + context + source + max(320, min(1400, int(source * 1.35) + 128))

    want = {}
    for node, text in texts.items():
        if not text:
            continue
        parts = packing.layout_parts(text, 180)
        for turn in range(depth + 1):
            sizes = [est(p) for p, _ in parts]
            totals = [total(n, int(sizes[i - 1] * 2.35) if i else first) for i, n in enumerate(sizes)]
            over = [t > window for t in totals]
            if turn == depth or not any(over):
                break
            after = []
            for (p, gap), n, t, bad in zip(parts, sizes, totals, over, strict=True):
                smaller = packing.layout_parts(p, min(max(16, window - t + n), max(16, n // 2))) if bad else [(p, "")]
                smaller[-1] = smaller[-1][0], smaller[-1][1] + gap
                after += smaller
            parts = after
        want[node] = [(p, g, n, t, t <= window) for (p, g), n, t in zip(parts, sizes, totals, strict=True)]
        assert "".join(p + g for p, g in parts) == text
    d = spark.createDataFrame(list(texts.items()), "node_id string, content string")
    got = {}
    for r in packing.segments(d, window, fixed, first, depth=depth).orderBy("node_id", "part").collect():
        got.setdefault(r["node_id"], []).append((r["text"], r["gap"], r["source_tokens"], r["total_tokens"], r["fits"]))
    assert got == want
    assert not all(x[-1] for x in want["q"]) and any(len(x) > 3 for x in want.values())
    assert packing.segments(d.limit(0)).count() == 0


def test_neighbours_on_both_sides(spark):
    from pyspark.sql import functions as F

    from lexiloom.operators import nodes

    rng = random.Random(8)
    rows = [(c, f"{c}{i}", i * 3, "w " * rng.randrange(30), rng.choice([None, "t " * 20]), rng.random() < 0.5) for c in "abc" for i in range(25)] + [(None, "n0", 0, "x", "y", True), (None, "n1", 1, "x", "y", True), ("z", "z0", 0, None, None, True), ("z", "z1", 1, None, None, None)]
    d = spark.createDataFrame(rows, "chapter_id string, node_id string, order_index int, content string, target_text string, ok boolean")
    got = {r["node_id"]: r["context"] for r in nodes.neighbours(d, 2, 3, 70, F.col("ok")).collect()}
    for c, node, at, *_ in rows:
        same = [r for r in rows if r[0] == c and c is not None and r[5]]
        near = [r for r in same if r[2] < at][-2:] + [r for r in same if r[2] > at][:3]
        ids, spent = [], 0
        for r in near:
            cost = max(1, int((len((r[3] or "").split()) + len((r[4] or "").split())) * 1.45))
            if not ids or spent + cost <= 70:
                ids.append(r[1])
                spent += cost
        assert got[node] == ids, node


def test_the_whole_gate_unites_every_check(spark):
    from lexiloom.operators import whole_gate

    leak = "six plain words stand here together"
    rows = [
        ("p", "a", "paragraph", "In Rome.", "In Rome."), ("p", "b", "paragraph", "In Rome.", "In Roma."), ("q", "c", "paragraph", "In Rome.", "In Rome."),
        ("p", "d", "heading", "One", "Tựa chung"), ("p", "e", "heading", "Two", "Tựa chung"), ("p", "f", "paragraph", "“I see you,” Bob said to Ann.", "“Tôi thấy bạn,” Bob nói."),
        ("p", "g", "paragraph", "x", f"{leak}. Other."), ("p", "h", "paragraph", "In Rome 5.", None), ("p", "i", "paragraph", "It has 5.", "Có 6."),
    ]
    d = spark.createDataFrame(rows, "project_id string, node_id string, node_type string, source_text string, target_text string")
    locked = spark.createDataFrame([("p", "Rome", "Roma")], "project_id string, source_key string, target string")
    couples = spark.createDataFrame([("p", "Bob", "Ann", "anh", "em")], "project_id string, speaker string, listener string, self_term string, other_term string")
    earlier = spark.createDataFrame([("z", f"{leak}.")], "id string, text string")
    codes = ("NUMBER_MISMATCH", "NUMBER_ADDITION")
    found = whole_gate.all_issues(d, locked, couples, earlier, codes=codes)
    got = sorted((r["node_id"], r["issue_type"]) for r in found.collect())
    assert got == [("a", "ENTITY_MISMATCH"), ("d", "HEADING_DUPLICATE"), ("e", "HEADING_DUPLICATE"), ("f", "ADDRESS_TERM_MISMATCH"), ("g", "CONTEXT_LEAK"), ("h", "EMPTY_TRANSLATION"), ("h", "ENTITY_MISMATCH"), ("i", "NUMBER_ADDITION"), ("i", "NUMBER_MISMATCH")]
    state = {r["node_id"]: (r["passed"], r["errors"]) for r in whole_gate.passed(d, found).collect()}
    assert state["b"] == (True, 0) and state["h"] == (False, 2) and sum(ok for ok, _ in state.values()) == 2
    assert {r["issue_type"] for r in whole_gate.all_issues(d, codes=codes).collect()} == {"HEADING_DUPLICATE", "EMPTY_TRANSLATION", "NUMBER_ADDITION", "NUMBER_MISMATCH"}
