"""Operators that SQL cannot express, against brute force on small tables; classifiers on held-out rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate, near_dedup, quality_classifier, quality_rules, substring_dedup

P = pytest.importorskip("public_tokenizers")


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def variants(rng, base, n, k):
    out = []
    for _ in range(n):
        v = list(base)
        for _ in range(rng.randrange(k + 1)):
            v[rng.randrange(len(v))] = f"z{rng.randrange(10**6)}"
        out.append(v)
    return out


def brute_components(texts, w, percent=80):
    sets = {}
    for i, t in texts.items():
        ws = (t or "").encode().lower().split()
        sets[i] = {tuple(ws[k : k + w]) for k in range(len(ws) - w + 1)} if len(ws) >= w else ({tuple(ws)} if ws else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_dedup_finds_every_link(spark, monkeypatch):
    """Groups far beyond the sizes of buckets and blocks, so that both steps and both kinds of buckets are at work."""
    monkeypatch.setattr(near_dedup, "SMALL", 6)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "WIDE_BLOCK", 16)
    rng = random.Random(1)
    rows = []
    for size, k in ((140, 9), (40, 6), (12, 4), (5, 2), (2, 1)):
        rows += variants(rng, words(rng, 70), size, k)
    rows += [words(rng, rng.randrange(1, 60)) for _ in range(120)]
    rows += [rows[0]] * 30
    rng.shuffle(rows)
    texts = {i: " ".join(r) for i, r in enumerate(rows)}
    want, sizes = brute_components(texts, 2)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = near_dedup.near_dedup(d, words=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert {r["doc_id"] for r in got if r["kept"]} == set(want.values())


def test_near_dedup_with_many_unlinked_components_in_hot_buckets(spark, monkeypatch):
    """Copies of one text at a distance that shares bands but makes few links: askers and members fill several blocks each."""
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "WIDE_BLOCK", 6)
    rng = random.Random(31)
    base = words(rng, 120)
    rows = [base]
    for i in range(160):
        v = list(base)
        for _ in range(4 + i % 9):
            v[rng.randrange(len(v))] = f"z{rng.randrange(10**6)}"
        rows.append(v)
    texts = {i: " ".join(r) for i, r in enumerate(rows[1:] + rows[:1])}
    want, _ = brute_components(texts, 2)
    assert 20 < len(set(want.values())) < 140
    got = near_dedup.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8, 0.95):
        both, own = int(2000 * share), int(2000 * (1 - share) / 2)
        x = np.unique(rng.integers(0, 1 << 63, both + 2 * own, np.uint64))
        a, b = np.sort(np.concatenate([x[:both], x[both : both + own]])), np.sort(np.concatenate([x[:both], x[both + own :]]))
        ra, rb = near_dedup.sketch(a), near_dedup.sketch(b)
        true = both / len(x)
        assert abs(near_dedup.estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0] - true) < 0.13
        assert (np.maximum(ra, rb) == near_dedup.sketch(x)).all()


def test_components_of_chains(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in near_dedup.components(e).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_decontamination_finds_edited_passages_and_spares_the_rest(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9)))
    items = [" ".join(word() for _ in range(rng.randrange(16, 60))) for _ in range(30)]
    rows, want = [], {}
    for i in range(200):
        body = " ".join(word() for _ in range(rng.randrange(5, 400)))
        if i % 4 == 0:
            k = rng.randrange(30)
            p = list(items[k])
            for _ in range(max(0, len(p) // 40)):  # one edit in 40 characters
                at = rng.randrange(len(p))
                p[at] = rng.choice(["", "q", p[at] + "q"])
            cut = rng.randrange(len(body) + 1)
            body = body[:cut] + "\n" + "".join(p).upper() + "  " + body[cut:]
            want[i] = k
        rows.append((i, body))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block in (4_000_000, 3_000):
        got = {r["doc_id"]: r["items"] for r in decontaminate.decontaminate(d, b, block_chars=block).where("contaminated").collect()}
        assert got == {i: [k] for i, k in want.items()}


def test_decontamination_equals_the_plain_rule(spark):
    """Every segment of every item against every place of every text, by a plain edit distance with free ends."""
    rng = random.Random(12)
    draw = lambda n: "".join(rng.choice("abcd efg ") for _ in range(n))
    items = {1: draw(150), 2: draw(64), 3: draw(70), 4: draw(40), 5: draw(90).upper(), 6: "short one", 7: "ab", 8: None, 9: "  ", 10: draw(33)}

    def segments(text):
        t = decontaminate.normal(text)
        m, step = decontaminate.SEGMENT, decontaminate.STRIDE
        if len(t) < decontaminate.SHORT:
            return []
        return [t[a : a + m] for a in sorted({*range(0, max(1, len(t) - m), step), max(0, len(t) - m)})]

    def within(segment, text):
        limit = min(int(len(segment) * decontaminate.EDIT_RATE), (len(segment) - decontaminate.Q) // decontaminate.Q)
        row = [0] * (len(text) + 1)
        for i, a in enumerate(segment, 1):
            new = [i]
            for j, b in enumerate(text, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
            row = new
        return min(row) <= limit

    def found(text):
        t = decontaminate.normal(text or "")
        out = set()
        for i, item in items.items():
            k = decontaminate.normal(item or "")
            if k and len(k) < decontaminate.SHORT:
                hit = f" {k} " in f" {t} "
            else:
                hit = any(within(s, t) for s in segments(item or ""))
            out |= {i} if hit else set()
        return sorted(out)

    texts = [None, "", "ab", "x ab.", "one Short  one here", draw(300)]
    for n in range(70):
        item = items[rng.choice([1, 2, 3, 4, 5, 10])]
        at = rng.randrange(max(1, len(item) - 30))
        cut = list(item[at : at + rng.randrange(25, 120)])
        for _ in range(rng.randrange(7)):
            k = rng.randrange(len(cut))
            cut[k : k + rng.choice([0, 1])] = rng.choice(["z", "", "yz"])
        texts.append(draw(rng.randrange(60)) + "".join(cut) + draw(rng.randrange(60)))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = {i: found(t) for i, t in enumerate(texts)}
    assert 15 < sum(map(bool, want.values())) < 70
    for block in (decontaminate.BLOCK_CHARS, 150):
        assert {r["doc_id"]: r["items"] for r in decontaminate.decontaminate(d, b, block_chars=block).collect()} == want


def test_short_items_are_found_as_whole_words(spark):
    items = ["The cat", "yes", "forty  two", "the CAT", "0123456789012345678901234"]
    texts = ["see the\ncat run", "the cats", "Yes", "eyes yesterday", "it is forty two.", "it is FORTY\ttwo ok", None, "", "x 0123456789012345678901234 y", "x01234567890123456789012345"]
    want = [[0, 3], [], [1], [], [], [2], [], [], [4], [4]]
    b = spark.createDataFrame([*enumerate(items), (9, None), (9, " ")], "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (1000, 12):
        got = {r["doc_id"]: r["items"] for r in decontaminate.decontaminate(d, b, block_chars=block).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_decontamination_crosses_windows(monkeypatch):
    monkeypatch.setattr(decontaminate, "WINDOW", 1000)
    rng = random.Random(4)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(15))
    x = decontaminate.build_index([(9, item)])
    for at in (0, 930, 980, 2500):
        text = ("z" * 7 + " ") * 200
        assert decontaminate.matches([text[:at] + item + text[at:]], x) == [{9}]
    assert decontaminate.matches([("z" * 7 + " ") * 500, None, ""], x) == [set(), set(), set()]


def test_banded_alignment_is_edit_distance():
    rng = random.Random(6)

    def within(a, b, k):
        d = [0] * (len(b) + 1)
        for i, c in enumerate(a, 1):
            prev, d[0] = d[0], i
            for j, e in enumerate(b, 1):
                prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (c != e))
        return min(d) <= k

    item = "".join(rng.choice("abcd ") for _ in range(64))
    x = decontaminate.build_index([(0, item)])
    s = decontaminate.normal(item)[: decontaminate.SEGMENT]
    for edits in range(10):
        p = list(s)
        for _ in range(edits):
            at = rng.randrange(len(p))
            p[at] = rng.choice(["", "q", p[at] + "q"])
        text = "zzzzzzzz" + "".join(p) + "zzzzzzzz"
        got = decontaminate.aligned(decontaminate.codes_of(text), np.array([8]), np.array([0]), x)[0]
        assert got == within(s, text, int(x.edits[0]))


def test_substring_dedup_catches_long_passages_wherever_they_stand(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 10))) for _ in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [some(52) for _ in range(60)]
    rows, holds = [], defaultdict(list)
    for i in range(400):
        body = some(rng.randrange(10, 200))
        if i % 2 == 0:
            k = rng.randrange(60)
            at = rng.randrange(len(body))
            body[at:at] = passages[k]
            holds[k].append(i)
        rows.append((i, " ".join(body)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(d).collect()}
    repeated = {i for docs in holds.values() if len(docs) > 1 for i in docs}
    flagged = {i for i, r in got.items() if r["has_repeat"]}
    assert flagged <= repeated and len(flagged) >= 0.97 * len(repeated)
    for docs in holds.values():
        for i in docs[1:]:
            if i in flagged:
                assert got[i]["dropped_bytes"] > 0
        assert got[docs[0]]["dropped_bytes"] == 0
    texts = dict(rows)
    assert all(got[i]["text"] == texts[i] for i in texts if i not in repeated)


def brute_repeats(texts, min_words, within=False):
    """{id: (n_repeats, repeated_bytes, dropped_bytes)} by the rule itself: 16-byte gear hashes, chunks from cut to cut, chunks compared as bytes."""
    gear = substring_dedup.GEAR.tolist()
    found = {}
    for i, text in texts.items():
        raw = text.encode()
        keep, data = [], []
        for k, c in enumerate(raw):
            blank = c in b" \t\n\x0b\x0c\r"
            if not (blank and (k == 0 or raw[k - 1] in b" \t\n\x0b\x0c\r")):
                keep.append(k)
                data.append(32 if blank else c + 32 if 65 <= c <= 90 else c)
        n = len(data)
        cuts = [k + 1 for k in range(n) if data[k] == 32 and sum(gear[data[k - j]] << j for j in range(min(16, k + 1))) % 65536 >> 14 == 0]
        if n and (not cuts or cuts[-1] != n):
            cuts.append(n)
        for a in ([0, *cuts[:-1]] if n else []):
            b = next((b for b in cuts if b > a and bytes(data[a:b]).count(b" ") + (b == n and data[-1] != 32) >= min_words), None)
            if b:
                found.setdefault(bytes(data[a:b]), []).append((i, keep[a], keep[b] if b < n else len(raw)))
    spans, gone = defaultdict(set), defaultdict(set)
    for at in found.values():
        if len(at) > 1 and (within or len({i for i, _, _ in at}) > 1):
            for x in at:
                spans[x[0]].add(x[1:])
                if x != min(at):
                    gone[x[0]].add(x[1:])
    cover = lambda s: len({p for a, b in s for p in range(a, b)})
    return {i: (len(spans[i]), cover(spans[i]), cover(gone[i])) for i in texts}


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(41)
    some = lambda n: [rng.choice(["a", "Bc", "def", "gh\t", "é日", "i\n", "klmno"]) + str(rng.randrange(60)) for _ in range(n)]
    shared = [some(rng.randrange(12, 60)) for _ in range(12)]
    texts = {}
    for i in range(120):
        t = some(rng.randrange(40))
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            at, lo = rng.randrange(len(t) + 1), rng.randrange(4)
            t[at:at] = [x.upper() if i % 5 == 0 and x.isascii() else x for x in p[lo:]]
        texts[i] = rng.choice([" ", "  "]).join(t)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for within in (False, True):
        got = {r["doc_id"]: (r["n_repeats"], r["repeated_bytes"], r["dropped_bytes"]) for r in substring_dedup.dedup_substrings(d, min_words=10, within=within).collect()}
        want = brute_repeats(texts, 10, within)
        assert got == want and sum(n > 0 for n, _, _ in want.values()) > 30


def test_chunks_resist_insertions():
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400))
    a, b = (set(substring_dedup.chunks_of(t.encode(), 20)[2].tolist()) for t in (text, "new words here " + text[:1000] + "X" + text[1000:]))
    assert len(a & b) > 0.6 * len(a)


def test_repeat_words_by_brute_force():
    rng = random.Random(9)
    for n in (0, 5, 8, 9, 40, 200):
        for size in (2, 5, 50):
            w = [str(rng.randrange(size)) for _ in range(n)]
            seen = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
            covered = {j for i in range(n - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
            assert quality_rules.repeat_words(w) == len(covered)


def synthetic(spark, n=1500):
    rng = random.Random(11)
    rows, y = [], []
    for i in range(n):
        w = words(rng, rng.randrange(30, 200), 2000)
        low, toxic = rng.random() < 0.2, rng.random() < 0.1
        if low:
            w = [x + "###" for x in w] if i % 2 else [x.upper() + "!!" for x in w]
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(("vile", "scum", "rot"))
            w[rng.randrange(len(w))] = rng.choice(("vile", "scum", "rot"))
        rows.append((i, " ".join(w), f"s{i % 7}", "en"))
        y.append((i, int(not low), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(y, "doc_id long, quality int, toxic int"), {i: (q == 1 and not t) for i, q, t in y}


def test_classifier_on_held_out_rows(spark):
    d, y, good = synthetic(spark)
    m = quality_classifier.fit(d, y.where("doc_id % 2 = 0"))
    got = {r["doc_id"]: r["kept"] for r in quality_classifier.score(d, m).collect()}
    held = [i for i in good if i % 2]
    assert sum(got[i] == good[i] for i in held) / len(held) > 0.95
    clean = [i for i in held if good[i]]
    assert sum(got[i] for i in clean) / len(clean) > 0.98


def test_sparse_paths_shrink_towards_their_host(spark):
    rows = [(i, f"h{i % 20}", "a" if i % 50 else "rare", float(i % 20 < 4)) for i in range(2000)]
    d = spark.createDataFrame([(i, h, p, "x" if s else "y") for i, h, p, s in rows], "doc_id long, source string, lang string, text string")
    m = quality_classifier.Model({"x": 0, "y": 1}, np.array([[4.0, -8], [-4.0, -8]]), np.zeros((quality_classifier.DENSE, 2)), np.stack([np.zeros(quality_classifier.DENSE), np.ones(quality_classifier.DENSE)]))
    rates = {(r["host"], r["path"]): r["path_rate"] for r in quality_classifier.score(d, m).collect()}
    assert rates["h0", "a"] > 0.8 and rates["h10", "a"] < 0.1
    assert rates["h0", "rare"] > 0.5 and rates["h10", "rare"] < 0.2


def test_shrunk_rates_equal_plain_python(spark):
    """Rates of hosts and paths, the prior weights and the combined score, worked out again from the documents' own scores."""
    d, y, _ = synthetic(spark)
    d = d.withColumn("source", F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("one"), "doc_id")).when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    d = d.withColumn("lang", F.when(F.col("doc_id") % 13 == 0, None).when(F.col("doc_id") % 5 == 0, "fr").otherwise("en"))
    got = quality_classifier.score(d, quality_classifier.fit(d, y)).collect()

    def strength(groups):  # (n, s, mean)
        n = sum(g[0] for g in groups)
        excess = (sum(w * (s / w - m) ** 2 for w, s, m in groups) - sum(m * (1 - m) for _, _, m in groups)) / n
        return min(1000.0, max(1.0, sum(w * m * (1 - m) for w, _, m in groups) / n / excess - 1)) if excess > 0 else 1000.0

    hosts, paths = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for r in got:
        for k, t in ((r["host"], hosts), ((r["host"], r["path"]), paths)):
            t[k][0] += 1
            t[k][1] += r["doc_score"]
    mean = sum(s for _, s in hosts.values()) / len(got)
    over = strength([(n, s, mean) for n, s in hosts.values()])
    host = {h: (s + over * mean) / (n + over) for h, (n, s) in hosts.items()}
    under = strength([(n, s, host[h]) for (h, _), (n, s) in paths.items()])
    logit = lambda p: math.log(max(min(p, 1 - 1e-6), 1e-6) / (1 - max(min(p, 1 - 1e-6), 1e-6)))
    for r in got:
        n, s = paths[r["host"], r["path"]]
        rate = (s + under * host[r["host"]]) / (n + under)
        score = 1 / (1 + math.exp(-(logit(r["doc_score"]) + logit(rate) - logit(mean))))
        assert abs(r["path_rate"] - rate) < 1e-9 and abs(r["score"] - score) < 1e-9 and r["kept"] == (r["score"] <= 0.5)
    assert len(hosts) > 20 and {r["path"] for r in got} == {"", "en", "fr"}


def test_pipeline_against_its_parts(spark, tmp_path):
    """The stages over a small corpus, against brute force on what each was given."""
    import corpus_pipeline as cp
    import sentencepiece

    d, y, good = synthetic(spark, 400)
    extra = spark.range(400, 430).select(F.col("id").alias("doc_id"), F.concat(F.lit("Shared line of all.\n"), F.concat_ws(" ", *[F.concat(F.lit(f"u{k}x"), "id") for k in range(40)])).alias("text"), F.lit("s1").alias("source"), F.lit("en").alias("lang"))
    item = "this is a benchmark passage of some length that nobody should train on at all ever"
    leak = spark.range(430, 432).select(F.col("id").alias("doc_id"), F.concat(F.concat_ws(" ", *[F.concat(F.lit(f"v{k}y"), "id") for k in range(40)]), F.lit(" " + item)).alias("text"), F.lit("s1").alias("source"), F.lit("en").alias("lang"))
    copies = extra.where("doc_id < 403").withColumn("doc_id", F.col("doc_id") + 1000)
    docs = d.union(extra).union(leak).union(copies).withColumn("n_chars", F.length("text").cast("long"))
    at = str(tmp_path)
    docs.write.parquet(f"{at}/documents.parquet")
    y.write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    out = {r["doc_id"]: r for r in cp.run(spark, at).collect()}
    first = {r["doc_id"] for r in cp.quality(spark, docs, at).collect()}
    second = {r["doc_id"]: r["text"] for r in cp.lines(spark, docs.where(F.col("doc_id").isin(list(first))), at).collect()}
    shared = [t for i, t in second.items() if i >= 400]
    assert all("Shared line" not in t for t in shared)
    components, _ = brute_components(second, 5)
    third = {i for i, c in components.items() if i == c}
    fourth = {i for i in third if item not in second[i]}
    assert set(out) == fourth
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert all(list(r["ids"]) == sp.encode(second[i]) and r["n_tokens"] == len(r["ids"]) for i, r in out.items())
    clean = {i for i in good if good[i]}
    assert len(clean & set(out)) >= 0.97 * len(clean)
    assert not {430, 431, 1400, 1401, 1402} & set(out)
    assert math.isclose(len(first & clean), len(clean), rel_tol=0.03)
