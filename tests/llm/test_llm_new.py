"""Filter audit, n-gram join and fill-in-middle against plain Python, on edge cases and on hot groups; SQL of the subpackage."""

import hashlib
import itertools
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import fill_in_middle as fim
from lexiloom.llm import filter_audit as fa
from lexiloom.llm import near_dedup, ngram_join

SCHEMA = "doc_id long, text string, lang string, id string, part string, _digest string, _text string, n long"
SF = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", "y", "z", "q", 5) for i, t, g in rows], SCHEMA)


def failures(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, _ in rows:
        text = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        e = i is not None and least[text] < i
        yield {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), e), strict=True) if bad}


def audited(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    fails = list(failures(rows))
    out = {}
    for part in {g or "" for _, _, g in rows}:
        mine = [(i, f) for (i, _, g), f in zip(rows, fails, strict=True) if (g or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                redundant = sum(f in x[1] for x in mine) - len(gone)
                counts = [len(left), len(gone), redundant, sum(x[1] == {f} for x in mine), sum(x[0] in good for x in gone if x[0] is not None), sum(x[0] in toxic for x in gone if x[0] is not None)]
                out[part, order, step] = counts
    for key in out:
        out[key].append(sum(v[1] for (p, o, s), v in out.items() if p == key[0] and o[s - 1] == key[1][key[2] - 1]))
    return out


def audit_rows():
    rng = random.Random(3)
    rows = []
    for i in range(160):
        n = rng.choice([0, 1, 30, 199, 200, 260])
        words = [f"{'W' if rng.random() < 0.3 else 'w'}{rng.randrange(rng.choice([20, 400]))}{rng.choice('#,.') if rng.random() < 0.01 else ''}" for _ in range(n)]
        rows.append((i, " \t\x0b "[rng.randrange(4)].join(words), rng.choice(["en", "de", None, ""])))
    rows += [(200 + i, rows[7 * i][1], "fr") for i in range(15)]
    rows += [(None, rows[3][1], "en"), (None, None, None), (3, rows[3][1], "en"), (3, "other", "en"), (900, None, "en"), (901, "", "en"), (902, "word " * 40_000, "en")]
    return rows + [(1000 + i, "the same #", "en") for i in range(90)]


LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 240, 3)] + [(3, 0, 0), (None, 1, 1), (6, None, None), (900, 1, 1)]


def test_audit_equals_every_order_played_out(spark):
    rows = audit_rows()
    random.Random(1).shuffle(rows)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = fa.filter_audit(table(spark, rows), labels).collect()
    want = audited(rows, LABELS)
    assert len(got) == len(want) == 600 * len({g or "" for _, _, g in rows})
    for r in got:
        assert [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] == want[r["part"], r["filter_order"], r["step"]]


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert fa.filter_audit(table(spark, []), labels).count() == 0
    one = fa.filter_audit(table(spark, [(1, "x", "en")]), labels.limit(0)).where("step = 1 and filter_order = 'EABCD'").first()
    assert (one["kept"], one["removed"], one["unique_fails"], one["shapley"]) == (1, 0, 0, 0)


def filled(i, text, seed=7, rate=100, spm=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= rate:
        return n, "plain", None, None, t
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts_to_fill():
    rng = random.Random(9)
    some = ["", None, "\n", "\n\n", "a", "a\n", "no end\nhere", "<S> marked\nx", "<", "x<\nS>\ny<P", "日本\n😀é\n\r\nlast", "line\n" * 30_000, "w" * 300_000, " \n\t\n"]
    some += ["".join(rng.choice("ab\n<PSM>é😀") for _ in range(rng.randrange(80))) for _ in range(120)]
    return some


@pytest.mark.parametrize("copies", [1000, 7])
def test_fill_in_middle_equals_plain_python(spark, monkeypatch, copies):
    """With few copies a group, texts of many copies are merged before the shuffle and dealt into parts."""
    monkeypatch.setattr(fim, "COPIES", copies)
    some = texts_to_fill()
    rows = list(enumerate(some)) + [(None, "a\nb\nc"), (None, None), (5, "twice\nthe id\n"), (5, "twice\nthe id\n"), (5, "x\ny")]
    rows += [(500 + i, "one of\nmany copies\nof a text") for i in range(60)] + [(600 + i, None if i % 2 else "") for i in range(20)]
    rows += [(None, "without\nids\n")] * 25
    random.Random(4).shuffle(rows)
    for seed, rate, spm in ((7, 100, 50), (8, 60, 20)):
        out = fim.fill_in_middle(table(spark, [(i, t, "en") for i, t in rows]), seed=seed, rate=rate, spm_rate=spm)
        got = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
        want = sorted((i or -1, *map(str, filled(i, t, seed, rate, spm)), t or "") for i, t in rows)
        assert sorted((r["doc_id"] or -1, *(str(r[c]) for c in ("n", "form", "prefix_chars", "middle_chars", "output")), r["back"]) for r in got) == want
        assert all(hashlib.sha256(r["back"].encode()).hexdigest() == r["text_sha256"] for r in got)
    assert fim.fill_in_middle(table(spark, [])).count() == 0


def test_elias_fano_selects():
    rng = np.random.default_rng(2)
    for n, gap in ((1, 1), (1, 5000), (7, 1), (300, 3), (300, 900), (1000, 40)):
        ends = np.cumsum(rng.integers(1, gap + 1, n))
        code = fim.ef_encode(ends)
        assert [fim.ef_select(code, i) for i in range(n)] == ends.tolist()
        assert 8 * (len(code) - 8) <= n * (max(0, (int(ends[-1]) // n).bit_length() - 1) + 3) + 16
    assert int.from_bytes(fim.ef_encode(np.zeros(0, np.int64))[:4], "little") == 0


def brute_links(texts, w, percent):
    """component of every id, and the set sizes."""
    sets = {}
    for i, t in texts.items():
        ws = (t or "").encode().lower().split()
        sets[i] = {tuple(ws[k : k + w]) for k in range(len(ws) - w + 1)} if len(ws) >= w else ({tuple(ws)} if ws else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def edited(rng, base, times, k):
    out = []
    for _ in range(times):
        v = list(base)
        for _ in range(rng.randrange(k + 1)):
            at = rng.randrange(len(v))
            v[at : at + rng.randrange(2)] = [f"z{rng.randrange(10**6)}"] * rng.randrange(2)
        out.append(v)
    return out


@pytest.mark.parametrize("sizes", [(48, 256, 512, 64), (4, 5, 8, 3)])
def test_ngram_join_finds_every_link(spark, monkeypatch, sizes):
    """Sets of all sizes about the boundary and far above it; the second time lists are long, blocks small and most shingles frequent."""
    for name, v in zip(("SMALL", "BLOCK", "WIDE_BLOCK"), sizes, strict=False):
        monkeypatch.setattr(near_dedup, name, v)
    monkeypatch.setattr(ngram_join, "LONG_LIST", sizes[3])
    rng = random.Random(6)
    rows = []
    for n in (*range(1, 34), 40, 60, 61, 90, 150, 400):
        rows += edited(rng, [f"w{rng.randrange(500)}" for _ in range(n)], 6, 1 + n // 40)
    rows += edited(rng, [f"w{rng.randrange(500)}" for _ in range(80)], 70, 6)
    rows += edited(rng, [f"w{rng.randrange(500)}" for _ in range(21)], 50, 2)
    rows += [["a", "common", "line", "of", "many"] * rng.randrange(1, 3) + [f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 8))] for _ in range(60)]
    rows += [rows[3]] * 20 + [[], ["one"], ["ONE"], ["two", "words"]]
    rng.shuffle(rows)
    texts = {i: " ".join(r) for i, r in enumerate(rows)} | {9000: None, 9001: " \t\n"}
    want, sizes_ = brute_links(texts, 3, 90)
    d = table(spark, [(i, t, "en") for i, t in texts.items()])
    got = ngram_join.ngram_join(d).collect()
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes_
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert 20 < len(set(want.values())) < len(want) - 100


def test_ngram_join_of_odd_rows(spark):
    rows = [(None, "a b c d", "en"), (None, None, "en"), (4, "a b c d", "en"), (4, "p q r s t", "en"), (4, "a b c d", "en"), (7, "P q R s t", "en"), (9, "", "en"), (10, "long words of a text " * 30_000, "en")]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in ngram_join.ngram_join(table(spark, rows)).collect())
    assert got == [(0, 0, 0, True), (0, 2, 0, True), (4, 2, 4, True), (4, 2, 4, True), (4, 3, 4, True), (7, 3, 4, False), (9, 0, 9, True), (10, 5, 10, True)]
    assert ngram_join.ngram_join(table(spark, [])).count() == 0


def test_subsets_and_bounds():
    assert [ngram_join.overlap(n, n, 90) for n in (1, 10, 18, 19, 20)] == [1, 10, 18, 18, 19]
    rng = np.random.default_rng(1)
    for n in range(1, 31):
        s = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        keys = ngram_join.subset_keys(s, 33, 90)
        assert len(keys) == ngram_join.count_subsets(n, 33, 90) == len(set(keys))
        for gone in range(n // 10 + 1):
            other = np.sort(np.concatenate([s[gone:], np.arange(gone // 2, dtype=np.uint64)]))
            both = n - gone
            if 100 * both >= 90 * (n + len(other) - both):
                assert set(keys) & set(ngram_join.subset_keys(other, 33, 90))
    for n in (5, 70, 300, 3000):
        s = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        t = np.unique(np.concatenate([s[n // 20 :], rng.integers(0, 1 << 63, n // 30, np.uint64)]))
        assert ngram_join._possible(ngram_join.parity(s), ngram_join.parity(t), len(s), len(t), 90)
    a, b = (np.unique(rng.integers(0, 1 << 63, 500, np.uint64)) for _ in "ab")
    assert not ngram_join._possible(ngram_join.parity(a), ngram_join.parity(b), len(a), len(b), 90)
    # cheap subsets are taken, dear ones are not
    assert ngram_join.boundary({5: 10, 19: 10, 30: 10}, {5: 20, 19: 1000, 30: 400}, 90) == 19
    assert ngram_join.boundary({5: 10}, {5: 1}, 90) == 0


def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    pytest.importorskip("public_tokenizers")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    from lexiloom.llm import queries
    from lexiloom.session import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, SF), con.execute(sql)
        names = sorted(c[0] for c in want.description)
        rows = want.df()[names].astype(object)
        rows = sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in rows.itertuples(index=False))
        mine = sorted(tuple("" if v is None else str(v) for v in r) for r in got.select(*names).collect())
        assert sorted(got.columns) == names and len(mine) == len(rows), name
        assert [[float(v) if re.fullmatch(r"-?\d+(\.\d+)?", v) else v for v in r] for r in mine] == [[float(v) if re.fullmatch(r"-?\d+(\.\d+)?", v) else v for v in r] for r in rows], name
