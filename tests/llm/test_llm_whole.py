"""Operators against the libraries' default settings."""

import zlib

import numpy as np
import pytest

from lexiloom.llm import token_store

P = pytest.importorskip("public_tokenizers")


def test_token_store_matches_added_tokens(spark):
    from tokenizers import Tokenizer

    model = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(model)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\ny z", "no <|endoftext| > here", "plain words, only"]
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    path = token_store.new_path(spark)
    token_store.write_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, model, P.PATTERN)
    at = 0
    for r in token_store.index_shards(spark, path).orderBy("start").collect():
        ids = [*t.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_encoder_equals_the_library_on_odd_characters():
    """Letters, digits, marks and blanks of many blocks, those that versions of Unicode class differently among them."""
    import random

    model = P.path("byte_bpe_50k.json")
    e = token_store.WordEncoder(model, P.PATTERN)
    rng = random.Random(8)
    odd = [0x88F, 0x558, 0xC5C, 0x10940, 0x16EA0, 0x1E6C0, 0x323B0, 0x209D, 0xA7CE, 0x2028, 0x85, 0xA0, 0x3000, 0x301, 0x200D, 0x1F600, 0x661, 0xB2, 0x4E2D, 0xAC00, 0x1D7D8]
    points = odd * 40 + [rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x3000, 0xD800), rng.randrange(0xE000, 0x110000)]) for _ in range(3000)]
    for _ in range(4000):
        text = "".join(rng.choice([chr(rng.choice(points)), rng.choice(" 'sl1a.\n\t"), rng.choice(["'s", "'ll", "  ", " x"])]) for _ in range(rng.randrange(1, 14)))
        assert e.encode(text) == np.array(e.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), [hex(ord(c)) for c in text]


def test_classifier_on_held_out_labels(spark):
    """Fitted on half of the labels, held against the other half."""
    import os

    from pyspark.sql import functions as F

    from lexiloom.llm import quality_classifier

    at = "/root/testdata/sf0.1"
    if not os.path.isdir(at):
        pytest.skip("no tables here")
    d, y = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    m = quality_classifier.fit(d, y.where("doc_id % 2 = 0"))
    held = quality_classifier.score(d, m).join(y.where("doc_id % 2 = 1"), "doc_id")
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    r = held.agg(*[F.avg(F.when(w, (F.col("kept") == k).cast("int"))).alias(n) for n, w, k in (("low", low, False), ("toxic", toxic & ~low, False), ("good", ~low & ~toxic, True))]).first()
    assert r["low"] >= 0.98 and r["toxic"] >= 0.9 and r["good"] >= 0.99


def test_pipeline_judges_rows_and_decodes(spark, monkeypatch):
    import corpus_pipeline as cp

    rows = [(None, "good text", "s", "en", 9), (None, "bad text", "s", "en", 8), (1, "good text", "s", "en", 9), (1, "bad text", "s", "en", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    monkeypatch.setattr(cp, "table", lambda *a: None)
    monkeypatch.setattr(cp.quality_classifier, "fit", lambda *a: None)
    monkeypatch.setattr(cp.quality_classifier, "score", lambda d, m, id_col="doc_id": d.select(id_col, (~d["text"].contains("bad")).alias("kept")))
    kept = cp.quality(spark, docs, "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "good text"), (1, "good text")]
    assert [r["round_trip"] for r in cp.pieces(spark, kept, "").collect()] == [True, True]


ODD = "doc_id long, text string, source string, lang string, n_chars long, _row string, _gone int, _text string"


def write_tables(spark, at, rows, labels=(), items=()):
    spark.createDataFrame(rows, ODD).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")


def test_pipeline_edges(spark, tmp_path):
    """Null and repeated ids, null and empty texts, clashing column names, no labels, no benchmark; then empty tables."""
    import corpus_pipeline as cp

    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long, None, None, None, "r", 1, "t"), (None, None, "s", "en", 0, None, None, None), (1, long, "s", "en", 9, "r", 2, "t"), (1, "", "s", "en", 0, "r", 3, "t"), (2, long, "s", "en", 9, "r", 4, "t"), (3, "x\ny", "s", "en", 3, "r", 5, "t")]
    write_tables(spark, tmp_path / "a", rows)
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    at = f"{tmp_path}/a"
    for name, f in cp.STAGES[:-1]:
        assert f(spark, docs, at).columns == docs.columns, name
    out = cp.run(spark, at).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in out) == [-1, -1, 1, 1, 3]  # 2 repeats 1; rows without an id stay
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out)
    write_tables(spark, tmp_path / "b", [])
    assert cp.run(spark, f"{tmp_path}/b").count() == 0


def test_near_dedup_stage_recall_on_edited_copies(spark):
    """Five words at 0.8: every copy at that similarity goes; those with an edit in some 45 words or fewer lie under it and stay."""
    import random

    import corpus_pipeline as cp

    rng = random.Random(12)
    rows, close = [], {}
    for g in range(60):
        base = [f"v{rng.randrange(5000)}" for _ in range(180)]
        rows.append((g * 10, base))
        for c in range(1, 4):
            v = list(base)
            for _ in range(2 * c):
                v[rng.randrange(len(v))] = f"e{rng.randrange(10**6)}"
            a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (base, v))
            close[g * 10 + c] = 100 * len(a & b) >= 80 * len(a | b)
            rows.append((g * 10 + c, v))
    d = spark.createDataFrame([(i, " ".join(w), "s", "en", 1) for i, w in rows], "doc_id long, text string, source string, lang string, n_chars long")
    kept = {r["doc_id"] for r in cp.near_duplicates(spark, d, "").collect()}
    assert {g * 10 for g in range(60)} <= kept
    gone = [i for i, near in close.items() if near]
    assert len(gone) > 60 and not kept & set(gone)
    assert sum(i not in kept for i in close) / len(close) < 0.95  # what is edited more is not this stage's
