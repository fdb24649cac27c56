"""What assurance costs: texts move once, wording and locked names are found without searching every text for each of them, and nothing is found less."""

import random

from pyspark.sql import functions as F

from lexiloom import stages
from lexiloom.functions import scores
from lexiloom.functions import text as tx
from lexiloom.operators import assurance, terms
from lexiloom.plans import queries_loops as q

EDGES = ("if", "only  if", "AS A RESULT", "as a", "result", "allé", "éall", "all_", "any2", "no one", "No", "one", "BUT", "noone", "—may—", "Kif", "ſhould", "İf", "if́", "because\nof", "x", "漢all", "(each)", "more", "than", "'only'")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wording_is_what_the_patterns_find(spark):
    rng = random.Random(5)
    phrases = [p for ps, _ in scores.WORDING.values() for p in ps]
    texts = ["", *phrases, *(p.upper() for p in phrases), *EDGES, *("".join(rng.choice((*phrases, *EDGES)) + rng.choice((" ", " ", "", ", ", "é", "-")) for _ in range(rng.randrange(1, 9))) for _ in range(2000))]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    found = scores.wording(F.col("t"))
    both = [(F.col("t").rlike(p), F.arrays_overlap(found, F.array(*map(F.lit, scores.SHORTEST[k])))) for k, (p, _) in scores.SENSITIVE.items()]
    for r in d.select("t", *[c for pair in both for c in pair]).collect():
        assert r[1::2] == r[2::2], r
    assert d.select(scores.wording(F.lit(None).cast("string"))).first()[0] == []


def test_risk_searches_a_text_once(spark):
    d = spark.createDataFrame([("a", "b")], "s string, t string")
    told = plan(d.select(scores.risk_score(F.col("s"), F.col("t"), F.lit("x"), F.lit(0), F.array().cast("array<string>"), F.lit(0)).alias("risk")))
    assert "RLIKE" not in told and told.count("(?i)(?=[") == 1


def test_lost_names_few_and_many(spark, monkeypatch):
    rng = random.Random(3)
    pieces = ("Rome", "rome's", "Romes", "Roma", "New York", "new  york", "New", "York", "NY", "unavec", "avec", "avecs", "aveced", "Été", "été", "x", "l'avec", "une", "É")
    cells = [(f"n{i}", " ".join(rng.choices(pieces, k=rng.randrange(0, 5))), rng.choice((None, "", "Roma", "NY avec", "l'été x", " ".join(rng.choices(pieces, k=3))))) for i in range(800)] + [("n800", None, "Roma")]
    d = spark.createDataFrame(cells, "node_id string, source_text string, candidate string")
    locked = spark.createDataFrame([("Rome", "Roma"), ("New York", "NY"), ("avec", "avec"), ("été", "Été"), ("x", None), ("avec", "x"), ("--", "y")], "source_key string, target string")
    hits = terms.term_hits(d, locked, "source_text", "source_key")
    lost = {r[0] for r in hits.where(~tx.has_term(F.coalesce("candidate", F.lit("")), F.col("target"))).select("node_id").collect()}
    few = assurance.names_lost(d, locked)
    assert "Exchange" not in plan(few)
    got = {r["node_id"]: r["broken"] for r in few.collect()}
    assert len(got) == 801 and {k for k, v in got.items() if v} == lost and 0 < len(lost) < 800
    monkeypatch.setattr(terms, "SEEK", 0)
    assert {r["node_id"]: r["broken"] for r in assurance.names_lost(d, locked).collect()} == got
    monkeypatch.setattr(terms, "FEW", 1)
    assert {r["node_id"]: r["broken"] for r in assurance.names_lost(d, locked).collect()} == got
    assert not assurance.names_lost(d, locked.where("source_key = '--'")).where("broken").head(1)


def test_texts_move_once_and_only_where_they_are_needed(spark, monkeypatch, tmp_path):
    made, real = {}, assurance.staged

    def spied(df, label):
        made.setdefault(label, (plan(df), out := real(df, label)))
        return out

    spark.createDataFrame([(i, f"Line of {('all', 'maybe if')[i % 2]} {i}.\nUne ligne avec all." * 2, "s", "en") for i in range(120)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(assurance, "staged", spied)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = q.assured_meaning(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    told, state = made["assurance"]
    # an exchange of the rows and one of the cache; the cache's rows are read once and its gate is not in a filter, too
    assert told.count("Exchange hashpartitioning") == 2 and told.count("FileScan") == 2
    assert not any("sha2" in line for line in told.splitlines() if "Filter" in line)
    assert state.where("level = 'LOW' and source_text is not null").count() == 0 < state.where("level <> 'LOW' and source_text is not null").count()
    assert made["reviewed"][1].where("end is not null and source_text is not null").count() == 0
    assert "candidate" not in made["repaired"][1].columns
    assert out.count() == out.select("node_id").distinct().count() > 0


def test_publication_holds_no_texts_that_no_step_reads(spark, monkeypatch, tmp_path):
    """What lies in the shared folder while rows are published, and what is left: texts for a pass and the next, then results only."""
    rng = random.Random(9)
    lines = [(i, "\n".join(f"{rng.choice(('all may', 'a stiff e line'))} {rng.randbytes(2000).hex()} if so." for _ in range(12)), "s", "en") for i in range(120)]
    text = sum(len(x[1]) for x in lines)
    spark.createDataFrame(lines, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    held, real = [], assurance.staged
    monkeypatch.setattr(stages, "shared_dir", lambda _: f"{tmp_path}/shared")

    def size():
        return sum(f.stat().st_size for f in (tmp_path / "shared").rglob("*.parquet"))

    def spied(df, label):
        out = real(df, label)
        held.append((label, size()))
        return out

    monkeypatch.setattr(assurance, "staged", spied)
    out = q.publications(spark, str(tmp_path))
    left = size()
    assert out.count() == out.select("node_id").distinct().count() == 120 * 12
    # a hexadecimal text takes half its size packed, or all of it; source and candidate of two passes at most
    assert max(n for _, n in held) < 3 * text and left < text / 10, (text, left, held)


def test_review_held_without_status_is_published(spark):
    """A review that the cache holds without a status does not approve: its row ends as NEEDS_REVIEW instead of nowhere."""
    none = "cast(array() as array<struct<type:string,severity:string,message:string>>)"
    told = {n: F.expr(f"named_struct('status', 'FAIL', 'score', 0.7D, '{n}', {none}, 'failed_checks', cast(array() as array<string>))") for n in ("errors", "issues")}
    models = assurance.Models(
        critic=lambda d: d.withColumn("review", told["errors"]), repair=lambda d: d.withColumn("repaired", F.col("source_text")), style=lambda d: d.withColumn("style", told["issues"]),
        rewrite=lambda d: d.withColumn("rewritten", F.lit("")), compare=lambda d: d.withColumns({"first": F.lit("TIE"), "second": F.lit("TIE")}),
    )
    policy = assurance.Policy(language="en")
    rows = spark.createDataFrame([("n0", "Plain.", "Plain.", "paragraph", 0, 0, False), ("n1", "Fine.", "Fine.", "paragraph", 0, 0, False)], "node_id string, source_text string, candidate string, kind string, previous_repairs int, entities int, trusted boolean")
    cache = assurance.signed(rows.where("node_id = 'n1'"), policy).select("*", F.lit(None).cast("string").alias("status"), F.lit(0.7).alias("score"), F.lit(0.1).alias("risk"), F.lit("LOW").alias("level"), F.array().cast(assurance.ERRORS).alias("errors"), F.lit(False).alias("stale"))
    locked = spark.createDataFrame([("Rome", "Roma")], "source_key string, target string")
    out = assurance.publish(rows, models, locked, policy, cache).collect()
    assert {r["node_id"]: (r["publication"], r["text"], r["rewrites"]) for r in out} == {"n0": ("NEEDS_REVIEW", "Plain.", 1), "n1": ("NEEDS_REVIEW", "Fine.", 0)}
