"""The process of assurance and publication: every end is reached, models are asked once for each open row, and nothing passes by default."""

import os

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import assurance
from lexiloom.plans import queries_loops as q

SF = "/root/testdata/sf0.001"
ROW = "node_id string, source_text string, candidate string, kind string, previous_repairs int, entities int, trusted boolean"


def answered(status, score=0.9, kind="MEANING_DRIFT", name="errors"):
    issue = f"array(named_struct('type', '{kind}', 'severity', 'ERROR', 'message', 'm'))" if status == "FAIL" else "cast(array() as array<struct<type:string,severity:string,message:string>>)"
    return F.expr(f"named_struct('status', '{status}', 'score', {score}D, '{name}', {issue}, 'failed_checks', cast(array() as array<string>))")


def models(**steps):
    told = {"critic": lambda d: d.withColumn("review", answered("PASS")), "repair": lambda d: d.withColumn("repaired", F.col("source_text")), "style": lambda d: d.withColumn("style", answered("PASS", name="issues")),
            "rewrite": lambda d: d.withColumn("rewritten", F.col("candidate")), "compare": lambda d: d.withColumn("first", F.lit("TIE")).withColumn("second", F.lit("TIE"))}
    return assurance.Models(**(told | steps))


def rows(spark, *cells):
    return spark.createDataFrame([(f"n{i}", s, c, "paragraph", p, 0, t) for i, (s, c, p, t) in enumerate(cells)], ROW)


POLICY = assurance.Policy(language="en")
RISKY = "It must not rain if all of us may come because we should."


def test_every_end_is_reached(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    out = q.publications(spark, SF).groupBy("publication", "status", "style_status", "rewrites", "rewrite_success", "from_cache").count().collect()
    ends = {(r["publication"], r["style_status"], r["rewrites"], r["rewrite_success"]) for r in out}
    assert ends >= {("NEEDS_REVIEW", "NOT_RUN", 0, False), ("APPROVED", "NOT_RUN", 0, False), ("APPROVED", "PASS", 0, False), ("NEEDS_REVIEW", "ERROR", 0, False), ("NEEDS_REVIEW", "FAIL", 0, False), ("NEEDS_REVIEW", "ERROR", 1, False), ("APPROVED", "PASS", 1, True), ("NEEDS_REVIEW", "FAIL", 1, False)}
    meaning = q.assured_meaning(spark, SF).groupBy("status", "repairs", "calls", "from_cache").count().collect()
    assert {(r["status"], r["repairs"], r["calls"]) for r in meaning} >= {("PASS", 0, 1), ("PASS", 1, 2), ("PASS", 2, 3), ("FAIL", 0, 0), ("FAIL", 1, 1), ("ERROR", 0, 1), ("NOT_REQUIRED", 0, 0)}
    assert any(r["from_cache"] for r in meaning)


def test_models_are_asked_once_for_each_open_row(spark):
    """The first candidate passes at once, the second after a repair, the third never; the fourth is not risky."""
    asked, mended = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(step, n):
        def run(batches):
            for b in batches:
                n.add(len(b))
                yield b

        return lambda d: step(d.mapInPandas(run, d.schema))

    good = F.col("candidate").contains("good")
    critic = counted(lambda d: d.withColumn("review", F.when(good, answered("PASS")).otherwise(answered("FAIL"))), asked)
    repair = counted(lambda d: d.withColumn("repaired", F.when(F.col("candidate").contains("second"), F.concat(F.col("source_text"), F.lit(" good"))).otherwise(F.col("candidate"))), mended)
    d = rows(spark, (RISKY, RISKY + " good", 0, False), (RISKY, RISKY + " second", 0, False), (RISKY, RISKY + " third", 0, False), ("Plain.", "Plain.", 0, False))
    got = {r["node_id"]: r for r in assurance.evaluate(d, models(critic=critic, repair=repair), POLICY).collect()}
    assert [(got[f"n{i}"]["status"], got[f"n{i}"]["repairs"], got[f"n{i}"]["calls"]) for i in range(4)] == [("PASS", 0, 1), ("PASS", 1, 2), ("FAIL", 2, 3), ("NOT_REQUIRED", 0, 0)]
    assert (asked.value, mended.value) == (3 + 2 + 1, 2 + 1)
    assert got["n2"]["errors"][0]["type"] == "MEANING_DRIFT" and got["n1"]["candidate"].endswith("good")


def test_missing_answers_and_failed_repairs_close(spark):
    silent = models(critic=lambda d: d.withColumn("review", F.when(F.lit(False), answered("PASS"))))
    d = rows(spark, (RISKY, RISKY, 0, False), (RISKY, None, 0, False), (None, None, 0, False))
    got = {r["node_id"]: (r["status"], r["approved"]) for r in assurance.evaluate(d, silent, POLICY).collect()}
    assert got == {"n0": ("ERROR", False), "n1": ("FAIL", False), "n2": ("FAIL", False)}
    empty = models(critic=lambda d: d.withColumn("review", answered("FAIL")), repair=lambda d: d.withColumn("repaired", F.lit(None).cast("string")))
    r = assurance.evaluate(rows(spark, (RISKY, RISKY, 0, False)), empty, POLICY).first()
    assert (r["status"], r["candidate"], r["repairs"], [e["type"] for e in r["errors"]]) == ("FAIL", "", 1, ["MEANING_DRIFT", "EMPTY_TRANSLATION"])
    assert assurance.evaluate(rows(spark, (RISKY, RISKY, 0, False)).limit(0), silent, POLICY).count() == 0


def test_stale_and_other_signatures_are_no_cache(spark):
    d = rows(spark, (RISKY, RISKY, 0, False), ("Plain.", "Plain.", 0, False))
    told = assurance.signed(d, POLICY)
    cache = told.select("node_id", "signature", F.lit("PASS").alias("status"), F.lit(0.7).alias("score"), F.lit(0.1).alias("risk"), F.lit("LOW").alias("level"), F.array().cast(assurance.ERRORS).alias("errors"), F.lit(False).alias("stale"))
    fails = models(critic=lambda x: x.withColumn("review", answered("ERROR")))
    status = lambda c, p=POLICY, **k: {r["node_id"]: (r["status"], r["from_cache"]) for r in assurance.evaluate(d, fails, p, c, **k).collect()}
    assert status(cache) == {"n0": ("PASS", True), "n1": ("PASS", True)}
    assert status(cache.withColumn("stale", F.lit(True))) == {"n0": ("ERROR", False), "n1": ("NOT_REQUIRED", False)}
    assert status(cache, force=True)["n0"] == ("ERROR", False)
    assert status(cache, assurance.Policy(language="en", repairs=1))["n0"] == ("ERROR", False)  # another policy, another signature


def test_publication_of_names_memory_and_rewrites(spark):
    locked = spark.createDataFrame([("Rome", "Roma")], "source_key string, target string")
    style = lambda d: d.withColumn("style", F.when(F.col("candidate").contains("stiff"), answered("FAIL", 0.7, "COLLOCATION", "issues")).otherwise(answered("PASS", name="issues")))
    rewrite = lambda d: d.withColumn("rewritten", F.replace("candidate", F.lit("stiff"), F.when(F.col("candidate").contains("Roma"), F.lit("lost")).otherwise(F.lit("free"))))
    d = rows(spark, ("In Rome.", "In Rome.", 0, True), ("In Rome.", "In Roma.", 0, True), ("A stiff one.", "A stiff one.", 0, False), ("Fine.", "Fine.", 0, False))
    got = {r["node_id"]: (r["publication"], r["text"], r["rewrites"]) for r in assurance.publish(d, models(style=style, rewrite=rewrite), locked, POLICY).collect()}
    assert got == {"n0": ("NEEDS_REVIEW", "In Rome.", 0), "n1": ("APPROVED", "In Roma.", 0), "n2": ("APPROVED", "A free one.", 1), "n3": ("APPROVED", "Fine.", 0)}
    wins = models(style=style, rewrite=rewrite, compare=lambda x: x.withColumn("first", F.lit("A")).withColumn("second", F.lit("B")))
    assert {r["node_id"]: r["publication"] for r in assurance.publish(d, wins, locked, POLICY).collect()}["n2"] == "NEEDS_REVIEW"
    none = assurance.Policy(language="en", rewrites=0)
    assert {r["node_id"]: (r["publication"], r["rewrites"]) for r in assurance.publish(d, models(style=style), locked, none).collect()}["n2"] == ("NEEDS_REVIEW", 0)
    off = assurance.Policy(language="en", style=False)
    assert {r["node_id"]: r["publication"] for r in assurance.publish(d, models(style=style), locked, off).collect()}["n2"] == "APPROVED"


def test_evaluation_hands_on_columns(spark):
    """What publication needs of a row comes with its evaluation; the texts are not joined again."""
    r = rows(spark, ("A house.", "Một ngôi nhà.", 1, False), (RISKY, "b", 2, False), ("A house.", "", 0, False))
    out = assurance.evaluate(r, models(), POLICY, keep=("source_text", "previous_repairs"))
    assert out.columns == [*assurance.RESULT, "source_text", "previous_repairs"]
    assert sorted(tuple(x) for x in out.select("node_id", "source_text", "previous_repairs").collect()) == [("n0", "A house.", 1), ("n1", RISKY, 2), ("n2", "A house.", 0)]
