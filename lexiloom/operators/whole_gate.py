"""The whole gate: what a pair shows by itself, and what it shows beside its project's names, headings, couples and earlier renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as tx
from lexiloom.operators import address, gate, terms

#: The columns of an issue.
ISSUE = ("project_id", "node_id", "issue_type", "severity", "message")


def _issues(found: DataFrame, kind: str, message: Column) -> DataFrame:
    return found.select("project_id", "node_id", F.lit(kind).alias("issue_type"), F.lit(gate.ERROR).alias("severity"), message.alias("message"))


def all_issues(pairs: DataFrame, locked: DataFrame | None = None, couples: DataFrame | None = None, earlier: DataFrame | None = None, language: str = "vi", codes: tuple[str, ...] = gate.CODES) -> DataFrame:
    """ISSUE rows of pairs (project_id, node_id, node_type, source_text, target_text); node_id is unique.

    Row by row the checks of `codes` (gate.issues); ENTITY_MISMATCH for each locked name (project_id, source_key, target) of the
    node's project that the source holds and the rendering does not; HEADING_DUPLICATE once for a heading rendered like, or
    within, another of its project; ADDRESS_TERM_MISMATCH for speech that breaks its couple's forms (couples as in
    address.mismatches); CONTEXT_LEAK for each sentence that repeats one of `earlier` (id, text). Checks without their table
    are left out. Every part is an equi-join of its own, united at the end; a null or empty rendering has EMPTY_TRANSLATION and
    no issue of the other tables but ENTITY_MISMATCH.
    """
    p = pairs.withColumn("node_id", F.col("node_id").cast("string"))
    out = gate.issues(p, language, codes=codes).select(*ISSUE)
    own = p.select("node_id", "project_id")
    shown = p.where(F.trim(F.coalesce("target_text", F.lit(""))) != "")
    if locked is not None:
        names = locked.select(F.col("project_id").alias("_of"), "source_key", "target")
        hits = terms.term_hits(p.select("project_id", "node_id", "source_text", F.coalesce("target_text", F.lit("")).alias("_t")), names, "source_text", "source_key")
        lost = hits.where((F.col("project_id") == F.col("_of")) & ~tx.has_term(F.col("_t"), F.col("target")))
        out = out.unionByName(_issues(lost, "ENTITY_MISMATCH", F.concat(F.col("source_key"), F.lit(" is to be "), F.col("target"))))
    headings = shown.where(F.lower("node_type").startswith("heading")).select("project_id", "node_id", "source_text", "target_text")
    twice = terms.duplicated_headings(headings).groupBy("node_id").agg(F.min("other_id").alias("other_id")).join(own, "node_id")
    out = out.unionByName(_issues(twice, "HEADING_DUPLICATE", F.concat(F.lit("like "), F.col("other_id"))))
    if couples is not None:
        broken = address.mismatches(shown.select("node_id", "project_id", "source_text", "target_text"), couples).join(own, "node_id")
        out = out.unionByName(_issues(broken, "ADDRESS_TERM_MISMATCH", F.col("reason")))
    if earlier is not None:
        leaks = gate.context_leaks(shown.select("node_id", F.col("target_text").alias("text")), earlier).join(own, "node_id")
        out = out.unionByName(_issues(leaks, "CONTEXT_LEAK", F.concat(F.lit("from "), F.col("leaked_from").cast("string"))))
    return out


def passed(pairs: DataFrame, issues: DataFrame) -> DataFrame:
    """(node_id, passed, errors): whether a pair has no ERROR among its issues."""
    bad = issues.where(F.col("severity") == gate.ERROR).groupBy("node_id").agg(F.count("*").alias("errors"))
    return pairs.select(F.col("node_id").cast("string").alias("node_id")).join(bad, "node_id", "left").select("node_id", F.col("errors").isNull().alias("passed"), F.coalesce("errors", F.lit(0)).alias("errors"))
