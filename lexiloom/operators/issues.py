"""Issue and record tables: upserts by key, resolution, invalidation, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators import terms as tm

#: Issue types that a deterministic check can settle, and names of theirs that mean another.
DETERMINISTIC = (
    "EMPTY_TRANSLATION", "NUMBER_MISMATCH", "NUMBER_ADDITION", "URL_MISMATCH", "URL_ADDITION", "BROKEN_REFERENCE",
    "REFERENCE_MISMATCH", "REFERENCE_ADDITION", "GLOSSARY_MISMATCH", "WRONG_TARGET_LANGUAGE", "FOREIGN_SCRIPT_CONTAMINATION",
    "CONTAINS_CHINESE", "NEGATION_LOSS",
)
ALIASES = {"BROKEN_REFERENCE": "URL_MISMATCH", "CONTAINS_CHINESE": "FOREIGN_SCRIPT_CONTAMINATION"}
#: Issue types that reviews by meaning may name, other names for them, and those that only warn.
SEMANTIC = (
    "SEMANTIC_OMISSION", "SEMANTIC_ADDITION", "MEANING_DRIFT", "MODALITY_ERROR", "CAUSALITY_ERROR", "SCOPE_ERROR",
    "CONDITION_ERROR", "COMPARISON_ERROR", "ENTITY_REFERENCE_ERROR", "PRONOUN_AMBIGUITY",
)
CONSISTENCY = ("ENTITY_MISMATCH", "ENTITY_VARIANT", "TERM_VARIANT", "ACRONYM_INCONSISTENCY", "REPEATED_PHRASE_INCONSISTENCY")
SYSTEM = ("SEMANTIC_QA_ERROR", "CONTEXT_BUDGET_EXCEEDED", "PROVIDER_ERROR")
SEMANTIC_NAMES = {
    "OMISSION": "SEMANTIC_OMISSION", "MISSING_MEANING": "SEMANTIC_OMISSION", "ADDITION": "SEMANTIC_ADDITION",
    "HALLUCINATION": "SEMANTIC_ADDITION", "SEMANTIC_MISMATCH": "MEANING_DRIFT", "QA_ERROR": "SEMANTIC_QA_ERROR",
    "ENTITY_CONSISTENCY": "ENTITY_VARIANT", "LOCKED_ENTITY_MISMATCH": "ENTITY_MISMATCH",
}
ONLY_WARN = ("PRONOUN_AMBIGUITY", "ENTITY_VARIANT", "TERM_VARIANT", "ACRONYM_INCONSISTENCY", "REPEATED_PHRASE_INCONSISTENCY")


def renamed(code: Column, names: dict[str, str]) -> Column:
    """code by its other name, if it has one."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), code), code)


def plain_code(code: Column) -> Column:
    return F.upper(F.trim(F.coalesce(code, F.lit(""))))


def semantic_type(code: Column) -> Column:
    """A reviewer's name for an issue as one of the known types; MEANING_DRIFT for none and for unknown ones."""
    c = renamed(F.replace(F.upper(F.trim(F.coalesce(F.nullif(code, F.lit("")), F.lit("MEANING_DRIFT")))), F.lit(" "), F.lit("_")), SEMANTIC_NAMES)
    return F.when(c.isin(*SEMANTIC, *CONSISTENCY, *SYSTEM), c).otherwise("MEANING_DRIFT")


def semantic_severity(code: Column) -> Column:
    return F.when(semantic_type(code).isin(*ONLY_WARN), "WARNING").otherwise("ERROR")


def upsert(table: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key: the newest of `new` by `order`, else that of the table. Keys compare null-safely."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n", "_new")


def insert_missing(table: DataFrame, new: DataFrame, key: list[str], among: Column | None = None) -> DataFrame:
    """The table with the rows of new whose key no row (for which `among` holds) has; equal keys of new go in once."""
    have = (table if among is None else table.where(among)).select(*[F.col(k).alias(f"_h_{k}") for k in key]).distinct()
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    return table.unionByName(new.dropDuplicates(key).join(have, same, "left_anti"), allowMissingColumns=True)


def replace_open(table: DataFrame, new: DataFrame) -> DataFrame:
    """A new run of checks: open issues go, the new ones come."""
    return table.where(F.coalesce(F.col("status") != "OPEN", F.lit(True))).unionByName(new.withColumn("status", F.lit("OPEN")), allowMissingColumns=True)


def resolve(issues: DataFrame, remaining: DataFrame, reviews: DataFrame) -> DataFrame:
    """Adds resolution and qa_error to issues (node_id, issue_type).

    Deterministic issues stay OPEN iff their code, or the one it means, is still among remaining (node_id, code). Others are
    RESOLVED iff the node's newest review (node_id, status, is_passed, reviewed_at) has the status PASS and is_passed, else
    OPEN; qa_error says why nothing could be told: MISSING_REVIEW without one, REVIEW_ERROR where it failed itself.
    """
    code = plain_code(F.col("issue_type"))
    left = remaining.select("node_id", renamed(plain_code(F.col("code")), ALIASES).alias("_code")).distinct().withColumn("_still", F.lit(True))
    r = reviews.groupBy("node_id").agg(F.max_by(F.struct("status", "is_passed"), "reviewed_at").alias("_review"))
    joined = issues.withColumn("_code", renamed(code, ALIASES)).join(left, ["node_id", "_code"], "left").join(r, "node_id", "left")
    by_check = F.when(F.col("_still"), "OPEN").otherwise("RESOLVED")
    passed = F.coalesce((F.col("_review.status") == "PASS") & F.col("_review.is_passed"), F.lit(False))
    sure = code.isin(*DETERMINISTIC)
    error = F.when(~sure & F.col("_review").isNull(), "MISSING_REVIEW").when(~sure & (F.col("_review.status") == "ERROR"), "REVIEW_ERROR")
    return joined.withColumns({"resolution": F.when(sure, by_check).when(passed, "RESOLVED").otherwise("OPEN"), "qa_error": error}).drop("_still", "_review", "_code")


def open_nodes(issues: DataFrame) -> DataFrame:
    return issues.where((F.col("status") == "OPEN") & F.col("node_id").isNotNull()).select("node_id").distinct()


def invalidate(reviews: DataFrame, nodes: DataFrame, term: DataFrame) -> DataFrame:
    """Reviews of nodes whose source holds a term of term(source_term) become stale."""
    hit = tm.term_hits(nodes, term, "source_text", "source_term").select("node_id").distinct().withColumn("_hit", F.lit(True))
    return reviews.join(hit, "node_id", "left").withColumn("is_stale", F.coalesce("_hit", F.col("is_stale"), F.lit(False))).drop("_hit")


def review_summary(reviews: DataFrame) -> DataFrame:
    """Per project: the latest review of each node that is not stale, by level and status."""
    w = Window.partitionBy("project_id", "node_id").orderBy(F.desc("created_at"), F.desc("review_id"))
    last = reviews.where(~F.col("is_stale")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1)
    counts = [F.count_if(F.col("risk_level") == x).alias(x.lower()) for x in ("LOW", "MEDIUM", "HIGH")]
    return last.groupBy("project_id").agg(F.count("*").alias("reviewed"), *counts, *[F.count_if(F.col("critic_status") == x).alias(x.lower() + "_count") for x in ("PASS", "FAIL", "ERROR")])


def reconcile(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """Per batch: missing, unknown, duplicate and empty ids of returned(batch_id, node_id, text) against expected(batch_id, node_id); ok if none."""
    r = returned.groupBy("batch_id", "node_id").agg(F.count("*").alias("n"), F.max(F.coalesce(F.trim("text") != "", F.lit(False))).alias("filled")).withColumn("_r", F.lit(1))
    both = expected.select("batch_id", "node_id").distinct().withColumn("_e", F.lit(1)).join(r, ["batch_id", "node_id"], "full_outer")
    per = both.groupBy("batch_id").agg(
        F.count_if(F.col("_r").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("duplicated"), F.count_if(F.col("_r").isNotNull() & ~F.col("filled")).alias("empty")
    )
    return per.withColumn("ok", (F.col("missing") + F.col("unknown") + F.col("duplicated") + F.col("empty")) == 0)
