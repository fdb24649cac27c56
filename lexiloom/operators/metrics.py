"""Evaluation metrics: summaries, preferences, classification figures, regression gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORES = ("semantic_accuracy", "naturalness", "terminology", "contextual_coherence", "register")


def rate(when: Column) -> Column:
    return F.coalesce(F.round(F.count_if(when) / F.nullif(F.count("*"), F.lit(0)), 4), F.lit(0.0))


def summarize(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of scores within 1 to 5, rates, sums and medians of evaluation rows; with `by`, a row a group and one for all (group null)."""
    valid = [F.round(F.avg(F.when(F.col(c).between(1, 5), F.col(c))), 4).alias(f"{c}_mean") for c in SCORES]
    aggs = [
        F.count("*").alias("samples"), *valid,
        rate(F.col("naturalness") >= 4).alias("naturalness_pass_rate"), rate(F.col("rewrite_applied")).alias("rewrite_rate"),
        rate(F.col("semantic_critical_error")).alias("semantic_critical_error_rate"), rate(F.col("hard_glossary_error")).alias("hard_glossary_error_rate"),
        rate(F.col("deterministic_error")).alias("deterministic_error_rate"),
        F.coalesce(F.sum("provider_calls"), F.lit(0)).cast("long").alias("provider_calls"), F.round(F.median("provider_calls"), 3).alias("median_provider_calls"), F.coalesce(F.sum("request_tokens"), F.lit(0)).cast("long").alias("request_tokens_total"),
        F.round(F.median("latency_ms"), 3).alias("median_latency_ms"),
        F.round(F.sum(F.when(F.col("lint_warnings").isNotNull(), F.col("lint_warnings"))) * 1000 / F.nullif(F.sum(F.when(F.col("lint_warnings").isNotNull(), F.col("word_count"))), F.lit(0)), 3).alias("lint_warnings_per_1000_words"),
    ]
    return rows.rollup(*by).agg(*aggs) if by else rows.agg(*aggs)


def preferences(rows: DataFrame) -> DataFrame:
    """Rates of A/B judgements; DRAW is TIE, other words are not judgements, rows without a candidate side count in the denominator alone."""
    p = F.upper(F.trim("preference"))
    p = F.when(p == "DRAW", "TIE").otherwise(p)
    side = F.upper(F.trim(F.coalesce("candidate_side", F.lit(""))))
    v = rows.select(p.alias("p"), side.alias("s")).where(F.col("p").isin("A", "B", "TIE"))
    known = F.col("s").isin("A", "B")
    return v.agg(
        F.count("*").alias("rated_samples"), rate(known & (F.col("p") == F.col("s"))).alias("candidate_preference_rate"), rate(F.col("p") == "TIE").alias("tie_rate"),
        rate(known & F.col("p").isin("A", "B") & (F.col("p") != F.col("s"))).alias("baseline_preference_rate"),
    )


def classification(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts, precision, recall and false-positive rate of boolean columns predicted and actual."""
    p, a = F.col("predicted"), F.col("actual")
    c = rows.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))

    def ratio(x: Column, d: Column) -> Column:
        return F.coalesce(F.round(x / F.nullif(d, F.lit(0)), 4), F.lit(0.0))

    return c.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_positive_rate"))


def regression(baseline: DataFrame, candidate: DataFrame, key: str, naturalness: float = 0.02, lint: float = 1.0, most_calls: float | None = None) -> DataFrame:
    """(key, failed_checks, passed) of two summaries joined on key: no more critical or glossary errors, naturalness at most 2 points down, median provider calls within most_calls, lint at most 1 up; without a limit or figures the last two pass."""
    b, c = baseline.alias("b"), candidate.alias("c")
    lints = F.coalesce(F.col("c.lint_warnings_per_1000_words") <= F.col("b.lint_warnings_per_1000_words") + lint, F.lit(True))
    checks = {
        "semantic": F.col("c.semantic_critical_error_rate") <= F.col("b.semantic_critical_error_rate"),
        "naturalness": F.col("c.naturalness_pass_rate") >= F.col("b.naturalness_pass_rate") - naturalness,
        "glossary": F.col("c.hard_glossary_error_rate") <= F.col("b.hard_glossary_error_rate"),
        "provider_calls": F.coalesce(F.col("c.median_provider_calls") <= F.lit(most_calls).cast("double"), F.lit(True)),
        "lint": lints,
    }
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(k)) for k, ok in checks.items()]))
    return b.join(c, F.col(f"b.{key}").eqNullSafe(F.col(f"c.{key}"))).select(F.col(f"b.{key}").alias(key), F.array_join(failed, ",").alias("failed_checks"), (F.size(failed) == 0).alias("passed"))
