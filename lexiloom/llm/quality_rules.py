"""Quality rules: per-document rules, then host verdicts from failure rates shrunk towards an empirical beta prior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import BLANKS, salted_join, slices, stage

SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list, window: int = WINDOW) -> int:
    """Words inside windows of `window` words (a power of two) that occur twice or more, the first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    span = 1
    while span < window:  # windows of 2, 4, 8 words get dense ranks from pairs of shorter ones, so equality is exact
        values, rank = np.unique(rank[:-span] * (int(rank.max()) + 1) + rank[span:], return_inverse=True)
        if len(values) == len(rank):
            return 0
        span *= 2
    twice = np.flatnonzero(np.bincount(rank)[rank] > 1)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, twice, 1)
    np.add.at(steps, twice + window, -1)
    return int((np.cumsum(steps)[:n] > 0).sum())


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """COUNTS of one whole text; all 0 where it is null."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def rule_counts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(_id, _host, COUNTS): one narrow Arrow pass over whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            found = np.array([counts(x) for x in b.column(2).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(found[:, i]) for i in range(len(COUNTS)))], ["_id", "_host", *COUNTS])

    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host"), F.col(text_col).alias("_text"))
    return d.mapInArrow(count, f"_id {dict(d.dtypes)['_id']}, _host string, " + ", ".join(f"{c} long" for c in COUNTS))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) by the method of moments over hosts (columns n, k), each weighted by its documents; strength within 1 to 1000.

    One row of sums comes to the driver. With no documents the prior is (0.5, 0.5).
    """
    r = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"), F.count("*").alias("hosts")).first()
    if not r["n"]:
        return 0.5, 0.5
    mean = r["k"] / r["n"]
    spread = mean * (1 - mean)
    between = (r["kk"] / r["n"] - mean * mean) - spread * r["hosts"] / r["n"]  # less what sampling alone gives
    strength = min(1000.0, max(1.0, spread / between - 1)) if between > 0 else 1000.0
    return mean * strength, (1 - mean) * strength


def apply_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    max_host_rate: float = 0.5,
) -> DataFrame:
    """(id, COUNTS, base_failed, host, host_rate, kept), one row per input row.

    base_failed: fewer than min_words words, or more than max_repeat_percent % of them in repeated windows. host_rate:
    the host's failure rate shrunk to the beta prior, null unless it is over max_host_rate; such hosts lose every
    document. Null texts have no words; a null host counts as the host ''; ids may be null or repeated, each row counts.
    Other columns are left out. An empty table gives an empty result.

    Texts are read once; the counts are staged (no text), summed by host with map-side sums, and only the hosts over the
    limit are joined back, salted, since one host may hold a third of all rows.
    """
    found = stage(
        rule_counts(docs, id_col, text_col, host_col).withColumn(
            "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
        ),
        "rule-counts",
    )
    hosts = found.groupBy("_host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("k"))
    alpha, beta = beta_prior(hosts)
    rate = (F.col("k") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
    rejected = hosts.select("_host", rate.alias("host_rate")).where(F.col("host_rate") > max_host_rate)
    out = salted_join(found, rejected, ["_host"], [F.col("_id"), F.col("n_words"), F.col("word_chars")])
    return out.select(
        F.col("_id").alias(id_col), *COUNTS, "base_failed", F.col("_host").alias("host"), "host_rate", (~F.col("base_failed") & F.col("host_rate").isNull()).alias("kept")
    )
