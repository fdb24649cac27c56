"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import BLANKS, ascii_lower, let, salted_join


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def _hashes(key: Column) -> list[Column]:
    """128 bits, so that counts of unlike lines do not merge even over 10^12 lines."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop every line whose key has min_chars code points or more and occurs in min_docs documents or more.

    Returns (id, text, n_lines, n_dropped, *carry), one row per input row; carry names further columns to pass through,
    all others are left out, so names cannot clash.
    Nulls: a null text is one empty line; null ids are kept and count as one document together. A document is an id: rows
    that repeat it count once for a line that several of them hold. Rows alike in id and text get alike results. An empty
    table gives an empty result. Lines without a key (blank ones) always stay.

    Only ids and 128-bit keys are shuffled to be counted, dealt by both, so a line of every document is spread; then counts
    meet by key with map-side sums. The hot keys come back by a salted join, and text moves once, hash-joined with the lists
    of dropped positions.
    """
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(F.lit(0).alias("_"), *carry).alias("_carry"))
    d = d.withColumn("_th", F.xxhash64("_text"))
    lines = F.split(F.coalesce("_text", F.lit("")), "\n", -1)
    keyed = (
        d.select("_id", "_th", F.posexplode(F.transform(lines, line_key)).alias("_pos", "_key"))
        .where(F.char_length("_key") >= min_chars)
        .select("_id", "_th", "_pos", *_hashes(F.col("_key")))
    )
    per_doc = d.select("_id", F.explode(F.array_distinct(F.transform(lines, line_key))).alias("_key")).where(F.char_length("_key") >= min_chars)
    hot = per_doc.select("_id", *_hashes(F.col("_key"))).distinct().groupBy("h1", "h2").agg(F.count("*").alias("_docs")).where(F.col("_docs") >= min_docs).select("h1", "h2")
    dropped = (
        salted_join(keyed, hot, ["h1", "h2"], [F.col("_id"), F.col("_th"), F.col("_pos")], "inner")
        .groupBy("_id", "_th")
        .agg(F.collect_set("_pos").alias("_drop"))
    )
    kept = let(lines, lambda all_: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("_drop")), lambda p: F.get(all_, p)), "\n"))
    joined = d.alias("d").join(dropped.hint("shuffle_hash").alias("r"), F.col("d._id").eqNullSafe(F.col("r._id")) & F.col("d._th").eqNullSafe(F.col("r._th")), "left")
    return joined.select(
        F.col("d._id").alias(id_col),
        F.when(F.col("_drop").isNull(), F.coalesce("_text", F.lit(""))).otherwise(kept).alias(text_col),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
        *(F.col("_carry")[c].alias(c) for c in carry),
    )
