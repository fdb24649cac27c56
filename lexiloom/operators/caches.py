"""Content-addressed reuse: keys by hash, lookups, and what is left to compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_hash", "style_hash", "glossary_hash", "prompt_version"]


def content_hash(c: Column) -> Column:
    return F.sha2(F.trim(F.coalesce(c, F.lit(""))), 256)


def signature(*parts: Column) -> Column:
    """A hash that tells apart any two lists of values: each part's length goes before it, null differs from empty."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]), 256)


def lookup(nodes: DataFrame, memory: DataFrame) -> DataFrame:
    """nodes with cached_text and cache_hit: the newest memory row (created_at) of the same four-part key; an empty part never matches."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("created_at"), "cached_text")
    m = memory.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).select(*KEY, "cached_text")
    whole = F.lit(True)
    for k in KEY:
        whole = whole & (F.coalesce(k, F.lit("")) != "")
    m = m.where(whole)
    return nodes.join(m, KEY, "left").withColumn("cache_hit", F.col("cached_text").isNotNull())


def stale(nodes: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the cache lacks: all that has to be computed again."""
    return nodes.join(cache.select(*key).distinct(), key, "left_anti")
