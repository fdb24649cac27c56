"""Filter interaction audit: every order of five filters from one histogram of failure masks.

A document's failures are five bits. What any order of the filters keeps, removes and overlooks depends only on how many
documents have each of the 32 masks, so the corpus is read once, and all 120 orders are read off 32 cells a part.
"""

from __future__ import annotations

import functools
import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import let, stage

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = tuple("".join(p) for p in itertools.permutations(FILTERS))
#: What is counted of a cell's documents.
_COUNTS = ("n", "good", "toxic")


def text_mask(text: Column) -> Column:
    """The bits of the filters A to D that a text fails; they depend on nothing but the text."""
    words = let(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (
        words["all"] < 200,
        words["distinct"] * 100 < words["all"] * 50,
        capitals.cast("long") * 100 > F.length(text).cast("long") * 3,
        functools.reduce(Column.__or__, (text.contains(c) for c in "#$%&*|")),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of the part fail exactly the mask's filters, and how many of those are labelled.

    Texts are told apart by SHA-256, so only digests are shuffled, and each text is read once. Rows alike in id, text and part
    are counted together before anything else, the least id of a text is a map-side minimum, and rows meet it by (text, id), so
    that a text, or an id, that a third of all rows have is nowhere gathered.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"))
    rows = stage(rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n")), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).where(F.col("id").isNotNull()).withColumn("first", F.lit(True))
    later = F.col("id").isNotNull() & F.col("first").isNull()
    masked = rows.join(first, ["digest", "id"], "left").select("id", "part", (F.col("mask") + F.when(later, 1 << 4).otherwise(0)).alias("mask"), "n")
    masked = masked.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    known = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("id is not null and (good or toxic)")
    known = known.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    labelled = masked.join(known, "id", "left")
    return labelled.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("good"), F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("toxic")
    )


def _steps() -> Column:
    """Every order's steps as (filter_order, step, own, before): the step's own bit and the bits of the filters before it."""
    out = []
    for order in ORDERS:
        bits = [1 << FILTERS.index(f) for f in order]
        out += [{"filter_order": order, "step": i + 1, "own": b, "before": sum(bits[:i])} for i, b in enumerate(bits)]
    return F.from_json(F.lit(json.dumps(out)), "array<struct<filter_order string, step int, own int, before int>>")


def audit_orders(cells: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every part, order and step, zeros included.

    The Shapley sum needs no order: a document that fails k filters is removed by each of them in 120 / k orders.
    """
    per = cells.groupBy("part").agg(*(F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in _COUNTS))
    per = per.select("part", *(F.array(*(F.coalesce(F.try_element_at(c, F.lit(m)), F.lit(0).cast("long")) for m in range(CELLS))).alias(c) for c in _COUNTS))
    at = per.select("part", *_COUNTS, F.explode(_steps()).alias("s"))
    own, before = F.col("s.own"), F.col("s.before")

    def total(counts: str, of) -> Column:  # noqa: ANN001
        """The sum of counts over the masks for which `of` holds."""
        there = F.transform(counts, lambda n, m: F.when(of(m), n).otherwise(F.lit(0).cast("long")))
        return F.aggregate(there, F.lit(0).cast("long"), lambda a, n: a + n)

    def fails(m: Column, bits: Column) -> Column:
        return m.bitwiseAND(bits) != 0

    def here(m: Column) -> Column:
        return fails(m, own) & ~fails(m, before)

    shares = F.array(*(F.lit(len(ORDERS) // max(1, m.bit_count())).cast("long") for m in range(CELLS)))
    weighed = F.transform("n", lambda n, m: F.when(fails(m, own), n * F.get(shares, m)).otherwise(F.lit(0).cast("long")))
    return at.select(
        "part", "s.filter_order", "s.step",
        total("n", lambda m: ~fails(m, own) & ~fails(m, before)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m, own) & fails(m, before)).alias("redundant"),
        F.get("n", own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        F.aggregate(weighed, F.lit(0).cast("long"), lambda a, n: a + n).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of docs, a part for each value of part_col; see audit_orders for the columns.

    Filters: A under 200 words; B under half of the words distinct; C over 3 % capitals A-Z; D holds any of #$%&*|; E the
    same text as a row of a smaller id. Nulls: a null text is empty, a null part is the empty string; a row without an id has
    neither a smaller id nor a label, so it never fails E. A row is a document: repeated rows count each, and rows that
    share the least id of their text do not fail E. Labels that repeat an id count where any of them says so. Other columns are left out.
    Without documents there is no part and no row.
    """
    return audit_orders(mask_cells(docs, labels, id_col, text_col, part_col))
