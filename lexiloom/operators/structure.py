"""Rebuilding structure from page blocks: margins, base size, reading order, chapters, node ids, tables.

Blocks: (doc_id, page_number, block_id, type, text, x0, y0, x1, y1, font_size, is_bold, heading_level), pages: (doc_id,
page_number, width, height). Everything is grouped by doc_id, so documents are rebuilt side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import scores, text as tx

PAGE_NUMBER = r"(?i)^\d{1,4}$|^page\s*\d{1,4}$|^\d{1,4}\s*\|\s*.*$"
LONE_NUMBER = r"(?i)^\d{1,4}$|^page\s*\d{1,4}$"


def margin(y0: Column, y1: Column, height: Column) -> Column:
    """top, bottom (12 % of the height each) or null. Blocks without a box are in no margin."""
    return F.when(y1 < 0.12 * height, "top").when(y0 > 0.88 * height, "bottom")


def repeated_margins(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, text): margin texts that repeat on 15 % of the pages (three at least) within a margin, and page numbers; none for documents of one page."""
    size = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= 2)
    b = blocks.where(F.col("type") == "text").join(pages.select("doc_id", "page_number", "height"), ["doc_id", "page_number"])
    at = b.select("doc_id", F.trim("text").alias("text"), margin(F.col("y0"), F.col("y1"), F.col("height")).alias("zone")).where(F.col("zone").isNotNull() & (F.col("text") != ""))
    per = at.groupBy("doc_id", "zone", "text").agg(F.count("*").alias("n")).join(size, "doc_id")
    often = F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("n_pages") * 0.15))
    return per.where(often | F.col("text").rlike(PAGE_NUMBER)).select("doc_id", "text").distinct()


def without_margins(blocks: DataFrame, pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """Blocks less repeated margin texts and lone page numbers in margins."""
    b = blocks.join(pages.select("doc_id", "page_number", "height"), ["doc_id", "page_number"]).withColumn("_t", F.trim("text"))
    b = b.withColumn("_edge", (F.col("type") == "text") & margin(F.col("y0"), F.col("y1"), F.col("height")).isNotNull())
    marked = b.join(repeated.withColumnRenamed("text", "_t").withColumn("_hit", F.lit(True)), ["doc_id", "_t"], "left")
    drop = F.col("_edge") & (F.coalesce("_hit", F.lit(False)) | F.col("_t").rlike(LONE_NUMBER))
    return marked.where(~F.coalesce(drop, F.lit(False))).drop("_t", "_edge", "_hit", "height")


def base_sizes(blocks: DataFrame, default: float = 11.0) -> DataFrame:
    """(doc_id, base_size): the upper median of the text blocks' sizes, by counts per size (a histogram, not a list of all sizes)."""
    per = blocks.groupBy("doc_id", "font_size").agg(F.count(F.when((F.col("type") == "text") & F.col("font_size").isNotNull(), 1)).alias("n"))
    w = Window.partitionBy("doc_id")
    up = F.sum("n").over(w.orderBy("font_size").rowsBetween(Window.unboundedPreceding, 0))
    hit = per.withColumn("_up", up).withColumn("_all", F.sum("n").over(w)).where((F.col("n") > 0) & (F.col("_up") > F.floor(F.col("_all") / 2)))
    found = hit.groupBy("doc_id").agg(F.min("font_size").alias("base_size"))
    return blocks.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("base_size", F.lit(default)).alias("base_size"))


def reading_order(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds reading_pos (from 0) on each page: with two columns of two blocks or more, wide blocks, then left, then right, each by y; else by (y, x). Ties keep block order."""
    b = blocks.join(pages.select("doc_id", "page_number", "width"), ["doc_id", "page_number"])
    mid = F.col("width") / 2
    column = F.when(F.col("x1") - F.col("x0") > 0.7 * F.col("width"), 0).when(F.col("x1") <= mid + 20, 1).when(F.col("x0") >= mid - 20, 2).otherwise(0)
    page = Window.partitionBy("doc_id", "page_number")
    b = b.withColumn("_c", column).withColumn("_two", (F.count_if(F.col("_c") == 1).over(page) >= 2) & (F.count_if(F.col("_c") == 2).over(page) >= 2))
    order = page.orderBy(F.when(F.col("_two"), F.col("_c")).otherwise(0), "y0", F.when(F.col("_two"), 0.0).otherwise(F.col("x0")), "block_id")
    return b.withColumn("reading_pos", F.row_number().over(order) - 1).drop("_c", "_two", "width")


def classify(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds node_type (heading, footnote, image, paragraph), opens_chapter, level. A heading level that the source gives stands."""
    b = blocks.join(base_sizes(blocks), "doc_id").join(pages.select("doc_id", "page_number", "height"), ["doc_id", "page_number"])
    opens = scores.opens_chapter(F.col("text"), F.col("font_size"), F.col("is_bold"), F.col("base_size")) & (F.col("type") != "image")
    short = tx.word_count(F.col("text")) <= 15
    level = F.coalesce("heading_level", F.when(opens, 1).when(short, scores.heading_level(F.col("font_size"), F.col("is_bold"), F.col("base_size"))))
    foot = scores.is_footnote(F.col("text"), F.col("y0"), F.col("height"), F.col("font_size"), F.col("base_size"))
    kind = F.when(F.col("type") == "image", "image").when(opens | level.isNotNull(), "heading").when(foot, "footnote").otherwise("paragraph")
    return b.withColumn("opens_chapter", opens).withColumn("level", level.cast("int")).withColumn("node_type", kind).drop("height", "base_size")


def chapters(blocks: DataFrame) -> DataFrame:
    """Adds chapter_no, chapter_id, node_no and node_id in document order (page, reading_pos): a chapter heading starts a chapter unless it is the first node."""
    w = Window.partitionBy("doc_id").orderBy("page_number", "reading_pos")
    n = F.row_number().over(w)
    b = blocks.withColumn("node_no", n)
    number = F.sum(F.when(F.col("opens_chapter") & (F.col("node_no") > 1), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1
    b = b.withColumn("chapter_no", number)
    return b.withColumn("chapter_id", F.format_string("chapter_%04d", "chapter_no")).withColumn("node_id", F.format_string("%s_%04d_%05d", "node_type", "page_number", "node_no"))


def rebuild(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks to nodes: margins out, reading order, classes, chapters and ids; texts with line breaks repaired."""
    kept = without_margins(blocks, pages, repeated_margins(blocks, pages))
    out = chapters(classify(reading_order(kept, pages), pages))
    return out.withColumn("content", tx.join_lines(F.col("text")))


def totals(nodes: DataFrame) -> DataFrame:
    """Per document: words, chapters and nodes."""
    return nodes.groupBy("doc_id").agg(F.sum(tx.word_count(F.col("content"))).alias("total_words"), F.count_distinct("chapter_no").alias("chapters"), F.count("*").alias("nodes"))


def rebuilt_totals(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """totals(rebuild(blocks, pages)), without long texts in its shuffles.

    Words are counted in the pass that reads a block. Over 150 characters a text opens no chapter, so all that is asked of it
    is whether it equals another or starts with a page number: its hash, padded to stay as long, stands for it.
    """
    t = F.trim("text")
    hashed = F.rpad(F.concat(F.lit("#"), F.sha2(t, 256)), 151, "#")
    slim = blocks.withColumn("words", tx.word_count(tx.join_lines(F.col("text"))))
    slim = slim.withColumn("text", F.when((F.length(t) > 150) & ~t.rlike(PAGE_NUMBER), hashed).otherwise(F.col("text")))
    return rebuild(slim, pages).groupBy("doc_id").agg(F.sum("words").alias("total_words"), F.count_distinct("chapter_no").alias("chapters"), F.count("*").alias("nodes"))


def table_rows(cells: DataFrame, gap: float = 12.0) -> DataFrame:
    """(table_id, rows, n_columns, confidence): cells (table_id, x, y, text) in rows by a running mean of y, padded to the widest row.

    The mean depends on what the row holds so far, so it is a fold over the table's sorted cells.
    """
    sorted_ = F.array_sort(F.collect_list(F.struct("y", "x", "text")))
    start = F.struct(F.array().cast("array<array<struct<x:double,text:string>>>").alias("rows"), F.lit(None).cast("double").alias("mean"))

    def step(acc: Column, c: Column) -> Column:
        cell = F.array(F.struct(c["x"].cast("double").alias("x"), c["text"].alias("text")))
        fits = acc["mean"].isNotNull() & (F.abs(c["y"] - acc["mean"]) < gap)
        last = F.size(acc["rows"])
        grown = F.concat(F.slice(acc["rows"], F.lit(1), F.greatest(last - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.get(acc["rows"], last - 1), F.array().cast("array<struct<x:double,text:string>>")), cell)))
        return F.when(fits, F.struct(grown.alias("rows"), ((acc["mean"] + c["y"]) / 2).alias("mean"))).otherwise(
            F.struct(F.concat(acc["rows"], F.array(cell)).alias("rows"), c["y"].cast("double").alias("mean"))
        )

    t = cells.groupBy("table_id").agg(sorted_.alias("c")).select("table_id", F.aggregate("c", start, step)["rows"].alias("r"))
    t = t.withColumn("r", F.transform("r", lambda row: F.array_sort(row)["text"])).withColumn("sizes", F.transform("r", F.size))
    widest, spread = F.array_max("sizes"), F.array_max("sizes") - F.array_min("sizes")
    padded = F.transform("r", lambda row: F.concat(row, F.array_repeat(F.lit(""), widest - F.size(row))))
    return t.select("table_id", padded.alias("rows"), widest.alias("n_columns"), F.when(spread == 0, 0.95).when(spread <= 1, 0.75).otherwise(0.40).alias("confidence"))
