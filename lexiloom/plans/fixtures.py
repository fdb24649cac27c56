"""Tables the queries work on, derived from the driver's tables: nodes, seeded source/target pairs, glossary, blocks.

Each derivation has its SQL twin (a CTE), so queries and their oracles start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.session import table

LINES_SQL = """
lines AS (
  SELECT concat(doc_id, ':', pos) AS node_id, source AS project_id, CAST(doc_id AS VARCHAR) AS chapter_id, doc_id, lang, CAST(pos AS BIGINT) AS order_index, content
  FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
  WHERE trim(content) <> '')"""

#: kind = (doc_id + pos) % 12 seeds one defect each; see pairs().
PAIRS_SQL = (
    LINES_SQL
    + """,
seeded AS (SELECT *, (doc_id + order_index) % 12 AS kind, CAST(doc_id * 7 % 4000 AS VARCHAR) AS num FROM lines),
pairs AS (
  SELECT node_id, project_id, chapter_id, order_index, lang, kind,
    CASE kind WHEN 1 THEN content || ' It weighs ' || num || '.50 kg and 12%.'
      WHEN 2 THEN content || ' See https://example.org/a' || num || '.'
      WHEN 3 THEN content || ' Figure 3.' || num || ' and Table 2 show it.'
      WHEN 4 THEN content || ' It is not so.'
      WHEN 5 THEN content || ' Run app.core.start() in /usr/local/bin now.'
      WHEN 6 THEN '"' || content || '" he said.' ELSE content END AS source_text,
    CASE kind WHEN 1 THEN content || ' It weighs ' || num || ',5 kg and 13%.'
      WHEN 2 THEN content || ' See https://example.org/b' || num || '.'
      WHEN 3 THEN content || ' Fig. 3.' || num || ' and Table 4 show it.'
      WHEN 4 THEN content || ' It is so.'
      WHEN 5 THEN content || ' Run app.core.stop() in /usr/local/bin now.'
      WHEN 6 THEN content || '" he said.'
      WHEN 7 THEN substr(content, 1, length(content) // 6)
      WHEN 8 THEN content || ' Is it so?'
      WHEN 9 THEN content || ' 漢字'
      WHEN 10 THEN '' ELSE content END AS target_text
  FROM seeded)"""
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of documents as nodes: project = source, chapter = document, order = position."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("pos", "content"))
    return d.where(F.trim("content") != "").select(
        F.concat_ws(":", "doc_id", "pos").alias("node_id"), F.col("source").alias("project_id"), F.col("doc_id").cast("string").alias("chapter_id"), "doc_id", "lang", F.col("pos").cast("long").alias("order_index"), "content"
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with a source and a rendering in which one kind of defect in twelve is seeded (kinds 0 and 11 are clean)."""
    n = lines(spark, sf_dir)
    n = n.withColumn("kind", (F.col("doc_id") + F.col("order_index")) % 12).withColumn("num", (F.col("doc_id") * 7 % 4000).cast("string"))
    c, num = F.col("content"), F.col("num")
    seeds = {
        1: (F.concat(c, F.lit(" It weighs "), num, F.lit(".50 kg and 12%.")), F.concat(c, F.lit(" It weighs "), num, F.lit(",5 kg and 13%."))),
        2: (F.concat(c, F.lit(" See https://example.org/a"), num, F.lit(".")), F.concat(c, F.lit(" See https://example.org/b"), num, F.lit("."))),
        3: (F.concat(c, F.lit(" Figure 3."), num, F.lit(" and Table 2 show it.")), F.concat(c, F.lit(" Fig. 3."), num, F.lit(" and Table 4 show it."))),
        4: (F.concat(c, F.lit(" It is not so.")), F.concat(c, F.lit(" It is so."))),
        5: (F.concat(c, F.lit(" Run app.core.start() in /usr/local/bin now.")), F.concat(c, F.lit(" Run app.core.stop() in /usr/local/bin now."))),
        6: (F.concat(F.lit('"'), c, F.lit('" he said.')), F.concat(c, F.lit('" he said.'))),
        7: (c, F.substring(c, F.lit(1), F.floor(F.length(c) / 6).cast("int"))),
        8: (c, F.concat(c, F.lit(" Is it so?"))),
        9: (c, F.concat(c, F.lit(" 漢字"))),
        10: (c, F.lit("")),
    }
    source, target = c, c
    for k, (s, t) in seeds.items():
        source, target = F.when(F.col("kind") == k, s).otherwise(source), F.when(F.col("kind") == k, t).otherwise(target)
    return n.select("node_id", "project_id", "chapter_id", "order_index", "lang", "kind", source.alias("source_text"), target.alias("target_text"))


TERMS = ("the", "with", "avec", "una", "und", "for the", "of the", "it")


def term_list(spark: SparkSession) -> DataFrame:
    """A small glossary over the fixtures' words: (source_term, target_term, locked, lock_level, allowed_variants, domain)."""
    rows = [(t, t if i % 2 else t + "x", i % 3 == 0, "HARD" if i % 3 == 0 else "SOFT", ["the"] if i == 2 else [], "GENERAL") for i, t in enumerate(TERMS)]
    return spark.createDataFrame(rows, "source_term string, target_term string, locked boolean, lock_level string, allowed_variants array<string>, domain string")


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("source_text"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target_text"))
    return u.join(a, ["conv_id", "turn"])


def blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, pages): each document laid out twelve lines a page, with a running header, a page number, a two-column page of three and headings by size."""
    n = lines(spark, sf_dir).select("doc_id", F.col("order_index").alias("pos"), F.col("content").alias("text"))
    page = F.floor(F.col("pos") / 12).cast("int") + 1
    k = (F.col("pos") % 12).cast("int")
    two = page % 3 == 0
    body = n.select(
        "doc_id", page.alias("page_number"), (k + 1).alias("block_id"), F.lit("text").alias("type"), "text",
        F.when(two & (k % 2 == 1), 320.0).otherwise(40.0).alias("x0"), (120.0 + F.floor(k / F.when(two, 2).otherwise(1)) * 50).cast("double").alias("y0"),
        F.when(two, F.when(k % 2 == 1, 560.0).otherwise(280.0)).otherwise(560.0).alias("x1"), (150.0 + F.floor(k / F.when(two, 2).otherwise(1)) * 50).cast("double").alias("y1"),
        F.when(F.col("pos") % 25 == 0, 22.0).when(F.col("pos") % 10 == 5, 14.0).otherwise(F.when(F.col("doc_id") % 2 == 0, 11.0).otherwise(10.0)).alias("font_size"), (F.col("pos") % 25 == 0).alias("is_bold"),
    )
    pages = body.select("doc_id", "page_number").distinct().withColumn("width", F.lit(600.0)).withColumn("height", F.lit(842.0))

    def extra(block: int, text, y0: float, y1: float) -> DataFrame:  # noqa: ANN001
        return pages.select(
            "doc_id", "page_number", F.lit(block).alias("block_id"), F.lit("text").alias("type"), text.alias("text"), F.lit(40.0).alias("x0"), F.lit(y0).alias("y0"), F.lit(560.0).alias("x1"), F.lit(y1).alias("y1"), F.lit(9.0).alias("font_size"), F.lit(False).alias("is_bold")
        )

    header = extra(0, F.concat(F.lit("Document "), F.col("doc_id").cast("string")), 20.0, 40.0)
    number = extra(99, F.col("page_number").cast("string"), 800.0, 820.0)
    return body.unionByName(header).unionByName(number).withColumn("heading_level", F.lit(None).cast("int")), pages


BLOCKS_SQL = (
    LINES_SQL
    + """,
body AS (
  SELECT doc_id, order_index // 12 + 1 AS page_number, order_index % 12 + 1 AS block_id, content AS text, order_index AS pos, (order_index // 12 + 1) % 3 = 0 AS two, order_index % 12 AS k FROM lines),
laid AS (
  SELECT doc_id, page_number, block_id, text,
    CASE WHEN two AND k % 2 = 1 THEN 320.0 ELSE 40.0 END AS x0, 120.0 + (k // (CASE WHEN two THEN 2 ELSE 1 END)) * 50 AS y0,
    CASE WHEN two THEN (CASE WHEN k % 2 = 1 THEN 560.0 ELSE 280.0 END) ELSE 560.0 END AS x1, 150.0 + (k // (CASE WHEN two THEN 2 ELSE 1 END)) * 50 AS y1,
    CASE WHEN pos % 25 = 0 THEN 22.0 WHEN pos % 10 = 5 THEN 14.0 WHEN doc_id % 2 = 0 THEN 11.0 ELSE 10.0 END AS font_size, pos % 25 = 0 AS is_bold FROM body),
pages_ AS (SELECT DISTINCT doc_id, page_number FROM body),
blocks AS (
  SELECT * FROM laid
  UNION ALL SELECT doc_id, page_number, 0, 'Document ' || doc_id, 40.0, 20.0, 560.0, 40.0, 9.0, false FROM pages_
  UNION ALL SELECT doc_id, page_number, 99, CAST(page_number AS VARCHAR), 40.0, 800.0, 560.0, 820.0, 9.0, false FROM pages_)"""
)
