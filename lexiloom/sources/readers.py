"""Readers and writers: plain text and Markdown, HTML, DOCX, glossary CSV, evaluation rows, artefact checks.

Files are read by Spark's own sources (text, binaryFile, csv, json); parsing of one file is a small function in a task.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as tx

EXTENSIONS = ("pdf", "epub", "docx", "txt", "md")
BLOCKS = "page_number int, block_id int, type string, text string, font_size double, is_bold boolean, heading_level int"


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, extension, length, title) of the files with a known extension; the title is the name with spaces for underscores, in title case."""
    f = spark.read.format("binaryFile").load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    title = F.initcap(F.replace(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_"), F.lit(" ")))
    return f.select("path", ext.alias("extension"), "length", title.alias("title")).where(F.col("extension").isin(*EXTENSIONS))


def text_blocks(docs: DataFrame) -> DataFrame:
    """Paragraphs and Markdown headings of docs(doc_id, text): (doc_id, block_no, type, heading_level, font_size, text).

    Blank lines and headings part blocks; lines of a paragraph join with a space; # to #### give levels 1 to 4 (deeper ones 4)
    and sizes 16 to 10. Gaps and islands over line positions, within one document each.
    """
    n = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("line", F.trim("line"))
    mark = F.regexp_extract("line", r"^(#{1,6})\s+", 1)
    n = n.withColumn("mark", F.length(mark)).withColumn("head", F.col("mark") > 0).withColumn("blank", F.col("line") == "")
    w = Window.partitionBy("doc_id").orderBy("pos")
    starts = F.col("head") | F.col("blank") | F.coalesce(F.lag("head").over(w), F.lit(False))
    n = n.withColumn("island", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("blank"))
    per = n.groupBy("doc_id", "island").agg(F.min("pos").alias("pos"), F.max("mark").alias("mark"), F.array_sort(F.collect_list(F.struct("pos", "line")))["line"].alias("ls"))
    level = F.least(F.col("mark"), F.lit(4))
    head = F.col("mark") > 0
    text = F.when(head, F.trim(F.regexp_replace(F.col("ls")[0], r"^#{1,6}\s+", ""))).otherwise(F.array_join("ls", " "))
    return per.select(
        "doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).alias("block_no"), F.when(head, "heading").otherwise("text").alias("type"), F.when(head, level).alias("heading_level"), F.when(head, 18.0 - 2 * level).otherwise(11.0).alias("font_size"), text.alias("text")
    )


class _Blocks(HTMLParser):
    """h1 to h6 and p as text blocks, img as image blocks; scripts and styles are no text; an opening block ends one left open."""

    KEEP = ("h1", "h2", "h3", "h4", "h5", "h6", "p")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, int | None, str]] = []
        self.tag, self.text, self.mute = None, [], 0

    def close_block(self) -> None:
        text = " ".join("".join(self.text).split())
        if self.tag and text:
            level = int(self.tag[1]) if self.tag != "p" else None
            self.out.append(("heading" if level else "text", level, text))
        self.tag, self.text = None, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.mute += 1
        elif tag in self.KEEP:
            self.close_block()
            self.tag = tag
        elif tag == "img":
            self.out.append(("image", None, dict(attrs).get("alt") or ""))
        elif tag == "br":
            self.text.append(" ")
        elif tag in ("div", "ul", "ol", "table", "nav", "footer", "article", "blockquote", "section"):
            self.close_block()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        elif tag == self.tag or tag in ("div", "article", "body"):
            self.close_block()

    def handle_data(self, data: str) -> None:
        if not self.mute and self.tag:
            self.text.append(data)


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_no, type, heading_level, text) of pages(page_id, html), streamed page by page."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, source in b.itertuples(index=False):
                p = _Blocks()
                p.feed(source or "")
                p.close_block()
                rows += [(page, k + 1, kind, level, text) for k, (kind, level, text) in enumerate(p.out)]
            yield pd.DataFrame(rows, columns=["page_id", "block_no", "type", "heading_level", "text"]).astype({"heading_level": "Int32"})

    return pages.select("page_id", "html").mapInPandas(parse, "page_id long, block_no long, type string, heading_level int, text string")


def _docx(data: bytes) -> list[tuple[str, int | None, float, bool, str]]:
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    out = []
    for p in root.iter(f"{ns}p"):
        text = "".join(t.text or "" for t in p.iter(f"{ns}t")).strip()
        style = next((s.get(f"{ns}val", "") for s in p.iter(f"{ns}pStyle")), "")
        m = re.fullmatch(r"heading\s*([123])", style.lower())
        if text:
            out.append(("heading" if m else "text", int(m[1]) if m else None, {1: 18.0, 2: 15.0, 3: 13.0}[int(m[1])] if m else 11.0, bool(m), text))
    return out


def docx_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(path, block_no, type, heading_level, font_size, is_bold, text) of DOCX files: headings 1 to 3 by style name, else text."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, k + 1, *x) for p, c in b.itertuples(index=False) for k, x in enumerate(_docx(c))]
            yield pd.DataFrame(rows, columns=["path", "block_no", "type", "heading_level", "font_size", "is_bold", "text"]).astype({"heading_level": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, block_no long, type string, heading_level int, font_size double, is_bold boolean, text string")


def _epub(data: bytes) -> list[tuple[int, str, int | None, str]]:
    """(page, type, level, text) of an EPUB: the items of its spine in order; items without blocks are no pages."""
    book = zipfile.ZipFile(io.BytesIO(data))
    opf = next(r.get("full-path") for r in ElementTree.fromstring(book.read("META-INF/container.xml")).iter() if r.tag.endswith("rootfile"))
    package, base = ElementTree.fromstring(book.read(opf)), opf.rpartition("/")[0]
    items = {i.get("id"): i.get("href") for i in package.iter() if i.tag.endswith("}item") or i.tag == "item"}
    out, page = [], 0
    for ref in (i.get("idref") for i in package.iter() if i.tag.endswith("itemref")):
        p = _Blocks()
        p.feed(book.read(f"{base}/{items[ref]}".lstrip("/")).decode("utf-8", "ignore"))
        p.close_block()
        page += bool(p.out)
        out += [(page, kind, level, text) for kind, level, text in p.out]
    return out


def epub_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_number, block_no, type, heading_level, text) of EPUB files; block_no counts over the book."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, x[0], k + 1, *x[1:]) for p, c in b.itertuples(index=False) for k, x in enumerate(_epub(c))]
            yield pd.DataFrame(rows, columns=["path", "page_number", "block_no", "type", "heading_level", "text"]).astype({"heading_level": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, page_number long, block_no long, type string, heading_level int, text string")


GLOSSARY_FIELDS = ("source_term", "target_term", "preferred_target", "allowed_variants", "category", "domain", "sense_hint", "part_of_speech", "preserve_original", "locked", "lock_level", "notes")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Glossary CSV with a header: rows without a term go, booleans are true, 1 or yes, variants are a JSON list or parted by |."""
    g = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(", ".join(f"{c} string" for c in GLOSSARY_FIELDS)).csv(path)
    return glossary_rows(g)


def glossary_rows(g: DataFrame) -> DataFrame:
    flag = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin("true", "1", "yes")
    v = F.trim(F.coalesce("allowed_variants", F.lit("")))
    listed = F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.filter(F.transform(F.split(v, r"\|"), F.trim), lambda x: x != ""))
    out = g.where(F.trim(F.coalesce("source_term", F.lit(""))) != "")
    return out.withColumns({"source_term": F.trim("source_term"), "preserve_original": flag("preserve_original"), "locked": flag("locked"), "allowed_variants": F.coalesce(listed, F.array().cast("array<string>"))})


def write_glossary(g: DataFrame, path: str) -> None:
    """The same twelve columns; variants as JSON."""
    g.withColumn("allowed_variants", F.to_json("allowed_variants")).select(*GLOSSARY_FIELDS).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation JSON lines of several shapes in one: sample_id (else a hash of domain and source), domain upper case, node_type paragraph by default, preferred output from whichever field has it."""
    schema = "id string, sample_id string, domain string, source string, node_type string, preferred_output string, natural_candidate string, repair_candidate string, expected string, glossary map<string,string>"
    e = spark.read.schema(schema).json(path)
    return e.select(
        F.coalesce("sample_id", "id", F.sha2(F.concat_ws("|", "domain", "source"), 256)).alias("sample_id"), F.upper(F.coalesce("domain", F.lit("GENERAL"))).alias("domain"), "source",
        F.coalesce("node_type", F.lit("paragraph")).alias("node_type"), F.coalesce("preferred_output", "natural_candidate", "repair_candidate").alias("preferred_output"), "expected", "glossary",
    )


def ocr_lines(words: DataFrame) -> DataFrame:
    """(page, line, text, x0, y0, x1, y1, confidence) from OCR words (page, pos, word_num, text, x, y, w, h, conf): a block begins at word_num 1; empty words and negative confidences go."""
    w = words.where((F.trim("text") != "") & (F.col("conf") >= 0))
    line = F.sum((F.col("word_num") == 1).cast("int")).over(Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    g = w.withColumn("line", line).groupBy("page", "line")
    return g.agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", "text")))["text"], " ").alias("text"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"), (F.avg("conf") / 100).alias("confidence")
    )


def valid_artefacts(spark: SparkSession, path: str) -> DataFrame:
    """(path, valid): exports by their first bytes: PDF %PDF-, EPUB PK 03 04; other files need any byte. Spark's source passes over files without bytes, so an export without a row here is not valid either."""
    f = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 5))
    ok = F.when(F.col("path").endswith(".pdf"), head.startswith("255044462D")).when(F.col("path").endswith(".epub"), head.startswith("504B0304")).otherwise(F.col("length") > 0)
    return f.select("path", (ok & (F.col("length") > 0)).alias("valid"))


def escaped(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.replace(out, F.lit("\n"), F.lit("<br>"))


def _or_null(nodes: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in nodes.columns else F.lit(None).cast(kind)


def render(nodes: DataFrame) -> DataFrame:
    """Adds html to nodes (node_id, node_type, level, source_text, target_text): the rendering, or the source without one, escaped, in the element of its type under the node's id.

    What only some types have comes from columns that may be missing: rows (array of rows of cells) of a table, asset and
    caption of an image, number of a footnote, language of code. A heading without a level is of the first; a table without
    rows is a paragraph, and so is every other type. Rules and page breaks have no content.
    """
    body = escaped(F.coalesce(F.nullif(F.col("target_text"), F.lit("")), F.col("source_text"), F.lit("")))
    kind, at = F.lower(F.coalesce("node_type", F.lit(""))), F.concat(F.lit(' id="'), escaped(F.col("node_id").cast("string")), F.lit('"'))

    def element(tag: Column | str, inner: Column) -> Column:
        tag = F.lit(tag) if isinstance(tag, str) else tag
        return F.concat(F.lit("<"), tag, at, F.lit(">"), inner, F.lit("</"), tag, F.lit(">"))

    def cells(row: Column, tag: str) -> Column:
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(row, lambda c: F.concat(F.lit(f"<{tag}>"), escaped(F.coalesce(c, F.lit(""))), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))

    rows = F.coalesce(_or_null(nodes, "rows", "array<array<string>>"), F.array().cast("array<array<string>>"))
    table = F.concat(cells(F.get(rows, F.lit(0)), "th"), F.array_join(F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: cells(r, "td")), ""))
    caption = escaped(F.coalesce(_or_null(nodes, "caption"), F.lit("")))
    figure = F.concat(F.lit('<img src="'), escaped(F.coalesce(_or_null(nodes, "asset"), F.lit(""))), F.lit('">'), F.when(caption != "", F.concat(F.lit("<figcaption>"), caption, F.lit("</figcaption>"))).otherwise(""))
    note = F.concat(F.lit("<sup>"), escaped(F.coalesce(F.nullif(_or_null(nodes, "number"), F.lit("")), F.lit("*"))), F.lit("</sup> "), body)
    code = F.concat(F.lit('<code class="language-'), escaped(F.coalesce(F.nullif(_or_null(nodes, "language"), F.lit("")), F.lit("text"))), F.lit('">'), body, F.lit("</code>"))
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(6)).cast("string")
    html = (
        F.when(kind == "heading", element(F.concat(F.lit("h"), level), body))
        .when(kind == "quote", element("blockquote", F.concat(F.lit("<p>"), body, F.lit("</p>"))))
        .when(kind == "image", element("figure", figure))
        .when((kind == "table") & (F.size(rows) > 0), element("table", table))
        .when(kind == "footnote", F.concat(F.lit('<div class="footnote"'), at, F.lit(">"), note, F.lit("</div>")))
        .when(kind == "code_block", element("pre", code))
        .when(kind == "horizontal_rule", "<hr>")
        .when(kind == "page_break_hint", '<div class="page-break"></div>')
        .otherwise(element("p", body))
    )
    return nodes.withColumn("html", html)


def chapters_html(nodes: DataFrame) -> DataFrame:
    """(project_id, chapter_id, html): the nodes' html in order, one row for each chapter."""
    rows = F.array_sort(F.collect_list(F.struct("order_index", "node_id", "html")))
    return nodes.groupBy("project_id", "chapter_id").agg(F.array_join(F.transform(rows, lambda r: r["html"]), "\n").alias("html"))


def contents(nodes: DataFrame) -> DataFrame:
    """(project_id, chapter_id, node_id, order_index, title, level, parent_id): the headings as a tree.

    A heading's parent is the nearest one before it in its chapter that is of a lower level; without one it is the chapter. The
    last heading of each level so far is carried along in order, so a chapter is passed once and no row holds more than a
    heading. Levels are 1 to 6; a heading without one is of the second. title: the rendering, or the source without one.
    """
    level = F.least(F.greatest(F.coalesce("level", F.lit(2)), F.lit(1)), F.lit(6)).cast("int")
    title = F.coalesce(F.nullif(F.col("target_text"), F.lit("")), F.col("source_text"))
    h = nodes.where(F.lower("node_type") == "heading").select("project_id", "chapter_id", "node_id", "order_index", title.alias("title"), level.alias("level"))
    so_far = Window.partitionBy("project_id", "chapter_id").orderBy("order_index", "node_id").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == n, F.struct("order_index", "node_id")), ignorenulls=True).over(so_far) for n in range(1, 6)]
    parent = F.array_max(F.slice(F.array(*last), F.lit(1), F.col("level") - 1))["node_id"]
    return h.withColumn("parent_id", F.coalesce(parent, F.col("chapter_id").cast("string")))
