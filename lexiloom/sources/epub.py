"""A sink for EPUB books: a Python data source whose tasks write whole books beside the target and whose driver commits them."""

from __future__ import annotations

import html
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Names and texts of the format.
CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
PAGE = '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{title}</title></head><body>{body}</body></html>'
PACKAGE = (
    '<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
    '<dc:identifier id="id">{id}</dc:identifier><dc:title>{title}</dc:title><dc:language>{language}</dc:language></metadata>'
    '<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{spine}</spine></package>'
)


@dataclass
class Written(WriterCommitMessage):
    """Books of one task: (temporary path, name)."""

    books: list[tuple[str, str]] = field(default_factory=list)


class _Book:
    """A book being written; chapters go to the file as they come, so only their titles are held."""

    def __init__(self, path: str, book_id: str, title: str, language: str) -> None:
        self.path, self.id, self.title, self.language, self.titles = path, book_id, title, language, []
        self.file = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED)
        self.file.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        self.file.writestr("META-INF/container.xml", CONTAINER)

    def add(self, title: str, body: str) -> None:
        self.titles.append(title)
        head = f"<h1>{html.escape(title)}</h1>" if title else ""
        self.file.writestr(f"OEBPS/c{len(self.titles)}.xhtml", PAGE.format(title=html.escape(title), body=head + body))

    def close(self) -> None:
        n = range(1, len(self.titles) + 1)
        links = "".join(f'<li><a href="c{i}.xhtml">{html.escape(self.titles[i - 1] or str(i))}</a></li>' for i in n)
        self.file.writestr("OEBPS/nav.xhtml", PAGE.format(title=html.escape(self.title), body=f'<nav epub:type="toc" xmlns:epub="http://www.idpf.org/2007/ops"><ol>{links}</ol></nav>'))
        items = "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in n)
        spine = "".join(f'<itemref idref="c{i}"/>' for i in n)
        self.file.writestr("OEBPS/content.opf", PACKAGE.format(id=html.escape(self.id), title=html.escape(self.title), language=html.escape(self.language), items=items, spine=spine))
        self.file.close()


class EpubWriter(DataSourceWriter):
    """Rows come sorted by book and place. A task writes its books to a folder of its own; commit moves them to the target, abort removes them."""

    def __init__(self, target: str) -> None:
        self.target, self.own = target, f"_{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        folder, done, book = os.path.join(self.target, self.own, uuid.uuid4().hex), Written(), None
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            if book is None or r["book_id"] != book.id:
                if book:
                    book.close()
                path = os.path.join(folder, f"{len(done.books)}.part")
                book = _Book(path, r["book_id"], r["title"], r["language"])
                done.books.append((path, f"{re.sub(r'[^A-Za-z0-9._-]', '_', book.id)}.epub"))
            book.add(r["chapter_title"] or "", r["html"] or "")
        if book:
            book.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        for path, name in [b for m in messages if m for b in m.books]:
            os.replace(path, os.path.join(self.target, name))
        self._tidy()

    def abort(self, messages: list[Written | None]) -> None:
        self._tidy()

    def _tidy(self) -> None:
        top = os.path.join(self.target, self.own)
        for folder, _, files in os.walk(top, topdown=False):
            for f in files:
                os.remove(os.path.join(folder, f))
            os.rmdir(folder)


class EpubSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epub_books"

    def writer(self, schema: StructType, overwrite: bool) -> EpubWriter:
        return EpubWriter(self.options["target"])


def write_books(chapters: DataFrame, target: str, language: str = "vi") -> None:
    """Write one EPUB file a book to target, a folder that driver and executors share as files.

    chapters: (book_id, title, chapter_order, chapter_title, html), one row a chapter. A book is one file and so the work of
    one task, which holds a chapter at a time. Files appear when the whole job is done, under names from their ids; a job that
    fails, or a task that is tried again, leaves none behind. Null ids and titles are empty.
    """
    spark = chapters.sparkSession
    spark.dataSource.register(EpubSource)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = chapters.select(text("book_id").alias("book_id"), text("title").alias("title"), F.lit(language).alias("language"), F.col("chapter_order").cast("long"), text("chapter_title").alias("chapter_title"), text("html").alias("html"))
    rows.repartition("book_id").sortWithinPartitions("book_id", "chapter_order", "chapter_title").write.format("epub_books").option("target", target).mode("append").save()
