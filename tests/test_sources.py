"""Readers and writers of files: EPUB, DOCX, evaluation rows, artefacts, uploads, rendering, books."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import nodes
from lexiloom.sources import readers


def test_epub_blocks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
        z.writestr("OEBPS/p.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="b" href="two.xhtml"/><item id="a" href="one.xhtml"/><item id="e" href="empty.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="e"/><itemref idref="b"/></spine></package>')
        z.writestr("OEBPS/one.xhtml", "<html><body><h1>One</h1><p>a  b</p><ul><li>x</li></ul></body></html>")
        z.writestr("OEBPS/empty.xhtml", "<html><body><p> </p></body></html>")
        z.writestr("OEBPS/two.xhtml", "<html><body><h2>Two</h2><img alt='i'/></body></html>")
    got = readers.epub_blocks(spark, str(tmp_path)).orderBy("block_no").collect()
    assert [(r["page_number"], r["type"], r["heading_level"], r["text"]) for r in got] == [(1, "heading", 1, "One"), (1, "text", None, "a b"), (2, "heading", 2, "Two"), (2, "image", None, "i")]


def test_docx_blocks(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda text, style="": f'<w:p>{f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{p("Title", "Heading1")}{p("text")}{p(" ")}{p("Sub", "heading 3")}</w:body></w:document>')
    got = readers.docx_blocks(spark, str(tmp_path)).orderBy("block_no").collect()
    assert [(r["type"], r["heading_level"], r["font_size"], r["is_bold"], r["text"]) for r in got] == [("heading", 1, 18.0, True, "Title"), ("text", None, 11.0, False, "text"), ("heading", 3, 13.0, True, "Sub")]


def test_eval_rows_and_artefacts(spark, tmp_path):
    rows = [{"sample_id": "a", "domain": "legal", "source": "s", "natural_candidate": "n"}, {"id": "b", "source": "t", "preferred_output": "p", "node_type": "heading"}, {"source": "u"}]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = {r["source"]: r for r in readers.read_eval(spark, str(tmp_path / "e.jsonl")).collect()}
    assert (got["s"]["sample_id"], got["s"]["domain"], got["s"]["preferred_output"]) == ("a", "LEGAL", "n")
    assert (got["t"]["sample_id"], got["t"]["domain"], got["t"]["node_type"]) == ("b", "GENERAL", "heading") and len(got["u"]["sample_id"]) == 64
    out = tmp_path / "out"
    out.mkdir()
    for name, data in (("a.pdf", b"%PDF-1.4"), ("b.pdf", b"no"), ("c.epub", b"PK\x03\x04x"), ("d.mobi", b""), ("e.mobi", b"x")):
        (out / name).write_bytes(data)
    assert {r["path"].rsplit("/", 1)[1]: r["valid"] for r in readers.valid_artefacts(spark, str(out)).collect()} == {"a.pdf": True, "b.pdf": False, "c.epub": True, "e.mobi": True}


def test_preview_picks(spark):
    rows = [("p", str(i), i, k, c) for i, (k, c) in enumerate([("image", "x"), ("heading", "H"), ("paragraph", "aa"), ("paragraph", "b Alice Smith"), ("paragraph", "the term here"), ("paragraph", "long " * 9), ("heading", "I"), ("paragraph", "z")])]
    n = spark.createDataFrame(rows, "project_id string, node_id string, order_index int, node_type string, content string")
    got = [r["node_id"] for r in nodes.preview_picks(n, ["term"]).orderBy("priority", "order_index").collect()]
    assert got[:6] == ["1", "2", "4", "5", "3", "0"] and len(got) == 7


NODE = "project_id string, chapter_id string, node_id string, order_index int, node_type string, level int, source_text string, target_text string"


def test_render_by_type(spark):
    rows = [("heading", None, "A & B", None), ("heading", 9, "x", "y"), ("quote", None, "q", ""), ("code_block", None, "a<b", None), ("horizontal_rule", None, "x", None), ("page_break_hint", None, "x", None), ("footnote", None, "f", None), ("table", None, "t", None), ("image", None, "i", None), ("list_item", None, "l\nm", None), (None, None, None, None)]
    n = spark.createDataFrame([("p", "c", f"n{i}", i, *r) for i, r in enumerate(rows)], NODE)
    got = [r["html"] for r in readers.render(n).orderBy("order_index").collect()]
    assert got == ['<h1 id="n0">A &amp; B</h1>', '<h6 id="n1">y</h6>', '<blockquote id="n2"><p>q</p></blockquote>', '<pre id="n3"><code class="language-text">a&lt;b</code></pre>', "<hr>", '<div class="page-break"></div>', '<div class="footnote" id="n6"><sup>*</sup> f</div>', '<p id="n7">t</p>', '<figure id="n8"><img src=""></figure>', '<p id="n9">l<br>m</p>', '<p id="n10"></p>']
    more = n.where("node_type in ('table', 'image', 'footnote', 'code_block')").withColumns({"rows": F.array(F.array(F.lit("h<"), F.lit(None)), F.array(F.lit("a"), F.lit("b"))), "asset": F.lit("x.png"), "caption": F.lit("C"), "number": F.lit("3"), "language": F.lit("py")})
    got = [r["html"] for r in readers.render(more).orderBy("order_index").collect()]
    assert got == ['<pre id="n3"><code class="language-py">a&lt;b</code></pre>', '<div class="footnote" id="n6"><sup>3</sup> f</div>', '<table id="n7"><tr><th>h&lt;</th><th></th></tr><tr><td>a</td><td>b</td></tr></table>', '<figure id="n8"><img src="x.png"><figcaption>C</figcaption></figure>']


def test_contents_are_a_tree(spark):
    import random

    rng = random.Random(4)
    rows = [("p", f"c{c}", f"{c}-{i}", i, rng.choice(["heading", "heading", "paragraph"]), rng.choice([None, 0, 1, 2, 3, 4, 5, 6, 9]), f"t{i}", None) for c in range(4) for i in range(40)]
    want, stack = {}, []
    for _, c, node, i, kind, level, *_ in rows:
        stack = [] if i == 0 else stack
        if kind != "heading":
            continue
        level = min(max(2 if level is None else level, 1), 6)
        while stack and stack[-1][0] >= level:
            stack.pop()
        want[node] = (level, stack[-1][1] if stack else c)
        stack.append((level, node))
    rng.shuffle(rows)
    got = {r["node_id"]: (r["level"], r["parent_id"]) for r in readers.contents(spark.createDataFrame(rows, NODE)).collect()}
    assert got == want


def test_books_come_back_through_the_reader(spark, tmp_path):
    from lexiloom.sources import epub

    chapters = [(f"b{b}", f"Book & {b}", c, f"Chapter <{c}>", f"<p>text {b}.{c}</p><h2>sub</h2>") for b in range(5) for c in (2, 0, 1)]
    d = spark.createDataFrame([*chapters, ("odd/name é", None, 1, None, None)], "book_id string, title string, chapter_order int, chapter_title string, html string")
    target = tmp_path / "books"
    epub.write_books(d, str(target))
    assert sorted(f.name for f in target.iterdir()) == ["b0.epub", "b1.epub", "b2.epub", "b3.epub", "b4.epub", "odd_name__.epub"]
    assert all(r["valid"] for r in readers.valid_artefacts(spark, str(target)).collect())
    blocks = [r for r in readers.epub_blocks(spark, str(target)).collect() if r["path"].endswith("b3.epub")]
    texts = [r["text"] for r in sorted(blocks, key=lambda r: r["block_no"])]
    assert [t for t in texts if t.startswith(("Chapter", "text"))] == ["Chapter <0>", "text 3.0", "Chapter <1>", "text 3.1", "Chapter <2>", "text 3.2"]


def test_a_job_that_fails_leaves_no_books(spark, tmp_path):
    from lexiloom.sources import epub

    d = spark.range(40).select(F.col("id").cast("string").alias("book_id"), F.lit("t").alias("title"), F.lit(1).alias("chapter_order"), F.lit("c").alias("chapter_title"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost")).cast("string")).otherwise("<p>x</p>").alias("html"))
    with pytest.raises(Exception, match="lost"):
        epub.write_books(d, str(tmp_path / "books"))
    assert not (tmp_path / "books").exists() or [f for f in (tmp_path / "books").rglob("*") if f.is_file()] == []
