"""Queries over node tables, terms, structure, issues, retrieval, metrics, caches and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import scores
from lexiloom.operators import caches, gate, issues, lint, metrics, mining, nodes, packing, retrieval, structure, terms
from lexiloom.plans import provider
from lexiloom.plans.fixtures import BLOCKS_SQL, LINES_SQL, PAIRS_SQL, TERMS, blocks, lines, pairs, term_list
from lexiloom.plans.queries_text import joined
from lexiloom.sources import readers
from lexiloom.session import table
from lexiloom.streaming import events as ev

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# nodes: lines of documents with a type (each of the fourteen, an unknown one, none) and a state by arithmetic

_UNSHOWN = "coalesce(node_type, '') IN ('image', 'equation', 'code_block', 'horizontal_rule', 'page_break_hint')"

NODES_SQL = (
    LINES_SQL
    + """,
nodes AS (
  SELECT *, ['heading', 'paragraph', 'quote', 'list', 'list_item', 'image', 'caption', 'table', 'footnote', 'footnote_reference', 'equation', 'code_block', 'horizontal_rule', 'page_break_hint', 'weird', NULL][((doc_id * 3 + order_index) % 16 + 1)::INT] AS node_type,
    ['TRANSLATED', 'PENDING', 'FAILED', 'NEEDS_REVIEW', 'TRANSLATING'][((doc_id + order_index) % 5 + 1)::INT] AS status FROM lines)"""
)


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("order_index")
    every = F.array(*map(F.lit, (*nodes.NODE_TYPES, "weird", None))).cast("array<string>")
    kind = F.element_at(every, ((F.col("doc_id") * 3 + o) % 16 + 1).cast("int"))
    state = F.element_at(F.array(*map(F.lit, ("TRANSLATED", "PENDING", "FAILED", "NEEDS_REVIEW", "TRANSLATING"))), ((F.col("doc_id") + o) % 5 + 1).cast("int"))
    return lines(spark, sf_dir).withColumn("node_type", kind).withColumn("status", state)


@query(f"""WITH {NODES_SQL}, s AS (
  SELECT project_id, count(*) AS total_nodes, count(*) FILTER (t) AS translatable_nodes, count(*) FILTER (t AND status = 'TRANSLATED') AS translated_nodes,
    count(*) FILTER (t AND status = 'FAILED') AS failed_nodes, count(*) FILTER (t AND status = 'NEEDS_REVIEW') AS needs_review_nodes
  FROM (SELECT *, NOT {_UNSHOWN} AS t FROM nodes) GROUP BY project_id)
SELECT *, greatest(0, total_nodes - translatable_nodes) AS skipped_nodes, translated_nodes + failed_nodes + needs_review_nodes AS terminal_nodes,
  CASE WHEN translatable_nodes > 0 THEN round(translated_nodes / translatable_nodes * 100.0, 1) ELSE 100.0 END AS progress_percent FROM s""")
def project_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.project_stats(typed(spark, sf_dir))


@query(f"""WITH {NODES_SQL}, s AS (
  SELECT project_id, count(*) FILTER (t) AS n, count(*) FILTER (t AND status = 'TRANSLATED') AS done, count(*) FILTER (t AND status IN ('TRANSLATED', 'FAILED', 'NEEDS_REVIEW')) AS ended
  FROM (SELECT *, NOT {_UNSHOWN} AS t FROM nodes) GROUP BY project_id)
SELECT project_id, CASE WHEN project_id LIKE '%7' THEN 'TRANSLATION_CONFIGURED' WHEN n = 0 OR done = n THEN 'TRANSLATED' WHEN ended >= n THEN 'TRANSLATED_WITH_REVIEW' ELSE 'TRANSLATION_FAILED' END AS stage FROM s""")
def stage_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.final_stage(nodes.project_stats(typed(spark, sf_dir)), F.col("project_id").endswith("7"))


@query(f"""WITH {LINES_SQL} SELECT node_id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY doc_id, order_index, node_id) - 1 AS order_index FROM lines""")
def node_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lines(spark, sf_dir).select("node_id", "project_id", F.col("doc_id").alias("chapter_index"), F.col("order_index").alias("node_index"))
    return nodes.number_nodes(n).select("node_id", "project_id", F.col("order_index").cast("long").alias("order_index"))


@query(f"""WITH {LINES_SQL}, f AS (
  SELECT *, lead(content) OVER w AS nxt, coalesce(lag(order_index % 4 = 1) OVER w, false) AS gone FROM lines WINDOW w AS (PARTITION BY chapter_id ORDER BY order_index))
SELECT node_id, CASE WHEN order_index % 4 = 1 AND nxt IS NOT NULL THEN content || ' ' || nxt ELSE content END AS content FROM f WHERE NOT gone""")
def merge_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lines(spark, sf_dir)
    return nodes.merge_next(n, n.where(F.col("order_index") % 4 == 1)).select("node_id", "content")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return nodes.latest(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("""WITH d AS (
  SELECT conv_id, turn, CAST(greatest(1, floor(len(regexp_extract_all(text, '\\S+')) * 1.45)) AS BIGINT) AS c FROM conversations WHERE role <> 'system'),
l AS (SELECT conv_id, turn, coalesce((SELECT list({'t': x.turn, 'c': x.c} ORDER BY x.turn) FROM (SELECT y.turn, y.c FROM d y WHERE y.conv_id = o.conv_id AND y.turn < o.turn ORDER BY y.turn DESC LIMIT 4) x), []) AS l FROM conversations o),
s1 AS (SELECT *, coalesce(l[1].c, 0) AS a FROM l), s2 AS (SELECT *, CASE WHEN len(l) > 1 AND a + l[2].c <= 120 THEN l[2].c ELSE 0 END AS b FROM s1),
s3 AS (SELECT *, CASE WHEN len(l) > 2 AND a + b + l[3].c <= 120 THEN l[3].c ELSE 0 END AS c FROM s2), s4 AS (SELECT *, CASE WHEN len(l) > 3 AND a + b + c + l[4].c <= 120 THEN l[4].c ELSE 0 END AS d FROM s3)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN a > 0 THEN l[1].t END, CASE WHEN b > 0 THEN l[2].t END, CASE WHEN c > 0 THEN l[3].t END, CASE WHEN d > 0 THEN l[4].t END], lambda x: x IS NOT NULL), ',') AS context FROM s4""")
def rolling_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter_id"), F.col("turn").alias("node_id"), F.col("turn").alias("order_index"), F.col("text").alias("content"), "role")
    out = nodes.rolling_context(c, k=4, budget=120, done=F.col("role") != "system")
    return out.select(F.col("chapter_id").alias("conv_id"), F.col("node_id").alias("turn"), joined(F.col("context")).alias("context"))


@query(f"""WITH {NODES_SQL}, n AS (SELECT *, row_number() OVER w - 1 AS at_, count(*) OVER (PARTITION BY chapter_id) AS n FROM nodes WINDOW w AS (PARTITION BY chapter_id ORDER BY order_index))
SELECT node_id FROM n WHERE at_ IN (0, floor((n - 1) * 0.25), floor((n - 1) * 0.5), floor((n - 1) * 0.75), n - 1) OR node_type = 'heading'""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.stratified_sample(typed(spark, sf_dir)).select("node_id")


@query(f"""WITH {NODES_SQL}, c AS (
  SELECT *, CASE WHEN coalesce(node_type, '') IN ('image', 'table') THEN 0 ELSE 1 END AS v, dense_rank() OVER (PARTITION BY project_id ORDER BY doc_id) - 1 AS chapter_index FROM nodes),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id, chapter_index ORDER BY CASE WHEN chapter_index = 0 THEN 0 ELSE v END, order_index) AS n FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY chapter_index, order_index) AS m FROM r WHERE (chapter_index = 0 AND n <= 15) OR (chapter_index > 0 AND v = 0 AND n = 1))
SELECT node_id, node_type FROM k WHERE m <= 40""")
def smart_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes.number_chapters(typed(spark, sf_dir), "doc_id")
    return nodes.preview(n).select("node_id", "node_type")


@query(f"""WITH {PAIRS_SQL}
SELECT node_id, (length(target_text) - length(replace(target_text, 'an', ''))) // 2 AS matches, replace(target_text, 'an', 'AN') AS replaced FROM pairs WHERE contains(target_text, 'an')""")
def find_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.find_replace(pairs(spark, sf_dir), "an", "AN").select("node_id", "matches", "replaced")


@query(f"""WITH {LINES_SQL} SELECT project_id, count(DISTINCT chapter_id) AS chapters, count(*) AS nodes, min(node_id) AS least_id FROM lines GROUP BY project_id""")
def nested_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lines(spark, sf_dir)
    chapters = n.select("project_id", "chapter_id", F.col("doc_id").alias("chapter_index")).distinct()
    d = nodes.nested(chapters, n)
    return d.groupBy("project_id").agg(F.count("*").alias("chapters"), F.sum(F.size("nodes")).alias("nodes"), F.min(F.array_min(F.col("nodes")["node_id"])).alias("least_id"))


# consistency and terms


@query("""WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT source, array_to_string(list_filter(string_split_regex(lower(line), '\\s+'), lambda x: x <> ''), ' ') AS key FROM l)
SELECT key AS source_key, count(*) AS occurrences, count(DISTINCT source) AS variants FROM k WHERE len(string_split(key, ' ')) >= 3 GROUP BY key HAVING count(*) >= 2 AND count(DISTINCT source) > 1""".replace("\\\\", "\\"))
def repeated_phrase_inconsistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lines(spark, sf_dir).select(F.col("content").alias("source_text"), F.col("project_id").alias("target_text"))
    return terms.repeated_phrases(n)


_TERM_VALUES = ", ".join(f"('{t}', '{t if i % 2 else t + 'x'}', {str(i % 3 == 0).lower()})" for i, t in enumerate(TERMS))


@query(f"""WITH {PAIRS_SQL}, g(s, t, l) AS (VALUES {_TERM_VALUES}),
h AS (SELECT s, t, contains(lower(target_text), t) AS ok FROM pairs JOIN g ON contains(lower(source_text), s))
SELECT s AS source_term, t AS target_term, count(*) AS occurrences, count(*) FILTER (NOT ok) AS deviations FROM h GROUP BY s, t HAVING count(*) >= 2 AND count(*) FILTER (NOT ok) > 0""")
def glossary_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.substring_consistency(pairs(spark, sf_dir), term_list(spark))


def _has(text: str, term: str) -> str:
    return f"regexp_matches({text}, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){term}(s|es|ed|ing)?($|[^\\p{{L}}\\p{{N}}_])')"


# one branch a term: RE2 compiles constant patterns once
_HITS = " UNION ALL ".join(
    f"SELECT node_id, '{s}' AS s, '{s if i % 2 else s + 'x'}' AS t, {str(i % 3 == 0).lower()} AS l, {_has('target_text', s if i % 2 else s + 'x')} AS ok, {_has('target_text', 'the')} AS other FROM pairs WHERE {_has('source_text', s)}"
    for i, s in enumerate(TERMS)
)


@query(f"""WITH {PAIRS_SQL}, h AS ({_HITS})
SELECT s AS source_term, t AS target_term, count(*) AS occurrences, count(*) FILTER (NOT ok) AS deviations, CASE WHEN l THEN 'ENTITY_MISMATCH' ELSE 'TERM_VARIANT' END AS issue_type, CASE WHEN l THEN 'ERROR' ELSE 'WARNING' END AS severity
FROM h GROUP BY s, t, l HAVING count(*) >= 2 AND count(*) FILTER (NOT ok) > 0""")
def term_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_variants(pairs(spark, sf_dir), term_list(spark))


@query(f"""WITH {PAIRS_SQL}, h AS ({_HITS})
SELECT node_id, s AS source_term, CASE WHEN l THEN 'GLOSSARY_MISMATCH' ELSE 'GLOSSARY_PREFERENCE' END AS issue_type, CASE WHEN l THEN 'ERROR' ELSE 'WARNING' END AS severity
FROM h WHERE NOT ok AND NOT (s = 'avec' AND other)""")
def glossary_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = term_list(spark).withColumn("target", F.col("target_term"))
    return terms.glossary_issues(pairs(spark, sf_dir), entries)


_ENTITIES = (("the", "the", "of", True, "TERM"), ("und", "und", "die", False, "ACRONYM"), ("la", "la", "le", False, "NAME"))
_LABELS = " UNION ALL ".join(
    f"SELECT '{k}' AS k, {str(lock).lower()} AS l, '{kind}' AS ty, CASE WHEN {_has('target_text', p)} THEN '{p}' WHEN {_has('target_text', a)} THEN '{a}' ELSE '<no match>' END AS label FROM pairs WHERE {_has('source_text', k)}"
    for k, p, a, lock, kind in _ENTITIES
)


@query(f"""WITH {PAIRS_SQL}, h AS ({_LABELS})
SELECT k AS source_key, count(*) AS occurrences, count(DISTINCT label) AS variants, CASE WHEN l THEN 'ENTITY_MISMATCH' WHEN ty = 'ACRONYM' THEN 'ACRONYM_INCONSISTENCY' ELSE 'ENTITY_VARIANT' END AS issue_type, CASE WHEN l THEN 'ERROR' ELSE 'WARNING' END AS severity
FROM h GROUP BY k, l, ty HAVING count(*) >= 2 AND count(DISTINCT label) > 1""")
def entity_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, p, [a], lock, kind) for k, p, a, lock, kind in _ENTITIES]
    d = spark.createDataFrame(rows, "source_key string, preferred string, aliases array<string>, locked boolean, entity_type string")
    return terms.entity_variants(pairs(spark, sf_dir), d)


@query("""WITH p AS (SELECT lower(split_part(p_type, ' ', 1)) AS term, p_partkey FROM part), f AS (SELECT term, min(p_partkey) AS ord FROM p GROUP BY term)
SELECT term, ord FROM f WHERE term NOT IN ('economy', 'promo')""")
def preset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.split("p_type", " ")[0].alias("term"), F.col("p_partkey").alias("ord"))
    have = spark.createDataFrame([("Economy",), ("PROMO",)], "source_term string")
    return terms.presets_to_add(p, have).select(F.lower("term").alias("term"), "ord")


@query(f"""WITH {PAIRS_SQL},
h AS (SELECT project_id, node_id, array_to_string(list_filter(string_split_regex(lower(source_text), '\\s+'), lambda x: x <> ''), ' ') AS s, array_to_string(list_filter(string_split_regex(lower(target_text), '\\s+'), lambda x: x <> ''), ' ') AS t FROM pairs WHERE order_index = 0)
SELECT a.node_id, b.node_id AS other_id FROM h a JOIN h b ON a.project_id = b.project_id AND a.node_id <> b.node_id
WHERE a.t <> '' AND b.t <> '' AND (a.t = b.t OR (length(a.t) >= 3 AND contains(b.t, a.t))) AND NOT contains(a.s, b.s) AND NOT contains(b.s, a.s)""")
def heading_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings (first lines) rendered like, or within, another heading of the project whose source is unrelated."""
    h = pairs(spark, sf_dir).where(F.col("order_index") == 0).select("project_id", "node_id", "source_text", "target_text")
    return terms.duplicated_headings(h)


@query("""WITH cut AS (SELECT doc_id AS id, 'd' AS side, unnest(string_split_regex(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(10), 'g'), '\\n+')) AS sentence FROM documents
  UNION ALL SELECT item_id, 'b', unnest(string_split_regex(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(10), 'g'), '\\n+')) FROM benchmark),
sen AS (SELECT side, id, sentence, list_distinct(regexp_extract_all(lower(sentence), '[\\p{L}\\p{N}_]+')) AS w FROM (SELECT DISTINCT * FROM cut WHERE trim(sentence) <> '')),
num AS (SELECT *, row_number() OVER () AS k, len(w) AS n FROM sen WHERE len(w) >= CASE side WHEN 'd' THEN 6 ELSE 1 END),
tok AS (SELECT side, k, n, unnest(w) AS word FROM num),
shared AS (SELECT a.k AS a, b.k AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM tok a JOIN tok b ON a.word = b.word AND a.side = 'd' AND b.side = 'b' GROUP BY 1, 2)
SELECT x.id AS node_id, x.sentence, min(y.id) AS leaked_from FROM shared JOIN num x ON x.k = a JOIN num y ON y.k = b WHERE c >= 0.8::DOUBLE * (na + nb - c) GROUP BY 1, 2""")
def context_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents that repeat a benchmark sentence (Jaccard of word sets 0.8 or more)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return gate.context_leaks(d, b)


# structure

_MARGIN_SQL = f"""WITH {BLOCKS_SQL},
np AS (SELECT doc_id, count(*) AS n_pages FROM pages_ GROUP BY doc_id HAVING count(*) >= 2),
z AS (SELECT doc_id, trim(text) AS text, CASE WHEN y1 < 0.12 * 842.0 THEN 'top' WHEN y0 > 0.88 * 842.0 THEN 'bottom' END AS zone FROM blocks),
rep AS (SELECT DISTINCT doc_id, text FROM (SELECT doc_id, zone, text, count(*) AS n FROM z WHERE zone IS NOT NULL AND text <> '' GROUP BY ALL) JOIN np USING (doc_id)
  WHERE n >= greatest(3, floor(n_pages * 0.15)) OR regexp_matches(text, '(?i)^\\d{{1,4}}$|^page\\s*\\d{{1,4}}$|^\\d{{1,4}}\\s*\\|\\s*.*$'))"""


@query(_MARGIN_SQL + " SELECT doc_id, text FROM rep")
def header_footer_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repeated_margins(*blocks(spark, sf_dir))


@query(f"""WITH {BLOCKS_SQL} SELECT doc_id, list_sort(list(CAST(font_size AS DOUBLE)))[(count(*) // 2 + 1)::INT] AS base_size FROM blocks GROUP BY doc_id""")
def base_font_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.base_sizes(blocks(spark, sf_dir)[0])


@query(f"""WITH {BLOCKS_SQL}, c AS (SELECT *, CASE WHEN x1 - x0 > 420 THEN 0 WHEN x1 <= 320 THEN 1 WHEN x0 >= 280 THEN 2 ELSE 0 END AS col FROM blocks),
t AS (SELECT *, count(*) FILTER (col = 1) OVER p >= 2 AND count(*) FILTER (col = 2) OVER p >= 2 AS cols FROM c WINDOW p AS (PARTITION BY doc_id, page_number))
SELECT doc_id, page_number, block_id, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY CASE WHEN cols THEN col ELSE 0 END, y0, CASE WHEN cols THEN 0 ELSE x0 END, block_id) - 1 AS reading_pos FROM t""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.reading_order(*blocks(spark, sf_dir)).select("doc_id", F.col("page_number").cast("long").alias("page_number"), F.col("block_id").cast("long").alias("block_id"), F.col("reading_pos").cast("long").alias("reading_pos"))


_REBUILT_SQL = _MARGIN_SQL + """,
kept AS (SELECT b.* FROM blocks b LEFT JOIN rep r ON r.doc_id = b.doc_id AND r.text = trim(b.text)
  WHERE NOT coalesce((y1 < 0.12 * 842.0 OR y0 > 0.88 * 842.0) AND (r.text IS NOT NULL OR regexp_matches(trim(b.text), '(?i)^\\d{1,4}$|^page\\s*\\d{1,4}$')), false)),
base AS (SELECT doc_id, list_sort(list(CAST(font_size AS DOUBLE)))[(count(*) // 2 + 1)::INT] AS base FROM kept GROUP BY doc_id),
col AS (SELECT *, CASE WHEN x1 - x0 > 420 THEN 0 WHEN x1 <= 320 THEN 1 WHEN x0 >= 280 THEN 2 ELSE 0 END AS c FROM kept),
two AS (SELECT *, count(*) FILTER (c = 1) OVER p >= 2 AND count(*) FILTER (c = 2) OVER p >= 2 AS cols FROM col WINDOW p AS (PARTITION BY doc_id, page_number)),
ord AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, CASE WHEN cols THEN c ELSE 0 END, y0, CASE WHEN cols THEN 0 ELSE x0 END, block_id) AS no, trim(text) AS x,
  len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS words, is_bold AS bold FROM two),
opens AS (SELECT doc_id, no, words, x <> '' AND length(x) <= 150 AND (regexp_matches(x, '(?i)^(?:CHAPTER|Ch\\.)\\s+([0-9IVXLCDM]+|[A-Za-z]+)(?:\\s*[:.\\-—]\\s*(.*))?$') OR regexp_matches(x, '(?i)^PART\\s+([0-9IVXLCDM]+)(?:\\s*[:.\\-—]\\s*(.*))?$')
  OR regexp_matches(x, '(?i)^APPENDIX\\s+([0-9A-Z]+)(?:\\s*[:.\\-—]\\s*(.*))?$') OR regexp_matches(x, '^([0-9]{1,2})\\.\\s+([A-Z][A-Za-z0-9\\s,\\-—]{3,60})$')
  OR (font_size >= base * 1.5 AND bold AND words <= 10 AND ((upper(x) = x AND regexp_matches(x, '\\p{L}')) OR length(x) < 50))) AS o FROM ord JOIN base USING (doc_id))
SELECT doc_id, CAST(sum(words) AS BIGINT) AS total_words, 1 + count(*) FILTER (o AND no > 1) AS chapters, count(*) AS nodes FROM opens GROUP BY doc_id"""


@query(_REBUILT_SQL)
def rebuilt_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rebuilt from blocks: words, chapters and nodes."""
    return structure.rebuilt_totals(*blocks(spark, sf_dir))


@query("""SELECT doc_id, CASE WHEN length(trim(text)) < 60 THEN CASE WHEN doc_id % 3 > 0 THEN 'SCANNED_PAGE' ELSE 'TEXT_PAGE' END
  WHEN doc_id % 3 > 0 AND (doc_id % 10) / 10.0 >= 0.3 THEN 'MIXED_PAGE' ELSE 'TEXT_PAGE' END AS page_class FROM documents""")
def page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", scores.page_class(F.length(F.trim("text")), F.col("doc_id") % 3, (F.col("doc_id") % 10) / 10.0).alias("page_class"))


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.html_blocks(table(spark, sf_dir, "pages"))


@query("""WITH d AS (SELECT doc_id, regexp_replace(text, '\\n([^\\n]{1,40})\\n', chr(10) || chr(10) || '## \\1' || chr(10), 'g') AS text FROM documents),
l AS (SELECT doc_id, unnest(generate_series(1, len(xs))) AS pos, trim(unnest(xs)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS xs FROM d)),
m AS (SELECT *, length(regexp_extract(line, '^(#{1,6})\\s+', 1)) AS mark FROM l),
s AS (SELECT *, mark > 0 OR line = '' OR coalesce(lag(mark > 0) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM m),
i AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM s),
g AS (SELECT doc_id, island, min(pos) AS at_, max(mark) AS mark, string_agg(line, ' ' ORDER BY pos) AS joined, arg_min(line, pos) AS head FROM i WHERE line <> '' GROUP BY doc_id, island)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY at_) AS block_no, CASE WHEN mark > 0 THEN 'heading' ELSE 'text' END AS type, CASE WHEN mark > 0 THEN least(mark, 4) END AS heading_level,
  CAST(CASE WHEN mark > 0 THEN 18 - 2 * least(mark, 4) ELSE 11 END AS DOUBLE) AS font_size, CASE WHEN mark > 0 THEN trim(regexp_replace(head, '^#{1,6}\\s+', '')) ELSE joined END AS text FROM g""")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\n([^\n]{1,40})\n", "\n\n## $1\n").alias("text"))
    out = readers.text_blocks(d)
    return out.withColumns({"block_no": F.col("block_no").cast("long"), "heading_level": F.col("heading_level").cast("long"), "font_size": F.col("font_size").cast("double")})


@query("""WITH w AS (SELECT c_custkey AS page, unnest(string_split(c_name || ' in ' || c_mktsegment, ' ')) AS text, generate_subscripts(string_split(c_name || ' in ' || c_mktsegment, ' '), 1) AS pos FROM customer)
SELECT page, string_agg(text, ' ' ORDER BY pos) AS text, CAST(min(pos * 50) AS BIGINT) AS x0, CAST(max(pos * 50 + 40) AS BIGINT) AS x1 FROM w GROUP BY page""")
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.posexplode(F.split(F.concat_ws(" in ", "c_name", "c_mktsegment"), " ")).alias("p", "text"))
    w = c.select("page", (F.col("p") + 1).alias("pos"), (F.col("p") + 1).alias("word_num"), "text", ((F.col("p") + 1) * 50).alias("x"), F.lit(10).alias("y"), F.lit(40).alias("w"), F.lit(12).alias("h"), F.lit(90).alias("conf"))
    return readers.ocr_lines(w).select("page", "text", F.col("x0").cast("long").alias("x0"), F.col("x1").cast("long").alias("x1"))


# issues and records


@query("""WITH u AS (SELECT o_custkey AS k, o_orderkey AS v, o_totalprice AS price, 0 AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, 1 FROM orders WHERE o_orderkey % 5 = 0)
SELECT k AS custkey, v AS orderkey, price FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, v DESC) AS r FROM u) WHERE r = 1""")
def record_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))
    return issues.upsert(o.where(F.col("orderkey") % 2 == 0), o.where(F.col("orderkey") % 5 == 0), ["custkey"], "orderkey")


@query("""SELECT event_type, count(*) AS n FROM (
  SELECT user_id, event_type FROM events WHERE event_id % 3 = 0
  UNION ALL SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 1 AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 3 = 0 AND user_id % 2 = 0)) GROUP BY event_type""")
def insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    out = issues.insert_missing(e.where(F.col("event_id") % 3 == 0), e.where(F.col("event_id") % 3 == 1), ["user_id", "event_type"], among=F.col("user_id") % 2 == 0)
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


_CODES = ("NUMBER_MISMATCH", "BROKEN_REFERENCE", "contains_chinese ", "NEGATION_LOSS", "MISTRANSLATION", "POSSIBLE_TRUNCATION", "CONTENT_ADDITION", "URL_MISMATCH", "OMISSION", "EMPTY_TRANSLATION")


def found_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("order_index") % 10 + 1).cast("int"))
    return pairs(spark, sf_dir).select("node_id", "order_index", code.alias("issue_type"))


@query(f"""WITH {PAIRS_SQL}, i AS (SELECT node_id, order_index AS o, {list(_CODES)!r}[(order_index % 10 + 1)::INT] AS issue_type FROM pairs),
r AS (SELECT *, order_index_ok AS still FROM (SELECT *, o % 4 < 2 AS order_index_ok FROM i)),
c AS (SELECT *, upper(trim(issue_type)) IN ('NUMBER_MISMATCH', 'BROKEN_REFERENCE', 'CONTAINS_CHINESE', 'NEGATION_LOSS', 'URL_MISMATCH', 'EMPTY_TRANSLATION') AS sure FROM r)
SELECT node_id, issue_type, CASE WHEN sure THEN CASE WHEN still THEN 'OPEN' ELSE 'RESOLVED' END WHEN o % 7 = 1 THEN 'RESOLVED' ELSE 'OPEN' END AS resolution,
  CASE WHEN NOT sure AND o % 7 = 0 THEN 'MISSING_REVIEW' WHEN NOT sure AND o % 7 = 4 THEN 'REVIEW_ERROR' END AS qa_error FROM c""")
def issue_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of every kind; half of the codes remain (under the name that an alias means), reviews pass, fail, break, or pass without is_passed."""
    i, o = found_issues(spark, sf_dir), F.col("order_index")
    left = i.where(o % 4 < 2).select("node_id", issues.renamed(issues.plain_code(F.col("issue_type")), issues.ALIASES).alias("code"))
    status = F.when(o % 7 == 4, "ERROR").when(o % 7 == 5, "FAIL").otherwise("PASS")
    r = i.where(o % 7 > 0).select("node_id", status.alias("status"), (o % 7 == 1).alias("is_passed"), F.lit(1).alias("reviewed_at"))
    return issues.resolve(i, left, r).select("node_id", "issue_type", "resolution", "qa_error")


@query(f"""WITH {PAIRS_SQL} SELECT node_id, order_index % 5 = 0 OR {_has("source_text", "with")} AS is_stale FROM pairs""")
def invalidate_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    r = p.select("node_id", (F.col("order_index") % 5 == 0).alias("is_stale"))
    return issues.invalidate(r, p, spark.createDataFrame([("with",)], "source_term string")).select("node_id", "is_stale")


@query("""WITH r AS (SELECT user_id AS node_id, event_type AS project_id, ts, event_id, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_id % 7 <> 0)
SELECT project_id, count(*) AS reviewed, count(*) FILTER (value < 20) AS low, count(*) FILTER (value >= 20 AND value < 60) AS medium, count(*) FILTER (value >= 60) AS high,
  count(*) FILTER (event_id % 3 = 0) AS pass_count, count(*) FILTER (event_id % 3 = 1) AS fail_count, count(*) FILTER (event_id % 3 = 2) AS error_count FROM r WHERE n = 1 GROUP BY project_id""")
def semantic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("value") < 20, "LOW").when(F.col("value") < 60, "MEDIUM").otherwise("HIGH")
    status = F.element_at(F.array(*map(F.lit, ("PASS", "FAIL", "ERROR"))), (F.col("event_id") % 3 + 1).cast("int"))
    r = e.select(F.col("event_type").alias("project_id"), F.col("user_id").alias("node_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("review_id"), level.alias("risk_level"), status.alias("critic_status"), (F.col("event_id") % 7 == 0).alias("is_stale"))
    return issues.review_summary(r)


@query("""WITH e AS (SELECT DISTINCT l_orderkey // 100 AS b, l_orderkey AS k FROM lineitem WHERE l_orderkey % 9 <> 0), r AS (SELECT o_orderkey // 100 AS b, o_orderkey AS k, 1 AS n, o_orderkey % 11 <> 0 AS filled FROM orders WHERE o_orderkey % 10 <> 0)
SELECT coalesce(e.b, r.b) AS batch_id, count(*) FILTER (r.k IS NULL) AS missing, count(*) FILTER (e.k IS NULL) AS unknown, count(*) FILTER (r.n > 1) AS duplicated, count(*) FILTER (r.k IS NOT NULL AND NOT filled) AS empty,
  count(*) FILTER (r.k IS NULL OR e.k IS NULL OR r.n > 1 OR NOT filled) = 0 AS ok FROM e FULL JOIN r ON e.b = r.b AND e.k = r.k GROUP BY 1""")
def batch_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").where(F.col("l_orderkey") % 9 != 0).select(F.floor(F.col("l_orderkey") / 100).alias("batch_id"), F.col("l_orderkey").alias("node_id"))
    r = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 10 != 0)
    r = r.select(F.floor(F.col("o_orderkey") / 100).alias("batch_id"), F.col("o_orderkey").alias("node_id"), F.when(F.col("o_orderkey") % 11 != 0, "x").otherwise(" ").alias("text"))
    return issues.reconcile(e, r)


# caches, retrieval, mining, packing, lint, metrics


@query("""WITH m AS (SELECT sha256(trim(text)) AS h, max(doc_id) AS d FROM documents WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT doc_id, d AS cached_from, d IS NOT NULL AS cache_hit FROM documents LEFT JOIN m ON m.h = sha256(trim(text))""")
def tm_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", caches.content_hash(F.col("text")).alias("source_hash"), F.lit("s").alias("style_hash"), F.lit("g").alias("glossary_hash"), F.lit("v1").alias("prompt_version"))
    memory = d.where(F.col("doc_id") % 2 == 0).withColumn("created_at", F.col("doc_id")).withColumn("cached_text", F.col("doc_id").cast("string")).drop("doc_id")
    return caches.lookup(d, memory).select("doc_id", F.col("cached_text").cast("long").alias("cached_from"), "cache_hit")


def example_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("example_id"), F.when(F.col("item_id") % 3 == 0, "LEGAL").otherwise("GENERAL").alias("domain"), F.when(F.col("item_id") % 2 == 0, "paragraph").otherwise("heading").alias("node_type"),
        F.array(F.when(F.col("item_id") % 4 == 0, "FAITHFUL").otherwise("NATURAL")).alias("modes"), F.when(F.col("item_id") % 5 == 0, "formal").otherwise("plain").alias("register"), F.array(F.lit("sentence_split")).alias("patterns"), F.col("text").alias("source"),
    )


_SPLIT = "(regexp_matches(lower(text), '[.!?](.|\\n)*[.!?]') OR regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(then|after that|first)($|[^\\p{L}\\p{N}_])'))"


@query("""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'LEGAL' WHEN doc_id % 6 = 1 THEN 'GENERAL' ELSE 'GENERAL' END AS domain, CASE WHEN doc_id % 2 = 0 THEN 'FAITHFUL' ELSE 'NATURAL' END AS mode,
    len(regexp_extract_all(text, '\\S+')) AS n, CASE WHEN """ + _SPLIT + """ THEN 1 ELSE 0 END AS split FROM documents),
l AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'LEGAL' ELSE 'GENERAL' END AS domain, text, len(regexp_extract_all(text, '\\S+')) AS m FROM benchmark),
s AS (SELECT doc_id, item_id, text, 100 + CASE WHEN item_id % 2 = 0 THEN 30 ELSE 0 END + CASE WHEN (item_id % 4 = 0) = (mode = 'FAITHFUL') THEN 12 ELSE 0 END + 18 * split + greatest(0, 12 - floor(abs(n - m) / 4)) + CASE WHEN mode = 'FAITHFUL' AND item_id % 5 = 0 THEN 5 ELSE 0 END AS score
  FROM n JOIN l USING (domain)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY score DESC, item_id) AS one FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rank FROM o WHERE one = 1)
SELECT doc_id AS node_id, item_id AS example_id, CAST(score AS BIGINT) AS score, rank FROM r WHERE rank <= 4""")
def few_shot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = d.select(F.col("doc_id").alias("node_id"), F.when(F.col("doc_id") % 6 == 0, "LEGAL").when(F.col("doc_id") % 6 == 1, "POETRY").otherwise("GENERAL").alias("domain"), F.when(F.col("doc_id") % 2 == 0, "FAITHFUL").otherwise("NATURAL").alias("mode"), F.lit("paragraph").alias("node_type"), F.col("text").alias("source_text"))
    return retrieval.few_shot(n, example_library(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH w AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w,
    CASE WHEN regexp_matches(lower(text), '[,;]\\s*(and|but|yet|while|so)($|[^\\p{L}\\p{N}_])|(^|[^\\p{L}\\p{N}_])and($|[^\\p{L}\\p{N}_])') THEN 1 ELSE 0 END AS merge FROM documents),
s AS (SELECT q.doc_id AS node_id, m.doc_id AS memory_id, CAST(CASE WHEN m.doc_id % 2 = 0 THEN 70 ELSE 0 END + 61 + 12 * q.merge + least(20, 3 * len(list_intersect(q.w, m.w))) + greatest(0, 10 - floor(abs(len(q.w) - len(m.w)) / 4)) AS BIGINT) AS score
  FROM w q JOIN w m ON q.source = m.source WHERE q.doc_id % 100 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, memory_id) AS rank FROM s) WHERE rank <= 3""")
def style_memory_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search: queries are the documents whose id is divisible by 100, the memory is every document."""
    d = table(spark, sf_dir, "documents")
    same = [F.lit("BOOK").alias("document_type"), F.lit("NATURAL").alias("mode"), F.lit("paragraph").alias("node_type"), F.col("text").alias("source_text")]
    n = d.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("node_id"), F.col("source").alias("project_id"), F.lit("GENERAL").alias("domain"), *same)
    domain = F.when(F.col("doc_id") % 2 == 0, "GENERAL").otherwise("LEGAL")
    m = d.select(F.col("doc_id").alias("memory_id"), F.col("source").alias("project_id"), domain.alias("domain"), *same, F.lit("USER_APPROVED").alias("quality_status"), F.lit("PROJECT").alias("scope"), F.array(F.lit("sentence_merge")).alias("source_patterns"))
    return retrieval.style_memory(n, m).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT CASE WHEN item_id % 3 = 0 THEN 'LEGAL' ELSE 'GENERAL' END AS domain, count(*) AS examples FROM benchmark GROUP BY 1")
def library_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.library_counts(example_library(spark, sf_dir))


@query()
def rule_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that put one word for another, mined to rules."""
    n = lines(spark, sf_dir)
    e = n.select("project_id", "node_id", F.col("content").alias("before"), F.regexp_replace("content", r"\bthe\b", "this").alias("after")).where(F.col("before") != F.col("after"))
    return mining.mine_rules(e)


@query("""WITH o AS (SELECT user_id, event_type AS k, event_id, value >= 50 AS kept, user_id % 3 = 0 AS decided FROM events),
f AS (SELECT *, min(CASE WHEN kept OR decided THEN event_id END) OVER (PARTITION BY user_id, k) AS first_id FROM o)
SELECT CAST(user_id AS VARCHAR) AS project_id, k AS source_key, CASE WHEN any_value(decided) THEN 'Z' ELSE k END AS preferred, CAST(min(first_id) AS VARCHAR) AS first_node_id, count(*) AS occurrences,
  count(*) FILTER (kept AND decided) AS conflicts FROM f WHERE event_id >= first_id GROUP BY 1, 2""")
def ledger_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third user's names are decided to be rendered Z; renderings that keep the name are then conflicts."""
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("value") >= 50, F.concat(F.lit("a "), F.upper("event_type"), F.lit("."))).otherwise(F.concat(F.col("event_type"), F.lit("x")))
    o = e.select(F.col("user_id").cast("string").alias("project_id"), F.col("event_id").alias("order_index"), F.col("event_id").cast("string").alias("node_id"), F.col("event_type").alias("source_key"), text.alias("target_text"), F.when(F.col("user_id") % 3 == 0, "Z").alias("decided"))
    return mining.ledger(o)


_TOKENS_SQL = "CAST(greatest(1, floor(1.22::DOUBLE * len(regexp_extract_all(content, '\\S+')) + 0.22::DOUBLE * len(regexp_extract_all(content, '[.,;:!?()\\[\\]{{}}\"'']')) + 0.08::DOUBLE * len(regexp_extract_all(content, '[^\\x00-\\x7F]')) + 8)) AS BIGINT)".replace("{{}}", "{}")


@query("WITH RECURSIVE " + NODES_SQL.lstrip() + f""",
n AS (SELECT chapter_id, node_id, node_type, {_TOKENS_SQL} AS tokens, row_number() OVER (PARTITION BY chapter_id ORDER BY order_index) AS i FROM nodes WHERE NOT {_UNSHOWN}),
p AS (
  SELECT chapter_id, node_id, i, tokens, CAST(1 AS BIGINT) AS chunk_no, tokens AS held, tokens > 400 OR coalesce(node_type, '') IN ('table', 'footnote') AS closed FROM n WHERE i = 1
  UNION ALL
  SELECT n.chapter_id, n.node_id, n.i, n.tokens, CASE WHEN fresh THEN p.chunk_no + 1 ELSE p.chunk_no END, CASE WHEN fresh THEN n.tokens ELSE p.held + n.tokens END, alone
  FROM p JOIN (SELECT *, tokens > 400 OR coalesce(node_type, '') IN ('table', 'footnote') AS alone, coalesce(node_type, '') = 'heading' AS head FROM n) n ON n.chapter_id = p.chapter_id AND n.i = p.i + 1, LATERAL (SELECT p.closed OR n.alone OR n.head OR p.held + n.tokens > 400 AS fresh) x)
SELECT chapter_id, node_id, chunk_no, tokens FROM p""")
def chunk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(typed(spark, sf_dir), target=400)


@query()
def split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.split_long(lines(spark, sf_dir), 120)


@query()
def style_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the lint over renderings seeded with phrases, by rule."""
    phrases = ("Việc này được làm bởi họ.", "Cô ấy nói rằng cô ấy đi.", "Anh đi một cách nhanh chóng.", "Nó của của tôi.", "Các sự chậm trễ.", "Ai cũng không biết.")
    i = (F.col("order_index") % len(phrases) + 1).cast("int")
    n = pairs(spark, sf_dir).select("node_id", F.lit("He said so.").alias("source_text"), F.concat_ws(" ", F.element_at(F.array(*map(F.lit, phrases)), i), "target_text").alias("target_text"))
    return lint.lint(n).groupBy("rule", "type", "severity").agg(F.count("*").alias("findings"))


@query("""WITH r AS (SELECT doc_id, lang, regexp_matches(text, '[#*$%&|]') AS p, quality = 0 AS a FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM r GROUP BY lang)
SELECT *, coalesce(round(tp / nullif(tp + fp, 0), 4), 0) AS precision, coalesce(round(tp / nullif(tp + fn, 0), 4), 0) AS recall, coalesce(round(fp / nullif(fp + tn, 0), 4), 0) AS false_positive_rate FROM c""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.classification(d.select("lang", F.col("text").rlike(r"[#*$%&|]").alias("predicted"), (F.col("quality") == 0).alias("actual")), ["lang"])


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("domain"), (k % 7).cast("double").alias("semantic_accuracy"), (k % 6).cast("double").alias("naturalness"), F.when(k % 3 == 0, 4.0).alias("terminology"), F.lit(5.0).alias("contextual_coherence"), F.lit(None).cast("double").alias("register"),
        (k % 4 == 0).alias("rewrite_applied"), (k % 97 == 0).alias("semantic_critical_error"), (k % 50 == 0).alias("hard_glossary_error"), (k % 20 == 0).alias("deterministic_error"), (k % 3 + 1).alias("provider_calls"), (k % 900).alias("request_tokens"),
        (k % 1000).cast("double").alias("latency_ms"), F.when(k % 2 == 0, k % 5).alias("lint_warnings"), (k % 90 + 10).alias("word_count"),
    )


@query("""SELECT o_orderpriority AS domain, count(*) AS samples, round(avg(CASE WHEN o_orderkey % 7 BETWEEN 1 AND 5 THEN o_orderkey % 7 END), 4) AS semantic_accuracy_mean, round(avg(CASE WHEN o_orderkey % 6 BETWEEN 1 AND 5 THEN o_orderkey % 6 END), 4) AS naturalness_mean,
  round(count(*) FILTER (o_orderkey % 6 >= 4) / count(*), 4) AS naturalness_pass_rate, round(count(*) FILTER (o_orderkey % 97 = 0) / count(*), 4) AS semantic_critical_error_rate, CAST(sum(o_orderkey % 3 + 1) AS BIGINT) AS provider_calls,
  round(median(o_orderkey % 1000), 3) AS median_latency_ms, round(sum(o_orderkey % 5) FILTER (o_orderkey % 2 = 0) * 1000 / sum(o_orderkey % 90 + 10) FILTER (o_orderkey % 2 = 0), 3) AS lint_warnings_per_1000_words
FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.summarize(eval_rows(spark, sf_dir), ["domain"])
    return m.select("domain", "samples", "semantic_accuracy_mean", "naturalness_mean", "naturalness_pass_rate", "semantic_critical_error_rate", "provider_calls", "median_latency_ms", "lint_warnings_per_1000_words")


@query("""WITH v AS (SELECT CASE c_custkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'TIE' WHEN 3 THEN 'TIE' ELSE 'X' END AS p, CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END AS s FROM customer)
SELECT count(*) AS rated_samples, round(count(*) FILTER (s <> '' AND p = s) / count(*), 4) AS candidate_preference_rate, round(count(*) FILTER (p = 'TIE') / count(*), 4) AS tie_rate, round(count(*) FILTER (s <> '' AND p IN ('A', 'B') AND p <> s) / count(*), 4) AS baseline_preference_rate FROM v WHERE p <> 'X'""")
def ab_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return metrics.preferences(table(spark, sf_dir, "customer").select(F.element_at(F.array(*map(F.lit, (" a", "B", "draw", "TIE", "x"))), (k % 5 + 1).cast("int")).alias("preference"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "b").alias("candidate_side")))


@query("""WITH r AS (SELECT o_orderpriority AS domain, o_orderkey AS k FROM orders),
m AS (SELECT domain, count(*) AS n, count(*) FILTER (k % 97 = 0) AS old, count(*) FILTER (k % 97 = 0 OR k % 1000 % 10 = 3) AS new, median(k % 3 + 1) AS calls FROM r GROUP BY ROLLUP (domain))
SELECT domain, concat_ws(',', CASE WHEN round(new / n, 4) > round(old / n, 4) THEN 'semantic' END, CASE WHEN round(calls, 3) > 1.5 THEN 'provider_calls' END) AS failed_checks, NOT (round(new / n, 4) > round(old / n, 4) OR round(calls, 3) > 1.5) AS passed FROM m""")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = eval_rows(spark, sf_dir)
    worse = rows.withColumn("semantic_critical_error", F.col("semantic_critical_error") | (F.col("latency_ms") % 10 == 3))
    return metrics.regression(metrics.summarize(rows, ["domain"]), metrics.summarize(worse, ["domain"]), "domain", most_calls=1.5)


@query()
def provider_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes the cache lacks, rendered by the deterministic provider in batches, gated, with the decision."""
    n = pairs(spark, sf_dir).select("project_id", "chapter_id", "node_id", "order_index", "source_text")
    return provider.translate_and_gate(n).groupBy("decision").agg(F.count("*").alias("nodes"))


# events


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.tumbling(ev.timed(table(spark, sf_dir, "events")))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM i GROUP BY user_id, k""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.sessions(ev.timed(table(spark, sf_dir, "events")))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 4 = 0) GROUP BY event_type")
def events_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return ev.deduplicated(e.union(e.where(F.col("event_id") % 4 == 0))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, max(ts) AS last_ts, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY ALL")
def telemetry_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.last_values(table(spark, sf_dir, "events"))
