"""Queries over processes of several steps (assurance, publication, assembly, splitting), with SQL that unrolls them.

Models are column expressions of the texts, so the SQL says the same answers; the process around them is what is compared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import canonical
from lexiloom.operators import assurance, nodes, packing
from lexiloom.plans.fixtures import LINES_SQL, PAIRS_SQL, TERMS, lines, pairs, term_list
from lexiloom.plans.queries_tables import _UNSHOWN, NODES_SQL, _has, typed
from lexiloom.plans.queries_text import _SENSITIVE_SQL, _word_sql
from lexiloom.session import table
from lexiloom.sources import readers
from lexiloom.sources.store import Store, save_document
from lexiloom.stages import STAGED, shared_dir
from lexiloom.streaming import lifecycle

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query, and its SQL where there is one."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# assurance and publication

POLICY = assurance.Policy(language="en", codes=("LENGTH_ANOMALY", "CONTENT_ADDITION", "QUOTE_UNBALANCED"))
LOCKED = (("avec", "avec"), ("una", "unax"))


def _struct(status: Column, score: Column, kind: str, names: tuple[str, ...]) -> Column:
    """An answer: its status and score, an issue of the kind where it is a FAIL, no answer where the status is null."""
    issue = F.struct(F.lit(kind).alias("type"), F.lit("WARNING").alias("severity"), F.lit("by rule").alias("message"))
    found = F.when(status == "FAIL", F.array(issue)).otherwise(F.array().cast("array<struct<type:string,severity:string,message:string>>"))
    last = {"failed_checks": F.array().cast("array<string>")} if "failed_checks" in names else {}
    return F.when(status.isNotNull(), F.struct(status.alias("status"), score.alias("score"), found.alias(names[0]), *(v.alias(k) for k, v in last.items())))


def _critic() -> Column:
    s, c = F.col("source_text"), F.col("candidate")
    status = F.when(F.length(s) % 17 == 0, F.lit(None)).when((F.length(c) * 10 < F.length(s) * 6) | c.contains("漢"), "FAIL").otherwise("PASS")
    return _struct(status, F.when(status == "FAIL", 0.4).otherwise(0.9), "SEMANTIC_OMISSION", ("errors",))


def _repair() -> Column:
    s, c = F.col("source_text"), F.col("candidate")
    more = F.substr(s, F.lit(1), F.length(c) + F.floor((F.length(s) + 2) / 3).cast("int"))
    return F.when(F.length(s) % 13 == 0, "").when(F.length(c) * 10 < F.length(s) * 6, more).otherwise(s)


def _style() -> Column:
    c = F.col("candidate")
    n = F.length(c)
    status = F.when(n % 19 == 0, F.lit(None)).when((n % 11 == 0) | (c.contains("e ") & (n % 2 == 0)), "FAIL").otherwise("PASS")
    return _struct(status, F.when(n % 11 == 0, 0.3).when(status == "FAIL", 0.7).otherwise(0.9), "COLLOCATION", ("issues", "failed_checks"))


def _rewrite() -> Column:
    c = F.col("candidate")
    return F.when(F.length(c) % 7 == 0, F.lit(None)).when(F.length(c) % 5 == 0, F.substr(c, F.lit(1), F.floor(F.length(c) / 2).cast("int"))).otherwise(F.replace(c, F.lit("e "), F.lit("e_")))


MODELS = assurance.Models(
    critic=assurance.as_step("review", _critic),
    repair=assurance.as_step("repaired", _repair),
    style=assurance.as_step("style", _style),
    rewrite=assurance.as_step("rewritten", _rewrite),
    compare=lambda df: df.withColumn("first", F.when(F.length("candidate") % 3 == 0, "A").otherwise("TIE")).withColumn("second", F.when(F.length("candidate") % 6 == 0, "B").otherwise("A")),
)


def candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows, cache): the seeded pairs as candidates, and reviews held of the clean kind 0, some of them stale."""
    kind = F.col("kind")
    rows = pairs(spark, sf_dir).select(
        "node_id", "order_index", "source_text", F.col("target_text").alias("candidate"), F.when(kind % 5 == 0, "table").otherwise("paragraph").alias("kind"),
        (kind % 3).cast("int").alias("previous_repairs"), F.when(kind >= 6, 3).otherwise(0).alias("entities"), (kind == 11).alias("trusted"), (kind == 0).alias("_held"),
    )
    known = rows.where("_held")
    held = assurance.signed(known, POLICY, keep=("order_index",))
    fails = F.col("order_index") % 2 == 1
    none = F.array().cast(assurance.ERRORS)
    cache = held.select("node_id", "signature", F.when(fails, "FAIL").otherwise("PASS").alias("status"), F.lit(0.5).alias("score"), F.lit(0.2).alias("risk"), F.lit("LOW").alias("level"), none.alias("errors"), (F.col("order_index") % 5 == 0).alias("stale"))
    return rows.drop("_held", "order_index"), cache


def _n_gate(s: str, t: str) -> tuple[str, str]:
    """(errors, all issues) of the gate as SQL counts."""
    asks = lambda x: f"len(regexp_extract_all(regexp_replace(trim({x}), '(?i)https?://[^\\s)\\]}}]+|www\\.[^\\s)\\]}}]+', ' ', 'g'), '\\?'))"
    marks = lambda x: f"len(regexp_extract_all({x}, '[\"“”]'))"
    off = f"(({marks(t)} % 2 = 1 AND {marks(s)} % 2 = 0) OR (regexp_matches(trim({s}), '^[\"“]') AND NOT regexp_matches(trim({t}), '^[\"“–—-]') AND regexp_matches(trim({t}), '^[^\"“”]+[,.!?…]\\s*[\"”]')))"
    errors = f"(CASE WHEN trim({t}) = '' THEN 1 ELSE CAST({asks(t)} > {asks(s)} AS INT) + CAST({off} AS INT) END)"
    warns = f"(CASE WHEN trim({t}) <> '' AND length(trim({s})) > 100 AND (length(trim({t})) / length(trim({s})) < 0.25 OR length(trim({t})) / length(trim({s})) > 3.5) THEN 1 ELSE 0 END)"
    return errors, warns


_RISK = (
    "CAST(round(least(1.0, 0.05 + " + " + ".join(f"CASE WHEN {_word_sql('s', w)} THEN {x} ELSE 0 END" for w, x in _SENSITIVE_SQL)
    + " + CASE WHEN kind % 5 = 0 THEN 0.25 ELSE 0 END + least(0.30, 0.18 * (kind % 3)) + CASE WHEN warns > 0 THEN 0.16 ELSE 0 END + CASE WHEN kind >= 6 THEN 0.10 ELSE 0 END"
    + " + CASE WHEN s <> '' AND c <> '' AND abs(greatest(1, len(regexp_extract_all(s, '[.!?]+'))) - greatest(1, len(regexp_extract_all(c, '[.!?]+')))) >= 2 THEN 0.14 ELSE 0 END), 3) AS DOUBLE)"
)
_E, _W = _n_gate("s", "c")
_CRITIC = "CASE WHEN length(s) % 17 = 0 THEN 'ERROR' WHEN length(c) * 10 < length(s) * 6 OR contains(c, '漢') THEN 'FAIL' ELSE 'PASS' END"
_REPAIR = "CASE WHEN length(s) % 13 = 0 THEN '' WHEN length(c) * 10 < length(s) * 6 THEN substr(s, 1, length(c) + (length(s) + 2) // 3) ELSE s END"
_STYLE = "CASE WHEN length(c) % 19 = 0 THEN 'ERROR' WHEN length(c) % 11 = 0 OR (contains(c, 'e ') AND length(c) % 2 = 0) THEN 'FAIL' ELSE 'PASS' END"
_STYLE_SCORE = "CASE WHEN length(c) % 19 = 0 THEN NULL WHEN length(c) % 11 = 0 THEN 0.3 WHEN contains(c, 'e ') AND length(c) % 2 = 0 THEN 0.7 ELSE 0.9 END"
_BROKEN = " OR ".join(f"({_has('s', k)} AND NOT {_has('c', t)})" for k, t in LOCKED)


def _passes(name: str, start: str, repairs: int) -> str:
    """CTEs that play the passes of review and repair over `start` (node_id, s, c, kind, errs, warns): name(node_id, c, approved, status, n_errors, repairs, calls)."""
    out, ends = [], []
    for i in range(repairs + 1):
        live = start if i == 0 else f"{name}_l{i}"
        out.append(f"{name}_r{i} AS (SELECT *, {_CRITIC} AS review FROM {live})")
        out.append(f"""{name}_e{i} AS (SELECT *, CASE WHEN review = 'PASS' AND errs = 0 THEN 'PASS' WHEN review = 'ERROR' OR {i} = {repairs} THEN CASE WHEN errs > 0 THEN 'FAIL' ELSE review END END AS fin,
  CASE WHEN errs > 0 THEN errs + warns ELSE 0 END + CASE WHEN review = 'FAIL' THEN 1 ELSE 0 END AS n_diag FROM {name}_r{i})""")
        ends.append(f"SELECT node_id, c, fin = 'PASS' AS approved, fin AS status, CASE WHEN fin = 'PASS' THEN 0 ELSE n_diag END AS n_errors, {i} AS repairs, {i + 1} AS calls FROM {name}_e{i} WHERE fin IS NOT NULL")
        if i < repairs:
            out.append(f"{name}_m{i} AS (SELECT node_id, s, kind, n_diag, {_REPAIR} AS c FROM {name}_e{i} WHERE fin IS NULL)")
            out.append(f"{name}_g{i} AS (SELECT *, {_E} AS errs, {_W} AS warns FROM {name}_m{i})")
            ends.append(f"SELECT node_id, c, false, 'FAIL', n_diag + errs + warns, {i + 1}, {i + 1} FROM {name}_g{i} WHERE errs > 0")
            out.append(f"{name}_l{i + 1} AS (SELECT node_id, s, c, kind, errs, warns FROM {name}_g{i} WHERE errs = 0)")
    return ", ".join(out) + f", {name} AS ({' UNION ALL '.join(ends)})"


_ASSURED = f"""WITH {PAIRS_SQL},
rows_ AS (SELECT node_id, order_index, kind, source_text AS s, target_text AS c FROM pairs),
gated AS (SELECT *, {_E} AS errs, {_W} AS warns, {_BROKEN} AS broken FROM rows_),
risky AS (SELECT *, {_RISK} >= 0.35 AS asked FROM gated WHERE NOT broken AND kind <> 11),
routed AS (SELECT *, CASE WHEN errs > 0 AND NOT asked THEN 'GATE' WHEN kind = 0 AND order_index % 5 <> 0 AND errs = 0 THEN 'CACHE' WHEN NOT asked THEN 'LOW_RISK' ELSE 'CRITIC' END AS route FROM risky),
open_ AS (SELECT node_id, s, c, kind, errs, warns FROM routed WHERE route = 'CRITIC'),
{_passes("looped", "open_", 2)},
meaning AS (
  SELECT node_id, c, false AS approved, 'FAIL' AS status, errs + warns AS n_errors, 0 AS repairs, 0 AS calls, false AS from_cache FROM routed WHERE route = 'GATE'
  UNION ALL SELECT node_id, c, order_index % 2 = 0, CASE WHEN order_index % 2 = 1 THEN 'FAIL' ELSE 'PASS' END, 0, 0, 0, true FROM routed WHERE route = 'CACHE'
  UNION ALL SELECT node_id, c, true, 'NOT_REQUIRED', 0, 0, 0, false FROM routed WHERE route = 'LOW_RISK'
  UNION ALL SELECT *, false FROM looped),
"""
_PUBLISHED = f"""{_ASSURED}
styled AS (SELECT m.*, s, kind, {_STYLE} AS style, {_STYLE_SCORE} AS score FROM (SELECT meaning.*, gated.s, gated.kind FROM meaning JOIN gated ON meaning.node_id = gated.node_id WHERE approved) m),
rewriting AS (SELECT node_id, s, kind, repairs, calls, from_cache, c AS original, status AS st, n_errors AS ne,
  trim(CASE WHEN length(c) % 7 = 0 THEN '' WHEN length(c) % 5 = 0 THEN substr(c, 1, length(c) // 2) ELSE replace(c, 'e ', 'e_') END) AS c FROM styled WHERE style = 'FAIL' AND score >= 0.55),
written AS (SELECT *, {_E} AS errs, {_W} AS warns, {_BROKEN} AS broken, {_STYLE} AS style, {_STYLE_SCORE} AS score FROM rewriting WHERE c <> ''),
again AS (SELECT node_id, s, c, kind, errs, warns FROM written),
{_passes("forced", "again", 0)},
checked AS (SELECT w.*, f.status AS fst, f.n_errors AS fne, f.calls AS fcalls, w.errs = 0 AND NOT broken AND f.approved AND style = 'PASS' AS good FROM written w JOIN forced f ON w.node_id = f.node_id),
ends AS (
  SELECT node_id, c AS text, 'NEEDS_REVIEW' AS publication, 'FAIL' AS status, 1 AS n_errors, 'NOT_RUN' AS style_status, NULL AS style_score, 0 AS rewrites, false AS rewrite_success, 0 AS repairs, 0 AS calls, 0 AS style_calls, false AS from_cache FROM gated WHERE broken
  UNION ALL SELECT node_id, c, 'APPROVED', 'NOT_REQUIRED', 0, 'NOT_RUN', NULL, 0, false, 0, 0, 0, true FROM gated WHERE NOT broken AND kind = 11
  UNION ALL SELECT node_id, c, 'NEEDS_REVIEW', status, n_errors, 'NOT_RUN', NULL, 0, false, repairs, calls, 0, from_cache FROM meaning WHERE NOT approved
  UNION ALL SELECT node_id, c, CASE WHEN style = 'PASS' THEN 'APPROVED' ELSE 'NEEDS_REVIEW' END, status, n_errors, style, score, 0, false, repairs, calls, 1, from_cache FROM styled WHERE NOT (style = 'FAIL' AND score >= 0.55)
  UNION ALL SELECT node_id, original, 'NEEDS_REVIEW', st, ne, 'ERROR', NULL, 1, false, repairs, calls, 1, from_cache FROM rewriting WHERE c = ''
  UNION ALL SELECT node_id, c, 'NEEDS_REVIEW', CASE WHEN broken THEN 'FAIL' ELSE fst END, fne + CAST(broken AS INT), style, score, 1, false, 0, fcalls, 2, false FROM checked WHERE NOT good
  UNION ALL SELECT node_id, c, CASE WHEN length(original) % 6 = 0 THEN 'NEEDS_REVIEW' ELSE 'APPROVED' END, fst, fne, CASE WHEN length(original) % 6 = 0 THEN 'FAIL' ELSE 'PASS' END, score, 1, length(original) % 6 <> 0, 0, fcalls, 4, false FROM checked WHERE good)
SELECT node_id, md5(text) AS text_md5, publication, publication = 'APPROVED' AS approved, status, CAST(n_errors AS INTEGER) AS n_errors, style_status, CAST(style_score AS DOUBLE) AS style_score, rewrites, rewrite_success, repairs, calls, style_calls, from_cache FROM ends"""


@query(f"{_ASSURED} done AS (SELECT * FROM meaning) SELECT node_id, md5(c) AS text_md5, approved, status, CAST(n_errors AS INTEGER) AS n_errors, repairs, calls, from_cache FROM done")
def assured_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate, risk, cache and the bounded loop of review and repair over every pair whose locked names are kept."""
    rows, cache = candidates(spark, sf_dir)
    locked = spark.createDataFrame(LOCKED, "source_key string, target string")
    told = assurance.names_lost(rows.where(~F.col("trusted")), locked)
    # a generator, since a filter would be pushed below the texts, which it would build again
    left = told.withColumn("_kept", F.explode(F.when(~F.col("broken"), F.array(F.lit(True))))).drop("broken", "_kept")
    out = assurance.evaluate(left, MODELS, POLICY, cache)
    return out.select("node_id", F.md5("candidate").alias("text_md5"), "approved", "status", F.size("errors").alias("n_errors"), "repairs", "calls", "from_cache")


@query(_PUBLISHED)
def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every pair: locked names, trusted memory, meaning, style, one rewrite, three rechecks, the original's veto."""
    rows, cache = candidates(spark, sf_dir)
    locked = spark.createDataFrame(LOCKED, "source_key string, target string")
    out = assurance.publish(rows, MODELS, locked, POLICY, cache, shown=F.md5)
    return out.select("node_id", F.col("text").alias("text_md5"), "publication", "approved", "status", F.size("errors").alias("n_errors"), "style_status", "style_score", "rewrites", "rewrite_success", "repairs", "calls", "style_calls", "from_cache")


# packing by the assembled request

CONTEXTS, FIXED, WINDOW, MOST_SOURCE = (260, 120, 30), 150, 1200, 420


def _sql_counts(text: str) -> str:
    """Words, punctuation and non-ASCII characters of a SQL text as (w, p, x)."""
    return f"len(regexp_extract_all({text}, '\\S+')) AS w, len(regexp_extract_all({text}, '[.,;:!?()\\[\\]{{}}\"'']')) AS p, len(regexp_extract_all({text}, '[^\\x00-\\x7F]')) AS x".replace("{{}}", "{}")


def _sql_tokens(w: str, p: str, x: str) -> str:
    return f"CAST(greatest(1, floor(1.22::DOUBLE * ({w}) + 0.22::DOUBLE * ({p}) + 0.08::DOUBLE * ({x}) + 8)) AS BIGINT)"


def _entry_counts(i: int, t: str) -> tuple[int, int]:
    entry = f'{{"source_term": "{t}", "preferred_target": "{t if i % 2 else t + "x"}"}}'
    return len(entry.split()), sum(c in ".,;:!?()[]{}\"'" for c in entry)


_OF_TERMS = [" + ".join(f"((mask >> {i}) & 1) * {_entry_counts(i, t)[k]}" for i, t in enumerate(TERMS)) for k in (0, 1)]
_SOURCE = _sql_tokens("w + 2", "p + 1 + size", "x")
_REST = f"""{FIXED} + {_sql_tokens(f"CASE WHEN mask = 0 THEN 1 ELSE {_OF_TERMS[0]} END", f"{_OF_TERMS[1]} + 2 + greatest(0, bit_count(mask) - 1)", "0")}
  + source + greatest(320, least(1400, CAST(floor(source * 1.35::DOUBLE) AS BIGINT) + 128)) + {max(220, int(WINDOW * 0.06))}"""
_LEVEL = f"CASE WHEN source > {MOST_SOURCE} THEN -1 " + " ".join(f"WHEN rest + {c} <= {WINDOW} THEN {i}" for i, c in enumerate(CONTEXTS)) + " ELSE -1 END"


def _request_sql(row: str) -> str:
    """row (with w, p, x, size, mask) and its source, rest and level."""
    return f"(SELECT *, {_LEVEL} AS level FROM (SELECT *, {_REST} AS rest FROM (SELECT *, {_SOURCE} AS source FROM ({row}))))"


@query("WITH RECURSIVE " + NODES_SQL.lstrip() + f""",
shown AS (SELECT chapter_id, node_id, coalesce(lower(node_type), 'paragraph') AS kind, content, order_index FROM nodes WHERE NOT {_UNSHOWN}),
n AS (
  SELECT chapter_id, node_id, kind, row_number() OVER (PARTITION BY chapter_id ORDER BY order_index) AS i, {" + ".join(f"CASE WHEN {_has('content', t)} THEN {1 << i} ELSE 0 END" for i, t in enumerate(TERMS))} AS mask,
    {_sql_counts("block")} FROM (SELECT *, '{{ "node_id": ' || CAST(to_json(node_id) AS VARCHAR) || ', "type": ' || CAST(to_json(kind) AS VARCHAR) || ', "text": ' || CAST(to_json(content) AS VARCHAR) || ' }}' AS block FROM shown)),
one AS (SELECT * FROM {_request_sql("SELECT *, 1 AS size FROM n")}),
r AS (
  SELECT chapter_id, node_id, i, CAST(1 AS BIGINT) AS chunk_no, w, p, x, 1 AS size, mask, source, rest, level, kind IN ('table', 'footnote') OR level < 0 AS closed FROM one WHERE i = 1
  UNION ALL
  SELECT chapter_id, node_id, i, CASE WHEN fresh THEN chunk_no + 1 ELSE chunk_no END, CASE WHEN fresh THEN nw ELSE w END, CASE WHEN fresh THEN np ELSE p END, CASE WHEN fresh THEN nx ELSE x END, CASE WHEN fresh THEN 1 ELSE size END, CASE WHEN fresh THEN nmask ELSE mask END,
    CASE WHEN fresh THEN ns ELSE source END, CASE WHEN fresh THEN nr ELSE rest END, CASE WHEN fresh THEN nl ELSE level END, kind IN ('table', 'footnote') OR (fresh AND nl < 0)
  FROM (
    SELECT *, closed OR kind IN ('table', 'footnote', 'heading') OR level < 0 AS fresh FROM {_request_sql("SELECT n.chapter_id, n.node_id, n.i, n.kind, r.chunk_no, r.closed, r.w + n.w AS w, r.p + n.p AS p, r.x + n.x AS x, r.size + 1 AS size, r.mask | n.mask AS mask, n.w AS nw, n.p AS np, n.x AS nx, n.mask AS nmask, n.source AS ns, n.rest AS nr, n.level AS nl FROM r JOIN one n ON n.chapter_id = r.chapter_id AND n.i = r.i + 1")})),
last AS (SELECT chapter_id, chunk_no, arg_max(source, i) AS source, arg_max(rest, i) AS rest, arg_max(level, i) AS level FROM r GROUP BY ALL)
SELECT r.chapter_id, r.node_id, r.chunk_no, last.source AS source_tokens, last.rest + CASE last.level WHEN 0 THEN {CONTEXTS[0]} WHEN 1 THEN {CONTEXTS[1]} ELSE {CONTEXTS[2]} END AS total_tokens, CAST(last.level AS BIGINT) AS level
FROM r JOIN last ON r.chapter_id = last.chapter_id AND r.chunk_no = last.chunk_no""")
def assembled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of nodes by the request that they would make, with the context that the chunk's request has room for."""
    g = term_list(spark).select("source_term", F.col("target_term").alias("target"))
    return packing.pack_assembled(typed(spark, sf_dir), g, CONTEXTS, FIXED, WINDOW, MOST_SOURCE)


# rendering and contents

_LEVELS = "CASE WHEN length(content) % 7 = 0 THEN NULL ELSE length(content) % 7 END"


def _laid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with levels of headings, cells of tables and what else a type has, all from their texts."""
    c, even = F.col("content"), F.col("order_index") % 2 == 0
    extra = {"level": F.nullif(F.length(c) % 7, F.lit(0)), "source_text": c, "target_text": F.when(F.col("order_index") % 3 == 0, F.concat(F.lit("& "), c)), "rows": F.when(even, F.array(F.slice(F.split(c, " "), 1, 2), F.slice(F.split(c, " "), 3, 2)))}
    more = {"asset": F.concat("chapter_id", F.lit(".png")), "caption": F.when(even, F.substring(c, 1, 9)), "number": (F.col("order_index") % 4).cast("string"), "language": F.when(even, F.lit("py"))}
    return typed(spark, sf_dir).withColumns(extra | more)


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_BODY = _ESC.format("CASE WHEN order_index % 3 = 0 AND content <> '' THEN '& ' || content ELSE content END")


def _cells(tag: str, at: int) -> str:
    return f"'<tr>' || array_to_string(list_transform(list_slice(string_split(content, ' '), {at}, {at} + 1), lambda x: '<{tag}>' || {_ESC.format('x')} || '</{tag}>'), '') || '</tr>'"


@query(f"""WITH {NODES_SQL}, b AS (SELECT *, coalesce(node_type, '') AS kind, ' id="' || node_id || '"' AS at_, {_BODY} AS body, coalesce({_LEVELS}, 1) AS lvl FROM nodes)
SELECT node_id, md5(CASE kind WHEN 'heading' THEN '<h' || lvl || at_ || '>' || body || '</h' || lvl || '>' WHEN 'quote' THEN '<blockquote' || at_ || '><p>' || body || '</p></blockquote>'
  WHEN 'image' THEN '<figure' || at_ || '><img src="' || chapter_id || '.png">' || CASE WHEN order_index % 2 = 0 AND substr(content, 1, 9) <> '' THEN '<figcaption>' || {_ESC.format("substr(content, 1, 9)")} || '</figcaption>' ELSE '' END || '</figure>'
  WHEN 'footnote' THEN '<div class="footnote"' || at_ || '><sup>' || order_index % 4 || '</sup> ' || body || '</div>'
  WHEN 'code_block' THEN '<pre' || at_ || '><code class="language-' || CASE WHEN order_index % 2 = 0 THEN 'py' ELSE 'text' END || '">' || body || '</code></pre>'
  WHEN 'horizontal_rule' THEN '<hr>' WHEN 'page_break_hint' THEN '<div class="page-break"></div>'
  ELSE CASE WHEN kind = 'table' AND order_index % 2 = 0 THEN '<table' || at_ || '>' || {_cells("th", 1)} || {_cells("td", 3)} || '</table>' ELSE '<p' || at_ || '>' || body || '</p>' END END) AS html_md5 FROM b""")
def rendered_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node as HTML of its type."""
    return readers.render(_laid(spark, sf_dir)).select("node_id", F.md5("html").alias("html_md5"))


@query(f"""WITH {NODES_SQL}, h AS (SELECT node_id, project_id, chapter_id, order_index, coalesce({_LEVELS}, 2) AS level FROM nodes WHERE node_type = 'heading'),
p AS (SELECT h.node_id, arg_max(p.node_id, p.order_index) AS parent FROM h JOIN h p ON p.chapter_id = h.chapter_id AND p.project_id = h.project_id AND p.order_index < h.order_index AND p.level < h.level GROUP BY h.node_id)
SELECT h.node_id, CAST(level AS INTEGER) AS level, coalesce(parent, chapter_id) AS parent_id FROM h LEFT JOIN p ON p.node_id = h.node_id""")
def contents_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every heading with its parent: the nearest heading before it of a lower level, or its chapter."""
    return readers.contents(_laid(spark, sf_dir)).select("node_id", "level", "parent_id")


# neighbours and signatures

_COST = "greatest(1, CAST(floor((len(regexp_extract_all(content, '\\S+')) + len(regexp_extract_all(CASE WHEN order_index % 3 = 0 THEN '& ' || content ELSE '' END, '\\S+'))) * 1.45::DOUBLE) AS BIGINT))"
_PICK = "CASE WHEN len({0}) >= {1} AND (len(ids) = 0 OR spent + {0}[{1}].cost <= 120) THEN"


def _budgeted(n: int) -> str:
    """CTEs b0 to bn that take the entries of a list one after the other."""
    out = ["b0 AS (SELECT node_id, found, CAST([] AS VARCHAR[]) AS ids, CAST(0 AS BIGINT) AS spent FROM f)"]
    for i in range(1, n + 1):
        pick = _PICK.format("found", i)
        out.append(f"b{i} AS (SELECT node_id, found, {pick} list_append(ids, found[{i}].id) ELSE ids END AS ids, {pick} spent + found[{i}].cost ELSE spent END AS spent FROM b{i - 1})")
    return ", ".join(out)


@query(f"""WITH {NODES_SQL},
v AS (SELECT chapter_id, order_index, row_number() OVER (PARTITION BY chapter_id ORDER BY order_index) AS i, {{'id': node_id, 'cost': {_COST}}} AS x FROM nodes WHERE status IN ('TRANSLATED', 'PENDING')),
lists AS (SELECT chapter_id, list(x ORDER BY i) AS xs, list(order_index ORDER BY i) AS os FROM v GROUP BY chapter_id),
f AS (SELECT node_id, list_concat(list_slice(xs, greatest(1, r - 1), r), list_slice(xs, r + own + 1, r + own + 2)) AS found FROM (
  SELECT node_id, coalesce(xs, []) AS xs, len(list_filter(coalesce(os, []), lambda o: o < order_index)) AS r, CAST(status IN ('TRANSLATED', 'PENDING') AS INT) AS own FROM nodes LEFT JOIN lists ON lists.chapter_id = nodes.chapter_id)),
{_budgeted(4)}
SELECT node_id, array_to_string(ids, ',') AS context FROM b4""")
def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest finished nodes on either side of every node, within a budget."""
    out = nodes.neighbours(_laid(spark, sf_dir), 2, 2, 120, F.col("status").isin("TRANSLATED", "PENDING"))
    return out.select("node_id", F.array_join("context", ",").alias("context"))


@query("""WITH w AS (SELECT doc_id, lang, source, n_chars, list_slice(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1, 4) AS ws FROM documents)
SELECT doc_id, sha256('{"document_type":' || to_json(coalesce(source, '')) || ',"style_guide":{"ALL":' || CAST(coalesce(n_chars, 0) AS VARCHAR) || ',"b":[],"words":[' || array_to_string(list_transform(ws, lambda x: CAST(to_json(x) AS VARCHAR)), ',') || ']},"target_language":' || to_json(coalesce(lang, '')) || '}') AS style_hash,
  sha256('{' || CASE WHEN len(ws) = 0 THEN '' ELSE '"term":' || to_json(ws[1]) END || '}') AS glossary_hash FROM w""")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of configurations made of every document, whose keys come in another order than the canonical one."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), 1, 4).alias("ws"))
    listed = F.array_join(F.transform("ws", canonical.quoted), ", ")
    config = F.concat(F.lit('{"target_language": '), canonical.quoted(F.coalesce("lang", F.lit(""))), F.lit(', "style_guide": {"words": ['), listed, F.lit('], "b": [ ], "ALL": '), F.coalesce("n_chars", F.lit(0)).cast("string"), F.lit('}, "document_type": '), canonical.quoted(F.coalesce("source", F.lit(""))), F.lit("}"))
    terms_ = F.when(F.size("ws") > 0, F.concat(F.lit('{ "term" : '), canonical.quoted(F.get("ws", F.lit(0))), F.lit("}")))
    found = canonical.translation_signature(config, terms_)
    return d.select("doc_id", found.alias("s")).select("doc_id", "s.style_hash", "s.glossary_hash")


@query("SELECT CAST(doc_id AS VARCHAR) AS node_id, md5(text) AS joined_md5, true AS fits FROM documents WHERE text <> ''")
def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in the segments that they are rendered in, cut again where a request does not fit, and put together again to the byte."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.col("text").alias("content"))
    found = packing.segments(d, window=2400, fixed=150, first_context=60)
    return packing.rejoin(found, F.every("fits").alias("fits")).select("node_id", F.md5("joined").alias("joined_md5"), "fits")


# documents replaced in a store

_NUMBERED = "row_number() OVER (PARTITION BY project_id ORDER BY doc_id, order_index) - 1"


@query(f"""WITH {LINES_SQL},
old AS (SELECT project_id, chapter_id, node_id, content, {_NUMBERED} AS order_index FROM lines WHERE project_id NOT IN ('src1', 'src2')),
new AS (SELECT project_id, chapter_id, node_id, '+' || content AS content, {_NUMBERED} AS order_index FROM lines WHERE project_id = 'src1' AND order_index % 2 = 0)
SELECT project_id, chapter_id, node_id, content, CAST(order_index AS BIGINT) AS order_index FROM (SELECT * FROM old UNION ALL SELECT * FROM new)""")
def replaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of every project, of which one is then replaced by a shorter text and one emptied; chapters and nodes in one commit each time."""
    n = lines(spark, sf_dir).select("project_id", "chapter_id", "node_id", F.col("doc_id").alias("chapter_index"), F.col("order_index").alias("node_index"), "content")
    c = n.select("project_id", "chapter_id", "chapter_index").distinct()
    kept = Store(spark, f"{shared_dir(spark)}/lexiloom/store-{uuid.uuid4().hex}")
    STAGED.add(kept.path)
    save_document(kept, n, c)
    more = n.where("project_id = 'src1' and node_index % 2 = 0").withColumn("content", F.concat(F.lit("+"), F.col("content")))
    save_document(kept, more, c.where("project_id in ('src1', 'src2')"))
    return kept.read("nodes").select("project_id", "chapter_id", "node_id", "content", F.col("order_index").cast("long").alias("order_index"))


# lives of jobs

_JOB_KINDS = {
    "signup": ("START", "RETRY", "START"), "click": ("NODE_STARTED", "NODE_STARTED", "NODE_DONE"), "purchase": ("PAUSE", "RESUME", "FINISHED"),
    "error": ("NODE_FAILED", "NODE_REVIEW", "STOP"), "view": ("HEARTBEAT", "START", "RESUME"),
}
_STALE = 12 * 3600 * 1_000_000
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{t}' THEN (['{a}', '{b}', '{c}'])[(event_id % 3 + 1)::INT]" for t, (a, b, c) in _JOB_KINDS.items()) + " ELSE 'HEARTBEAT' END"


def _swapped(nodes_: str, states: str) -> str:
    return f"list_transform({nodes_}, lambda x: CASE WHEN x IN ({states}) THEN 'PENDING' ELSE x END)"


def _held(nodes_: str, states: str) -> str:
    return f"len(list_filter({nodes_}, lambda x: x IN ({states})))"


@query(f"""WITH RECURSIVE ev AS (
  SELECT CAST(user_id AS VARCHAR) AS p, epoch_us(ts) AS us, event_id, {_KIND_SQL} AS kind, CAST(event_id % 4 AS INT) AS node, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (
  SELECT DISTINCT p, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS us, CAST(NULL AS BIGINT) AS event_id, '' AS kind, 'IDLE' AS was, 'IDLE' AS status, CAST(['', '', '', ''] AS VARCHAR[]) AS ns, false AS stale, CAST(0 AS BIGINT) AS stale_at, 0 AS stale_reset, false AS moved, 0 AS move_reset FROM ev
  UNION ALL
  SELECT p, i, us, event_id, kind, st, CASE WHEN mv THEN aft ELSE st END, CASE WHEN mv AND kind = 'RETRY' THEN {_swapped("n2", "'TRANSLATING', 'FAILED', 'NEEDS_REVIEW'")} WHEN mv AND kind = 'START' THEN {_swapped("n2", "'TRANSLATING'")} ELSE n2 END,
    s, prev_us + {_STALE}, CASE WHEN s THEN {_held("ns", "'TRANSLATING'")} ELSE 0 END, mv,
    CASE WHEN mv AND kind = 'RETRY' THEN {_held("n2", "'TRANSLATING', 'FAILED', 'NEEDS_REVIEW'")} WHEN mv AND kind = 'START' THEN {_held("n2", "'TRANSLATING'")} ELSE 0 END
  FROM (
    SELECT *, CASE kind WHEN 'START' THEN 'RUNNING' WHEN 'RETRY' THEN 'RUNNING' WHEN 'RESUME' THEN 'RUNNING' WHEN 'PAUSE' THEN 'PAUSED' WHEN 'STOP' THEN 'STOPPED' WHEN 'FINISHED' THEN 'IDLE' END AS aft,
      CASE WHEN kind IN ('START', 'RETRY') THEN st <> 'RUNNING' WHEN kind IN ('PAUSE', 'FINISHED') THEN st = 'RUNNING' WHEN kind = 'RESUME' THEN st = 'PAUSED' WHEN kind = 'STOP' THEN st <> 'STOPPED' ELSE false END AS mv,
      CASE WHEN starts_with(kind, 'NODE_') THEN list_transform(n1, lambda x, j: CASE WHEN j = node + 1 THEN CASE kind WHEN 'NODE_STARTED' THEN 'TRANSLATING' WHEN 'NODE_DONE' THEN 'TRANSLATED' WHEN 'NODE_FAILED' THEN 'FAILED' ELSE 'NEEDS_REVIEW' END ELSE x END) ELSE n1 END AS n2
    FROM (
      SELECT *, CASE WHEN s THEN 'IDLE' ELSE status END AS st, CASE WHEN s THEN {_swapped("ns", "'TRANSLATING'")} ELSE ns END AS n1
      FROM (SELECT ev.p, ev.i, ev.us, ev.event_id, ev.kind, ev.node, r.us AS prev_us, r.status, r.ns, r.status = 'RUNNING' AND ev.us - r.us > {_STALE} AS s FROM r JOIN ev ON ev.p = r.p AND ev.i = r.i + 1))))
SELECT p AS project_id, stale_at AS micros, CAST(NULL AS BIGINT) AS event_id, 'STALE' AS kind, 'RUNNING' AS before, 'IDLE' AS after, CAST(stale_reset AS BIGINT) AS nodes_reset FROM r WHERE stale
UNION ALL SELECT p, us, event_id, kind, was, status, CAST(move_reset AS BIGINT) FROM r WHERE moved""")
def job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of every user's job, whose kinds of events are told by type and id; the streaming form is held against this one in the tests."""
    e = table(spark, sf_dir, "events")
    kind = F.lit("HEARTBEAT")
    for t, names in _JOB_KINDS.items():
        kind = F.when(F.col("event_type") == t, F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 3 + 1).cast("int"))).otherwise(kind)
    e = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("project_id"), kind.alias("kind"), (F.col("event_id") % 4).alias("node_id"))
    return lifecycle.transitions(e, "12 hours")
