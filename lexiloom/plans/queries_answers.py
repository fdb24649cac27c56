"""Queries over model answers, reviews, records, forms of address and small relational operators, with their SQL.

Answers and payloads are made from the tables in every shape the operators read; the SQL says what they must come to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import answers, text as tx
from lexiloom.operators import address, issues, lint, nodes, packing, prompts, records, reviews, terms
from lexiloom.plans.fixtures import LINES_SQL, PAIRS_SQL, lines, pairs
from lexiloom.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def pick(n: Column, *values) -> Column:  # noqa: ANN002
    """values[n % len(values)]."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


# answers

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def answered(n: DataFrame) -> DataFrame:
    """(doc_id, answer): each document's lines as one answer to a batch: fenced, a bare list, a mapping, within prose with trailing commas, and broken twice."""
    item = lambda i, t, flip=False: F.transform("ls", lambda x: F.to_json(F.struct(*([x["content"].alias(t), x["node_id"].alias(i)] if flip else [x["node_id"].alias(i), x["content"].alias(t)]))))
    per = n.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "node_id", "content"))).alias("ls"))
    k = F.col("doc_id") % 6
    joined = lambda xs, by=",": F.array_join(xs, by)
    mapping = F.to_json(F.map_from_entries(F.transform("ls", lambda x: F.struct(x["node_id"], x["content"]))))
    answer = (
        F.when(k == 0, F.concat(F.lit('Here it is:\n```json\n{"translations":['), joined(item("node_id", "text")), F.lit("]}\n```")))
        .when(k == 1, F.concat(F.lit("["), joined(item("id", "translation")), F.lit("]")))
        .when(k == 2, mapping)
        .when(k == 3, F.concat(F.lit('Sure.\n{"results":['), joined(item("node_id", "translated_text")), F.lit(",]}\nDone.")))
        .when(k == 4, F.concat(F.lit('{"translations":['), joined(item("node_id", "text"), "\n"), F.lit("]")))
        .otherwise(F.concat(F.lit('{"translations":['), joined(item("node_id", "text", True), "\n"), F.lit("]")))
    )
    return per.select("doc_id", answer.alias("answer"))


@query(f"WITH {LINES_SQL} SELECT doc_id, node_id, {_STRIP.format('content')} AS text FROM lines")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered(lines(spark, sf_dir)).select("doc_id", F.inline(answers.answer_items(F.col("answer"))))


@query(f"""WITH {LINES_SQL}
SELECT doc_id AS batch_id, count(*) FILTER (order_index % 9 IN (4, 7)) AS missing, count(*) FILTER (order_index % 9 = 7) AS unknown, count(*) FILTER (order_index % 9 = 5) AS duplicated, count(*) FILTER (order_index % 9 = 6) AS empty,
  count(*) FILTER (order_index % 9 >= 4 AND order_index % 9 < 8) = 0 AS ok FROM lines GROUP BY doc_id""")
def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that leave nodes out, repeat them, leave them blank and invent ids, held against what was asked."""
    n, o = lines(spark, sf_dir), F.col("order_index") % 9
    given = n.where(o != 4).withColumns({"node_id": F.when(o == 7, F.concat(F.lit("x"), "node_id")).otherwise(F.col("node_id")), "content": F.when(o == 6, " ").otherwise(F.col("content"))})
    found = answered(given.union(given.where(o == 5))).where(F.col("doc_id") % 6 != 2).select("doc_id", F.inline(answers.answer_items(F.col("answer"))))
    plain = given.union(given.where(o == 5)).where(F.col("doc_id") % 6 == 2).select("doc_id", "node_id", F.col("content").alias("text"))  # a mapping cannot repeat a key
    return issues.reconcile(n.select(F.col("doc_id").alias("batch_id"), "node_id"), found.union(plain).withColumnRenamed("doc_id", "batch_id"))


@query(f"""WITH l AS (SELECT doc_id, unnest(generate_series(1, len(xs))) AS pos, {_STRIP.format('unnest(xs)')} AS line FROM (SELECT doc_id, string_split(text || chr(10) || text, chr(10)) AS xs FROM documents)),
f AS (SELECT doc_id, line, min(pos) AS pos FROM l WHERE line <> '' GROUP BY ALL)
SELECT d.doc_id, sha256(coalesce(string_agg(line, chr(10) || chr(10) ORDER BY pos), '')) AS kept_sha256 FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""")
def repeated_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = F.concat_ws("\n", "text", "text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(answers.unique_paragraphs(twice), 256).alias("kept_sha256"))


@query()
def cleaned_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers with an opening, full-width marks, a repeated paragraph and a remark, cleaned. tests/test_answers.py holds the rules against examples."""
    text = F.concat(F.lit('{"translation": '), F.to_json(F.struct(F.concat(F.lit("Translation: "), "text", F.lit("，。\n"), "text", F.lit("\nNote: none")).alias("t"))).substr(6, 10**8))
    d = table(spark, sf_dir, "documents").select("doc_id", answers.cleaned(text).alias("cleaned"))
    return d.select("doc_id", F.length("cleaned").cast("long").alias("n_chars"), F.sha2("cleaned", 256).alias("cleaned_sha256"))


_TOKENS = """CAST(greatest(1, floor(1.22::DOUBLE * len(regexp_extract_all(text, '\\S+')) + 0.22::DOUBLE * len(regexp_extract_all(text, '[.,;:!?()\\[\\]{}"'']')) + 0.08::DOUBLE * len(regexp_extract_all(text, '[^\\x00-\\x7F]')) + 8)) AS BIGINT)"""


@query(f"SELECT CAST(doc_id AS VARCHAR) AS node_id, sha256(text) AS joined_sha256, true AS within FROM documents WHERE {_TOKENS} > 150")
def layout_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents in parts of 150 tokens, joined again to the byte: nothing is lost and no part is over the budget (but single words)."""
    parts = packing.split_layout(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.col("text").alias("content")), 150)
    within = F.every((tx.token_estimate(F.col("text")) <= 150) | (tx.word_count(F.col("text")) <= 1)).alias("within")
    return packing.rejoin(parts, within).select("node_id", F.sha2("joined", 256).alias("joined_sha256"), "within")


# reviews

_ALL = ", ".join(f'"{c}": "PASS"' for c in reviews.CHECK_ISSUES)
_MOST = ", ".join(f'"{c}": true' for c in list(reviews.CHECK_ISSUES)[:6])
PAYLOADS = (
    f'{{"status": "PASS", "score": 0.95, "checks": {{{_ALL}}}, "errors": []}}',
    f'Sure: {{"verdict": "passed", "score": "92%", "checks": {{{_MOST}}}}} ok',
    '{"status": "PASS", "checks": {}}',
    f'{{"status": "PASS", "score": 9, "checks": {{{_ALL.replace(chr(34) + "meaning" + chr(34) + ": " + chr(34) + "PASS", chr(34) + "meaning" + chr(34) + ": " + chr(34) + "Partial")}}}, "errors": []}}',
    '{"score": 1, "issues": [{"category": "omission", "description": "one sentence"}]}',
    "no json at all",
    '{"status": "FAIL", "score": 0.3, "errors": ["wrong"]}',
    f'{{"status": "FAIL", "score": 0.5, "checks": {{{_ALL}}}, "errors": []}}',
)


@query("""SELECT c_custkey AS node_id, ['PASS', 'PASS', 'ERROR', 'FAIL', 'FAIL', 'ERROR', 'FAIL', 'ERROR'][(c_custkey % 8 + 1)::INT] AS status,
  [0.95::DOUBLE, 0.92::DOUBLE, NULL, 0.6::DOUBLE, 0.6::DOUBLE, NULL, 0.3::DOUBLE, NULL][(c_custkey % 8 + 1)::INT] AS score,
  ['', '', '', 'MEANING_DRIFT', 'SEMANTIC_OMISSION', '', 'MEANING_DRIFT', ''][(c_custkey % 8 + 1)::INT] AS types FROM customer""")
def review_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    r = table(spark, sf_dir, "customer").select(k.alias("node_id"), reviews.review(pick(k, *PAYLOADS)).alias("r"))
    return r.select("node_id", "r.status", "r.score", F.array_join(F.transform("r.errors", lambda e: e["type"]), ",").alias("types"))


_STYLE_PAYLOADS = (
    '{"status": "natural", "score": "9", "issues": [{"type": "tone", "severity": "minor", "comment": "c"}]}',
    '{"verdict": "PASS", "issues": ["clumsy"]}',
    '{"status": "FAIL", "checks": ["word_order", "cohesion"]}',
    '{"status": "unnatural", "score": 0.4, "checks": {"register": "good"}}',
    '{"status": "ERROR", "error": "x"}',
    '{"checks": {"register": 0.2, "cohesion": {"status": "ok"}}, "issues": {"category": "word choice", "level": "HIGH", "span": "s"}}',
)


@query("""SELECT c_custkey AS node_id, ['PASS', 'FAIL', 'FAIL', 'ERROR', 'ERROR', 'FAIL'][(c_custkey % 6 + 1)::INT] AS status, [0.9::DOUBLE, 0.85::DOUBLE, 1.0::DOUBLE, NULL, NULL, 0.85::DOUBLE][(c_custkey % 6 + 1)::INT] AS score,
  ['', 'sentence_flow', 'word_order,cohesion', '', '', 'collocation,register'][(c_custkey % 6 + 1)::INT] AS failed,
  ['VIETNAMESE_REGISTER INFO', 'VIETNAMESE_SENTENCE_FLOW WARNING', 'VIETNAMESE_NATURALNESS_ERROR WARNING', 'VIETNAMESE_NATURALNESS_ERROR ERROR', 'VIETNAMESE_NATURALNESS_ERROR ERROR', 'VIETNAMESE_COLLOCATION ERROR'][(c_custkey % 6 + 1)::INT] AS report FROM customer""")
def style_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    r = table(spark, sf_dir, "customer").select(k.alias("node_id"), reviews.style_review(pick(k, *_STYLE_PAYLOADS)).alias("r"))
    report = F.array_join(F.transform(reviews.style_report(F.col("r")), lambda i: F.concat_ws(" ", i["issue_type"], i["severity"])), ",")
    return r.select("node_id", "r.status", "r.score", F.array_join("r.failed_checks", ",").alias("failed"), report.alias("report"))


@query("""SELECT o_orderkey AS node_id, CASE WHEN o_orderkey % 3 = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 0.85::DOUBLE ELSE 0.4::DOUBLE END AS score FROM orders""")
def refuted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that say a clerk was added: refuted where the source names the clerk."""
    k = F.col("o_orderkey")
    source = F.concat(F.lit("Sold by "), F.when(k % 3 == 0, F.concat(F.lit("Clerk "), "o_orderpriority")).otherwise("no one"), F.lit(" then."))
    payload = F.concat(F.lit('{"status": "FAIL", "errors": [{"type": "addition", "message": "adds \'Clerk '), "o_orderpriority", F.lit("' which is not present\"}]}"))
    o = table(spark, sf_dir, "orders").select(k.alias("node_id"), source.alias("s"), reviews.review(payload).alias("r"))
    return o.select("node_id", reviews.refute_additions(F.col("s"), F.col("r")).alias("r")).select("node_id", "r.status", "r.score")


def _verdict_payload() -> Column:
    """A verdict as a model may give it, made of a document: its length tells the form of every part, its words are the issues."""
    n, ws = F.length("text"), F.transform(F.slice(F.split("text", " "), 1, 2), lambda w: F.regexp_replace(w, "[^A-Za-z]", ""))
    form = lambda by, *texts: F.get(F.array(*texts), (F.floor(n / by) % len(texts)).cast("int"))
    none = F.lit(None).cast("string")
    told = form(11, F.lit('"is_passed": true'), F.lit('"is_passed": false'), F.lit('"is_passed": "yes"'), F.lit('"is_passed": true'), none)
    score = form(55, F.concat(F.lit('"score": 0.'), F.lpad((n % 100).cast("string"), 2, "0")), F.concat(F.lit('"score": '), n.cast("string")), F.lit('"score": "0.5"'), F.lit('"score": 1'), none, F.lit('"score": -0.5'))
    listed = F.concat(F.lit('"issues": ["'), F.array_join(ws, '", "'), F.lit('"]'))
    issues_ = form(7, F.lit('"issues": []'), listed, F.concat(F.lit('"issues": ["'), F.get(ws, F.lit(0)), F.lit('", 3]')), listed, none)
    failed = F.when(F.col("text").contains("%"), F.concat(F.lit('"status": "ERROR", "error": "'), F.get(ws, F.lit(0)), F.lit('"')))
    whole = F.concat(F.lit("{"), F.concat_ws(", ", issues_, score, failed, told), F.lit("}"))
    return F.when(n % 13 == 0, F.col("text")).when(n % 13 == 1, F.lit('[{"is_passed": true, "score": 1, "issues": []}]')).otherwise(whole)


_VERDICT_FORM = "([{1}])[(length(text) // {0} % {2} + 1)::INT]"
_VERDICT_PARTS = {
    "told": (11, ("'\"is_passed\": true'", "'\"is_passed\": false'", "'\"is_passed\": \"yes\"'", "'\"is_passed\": true'", "NULL")),
    "score": (55, ("'\"score\": 0.' || lpad(CAST(length(text) % 100 AS VARCHAR), 2, '0')", "'\"score\": ' || length(text)", "'\"score\": \"0.5\"'", "'\"score\": 1'", "NULL", "'\"score\": -0.5'")),
    "listed": (7, ("'\"issues\": []'", "l", "'\"issues\": [\"' || ws[1] || '\", 3]'", "l", "NULL")),
}


@query("""WITH w AS (SELECT doc_id, text, list_transform(list_slice(string_split(text, ' '), 1, 2), lambda x: regexp_replace(x, '[^A-Za-z]', '', 'g')) AS ws FROM documents),
q AS (SELECT *, '"issues": ["' || array_to_string(ws, '", "') || '"]' AS l FROM w),
parts AS (SELECT *, """ + ", ".join(f"{_VERDICT_FORM.format(by, ', '.join(xs), len(xs))} AS {name}" for name, (by, xs) in _VERDICT_PARTS.items()) + """ FROM q),
made AS (SELECT doc_id, CASE length(text) % 13 WHEN 0 THEN text WHEN 1 THEN '[{"is_passed": true, "score": 1, "issues": []}]'
  ELSE '{' || concat_ws(', ', listed, score, CASE WHEN contains(text, '%') THEN '"status": "ERROR", "error": "' || ws[1] || '"' END, told) || '}' END AS p FROM parts),
j AS (SELECT doc_id, CASE WHEN json_valid(p) THEN CAST(p AS JSON) END AS j FROM made),
e AS (SELECT doc_id, j, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'NOT_AN_OBJECT'
  WHEN j->>'$.status' = 'ERROR' OR coalesce(j->>'$.error', '') <> '' THEN coalesce(nullif(j->>'$.error', ''), 'PROVIDER_ERROR')
  WHEN coalesce(json_type(j, '$.is_passed'), '') <> 'BOOLEAN' THEN 'NO_VERDICT'
  WHEN coalesce(json_type(j, '$.score'), '') NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT') OR CAST(j->>'$.score' AS DOUBLE) NOT BETWEEN 0 AND 1 THEN 'BAD_SCORE'
  WHEN coalesce(json_type(j, '$.issues'), '') <> 'ARRAY' OR len(list_filter(json_transform(j->'$.issues', '["JSON"]'), lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN 'BAD_ISSUES' END AS error FROM j)
SELECT doc_id AS node_id, CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN j->>'$.is_passed' = 'true' THEN 'PASS' ELSE 'FAIL' END AS status, coalesce(error, '') AS error,
  CASE WHEN error IS NOT NULL THEN 'QA_ERROR' WHEN j->>'$.is_passed' <> 'true' THEN 'AI_QA_RECOMMENDATION' END AS issue_type,
  CASE WHEN error IS NULL THEN array_to_string(json_transform(j->'$.issues', '["VARCHAR"]'), ',') ELSE '' END AS issues, CASE WHEN error IS NULL THEN CAST(j->>'$.score' AS DOUBLE) END AS score FROM e""")
def quality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts made of every document in all forms and combinations of their parts, read strictly; the SQL parses the same payloads."""
    r = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), reviews.qa_result(_verdict_payload()).alias("r"))
    return r.select("node_id", "r.status", F.coalesce("r.error", F.lit("")).alias("error"), reviews.verdict_issue(F.col("r.status"), F.col("r.is_passed"))["issue_type"].alias("issue_type"), F.array_join("r.issues", ",").alias("issues"), "r.score")


@query("""WITH c AS (SELECT c_custkey AS k, ['paragraph', 'heading', 'table', 'caption'][c_custkey % 4 + 1] AS kind, ['AUTO', 'ALWAYS', 'LINT_ONLY'][c_custkey % 3 + 1] AS mode, ['HIGH_QUALITY', 'PUBLISHING'][c_custkey % 2 + 1] AS tier,
    ['LEGAL', 'GENERAL'][c_custkey % 2 + 1] AS domain, ['PASS', 'A', 'B', 'TIE'][c_custkey % 4 + 1] AS x, ['B', 'A', 'TIE'][c_custkey % 3 + 1] AS y, c_custkey % 5 < 2 AS mild, 0.5::DOUBLE + c_custkey % 5 / 10.0::DOUBLE AS score FROM customer)
SELECT k AS node_id, kind NOT IN ('heading', 'caption') AND CASE mode WHEN 'ALWAYS' THEN true WHEN 'LINT_ONLY' THEN false ELSE tier <> 'HIGH_QUALITY' END AS asks,
  kind NOT IN ('heading', 'caption') AND NOT (domain = 'LEGAL' AND mild) AS may, CASE WHEN x <> 'PASS' THEN x = 'A' AND y = 'B' END AS original, score >= 0.55 AND score < 0.8 AS in_range FROM c""")
def review_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = pick(k, "paragraph", "heading", "table", "caption")
    types = F.when(k % 5 < 2, F.array(F.lit("register"), F.lit("PASSIVE_VOICE"))).otherwise(F.array(F.lit("REGISTER"), F.lit("LITERAL_CALQUE")))
    return table(spark, sf_dir, "customer").select(
        k.alias("node_id"), reviews.asks_critic(kind, pick(k, "AUTO", "ALWAYS", "LINT_ONLY"), pick(k, "HIGH_QUALITY", "PUBLISHING")).alias("asks"), reviews.may_rewrite(kind, F.lit("NATURAL"), pick(k, "LEGAL", "GENERAL"), types).alias("may"),
        reviews.original_wins(pick(k, "PASS", "a ", "B", "tie"), pick(k, "B", "A", "TIE")).alias("original"), reviews.in_rewrite_range(F.lit("FAIL"), F.lit(0.5) + (k % 5) / 10.0).alias("in_range"),
    )


@query("""SELECT o_orderpriority AS run, count(*) AS reviewed, count(*) FILTER (o_orderkey % 4 = 0) AS cached, count(*) FILTER (o_orderkey % 3 = 0) AS passed, count(*) FILTER (o_orderkey % 3 = 1) AS failed, count(*) FILTER (o_orderkey % 3 = 2) AS errors FROM orders GROUP BY 1""")
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return reviews.run_counts(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), pick(k, "PASS", "FAIL", "ERROR").alias("status"), (k % 4 == 0).alias("cached")), ["run"])


@query(f"""WITH {PAIRS_SQL}, f AS (SELECT node_id, ['REGISTER', 'LITERAL_CALQUE'][(order_index % 2 + 1)::INT] AS type, CASE WHEN order_index % 3 = 0 THEN 'x' ELSE 'y' END AS span FROM pairs WHERE kind < 6),
h AS (SELECT node_id, 'LITERAL_CALQUE' AS type, CASE WHEN kind % 2 = 0 THEN 'WARNING' ELSE 'INFO' END AS severity, 'x' AS span FROM pairs WHERE kind > 2)
SELECT node_id, type, 'ERROR' AS severity, span, 'REVIEW' AS origin FROM f UNION ALL SELECT h.*, 'LINT' FROM h JOIN f ON f.node_id = h.node_id AND f.type = h.type WHERE severity = 'WARNING' AND f.span <> h.span""")
def rewrite_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, o = pairs(spark, sf_dir), F.col("order_index")
    f = p.where(F.col("kind") < 6).select("node_id", pick(o, "REGISTER", "LITERAL_CALQUE").alias("type"), F.lit("ERROR").alias("severity"), F.when(o % 3 == 0, "x").otherwise("y").alias("span"))
    h = p.where(F.col("kind") > 2).select("node_id", F.lit("LITERAL_CALQUE").alias("type"), F.when(F.col("kind") % 2 == 0, "WARNING").otherwise("INFO").alias("severity"), F.lit("x").alias("span"))
    return reviews.rewrite_issues(f, h)


@query()
def lint_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by the lint alone over renderings of which some hold a phrase it warns of."""
    o = F.col("order_index")
    n = pairs(spark, sf_dir).select("node_id", "source_text", F.concat_ws(" ", pick(o, "Việc này được làm bởi họ.", "Anh về.", "để có thể"), "target_text").alias("target_text"))
    return lint.verdicts(n, lint.lint(n)).groupBy("status", "score").agg(F.count("*").alias("nodes"))


# records

@query("""SELECT user_id AS node_id, user_id % 4 + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version_number, CAST(event_id AS VARCHAR) AS target_text FROM events""")
def saved_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = e.select(F.col("user_id").alias("node_id")).distinct().withColumns({"content": F.lit("c"), "target_text": F.lit(None).cast("string"), "status": F.lit("PENDING"), "version": F.col("node_id") % 4})
    _, versions = records.save(n, e.select(F.col("user_id").alias("node_id"), F.col("event_id").cast("string").alias("target_text"), F.struct("ts", "event_id").alias("saved_at")))
    return versions.select("node_id", "version_number", "target_text")


@query("""SELECT user_id AS node_id, CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) AS target_text, 'TRANSLATED' AS status, user_id % 4 + count(*) AS version FROM events GROUP BY user_id""")
def saved_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = e.select(F.col("user_id").alias("node_id")).distinct().withColumns({"content": F.lit("c"), "target_text": F.lit(None).cast("string"), "status": F.lit("PENDING"), "version": F.col("node_id") % 4})
    after, _ = records.save(n, e.select(F.col("user_id").alias("node_id"), F.col("event_id").cast("string").alias("target_text"), F.struct("ts", "event_id").alias("saved_at")))
    return after.select("node_id", "target_text", "status", "version")


def _rejected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    error = lambda kind, code: F.struct(kind.alias("type"), code.alias("code"), F.lit("ERROR").alias("severity"), F.lit("m").alias("message"))
    none = F.lit(None).cast("string")
    errors = F.array(error(pick(k, "MEANING_DRIFT", "SCOPE_ERROR", None).cast("string"), F.lit("NEGATION_LOSS")), error(none, F.lit("SEMANTIC_REPAIR_POLICY")))
    base = o.select(F.lit("p").alias("project_id"), k.alias("node_id"), (k % 7).alias("r"), errors.alias("errors"), F.concat(F.lit("s"), k % 2).alias("signature"), F.lit("draft").alias("target_text"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("saved_at"))
    n = base.select("project_id", "node_id", F.lit("TRANSLATED").alias("status"))
    audits = base.where("r < 3").select("project_id", "node_id", F.lit("s0").alias("signature"), (F.col("r") == 2).alias("is_stale"))
    found = base.where("r < 2").select("project_id", "node_id", F.lit("MEANING_DRIFT").alias("issue_type"), F.lit("WARNING").alias("severity"), F.lit("old").alias("message"), F.when(F.col("r") == 0, "OPEN").otherwise("RESOLVED").alias("status"))
    return records.reject(n, audits, found, base.where("r % 2 = 0").drop("r"))


@query("""WITH r AS (SELECT o_orderkey AS k, ['MEANING_DRIFT', 'SCOPE_ERROR', 'NEGATION_LOSS'][(o_orderkey % 3 + 1)::INT] AS t FROM orders WHERE o_orderkey % 7 % 2 = 0)
SELECT o_orderkey AS node_id, 'MEANING_DRIFT' AS issue_type, 'WARNING' AS severity, CASE WHEN o_orderkey % 7 = 0 THEN 'OPEN' ELSE 'RESOLVED' END AS status FROM orders WHERE o_orderkey % 7 < 2
UNION ALL SELECT k, t, 'ERROR', 'OPEN' FROM r WHERE NOT (k % 7 = 0 AND t = 'MEANING_DRIFT')""")
def rejected_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rejected(spark, sf_dir)[2].select("node_id", "issue_type", "severity", "status")


@query("""SELECT 'audit' AS kind, o_orderkey AS node_id, 's0' AS value FROM orders WHERE o_orderkey % 7 < 3
UNION ALL SELECT 'audit', o_orderkey, 's' || (o_orderkey % 2) FROM orders WHERE o_orderkey % 7 % 2 = 0 AND NOT (o_orderkey % 7 = 0 AND o_orderkey % 2 = 0)
UNION ALL SELECT 'node', o_orderkey, CASE WHEN o_orderkey % 7 % 2 = 0 THEN 'NEEDS_REVIEW draft ' || ['MEANING_DRIFT', 'SCOPE_ERROR', 'NEGATION_LOSS'][(o_orderkey % 3 + 1)::INT] || ' 2024-01-02T03:04:05' ELSE 'TRANSLATED' END FROM orders""")
def rejected_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, audits, _ = _rejected(spark, sf_dir)
    value = F.concat_ws(" ", "status", "draft.text", F.array_join("draft.reasons", ","), "draft.saved_at")
    return audits.select(F.lit("audit").alias("kind"), "node_id", F.col("signature").alias("value")).union(n.select(F.lit("node"), "node_id", value))


@query("""WITH c AS (SELECT c_custkey AS k, upper(c_mktsegment) AS seg, c_acctbal / 10000 AS p, c_acctbal / 20000 AS r FROM customer), d AS (SELECT *, CASE WHEN p BETWEEN 0 AND 1 THEN p ELSE 0.8 END AS pass FROM c)
SELECT k AS project_id, CASE k % 5 WHEN 0 THEN 'FAST' WHEN 1 THEN 'PUBLISHING' ELSE 'HIGH_QUALITY' END AS quality_tier, CASE WHEN k % 3 = 0 THEN 'PRESERVE' ELSE 'MODERATE' END AS sentence_style, pass AS passing,
  CASE WHEN r >= 0 AND r < pass THEN r ELSE least(0.55, greatest(0, pass - 0.01)) END AS rewrite, greatest(0, least(2, k % 5 - 1)) AS repairs, greatest(0, least(1, k % 4 - 1)) AS rewrites FROM d""")
def project_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = records.derived_config(pick(k, "fast", "Publishing", None, "BALANCED", "x"), pick(k, "legal", "GENERAL", "LITERATURE"), F.col("c_acctbal") / 10000, F.col("c_acctbal") / 20000, k % 5 - 1, k % 4 - 1)
    return table(spark, sf_dir, "customer").select(k.alias("project_id"), c.alias("c")).select("project_id", "c.*")


_B, _E = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
#: Wording of hard sources, for RE2.
_HARD_SQL = (
    ("negation", rf"{_B}(not|never|no|neither|nothing|cannot|can''t){_E}"), ("double_negation", rf"{_B}(no|never|without|not)($|[^\p{{L}}\p{{N}}_\n]|[^\p{{L}}\p{{N}}_\n].*[^\p{{L}}\p{{N}}_\n])not{_E}"), ("modality", rf"{_B}(may|might|must|should|could|shall|would){_E}"),
    ("condition", rf"{_B}(if|unless|provided|although|whether){_E}"), ("causality", rf"{_B}(because|therefore|thus|resulted|so that|rather than){_E}"), ("pronoun", rf"{_B}(which|who|she|he|they|it|her|him|their){_E}"),
    ("passive", rf"{_B}(is|are|was|were|been|be)\s+[\p{{L}}\p{{N}}_]+(ed|en){_E}"), ("nominalization", rf"{_B}(tion|ment|ity|ance|ence){_E}"),
)


@query("WITH d AS (SELECT doc_id, lower(text) AS low FROM documents) SELECT doc_id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN '{t}' END" for t, p in _HARD_SQL) + rf", CASE WHEN contains(low, '%') THEN 'percent' WHEN contains(low, '$') THEN 'currency' WHEN regexp_matches(low, '{_B}\d+(\.\d+)?{_E}') THEN 'date' END, CASE WHEN len(regexp_extract_all(low, '\S+')) >= 45 THEN 'long_paragraph' END], lambda x: x IS NOT NULL)), ',') AS tags FROM d")
def hard_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(records.hard_tags(F.col("text")), ",").alias("tags"))


@query("""SELECT doc_id, ['legal readers', 'narrative', 'general readers'][(doc_id % 3 + 1)::INT] AS reader, CASE WHEN len(regexp_extract_all(text, '\\S+')) / greatest(1, len(regexp_extract_all(text, '[.!?]+'))) > 28 THEN 'high' ELSE 'medium' END AS complexity,
  CASE WHEN contains('02468ace', substr(sha256(CAST(doc_id AS VARCHAR)), 2, 1)) THEN 'A' ELSE 'B' END AS side FROM documents""".replace("'narrative'", "'general readers'"))
def document_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = records.fallback_profile(pick(F.col("doc_id"), "legal", "LITERATURE", None), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", p["audience"].alias("reader"), p["complexity"].alias("complexity"), records.candidate_side(F.col("doc_id").cast("string")).alias("side"))


@query("""WITH m AS (SELECT p_partkey, ['qwen2.5:7b', 'Llama3', 'gemma', 'mock-mistral', 'other'][p_partkey % 5 + 1] AS model FROM part)
SELECT p_partkey, [8192, 8192, 8192, 8192, 4096][p_partkey % 5 + 1] AS window_, [1200, 1200, 1100, 1200, 1200][p_partkey % 5 + 1] AS source_tokens, CASE WHEN model LIKE 'mock%' THEN 'MOCK' ELSE 'MODEL' END AS provider FROM m""")
def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = pick(F.col("p_partkey"), "qwen2.5:7b", "Llama3", "gemma", "mock-mistral", "other")
    c = records.capabilities(m)
    return table(spark, sf_dir, "part").select("p_partkey", c["window"].alias("window_"), c["source_tokens"].alias("source_tokens"), records.provider_of(m).alias("provider"))


@query("""SELECT p_partkey AS term_id, CASE WHEN p_partkey % 3 = 0 THEN true WHEN p_partkey % 3 = 1 THEN p_partkey % 2 = 0 ELSE false END AS locked, CASE WHEN p_partkey % 3 = 0 THEN 'HARD' WHEN p_partkey % 3 = 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'HARD' ELSE 'SOFT' END ELSE 'SOFT' END AS lock_level,
  CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_name END AS target_term, CASE WHEN p_partkey % 5 = 0 THEN upper(p_type) ELSE 'GENERAL' END AS domain FROM part""")
def patched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    term = {"locked": F.lit(False), "lock_level": F.lit("SOFT"), "target_term": F.col("p_name"), "preferred_target": F.col("p_name"), "allowed_variants": F.array(F.lit("v")), "domain": F.lit("GENERAL")}
    patch = {"locked": F.when(k % 3 == 1, k % 2 == 0), "lock_level": F.when(k % 3 == 0, "hard"), "target_term": none, "preferred_target": F.when(k % 4 == 0, F.col("p_brand")), "allowed_variants": F.array(F.lit(" a "), F.lit(" ")), "domain": F.when(k % 5 == 0, F.lower("p_type"))}
    after = records.patched_term(term, patch)
    return table(spark, sf_dir, "part").select(k.alias("term_id"), *[after[c].alias(c) for c in ("locked", "lock_level", "target_term", "domain")])


@query("""WITH e AS (SELECT event_id, user_id, event_type, event_id % 5 > 0 AS explicit, value > 10 AS sound, event_id % 7 AS errors, ['QA_EDITOR', 'MANUAL_FINAL', 'MODEL'][(event_id % 3 + 1)::INT] AS origin FROM events),
v AS (SELECT *, CASE WHEN NOT explicit THEN 'EXPLICIT_APPROVAL_REQUIRED' WHEN origin = 'MODEL' THEN 'UNAPPROVED_SOURCE' WHEN errors = 0 THEN 'DETERMINISTIC_GATE_FAILED' WHEN NOT sound THEN 'SEMANTIC_APPROVAL_REQUIRED' ELSE 'INGESTED' END AS verdict FROM e)
SELECT event_id AS example_id, CASE WHEN verdict = 'INGESTED' AND (user_id % 10 = 0 OR row_number() OVER (PARTITION BY user_id, event_type, verdict = 'INGESTED' ORDER BY event_id) > 1) THEN 'DUPLICATE' ELSE verdict END AS verdict FROM v""")
def memory_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    c = {"explicit": i % 5 > 0, "project_id": F.lit("p"), "source_text": F.lit("s"), "target_text": F.lit("t"), "approval_source": pick(i, "qa_editor", "MANUAL_FINAL ", "MODEL"), "scope": F.lit(None).cast("string"), "errors": F.when(i % 7 == 0, 1).otherwise(0), "semantic_ok": F.col("value") > 10}
    j = table(spark, sf_dir, "events").select(i.alias("example_id"), "user_id", "event_type", records.memory_verdict(c).alias("verdict"))
    have = j.where(F.col("user_id") % 10 == 0).select("user_id", "event_type")
    return records.ingest(have, j, ["user_id", "event_type"]).select("example_id", "verdict")


@query("""SELECT user_id AS run_id, event_id AS item_no, row_number() OVER w AS done, CAST(floor(100 * row_number() OVER w / count(*) OVER (PARTITION BY user_id)) AS BIGINT) AS percent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.progress(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("item_no")))


_AVOIDED = ("of the", "with", "und die")
_HINTS = " UNION ALL ".join(f"SELECT node_id, '{a}' AS avoid, 'x' AS prefer FROM pairs WHERE regexp_matches(target_text, '(?i){_B}{a}{_E}')" for a in _AVOIDED)


@query(f"WITH {PAIRS_SQL} {_HINTS}")
def project_style_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    rules = p.select("project_id").distinct().crossJoin(spark.createDataFrame([(a, "x") for a in _AVOIDED], "avoid string, prefer string"))
    return records.rule_hints(p, rules)


@query(f"WITH {LINES_SQL} SELECT node_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY order_index, node_id) AS n FROM lines) WHERE n <= 20")
def first_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.first_nodes(lines(spark, sf_dir)).select("node_id")


@query(f"""WITH {LINES_SQL} SELECT l.node_id, r.status, substr(l.content, 1, 160) AS source_snippet FROM (SELECT node_id, CASE WHEN order_index % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM lines WHERE order_index % 3 = 0) r LEFT JOIN lines l USING (node_id)""")
def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lines(spark, sf_dir).select("node_id", "order_index", F.col("content").alias("source_text"), F.lit("").alias("target_text"))
    r = n.where(F.col("order_index") % 3 == 0).select("node_id", F.when(F.col("order_index") % 2 == 0, "PASS").otherwise("FAIL").alias("status"))
    return reviews.with_nodes(r, n).select("node_id", "status", "source_snippet")


@query("""SELECT o_orderkey AS orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'P' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 1.5 ELSE o_totalprice END AS price FROM orders""")
def patched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    u = o.where(F.col("orderkey") % 3 == 0).select("orderkey", F.lit("P").alias("status"), F.when(F.col("orderkey") % 2 == 0, 1.5).alias("price"))
    return nodes.patch(o, u, "orderkey")


@query("""SELECT o_orderkey AS node_id, 'OLD' AS issue_type, 'RESOLVED' AS status FROM orders WHERE o_orderkey % 4 = 1 UNION ALL SELECT o_orderkey, 'NEW', 'OPEN' FROM orders WHERE o_orderkey % 3 = 0""")
def rerun_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    old = o.where(k % 4 < 2).select(k.alias("node_id"), F.lit("OLD").alias("issue_type"), F.when(k % 4 == 0, "OPEN").otherwise("RESOLVED").alias("status"))
    return issues.replace_open(old, o.where(k % 3 == 0).select(k.alias("node_id"), F.lit("NEW").alias("issue_type")))


@query("""SELECT DISTINCT l_orderkey AS node_id FROM lineitem WHERE l_linestatus = 'O'""")
def nodes_with_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.open_nodes(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node_id"), F.when(F.col("l_linestatus") == "O", "OPEN").otherwise("RESOLVED").alias("status")))


@query("""SELECT n_name AS source_key, CASE WHEN n_nationkey % 3 = 0 THEN 'g' || n_nationkey ELSE 'p' || n_nationkey END AS target, n_nationkey % 3 <> 0 AS free FROM nation WHERE n_nationkey % 2 = 0""")
def locked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    d = n.select(F.col("n_name").alias("source_key"), F.concat(F.lit("p"), k).alias("preferred"), (k % 2 == 0).alias("locked"))
    g = n.where(k % 3 == 0).select(F.lower("n_name").alias("source_term"), F.concat(F.lit("g"), k).alias("target"))
    free = records.free_decisions(d, g).select("source_key", F.lit(True).alias("_free"))
    return terms.locked_targets(d, g).join(free, "source_key", "left").select("source_key", "target", F.coalesce("_free", F.lit(False)).alias("free"))


@query("""WITH c AS (SELECT doc_id, length(trim(text)) AS n, doc_id % 3 > 0 AS img, (doc_id % 10) / 10.0 AS ratio FROM documents)
SELECT doc_id, (n < 60 AND img OR n >= 60 AND img AND ratio >= 0.3) AND n < 100 AND doc_id % 2 = 0 AS needs_ocr FROM c""")
def ocr_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.functions import scores

    n = F.length(F.trim("text"))
    kind = scores.page_class(n, F.col("doc_id") % 3, (F.col("doc_id") % 10) / 10.0)
    return table(spark, sf_dir, "documents").select("doc_id", records.needs_ocr(kind, n, F.col("doc_id") % 2 == 0).alias("needs_ocr"))


# forms of address

#: Speech by the length of a document: what is said (with two words of the text), who says it, and how its rendering goes wrong.
_SAID = ("I %s you", "You %s me", "We %s", "I %s my %s with you")
_PERSONS = (("I", "you"), ("You", "me"), (), ("I", "my", "you"))
_TOLD = (" {s} said to {l}.", " {l} told {s} so.", " he said.", " {s} said to {l}, and {l} said to {s}.")


def _spoken(persons: tuple[str, ...], form: int, own: str, other: str) -> str:
    """The rendered speech: right, swapped, with neutral pronouns, or swapped with one pronoun too many."""
    first = {0: own, 1: other, 2: "tôi", 3: other}[form]
    second = {0: other, 1: own, 2: "bạn", 3: own}[form]
    said = [first if p.lower() in ("i", "me", "my") else second for p in persons] + ([own] if form == 3 and persons else [])
    text = " x ".join(said) if said else "chúng x"
    return f"“{text[0].upper()}{text[1:]},” nói."


#: The renderings by speech, speaker (0: the first of the couple, 1: the other) and form.
_RENDERED = {(i, w, f): _spoken(p, f, *(("anh", "em") if w == 0 else ("em", "anh"))) for i, p in enumerate(_PERSONS) for w in (0, 1) for f in range(4)}
_ADDRESS_SQL = f"""WITH k AS (SELECT doc_id, length(text) % 4 AS said, length(text) // 4 % 4 AS told, length(text) // 16 % 4 AS form FROM documents),
p AS (SELECT *, CASE WHEN told = 1 THEN 1 ELSE 0 END AS who FROM k WHERE told < 2 AND said <> 2)"""


@query(_ADDRESS_SQL + """
SELECT doc_id AS node_id, ['SWAPPED', 'NEUTRAL', 'OPENING'][form] AS reason FROM p WHERE form > 0""")
def address_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech made of every document, by couples of its project, whose rendering is right or wrong in one of three ways."""
    return address.mismatches(_dialogues(spark, sf_dir), _couples(spark, sf_dir))


@query(_ADDRESS_SQL + """, r(said, who, fixed) AS (VALUES """ + ", ".join(f"({i}, {w}, '{t}')" for (i, w, f), t in _RENDERED.items() if f == 0) + """)
SELECT doc_id AS node_id, fixed FROM p JOIN r ON r.said = p.said AND r.who = p.who WHERE form IN (1, 2)""")
def address_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address.repaired(_dialogues(spark, sf_dir), _couples(spark, sf_dir))


def _dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("project_id"), F.length("text").alias("n"), F.slice(F.split("text", " "), 1, 2).alias("ws"))
    word = lambda i: F.concat(F.lit("q"), F.lower(F.regexp_replace(F.coalesce(F.get("ws", F.lit(i)), F.lit("")), "[^A-Za-z]", "")))
    own, other = F.initcap("project_id"), F.concat(F.lit("Bob "), F.initcap("project_id"), F.lit("son"))
    by = lambda step, texts: F.get(F.array(*texts), (F.floor(F.col("n") / step) % len(texts)).cast("int"))
    said = by(1, [F.format_string(x, *[word(i) for i in range(x.count("%s"))]) for x in _SAID])
    told = by(4, [F.replace(F.replace(F.lit(x), F.lit("{s}"), own), F.lit("{l}"), other) for x in _TOLD])
    who = (F.floor(F.col("n") / 4) % 4 == 1).cast("int")
    at = ((F.col("n") % 4) * 2 + who) * 4 + F.floor(F.col("n") / 16) % 4
    rendered = F.get(F.array(*map(F.lit, _RENDERED.values())), at.cast("int"))
    return d.select(F.col("doc_id").alias("node_id"), "project_id", F.concat(F.lit("“"), said, F.lit(",”"), told).alias("source_text"), rendered.alias("target_text"))


def _couples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the two of every project address each other."""
    p = table(spark, sf_dir, "documents").select(F.col("source").alias("project_id")).distinct()
    own, other = F.initcap("project_id"), F.concat(F.lit("Bob "), F.initcap("project_id"), F.lit("son"))
    one = p.select("project_id", own.alias("speaker"), other.alias("listener"), F.lit("anh").alias("self_term"), F.lit("em").alias("other_term"))
    return one.unionByName(p.select("project_id", other.alias("speaker"), own.alias("listener"), F.lit("em").alias("self_term"), F.lit("anh").alias("other_term")))


# prompts

@query("""WITH t AS (SELECT conv_id, turn, CAST(CASE WHEN text = '' THEN 0 ELSE greatest(1, floor(1.22::DOUBLE * len(regexp_extract_all(text, '\\S+')) + 0.22::DOUBLE * len(regexp_extract_all(text, '[.,;:!?()\\[\\]{}"'']')) + 0.08::DOUBLE * len(regexp_extract_all(text, '[^\\x00-\\x7F]')) + 8)) END AS BIGINT) AS c FROM conversations WHERE text IS NOT NULL),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n, sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM t),
v AS (SELECT conv_id, any_value(n) AS n, sum(c) AS total, max(c) FILTER (i = 1) AS source, max(CASE WHEN upto <= 180 THEN i END) FILTER (i > 1) AS fit FROM u GROUP BY conv_id)
SELECT conv_id, CAST(CASE WHEN total <= 180 THEN 0 WHEN source > 180 THEN n - 1 ELSE n - coalesce(fit, 1) END AS BIGINT) AS dropped, source <= 180 AS fits FROM v""")
def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as requests: the first turn is the source, the others are examples, of which the last go until the rest fits 180 tokens."""
    c = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull())
    ts = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("ts"))
    none = F.array().cast("array<string>")
    r = ts.select("conv_id", *[none.alias(s) for s in prompts.HEADERS if s not in ("source", "examples")], F.slice("ts", 1, 1).alias("source"), F.slice("ts", F.lit(2), F.size("ts")).alias("examples"))
    out = prompts.budgeted(r, window=300)
    return out.select("conv_id", F.coalesce(F.element_at("dropped", "examples"), F.lit(0)).cast("long").alias("dropped"), "fits")

