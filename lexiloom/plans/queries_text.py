"""Queries over text functions and the gate, with their SQL.

The SQL states each rule on its own terms: from the texts alone, not from which defect the fixture put where. Its word lists and
patterns are the library's fixed values again, written for RE2, which has no look-around: words are told by tokens or by the
characters beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import facts, scores, text as tx
from lexiloom.operators import gate
from lexiloom.operators.multiset import multiset_minus
from lexiloom.plans.fixtures import LINES_SQL, PAIRS_SQL, conversation_pairs, lines, pairs
from lexiloom.session import table

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


def joined(xs):  # noqa: ANN001, ANN201
    return F.array_join(xs, ",")


def key_diff(s: Column, t: Column) -> Column:
    """Array of at most one (missing, unexpected): what the key lists of two sides lack of each other. Both lists are bound once."""
    both = tx.let(F.struct(s.alias("s"), t.alias("t")), lambda v: F.struct(joined(multiset_minus(v["s"], v["t"])).alias("missing"), joined(multiset_minus(v["t"], v["s"])).alias("unexpected")))
    return F.filter(F.array(both), lambda d: (d["missing"] != "") | (d["unexpected"] != ""))


def differing(p: DataFrame, keys) -> DataFrame:  # noqa: ANN001
    """(node_id, missing, unexpected). A generator, not a filter, drops the rest: a filter would be pushed below and compute the keys again."""
    return p.select("node_id", F.inline(key_diff(keys(F.col("source_text")), keys(F.col("target_text")))))


@query(f"""WITH {LINES_SQL}
SELECT node_id, array_to_string(list_filter(string_split_regex(lower(content), '\\s+'), lambda x: x <> ''), ' ') AS normal,
  len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '')) AS n_words, length(content) AS n_chars, substr(content, 1, 150) AS snippet
FROM lines""")
def text_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return lines(spark, sf_dir).select("node_id", tx.normal_form(c).alias("normal"), tx.word_count(c).alias("n_words"), F.length(c).cast("long").alias("n_chars"), tx.snippet(c, 150).alias("snippet"))


@query(f"""WITH {LINES_SQL}
SELECT node_id, CAST(greatest(1, floor(1.22::DOUBLE * len(regexp_extract_all(content, '\\S+')) + 0.22::DOUBLE * len(regexp_extract_all(content, '[.,;:!?()\\[\\]{{}}"'']'))
  + 0.08::DOUBLE * len(regexp_extract_all(content, '[^\\x00-\\x7F]')) + 8)) AS BIGINT) AS tokens, NOT regexp_matches(content, '\\p{{L}}') AS no_words
FROM lines""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("node_id", tx.token_estimate(F.col("content")).alias("tokens"), tx.has_no_words(F.col("content")).alias("no_words"))


# References by tokens: a token that ends with a label (whole word, a dot may follow), then one that begins with an identifier.
_REF = r"""
tok AS (SELECT node_id, side, list_filter(string_split_regex(x, '[ \t\n\r\f\v]+'), lambda y: y <> '') AS w FROM (SELECT node_id, 's' AS side, source_text AS x FROM pairs UNION ALL SELECT node_id, 't', target_text FROM pairs)),
step AS (SELECT node_id, side, i, w[i] AS a, w[i + 1] AS b, CASE WHEN i > 1 THEN w[i - 1] ELSE '' END AS p FROM (SELECT *, unnest(generate_series(1, len(w) - 1)) AS i FROM tok WHERE len(w) > 1)),
cut AS (SELECT *, lower(regexp_extract(a, '(?i)(^|[^\p{L}\p{N}_])(figure|fig|hình|table|bảng|chapter|ch|chương|section|sec|mục|phần|tiết)\.?$', 2)) AS label,
  regexp_extract(b, '^(\d+(\.\d+)*|[A-Za-z](\.\d+|-[A-Za-z0-9]+)*)', 1) AS id FROM step),
ref AS (SELECT node_id, side, i, CASE WHEN label IN ('figure', 'fig', 'hình') THEN 'FIGURE' WHEN label IN ('table', 'bảng') THEN 'TABLE' WHEN label IN ('chapter', 'ch', 'chương') THEN 'CHAPTER' ELSE 'SECTION' END || ':' || upper(id) AS k
  FROM cut WHERE label <> '' AND id <> '' AND NOT regexp_matches(substr(b, length(id) + 1), '^([\p{L}\p{N}_-]|\.\d|:[\\/])')
    AND NOT (regexp_matches(p, '(?i)(thư|danh|hạng|chuyên|tiêu)$') AND regexp_matches(a, '(?i)^(figure|fig|hình|table|bảng|chapter|ch|chương|section|sec|mục|phần|tiết)\.?$')))"""


def _minus_sql(keyed: str, name: str) -> str:
    """Multiset differences of the sides of a table (node_id, side, i, k): a key's first occurrences beyond what the other side holds."""
    return f"""
{name}_cnt AS (SELECT *, row_number() OVER (PARTITION BY node_id, side, k ORDER BY i) AS n, count(*) OVER (PARTITION BY node_id, side, k) AS total FROM {keyed}),
{name}_held AS (SELECT node_id, side, k, count(*) AS held FROM {keyed} GROUP BY ALL),
{name}_diff AS (SELECT c.* FROM {name}_cnt c LEFT JOIN {name}_held o ON o.node_id = c.node_id AND o.k = c.k AND o.side <> c.side WHERE n <= total - coalesce(held, 0))"""


_DIFF = "SELECT node_id, coalesce(string_agg(k, ',' ORDER BY i) FILTER (WHERE side = 's'), '') AS missing, coalesce(string_agg(k, ',' ORDER BY i) FILTER (WHERE side = 't'), '') AS unexpected FROM {}_diff GROUP BY node_id"

# Numbers: references are blanked first (label and identifier with the characters beside them), as their numbers do not count.
_NUMBER_RE = r"(?i)[$€£]?\s*[+-]?\d+(?:[.,]\d+)*\s*%?\s*(?:°C|°F|kHz|MHz|GHz|USD|EUR|kg|km|cm|mm|MB|GB|ms|Hz|s)?"
_NO_REF = r"regexp_replace({0}, '(?i)(^|[^\p{{L}}\p{{N}}_])(figure|fig|table|chapter|ch|section|sec)\.?\s+\d+(\.\d+)*', '\1 ', 'g')"
_NUM = rf"""
raw AS (SELECT node_id, side, unnest(generate_series(1, len(ts))) AS i, unnest(ts) AS t FROM (
  SELECT node_id, 's' AS side, regexp_extract_all({_NO_REF.format("source_text")}, '{_NUMBER_RE}') AS ts FROM pairs
  UNION ALL SELECT node_id, 't', regexp_extract_all({_NO_REF.format("target_text")}, '{_NUMBER_RE}') FROM pairs)),
num AS (SELECT *, regexp_extract(t, '([+-]?\d+(?:[.,]\d+)*)', 1) AS r, upper(regexp_extract(t, '(?i)\d\s*%?\s*(°C|°F|kHz|MHz|GHz|USD|EUR|kg|km|cm|mm|MB|GB|ms|Hz|s)$', 1)) AS unit FROM raw),
val AS (SELECT *, CASE WHEN left(r, 1) = '-' THEN '-' ELSE '' END AS sign, regexp_replace(r, '^[+-]', '') AS v FROM num),
dec AS (SELECT *, CASE
    WHEN contains(v, '.') AND contains(v, ',') THEN CASE WHEN regexp_matches(v, '\.\d*$') THEN replace(v, ',', '') ELSE replace(replace(v, '.', ''), ',', '.') END
    WHEN regexp_matches(v, '^\d{{1,3}}[.,]\d{{3}}$') OR regexp_matches(v, '^\d+(?:[.,]\d+){{2,}}$') THEN regexp_replace(v, '[.,]', '', 'g') ELSE replace(v, ',', '.') END AS d FROM val),
zero AS (SELECT *, CASE WHEN contains(d, '.') THEN rtrim(rtrim(d, '0'), '.') ELSE d END AS z0 FROM dec),
number AS (SELECT node_id, side, i, CASE WHEN ltrim(z0, '0') = '' THEN '0' WHEN left(ltrim(z0, '0'), 1) = '.' THEN sign || '0' || ltrim(z0, '0') ELSE sign || ltrim(z0, '0') END
  || '|' || CASE WHEN contains(t, '%') THEN '%' ELSE '' END || '|' || CASE WHEN unit IN ('USD', 'EUR') THEN unit ELSE regexp_extract(t, '^\s*([$€£])', 1) END || '|' || CASE WHEN unit IN ('USD', 'EUR') THEN '' ELSE unit END AS k FROM zero)"""

_URL_RE = r"(?i)https?://[^\s)\]}]+|www\.[^\s)\]}]+"
_URLS = rf"""
url AS (SELECT node_id, side, unnest(generate_series(1, len(us))) AS i, regexp_replace(unnest(us), '[.,;:!?]+$', '') AS k FROM (
  SELECT node_id, 's' AS side, regexp_extract_all(source_text, '{_URL_RE}') AS us FROM pairs UNION ALL SELECT node_id, 't', regexp_extract_all(target_text, '{_URL_RE}') FROM pairs))"""


@query(f"WITH {PAIRS_SQL}, {_NUM}, {_minus_sql('number', 'number')} " + _DIFF.format("number"))
def number_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differing(pairs(spark, sf_dir), facts.number_keys)


@query(f"WITH {PAIRS_SQL}, {_URLS}, {_minus_sql('url', 'url')} " + _DIFF.format("url"))
def url_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differing(pairs(spark, sf_dir), tx.urls)


@query(f"WITH {PAIRS_SQL}, {_REF}, {_minus_sql('ref', 'ref')} " + _DIFF.format("ref"))
def reference_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differing(pairs(spark, sf_dir), facts.reference_keys)


@query(f"""WITH {PAIRS_SQL}
SELECT node_id, CASE WHEN length(trim(target_text)) / length(trim(source_text)) < 0.25 THEN 'POSSIBLE_TRUNCATION' ELSE 'POSSIBLE_ADDED_CONTENT' END AS issue_type
FROM pairs WHERE length(trim(source_text)) > 100 AND trim(target_text) <> '' AND (length(trim(target_text)) / length(trim(source_text)) < 0.25 OR length(trim(target_text)) / length(trim(source_text)) > 3.5)""")
def length_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gate.issues(pairs(spark, sf_dir).where(F.trim("target_text") != ""), codes=("LENGTH_ANOMALY",))
    ratio = F.regexp_extract("message", r"([0-9.,]+)$", 1)
    return found.select("node_id", gate.relabel(F.col("issue_type"), F.replace(ratio, F.lit(","), F.lit("")).cast("double")).alias("issue_type"))


_QUOTES = r"""
side AS (SELECT node_id, project_id, trim(source_text) AS s, trim(target_text) AS t FROM pairs),
marks AS (SELECT *, len(regexp_extract_all(s, '["“”]')) AS qs, len(regexp_extract_all(t, '["“”]')) AS qt,
  len(regexp_extract_all(regexp_replace(s, '(?i)https?://[^\s)\]}]+|www\.[^\s)\]}]+', ' ', 'g'), '\?')) AS as_, len(regexp_extract_all(regexp_replace(t, '(?i)https?://[^\s)\]}]+|www\.[^\s)\]}]+', ' ', 'g'), '\?')) AS at_ FROM side WHERE t <> ''),
added AS (SELECT node_id, project_id, at_ > as_ AS question_added, (qt % 2 = 1 AND qs % 2 = 0) OR (regexp_matches(s, '^["“]') AND NOT regexp_matches(t, '^["“–—-]') AND regexp_matches(t, '^[^"“”]+[,.!?…]\s*["”]')) AS quotes_off FROM marks)"""


@query(f"WITH {PAIRS_SQL}, {_QUOTES} SELECT node_id, question_added, quotes_off FROM added WHERE question_added OR quotes_off")
def added_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gate.issues(pairs(spark, sf_dir).where(F.trim("target_text") != ""), codes=("CONTENT_ADDITION", "QUOTE_UNBALANCED"))
    return found.groupBy("node_id").agg(F.max(F.col("issue_type") == "CONTENT_ADDITION").alias("question_added"), F.max(F.col("issue_type") == "QUOTE_UNBALANCED").alias("quotes_off"))


#: Words of negation, for RE2.
_NOT = r"(?i)(^|[^\p{L}\p{N}_])((must|should|may|did|does|is|are|was|were)\s+not|no\s+longer|cannot|can[''’]?t|never|none|neither|nor|not|[A-Za-z]+n[''’]t)($|[^\p{L}\p{N}_])"


@query(f"""WITH {PAIRS_SQL}
SELECT node_id, 'NEGATION_LOSS' AS issue_type FROM pairs WHERE regexp_matches(source_text, '{_NOT}') AND NOT regexp_matches(target_text, '{_NOT}')""")
def negation_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = facts.negation_lost(F.col("source_text"), F.col("target_text"), "en")
    return pairs(spark, sf_dir).where(lost).select("node_id", F.lit("NEGATION_LOSS").alias("issue_type"))


_HAN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2F800}-\x{2FA1F}\x{3000}-\x{303F}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}]"
_FOREIGN = f"list_filter(list_distinct(regexp_extract_all(target_text, '{_HAN}')), lambda x: NOT contains(source_text, x))"


@query(f"WITH {PAIRS_SQL}, f AS (SELECT node_id, array_to_string(list_sort({_FOREIGN}), '') AS foreign_chars FROM pairs) SELECT * FROM f WHERE foreign_chars <> ''")
def foreign_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_join(F.array_sort(tx.foreign_script(F.col("source_text"), F.col("target_text"))), "")
    return pairs(spark, sf_dir).select("node_id", F.explode(F.filter(F.array(found), lambda x: x != "")).alias("foreign_chars"))


@query()
def language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function words of four languages in every document. No SQL: what an identifier is depends on look-around; tests/test_answers.py counts in Python."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", facts.language_words(F.col("text")).alias("ws"))
    return d.select("doc_id", "lang", F.size("ws").cast("long").alias("n_words"), *[facts.stopword_hits(F.col("ws"), x).alias(f"{x}_hits") for x in ("en", "fr", "de", "es")])


def _word_sql(text: str, words: str) -> str:
    return f"regexp_matches({text}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({words})($|[^\\p{{L}}\\p{{N}}_])')"


#: Wording that makes a source sensitive, for RE2.
_SENSITIVE_SQL = (
    ("if|unless|only if|provided that|except when", 0.18),
    ("may|might|must|shall|should|could|would|likely|unlikely", 0.18),
    ("because|because of|therefore|thus|consequently|as a result", 0.12),
    ("not only|at least|at most|only|all|none|each|every|either|neither|any|both|nothing|nobody|no one", 0.12),
    ("although|however|despite|whereas|rather than|instead of", 0.12),
    ("more than|less than|higher than|lower than|compared with|approximately", 0.12),
)


@query(f"""WITH {PAIRS_SQL}, r AS (
SELECT node_id, CAST(round(least(1.0, 0.05 + {" + ".join(f"CASE WHEN {_word_sql('source_text', w)} THEN {x} ELSE 0 END" for w, x in _SENSITIVE_SQL)}
  + CASE WHEN kind % 5 = 0 THEN 0.25 ELSE 0 END + least(0.30, 0.18 * (kind % 3)) + CASE WHEN kind = 7 THEN 0.16 ELSE 0 END + CASE WHEN kind >= 6 THEN 0.10 ELSE 0 END
  + CASE WHEN source_text <> '' AND target_text <> '' AND abs(greatest(1, len(regexp_extract_all(source_text, '[.!?]+'))) - greatest(1, len(regexp_extract_all(target_text, '[.!?]+')))) >= 2 THEN 0.14 ELSE 0 END), 3) AS DOUBLE) AS risk FROM pairs)
SELECT node_id, risk, CASE WHEN risk >= 0.65 THEN 'HIGH' WHEN risk >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r""")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk with figures of the node (kind of text, repairs, warnings, entities) that the fixture sets by its kind number."""
    kind = F.col("kind")
    risk = scores.risk_score(
        F.col("source_text"), F.col("target_text"), F.when(kind % 5 == 0, "table").otherwise("paragraph"), kind % 3, F.when(kind == 7, F.array(F.lit("LENGTH_ANOMALY"))).otherwise(F.array().cast("array<string>")), F.when(kind >= 6, 3).otherwise(0)
    )
    return pairs(spark, sf_dir).select("node_id", risk.alias("risk")).withColumn("level", scores.risk_level(F.col("risk")))


@query()
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every issue of the gate over the seeded pairs, by project, type and severity. The types that SQL can say are held against it in qa_report; the others by tests/test_answers.py and tests/test_whole.py."""
    return gate.issues(pairs(spark, sf_dir)).groupBy("project_id", "issue_type", "severity").agg(F.count("*").alias("issues"), F.count_distinct("node_id").alias("nodes"))


#: Codes of the flagship: all of the gate but those that tell Vietnamese from other languages, which RE2 cannot say.
REPORTED = (
    "FOREIGN_SCRIPT_CONTAMINATION", "NUMBER_MISMATCH", "NUMBER_ADDITION", "URL_MISMATCH", "URL_ADDITION", "REFERENCE_MISMATCH", "REFERENCE_ADDITION",
    "LENGTH_ANOMALY", "CONTENT_ADDITION", "QUOTE_UNBALANCED", "TECHNICAL_TOKEN_MISMATCH", "NEGATION_LOSS", "NEGATION_RISK",
)
_TECHNICAL_SQL = r"""
sp AS (SELECT node_id, project_id, trim(source_text) AS s, trim(target_text) AS t FROM pairs WHERE trim(target_text) <> ''),
techs AS (SELECT node_id, project_id, t, unnest(regexp_extract_all(s, '`[^`\n]+`')) AS k FROM sp
  UNION ALL SELECT node_id, project_id, t, unnest(regexp_extract_all(s, '[A-Za-z]:\\[^\s,;\"''“”()]+')) FROM sp
  UNION ALL SELECT node_id, project_id, t, regexp_extract(x, '(/([\p{L}\p{N}_.-]+/)+[\p{L}\p{N}_.-]*)', 1) FROM (SELECT node_id, project_id, t, unnest(regexp_extract_all(s, '(?:^|[^\p{L}\p{N}_.])/(?:[\p{L}\p{N}_.-]+/)+[\p{L}\p{N}_.-]*')) AS x FROM sp)
  UNION ALL SELECT node_id, project_id, t, regexp_extract(x, '([A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)+\(\))', 1) FROM (SELECT node_id, project_id, t, unnest(regexp_extract_all(s, '[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+\(\)')) AS x FROM sp)),
tech AS (SELECT DISTINCT node_id, project_id FROM techs WHERE NOT contains(t, rtrim(k, '.,;:')))"""
_REPORT = "\n".join(
    f"  UNION ALL SELECT DISTINCT d.node_id, project_id, '{name}_{what}' FROM {key}_diff d JOIN sp USING (node_id) WHERE side = '{side}'"
    for name, key in (("NUMBER", "number"), ("URL", "url"), ("REFERENCE", "ref"))
    for what, side in (("MISMATCH", "s"), ("ADDITION", "t"))
)


@query(f"""WITH {PAIRS_SQL}, {_NUM}, {_minus_sql('number', 'number')}, {_URLS}, {_minus_sql('url', 'url')}, {_REF}, {_minus_sql('ref', 'ref')}, {_QUOTES}, {_TECHNICAL_SQL},
lost AS (SELECT node_id, project_id, regexp_matches(source_text, '{_NOT}') AND NOT regexp_matches(target_text, '{_NOT}') AS loss,
  {_word_sql('source_text', 'without')} AND NOT regexp_matches(target_text, '{_NOT}') AS risk FROM pairs WHERE trim(target_text) <> '')
SELECT project_id, issue_type, count(*) AS issues FROM (
  SELECT node_id, project_id, 'EMPTY_TRANSLATION' AS issue_type FROM pairs WHERE trim(target_text) = ''
  UNION ALL SELECT node_id, project_id, 'FOREIGN_SCRIPT_CONTAMINATION' FROM pairs WHERE trim(target_text) <> '' AND len({_FOREIGN}) > 0
{_REPORT}
  UNION ALL SELECT node_id, project_id, 'LENGTH_ANOMALY' FROM sp WHERE length(s) > 100 AND (length(t) / length(s) < 0.25 OR length(t) / length(s) > 3.5)
  UNION ALL SELECT node_id, project_id, 'CONTENT_ADDITION' FROM added WHERE question_added
  UNION ALL SELECT node_id, project_id, 'QUOTE_UNBALANCED' FROM added WHERE quotes_off
  UNION ALL SELECT node_id, project_id, 'TECHNICAL_TOKEN_MISMATCH' FROM tech
  UNION ALL SELECT node_id, project_id, 'NEGATION_LOSS' FROM lost WHERE loss
  UNION ALL SELECT node_id, project_id, 'NEGATION_RISK' FROM lost WHERE risk AND NOT loss) GROUP BY ALL""")
def qa_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: one narrow pass over every pair, issues counted by project and type."""
    return gate.issues(pairs(spark, sf_dir), "en", codes=REPORTED).groupBy("project_id", "issue_type").agg(F.count("*").alias("issues"))


@query("""SELECT u.conv_id, u.turn, length(a.text) AS n_target, length(u.text) AS n_source
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_pairs(spark, sf_dir).select("conv_id", "turn", F.length("target_text").cast("long").alias("n_target"), F.length("source_text").cast("long").alias("n_source"))


_L, _R, _W = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])", r"[\p{L}\p{N}_]"
#: Tags of linguistic patterns, for RE2.
_TAGS_SQL = (
    ("passive", rf"{_L}(is|are|was|were|be|been|being|get|got)\s+{_W}+(ed|en){_R}"),
    ("nominalization", rf"{_L}{_W}+(tion|sion|ment|ity|ance|ence|al){_R}"),
    ("long_noun_phrase", rf"{_L}the\s+[^.!?;]{{8,}}\s+of\s+[^.!?;]{{3,}}"),
    ("relative_clause", rf"{_L}(which|who|whom|whose|where|that){_R}"),
    ("conditional", rf"{_L}(if|unless|provided that|as long as|whether){_R}"),
    ("modality", rf"{_L}(may|might|must|should|can|could|shall|would|will|need to){_R}"),
    ("causality", rf"{_L}(because|therefore|thus|hence|so that|as a result|due to|resulted from){_R}"),
    ("pronoun_chain", rf"{_L}(he|she|they|it|them|her|him|their|his|its|this|that){_R}"),
    ("idiom", rf"{_L}(break the ice|on the same page|give in|by heart|take with a grain of salt){_R}"),
    ("phrasal_verb", rf"{_L}(look into|set up|follow up|take over|give rise to|carry out|point out|fall back|write down){_R}"),
    ("business_collocation", rf"{_L}(revenue|margin|forecast|stakeholder|churn|sales|budget|client|board|strategy|operational){_R}"),
    ("technical_definition", rf"{_L}(is|are|means|refers to|defined as|component that|function returns|schema){_R}"),
    ("legal_obligation", rf"{_L}(shall|must not|required|prohibited|agreement|licensee|supplier|warranty|statutory){_R}"),
    ("academic_hedging", rf"{_L}(may suggest|suggests|likely|appears|could|not necessarily|broadly consistent){_R}"),
    ("sentence_split", rf"{_L}(then|after that|first){_R}|[.!?](.|\n)*[.!?]"),
    ("sentence_merge", rf"[,;]\s*(and|but|yet|while|so){_R}|{_L}and{_R}"),
    ("discourse_connector", rf"{_L}(however|although|nevertheless|therefore|first|then|finally|except){_R}"),
)


@query("SELECT doc_id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{t}' END" for t, p in _TAGS_SQL) + "], lambda x: x IS NOT NULL)), ',') AS tags FROM documents")
def pattern_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", joined(scores.pattern_tags(F.col("text"))).alias("tags"))
