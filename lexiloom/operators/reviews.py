"""Reviews by a model: their payloads repaired and validated, claims checked, and what follows from a verdict.

Payloads are JSON text; Spark parses them into variants. A payload that says nothing certain is an ERROR, never a pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as tx
from lexiloom.functions.answers import VARIANTS, field, is_string, json_value, stripped
from lexiloom.operators import issues

#: What a review by meaning checks, the issue that a failed check stands for, the check that an issue fails.
CHECK_ISSUES = {
    "completeness": "SEMANTIC_OMISSION", "meaning": "MEANING_DRIFT", "polarity": "MEANING_DRIFT", "modality": "MODALITY_ERROR",
    "causality": "CAUSALITY_ERROR", "scope": "SCOPE_ERROR", "entity_reference": "ENTITY_REFERENCE_ERROR",
}
ISSUE_CHECKS = {
    "SEMANTIC_OMISSION": "completeness", "SEMANTIC_ADDITION": "completeness", "MEANING_DRIFT": "meaning", "MODALITY_ERROR": "modality",
    "CAUSALITY_ERROR": "causality", "SCOPE_ERROR": "scope", "CONDITION_ERROR": "scope", "COMPARISON_ERROR": "scope",
    "ENTITY_REFERENCE_ERROR": "entity_reference", "PRONOUN_AMBIGUITY": "entity_reference",
}
PASSES = ("PASS", "PASSED", "OK", "TRUE", "YES", "CORRECT")
FAILS = ("FAIL", "FAILED", "FALSE", "NO", "INCORRECT", "PARTIAL", "PARTIALLY", "MOSTLY", "UNCLEAR")
LEAST_CHECKS = 5
MESSAGES = ("message", "description", "explanation", "reason", "details", "comment")
#: Wording that claims an addition, and issue types that such a claim may come as.
ADDED = r"(?i)not (?:present|found|mentioned|in the (?:original|source))|adds?\b|added|introduc|does not appear|absent from"
REFUTABLE = ("SEMANTIC_ADDITION", "ENTITY_REFERENCE_ERROR", "SCOPE_ERROR", "MEANING_DRIFT")
SNIPPET = r"'([^']{3,120})'|\"([^\"]{3,120})\"|“([^”]{3,120})”|‘([^’]{3,120})’|\(([^()]{3,120})\)"
#: Fixed value: what a quote in English looks like.
ENGLISH = r"^[A-Za-z][A-Za-z0-9 ,.;:'’\-]*$"
ISSUE = "struct<type:string,severity:string,message:string,source_span:string,target_span:string>"


def repaired_score(raw: Column, status: Column) -> Column:
    """A score within 0 to 1 from a number or text (a % sign may follow): values over 1 count in tenths or hundreds; without one 1.0 for PASS, 0.4 else; a FAIL has at most 0.6 where it claims 0.9 or more."""
    n = F.regexp_replace(F.trim(raw), r"%+$", "").try_cast("double")
    scaled = F.when(n > 10, n / 100).when(n > 1, n / 10).otherwise(n)
    known = F.coalesce(scaled, F.when(status == "PASS", 1.0).otherwise(0.4))
    bound = F.least(F.lit(1.0), F.greatest(F.lit(0.0), known))
    return F.when((status == "FAIL") & (bound >= 0.9), 0.6).otherwise(bound)


def _lowered(v: Column) -> Column:
    """An object's members by lower-case name; the last of equal names."""
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))


def _member(entries: Column, *names: str) -> Column:
    def first(name: str) -> Column:
        return F.get(F.filter(entries, lambda e: e["key"] == name), F.lit(0))["value"]

    return F.coalesce(*map(first, names))


def _text(entries: Column, *names: str) -> Column:
    """The first of the named members that is text and not blank."""
    found = [F.nullif(stripped(F.try_variant_get(_member(entries, n), "$", "string")), F.lit("")) for n in names]
    return F.coalesce(*found)


def review(payload: Column) -> Column:
    """A review by meaning as a struct (status, score, errors, checks): PASS or FAIL, or ERROR where nothing certain can be read.

    Read in spite of: prose around the JSON, other names for errors and messages, single errors, plain text as an error, checks as
    booleans, numbers or words. What is open counts against the rendering: unknown checks fail if an error is about them, a PASS
    with an error or a failed check is a FAIL. A PASS with fewer than LEAST_CHECKS checks, and a FAIL without a reason, are ERRORs.
    """
    cut = F.regexp_extract(F.coalesce(payload, F.lit("")), r"(?s)(\{.*\})", 1)
    return tx.let(_lowered(json_value(cut)), _read)


def _read(top: Column) -> Column:
    raw = _member(top, "errors", "issues")
    kind = F.coalesce(F.schema_of_variant(raw), F.lit(""))
    listed = F.when(kind.startswith("ARRAY"), F.try_variant_get(raw, "$", VARIANTS)).when(kind.startswith("OBJECT") | is_string(raw), F.array(raw))
    readable = raw.isNull() | listed.isNotNull() | (kind == "VOID")
    errors = F.filter(F.transform(F.coalesce(listed, F.array().cast(VARIANTS)), _error), lambda e: e.isNotNull())
    checks = _lowered(_member(top, "checks"))
    score = F.try_variant_get(_member(top, "score"), "$", "string")
    status = F.upper(F.coalesce(_text(top, "status", "verdict"), F.lit("")))
    parts = F.struct(errors.alias("errors"), checks.alias("checks"), score.alias("score"), status.alias("status"), (readable & top.isNotNull()).alias("readable"))
    return tx.let(parts, lambda p: tx.let(F.struct(p.alias("p"), F.array(*[_check(p["checks"], p["errors"], c) for c in CHECK_ISSUES]).alias("c")), _concluded))


def _error(v: Column) -> Column:
    def of(m: Column) -> Column:
        kind = issues.semantic_type(F.coalesce(_text(m, "type", "category"), F.lit("MEANING_DRIFT")))
        message = F.coalesce(_text(m, *MESSAGES), _text(m, "type", "category"), F.lit("MEANING_DRIFT"))
        return F.struct(kind.alias("type"), issues.semantic_severity(kind).alias("severity"), message.alias("message"), F.coalesce(_text(m, "source_span"), F.lit("")).alias("source_span"), F.coalesce(_text(m, "target_span", "span"), F.lit("")).alias("target_span"))

    plain = stripped(F.try_variant_get(v, "$", "string"))
    alone = F.struct(F.lit("MEANING_DRIFT").alias("type"), F.lit("ERROR").alias("severity"), plain.alias("message"), F.lit("").alias("source_span"), F.lit("").alias("target_span"))
    return F.when(is_string(v), F.when(plain != "", alone)).when(F.schema_of_variant(v).startswith("OBJECT"), tx.let(_lowered(v), of))


def _check(checks: Column, errors: Column, name: str) -> Column:
    v = _member(checks, name)
    inner = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.coalesce(field(v, "status", "variant"), field(v, "result", "variant"))).otherwise(v)
    word, number = F.upper(stripped(F.try_variant_get(inner, "$", "string"))), F.try_variant_get(inner, "$", "double")
    told = F.when(word.isin(*PASSES), "PASS").when(word.isin(*FAILS), "FAIL").when(~is_string(inner) & number.isNotNull(), F.when(number >= 0.9, "PASS").otherwise("FAIL"))
    about = F.exists(errors, lambda e: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ISSUE_CHECKS.items() for x in kv]), e["type"]), F.lit("meaning")) == name)
    return F.struct(F.lit(name).alias("name"), F.coalesce(told, F.when(about, "FAIL").otherwise("PASS")).alias("value"), v.isNotNull().alias("reported"))


def _concluded(x: Column) -> Column:
    p, c = x["p"], x["c"]
    failed = F.filter(c, lambda k: k["value"] == "FAIL")
    bad = (F.size(p["errors"]) > 0) | (F.size(failed) > 0)
    said = F.when(p["status"].isin("PASS", "PASSED", "OK"), "PASS").when(p["status"].isin("FAIL", "FAILED"), "FAIL").otherwise(F.when(bad, "FAIL").otherwise("PASS"))
    status = F.when((said == "PASS") & bad, "FAIL").otherwise(said)
    bare = (status == "PASS") & (F.size(F.filter(c, lambda k: k["reported"])) < LEAST_CHECKS)
    status = F.when(~F.coalesce(p["readable"], F.lit(False)) | bare | ((status == "FAIL") & ~bad), "ERROR").otherwise(status)
    names = F.create_map(*[F.lit(v) for kv in CHECK_ISSUES.items() for v in kv])
    derived = F.transform(failed, lambda k: F.struct(F.element_at(names, k["name"]).alias("type"), issues.semantic_severity(F.element_at(names, k["name"])).alias("severity"), F.concat(F.lit("failed check: "), k["name"]).alias("message"), F.lit("").alias("source_span"), F.lit("").alias("target_span")))
    errors = F.when(status == "FAIL", F.when(F.size(p["errors"]) > 0, p["errors"]).otherwise(derived)).otherwise(F.array().cast(f"array<{ISSUE}>"))
    return F.struct(
        status.alias("status"), F.when(status != "ERROR", repaired_score(p["score"], status)).alias("score"), errors.cast(f"array<{ISSUE}>").alias("errors"),
        F.transform(failed, lambda k: k["name"]).alias("failed_checks"),
    )


def _plain_words(c: Column) -> Column:
    return F.array_join(tx.matches(F.lower(c), r"[a-z0-9]+"), " ")


def refute_additions(source: Column, result: Column) -> Column:
    """A failed review (as of review()) without claims of additions that its own quotes refute: every English quote of the message stands in the source. Without any error left it is a PASS of 0.85 at least."""
    own = F.concat(F.lit(" "), _plain_words(source), F.lit(" "))

    def refuted(e: Column) -> Column:
        quotes = F.transform(tx.matches(e["message"], SNIPPET), lambda q: F.substr(q, F.lit(2), F.length(q) - 2))
        english = F.filter(quotes, lambda q: F.trim(q).rlike(ENGLISH))
        return e["type"].isin(*REFUTABLE) & e["message"].rlike(ADDED) & (F.size(english) > 0) & F.forall(english, lambda q: F.contains(own, F.concat(F.lit(" "), _plain_words(q), F.lit(" "))))

    kept = F.filter(result["errors"], lambda e: ~refuted(e))
    cleared = (result["status"] == "FAIL") & (F.size(result["errors"]) > 0) & (F.size(kept) == 0)
    return F.struct(
        F.when(cleared, "PASS").otherwise(result["status"]).alias("status"), F.when(cleared, F.greatest(F.coalesce(result["score"], F.lit(0.0)), F.lit(0.85))).otherwise(result["score"]).alias("score"),
        F.when(result["status"] == "FAIL", kept).otherwise(result["errors"]).alias("errors"), F.when(cleared, F.array().cast("array<string>")).otherwise(result["failed_checks"]).alias("failed_checks"),
    )


def qa_result(payload: Column) -> Column:
    """A plain quality verdict (status, is_passed, score, issues, error): strict; whatever is not right is an ERROR with its reason."""
    v = json_value(payload)
    told, score, listed = field(v, "is_passed", "variant"), field(v, "score", "variant"), field(v, "issues", VARIANTS)
    number = F.when(~is_string(score) & (F.schema_of_variant(score) != "BOOLEAN"), F.try_variant_get(score, "$", "double"))
    claimed = F.nullif(field(v, "error"), F.lit(""))
    error = (
        F.when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "NOT_AN_OBJECT")
        .when((field(v, "status") == "ERROR") | claimed.isNotNull(), F.coalesce(claimed, F.lit("PROVIDER_ERROR")))
        .when(~F.coalesce(F.schema_of_variant(told) == "BOOLEAN", F.lit(False)), "NO_VERDICT")
        .when(~F.coalesce(number.between(0, 1), F.lit(False)), "BAD_SCORE")
        .when(listed.isNull() | F.exists(listed, lambda i: ~is_string(i)), "BAD_ISSUES")
    )
    passed = F.try_variant_get(told, "$", "boolean")
    return F.struct(
        F.when(error.isNotNull(), "ERROR").when(passed, "PASS").otherwise("FAIL").alias("status"), F.when(error.isNull(), passed).otherwise(False).alias("is_passed"), F.when(error.isNull(), number).alias("score"),
        F.when(error.isNull(), F.transform(listed, lambda i: F.try_variant_get(i, "$", "string"))).otherwise(F.array().cast("array<string>")).alias("issues"), error.alias("error"),
    )


#: The lists of a chapter's memory and how long each may be.
MEMORY_LISTS = {"entities": 20, "key_concepts": 15, "pronoun_notes": 10, "terminology": 30, "important_facts": 15, "style_notes": 10}


def memory_is_valid(payload: Column) -> Column:
    """Whether a chapter memory has exactly its fields, of the right kinds and within their bounds."""
    v = json_value(payload)
    names = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    wanted = F.array(*map(F.lit, ("summary", "tone", *MEMORY_LISTS)))
    ok = (F.size(names) == len(MEMORY_LISTS) + 2) & (F.size(F.array_except(wanted, names)) == 0)
    for name, most in (("summary", 1800), ("tone", 500)):
        ok = ok & is_string(field(v, name, "variant")) & (F.length(field(v, name)) <= most)

    def pair(i: Column) -> Column:
        named = [is_string(field(i, n, "variant")) & (F.length(field(i, n)) <= 200) for n in ("source", "preferred")]
        return F.coalesce((F.size(F.try_variant_get(i, "$", "map<string,variant>")) == 2) & named[0] & named[1], F.lit(False))

    def text(i: Column) -> Column:
        return F.coalesce(is_string(i) & (F.length(F.try_variant_get(i, "$", "string")) <= 500), F.lit(False))

    for name, most in MEMORY_LISTS.items():
        items = field(v, name, VARIANTS)
        ok = ok & items.isNotNull() & (F.size(items) <= most) & F.forall(items, pair if name in ("entities", "terminology") else text)
    return F.coalesce(ok, F.lit(False))


# what follows from verdicts


def original_wins(first: Column, second: Column) -> Column:
    """Whether the original beats its rewrite in both orders (asked as A, then as B); null where an answer is none of A, B, TIE."""
    a, b = F.upper(F.trim(first)), F.upper(F.trim(second))
    known = a.isin("A", "B", "TIE") & b.isin("A", "B", "TIE")
    return F.when(F.coalesce(known, F.lit(False)), (a == "A") & (b == "B"))


def is_heading(kind: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    return k.startswith("heading") | k.isin("title", "subtitle", "caption")


def asks_critic(kind: Column, mode: Column, tier: Column) -> Column:
    """Whether a model judges the style: never headings; ALWAYS and LINT_ONLY decide; else all tiers but HIGH_QUALITY."""
    m = F.upper(F.coalesce(F.nullif(mode, F.lit("")), F.lit("AUTO")))
    return ~is_heading(kind) & F.when(m.isin("ALWAYS", "LINT_ONLY"), m == "ALWAYS").otherwise(F.upper(F.coalesce(tier, F.lit(""))) != "HIGH_QUALITY")


def may_rewrite(kind: Column, mode: Column, domain: Column, types: Column) -> Column:
    """Whether a rewrite may be tried: no headings; where form is bound (mode or domain), not for register, passives and long sentences alone."""
    bound = F.upper(F.coalesce(mode, F.lit("NATURAL"))).isin("FAITHFUL", "ACADEMIC", "TECHNICAL") | F.upper(F.coalesce(domain, F.lit("GENERAL"))).isin("LEGAL", "ACADEMIC", "TECHNICAL")
    mild = (F.size(types) > 0) & (F.size(F.array_except(F.transform(types, F.upper), F.array(*map(F.lit, ("REGISTER", "PASSIVE_VOICE", "SENTENCE_FLOW"))))) == 0)
    return ~is_heading(kind) & ~(bound & mild)


def in_rewrite_range(status: Column, score: Column, rewrite: float = 0.55, passing: float = 0.80) -> Column:
    return F.coalesce((status == "FAIL") & (score >= rewrite) & (score < passing), F.lit(False))


def blocking(found: Column) -> Column:
    """Issues that keep a rendering back: all but INFO; without a severity WARNING."""
    return F.filter(found, lambda i: F.upper(F.coalesce(i["severity"], F.lit("WARNING"))) != "INFO")


def rewrite_issues(found: DataFrame, hints: DataFrame) -> DataFrame:
    """(node_id, type, severity, span, origin): a review's issues (node_id, type, severity, span) and the lint's warnings of types that the review failed, unless their span is already there."""
    types = found.select("node_id", F.upper("type").alias("type")).distinct()
    spans = found.select("node_id", "span").distinct()
    more = hints.where(F.col("severity") == "WARNING").join(types, ["node_id", "type"], "left_semi").join(spans, ["node_id", "span"], "left_anti")
    return found.select("node_id", "type", "severity", "span", F.lit("REVIEW").alias("origin")).unionByName(more.select("node_id", "type", "severity", "span", F.lit("LINT").alias("origin")))


def verdict_issue(status: Column, is_passed: Column) -> Column:
    """What a quality verdict becomes as an issue: QA_ERROR (ERROR), AI_QA_RECOMMENDATION (INFO) or none."""
    one = lambda code, severity: F.struct(F.lit(code).alias("issue_type"), F.lit(severity).alias("severity"))
    return F.when(status == "ERROR", one("QA_ERROR", "ERROR")).when(~F.coalesce(is_passed, F.lit(False)), one("AI_QA_RECOMMENDATION", "INFO"))


def run_counts(reviews: DataFrame, by: list[str]) -> DataFrame:
    """Of a run of reviews (status, cached): reviewed, cached, passed, failed, errors."""
    s = F.col("status")
    return reviews.groupBy(*by).agg(F.count("*").alias("reviewed"), F.count_if(F.col("cached")).alias("cached"), F.count_if(s == "PASS").alias("passed"), F.count_if(s == "FAIL").alias("failed"), F.count_if(s == "ERROR").alias("errors"))


def with_nodes(reviews: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reviews with their node's snippets; reviews of nodes that are gone have none."""
    n = nodes.select("node_id", tx.snippet(F.col("source_text"), 160).alias("source_snippet"), tx.snippet(F.col("target_text"), 160).alias("target_snippet"))
    return reviews.join(n, "node_id", "left")


def publication(approved: Column, locked_kept: Column, style_status: Column, rewritten: Column, veto: Column) -> Column:
    """Whether a rendering goes out: locked names kept, approved by meaning, its style passed, and no veto of the original against a rewrite."""
    return F.when(~F.coalesce(locked_kept, F.lit(False)) | ~F.coalesce(approved, F.lit(False)), "NEEDS_REVIEW").when(F.coalesce(style_status != "PASS", F.lit(True)), "NEEDS_REVIEW").when(F.coalesce(rewritten & veto, F.lit(False)), "KEEP_ORIGINAL").otherwise("APPROVED")


# reviews of style

#: What a review of style checks, other names for its issues and severities, its words for passing and failing.
STYLE_CHECKS = (
    "literal_calque", "word_order", "collocation", "cohesion", "pronoun_reference", "register", "redundancy", "nominalization",
    "passive_voice", "sentence_flow",
)
STYLE_NAMES = {
    "CALQUE": "LITERAL_CALQUE", "LITERAL": "LITERAL_CALQUE", "LITERAL_TRANSLATION": "LITERAL_CALQUE", "PASSIVE": "PASSIVE_VOICE",
    "PRONOUN": "PRONOUN_REFERENCE", "REFERENCE": "PRONOUN_REFERENCE", "FLOW": "SENTENCE_FLOW", "FLUENCY": "SENTENCE_FLOW",
    "GRAMMAR": "SENTENCE_FLOW", "READABILITY": "SENTENCE_FLOW", "STYLE": "REGISTER", "TONE": "REGISTER", "FORMALITY": "REGISTER",
    "REDUNDANT": "REDUNDANCY", "WORDINESS": "REDUNDANCY", "VERBOSITY": "REDUNDANCY", "NOMINALISATION": "NOMINALIZATION",
    "ORDER": "WORD_ORDER", "SYNTAX": "WORD_ORDER", "WORD_CHOICE": "COLLOCATION", "LEXICAL": "COLLOCATION", "COHERENCE": "COHESION",
}
STYLE_TYPES = (*map(str.upper, STYLE_CHECKS), "NATURALNESS_ERROR", "VIETNAMESE_NATURALNESS_ERROR")
STYLE_SEVERITIES = {
    "INFO": "INFO", "LOW": "INFO", "MINOR": "INFO", "NOTE": "INFO", "SUGGESTION": "INFO", "TRIVIAL": "INFO",
    "WARNING": "WARNING", "WARN": "WARNING", "MEDIUM": "WARNING", "MODERATE": "WARNING",
    "ERROR": "ERROR", "HIGH": "ERROR", "MAJOR": "ERROR", "CRITICAL": "ERROR", "SEVERE": "ERROR",
}
STYLE_PASSES, STYLE_FAILS = ("PASS", "PASSED", "OK", "TRUE", "YES", "GOOD"), ("FAIL", "FAILED", "FALSE", "NO", "BAD")
STYLE_STATUS = {"PASS": "PASS", "PASSED": "PASS", "OK": "PASS", "GOOD": "PASS", "NATURAL": "PASS", "FAIL": "FAIL", "FAILED": "FAIL", "NEEDS_REVISION": "FAIL", "UNNATURAL": "FAIL", "ERROR": "ERROR"}
#: Names of style issues in a report.
STYLE_REPORT = {
    "LITERAL_CALQUE": "VIETNAMESE_LITERAL_CALQUE", "WORD_ORDER": "VIETNAMESE_WORD_ORDER", "COLLOCATION": "VIETNAMESE_COLLOCATION",
    "COHESION": "VIETNAMESE_COHESION", "PRONOUN_REFERENCE": "VIETNAMESE_PRONOUN", "REGISTER": "VIETNAMESE_REGISTER",
    "REDUNDANCY": "VIETNAMESE_REDUNDANCY", "NOMINALIZATION": "VIETNAMESE_NOMINALIZATION", "PASSIVE_VOICE": "VIETNAMESE_PASSIVE",
    "SENTENCE_FLOW": "VIETNAMESE_SENTENCE_FLOW",
}


def _named(names: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def style_review(payload: Column) -> Column:
    """A review of style as a struct (status, score, issues, failed_checks), read as kindly as review(): PASS, FAIL, or ERROR where nothing certain can be read.

    Issues that are only INFO keep nothing back. A check that is not told fails if a blocking issue has its type; a PASS with a
    blocking issue or a failed check is a FAIL; a FAIL without either is an ERROR. Without a score a PASS has 0.9, a FAIL 1 less
    0.15 for each blocking issue.
    """
    top = _lowered(json_value(F.regexp_extract(F.coalesce(payload, F.lit("")), r"(?s)(\{.*\})", 1)))
    return tx.let(top, _read_style)


def _style_issue(v: Column) -> Column:
    def of(m: Column) -> Column:
        raw = F.translate(F.upper(F.coalesce(_text(m, "type", "category", "check"), F.lit(""))), " -", "__")
        kind = issues.renamed(raw, STYLE_NAMES)
        kind = F.when(kind.isin(*STYLE_TYPES), kind).otherwise("SENTENCE_FLOW")
        span = F.coalesce(_text(m, "target_span", "span", "text"), F.lit(""))
        severity = F.coalesce(_named(STYLE_SEVERITIES, F.upper(F.coalesce(_text(m, "severity", "level"), F.lit("WARNING")))), F.lit("WARNING"))
        message = F.coalesce(_text(m, *[k for k in MESSAGES if k != "details"]), F.concat_ws(": ", kind, F.nullif(span, F.lit(""))))
        return F.struct(kind.alias("type"), severity.alias("severity"), message.alias("message"), F.coalesce(_text(m, "source_span"), F.lit("")).alias("source_span"), span.alias("target_span"))

    plain = stripped(F.try_variant_get(v, "$", "string"))
    alone = F.struct(F.lit("SENTENCE_FLOW").alias("type"), F.lit("WARNING").alias("severity"), plain.alias("message"), F.lit("").alias("source_span"), F.lit("").alias("target_span"))
    return F.when(is_string(v), F.when(plain != "", alone)).when(F.schema_of_variant(v).startswith("OBJECT"), tx.let(_lowered(v), of))


def _read_style(top: Column) -> Column:
    raw = _member(top, "issues")
    kind = F.coalesce(F.schema_of_variant(raw), F.lit(""))
    listed = F.when(kind.startswith("ARRAY"), F.try_variant_get(raw, "$", VARIANTS)).when(kind.startswith("OBJECT") | is_string(raw), F.array(raw))
    found = F.filter(F.transform(F.coalesce(listed, F.array().cast(VARIANTS)), _style_issue), lambda i: i.isNotNull())
    checks = _member(top, "checks")
    failed = F.transform(F.try_variant_get(checks, "$", VARIANTS), lambda c: F.lower(F.try_variant_get(c, "$", "string")))
    parts = F.struct(
        found.alias("issues"), _lowered(checks).alias("checks"), failed.alias("listed"), F.try_variant_get(_member(top, "score"), "$", "string").alias("score"),
        _named(STYLE_STATUS, F.upper(F.coalesce(_text(top, "status", "verdict"), F.lit("")))).alias("status"), (top.isNotNull() & (raw.isNull() | listed.isNotNull() | (kind == "VOID"))).alias("readable"),
    )
    return tx.let(parts, lambda p: tx.let(F.struct(p.alias("p"), F.array(*[_style_check(p, c) for c in STYLE_CHECKS]).alias("c")), _styled))


def _style_check(p: Column, name: str) -> Column:
    v = _member(p["checks"], name)
    inner = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.coalesce(field(v, "status", "variant"), field(v, "result", "variant"))).otherwise(v)
    word, number = F.upper(stripped(F.try_variant_get(inner, "$", "string"))), F.try_variant_get(inner, "$", "double")
    told = F.when(word.isin(*STYLE_PASSES), "PASS").when(word.isin(*STYLE_FAILS), "FAIL").when(~is_string(inner) & number.isNotNull(), F.when(number >= 0.5, "PASS").otherwise("FAIL"))
    named = F.when(p["listed"].isNotNull(), F.when(F.array_contains(p["listed"], name), "FAIL").otherwise("PASS"))
    about = F.exists(blocking(p["issues"]), lambda i: i["type"] == name.upper())
    return F.struct(F.lit(name).alias("name"), F.coalesce(named, told, F.when(about, "FAIL").otherwise("PASS")).alias("value"))


def _styled(x: Column) -> Column:
    p, failed = x["p"], F.filter(x["c"], lambda k: k["value"] == "FAIL")
    n = F.size(blocking(p["issues"]))
    bad = (n > 0) | (F.size(failed) > 0)
    status = F.when(bad, "FAIL").otherwise(F.coalesce(p["status"], F.lit("PASS")))
    status = F.when(~F.coalesce(p["readable"], F.lit(False)) | (F.coalesce(p["status"], F.lit("")) == "ERROR") | ((status == "FAIL") & ~bad), "ERROR").otherwise(status)
    number = F.regexp_replace(F.trim(p["score"]), r"%+$", "").try_cast("double")
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(number > 10, number / 100).when(number > 1, number / 10).otherwise(number)))
    score = F.coalesce(F.when(number.isNotNull(), scaled), F.when(status == "FAIL", F.greatest(F.lit(0.0), F.round(1 - 0.15 * n, 2))).otherwise(0.9))
    return F.struct(status.alias("status"), F.when(status != "ERROR", score).alias("score"), F.when(status == "ERROR", F.array().cast(f"array<{ISSUE}>")).otherwise(p["issues"].cast(f"array<{ISSUE}>")).alias("issues"), F.transform(failed, lambda k: k["name"]).alias("failed_checks"))


def style_passes(r: Column, threshold: float = 0.80) -> Column:
    """Whether a style review lets a rendering out: PASS at the threshold, nothing that blocks, no failed check."""
    return F.coalesce((r["status"] == "PASS") & (r["score"] >= threshold) & (F.size(blocking(r["issues"])) == 0) & (F.size(r["failed_checks"]) == 0), F.lit(False))


def style_report(r: Column, threshold: float = 0.80) -> Column:
    """The issues of a style review as those of a report (issue_type, severity, message); one of its own where the review does not pass and names none."""
    listed = F.transform(r["issues"], lambda i: F.struct(F.coalesce(_named(STYLE_REPORT, i["type"]), F.lit("VIETNAMESE_NATURALNESS_ERROR")).alias("issue_type"), i["severity"].alias("severity"), i["message"].alias("message")))
    alone = F.array(F.struct(F.lit("VIETNAMESE_NATURALNESS_ERROR").alias("issue_type"), F.when(r["status"] == "ERROR", "ERROR").otherwise("WARNING").alias("severity"), F.lit("below the threshold of style").alias("message")))
    return F.when(~style_passes(r, threshold) & (F.size(r["issues"]) == 0), alone).otherwise(listed)


#: Issues after which a shorter prompt is tried.
RECOVERABLE = ("FOREIGN_SCRIPT_CONTAMINATION", "ENGLISH_RESIDUE", "WRONG_TARGET_LANGUAGE")


def tries_short_prompt(found: Column) -> Column:
    return F.arrays_overlap(F.transform(found, lambda i: i["code"]), F.array(*map(F.lit, RECOVERABLE)))


def policy_signature(medium: Column, high: Column, repairs: Column, warnings: Column) -> Column:
    """A hash of what a review was asked under: thresholds, repairs, and the distinct warnings in upper case and order."""
    told = F.array_sort(F.array_distinct(F.transform(F.coalesce(warnings, F.array().cast("array<string>")), F.upper)))
    return F.sha2(F.to_json(F.struct(high.alias("high"), medium.alias("medium"), repairs.alias("repairs"), told.alias("warnings"))), 256)
