"""Records of a project: versions and commits, drafts, issues, glossary changes, configuration, and small decisions over them.

A table is never changed in place: each operation gives the next state as a DataFrame (or several, for one commit), which a
job writes beside the old one and swaps in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as tx
from lexiloom.functions.answers import stripped

#: States of a node.
STATUSES = ("PENDING", "QUEUED", "TRANSLATING", "TRANSLATED", "QA_PENDING", "QA_PASSED", "NEEDS_REVIEW", "FAILED")
MOST_REASONS = 8
DRAFT = "struct<text:string,reasons:array<string>,stage:string,saved_at:string>"


def known_status(status: Column) -> Column:
    """A node's status; unknown and null ones as PENDING."""
    return F.when(status.isin(*STATUSES), status).otherwise("PENDING")


def save(nodes: DataFrame, saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, versions) after saving `saved` (node_id, target_text, saved_at[, created_by]), several rows a node in the order of saved_at.

    nodes: (node_id, content, target_text, status, version, …). Each saved row is a version, numbered on from the node's;
    the node takes the last text and number and is TRANSLATED. Rows for unknown nodes are left out.
    """
    by = F.col("created_by") if "created_by" in saved.columns else F.lit("ai")
    new = saved.select("node_id", F.col("target_text").alias("_text"), "saved_at", by.alias("created_by"))
    new = new.withColumn("_n", F.row_number().over(Window.partitionBy("node_id").orderBy("saved_at", "_text")))
    versions = new.join(nodes.select("node_id", F.col("content").alias("source_content"), F.coalesce("version", F.lit(0)).alias("_v")), "node_id").select(
        "node_id", (F.col("_v") + F.col("_n")).alias("version_number"), "source_content", F.col("_text").alias("target_text"), "created_by", "saved_at"
    )
    last = new.groupBy("node_id").agg(F.max_by("_text", "_n").alias("_text"), F.count("*").alias("_more"))
    changed = {"target_text": F.coalesce("_text", "target_text"), "status": F.when(F.col("_more") > 0, "TRANSLATED").otherwise(F.col("status")), "version": F.coalesce("version", F.lit(0)) + F.coalesce("_more", F.lit(0))}
    return nodes.join(last, "node_id", "left").withColumns(changed).drop("_text", "_more"), versions


def draft(text: Column, reasons: Column, stage: Column, saved_at: Column) -> Column:
    """A draft kept with a node: its text, at most MOST_REASONS distinct reasons, sorted, and when; null for a blank text."""
    kept = F.slice(F.array_sort(F.array_distinct(F.filter(reasons, lambda r: F.coalesce(r, F.lit("")) != ""))), 1, MOST_REASONS)
    made = F.struct(stripped(text).alias("text"), kept.alias("reasons"), stage.alias("stage"), F.date_format(saved_at, "yyyy-MM-dd'T'HH:mm:ss").alias("saved_at"))
    return F.when(stripped(F.coalesce(text, F.lit(""))) != "", made.cast(DRAFT))


def reject(nodes: DataFrame, audits: DataFrame, open_issues: DataFrame, rejected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, audits, issues) after renderings were refused.

    rejected: (project_id, node_id, signature, target_text, errors: array of (type, code, severity, message), saved_at), one row a node.
    An audit is added unless a fresh one has the signature; an issue for each error's type unless one is open for the node;
    SEMANTIC_REPAIR_POLICY is no error of the rendering. Nodes wait for review and keep the text as a draft; what they had stays.
    """
    fresh = audits.where(~F.coalesce("is_stale", F.lit(False))).select("project_id", "node_id", "signature")
    more = rejected.join(fresh, ["project_id", "node_id", "signature"], "left_anti").select("project_id", "node_id", "signature", F.lit(False).alias("is_stale"))
    kinds = F.filter(F.transform("errors", lambda e: F.struct(F.coalesce(e["type"], e["code"], F.lit("SEMANTIC_QA_ERROR")).alias("issue_type"), F.coalesce(e["severity"], F.lit("ERROR")).alias("severity"), F.coalesce(e["message"], F.lit("")).alias("message"))), lambda e: e["issue_type"] != "SEMANTIC_REPAIR_POLICY")
    told = rejected.withColumn("_kinds", kinds)
    key = ["project_id", "node_id", "issue_type"]
    found = told.select("project_id", "node_id", F.inline("_kinds")).groupBy(*key).agg(F.min("severity").alias("severity"), F.min("message").alias("message"))
    have = open_issues.where(F.col("status") == "OPEN").select(*key).distinct()
    issues = open_issues.unionByName(found.join(have, key, "left_anti").withColumn("status", F.lit("OPEN")), allowMissingColumns=True)
    drafts = told.select("node_id", draft(F.col("target_text"), F.transform("_kinds", lambda k: k["issue_type"]), F.lit("SEMANTIC"), F.col("saved_at")).alias("_draft"), F.lit(True).alias("_hit"))
    old = F.col("draft") if "draft" in nodes.columns else F.lit(None).cast(DRAFT)
    after = nodes.join(drafts, "node_id", "left").withColumns({"status": F.when(F.col("_hit"), "NEEDS_REVIEW").otherwise(F.col("status")), "draft": F.coalesce("_draft", old)}).drop("_draft", "_hit")
    return after, audits.unionByName(more, allowMissingColumns=True), issues


def commit(candidates: DataFrame, nodes: DataFrame, memory: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, versions, memory) after committing the candidates (node_id, target_text, saved_at, source_hash, style_hash, glossary_hash, prompt_version, gate_passed, approved) that passed everything.

    All or nothing per node: a candidate that failed any check changes none of the three. The memory keeps the newest row of a key.
    """
    good = candidates.where(F.coalesce(F.col("gate_passed") & F.col("approved"), F.lit(False)) & (F.trim(F.coalesce("target_text", F.lit(""))) != ""))
    after, versions = save(nodes, good)
    key = ["source_hash", "style_hash", "glossary_hash", "prompt_version"]
    both = memory.withColumn("_new", F.lit(0)).unionByName(good.select(*key, F.col("target_text").alias("cached_text"), F.col("saved_at").alias("created_at")).withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc("created_at"), "cached_text")
    return after, versions, both.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n", "_new")


def add_issues(table: DataFrame, new: DataFrame) -> DataFrame:
    """The table with new issues, open, a warning unless they say else."""
    severity = F.coalesce("severity", F.lit("WARNING")) if "severity" in new.columns else F.lit("WARNING")
    return table.unionByName(new.withColumns({"severity": severity, "status": F.lit("OPEN")}), allowMissingColumns=True)


def set_status(table: DataFrame, changes: DataFrame, key: str, allowed: tuple[str, ...]) -> DataFrame:
    """The table with the status that changes (key, status) ask for; what is not allowed changes nothing."""
    c = changes.select(F.col(key), F.upper("status").alias("_to")).where(F.col("_to").isin(*allowed))
    return table.join(c, key, "left").withColumn("status", F.coalesce("_to", "status")).drop("_to")


RULE_STATUSES = ("ACTIVE", "DISABLED", "CANDIDATE")


def patched_term(term: dict[str, Column], patch: dict[str, Column]) -> dict[str, Column]:
    """Columns of a glossary entry after a patch (null: unchanged): lock level and locked follow each other, so do both targets; domain in upper case, blank variants out."""
    level = F.upper(patch["lock_level"])
    level = F.when(level.isin("HARD", "SOFT"), level)
    locked = F.coalesce(level == "HARD", F.when(patch["lock_level"].isNull(), patch["locked"]), term["locked"])
    target = F.coalesce(F.nullif(patch["preferred_target"], F.lit("")), F.nullif(patch["target_term"], F.lit("")))
    variants = F.filter(F.transform(patch["allowed_variants"], F.trim), lambda v: v != "")
    return {
        "locked": locked, "lock_level": F.coalesce(level, F.when(patch["lock_level"].isNull() & patch["locked"].isNotNull(), F.when(patch["locked"], "HARD").otherwise("SOFT")), term["lock_level"]),
        "target_term": F.coalesce(target, term["target_term"]), "preferred_target": F.coalesce(F.nullif(patch["target_term"], F.lit("")), F.nullif(patch["preferred_target"], F.lit("")), term["preferred_target"]),
        "allowed_variants": F.coalesce(variants, term["allowed_variants"]), "domain": F.coalesce(F.upper(F.nullif(patch["domain"], F.lit(""))), term["domain"]),
    }


def lock_maps(entries: DataFrame) -> DataFrame:
    """(lock_level, terms): the glossary as one map for each level, the first target (by name) of equal terms. A glossary is small by nature; a map is its use in a prompt."""
    one = entries.groupBy("lock_level", "source_term").agg(F.min("target").alias("target"))
    return one.groupBy("lock_level").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_term", "target")))).alias("terms"))


def free_decisions(decisions: DataFrame, glossary: DataFrame) -> DataFrame:
    """Entity decisions (source_key) whose name the glossary (source_term) does not have, case aside."""
    return decisions.join(glossary.select(F.lower("source_term").alias("_k")).distinct(), F.lower("source_key") == F.col("_k"), "left_anti")


#: Wording of instructions that ask for less than the whole text.
CONFLICTS = (r"(?iu)(?<![\p{L}\p{N}_])tóm tắt(?![\p{L}\p{N}_])", r"(?iu)(?<![\p{L}\p{N}_])rút gọn(?![\p{L}\p{N}_])", r"(?iu)(?<![\p{L}\p{N}_])bỏ (?:qua|bớt)(?![\p{L}\p{N}_])", r"(?i)\bsummar(?:y|ize)\b", r"(?i)\bom(?:it|ission)\b")


def conflicts(instructions: Column) -> Column:
    found = F.lit(False)
    for p in CONFLICTS:
        found = found | F.coalesce(instructions.rlike(p), F.lit(False))
    return found


def derived_config(level: Column, domain: Column, passing: Column, rewrite: Column, repairs: Column, rewrites: Column) -> Column:
    """What a project's settings come to: quality tier, sentence style, thresholds within their bounds, and how often repairs may run."""
    asked = F.upper(F.coalesce(F.nullif(level, F.lit("")), F.lit("BALANCED")))
    p = F.when(F.coalesce(passing, F.lit(0.8)).between(0, 1), F.coalesce(passing, F.lit(0.8))).otherwise(0.8)
    r = F.coalesce(rewrite, F.lit(0.55))
    return F.struct(
        F.when(asked.isin("OFF", "DETERMINISTIC_ONLY", "FAST"), "FAST").when(asked == "PUBLISHING", "PUBLISHING").otherwise("HIGH_QUALITY").alias("quality_tier"),
        F.when(F.upper(domain).isin("LEGAL", "TECHNICAL", "ACADEMIC"), "PRESERVE").otherwise("MODERATE").alias("sentence_style"), p.alias("passing"),
        F.when((r >= 0) & (r < p), r).otherwise(F.least(F.lit(0.55), F.greatest(F.lit(0.0), p - 0.01))).alias("rewrite"),
        F.greatest(F.lit(0), F.least(F.lit(2), F.coalesce(repairs, F.lit(2)))).cast("long").alias("repairs"), F.greatest(F.lit(0), F.least(F.lit(1), F.coalesce(rewrites, F.lit(1)))).cast("long").alias("rewrites"),
    )


#: Readers, tone and register that a domain is taken for without a profile.
PROFILES = {
    "SELF_HELP": ("general adult readers", "direct, encouraging, conversational", "accessible"),
    "TECHNICAL": ("technical readers", "precise, instructional", "technical"),
    "ACADEMIC": ("academic readers", "formal, neutral", "scholarly"),
    "LEGAL": ("legal readers", "formal, conservative", "legal"),
    "LITERATURE": ("general readers", "narrative, voice-driven", "literary"),
    "BUSINESS": ("business readers", "concise, professional", "professional"),
    "FINANCE": ("finance readers", "precise, analytical", "professional"),
}


def fallback_profile(domain: Column, sample: Column) -> Column:
    """(domain, audience, tone, register, complexity) of a document that has no profile; complex from 28 words a sentence on."""
    d = F.upper(F.coalesce(F.nullif(domain, F.lit("")), F.lit("GENERAL")))
    known = F.create_map(*[x for k, v in PROFILES.items() for x in (F.lit(k), F.struct(*[F.lit(y).alias(n) for n, y in zip(("audience", "tone", "register"), v, strict=True)]))])
    p = F.coalesce(F.element_at(known, d), F.struct(F.lit("general readers").alias("audience"), F.lit("clear, neutral").alias("tone"), F.lit("accessible").alias("register")))
    long = tx.word_count(sample) / F.greatest(F.lit(1), tx.count_of(sample, "[.!?]+")) > 28
    return F.struct(d.alias("domain"), p["audience"].alias("audience"), p["tone"].alias("tone"), p["register"].alias("register"), F.when(long, "high").otherwise("medium").alias("complexity"))


#: Context window and advised window and source tokens by a part of the model's name; the first that fits.
FAMILIES = (("qwen", 8192, 4096, 1200), ("llama", 8192, 4096, 1200), ("gemma", 8192, 4096, 1100), ("mistral", 8192, 4096, 1200), ("mock", 4096, 4096, 1200))


def capabilities(model: Column) -> Column:
    m = F.lower(F.coalesce(model, F.lit("")))
    out = None
    for name, *sizes in reversed(FAMILIES):
        row = F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip(("window", "advised", "source_tokens"), sizes, strict=True)])
        out = F.when(m.contains(name), row).otherwise(out if out is not None else F.struct(*[F.lit(x).cast("long").alias(n) for n, x in (("window", 4096), ("advised", 4096), ("source_tokens", 1200))]))
    return out


def provider_of(model: Column) -> Column:
    return F.when(F.lower(F.coalesce(model, F.lit(""))).rlike("^(?:mock|demo)"), "MOCK").otherwise("MODEL")


def candidate_side(sample_id: Column) -> Column:
    """A or B by the parity of the first byte of the id's SHA-256, so that sides are mixed but the same in every run."""
    return F.when(F.conv(F.substring(F.sha2(sample_id, 256), 1, 2), 16, 10).cast("int") % 2 == 0, "A").otherwise("B")


#: What makes a source hard, in its lower-cased text.
HARD = {
    "negation": r"\b(?:not|never|no|neither|nothing|cannot|can't)\b",
    "double_negation": r"\b(?:no|never|without|not)\b.*\bnot\b",
    "modality": r"\b(?:may|might|must|should|could|shall|would)\b",
    "condition": r"\b(?:if|unless|provided|although|whether)\b",
    "causality": r"\b(?:because|therefore|thus|resulted|so that|rather than)\b",
    "pronoun": r"\b(?:which|who|she|he|they|it|her|him|their)\b",
    "passive": r"\b(?:is|are|was|were|been|be)\s+\w+(?:ed|en)\b",
    "nominalization": r"\b(?:tion|ment|ity|ance|ence)\b",
}


def hard_tags(source: Column) -> Column:
    """Sorted tags of what makes a source hard: HARD, figures (percent, currency or date) and 45 words or more."""
    low = F.lower(F.coalesce(source, F.lit("")))
    figure = F.when(low.contains("%"), "percent").when(low.contains("$"), "currency").when(low.rlike(r"(?U)\b\d+(?:\.\d+)?\b"), "date")
    return F.array_sort(F.array_compact(F.array(*[F.when(low.rlike("(?U)" + p), F.lit(t)) for t, p in HARD.items()], figure, F.when(tx.word_count(low) >= 45, F.lit("long_paragraph")))))


def same_sets(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def first_nodes(nodes: DataFrame, n: int = 20) -> DataFrame:
    """The first n nodes of each project by order_index: a sample that is the feature."""
    return nodes.withColumn("_r", F.row_number().over(Window.partitionBy("project_id").orderBy("order_index", "node_id"))).where(F.col("_r") <= n).drop("_r")


def needs_ocr(page_class: Column, chars: Column, available: Column) -> Column:
    return page_class.isin("SCANNED_PAGE", "MIXED_PAGE") & (chars < 100) & available


def first_documents(files: DataFrame) -> DataFrame:
    """Of each project (project_id, path, extension, uploaded_at) the first document, with the reader that its extension asks for."""
    one = files.withColumn("_r", F.row_number().over(Window.partitionBy("project_id").orderBy("uploaded_at", "path"))).where(F.col("_r") == 1).drop("_r")
    return one.withColumn("reader", F.when(F.col("extension").isin("pdf", "epub", "docx"), F.col("extension")).otherwise("text"))


def confirm_structure(projects: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Projects whose structure is confirmed: one version on, ready for rendering."""
    c = confirmed.select("project_id").distinct().withColumn("_c", F.lit(True))
    hit = F.coalesce("_c", F.lit(False))
    return projects.join(c, "project_id", "left").withColumns({"version": F.when(hit, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")), "stage": F.when(hit, "STRUCTURE_CONFIRMED").otherwise(F.col("stage"))}).drop("_c")


def progress(items: DataFrame) -> DataFrame:
    """Adds done and percent (whole) to the items (run_id, item_no) of runs, item by item."""
    w = Window.partitionBy("run_id")
    done = F.row_number().over(w.orderBy("item_no"))
    return items.withColumn("done", done.cast("long")).withColumn("percent", F.floor(100 * done / F.count("*").over(w)).cast("long"))


#: Where an approval may come from.
APPROVERS = ("QA_EDITOR", "RETRANSLATION_APPROVED", "MANUAL_FINAL")


def memory_verdict(c: dict[str, Column], approvers: tuple[str, ...] = APPROVERS) -> Column:
    """Why an example may not enter the style memory, the first reason in order; INGESTED if none.

    c: explicit (approved by hand), project_id, source_text, target_text, approval_source, scope, errors (of the gate), semantic_ok.
    """
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    return (
        F.when(~F.coalesce(c["explicit"], F.lit(False)), "EXPLICIT_APPROVAL_REQUIRED")
        .when(blank(c["project_id"]) | blank(c["source_text"]) | blank(c["target_text"]), "SOURCE_OR_TARGET_EMPTY")
        .when(~F.coalesce(F.upper(F.trim(c["approval_source"])).isin(*approvers), F.lit(False)), "UNAPPROVED_SOURCE")
        .when(~F.upper(F.coalesce(F.nullif(c["scope"], F.lit("")), F.lit("PROJECT"))).isin("PROJECT", "USER_LOCAL"), "INVALID_SCOPE")
        .when(c["errors"] > 0, "DETERMINISTIC_GATE_FAILED")
        .when(~F.coalesce(c["semantic_ok"], F.lit(False)), "SEMANTIC_APPROVAL_REQUIRED")
        .otherwise("INGESTED")
    )


def ingest(memory: DataFrame, judged: DataFrame, key: list[str]) -> DataFrame:
    """judged (key…, verdict, example_id) with DUPLICATE for those whose key the memory, or an earlier row (by example_id), has."""
    have = memory.select(*key).distinct().withColumn("_have", F.lit(True))
    good = F.col("verdict") == "INGESTED"
    rank = F.row_number().over(Window.partitionBy(*key, good).orderBy("example_id"))
    j = judged.withColumn("_n", rank).join(have, key, "left")
    return j.withColumn("verdict", F.when(good & (F.coalesce("_have", F.lit(False)) | (F.col("_n") > 1)), "DUPLICATE").otherwise(F.col("verdict"))).drop("_n", "_have")


def rule_lines(rules: DataFrame) -> DataFrame:
    """(project_id, line): active rules as lines of a prompt."""
    line = F.when(F.col("prefer") != "", F.format_string('- Avoid "%s", use "%s" (corrected %d times).', "avoid", "prefer", "occurrences")).otherwise(F.format_string('- Avoid "%s"; it can mostly be left out (corrected %d times).', "avoid", "occurrences"))
    return rules.select("project_id", line.alias("line"))


def rule_hints(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(node_id, avoid, prefer): renderings of a project that hold a phrase its active rules avoid, as whole words, case aside.

    Both sides meet on the phrase's first word within the project, without texts; candidates fetch their text to be verified.
    """
    filed = rules.select("project_id", "avoid", "prefer", F.regexp_extract(F.lower("avoid"), rf"({tx.WORD}+)", 1).alias("_w")).where(F.col("_w") != "")
    words = nodes.select("node_id", "project_id", F.explode(F.array_distinct(tx.matches(F.lower("target_text"), tx.WORD + "+"))).alias("_w"))
    near = words.join(filed, ["project_id", "_w"]).select("node_id", "avoid", "prefer").distinct()
    whole = F.concat(F.lit(rf"(?iu)(?<!{tx.WORD})\Q"), F.col("avoid"), F.lit(rf"\E(?!{tx.WORD})"))
    return near.join(nodes.select("node_id", "target_text"), "node_id").where(F.regexp_like("target_text", whole)).select("node_id", "avoid", "prefer")
