"""The quality gate: deterministic checks of a rendering against its source, as issue rows.

All row-local checks are one projection: an array of nullable issue structs, compacted and exploded; nothing is shuffled.
Term checks join the glossary (lexiloom.operators.terms) and are united with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import facts, text as tx
from lexiloom.operators.multiset import multiset_minus
from lexiloom.stages import staged

ERROR, WARNING, INFO = "ERROR", "WARNING", "INFO"
ISSUES = "array<struct<code:string,severity:string,detail:string>>"
QUOTES = "\"“”"
LABEL = r"\b(?:Chapter|Section|Figure|Table|Appendix|Part)\s+\d+(?:\.\d+\b)*+\b"
#: Plain English words that are no syllable of the target language.
RESIDUE = (
    "the", "and", "of", "with", "that", "this", "these", "those", "is", "are", "was", "were", "been",
    "have", "has", "had", "would", "could", "should", "nobody", "somebody", "everybody", "anybody",
    "nothing", "something", "everything", "anything", "never", "always", "said", "because", "which",
    "what", "when", "where", "there", "their", "they", "she", "his", "her", "him", "from", "into",
    "about", "then", "just", "very", "only", "also", "not", "however", "therefore", "although",
)
#: English words that open a sentence; they are left over where the next word is in lower case.
OPENINGS = (
    "Since", "The", "However", "Although", "Because", "When", "While", "If", "But", "And", "This", "That", "These",
    "Those", "There", "It", "What", "Which", "Nobody", "Nothing", "Everything",
)
#: What parts tokens, the shape of a Vietnamese syllable without marks, lower-case Roman numbers.
PARTING = r"\s“”\"()\[\]—–,;:.!?"
SYLLABLE = r"^(?:ngh|ng|nh|ch|gh|gi|kh|ph|qu|th|tr|b|c|d|g|h|k|l|m|n|p|r|s|t|v|x)?[aeiouy]+(?:ng|nh|ch|c|m|n|p|t)?$"
ROMAN = r"^x{0,3}(?:ix|iv|v?i{0,3})$"
ASCII_WORD = r"(?<![\p{L}\p{N}_@#$%&+=/\\.-])[A-Za-z]+(?![\p{L}\p{N}_@/\\-]|\.[\p{L}\p{N}_])"
#: Loan words, units and abbreviations that a Vietnamese text may hold.
LOANWORDS = (
    "ok", "email", "internet", "online", "offline", "video", "web", "website", "blog", "game", "file", "app",
    "wifi", "pizza", "taxi", "radio", "piano", "guitar", "violin", "jazz", "rock", "pop", "golf", "tennis",
    "menu", "show", "shop", "laptop", "smartphone", "robot", "virus", "vitamin", "protein", "sandwich",
    "hamburger", "cocktail", "selfie", "livestream", "marketing", "startup", "logo", "slogan", "poster",
    "bar", "sofa", "opera", "yoga", "acid", "ballet", "karaoke", "logic", "ego", "tivi",
    "electron", "proton", "neutron",
    "kg", "km", "cm", "mm", "ml", "mg", "kw", "kwh", "mb", "gb", "tb", "kb", "hz", "mhz", "ghz", "ppm",
    "gram", "inch", "feet", "ounce", "pound", "yard", "mile",
    "tr", "ed", "eds", "trans", "vol", "pp", "ibid", "etc", "vs",
)
#: Every code of the row-local checks, in their order.
CODES = (
    "FOREIGN_SCRIPT_CONTAMINATION", "WRONG_TARGET_LANGUAGE", "NUMBER_MISMATCH", "NUMBER_ADDITION", "URL_MISMATCH", "URL_ADDITION",
    "REFERENCE_MISMATCH", "REFERENCE_ADDITION", "LENGTH_ANOMALY", "CONTENT_ADDITION", "QUOTE_UNBALANCED", "QUANTIFIER_SHIFT",
    "ENGLISH_RESIDUE", "UNTRANSLATED_LABEL", "TECHNICAL_TOKEN_MISMATCH", "NEGATION_LOSS", "NEGATION_RISK",
)


def _issue(when: Column, code: str, severity: str, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail")))


def _some(xs: Column) -> Column:
    return F.size(xs) > 0


def _prose(c: Column) -> Column:
    """Without technical tokens and URLs."""
    bare = F.when(c.contains("`") | c.contains(":\\") | c.contains("/") | c.contains("()"), F.regexp_replace(c, tx.TECHNICAL, " ")).otherwise(c)
    return F.regexp_replace(bare, tx.URL, " ")


def residue(target: Column) -> Column:
    """English function words left in a rendering, sorted: lower-case ones, and capitalised ones that open a sentence before a lower-case word.

    Function words between two capitalised words are part of a name or title; such runs are cut out first, in one pass over
    the text instead of looking up each word's neighbours, and only where there is a function word at all.
    """
    return tx.let(_prose(target), _residue)


def _residue(prose: Column) -> Column:
    word, quote, part = tx.by_first(RESIDUE), "['‘’]*", f"[{PARTING}]"
    gap = f"{quote}{part}+{quote}"
    # each word is seen to its end, so a run need not be given back word by word: Java would keep a frame for each of them
    title = rf"((?=\p{{Lu}})(?:^|(?<=[{PARTING}'‘’]))\p{{Lu}}[^{PARTING}]*?)(?:{gap}{word}(?={quote}{part}))++(?={gap}\p{{Lu}})"
    left = rf"(?:^|{part}){quote}({word})(?={quote}(?:{part}|$))"
    plain = F.regexp_replace(prose, title, "$1 ")
    lower = F.when(prose.rlike(left), F.regexp_extract_all(plain, F.lit(left), F.lit(1))).otherwise(F.array().cast("array<string>"))
    opening = rf"(?=[A-Z])(?:^|(?<=[.!?…:;]\s)|(?<=[“\"(]))({tx.by_first(OPENINGS)})\s+(?=[a-zà-ỹđ])"
    return F.array_sort(F.array_distinct(F.concat(lower, F.regexp_extract_all(prose, F.lit(opening), F.lit(1)))))


#: A word quoted alone; a rendering that lost its opening quote.
QUOTED_WORD = r"[“\"‘']([A-Za-z]+)[”\"’']"
OPENING_LOST = "^[^\"“”]+[,.!?…]\\s*[\"”]"


def foreign_words(source: Column, target: Column, allowed: Column | None = None) -> Column:
    """Words of ASCII letters in a rendering that no Vietnamese syllable looks like, each once, in their order.

    Not counted: loan words, words of `allowed` (an array, lower case; a glossary's targets), function words (residue has
    them), abbreviations and names (a capital inside, or at the front while the source has no such word in lower case), Roman
    numbers, text in parentheses, and a word quoted alone that the source has.
    """
    return tx.let(_prose(target), lambda prose: _foreign_words(source, prose, allowed))


def _foreign_words(source: Column, prose: Column, allowed: Column | None) -> Column:
    """foreign_words of a rendering's prose. What the words are compared with is bound: inside a lambda it would be cut again for each word."""

    def unquoted(bare: Column) -> Column:
        quoted = F.filter(F.regexp_extract_all(bare, F.lit(QUOTED_WORD), F.lit(1)), lambda w: F.contains(F.lower(source), F.lower(w)))
        return F.aggregate(F.array_distinct(quoted), bare, lambda text, w: F.regexp_replace(text, F.concat(F.lit("[“\"‘']"), w, F.lit("[”\"’']")), F.lit(" ")))

    def unknown(w: Column) -> Column:
        low = F.lower(w)
        known = low.isin(*LOANWORDS, *RESIDUE) | low.rlike(SYLLABLE) | w.rlike(ROMAN)
        if allowed is not None:
            known = known | F.array_contains(allowed, low)
        return (F.length(w) >= 2) & ~w.rlike(r"^.+[A-Z]") & ~known

    def capital(w: Column) -> Column:
        return w.rlike(r"^[A-Z]")

    def not_names(words: Column) -> Column:
        own = F.array_distinct(tx.matches(source, rf"(?<!{tx.WORD})[a-z]+(?!{tx.WORD})"))
        left = tx.let(own, lambda have: F.filter(words, lambda w: ~capital(w) | F.array_contains(have, F.lower(w))))
        return F.when(F.exists(words, capital), left).otherwise(words)

    bare = F.when(prose.contains("("), F.regexp_replace(prose, r"\([^()]*\)", " ")).otherwise(prose)
    return tx.let(F.filter(F.array_distinct(tx.matches(tx.let(bare, unquoted), ASCII_WORD)), unknown), not_names)


def gate_issues(source: Column, target: Column, language: str = "vi", codes: tuple[str, ...] = CODES, allowed: Column | None = None) -> Column:
    """Array of (code, severity, detail) for one pair, in the order of the checks; an empty rendering has that issue alone.

    Only the checks of `codes` are built. What several of them need (tokens of both sides, counts) is computed once a side and
    bound. allowed: words that are no residue (see foreign_words).
    """
    s, t = F.trim(F.coalesce(source, F.lit(""))), F.trim(F.coalesce(target, F.lit("")))
    vi = language == "vi"

    def want(*names: str) -> bool:
        return any(n in codes for n in names)

    facts_of = {"NUMBER": facts.number_keys, "URL": tx.urls, "REFERENCE": facts.reference_keys}
    facts_of = {n: f for n, f in facts_of.items() if want(f"{n}_MISMATCH", f"{n}_ADDITION")}

    def sides(x: Column) -> Column:
        return F.struct(x.alias("x"), F.length(x).alias("n"), *[f(x).alias(n) for n, f in facts_of.items()])

    def derived(v: Column) -> Column:
        a, b = v["s"], v["t"]
        out = [a.alias("s"), b.alias("t")]
        for n in facts_of:
            out += [multiset_minus(a[n], b[n]).alias(f"{n}_MISMATCH"), multiset_minus(b[n], a[n]).alias(f"{n}_ADDITION")]
        if want("FOREIGN_SCRIPT_CONTAMINATION", "WRONG_TARGET_LANGUAGE"):
            out.append(tx.foreign_script(a["x"], b["x"]).alias("foreign"))
        if want("CONTENT_ADDITION"):
            out += [F.when(b["x"].contains("?") & x["x"].contains("?"), tx.count_chars(F.regexp_replace(x["x"], tx.URL, " "), "?")).otherwise(0).alias(n) for n, x in (("asks", a), ("asked", b))]
        if want("QUOTE_UNBALANCED"):
            out.append(tx.count_chars(b["x"], QUOTES).alias("quotes"))
        if want("ENGLISH_RESIDUE") and vi:
            out.append(tx.let(_prose(b["x"]), lambda prose: tx.let(_residue(prose), lambda words: F.concat(words, F.array_except(_foreign_words(a["x"], prose, allowed), words)))).alias("residue"))
        if want("UNTRANSLATED_LABEL") and vi:
            out.append(F.filter(tx.matches(b["x"], LABEL), lambda x: ~a["x"].rlike(LABEL) | a["x"].contains(x)).alias("labels"))
        if want("TECHNICAL_TOKEN_MISMATCH"):
            out.append(F.filter(tx.technical_tokens(a["x"]), lambda x: ~b["x"].contains(x)).alias("missing"))
        if want("NEGATION_LOSS", "NEGATION_RISK"):
            out.append(facts.negation_lost(a["x"], b["x"], language).alias("loss"))
        return tx.let(F.struct(*out), checks)

    def checks(v: Column) -> Column:
        s, t = v["s"]["x"], v["t"]["x"]
        ratio = v["t"]["n"] / F.greatest(v["s"]["n"], F.lit(1))
        rules = {
            "FOREIGN_SCRIPT_CONTAMINATION": (True, lambda: _some(v["foreign"]), ERROR, lambda: F.array_join(v["foreign"], "")),
            "WRONG_TARGET_LANGUAGE": (vi, lambda: ~_some(v["foreign"]) & facts.wrong_language(s, t), ERROR, lambda: F.lit("")),
            **{c: (True, lambda c=c: _some(v[c]), ERROR, lambda c=c: F.array_join(v[c], ", ")) for n in facts_of for c in (f"{n}_MISMATCH", f"{n}_ADDITION")},
            "LENGTH_ANOMALY": (True, lambda: (v["s"]["n"] > 100) & ((ratio < 0.25) | (ratio > 3.5)), WARNING, lambda: F.format_number(ratio, 2)),
            "CONTENT_ADDITION": (True, lambda: v["asked"] > v["asks"], ERROR, lambda: v["asked"]),
            "QUOTE_UNBALANCED": (True, lambda: _opening_lost(s, t) | ((v["quotes"] % 2 == 1) & (tx.count_chars(s, QUOTES) % 2 == 0)), ERROR, lambda: v["quotes"]),
            "QUANTIFIER_SHIFT": (vi, lambda: s.rlike(r"(?i)\beither\b") & ~s.rlike(r"(?i)\bboth\b") & t.rlike(rf"(?iu)(?<!{tx.WORD})cả hai(?!{tx.WORD})"), ERROR, lambda: F.lit("")),
            "ENGLISH_RESIDUE": (vi, lambda: _some(v["residue"]), ERROR, lambda: F.array_join(F.slice(v["residue"], 1, 5), ", ")),
            "UNTRANSLATED_LABEL": (vi, lambda: _some(v["labels"]), ERROR, lambda: F.array_join(F.slice(v["labels"], 1, 3), ", ")),
            "TECHNICAL_TOKEN_MISMATCH": (True, lambda: _some(v["missing"]), ERROR, lambda: F.array_join(F.slice(v["missing"], 1, 5), ", ")),
            "NEGATION_LOSS": (True, lambda: v["loss"], ERROR, lambda: F.lit("")),
            "NEGATION_RISK": (True, lambda: ~v["loss"] & facts.negation_risk(s, t, language), WARNING, lambda: F.lit("")),
        }
        found = [_issue(when(), code, severity, detail()) for code, (applies, when, severity, detail) in rules.items() if applies and code in codes]
        return F.array_compact(F.array(*found)) if found else F.array().cast(ISSUES)

    alone = F.array(F.struct(F.lit("EMPTY_TRANSLATION").alias("code"), F.lit(ERROR).alias("severity"), F.lit("").alias("detail")))
    return F.when(t == "", alone).otherwise(tx.let(F.struct(sides(s).alias("s"), sides(t).alias("t")), derived))


def _opening_lost(s: Column, t: Column) -> Column:
    return (s.startswith('"') | s.startswith("“")) & ~t.rlike("^[\"“–—-]") & t.rlike(OPENING_LOST)


def issues(pairs: DataFrame, language: str = "vi", source: str = "source_text", target: str = "target_text", codes: tuple[str, ...] = CODES) -> DataFrame:
    """Rows (project_id, node_id, issue_type, severity, message, source_snippet, translation_snippet), one per issue of the pairs (project_id, node_id, source, target): EMPTY_TRANSLATION and those of `codes`."""
    found = pairs.select("project_id", "node_id", F.col(source).alias("_s"), F.col(target).alias("_t"), F.explode(gate_issues(F.col(source), F.col(target), language, codes)).alias("i"))
    return found.select(
        "project_id", "node_id", F.col("i.code").alias("issue_type"), F.col("i.severity").alias("severity"), F.concat_ws(": ", "i.code", "i.detail").alias("message"), tx.snippet(F.col("_s"), 150).alias("source_snippet"), tx.snippet(F.col("_t"), 150).alias("translation_snippet")
    )


def relabel(issue_type: Column, ratio: Column) -> Column:
    """Names of gate issues in the report: CJK contamination, truncation and added content have their own."""
    return (
        F.when(issue_type == "FOREIGN_SCRIPT_CONTAMINATION", "CONTAINS_CHINESE")
        .when((issue_type == "LENGTH_ANOMALY") & (ratio < 0.25), "POSSIBLE_TRUNCATION")
        .when(issue_type == "LENGTH_ANOMALY", "POSSIBLE_ADDED_CONTENT")
        .otherwise(issue_type)
    )


#: So many distinct words of the earlier texts go to the tasks with their counts; with more, words meet in a join.
KNOWN_WORDS = 50_000


def _meeting(batches: Iterator[pa.RecordBatch], ranked: list[str], opening: set[str], least_words: int, overlap: float) -> Iterator[pa.RecordBatch]:
    """The sentences with a word of `opening` among their rarest; `ranked` has the known words from the rarest on, all others are rarer."""
    known, opens = pa.array(ranked, pa.string()), np.array([w in opening for w in ranked] + [False])
    for b in batches:
        words = b.column(b.schema.get_field_index("a_words"))
        n = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at = pc.index_in(words.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(n)), n)
        at = at[np.lexsort((at, of))]
        place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        rarest = n - np.ceil(overlap * n - 1e-9).astype(int) + 1
        meets = np.zeros(len(n), bool)
        meets[of[(place < rarest[of]) & opens[at]]] = True
        yield b.filter(pa.array(meets & (n >= least_words)))


def context_leaks(nodes: DataFrame, earlier: DataFrame, least_words: int = 6, overlap: float = 0.8, known: int = KNOWN_WORDS) -> DataFrame:
    """(node_id, sentence, leaked_from): sentences of nodes(node_id, text) whose word set overlaps one of earlier(id, text) by `overlap` (Jaccard).

    Candidates come from an equi-join on rare words: each distinct set of words files under its (1 - overlap) n + 1 rarest words,
    which any set at that overlap shares; so there is no cross join. The earlier texts' words are counted: `known` of them
    at most go to the tasks by rank, and sentences are read once, without a shuffle: those whose rarest words meet
    none are left there. With more words, (set, word) rows meet in a join. Words come back for the exact check, sentences for the answer.
    """

    def cut(df: DataFrame, key: str, name: str) -> DataFrame:
        s = df.select(F.col(key).alias(f"{name}_id"), F.explode(F.array_distinct(tx.sentences(F.col("text")))).alias(f"{name}_sentence"))
        return s.select("*", tx.word_set(F.col(f"{name}_sentence")).alias(f"{name}_words"))

    def keyed(s: DataFrame, name: str) -> DataFrame:
        return s.withColumn(f"{name}_key", F.unhex(F.sha2(F.array_join(F.array_sort(f"{name}_words"), " "), 256)))

    def first(n: Column) -> Column:
        return n - F.ceil(overlap * n - 1e-9).cast("int") + 1

    def filed(sets: DataFrame, name: str) -> DataFrame:
        """(key, word) of the rarest words of each distinct word set: as many as a set at the overlap is bound to share."""
        one = sets.select(F.col(f"{name}_key").alias("key"), F.col(f"{name}_words").alias("words")).dropDuplicates(["key"])
        w = one.select("key", F.size("words").alias("n"), F.explode("words").alias("word")).join(rank, "word", "left")
        rarest = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "word"))), F.lit(1), first(F.first("n")))
        return w.groupBy("key").agg(rarest.alias("p")).select(F.col("key").alias(f"{name}_key"), F.explode("p.word").alias("word"))

    b = staged(keyed(cut(earlier, "id", "b").where(F.size("b_words") >= 1).dropDuplicates(["b_id", "b_sentence"]), "b"), "sentences")
    rank = b.select(F.explode("b_words").alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    held = filed(b, "b")
    a = cut(nodes, "node_id", "a")
    ranked = [r[0] for r in rank.orderBy("freq", "word").select("word").limit(known + 1).collect()]
    if len(ranked) <= known:
        opening = {r[0] for r in held.select("word").distinct().collect()}
        a = a.mapInArrow(partial(_meeting, ranked=ranked, opening=opening, least_words=least_words, overlap=overlap), a.schema)
    else:
        a = a.where(F.size("a_words") >= least_words)
    a = staged(keyed(a, "a"), "sentences")
    met = filed(a, "a").join(held, "word").select("a_key", "b_key").distinct()
    same, either = F.size(F.array_intersect("a_words", "b_words")), F.size(F.array_union("a_words", "b_words"))
    a_sets, b_sets = a.select("a_key", "a_words").dropDuplicates(["a_key"]), b.groupBy("b_key").agg(F.min("b_id").alias("b_id"), F.first("b_words").alias("b_words"))
    near = met.join(a_sets, "a_key").join(b_sets, "b_key").where(same / either >= overlap).groupBy("a_key").agg(F.min("b_id").alias("leaked_from"))
    return a.join(near, "a_key").groupBy(F.col("a_id").alias("node_id"), F.col("a_sentence").alias("sentence")).agg(F.min("leaked_from").alias("leaked_from"))
