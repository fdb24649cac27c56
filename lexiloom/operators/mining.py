"""Mining of edits and names: style rules from corrections, entities, and the entity ledger."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as tx


def edit_words(text: str) -> list[str]:
    """The words of a text as edits compare them: composed characters, without marks at their ends, case folded."""
    bare = (re.sub(r"^\W+|\W+$", "", w) for w in unicodedata.normalize("NFC", text or "").split())
    return [w.casefold() for w in bare if w]


def edit_hunks(before: str, after: str, most: int = 4) -> list[tuple[str, str]]:
    """Word runs that an edit put in place of others, as (avoid, prefer) in the form of edit_words.

    Changes that a single kept word parts are one. Runs over `most` words, with digits, and single deleted words are no style;
    texts less than half alike are another text.
    """
    a, b = edit_words(before), edit_words(after)
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    if not a or not b or a == b or m.ratio() < 0.5:
        return []
    kept = [x for x in m.get_matching_blocks() if x.size > 1 or x.a == 0 == x.b or not x.size or x.a + x.size == len(a) and x.b + x.size == len(b)]
    out, i, j = [], 0, 0
    for block in kept:
        avoid, prefer = a[i : block.a], b[j : block.b]
        i, j = block.a + block.size, block.b + block.size
        style = 0 < len(avoid) <= most and len(prefer) <= most and (prefer or len(avoid) > 1) and not re.search(r"\d", " ".join(avoid + prefer))
        if style and avoid != prefer:
            out.append((" ".join(avoid), " ".join(prefer)))
    return out


def mine_rules(edits: DataFrame, disabled: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(project_id, avoid, prefer, occurrences, status) from edits (project_id, node_id, before, after): ACTIVE from `least` distinct nodes on, else CANDIDATE; pairs in `disabled` stay DISABLED."""

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, n, x, y) for p, n, before, after in b.itertuples(index=False) for x, y in edit_hunks(before or "", after or "")]
            yield pd.DataFrame(rows, columns=["project_id", "node_id", "avoid", "prefer"])

    found = edits.select("project_id", "node_id", "before", "after").mapInPandas(diff, "project_id string, node_id string, avoid string, prefer string")
    rules = found.groupBy("project_id", "avoid", "prefer").agg(F.count_distinct("node_id").alias("occurrences"))
    status = F.when(F.col("occurrences") >= least, "ACTIVE").otherwise("CANDIDATE")
    if disabled is None:
        return rules.withColumn("status", status)
    off = disabled.select("project_id", "avoid", "prefer").distinct().withColumn("_off", F.lit(True))
    return rules.join(off, ["project_id", "avoid", "prefer"], "left").withColumn("status", F.when(F.col("_off"), "DISABLED").otherwise(status)).drop("_off")


def active_rules(rules: DataFrame, k: int = 12) -> DataFrame:
    """At most k active rules a project, most frequent first."""
    w = Window.partitionBy("project_id").orderBy(F.desc("occurrences"), "avoid", "prefer")
    return rules.where(F.col("status") == "ACTIVE").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Labels that are no names.
GENERIC = ("CHAPTER", "SECTION", "TABLE", "FIGURE", "APPENDIX")
_NAME = r"[A-Z][A-Za-z0-9.&'-]*(?:\s+[A-Z][A-Za-z0-9.&'-]*){0,4}"


def source_entities(text: Column) -> Column:
    """Distinct (name, type) of a text as an array: runs of up to five capitalised words, and acronyms (type ACRONYM, over OTHER).

    A leading The, A or An goes; labels are no names, nor are names of two letters or fewer. A single capitalised word counts only
    inside a sentence, and not in a text like a heading (eight words or fewer, no end mark).
    """
    t = F.coalesce(text, F.lit(""))
    heading = (F.size(tx.words(t)) <= 8) & ~F.trim(t).rlike(r"[.!?]$")
    inner = F.regexp_replace(t, r"(^\s*|[.!?:]\s*)(?:(?:The|A|An)\s+)?[A-Z][a-z]*(?![A-Za-z0-9.&'-])(?!\s+[A-Z])", "$1")
    runs = F.transform(tx.matches(F.when(heading, t).otherwise(inner), rf"(?<!{tx.WORD}){_NAME}(?<!{tx.WORD}\.)"), lambda r: F.regexp_replace(F.regexp_replace(r, r"\.+$", ""), r"^(?:The|A|An)\s+", ""))
    plain = lambda n: n.rlike(r"^[A-Z][a-z]*$")
    names = F.filter(runs, lambda n: (F.length(n) > 2) & ~n.isin(*GENERIC) & ~F.lower(n).isin("the", "this", "that") & ~(heading & plain(n)))
    short = F.filter(tx.matches(t, rf"(?<!{tx.WORD})[A-Z][A-Z0-9-]{{1,12}}(?!{tx.WORD})"), lambda n: ~n.isin(*GENERIC))
    return F.array_sort(F.concat(
        F.transform(F.array_distinct(short), lambda n: F.struct(n.alias("name"), F.lit("ACRONYM").alias("type"))),
        F.transform(F.array_except(names, short), lambda n: F.struct(n.alias("name"), F.lit("OTHER").alias("type"))),
    ))


def ledger(observations: DataFrame) -> DataFrame:
    """(project_id, source_key, preferred, first_node_id, occurrences, conflicts) over the whole log of observations (project_id, order_index, node_id, source_key, target_text[, decided]).

    A name enters with the first node whose rendering keeps it (as whole words), unless it is decided before (column
    `decided`: its rendering by decision); occurrences are all observations from there on. A conflict is a later rendering
    that keeps the name though the decision is another.
    """
    decided = F.col("decided") if "decided" in observations.columns else F.lit(None).cast("string")
    o = observations.withColumn("_decided", decided).withColumn("_kept", tx.has_term(F.coalesce("target_text", F.lit("")), F.col("source_key")))
    w = Window.partitionBy("project_id", "source_key")
    first = F.min(F.when(F.col("_kept") | F.col("_decided").isNotNull(), F.struct("order_index", "node_id"))).over(w)
    o = o.withColumn("_first", first).where(F.struct("order_index", "node_id") >= F.col("_first"))
    preferred = F.coalesce(F.max("_decided"), F.first("source_key"))
    other = F.count_if(F.col("_kept") & (F.lower("source_key") != F.lower(F.coalesce("_decided", "source_key"))))
    return o.groupBy("project_id", "source_key").agg(preferred.alias("preferred"), F.min("_first.node_id").alias("first_node_id"), F.count("*").alias("occurrences"), other.alias("conflicts"))
