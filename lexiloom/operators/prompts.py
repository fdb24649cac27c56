"""Prompts within a window: sections in an order of importance, trimmed until they fit, and put together as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as tx
from lexiloom.operators.packing import MARGIN, RESERVED, counts_of, quoted

#: Sections a prompt may lose, first to go first, with how many of their entries stay at least. What is not listed always stays.
TRIMMED = ("examples", "style_notes", "document", "chapter", "following", "previous", "entities", "soft_glossary")
HEADERS = {
    "task": "TASK", "hard_glossary": "TERMS", "entities": "NAMES", "soft_glossary": "PREFERRED TERMS", "document": "DOCUMENT", "chapter": "CHAPTER", "previous": "BEFORE",
    "following": "AFTER", "style_notes": "STYLE", "examples": "EXAMPLES", "source": "SOURCE",
}


def budgeted(requests: DataFrame, window: int = 4096, output_share: float = 0.4, trimmed: tuple[str, ...] = TRIMMED) -> DataFrame:
    """Requests (request_id and an array of text for each name in HEADERS) within the window: adds prompt_tokens, budget, dropped (how many entries went, by section) and fits.

    The answer keeps output_share of the window. Entries go from the end of a section, and a section is emptied before the next
    one is touched. Costs of entries are summed from the end, so that what has to go follows from one comparison a section.
    """
    cost = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda e: tx.token_estimate(e))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    budget = int(window * (1 - output_share))
    r = requests.withColumns({f"_c_{c}": cost(c) for c in HEADERS})
    r = r.withColumn("_over", sum((total(F.col(f"_c_{c}")) for c in HEADERS), F.lit(0).cast("long")) - budget)

    def freed(c: str, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(k.alias("k"), total(F.slice(F.col(f"_c_{c}"), n - k + 1, k)).alias("freed")))

    for c in trimmed:
        n = F.size(f"_c_{c}")
        steps = freed(c, n)  # entries from the end: the least number whose costs reach what is over
        gone = F.coalesce(F.get(F.filter(steps, lambda s: s["freed"] >= F.col("_over")), F.lit(0)), F.get(steps, n))
        r = r.withColumn("_gone", F.when(F.col("_over") <= 0, F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("freed"))).otherwise(gone))
        r = r.withColumns({c: F.slice(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lit(1), n - F.col("_gone.k")), f"_d_{c}": F.col("_gone.k"), "_over": F.col("_over") - F.col("_gone.freed")})
    r = r.withColumn("dropped", F.map_filter(F.create_map(*[x for c in trimmed for x in (F.lit(c), F.col(f"_d_{c}"))]), lambda _, v: v > 0))
    r = r.withColumns({"prompt_tokens": F.col("_over") + budget, "budget": F.lit(budget).cast("long"), "fits": F.col("_over") <= 0})
    return r.drop("_over", "_gone", *[f"_c_{c}" for c in HEADERS], *[f"_d_{c}" for c in trimmed])


def prompt(headers: dict[str, str] = HEADERS) -> Column:
    """The text of a request: each section that has entries under its header."""
    part = lambda c, h: F.when(F.size(c) > 0, F.concat(F.lit(f"[{h}]\n"), F.array_join(c, "\n")))
    return F.concat_ws("\n\n", *[part(c, h) for c, h in headers.items()])


def batch_payload(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by…, payload): the nodes of a batch as JSON (node_id, type, text), in order."""
    rows = F.array_sort(F.collect_list(F.struct("order_index", "node_id", F.col("node_type").alias("type"), F.col("content").alias("text"))))
    return nodes.groupBy(*by).agg(F.to_json(F.struct(F.transform(rows, lambda r: F.struct(r["node_id"].alias("node_id"), r["type"].alias("type"), r["text"].alias("text"))).alias("nodes"))).alias("payload"))


def compact(c: Column, most: int) -> Column:
    """A text in at most `most` characters, cut at a blank where there is one."""
    cut = F.substring(c, 1, most)
    whole = F.regexp_extract(cut, r"(?s)^(.*\S)\s+\S*$", 1)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.when(whole != "", whole).otherwise(cut), F.lit("…")))


# assembly in steps

#: The steps of trimming in their order.
STEPS = (
    "document_memory_compact_1", "document_memory_compact_2", "chapter_memory_compact_1", "chapter_memory_compact_2", "rolling_context_oldest",
    "entity_decisions_optional", "soft_glossary_optional", "style_memory_oldest", "few_shot_reduce", "few_shot_drop_emergency",
    "style_memory_drop_emergency", "optional_style_notes",
)
#: What a chapter's and a document's memory keep when compacted once and twice (characters of texts, entries of lists).
CHAPTER_LEVELS = (
    {"summary": 1200, "entities": 10, "terminology": 10, "pronoun_notes": 8, "tone": 300, "style_notes": 5},
    {"summary": 500, "entities": 5, "terminology": 5, "pronoun_notes": 3},
)
DOCUMENT_LEVELS = (
    {"document_type": None, "source_domain": None, "source_audience": None, "source_tone": None, "source_register": None, "style_observations": 5, "source_summary": 900},
    {"source_domain": None, "source_tone": None, "source_register": None, "source_summary": 400},
)
#: Tokens of labels between sections, the least size at which a lone example is given up, and its share of the window.
LABELS, OVERSIZED = 72, (256, 6)


def compacted(memory: Column, kinds: dict[str, str], keep: dict[str, int | None]) -> Column:
    """A memory (struct) as JSON with the fields of `keep` alone, texts and lists cut to as many characters or entries. kinds: the fields' types."""

    def cut(name: str, most: int | None) -> Column:
        v = memory[name]
        if kinds[name].startswith("array"):
            v = F.coalesce(v, F.array().cast(kinds[name]))
            return v if most is None else F.slice(v, 1, most)
        v = F.coalesce(v, F.lit(""))
        return v if most is None else F.substring(v, 1, most)

    return F.to_json(F.struct(*[cut(n, m).alias(n) for n, m in keep.items()]))


def _json_entry(e: Column, fields: tuple[str, ...]) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{f}": '), quoted(e[f])) for f in fields]), F.lit("}"))


def _json_pair(e: Column, fields: tuple[str, ...]) -> Column:
    return F.concat(quoted(e[fields[0]]), F.lit(": "), quoted(e[fields[1]]))


#: Lists of a request: their fields, how an entry is written (a map's entries are pairs), which end goes first and how many stay at least.
LISTS = {
    "rolling": (("node_id", "source", "translation"), _json_entry, "first", 1),
    "entities": (("source", "target"), _json_pair, "last", 0),
    "soft": (("source_term", "preferred_target"), _json_entry, "last", 0),
    "style": (("source", "translation"), _json_entry, "first", 1),
    "shots": (("source", "target"), _json_entry, "last", 1),
}


def _list_tokens(counts: Column) -> Column:
    """Tokens of a JSON list (or map) whose entries have these counts (words, punctuation, wide characters)."""
    n = F.size(counts)

    def summed(i: int) -> Column:
        return F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c[i])

    sums = [summed(i) for i in range(3)]
    total = 1.22 * F.when(n == 0, 1).otherwise(sums[0]) + 0.22 * (sums[1] + 2 + F.greatest(n - 1, F.lit(0))) + 0.08 * sums[2] + 8
    return F.greatest(F.lit(1), F.floor(total)).cast("long")


def assemble(requests: DataFrame) -> DataFrame:
    """Requests put into their window by giving up what matters least, a step at a time, until they fit.

    requests: request_id, payload (the source as it is sent), document and chapter (structs, see DOCUMENT_LEVELS and
    CHAPTER_LEVELS, fields beyond those are in the full text only), rolling, entities, soft, style and shots (arrays of structs,
    see LISTS; shots also have example_id), hard (array of source_term, preferred_target), system, compact_system, contract
    (texts), rules (array of text), window and most_source (numbers). Nulls are empty.

    Adds trim_steps (which of STEPS were taken, in order) and tokens (a struct of every part, source, reserved, margin, total,
    available_source, fits); document and chapter become the JSON text that is left, system and the lists what is left of them.
    Each section is a list of ever cheaper forms with their costs; the first form that makes the request fit is taken, or
    the last, and what is still over goes to the next section. The terms that are locked, the contract and the source stay.
    """
    types = dict(requests.dtypes)
    r = requests
    for c, (fields, *_) in LISTS.items():
        r = r.withColumn(c, F.coalesce(c, F.array().cast(types[c])))
    est = tx.token_estimate
    limit = F.col("window")
    big = F.greatest(F.lit(OVERSIZED[0]), F.floor(limit / OVERSIZED[1]))

    def sized(c: str) -> Column:
        fields, written, *_ = LISTS[c]
        return F.transform(c, lambda e: F.array(*counts_of(written(e, fields))))

    def without(xs: Column, gone: Column, end: str) -> Column:
        return F.slice(xs, gone + 1, F.size(xs) - gone) if end == "first" else F.slice(xs, F.lit(1), F.size(xs) - gone)

    def forms(c: str) -> Column:
        """Costs of a list with none, one, two and more of its entries given up."""
        _, _, end, least = LISTS[c]
        counts = F.col(f"_n_{c}")
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(counts) - least, F.lit(0))), lambda gone: _list_tokens(without(counts, gone, end)))

    def first_fit(costs: Column) -> Column:
        fit = F.filter(F.sequence(F.lit(0), F.size(costs) - 1), lambda d: F.col("_over") - F.get(costs, F.lit(0)) + F.get(costs, d) <= 0)
        return F.coalesce(F.get(fit, F.lit(0)), F.size(costs) - 1)

    outsize = lambda e: (F.coalesce(e["example_id"], F.lit("")) == "") & (est(_json_entry(e, LISTS["shots"][0])) > big)
    r = r.withColumn("_early", F.exists("shots", outsize)).withColumn("shots", F.filter("shots", lambda e: ~outsize(e)))
    r = r.withColumns({f"_n_{c}": sized(c) for c in LISTS})
    doc, chap = F.col("document"), F.col("chapter")
    parts = lambda name: {f.name: f.dataType.simpleString() for f in requests.schema[name].dataType.fields}
    whole = lambda name: dict.fromkeys(parts(name))
    r = r.withColumns({
        "_document": F.array(*[compacted(doc, parts("document"), k) for k in (whole("document"), *DOCUMENT_LEVELS)]),
        "_chapter": F.array(*[compacted(chap, parts("chapter"), k) for k in (whole("chapter"), *CHAPTER_LEVELS)]),
    })
    levels = {c: F.transform(f"_{c}", est) for c in ("document", "chapter")}
    levels |= {c: forms(c) for c in LISTS}
    hard = F.transform(F.coalesce("hard", F.array().cast(types["hard"])), lambda e: F.array(*counts_of(_json_entry(e, LISTS["soft"][0]))))
    contract = est(F.coalesce("contract", F.lit(""))) + LABELS + est(F.array_join(F.coalesce("rules", F.array().cast("array<string>")), "\n"))
    r = r.withColumns({f"_l_{c}": v for c, v in levels.items()} | {"_hard": _list_tokens(hard), "_contract": contract, "_system": est(F.coalesce("system", F.lit(""))), "_source": est(F.coalesce("payload", F.lit("")))})
    share, more, least, most = RESERVED
    r = r.withColumns({"_reserved": F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.col("_source") * share) + more)).cast("long"), "_margin": F.greatest(F.lit(MARGIN[1]), F.floor(limit * MARGIN[0])).cast("long")})
    always = F.col("_hard") + F.col("_contract") + F.col("_system") + F.col("_source") + F.col("_reserved") + F.col("_margin")
    r = r.withColumn("_over", sum((F.get(f"_l_{c}", F.lit(0)) for c in levels), always) - limit)
    for c in levels:
        costs = F.col(f"_l_{c}")
        r = r.withColumn(f"_k_{c}", first_fit(costs))
        r = r.withColumn("_over", F.col("_over") - F.get(costs, F.lit(0)) + F.get(costs, F.col(f"_k_{c}")))
    for c, (_, _, end, _) in LISTS.items():
        k = F.col(f"_k_{c}")
        r = r.withColumns({c: without(F.col(c), k, end), f"_t_{c}": F.get(f"_l_{c}", k)})
    none = F.array().cast("array<array<bigint>>")
    for c, flag in (("shots", "_late"), ("style", "_style")):
        alone = (F.col("_over") > 0) & (F.size(c) == 1) & (est(_json_entry(F.get(c, F.lit(0)), LISTS[c][0])) > big)
        r = r.withColumn(flag, F.coalesce(alone, F.lit(False))).withColumn("_new", F.when(F.col(flag), _list_tokens(none)).otherwise(F.col(f"_t_{c}")))
        r = r.withColumns({c: F.when(F.col(flag), F.array().cast(types[c])).otherwise(F.col(c)), "_over": F.col("_over") - F.col(f"_t_{c}") + F.col("_new"), f"_t_{c}": F.col("_new")})
    short = (F.col("_over") > 0) & (F.coalesce("compact_system", F.lit("")) != "") & (F.col("compact_system") != F.coalesce("system", F.lit("")))
    r = r.withColumn("_short", F.coalesce(short, F.lit(False))).withColumn("_new", F.when(F.col("_short"), est(F.col("compact_system"))).otherwise(F.col("_system")))
    r = r.withColumns({"system": F.when(F.col("_short"), F.col("compact_system")).otherwise(F.col("system")), "_over": F.col("_over") - F.col("_system") + F.col("_new"), "_system": F.col("_new")})
    taken = {
        "document_memory_compact_1": F.col("_k_document") >= 1, "document_memory_compact_2": F.col("_k_document") >= 2, "chapter_memory_compact_1": F.col("_k_chapter") >= 1, "chapter_memory_compact_2": F.col("_k_chapter") >= 2,
        "rolling_context_oldest": F.col("_k_rolling") > 0, "entity_decisions_optional": F.col("_k_entities") > 0, "soft_glossary_optional": F.col("_k_soft") > 0, "style_memory_oldest": F.col("_k_style") > 0,
        "few_shot_reduce": F.col("_k_shots") > 0, "few_shot_drop_emergency": F.col("_late"), "style_memory_drop_emergency": F.col("_style"), "optional_style_notes": F.col("_short"),
    }
    early = F.when(F.col("_early"), F.lit("few_shot_drop_emergency"))
    total = F.col("_over") + limit
    told = {"system": F.col("_system"), "document": F.get("_l_document", F.col("_k_document")), "chapter": F.get("_l_chapter", F.col("_k_chapter")), **{c: F.col(f"_t_{c}") for c in LISTS}, "hard": F.col("_hard"), "contract": F.col("_contract"), "source": F.col("_source"), "reserved": F.col("_reserved"), "margin": F.col("_margin"), "total": total}
    room = F.least(F.col("most_source"), F.greatest(F.lit(0), limit - (total - F.col("_source"))))
    tokens = F.struct(*[v.cast("long").alias(c) for c, v in told.items()], room.cast("long").alias("available_source"), ((total <= limit) & (F.col("_source") <= room)).alias("fits"))
    r = r.withColumns({"trim_steps": F.array_compact(F.array(early, *[F.when(taken[s], s) for s in STEPS])), "tokens": tokens, "document": F.get("_document", F.col("_k_document")), "chapter": F.get("_chapter", F.col("_k_chapter"))})
    return r.select(*requests.columns, "trim_steps", "tokens")
