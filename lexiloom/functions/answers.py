"""What a model answers, as Column expressions: texts and JSON out of fences and prose, cleaning, repeated parts.

JSON is parsed by Spark into variants; an answer that is not JSON after all gives null, never an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions import text as tx

#: Keys under which a single answer or an item may hold its text, and items their node.
TEXT_KEYS = ("translation", "text", "translated_text", "vietnamese", "content", "result")
ITEM_TEXT_KEYS = ("text", "translation", "translated_text", "vietnamese")
ITEM_ID_KEYS = ("node_id", "id")
LIST_KEYS = ("translations", "results", "nodes")
NO_NODES = ("model", "status", "version", "summary", "notes")
#: Remarks behind an answer, and openings before it.
POSTAMBLES = (
    r"(?isu)(?=[LGCN])(?:Lưu\s*[Ýý]|Ghi\s*chú|Chú\s*thích|Note|Notes)\s*[:\-].*$",
    r"(?isu)-\s*Bản dịch đã được.*$",
    r"(?isu)-\s*Đã loại bỏ.*$",
)
PREAMBLES = (
    r"(?iu)^(?:Dưới đây là|Đây là|Bản dịch tiếng Việt|Bản dịch là|Nội dung dịch|Bản dịch:)\s*[:\-]?\s*",
    r"(?iu)^(?:Here is the translation|Vietnamese translation|Translation:)\s*[:\-]?\s*",
)
#: Labels that a rendered heading may have, and those of its source.
HEADING_LABEL = r"(?iu)^(?:Chương|Phần|Mục)\s+[\dIVXLC]+\s*[:.\-–]\s*"
SOURCE_LABEL = r"(?i)\b(?:chapter|part|section)\s+[\dIVXLC]+"
#: Clusters of marks, blanks around marks, straight quotes and dots, and what they become, in this order.
PUNCTUATION = (
    (r"[,;:]+\s*([.!?])", "$1"), (r"([.!?])\s*[,;:]+", "$1"), (r"[,;]{2,}", ", "), (r"\.{4,}", "..."),
    (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"\s+([,.:;!?])", "$1"), (r"([,.:;!?])([^\s\d,.:;!?\"')\]}”’])", "$1 $2"),
    (r"\"([^\"]+)\"", "“$1”"), (r"\s*\.\.\.\s*", "... "), (r"\s+$", ""),
)
#: The inside of a JSON string, captured. Runs are possessive: Java would recurse for every character of a plain alternation.
STRING = r'([^"\\]*+(?:\\.[^"\\]*+)*+)'
VARIANTS = "array<variant>"
ITEMS = "array<struct<node_id:string,text:string>>"


#: What \s stands for, and what Java's $ may stand before at the end of a text, though it is no blank.
BLANKS, LINE_ENDS = " \t\n\x0b\f\r", ("\u0085", "\u2028", "\u2029")


def stripped(c: Column) -> Column:
    """c without blanks at both ends, as the pattern ^\\s+|\\s+$ has it; the pattern itself, tried on every character, only where a line end that is no blank stands last."""

    def of(t: Column) -> Column:
        ends = t.endswith(LINE_ENDS[0]) | t.endswith(LINE_ENDS[1]) | t.endswith(LINE_ENDS[2])
        return F.when(ends, F.regexp_replace(t, r"^\s+|\s+$", "")).otherwise(F.btrim(t, F.lit(BLANKS)))

    return tx.let(c, of)


def unfenced(c: Column) -> Column:
    """The content of the first code fence, or the text without a lone fence."""
    t = stripped(F.coalesce(c, F.lit("")))
    fence = r"(?is)```(?:json)?\s*(.*?)\s*```"
    lone = stripped(F.regexp_replace(F.regexp_replace(t, r"^```[a-zA-Z]*\n?", ""), r"\n?```$", ""))
    return F.when(~t.contains("```"), t).when(t.rlike(fence), stripped(F.regexp_extract(t, fence, 1))).otherwise(lone)


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))


def without_remarks(c: Column) -> Column:
    for pattern in POSTAMBLES:
        c = stripped(F.regexp_replace(c, pattern, ""))
    return c


def json_value(c: Column) -> Column:
    """The one JSON value that a text is, as a variant; null where it is none. Spark's parser alone would pass over whatever follows a value."""
    held = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", VARIANTS)
    return F.when(F.size(held) == 1, F.get(held, F.lit(0)))


def field(v: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def answer_text(c: Column) -> Column:
    """The text of an answer to a single request: of a JSON object's known key (also with curly quotes, also if the JSON is broken), else the answer itself; without fences and remarks."""

    def of(t: Column) -> Column:
        braces = F.regexp_extract(F.translate(t, "“”", '""'), r"(?s)(\{.*\})", 1)
        return tx.let(F.struct(t.alias("t"), braces.alias("b"), json_value(braces).alias("v")), chosen)

    def chosen(x: Column) -> Column:
        held = F.coalesce(*[F.when(is_string(field(x["v"], k, "variant")), field(x["v"], k)) for k in TEXT_KEYS])
        loose = rf'"(?:{"|".join(k for k in TEXT_KEYS if k != "result")})"\s*:\s*"{STRING}"'
        broken = F.when(x["v"].isNull() & x["b"].rlike(loose), unescaped(F.regexp_extract(x["b"], loose, 1)))
        return F.coalesce(held, broken, x["t"])

    return stripped(without_remarks(tx.let(unfenced(c), of)))


def answer_items(c: Column) -> Column:
    """(node_id, text) of an answer to a batch, as an array; items without a node are left out, none are mapped by position.

    Known shapes: a list, an object with a list, an object from nodes to texts; a list or object within prose, with trailing
    commas; or, where the JSON is broken, whatever whole items stand in the text.
    """

    def parsed(t: Column) -> Column:
        cut = F.regexp_replace(F.regexp_extract(t, r"(?s)(\[.*\]|\{.*\})", 1), r",\s*([\}\]])", "$1")
        return F.coalesce(json_value(t), json_value(cut))

    def shapes(x: Column) -> Column:
        v = x["v"]
        kind = F.coalesce(F.schema_of_variant(v), F.lit(""))
        listed = F.coalesce(*[field(v, k, VARIANTS) for k in LIST_KEYS], F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", VARIANTS)))
        items = F.filter(F.transform(listed, item), lambda i: i["node_id"].isNotNull() & (i["node_id"] != ""))
        pairs = F.when(kind.startswith("OBJECT") & listed.isNull(), F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")))
        mapped = F.transform(F.filter(pairs, lambda e: ~F.lower(e["key"]).isin(*NO_NODES)), lambda e: F.struct(e["key"].alias("node_id"), stripped(value(e["value"])).alias("text")))
        none = F.array().cast(ITEMS)
        some = lambda xs: F.when(F.size(xs) > 0, xs)
        return F.coalesce(some(items), some(mapped), some(loose(x["c"], False)), some(loose(x["c"], True)), none)

    def item(i: Column) -> Column:
        held = F.coalesce(*[F.nullif(field(i, k), F.lit("")) for k in ITEM_TEXT_KEYS], F.lit(""))
        return F.struct(F.coalesce(*[F.nullif(field(i, k), F.lit("")) for k in ITEM_ID_KEYS]).alias("node_id"), stripped(held).alias("text"))

    def value(v: Column) -> Column:
        inner = F.coalesce(F.nullif(field(v, "text"), F.lit("")), field(v, "translation"))
        return F.coalesce(F.when(F.schema_of_variant(v).startswith("OBJECT"), inner), F.try_variant_get(v, "$", "string"), F.lit(""))

    def loose(t: Column, text_first: bool) -> Column:
        node, text = r'"(?:node_id|id)"\s*:\s*"([^"]+)"', rf'"(?:{"|".join(ITEM_TEXT_KEYS)})"\s*:\s*"{STRING}"'
        pattern = r"\{\s*" + r"\s*,\s*".join((text, node) if text_first else (node, text)) + r"\s*\}"
        nodes, texts = (F.regexp_extract_all(t, F.lit(pattern), F.lit(g)) for g in ((2, 1) if text_first else (1, 2)))
        return F.transform(F.arrays_zip(nodes.alias("n"), texts.alias("t")), lambda z: F.struct(z["n"].alias("node_id"), stripped(unescaped(z["t"])).alias("text")))

    c = F.coalesce(c, F.lit(""))
    return tx.let(F.struct(c.alias("c"), tx.let(unfenced(c), parsed).alias("v")), shapes)


def unique_paragraphs(c: Column) -> Column:
    """Each paragraph (line) once, at its first place, parted by an empty line."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), stripped)
    return F.array_join(F.array_distinct(F.filter(lines, lambda p: p != "")), "\n\n")


#: So many sentences are kept or not at once.
PART = 64


def unique_sentences(c: Column) -> Column:
    """Sentences without those equal to the last or the last but one that was kept; texts of two sentences or fewer stay."""

    def step(acc: Column, s: Column) -> Column:
        return F.when(F.array_contains(F.slice(acc, F.greatest(F.size(acc) - 1, F.lit(1)), F.lit(2)), s), acc).otherwise(F.concat(acc, F.array(s)))

    def part(acc: Column, p: Column) -> Column:
        return tx.let(F.aggregate(p, acc["last"], step), lambda k: F.struct(F.concat(acc["done"], shown(F.slice(k, F.size(acc["last"]) + 1, F.size(k)))).alias("done"), F.slice(k, F.greatest(F.size(k) - 1, F.lit(1)), F.lit(2)).alias("last")))

    def shown(k: Column) -> Column:
        return F.when(F.size(k) > 0, F.array(F.array_join(k, " "))).otherwise(F.array().cast("array<string>"))

    def kept(f: Column) -> Column:
        # in parts: a list that grows by a sentence is copied for each
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(f) - 1) / PART)), lambda i: F.slice(f, (i * PART + 1).cast("int"), F.lit(PART)))
        none = F.array().cast("array<string>")
        return F.array_join(F.aggregate(parts, F.struct(none.alias("done"), none.alias("last")), part)["done"], " ")

    def of(t: Column) -> Column:
        # a blank first, then what stands before it: looking back from every character costs more
        found = F.filter(F.transform(F.split(t, r"\s(?<=[.!?]\s)\s*"), stripped), lambda s: s != "")
        return tx.let(found, lambda f: F.when(F.size(f) > 2, kept(f)).otherwise(t))

    return tx.let(c, of)


LOOPS = range(60, 20, -5)


def _may_loop(blocks: Column) -> Column:
    """Whether a text may have such a phrase, by its blocks of five characters: then four blocks in a row equal those as many further on as the phrase has."""

    def same(i: Column, by: int) -> Column:
        return reduce(Column.__and__, [F.get(blocks, i + k) == F.get(blocks, i + k + by) for k in range(4)])

    return F.exists(F.sequence(F.lit(0), F.size(blocks)), lambda i: reduce(Column.__or__, [same(i, n // 5) for n in LOOPS]))


def without_loops(c: Column) -> Column:
    """Phrases of 60, 55, ... 25 characters that follow themselves, once each. The patterns, tried on every character, are for texts that may have one."""

    def of(t: Column) -> Column:
        once = reduce(lambda x, n: F.regexp_replace(x, rf"(?s)(?!\s{{{n - 14},}})(.{{{n}}})\1+", "$1"), LOOPS, t)
        return F.when(tx.let(tx.matches(t, r"(?s).{5}"), _may_loop), once).otherwise(t)

    return stripped(tx.let(c, of))


def without_repeats(c: Column) -> Column:
    return without_loops(unique_sentences(unique_paragraphs(c)))


def cleaned(c: Column) -> Column:
    """An answer as running text: out of JSON, Latin punctuation, no openings, remarks or repeats, clean punctuation and blanks, curly quotes."""
    x = tx.latin_punctuation(answer_text(c))
    for pattern in PREAMBLES:
        x = stripped(F.regexp_replace(x, pattern, ""))
    x = without_repeats(without_remarks(x))
    for pattern, by in PUNCTUATION:
        x = F.regexp_replace(x, pattern, by)
    return x


def unwrapped(answer: Column, source: Column) -> Column:
    """An answer without the quotes around all of it, unless they are its own (inner quotes, or a source that opens with one)."""
    inner = F.substr(answer, F.lit(2), F.length(answer) - 2)
    around = answer.rlike('(?s)^(?:".*"|“.*”)$') & (F.length(answer) >= 2)
    own = F.trim(F.coalesce(source, F.lit(""))).rlike('^["“”]') | inner.rlike('["“”]')
    return F.when(around & ~own, stripped(inner)).otherwise(answer)


def output_cap(*texts: Column, factor: float = 2.0, least: int = 256, most: int = 2048) -> Column:
    """Tokens an answer may take: a quarter of the characters asked about, times factor, and 64; within bounds."""
    n = sum((F.length(F.coalesce(t, F.lit(""))) for t in texts), F.lit(0))
    return F.least(F.lit(most), F.greatest(F.lit(least), F.floor(n / 4 * factor + 64))).cast("long")


def heading_line(answer: Column, source: Column) -> Column:
    """A heading's answer without a label that its source does not have; its first line that is not blank, if the source is one line."""
    source = F.coalesce(source, F.lit(""))
    bare = F.when(source.rlike(SOURCE_LABEL), answer).otherwise(F.coalesce(F.nullif(F.regexp_replace(answer, HEADING_LABEL, ""), F.lit("")), answer))
    first = F.get(F.filter(F.transform(F.split(bare, "\n"), stripped), lambda x: x != ""), F.lit(0))
    return F.when(stripped(source).contains("\n") | ~bare.contains("\n"), bare).otherwise(F.coalesce(first, bare))
