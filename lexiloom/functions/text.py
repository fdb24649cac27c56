"""Text functions as Column expressions.

Word characters are written out ([\\p{L}\\p{N}_]) because \\w and \\b mean ASCII in Java unless told otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
#: Han ideographs with their extensions, CJK punctuation and full-width forms, as ranges for Java patterns.
CJK_RANGES = (
    r"\x{4E00}-\x{9FFF}", r"\x{3400}-\x{4DBF}", r"\x{F900}-\x{FAFF}", r"\x{20000}-\x{2A6DF}", r"\x{2A700}-\x{2B73F}",
    r"\x{2B740}-\x{2B81F}", r"\x{2B820}-\x{2CEAF}", r"\x{2F800}-\x{2FA1F}", r"\x{3000}-\x{303F}", r"\x{FF01}-\x{FF0F}",
    r"\x{FF1A}-\x{FF20}", r"\x{FF3B}-\x{FF40}", r"\x{FF5B}-\x{FF65}",
)
#: One comparison tells most characters from all the ranges.
CJK = rf"(?=[^\x00-\x{{2FFF}}])[{''.join(CJK_RANGES)}]"
#: CJK and full-width punctuation and what takes its place.
CJK_PUNCTUATION = {
    "，": ", ", "。": ". ", "；": "; ", "：": ": ", "！": "! ", "？": "? ", "、": ", ", "（": " (", "）": ") ",
    "【": " [", "】": "] ", "《": " “", "》": "” ", "～": "~", "—": "—", "…": "...",
}
URL = r"(?i)https?://[^\s)\]}]+|www\.[^\s)\]}]+"
#: Tokens that must survive a rendering letter by letter (code, drive path, unix path, dotted call).
TECHNICAL = r"`[^`\n]+`|[A-Za-z]:\\[^\s,;\"'“”()]+|(?<![\p{L}\p{N}_.])/(?:[\p{L}\p{N}_.-]+/)++[\p{L}\p{N}_.-]*|\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)++\(\)"
#: Compounds whose hyphen stays when a line break falls on it.
COMPOUNDS = (
    "state-of-the-art", "user-friendly", "up-to-date", "real-time", "long-term", "short-term", "cost-effective",
    "well-known", "high-level", "low-level", "decision-making", "cross-cutting", "peer-to-peer", "end-to-end",
    "follow-up", "built-in", "out-of-date", "all-out", "step-by-step", "part-time", "full-time",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind value once for body: what a lambda refers to by its expression is computed again for each element."""
    return F.transform(F.array(value), body)[0]


def by_first(words: Iterable[str]) -> str:
    """A pattern of whole words, grouped by their first letters: a letter that opens none settles a place at once."""
    ends: dict[str, list[str]] = {}
    for w in words:
        ends.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(xs)})" for c, xs in ends.items()) + ")"


def clean(c: Column) -> Column:
    """Trimmed, null where nothing is left."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def words(c: Column) -> Column:
    """Runs of non-blank characters; empty for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def normal_form(c: Column) -> Column:
    """Lower case, blanks collapsed, ends trimmed."""
    return F.array_join(words(F.lower(c)), " ")


def count_of(c: Column, pattern: str) -> Column:
    """Matches of a Java pattern in c; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0)).cast("long")


def count_chars(c: Column, chars: str) -> Column:
    """How often c has any of some characters; 0 for null. Cutting them out is cheaper than a pattern tried on every character, and looking for one is cheaper still."""
    left = reduce(lambda x, y: F.replace(x, F.lit(y), F.lit("")), chars, c)
    return F.when(reduce(or_, [c.contains(y) for y in chars]), F.length(c) - F.length(left)).otherwise(0).cast("long")


def matches(c: Column, pattern: str) -> Column:
    """Array of whole matches; empty for null."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def token_estimate(c: Column) -> Column:
    """Prompt tokens without a tokenizer: words, punctuation and non-ASCII characters, weighted."""
    n = 1.22 * word_count(c) + 0.22 * count_of(c, r"[.,;:!?()\[\]{}\"']") + 0.08 * count_of(c, r"[^\x00-\x7F]") + 8
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n))).cast("long")


def has_no_words(c: Column) -> Column:
    """Not blank, yet without a letter: such nodes pass through unrendered."""
    return clean(c).isNotNull() & ~c.rlike(r"\p{L}")


def snippet(c: Column, n: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def urls(c: Column) -> Column:
    """URLs without the punctuation that ends a sentence."""
    found = F.transform(matches(c, URL), lambda x: F.regexp_replace(x, r"[.,;:!?]+$", ""))
    return F.when(c.contains("://") | F.lower(c).contains("www."), found).otherwise(F.array().cast("array<string>"))


def technical_tokens(c: Column) -> Column:
    found = F.transform(matches(c, TECHNICAL), lambda x: F.regexp_replace(x, r"[.,;:]+$", ""))
    return F.when(c.contains("`") | c.contains(":\\") | c.contains("/") | c.contains("()"), found).otherwise(F.array().cast("array<string>"))


def sentences(c: Column) -> Column:
    """Split behind . ! ? … and a blank, or at line breaks."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?…])\s+|\n+"), lambda x: F.trim(x) != "")


def word_set(c: Column) -> Column:
    return F.array_distinct(matches(F.lower(c), WORD + "+"))


def latin_punctuation(c: Column) -> Column:
    """CJK punctuation as Latin punctuation with its blanks."""
    for mark, latin in CJK_PUNCTUATION.items():
        c = F.replace(c, F.lit(mark), F.lit(latin))
    return c


def without_cjk(c: Column) -> Column:
    """The text without ideographs and their punctuation, single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, CJK, ""), r"[ \t]+", " "))


def foreign_script(source: Column, target: Column) -> Column:
    """CJK characters of the target that the source does not have."""
    return F.when(target.rlike(CJK), F.array_except(matches(target, CJK), matches(source, CJK))).otherwise(F.array().cast("array<string>"))


def repair_hyphenation(c: Column) -> Column:
    """Join words that a line break parts; known compounds and capitals keep their hyphen, and the match keeps its case."""
    out = c
    for compound in COMPOUNDS:
        parts = compound.split("-")
        for i in range(1, len(parts)):
            out = F.regexp_replace(out, rf"(?i)\b({re.escape('-'.join(parts[:i]))})-\s*\n\s*({re.escape('-'.join(parts[i:]))})\b", "$1-\u0001$2")
    out = F.regexp_replace(out, r"([a-zA-Z]+)-\s*\n\s*(\p{Lu}[a-zA-Z]*)", "$1-$2")
    out = F.regexp_replace(out, r"([a-zA-Z]+)-\s*\n\s*([a-zA-Z]+)", "$1$2")
    return F.replace(out, F.lit("\u0001"), F.lit(""))


def join_lines(c: Column) -> Column:
    """Lines of a paragraph as one line, hyphenated breaks joined."""
    return F.regexp_replace(F.trim(F.regexp_replace(repair_hyphenation(c), r"\s*\n\s*", " ")), r"[ \t]+", " ")


def normalize_safely(c: Column) -> Column:
    """Line feeds only, single blanks, at most one empty line; straight dialogue quotes become curly where they pair up and the text holds no code."""
    x = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]+", " ")
    x = F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))
    parts = F.split(x, '"', -1)
    quoted = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.concat(F.lit("“"), p, F.lit("”"))).otherwise(p)), "")
    return F.when((F.size(parts) % 2 == 1) & ~x.contains("`"), quoted).otherwise(x)


def term_pattern(term: Column) -> Column:
    """A Java pattern that finds a term as whole words, with s, es, ed or ing after purely Latin terms; case is ignored."""
    t = F.trim(term)
    tail = F.when(t.rlike(r"^[A-Za-z][A-Za-z\s'-]*$"), F.lit("(?:s|es|ed|ing)?")).otherwise(F.lit(""))
    return F.concat(F.lit(rf"(?iu)(?<!{WORD})\Q"), t, F.lit(r"\E"), tail, F.lit(rf"(?!{WORD})"))


def has_term(text: Column, term: Column) -> Column:
    return F.coalesce((F.trim(term) != "") & F.regexp_like(text, term_pattern(term)), F.lit(False))
