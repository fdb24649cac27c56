"""Facts that a rendering must keep: numbers, references, negation; and the language it is in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions import text as tx

#: Units and currencies of numeric tokens.
UNITS = "°C|°F|kHz|MHz|GHz|USD|EUR|kg|km|cm|mm|MB|GB|ms|Hz|s"
NUMBER = rf"(?i)[$€£]?\s*[+-]?\d+(?:[.,]\d+)*+\s*%?\s*(?:{UNITS})?"
#: Labels of references, English and Vietnamese, and their types.
LABELS = {
    "figure": "FIGURE", "fig": "FIGURE", "hình": "FIGURE", "table": "TABLE", "bảng": "TABLE", "chapter": "CHAPTER",
    "ch": "CHAPTER", "chương": "CHAPTER", "section": "SECTION", "sec": "SECTION", "mục": "SECTION", "phần": "SECTION",
    "tiết": "SECTION",
}
_LABEL = "|".join(sorted(LABELS, key=len, reverse=True))
REFERENCE = (
    rf"(?iu)(?=[{''.join(sorted({k[0] for k in LABELS}))}])(?<!{tx.WORD})(?<!thư )(?<!danh )(?<!hạng )(?<!chuyên )(?<!tiêu )(?:{_LABEL})\.?(?!{tx.WORD})\s+"
    rf"(?:\d+(?:\.\d+)*+|[A-Za-z](?:\.\d+|-[A-Za-z0-9]+)*+)(?![\p{{L}}\p{{N}}_-]|\.\d|:[\\/])"
)
#: What every reference holds: the last letter of a label or its dot, blanks, then a digit or a letter alone.
IN_REFERENCE = rf"[EeGgHhNnRrCcTt.]\s+(?:\d|[A-Za-z\x{{17F}}\x{{212A}}](?!{tx.WORD}))"
#: Explicit negation in English ("must not" and its like hold "not"), shortened negation, and negation in Vietnamese.
NEGATION = r"(?i)(?=[cn])\b(?:no\s+longer|cannot|can['’]?t|never|none|neither|nor|not)\b"
SHORT_NEGATION = r"(?i)\b[A-Za-z]+n['’]t\b"
VI_NEGATION = rf"(?iu)(?<!{tx.WORD})(?:không|chưa|chẳng|chả)(?!{tx.WORD})"
#: Function words by which a language is told.
STOPWORDS = {
    "vi": (
        "và là của có được cho trong với không một những các đã đang này đó từ đến khi về theo nhưng cũng sẽ tại trên dưới "
        "công ty doanh thu phát hành phiên bản mới sử dụng để tăng giảm năm người việc thành nay hoat dong khong duoc can phai nen da"
    ).split(),
    "en": (
        "the a an and or but is are was were be been to of in on for with from by this that these those it its as at not also company "
        "increased revenue expanded overseas can cannot could would should must shall may have has had do does did will into through "
        "enables between without within after before during i you he she we they him her his them their my your our said says told asked "
        "replied never always what when where which who there here about than then just very because if so"
    ).split(),
    "fr": "le la les un une des de du et est en que qui dans pour par sur avec au aux ce cette il elle ne pas plus".split(),
    "de": "der die das und ist ein eine in zu den von mit auf für nicht sich dem des im als auch es an werden".split(),
    "es": "el la los las un una de del y es en que se por para con su al lo como más pero no este esta".split(),
}
#: Words of a text for telling its language, marks of Vietnamese letters in lower case, tokens that are no words, and what each of those tokens holds.
LANGUAGE_WORD = r"[A-Za-zÀ-ỹĐđ]+(?:[-'][A-Za-zÀ-ỹĐđ]+)*+"
VI_MARK = r"[ăâđêôơưáàãéèíìĩóòõúùũýẠ-ỹ]"
IDENTIFIER = r"(?U)(?:https?://\S+|www\.\S+|\b[A-Z][A-Z0-9_+.#/-]{1,}\b|\b\w+[_/.]\w+\b)"
IN_IDENTIFIER = r"[A-Z][A-Z0-9_+.#/-]|[_/.]\S"


def canonical_number(raw: Column) -> Column:
    """The value of a written number as text: the rightmost of . and , is the decimal mark if both occur, a mark before exactly three digits groups, zeros and -0 are trimmed. Works on text, so any length will do."""
    value = F.struct(F.when(raw.startswith("-"), F.lit("-")).otherwise(F.lit("")).alias("sign"), F.regexp_replace(raw, r"^[+-]", "").alias("v"))
    return tx.let(value, lambda x: _canonical(x["sign"], x["v"]))


def _canonical(sign: Column, v: Column) -> Column:
    dot, comma = v.contains("."), v.contains(",")
    dot_last = F.length(v) - F.instr(F.reverse(v), ".") > F.length(v) - F.instr(F.reverse(v), ",")
    both = F.when(dot_last, F.replace(v, F.lit(","), F.lit(""))).otherwise(F.replace(F.replace(v, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    grouped = v.rlike(r"^\d{1,3}[.,]\d{3}$") | v.rlike(r"^\d+(?:[.,]\d+){2,}+$")
    one = F.when(grouped, F.regexp_replace(v, "[.,]", "")).otherwise(F.replace(v, F.lit(","), F.lit(".")))
    x = F.when(dot & comma, both).when(dot | comma, one).otherwise(v)
    x = F.regexp_replace(F.regexp_replace(x, r"^0+(?=\d)", ""), r"(\.\d*?)0+$", "$1")
    return tx.let(F.regexp_replace(x, r"\.$", ""), lambda y: F.when(y == "0", y).otherwise(F.concat(sign, y)))


def number_keys(c: Column) -> Column:
    """Array of value|%|CURRENCY|UNIT in text order; numbers of references do not count."""
    text = F.coalesce(c, F.lit(""))
    plain = F.when(text.rlike(IN_REFERENCE), F.regexp_replace(text, REFERENCE, " ")).otherwise(text)

    def key(token: Column) -> Column:
        value = canonical_number(F.regexp_extract(token, r"([+-]?\d+(?:[.,]\d+)*+)", 1))
        unit = F.upper(F.regexp_extract(token, rf"(?i)\d\s*%?\s*({UNITS})$", 1))
        money = unit.isin("USD", "EUR")
        currency = F.when(money, unit).otherwise(F.regexp_extract(token, r"^\s*([$€£])", 1))
        return F.concat_ws("|", value, F.when(token.contains("%"), "%").otherwise(""), currency, F.when(money, "").otherwise(unit))

    return F.when(c.rlike(r"\d"), F.transform(tx.matches(plain, NUMBER), key)).otherwise(F.array().cast("array<string>"))


def reference_keys(c: Column) -> Column:
    """Array of TYPE:IDENTIFIER in text order; labels of both languages share a type."""
    types = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])

    def key(raw: Column) -> Column:
        label = F.regexp_replace(F.lower(F.regexp_extract(raw, r"^(\S+)\s", 1)), r"\.$", "")
        return F.concat(F.element_at(types, label), F.lit(":"), F.upper(F.regexp_extract(raw, r"\s(\S+)$", 1)))

    return F.when(c.rlike(IN_REFERENCE), F.transform(tx.matches(c, REFERENCE), key)).otherwise(F.array().cast("array<string>"))


def negates(c: Column, language: str = "en") -> Column:
    """Whether a text in English or Vietnamese holds a negation."""
    short = c.contains("'t") | c.contains("’t") | c.contains("'T") | c.contains("’T")
    return {"vi": c.rlike(VI_NEGATION), "en": c.rlike(NEGATION) | (short & c.rlike(SHORT_NEGATION))}[language]


def negation_lost(source: Column, target: Column, language: str = "vi") -> Column:
    return F.coalesce(negates(source) & ~negates(F.coalesce(target, F.lit("")), language), F.lit(False))


def negation_risk(source: Column, target: Column, language: str = "vi") -> Column:
    return F.coalesce(source.rlike(r"(?i)(?=w)\bwithout\b") & ~negates(F.coalesce(target, F.lit("")), language), F.lit(False))


def _words(c: Column) -> Column:
    """Words in lower case without identifiers, which are looked for only where there may be one."""
    plain = F.when(c.rlike(IN_IDENTIFIER), F.regexp_replace(c, IDENTIFIER, " ")).otherwise(c)
    return F.transform(tx.matches(plain, LANGUAGE_WORD), F.lower)


def language_words(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return _words(F.when(text.contains("`"), F.regexp_replace(text, "`[^`]*`", " ")).otherwise(text))


def stopword_hits(tokens: Column, language: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x.isin(*STOPWORDS[language]))).cast("long")


def wrong_language(source: Column, target: Column) -> Column:
    """Whether a rendering meant for Vietnamese is plainly English or copies its source. The source's words are cut only where a copy is all that is left to ask."""
    return tx.let(language_words(target), lambda w: _wrong(w, F.coalesce(source, F.lit(""))))


def _wrong(w: Column, source: Column) -> Column:
    def judged(n: Column) -> Column:
        total, vi, en, marks = n["total"], n["vi"], n["en"], n["marks"]
        vi_score = F.least(F.lit(1.0), (vi * 1.4 + marks * 1.1) / F.greatest(total, F.lit(1)))
        en_score = F.least(F.lit(1.0), en / F.greatest(total, F.lit(1)))
        plainly = (en >= 2) & (en > (vi + marks) * 1.35)
        mixed = (total >= 8) & (en >= 3) & (en_score >= 0.28) & (vi_score < 0.35)

        def copied(new: Column) -> Column:
            # at least four fifths of the words stand in the source: a fifth of them may be new, so more distinct new words settle it
            other = F.size(F.filter(w, lambda x: F.array_contains(new, x)))
            return (F.size(new) * 5 <= total) & ((total - other) / F.greatest(total, F.lit(1)) >= 0.8)

        copy = (total >= 5) & (vi == 0) & (marks == 0) & tx.let(F.array_except(w, _words(source)), copied)
        return (total > 0) & (plainly | mixed | copy)

    # a mark is no ASCII character, so words of as many bytes as characters need no pattern
    marked = F.size(F.filter(w, lambda x: (F.octet_length(x) > F.length(x)) & x.rlike(VI_MARK)))
    counts = F.struct(F.size(w).alias("total"), stopword_hits(w, "vi").alias("vi"), stopword_hits(w, "en").alias("en"), marked.alias("marks"))
    return tx.let(counts, judged)
