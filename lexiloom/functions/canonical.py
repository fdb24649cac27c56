"""Canonical JSON: one text for all values that are equal, so that a hash of it names the value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.answers import VARIANTS, is_string, json_value
from lexiloom.functions.text import let

#: Values nested deeper than this are no canonical text (null).
DEPTH = 8


def quoted(c: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, nothing else."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    named = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
    full = out
    for x in map(chr, range(32)):
        full = F.replace(full, F.lit(x), F.lit(named.get(x, f"\\u{ord(x):04x}")))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f]"), full).otherwise(out), F.lit('"'))


def number(v: Column, kind: Column) -> Column:
    """A number as Python writes it: integers plainly, fractions by the shortest digits, powers of ten from 16 places and under four zeros on."""
    x = F.try_variant_get(v, "$", "double")
    java = x.cast("string")
    size = F.abs(x)
    mantissa, power = F.regexp_replace(F.regexp_extract(java, r"^([^E]+)", 1), r"\.0$", ""), F.regexp_extract(java, r"E(-?\d+)$", 1).try_cast("int")
    digits, point = F.regexp_replace(mantissa, r"[-.]", ""), power + 1
    sign = F.when(java.startswith("-"), "-").otherwise("")
    whole = F.rpad(digits, F.greatest(point, F.length(digits)), F.lit("0"))
    large = F.concat(sign, F.substr(whole, F.lit(1), point), F.lit("."), F.when(F.length(whole) > point, F.substr(whole, point + 1)).otherwise(F.lit("0")))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    scientific = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    fraction = F.when(power.isNull(), java).when((size >= 1e7) & (size < 1e16), large).when((size < 1e-3) & (size >= 1e-4), small).otherwise(scientific)
    # the parser keeps integers of 64 bits as such, so a smaller number without a fraction was written with one
    plain = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | (kind.rlike(r"^DECIMAL\(\d+,0\)$") & (size >= 2.0**63))
    return F.when(plain, F.to_json(v)).otherwise(fraction)


def canonical(value: Column, item: str = ",", pair: str = ":", depth: int = DEPTH) -> Column:
    """The text of a variant with the keys of every object in the order of their code points. item, pair: what parts items, and keys from values.

    As Python's json.dumps(sort_keys=True, ensure_ascii=False) writes what json.loads reads. Null for null, and for values
    nested deeper than `depth`. Of equal keys in an object the last counts where the parser allows them.
    """

    def of(v: Column, left: int) -> Column:
        return let(F.struct(v.alias("v"), F.schema_of_variant(v).alias("kind")), lambda e: known(e["v"], e["kind"], left))

    def known(v: Column, kind: Column, left: int) -> Column:
        scalar = F.when(is_string(v), quoted(F.try_variant_get(v, "$", "string"))).when(kind.isin("BOOLEAN", "VOID"), F.to_json(v)).otherwise(number(v, kind))
        if left == 0:
            return F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), scalar)

        def joined(e: Column) -> Column:
            keys, texts = e["keys"], e["texts"]
            named = F.zip_with(keys, texts, lambda k, t: F.concat(quoted(k), F.lit(pair), t))
            return F.when(F.forall(texts, lambda t: t.isNotNull()), F.when(keys.isNotNull(), F.concat(F.lit("{"), F.array_join(named, item), F.lit("}"))).otherwise(F.concat(F.lit("["), F.array_join(texts, item), F.lit("]"))))

        def nested(p: Column) -> Column:
            texts = F.transform(F.coalesce(p["items"], F.transform(p["keys"], lambda k: F.element_at(p["members"], k))), lambda x: of(x, left - 1))
            return let(F.struct(p["keys"].alias("keys"), texts.alias("texts")), joined)

        members = F.when(kind.startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))
        parts = F.struct(members.alias("members"), F.array_sort(F.map_keys(members)).alias("keys"), F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", VARIANTS)).alias("items"))
        return F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), let(parts, nested)).otherwise(scalar)

    return of(value, depth)


def canonical_hash(text: Column, spaced: bool = False, depth: int = DEPTH) -> Column:
    """SHA-256 of the canonical form of a JSON text; null where it is no JSON. spaced: blanks behind commas and colons."""
    return F.sha2(canonical(json_value(text), ", " if spaced else ",", ": " if spaced else ":", depth), 256)


def translation_signature(config: Column, glossary: Column) -> Column:
    """(style_hash, glossary_hash) of a configuration and its locked terms, both JSON texts; without terms those of an empty object."""
    return F.struct(canonical_hash(config).alias("style_hash"), canonical_hash(F.coalesce(glossary, F.lit("{}"))).alias("glossary_hash"))
