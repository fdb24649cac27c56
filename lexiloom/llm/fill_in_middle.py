"""Fill-in-middle transformation over an index of distinct texts.

Where a text may be cut depends on the text alone, so it is worked out once for each distinct text: the ends of its lines,
in code points, as an Elias-Fano list. Documents are (id, digest) rows that ask the index for the two cuts that their seeded
numbers choose.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from lexiloom.llm.common import HOT_KEYS, let, stage

#: The marks of prefix, suffix and middle; fixed by the output's format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A text with so many copies is one group; more copies are dealt into parts of about so many.
COPIES = 1000


def ef_encode(ends: np.ndarray) -> bytes:
    """An increasing list as an Elias-Fano code: length and width, the numbers' `width` lowest bits, what is left of them in unary.

    The width is that of the average gap, so a number takes about width + 2 bits.
    """
    n = len(ends)
    if not n:
        return np.zeros(2, "<u4").tobytes()
    width = max(0, (int(ends[-1]) // n).bit_length() - 1)
    low = (ends[:, None] >> np.arange(width)) & 1
    high = np.zeros((int(ends[-1]) >> width) + n, np.uint8)
    high[(ends >> width) + np.arange(n)] = 1
    return np.array([n, width], "<u4").tobytes() + np.packbits(low.astype(np.uint8).ravel()).tobytes() + np.packbits(high).tobytes()


def ef_select(code: bytes, i: int) -> int:
    """The i-th number (from 0) of an Elias-Fano code: its low bits by position, its high bits from the place of the i-th one."""
    n, width = (int(x) for x in np.frombuffer(code, "<u4", 2))
    body = np.frombuffer(code, np.uint8, offset=8)
    unary = body[(n * width + 7) // 8 :]
    ones = np.cumsum(np.bitwise_count(unary))
    at = int(np.searchsorted(ones, i + 1))
    before = int(ones[at - 1]) if at else 0
    high = 8 * at + int(np.flatnonzero(np.unpackbits(unary[at : at + 1]))[i - before]) - i
    first = i * width
    low = np.unpackbits(body[first // 8 : (first + width + 7) // 8])[first % 8 :][:width]
    return high << width | sum(int(b) << k for k, b in enumerate(low.tolist()))


@pandas_udf(BinaryType())
def _boundaries(lengths: pd.Series) -> pd.Series:
    """Codes of line ends, in code points, from the lengths of the pieces between line feeds."""

    def one(pieces: np.ndarray) -> bytes:
        ends = np.cumsum(np.asarray(pieces, np.int64) + 1)
        ends[-1] -= 1  # nothing ends the last piece
        return ef_encode(ends if pieces[-1] else ends[:-1])

    return lengths.map(one)


@pandas_udf(StructType([StructField(c, IntegerType()) for c in ("n", "a", "b")]))
def _cuts(codes: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    """The number n of lines, and the code points before the two cuts that the drawn numbers choose of n + 1."""
    out = np.zeros((len(codes), 3), np.int32)
    for r, (code, *drawn) in enumerate(zip(codes, first, second, strict=True)):
        n = int.from_bytes(code[:4], "little")
        after = sorted(h % (n + 1) for h in drawn)
        out[r] = n, *(ef_select(code, k - 1) if k else 0 for k in after)
    return pd.DataFrame(out, columns=["n", "a", "b"])


def _draw(seed: int, id_: Column, i: int) -> Column:
    """The i-th 8-digit group of the hex SHA-256 of seed:id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output, text_sha256), one row per input row.

    A text's units are its lines with their line feeds. Two numbers drawn from SHA-256 of "seed:id" choose two cuts between
    units; the third says whether the text stays plain (its remainder by 100 is `rate` or more), the fourth its form: spm
    under spm_rate, else psm. Empty texts, and texts that hold one of the marks, stay plain; prefix_chars and middle_chars are null then.
    Nulls: a null text is empty; a null id draws from "seed:". Repeated rows give repeated rows. Other columns are left out.
    An empty table gives an empty result.

    Texts are grouped by SHA-256 and compared as a whole where they meet. Texts with more than COPIES copies (or, beyond
    10 million rows, more than a HOT_KEYS-th of all rows, so that they number HOT_KEYS at most) have their copies merged
    before the shuffle and then stand in the index once for each part of that many copies, so no task gets a whole large group. A
    text moves once; what asks for its cuts is an id and a digest.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))  # never null, and known to be
    d = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), digest.alias("_digest"))
    rows = stage(d.select("_id", "_digest"), "fim-rows")
    most = max(COPIES, rows.count() // HOT_KEYS)
    hot = rows.groupBy("_digest").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    hot = stage(hot.select("_digest", F.ceil(F.col("_n") / most).cast("int").alias("_parts")), "fim-hot")

    cold = d.join(F.broadcast(hot.select("_digest")), "_digest", "left_anti").select("_digest", F.lit(0).alias("_part"), "_text")
    merged = d.select("_digest", "_text").join(F.broadcast(hot), "_digest").distinct().select("_digest", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "_text")
    texts = cold.unionByName(merged).repartition("_digest", "_part").distinct()
    lengths = F.transform(F.split("_text", "\n", -1), F.length)
    index = texts.select("_digest", "_part", _boundaries(lengths).alias("_code"))

    asks = rows.join(F.broadcast(hot), "_digest", "left")
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.floor(F.rand(seed) * F.col("_parts")).cast("int"))
    asks = asks.select("_id", "_digest", part.alias("_part"), *(_draw(seed, F.col("_id"), i).alias(f"_h{i}") for i in range(4)))
    cut = asks.join(index, ["_digest", "_part"]).select("_id", "_digest", "_part", "_h2", "_h3", _cuts("_code", "_h0", "_h1").alias("_cut"))

    found = texts.join(cut.hint("shuffle_hash"), ["_digest", "_part"]).select("*", F.col("_cut.a").alias("_a"), F.col("_cut.b").alias("_b"))
    plain = (F.col("_text") == "") | F.col("_text").contains(PREFIX) | F.col("_text").contains(SUFFIX) | F.col("_text").contains(MIDDLE) | (F.col("_h2") % 100 >= rate)
    found = found.withColumn("_form", F.when(plain, "plain").when(F.col("_h3") % 100 < spm_rate, "spm").otherwise("psm"))

    def piece(start: Column, end: Column) -> Column:
        return F.substr(F.col("_text"), start + 1, end - start)

    prefix, middle, suffix = piece(F.lit(0), F.col("_a")), piece(F.col("_a"), F.col("_b")), piece(F.col("_b"), F.length("_text"))
    out = (
        F.when(F.col("_form") == "plain", F.col("_text"))
        .when(F.col("_form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    )
    cut_up = F.col("_form") != "plain"
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_cut.n").cast("long").alias("n"),
        F.col("_form").alias("form"),
        F.when(cut_up, F.col("_a").cast("long")).alias("prefix_chars"),
        F.when(cut_up, (F.col("_b") - F.col("_a")).cast("long")).alias("middle_chars"),
        out.alias("output"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of: its three pieces lie between marks that the text itself does not hold."""

    def joined(p: Column) -> Column:
        return F.when(form == "spm", F.concat(F.get(p, F.lit(2)), F.get(p, F.lit(3)), F.get(p, F.lit(1)))).otherwise(F.concat(F.get(p, F.lit(1)), F.get(p, F.lit(3)), F.get(p, F.lit(2))))

    return F.when(form == "plain", output).otherwise(let(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1), joined))
