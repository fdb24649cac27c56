"""Substring dedup by content-defined chunking with a gear rolling hash.

A blank ends a chunk where the gear hash of the 16 bytes before it has two leading zero bits, so cuts depend on nearby
content alone and come back a few words after an insertion. From every cut a chunk runs to the first cut that leaves
min_words words inside. Chunks overlap on purpose: with chunks that only part the text, a repeated passage would be found
if it held a whole chunk of the one partition, so chunks had to be a few words long and ordinary phrases would count as
repeats. A chunk whose digest occurs in another document is a repeat; all but its first occurrence are cut from their texts.

A blank is a cut with probability 1/4, so a repeated passage of n words is missed with probability
0.75^b + b 0.25 0.75^(b-1), b = n - 1 - min_words: 2.4 % for 51 words at min_words = 30, 0.2 % for 60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import skew_join, slices, stage

#: Words a chunk has at least; meant for passages of over 50 words.
MIN_WORDS = 30
_MIX = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _table(seed: int) -> np.ndarray:
    """256 random words of 64 bits from a seed."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


GEAR, BYTES = _table(1), (_table(2), _table(3))
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[BLANK] = 32


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def cuts_of(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end: blanks whose gear hash starts with two zero bits."""
    h = GEAR[data].astype(np.uint16)
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint16(step))
    return np.flatnonzero((data == 32) & (h >> np.uint16(14) == 0))


def chunks_of(text: bytes, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, digest, second digest) of every chunk; start and end are byte offsets in text, digests ignore case (A-Z) and the kind and number of blanks."""
    raw = np.frombuffer(text, np.uint8)
    blank = BLANK[raw]
    keep = np.flatnonzero(~(blank & np.concatenate([[True], blank[:-1]]))) if len(raw) else np.zeros(0, np.int64)
    data = FOLD[raw[keep]]
    n = len(data)
    empty = np.zeros(0, np.int64)
    if not n:
        return empty, empty, empty, empty
    ends = cuts_of(data) + 1
    if ends.size == 0 or ends[-1] != n:
        ends = np.append(ends, n)
    starts = np.concatenate([[0], ends[:-1]])
    words = np.concatenate([[0], np.cumsum(data == 32)])
    if data[-1] != 32:
        words[-1] += 1
    stop = np.searchsorted(words[ends], words[starts] + min_words, "left")
    whole = stop < len(ends)
    start, end = starts[whole], ends[stop[whole]]
    digests = []
    for mix, table in zip(_MIX, BYTES, strict=True):  # polynomial digests from prefix sums modulo 2^64
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(table[data] * _powers(mix, n), dtype=np.uint64)])
        digests.append(((prefix[end] - prefix[start]) * _powers(_inverse(mix), n)[start]).view(np.int64))
    return keep[start], np.where(end < n, keep[np.minimum(end, n - 1)], len(raw)), *digests


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, within: bool = False) -> DataFrame:
    """(id, text, n_repeats, repeated_bytes, dropped_bytes, has_repeat), one row per input row.

    n_repeats: chunks of the text that occur in two documents or more (with `within`, also those twice in one document);
    repeated_bytes: UTF-8 bytes they cover; the occurrence with the least (id, position) stays and dropped_bytes are cut
    from the others. Null and empty texts, and
    texts with fewer than min_words words after a cut, have none; a null text stays null. A row that repeats another's id
    and text is the same document and is treated like it, so neither loses its text to the other. Ids may be null. Other
    columns are left out. An empty table gives an empty result.

    Digests are counted with map-side sums (a passage of a third of all texts is one row a task); only chunks whose
    first digest repeats go on, through joins that split hot keys; text moves once, hash-joined with its list of cuts.
    """
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    d = d.withColumn("_row", F.xxhash64(F.lit("row"), "_id", "_text"))

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "_row", "_start", "_end", "_d1", "_d2"]
        for b in slices(batches, "_text", 1 << 20):
            found = [chunks_of((x or "").encode("utf-8", "surrogatepass"), min_words) for x in b.column(2).to_pylist()]
            doc = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            yield pa.record_batch([b.column(0).take(doc), b.column(1).take(doc), *(pa.array(np.concatenate([f[i] for f in found]).astype(np.int64)) for i in range(4))], names)

    kind = dict(d.dtypes)["_id"]
    chunks = d.select("_id", "_row", "_text").mapInArrow(chunk, f"_id {kind}, _row long, _start long, _end long, _d1 long, _d2 long")
    twice = chunks.groupBy("_d1").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("_d1")
    again = stage(skew_join(chunks, twice, ["_d1"]), "repeats")
    one, other = F.struct("_id", "_row"), F.struct("_id", "_row", "_start")
    first = again.groupBy("_d1", "_d2").agg(F.count("*").alias("_n"), F.min(other).alias("_first"), (F.min(one) != F.max(one)).alias("_across"))
    first = first.where((F.col("_n") > 1) & (F.lit(within) | F.col("_across"))).drop("_n", "_across")
    told = skew_join(again, first, ["_d1", "_d2"])
    drop = ~other.eqNullSafe(F.col("_first"))
    cuts = told.groupBy(F.col("_id").alias("_of"), F.col("_row").alias("_at")).agg(F.collect_list(F.struct(F.col("_start").alias("a"), F.col("_end").alias("b"), drop.alias("drop"))).alias("_cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not spans:
                    rows.append((text, 0, 0, 0))
                    continue
                data = text.encode("utf-8", "surrogatepass")
                gone = merged([(s["a"], s["b"]) for s in spans if s["drop"]])
                at = [0, *(x for span in gone for x in span), len(data)]
                left = b"".join(data[at[i] : at[i + 1]] for i in range(0, len(at), 2))
                every = merged([(s["a"], s["b"]) for s in spans])
                rows.append((left.decode("utf-8", "surrogatepass"), len({(s["a"], s["b"]) for s in spans}), sum(y - x for x, y in every), sum(y - x for x, y in gone)))
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), *[pa.int64()] * 3), strict=True))], ["_id", "_text", "n_repeats", "repeated_bytes", "dropped_bytes"])

    own = F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_row") == F.col("_at"))
    joined = d.join(cuts.hint("shuffle_hash"), own, "left").select("_id", "_text", "_cuts")
    out = joined.mapInArrow(cut, f"_id {kind}, _text string, n_repeats long, repeated_bytes long, dropped_bytes long")
    return out.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), "n_repeats", "repeated_bytes", "dropped_bytes", (F.col("n_repeats") > 0).alias("has_repeat"))
