"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping segments. An occurrence of a segment of m characters with at most k edits shares
at least m - q + 1 - k q of its q-grams with the text, all within k + 1 neighbouring diagonals. So q-gram hits are counted
by (segment, band of diagonals), with bands that overlap by half; regions that reach the bound are verified by a banded
alignment.

Items too short to allow an edit (under SHORT characters) are looked for exactly, as whole words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import slices, stage, unstage

Q = 10
SEGMENT, STRIDE = 64, 32
EDIT_RATE = 0.0625
#: Items of fewer characters (normalised) are matched exactly, as whole words.
SHORT = 25
#: Characters of the benchmark that are indexed and sent with the tasks at once (about 80 bytes each); a larger benchmark takes
#: several passes, each a job of its own.
BLOCK_CHARS = 2_000_000
#: Characters of text that are scanned at once; longer texts are scanned in overlapping windows.
WINDOW = 500_000
BITS = 22


class Index(NamedTuple):
    """grams: sorted hashes of all segments' q-grams; segment, place: where each stands; bitmap: by the hashes' top bits; codes, size: the segments; item: their items; edits, bound: k and the least shared q-grams; short: (text, items) of items matched exactly."""

    grams: np.ndarray
    segment: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    codes: np.ndarray
    size: np.ndarray
    item: np.ndarray
    edits: np.ndarray
    bound: np.ndarray
    short: list[tuple[str, list[int]]]


def normal(text: str) -> str:
    """Lower case, blanks as single spaces."""
    return " ".join(text.lower().split())


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q characters from each position on."""
    k = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
    one = (codes.astype(np.uint64) + np.uint64(1)) * k[0]
    one ^= one >> np.uint64(29)
    two = one[:-1] * k[1] + one[1:]
    four = two[:-2] * k[2] + two[2:]
    eight = four[:-4] * k[3] + four[4:]
    h = eight[: len(codes) - Q + 1] * k[1] + two[8:]
    h ^= h >> np.uint64(32)
    return h * k[0]


def build_index(items: list[tuple[int, str]]) -> Index | None:
    segments: list[tuple[int, str]] = []
    short: dict[str, list[int]] = {}
    for item, text in items:
        t = normal(text or "")
        if len(t) >= SHORT:
            starts = [*range(0, max(1, len(t) - SEGMENT), STRIDE), max(0, len(t) - SEGMENT)]
            segments += [(item, t[a : a + SEGMENT]) for a in dict.fromkeys(starts)]
        elif t:
            short.setdefault(t, []).append(item)
    if not segments and not short:
        return None
    size = np.array([len(s) for _, s in segments], np.int64)
    edits = np.minimum((size * EDIT_RATE).astype(np.int64), (size - Q) // Q)
    codes = np.zeros((len(segments), SEGMENT), np.uint32)
    for i, (_, s) in enumerate(segments):
        codes[i, : len(s)] = codes_of(s)
    hashes = [gram_hashes(codes[i, :n]) for i, n in enumerate(size.tolist())]
    grams = np.concatenate([np.zeros(0, np.uint64), *hashes])
    order = np.argsort(grams, kind="stable")
    bitmap = np.zeros(1 << BITS, bool)
    bitmap[grams >> np.uint64(64 - BITS)] = True
    return Index(
        grams[order],
        np.repeat(np.arange(len(size), dtype=np.int32), [len(h) for h in hashes])[order],
        np.concatenate([np.zeros(0, np.int16), *(np.arange(len(h), dtype=np.int16) for h in hashes)])[order],
        bitmap, codes, size, np.array([i for i, _ in segments], np.int64), edits, size - Q + 1 - edits * Q, sorted(short.items()),
    )


@lru_cache(1)
def _automaton(short: tuple[str, ...]):  # noqa: ANN202
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, t in enumerate(short):
        a.add_word(f" {t} ", i)
    a.make_automaton()
    return a


def whole_words(text: str, x: Index) -> set[int]:
    """The short items that stand in a normalised text as whole words."""
    return {item for _, i in _automaton(tuple(t for t, _ in x.short)).iter(f" {text} ") for item in x.short[i][1]}


def aligned(text: np.ndarray, start: np.ndarray, segment: np.ndarray, x: Index) -> np.ndarray:
    """Whether segment i lies, with its edits at most, in text from about start[i] on: edit distance with free ends, inside the band."""
    k = int(x.edits.max())
    width = SEGMENT + 4 * k + 4
    at = np.arange(width)
    place = start[:, None] - k + at
    window = np.where((place >= 0) & (place < len(text)), text[np.clip(place, 0, len(text) - 1)], 0)
    size = x.size[segment]
    row = np.zeros((len(start), width + 1), np.int32)
    best = np.full(len(start), width, np.int32)
    ramp = np.arange(width + 1, dtype=np.int32)
    for i in range(int(size.max())):
        same = window == x.codes[segment, i][:, None]
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + ~same, row[:, 1:] + 1)
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
        done = size == i + 1
        best[done] = row[done].min(1)
    return best <= x.edits[segment]


def scan(text: np.ndarray, x: Index) -> tuple[np.ndarray, np.ndarray]:
    """(start, segment) of verified regions in text."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(text) < Q or not len(x.size):
        return none
    h = gram_hashes(text)
    at = np.flatnonzero(x.bitmap[h >> np.uint64(64 - BITS)])
    lo, hi = np.searchsorted(x.grams, h[at], "left"), np.searchsorted(x.grams, h[at], "right")
    n = hi - lo
    if not n.sum():
        return none
    entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    segment, diagonal = x.segment[entry].astype(np.int64), np.repeat(at, n) - x.place[entry] + SEGMENT
    step = int(x.edits.max()) + 1
    bands = len(text) // step + SEGMENT + 2
    band = diagonal // step  # band b holds the diagonals of steps b and b + 1
    key, count = np.unique(np.concatenate([segment * bands + band, segment * bands + band - 1]), return_counts=True)
    key = key[count >= x.bound[key // bands]]
    segment, start = key // bands, key % bands * step - SEGMENT
    good = [aligned(text, start[i : i + 4096], segment[i : i + 4096], x) for i in range(0, len(key), 4096)]
    if not good:
        return none
    good = np.concatenate(good)
    return start[good], segment[good]


def matches(texts: list[str | None], x: Index) -> list[set[int]]:
    """The items found in each whole text."""
    out: list[set[int]] = [set() for _ in texts]
    held, owners, size = [], [], 0
    gap = "\0" * (SEGMENT + 16)

    def flush() -> None:
        text = codes_of(gap.join(held))
        first = np.cumsum([0, *(len(t) + len(gap) for t in held)])[:-1]
        start, segment = scan(text, x)
        for doc, item in set(zip(np.searchsorted(first, start + SEGMENT // 4, "right").tolist(), x.item[segment].tolist(), strict=True)):
            out[owners[doc - 1]].add(item)

    for i, text in enumerate(texts):
        t = normal(text or "")
        if x.short and t:
            out[i] |= whole_words(t, x)
        for a in range(0, max(1, len(t)), WINDOW):
            held.append(t[a : a + WINDOW + 2 * SEGMENT])
            owners.append(i)
            size += len(held[-1])
            if size >= WINDOW:
                flush()
                held, owners, size = [], [], 0
    if held:
        flush()
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, text, items, n_items, contaminated), one row per input row; items: sorted ids of the benchmark items found.

    A text is contaminated if any segment of an item lies in it within its edits, upper and lower case and blanks
    aside; an item of under SHORT characters if it lies in it as whole words. Null or empty texts hold nothing. Null and
    blank item texts match nothing; null item ids are passed over; repeated items count once. Repeated rows are judged
    alike. Other columns are left out. An empty table on either side gives no matches.

    Narrow passes over the documents, no shuffle: the benchmark goes to the tasks, in blocks of about block_chars characters
    (its size is summed first). One block is one pass; several blocks are a job each, staged, so that neither the driver nor
    a task holds more than one block's index.
    """
    b = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull())
    blocks = -(-(b.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0) // block_chars) or 1
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.array().cast("array<long>").alias("_items"))
    kind = f"_id {dict(d.dtypes)['_id']}, _text string, _items array<bigint>"
    for block in range(blocks):
        x = build_index([(r["i"], r["t"]) for r in b.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()])
        if x is not None:
            done, d = d, d.mapInArrow(_matcher(x), kind)
            if blocks > 1:
                d = stage(d, "matches")
                unstage(done)
    items = F.array_sort(F.array_distinct("_items"))
    return d.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), items.alias("items"), F.size(items).cast("long").alias("n_items"), (F.size(items) > 0).alias("contaminated"))


def _matcher(x: Index):  # noqa: ANN202
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            found = [[*old, *sorted(new)] for old, new in zip(b.column(2).to_pylist(), matches(b.column(1).to_pylist(), x), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], ["_id", "_text", "_items"])

    return match
