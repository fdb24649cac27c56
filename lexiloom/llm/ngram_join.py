"""Exact Jaccard join of documents on word shingles, light sets by subsets and heavy sets by inverted lists.

Every document is its set of word shingles; documents with equal sets form a class, and all work is on classes. Two sets of
sizes n and m are linked where they share at least `overlap(n, m)` shingles.

* Light sets (up to a boundary) are joined by enumeration: for each size a partner may have, all subsets of the size that the
  two would have to share are written out, so linked sets meet in a subset, and whatever meets in one is linked.
* Heavy sets scan inverted lists. In one order of all shingles, the same for all sets, linked sets share one of the first
  n - ceil(percent * n / 100) + 1 of each, so only those are listed. The order is by hash, frequent shingles last and by count,
  which keeps lists short; any order gives the same links. A list is one of a shingle and a band of sizes, and a set is on
  those of its own band and the next, so that it meets sets of about its size only. Lists of heavy sets also hold light ones,
  down to the least size that a heavy set may be linked with.
* The boundary is where the number of subsets of light sets plus the number of list entries that heavy sets scan is least;
  both are counted per size before anything is joined.

Pairs from lists are screened by parity bits before their sets are fetched: a set sets the bits that an odd number of its
shingles hash to, and two sets differ in no more bits than in shingles, so no linked pair is lost. Long lists are taken in blocks,
and links are verified only as far as components need them; see near_dedup.list_components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import hot_join, slices, stage, unstage
from lexiloom.llm.near_dedup import _K, _mix, _verified, held_sets, list_components, shingles, with_components

#: The boundary is sought from 0 to this size; beyond it the subsets of one set alone number tens of thousands.
MOST_LIGHT = 40
#: Shingles listed more often than this, and more often than a FREQUENT-th of all listings, come last in the order. They number FREQUENT at most.
LONG_LIST, FREQUENT = 64, 1 << 20


def overlap(n: int, m: int, percent: int) -> int:
    """The least intersection of linked sets of sizes n and m."""
    return -(-percent * (n + m) // (100 + percent))


def partners(n: int, percent: int) -> range:
    """The sizes that a set linked with one of size n may have."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def bands(most: int, percent: int) -> list[int]:
    """The least sizes of bands such that linked sets are of the same band or of two that follow each other."""
    out = [1]
    while out[-1] <= most:
        out.append(100 * out[-1] // percent + 1)
    return out


def subset_keys(s: np.ndarray, most: int, percent: int) -> list[tuple[int, int, int]]:
    """(least size, greatest size, key) of every subset that a linked set of at most `most` shingles would have to share."""
    n, out = len(s), []
    mixed = _mix(s * _K[0])
    whole = mixed.sum(dtype=np.uint64)
    for m in partners(n, percent):
        less = n - overlap(n, m, percent)
        if m > most or overlap(n, m, percent) > m or less < 0:
            continue
        left_out = np.array(list(combinations(range(n), less)), np.int64).reshape(comb(n, less), less)
        keys = whole - mixed[left_out].sum(1, dtype=np.uint64)
        lo, hi = min(n, m), max(n, m)
        out += [(lo, hi, k) for k in _mix(keys * _K[2] + np.uint64(lo * 1000 + hi)).view(np.int64).tolist()]
    return out


def count_subsets(n: int, most: int, percent: int) -> int:
    """How many keys subset_keys gives a set of n shingles."""
    return sum(comb(n, n - overlap(n, m, percent)) for m in partners(n, percent) if m <= most and overlap(n, m, percent) <= min(n, m))


def listed(s: np.ndarray, percent: int, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set that are listed. frequent: sorted hashes, with their counts."""
    take = len(s) + percent * len(s) // -100 + 1
    at = np.searchsorted(frequent, s)
    common = np.append(frequent, np.uint64(0))[at] == s
    common &= at < len(frequent)
    rare = s[~common][:take]
    if len(rare) == take:
        return rare
    often = s[common]
    order = np.lexsort((often, counts[at[common]]))
    return np.concatenate([rare, often[order][: take - len(rare)]])


def parity(s: np.ndarray) -> bytes:
    """A bit for every two shingles or so (a power of two, 64 at least): set where an odd number of shingles has it as its lowest hash bits."""
    n = 1 << max(6, (len(s) - 1).bit_length() - 1)
    return np.packbits(np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n).astype(np.uint8) & 1).tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Parity bits as a set of fewer bits would have them."""
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def _possible(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    apart = int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum())
    return apart <= n + m - 2 * overlap(n, m, percent)


def _frequent(signed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of the shingles that come last; FREQUENT of them at most, as each has more than a FREQUENT-th of all listings."""
    counts = stage(signed.where(F.col("_keys").isNotNull()).select(F.explode("_keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")), "shingle-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.where(F.col("n") > max(LONG_LIST, total // FREQUENT)).toArrow()
    unstage(counts)
    keys, n = often["key"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def boundary(sets: dict[int, int], scans: dict[int, int], percent: int) -> int:
    """The size up to which sets are light: subsets of the light plus list entries scanned for the heavy are fewest. sets and scans: number of sets, and of entries, by size."""
    sizes = sorted(sets)

    def cost(most: int) -> int:
        return sum(sets[n] * count_subsets(n, most, percent) if n <= most else scans.get(n, 0) for n in sizes)

    return min([0, *sizes], key=lambda most: (cost(most), most))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per input row.

    Documents are linked where 100 * shared shingles >= percent * all shingles of the two; component_id is the least id that
    links reach, itself included; kept: the row's id is its component's. All links count, whatever the length of lists.
    Texts without words (null ones too) have no shingles and stand alone. Rows with a null id are not linked: component_id is
    null, kept is true. Rows that share an id are versions of one document and share its component. Ids are cast to long;
    other columns are left out. An empty table gives an empty result. percent from 50 to 99 (equal sets are one class in any case).
    """
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    none = np.zeros(0, np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(batches, "_text"):
            seen, n, prints, keys = set(), [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                fresh = len(s) and prints[-1] not in seen  # copies within a slice are counted once
                seen.add(prints[-1])
                keys.append(listed(s, percent, none, none).view(np.int64) if fresh else None)
            f = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(keys, pa.list_(pa.int64()))], ["_id", "_n", "_f1", "_f2", "_keys"])

    signed = stage(d.mapInArrow(sign, "_id long, _n long, _f1 long, _f2 long, _keys array<long>"), "signed")
    frequent, counts = _frequent(signed)
    known = signed.where((F.col("_n") > 0) & F.col("_id").isNotNull())
    classes = stage(known.groupBy("_f1", "_f2").agg(F.min("_id").alias("rep"), F.max("_n").alias("n"), F.count("*").alias("members")), "classes")
    rows = classes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ["_id", "_f1", "_f2", "keys", "bits", "items"]
        for b in slices(batches, "_text"):
            prints, keys, bits, items = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, words)
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(listed(s, percent, frequent, counts).view(np.int64) if len(s) else [])
                bits.append(parity(s))
                items.append(s.tobytes() if len(s) <= MOST_LIGHT else None)
            f = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
            yield pa.record_batch([b.column(0), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(items, pa.binary())], names)

    reps = classes.select(F.col("rep").alias("_id"), "_f1", "_f2", "n")
    filed = d.where(F.col("_id").isNotNull()).mapInArrow(file, "_id long, _f1 long, _f2 long, keys array<long>, bits binary, items binary")
    filed = stage(filed.join(reps.hint("shuffle_hash"), ["_id", "_f1", "_f2"]).select(F.col("_id").alias("rep"), "n", "keys", "bits", "items"), "filed")
    entries = filed.select("rep", "n", F.explode("keys").alias("key"))
    lengths = stage(entries.groupBy("key").agg(F.count("*").alias("cnt"), F.max("n").alias("longest")).where(F.col("cnt") > 1), "list-lengths")
    n_entries = filed.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]

    # what either way costs the sets of each size; MOST_LIGHT rows at most
    few = filed.where(F.col("n") <= MOST_LIGHT)
    sets = {r["n"]: r["sets"] for r in few.groupBy("n").agg(F.count("*").alias("sets")).collect()}
    scanned = hot_join(few.select("n", F.explode("keys").alias("key")), lengths.select("key", "cnt"), ["key"], "cnt", n_entries)
    scans = {r["n"]: r["entries"] for r in scanned.groupBy("n").agg(F.sum(F.coalesce("cnt", F.lit(1))).alias("entries")).collect()}
    most = boundary(sets, scans, percent)

    # light sets: whoever shares a subset with sets of the other size is linked with the least of them
    def enumerate_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rep, n, items in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = subset_keys(np.frombuffer(items, np.uint64), most, percent)
                yield pa.record_batch([pa.array([rep] * len(found), pa.int64()), pa.array([n] * len(found), pa.int64()), *(pa.array([x[i] for x in found], pa.int64()) for i in range(3))], ["rep", "n", "lo", "hi", "key"])

    light = few.where((F.col("n") <= most) & F.col("items").isNotNull()).select("rep", "n", "items")
    subsets = stage(light.mapInArrow(enumerate_, "rep long, n long, lo long, hi long, key long").distinct(), "subsets")
    least = subsets.groupBy("lo", "hi", "key").agg(F.count("*").alias("cnt"), F.min(F.when(F.col("n") == F.col("lo"), F.col("rep"))).alias("low"), F.min(F.when(F.col("n") == F.col("hi"), F.col("rep"))).alias("high"))
    least = stage(least.where("low is not null and high is not null and cnt > 1"), "subset-lists")
    met = hot_join(subsets, least, ["lo", "hi", "key"], "cnt", subsets.count(), "inner")
    pairs = met.select("rep", F.explode(F.array(F.when(F.col("n") == F.col("lo"), F.col("high")), F.when(F.col("n") == F.col("hi"), F.col("low")))).alias("other"))
    pairs = stage(pairs.where(F.col("rep") != F.col("other")).select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct(), "pairs")
    small = few.where(F.col("items").isNotNull()).select("rep", "items")
    links = stage(_verified(pairs, small, percent), "links")

    # heavy sets: lists of those in reach of one
    heavy = entries.where(F.col("n") >= partners(most + 1, percent)[0])
    near = hot_join(heavy, lengths.where(F.col("longest") > most), ["key"], "cnt", n_entries, "inner").select("key", "rep", "n")
    steps = F.array(*map(F.lit, bands(filed.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0], percent)))
    band = F.size(F.filter(steps, lambda x: x <= F.col("n")))
    near = stage(near.select("rep", "n", F.explode(F.transform(F.array(band, band + 1), lambda b: F.xxhash64("key", b))).alias("key")).dropDuplicates(["key", "rep"]), "near-size")
    lengths_ = stage(near.groupBy("key").agg(F.count("*").alias("cnt"), F.sum("n").alias("total")).where(F.col("cnt") > 1), "list-lengths")
    n_near = near.count()
    lists = stage(hot_join(near, lengths_, ["key"], "cnt", n_near, "inner"), "lists")
    bits = filed.select("rep", "n", "bits")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [_possible(*r, percent) for r in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)]
            yield pa.record_batch([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    def screen(found: DataFrame) -> DataFrame:
        x, y = bits.select(F.col("rep").alias("a"), F.col("bits").alias("x"), F.col("n").alias("n_x")), bits.select(F.col("rep").alias("b"), F.col("bits").alias("y"), F.col("n").alias("n_y"))
        return found.join(x, "a").join(y, "b").select("a", "b", "x", "y", "n_x", "n_y").mapInArrow(look, "a long, b long").distinct()

    held: list[DataFrame] = []

    def hold(wanted: DataFrame) -> DataFrame:
        held.append(held_sets(d, wanted, words))
        return held[-1]

    final = list_components(lists, hold, percent, n_near, links, screen)
    unstage(filed, lengths, subsets, least, pairs, links, near, lengths_, lists, *held)
    return with_components(signed, classes, final, rows, id_col)
