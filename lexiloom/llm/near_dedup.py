"""Near-duplicate documents by SetSketch registers, banding and exact verification.

Every document is its set of word shingles. Documents with the same set form a class, represented by its least id; all
further work is on representatives. A SetSketch of BANDS x ROWS registers (minima of exponential values on a scale of
base BASE) is cut into bands; representatives that share a band's registers share a bucket. A pair of similarity 0.8
shares none of 40 bands of 5 registers with probability 2e-7.

Links are needed only as far as components do, which keeps large groups of near copies linear:

1. In a small bucket every member is compared with the least one; in large buckets members are dealt at random into
   blocks of about BLOCK, compared all with all inside a task. Verified links give first components.
2. Exactly the pairs that can still matter follow: in every bucket that holds several components, each member outside
   the bucket's main component is compared with all members of other components. Both sides are dealt into blocks and
   every block of askers meets every block of members, so a group is bounded on both sides, and no link between texts that
   share a bucket is lost, whatever the bucket's size or the number of its components. Texts of a large group share many
   buckets, so each large bucket has a cover, a larger one of its least member's: pairs inside the cover are compared there, and
   members outside the cover alone ask where they are fewer.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import hot_join, skew_join, slices, stage, unstage

BANDS, ROWS = 40, 5
BASE, RATE = 1.001, 20.0
#: Buckets of more members are dealt into blocks; blocks hold about so many members, or so many bytes of sets.
SMALL, BLOCK, WIDE_BLOCK, BLOCK_BYTES = 48, 256, 512, 16 << 20
#: In step 1 a representative takes part in so many of its large buckets.
LARGE_BUCKETS = 3
#: Pairs whose estimate lies further below the threshold than this are not verified. At a similarity of 0.8 the standard
#: error of 200 registers is 0.028, so this is 8.8 of them: a linked pair is passed over with a probability under 1e-17.
MARGIN = 0.25

_rng = np.random.default_rng(20)
_MULT = _rng.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_BAND = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Words are hashed in pieces of a text of about so many bytes.
PIECE = 1 << 20
_BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")
_IN_WORD = np.isin(np.arange(256), [*b" \t\n\x0b\x0c\r"], invert=True)
_BYTES = _rng.integers(1, 1 << 63, 256, np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_PLACES = _rng.integers(1, 1 << 63, 1 << 16, np.uint64) * np.uint64(2) + np.uint64(1)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _K[1]
    return h ^ (h >> np.uint64(29))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word (bytes between blanks, A-Z lower-cased): a sum of its bytes' random values weighed by their places."""
    out, start = [], 0
    while start < len(data):
        cut = _BLANK.search(data, min(len(data), start + PIECE))
        end = cut.start() if cut else len(data)
        raw = np.frombuffer(data, np.uint8, end - start, start)
        start = end
        at = np.flatnonzero(_IN_WORD[raw])
        if not len(at):
            continue
        first = np.concatenate([[0], np.flatnonzero(np.diff(at) > 1) + 1])
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        values = _BYTES[raw[at]] * _PLACES[place & 0xFFFF]
        if place[-1] > 0xFFFF or len(at) > 0x10000 and place.max() > 0xFFFF:
            values *= _PLACES[(place >> 16) & 0xFFFF]
        out.append(np.add.reduceat(values, first))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: A-Z lower-cased words parted by blanks; all words as one where there are fewer."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(h):
        return h
    span = min(words, len(h))
    out = h[: len(h) - span + 1] + np.uint64(span)
    for j in range(1, span):
        out = (out ^ (out >> np.uint64(27))) * _K[0] + h[j : len(h) - span + 1 + j]
    out = np.sort(_mix(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def sketch(s: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes. Two sets' registers merge by their maximum."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(least, (np.multiply.outer(_MULT, x[i : i + 2048]) + _ADD[:, None]).min(1), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 0xFFFF).astype(np.uint16)


def bands_of(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for every band of every row of registers."""
    h = (registers.astype(np.uint64) + np.uint64(1)) * _BAND
    return _mix(_mix(h).reshape(len(registers), BANDS, ROWS).sum(2, dtype=np.uint64)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs from how many registers are larger, smaller and equal, given the set sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    j = np.linspace(0, 1, 101) * np.minimum(u / (1 - u), (1 - u) / u)

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)

    up, down = p(u - (1 - u) * j), p(1 - u - u * j)
    likelihood = more * np.log(up) + less * np.log(down) + (a.shape[1] - more - less) * np.log(np.clip(1 - up - down, 1e-9, 1))
    return j[np.arange(len(j)), likelihood.argmax(1)]


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of every left with every right set."""
    out = np.zeros((len(left), len(right)), np.float32)
    values = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, col = np.unique(values, return_inverse=True)
    of_left = np.bincount(col[owner < len(left)], minlength=int(col.max()) + 1 if len(col) else 0)
    of_right = np.bincount(col[owner >= len(left)], minlength=len(of_left))
    keep = ((of_left > (left is right)) & (of_right > 0))[col]  # the rest meets nothing, or itself alone
    _, col = np.unique(col[keep], return_inverse=True)
    owner = owner[keep]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    step = max(64, (8 << 20) // (len(left) + len(right) + 1))
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        lo, hi = np.searchsorted(col, [a, a + step])
        m = np.zeros((len(left) + len(right), step), np.float32)
        m[owner[lo:hi], col[lo:hi] - a] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which left and right sets are linked; where both are the same list, the diagonal says nothing."""
    both = _overlaps(left, right)
    a, b = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    return 100 * both >= percent * (a[:, None] + b[None, :] - both)


def _sets(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the least node that can be reached.

    Alternating large-star and small-star steps; each ends in a staged table. A centre may have a
    third of all edges, so the joins are of a kind whose hot keys adaptive execution splits.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") > F.col("v")).distinct(), "edges")
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = skew_join(both.where(F.col("v") > F.col("u")), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") > F.col("v")).distinct()
        mid = stage(large, "edges")
        least = mid.groupBy("u").agg(F.min("v").alias("m"))
        joined = skew_join(mid, least, ["u"])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where(F.col("u") > F.col("v")).distinct()
        after = stage(small, "edges")
        unstage(now, mid)
        now = after
        r = now.agg(F.count("*").alias("n"), F.count_distinct("u").alias("nodes")).first()
        if r["n"] == r["nodes"] and not now.join(now.select(F.col("u").alias("v")), "v", "left_semi").head(1):
            break  # every node has one parent and no parent has one: stars
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def _near(a: str, b: str, percent: int) -> Column:
    """Sizes alone leave the pair a chance."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of reps that are linked. Sets that bring registers are compared as a whole only where their estimate leaves a chance."""
    extra = [c for c in sets.columns if c not in ("rep", "items")]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "x", 8 << 20):
            x, y = _sets(b.column(2)), _sets(b.column(3))
            n_x, n_y = np.array([len(s) for s in x]), np.array([len(s) for s in y])
            maybe = np.ones(len(x), bool)
            if extra:
                r_x, r_y = (np.array([np.frombuffer(v, np.uint16) for v in b.column(i).to_pylist()]) for i in (4, 5))
                maybe = estimate(r_x, r_y, n_x, n_y) >= percent / 100 - MARGIN
            for i in np.flatnonzero(maybe).tolist():
                both = len(np.intersect1d(x[i], y[i], assume_unique=True))
                maybe[i] = 100 * both >= percent * (n_x[i] + n_y[i] - both)
            yield pa.record_batch([c.filter(pa.array(maybe)) for c in b.columns[:2]], ["a", "b"])

    left = sets.select(F.col("rep").alias("a"), F.col("items").alias("x"), *(F.col(c).alias(f"{c}_x") for c in extra))
    right = sets.select(F.col("rep").alias("b"), F.col("items").alias("y"), *(F.col(c).alias(f"{c}_y") for c in extra))
    met = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
    return met.select("a", "b", "x", "y", *(f"{c}_{s}" for c in extra for s in "xy")).mapInArrow(verify, "a long, b long")


def list_components(lists: DataFrame, hold: Callable[[DataFrame], DataFrame], percent: int, rows: int, links: DataFrame | None = None, screen: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) of the representatives that are linked to others; the steps 1 and 2 of the module's head.

    lists: staged (key, rep, n, cnt, total), the members of every list of two or more, with their set's size, the list's
    length and the sum of its sizes; `rows` is the number of all (key, rep) rows, of lists of one, too. hold gives staged sets
    (rep, items) of the reps it is given at least. links: further links (a, b), known already. screen drops pairs (a, b)
    that cannot be linked, before their sets are fetched.
    """
    made: list[DataFrame] = []

    def kept(df: DataFrame, label: str) -> DataFrame:
        made.append(stage(df, label))
        return made[-1]

    def verified(pairs: DataFrame) -> DataFrame:
        if screen is not None:
            pairs = kept(screen(pairs.select("a", "b").distinct()), "pairs")
        return _verified(pairs, hold(pairs.select(F.col("a").alias("rep")).union(pairs.select("b"))), percent)

    def blocks(size: int, count: str = "cnt", shingles_: str = "total") -> Column:
        return F.greatest(F.ceil(F.col(count) / size), F.ceil(F.col(shingles_) * 8 / BLOCK_BYTES), F.lit(1)).cast("long")

    # step 1
    small, large = lists.where(F.col("cnt") <= SMALL), lists.where(F.col("cnt") > SMALL)
    wide = hold(large.select("rep"))
    least = small.groupBy("key").agg(F.min_by(F.struct("rep", "n"), "rep").alias("l"))
    stars = small.join(least, "key").select(F.col("l.rep").alias("a"), F.col("rep").alias("b"), F.col("l.n").alias("na"), F.col("n").alias("nb")).where((F.col("a") < F.col("b")) & _near("na", "nb", percent))

    def link(group: pa.Table) -> pa.Table:
        ids, sets_ = group["rep"].to_numpy(), _sets(group["items"])
        root = list(range(len(ids)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, j in np.argwhere(np.triu(_linked(sets_, sets_, percent), 1)).tolist():
            a, b = find(i), find(j)
            if ids[b] < ids[a]:
                a, b = b, a
            root[b] = a
        pairs = [(ids[find(i)], ids[i]) for i in range(len(ids)) if find(i) != i]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    largest = Window.partitionBy("rep").orderBy(F.desc("cnt"), "key")
    dealt = large.withColumn("o", F.row_number().over(largest)).where(F.col("o") <= LARGE_BUCKETS)
    dealt = dealt.select("rep", "key", F.pmod(F.xxhash64("rep", "key"), blocks(BLOCK)).alias("block")).join(wide.select("rep", "items"), "rep")
    in_blocks = dealt.groupBy("key", "block").applyInArrow(link, "a long, b long")
    found = verified(stars).union(in_blocks)
    links = kept(found if links is None else found.union(links), "links")
    first = kept(components(links), "components")

    # step 2
    placed = lists.join(first.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    per = placed.groupBy("key", "component").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    main = per.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("m", "component", "s")).alias("top"), F.sum("m").alias("here"), F.sum("s").alias("sum")).where(F.col("parts") > 1)
    main = kept(main.select("key", "here", F.col("top.component").alias("main"), (F.col("here") - F.col("top.m")).alias("askers"), (F.col("sum") - F.col("top.s")).alias("asked")), "main")
    if not main.head(1):  # every list is within one component
        made.remove(first)
        unstage(*made)
        return first
    open_ = kept(hot_join(placed, main, ["key"], "here", rows, "inner").drop("here"), "open")
    small, large = open_.where(F.col("cnt") <= SMALL), open_.where(F.col("cnt") > SMALL)
    x, y = small.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb")), small.where(F.col("component") != F.col("main"))
    crossed = y.select("key", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca")).join(x, "key").where((F.col("ca") != F.col("cb")) & _near("na", "nb", percent))
    rest = verified(crossed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))

    def ask(group: pa.Table) -> pa.Table:
        asks = group["asks"].to_numpy(zero_copy_only=False)
        q, m = group.filter(pa.array(asks)), group.filter(pa.array(~asks))
        out: set[tuple[int, int]] = set()
        if len(q) and len(m):
            ids, parts, members = m["rep"].to_pylist(), m["component"].to_numpy(), _sets(m["items"])
            asking, own, asked = q["rep"].to_pylist(), q["component"].to_numpy(), _sets(q["items"])
            for i in range(0, len(asked), 512):
                hit = _linked(asked[i : i + 512], members, percent) & (own[i : i + 512, None] != parts[None, :])
                for r in np.flatnonzero(hit.any(1)).tolist():
                    at = np.flatnonzero(hit[r])
                    out |= {(asking[i + r], ids[at[k]]) for k in np.unique(parts[at], return_index=True)[1]}  # a link to each component is enough
        pairs = sorted(out)
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    # pairs that also share the list's cover meet there, so members outside the cover may ask in place of those outside the main component
    place = F.struct(-F.col("cnt"), "key")
    first_list = large.groupBy(F.col("rep").alias("least")).agg(F.min(place)["key"].alias("cover"))
    covers = kept(large.groupBy("key").agg(F.min("rep").alias("least"), F.max("cnt").alias("here")).join(first_list, "least").select("key", "here", F.nullif("cover", "key").alias("cover")), "covers")
    within = large.select("rep", F.col("key").alias("cover"), F.lit(True).alias("covered"))
    told = hot_join(large, covers, ["key"], "here", rows, "inner").join(within, ["rep", "cover"], "left").withColumn("out", F.col("covered").isNull()).drop("cover", "covered", "here")
    told = kept(told, "covered")
    fewer = kept(told.groupBy("key").agg(F.max("cnt").alias("here"), F.max("askers").alias("was"), F.count_if("out").alias("new"), F.coalesce(F.sum(F.when(F.col("out"), F.col("n"))), F.lit(0)).alias("sum")).where(F.col("new") < F.col("was")).drop("was"), "askers")
    large = hot_join(told, fewer, ["key"], "here", rows).withColumn("by_cover", F.col("new").isNotNull())
    large = large.withColumns({"askers": F.coalesce("new", "askers"), "asked": F.coalesce("sum", "asked"), "asker": F.when(F.col("by_cover"), F.col("out")).otherwise(F.col("component") != F.col("main"))}).where(F.col("askers") > 0)
    n, q = blocks(WIDE_BLOCK), blocks(WIDE_BLOCK, "askers", "asked")

    def every(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), count - 1))

    members = large.select("rep", "component", "key", F.pmod(F.xxhash64("rep"), n).alias("block"), every(q).alias("by"), F.lit(False).alias("asks"))
    askers = large.where("asker").select("rep", "component", "key", every(n).alias("block"), F.pmod(F.xxhash64(F.lit("asks"), "rep"), q).alias("by"), F.lit(True).alias("asks"))
    asked = members.unionByName(askers).join(wide.select("rep", "items"), "rep").groupBy("key", "block", "by").applyInArrow(ask, "a long, b long")
    more = kept(rest.union(asked), "links")
    final = stage(components(links.union(more)), "components") if more.head(1) else first
    if final is first:
        made.remove(first)
    unstage(*made)
    return final


def held_sets(texts: DataFrame, reps: DataFrame, words: int, registers: bool = False) -> DataFrame:
    """Staged (rep, items) of the reps' texts, with their registers if wanted; texts is (_id, _text). Rows that share an id give a set each."""
    names = ["rep", "items", *(["registers"] if registers else [])]

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            seen = {}
            for i, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = shingles(text, words)
                seen.setdefault((i, s.tobytes()), s)
            keys = list(seen)
            cols = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary())]
            if registers:
                cols.append(pa.array([sketch(seen[k]).tobytes() for k in keys], pa.binary()))
            yield pa.record_batch(cols, names)

    wanted = reps.select(F.col("rep").alias("_id")).distinct()
    held = texts.join(wanted.hint("shuffle_hash"), "_id", "left_semi").mapInArrow(hold, "rep long, items binary" + ", registers binary" * registers).withColumn("print", F.xxhash64("items"))
    first = held.groupBy("rep", "print").agg(*(F.first(c).alias(c) for c in names[1:]))
    return stage(first.where(F.length("items") > 0).select(*names), "sets")


def with_components(signed: DataFrame, classes: DataFrame, final: DataFrame, rows: int, id_col: str) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every signed row from its class's component; see near_dedup for what is null."""
    joined = classes.select("_f1", "_f2", "rep", "members").join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
    found = stage(joined.where((F.col("members") > 1) | F.col("component").isNotNull()).select("_f1", "_f2", "members", F.coalesce("component", "rep").alias("component")), "found")
    out = hot_join(signed.select("_id", "_n", "_f1", "_f2"), found, ["_f1", "_f2"], "members", rows)
    component = F.when(F.col("_id").isNotNull(), F.when(F.col("_n") > 0, F.coalesce("component", "_id")).otherwise(F.col("_id")))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per input row.

    Documents are linked where 100 * shared shingles >= percent * all shingles of the two; component_id is the least id
    that links reach, itself included; kept: the row's id is its component's. Texts without words (null ones too) have
    no shingles and stand alone. Rows with a null id are not linked: component_id is null, kept is true. Rows that
    share an id are versions of one document and share its component. Ids are cast to long; other columns are left out.
    An empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ["_id", "_n", "_f1", "_f2", "_bands"]
        for b in slices(batches, "_text"):
            seen, n, prints, registers, at = set(), [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                s = shingles(text, words)
                n.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s) and prints[-1] not in seen:  # copies within a slice need no second sketch
                    seen.add(prints[-1])
                    registers.append(sketch(s))
                    at.append(i)
            bands: list = [None] * len(n)
            if at:
                for i, keys in zip(at, bands_of(np.array(registers)).tolist(), strict=True):
                    bands[i] = keys
            f = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(bands, pa.list_(pa.int64()))], names)

    signed = stage(d.mapInArrow(sign, "_id long, _n long, _f1 long, _f2 long, _bands array<long>"), "signed")
    known = signed.where((F.col("_n") > 0) & F.col("_id").isNotNull() | F.col("_bands").isNotNull())
    classes = stage(
        known.groupBy("_f1", "_f2").agg(F.min("_id").alias("rep"), F.first("_n").alias("n"), F.count("_id").alias("members"), F.first("_bands", ignorenulls=True).alias("bands")).where(F.col("rep").isNotNull()), "classes"
    )
    banded = classes.select("rep", "n", F.explode("bands").alias("key"))
    buckets = stage(banded.groupBy("key").agg(F.count("*").alias("cnt"), F.sum("n").alias("total")).where(F.col("cnt") > 1), "bucket-sizes")
    there = classes.agg(F.count("*").alias("classes"), F.coalesce(F.sum("members"), F.lit(0)).alias("rows")).first()
    n_banded = BANDS * there["classes"]
    shared = stage(hot_join(banded, buckets, ["key"], "cnt", n_banded, "inner").dropDuplicates(["key", "rep"]), "buckets")

    sets = held_sets(d, shared.select("rep"), words, registers=True)
    final = list_components(shared, lambda reps: sets, percent, n_banded)
    unstage(buckets, shared, sets)
    return with_components(signed, classes, final, there["rows"], id_col)
