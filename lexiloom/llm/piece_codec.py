"""SentencePiece encoding and decoding by suffix-array matching.

Words that a worker has not met yet are concatenated into one string; its suffixes are sorted by as many characters as the
longest piece has; a binary search finds, for every piece of the vocabulary, its range of suffixes, that is, all its
occurrences. The occurrences become edges (start, length, piece), are sorted by position, and are relaxed: in each
round every word takes its best edge that spans exactly two of its current symbols. That is the model's own order of
merges, so the ids are those of the sentencepiece library for a BPE model.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import slices

SPACE = "▁"
#: Words longer than this are relaxed by a heap over their own edges instead of in rounds over all words.
LONG_WORD = 48
#: Characters that are indexed at once, unless a single word has more.
INDEX_CHARS = 125_000
#: Words whose ids a worker keeps; the cache starts anew when it is full. Workers live on after the task, and with them the cache.
CACHE_ENTRIES = 150_000
SEP = 0x10FFFF


def sort_suffixes(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of codes (code points of up to 21 bits), by the first `depth` code points at least."""
    n = len(codes)

    def after(rank: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        out[: max(0, n - by)] = rank[by:] + np.uint64(1)
        return out

    c = codes.astype(np.uint64)
    key, span = (c << np.uint64(42)) | (after(c, 1) << np.uint64(21)) | after(c, 2), 3
    while True:
        order = np.argsort(key, kind="stable")
        if span >= depth:
            return order
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])]).astype(np.uint64)
        key, span = (rank << np.uint64(32)) | after(rank, span), 2 * span


class PieceCodec:
    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        probe = "ﬁ Ａ ①  x"
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model normalises texts; this codec would give other ids than the library")
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        octets = {i: int(names[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.unk = sp.unk_id()
        self.octet_id = {v: i for i, v in octets.items()}
        usable = [i for i in range(n) if i not in special and i not in octets]
        if any(SPACE in names[i].lstrip(SPACE) for i in usable):
            raise ValueError("a piece crosses words")
        self.single = {names[i]: i for i in usable if len(names[i]) == 1}
        self.ids = np.array(sorted((i for i in usable if len(names[i]) > 1), key=names.__getitem__), np.int64)
        self.pieces = [names[i] for i in self.ids.tolist()]
        self.depth = max(map(len, self.pieces), default=1)
        self.lens = np.array([len(p) for p in self.pieces], np.int64)
        score = np.array([sp.get_score(i) for i in self.ids.tolist()])
        if (score != np.round(score)).any():
            raise ValueError("not a BPE model: scores are no ranks")
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
        table = [b"" if i in special else bytes((octets[i],)) if i in octets else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.letters, self.spans = np.frombuffer(b"".join(table), np.uint8), np.array([len(x) for x in table])
        self.places = np.cumsum(self.spans) - self.spans
        self.alone = not any("\n" in p for p in names)  # then a line feed always parts what stands around it
        self.cache: dict[str, bytes] = {}  # ids as little-endian 32-bit integers

    # encoding

    def _words(self, text: str) -> list[str]:
        """The text with its dummy space, cut before every run of spaces; merges never cross such cuts."""
        parts, held, out = text.replace(SPACE, " ").split(" "), "", []
        for p in parts:
            if p:
                out.append(held + SPACE + p)
                held = ""
            else:
                held += SPACE
        if held:
            out.append(held)
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; an empty text has none."""
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        cut = [self._words(t) if t else [] for t in texts]
        if self.alone:
            cut = [[y for w in words for y in (self._lines(w) if "\n" in w else (w,))] for words in cut]
        new, size = [], 0
        for w in dict.fromkeys(w for words in cut for w in words):
            if w in cache:
                continue
            new.append(w)
            size += len(w) + 1
            if size >= INDEX_CHARS:
                self._index(new)
                new, size = [], 0
        if new:
            self._index(new)
        return [np.frombuffer(b"".join([cache[w] for w in words]), "<i4") for words in cut]

    @staticmethod
    def _lines(word: str) -> Iterator[str]:
        first, *rest = word.split("\n")
        if first:
            yield first
        for p in rest:
            yield "\n"
            if p:
                yield p

    def _edges(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece index) of every occurrence of every piece, by start and then length."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        order = sort_suffixes(codes, self.depth)
        padded = np.concatenate([codes, np.zeros(self.depth, "<u4")])
        rows = np.lib.stride_tricks.sliding_window_view(padded, self.depth)[order]
        suffixes = np.ascontiguousarray(rows).view(f"<U{self.depth}").ravel()
        lo = np.searchsorted(suffixes, np.array(self.pieces, f"<U{self.depth}"), "left")
        last = np.array([(p + chr(SEP) * self.depth)[: self.depth] for p in self.pieces], f"<U{self.depth}")
        hi = np.maximum(np.searchsorted(suffixes, last, "right"), lo)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(which))
        start = order[at]
        by = np.argsort(start * (self.depth + 1) + self.lens[which], kind="stable")
        return start[by], which[by]

    def _index(self, words: list[str]) -> None:
        text = "\n".join(words) + "\n" if self.alone else None
        if text is None or "\n" in words:  # a line feed of its own is a word without edges; it must not stand for the separator
            words_in = [w for w in words if w != "\n"]
            if "\n" in words:
                self.cache["\n"] = np.array(self._fallback("\n"), "<i4").tobytes()
            if not words_in:
                return
            words, text = words_in, (chr(SEP - 1)).join(words_in) + chr(SEP - 1)
        n = len(text)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
        owner = np.repeat(np.arange(len(words)), lens + 1)
        start, which = self._edges(text)
        length, rank, ids = self.lens[which], self.rank[which], self.ids[which]
        end = start + length
        next_of = np.arange(1, n + 1)
        bound = np.ones(n + 1, bool)
        piece = np.full(n, -1, np.int64)
        long = lens > LONG_WORD
        if long.any():
            for w in np.flatnonzero(long).tolist():
                a, b = np.searchsorted(start, [begin[w], begin[w] + lens[w]])
                self._relax_long(int(begin[w]), int(lens[w]), start[a:b], end[a:b], rank[a:b], ids[a:b], next_of, bound, piece)
            keep = ~long[owner[start]]
            start, end, rank, ids = start[keep], end[keep], rank[keep], ids[keep]
        none = np.iinfo(np.int64).max
        while len(start):
            live = bound[start] & bound[end] & (next_of[start] < end)
            start, end, rank, ids = start[live], end[live], rank[live], ids[live]
            if not len(start):
                break
            two = next_of[next_of[start]] == end
            key = np.where(two, (rank << 32) | start, none)
            of = owner[start]
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            best = np.minimum.reduceat(key, first)
            count = np.diff(np.concatenate([first, [len(start)]]))
            spread = np.repeat(best, count)
            chosen = two & (key == spread)
            s, e = start[chosen], end[chosen]
            bound[next_of[s]] = False
            next_of[s] = e
            piece[s] = ids[chosen]
            keep = spread < none  # a word without a mergeable edge has come to its end
            start, end, rank, ids = start[keep], end[keep], rank[keep], ids[keep]
        inside = np.ones(n, bool)
        inside[begin + lens] = False
        at = np.flatnonzero(bound[:n] & inside)
        found = piece[at]
        chars, which = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")[at], return_inverse=True)
        alone = [[self.single[c]] if (c := chr(x)) in self.single else self._fallback(c) for x in chars.tolist()]
        flat, size = np.array([i for x in alone for i in x], np.int64), np.array([len(x) for x in alone])
        count = np.where(found >= 0, 1, size[which])
        ends = np.cumsum(count)
        out = np.repeat(found, count)
        rest = np.repeat(found < 0, count)
        out[rest] = flat[(np.repeat(np.cumsum(size)[which] - size[which] - (ends - count), count) + np.arange(len(out)))[rest]]
        ids_of, total = out.astype("<i4").tobytes(), np.concatenate([[0], ends])
        stops = 4 * total[np.searchsorted(at, begin + lens)]
        starts = 4 * total[np.searchsorted(at, begin)]
        for w, a, b in zip(words, starts.tolist(), stops.tolist(), strict=True):
            self.cache[w] = ids_of[a:b]

    def _fallback(self, c: str) -> list[int]:
        octets = c.encode("utf-8", "replace")
        return [self.octet_id[b] for b in octets] if len(self.octet_id) == 256 else [self.unk]

    @staticmethod
    def _relax_long(begin: int, size: int, start: np.ndarray, end: np.ndarray, rank: np.ndarray, ids: np.ndarray, next_of: np.ndarray, bound: np.ndarray, piece: np.ndarray) -> None:
        """The same order of merges for one word, by a heap: size log size."""
        edge = {(s, e): (r, i) for s, e, r, i in zip(start.tolist(), end.tolist(), rank.tolist(), ids.tolist(), strict=True)}
        nxt, prev, alive, stop = {i: i + 1 for i in range(begin, begin + size)}, {i: i - 1 for i in range(begin, begin + size)}, set(range(begin, begin + size)), begin + size
        heap: list[tuple[int, int, int, int]] = []

        def offer(s: int) -> None:
            mid = nxt[s]
            if mid < stop and (hit := edge.get((s, nxt[mid]))):
                heapq.heappush(heap, (hit[0], s, mid, nxt[mid]))

        for i in range(begin, stop):
            offer(i)
        while heap:
            _, s, mid, e = heapq.heappop(heap)
            if s not in alive or mid not in alive or nxt[s] != mid or nxt[mid] != e:
                continue
            alive.discard(mid)
            nxt[s] = e
            if e < stop:
                prev[e] = s
            bound[mid] = False
            next_of[s] = e
            piece[s] = edge[s, e][1]
            offer(s)
            if prev[s] >= begin:
                offer(prev[s])

    # decoding

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids without its dummy space. Bytes that are not UTF-8 become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        n = self.spans[ids]
        at = np.repeat(self.places[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out = self.letters[at].tobytes().decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


@lru_cache(2)
def codec(model_file: str) -> PieceCodec:
    return PieceCodec(model_file)


def encode_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """(id, text, ids[, decoded_col]): every whole text with its piece ids, one row per input row; decoded_col: the text that the ids decode to.

    Decoding in the same pass spares every task a second Python worker, which would live on beside the first.

    Null and empty texts have an empty list (a null text stays null). Ids of rows may be null or repeated; other columns are
    left out. An empty table gives an empty result. One narrow Arrow pass, no shuffle; a worker's cache of words is bounded.
    The model file must be readable on every executor (as the installed package's is).
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for b in slices(batches, "_text"):
            ids = c.encode_batch([x or "" for x in b.column(1).to_pylist()])
            flat = np.concatenate(ids)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            more = [pa.array([c.decode(x) for x in ids], pa.string())] if decoded_col else []
            yield pa.record_batch([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), *more], ["_id", "_text", "_ids", "_decoded"][: 3 + len(more)])

    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = d.mapInArrow(encode, f"_id {dict(d.dtypes)['_id']}, _text string, _ids array<int>" + ", _decoded string" * bool(decoded_col))
    return out.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), F.col("_ids").alias("ids"), *([F.col("_decoded").alias(decoded_col)] if decoded_col else []))


def decode_pieces(encoded: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds out_col, the text of ids_col (null where that is null). SPACE in a text comes back as a space, as in the library."""
    from pyspark.sql.types import StringType, StructType

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for b in batches:
            ids = b.column(b.schema.get_field_index(ids_col))
            flat, at = ids.values.to_numpy(), ids.offsets.to_numpy()
            text = [None if null else c.decode(flat[at[i] : at[i + 1]]) for i, null in enumerate(ids.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, out_col])

    return encoded.mapInArrow(decode, StructType([*encoded.schema.fields]).add(out_col, StringType()))
