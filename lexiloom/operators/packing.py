"""Token-budget packing: greedy chunks of nodes, and splitting of texts that are too long."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexiloom.functions import text as tx
from lexiloom.operators.nodes import translatable
from lexiloom.operators.terms import term_hits
from lexiloom.stages import staged


class _Chunks:
    """The nodes of one chapter put into chunks, one after the other. fits(held, row) gives what the chunk holds with the row, or None."""

    def __init__(self, fits: Callable[[dict | None, dict], dict | None], alone: Callable[[dict], bool], starts: Callable[[dict], bool]) -> None:
        self.fits, self.alone, self.starts = fits, alone, starts
        self.no, self.nodes, self.held, self.closed = 0, [], None, False

    def take(self, row: dict) -> list[tuple]:
        with_row = None if not self.nodes or self.closed or self.starts(row) or self.alone(row) else self.fits(self.held, row)
        out: list[tuple] = []
        if with_row is None:
            out = self.end()
            self.no, self.nodes, self.closed = self.no + 1, [], self.alone(row)
            with_row = self.fits(None, row) or {}
            self.closed = self.closed or not with_row
        self.nodes.append(row)
        self.held = with_row
        return out

    def end(self) -> list[tuple]:
        return [(r["chapter_id"], r["node_id"], self.no, r, self.held) for r in self.nodes]


def _streamed(nodes: DataFrame, make: Callable[[], _Chunks], shown: Callable[[dict, dict], tuple], schema: str) -> DataFrame:
    """(chapter_id, node_id, chunk_no, *shown): a pass over the nodes of each chapter in order.

    Rows of a chapter come to one task sorted and are folded as they stream by, so a task holds a chunk and not a chapter, and
    the work is linear. What moves is counts, not texts.
    """
    fields = [f.name for f in nodes.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*kept, *(pa.int64() for _ in schema.split(","))]
        names = ["chapter_id", "node_id", "chunk_no", *(c.split()[0] for c in schema.split(","))]
        chapter, chunks = None, None

        def batch(done: list[tuple]) -> pa.RecordBatch:
            rows = [(c, n, no, *shown(r, held)) for c, n, no, r, held in done]
            return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [kinds[0], kinds[1], pa.int64(), *kinds[2:]], strict=True)], names)

        for b in batches:
            done: list[tuple] = []
            for row in b.to_pylist():
                if chunks is None or row["chapter_id"] != chapter:
                    done += chunks.end() if chunks else []
                    chapter, chunks = row["chapter_id"], make()
                done += chunks.take(row)
            if done:
                yield batch(done)
        if chunks and (done := chunks.end()):
            yield batch(done)

    types = dict(nodes.dtypes)
    kept = [to_arrow_type(nodes.schema[c].dataType) for c in ("chapter_id", "node_id")]
    ordered = nodes.select(*fields).repartition("chapter_id").sortWithinPartitions("chapter_id", "order_index", "node_id")
    return ordered.mapInArrow(run, f"chapter_id {types['chapter_id']}, node_id {types['node_id']}, chunk_no long, {schema}")


def pack(nodes: DataFrame, target: int = 1200, limit: int | None = None, extra: int = 0) -> DataFrame:
    """(chapter_id, node_id, chunk_no, tokens): nodes of each chapter in order, packed greedily; each node takes `extra` tokens more.

    A chunk ends before a node that would pass the target, before a heading, and around tables, footnotes and nodes over
    the limit, which stand alone. Where a chunk starts depends on what the last one took, so this is a fold over the
    chapter's (order, tokens, kind), not a running sum.
    """
    limit = max(64, limit or target)
    target = min(target, limit)
    kind = F.coalesce(F.lower("node_type"), F.lit("paragraph"))
    n = nodes.where(translatable(F.col("node_type"))).select("chapter_id", "node_id", "order_index", kind.alias("node_type"), (tx.token_estimate(F.col("content")) + extra).alias("tokens"))

    def fits(held: dict | None, row: dict) -> dict | None:
        tokens = row["tokens"] + (held["tokens"] if held else 0)
        return {"tokens": tokens} if held is None or tokens <= target else None

    def make() -> _Chunks:
        return _Chunks(fits, lambda r: r["tokens"] > limit or r["node_type"] in ("table", "footnote"), lambda r: r["node_type"] == "heading")

    return _streamed(n, make, lambda r, held: (r["tokens"],), "tokens long")


def pack_requests(nodes: DataFrame, window: int = 4096, fixed: int = 600, per_node: int = 12) -> DataFrame:
    """pack() by what a request takes: as many nodes as fit the window beside what every request has (fixed) and what each node adds (per_node)."""
    return pack(nodes, max(64, window - fixed), extra=per_node)


#: What a request keeps for its answer (share of the source, a constant, least and most) and as a margin (share of the window, least).
RESERVED, MARGIN = (1.35, 128, 320, 1400), (0.06, 220)


def counts_of(text: Column) -> list[Column]:
    """Words, punctuation and non-ASCII characters of a text: what its token estimate adds up."""
    return [tx.word_count(text).cast("long"), tx.count_of(text, r"[.,;:!?()\[\]{}\"']"), tx.count_of(text, r"[^\x00-\x7F]")]


def _tokens(words: float, marks: float, wide: float) -> int:
    return max(1, int(words * 1.22 + marks * 0.22 + wide * 0.08 + 8))


def quoted(c: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(F.coalesce(c.cast("string"), F.lit(""))))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def pack_assembled(nodes: DataFrame, terms: DataFrame, contexts: tuple[int, ...] = (0,), fixed: int = 600, window: int = 4096, most_source: int | None = None) -> DataFrame:
    """(chapter_id, node_id, chunk_no, source_tokens, total_tokens, level): nodes of each chapter packed by the request that they would make.

    A node joins a chunk while the request still fits: its source (the nodes as JSON blocks) within most_source, and fixed +
    the terms (source_term, target) that occur in the nodes taken + the context + source + answer + margin within the window.
    contexts: what the context takes from full to most compact; the first of these levels that fits is taken, so the cost
    falls while context can still be dropped, and what has to stay grows with the terms of each node. A chunk ends before a
    heading, table or footnote and after a table or footnote; a node that fits in no request stands alone with level -1 and
    the total of the most compact one. source_tokens, total_tokens and level are the chunk's. Nodes that need no rendering are left out.

    Terms meet nodes by an equi-join (term_hits); a chapter's counts stream through one task in order, texts do not.
    """
    most_source = window if most_source is None else most_source
    n = nodes.where(translatable(F.col("node_type"))).select("chapter_id", "node_id", "order_index", F.coalesce(F.lower("node_type"), F.lit("paragraph")).alias("node_type"), F.coalesce("content", F.lit("")).alias("content"))
    entry = F.concat(F.lit('{"source_term": '), quoted(F.col("source_term")), F.lit(', "preferred_target": '), quoted(F.col("target")), F.lit("}"))
    listed = terms.select("source_term", "target").distinct().withColumn("_counts", F.array(*counts_of(entry)))
    hits = term_hits(n.select("chapter_id", "node_id", "content"), listed, "content", "source_term").groupBy("chapter_id", "node_id")
    hits = hits.agg(F.array_sort(F.collect_set(F.struct("source_term", "target", "_counts"))).alias("terms"))
    block = F.concat(F.lit('{ "node_id": '), quoted(F.col("node_id")), F.lit(', "type": '), quoted(F.col("node_type")), F.lit(', "text": '), quoted(F.col("content")), F.lit(" }"))
    n = n.select("chapter_id", "node_id", "order_index", "node_type", F.array(*counts_of(block)).alias("counts"))
    same = [n[c].eqNullSafe(hits[c]) for c in ("chapter_id", "node_id")]
    n = n.join(hits, same[0] & same[1], "left").select(n["chapter_id"], n["node_id"], "order_index", "node_type", "counts", "terms")

    def request(counts: list[int], size: int, terms_: dict) -> dict:
        source = _tokens(counts[0] + 2, counts[1] + 2 + size - 1, counts[2])
        kept = [sum(c[i] for c in terms_.values()) for i in range(3)]
        glossary = _tokens(kept[0] if terms_ else 1, kept[1] + 2 + max(0, len(terms_) - 1), kept[2])
        share, more, least, most = RESERVED
        rest = fixed + glossary + source + max(least, min(most, int(source * share) + more)) + max(MARGIN[1], int(window * MARGIN[0]))
        level = next((i for i, c in enumerate(contexts) if rest + c <= window), -1) if source <= most_source else -1
        return {"counts": counts, "size": size, "terms": terms_, "source": source, "total": rest + contexts[level], "level": level}

    def fits(held: dict | None, row: dict) -> dict | None:
        own = {(t["source_term"], t["target"]): t["_counts"] for t in row["terms"] or []}
        r = request(row["counts"], 1, own) if held is None else request([a + b for a, b in zip(held["counts"], row["counts"], strict=True)], held["size"] + 1, held["terms"] | own)
        return r if held is None or r["level"] >= 0 else None

    def make() -> _Chunks:
        return _Requests(fits, lambda r: r["node_type"] in ("table", "footnote"), lambda r: r["node_type"] == "heading")

    return _streamed(n, make, lambda r, held: (held["source"], held["total"], held["level"]), "source_tokens long, total_tokens long, level long")


class _Requests(_Chunks):
    """Chunks of which one that fits no request is closed."""

    def take(self, row: dict) -> list[tuple]:
        out = super().take(row)
        self.closed = self.closed or self.held["level"] < 0
        return out


def estimate(text: str) -> int:
    """The same estimate as functions.text.token_estimate, for one string."""
    return _estimated(*_measures(text)) if text else 0


_MARKS = re.compile(r"[.,;:!?()\[\]{}\"']")
_FOREIGN = re.compile(r"[^\x00-\x7f]")


def _measures(text: str) -> tuple[int, int, int]:
    """Words, punctuation and non-ASCII characters of a text."""
    return len(text.split()), len(_MARKS.findall(text)), 0 if text.isascii() else len(_FOREIGN.findall(text))


def _estimated(words: int, marks: int, foreign: int) -> int:
    return max(1, int(words * 1.22 + marks * 0.22 + foreign * 0.08 + 8))


def _greedy(units: list[str], budget: int, joint: str) -> list[str]:
    out: list[str] = []
    for u in units:
        if out and estimate(out[-1] + joint + u) <= budget:
            out[-1] += joint + u
        else:
            out.append(u)
    return out


def split_text(text: str, budget: int) -> list[str]:
    """Whole sentences in segments within the budget; a sentence over it is split between words. A sentence ends where a capital, digit, quote or bracket follows."""
    out: list[str] = []
    for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])", text.strip()):
        parts = [s] if estimate(s) <= budget else _greedy(s.split(), budget, " ")
        for p in parts:
            if out and len(parts) == 1 and estimate(out[-1] + " " + p) <= budget:
                out[-1] += " " + p
            elif p:
                out.append(p)
    return out


def split_long(nodes: DataFrame, budget: int) -> DataFrame:
    """(node_id, part, text) of texts over the budget; what a node's parts join to is its text up to blanks."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, p) for i, t in zip(b["node_id"], b["content"], strict=True) for k, p in enumerate(split_text(t, budget))]
            yield pd.DataFrame(rows, columns=["node_id", "part", "text"])

    long = nodes.where(tx.token_estimate(F.col("content")) > budget).select("node_id", "content")
    return long.mapInPandas(cut, "node_id string, part long, text string")


def _cut(text: str, pattern: str) -> list[tuple[str, str]]:
    """The pieces of a text between matches of a pattern (one group), each with the match behind it."""
    parts = re.split(pattern, text)
    return list(zip(parts[::2], [*parts[1::2], ""], strict=True))


def _merged(units: list[tuple[str, str]], budget: int) -> list[tuple[str, str]]:
    """Units put together while they are within the budget; blank ones join what is before them. Each is measured once: measures add up, but for a word that goes on in the next unit."""
    out: list[tuple[str, str]] = []
    held = (0, 0, 0)
    for unit, gap in units:
        own = _measures(unit)
        if out:
            last, between = out[-1]
            whole = last + between
            on = bool(whole and unit) and not whole[-1].isspace() and not unit[0].isspace()
            w, m, f = _measures(between) if between else (0, 0, 0)
            on += bool(last and between) and not last[-1].isspace() and not between[0].isspace()
            both = held[0] + w + own[0] - on, held[1] + m + own[1], held[2] + f + own[2]
            if not last.strip() or not unit.strip() or _estimated(*both) <= budget:
                out[-1], held = (whole + unit, gap), both
                continue
        out.append((unit, gap))
        held = own
    return out


def layout_parts(text: str, budget: int) -> list[tuple[str, str]]:
    """(part, gap) within the budget, whose texts and gaps joined in order are the text again, to the byte.

    Cut at blank lines, line ends and behind sentences and clauses; what is over the budget then is cut between words, and a
    word over it stays whole.
    """
    units: list[tuple[str, str]] = []
    for unit, gap in _cut(text, r"(\n{2,}|\n|(?<=[.!?;:])\s+)"):
        pieces = _merged(_cut(unit, r"(\s+)"), budget) if estimate(unit) > budget else [(unit, "")]
        units += [*pieces[:-1], (pieces[-1][0], pieces[-1][1] + gap)]
    return _merged(units, budget)


def _split(parts: DataFrame) -> DataFrame:
    """(node_id, path, text, gap) of parts (node_id, path, text, gap, budget), each cut by its own budget; the last piece keeps the part's gap. Paths grow by the piece's number."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for node, path, text, gap, budget in b.itertuples(index=False):
                pieces = layout_parts(text, budget)
                pieces[-1] = pieces[-1][0], pieces[-1][1] + gap
                rows += [(node, [*path, k], *p) for k, p in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["node_id", "path", "text", "gap"])

    return parts.select("node_id", "path", "text", "gap", "budget").mapInPandas(cut, "node_id string, path array<int>, text string, gap string")


def split_layout(nodes: DataFrame, budget: int) -> DataFrame:
    """(node_id, part, text, gap): texts over the budget in parts within it, with what stood between them; parts and gaps joined in order are the text again, to the byte."""
    long = nodes.where(tx.token_estimate(F.col("content")) > budget).select(F.col("node_id").cast("string"), F.array().cast("array<int>").alias("path"), F.col("content").alias("text"), F.lit("").alias("gap"), F.lit(budget).alias("budget"))
    return _split(long).select("node_id", F.get("path", F.lit(0)).cast("long").alias("part"), "text", "gap")


def segments(nodes: DataFrame, window: int = 4096, fixed: int = 600, first_context: int = 0, most_source: int | None = None, depth: int = 4) -> DataFrame:
    """(node_id, part, text, gap, source_tokens, total_tokens, fits): nodes (node_id, content) cut into the segments that they are rendered in.

    A segment's request takes fixed, its source, room for the answer, a margin, and its context: first_context for the first
    segment, for every other the segment before it with its rendering (taken to be as long as the answer's share). Texts are
    cut to a fifth of the window (most_source and 64 tokens are bounds); segments whose request is over the window are cut
    again to what is left for their source, or to half, `depth` times at most. A pass cuts only those, and takes along only
    nodes that have any; each ends in a staged table. Cuts only make what is behind them smaller, so a segment that fits stays so.
    fits is false for segments that still do not (a single word, or the depth is reached). Texts and gaps joined in order are
    the content again, to the byte. Null and empty contents have no segment; node ids become text and are unique.
    """
    most_source = window if most_source is None else most_source
    share, more, least, most = RESERVED
    margin = max(MARGIN[1], int(window * MARGIN[0]))
    n = nodes.where(F.coalesce("content", F.lit("")) != "").select(F.col("node_id").cast("string"), F.array().cast("array<int>").alias("path"), F.col("content").alias("text"), F.lit("").alias("gap"))
    start = max(64, min(most_source, window // 5))
    live = _split(n.withColumn("budget", F.lit(start)))
    done = []
    for i in range(depth + 1):
        source = tx.token_estimate(F.col("text"))
        order = Window.partitionBy("node_id").orderBy("path")
        before = F.lag("source_tokens").over(order)
        sized = live.withColumn("source_tokens", source).withColumn("context", F.coalesce(F.floor(before * (1 + share)), F.lit(first_context)))
        reserved = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.col("source_tokens") * share) + more))
        sized = sized.withColumn("total_tokens", (fixed + margin + F.col("context") + F.col("source_tokens") + reserved).cast("long"))
        sized = sized.withColumn("over", (F.col("total_tokens") > window) | (F.col("source_tokens") > most_source))
        sized = staged(sized.drop("context"), "segments")
        open_ = sized.where("over").select("node_id").distinct()
        if i == depth or not open_.head(1):
            done.append(sized)
            break
        done.append(sized.join(open_, "node_id", "left_anti"))
        going = sized.join(open_, "node_id", "left_semi")
        room = F.least(F.lit(most_source), F.lit(window) - F.col("total_tokens") + F.col("source_tokens"))
        budget = F.least(F.greatest(F.lit(16), room), F.greatest(F.lit(16), F.floor(F.col("source_tokens") / 2))).cast("int")
        again = _split(going.where("over").withColumn("budget", budget))
        live = going.where(~F.col("over")).select("node_id", "path", "text", "gap").unionByName(again)
    found = reduce(DataFrame.unionByName, done)
    part = F.row_number().over(Window.partitionBy("node_id").orderBy("path")) - 1
    return found.select("node_id", part.cast("long").alias("part"), "text", "gap", "source_tokens", "total_tokens", (~F.col("over")).alias("fits"))


def rejoin(parts: DataFrame, *also: Column, text: str = "text") -> DataFrame:
    """(node_id, joined): parts (of one column, rendered or not) put together again with their gaps; `also`: more aggregates of a node's parts, from the same pass."""
    return parts.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", text, "gap"))), lambda p: F.concat(p[text], p["gap"])), "").alias("joined"), *also)
