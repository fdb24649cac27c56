"""Operators on node tables: order, context windows, merges, versions, project figures, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as tx

#: Node types, and those that are rendered.
NODE_TYPES = (
    "heading", "paragraph", "quote", "list", "list_item", "image", "caption", "table", "footnote", "footnote_reference",
    "equation", "code_block", "horizontal_rule", "page_break_hint",
)
TRANSLATABLE = ("heading", "paragraph", "quote", "list", "list_item", "caption", "table", "footnote", "footnote_reference")


def translatable(kind: Column) -> Column:
    """Types are compared in lower case; unknown and null ones count as paragraphs."""
    kind = F.lower(kind)
    return F.when(kind.isin(*NODE_TYPES), kind).otherwise("paragraph").isin(*TRANSLATABLE)


def shown(target: Column, source: Column) -> Column:
    """The rendering, or the source where there is none."""
    return F.coalesce(F.nullif(target, F.lit("")), source)


def number_nodes(nodes: DataFrame) -> DataFrame:
    """Adds order_index from 0 within each project by (chapter_index, node_index, node_id): places in the chapter, after the nodes of earlier chapters."""
    w = Window.partitionBy("project_id").orderBy("chapter_index").rowsBetween(Window.unboundedPreceding, -1)
    sizes = nodes.groupBy("project_id", "chapter_index").agg(F.count("*").alias("_size"))
    before = sizes.select(F.col("project_id").alias("_p"), F.col("chapter_index").alias("_c"), F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("project_id", "chapter_index").orderBy("node_index", "node_id")) - 1
    n = nodes.withColumn("_at", at).join(before, F.col("project_id").eqNullSafe(F.col("_p")) & F.col("chapter_index").eqNullSafe(F.col("_c")))
    return n.withColumn("order_index", F.col("_before") + F.col("_at")).drop("_p", "_c", "_before", "_at")


def number_chapters(nodes: DataFrame, chapter: str) -> DataFrame:
    """Adds chapter_index from 0 within each project by the chapter column, over distinct chapters."""
    every = nodes.select(F.col("project_id").alias("_p"), F.col(chapter).alias("_c")).distinct()
    every = every.withColumn("chapter_index", F.row_number().over(Window.partitionBy("_p").orderBy("_c")) - 1)
    return nodes.join(every, F.col("project_id").eqNullSafe(F.col("_p")) & F.col(chapter).eqNullSafe(F.col("_c"))).drop("_p", "_c")


def merge_next(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen nodes (node_id) take up the next node of their chapter, which goes; the next one's rendering is not merged and gaps in the order stay."""
    w = Window.partitionBy("chapter_id").orderBy("order_index")
    n = nodes.join(chosen.select("node_id").distinct().withColumn("_take", F.lit(True)), "node_id", "left")
    n = n.withColumn("_next", F.lead("content").over(w)).withColumn("_gone", F.coalesce(F.lag("_take").over(w), F.lit(False)))
    return n.where(~F.col("_gone")).withColumn("content", F.when(F.col("_take") & F.col("_next").isNotNull(), F.concat_ws(" ", "content", "_next")).otherwise(F.col("content"))).drop("_take", "_next", "_gone")


def latest(log: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") == 1).drop("_n")


def rolling_context(nodes: DataFrame, k: int = 4, budget: int = 300, done: Column | None = None) -> DataFrame:
    """Adds context: the last k earlier nodes of the chapter for which `done` holds, oldest first; the first always fits, later ones are skipped where they would pass the token budget.

    nodes: (chapter_id, node_id, order_index, content). A frame gathers the done nodes before each node; a fold spends the budget.
    """
    done = F.lit(True) if done is None else done
    n = nodes.withColumn("_done", done).withColumn("_rank", F.sum(F.col("_done").cast("int")).over(Window.partitionBy("chapter_id").orderBy("order_index").rowsBetween(Window.unboundedPreceding, -1)))
    d = n.where("_done").select("chapter_id", "node_id", "order_index", (F.coalesce("_rank", F.lit(0)) + 1).alias("_at"), F.greatest(F.lit(1), F.floor(tx.word_count(F.col("content")) * 1.45)).cast("long").alias("_cost"))
    frame = Window.partitionBy("chapter_id").orderBy("_at").rowsBetween(-(k - 1), 0)
    tails = d.select("chapter_id", "_at", F.collect_list(F.struct(F.col("node_id").alias("id"), F.col("_cost").alias("cost"))).over(frame).alias("_tail"))
    start = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(0).cast("long").alias("spent"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["ids"]) == 0) | (acc["spent"] + x["cost"] <= budget)
        return F.when(fits, F.struct(F.concat(acc["ids"], F.array(x["id"].cast("string"))).alias("ids"), (acc["spent"] + x["cost"]).alias("spent"))).otherwise(acc)

    joined = n.withColumn("_at", F.coalesce("_rank", F.lit(0))).join(tails, ["chapter_id", "_at"], "left")
    empty = F.array().cast("array<struct<id:string,cost:bigint>>")
    return joined.withColumn("context", F.aggregate(F.coalesce(F.col("_tail").cast("array<struct<id:string,cost:bigint>>"), empty), start, step)["ids"]).drop("_done", "_rank", "_at", "_tail")


def stratified_sample(nodes: DataFrame, quantiles: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Nodes at fixed places of each chapter (by order_index), and all headings. The places are the feature."""
    w = Window.partitionBy("chapter_id")
    at = F.row_number().over(w.orderBy("order_index")) - 1
    n = nodes.withColumn("_at", at).withColumn("_n", F.count("*").over(w))
    places = F.array(*[F.floor((F.col("_n") - 1) * F.lit(q)) for q in quantiles])
    return n.where(F.array_contains(places, F.col("_at").cast("long")) | (F.col("node_type") == "heading")).drop("_at", "_n")


def project_stats(nodes: DataFrame) -> DataFrame:
    """Per project, in one pass: node counts by state, skipped, terminal, progress in percent (100 where nothing is to be rendered)."""
    t = translatable(F.col("node_type"))
    done, failed, review = F.col("status").isin("TRANSLATED", "QA_PASSED"), F.col("status") == "FAILED", F.col("status") == "NEEDS_REVIEW"
    per = nodes.groupBy("project_id").agg(
        F.count("*").alias("total_nodes"), F.count_if(t).alias("translatable_nodes"), F.count_if(t & done).alias("translated_nodes"), F.count_if(t & failed).alias("failed_nodes"), F.count_if(t & review).alias("needs_review_nodes")
    )
    return per.select(
        "*",
        F.greatest(F.lit(0), F.col("total_nodes") - F.col("translatable_nodes")).alias("skipped_nodes"),
        (F.col("translated_nodes") + F.col("failed_nodes") + F.col("needs_review_nodes")).alias("terminal_nodes"),
        F.when(F.col("translatable_nodes") > 0, F.round(F.col("translated_nodes") / F.col("translatable_nodes") * 100.0, 1)).otherwise(100.0).alias("progress_percent"),
    )


def final_stage(stats: DataFrame, stopped: Column) -> DataFrame:
    """(project_id, stage) when a job ends."""
    every = (F.col("translatable_nodes") == 0) | (F.col("translated_nodes") == F.col("translatable_nodes"))
    stage = F.when(stopped, "TRANSLATION_CONFIGURED").when(every, "TRANSLATED").when(F.col("terminal_nodes") >= F.col("translatable_nodes"), "TRANSLATED_WITH_REVIEW").otherwise("TRANSLATION_FAILED")
    return stats.select("project_id", stage.alias("stage"))


def recover(status: Column) -> Column:
    """States after a crash: what was under way waits again."""
    return F.when(status == "TRANSLATING", "PENDING").otherwise(status)


def patch(current: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """Rows of current with the non-null fields of update; a field cannot be set to null."""
    fields = [c for c in update.columns if c != key]
    u = update.select(F.col(key).alias(key), *[F.col(c).alias(f"_u_{c}") for c in fields])
    return current.join(u, key, "left").select(*[F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in current.columns])


def find_replace(nodes: DataFrame, find: str, replacement: str, text: str = "target_text") -> DataFrame:
    """(…, matches, replaced) of the nodes whose text holds `find` exactly."""
    n = (F.length(text) - F.length(F.replace(F.col(text), F.lit(find), F.lit("")))) / len(find)
    return nodes.where(F.col(text).contains(find)).select("*", n.cast("long").alias("matches"), F.replace(F.col(text), F.lit(find), F.lit(replacement)).alias("replaced"))


def preview(nodes: DataFrame, first: int = 15, most: int = 40) -> DataFrame:
    """Representative preview of each project: the first nodes of chapter 0 and the first image or table of each later chapter, `most` in all."""
    visual = F.col("node_type").isin("image", "table")
    w = Window.partitionBy("project_id", "chapter_index").orderBy(F.when(F.col("chapter_index") == 0, 0).otherwise(F.when(visual, 0).otherwise(1)), "order_index")
    n = nodes.withColumn("_n", F.row_number().over(w))
    chosen = n.where(((F.col("chapter_index") == 0) & (F.col("_n") <= first)) | ((F.col("chapter_index") > 0) & visual & (F.col("_n") == 1)))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("chapter_index", "order_index"))
    return chosen.withColumn("_r", rank).where(F.col("_r") <= most).drop("_n", "_r")


def preview_picks(nodes: DataFrame, terms: list[str], limit: int = 7) -> DataFrame:
    """Per project at most `limit` distinct nodes: first heading, first, middle and longest paragraph, first with a term, first with a name of several words, then in order."""
    para = F.col("node_type") == "paragraph"
    project = Window.partitionBy("project_id")
    n = nodes.withColumn("_p", F.when(para, F.row_number().over(Window.partitionBy("project_id", para).orderBy("order_index")))).withColumn("_np", F.count_if(para).over(project))
    name = F.col("content").rlike(r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b")
    term = F.lit(False)
    for t in terms:
        term = term | tx.has_term(F.col("content"), F.lit(t))

    def first_of(when: Column, *order: Column) -> Column:
        return F.when(when, F.row_number().over(Window.partitionBy("project_id", when).orderBy(*order, "order_index"))) == 1

    rules = [
        first_of(F.col("node_type") == "heading"), F.col("_p") == 1, F.col("_p") == F.floor(F.col("_np") / 2) + 1,
        first_of(para, F.desc(F.length("content"))), first_of(term), first_of(name),
    ]
    priority = F.lit(len(rules))
    for i, r in reversed(list(enumerate(rules))):
        priority = F.when(F.coalesce(r, F.lit(False)), i).otherwise(priority)
    w = project.orderBy("priority", "order_index")
    return n.withColumn("priority", priority).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_p", "_np", "_r")


def nested(chapters: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project_id, chapter_index, chapter_id, nodes): one row per chapter with its nodes in order, null without any. A project is its rows; no row holds a project."""
    per = nodes.groupBy(F.col("project_id").alias("_p"), F.col("chapter_id").alias("_c")).agg(F.array_sort(F.collect_list(F.struct("order_index", "node_id", "content"))).alias("nodes"))
    own = F.col("project_id").eqNullSafe(F.col("_p")) & F.col("chapter_id").eqNullSafe(F.col("_c"))
    return chapters.join(per, own, "left").select("project_id", "chapter_index", "chapter_id", "nodes")


def neighbours(nodes: DataFrame, previous: int = 2, following: int = 2, budget: int = 700, done: Column | None = None) -> DataFrame:
    """Adds context: the nearest nodes of the chapter for which `done` holds, `previous` before and `following` behind, in order, within the token budget.

    nodes: (chapter_id, node_id, order_index, content, target_text); a node is no neighbour of itself. The first always fits,
    later ones are skipped where they would pass the budget. A join by rank on either side: done nodes are numbered in their
    chapter, each carries the ids and costs of the frame that ends with it and of the one that begins with it, and a node
    takes the frames of the numbers next to it, whatever gaps lie between. Null texts cost nothing; null chapters have no neighbours.
    """
    done = F.lit(True) if done is None else done
    before = Window.partitionBy("chapter_id").orderBy("order_index", "node_id").rowsBetween(Window.unboundedPreceding, -1)
    n = nodes.withColumn("_done", F.coalesce(done, F.lit(False))).withColumn("_behind", F.coalesce(F.sum(F.col("_done").cast("int")).over(before), F.lit(0)))
    words = tx.word_count(F.coalesce("content", F.lit(""))) + tx.word_count(F.coalesce("target_text", F.lit("")))
    cost = F.greatest(F.lit(1), F.floor(words * 1.45)).cast("long")
    ranked = n.where("_done").select("chapter_id", (F.col("_behind") + 1).alias("_at"), F.struct(F.col("node_id").cast("string").alias("id"), cost.alias("cost")).alias("x"))
    place = Window.partitionBy("chapter_id").orderBy("_at")
    frames = ranked.select("chapter_id", "_at", F.collect_list("x").over(place.rowsBetween(1 - previous, 0)).alias("_ends"), F.collect_list("x").over(place.rowsBetween(0, following - 1)).alias("_starts"))
    n = n.withColumn("_ahead", F.col("_behind") + F.col("_done").cast("int") + 1)
    n = n.join(frames.select("chapter_id", F.col("_at").alias("_behind"), "_ends"), ["chapter_id", "_behind"], "left")
    n = n.join(frames.select("chapter_id", F.col("_at").alias("_ahead"), "_starts"), ["chapter_id", "_ahead"], "left")
    empty = F.array().cast("array<struct<id:string,cost:bigint>>")
    start = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(0).cast("long").alias("spent"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["ids"]) == 0) | (acc["spent"] + x["cost"] <= budget)
        return F.when(fits, F.struct(F.concat(acc["ids"], F.array(x["id"])).alias("ids"), (acc["spent"] + x["cost"]).alias("spent"))).otherwise(acc)

    found = F.concat(F.coalesce("_ends", empty), F.coalesce("_starts", empty))
    return n.withColumn("context", F.aggregate(found, start, step)["ids"]).select(*nodes.columns, "context")
