"""Ranked example retrieval: additive scores over a library of examples, best first, ties by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import scores, text as tx
from lexiloom.stages import staged


def _length_match(a: Column, b: Column, most: int) -> Column:
    return F.greatest(F.lit(0), F.lit(most) - F.floor(F.abs(a - b) / 4))


#: Deals of a memory table: a project's memory is spread over so many parts, and the queries go to each.
DEALS = 16


def _best(scored: DataFrame, per: list[str], k: int, tie: str) -> DataFrame:
    """The k best rows per key by score, ties by `tie`, with rank. Spark keeps k rows a key and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("score"), tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


#: A library of so many examples at most goes to the tasks whole.
LIBRARY = 5_000


def few_shot(nodes: DataFrame, library: DataFrame, k: int = 4) -> DataFrame:
    """(node_id, example_id, score, rank): at most k examples of the node's domain (GENERAL where the library lacks it), each source once.

    nodes: (node_id, domain, mode, node_type, source_text); library: (example_id, domain, node_type, modes, register, patterns,
    source). Examples alike but for their id are one, the least. The library is counted: LIBRARY examples at most are
    broadcast as a list for each domain, and a node's best are taken from its list in the pass that reads it, without a shuffle. A
    larger one meets nodes by the domain, dealt in parts that each keep k examples a node.
    """
    alike = ["domain", "x_type", "modes", "register", "patterns", "source", "x_n"]
    lib = library.select("example_id", "domain", F.lower("node_type").alias("x_type"), "modes", "register", "patterns", F.sha2("source", 256).alias("source"), tx.word_count(F.col("source")).alias("x_n"))
    lib = lib.groupBy(*alike).agg(F.min("example_id").alias("example_id"))
    have = library.select("domain").distinct().withColumn("_have", F.lit(True))
    n = nodes.join(have, "domain", "left").withColumn("domain", F.when(F.col("_have"), F.col("domain")).otherwise("GENERAL"))
    n = n.select("node_id", "domain", "mode", F.lower("node_type").alias("node_type"), scores.pattern_tags(F.col("source_text")).alias("tags"), tx.word_count(F.col("source_text")).alias("n"))

    def scored(x) -> Column:  # noqa: ANN001
        type_ = F.when(x["x_type"] == F.col("node_type"), 30).when(F.col("node_type").isin("paragraph", "quote") & (x["x_type"] == "paragraph"), 8).otherwise(0)
        exact = F.col("mode").isin("FAITHFUL", "ACADEMIC", "TECHNICAL") & x["register"].isin("formal", "scholarly", "precise")
        total = 100 + type_ + F.when(F.array_contains(x["modes"], F.col("mode")), 12).otherwise(0) + 18 * F.size(F.array_intersect(F.col("tags"), x["patterns"])) + _length_match(F.col("n"), x["x_n"], 12) + F.when(exact, 5).otherwise(0)
        return total.cast("long")

    if len(library.select("example_id").limit(LIBRARY + 1).collect()) <= LIBRARY:
        lists = lib.groupBy("domain").agg(F.collect_list(F.struct("example_id", *alike[1:])).alias("xs"))
        n = n.join(F.broadcast(lists), "domain").select("node_id", F.array_sort(F.transform("xs", lambda x: F.struct(x["source"].alias("source"), (-scored(x)).alias("least"), x["example_id"].alias("example_id")))).alias("all"))
        best = tx.let(F.col("all"), lambda xs: F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1)["source"] != x["source"])))  # the best of a source comes first
        top = F.slice(F.array_sort(F.transform(best, lambda x: F.struct(x["least"].alias("least"), x["example_id"].alias("example_id")))), 1, k)
        found = n.select("node_id", F.posexplode(top).alias("at", "x"))
        return found.select("node_id", F.col("x.example_id").alias("example_id"), (-F.col("x.least")).alias("score"), (F.col("at") + 1).alias("rank"))
    dealt = n.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    met = dealt.join(lib.withColumn("part", F.pmod(F.xxhash64("source"), F.lit(DEALS)).cast("int")), ["domain", "part"])
    per = met.select("node_id", "part", "example_id", "source", scored({c: F.col(c) for c in alike}).alias("score"))
    one = _best(per, ["node_id", "part", "source"], 1, "example_id").drop("rank")
    some = _best(one, ["node_id", "part"], k, "example_id").drop("rank", "part", "source")
    return _best(some, ["node_id"], k, "example_id").select("node_id", "example_id", "score", "rank")


#: So many rows of the least ids are read first, of each kind of memory and of each length of its texts.
FIRST = 32
#: Word counts that share a length, as the score tells them apart.
STEP = 4


def style_memory(nodes: DataFrame, memory: DataFrame, k: int = 3, first: int = FIRST) -> DataFrame:
    """(node_id, memory_id, score, rank): at most k approved examples of the node's own project.

    nodes is a stated set of queries. A score is what the row's kind (project and the columns compared), its length and at
    most 20 points for shared words come to, so a node does not meet its whole project: it meets the `first` least ids of each
    kind, overall and at its own length. The k-th best of these is a bound; of the other rows the node meets those of kinds and lengths whose
    most points reach it (with as many points, only lesser ids). All others are worse than k rows that were met, so the result is exact.
    """
    kinds = ("domain", "document_type", "mode", "node_type")
    n = nodes.select("node_id", "project_id", *kinds, scores.pattern_tags(F.col("source_text")).alias("tags"), tx.word_set(F.col("source_text")).alias("words"))
    n = staged(n.withColumns({"n": F.size("words"), "at": F.floor(F.size("words") / STEP).cast("int")}), "style-queries")
    m = memory.where((F.col("quality_status") == "USER_APPROVED") & F.col("scope").isin("PROJECT", "USER_LOCAL"))
    m = m.select("memory_id", "project_id", *[F.col(c).alias("m_" + c) for c in kinds], F.col("source_patterns").alias("m_tags"), tx.word_set(F.col("source_text")).alias("m_words"))
    like = ["project_id", *["m_" + c for c in kinds], "m_tags"]
    m = m.withColumns({"kind": F.to_json(F.struct(*like)), "m_n": F.size("m_words"), "m_at": F.floor(F.size("m_words") / STEP).cast("int")})
    m = staged(m.where(F.col("project_id").isNotNull()), "style-memory")

    fixed = sum((F.when(F.upper(c) == F.upper("m_" + c), v).otherwise(0) for c, v in zip(kinds, (70, 25, 18, 18), strict=True)), F.lit(0)) + 12 * F.size(F.array_intersect("tags", "m_tags"))
    score = fixed + F.least(F.lit(20), 3 * F.size(F.array_intersect("words", "m_words"))) + _length_match(F.col("n"), F.col("m_n"), 10)

    # the least ids of each kind and length
    least = m.select("kind", "m_at", "memory_id").withColumn("_n", F.row_number().over(Window.partitionBy("kind", "m_at").orderBy("memory_id"))).where(F.col("_n") <= first)
    cuts = least.groupBy("kind", "m_at").agg(F.max("memory_id").alias("cut"))
    over = m.select("kind", "memory_id").withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy("memory_id"))).where(F.col("_n") <= first).groupBy("kind").agg(F.max("memory_id").alias("over"))
    dealt = m.join(staged(cuts.join(over, "kind"), "style-cuts"), ["kind", "m_at"])
    seen = staged(dealt.where(F.col("memory_id") <= F.col("cut")), "style-first")
    near = n.withColumn("to", F.explode(F.sequence(F.col("at") - 1, F.col("at") + 1))).join(seen.withColumn("to", F.col("m_at")), ["project_id", "to"])
    far = n.join(seen.where(F.col("memory_id") <= F.col("over")), "project_id").where(F.abs(F.col("at") - F.col("m_at")) > 1)
    met = near.drop("to").unionByName(far).select("node_id", "memory_id", score.cast("long").alias("score"))
    some = staged(_best(met, ["node_id"], k, "memory_id").drop("rank"), "style-some")

    # what may still reach the k-th
    kth = some.groupBy("node_id").agg(F.when(F.count("*") >= k, F.max_by(F.struct("score", "memory_id"), F.struct(-F.col("score"), F.col("memory_id")))).alias("kth"))
    bound = n.join(kth, "node_id", "left")

    def reaches(most: Column, id_: str) -> Column:
        return F.col("kth").isNull() | (most > F.col("kth.score")) | ((most == F.col("kth.score")) & (F.col(id_) < F.col("kth.memory_id")))

    left = lambda c: F.min(F.when(F.col("memory_id") > F.col(c), F.col("memory_id")))
    lists = dealt.groupBy("kind", "m_at", *like).agg(left("cut").alias("near_id"), left("over").alias("far_id"), F.max("m_n").alias("most_n"))
    lists = lists.withColumn("part", F.pmod(F.xxhash64("kind", "m_at"), F.lit(DEALS)).cast("int"))
    beside = F.abs(F.col("at") - F.col("m_at")) <= 1
    gap = F.greatest(F.lit(0), F.col("m_at") * STEP - F.col("n"), F.col("n") - F.col("m_at") * STEP - (STEP - 1))

    def most(apart: Column, words: str) -> Column:
        return fixed + F.least(F.lit(20), 3 * F.least("n", words)) + _length_match(apart, F.lit(0), 10)

    asked = bound.drop("words").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)))).join(lists, ["project_id", "part"]).withColumn("least_id", F.when(beside, F.col("near_id")).otherwise(F.col("far_id")))
    asked = asked.where(F.col("least_id").isNotNull() & reaches(most(gap, "most_n"), "least_id"))
    needed = F.coalesce(F.ceil((F.col("kth.score") - fixed - _length_match(gap, F.lit(0), 10)) / 3), F.lit(0)).cast("int")
    asked = staged(asked.select("node_id", "project_id", "kind", "m_at", needed.alias("needed")).distinct(), "style-asked")

    # a row that shares `needed` words of n has one of any n - needed + 1 of them: of those that are rare among the nodes
    rarity = n.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("held"))
    of = n.join(asked.where(F.col("needed") > 0).groupBy("node_id", "project_id").agg(F.min("needed").alias("needed")), ["node_id", "project_id"])
    of = of.select("node_id", "project_id", "n", "needed", F.explode("words").alias("word")).join(rarity, "word").groupBy("node_id", "project_id", "n", "needed").agg(F.array_sort(F.collect_set(F.struct("held", "word"))).alias("by"))
    of = of.select("node_id", "project_id", "n", F.posexplode(F.slice("by", F.lit(1), F.greatest(F.lit(0), F.col("n") - F.col("needed") + 1))["word"]).alias("before", "word"))
    listed = m.select("project_id", "kind", "m_at", "memory_id", F.explode("m_words").alias("word")).join(of, ["project_id", "word"])
    listed = listed.join(asked.where(F.col("needed") > 0), ["node_id", "project_id", "kind", "m_at"]).where(F.col("before") <= F.col("n") - F.col("needed")).select("node_id", "project_id", "kind", "m_at", "memory_id").distinct()
    plain = asked.where(F.col("needed") <= 0).drop("needed")
    unmet = dealt.drop("project_id").where(F.col("memory_id") > F.least("cut", "over"))
    pairs = bound.join(plain, ["node_id", "project_id"]).join(unmet, ["kind", "m_at"]).unionByName(bound.join(listed, ["node_id", "project_id"]).join(unmet, ["kind", "m_at", "memory_id"]))
    more = pairs.where((F.col("memory_id") > F.when(beside, F.col("cut")).otherwise(F.col("over"))) & reaches(most(F.col("n") - F.col("m_n"), "m_n"), "memory_id"))
    more = more.select("node_id", "memory_id", score.cast("long").alias("score"))
    return _best(some.unionByName(more), ["node_id"], k, "memory_id")


def library_counts(library: DataFrame) -> DataFrame:
    return library.groupBy("domain").agg(F.count("*").alias("examples"))
