"""Forms of address: who speaks to whom, whether a rendering keeps the agreed pronouns, and repairs by position.

pairs: (project_id, speaker, listener, self_term, other_term): how a speaker says I and you to a listener. A project has few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as tx
from lexiloom.operators.terms import term_hits

#: Quoted speech, lines of speech, verbs of saying, English persons, neutral pronouns, ways to call the reader.
QUOTED = r"“[^”]*”|\"[^\"]*\"|«[^»]*»"
DASHED = r"(?m)^\s*[–—-]\s.*$"
SAYING = "said|says|told|tells|asked|asks|replied|whispered|shouted|answered|smiled|looked|called"
PERSONS = r"(?i)\b(?:I|me|my|mine|myself|you|your|yours|yourself)\b"
FIRST = ("i", "me", "my", "mine", "myself")
YOU = r"(?i)\byou(?:r|rs|rself|rselves)?\b"
NEUTRAL = ("tôi", "bạn", "tao", "mày")
THIRD = rf"(?iu)\s+(?:ấy|ta|kia)(?!{tx.WORD})"
READER_TERMS = ("bạn", "các bạn", "quý vị", "quý khách", "anh chị", "cậu", "mày")


def speech(c: Column) -> Column:
    """Quoted passages of a text, quotes included."""
    return tx.matches(c, QUOTED)


def narration(c: Column) -> Column:
    """The text without speech, quoted or by dashes."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), QUOTED, " "), DASHED, " ")


def _words(c: Column) -> Column:
    return tx.matches(F.lower(c), tx.WORD + "+")


def attributed(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """nodes (node_id, project_id, source_text, target_text) with the one pair whose speaker says something to the listener in the narration; nodes with none or several are left out.

    Nodes and pairs meet where the speaker stands in the narration as a whole word, or words (term_hits), so pairs that are
    not named cost nothing; the pattern is verified, then pairs are counted for each node.
    """
    told = F.regexp_replace(F.coalesce("source_text", F.lit("")), QUOTED, " | ")
    name = lambda c: F.concat(F.lit(r"\b\Q"), F.col(c), F.lit(r"\E\b"))
    says = F.lit(rf"\b(?:{SAYING})\b")
    pattern = F.concat(F.lit("(?iU)"), name("speaker"), F.lit("[^|.]*?(?:"), says, F.lit("[^|.]*?"), name("listener"), F.lit("|"), name("listener"), F.lit("[^|.]*?"), says, F.lit(")"))
    met = term_hits(nodes.select("node_id", "project_id", told.alias("_told")), pairs.withColumnRenamed("project_id", "_of"), "_told", "speaker")
    hit = met.where((F.col("project_id") == F.col("_of")) & F.regexp_like("_told", pattern))
    one = hit.groupBy("node_id").agg(F.count("*").alias("_pairs"), F.first(F.struct("speaker", "listener", "self_term", "other_term")).alias("pair")).where(F.col("_pairs") == 1)
    return nodes.join(one.drop("_pairs"), "node_id")


def _expected(source: Column, pair: Column) -> Column:
    persons = tx.matches(F.array_join(speech(source), " "), PERSONS)
    return F.transform(persons, lambda w: F.lower(F.when(F.lower(w).isin(*FIRST), pair["self_term"]).otherwise(pair["other_term"])))


def mismatches(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node_id, reason): speech whose pronouns are not the agreed ones: NEUTRAL (a neutral pronoun), SWAPPED (as many as in the source, in another order), OPENING (the first word is the wrong one)."""
    n = attributed(nodes, pairs)
    pair = F.col("pair")
    terms = F.array(F.lower(pair["self_term"]), F.lower(pair["other_term"]))
    said = _words(F.array_join(speech(F.col("target_text")), " "))
    facts = n.select(
        "node_id", pair.alias("pair"), terms.alias("terms"), said.alias("said"), _expected(F.col("source_text"), pair).alias("expected"),
        F.get(tx.matches(F.get(speech(F.col("source_text")), F.lit(0)), tx.WORD + "+"), F.lit(0)).alias("opens"), F.get(_words(F.get(speech(F.col("target_text")), F.lit(0))), F.lit(0)).alias("opened"),
    ).where((F.size("said") > 0) & F.col("opens").isNotNull())
    actual = F.filter("said", lambda w: F.array_contains(F.col("terms"), w))
    neutral = F.exists("said", lambda w: w.isin(*NEUTRAL) & ~F.array_contains(F.col("terms"), w))
    swapped = (F.size("expected") > 0) & (F.size(actual) == F.size("expected")) & (actual != F.col("expected"))
    wanted = F.lower(F.when(F.lower("opens").isin(*FIRST), F.col("pair.self_term")).otherwise(F.col("pair.other_term")))
    opening = F.col("opens").rlike(rf"^(?:{PERSONS})$") & F.array_contains("terms", F.col("opened")) & (F.col("opened") != wanted)
    reason = F.when(neutral, "NEUTRAL").when(swapped, "SWAPPED").when(opening, "OPENING")
    return facts.select("node_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def reader_mismatches(nodes: DataFrame, readers: DataFrame) -> DataFrame:
    """(node_id, found): renderings whose narration calls the reader something else than readers (project_id, reader) says, where the source's narration has a you. Terms that hold each other are the same."""
    n = nodes.join(readers.where(F.trim(F.coalesce("reader", F.lit(""))) != ""), "project_id").where(narration(F.col("source_text")).rlike(YOU))
    told, agreed = narration(F.col("target_text")), F.lower("reader")
    found = F.array_compact(F.array(*[F.when(~agreed.contains(t) & ~F.contains(F.lit(t), agreed) & told.rlike(rf"(?iu)(?<!{tx.WORD}){t}(?!{tx.WORD})"), F.lit(t)) for t in READER_TERMS]))
    return n.select("node_id", F.explode(found).alias("found"))


def repaired(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node_id, fixed): renderings whose speech gets the agreed pronouns by position, where it has as many of them (neutral ones too) as the source's speech has persons; a third person (anh ấy) is none.

    The text is cut at its pronouns; the n-th within quotes takes the n-th agreed term, with its capital.
    """
    n = attributed(nodes, pairs)
    pair = F.col("pair")
    own = F.array_distinct(F.concat(F.array(F.lower(pair["self_term"]), F.lower(pair["other_term"])), F.array(*map(F.lit, NEUTRAL))))
    mark = "\u0001"
    # quoted passages with every word of theirs set apart; other text stays whole
    parts = tx.matches(F.col("target_text"), rf"(?s){QUOTED}|[^“\"«]+|.")
    cut = F.flatten(F.transform(parts, lambda p: F.when(p.rlike(rf"^(?:{QUOTED})$"), tx.matches(p, rf"(?s){tx.WORD}+(?:{THIRD})?|[^\p{{L}}\p{{N}}_]+")).otherwise(F.array(F.concat(F.lit(mark), p)))))
    f = n.select("node_id", "target_text", own.alias("own"), _expected(F.col("source_text"), pair).alias("expected"), F.array(pair["self_term"], pair["other_term"]).alias("terms"), cut.alias("cut"))
    hit = F.transform("cut", lambda w: F.array_contains(F.col("own"), F.lower(w)).cast("int"))
    f = f.withColumn("hit", hit).where((F.size("expected") > 0) & (F.aggregate("hit", F.lit(0), lambda a, h: a + h) == F.size("expected")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(acc: Column, z: Column) -> Column:
        word = F.get(F.col("expected"), acc["at"])
        term = F.coalesce(F.get(F.filter("terms", lambda t: F.lower(t) == word), F.lit(0)), word)
        capital = F.when(z["w"].rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(term, 1, 1)), F.substring(term, 2, 1000))).otherwise(term)
        return F.struct((acc["at"] + z["h"]).alias("at"), F.concat(acc["text"], F.when(z["h"] == 1, capital).otherwise(F.replace(z["w"], F.lit(mark), F.lit("")))).alias("text"))

    zipped = F.arrays_zip(F.col("cut").alias("w"), F.col("hit").alias("h"))
    fixed = F.aggregate(zipped, start, step)["text"]
    return f.select("node_id", "target_text", fixed.alias("fixed")).where(F.col("fixed") != F.col("target_text")).select("node_id", "fixed")
