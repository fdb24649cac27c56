"""The corpus pipeline: quality classifier, line dedup, near-dedup, benchmark decontamination, piece encoding.

Each stage works on all that its predecessor kept and returns the columns of documents; the last returns
(doc_id, n_tokens, ids, round_trip). Rows that share a doc_id stay or go together in near-dedup, which decides by id; rows
without one stay there. Null texts and empty tables pass through every stage; without labels nothing is rejected, without a
benchmark nothing is contaminated; further columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate, line_dedup, near_dedup, piece_codec, quality_classifier
from lexiloom.llm.common import stage
from lexiloom.session import table

#: The stages' rows cannot be had in SQL; tests compare them with brute-force versions.
ORACLE_SQL = None


def _own(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, whatever further columns it brings."""
    have = {c.lower() for c in docs.columns}
    while name in have:
        name += "_"
    return name


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs but for the rejected ids; rows without an id stay, past the join. Text moves once and is not sorted."""
    gone = _own(docs, "_gone")
    ids = rejected.select(F.col("doc_id").alias(gone)).distinct()
    known = F.col("doc_id").isNotNull()
    return docs.where(known).join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col(gone), "left_anti").unionByName(docs.where(~known))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, row by row: rows that share an id, or have none, are judged each by its own text, source and language."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    row = _own(docs, "_row")
    keyed = docs.withColumn(row, F.sha2(F.to_json(F.struct("doc_id", "text", "source", "lang")), 256))
    gone = quality_classifier.score(keyed, model, id_col=row).where(~F.col("kept")).select(row).distinct()
    return keyed.join(gone.hint("shuffle_hash"), row, "left_anti").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them have; n_chars follows the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = line_dedup.dedup_lines(docs, min_docs=10, carry=tuple(others))
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates: five words, 0.8, as the job sets for this stage.

    Every pair at that similarity is found. A copy with an edit in every fifteenth word or so lies below it and stays.
    """
    return _without(docs, near_dedup.near_dedup(docs, words=5, percent=80).where(~F.col("kept")))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    whole = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("_row"), "text")
    out = decontaminate.decontaminate(whole, table(spark, sf_dir, "benchmark"), id_col="_row")
    return out.where(~F.col("contaminated")).select("_row.*", "text").select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every document left; round_trip: the decoded ids are the text (SPACE as a space)."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    out = piece_codec.encode_pieces(docs, model, decoded_col="decoded")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(piece_codec.SPACE), F.lit(" "))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == text).alias("round_trip"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near dedup", near_duplicates),
    ("decontamination", benchmark_free),
    ("piece encoding", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, "pipeline")
    return docs
