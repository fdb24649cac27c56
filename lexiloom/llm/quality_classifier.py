"""Quality classifier with hierarchical empirical Bayes.

A document's own evidence comes from two logistic models (low quality, toxic) fitted on a bounded sample of labelled
documents. Its odds of being bad are then moved by where it stands: the rate of its path (a section of a host) shrunk
towards its host's rate, itself shrunk towards the rate of all documents, against that global rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import hot_join, slices, stage

HEADS = ("low", "toxic")
#: Bounds of the fit: labelled documents sampled by a hash of their id, and vocabulary entries.
SAMPLE_DOCS, VOCABULARY = 20_000, 20_000
#: A token enters the vocabulary if so many sampled documents hold it and its z-score against a label reaches this.
MIN_DOCS, MIN_Z = 5, 4.0
DENSE = 9
MAX_WEIGHT = 4.0


class Model(NamedTuple):
    """index: token to row; words: weights by row and head; dense: weights of the DENSE features (bias last); scale: mean and deviation of each."""

    index: dict[str, int]
    words: np.ndarray
    dense: np.ndarray
    scale: np.ndarray


def tokens_of(text: str) -> set[str]:
    """Distinct lower-cased words without punctuation at their ends, and their first four characters marked ^."""
    words = {w.strip(".,;:!?\"'()[]*#$%&|") for w in text.lower().split()}
    words.discard("")
    return words | {"^" + w[:4] for w in words if len(w) > 4}


def dense_of(text: str) -> list[float]:
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    return [
        min(1.0, 10 * sum(map(text.count, "#*$%&<>")) / size),
        words.count("|") / n,
        sum(w.isupper() and len(w) > 1 for w in words) / n,
        min(1.0, text.count("!!") / n),
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n,
        np.log1p(len(words)) / 10,
        sum(map(text.count, "0123456789")) / size,
        1.0,
    ]


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(text, low, toxic): at most about `sample` labelled texts, each text once. Broadcasts the sampled labels, whose number is bounded."""
    y = labels.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_id"), (1 - F.coalesce("quality", F.lit(1))).cast("int").alias("low"), F.coalesce("toxic", F.lit(0)).cast("int").alias("toxic")
    )
    share = min(1.0, sample / max(1, y.count()))
    y = y.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20))).dropDuplicates(["_id"])
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    return d.join(F.broadcast(y), "_id").select("_text", "low", "toxic").dropDuplicates(["_text"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS, vocabulary: int = VOCABULARY) -> Model | None:
    """The two models; None without labelled documents (then nothing is rejected).

    sample bounds the labelled documents of the fit, vocabulary the tokens that have a weight (the strongest by z-score): both
    bound what comes to the driver and what travels with the tasks; every document is scored. Token counts are aggregated
    by Spark.
    """
    data = stage(_sampled(docs, labels, id_col, text_col, sample), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            found = [(t, low, tox) for text, low, tox in zip(*(c.to_pylist() for c in b.columns), strict=True) for t in tokens_of(text)]
            yield pa.record_batch([pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int32()))], ["token", "low", "toxic"])

    totals = data.agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")).first()
    if not totals["n"]:
        return None
    tokens = data.mapInArrow(count, "token string, low int, toxic int").groupBy("token").agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic"))

    def z(head: str) -> Column:
        rate = (totals[head] or 0) / totals["n"]
        return F.abs(F.col(head) - F.col("n") * rate) / F.sqrt(F.col("n") * max(rate * (1 - rate), 1e-6))

    strong = tokens.where(F.col("n") >= MIN_DOCS).select("token", F.greatest(z("low"), z("toxic")).alias("z")).where(F.col("z") >= MIN_Z)
    index = {r["token"]: i for i, r in enumerate(strong.orderBy(F.desc("z"), "token").limit(vocabulary).select("token").collect())}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            texts = b.column(0).to_pylist()
            rows = pa.array([sorted(index[t] for t in tokens_of(x) if t in index) for x in texts], pa.list_(pa.int32()))
            yield pa.record_batch([pa.array([dense_of(x) for x in texts], pa.list_(pa.float64())), rows, b.column(1), b.column(2)], ["dense", "rows", "low", "toxic"])

    got = data.mapInArrow(look, "dense array<double>, rows array<int>, low int, toxic int").toArrow()
    order = np.lexsort([np.array(got.column(i).to_pylist()) for i in (2, 3)] + [np.array(got.column(0).to_pylist())[:, i] for i in range(DENSE)])  # whatever the order of rows, the same fit
    got = got.take(pa.array(order))
    dense, y = np.array(got["dense"].to_pylist()), np.stack([got[h].to_numpy() for h in HEADS], 1).astype(float)
    lists = got["rows"].to_pylist()
    scale = np.stack([dense.mean(0), dense.std(0) + 1e-6])
    scale[:, -1] = 0, 1
    return Model(index, *_descend((dense - scale[0]) / scale[1], lists, y, len(index)), scale)


def _descend(dense: np.ndarray, lists: list[list[int]], y: np.ndarray, rows: int, epochs: int = 30, rate: float = 0.2, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression of every head by AdaGrad over batches, in a fixed order.

    A head's rare rows weigh more, by the square root of how much rarer they are (up to MAX_WEIGHT): one word in a long
    document has to outweigh the many that say nothing.
    """
    weight = np.clip(np.sqrt((1 - y.mean(0)) / np.maximum(y.mean(0), 1e-6)), 1, MAX_WEIGHT)
    words, body = np.zeros((rows, y.shape[1])), np.zeros((dense.shape[1], y.shape[1]))
    sq_w, sq_b = np.full_like(words, 1e-3), np.full_like(body, 1e-3)
    order = np.random.default_rng(0).permutation(len(y))
    batches = []
    for i in range(0, len(y), 512):
        take = order[i : i + 512]
        n = [len(lists[j]) for j in take]
        batches.append((take, np.repeat(np.arange(len(take)), n), np.array([r for j in take for r in lists[j]], np.int64)))
    for _ in range(epochs):
        for take, doc, row in batches:
            z = dense[take] @ body
            for h in range(y.shape[1]):
                z[:, h] += np.bincount(doc, words[row, h], len(take)) if len(row) else 0
            wrong = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]) * np.where(y[take] > 0, weight, 1) / len(take)
            g = dense[take].T @ wrong + decay * body
            sq_b += g * g
            body -= rate * g / np.sqrt(sq_b)
            for h in range(y.shape[1]):
                if len(row):
                    g = np.bincount(row, wrong[doc, h], rows) + decay * words[:, h] / 10
                    sq_w[:, h] += g * g
                    words[:, h] -= rate * g / np.sqrt(sq_w[:, h])
    return words, body


def evidence(text: str, m: Model) -> np.ndarray:
    """Log-odds of every head for one text."""
    rows = [m.index[t] for t in tokens_of(text) if t in m.index]
    return ((np.array(dense_of(text)) - m.scale[0]) / m.scale[1]) @ m.dense + m.words[rows].sum(0)


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, n: str, s: str, mean: Column) -> float:
    """Prior weight in documents by the method of moments: how far group rates (s / n) vary about their own mean beyond sampling. Within 1 to 1000; one row of sums comes to the driver."""
    w = F.col(n)
    r = groups.agg(
        F.sum(w).alias("n"), F.count("*").alias("groups"), F.sum(w * F.pow(F.col(s) / w - mean, 2)).alias("between"), F.sum(w * mean * (1 - mean)).alias("within"), F.sum(mean * (1 - mean)).alias("sampling")
    ).first()
    if not r["n"]:
        return 1000.0
    excess = (r["between"] - r["sampling"]) / r["n"]
    return min(1000.0, max(1.0, r["within"] / r["n"] / excess - 1)) if excess > 0 else 1000.0


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """(id, host, path, doc_score, path_rate, score, kept): one row per input row.

    doc_score: the document's own probability of being low or toxic. path_rate: its path's shrunk rate. score: both
    combined; kept where it is at most 0.5. Null or empty texts have the evidence of an empty text; null hosts and paths
    count as ''; ids may be null or repeated. Without a model every score is 0 and all is kept. Other columns are left
    out. An empty table gives an empty result.

    Texts are read once, in a narrow pass; scores are staged without text and summed by (host, path) and host with
    map-side sums; rates come back broadcast for paths of many documents (a bounded number) and by a shuffle for all others.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            z = np.array([evidence(x or "", model) if model else (-50.0, -50.0) for x in b.column(3).to_pylist()])
            good = 1 / (1 + np.exp(np.clip(z, -50, 50)))
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(1 - good.prod(1))], ["_id", "_host", "_path", "_p"])

    d = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("_path"), F.col(text_col).alias("_text")
    )
    found = stage(d.mapInArrow(judge, f"_id {dict(d.dtypes)['_id']}, _host string, _path string, _p double"), "scores")
    paths = found.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("_p").alias("s"))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    totals = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    overall = totals["s"] / totals["n"] if totals["n"] else 0.0
    over_hosts = _strength(hosts, "hn", "hs", F.lit(overall))
    hosts = hosts.select("_host", ((F.col("hs") + over_hosts * overall) / (F.col("hn") + over_hosts)).alias("host_rate"))
    paths = paths.join(hosts, "_host")
    over_paths = _strength(paths, "n", "s", F.col("host_rate"))
    rates = stage(paths.select("_host", "_path", "n", ((F.col("s") + over_paths * F.col("host_rate")) / (F.col("n") + over_paths)).alias("path_rate")), "rates")
    out = hot_join(found, rates, ["_host", "_path"], "n", totals["n"] or 0)
    odds = _logit(F.col("_p")) + _logit(F.col("path_rate")) - _logit(F.lit(overall))
    combined = F.lit(0.0) if model is None else 1 / (1 + F.exp(-odds))
    return out.select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_p").alias("doc_score"), "path_rate", combined.alias("score"), (combined <= 0.5).alias("kept")
    )
