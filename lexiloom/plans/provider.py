"""The provider boundary: model calls behind a protocol, batched in mapInPandas, with a deterministic offline default."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import scores
from lexiloom.operators import gate


class Provider(Protocol):
    def translate(self, texts: list[str]) -> list[str]: ...

    def review(self, sources: list[str], targets: list[str]) -> list[str]: ...


class MarkingProvider:
    """Renders a text by marking it; texts that start with a digit come back empty, as a failing model's would. No network."""

    def translate(self, texts: list[str]) -> list[str]:
        return ["" if t[:1].isdigit() else f"«{t}»" for t in texts]

    def review(self, sources: list[str], targets: list[str]) -> list[str]:
        return ["PASS" if s in t else "FAIL" for s, t in zip(sources, targets, strict=True)]


def translated(nodes: DataFrame, make: Callable[[], Provider] = MarkingProvider, batch: int = 64) -> DataFrame:
    """Adds target_text: one provider per partition, `batch` texts a call. A call that fails leaves its nodes without a rendering."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = make()
        for b in batches:
            out: list[str | None] = []
            for i in range(0, len(b), batch):
                texts = b["source_text"].iloc[i : i + batch].tolist()
                try:
                    got = p.translate(texts)
                except ConnectionError:
                    got = [None] * len(texts)
                out += got if len(got) == len(texts) else [None] * len(texts)
            yield b.assign(target_text=pd.Series(out, index=b.index, dtype=object))

    schema = ", ".join(f"`{c}` {t}" for c, t in nodes.dtypes) + ", target_text string"
    return nodes.mapInPandas(run, schema)


def translate_and_gate(nodes: DataFrame, make: Callable[[], Provider] = MarkingProvider, language: str = "en") -> DataFrame:
    """Adds target_text, issues, risk and decision: COMMIT without errors at low risk, REVIEW at higher risk, REPAIR with errors, EMPTY without a rendering."""
    t = translated(nodes, make).withColumn("issues", gate.gate_issues(F.col("source_text"), F.col("target_text"), language))
    codes = F.transform("issues", lambda i: i["code"])
    risk = scores.risk_score(F.col("source_text"), F.col("target_text"), F.lit("paragraph"), F.lit(0), codes, F.lit(0))
    errors = F.exists("issues", lambda i: i["severity"] == gate.ERROR)
    decision = F.when(F.coalesce("target_text", F.lit("")) == "", "EMPTY").when(errors, "REPAIR").when(scores.risk_level(F.col("risk")) == "LOW", "COMMIT").otherwise("REVIEW")
    return t.withColumn("risk", risk).withColumn("decision", decision)
