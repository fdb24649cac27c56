"""Assurance and publication of renderings: a bounded iteration of review and repair over staged tables.

A row is a candidate with its state. A pass asks the models once for every row that is still open, settles those that reach an
end and hands on only the others, so a pass costs what is left of the work, and an answer, once staged, is never asked for
again. Models are functions from DataFrame to DataFrame (calls in mapInPandas, or column expressions); an answer that is
missing counts as an error and never as a pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import scores
from lexiloom.operators import gate, reviews, terms
from lexiloom.stages import GOING, delete, parted, parts, spent, staged

ERRORS = "array<struct<type:string,severity:string,message:string>>"
STYLE_ISSUES = "array<struct<type:string,severity:string>>"
Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Models:
    """What is asked of models, each a function that keeps its input's columns and adds one.

    critic: (source_text, candidate) adds review, a struct (status, score, errors); status is PASS, FAIL or ERROR.
    repair: (source_text, candidate, diagnostics) adds repaired. style: (source_text, candidate, kind) adds style, a struct
    (status, score, issues, failed_checks). rewrite: (source_text, candidate, style) adds rewritten.
    compare: (source_text, candidate, rewritten) adds first and second, the answers A, B or TIE with the original as A, then as B.
    """

    critic: Step
    repair: Step
    style: Step
    rewrite: Step
    compare: Step


@dataclass(frozen=True)
class Policy:
    """Bounds of the process: repairs of meaning, rewrites of style (1 at most), thresholds of risk and style."""

    repairs: int = 2
    rewrites: int = 1
    medium: float = 0.35
    high: float = 0.65
    passing: float = 0.80
    rewriting: float = 0.55
    style: bool = True
    veto: bool = True
    mode: str = "NATURAL"
    domain: str = "GENERAL"
    language: str = "vi"
    codes: tuple[str, ...] = gate.CODES


def _gated(df: DataFrame, p: Policy, text: str = "candidate", name: str = "found", goes: Column | None = None) -> DataFrame:
    """Adds the gate's issues as errors (type, severity, message); none where not `goes`."""
    found = gate.gate_issues(F.col("source_text"), F.col(text), p.language, p.codes)
    found = found if goes is None else F.when(goes, found).otherwise(F.array().cast(gate.ISSUES))
    return df.withColumn(name, F.transform(found, lambda i: F.struct(i["code"].alias("type"), i["severity"].alias("severity"), F.concat_ws(": ", i["code"], F.nullif(i["detail"], F.lit(""))).alias("message"))).cast(ERRORS))


def _clean(found: str) -> Column:
    return ~F.exists(found, lambda i: i["severity"] == gate.ERROR)


def _none() -> Column:
    return F.array().cast(ERRORS)


def signature(found: Column, p: Policy) -> Column:
    """What a review of a candidate was made under: texts, entities' number, warnings and the policy. Never null, and Spark is told so: else a join on it asks for it again in a filter."""
    warned = F.transform(F.filter(found, lambda i: i["severity"] == gate.WARNING), lambda i: i["type"])
    policy = reviews.policy_signature(F.lit(p.medium), F.lit(p.high), F.lit(p.repairs), warned)
    told = F.to_json(F.struct(F.col("candidate").alias("a_candidate"), F.lit(p.domain).alias("b_domain"), F.coalesce("entities", F.lit(0)).alias("c_entities"), policy.alias("d_policy"), F.col("source_text").alias("e_source")))
    return F.coalesce(F.sha2(told, 256), F.lit(""))


def signed(rows: DataFrame, p: Policy = Policy(), keep: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """(node_id, signature) of rows (node_id, source_text, candidate, entities), as evaluate() looks them up in its cache, and their columns of `keep`."""
    return _gated(rows.withColumn("candidate", F.coalesce("candidate", F.lit(""))), p).select("node_id", signature(F.col("found"), p).alias("signature"), *keep)


#: The columns of a settled row.
RESULT = ("node_id", "candidate", "approved", "status", "risk", "level", "errors", "signature", "score", "repairs", "calls", "from_cache")


def evaluate(rows: DataFrame, models: Models, p: Policy = Policy(), cache: DataFrame | None = None, force: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """RESULT of every row (node_id, source_text, candidate, kind, previous_repairs, entities), and its columns of `keep`; node_id is unique.

    Gate and risk decide who is reviewed. Errors of the gate at low risk are a FAIL; a clean candidate whose signature the cache
    (node_id, signature, status, score, risk, level, errors, stale) holds takes that review; a clean one at low risk is
    NOT_REQUIRED. All others go through passes: a PASS of the critic on a clean candidate settles; an ERROR, or a FAIL after
    the last repair, settles as not approved; else the candidate is repaired, and a repair that does not pass the gate settles
    as FAIL. `force` reviews every row and looks at no cache. Nulls: a null candidate is an empty one; a review that is null is
    an ERROR. A settled row's score is the last review's.

    A row goes through one shuffle at most, to meet the cache. Sources go on and are staged only for rows that models may
    still be asked about, or where `keep` has them; a repaired candidate takes the place of the one before.
    """
    return _evaluated(rows, models, p, cache, force, keep)[0]


def _evaluated(rows: DataFrame, models: Models, p: Policy, cache: DataFrame | None, force: bool, keep: tuple[str, ...], ended: str | None = None, once: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """evaluate(), and the staged tables that its result reads. Rows whose column `ended` is not null are handed on as they are: nothing is asked of them. `once`: rows that go on are deleted when the next pass has them."""
    goes = F.lit(True) if ended is None else F.col(ended).isNull()
    seen = _gated(rows.withColumn("candidate", F.coalesce("candidate", F.lit(""))), p, goes=None if ended is None else goes)
    codes = F.transform(F.filter("found", lambda i: i["severity"] == gate.WARNING), lambda i: i["type"])
    risk = scores.risk_score(F.col("source_text"), F.col("candidate"), F.when(F.lower(F.lit(p.domain)).isin(*scores.HIGH_RISK), F.lit(p.domain)).otherwise(F.col("kind")), F.col("previous_repairs"), codes, F.col("entities"))
    seen = seen.withColumn("risk", F.when(goes, risk)).withColumn("level", scores.risk_level(F.col("risk"), p.medium, p.high)).withColumn("signature", F.when(goes, signature(F.col("found"), p)).otherwise(""))
    asked = F.lit(force) | (F.col("level") != "LOW")

    def sourced(df: DataFrame, open_: Column) -> DataFrame:
        return df if "source_text" in keep else df.withColumn("source_text", F.when(open_, F.col("source_text")))

    carried = tuple(dict.fromkeys(("node_id", "source_text", "kind", "entities", "risk", "level", *keep)))
    seen = sourced(seen.select(*carried, "candidate", "found", "signature"), asked)
    if cache is None:
        seen = seen.withColumn("held", F.lit(None).cast(f"struct<status string, score double, risk double, level string, errors {ERRORS}>"))
    else:
        live = cache.where(~F.coalesce("stale", F.lit(False))).groupBy("node_id", "signature").agg(F.min(F.struct("status", "score", "risk", "level", F.col("errors").cast(ERRORS).alias("errors"))).alias("held"))
        seen = seen.join(live, ["node_id", "signature"], "left")
    usable = F.col("held").isNotNull() & _clean("found") & ~F.lit(force)
    route = F.when(~goes, "ENDED").when(~_clean("found") & ~asked, "GATE").when(usable, "CACHE").when(~asked, "LOW_RISK").otherwise("CRITIC")
    state = seen.withColumn("route", route).withColumn(GOING, F.col("route") == "CRITIC")
    tables = []
    if not once or not force:  # else every row goes on, and the critic takes it as it comes
        tables.append(state := staged(state, "assurance"))

    def settled(df: DataFrame, **cols: Column) -> DataFrame:
        known = {"candidate": F.col("candidate"), "risk": F.col("risk"), "level": F.col("level"), "signature": F.col("signature"), "score": F.lit(None), "repairs": F.lit(0), "calls": F.lit(0), "from_cache": F.lit(False), "errors": _none()} | cols
        kinds = {"score": "double", "repairs": "int", "calls": "int", "errors": ERRORS, "approved": "boolean"}
        return df.select("node_id", *(known[c].cast(kinds[c]).alias(c) if c in kinds else known[c].alias(c) for c in RESULT[1:]), *keep)

    held = F.col("held")
    gate_, cached = F.col("route") == "GATE", F.col("route") == "CACHE"
    of_cache = {c: F.when(cached, held[c]).otherwise(F.col(c)) for c in ("risk", "level")}
    out = []
    if tables:
        ended_here = settled(
            state.where(f"not {GOING}"), approved=F.when(cached, held["status"].isin("PASS", "NOT_REQUIRED")).otherwise(~gate_), status=F.when(cached, held["status"]).when(gate_, "FAIL").otherwise("NOT_REQUIRED"),
            score=F.when(cached, held["score"]), errors=F.when(cached, held["errors"]).when(gate_, F.col("found")).otherwise(_none()), from_cache=cached, **of_cache,
        )
        out.append(ended_here)
    live = (state.where(GOING) if tables else state).select(*carried, "candidate", "found", "signature")
    for i in range(p.repairs + 1):
        review = F.col("review")
        status = F.coalesce(review["status"], F.lit("ERROR"))
        clean = _clean("found")
        problems = F.concat(F.when(clean, _none()).otherwise(F.col("found")), F.when(status != "PASS", F.coalesce(review["errors"].cast(ERRORS), _none())).otherwise(_none()))
        end = F.when((status == "PASS") & clean, "PASS").when((status == "ERROR") | F.lit(i >= p.repairs), F.when(~clean, "FAIL").otherwise(status))
        done = models.critic(live).withColumn("end", end).withColumn("diagnostics", problems).drop("found")
        done = staged(sourced(done, F.col("end").isNull()).withColumn(GOING, F.col("end").isNull()), "reviewed")
        if once and tables:
            spent(tables[-1])
        tables.append(done)
        out.append(settled(done.where(f"not {GOING}"), approved=F.col("end") == "PASS", status=F.col("end"), errors=F.when(F.col("end") == "PASS", _none()).otherwise(F.col("diagnostics")), score=review["score"], repairs=F.lit(i), calls=F.lit(i + 1)))
        going = done.where(GOING).drop(GOING)
        if i == p.repairs or not going.head(1):
            break
        mended = _gated(models.repair(going).withColumn("repaired", F.coalesce("repaired", F.lit(""))), p, "repaired")
        mended = staged(sourced(mended.drop("candidate").withColumn("ok", _clean("found")), F.col("ok")).withColumn(GOING, F.col("ok")), "repaired")
        if once:
            spent(tables[-1])
        tables.append(mended)
        failed = F.concat("diagnostics", F.col("found"))
        out.append(settled(mended.where(f"not {GOING}"), candidate=F.col("repaired"), approved=F.lit(False), status=F.lit("FAIL"), errors=failed, score=review["score"], repairs=F.lit(i + 1), calls=F.lit(i + 1)))
        live = mended.where(GOING).select(*carried, F.col("repaired").alias("candidate"), "found")
        live = live.withColumn("signature", signature(F.col("found"), p))
    return reduce(DataFrame.unionByName, out), tables


def names_lost(rows: DataFrame, locked: DataFrame, text: str = "candidate") -> DataFrame:
    """Adds broken: whether the row's source names a locked entity (source_key, target) that `text` does not render as its target."""
    return terms.lost_terms(rows, locked, "source_text", "source_key", text, "target", "broken")


def reviewed_style(rows: DataFrame, models: Models, p: Policy) -> DataFrame:
    """Adds style: what the model says, or an ERROR with its issue where it says nothing (its context could not be built, its answer not be read)."""
    closed = F.struct(F.lit("ERROR").alias("status"), F.lit(None).cast("double").alias("score"), F.array(F.struct(F.lit("VIETNAMESE_NATURALNESS_ERROR").alias("type"), F.lit("ERROR").alias("severity"))).cast(STYLE_ISSUES).alias("issues"), F.array().cast("array<string>").alias("failed_checks"))
    told = F.col("style")
    shaped = F.struct(told["status"].alias("status"), told["score"].cast("double").alias("score"), F.transform(F.coalesce(told["issues"], F.array()), lambda i: F.struct(i["type"].alias("type"), i["severity"].alias("severity"))).cast(STYLE_ISSUES).alias("issues"), F.coalesce(told["failed_checks"].cast("array<string>"), F.array().cast("array<string>")).alias("failed_checks"))
    return models.style(rows).withColumn("style", F.when(told["status"].isNull(), closed).otherwise(shaped))


#: The columns of a publication.
PUBLISHED = ("node_id", "text", "publication", "approved", "status", "errors", "style_status", "style_score", "rewrites", "rewrite_success", "repairs", "calls", "style_calls", "from_cache")


def publish(rows: DataFrame, models: Models, locked: DataFrame, p: Policy = Policy(), cache: DataFrame | None = None, shown: Callable[[Column], Column] = lambda c: c) -> DataFrame:  # noqa: B008
    """PUBLISHED of every row (node_id, source_text, candidate, kind, previous_repairs, entities, trusted): one row each.

    In this order: a locked entity that is not kept ends as NEEDS_REVIEW; a trusted rendering (from memory) is APPROVED without
    a model; evaluate() has to approve the meaning; the style has to pass. A style in the range of rewriting is rewritten once
    where that may be tried, and the rewrite is checked three times (gate and locked entities, meaning without repairs, style);
    if it passes all, the original may still veto it by winning in both orders.

    Rows that go on are staged and deleted when the next step has them; of a row that ends only its result stays, with
    `shown` of its text (a digest, say, where the text itself is not asked for).
    """
    base = ("node_id", "source_text", "kind", "previous_repairs", "entities")
    blank = {"errors": _none(), "style_status": F.lit("NOT_RUN"), "style_score": F.lit(None), "rewrites": F.lit(0), "rewrite_success": F.lit(False), "repairs": F.lit(0), "calls": F.lit(0), "style_calls": F.lit(0), "from_cache": F.lit(False)}
    kinds = {"errors": ERRORS, "style_score": "double", "rewrites": "int", "repairs": "int", "calls": "int", "style_calls": "int", "approved": "boolean"}

    def ended(publication: Column, **cols: Column) -> list[Column]:
        known = blank | {"node_id": F.col("node_id"), "text": shown(F.col("candidate")), "publication": publication, "approved": publication == "APPROVED"} | cols
        return [(known[c].cast(kinds[c]) if c in kinds else known[c]).alias(c) for c in PUBLISHED]

    def gone(tables: list[DataFrame]) -> None:
        for t in tables:
            delete(t.sparkSession, t.staged_path)

    review, approved = F.lit("NEEDS_REVIEW"), F.lit("APPROVED")
    name_lost = F.array(F.struct(F.lit("ENTITY_MISMATCH").alias("type"), F.lit("ERROR").alias("severity"), F.lit("a locked entity is not kept").alias("message")))
    state = names_lost(rows.withColumn("candidate", F.coalesce("candidate", F.lit(""))), locked)
    state = state.withColumn("ended", F.when(F.col("broken"), "NAME").when(F.coalesce("trusted", F.lit(False)), "MEMORY"))
    goes = F.col("ended").isNull()
    state = state.select("node_id", F.when(goes, F.col("source_text")).alias("source_text"), *base[2:], F.when(goes, F.col("candidate")).otherwise(shown(F.col("candidate"))).alias("candidate"), "ended")
    told, tables = _evaluated(state, models, p, cache, False, (*base[1:], "ended"), "ended", once=True)
    of_meaning = {c: F.col(c) for c in ("status", "errors", "repairs", "calls", "from_cache")}
    lost, memory = F.col("ended").eqNullSafe("NAME"), F.col("ended").eqNullSafe("MEMORY")
    of_end = {"text": F.when(goes, shown(F.col("candidate"))).otherwise(F.col("candidate")), "status": F.when(lost, "FAIL").when(memory, "NOT_REQUIRED").otherwise(F.col("status")), "errors": F.when(lost, name_lost.cast(ERRORS)).otherwise(F.col("errors")), "from_cache": memory | (goes & F.col("from_cache"))}
    meant = goes & F.coalesce("approved", F.lit(False))
    out = [staged(told.where(~meant).select(*ended(F.when(memory, approved).otherwise(review), **(of_meaning | of_end))), "published")]
    good = told.where(meant).select(*base, "candidate", *of_meaning)
    if not p.style:
        out.append(staged(good.select(*ended(approved, **of_meaning)), "published"))
        gone(tables)
        return reduce(DataFrame.unionByName, out)

    style = F.col("style")
    passes, types = reviews.style_passes(style, p.passing), F.transform(style["issues"], lambda i: i["type"])
    tried = reviews.in_rewrite_range(style["status"], style["score"], p.rewriting, p.passing) & reviews.may_rewrite(F.col("kind"), F.lit(p.mode), F.lit(p.domain), types) & F.lit(min(p.rewrites, 1) > 0)
    of_style = of_meaning | {"style_status": style["status"], "style_score": style["score"], "style_calls": F.lit(1)}
    styled = staged(parted(reviewed_style(good, models, p), ~passes & tried, (*base, "candidate", "style", *of_meaning), ended(F.when(passes, approved).otherwise(review), **of_style)), "style")
    gone(tables)
    going, over = parts(styled)
    out.append(over)

    again = models.rewrite(going).withColumn("rewritten", F.trim(F.coalesce("rewritten", F.lit(""))))
    unwritten = ended(review, text=shown(F.col("original")), style_status=F.lit("ERROR"), rewrites=F.lit(1), style_calls=F.lit(1), **of_meaning)
    written = staged(parted(again.withColumnRenamed("candidate", "original"), F.col("rewritten") != "", (*base, "original", F.col("rewritten").alias("candidate")), unwritten), "rewritten")
    spent(styled)
    going, over = parts(written)
    out.append(over)

    told, tables = _evaluated(going, models, Policy(**{**p.__dict__, "repairs": 0}), None, True, (*base[1:], "original"), once=True)
    spent(written)
    told = told.select(*base, "original", "candidate", F.col("candidate").alias("rewritten"), F.col("approved").alias("meant"), "status", F.col("errors").alias("found"), "calls")
    checked = names_lost(reviewed_style(told, models, p), locked)
    good = ~F.col("broken") & F.col("meant") & passes  # what is meant has passed the gate
    of_rewrite = {"status": F.when(F.col("broken"), "FAIL").otherwise(F.col("status")), "errors": F.when(F.col("broken"), F.concat("found", name_lost.cast(ERRORS))).otherwise(F.col("found")), "calls": F.col("calls"), "style_status": style["status"], "style_score": style["score"], "rewrites": F.lit(1), "style_calls": F.lit(2)}
    rechecked = staged(parted(checked, good, (*base, "original", "rewritten", "candidate", "style", "broken", "found", "status", "calls"), ended(review, **of_rewrite)), "rechecked")
    gone(tables)
    fine, over = parts(rechecked)
    out.append(over)

    if p.veto:
        pair = models.compare(fine.withColumn("candidate", F.col("original"))).withColumn("candidate", F.col("rewritten"))
        pair = pair.withColumn("vetoed", F.coalesce(reviews.original_wins(F.col("first"), F.col("second")), F.lit(False)))
        vetoed = F.col("vetoed")
        with_veto = of_rewrite | {"style_calls": F.lit(4), "style_status": F.when(vetoed, "FAIL").otherwise(style["status"]), "rewrite_success": ~vetoed}
        out.append(staged(pair.select(*ended(F.when(vetoed, review).otherwise(approved), **with_veto)), "published"))
    else:
        out.append(staged(fine.select(*ended(approved, rewrite_success=F.lit(True), **of_rewrite)), "published"))
    spent(rechecked)
    return reduce(DataFrame.unionByName, out)


def as_step(name: str, answer: Callable[[], Column]) -> Step:
    """A model that is a column expression of its input's columns."""
    return partial(_added, name=name, answer=answer)


def _added(df: DataFrame, name: str, answer: Callable[[], Column]) -> DataFrame:
    return df.withColumn(name, answer())
