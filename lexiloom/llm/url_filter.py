"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over host + path. Its literal tokens (runs of a-z0-9 that must stand in any
matching URL as whole tokens) are counted over all URLs; the rule is filed under the rarest one. A URL fetches the rules
filed under its own tokens, and only those run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import LOWER, UPPER, ascii_lower, stage

#: Rules that travel with the tasks at once; a longer list takes several passes, each of which keeps the best so far.
RULES_AT_ONCE = 100_000


@dataclass(frozen=True)
class Rule:
    """name: shown in results. pattern: searched in host + path. tokens: literals every match holds. A larger rank wins."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: tuple[int, ...] = (0,)


def site_rule(verdict: str, text: str, order: int = 0) -> Rule:
    """`host/path`: fits the host and its subdomains where the path starts with the rule's; the longest text wins, then the longest host, then the first."""
    host, slash, rest = text.partition("/")
    path = slash + rest
    whole = re.findall(r"[a-z0-9]+", host) + [t.lower() for t in re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)]
    return Rule(text, r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(path), tuple(whole), verdict, (1, len(text), len(host), -order))


def word_rule(verdict: str, *words: str) -> Rule:
    """Hosts that hold the words next to each other as whole tokens, parted by - or a dot. It gives way to any site rule."""
    name = "-".join(words)
    return Rule(name, r"^(?:[^/]*[^a-z0-9/])?" + "[-.]".join(map(re.escape, words)) + r"(?![a-z0-9])[^/]*(?:/|$)", words, verdict, (0, len(name)))


def path_rule(verdict: str, name: str, pattern: str, *tokens: str) -> Rule:
    """A pattern over host + path with the tokens it cannot match without. It gives way to any site rule."""
    return Rule(name, pattern, tokens, verdict, (0, len(name)))


#: The method's own block list: words of hosts whose pages are sold links, gambling, sexual content, drugs or loans, and
#: paths of log-in forms and doorway pages. A parameter of filter_urls like any other rules.
JUNK_WORDS = (
    ("casino",), ("poker",), ("gambling",), ("slots",), ("porn",), ("xxx",), ("escort",), ("viagra",), ("pills",),
    ("payday", "loan"), ("free", "ringtones"), ("spam", "farm"), ("link", "farm"), ("warez",),
)
PATTERNS = (
    *(word_rule("block", *w) for w in JUNK_WORDS),
    path_rule("block", "login page", r"/wp-login\.php$", "wp", "login", "php"),
    path_rule("block", "doorway", r"/doorway/[0-9]+(?:\.html)?$", "doorway"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or end, A-Z lower-cased; empty where url is null or has no ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or end; empty where url is null or has no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(F.concat(host, path)), "[^a-z0-9]+"))


def rarest_tokens(urls: DataFrame, rules: list[Rule]) -> dict[str, list[int]]:
    """Rules (by number) under their token that the fewest URLs hold; rules without a token under ''.

    The rules' tokens are broadcast, a few for each of RULES_AT_ONCE rules at most; as many counts come to the driver.
    """
    literals = sorted({t for r in rules for t in r.tokens})
    counts = dict.fromkeys(literals, 0)
    if literals:
        known = urls.sparkSession.createDataFrame([(t,) for t in literals], "token string")
        found = urls.select(F.explode(tokens_of(F.col("host"), F.col("path"))).alias("token")).join(F.broadcast(known), "token", "left_semi")
        counts |= {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (counts[t], t)) if r.tokens else "", []).append(i)
    return index


class _Compiled(dict):
    """Patterns of rules, compiled when a URL first fetches them."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules

    def __missing__(self, i: int) -> re.Pattern:
        out = self[i] = re.compile(self.rules[i].pattern, re.DOTALL)
        return out


def _judge(rules: list[Rule], index: dict[str, list[int]], first: int):  # noqa: ANN202
    """Betters (rank, no, rule, verdict) of each URL by the rules, numbered from `first`; adds up n_candidates."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, every = _Compiled(rules), index.get("", [])
        cut, lower = re.compile("[^a-z0-9]+"), str.maketrans(UPPER, LOWER)
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            best = list(zip(b.column(at["rank"]).to_pylist(), b.column(at["no"]).to_pylist(), b.column(at["rule"]).to_pylist(), b.column(at["verdict"]).to_pylist(), strict=True))
            tried = b.column(at["n_candidates"]).to_pylist()
            for k, (host, path) in enumerate(zip(b.column(at["host"]).to_pylist(), b.column(at["path"]).to_pylist(), strict=True)):
                text = host + path
                fetched = [*every, *(i for t in set(cut.split(text.translate(lower))) if t for i in index.get(t, ()))]
                tried[k] += len(fetched)
                for i in fetched:
                    r = rules[i]
                    if ((tuple(r.rank), -(first + i)) > (tuple(best[k][0] or ()), -(best[k][1] or 0))) and compiled[i].search(text):
                        best[k] = list(r.rank), first + i, r.name if r.rank[0] else None, r.verdict
            made = {"rank": pa.array([x[0] for x in best], pa.list_(pa.int64())), "no": pa.array([x[1] for x in best], pa.int64()), "rule": pa.array([x[2] for x in best], pa.string()), "verdict": pa.array([x[3] for x in best], pa.string()), "n_candidates": pa.array(tried, pa.int64())}
            yield pa.record_batch([made.get(n, b.column(i)) for n, i in at.items()], list(at))

    return judge


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", at_once: int = RULES_AT_ONCE) -> DataFrame:
    """Judge every URL: (id, host, path, rule, verdict, n_candidates), one row per input row.

    rule names the site rule that won, null if none fits; verdict is that rule's, else that of the method's strongest
    matching pattern, else `default`. Null or odd URLs have empty host and path and get the default. Ties between rules
    go by rank and then by the order given. Ids may be null or repeated; other columns are left out. Very long URLs are
    judged whole. An empty table or an empty list of rules is no error.

    One column-pruned pass counts the rules' literal tokens over all URLs (partial sums), one narrow pass judges; no shuffle of
    URLs, no join on their side, so hot hosts cannot pile up. More than `at_once` rules take a pass each, staged in between;
    every pass keeps what is best so far, so the longest rule wins over all.
    """
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    found = urls.select("*", F.lit(None).cast("array<bigint>").alias("rank"), F.lit(None).cast("bigint").alias("no"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(0).cast("bigint").alias("n_candidates"))
    kind = ", ".join(f"{c} {t}" for c, t in found.dtypes)
    for first in range(0, len(rules), at_once):
        some = rules[first : first + at_once]
        found = (stage(found, "urls") if first else found).mapInArrow(_judge(some, rarest_tokens(urls, some), first), kind)
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"), "n_candidates")
