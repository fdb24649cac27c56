"""The queries opN_<name> over the driver's tables with production parameters, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import chat_format, decontaminate, fill_in_middle, filter_audit, line_dedup, near_dedup, ngram_join, piece_codec, quality_classifier, quality_rules, substring_dedup, token_store, url_filter
from lexiloom.session import table

#: The contract's site rules, in its order.
SITE_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = token_store.new_path(spark)
    token_store.write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)
    return token_store.index_shards(spark, path)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    return chat_format.digest_chats(chat_format.format_chats(turns.unionByName(own)))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("text", 256)).drop("text")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.site_rule(v, x, i) for i, (v, x) in enumerate(SITE_RULES)]
    out = url_filter.filter_urls(table(spark, sf_dir, "pages"), [*rules, *url_filter.PATTERNS])
    return out.select("page_id", "host", "path", "rule", "verdict")


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded, decoded again and compared."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = piece_codec.encode_pieces(table(spark, sf_dir, "documents"), model, decoded_col="decoded")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(piece_codec.SPACE), F.lit(" "))
    digest = F.sha2("decoded", 256)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), digest.alias("decoded_sha256"), (digest == F.sha2(text, 256)).alias("round_trip"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), words=3, percent=90).drop("kept")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_near_dedup": op2_near_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_store": op4_token_store,
    "op5_chat_format": op5_chat_format,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_url_filter": op8_url_filter,
    "op9_piece_codec": op9_piece_codec,
    "op10_quality_rules": op10_quality_rules,
    "op11_filter_audit": op11_filter_audit,
    "op12_ngram_join": op12_ngram_join,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_KEY = r"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op3_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT doc_id, pos, line, {_KEY} AS k FROM lines),
hot AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE h.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE h.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot h ON keyed.k = h.k GROUP BY doc_id""",
    "op5_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marks(m) AS (VALUES ('<<SYS>>'), ('<</SYS>>'), ('[INST]'), ('[/INST]'), ('<s>'), ('</s>'), ('[ROLE]'), ('[/ROLE]'), ('[TEXT]')),
ms AS (SELECT list(m) AS ms FROM marks),
e AS (
  SELECT t.*, length(text) + length(text) - length(replace(text, chr(92), ''))
    + 2 * list_sum(list_transform(ms, lambda m: (length(text) - length(replace(text, m, ''))) // length(m))) AS body,
    length(role) + length(role) - length(replace(role, chr(92), ''))
    + 2 * list_sum(list_transform(ms, lambda m: (length(role) - length(replace(role, m, ''))) // length(m))) AS name,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS after
  FROM t, ms),
f AS (
  SELECT *, body + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + name END AS chars,
    concat(coalesce(before, '^'), '>', role) IN ('^>system', '^>user', 'system>user', 'user>assistant', 'assistant>user') AND (after IS NOT NULL OR role = 'assistant') AS ok
  FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(ok) AS valid
FROM f GROUP BY conv_id""",
    "op8_url_filter": r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(v, h, s, i) AS (VALUES ('allow', 'org', '/', 0), ('block', 'example.org', '/es/', 1), ('block', 'example.org', '/en/1', 2), ('allow', 'com', '/fr/', 3), ('block', 'com', '/de/', 4)),
fits AS (
  SELECT page_id, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS v
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
SELECT p.page_id, host, path, rule,
  coalesce(v, CASE WHEN regexp_matches(split_part(host || path, '/', 1), '(^|[^a-z0-9])(casino|poker|gambling|slots|porn|xxx|escort|viagra|pills|payday[-.]loan|free[-.]ringtones|spam[-.]farm|link[-.]farm|warez)([^a-z0-9]|$)')
    OR regexp_matches(host || path, '/wp-login\.php$') OR regexp_matches(host || path, '/doorway/[0-9]+(?:\.html)?$') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits ON p.page_id = fits.page_id""",
    "op10_quality_rules": r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS g
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 7, 0))) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS j FROM rep WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (
  SELECT w.doc_id, coalesce(source, '') AS host, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN covered ON covered.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed) AS k FROM b GROUP BY host),
s AS (SELECT sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) AS kk, count(*) / sum(n) AS per FROM hosts),
prior AS (
  SELECT mean, CASE WHEN kk - mean * mean - mean * (1 - mean) * per > 0
    THEN least(1000, greatest(1, mean * (1 - mean) / (kk - mean * mean - mean * (1 - mean) * per) - 1)) ELSE 1000 END AS strength FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (k + mean * strength) / (n + strength) <= 0.5 AS kept
FROM b JOIN hosts USING (host), prior""",
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
judged AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map(['A', 'B', 'C', 'D', 'E'], [
    len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * length(d.text),
    regexp_matches(d.text, '[#$%&*|]'), coalesce(d.doc_id > least, false)]) AS fails
  FROM d JOIN firsts ON d.text = firsts.text LEFT JOIN judged ON d.doc_id = judged.doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic, len(list_filter(map_values(fails), lambda x: x)) AS bits FROM f GROUP BY part, fails),
letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, list_filter(string_split(filter_order, ''), lambda x, i: i < step) AS before FROM orders, (SELECT unnest(generate_series(1, 5)) AS step)),
parts AS (SELECT DISTINCT part FROM cells),
seen AS (
  SELECT c.*, s.*, c.fails[s.own] AS fail, list_bool_or(list_transform(s.before, lambda x: c.fails[x])) IS TRUE AS gone FROM cells c, steps s),
per AS (
  SELECT part, filter_order, step, own,
    sum(n) FILTER (WHERE NOT fail AND NOT gone) AS kept, sum(n) FILTER (WHERE fail AND NOT gone) AS removed, sum(n) FILTER (WHERE fail AND gone) AS redundant,
    sum(n) FILTER (WHERE fail AND bits = 1) AS unique_fails, sum(good) FILTER (WHERE fail AND NOT gone) AS good_lost, sum(toxic) FILTER (WHERE fail AND NOT gone) AS toxic_lost
  FROM seen GROUP BY part, filter_order, step, own),
shares AS (SELECT part, own, sum(removed) AS shapley FROM per GROUP BY part, own)
SELECT per.part, per.filter_order, CAST(per.step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(shapley, 0) AS BIGINT) AS shapley
FROM per JOIN shares ON per.part = shares.part AND per.own = shares.own""",
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, len(units) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) for i in range(4)] AS r FROM d),
c AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p""",
}
