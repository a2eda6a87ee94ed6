"""The corpus operators applied to whole tables: one query per operator, and their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, ctw, decontaminate, flatfiles, knn, negatives, order, pii, quality, simhash, substrings
from .common import stored, work_dir

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE, END_ID = "byte_bpe_50k.tiktoken", 50256
ORDER_KEY = "training order, epoch 0"
#: The key of pseudonyms is this setting of the session; the default is for test tables only.
PSEUDONYM_SETTING, PSEUDONYM_KEY = "spark.wanderframe.pseudonymKey", "documents"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pseudonym_key(spark: SparkSession) -> str:
    return spark.conf.get(PSEUDONYM_SETTING, PSEUDONYM_KEY)


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all sequences of ``documents`` in training order; shards go to the shared folder."""
    seqs = order.packed_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, END_ID)
    return order.materialise(seqs, work_dir(spark, "shards"), ORDER_KEY, END_ID, order.PACKED)


def op2_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of conversations that share their first turn, and each conversation against
    itself led on from one of its answers as the next conversation goes on there."""
    convs = stored(chat.conversations(table(spark, sf_dir, "conversations")), "conversations")
    shared = chat.paired(convs, chat.neighbours(convs)).withColumn("kind", F.lit("shared"))
    branched = chat.branched(convs).withColumn("kind", F.lit("branched"))
    keep = chat.preferences(shared.unionByName(branched).select("chosen_id", "rejected_id", "c", "r", "kind"), ("kind",))
    return keep.select("kind", "chosen_id", "rejected_id", "n_prompt_turns", "prompt", "chosen", "rejected", F.to_json("chosen_spans").alias("chosen_spans"), F.to_json("rejected_spans").alias("rejected_spans"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.pseudonymize_documents(table(spark, sf_dir, "documents"), pseudonym_key(spark))
    return docs.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_replaced"), F.to_json("pii_spans").alias("spans"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, found again in flat files that hold only ids."""
    folder = work_dir(spark, "flat")
    written = stored(flatfiles.write_flat(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, END_ID))
    counted = flatfiles.scan_flat(spark, folder, END_ID)
    return counted.join(written, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {f.__name__: f for f in (op1_training_order, op2_repeated_substrings, op3_quality, op4_bpe, op5_simhash, op6_preferences, op7_pseudonyms, op8_token_counts, op9_decontamination, op10_ctw, op11_negatives, op12_filter_audit, op13_top_k)}

#: One rendered turn, and the spans of the trained turns of a list of turns, in SQL.
RENDERED = "'<|im_start|>' || {t}.role || chr(10) || {t}.text || '<|im_end|>' || chr(10)"
SPANS = """CAST(to_json(list_transform(list_filter(range(1, len({p}) + 1), lambda i: {p}[i].role = 'assistant'), lambda i: {{
  'start': CAST(coalesce(list_sum(list_transform({p}[1:i - 1], lambda t: length(t.role) + length(t.text) + 24)), 0) + length({p}[i].role) + 13 AS BIGINT),
  'end': CAST(coalesce(list_sum(list_transform({p}[1:i - 1], lambda t: length(t.role) + length(t.text) + 24)), 0) + length({p}[i].role) + length({p}[i].text) + 23 AS BIGINT)}})) AS VARCHAR)"""
PREFERENCES = f"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
ranked AS (SELECT conv_id, turns, row_number() OVER (PARTITION BY turns[1] ORDER BY conv_id) - 1 AS k, turns[1] AS first FROM c),
shared AS (
  SELECT 'shared' AS kind, a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.turns AS c, b.turns AS r
  FROM ranked a JOIN ranked b ON a.first = b.first AND a.k % 2 = 0 AND b.k = a.k + 1),
n AS (
  SELECT conv_id, turns, coalesce(lead(conv_id) OVER w, first_value(conv_id) OVER w) AS other_id, coalesce(lead(turns) OVER w, first_value(turns) OVER w) AS other,
    list_filter(range(0, len(turns)), lambda i: turns[i + 1].role = 'assistant') AS trained
  FROM c WINDOW w AS (ORDER BY conv_id)),
b AS (SELECT *, trained[((conv_id % len(trained)) + len(trained)) % len(trained) + 1] AS cut_at FROM n WHERE other_id <> conv_id AND len(trained) > 0),
pairs AS (
  SELECT * FROM shared
  UNION ALL SELECT 'branched', conv_id, other_id, turns, turns[1:cut_at] || list_slice(other, cut_at + 1, len(other)) FROM b),
cut AS (
  SELECT *, coalesce(list_position(list_transform(range(1, least(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i]), true) - 1, least(len(c), len(r))) AS p FROM pairs),
parts AS (SELECT kind, chosen_id, rejected_id, CAST(p AS BIGINT) AS n_prompt_turns, c[1:p] AS p, list_slice(c, p + 1, len(c)) AS c, list_slice(r, p + 1, len(r)) AS r FROM cut)
SELECT kind, chosen_id, rejected_id, n_prompt_turns,
  {", ".join(f"coalesce(array_to_string(list_transform({x}, lambda t: {RENDERED.format(t='t')}), ''), '') AS {name}" for x, name in (("p", "prompt"), ("c", "chosen"), ("r", "rejected")))},
  {SPANS.format(p="c")} AS chosen_spans, {SPANS.format(p="r")} AS rejected_spans
FROM parts"""

#: Vectors of whole numbers, a number for each row; those with unknown components left out.
VECTORS = """v AS (
  SELECT row_number() OVER () AS r, vec_id, {label} AS label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
NEGATIVES = f"""
WITH {VECTORS.format(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END", scale=256)},
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id, br) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.id, s.br) AS INTEGER) AS rank
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM n WHERE rank <= 10"""
TOP_K = f"""
WITH {VECTORS.format(label="0", scale=64).replace("AND label IS NOT NULL ", "")},
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score,
    CAST(row_number() OVER (PARTITION BY a.r ORDER BY list_dot_product(a.x, b.x) DESC, b.vec_id, b.r) AS INTEGER) AS rank
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.r <> b.r)
SELECT * FROM s WHERE rank <= 20"""
AUDIT = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
    'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(first < w.doc_id, false)} AS f
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
d AS (
  SELECT part, good, toxic, map(['A', 'B', 'C', 'D', 'E'], [f.A, f.B, f.C, f.D, f.E]) AS f, CAST(f.A AS INT) + CAST(f.B AS INT) + CAST(f.C AS INT) + CAST(f.D AS INT) + CAST(f.E AS INT) AS fails, count(*) AS n
  FROM m GROUP BY ALL),
o AS (SELECT '' AS o UNION ALL SELECT o || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) u(x) WHERE NOT contains(o, x)),
s AS (SELECT o AS filter_order, CAST(step AS INTEGER) AS step, o[step] AS x, o[1:step - 1] AS before FROM o, range(1, 6) r(step) WHERE length(o) = 5),
e AS (SELECT d.*, s.*, f[x] AS failed, len(list_filter(string_split(before, ''), lambda b: coalesce(f[b], false))) > 0 AS gone FROM d, s),
g AS (
  SELECT part, filter_order, step, x, sum(n) FILTER (NOT failed AND NOT gone) AS kept, sum(n) FILTER (failed AND NOT gone) AS removed, sum(n) FILTER (failed AND gone) AS redundant,
    sum(n) FILTER (failed AND fails = 1) AS unique_fails, sum(n) FILTER (failed AND NOT gone AND good) AS good_lost, sum(n) FILTER (failed AND NOT gone AND toxic) AS toxic_lost
  FROM e GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, x), 0) AS BIGINT) AS shapley
FROM g"""

#: SQL cannot state the others in a time that whole tables allow; tests hold them against brute force.
ORACLE: dict[str, str] = {"op6_preferences": PREFERENCES, "op11_negatives": NEGATIVES, "op12_filter_audit": AUDIT, "op13_top_k": TOP_K}
