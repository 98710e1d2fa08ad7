"""Queries of the text operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rategrid.llm import chat, codes, decontam, divergence, fingerprints, langid, lm, mixing, neardup, pages, passages, quality, toxicity
from rategrid.llm.common import table


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(marked).alias("text"),
    )
    return chat.digests(chat.windows(own.unionByName(more)))


OP9_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + {chat.OVERHEAD} AS size,
    12 + 1 + 11 + length(role) + length(text)
      + length(role) - length(replace(role, chr(92), '')) + length(text) - length(replace(text, chr(92), ''))
      + length(role) - length(replace(role, chr(10), ''))
      + len(regexp_extract_all(role, '<\\||</?s>|<</?SYS>>|\\[/?INST\\]'))
      + len(regexp_extract_all(text, '<\\||</?s>|<</?SYS>>|\\[/?INST\\]')) AS chars
  FROM c
), p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM t
), o AS (
  SELECT *, before // {chat.BUDGET - chat.HISTORY} AS owner FROM p
), w AS (
  SELECT conv_id, owner, min(i) AS first_i, max(i) AS last_i, min(before) AS first_before FROM o GROUP BY conv_id, owner
), f AS (
  SELECT w.conv_id, sum(o.chars)::BIGINT AS formatted_chars
  FROM w JOIN o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.i <= w.last_i
    AND (o.before >= w.first_before - {chat.HISTORY} OR (o.i = 0 AND o.role = 'system'))
  GROUP BY w.conv_id
), d AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss_text
  FROM o GROUP BY conv_id
)
SELECT d.conv_id, n_turns, turns_sha256, length(loss_text)::BIGINT AS loss_chars, sha256(loss_text) AS loss_sha256, formatted_chars
FROM d JOIN f ON d.conv_id IS NOT DISTINCT FROM f.conv_id
"""

def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("row_id", "host", "text_hash", "removed_lines")


A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = "'[^\\x20\\x09-\\x0D]+'"

BASE_SQL = f"""d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM d
), w3 AS (
  SELECT doc_id, pos, w, lead(w, 1) OVER p AS x, lead(w, 2) OVER p AS y FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY pos)
), g AS (
  SELECT doc_id, pos, y IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, x, y) > 1 AS twice FROM w3
), r AS (
  SELECT doc_id, twice OR coalesce(lag(twice, 1) OVER p, false) OR coalesce(lag(twice, 2) OVER p, false) AS covered
  FROM g WINDOW p AS (PARTITION BY doc_id ORDER BY pos)
), reps AS (
  SELECT doc_id, count(*) FILTER (WHERE covered)::BIGINT AS n_repeat_words FROM r GROUP BY doc_id
), rawlines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d
), lines AS (
  SELECT doc_id, line, regexp_extract_all(translate(line, {A_TO_Z}), {WORDS}) AS lw FROM rawlines
), dups AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM lines WHERE len(lw) > 0 GROUP BY doc_id
)"""

OP1_SQL = f"""
WITH {BASE_SQL}, normal AS (
  SELECT l.doc_id, d.source, d.text, array_to_string(lw, ' ') AS line, sum(len(lw)) AS n
  FROM lines l JOIN d USING (doc_id) WHERE len(lw) > 0 GROUP BY ALL
), frequent AS (
  SELECT source, line, min(doc_id) AS first_doc FROM normal GROUP BY source, line HAVING count(DISTINCT text) > {quality.LIMIT_DOCS}
), removed AS (
  SELECT n.doc_id, sum(n.n)::BIGINT AS removed_words FROM normal n
  JOIN frequent f ON n.line = f.line AND n.source IS NOT DISTINCT FROM f.source AND n.doc_id <> f.first_doc
  GROUP BY n.doc_id
), s AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN reps USING (doc_id) LEFT JOIN removed USING (doc_id)
), b AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s
)
SELECT *, NOT base_failed AND n_words - removed_words >= {quality.MIN_LEFT}::DOUBLE * n_words AS kept FROM b
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH {BASE_SQL}, q AS (
  SELECT doc_id, source, len(ws)::BIGINT AS size,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) + coalesce(n_repeat_words, 0) + 10 * coalesce(n_dup_lines, 0) AS bad,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, text)), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / {2**52}::DOUBLE AS u
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN reps USING (doc_id)
), k AS (
  SELECT *, -ln(u) / (greatest(1, {mixing.LEVELS} - {mixing.LEVELS} * bad // greatest(size, 1))::DOUBLE / {mixing.LEVELS}::DOUBLE) AS key FROM q
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM q GROUP BY source
), sw AS (
  SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT] AS w FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - {mixing.CAP} * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM sw WINDOW o AS (ORDER BY source_size::DOUBLE / w, place)
), t AS (
  SELECT source, source_size, least(({mixing.CAP} * source_size)::DOUBLE, w * max(level) OVER ()) AS target FROM l
), p AS (
  SELECT k.doc_id, k.source, k.size, t.source_size, t.target,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
  (size * (epochs + CASE WHEN (2 * before + size)::DOUBLE <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""



def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.judge(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.evaluate(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(table(spark, sf_dir, "documents")).drop("text_key", "group")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


TERM = "'[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'"

OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {A_TO_Z}) AS text
  FROM documents
), o AS (
  SELECT row_id, lang, source, unnest(regexp_extract_all(text, {TERM})) AS term FROM d
), t AS (
  SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT row_id) >= {divergence.MIN_DOCS}
), c AS (
  SELECT lang, source, term, count(*) AS n FROM o JOIN t USING (lang, term) GROUP BY ALL
), g AS (
  SELECT DISTINCT lang, source FROM d
), s AS (
  SELECT lang, source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), l AS (
  SELECT lang, sum(total) AS lang_total, any_value(v) AS v FROM s JOIN (
    SELECT g.lang, count(DISTINCT t.term) AS v FROM g LEFT JOIN t USING (lang) GROUP BY g.lang
  ) USING (lang) GROUP BY lang
), p AS (
  SELECT s.lang, s.source, t.term, coalesce(c.n, 0) AS n, 1 + ({divergence.UNIT}::HUGEINT * (coalesce(c.n, 0) + 1)) // (total + v) AS p
  FROM s JOIN l USING (lang) JOIN t USING (lang) LEFT JOIN c USING (lang, source, term)
), q AS (
  SELECT lang, term, 1 + ({divergence.UNIT}::HUGEINT * (sum(n) + 1)) // (any_value(lang_total) + any_value(v)) AS q FROM c JOIN l USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM terms)
)
FROM r WHERE part = 'pair' OR rank <= {divergence.TOP}
"""

def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    steps = []
    for i in range(codes.ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT id, part, arg_min(entry, d * {codes.ENTRIES} + entry) AS entry, min(d) AS d FROM (
    SELECT id, part, entry, x.xx + list_inner_product(c.p, c.p) - 2 * list_inner_product(x.p, c.p) AS d FROM x JOIN c{i} c USING (part)
  ) GROUP BY id, part
)""")
        if i < codes.ROUNDS:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.p, c.p) AS p FROM c{i} c LEFT JOIN (
    SELECT part, entry, list(floor(s / n) ORDER BY pos) AS p FROM (
      SELECT part, entry, pos, sum(y) AS s, count(*) AS n FROM (
        SELECT a.part, a.entry, unnest(x.p) AS y, generate_subscripts(x.p, 1) AS pos FROM a{i} a JOIN x USING (id, part)
      ) GROUP BY ALL
    ) GROUP BY part, entry
  ) m USING (part, entry)
)""")
    last = codes.ROUNDS
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda y: floor(y::DOUBLE * {codes.SCALE})) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0
), x AS MATERIALIZED (
  SELECT id, part, p, list_inner_product(p, p) AS xx FROM (
    SELECT id, part, e[part * len(e) // {codes.PARTS} + 1 : (part + 1) * len(e) // {codes.PARTS}] AS p FROM v, (SELECT unnest(range({codes.PARTS})) AS part)
  )
), c0 AS MATERIALIZED (
  SELECT part, id - 1 AS entry, p FROM x WHERE id <= {codes.ENTRIES}
), {", ".join(steps)}, r AS (
  SELECT id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY id
), l AS (
  SELECT label, sum(error)::BIGINT AS label_error FROM r JOIN v USING (id) GROUP BY label
), h AS (
  SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(p) AS y, generate_subscripts(p, 1) AS pos FROM c{last})
)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM r JOIN v USING (id) JOIN l ON v.label IS NOT DISTINCT FROM l.label, h
"""


OP12_SQL = _op12_sql()

def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_html_extraction": op2_html_extraction,
    "op3_mixing": op3_mixing,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_language_id": op5_language_id,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_decontamination": op7_decontamination,
    "op8_minhash_neardup": op8_minhash_neardup,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_vector_codes": op12_vector_codes,
    "op13_document_fingerprints": op13_document_fingerprints,
}

ORACLES = {
    "op1_quality_rules": OP1_SQL,
    "op3_mixing": OP3_SQL,
    "op9_chat_formatting": OP9_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
}
