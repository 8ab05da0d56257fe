"""The registered queries of the training-data operators and the SQL some are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import (
    bit_whitening,
    fill_middle,
    host_paths,
    host_rules,
    kdtree_topk,
    language_kernel,
    line_dedup,
    mix_flow,
    perspectives,
    quality_crf,
    secret_net,
    simhash_dedup,
    unigram_pieces,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.classify(_table(spark, sf_dir, "documents"),
                                _table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.perspectives(_table(spark, sf_dir, "conversations"))


def op5_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_paths.extract(_table(spark, sf_dir, "pages"))


def op6_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree_topk.top_k(_table(spark, sf_dir, "embeddings"))


def op7_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_pieces.encode_documents(_table(spark, sf_dir, "documents"))


def op8_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_kernel.identify(_table(spark, sf_dir, "documents"))


def op9_mix_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_flow.mix_report(_table(spark, sf_dir, "documents"))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(_table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(_table(spark, sf_dir, "documents"))


def op12_bit_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_secret_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_net.secret_report(_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn,
         CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END AS role,
         replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'),
                 '<|im_end|>', '<im_end>') AS text,
         coalesce(floor(turn / 256.0)::BIGINT, -1) AS part
  FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
r AS (
  SELECT t.*, speaker, role = speaker AS own, '<|im_start|>' || CASE WHEN role = speaker
           THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END
           || chr(10) AS head,
         row_number() OVER (PARTITION BY t.conv_id, speaker, part
                            ORDER BY turn NULLS FIRST, role, text) AS n
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(text) + 11) OVER (
           PARTITION BY conv_id, speaker, part ORDER BY n
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS place
  FROM r)
SELECT conv_id, speaker, part, count(*)::INT AS n_turns, (count(*) FILTER (own))::INT AS n_own,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY n) AS text,
       coalesce(string_agg(place::BIGINT || '-' || (place + length(text) + 10)::BIGINT, ' ' ORDER BY n)
         FILTER (own), '') AS spans
FROM o GROUP BY conv_id, speaker, part
"""

OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.row <> c.row AND len(q.v) = len(c.v)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

# Every document has one source, so the flow gives each source its quota from its own pattern.
OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         coalesce('42:' || doc_id::VARCHAR, '42:row ' || ('0x' || substr(md5(
           md5(coalesce(text, '')) || ':' || row_number() OVER (
             PARTITION BY doc_id IS NULL, source, md5(coalesce(text, '')))), 1, 15))::BIGINT) AS unit
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source),
t AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / w, source
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY 3.0 * source_size / w, source
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM s),
unit AS (
  SELECT total - before AS words, weights FROM t
  WHERE (total - before) * w <= 3 * source_size * weights
  ORDER BY 3.0 * source_size / w, source LIMIT 1),
q AS (
  SELECT s.source, source_size, w,
         w * words > 3 * source_size * weights AS full_,
         CASE WHEN w * words > 3 * source_size * weights THEN 3.0 * source_size
              ELSE round((w * words)::DOUBLE / weights::DOUBLE, 6) END AS target,
         CASE WHEN w * words > 3 * source_size * weights THEN 3 * source_size
              ELSE (w * words) // weights END AS quota
  FROM s, unit),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS rounds,
         CASE WHEN source_size > 0 THEN quota % source_size ELSE 0 END AS remainder
  FROM q),
u AS (
  SELECT d.source, d.unit, sum(size) AS size,
         ('0x' || substr(md5(d.unit), 1, 15))::BIGINT AS h
  FROM d GROUP BY d.source, d.unit),
o AS (
  SELECT u.*, p.remainder, sum(u.size) OVER (PARTITION BY u.source ORDER BY h, u.unit) AS upto
  FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source WHERE p.remainder > 0),
gaps AS (
  SELECT source, min(remainder) - coalesce(max(upto) FILTER (upto <= remainder), 0) AS gap
  FROM o GROUP BY source),
rest AS (
  SELECT o.source, o.unit, o.size, row_number() OVER (
           PARTITION BY o.source ORDER BY o.size DESC, h, o.unit) AS place
  FROM o JOIN gaps g ON o.source IS NOT DISTINCT FROM g.source
  WHERE upto > remainder AND size > 0 AND size <= gap),
fill AS (
  SELECT source, gap, 0::BIGINT AS place, NULL::VARCHAR AS unit FROM gaps
  UNION ALL
  SELECT f.source, f.gap - r.size, r.place, r.unit
  FROM fill f JOIN rest r ON r.source IS NOT DISTINCT FROM f.source
  WHERE r.place > f.place AND r.size <= f.gap
  QUALIFY row_number() OVER (PARTITION BY f.source ORDER BY r.place) = 1),
extra AS (
  SELECT source, unit FROM o WHERE upto <= remainder
  UNION ALL SELECT source, unit FROM fill WHERE place > 0)
SELECT d.doc_id, d.size::BIGINT AS size, p.source_size, p.target::DOUBLE AS target,
       (d.size * (p.rounds + CASE WHEN e.unit IS NULL THEN 0 ELSE 1 END))
         ::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
LEFT JOIN extra e ON e.source IS NOT DISTINCT FROM d.source AND e.unit = d.unit
"""

OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text
           FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT row, i, list_slice(words, i, i + 7) AS win
        FROM (SELECT row, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
again AS (SELECT row, unnest(range(i, i + 8)) AS place
          FROM (SELECT row, i, count(*) OVER (PARTITION BY row, win) AS n FROM win) WHERE n > 1),
repeats AS (SELECT row, count(DISTINCT place) AS n_repeat_words FROM again GROUP BY row),
dups AS (SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines
         FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d)
         WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
m AS (
  SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN repeats USING (row) LEFT JOIN dups USING (row)),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         10 * n_symbols > n_words AS by_symbols, 5 * n_dup_lines > n_words AS by_lines,
         word_chars > 12 * n_words OR word_chars < 2 * n_words AS by_lengths
  FROM m),
long_ AS (
  SELECT source, unnest(['base', 'symbols', 'lines', 'lengths']) AS rule,
         unnest([base_failed, by_symbols, by_lines, by_lengths])::INT AS failed FROM f),
hosts AS (SELECT source, rule, count(*) AS n, sum(failed) AS k, sum(failed) / count(*) AS rate
          FROM long_ GROUP BY source, rule),
spread AS (
  SELECT rule, avg(rate) AS mean, avg(rate) * (1 - avg(rate)) AS noise,
         var_pop(rate) - avg(rate) * (1 - avg(rate)) / (count(*) / sum(1.0 / n)) AS beyond
  FROM hosts GROUP BY rule),
prior AS (
  SELECT rule, mean, CASE WHEN beyond <= 0 THEN 1e6
         ELSE greatest(1.0, least(1e6, noise / beyond - 1)) END AS strength FROM spread),
verdict AS (
  SELECT source, max((k + mean * strength) / (n + strength)) AS worst
  FROM hosts JOIN prior USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND worst <= 0.5 AS kept
FROM f JOIN verdict v ON f.source IS NOT DISTINCT FROM v.source
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
         ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low,
         greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, coalesce(array_to_string(units[1:low], ''), '') AS prefix,
         coalesce(array_to_string(units[low + 1:high], ''), '') AS middle,
         coalesce(array_to_string(units[high + 1:n], ''), '') AS suffix
  FROM c)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END)
         AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END)
         AS restored_sha256
FROM p
"""

LLM_QUERIES = {f.__name__: f for f in (
    op1_quality_crf, op2_line_dedup, op3_simhash_near_dedup, op4_perspectives, op5_host_paths,
    op6_kdtree_topk, op7_unigram_pieces, op8_language_kernel, op9_mix_flow, op10_host_rules,
    op11_fill_middle, op12_bit_whitening, op13_secret_net,
)}
LLM_SQL: dict[str, str] = {
    "op4_perspectives": OP4_SQL,
    "op6_kdtree_topk": OP6_SQL,
    "op9_mix_flow": OP9_SQL,
    "op10_host_rules": OP10_SQL,
    "op11_fill_middle": OP11_SQL,
}
