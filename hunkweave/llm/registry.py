"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hunkweave.llm import components, contamination, percentiles, residue, tokenizer
from hunkweave.runtime import table


def p3_percentiles(spark, sf_dir):
    return percentiles.run_percentiles(table(spark, sf_dir, "timing_runs")).select("span", "period", "command", "size_class", "per_mille", F.col("value").alias("duration_ms"), F.col("total").alias("run_count"))


def p3_day_counts(spark, sf_dir):
    runs = table(spark, sf_dir, "timing_runs")
    groups = {"command": F.col("command"), "size_class": percentiles.size_class("hunk_count")}
    state = percentiles.day_counts(runs, "id", groups, "duration_ms", "started_at")
    return state.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "command", percentiles.label("size_class", percentiles.SIZE_CLASSES), F.col("value").alias("duration_ms"), F.col("n").alias("run_count"))


def p5_found(spark, sf_dir):
    return components.merge_groups(table(spark, sf_dir, "overrides"))


def p6_ids(spark, sf_dir):
    return tokenizer.token_ids(table(spark, sf_dir, "documents"))


def p6_roundtrip(spark, sf_dir):
    """The hash of each text put together again from its ids."""
    back = tokenizer.texts_of(tokenizer.token_ids(table(spark, sf_dir, "documents")))
    return back.select("doc_id", F.sha1(F.col("text").cast("binary")).alias("text_sha"))


def p7_found(spark, sf_dir):
    return contamination.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_spans(spark, sf_dir):
    return contamination.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark, sf_dir):
    return residue.residue_documents(table(spark, sf_dir, "documents"))


def p8_passages(spark, sf_dir):
    return residue.residue_passages(table(spark, sf_dir, "documents")).select("doc_id", "label", "start_offset", "end_offset")


def p8_kept(spark, sf_dir):
    return residue.without_residue(table(spark, sf_dir, "documents")).select("doc_id", "source", "doc_kind")


_P3_STATE = """
runs AS (SELECT DISTINCT ON (id) id, started_at, command, duration_ms,
  CASE WHEN hunk_count IS NULL OR hunk_count < 0 THEN 'unknown' WHEN hunk_count < 1 THEN '0' WHEN hunk_count < 10 THEN '1-9' WHEN hunk_count < 50 THEN '10-49'
       WHEN hunk_count < 200 THEN '50-199' WHEN hunk_count < 1000 THEN '200-999' ELSE '1000+' END AS size_class
  FROM timing_runs WHERE duration_ms >= 0)
"""

P3_DAY_COUNTS = f"""
WITH {_P3_STATE}
SELECT strftime(started_at, '%Y-%m-%d') AS day, command, size_class, duration_ms, count(*) AS run_count FROM runs GROUP BY ALL
"""

P3_PERCENTILES = f"""
WITH {_P3_STATE},
each AS (
  SELECT unnest(['day', 'week', 'month', 'all']) AS span,
         unnest([strftime(started_at, '%Y-%m-%d'), strftime(date_trunc('week', started_at), '%Y-%m-%d'), strftime(started_at, '%Y-%m'), 'all']) AS period,
         command, size_class, duration_ms FROM runs),
both_classes AS (SELECT span, period, command, unnest([size_class, 'all']) AS size_class, duration_ms FROM each),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY span, period, command, size_class ORDER BY duration_ms) AS rk, count(*) OVER (PARTITION BY span, period, command, size_class) AS total FROM both_classes),
targets AS (SELECT unnest([500, 900, 950, 990]) AS per_mille)
SELECT span, period, command, size_class, per_mille, duration_ms, total AS run_count FROM ranked, targets WHERE rk = greatest(1, (per_mille * total + 999) // 1000)
"""

P5_FOUND = r"""
WITH RECURSIVE tidy AS (
  SELECT branch, nullif(regexp_replace(selector_a, '^\s+|\s+$', '', 'g'), '') AS a, nullif(regexp_replace(selector_b, '^\s+|\s+$', '', 'g'), '') AS b FROM overrides WHERE kind = 'force_merge'),
names AS (SELECT branch, a AS s FROM tidy WHERE a IS NOT NULL UNION SELECT branch, b FROM tidy WHERE b IS NOT NULL),
links AS (SELECT branch, a AS x, b AS y FROM tidy WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT branch, b, a FROM tidy WHERE a IS NOT NULL AND b IS NOT NULL),
reach AS (SELECT branch, s, s AS t FROM names UNION SELECT r.branch, r.s, l.y FROM reach r JOIN links l ON l.branch = r.branch AND l.x = r.t)
SELECT branch, s AS selector, min(t) AS group_selector FROM reach GROUP BY 1, 2
"""

P6_ROUNDTRIP = "SELECT doc_id, sha1(coalesce(text, '')) AS text_sha FROM documents"

P7_FOUND = r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dw AS (SELECT id, array_to_string(w[i : i + 15], ' ') AS k FROM (SELECT id, w, unnest(range(1, len(w) - 14)) AS i FROM d)),
ew AS (SELECT DISTINCT id, array_to_string(w[i : i + 15], ' ') AS k FROM (SELECT id, w, unnest(range(1, len(w) - 14)) AS i FROM e))
SELECT DISTINCT dw.id AS doc_id, ew.id AS item_id FROM dw JOIN ew USING (k)
"""

P7_SPANS = r"""
WITH d AS (SELECT doc_id, m, i FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\p{L}\p{N}]*[\p{L}\p{N}]+')) AS m, unnest(range(1, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) + 1)) AS i FROM documents)),
w AS (SELECT doc_id, i, lower(regexp_extract(m, '[\p{L}\p{N}]+')) AS word, sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS b, length(regexp_extract(m, '[\p{L}\p{N}]+')) AS n FROM d),
dw AS (SELECT doc_id, i, string_agg(word, ' ') OVER r AS k, count(*) OVER r AS c FROM w WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
ew AS (SELECT item_id, j, array_to_string(w[j : j + 15], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - 14)) AS j FROM e)),
hit AS (SELECT doc_id, item_id, i, j, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS g FROM dw JOIN ew USING (k) WHERE c = 16),
run AS (SELECT doc_id, item_id, min(i) AS a, max(i) + 15 AS z, min(j) - 1 AS item_word FROM hit GROUP BY doc_id, item_id, i - j, g)
SELECT run.doc_id, item_id, CAST(f.b - f.n AS BIGINT) AS start_offset, CAST(l.b AS BIGINT) AS end_offset, item_word, z - a + 1 AS word_count
FROM run JOIN w f ON f.doc_id = run.doc_id AND f.i = run.a JOIN w l ON l.doc_id = run.doc_id AND l.i = run.z
"""

QUERIES = {"p3_percentiles": p3_percentiles, "p3_day_counts": p3_day_counts, "p5_found": p5_found, "p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p7_found": p7_found, "p7_spans": p7_spans, "p8_found": p8_found, "p8_passages": p8_passages, "p8_kept": p8_kept}
SQL = {"p3_percentiles": P3_PERCENTILES, "p3_day_counts": P3_DAY_COUNTS, "p5_found": P5_FOUND, "p6_roundtrip": P6_ROUNDTRIP, "p7_found": P7_FOUND, "p7_spans": P7_SPANS}
