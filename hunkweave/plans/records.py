"""Queries over whole record tables: missing references, hierarchies and snapshot changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from hunkweave.operators import hierarchy, orphans, snapshots
from hunkweave.runtime import table


def p1_found(spark, sf_dir):
    return orphans.orphan_entries(table(spark, sf_dir, "projections"), table(spark, sf_dir, "hunks")).select("entry_id", "field_name", "ref_value")


def p1_counts(spark, sf_dir):
    return orphans.orphan_counts(table(spark, sf_dir, "projections"), table(spark, sf_dir, "hunks"))


def _hierarchy(spark, sf_dir, kind):
    return hierarchy.record_hierarchy(table(spark, sf_dir, "stack_nodes"), table(spark, sf_dir, "projections"), kind)


def p2_found(spark, sf_dir):
    return _hierarchy(spark, sf_dir, "roots").select("source_table", "node_id", "root_id", "node_depth")


def p2_paths(spark, sf_dir):
    return _hierarchy(spark, sf_dir, "paths").select("source_table", "node_id", "root_id", "node_depth", "path")


def p2_descendants(spark, sf_dir):
    return _hierarchy(spark, sf_dir, "descendants").select("source_table", "node_id", "chain_id", "from_pos", "to_pos")


def p2_chains(spark, sf_dir):
    """The nodes that the intervals of p2_descendants name."""
    return _hierarchy(spark, sf_dir, "chains").select("source_table", "node_id", "chain_id", "chain_pos")


def p2_descendant_counts(spark, sf_dir):
    found = _hierarchy(spark, sf_dir, "descendants").groupBy("source_table", "node_id")
    return found.agg(F.sum(F.col("to_pos") - F.col("from_pos") + 1).alias("descendant_count"))


def p4_found(spark, sf_dir):
    rows = snapshots.normalised_store(table(spark, sf_dir, "correspondence"))
    return snapshots.snapshot_changes(rows, ["branch", "slice_signature"], ["content_hash", "base_ref"], "snapshot_no", "updated_at")


_P1_REFS = """
refs AS (
  SELECT DISTINCT entry_id, plan_id, manifest_id, declared_at, field_name, ref_value FROM (
    SELECT entry_id, plan_id, manifest_id, declared_at, 'atomic_slices' AS field_name, unnest(atomic_slices) AS ref_value FROM projections
    UNION ALL SELECT entry_id, plan_id, manifest_id, declared_at, 'glue', unnest(glue) FROM projections
    UNION ALL SELECT entry_id, plan_id, manifest_id, declared_at, 'depends_on', unnest(depends_on) FROM projections)
  WHERE ref_value IS NOT NULL),
targets AS (
  SELECT DISTINCT 'slice' AS kind, plan_id AS scope, unnest([CASE WHEN qualified_symbol IS NULL THEN fallback_selector ELSE file_path || '::' || qualified_symbol END, slice_label]) AS v,
         planned_at AS s, dropped_at AS e FROM hunks
  UNION ALL SELECT DISTINCT 'entry', manifest_id, projection_id, declared_at, withdrawn_at FROM projections),
lost AS (
  SELECT * FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM targets t WHERE t.kind = CASE WHEN r.field_name = 'depends_on' THEN 'entry' ELSE 'slice' END
      AND t.scope = CASE WHEN r.field_name = 'depends_on' THEN r.manifest_id ELSE r.plan_id END
      AND t.v = r.ref_value AND t.s <= r.declared_at AND (t.e IS NULL OR t.e > r.declared_at)))
"""

P1_FOUND = f"WITH {_P1_REFS} SELECT entry_id, field_name, ref_value FROM lost"

P1_COUNTS = f"""
WITH {_P1_REFS}
SELECT field_name, month, CAST(sum(r) AS BIGINT) AS ref_count, CAST(sum(o) AS BIGINT) AS orphan_count FROM (
  SELECT field_name, strftime(declared_at, '%Y-%m') AS month, 1 AS r, 0 AS o FROM refs
  UNION ALL SELECT field_name, strftime(declared_at, '%Y-%m'), 0, 1 FROM lost)
GROUP BY 1, 2
"""

P4_FOUND = r"""
WITH tidy AS (
  SELECT snapshot_no, branch, nullif(lower(regexp_replace(slice_signature, '^\s+|\s+$', '', 'g')), '') AS slice_signature,
         nullif(lower(regexp_replace(content_hash, '^\s+|\s+$', '', 'g')), '') AS content_hash,
         nullif(regexp_replace(base_ref, '^\s+|\s+$', '', 'g'), '') AS base_ref, updated_at FROM correspondence),
held AS (
  SELECT * FROM tidy QUALIFY row_number() OVER (PARTITION BY snapshot_no, branch, slice_signature ORDER BY updated_at DESC NULLS LAST, content_hash DESC NULLS LAST, base_ref DESC NULLS LAST) = 1),
snaps AS (SELECT snapshot_no AS cur, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT snapshot_no FROM held)),
new AS (SELECT cur, held.* FROM held JOIN snaps ON snapshot_no = cur WHERE prev IS NOT NULL),
old AS (SELECT cur, held.* FROM held JOIN snaps ON snapshot_no = prev)
SELECT coalesce(n.cur, o.cur) AS snapshot_no, coalesce(n.branch, o.branch) AS branch, coalesce(n.slice_signature, o.slice_signature) AS slice_signature,
       CASE WHEN o.cur IS NULL THEN 'added' WHEN n.cur IS NULL THEN 'removed' ELSE 'changed' END AS change_type
FROM new n FULL JOIN old o ON n.cur = o.cur AND n.branch IS NOT DISTINCT FROM o.branch AND n.slice_signature IS NOT DISTINCT FROM o.slice_signature
WHERE o.cur IS NULL OR n.cur IS NULL OR n.content_hash IS DISTINCT FROM o.content_hash OR n.base_ref IS DISTINCT FROM o.base_ref
"""

_P2_REACH = """
nodes AS (
  SELECT DISTINCT 'stack_nodes' AS source_table, node_id, push_id AS g, branch AS name, [base] AS refs FROM stack_nodes
  UNION ALL SELECT DISTINCT 'projections', entry_id, manifest_id, projection_id, depends_on FROM projections),
links AS (
  SELECT DISTINCT c.source_table, c.node_id, p.node_id AS parent_id
  FROM (SELECT source_table, node_id, g, unnest(refs) AS need FROM nodes) c
  JOIN nodes p ON p.source_table = c.source_table AND p.g = c.g AND p.name = c.need),
reach AS (
  SELECT source_table, node_id, parent_id AS up FROM links
  UNION SELECT r.source_table, r.node_id, l.parent_id FROM reach r JOIN links l ON l.source_table = r.source_table AND l.node_id = r.up),
cyclic AS (SELECT DISTINCT source_table, node_id FROM reach WHERE node_id = up),
unsound AS (SELECT source_table, node_id FROM cyclic UNION SELECT r.source_table, r.node_id FROM reach r JOIN cyclic c ON c.source_table = r.source_table AND c.node_id = r.up)
"""

P2_FOUND = f"""
WITH RECURSIVE {_P2_REACH},
sound AS (SELECT source_table, node_id FROM nodes EXCEPT SELECT * FROM unsound),
ways AS (
  SELECT source_table, node_id, node_id AS up, 0 AS d FROM sound
  UNION SELECT w.source_table, w.node_id, l.parent_id, w.d + 1 FROM ways w JOIN links l ON l.source_table = w.source_table AND l.node_id = w.up)
SELECT source_table, node_id, up AS root_id, CAST(max(d) AS BIGINT) AS node_depth FROM ways w
WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.source_table = w.source_table AND l.node_id = w.up) GROUP BY 1, 2, 3
UNION ALL SELECT source_table, node_id, -1, CASE WHEN (source_table, node_id) IN (SELECT (source_table, node_id) FROM cyclic) THEN -1 ELSE -2 END FROM unsound
"""

P2_DESCENDANT_COUNTS = f"""
WITH RECURSIVE {_P2_REACH}
SELECT r.source_table, r.up AS node_id, count(*) AS descendant_count FROM reach r
WHERE (r.source_table, r.node_id) NOT IN (SELECT (source_table, node_id) FROM unsound)
GROUP BY 1, 2
"""

_P2_PATHS = f"""
{_P2_REACH},
sound AS (SELECT source_table, node_id FROM nodes EXCEPT SELECT * FROM unsound),
ways AS (
  SELECT source_table, node_id, node_id AS up, 0 AS d FROM sound
  UNION SELECT w.source_table, w.node_id, l.parent_id, w.d + 1 FROM ways w JOIN links l ON l.source_table = w.source_table AND l.node_id = w.up),
dist AS (
  SELECT source_table, node_id, up AS root_id, max(d) AS d FROM ways w
  WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.source_table = w.source_table AND l.node_id = w.up) GROUP BY 1, 2, 3),
pred AS (
  SELECT c.source_table, c.node_id, c.root_id, min(l.parent_id) AS p FROM dist c JOIN links l ON l.source_table = c.source_table AND l.node_id = c.node_id
  JOIN dist u ON u.source_table = c.source_table AND u.node_id = l.parent_id AND u.root_id = c.root_id AND u.d = c.d - 1 GROUP BY 1, 2, 3),
walk AS (
  SELECT source_table, node_id, root_id, d, node_id AS cur, [node_id] AS path FROM dist
  UNION ALL SELECT w.source_table, w.node_id, w.root_id, w.d, p.p, list_prepend(p.p, w.path) FROM walk w JOIN pred p ON p.source_table = w.source_table AND p.node_id = w.cur AND p.root_id = w.root_id)
"""

P2_PATHS = f"""
WITH RECURSIVE {_P2_PATHS}
SELECT source_table, node_id, root_id, CAST(d AS BIGINT) AS node_depth, path FROM walk WHERE cur = root_id
UNION ALL SELECT source_table, node_id, -1, CASE WHEN (source_table, node_id) IN (SELECT (source_table, node_id) FROM cyclic) THEN -1 ELSE -2 END, NULL FROM unsound
"""

_P2_CHAINS = f"""
{_P2_REACH},
sound AS (SELECT source_table AS t, node_id AS v FROM nodes EXCEPT SELECT * FROM unsound),
keep AS (SELECT l.source_table AS t, l.node_id AS v, min(l.parent_id) AS p FROM links l JOIN sound ON t = l.source_table AND v = l.node_id GROUP BY 1, 2),
above AS (SELECT t, v, p FROM keep UNION ALL SELECT a.t, a.v, k.p FROM above a JOIN keep k ON k.t = a.t AND k.v = a.p),
sizes AS (SELECT s.t, s.v, 1 + count(a.v) AS n FROM sound s LEFT JOIN above a ON a.t = s.t AND a.p = s.v GROUP BY 1, 2),
heavy AS (SELECT k.t, k.p, k.v FROM keep k JOIN sizes z ON z.t = k.t AND z.v = k.v QUALIFY row_number() OVER (PARTITION BY k.t, k.p ORDER BY z.n DESC, k.v) = 1),
ch AS (
  SELECT s.t, s.v, s.v AS chain_id, CAST(0 AS BIGINT) AS pos FROM sound s WHERE NOT EXISTS (SELECT 1 FROM heavy h WHERE h.t = s.t AND h.v = s.v)
  UNION ALL SELECT c.t, h.v, c.chain_id, c.pos + 1 FROM ch c JOIN heavy h ON h.t = c.t AND h.p = c.v)
"""

P2_CHAINS = f"WITH RECURSIVE {_P2_CHAINS} SELECT t AS source_table, v AS node_id, chain_id, pos AS chain_pos FROM ch"

P2_DESCENDANTS = f"""
WITH RECURSIVE {_P2_CHAINS}
SELECT r.source_table, r.up AS node_id, c.chain_id, min(c.pos) AS from_pos, max(c.pos) AS to_pos FROM reach r JOIN ch c ON c.t = r.source_table AND c.v = r.node_id GROUP BY 1, 2, 3
"""

QUERIES = {
    "p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants, "p2_chains": p2_chains, "p2_descendant_counts": p2_descendant_counts,
    "p1_found": p1_found, "p1_counts": p1_counts, "p4_found": p4_found,
}
SQL = {
    "p2_found": P2_FOUND, "p2_paths": P2_PATHS, "p2_chains": P2_CHAINS, "p2_descendants": P2_DESCENDANTS, "p2_descendant_counts": P2_DESCENDANT_COUNTS,
    "p1_found": P1_FOUND, "p1_counts": P1_COUNTS, "p4_found": P4_FOUND,
}
