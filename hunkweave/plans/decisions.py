"""Queries of the decision operators over the record tables, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hunkweave.functions import hashes, paths
from hunkweave.operators import apply, edges, graph, manifest, push, reconcile, stacks
from hunkweave.plans import bindings as B
from hunkweave.plans import core
from hunkweave.plans.core import _DECL, _E, _ENT, _H, _NAMES, _REACH, _REC, _S, _USES
from hunkweave.runtime import materialize, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# Declared groupings against the edges of their plans.

_REFS = _USES.replace("uses AS (", "refs AS (")


@query(f"""
WITH RECURSIVE {_ENT}, {_NAMES}, {_DECL}, {_REFS}, r AS (SELECT scope, src, dst FROM dec UNION SELECT r.scope, r.src, d.dst FROM r JOIN dec d ON d.scope = r.scope AND d.src = r.dst),
ed AS (SELECT DISTINCT m.manifest_id AS scope, h.slice_label AS src, refs.dst FROM refs JOIN {_H} h ON h.hunk_id = refs.use_index JOIN (SELECT DISTINCT manifest_id, plan_id FROM {_E}) m ON m.plan_id = refs.plan_id WHERE h.slice_label <> refs.dst)
SELECT DISTINCT ed.scope, s.owner AS projection, d.owner AS needs FROM ed JOIN own s ON s.scope = ed.scope AND s.slice_id = ed.src JOIN own d ON d.scope = ed.scope AND d.slice_id = ed.dst
WHERE s.owner <> d.owner AND NOT EXISTS (SELECT 1 FROM r WHERE r.scope = ed.scope AND r.src = s.owner AND r.dst = d.owner)""")
def removed_dependencies(spark, sf_dir):
    return B.declared(spark, sf_dir).removed_dependencies().select("scope", "projection", F.col("detail").alias("needs"))


@query(f"""
WITH RECURSIVE {_ENT}, {_DECL}, nd AS (SELECT scope, projection AS node, min(pos) AS seq FROM ent GROUP BY 1, 2), size AS (SELECT scope, count(*) AS c FROM nd GROUP BY 1),
k AS (SELECT scope, 0 AS i, list(node ORDER BY seq, node) FILTER (WHERE NOT EXISTS (SELECT 1 FROM dec WHERE dec.scope = nd.scope AND dec.src = nd.node)) AS ord FROM nd GROUP BY 1
  UNION ALL SELECT q.scope, q.i + 1, list_concat(any_value(q.ord), coalesce(list(q.m ORDER BY q.m) FILTER (WHERE q.ready), []))
  FROM (SELECT k.scope, k.i, k.ord, f.src AS m, bool_and(list_contains(k.ord[: k.i + 1], g.dst)) AS ready FROM k LEFT JOIN dec f ON f.scope = k.scope AND f.dst = k.ord[k.i + 1] LEFT JOIN dec g ON g.scope = f.scope AND g.src = f.src
    WHERE k.i < len(k.ord) GROUP BY k.scope, k.i, k.ord, f.src) q GROUP BY q.scope, q.i),
last AS (SELECT scope, arg_max(ord, i) AS ord FROM k GROUP BY 1)
SELECT nd.scope, nd.node AS projection, CASE WHEN len(last.ord) = size.c THEN list_position(last.ord, nd.node) - 1 ELSE nd.seq END AS rank FROM nd JOIN size ON size.scope = nd.scope LEFT JOIN last ON last.scope = nd.scope""")
def manifest_order(spark, sf_dir):
    return B.declared(spark, sf_dir).order().select("scope", "projection", "rank")


@query(f"""
WITH {_ENT}, {_NAMES} SELECT e.scope, e.projection AS unit, coalesce((SELECT string_agg(o.slice_id, ' ' ORDER BY TRY_CAST(regexp_extract(o.slice_id, '(\\d+)$', 1) AS BIGINT), o.slice_id) FROM own o WHERE o.scope = e.scope AND o.owner = e.projection), '') AS slices FROM ent e""")
def verification_units(spark, sf_dir):
    found = B.declared(spark, sf_dir).verification_units()
    return found.select("scope", "unit", F.coalesce(F.array_join("slice_ids", " "), F.lit("")).alias("slices"))


_FINDINGS = ("unknown_selectors", "duplicate_assignments", "unknown_dependencies", "unassigned_slices", "manifest_cycles", "unreachable_glue", "oversize")


@query(
    "SELECT scope, count(*) FILTER (WHERE e) AS errors, count(*) FILTER (WHERE NOT e) AS warnings, bool_or(e) AS failed FROM ("
    + " UNION ALL ".join(f"SELECT scope, true AS e FROM ({core.SQL[n]})" for n in _FINDINGS)
    + f" UNION ALL SELECT scope, true FROM (WITH {_ENT} SELECT scope, projection FROM ent GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT scope, false FROM ({core.SQL['missing_intents']}) UNION ALL SELECT scope, code <> 'no-verification' FROM ({core.SQL['verification_findings']})) GROUP BY scope"
)
def manifest_verdicts(spark, sf_dir):
    """Errors and warnings of every manifest, without those about ordinals and removed dependencies, which have queries of their own."""
    d = B.declared(spark, sf_dir).settle()
    parts = [d.duplicate_ids(), d.unknown_selectors(), d.duplicate_assignments(), d.unknown_dependencies(), d.unassigned(), d.cycles(), d.unreachable_glue(), d.oversize(), d.intents(), d.verification()]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return manifest.verdict(found)


# Prerequisites: what a failure blocks, and what a choice needs.

_FLAG = f"flag AS (SELECT DISTINCT 'stack_nodes:' || push_id AS scope, branch AS node FROM {_S} WHERE adopted AND push_id IS NOT NULL AND branch IS NOT NULL)"


def _adopted(spark, sf_dir):
    s = table(spark, sf_dir, "stack_nodes").dropDuplicates(["node_id"]).where("adopted")
    return s.select(F.concat(F.lit("stack_nodes:"), "push_id").alias("scope"), F.col("branch").alias("node")).dropna().distinct()


@query(f"WITH RECURSIVE {_REC}, {_REACH}, {_FLAG} SELECT scope, node FROM flag UNION SELECT r.scope, r.src FROM r JOIN flag ON flag.scope = r.scope AND flag.node = r.dst")
def blocked_units(spark, sf_dir):
    """Adopted branches taken as blocked, and all that are stacked on one of them."""
    return graph.propagate(graph.closure(B.record_edges(spark, sf_dir)), _adopted(spark, sf_dir))


@query(f"WITH RECURSIVE {_REC}, {_REACH}, {_FLAG} SELECT scope, node FROM flag UNION SELECT r.scope, r.dst FROM r JOIN flag ON flag.scope = r.scope AND flag.node = r.src")
def selected_units(spark, sf_dir):
    """Adopted branches chosen, with all that they are stacked on."""
    return graph.selection(_adopted(spark, sf_dir), graph.closure(B.record_edges(spark, sf_dir)), None, False)


@query(f"WITH {_REC}, {_FLAG}, top AS (SELECT scope, max(node) AS m FROM flag GROUP BY 1) SELECT n.scope, n.node FROM n JOIN top ON top.scope = n.scope WHERE n.node <= top.m")
def selected_prefixes(spark, sf_dir):
    """The same in a stack whose order is that of the names: all up to the last one chosen."""
    ranks = B.record_nodes(spark, sf_dir).withColumn("rank", F.col("node"))
    return graph.selection(_adopted(spark, sf_dir), None, ranks, True)


# Pushes.

_LAST = f"""
sn AS (SELECT * FROM {_S} WHERE push_id IS NOT NULL AND branch IS NOT NULL),
old AS (SELECT n.push_id, n.node_id, arg_max(o, o.push_id) AS o FROM sn n JOIN sn o ON o.branch = n.branch AND o.push_id < n.push_id GROUP BY 1, 2)
"""


def _push(spark, sf_dir, **options):
    s = table(spark, sf_dir, "stack_nodes").dropDuplicates(["node_id"]).where("push_id is not null and branch is not null").select("push_id", "node_id", "branch", "unit_id", "pr_number", "base", "adopted")
    w = Window.partitionBy("branch").orderBy("push_id").rowsBetween(Window.unboundedPreceding, -1)
    s = materialize(s.withColumn("old", F.last(F.struct("node_id", "pr_number", "base", "adopted", "unit_id")).over(w)))
    up = s.select("push_id", F.col("branch").alias("base"), F.lit(True).alias("_known"))
    units = s.join(up, ["push_id", "base"], "left").select(
        F.col("push_id").alias("scope"), F.col("branch").alias("unit"), F.col("node_id").alias("rank"), F.col("branch").alias("branch_name"), F.col("branch").alias("signature"), F.col("unit_id").alias("patch"),
        F.when(F.col("pr_number") % 11 != 0, F.col("unit_id")).alias("tree"), F.lit(None).cast("string").alias("error"), F.when(F.col("_known"), "reuse").otherwise("root").alias("base_kind"), F.when(F.col("_known"), F.col("base")).alias("base_unit"),
        F.when(F.col("_known"), F.array("base")).otherwise(F.array().cast("array<string>")).alias("prerequisites"), F.lit(False).alias("widened"), (F.col("pr_number") % 7 == 0).alias("merged"),
    )
    kept = s.where("old is not null")
    store = kept.select(
        F.col("push_id").alias("scope"), F.col("branch").alias("signature"), "old.pr_number", hashes.content_hash(F.col("old.unit_id"), F.col("old.unit_id"), F.col("old.base")).alias("content_hash"), F.sha1(F.col("old.unit_id").cast("binary")).alias("commit_sha"),
        F.col("old.unit_id").alias("stored_tree"), F.col("old.base").alias("base_ref"), F.col("old.adopted").alias("adopted"),
    )
    head = F.when(F.col("pr_number") % 5 == 0, None).when(F.col("pr_number") % 3 == 0, F.col("unit_id")).otherwise(F.col("old.unit_id"))
    heads = kept.select(F.col("push_id").alias("scope"), F.col("branch").alias("branch_name"), F.sha1(head.cast("binary")).alias("remote_sha"))
    return push.push_plan(units, store, heads, "main", **options)


_PUSHED = f"""
WITH {_LAST},
x AS (SELECT n.push_id AS scope, n.branch AS unit, n.node_id AS rank, n.base AS wants, n.unit_id AS u, n.pr_number AS n_pr, old.o IS NOT NULL AS ex, old.o.pr_number AS pr, coalesce(old.o.adopted, false) AS ad, old.o.unit_id AS ou, old.o.base AS ob,
    n.pr_number % 7 = 0 AS merged, EXISTS (SELECT 1 FROM sn p WHERE p.push_id = n.push_id AND p.branch = n.base) AS known,
    CASE WHEN old.o IS NULL OR n.pr_number % 5 = 0 THEN NULL WHEN n.pr_number % 3 = 0 THEN n.unit_id ELSE old.o.unit_id END AS head FROM sn n LEFT JOIN old ON old.push_id = n.push_id AND old.node_id = n.node_id),
d AS (SELECT *, coalesce(ex AND NOT merged AND ou IS NOT NULL AND head <> ou, false) AS moved, ex AND NOT merged AND ou IS NOT NULL AND head IS NULL AS missing FROM x),
o AS (SELECT *, CASE WHEN n_pr % 11 = 0 OR u IS NULL THEN 'could not be built' WHEN moved AND (ad OR NOT {{reclaim}}) THEN 'others moved the branch to ' || substr(sha1(head), 1, 7) WHEN missing AND ad THEN 'the adopted branch is gone' END AS own FROM d),
b AS (SELECT o.*, {{block}} AS block FROM o LEFT JOIN o p ON p.scope = o.scope AND p.unit = o.wants),
w AS (SELECT b.*, {{base}} AS base FROM b {{below}}),
z AS (SELECT *, substr(sha1(concat_ws(chr(10) || '--' || chr(10), coalesce(u, ''), coalesce(u, ''), coalesce(base, ''))), 1, 12) AS made, substr(sha1(concat_ws(chr(10) || '--' || chr(10), coalesce(ou, ''), coalesce(ou, ''), coalesce(ob, ''))), 1, 12) AS held FROM w),
s AS (SELECT *, CASE WHEN merged THEN 'squash-merged' WHEN ex AND (held = made OR (ad AND ou = u)) THEN 'unchanged' WHEN ex THEN 'updated' ELSE 'created' END AS st FROM z)
SELECT scope, unit, CASE WHEN block IS NOT NULL THEN 'blocked' WHEN (moved OR missing) AND st = 'unchanged' THEN 'updated' ELSE st END AS status, CASE WHEN block IS NOT NULL THEN 'main' ELSE base END AS base,
  CASE WHEN block IS NULL AND st <> 'squash-merged' AND NOT ex THEN false END AS draft, CASE WHEN block IS NULL AND st <> 'squash-merged' AND NOT missing THEN CASE WHEN moved THEN sha1(head) ELSE CASE WHEN ex THEN sha1(ou) END END END AS expected_sha FROM s
"""


@query(_PUSHED.format(
    reclaim="false", block="CASE WHEN o.own = 'could not be built' THEN o.own WHEN o.known AND p.own IS NOT NULL THEN 'waits' ELSE o.own END", base="CASE WHEN b.known AND NOT (q.merged AND q.block IS NULL) THEN b.wants ELSE 'main' END",
    below="LEFT JOIN b q ON q.scope = b.scope AND q.unit = b.wants",
))
def push_flat(spark, sf_dir):
    """Every push with each branch on its base alone; what was stored is the branch's last node in an earlier push."""
    return _push(spark, sf_dir).select("scope", "unit", "status", "base", "draft", "expected_sha")


@query(_PUSHED.format(
    reclaim="true", block="o.own", below="",
    base="coalesce(last_value(CASE WHEN b.block IS NULL AND NOT b.merged THEN b.unit END IGNORE NULLS) OVER (PARTITION BY b.scope ORDER BY b.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'main')",
))
def push_stacked(spark, sf_dir):
    """Every push as one stack, with branches that others moved reclaimed."""
    return _push(spark, sf_dir, flat=False, reclaim=True).select("scope", "unit", "status", "base", "draft", "expected_sha")


@query(f"""
WITH p AS ({core.SQL['stack_links']}), own AS (SELECT DISTINCT push_id FROM {_S} WHERE adopted),
h AS (SELECT c.push_id, count(DISTINCT o.push_id) AS n, min(o.push_id) AS s FROM {_S} c JOIN {_S} o ON o.pr_number = c.pr_number AND o.push_id < c.push_id WHERE c.adopted = false GROUP BY 1)
SELECT p.chain_id, p.link_status, CASE WHEN h.n = 1 THEN h.s END AS stack_number,
  CASE p.link_status WHEN 'unchanged' THEN 'none' WHEN 'created' THEN 'create' WHEN 'extended' THEN 'extend' ELSE CASE WHEN h.n = 1 AND own.push_id IS NOT NULL THEN 'rebuild' ELSE 'refuse' END END AS action
FROM p LEFT JOIN h ON h.push_id = p.chain_id LEFT JOIN own ON h.n = 1 AND own.push_id = h.s""")
def link_actions(spark, sf_dir):
    """What linking each push's chain to the earlier stacks would do, with the stacks that hold an adopted branch as our own."""
    wanted, held, n = core.chains_and_stacks(spark, sf_dir)
    owned = n.where("adopted").select(F.col("push_id").alias("stack_number")).distinct()
    return stacks.link_actions(stacks.plan_links(wanted, held, earlier=True), owned, True, False).select("chain_id", "link_status", "stack_number", "action")


@query(f"""
WITH spots AS (SELECT pr_number, push_id AS stack_number, row_number() OVER (PARTITION BY push_id ORDER BY node_id) AS position FROM (SELECT * FROM {_S} WHERE push_id IS NOT NULL)),
last AS (SELECT * FROM spots QUALIFY row_number() OVER (PARTITION BY pr_number ORDER BY stack_number DESC, position DESC) = 1)
SELECT s.node_id, l.stack_number, l.position FROM {_S} s LEFT JOIN last l ON l.pr_number = s.pr_number""")
def stack_placements(spark, sf_dir):
    _, held, n = core.chains_and_stacks(spark, sf_dir)
    nodes = table(spark, sf_dir, "stack_nodes").dropDuplicates(["node_id"]).select("node_id", "pr_number")
    return stacks.with_placement(nodes, held).select("node_id", "stack_number", "position")


@query("SELECT branch, count(*) FILTER (WHERE pr_number IS NOT NULL AND base_ref IS NOT NULL) AS pushed, count(*) FILTER (WHERE pr_number IS NULL OR base_ref IS NULL) AS waiting FROM correspondence GROUP BY 1")
def stored_nodes(spark, sf_dir):
    pushed, waiting = stacks.store_nodes(table(spark, sf_dir, "correspondence"))
    both = pushed.select("branch", F.lit(1).alias("p")).unionByName(waiting.select("branch", F.lit(0).alias("p")))
    return both.groupBy("branch").agg(F.sum("p").alias("pushed"), F.sum(1 - F.col("p")).alias("waiting"))


# The store of one snapshot against the next one.

_STEP = """
k AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS next_no FROM (SELECT DISTINCT snapshot_no FROM correspondence WHERE snapshot_no IS NOT NULL)),
c AS (SELECT * FROM correspondence WHERE snapshot_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY snapshot_no, branch, slice_signature ORDER BY updated_at DESC NULLS LAST, id DESC NULLS LAST, slice_branch DESC NULLS LAST, pr_number DESC NULLS LAST, content_hash DESC NULLS LAST, commit_sha DESC NULLS LAST, base_ref DESC NULLS LAST, adopted DESC NULLS LAST) = 1),
now AS (SELECT c.* FROM c JOIN k ON k.next_no = c.snapshot_no), was AS (SELECT k.next_no, c.* FROM c JOIN k ON k.snapshot_no = c.snapshot_no AND k.next_no IS NOT NULL)
"""


def _steps(spark, sf_dir):
    """Rows of every snapshot but the first, and those of the snapshot before each, under one name of branch and snapshot."""
    c = table(spark, sf_dir, "correspondence").where("snapshot_no is not null")
    numbers = c.select("snapshot_no").distinct()
    after = F.broadcast(numbers.select("snapshot_no", F.lead("snapshot_no").over(Window.orderBy("snapshot_no")).alias("next_no"), F.lag("snapshot_no").over(Window.orderBy("snapshot_no")).alias("last_no")))
    rows = core.latest(c.select("snapshot_no", "branch", "slice_signature", "updated_at", "id", "slice_branch", "pr_number", "content_hash", "commit_sha", "base_ref", "adopted"), ["snapshot_no", "branch", "slice_signature"], "updated_at", "id")
    rows = rows.join(after, "snapshot_no")
    name = F.struct("branch", F.col("no").alias("no")).alias("branch")
    now = rows.where("last_no is not null").withColumn("no", F.col("snapshot_no")).withColumn("branch", name)
    was = rows.where("next_no is not null").withColumn("no", F.col("next_no")).withColumn("branch", name)
    return now, was


@query(f"""
WITH {_STEP}, talk AS (SELECT pr_number, count(*) FILTER (WHERE NOT adopted) AS threads, count(*) FILTER (WHERE adopted) AS replies FROM {_S} GROUP BY 1), lost AS (SELECT next_no, branch, slice_signature, count(*) AS n FROM was WHERE adopted GROUP BY ALL),
spot AS (SELECT pr_number, min(push_id) AS stack_number FROM {_S} GROUP BY 1)
SELECT n.snapshot_no, n.branch, n.slice_signature, CASE WHEN n.content_hash IS NULL THEN 'not-materializable' WHEN w.id IS NULL THEN 'never-pushed' WHEN w.commit_sha IS NULL OR w.content_hash IS NULL THEN 'unknown' WHEN w.content_hash = n.content_hash THEN 'unchanged' ELSE 'changed' END AS state,
  CASE WHEN w.id IS NOT NULL THEN w.base_ref IS NOT DISTINCT FROM n.base_ref END AS base_agrees, coalesce(t.threads, 0) AS threads, coalesce(t.replies, 0) AS replies, coalesce(l.n, 0) AS orphaned_anchors, s.stack_number
FROM now n LEFT JOIN was w ON w.next_no = n.snapshot_no AND w.branch = n.branch AND w.slice_signature = n.slice_signature LEFT JOIN talk t ON t.pr_number = w.pr_number
LEFT JOIN lost l ON l.next_no = n.snapshot_no AND l.branch = n.branch AND l.slice_signature = n.slice_signature LEFT JOIN spot s ON s.pr_number = w.pr_number""")
def review_contexts(spark, sf_dir):
    """Each slice of a snapshot with its review: what was stored before, the talk on its pull request, and its place in a stack."""
    now, was = _steps(spark, sf_dir)
    units = now.select("branch", F.col("slice_signature").alias("unit"), F.col("slice_signature").alias("signature"), F.col("content_hash").alias("tree"), F.lit(None).cast("string").alias("error"), F.col("base_ref").alias("manifest_base"))
    store = was.select("branch", F.col("slice_signature").alias("signature"), "slice_branch", "pr_number", "commit_sha", F.col("content_hash").alias("stored_tree"), "base_ref", "adopted")
    s = table(spark, sf_dir, "stack_nodes").dropDuplicates(["node_id"])
    talk = s.select("pr_number", F.col("node_id").alias("comment_id"), F.when(F.col("adopted"), F.col("node_id")).alias("in_reply_to"))
    anchors = was.where("adopted").select("branch", F.col("slice_signature").alias("signature"), F.lit("orphaned").alias("anchor"))
    found = reconcile.review_context(units, store, talk, anchors, s.groupBy("pr_number").agg(F.min("push_id").alias("stack_number")))
    return found.select(F.col("branch.no").alias("snapshot_no"), F.col("branch.branch").alias("branch"), F.col("unit").alias("slice_signature"), "state", "base_agrees", "threads", "replies", "orphaned_anchors", "stack_number")


@query(f"""
WITH {_STEP} SELECT n.snapshot_no, n.branch, n.slice_signature, CASE WHEN n.content_hash IS NULL THEN NULL WHEN w.content_hash IS NULL THEN 'created' WHEN w.content_hash = n.content_hash THEN 'unchanged' ELSE 'blocked' END AS local_status
FROM now n LEFT JOIN was w ON w.next_no = n.snapshot_no AND w.branch = n.branch AND w.slice_signature = n.slice_signature""")
def local_statuses(spark, sf_dir):
    """What writing each slice's branch would do to a local branch that holds the content of the snapshot before."""
    now, was = _steps(spark, sf_dir)
    units = now.join(was.select("branch", "slice_signature", F.col("content_hash").alias("ref_tree")), ["branch", "slice_signature"], "left").withColumnRenamed("content_hash", "tree")
    return reconcile.local_status(units).select("snapshot_no", F.col("branch.branch").alias("branch"), "slice_signature", "local_status")


@query(f"""
WITH {_STEP}, x AS (SELECT n.snapshot_no AS no, n.branch AS b, n.slice_signature AS sig, n.slice_branch AS head, n.pr_number AS pr, w.adopted AS ad, w.slice_branch AS wh, w.base_ref AS wb, n.base_ref AS nb, n.content_hash AS t, w.content_hash AS wt
  FROM now n LEFT JOIN was w ON w.next_no = n.snapshot_no AND w.branch = n.branch AND w.slice_signature = n.slice_signature)
SELECT no AS snapshot_no, b AS branch, sig AS projection, 'error' AS severity, 'adopt-pr-state' AS code FROM x WHERE NOT ad UNION ALL SELECT no, b, sig, 'error', 'adopt-head-mismatch' FROM x WHERE wh <> head
UNION ALL SELECT no, b, sig, 'error', 'adopt-conflict' FROM (SELECT DISTINCT no, b, sig, s.slice_signature FROM x JOIN was s ON s.next_no = x.no AND s.branch = x.b AND s.slice_signature <> x.sig AND (s.slice_branch = x.head OR s.pr_number = x.pr))
UNION ALL SELECT no, b, sig, 'warning', 'base-disagreement' FROM x WHERE wb <> nb UNION ALL SELECT no, b, sig, 'error', 'apply-failure' FROM x WHERE t IS NULL UNION ALL SELECT no, b, sig, 'error', 'adopt-replay-failed' FROM x WHERE t IS NOT NULL AND wt IS NULL
UNION ALL SELECT no, b, sig, 'error', 'adopt-mismatch' FROM x WHERE t <> wt""")
def adoption_findings(spark, sf_dir):
    """Findings of binding each slice to the pull request that it has in the next snapshot, with all slices stored before as bound already."""
    now, was = _steps(spark, sf_dir)
    before = was.select("branch", "slice_signature", F.when(F.col("adopted"), "OPEN").otherwise("CLOSED").alias("pr_state"), F.col("slice_branch").alias("pr_head"), F.col("base_ref").alias("pr_base"), F.col("content_hash").alias("head_tree"))
    checks = now.join(before, ["branch", "slice_signature"], "left").select("branch", F.col("slice_signature").alias("projection"), F.col("slice_signature").alias("signature"), F.col("slice_branch").alias("head"), "pr_number", "pr_state", "pr_head", "pr_base", F.col("base_ref").alias("manifest_base"), F.col("content_hash").alias("tree"), "head_tree")
    found = reconcile.adoption_findings(checks, was.select("branch", F.col("slice_signature").alias("signature"), "slice_branch", "pr_number"))
    return found.select(F.col("branch.no").alias("snapshot_no"), F.col("branch.branch").alias("branch"), "projection", "severity", "code")


@query(f"SELECT DISTINCT s.branch AS head, s.pr_number FROM {_S} s WHERE NOT starts_with(s.branch, 'review/') AND NOT EXISTS (SELECT 1 FROM correspondence c WHERE c.pr_number = s.pr_number)")
def open_for_discovery(spark, sf_dir):
    prs = table(spark, sf_dir, "stack_nodes").select(F.col("branch").alias("head"), "pr_number").distinct()
    return reconcile.open_for_discovery(prs, table(spark, sf_dir, "correspondence").where("pr_number is not null"), "review/")


# Comments, runs and files.

@query(f"""
WITH h AS (SELECT plan_id AS u, hunk_id, file_path AS p, new_start AS a, new_start + greatest(new_lines, 1) - 1 AS z, raw, exported, dropped_at IS NULL AS live FROM {_H}),
c AS (SELECT * FROM h WHERE NOT exported AND EXISTS (SELECT 1 FROM h f WHERE f.live AND f.u = h.u AND f.p = h.p)),
held AS (SELECT c.u, c.hunk_id, c.p, arg_min(o.raw, o.hunk_id) AS raw FROM c JOIN h o ON o.u = c.u AND o.p = c.p AND c.a BETWEEN o.a AND o.z GROUP BY 1, 2, 3)
SELECT u AS unit, hunk_id AS comment_id, CASE WHEN EXISTS (SELECT 1 FROM h n WHERE n.live AND n.u = held.u AND n.p = held.p AND n.raw = held.raw) THEN 'unchanged' ELSE 'orphaned' END AS anchor FROM held""")
def comment_anchors(spark, sf_dir):
    """A comment on the first line of every hunk, those on exported symbols handled before; dropped hunks are gone from the new text."""
    h = B.hunks(spark, sf_dir)
    old = h.select(F.col("plan_id").alias("unit"), F.col("file_path").alias("path"), F.col("hunk_id").alias("hunk_index"), "new_start", "new_lines", "raw")
    comments = h.select(F.col("plan_id").alias("unit"), F.col("hunk_id").alias("comment_id"), F.col("file_path").alias("path"), F.col("new_start").alias("line"), F.lit(None).cast("int").alias("original_line"), F.lit("RIGHT").alias("side"), F.lit(None).cast("long").alias("in_reply_to"))
    new = h.where("dropped_at is null").select(F.col("plan_id").alias("unit"), F.col("file_path").alias("path"), "raw")
    return reconcile.comment_actions(comments, old, new, h.where("exported").select(F.col("hunk_id").alias("comment_id")))


@query("""
WITH d AS (SELECT doc_id, source, first_value(doc_id) OVER (PARTITION BY source ORDER BY created_at, doc_id) AS first, text FROM documents WHERE doc_kind = 'review_comment')
SELECT doc_id AS comment_id, (SELECT count(*) FROM d r WHERE r.source = d.source AND r.doc_id <> r.first) AS replies FROM d WHERE doc_id = first""")
def thread_replies(spark, sf_dir):
    """Every source's first review comment as a thread, the others as replies to it."""
    d = table(spark, sf_dir, "documents").where("doc_kind = 'review_comment'")
    first = F.first("doc_id").over(Window.partitionBy("source").orderBy("created_at", "doc_id"))
    c = d.withColumn("_f", first).select(F.col("doc_id").alias("comment_id"), F.col("source").alias("path"), F.lit(1).alias("line"), F.lit(1).alias("original_line"), F.when(F.col("_f") != F.col("doc_id"), F.col("_f")).alias("in_reply_to"), F.col("text").alias("body"))
    return reconcile.threads(c).select("comment_id", "replies")


@query("""
WITH t AS (SELECT DISTINCT ON (id) * FROM timing_runs), c AS (SELECT branch, command, hunk_count, duration_ms > 0 AS passed FROM t WHERE branch IS NOT NULL AND command IS NOT NULL QUALIFY row_number() OVER (PARTITION BY branch, command ORDER BY started_at DESC, id DESC) = 1)
SELECT t.id, coalesce(c.passed AND c.hunk_count = t.hunk_count, false) AS cached FROM t LEFT JOIN c ON c.branch = t.branch AND c.command = t.command""")
def cached_runs(spark, sf_dir):
    """Runs that the last one of their branch and command makes needless: it passed on the same tree, here the hunk count."""
    t = table(spark, sf_dir, "timing_runs").dropDuplicates(["id"]).select("id", "branch", F.lit("all").alias("projection"), "command", F.col("hunk_count").alias("tree_hash"), "started_at", "duration_ms")
    last = core.latest(t.where("branch is not null and command is not null"), ["branch", "projection", "command"], "started_at", "id")
    return reconcile.verification_plan(t, last.select("branch", "projection", "command", "tree_hash", (F.col("duration_ms") > 0).alias("passed"))).select("id", "cached")


@query("SELECT command, CASE WHEN hunk_count IS NULL THEN 'disabled' WHEN duration_ms IS NULL THEN 'no-command' ELSE 'ran' END AS outcome, count(*) AS runs FROM (SELECT DISTINCT ON (id) * FROM timing_runs) GROUP BY 1, 2")
def build_outcomes(spark, sf_dir):
    t = table(spark, sf_dir, "timing_runs").dropDuplicates(["id"])
    return t.groupBy("command", reconcile.build_outcome(F.col("hunk_count").isNotNull(), F.col("duration_ms").cast("string")).alias("outcome")).agg(F.count(F.lit(1)).alias("runs"))


@query(r"""
SELECT DISTINCT file_path, CASE WHEN regexp_extract(file_path, '[^/]*$') IN ('bun.lock', 'bun.lockb', 'package-lock.json', 'npm-shrinkwrap.json', 'yarn.lock', 'pnpm-lock.yaml', 'package.json') THEN 'dependency-manifest'
  WHEN regexp_matches(file_path, '\.(ts|tsx|js|jsx|mjs|cjs)$') THEN 'no-enclosing-symbol' ELSE 'unsupported-language' END AS reason FROM hunks""")
def fallback_reasons(spark, sf_dir):
    p = table(spark, sf_dir, "hunks").select("file_path").distinct()
    return p.select("file_path", paths.fallback_reason("file_path", F.when(paths.language("file_path").isNotNull(), "parsed").otherwise("unsupported-language")).alias("reason"))


_LINE = "{t} || CASE WHEN ends_with({t}, chr(10)) THEN '' ELSE chr(10) END"


@query(f"""
WITH d AS (SELECT DISTINCT doc_id, source, {_LINE.format(t='text')} AS text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), b AS (SELECT source, arg_max(text, [length(text), doc_id]) AS base FROM d GROUP BY 1)
SELECT d.doc_id AS unit, contains(chr(10) || b.base, chr(10) || d.text) AS merged FROM d JOIN b ON b.source = d.source""")
def already_merged(spark, sf_dir):
    """Units that each add all lines of a text, and whether the longest text of the same source has them already."""
    text = F.when(F.col("text").endswith("\n"), F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    d = materialize(table(spark, sf_dir, "documents").where("text is not null and source is not null").dropDuplicates(["doc_id"]).select("doc_id", F.col("source").alias("scope"), text.alias("text")))
    base = d.groupBy("scope").agg(F.max_by("text", F.struct(F.length("text"), "doc_id")).alias("content")).withColumn("path", F.lit("notes"))
    lines = F.split(F.expr("substring(text, 1, length(text) - 1)"), "\n", -1)
    raw = F.concat(F.lit("@@ -0,0 +1,"), F.size(lines).cast("string"), F.lit(" @@\n+"), F.array_join(lines, "\n+"), F.lit("\n"))
    return apply.reverses(base, d.select("scope", F.col("doc_id").alias("unit"), F.lit("notes").alias("path"), F.lit(0).alias("hunk_index"), raw.alias("raw"))).select("unit", "merged")


_TREE = "sha1(encode('tree 33' || chr(0) || '100644 notes' || chr(0)) || unhex(sha1(encode('blob ' || octet_length(encode({t})) || chr(0)) || encode({t}))))"


@query(f"""
WITH d AS (SELECT DISTINCT doc_id, 'base' || chr(10) || {_LINE.format(t='text')} AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS scope, unnest(['a', 'b', 'c', 'd', 'e']) AS unit, unnest(['root', 'reuse', 'reuse', NULL, NULL]) AS base_kind, unnest([NULL, 'a', 'b', NULL, NULL]) AS base_unit, unnest([false, false, true, false, false]) AS widened,
  unnest([{_TREE.format(t="('first' || chr(10) || t)")}, {_TREE.format(t="('first' || chr(10) || t || 'last' || chr(10))")}, {_TREE.format(t="('changed' || chr(10) || t || 'last' || chr(10))")}, NULL, NULL]) AS tree FROM d""")
def flat_first_units(spark, sf_dir):
    """Five units on every text: a line before all, a line after all that needs it, one that changes the first line without saying what it needs, one that fits nowhere, one that needs that."""
    text = F.when(F.col("text").endswith("\n"), F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    d = materialize(table(spark, sf_dir, "documents").where("text is not null").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("scope"), F.concat(F.lit("base\n"), text).alias("content"), F.lit("notes").alias("path")))
    n = F.size(F.split("content", "\n", -1)).cast("string")
    hunks = [
        ("a", F.lit("@@ -0,0 +1,1 @@\n+first\n")), ("b", F.concat(F.lit("@@ -"), n, F.lit(",0 +"), n, F.lit(",1 @@\n+last\n"))), ("c", F.lit("@@ -1,2 +1,2 @@\n-first\n+changed\n base\n")),
        ("d", F.lit("@@ -1,1 +1,1 @@\n-no text has this line, nor any like it\n+x\n")), ("e", F.lit("@@ -0,0 +1,1 @@\n+e\n")),
    ]
    each = d.select("scope", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.lit(i).alias("rank"), raw.alias("raw")) for i, (u, raw) in enumerate(hunks)])).alias("u")).select("scope", "u.*")
    links = d.select("scope", F.explode(F.array(F.struct(F.lit("b").alias("src"), F.lit("a").alias("dst")), F.struct(F.lit("e").alias("src"), F.lit("d").alias("dst")))).alias("l")).select("scope", "l.*")
    built = apply.flat_first_units(d, each.select("scope", "unit", "rank"), each.select("scope", "unit", F.col("rank").alias("hunk_index"), F.lit("notes").alias("path"), "raw"), links)
    return built.select("scope", "unit", "base_kind", "base_unit", "widened", "tree")
