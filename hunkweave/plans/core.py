"""Queries of the engine's own operators over the record tables, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hunkweave.functions import hashes, paths
from hunkweave.operators import apply, diffs, edges, graph, manifest, partition, reconcile, score, stacks
from hunkweave.plans import bindings as B
from hunkweave.runtime import materialize, table
from hunkweave.sources.store import earliest, latest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_H = "(SELECT DISTINCT ON (hunk_id) *, CASE WHEN qualified_symbol IS NULL THEN coalesce(fallback_selector, file_path || '::(file)') ELSE file_path || '::' || qualified_symbol END AS selector FROM hunks)"
_E = "(SELECT DISTINCT ON (entry_id) * FROM projections)"
_S = "(SELECT DISTINCT ON (node_id) * FROM stack_nodes)"
_LINES = "len(list_filter(string_split({t}, chr(10)), lambda l: (l[1] = '+' OR l[1] = '-') AND l[1:3] <> '+++' AND l[1:3] <> '---'))"


# Sections and hunks of diff text: every patch document.

@query(r"""
SELECT doc_id AS diff_id, CAST(len(regexp_extract_all(text, '(?m)^diff --git ')) AS BIGINT) AS section_count FROM documents WHERE doc_kind = 'patch' AND regexp_matches(text, '(?m)^diff --git ')""")
def diff_sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_kind = 'patch'").select(F.col("doc_id").alias("diff_id"), "text")
    return diffs.sections(docs).groupBy("diff_id").agg(F.count(F.lit(1)).alias("section_count"))


@query(r"""
WITH sec AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '(?m)^diff --git '), lambda x: true)[2:]) AS s FROM documents WHERE doc_kind = 'patch'),
h AS (SELECT doc_id, unnest(regexp_extract_all(s, '(?m)^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@')) AS head FROM sec WHERE regexp_matches(s, '(?m)^(\+\+\+ b/.|--- a/.)') OR regexp_matches(s, '^a/.+? b/.'))
SELECT doc_id AS diff_id, count(*) AS hunk_count, CAST(sum(coalesce(TRY_CAST(nullif(regexp_extract(head, '^@@ -\d+(?:,(\d+))?', 1), '') AS INT), 1)) AS BIGINT) AS old_lines,
  CAST(sum(CAST(regexp_extract(head, '\+(\d+)', 1) AS INT)) AS BIGINT) AS new_starts FROM h GROUP BY 1""")
def diff_hunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_kind = 'patch'").select(F.col("doc_id").alias("diff_id"), "text")
    return diffs.hunks(diffs.sections(docs)).groupBy("diff_id").agg(F.count(F.lit(1)).alias("hunk_count"), F.sum("old_lines").alias("old_lines"), F.sum("new_start").alias("new_starts"))


_HEADERS = ("Binary files a/{p} and b/{p} differ", "similarity index 100%\nrename from {p}\nrename to {p}.old", "old mode 100644\nnew mode 100755", "new file mode 100644\nindex 0000000..e69de29", "odd one\nodd two\nodd three\nodd four")


@query(r"""
WITH k AS (SELECT DISTINCT hunk_id, file_path AS p, len(file_path) % 5 AS v FROM hunks)
SELECT hunk_id AS diff_id, CASE WHEN v = 3 THEN NULL ELSE p END AS path, ['binary', 'rename-only', 'mode-only', 'empty-file', 'unrecognized'][v + 1] AS reason,
  CASE v WHEN 0 THEN 'Binary files a/' || p || ' and b/' || p || ' differ' WHEN 1 THEN 'similarity index 100% / rename from ' || p || ' / rename to ' || p || '.old' WHEN 2 THEN 'old mode 100644 / new mode 100755' WHEN 3 THEN 'new file mode 100644'
    ELSE 'diff --git a/' || p || ' b/' || p || ' / odd one / odd two' END AS detail FROM k""")
def diff_excluded(spark, sf_dir):
    """One section without hunks for each hunk's file, of the kind that the length of its path picks; an empty file names no path."""
    h = B.hunks(spark, sf_dir).select("hunk_id", "file_path", F.length("file_path") % 5)
    p = F.col("file_path")
    parts = [F.concat(*[x for piece in text.split("{p}") for x in (F.lit(piece), p)][:-1]) for text in _HEADERS]
    first = F.when(F.length(p) % 5 == 3, F.lit("diff --git\n")).otherwise(F.concat(F.lit("diff --git a/"), p, F.lit(" b/"), p, F.lit("\n")))
    body = F.element_at(F.array(*parts), F.length(p) % 5 + 1)
    return diffs.excluded(diffs.sections(h.select(F.col("hunk_id").alias("diff_id"), F.concat(F.when(F.length(p) % 5 == 3, F.lit("diff --git \n")).otherwise(first), body, F.lit("\n")).alias("text")))).drop("section_pos")


@query(f"SELECT hunk_id, CAST({_LINES.format(t='raw')} AS INTEGER) AS changed_lines FROM {_H}")
def changed_lines(spark, sf_dir):
    return B.hunks(spark, sf_dir).select("hunk_id", F.size(diffs.changed_lines("raw")).alias("changed_lines"))


@query(f"SELECT doc_id, CAST({_LINES.format(t='text')} AS INTEGER) AS changed_lines FROM documents WHERE text IS NOT NULL")
def document_changed_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(diffs.changed_lines("text")).alias("changed_lines"))


# Paths and names.

@query(f"""
SELECT DISTINCT file_path, CASE WHEN file_path LIKE '%.tsx' THEN 'tsx' WHEN file_path LIKE '%.ts' THEN 'typescript' WHEN regexp_matches(file_path, '\\.(js|jsx|mjs|cjs)$') THEN 'javascript' END AS grammar,
  regexp_matches(file_path, '(^|/)__tests__/|\\.(test|spec)\\.[cm]?[jt]sx?$') AS is_test, regexp_matches(file_path, '\\.(ts|tsx|mts|cts|js|jsx|mjs|cjs)$') AS is_code,
  regexp_replace(file_path, '\\.(test|spec)\\.([cm]?[jt]sx?)$', '.\\2') AS counterpart,
  CASE WHEN regexp_extract(file_path, '[^/]*$') IN ('bun.lock', 'bun.lockb', 'package-lock.json', 'npm-shrinkwrap.json', 'yarn.lock', 'pnpm-lock.yaml', 'package.json')
       THEN regexp_extract(file_path, '^(.*/)?[^/]*$', 1) || 'package.json::(deps)' ELSE file_path || '::(file)' END AS fallback
FROM hunks""")
def path_rules(spark, sf_dir):
    p = table(spark, sf_dir, "hunks").select("file_path").distinct()
    return p.select(
        "file_path", paths.language("file_path").alias("grammar"), paths.is_test_file("file_path").alias("is_test"), paths.is_code_file("file_path").alias("is_code"),
        paths.production_counterpart("file_path").alias("counterpart"), paths.fallback_selector("file_path").alias("fallback"),
    )


@query(f"""
SELECT DISTINCT qualified_symbol, CASE WHEN qualified_symbol LIKE '%.constructor' THEN string_split(qualified_symbol, '.')[-2] ELSE string_split(qualified_symbol, '.')[-1] END AS definition_name
FROM hunks WHERE qualified_symbol IS NOT NULL""")
def definition_names(spark, sf_dir):
    return table(spark, sf_dir, "hunks").where("qualified_symbol is not null").select("qualified_symbol", paths.definition_name("qualified_symbol").alias("definition_name")).distinct()


@query(f"""
SELECT DISTINCT t.plan_id, t.slice_label AS test_slice, p.slice_label AS code_slice FROM {_H} t JOIN {_H} p ON p.plan_id = t.plan_id
  AND p.file_path = regexp_replace(t.file_path, '\\.(test|spec)\\.([cm]?[jt]sx?)$', '.\\2') AND p.slice_label <> t.slice_label
WHERE regexp_matches(t.file_path, '\\.(test|spec)\\.[cm]?[jt]sx?$')""")
def test_counterparts(spark, sf_dir):
    h = B.hunks(spark, sf_dir).select("plan_id", "file_path", "slice_label")
    t = h.where(F.col("file_path").rlike(r"\.(test|spec)\.[cm]?[jt]sx?$")).select("plan_id", paths.production_counterpart("file_path").alias("file_path"), F.col("slice_label").alias("test_slice")).distinct()
    return t.join(h.withColumnRenamed("slice_label", "code_slice"), ["plan_id", "file_path"]).where("test_slice <> code_slice").select("plan_id", "test_slice", "code_slice").distinct()


@query(f"""
WITH d AS (SELECT plan_id, slice_label, string_split(file_path, '/')[:-2] AS parts FROM {_H}),
lev AS (SELECT plan_id, slice_label, i, min(parts[i]) AS a, max(coalesce(parts[i], chr(127))) AS b, count(*) AS n, count(parts[i]) AS k FROM (SELECT *, unnest(range(1, 12)) AS i FROM d) GROUP BY ALL),
ok AS (SELECT *, min(CASE WHEN n = k AND a = b THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id, slice_label ORDER BY i) AS good FROM lev)
SELECT plan_id, slice_label, coalesce(string_agg(a, '/' ORDER BY i) FILTER (WHERE good = 1), '') AS shared_directory FROM ok GROUP BY 1, 2""")
def shared_directories(spark, sf_dir):
    g = B.hunks(spark, sf_dir).groupBy("plan_id", "slice_label").agg(F.collect_set("file_path").alias("files"))
    return g.select("plan_id", "slice_label", F.array_join(paths.common_directory("files"), "/").alias("shared_directory"))


@query("""
SELECT branch, slice_signature, slice_branch IS NOT NULL AS bound, coalesce(slice_branch, 'review/' || branch || '/' || slice_signature) AS unit_branch FROM correspondence""")
def unit_branches(spark, sf_dir):
    return table(spark, sf_dir, "correspondence").select("branch", "slice_signature", F.col("slice_branch").isNotNull().alias("bound"), hashes.branch_name(F.col("branch"), F.col("slice_signature"), F.col("slice_branch")).alias("unit_branch"))


# Groups, signatures and hashes.

@query(f"SELECT plan_id, selector, count(*) AS hunk_count, min(hunk_id) AS first_hunk FROM {_H} GROUP BY 1, 2")
def group_by_key(spark, sf_dir):
    return B.hunks(spark, sf_dir).groupBy("plan_id", paths.group_key().alias("selector")).agg(F.count(F.lit(1)).alias("hunk_count"), F.min("hunk_id").alias("first_hunk"))


@query(f"SELECT plan_id, slice_label, substr(sha1(array_to_string(list_sort(list(DISTINCT selector)), '|')), 1, 12) AS signature FROM {_H} GROUP BY 1, 2")
def slice_signatures(spark, sf_dir):
    g = B.hunks(spark, sf_dir).groupBy("plan_id", "slice_label").agg(F.collect_set(paths.group_key()).alias("keys"))
    return g.select("plan_id", "slice_label", hashes.signature(F.col("keys")).alias("signature"))


@query(f"SELECT plan_id, selector, min(hunk_id) OVER (PARTITION BY plan_id, selector) AS slice_id, hunk_id AS hunk_index FROM {_H}")
def slices(spark, sf_dir):
    return partition.slices(B.plan_hunks(spark, sf_dir)).select(F.col("diff_id").alias("plan_id"), "selector", "slice_id", "hunk_index")


@query(f"""
WITH o AS (SELECT DISTINCT branch, selector_a FROM overrides WHERE kind = 'force_split' AND selector_a IS NOT NULL),
k AS (SELECT h.branch, h.hunk_id, h.selector, o.selector_a IS NOT NULL AS split FROM {_H} h LEFT JOIN o ON o.branch = h.branch AND o.selector_a = h.selector)
SELECT branch, hunk_id AS hunk_index, selector, CASE WHEN split THEN hunk_id ELSE min(hunk_id) OVER (PARTITION BY branch, selector) END AS slice_id FROM k""")
def split_slices(spark, sf_dir):
    h = B.hunks(spark, sf_dir).drop("hunk_index").withColumnRenamed("hunk_id", "hunk_index")
    return partition.slices(h, B.overrides(spark, sf_dir).where("kind = 'force_split'"), "branch").select("branch", "hunk_index", "selector", "slice_id")


@query(f"""
WITH RECURSIVE h AS (SELECT branch, selector, min(hunk_id) AS f FROM {_H} GROUP BY 1, 2),
l AS (SELECT a.branch, a.f AS x, b.f AS y FROM overrides o JOIN h a ON a.branch = o.branch AND a.selector = o.selector_a JOIN h b ON b.branch = o.branch AND b.selector = o.selector_b WHERE o.kind = 'force_merge'),
u AS (SELECT branch, x, y FROM l UNION SELECT branch, y, x FROM l),
r AS (SELECT branch, f AS a, f AS b FROM h UNION SELECT r.branch, r.a, u.y FROM r JOIN u ON u.branch = r.branch AND u.x = r.b),
c AS (SELECT branch, a, min(b) AS slice_id FROM r GROUP BY 1, 2)
SELECT h.branch, h.selector, c.slice_id FROM h JOIN c ON c.branch = h.branch AND c.a = h.f""")
def merged_slices(spark, sf_dir):
    h = B.hunks(spark, sf_dir).drop("hunk_index").withColumnRenamed("hunk_id", "hunk_index")
    got = partition.slices(h, B.overrides(spark, sf_dir).where("kind = 'force_merge'"), "branch")
    return got.select("branch", "selector", "slice_id").distinct()


@query(f"""
SELECT branch, id, kind, selector FROM (SELECT branch, id, kind, unnest([selector_a, selector_b]) AS selector FROM (SELECT DISTINCT ON (id) * FROM overrides)) o
WHERE selector IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_H} h WHERE h.branch = o.branch AND h.selector = o.selector)""")
def ignored_overrides(spark, sf_dir):
    return partition.ignored_overrides(B.overrides(spark, sf_dir), B.hunks(spark, sf_dir), "branch")


@query("""
SELECT id, reason FROM (SELECT id, CASE WHEN kind IS NULL OR kind NOT IN ('force_merge', 'force_split') THEN 'unknown-kind' WHEN selector_a IS NULL OR NOT contains(selector_a, '::') THEN 'selector-a-without-separator'
  WHEN kind = 'force_merge' AND selector_b IS NULL THEN 'merge-needs-two-selectors' WHEN kind = 'force_split' AND selector_b IS NOT NULL THEN 'split-takes-one-selector'
  WHEN selector_b IS NOT NULL AND NOT contains(selector_b, '::') THEN 'selector-b-without-separator' END AS reason FROM (SELECT DISTINCT ON (id) * FROM overrides)) WHERE reason IS NOT NULL""")
def invalid_overrides(spark, sf_dir):
    return partition.invalid_overrides(B.overrides(spark, sf_dir)).select("id", "reason")


@query(f"""
SELECT plan_id, slice_label, list_sort(list(DISTINCT file_path)) AS files, list_sort(list(DISTINCT selector)) AS selectors, count(*) AS hunk_count, bool_and(qualified_symbol IS NULL) AS fallback_only FROM {_H} GROUP BY 1, 2""")
def slice_units(spark, sf_dir):
    h = B.plan_hunks(spark, sf_dir)
    m = h.select("diff_id", "hunk_index", paths.group_key().alias("selector"), F.col("slice_label").alias("slice_id"))
    return partition.slice_units(h, m).select(F.col("diff_id").alias("plan_id"), F.col("slice_id").alias("slice_label"), "files", "selectors", "hunk_count", "fallback_only")


@query("""
SELECT substr(sha1(text), 1, 12) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1""")
def content_hash_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    g = d.groupBy(F.sha1(F.col("text").cast("binary")).alias("full")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")
    return g.select(F.substring("full", 1, 12).alias("content_hash"), "copies", "first_doc")


@query("SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text)) || chr(0)) || encode(text)) AS blob FROM documents WHERE text IS NOT NULL")
def blob_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", hashes.blob_hash(F.col("text")).alias("blob"))


@query("""
WITH l AS (SELECT sha1(text) AS h, min(doc_id) AS m FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT d.doc_id, l.m AS component FROM documents d JOIN l ON sha1(d.text) = l.h""")
def components(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("h"))
    w = Window.partitionBy("h").orderBy("doc_id")
    chain = d.withColumn("b", F.lag("doc_id").over(w)).where("b is not null").select(F.lit(0).alias("scope"), F.col("doc_id").alias("a"), "b")
    return graph.components(chain).select(F.col("node").alias("doc_id"), "component")


# Edges and graphs.

_USES = f"""
w AS (SELECT DISTINCT plan_id, hunk_id AS u, file_path, unnest(regexp_extract_all(coalesce(changed_text, ''), '[A-Za-z0-9_]+')) AS word FROM {_H}),
d AS (SELECT plan_id, hunk_id AS d, file_path, exported, slice_label, CASE WHEN qualified_symbol LIKE '%.constructor' THEN string_split(qualified_symbol, '.')[-2] ELSE string_split(qualified_symbol, '.')[-1] END AS name FROM {_H} WHERE qualified_symbol IS NOT NULL),
uses AS (SELECT w.plan_id, w.u AS use_index, d.d AS def_index, d.name, d.slice_label AS dst FROM w JOIN d ON d.plan_id = w.plan_id AND d.name = w.word WHERE w.u <> d.d AND (w.file_path = d.file_path OR d.exported))
"""


@query(f"WITH {_USES} SELECT plan_id, use_index, def_index, name FROM uses")
def def_use_edges(spark, sf_dir):
    return edges.def_use(B.plan_hunks(spark, sf_dir)).withColumnRenamed("diff_id", "plan_id")


@query(f"""
WITH {_USES} SELECT uses.plan_id, h.slice_label AS src, uses.dst, count(*) AS evidence_count FROM uses JOIN {_H} h ON h.hunk_id = uses.use_index WHERE h.slice_label <> uses.dst GROUP BY 1, 2, 3""")
def slice_edges(spark, sf_dir):
    h = B.plan_hunks(spark, sf_dir)
    m = h.select("diff_id", "hunk_index", F.col("slice_label").alias("slice_id"))
    return edges.slice_edges(edges.def_use(h), m, h).select(F.col("diff_id").alias("plan_id"), "src", "dst", "evidence_count")


# Graphs: the dependencies of all manifests and the bases of all pushes, and the slices of all plans.

_REC = f"""
pr AS (SELECT 'projections:' || manifest_id AS scope, projection_id AS node, depends_on FROM {_E}), sn AS (SELECT 'stack_nodes:' || push_id AS scope, branch AS node, base FROM {_S}),
n AS (SELECT scope, node FROM pr WHERE scope IS NOT NULL AND node IS NOT NULL UNION SELECT scope, node FROM sn WHERE scope IS NOT NULL AND node IS NOT NULL),
e AS (SELECT d.scope, d.src, d.dst FROM (SELECT scope, node AS src, unnest(depends_on) AS dst FROM pr UNION SELECT scope, node, base FROM sn WHERE base <> node) d JOIN n ON n.scope = d.scope AND n.node = d.dst WHERE d.src IS NOT NULL)
"""
_REACH = "r AS (SELECT scope, src, dst FROM e UNION SELECT r.scope, r.src, e.dst FROM r JOIN e ON e.scope = r.scope AND e.src = r.dst)"
_LEVELS = """
bad AS (SELECT DISTINCT r.scope, r.src AS node FROM r WHERE src = dst UNION SELECT r.scope, r.src FROM r JOIN r c ON c.scope = r.scope AND c.src = r.dst AND c.dst = r.dst),
up AS (SELECT scope, node, 0 AS d FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.scope = n.scope AND e.src = n.node)
  UNION SELECT e.scope, e.src, up.d + 1 FROM up JOIN e ON e.scope = up.scope AND e.dst = up.node WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.scope = e.scope AND bad.node = e.src)),
lev AS (SELECT n.scope, n.node, max(d) AS level FROM n LEFT JOIN up ON up.scope = n.scope AND up.node = n.node GROUP BY 1, 2)
"""


@query(f"WITH RECURSIVE {_REC}, {_REACH} SELECT scope, src, dst FROM r")
def closure(spark, sf_dir):
    return graph.closure(B.record_edges(spark, sf_dir)).select("scope", "src", "dst")


@query(f"WITH RECURSIVE {_REC}, {_REACH}, {_LEVELS} SELECT scope, node, level FROM lev")
def levels(spark, sf_dir):
    return graph.levels(B.record_nodes(spark, sf_dir), B.record_edges(spark, sf_dir)).select("scope", "node", "level")


@query(f"""
WITH RECURSIVE {_REC}, {_REACH}
SELECT scope, src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM e m JOIN r ON r.scope = m.scope AND r.src = m.dst WHERE m.scope = e.scope AND m.src = e.src AND m.dst <> e.dst AND r.dst = e.dst)""")
def maximal_prerequisites(spark, sf_dir):
    e = B.record_edges(spark, sf_dir)
    return graph.maximal(e, graph.closure(e)).select("scope", "src", "dst")


@query(f"""
WITH RECURSIVE {_REC}, {_REACH}
SELECT a.scope, a.src AS node, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON b.scope = a.scope AND b.src = a.dst AND b.dst = a.src WHERE a.src <> a.dst GROUP BY a.scope, a.src""")
def strong_components(spark, sf_dir):
    return graph.strong_components(B.record_edges(spark, sf_dir)).select("scope", "node", "component")


@query(f"WITH {_REC} SELECT scope, string_split(src, '-')[1] AS src, string_split(dst, '-')[1] AS dst FROM e WHERE string_split(src, '-')[1] <> string_split(dst, '-')[1] GROUP BY ALL")
def quotient(spark, sf_dir):
    """Edges between the groups of names with one first word."""
    m = B.record_nodes(spark, sf_dir).withColumn("grp", F.element_at(F.split("node", "-"), 1))
    return graph.quotient(B.record_edges(spark, sf_dir), m).select("scope", "src", "dst")


@query(f"WITH {_REC} SELECT n, count(*) AS nodes FROM (SELECT scope, dst, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1")
def fanout(spark, sf_dir):
    a = graph.adjacency(B.record_edges(spark, sf_dir)).select(F.size("dependents").alias("n")).where("n > 0")
    return a.groupBy("n").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"""
WITH RECURSIVE {_REC}, {_REACH}, {_LEVELS},
p AS (SELECT lev.scope, lev.node, any_value(lev.level) AS level, coalesce(list(r.dst ORDER BY coalesce(b.level, -1), r.dst) FILTER (WHERE r.dst IS NOT NULL), []) AS prereqs
  FROM lev LEFT JOIN r ON r.scope = lev.scope AND r.src = lev.node LEFT JOIN lev b ON b.scope = r.scope AND b.node = r.dst GROUP BY 1, 2)
SELECT p.scope, p.node, array_to_string(p.prereqs, ',') AS prereqs, CASE WHEN p.level IS NULL THEN NULL WHEN len(p.prereqs) = 0 THEN 'root' WHEN list_append(q.prereqs, p.prereqs[-1]) = p.prereqs THEN 'reuse' ELSE 'integration' END AS base_kind
FROM p LEFT JOIN p q ON q.scope = p.scope AND q.node = p.prereqs[-1]""")
def base_kinds(spark, sf_dir):
    """Prerequisites in order of level and name; a node on or above a cycle has no base."""
    e = B.record_edges(spark, sf_dir)
    level = materialize(graph.levels(B.record_nodes(spark, sf_dir), e))
    full = graph.ordered_prerequisites(graph.closure(e), level.select("scope", "node", F.struct(F.coalesce("level", F.lit(-1)).alias("level"), "node").alias("rank")))
    every = level.join(full, ["scope", "node"], "left").withColumn("prereqs", F.coalesce("prereqs", F.array().cast("array<string>")))
    b = graph.bases(every).join(every, ["scope", "node"])
    return b.select("scope", "node", F.array_join("prereqs", ",").alias("prereqs"), F.when(F.col("level").isNotNull(), F.col("base_kind")).alias("base_kind"))


@query(f"""
WITH RECURSIVE {_REC}, size AS (SELECT scope, count(*) AS c FROM n GROUP BY 1),
k AS (SELECT scope, 0 AS i, list(node ORDER BY node) FILTER (WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.scope = n.scope AND e.src = n.node)) AS ord FROM n GROUP BY 1
  UNION ALL SELECT q.scope, q.i + 1, list_concat(any_value(q.ord), coalesce(list(q.m ORDER BY q.m) FILTER (WHERE q.ready), []))
  FROM (SELECT k.scope, k.i, k.ord, f.src AS m, bool_and(list_contains(k.ord[: k.i + 1], g.dst)) AS ready FROM k LEFT JOIN e f ON f.scope = k.scope AND f.dst = k.ord[k.i + 1] LEFT JOIN e g ON g.scope = f.scope AND g.src = f.src
    WHERE k.i < len(k.ord) GROUP BY k.scope, k.i, k.ord, f.src) q GROUP BY q.scope, q.i),
last AS (SELECT scope, arg_max(ord, i) AS ord FROM k GROUP BY 1)
SELECT n.scope, n.node, CASE WHEN len(last.ord) = size.c THEN list_position(last.ord, n.node) - 1 END AS topo_num FROM n JOIN size ON size.scope = n.scope LEFT JOIN last ON last.scope = n.scope""")
def kahn_order(spark, sf_dir):
    nodes = B.record_nodes(spark, sf_dir).withColumn("seq", F.col("node"))
    return graph.kahn_order(nodes, B.record_edges(spark, sf_dir).withColumn("seq", F.col("src"))).select("scope", "node", "topo_num")


_PLAN = f"{_USES}, e AS (SELECT DISTINCT uses.plan_id AS scope, h.slice_label AS src, uses.dst FROM uses JOIN {_H} h ON h.hunk_id = uses.use_index WHERE h.slice_label <> uses.dst), n AS (SELECT DISTINCT plan_id AS scope, slice_label AS node FROM {_H})"


def _plan_graph(spark, sf_dir):
    h = B.plan_hunks(spark, sf_dir)
    m = h.select("diff_id", "hunk_index", F.col("slice_label").alias("slice_id"))
    e = edges.slice_edges(edges.def_use(h), m, h).select(F.col("diff_id").alias("scope"), "src", "dst")
    return m.select(F.col("diff_id").alias("scope"), F.col("slice_id").alias("node")).distinct(), materialize(e)


@query(f"WITH RECURSIVE {_PLAN}, {_REACH}, {_LEVELS} SELECT scope AS plan_id, node, level FROM lev")
def plan_levels(spark, sf_dir):
    return graph.levels(*_plan_graph(spark, sf_dir)).select(F.col("scope").alias("plan_id"), "node", "level")


@query(f"""
WITH RECURSIVE {_PLAN}, {_REACH}
SELECT a.scope AS plan_id, a.src AS node, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON b.scope = a.scope AND b.src = a.dst AND b.dst = a.src WHERE a.src <> a.dst GROUP BY a.scope, a.src""")
def plan_cycles(spark, sf_dir):
    return graph.strong_components(_plan_graph(spark, sf_dir)[1]).select(F.col("scope").alias("plan_id"), "node", "component")


@query(f"""
WITH RECURSIVE {_PLAN}, {_REACH}, c AS (SELECT a.scope, a.src AS node, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON b.scope = a.scope AND b.src = a.dst AND b.dst = a.src WHERE a.src <> a.dst GROUP BY a.scope, a.src)
SELECT x.scope AS plan_id, x.component, (SELECT string_agg(node, ' ' ORDER BY node) FROM c m WHERE m.scope = x.scope AND m.component = x.component) AS members, count(*) AS internal_edges
FROM c x JOIN e ON e.scope = x.scope AND e.src = x.node JOIN c y ON y.scope = x.scope AND y.node = e.dst AND y.component = x.component GROUP BY 1, 2, x.scope""")
def plan_cycle_reports(spark, sf_dir):
    e = _plan_graph(spark, sf_dir)[1]
    found = graph.cycle_report(e, materialize(graph.strong_components(e)))
    return found.select(F.col("scope").alias("plan_id"), "component", F.array_join("members", " ").alias("members"), F.size("internal_edges").cast("long").alias("internal_edges"))


@query(f"""
WITH RECURSIVE n AS (SELECT push_id, node_id, branch, base FROM {_S}),
p AS (SELECT c.push_id, c.node_id, q.node_id AS parent FROM n c JOIN n q ON q.push_id = c.push_id AND q.branch = c.base AND q.branch <> c.branch),
k AS (SELECT push_id, parent, count(*) AS kids FROM p GROUP BY 1, 2),
r AS (SELECT n.push_id, n.node_id, n.node_id AS top, 0 AS pos FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.push_id = n.push_id AND p.node_id = n.node_id)
  UNION ALL SELECT r.push_id, p.node_id, r.top, r.pos + 1 FROM r JOIN p ON p.push_id = r.push_id AND p.parent = r.node_id JOIN k ON k.push_id = r.push_id AND k.parent = r.node_id AND k.kids = 1),
s AS (SELECT *, count(*) OVER (PARTITION BY push_id, top) AS size FROM r)
SELECT n.push_id, n.node_id, CASE WHEN s.size > 1 THEN s.top END AS chain_root, CASE WHEN s.size > 1 THEN s.pos END AS chain_pos, CASE WHEN s.size > 1 THEN 'chain' ELSE 'solitary' END AS placement
FROM n LEFT JOIN s ON s.push_id = n.push_id AND s.node_id = n.node_id""")
def stack_chains(spark, sf_dir):
    nodes = table(spark, sf_dir, "stack_nodes").dropDuplicates(["node_id"])
    return stacks.chains(nodes).select("push_id", "node_id", "chain_root", "chain_pos", "placement")


@query(f"""
SELECT c.push_id, c.branch, CASE WHEN p.branch <> c.branch THEN p.branch END AS parent, (SELECT count(*) FROM {_S} k WHERE k.push_id = c.push_id AND k.base = c.branch AND k.branch <> c.branch) AS child_count
FROM {_S} c LEFT JOIN {_S} p ON p.push_id = c.push_id AND p.branch = c.base""")
def base_pointers(spark, sf_dir):
    return graph.base_roots(table(spark, sf_dir, "stack_nodes").dropDuplicates(["node_id"]), "push_id")


# Joins by interval, existence and absence.

@query("""
WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate AS a, o_orderdate + INTERVAL 1 DAY * (1 + o_orderkey % 365) AS b FROM orders),
h AS (SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
j AS (SELECT DISTINCT h.l_orderkey, h.l_linenumber, h.l_partkey, h.l_suppkey, h.l_shipdate, s.o_orderkey, s.b - s.a AS span FROM h JOIN s ON s.o_custkey = h.o_custkey AND h.l_shipdate BETWEEN s.a AND s.b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, o_orderkey AS inner_order FROM j QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate ORDER BY span, o_orderkey) = 1""")
def innermost_interval(spark, sf_dir):
    from hunkweave.operators.symbols import innermost

    o = table(spark, sf_dir, "orders")
    spans = o.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("inner_order"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("a"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (1 + F.col("o_orderkey") % 365) * 86_400_000_000).alias("b"))
    lines = table(spark, sf_dir, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cust")), "l_orderkey").withColumn("at", F.unix_micros(F.col("l_shipdate").cast("timestamp")))
    return innermost(lines, spans, ["cust"], "at", "a", "b", "inner_order", ["inner_order"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"])


@query(f"""
SELECT plan_id, slice_label, file_path, owners FROM (SELECT *, count(*) OVER (PARTITION BY plan_id, file_path) AS owners FROM (SELECT DISTINCT plan_id, slice_label, file_path FROM {_H})) WHERE owners > 1""")
def shared_files(spark, sf_dir):
    """Slices that share a file, one row for each slice and file with the number of slices that own it, instead of all their pairs."""
    h = B.hunks(spark, sf_dir).select("plan_id", "file_path", "slice_label").distinct()
    many = h.groupBy("plan_id", "file_path").agg(F.count(F.lit(1)).alias("owners")).where("owners > 1")
    return h.join(many, ["plan_id", "file_path"]).select("plan_id", "slice_label", "file_path", "owners")



# Declared groupings.

_ENT = f"ent AS (SELECT manifest_id AS scope, projection_id AS projection, entry_id AS pos, * FROM {_E})"
_NAMES = f"""
sl AS (SELECT DISTINCT e.manifest_id AS scope, h.slice_label, h.selector FROM (SELECT DISTINCT manifest_id, plan_id FROM {_E}) e JOIN {_H} h ON h.plan_id = e.plan_id),
names AS (SELECT scope, selector, min(slice_label) AS slice_id FROM sl WHERE contains(selector, '::') AND NOT regexp_matches(selector, '^slice\\d+$') GROUP BY 1, 2 UNION ALL SELECT DISTINCT scope, slice_label, slice_label FROM sl),
uses AS (SELECT scope, projection, pos, 'atomic' AS kind, 0 AS k, unnest(atomic_slices) AS selector, unnest(range(1, len(atomic_slices) + 1)) AS i FROM ent UNION ALL SELECT scope, projection, pos, 'glue', 1, unnest(glue), unnest(range(1, len(glue) + 1)) FROM ent),
hits AS (SELECT u.*, n.slice_id FROM uses u JOIN names n ON n.scope = u.scope AND n.selector = u.selector),
own AS (SELECT scope, slice_id, projection AS owner FROM hits QUALIFY row_number() OVER (PARTITION BY scope, slice_id ORDER BY k, pos, i) = 1)
"""


@query(f"WITH {_ENT}, {_NAMES} SELECT u.scope, u.projection, u.selector FROM uses u WHERE u.selector IS NOT NULL AND NOT EXISTS (SELECT 1 FROM names n WHERE n.scope = u.scope AND n.selector = u.selector)")
def unknown_selectors(spark, sf_dir):
    return B.declared(spark, sf_dir).unknown_selectors().select("scope", "projection", F.col("detail").alias("selector"))


@query(f"WITH {_ENT}, {_NAMES} SELECT h.scope, h.projection, h.selector || ' ' || o.owner AS detail FROM hits h JOIN own o ON o.scope = h.scope AND o.slice_id = h.slice_id WHERE h.kind = 'atomic' AND h.projection <> o.owner")
def duplicate_assignments(spark, sf_dir):
    return B.declared(spark, sf_dir).duplicate_assignments().select("scope", "projection", "detail")


@query(f"""
WITH {_ENT}, {_NAMES}, lab AS (SELECT scope, slice_label, min(selector) AS durable FROM sl GROUP BY 1, 2)
SELECT scope, durable FROM lab WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.scope = lab.scope AND o.slice_id = lab.slice_label)""")
def unassigned_slices(spark, sf_dir):
    return B.declared(spark, sf_dir).unassigned().select("scope", F.col("detail").alias("durable"))


@query(f"""
WITH {_ENT} SELECT scope, projection, dep FROM (SELECT scope, projection, unnest(depends_on) AS dep FROM ent) d WHERE dep IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ent e WHERE e.scope = d.scope AND e.projection = d.dep)""")
def unknown_dependencies(spark, sf_dir):
    return B.declared(spark, sf_dir).unknown_dependencies().select("scope", "projection", F.col("detail").alias("dep"))


_DECL = "dec AS (SELECT DISTINCT d.scope, d.projection AS src, d.dep AS dst FROM (SELECT scope, projection, unnest(depends_on) AS dep FROM ent) d JOIN ent e ON e.scope = d.scope AND e.projection = d.dep)"


@query(f"WITH RECURSIVE {_ENT}, {_DECL}, r AS (SELECT scope, src, dst FROM dec UNION SELECT r.scope, r.src, d.dst FROM r JOIN dec d ON d.scope = r.scope AND d.src = r.dst) SELECT DISTINCT scope FROM r WHERE src = dst")
def manifest_cycles(spark, sf_dir):
    return B.declared(spark, sf_dir).cycles().select("scope")


@query(f"""
WITH RECURSIVE {_ENT}, {_NAMES}, {_DECL}, r AS (SELECT scope, src, dst FROM dec UNION SELECT r.scope, r.src, d.dst FROM r JOIN dec d ON d.scope = r.scope AND d.src = r.dst)
SELECT h.scope, h.projection, o.owner FROM hits h JOIN own o ON o.scope = h.scope AND o.slice_id = h.slice_id WHERE h.kind = 'glue' AND h.projection <> o.owner
  AND NOT EXISTS (SELECT 1 FROM r WHERE r.scope = h.scope AND r.src = h.projection AND r.dst = o.owner)""")
def unreachable_glue(spark, sf_dir):
    return B.declared(spark, sf_dir).unreachable_glue().select("scope", "projection", F.col("detail").alias("owner"))


@query(f"""
WITH {_ENT}, {_NAMES}, u AS (SELECT o.scope, o.owner, count(DISTINCT h.file_path) AS f, count(*) AS n, sum({_LINES.format(t='h.raw')}) AS l
  FROM own o JOIN (SELECT DISTINCT manifest_id, plan_id FROM {_E}) m ON m.manifest_id = o.scope JOIN {_H} h ON h.plan_id = m.plan_id AND h.slice_label = o.slice_id GROUP BY 1, 2)
SELECT e.scope, e.projection, concat_ws(', ', CASE WHEN f > 4 THEN 'files' END, CASE WHEN n > 6 THEN 'hunks' END, CASE WHEN l > 60 THEN 'changed lines' END) AS over
FROM ent e JOIN u ON u.scope = e.scope AND u.owner = e.projection WHERE (f > 4 OR n > 6 OR l > 60) AND coalesce(e.oversize_reason, '') = ''""")
def oversize(spark, sf_dir):
    return B.declared(spark, sf_dir).oversize().select("scope", "projection", F.col("detail").alias("over"))


@query(f"WITH {_ENT} SELECT scope, projection FROM ent WHERE trim(coalesce(intent, '')) = ''")
def missing_intents(spark, sf_dir):
    return B.declared(spark, sf_dir).intents().select("scope", "projection")


@query(f"""
WITH {_ENT}, x AS (SELECT *, coalesce(verification_profile, '') <> '' AS named, coalesce(len(verification), 0) > 0 AS inl FROM ent)
SELECT scope, projection, 'verification-profile-conflict' AS code FROM x WHERE named AND inl UNION ALL SELECT scope, projection, 'unknown-verification-profile' FROM x WHERE named AND NOT inl AND verification_profile NOT IN ('unit', 'default')
UNION ALL SELECT scope, projection, 'no-verification' FROM x WHERE NOT named AND NOT inl AND coalesce(verification_reason, '') = ''""")
def verification_findings(spark, sf_dir):
    return B.declared(spark, sf_dir).verification().select("scope", "projection", "code")


@query(f"SELECT plan_id AS scope, projection_id AS projection FROM {_E} GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    """Ids that come more than once in the manifests of one plan taken together; within one manifest they are unique here."""
    d = B.declared(spark, sf_dir)
    d.entries = B.entries(spark, sf_dir).select(F.col("plan_id").alias("scope"), F.col("projection_id").alias("projection"))
    return d.duplicate_ids().select("scope", "projection")



# Scores.

def _scored(spark, sf_dir):
    h = B.plan_hunks(spark, sf_dir).withColumn("selector", paths.group_key())
    actual = F.element_at(F.split("file_path", "/"), 1)
    units = h.select(F.col("diff_id").alias("scope"), "hunk_index", "selector", F.col("qualified_symbol").isNull().alias("is_fallback"), actual.alias("actual"), F.ascii(actual).alias("act_rank"))
    declared = h.groupBy(F.col("diff_id").alias("scope"), "selector").agg(F.min("slice_label").alias("unit")).withColumn("unit_pos", F.regexp_extract("unit", r"(\d+)$", 1).cast("int"))
    return score.score_hunks(units, declared), declared


_SC = f"""
h AS (SELECT plan_id AS scope, hunk_id, selector, qualified_symbol IS NULL AS fb, string_split(file_path, '/')[1] AS actual, slice_label FROM {_H}),
x AS (SELECT scope, selector, min(slice_label) AS expected FROM h GROUP BY 1, 2),
sc AS (SELECT h.scope, h.actual, x.expected FROM h JOIN x ON x.scope = h.scope AND x.selector = h.selector WHERE NOT fb)
"""


@query(f"WITH {_SC} SELECT scope, expected, actual, count(*) AS hunks FROM sc GROUP BY 1, 2, 3")
def contingency(spark, sf_dir):
    return score.contingency(_scored(spark, sf_dir)[0].where("role = 'scored'")).select("scope", "expected", "actual", "hunks")


_MATCH = f"""
{_SC},
pos AS (SELECT scope, expected, min(TRY_CAST(regexp_extract(expected, '(\\d+)$', 1) AS INT)) AS exp_pos FROM x GROUP BY 1, 2),
pair AS (SELECT sc.scope, sc.expected, sc.actual, count(*) AS hunks, min(pos.exp_pos) AS exp_pos, min(ascii(sc.actual)) AS act_rank FROM sc JOIN pos ON pos.scope = sc.scope AND pos.expected = sc.expected GROUP BY 1, 2, 3),
place AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY hunks DESC, exp_pos NULLS LAST, act_rank, expected, actual) AS p FROM pair),
g AS (SELECT scope, expected, actual, hunks, p, [expected] AS es, [actual] AS ac FROM place WHERE p = 1
  UNION ALL SELECT n.scope, n.expected, n.actual, n.hunks, n.p, list_append(n.es, n.expected), list_append(n.ac, n.actual) FROM (
    SELECT g.es, g.ac, q.*, row_number() OVER (PARTITION BY g.scope ORDER BY q.p) AS r FROM g JOIN place q ON q.scope = g.scope AND q.p > g.p AND NOT list_contains(g.es, q.expected) AND NOT list_contains(g.ac, q.actual)) n WHERE r = 1),
role AS (SELECT h.*, x.expected, CASE WHEN fb THEN 'excluded-fallback' ELSE 'scored' END AS role FROM h JOIN x ON x.scope = h.scope AND x.selector = h.selector)
"""


@query(f"WITH RECURSIVE {_MATCH} SELECT scope, expected, actual, hunks FROM g")
def greedy_match(spark, sf_dir):
    return score.greedy_match(score.contingency(_scored(spark, sf_dir)[0].where("role = 'scored'")))


@query(f"""
WITH RECURSIVE {_MATCH}, s AS (SELECT role.scope, count(*) FILTER (WHERE role = 'scored') AS scored, count(*) FILTER (WHERE role = 'scored' AND role.actual = g.actual) AS agreed, CAST(0 AS BIGINT) AS unscored,
  count(*) FILTER (WHERE role = 'excluded-fallback') AS excluded FROM role LEFT JOIN g ON g.scope = role.scope AND g.expected = role.expected GROUP BY 1)
SELECT *, CASE WHEN scored > 0 THEN agreed / scored ELSE 0.0 END AS agreement, scored > 0 AND agreed / scored >= 2.0 / 3 AS pass FROM s""")
def agreement(spark, sf_dir):
    return score.agreement(_scored(spark, sf_dir)[0], 2 / 3)


@query(f"""
WITH RECURSIVE {_MATCH}, u AS (SELECT DISTINCT scope, expected AS unit FROM x)
SELECT u.scope, u.unit, g.actual AS matched, CAST(coalesce((SELECT sum(hunks) FROM pair p WHERE p.scope = u.scope AND p.expected = u.unit), 0) AS BIGINT) AS hunks, coalesce(g.hunks, 0) AS agreed,
  coalesce((SELECT string_agg(actual, ' ' ORDER BY act_rank, actual) FROM pair p WHERE p.scope = u.scope AND p.expected = u.unit), '') AS spread
FROM u LEFT JOIN g ON g.scope = u.scope AND g.expected = u.unit""")
def unit_scores(spark, sf_dir):
    hunk_rows, declared = _scored(spark, sf_dir)
    return score.unit_scores(hunk_rows, declared).select("scope", "unit", "matched", "hunks", "agreed", F.array_join("spread", " ").alias("spread"))


@query(f"""
WITH RECURSIVE {_MATCH}
SELECT role.scope, role.selector, min(role.expected) AS expected, arg_min(role.actual, [ascii(role.actual), role.hunk_id]) AS actual, count(*) AS hunks
FROM role LEFT JOIN g ON g.scope = role.scope AND g.expected = role.expected WHERE role = 'scored' AND g.actual IS DISTINCT FROM role.actual GROUP BY 1, 2""")
def disagreements(spark, sf_dir):
    return score.disagreements(_scored(spark, sf_dir)[0]).drop("position")


# State, caches and decisions.

@query("""
SELECT branch, slice_signature, content_hash, base_ref, snapshot_no FROM correspondence
QUALIFY row_number() OVER (PARTITION BY branch, slice_signature ORDER BY snapshot_no DESC, updated_at DESC NULLS LAST, content_hash DESC NULLS LAST, base_ref DESC NULLS LAST) = 1""")
def latest_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "correspondence").select("branch", "slice_signature", "snapshot_no", "updated_at", "content_hash", "base_ref")
    return latest(c, ["branch", "slice_signature"], "snapshot_no", "updated_at").select("branch", "slice_signature", "content_hash", "base_ref", "snapshot_no")


@query("SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_write_wins(spark, sf_dir):
    return earliest(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "value", "event_id")


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'squash-merged' WHEN p IS NOT NULL AND p = round(value) THEN 'unchanged' WHEN user_id % 5 = 0 THEN 'dry-run' WHEN p IS NOT NULL THEN 'updated' ELSE 'created' END AS status
FROM (SELECT *, lag(round(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)""")
def unit_status(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("p", F.lag(F.round("value")).over(w))
    return e.select("event_id", reconcile.unit_status(F.col("event_type") == "error", F.col("p"), F.col("p").isNotNull(), F.round("value"), F.col("user_id") % 5 == 0).alias("status"))


@query("""
WITH k AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS next_no FROM (SELECT DISTINCT snapshot_no FROM correspondence WHERE snapshot_no IS NOT NULL)),
s AS (SELECT c.snapshot_no, k.next_no, branch, slice_signature, commit_sha, adopted, slice_branch FROM correspondence c JOIN k ON k.snapshot_no = c.snapshot_no AND k.next_no IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY c.snapshot_no, branch, slice_signature ORDER BY updated_at DESC NULLS LAST, id DESC NULLS LAST, commit_sha DESC NULLS LAST, adopted DESC NULLS LAST, slice_branch DESC NULLS LAST) = 1),
h AS (SELECT snapshot_no, slice_branch, max(commit_sha) AS sha FROM correspondence WHERE slice_branch IS NOT NULL AND commit_sha IS NOT NULL GROUP BY 1, 2)
SELECT s.snapshot_no, s.next_no, s.branch, s.slice_signature, CASE WHEN s.commit_sha IS NULL THEN NULL WHEN h.sha IS NULL THEN 'missing' WHEN h.sha <> s.commit_sha THEN 'moved' END AS drift,
  CASE WHEN s.commit_sha IS NULL THEN 'unchanged' WHEN h.sha IS NULL THEN CASE WHEN adopted THEN 'blocked' ELSE 'updated' END WHEN h.sha <> s.commit_sha THEN 'blocked' ELSE 'unchanged' END AS status
FROM s LEFT JOIN h ON h.slice_branch = s.slice_branch AND h.snapshot_no = s.next_no""")
def drift(spark, sf_dir):
    """Every delivered snapshot against the next one."""
    c = table(spark, sf_dir, "correspondence")
    numbers = c.select("snapshot_no").where("snapshot_no is not null").distinct()
    following = numbers.select("snapshot_no", F.lead("snapshot_no").over(Window.orderBy("snapshot_no")).alias("next_no")).where("next_no is not null")
    rows = latest(c.select("snapshot_no", "branch", "slice_signature", "updated_at", "id", "commit_sha", "adopted", "slice_branch"), ["snapshot_no", "branch", "slice_signature"], "updated_at", "id").join(F.broadcast(following), "snapshot_no")
    units = rows.select("snapshot_no", "next_no", "branch", "slice_signature", F.struct(F.col("next_no").alias("no"), F.col("slice_branch").alias("name")).alias("branch_name"), F.lit("unchanged").alias("status"), F.col("commit_sha").alias("stored_sha"), "adopted")
    heads = c.where("slice_branch is not null and commit_sha is not null").groupBy(F.struct(F.col("snapshot_no").alias("no"), F.col("slice_branch").alias("name")).alias("branch_name")).agg(F.max("commit_sha").alias("remote_sha"))
    return reconcile.drift(units, heads).select("snapshot_no", "next_no", "branch", "slice_signature", "drift", "status")


@query("""
SELECT event_id, coalesce(last_value(CASE WHEN event_type <> 'error' THEN CAST(event_id AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'main') AS base FROM events""")
def running_base(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("rank"), F.col("event_id").cast("string").alias("branch_name"), F.when(F.col("event_type") == "error", "blocked").otherwise("created").alias("status"))
    return reconcile.running_base(e, F.lit("main"), "user_id").select("event_id", "base")


@query("""
SELECT id, min(CASE WHEN slice_count = hunk_count AND duration_ms > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY branch ORDER BY started_at, id ROWS UNBOUNDED PRECEDING) = 1 AS cached FROM (SELECT DISTINCT ON (id) * FROM timing_runs)""")
def prefix_cache(spark, sf_dir):
    r = table(spark, sf_dir, "timing_runs").dropDuplicates(["id"])
    steps = r.select("branch", "id", F.struct("started_at", "id").alias("rank"), F.col("slice_count").alias("content_hash"), F.col("hunk_count").alias("cached_hash"), F.coalesce(F.col("duration_ms") > 0, F.lit(False)).alias("cached_passed"))
    return reconcile.unchanged_prefix(steps, "branch").select("id", "cached")


@query("""
SELECT event_id FROM (SELECT event_id, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM events) WHERE f = 0""")
def until_failure(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("pos"), (F.col("event_type") != "error").alias("passed"))
    return reconcile.until_failure(e, ["user_id"]).select("event_id")


@query("""
WITH a AS (SELECT user_id, list(event_type ORDER BY ts, event_id)[:2] AS x, list(event_type ORDER BY event_id) AS y FROM events GROUP BY 1) SELECT user_id, x = y[:len(x)] AS is_prefix FROM a""")
def is_prefix(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("a"), F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("b"))
    x, y = F.slice(F.transform("a", lambda s: s["event_type"]), 1, 2), F.transform("b", lambda s: s["event_type"])
    return g.select("user_id", stacks.is_prefix(x, y).alias("is_prefix"))


@query(r"""
SELECT doc_id, max(CASE WHEN regexp_matches(text, '(^|[\n\r\x{2028}\x{2029}])Change-Id: I[0-9a-f]{40}($|[\n\r\x{2028}\x{2029}])') THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY created_at, doc_id ROWS UNBOUNDED PRECEDING) = 1 AS rewrite
FROM documents WHERE doc_kind = 'commit_message' AND text IS NOT NULL""")
def change_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_kind = 'commit_message' and text is not null").select("source", "doc_id", F.struct("created_at", "doc_id").alias("pos"), F.col("doc_id").cast("string").alias("sha"), F.col("text").alias("message"))
    return reconcile.change_ids(d, "source").select("doc_id", "rewrite")


@query(r"""
SELECT doc_id AS comment_id, substr(coalesce(list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ') <> '')[1], ''), 1, 120) AS excerpt FROM documents WHERE doc_kind = 'review_comment' AND text IS NOT NULL""")
def thread_excerpts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_kind = 'review_comment' and text is not null")
    c = d.select(F.col("doc_id").alias("comment_id"), F.col("source").alias("path"), F.lit(1).alias("line"), F.lit(1).alias("original_line"), F.lit(None).cast("long").alias("in_reply_to"), F.col("text").alias("body"))
    return reconcile.threads(c).select("comment_id", "excerpt")


@query("""
WITH t AS (SELECT doc_id AS projection, sha1(text) AS tree FROM documents WHERE doc_kind = 'pr_body' AND text IS NOT NULL), b AS (SELECT doc_id AS pr_number, sha1(text) AS tree FROM documents WHERE doc_kind = 'review_comment' AND text IS NOT NULL)
SELECT t.projection, b.pr_number, CASE WHEN b.pr_number IS NULL THEN 'none' ELSE 'exact-tree' END AS evidence, count(b.pr_number) OVER (PARTITION BY t.projection) > 1 AS ambiguous FROM t LEFT JOIN b ON b.tree = t.tree""")
def adoption_candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").withColumn("tree", F.sha1(F.col("text").cast("binary")))
    targets = d.where("doc_kind = 'pr_body'").select(F.col("doc_id").alias("projection"), "tree", F.lit(None).cast("string").alias("own_tree"))
    return reconcile.adoption_candidates(targets, d.where("doc_kind = 'review_comment'").select(F.col("doc_id").alias("pr_number"), "tree"))


def chains_and_stacks(spark, sf_dir):
    """The chain of each push without adopted branches, each push as a stack, and the nodes of both."""
    n = table(spark, sf_dir, "stack_nodes").dropDuplicates(["node_id"]).where("push_id is not null")
    pairs = F.array_sort(F.collect_list(F.struct("node_id", "pr_number")))
    wanted = n.where("not adopted").groupBy(F.col("push_id").alias("chain_id")).agg(F.transform(pairs, lambda p: p["pr_number"]).alias("prs"))
    held = n.groupBy(F.col("push_id").alias("stack_number")).agg(F.transform(pairs, lambda p: F.struct(p["pr_number"].alias("number"), F.lit("open").alias("state"), F.lit(False).alias("merged"))).alias("prs"))
    return wanted, held, n


@query(f"""
WITH c AS (SELECT push_id, list(pr_number ORDER BY node_id) AS prs FROM {_S} WHERE adopted = false AND push_id IS NOT NULL GROUP BY 1), o AS (SELECT push_id AS stack_number, list(pr_number ORDER BY node_id) AS prs FROM {_S} WHERE push_id IS NOT NULL GROUP BY 1),
h AS (SELECT c.push_id, count(DISTINCT o.stack_number) AS n, min(o.stack_number) AS s FROM (SELECT push_id, unnest(prs) AS pr FROM c) c JOIN (SELECT stack_number, unnest(prs) AS pr FROM o) o ON o.pr = c.pr AND o.stack_number < c.push_id GROUP BY 1)
SELECT c.push_id AS chain_id, CASE WHEN h.n IS NULL THEN 'created' WHEN h.n > 1 THEN 'diverged' WHEN len(c.prs) <= len(o.prs) AND o.prs[:len(c.prs)] = c.prs THEN 'unchanged' WHEN len(o.prs) <= len(c.prs) AND c.prs[:len(o.prs)] = o.prs THEN 'extended' ELSE 'diverged' END AS link_status
FROM c LEFT JOIN h ON h.push_id = c.push_id LEFT JOIN o ON o.stack_number = h.s""")
def stack_links(spark, sf_dir):
    """Every push's chain against the stacks of all earlier pushes."""
    wanted, held, _ = chains_and_stacks(spark, sf_dir)
    return stacks.plan_links(wanted, held, earlier=True).select("chain_id", "link_status")



@query("SELECT command, count(*) AS run_count FROM (SELECT DISTINCT ON (id) * FROM timing_runs) GROUP BY 1")
def command_counts(spark, sf_dir):
    return table(spark, sf_dir, "timing_runs").dropDuplicates(["id"]).groupBy("command").agg(F.count(F.lit(1)).alias("run_count"))


def _plan_overrides(spark, sf_dir):
    """Overrides of a branch under every plan of the branch that has the selectors they name; under the others they change nothing."""
    h = materialize(B.hunks(spark, sf_dir).select("branch", F.col("plan_id").alias("diff_id"), paths.group_key().alias("selector")).distinct())
    known = h.select("diff_id", "selector").distinct()
    named = h.select("branch", "diff_id").distinct().join(known, "diff_id").withColumnRenamed("selector", "selector_a")
    held = B.overrides(spark, sf_dir).select("branch", "kind", "selector_a", "selector_b").distinct().join(named, ["branch", "selector_a"]).select("diff_id", "kind", "selector_a", "selector_b")
    merges = held.where("kind = 'force_merge'").join(known.withColumnRenamed("selector", "selector_b"), ["diff_id", "selector_b"], "left_semi")
    return materialize(held.where("kind = 'force_split'").unionByName(merges))


def _review(spark, sf_dir, overrides=None):
    from hunkweave.plans.review import relate

    h = materialize(B.plan_hunks(spark, sf_dir).select("diff_id", "hunk_index", "file_path", "changed_text", "qualified_symbol", "exported", "fallback_selector", "fallback_reason"))
    plan = relate(h, h.where("false"), h.where("false"), overrides).settle("order")
    sound = plan.order.groupBy("diff_id").agg(F.bool_and(F.col("topo_num").isNotNull()).alias("ok")).where("ok").select("diff_id")
    plan.units, plan.edges = plan.units.join(sound, "diff_id", "left_semi"), plan.edges.join(sound, "diff_id", "left_semi")
    return plan


@query()
def review_units(spark, sf_dir):
    """Coarsened units of every plan whose slice graph has no cycle, with the overrides of its branch: forced merges and splits, slices of split selectors pinned."""
    return _review(spark, sf_dir, _plan_overrides(spark, sf_dir)).coarse(12)


@query(f"""
WITH RECURSIVE {_USES}, x AS (SELECT DISTINCT h.plan_id AS scope, h.selector AS src, g.selector AS dst FROM uses JOIN {_H} h ON h.hunk_id = uses.use_index JOIN {_H} g ON g.hunk_id = uses.def_index WHERE h.selector <> g.selector),
r AS (SELECT scope, src, dst FROM x UNION SELECT r.scope, r.src, x.dst FROM r JOIN x ON x.scope = r.scope AND x.src = r.dst), bad AS (SELECT DISTINCT scope FROM r WHERE src = dst)
SELECT plan_id, count(DISTINCT selector) AS slices, count(*) AS hunks, true AS each_once, true AS acyclic, true AS cap_held FROM {_H} WHERE plan_id NOT IN (SELECT scope FROM bad) GROUP BY 1""")
def review_unit_checks(spark, sf_dir):
    """What must hold of the units of every plan: each slice and hunk in one of them, no cycle between them, none over the size cap by directories alone."""
    plan = _review(spark, sf_dir)
    units = materialize(plan.coarse(12))
    cap = units.groupBy("diff_id").agg((F.greatest(F.lit(1), F.ceil(F.sum("hunk_count") / 12) * 2)).alias("cap"))
    only = F.forall("rules", lambda r: r.startswith("directory-affinity:"))
    within = units.join(cap, "diff_id").groupBy("diff_id").agg(F.bool_and((F.col("hunk_count") <= F.col("cap")) | ~only | (F.size("slice_ids") == 1)).alias("cap_held"))
    each = units.select("diff_id", F.explode("slice_ids").alias("s")).groupBy("diff_id").agg(F.count_distinct("s").alias("slices"), F.count(F.lit(1)).alias("_n"))
    links = units.select(F.col("diff_id").alias("scope"), F.col("unit_num").alias("src"), F.explode("prerequisites").alias("dst"))
    cyclic = graph.strong_components(links).select(F.col("scope").alias("diff_id"), F.lit(True).alias("_c")).distinct()
    hunks = units.groupBy("diff_id").agg(F.sum("hunk_count").alias("hunks"))
    joined = hunks.join(each, "diff_id").join(within, "diff_id").join(cyclic, "diff_id", "left")
    return joined.select(F.col("diff_id").alias("plan_id"), "slices", "hunks", (F.col("_n") == F.col("slices")).alias("each_once"), F.col("_c").isNull().alias("acyclic"), "cap_held")



def _rebuilt(d):
    lines = F.split("content", "\n", -1)
    full = F.concat(F.lit("@@ -0,0 +1,"), F.size(lines).cast("string"), F.lit(" @@\n+"), F.array_join(lines, "\n+"), F.lit("\n\\ No newline at end of file\n"))
    steps = d.select("scope", "path", F.lit(0).alias("step"), F.lit(0).alias("hunk_index"), full.alias("raw"))
    return apply.rebuild_check(d.where("false"), steps, d).select("scope", "rebuilt", "same")


@query("""
SELECT DISTINCT doc_id AS scope, sha1(encode('tree 35' || chr(0) || '100644 message' || chr(0)) || unhex(sha1(encode('blob ' || octet_length(encode(text)) || chr(0)) || encode(text)))) AS rebuilt, true AS same FROM documents WHERE text IS NOT NULL""")
def rebuild_text(spark, sf_dir):
    """Every text taken apart into one hunk and applied again: the rebuilt tree's id against that of the text itself."""
    d = table(spark, sf_dir, "documents").where("text is not null").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("scope"), F.lit("message").alias("path"), F.col("text").alias("content"), F.lit("100644").alias("mode"))
    return _rebuilt(materialize(d))
