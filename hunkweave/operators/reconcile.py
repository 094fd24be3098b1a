"""What a push, a build or a comment pass would do, as decision rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkweave.functions.hashes import short_sha

# Fixed value: a line that is a change id and nothing else; a line ends at a line feed, a carriage return or a Unicode separator.
TRAILER = r"(?<![^\n\r\u2028\u2029])Change-Id: I[0-9a-f]{40}(?![^\n\r\u2028\u2029])"


def unit_status(merged: Column, stored_hash: Column, exists: Column, new_hash: Column, dry_run: Column) -> Column:
    """squash-merged, else unchanged, else dry-run, else updated or created."""
    same = exists & F.coalesce(stored_hash == new_hash, F.lit(False))
    return F.when(merged, "squash-merged").when(same, "unchanged").when(dry_run, "dry-run").when(exists, "updated").otherwise("created")


def drift(units: DataFrame, heads: DataFrame | None, reclaim: bool = False, dry_run: bool = False) -> DataFrame:
    """Units with what the remote says about their branch: drift, action status and the head a push would expect.

    ``units``: (…, branch_name, status, stored_sha, adopted), ``heads``: (branch_name, remote_sha) or None where the remote could
    not be read. A moved branch is blocked unless it is our own and reclaimed; a missing adopted branch is blocked, an own
    one made again; either makes an unchanged unit a push again.
    """
    recorded = F.col("stored_sha").isNotNull() & (F.col("status") != "squash-merged")
    if heads is None:
        return units.withColumn("drift", F.when(recorded, "unread")).withColumn("expected_sha", F.col("stored_sha"))
    joined = units.join(heads.select("branch_name", "remote_sha"), "branch_name", "left")
    seen = F.when(~recorded, None).when(F.col("remote_sha").isNull(), "missing").when(F.col("remote_sha") != F.col("stored_sha"), "moved")
    blocked = F.coalesce(((seen == "moved") & (F.col("adopted") | F.lit(not reclaim))) | ((seen == "missing") & F.col("adopted")), F.lit(False))
    again = F.when(seen.isNotNull() & (F.col("status") == "unchanged"), F.lit("dry-run" if dry_run else "updated")).otherwise(F.col("status"))
    expected = F.when(seen == "missing", None).when((seen == "moved") & F.lit(reclaim), F.col("remote_sha")).otherwise(F.col("stored_sha"))
    return joined.select(*units.columns, seen.alias("drift"), expected.alias("expected_sha"), F.when(blocked, "blocked").otherwise(again).alias("action")).drop("status").withColumnRenamed("action", "status")


def running_base(units: DataFrame, base_branch: Column, scope: str = "scope") -> DataFrame:
    """Units with ``base``: the branch of the last unit before them that is neither dropped nor blocked, else the base branch."""
    w = Window.partitionBy(scope).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    stays = F.when(~F.col("status").isin("squash-merged", "blocked"), F.col("branch_name"))
    return units.withColumn("base", F.coalesce(F.last(stays, True).over(w), base_branch))


def flat_bases(units: DataFrame, base_branch: str, scope: str = "scope", reviewable: bool = False) -> DataFrame:
    """Units with base, hidden_base and block note by base kind; a base that was merged already falls to the base branch.

    ``units``: (scope, unit, branch_name, base_kind, base_unit, error, status).
    """
    below = units.select(scope, F.col("unit").alias("base_unit"), F.col("branch_name").alias("_b"), (F.col("status") == "squash-merged").alias("_gone"))
    joined = units.join(below, [scope, "base_unit"], "left")
    made = F.col("base_kind") == "integration"
    base = F.when(made, F.concat("branch_name", F.lit("-base"))).when((F.col("base_kind") == "reuse") & ~F.coalesce("_gone", F.lit(False)), F.col("_b")).otherwise(F.lit(base_branch))
    note = F.when(F.col("error").isNotNull(), F.col("error")).when(made & F.lit(reviewable), "needs a generated base that has no pull request")
    return joined.select(*units.columns, base.alias("base"), (made & (F.col("status") != "squash-merged")).alias("hidden_base"), note.alias("block_note"))


def unchanged_prefix(steps: DataFrame, scope: str = "scope") -> DataFrame:
    """Steps with ``cached``: True while every step up to this one has passed before with the same content.

    ``steps``: (scope, rank, content_hash, cached_hash, cached_passed).
    """
    hit = F.coalesce((F.col("content_hash") == F.col("cached_hash")) & F.col("cached_passed"), F.lit(False))
    w = Window.partitionBy(scope).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("cached", F.min(hit.cast("int")).over(w) == 1)


def verification_plan(commands: DataFrame, cache: DataFrame) -> DataFrame:
    """Commands with ``cached``: only a pass on the same tree counts. Keys (branch, projection, command)."""
    known = cache.select("branch", "projection", "command", F.col("tree_hash").alias("_tree"), "passed")
    return commands.join(known, ["branch", "projection", "command"], "left").withColumn("cached", F.coalesce(F.col("passed") & (F.col("_tree") == F.col("tree_hash")), F.lit(False))).drop("_tree", "passed")


def until_failure(runs: DataFrame, scope: list[str]) -> DataFrame:
    """The runs up to and with the first that fails in each scope. ``runs``: (scope…, pos, passed)."""
    before = Window.partitionBy(*scope).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("_f", F.coalesce(F.sum((~F.col("passed")).cast("int")).over(before), F.lit(0))).where("_f = 0").drop("_f")


def local_status(units: DataFrame, force: bool = False) -> DataFrame:
    """Units with ``local_status`` from (ref_tree, tree): created, unchanged, updated or blocked; no tree, no status."""
    status = F.when(F.col("ref_tree").isNull(), "created").when(F.col("ref_tree") == F.col("tree"), "unchanged").otherwise("updated" if force else "blocked")
    return units.withColumn("local_status", F.when(F.col("tree").isNotNull(), status))


def build_outcome(enabled: Column, command: Column) -> Column:
    return F.when(~enabled, "disabled").when(command.isNull(), "no-command").otherwise("ran")


def comment_actions(comments: DataFrame, old_hunks: DataFrame, new_hunks: DataFrame, processed: DataFrame) -> DataFrame:
    """(comment_id, anchor): unchanged where the commented hunk, header line included, is still in the file, else orphaned.

    Only top-level comments on the new side, in files of the unit, not handled before and inside an old hunk. Keys by (unit).
    ``comments``: (unit, comment_id, path, line, original_line, side, in_reply_to), hunks: (unit, path, hunk_index, new_start, new_lines, raw).
    """
    files = new_hunks.select("unit", "path").distinct()
    todo = (
        comments.where(F.col("in_reply_to").isNull() & (F.col("side") == "RIGHT")).join(files, ["unit", "path"], "left_semi")
        .join(processed.select("comment_id"), "comment_id", "left_anti").withColumn("_at", F.coalesce("original_line", "line"))
    )
    c, h = todo.alias("c"), old_hunks.alias("h")
    last = F.col("h.new_start") + F.greatest(F.col("h.new_lines"), F.lit(1)) - 1
    inside = (F.col("c.unit") == F.col("h.unit")) & (F.col("c.path") == F.col("h.path")) & F.col("c._at").between(F.col("h.new_start"), last)
    held = c.join(h, inside).groupBy("c.unit", "c.comment_id", "c.path").agg(F.min_by("h.raw", "h.hunk_index").alias("raw")).withColumn("hash", short_sha(F.col("raw")))
    now = new_hunks.select("unit", "path", short_sha(F.col("raw")).alias("hash")).distinct().withColumn("_still", F.lit(True))
    return held.join(now, ["unit", "path", "hash"], "left").select("unit", "comment_id", F.when(F.col("_still"), "unchanged").otherwise("orphaned").alias("anchor"))


def review_state(projections: DataFrame) -> DataFrame:
    """Rows with ``state``: never-pushed, unchanged, changed, unknown or not-materializable. Columns: error, exists, stored_sha, stored_tree, tree."""
    state = (
        F.when(F.col("error").isNotNull() | F.col("tree").isNull(), "not-materializable").when(~F.col("exists"), "never-pushed")
        .when(F.col("stored_sha").isNull() | F.col("stored_tree").isNull(), "unknown").when(F.col("stored_tree") == F.col("tree"), "unchanged").otherwise("changed")
    )
    return projections.withColumn("state", state)


def changed_selectors(changed_files: DataFrame, unit_hunks: DataFrame) -> DataFrame:
    """(unit, changed_files, changed_selectors), sorted, from (unit, path) and (unit, path, selector)."""
    files = changed_files.groupBy("unit").agg(F.array_sort(F.collect_set("path")).alias("changed_files"))
    keys = unit_hunks.join(changed_files.distinct(), ["unit", "path"], "left_semi").groupBy("unit").agg(F.array_sort(F.collect_set("selector")).alias("changed_selectors"))
    return files.join(keys, "unit", "left")


def threads(comments: DataFrame) -> DataFrame:
    """(comment_id, path, at_line, replies, excerpt) of the top-level comments; the excerpt is the first line that is not blank, 120 signs long."""
    replies = comments.where(F.col("in_reply_to").isNotNull()).groupBy(F.col("in_reply_to").alias("comment_id")).agg(F.count(F.lit(1)).alias("replies"))
    first = F.try_element_at(F.filter(F.split("body", "\n"), lambda l: F.trim(l) != ""), F.lit(1))
    return comments.where(F.col("in_reply_to").isNull()).join(replies, "comment_id", "left").select(
        "comment_id", "path", F.coalesce("line", "original_line").alias("at_line"), F.coalesce("replies", F.lit(0)).alias("replies"), F.substring(F.coalesce(first, F.lit("")), 1, 120).alias("excerpt")
    )


def review_context(projections: DataFrame, store: DataFrame, comments: DataFrame, anchors: DataFrame, stacks: DataFrame) -> DataFrame:
    """One wide row per projection: stored state, base agreement, open threads, orphaned anchors and stack position.

    projections (branch, unit, signature, tree, error, manifest_base), store (branch, signature, slice_branch, pr_number, commit_sha, stored_tree, base_ref, adopted),
    comments (pr_number, comment_id, in_reply_to), anchors (branch, signature, anchor), stacks (pr_number, stack_number, position).
    """
    s = store.select("branch", "signature", "slice_branch", "pr_number", F.col("commit_sha").alias("stored_sha"), "stored_tree", "base_ref", "adopted", F.lit(True).alias("exists"))
    talk = comments.groupBy("pr_number").agg(F.count_if(F.col("in_reply_to").isNull()).alias("threads"), F.count_if(F.col("in_reply_to").isNotNull()).alias("replies"))
    lost = anchors.where("anchor = 'orphaned'").groupBy("branch", "signature").agg(F.count(F.lit(1)).alias("orphaned_anchors"))
    joined = projections.join(s, ["branch", "signature"], "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    wide = joined.join(talk, "pr_number", "left").join(lost, ["branch", "signature"], "left").join(stacks, "pr_number", "left")
    return review_state(wide).withColumn("base_agrees", F.when(F.col("exists"), F.col("base_ref").eqNullSafe(F.col("manifest_base")))).fillna(0, ["threads", "replies", "orphaned_anchors"])


def change_ids(commits: DataFrame, scope: str = "scope") -> DataFrame:
    """Commits with ``rewrite`` and ``new_message``: one without a trailer gets one, and all after it get a new parent.

    ``commits``: (scope, pos, sha, message). The id made here comes from the commit's own sha, so a second run makes the same.
    """
    has = F.col("message").rlike(TRAILER)
    w = Window.partitionBy(scope).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    made = F.concat(F.regexp_replace("message", r"\n+$", ""), F.lit("\n\nChange-Id: I"), F.sha1(F.col("sha").cast("binary")), F.lit("\n"))
    return commits.withColumn("rewrite", F.max((~has).cast("int")).over(w) == 1).withColumn("new_message", F.when(has, F.col("message")).otherwise(made))


def adoption_findings(checks: DataFrame, store: DataFrame) -> DataFrame:
    """(projection, severity, code) of binding a projection to an existing pull request.

    checks: (branch, projection, signature, head, pr_number, pr_state, pr_head, pr_base, manifest_base, tree, head_tree, own_tree, has_prerequisites).
    """
    def out(rows: DataFrame, severity: str, code: str) -> DataFrame:
        return rows.select("branch", "projection", F.lit(severity).alias("severity"), F.lit(code).alias("code"))

    c, s = checks.alias("c"), store.select("branch", "signature", "slice_branch", F.col("pr_number").alias("other_pr")).alias("s")
    same = (F.col("c.branch") == F.col("s.branch")) & (F.col("c.signature") != F.col("s.signature"))
    # An equi join per key keeps this from becoming a nested loop.
    by_head = c.join(s, same & (F.col("c.head") == F.col("s.slice_branch"))).select("c.*", F.col("s.signature").alias("_o"))
    by_pr = c.join(s, same & (F.col("c.pr_number") == F.col("s.other_pr"))).select("c.*", F.col("s.signature").alias("_o"))
    parts = [
        out(checks.where("pr_state <> 'OPEN'"), "error", "adopt-pr-state"), out(checks.where("pr_head <> head"), "error", "adopt-head-mismatch"),
        out(by_head.unionByName(by_pr).dropDuplicates(["branch", "projection", "_o"]), "error", "adopt-conflict"),
        out(checks.where("pr_base <> manifest_base"), "warning", "base-disagreement"), out(checks.where("tree is null"), "error", "apply-failure"),
        out(checks.where("tree is not null and head_tree is null"), "error", "adopt-replay-failed"), out(checks.where("tree <> head_tree"), "error", "adopt-mismatch"),
    ]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def adoption_candidates(targets: DataFrame, branches: DataFrame) -> DataFrame:
    """(projection, pr_number, evidence, ambiguous): pull requests whose tree is the projection's, else its own change's.

    targets: (projection, tree, own_tree), branches: (pr_number, tree). A projection with an exact match gets no weaker one; one without either
    gets a row with a null pull request.
    """
    exact = targets.select("projection", "tree").join(branches, "tree").select("projection", "pr_number", F.lit("exact-tree").alias("evidence"))
    rest = targets.join(exact.select("projection").distinct(), "projection", "left_anti")
    near = rest.select("projection", F.col("own_tree").alias("tree")).join(branches, "tree").select("projection", "pr_number", F.lit("own-change-only").alias("evidence"))
    none = rest.join(near.select("projection").distinct(), "projection", "left_anti").select("projection", F.lit(None).cast(dict(branches.dtypes)["pr_number"]).alias("pr_number"), F.lit("none").alias("evidence"))
    n = F.count("pr_number").over(Window.partitionBy("projection"))
    return exact.unionByName(near).unionByName(none).withColumn("ambiguous", (n > 1) & (F.col("evidence") == "exact-tree"))


def open_for_discovery(prs: DataFrame, bound: DataFrame, prefix: str) -> DataFrame:
    """Pull requests whose branch is not generated by us and that no projection is bound to."""
    return prs.where(~F.col("head").startswith(prefix)).join(bound.select("pr_number"), "pr_number", "left_anti")
