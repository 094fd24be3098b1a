"""What a push of review units would do, decided for all units of all plans as one staged query. Nothing is pushed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkweave.functions.hashes import content_hash
from hunkweave.operators.reconcile import running_base, unit_status


def _joined(*notes: Column) -> Column:
    return F.nullif(F.concat_ws("; ", *notes), F.lit(""))


def push_plan(
    units: DataFrame, store: DataFrame, heads: DataFrame | None, base_branch: str, flat: bool = True, reviewable: bool = False, draft: bool = False, reclaim: bool = False,
    dry_run: bool = False, separator: str = "\n--\n", scope: str = "scope",
) -> DataFrame:
    """(scope, unit, branch_name, status, base, base_ref, note, draft, hidden_base, expected_sha, content_hash, pr_number, adopted) of every unit.

    ``units``: (scope, unit, rank, branch_name, signature, patch, tree, error, base_kind, base_unit, prerequisites, widened, merged), the
    prerequisites with all of theirs and in order; ``store``: (scope, signature, pr_number, content_hash, commit_sha, stored_tree, base_ref,
    adopted); ``heads``: (scope, branch_name, remote_sha), None where the remote could not be read.

    A unit is blocked that could not be built, that needs a blocked one, whose generated base would hide its prerequisites
    from a reviewable stack, or whose branch others have moved or removed. Discarding what others wrote needs ``reclaim``, and
    an adopted branch is never discarded, made again or retargeted. The base of a stacked unit is the last unit before it that
    stays; that of a flat one its one prerequisite, a generated union of several, or the base branch, also where the
    prerequisite was merged already. What counts as unchanged are patch, tree and base together; on an adopted branch the tree.
    """
    kept = store.select(scope, "signature", "pr_number", F.col("content_hash").alias("_hash"), "commit_sha", "stored_tree", "base_ref", F.coalesce("adopted", F.lit(False)).alias("adopted"), F.lit(True).alias("_exists"))
    u = units.join(kept, [scope, "signature"], "left").fillna(False, ["_exists", "adopted", "merged"])
    if heads is not None:
        u = u.join(heads.select(scope, "branch_name", "remote_sha"), [scope, "branch_name"], "left")
    else:
        u = u.withColumn("remote_sha", F.col("commit_sha"))
    recorded = F.col("commit_sha").isNotNull() & ~F.col("merged")
    moved = F.coalesce(recorded & (F.col("remote_sha") != F.col("commit_sha")), F.lit(False))
    missing = recorded & F.col("remote_sha").isNull()
    union = F.lit(flat) & (F.col("base_kind") == "integration")
    others = F.concat(F.lit("others moved the branch to "), F.substring("remote_sha", 1, 7))
    own = F.coalesce(
        F.when(F.col("tree").isNull(), F.coalesce("error", F.lit("could not be built"))),
        F.when(union & F.lit(reviewable), F.lit("needs a generated base that has no pull request")),
        F.when(moved & (F.col("adopted") | F.lit(not reclaim)), others), F.when(missing & F.col("adopted"), F.lit("the adopted branch is gone")),
    )
    u = u.withColumn("_own", own)
    if flat:
        stuck = u.where("_own is not null").select(scope, F.col("unit").alias("_p"))
        need = u.select(scope, "unit", F.posexplode("prerequisites").alias("_i", "_p")).join(stuck, [scope, "_p"]).groupBy(scope, "unit").agg(F.min_by("_p", "_i").alias("_stuck"))
        u = u.join(need, [scope, "unit"], "left")
    else:
        u = u.withColumn("_stuck", F.lit(None).cast("string"))
    waits = F.when(F.col("_stuck").isNotNull(), F.concat(F.lit("its prerequisite "), "_stuck", F.lit(" is not pushed")))
    u = u.withColumn("_block", F.when(F.col("tree").isNull(), F.col("_own")).otherwise(F.coalesce(waits, F.col("_own"))))

    if flat:
        below = u.select(scope, F.col("unit").alias("base_unit"), F.col("branch_name").alias("_below"), (F.col("merged") & F.col("_block").isNull()).alias("_gone"))
        u = u.join(below, [scope, "base_unit"], "left")
        base = F.when(union, F.concat("branch_name", F.lit("-base"))).when((F.col("base_kind") == "reuse") & ~F.coalesce("_gone", F.lit(False)), F.col("_below")).otherwise(F.lit(base_branch))
        u = u.withColumn("base", base)
    else:
        u = u.withColumn("status", F.when(F.col("_block").isNotNull(), "blocked").when(F.col("merged"), "squash-merged").otherwise("created"))
        u = running_base(u, F.lit(base_branch), scope).drop("status")

    blocked = F.col("_block").isNotNull()
    made = content_hash(F.col("patch"), F.col("tree"), F.col("base"), separator=separator)
    same_tree = F.col("adopted") & F.coalesce(F.col("stored_tree") == F.col("tree"), F.lit(False))
    u = u.withColumn("_new", F.when(same_tree, F.coalesce("_hash", made)).otherwise(made))
    status = unit_status(F.col("merged"), F.col("_hash"), F.col("_exists"), F.col("_new"), F.lit(dry_run))
    again = F.when((moved | missing) & (status == "unchanged"), F.lit("dry-run" if dry_run else "updated")).otherwise(status)
    u = u.withColumn("status", F.when(blocked, "blocked").otherwise(again))
    live = ~blocked & (F.col("status") != "squash-merged")
    retarget = F.col("pr_number").isNotNull() & F.col("base_ref").isNotNull() & (F.col("base_ref") != F.col("base")) & F.col("status").isin("created", "updated")
    note = _joined(
        F.when(union, F.concat(F.lit("its base is a generated union of "), F.array_join("prerequisites", ", "))), F.when(F.col("widened") & F.lit(flat), F.concat(F.lit("built on more than declared: "), F.array_join("prerequisites", ", "))),
        F.when(F.lit(draft) & F.col("pr_number").isNotNull() & ~F.col("merged"), F.lit("an existing pull request keeps its draft state")),
        F.when(recorded & F.lit(heads is None), F.lit("the remote could not be read")), F.when(moved, F.concat(others, F.lit("; overwritten"))), F.when(missing, F.lit("the branch was gone and is made again")),
        F.when(retarget & F.col("adopted"), F.concat(F.lit("the adopted pull request stays on "), "base_ref")),
    )
    return u.select(
        scope, "unit", "branch_name", "status", F.when(blocked, F.lit(base_branch)).otherwise(F.col("base")).alias("base"),
        F.when(live, F.when(retarget & F.col("adopted"), F.col("base_ref")).otherwise(F.col("base"))).alias("base_ref"), F.when(blocked, F.col("_block")).otherwise(note).alias("note"),
        F.when(live & ~F.col("_exists"), F.lit(draft)).alias("draft"), (live & F.coalesce(union, F.lit(False))).alias("hidden_base"),
        F.when(live & ~missing, F.when(moved, F.col("remote_sha")).otherwise(F.col("commit_sha"))).alias("expected_sha"), F.when(~blocked, made).alias("content_hash"), "pr_number", "adopted",
    )
