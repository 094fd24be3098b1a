"""A declared grouping checked against its plan and against the repository, and scored against an expected one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkweave.functions.hashes import manifest_signature
from hunkweave.functions.paths import group_key
from hunkweave.operators import apply, manifest, score
from hunkweave.operators.manifest import Declared, finding
from hunkweave.plans.review import Plan
from hunkweave.sources import git


def declare(plan: Plan, relations: dict[str, DataFrame], profiles: DataFrame, scope: str) -> Declared:
    """A manifest's relations, read under the name ``scope``, resolved against the one plan that they belong to."""
    slices = plan.slices().withColumn("scope", F.lit(scope))
    edges = plan.edges.select(F.lit(scope).alias("scope"), "src", "dst")
    return Declared(relations["entries"], slices, edges, relations["deferred"], profiles, relations["budgets"])


def unit_hunks(plan: Plan, declared: Declared) -> DataFrame:
    """(scope, unit, hunk_index, path, raw) of every declared unit, deferred slices as the last one."""
    member = declared.verification_units().select("scope", "unit", F.explode("slice_ids").alias("slice_id"))
    rows = plan.hunks.join(plan.membership.select("hunk_index", "slice_id"), "hunk_index")
    return rows.join(member, "slice_id").select("scope", "unit", "hunk_index", F.col("file_path").alias("path"), "raw")


def git_findings(spark: SparkSession, repo: str, plan: Plan, declared: Declared, base_ref: str, goal_ref: str) -> DataFrame:
    """Findings of building every unit on its declared prerequisites, and of rebuilding the whole in order."""
    first = declared.entries.select("scope").first()
    if first is None:  # a manifest without entries builds nothing
        return finding(declared.entries.where("false"), "error", "apply-failure")
    scope = first["scope"]
    base, goal = git.tree_files(spark, repo, base_ref, scope), git.tree_files(spark, repo, goal_ref, scope)
    hunks = unit_hunks(plan, declared)
    ranks = declared.verification_units().select("scope", "unit", F.col("rank").cast("int").alias("rank"))
    own = hunks.where("unit <> '(deferred)'")
    built = apply.flat_first_units(base, ranks.where("unit <> '(deferred)'"), own, declared.declared.select("scope", "src", "dst"))
    failed = finding(built.where("error is not null"), "error", "apply-failure", F.col("unit"), F.col("error"))
    widened = finding(built.where("widened"), "warning", "apply-failure", F.col("unit"), F.array_join("prerequisites", ", "))
    steps = hunks.join(ranks.withColumnRenamed("rank", "step"), ["scope", "unit"]).select("scope", "path", "step", "hunk_index", "raw")
    whole = apply.rebuild_check(base, steps, goal)
    return failed.unionByName(widened).unionByName(finding(whole.where("not same"), "error", "tree-hash-mismatch"))


def adoption_checks(built: DataFrame, prs: DataFrame, manifest_bases: DataFrame) -> DataFrame:
    """Rows for ``adoption_findings`` from built units (scope, unit, tree), pull requests (projection, branch, head, pr_number, pr_state, pr_head, pr_base, head_tree, own_tree) and bases (unit, manifest_base)."""
    trees = built.select(F.col("unit").alias("projection"), "tree")
    bases = manifest_bases.withColumnRenamed("unit", "projection")
    return prs.join(trees, "projection", "left").join(bases, "projection", "left").withColumn("signature", manifest_signature(F.col("projection")))


def score_plan(plan: Plan, expected: DataFrame, threshold: float, scope: str, include_fallback: bool = False, target: int | None = None, coarse: bool = False) -> dict[str, DataFrame]:
    """Scores of a plan's slices or review units against expected units (scope, unit, unit_pos, selector) of the named scope."""
    member = plan.membership.select("diff_id", "hunk_index", "slice_id")
    numbers = plan.numbers()
    if coarse:
        units = plan.coarse(target).select("diff_id", F.explode("slice_ids").alias("slice_id"), F.concat(F.lit("projection"), F.col("unit_num").cast("string")).alias("actual"), F.col("unit_num").alias("act_rank"))
    else:
        units = numbers.select("diff_id", "slice_id", F.concat(F.lit("slice"), F.col("topo_num").cast("string")).alias("actual"), F.col("topo_num").alias("act_rank"))
    rows = plan.hunks.join(member, ["diff_id", "hunk_index"]).join(units, ["diff_id", "slice_id"]).withColumn("scope", F.lit(scope))
    hunk_units = rows.select("scope", "hunk_index", group_key().alias("selector"), F.col("qualified_symbol").isNull().alias("is_fallback"), "actual", "act_rank")
    hunks = score.score_hunks(hunk_units, expected, include_fallback)
    return {
        "agreement": score.agreement(hunks, threshold), "units": score.unit_scores(hunks, expected), "disagreements": score.disagreements(hunks),
        "unmatched": score.unmatched_selectors(hunk_units, expected), "duplicates": score.duplicate_selectors(expected),
    }


def score_declared(plan: Plan, declared: Declared, expected: DataFrame, threshold: float, scope: str, include_fallback: bool = False) -> dict[str, DataFrame]:
    """Scores of a declared grouping's units, in dependency order, against expected units."""
    order = declared.order().select(F.col("projection").alias("actual"), F.col("rank").alias("act_rank"))
    member = declared.owner.select("slice_id", F.col("owner").alias("actual")).join(order, "actual")
    rows = plan.hunks.join(plan.membership.select("hunk_index", "slice_id"), "hunk_index").join(member, "slice_id").withColumn("scope", F.lit(scope))
    hunk_units = rows.select("scope", "hunk_index", group_key().alias("selector"), F.col("qualified_symbol").isNull().alias("is_fallback"), "actual", "act_rank")
    hunks = score.score_hunks(hunk_units, expected, include_fallback)
    return {"agreement": score.agreement(hunks, threshold), "units": score.unit_scores(hunks, expected), "disagreements": score.disagreements(hunks)}


def skeleton(plan: Plan, branch: str, base: str, target: int | None = None) -> DataFrame:
    """(manifest): one JSON document that declares the plan's review units, for a person to edit."""
    units = plan.coarse(target).withColumnRenamed("diff_id", "scope")
    parts = units.select("scope", "unit_num", "fallback_only", F.explode("slice_ids").alias("slice_id")).join(plan.units.withColumnRenamed("diff_id", "scope"), ["scope", "slice_id"])
    shaped = parts.groupBy("scope", "unit_num").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("selectors")))).alias("atomicSlices"), F.bool_and(units["fallback_only"]).alias("fallback_only"),
    )
    ids = manifest.skeleton_ids(shaped)
    needs = units.select("scope", "unit_num", F.explode("prerequisites").alias("need")).join(ids.select("scope", F.col("unit_num").alias("need"), F.col("entry_id").alias("dep")), ["scope", "need"]).groupBy("scope", "unit_num").agg(F.array_sort(F.collect_set("dep")).alias("dependsOn"))
    entries = shaped.join(ids, ["scope", "unit_num"]).join(needs, ["scope", "unit_num"], "left")
    entry = F.struct("unit_num", F.struct(F.col("entry_id").alias("id"), F.col("entry_id").alias("title"), "atomicSlices", F.coalesce("dependsOn", F.array().cast("array<string>")).alias("dependsOn")).alias("e"))
    listed = entries.groupBy("scope").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("projections"))
    return listed.select(F.to_json(F.struct(F.lit(1).alias("version"), F.lit(branch).alias("sourceBranch"), F.lit(base).alias("base"), "projections")).alias("manifest"))
