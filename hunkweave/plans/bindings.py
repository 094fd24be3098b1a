"""Relations of the engine's model read from whole record tables, repeated deliveries counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkweave.functions.paths import group_key, is_code_file
from hunkweave.operators.diffs import changed_lines
from hunkweave.operators.edges import def_use, slice_edges
from hunkweave.operators.manifest import Declared
from hunkweave.runtime import table


def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "hunks").dropDuplicates(["hunk_id"])


def plan_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks keyed as the planner's relation; the plan is the scope and the hunk id the index."""
    return hunks(spark, sf_dir).select(
        F.col("plan_id").alias("diff_id"), F.col("hunk_id").alias("hunk_index"), "file_path", "old_start", "old_lines", "new_start", "new_lines", "raw",
        F.coalesce("changed_text", F.lit("")).alias("changed_text"), "qualified_symbol", "exported", "fallback_selector", "fallback_reason", "slice_label",
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "projections").dropDuplicates(["entry_id"])


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "overrides").dropDuplicates(["id"])


def record_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, node) of every manifest's projections and every push's branches."""
    p = entries(spark, sf_dir).select(F.concat(F.lit("projections:"), "manifest_id").alias("scope"), F.col("projection_id").alias("node"))
    s = table(spark, sf_dir, "stack_nodes").dropDuplicates(["node_id"]).select(F.concat(F.lit("stack_nodes:"), "push_id").alias("scope"), F.col("branch").alias("node"))
    return p.unionByName(s).where("scope is not null and node is not null").distinct()


def record_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, src, dst) of all manifests and pushes: a projection needs what it depends on, a branch its base; names unknown in their scope fall away."""
    d = entries(spark, sf_dir).select(F.concat(F.lit("projections:"), "manifest_id").alias("scope"), F.col("projection_id").alias("src"), F.explode("depends_on").alias("dst"))
    s = table(spark, sf_dir, "stack_nodes").dropDuplicates(["node_id"]).where("base <> branch").select(F.concat(F.lit("stack_nodes:"), "push_id").alias("scope"), F.col("branch").alias("src"), F.col("base").alias("dst"))
    known = record_nodes(spark, sf_dir).withColumnRenamed("node", "dst")
    return d.unionByName(s).where("src is not null").distinct().join(known, ["scope", "dst"], "left_semi").select("scope", "src", "dst")


def declared(spark: SparkSession, sf_dir: str) -> Declared:
    """All manifests against the slices of their plans; the manifest is the scope, the slice label the slice."""
    e = entries(spark, sf_dir)
    none = F.array().cast("array<string>")
    names = F.coalesce("depends_on", none)
    rows = e.select(
        F.col("manifest_id").alias("scope"), F.col("projection_id").alias("projection"), F.col("entry_id").alias("pos"), "intent", F.coalesce("atomic_slices", none).alias("atomic"), F.coalesce("glue", none).alias("glue"),
        names.alias("depends"), F.coalesce("verification", none).alias("verification"), F.col("verification_profile").alias("profile"), F.col("verification_reason").alias("reason"), F.col("oversize_reason").alias("oversize"),
    )
    h = hunks(spark, sf_dir).withColumn("selector", group_key())
    units = h.groupBy("plan_id", "slice_label").agg(
        F.array_sort(F.collect_set("selector")).alias("selectors"), F.array_sort(F.collect_set("file_path")).alias("files"), F.count(F.lit(1)).alias("hunk_count"),
        F.sum(F.size(changed_lines("raw"))).alias("changed_lines"), F.array_sort(F.collect_set(F.when(is_code_file("file_path"), F.col("file_path")))).alias("code_files"),
    )
    plans = e.select(F.col("manifest_id").alias("scope"), "plan_id").distinct()
    slices = plans.join(units, "plan_id").select("scope", F.col("slice_label").alias("slice_id"), F.regexp_extract("slice_label", r"(\d+)$", 1).cast("long").alias("topo_num"), "selectors", "files", "hunk_count", "changed_lines", "code_files")
    keyed = plan_hunks(spark, sf_dir)
    member = keyed.select("diff_id", "hunk_index", F.col("slice_label").alias("slice_id"))
    needs = slice_edges(def_use(keyed), member, keyed).select(F.col("diff_id").alias("plan_id"), "src", "dst")
    links = plans.join(needs, "plan_id").select("scope", "src", "dst").distinct()
    budgets = plans.select("scope", F.lit(4).alias("max_files"), F.lit(6).alias("max_hunks"), F.lit(60).alias("max_lines")).distinct()
    return Declared(rows, slices, links, spark.createDataFrame([], "scope long, selector string, reason string"), spark.createDataFrame([("unit",), ("default",)], "profile string"), budgets)
