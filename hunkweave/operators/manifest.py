"""A declared grouping checked against the plan that it groups: one query per kind of finding.

Inputs, all keyed by a scope (one manifest against one plan):
entries (scope, projection, pos, intent, atomic array, glue array, depends array, verification array, profile, reason, oversize),
slices (scope, slice_id, topo_num, selectors array, files array, hunk_count, changed_lines, code_files), edges (scope, src, dst),
deferred (scope, selector, reason), profiles (profile, commands array), budgets (scope, max_files, max_hunks, max_lines).
Every finding is (scope, severity, code, projection, detail).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkweave.functions.paths import common_directory, slug
from hunkweave.operators.graph import closure, kahn_order, strong_components
from hunkweave.runtime import materialize


def finding(rows: DataFrame, severity: str | Column, code: str, projection: Column | None = None, detail: Column | None = None) -> DataFrame:
    return rows.select(
        "scope", (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(code).alias("code"),
        (projection if projection is not None else F.lit(None).cast("string")).alias("projection"), (detail if detail is not None else F.lit("")).alias("detail"),
    )


class Declared:
    """A manifest resolved against its plan, and the queries over it."""

    def __init__(self, entries: DataFrame, slices: DataFrame, edges: DataFrame, deferred: DataFrame, profiles: DataFrame, budgets: DataFrame) -> None:
        self.entries, self.slices, self.edges, self.profiles, self.budgets = entries, slices, edges, profiles, budgets
        self.labels = slices.select("scope", "slice_id", F.concat(F.lit("slice"), F.col("topo_num").cast("string")).alias("label"), F.array_min("selectors").alias("durable"))
        # A selector names the first slice that holds it; ordinals name slices by their number and nothing else does.
        durable = slices.select("scope", "slice_id", F.explode(F.array_distinct("selectors")).alias("selector")).where(F.col("selector").contains("::") & ~F.col("selector").rlike(r"^slice\d+$"))
        ordinal = self.labels.select("scope", F.col("label").alias("selector"), "slice_id")
        names = durable.groupBy("scope", "selector").agg(F.min("slice_id").alias("slice_id"))
        self.names = names.withColumn("ordinal", F.lit(False)).unionByName(ordinal.withColumn("ordinal", F.lit(True)))
        uses = [
            entries.select("scope", "projection", "pos", F.lit(kind).alias("kind"), F.posexplode(kind).alias("at", "selector")) for kind in ("atomic", "glue")
        ]
        self.uses = uses[0].unionByName(uses[1]).where(F.col("selector").isNotNull())
        self.hits = self.uses.join(self.names, ["scope", "selector"])
        self.deferred = deferred.join(self.names, ["scope", "selector"]).select("scope", "slice_id", "reason").distinct()
        self.lost_deferred = deferred.join(self.names, ["scope", "selector"], "left_anti")
        # First assignment holds; a slice that is only glue belongs to the first projection that mentions it.
        first = self.hits.groupBy("scope", "slice_id").agg(F.min(F.struct(F.when(F.col("kind") == "atomic", 0).otherwise(1).alias("k"), "pos", "at", "projection")).alias("_f"))
        self.owner = first.select("scope", "slice_id", F.col("_f.projection").alias("owner"))
        known = entries.select("scope", F.col("projection").alias("dst")).distinct()
        wanted = entries.select("scope", F.col("projection").alias("src"), F.explode("depends").alias("dst")).where(F.col("dst").isNotNull())
        self.declared = wanted.join(known, ["scope", "dst"]).select("scope", "src", "dst").distinct()
        self.unknown = wanted.join(known, ["scope", "dst"], "left_anti")
        self._reach: DataFrame | None = None

    def settle(self) -> Declared:
        """The same manifest with its resolved relations written once."""
        for name in ("names", "uses", "hits", "owner", "declared", "labels", "deferred"):
            setattr(self, name, materialize(getattr(self, name)))
        return self

    @property
    def reach(self) -> DataFrame:
        """Closure of the declared dependencies, built once."""
        if self._reach is None:
            self._reach = closure(self.declared)
        return self._reach

    def order(self) -> DataFrame:
        """(scope, projection, rank): dependency order, or the order of declaration where the declared graph is cyclic."""
        nodes = self.entries.groupBy("scope", F.col("projection").alias("node")).agg(F.min("pos").alias("seq"))
        topo = kahn_order(nodes, self.declared.withColumn("seq", F.lit(0)))
        return topo.join(nodes, ["scope", "node"]).select("scope", F.col("node").alias("projection"), F.coalesce("topo_num", "seq").alias("rank"))

    def units(self) -> DataFrame:
        """(scope, projection, slice_ids, files, hunk_count, changed_lines, code_files) of every entry, empty ones included."""
        joined = self.owner.join(self.slices, ["scope", "slice_id"]).groupBy("scope", F.col("owner").alias("projection")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("topo_num", "slice_id"))), lambda s: s["slice_id"]).alias("slice_ids"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"), F.sum("hunk_count").alias("hunk_count"),
            F.sum("changed_lines").alias("changed_lines"), F.size(F.array_distinct(F.flatten(F.collect_list("code_files")))).alias("code_files"),
        )
        return self.entries.join(joined, ["scope", "projection"], "left")

    def branch_mismatch(self, manifests: DataFrame) -> DataFrame:
        """``manifests``: (scope, source_branch, branch)."""
        return finding(manifests.where((F.col("source_branch") != F.col("branch"))), "warning", "branch-mismatch", None, F.col("source_branch"))

    def duplicate_ids(self) -> DataFrame:
        return finding(self.entries.groupBy("scope", "projection").count().where("count > 1"), "error", "duplicate-id", F.col("projection"))

    def unknown_selectors(self) -> DataFrame:
        lost = self.uses.join(self.names, ["scope", "selector"], "left_anti")
        return finding(lost, "error", "unknown-selector", F.col("projection"), F.col("selector")).unionByName(finding(self.lost_deferred, "error", "unknown-selector", None, F.col("selector")))

    def ordinal_selectors(self) -> DataFrame:
        return finding(self.hits.where("ordinal").join(self.labels, ["scope", "slice_id"]), "warning", "ordinal-selector", F.col("projection"), F.concat_ws(" ", "selector", "durable"))

    def duplicate_assignments(self) -> DataFrame:
        clash = self.hits.where("kind = 'atomic'").join(self.owner, ["scope", "slice_id"]).where("projection <> owner")
        return finding(clash, "error", "duplicate-assignment", F.col("projection"), F.concat_ws(" ", "selector", "owner"))

    def unknown_dependencies(self) -> DataFrame:
        return finding(self.unknown, "error", "unknown-dependency", F.col("src"), F.col("dst"))

    def unassigned(self) -> DataFrame:
        held = self.owner.select("scope", "slice_id").unionByName(self.deferred.select("scope", "slice_id"))
        return finding(self.labels.join(held, ["scope", "slice_id"], "left_anti"), "error", "unassigned-slice", None, F.col("durable"))

    def cycles(self) -> DataFrame:
        """One finding per manifest whose declared graph has a cycle; an entry that depends on itself is one."""
        loops = self.declared.where("src = dst").select("scope").unionByName(strong_components(self.declared).select("scope")).distinct()
        return finding(loops, "error", "manifest-cycle")

    def _across(self) -> DataFrame:
        s = self.owner.select("scope", F.col("slice_id").alias("src"), F.col("owner").alias("pf"))
        d = self.owner.select("scope", F.col("slice_id").alias("dst"), F.col("owner").alias("pt"))
        return self.edges.join(s, ["scope", "src"]).join(d, ["scope", "dst"], "left")

    def removed_dependencies(self) -> DataFrame:
        """Edges between projections that the declared closure does not hold, once per pair, and edges to deferred slices, once per slice."""
        across = self._across()
        put_off = across.where(F.col("pt").isNull()).join(self.deferred.select("scope", F.col("slice_id").alias("dst")), ["scope", "dst"], "left_semi").select("scope", "pf", "dst").distinct()
        reach = self.reach.select("scope", F.col("src").alias("pf"), F.col("dst").alias("pt"))
        crossing = across.where("pf <> pt").select("scope", "pf", "pt").distinct().join(reach, ["scope", "pf", "pt"], "left_anti")
        return finding(put_off, "error", "dependency-removed", F.col("pf"), F.concat(F.lit("deferred "), F.col("dst").cast("string"))).unionByName(finding(crossing, "error", "dependency-removed", F.col("pf"), F.col("pt")))

    def unreachable_glue(self) -> DataFrame:
        used = self.hits.where("kind = 'glue'").join(self.owner, ["scope", "slice_id"]).where("projection <> owner")
        reach = self.reach.select("scope", F.col("src").alias("projection"), F.col("dst").alias("owner"))
        return finding(used.join(reach, ["scope", "projection", "owner"], "left_anti"), "error", "glue-not-reachable", F.col("projection"), F.col("owner"))

    def oversize(self) -> DataFrame:
        u = self.units().join(self.budgets, "scope")
        over = F.concat_ws(
            ", ", F.when((F.col("max_files") > 0) & (F.size("files") > F.col("max_files")), "files"), F.when((F.col("max_hunks") > 0) & (F.col("hunk_count") > F.col("max_hunks")), "hunks"),
            F.when((F.col("max_lines") > 0) & (F.col("changed_lines") > F.col("max_lines")), "changed lines"),
        )
        return finding(u.withColumn("_over", over).where((F.col("_over") != "") & (F.coalesce(F.col("oversize"), F.lit("")) == "")), "error", "oversize", F.col("projection"), F.col("_over"))

    def intents(self, required: bool = False) -> DataFrame:
        blank = F.trim(F.coalesce("intent", F.lit(""))) == ""
        return finding(self.entries.where(blank), "error" if required else "warning", "no-intent", F.col("projection"))

    def verification(self, required: bool = False) -> DataFrame:
        """Profile conflicts, unknown profiles, and missing or waived commands."""
        named = F.coalesce("profile", F.lit("")) != ""
        inline = F.coalesce(F.size("verification"), F.lit(0)) > 0
        conflict = finding(self.entries.where(named & inline), "error", "verification-profile-conflict", F.col("projection"), F.col("profile"))
        unknown = finding(self.entries.where(named & ~inline).join(self.profiles.select("profile"), "profile", "left_anti"), "error", "unknown-verification-profile", F.col("projection"), F.col("profile"))
        bare = self.units().where(~named & ~inline)
        has_code = F.coalesce("code_files", F.lit(0)) > 0
        waived = finding(bare.where(F.lit(required) & has_code), "error", "verification-waived", F.col("projection"), F.coalesce("reason", F.lit("")))
        none = finding(bare.where(~(F.lit(required) & has_code) & (F.coalesce("reason", F.lit("")) == "")), "warning", "no-verification", F.col("projection"))
        return reduce(DataFrame.unionByName, [conflict, unknown, waived, none])

    def findings(self, require_intent: bool = False, require_verification: bool = False) -> DataFrame:
        return reduce(DataFrame.unionByName, [
            self.duplicate_ids(), self.unknown_selectors(), self.ordinal_selectors(), self.duplicate_assignments(), self.unknown_dependencies(), self.unassigned(), self.cycles(),
            self.removed_dependencies(), self.unreachable_glue(), self.oversize(), self.intents(require_intent), self.verification(require_verification),
        ])

    def verification_units(self) -> DataFrame:
        """(scope, unit, rank, slice_ids): the projections in order and the deferred slices as one unit after all."""
        ranked = self.units().join(self.order(), ["scope", "projection"]).select("scope", F.col("projection").alias("unit"), "rank", "slice_ids")
        last = ranked.groupBy("scope").agg((F.max("rank") + 1).alias("rank"))
        tail = self.deferred.groupBy("scope").agg(F.array_sort(F.collect_set("slice_id")).alias("slice_ids")).join(last, "scope").select("scope", F.lit("(deferred)").alias("unit"), "rank", "slice_ids")
        return ranked.unionByName(tail)


def verdict(findings: DataFrame, strict: bool = False) -> DataFrame:
    """(scope, errors, warnings, failed): warnings fail too when strict."""
    error = F.col("severity") == "error"
    return findings.groupBy("scope").agg(F.count_if(error).alias("errors"), F.count_if(~error).alias("warnings"), F.bool_or(error | F.lit(strict)).alias("failed"))


def skeleton_ids(units: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, unit_num, entry_id): an id for every review unit from the directory its files share.

    Units of dependency files alone are ``deps``; without a shared directory the first file's name is used. Repeats get a
    number from 2. ``units``: (scope, unit_num, files, reasons, fallback_only).
    """
    shared = common_directory("files")
    base = F.when(F.size(shared) > 0, F.array_join(shared, "-")).otherwise(F.regexp_replace(F.element_at(F.split(F.try_element_at("files", F.lit(1)), "/"), -1), r"\.[^.]+$", ""))
    name = F.when(F.col("fallback_only") & (F.col("reasons") == F.array(F.lit("dependency-manifest"))), "deps").otherwise(F.coalesce(F.nullif(slug(base), F.lit("")), F.concat(F.lit("projection"), F.col("unit_num").cast("string"))))
    named = units.select(scope, "unit_num", name.alias("_name"))
    n = F.row_number().over(Window.partitionBy(scope, "_name").orderBy("unit_num"))
    return named.select(scope, "unit_num", F.when(n == 1, F.col("_name")).otherwise(F.concat("_name", F.lit("-"), n.cast("string"))).alias("entry_id"))
