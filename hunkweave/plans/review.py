"""The whole path from a repository to a review plan: scan, parse, place, group, relate, order, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hunkweave.functions.paths import is_code_file, language
from hunkweave.operators import coarsen as coarsening
from hunkweave.operators import diffs, edges, graph, partition, symbols
from hunkweave.runtime import materialize
from hunkweave.sources import git


@dataclass
class Plan:
    """Relations of one or many diffs, keyed by diff_id."""

    sections: DataFrame
    hunks: DataFrame
    excluded: DataFrame
    membership: DataFrame
    units: DataFrame
    uses: DataFrame
    edges: DataFrame
    order: DataFrame
    overrides: DataFrame | None = None

    def settle(self, *names: str) -> Plan:
        """The same plan with its relations, or those named, written once, for callers that ask it many things."""
        for name in names or ("hunks", "membership", "units", "edges", "order"):
            setattr(self, name, materialize(getattr(self, name)))
        return self

    def slices(self) -> DataFrame:
        """Slices as a manifest is checked against: (scope, slice_id, topo_num, selectors, files, hunk_count, changed_lines, code_files)."""
        lines = self.hunks.join(self.membership.select("diff_id", "hunk_index", "slice_id"), ["diff_id", "hunk_index"]).groupBy("diff_id", "slice_id").agg(F.sum(F.size(diffs.changed_lines("raw"))).alias("changed_lines"))
        joined = self.units.join(self.numbers(), ["diff_id", "slice_id"]).join(lines, ["diff_id", "slice_id"])
        return joined.select(F.col("diff_id").alias("scope"), "slice_id", "topo_num", "selectors", "files", "hunk_count", "changed_lines", F.filter("files", is_code_file).alias("code_files"))

    def numbers(self) -> DataFrame:
        """(diff_id, slice_id, topo_num): the public number of each slice, by dependency order, by first hunk where there is a cycle."""
        first = F.row_number().over(Window.partitionBy("diff_id").orderBy("node")) - 1
        return self.order.withColumn("_n", first).select("diff_id", F.col("node").alias("slice_id"), F.coalesce("topo_num", F.col("_n")).alias("topo_num"))

    def coarse(self, target: int | None = None) -> DataFrame:
        """Review units. A slice with a force_split selector is pinned."""
        units = self.units.withColumn("seq", F.col("first_index"))
        pinned = F.lit(False)
        if self.overrides is not None:
            split = self.overrides.where("kind = 'force_split'").groupBy("diff_id").agg(F.collect_set("selector_a").alias("_split"))
            units = units.join(split, "diff_id", "left")
            pinned = F.coalesce(F.arrays_overlap("selectors", "_split"), F.lit(False))
        return coarsening.coarsen(units.withColumn("pinned", pinned), self.edges, target)

    def report(self) -> DataFrame:
        """(diff_id, ok, plan): one JSON document per diff with slices in display order, edges, fallback groups, cycles and exclusions."""
        numbers = self.numbers()
        label = F.concat(F.lit("slice"), F.col("topo_num").cast("string"))
        last = F.col("new_start") + F.greatest("new_lines", F.lit(1)) - 1
        hunk = F.struct("new_start", "hunk_index", F.struct(F.col("file_path").alias("file"), F.col("new_start").alias("startLine"), last.alias("endLine"), F.col("fallback_reason").alias("fallbackReason"), F.col("fallback_selector").alias("fallbackSelector")).alias("h"))
        listed = self.hunks.join(self.membership.select("diff_id", "hunk_index", "slice_id"), ["diff_id", "hunk_index"]).groupBy("diff_id", "slice_id").agg(F.transform(F.array_sort(F.collect_list(hunk)), lambda x: x["h"]).alias("hunks"))
        slices = self.units.join(numbers, ["diff_id", "slice_id"]).join(listed, ["diff_id", "slice_id"])
        shown = F.struct("topo_num", F.struct(label.alias("slice"), "files", "symbols", F.when(F.col("fallback_only"), F.struct("selectors", "reasons")).alias("fallback"), "hunks").alias("s"))
        out = slices.groupBy("diff_id").agg(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["s"]).alias("slices"))
        s = numbers.select("diff_id", F.col("slice_id").alias("src"), label.alias("from"))
        d = numbers.select("diff_id", F.col("slice_id").alias("dst"), label.alias("dependsOn"))
        linked = self.edges.join(s, ["diff_id", "src"]).join(d, ["diff_id", "dst"]).groupBy("diff_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct("from", "dependsOn").alias("e")))), lambda x: x["e"]).alias("edges"))
        left_out = self.excluded.groupBy("diff_id").agg(F.array_sort(F.collect_list(F.struct("section_pos", "path", "reason", "detail"))).alias("excluded"))
        acyclic = self.order.groupBy("diff_id").agg(F.bool_and(F.col("topo_num").isNotNull()).alias("ok"))
        joined = out.join(acyclic, "diff_id").join(linked, "diff_id", "left").join(left_out, "diff_id", "left")
        return joined.select("diff_id", "ok", F.to_json(F.struct("ok", "slices", "edges", "excluded")).alias("plan"))


def plan_diffs(texts: DataFrame, files: DataFrame, overrides: DataFrame | None = None) -> Plan:
    """Plan any number of diffs at once. ``texts``: (diff_id, text), ``files``: (diff_id, path, content) of the changed files."""
    parts = diffs.sections(texts)
    raw = diffs.hunks(parts)
    readable = files.where(language("path").isNotNull())
    state = F.when(language("path").isNull(), "unsupported-language").when(F.col("content").isNull(), "unparseable").otherwise("parsed")
    placed = symbols.attach_symbols(raw, symbols.symbols(readable), files.select("diff_id", "path", state.alias("state")))
    return relate(placed, parts, diffs.excluded(parts), overrides)


def relate(hunk_rows: DataFrame, sections: DataFrame, excluded: DataFrame, overrides: DataFrame | None = None) -> Plan:
    """Plan hunks that have their symbols already."""
    member = materialize(partition.slices(hunk_rows, overrides))
    units = materialize(partition.slice_units(hunk_rows, member))
    uses = edges.def_use(hunk_rows)
    links = materialize(edges.slice_edges(uses, member, hunk_rows))
    order = graph.kahn_order(units.select("diff_id", F.col("slice_id").alias("node"), F.col("first_index").alias("seq")), links, "diff_id")
    return Plan(sections, hunk_rows, excluded, member, units, uses, links, order, overrides)


def plan_branch(spark: SparkSession, repo: str, base: str, branch: str | None = None, worktree: bool = False, overrides: DataFrame | None = None) -> Plan:
    """Plan what a branch or the working tree changes since it left the base branch. An empty diff gives an empty plan."""
    source = git.resolve_source(repo, base, branch, worktree)
    text = git.diff_text(spark, repo, source.merge_base, source.ref)
    changed = [r["path"] for r in git.name_status(spark, repo, source.merge_base, source.ref).collect()]
    files = git.files_at(spark, repo, changed, source.ref, source.merge_base)
    return plan_diffs(text, files, overrides).settle()


def text_report(plan: Plan) -> str:
    """A plan as lines of text, one per slice, for people."""
    rows = plan.units.join(plan.numbers(), ["diff_id", "slice_id"]).orderBy("diff_id", "topo_num").collect()
    return "\n".join(f"slice{r['topo_num']} [{r['hunk_count']} hunks] {', '.join(r['selectors'])}" for r in rows)
