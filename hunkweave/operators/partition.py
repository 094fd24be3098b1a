"""Hunks grouped into slices by selector, with the stored overrides applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkweave.functions.hashes import signature
from hunkweave.functions.paths import group_key
from hunkweave.operators.graph import components
from hunkweave.runtime import fits


def slices(hunk_rows: DataFrame, overrides: DataFrame | None = None, scope: str = "diff_id") -> DataFrame:
    """(scope, hunk_index, selector, slice_id): every hunk once. The slice id is the least hunk index of its slice.

    A selector under force_split leaves each of its hunks alone; force_merge joins the first hunks of two selectors.
    Without merges this is a grouping by key; with merges the groups are joined as connected components.
    ``overrides``: (scope, kind, selector_a, selector_b).
    """
    keyed = hunk_rows.select(scope, "hunk_index", group_key().alias("selector"))
    if overrides is None:
        first = keyed.groupBy(scope, "selector").agg(F.min("hunk_index").alias("slice_id"))
        return keyed.join(first, [scope, "selector"]).select(scope, "hunk_index", "selector", "slice_id")
    split = overrides.where(F.col("kind") == "force_split").select(scope, F.col("selector_a").alias("selector"), F.lit(True).alias("_split")).distinct()
    keyed = keyed.join(split, [scope, "selector"], "left").withColumn("_split", F.coalesce("_split", F.lit(False)))
    first = keyed.groupBy(scope, "selector").agg(F.min("hunk_index").alias("_first"))
    start = keyed.join(first, [scope, "selector"]).select(scope, "hunk_index", "selector", F.when(F.col("_split"), F.col("hunk_index")).otherwise(F.col("_first")).alias("slice_id"))
    merges = overrides.where((F.col("kind") == "force_merge") & F.col("selector_b").isNotNull()).select(scope, "selector_a", "selector_b").distinct()
    a = first.select(scope, F.col("selector").alias("selector_a"), F.col("_first").alias("a"))
    b = first.select(scope, F.col("selector").alias("selector_b"), F.col("_first").alias("b"))
    links = merges.join(a, [scope, "selector_a"]).join(b, [scope, "selector_b"]).where("a <> b").select(scope, "a", "b")
    if fits(links, 0):
        return start
    joined = components(links, scope).select(scope, F.col("node").alias("slice_id"), "component")
    return start.join(joined, [scope, "slice_id"], "left").select(scope, "hunk_index", "selector", F.coalesce("component", "slice_id").alias("slice_id"))


def ignored_overrides(overrides: DataFrame, hunk_rows: DataFrame, scope: str = "diff_id") -> DataFrame:
    """Selectors of overrides that no hunk has, one row per mention; a merge without a second selector names only its first."""
    named = overrides.select(scope, "id", "kind", F.explode(F.array("selector_a", "selector_b")).alias("selector")).where(F.col("selector").isNotNull())
    known = hunk_rows.select(scope, group_key().alias("selector")).distinct()
    return named.join(known, [scope, "selector"], "left_anti").select(scope, "id", "kind", "selector")


def invalid_overrides(overrides: DataFrame) -> DataFrame:
    """Override rows that the store would refuse, with the reason."""
    a, b = F.col("selector_a"), F.col("selector_b")
    reason = (
        F.when(F.col("kind").isNull() | ~F.col("kind").isin("force_merge", "force_split"), "unknown-kind")
        .when(a.isNull() | ~a.contains("::"), "selector-a-without-separator")
        .when((F.col("kind") == "force_merge") & b.isNull(), "merge-needs-two-selectors")
        .when((F.col("kind") == "force_split") & b.isNotNull(), "split-takes-one-selector")
        .when(b.isNotNull() & ~b.contains("::"), "selector-b-without-separator")
    )
    return overrides.withColumn("reason", reason).where(F.col("reason").isNotNull())


def slice_units(hunk_rows: DataFrame, membership: DataFrame, scope: str = "diff_id") -> DataFrame:
    """One row per slice: its files, symbols, selectors and reasons sorted, hunk count, signature and whether all hunks are fallback."""
    joined = hunk_rows.join(membership.select(scope, "hunk_index", "selector", "slice_id"), [scope, "hunk_index"])

    def sorted_set(name: str):
        return F.array_sort(F.collect_set(name))

    return joined.groupBy(scope, "slice_id").agg(
        sorted_set("file_path").alias("files"), sorted_set("qualified_symbol").alias("symbols"), sorted_set("selector").alias("selectors"),
        sorted_set("fallback_reason").alias("reasons"), F.count(F.lit(1)).alias("hunk_count"),
        F.bool_and(F.col("qualified_symbol").isNull()).alias("fallback_only"), F.min("hunk_index").alias("first_index"),
    ).withColumn("signature", signature(F.col("selectors")))
