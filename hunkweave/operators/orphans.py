"""References to records that do not exist at the time of the reference.

A reference at time t has a live target exactly where, of the targets with its key that start at or before t, one ends
after t, that is, where the greatest end among them is after t. References are reduced to one row per key and instant before
they meet targets. Keys with more rows than one task should hold are split off: their targets are broadcast where a count
proves them few, else they are sorted into ranges over all executors and the greatest end so far is carried from range to
range. All other keys go through one shuffle, in which references and targets of a key are merged in order of time; those
left without a live target are the anti join's result. No step forms pairs of the references and targets of a key.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkweave.runtime import HEAVY_ROWS, heavy_counts, key_hash, materialize

FOREVER = datetime(9999, 12, 31)
TARGET, REFERENCE = 0, 1


def _events(refs: DataFrame, targets: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Targets and references as one relation (keys, at, kind, until, ref_count); an open target ends after all times."""
    kind = dict(refs.dtypes)["ref_at"]
    until = F.coalesce(F.col(end).cast(kind), F.lit(FOREVER).cast(kind))
    spans = targets.dropna(subset=keys).select(*keys, F.col(start).cast(kind).alias("_at"), F.lit(TARGET).alias("_kind"), until.alias("_until"), F.lit(0).cast("long").alias("ref_count")).where("_at is not null and _until > _at")
    asked = refs.select(*keys, F.col("ref_at").alias("_at"), F.lit(REFERENCE).alias("_kind"), F.lit(None).cast(kind).alias("_until"), "ref_count")
    return spans.unionByName(asked)


def _merged(events: DataFrame, keys: list[str]) -> DataFrame:
    """References without a live target, each key merged in order of time within one task. A target counts from its start on."""
    w = Window.partitionBy(*keys).orderBy(F.col("_at").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("_until").over(w)
    return events.withColumn("_reach", reach).where((F.col("_kind") == REFERENCE) & (F.col("_reach").isNull() | F.col("_at").isNull() | (F.col("_reach") <= F.col("_at")))).select(*keys, "_at", "ref_count")


def _merged_in_ranges(events: DataFrame, keys: list[str], ranges: int) -> DataFrame:
    """The same for keys of any size: ranges of (key, time) are merged on their own, and start from the reach of the ranges before."""
    order = [*keys, F.col("_at").asc_nulls_first(), "_kind"]
    ranged = materialize(events.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = ranged.groupBy(*keys, "_range").agg(F.max("_until").alias("_m")).select(*keys, "_range", F.max("_m").over(before).alias("_carried"))
    w = Window.partitionBy(*keys, "_range").orderBy(F.col("_at").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = ranged.withColumn("_here", F.max("_until").over(w)).join(carry, [*keys, "_range"])
    reach = F.greatest("_here", "_carried")
    return met.where((F.col("_kind") == REFERENCE) & (reach.isNull() | F.col("_at").isNull() | (reach <= F.col("_at")))).select(*keys, "_at", "ref_count")


def _missing(events: DataFrame, keys: list[str]) -> DataFrame:
    """The same by a broadcast of the targets, which the caller has counted, grouped into one row per key."""
    spans = events.where(F.col("_kind") == TARGET).groupBy(*keys).agg(F.collect_list(F.struct("_at", "_until")).alias("_spans"))
    asked = events.where(F.col("_kind") == REFERENCE).select(*keys, "_at", "ref_count")
    live = F.exists("_spans", lambda s: (s["_at"] <= F.col("_at")) & (F.col("_at") < s["_until"]))
    return asked.join(F.broadcast(spans), keys, "left").where(~F.coalesce(live, F.lit(False))).select(*keys, "_at", "ref_count")


def orphan_references(
    refs: DataFrame, targets: DataFrame, keys: list[str], at: str, start: str, end: str,
    heavy_rows: int = HEAVY_ROWS, broadcast_rows: int = 10_000, spans_per_key: int = 64, ranges: int | None = None,
) -> DataFrame:
    """(keys, ``at``, ref_count) of the references whose key has no target live at ``at``.

    ``ref_count`` is the number of reference rows pre-aggregated into the row. A reference with a null key part refers
    to nothing and is left out; one with a null ``at`` finds no live target and is an orphan. Further columns of either
    side are ignored, so clashing names do no harm; empty inputs give an empty result (an empty target side makes every
    reference an orphan). ``start`` counts as live, ``end`` does not; a null ``end`` is open. Targets with a null key part or a
    null ``start``, and those that end before they start, are never live. Repeated target rows change nothing.

    A key is heavy with more than ``heavy_rows`` targets and references. Heavy keys whose targets are at most ``broadcast_rows``
    in all and ``spans_per_key`` for each are broadcast, all other heavy keys are merged in ranges.
    """
    pre = refs.select(*keys, F.col(at).alias("ref_at")).dropna(subset=keys).groupBy(*keys, "ref_at").agg(F.count(F.lit(1)).alias("ref_count"))
    events = _events(pre, targets, keys, start, end)

    def back(rows: DataFrame) -> DataFrame:
        return rows.select(*keys, F.col("_at").alias(at), "ref_count")

    counts = heavy_counts(events, keys, heavy_rows, F.count_if(F.col("_kind") == TARGET).alias("spans"))
    if not counts:
        return back(_merged(events, keys))
    few = sorted((r["spans"], r["h"]) for r in counts if r["spans"] <= spans_per_key)
    total, small = 0, []
    for spans, h in few:
        total += spans
        if total > broadcast_rows:
            break
        small.append(h)
    large = sorted({r["h"] for r in counts} - set(small))

    def within(hashes: list[int]) -> Column:
        return key_hash(keys).isin(hashes) if hashes else F.lit(False)

    out = back(_merged(events.where(~within([*small, *large])), keys))
    if small:
        out = out.unionByName(back(_missing(events.where(within(small)), keys)))
    if large:
        parts = ranges or int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = out.unionByName(back(_merged_in_ranges(events.where(within(large)), keys, parts)))
    return out


def entry_references(projections: DataFrame) -> DataFrame:
    """(entry_id, field_name, ref_value, target_kind, target_scope, declared_at): one row per entry, field and value.

    Null lists, null values and repeats within a list refer to nothing new. Entries delivered more than once count once.
    """
    fields = [("atomic_slices", "slice", "plan_id"), ("glue", "slice", "plan_id"), ("depends_on", "entry", "manifest_id")]
    packed = F.array(*[
        F.struct(F.lit(name).alias("field_name"), F.lit(kind).alias("target_kind"), F.col(scope).alias("target_scope"), F.array_distinct(F.col(name)).alias("vals"))
        for name, kind, scope in fields
    ])
    return (
        projections.select("entry_id", "declared_at", F.explode(packed).alias("f"))
        .select("entry_id", "declared_at", "f.field_name", "f.target_kind", "f.target_scope", F.explode("f.vals").alias("ref_value"))
        .where(F.col("ref_value").isNotNull())
        .dropDuplicates(["entry_id", "field_name", "ref_value"])
    )


def entry_targets(hunks: DataFrame, projections: DataFrame) -> DataFrame:
    """(target_kind, target_scope, ref_value, live_from, live_to): what entries can refer to."""
    selector = F.when(F.col("qualified_symbol").isNotNull(), F.concat("file_path", F.lit("::"), "qualified_symbol")).otherwise(F.col("fallback_selector"))
    slices = hunks.select(
        F.lit("slice").alias("target_kind"), F.col("plan_id").alias("target_scope"),
        F.explode(F.array(selector, F.col("slice_label"))).alias("ref_value"),
        F.col("planned_at").alias("live_from"), F.col("dropped_at").alias("live_to"),
    )
    entries = projections.select(
        F.lit("entry").alias("target_kind"), F.col("manifest_id").alias("target_scope"), F.col("projection_id").alias("ref_value"),
        F.col("declared_at").alias("live_from"), F.col("withdrawn_at").alias("live_to"),
    )
    return slices.unionByName(entries)


KEYS = ["target_kind", "target_scope", "ref_value"]


def _orphans(refs: DataFrame, projections: DataFrame, hunks: DataFrame, **options) -> DataFrame:
    """The rows of ``refs``, which are read twice, whose target did not exist."""
    lost = orphan_references(refs, entry_targets(hunks, projections), KEYS, "declared_at", "live_from", "live_to", **options).drop("ref_count")
    r, o = refs.alias("r"), lost.alias("o")
    same = F.col("r.declared_at").eqNullSafe(F.col("o.declared_at"))
    for k in KEYS:
        same = (F.col(f"r.{k}") == F.col(f"o.{k}")) & same
    return r.join(o, same, "left_semi").select("entry_id", "field_name", "ref_value", "declared_at")


def orphan_entries(projections: DataFrame, hunks: DataFrame, **options) -> DataFrame:
    """(entry_id, field_name, ref_value, declared_at) of every entry reference whose target did not exist then."""
    return _orphans(materialize(entry_references(projections)), projections, hunks, **options)


def orphan_counts(projections: DataFrame, hunks: DataFrame, **options) -> DataFrame:
    """(field_name, month, ref_count, orphan_count): references and orphans by field and month of declared_at."""
    refs = materialize(entry_references(projections))
    month = F.date_format("declared_at", "yyyy-MM").alias("month")
    every = refs.groupBy("field_name", month).agg(F.count(F.lit(1)).alias("ref_count"), F.lit(0).cast("long").alias("orphan_count"))
    lost = _orphans(refs, projections, hunks, **options).groupBy("field_name", month).agg(F.lit(0).cast("long").alias("ref_count"), F.count(F.lit(1)).alias("orphan_count"))
    return every.unionByName(lost).groupBy("field_name", "month").agg(F.sum("ref_count").alias("ref_count"), F.sum("orphan_count").alias("orphan_count"))
