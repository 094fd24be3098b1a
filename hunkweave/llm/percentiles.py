"""Percentiles of very large numeric columns from mergeable value counts.

The state of a day is the number of runs per group and value. States of days add up to the state of any longer span.
Percentiles come from cumulative frequencies: values fall into ranges, the counts of a group in the ranges before a range are
the range's offset, offset plus running sum is the cumulative count, and the first value that reaches a rank is the
percentile. The offsets come from counts per range, which are few, and tell which ranges hold a rank at all; running sums are
built within those only, and every count is sent once. With exact values the error is zero; on a relative grid the result
is at least the true value and exceeds it by at most the grid's relative width.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkweave.runtime import fits, materialize

PER_MILLE = (500, 900, 950, 990)


SIZE_CLASSES = ("unknown", "0", "1-9", "10-49", "50-199", "200-999", "1000+", "all")
ALL_SIZES = SIZE_CLASSES.index("all")
SPANS = ("day", "week", "month", "all")


def size_class(count: Column | str) -> Column:
    """Number of the size class of a hunk count; null and negative counts are ``unknown``."""
    c = F.col(count) if isinstance(count, str) else count
    return F.when(c.isNull() | (c < 0), 0).when(c < 1, 1).when(c < 10, 2).when(c < 50, 3).when(c < 200, 4).when(c < 1000, 5).otherwise(6)


def label(code: str, labels: tuple[str, ...]) -> Column:
    """The label of a code column, under the column's own name."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.col(code) + 1).alias(code)


def on_grid(value: Column, relative_error: float) -> Column:
    """The smallest power of (1 + relative_error) not below a positive value; zero stays."""
    step = math.log1p(relative_error)
    return F.when(value <= 0, F.lit(0.0)).otherwise(F.exp(F.ceil(F.log(value) / step - 1e-12) * step))


def day_counts(runs: DataFrame, id_col: str, groups: dict[str, Column], value: str, at: str, relative_error: float | None = None) -> DataFrame:
    """(day, groups, value, n): the mergeable state, each run counted once.

    A run delivered more than once has one id and one content. Null and negative values are no durations and are left
    out; zeros count. A null time falls on a null day, which belongs to no span but ``all``. With ``relative_error`` the
    values are rounded up to a grid, which bounds the state by the number of grid steps per day and group.
    """
    v = F.col("_value") if relative_error is None else on_grid(F.col("_value"), relative_error)
    return (
        runs.where(F.col(value) >= 0)
        .select(F.col(id_col).alias("_id"), F.to_date(at).alias("day"), *[c.alias(n) for n, c in groups.items()], F.col(value).alias("_value"))
        .dropDuplicates(["_id"])
        .groupBy("day", *groups, v.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    )


def spans(counts: DataFrame) -> DataFrame:
    """Each row with a ``day`` once per span that holds its day: (span, period, …) instead of the day.

    ``span`` is a place in ``SPANS`` and ``period`` the first day of the span, null for the whole.
    """
    first = (F.col("day"), F.date_trunc("week", "day").cast("date"), F.date_trunc("month", "day").cast("date"), F.lit(None).cast("date"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("span"), d.alias("period")) for i, d in enumerate(first)])).alias("_s")
    rest = [c for c in counts.columns if c != "day"]
    return counts.select(each, *rest).select(F.col("_s.span").alias("span"), F.col("_s.period").alias("period"), *rest).where(F.col("period").isNotNull() | (F.col("span") == len(SPANS) - 1))


def with_totals(counts: DataFrame, group: str, total: object) -> DataFrame:
    """Each count once under its own ``group`` and once under the group of all."""
    return counts.withColumn(group, F.explode(F.array(F.col(group), F.lit(total))))


def _octave(value: Column) -> Column:
    """The sign and power of two of a value, as a whole number that rises with it."""
    return F.floor(F.signum(value) * (1 + F.log2(1 + F.abs(value)))).cast("int")


def percentiles(
    counts: DataFrame, groups: list[str], per_mille: tuple[int, ...] = PER_MILLE, expand: Callable[[DataFrame], DataFrame] | None = None,
    fixed: list[str] | None = None, range_rows: int = 50_000, broadcast_rows: int = 200_000,
) -> DataFrame:
    """(groups, per_mille, value, total): the first value whose cumulative count reaches ``ceil(p * total)``.

    ``counts`` holds group columns, value and n; counts of one group and value add up. ``expand`` may give each row to several
    groups, as an explosion that reads no value; ``fixed`` then names the group columns that it leaves as they are. A null
    group is a group; a null value is left out; an empty input gives an empty result.

    A range is a part of a power of two, cut so that it holds about ``range_rows`` of the rows of ``counts``. ``counts`` is read
    three times and should be a written table. The ranges to look into are broadcast when a count shows so few.
    """
    expand, fixed = expand or (lambda rows: rows), groups if fixed is None else fixed
    base = [c for c in counts.columns if c not in ("value", "n")]
    slim = counts.where(F.col("value").isNotNull()).withColumn("_octave", _octave(F.col("value")))
    sizes = {r["_octave"]: r["count"] for r in slim.groupBy("_octave").count().collect()}  # one row for each power of two
    octaves = sorted(sizes)
    steps = {o: max(1, math.ceil(sizes[o] / range_rows)) for o in octaves}
    start = {o: sum(steps[x] for x in octaves[:i]) for i, o in enumerate(octaves)}
    place = F.signum("value") * (1 + F.log2(1 + F.abs("value"))) - F.col("_octave")
    number = F.lit(0)
    for o in octaves:
        number = F.when(F.col("_octave") == o, start[o] + (F.least(F.floor(place * steps[o]), F.lit(steps[o] - 1)) if steps[o] > 1 else F.lit(0))).otherwise(number)
    ranged = slim.withColumn("_range", number.cast("int")).drop("_octave")

    sums = expand(ranged.groupBy(*base, "_range").agg(F.sum("n").alias("n"))).groupBy(*groups, "_range").agg(F.sum("n").alias("_n"))
    by_group = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_n").over(by_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sums.select(*groups, "_range", "_n", F.sum("_n").over(by_group).alias("total"), before.alias("_before"))

    def rank(p: Column) -> Column:
        return F.greatest(F.floor((p * F.col("total") + 999) / 1000), F.lit(1).cast("long"))

    def reached(low: Column, high: Column) -> Column:
        return F.filter(F.array(*[F.lit(p) for p in per_mille]), lambda p: (rank(p) > low) & (rank(p) <= high))

    wanted = materialize(placed.where(F.size(reached(F.col("_before"), F.col("_before") + F.col("_n"))) > 0).select(*groups, "_range", "total", "_before"))
    same = F.col("r._range") == F.col("o._range")
    for g in groups:
        same = same & F.col(f"r.{g}").eqNullSafe(F.col(f"o.{g}"))
    rows = expand(ranged.repartition(*fixed, "_range"))
    offsets = F.broadcast(wanted) if fits(wanted, broadcast_rows) else wanted
    joined = rows.alias("r").join(offsets.alias("o"), same).select(*[F.col(f"r.{g}") for g in groups], "r._range", "r.value", "r.n", "o.total", "o._before")
    run = F.sum("n").over(Window.partitionBy(*groups, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    summed = joined.withColumn("_upto", F.col("_before") + run).withColumn("_from", F.col("_upto") - F.col("n"))
    return summed.select(*groups, F.explode(reached(F.col("_from"), F.col("_upto"))).alias("per_mille"), "value", "total")


def run_percentiles(timing_runs: DataFrame, relative_error: float | None = None) -> DataFrame:
    """Percentiles of duration_ms by command and by command and size class, for each day, week, month and the whole."""
    groups = {"command": F.col("command"), "size_class": size_class("hunk_count")}
    state = day_counts(timing_runs, "id", groups, "duration_ms", "started_at", relative_error)
    found = percentiles(materialize(state), ["span", "period", *groups], expand=lambda rows: spans(with_totals(rows, "size_class", ALL_SIZES)), fixed=["command"])
    period = F.when(F.col("span") == SPANS.index("all"), "all").when(F.col("span") == SPANS.index("month"), F.date_format("period", "yyyy-MM")).otherwise(F.date_format("period", "yyyy-MM-dd"))
    return found.withColumn("period", period).withColumns({"span": label("span", SPANS), "size_class": label("size_class", SIZE_CLASSES)})
