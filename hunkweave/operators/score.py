"""Agreement between a computed partition and an expected one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hunkweave.operators.grouped import solve_groups
from hunkweave.runtime import Growing, fits, materialize, release


def first_declared(expected: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, selector, unit, unit_pos): of several units that declare a selector the first holds."""
    return expected.groupBy(scope, "selector").agg(F.min(F.struct("unit_pos", "unit")).alias("_u")).select(scope, "selector", F.col("_u.unit").alias("unit"), F.col("_u.unit_pos").alias("unit_pos"))


def duplicate_selectors(expected: DataFrame, scope: str = "scope") -> DataFrame:
    """Selectors that more than one unit declares."""
    return expected.groupBy(scope, "selector").agg(F.count_distinct("unit").alias("n")).where("n > 1").select(scope, "selector")


def contingency(scored: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, expected, actual, hunks, exp_pos, act_rank) of every pair that shares hunks."""
    return scored.groupBy(scope, "expected", "actual").agg(F.count(F.lit(1)).alias("hunks"), F.min("exp_pos").alias("exp_pos"), F.min("act_rank").alias("act_rank"))


def greedy_match(pairs: DataFrame, scope: str = "scope", max_group_rows: int = 500_000) -> DataFrame:
    """(scope, expected, actual, hunks): pairs taken in order of hunks, expected position and actual rank (equal ones by name) while both sides are free.

    A scope of up to ``max_group_rows`` pairs is matched in one task. In a larger one every pair that comes first for both of its sides
    is taken at once, and the pairs of taken sides fall away, until none is left; as the order has no ties that is the same.
    """
    rows = pairs.select(scope, "expected", "actual", "hunks", (-F.col("hunks")).alias("_h"), F.struct(F.col("exp_pos").isNull().alias("n"), "exp_pos").alias("_e"), F.struct(F.col("act_rank").isNull().alias("n"), "act_rank").alias("_a"))
    order = ["_h", "_e", "_a", "expected", "actual"]

    def match(key: object, group: dict[str, list]) -> list[tuple]:
        left, right, out = set(), set(), []
        for e, a, n in zip(group["expected"], group["actual"], group["hunks"]):
            if e not in left and a not in right:
                left.add(e)
                right.add(a)
                out.append((key, e, a, n))
        return out

    schema = [(scope, scope), ("expected", "expected"), ("actual", "actual"), ("hunks", "hunks")]
    large = rows.groupBy(scope).count().where(F.col("count") > max_group_rows).select(scope)
    if fits(large, 0):
        return solve_groups(rows, scope, order, match, schema)
    large = materialize(large)
    small = solve_groups(rows.join(large, scope, "left_anti"), scope, order, match, schema)
    left = materialize(rows.join(large, scope, "left_semi"))
    taken = Growing(pairs.sparkSession)
    while not fits(left, 0):
        first = F.struct(*order)
        of_expected = left.groupBy(scope, "expected").agg(F.min(first).alias("_x"))
        of_actual = left.groupBy(scope, "actual").agg(F.min(first).alias("_y"))
        best = left.join(of_expected, [scope, "expected"]).join(of_actual, [scope, "actual"]).where((F.col("_x") == first) & (F.col("_y") == first))
        now = taken.add(best.select(scope, "expected", "actual", "hunks"))
        rest = materialize(left.join(now.select(scope, "expected"), [scope, "expected"], "left_anti").join(now.select(scope, "actual"), [scope, "actual"], "left_anti"))
        release(left)
        left = rest
    return small.unionByName(taken.read())


def score_hunks(hunk_units: DataFrame, expected: DataFrame, include_fallback: bool = False, scope: str = "scope") -> DataFrame:
    """Every hunk with its expected unit and role: ``scored``, ``unscored`` or ``excluded-fallback``.

    ``hunk_units``: (scope, hunk_index, selector, is_fallback, actual, act_rank).
    """
    joined = hunk_units.join(first_declared(expected, scope), [scope, "selector"], "left")
    role = F.when(F.col("unit").isNull(), "unscored").when(F.col("is_fallback") & F.lit(not include_fallback), "excluded-fallback").otherwise("scored")
    return joined.select(scope, "hunk_index", "selector", "actual", "act_rank", F.col("unit").alias("expected"), F.col("unit_pos").alias("exp_pos"), role.alias("role"))


def agreement(hunks: DataFrame, threshold: float, scope: str = "scope") -> DataFrame:
    """(scope, scored, agreed, unscored, excluded, agreement, pass); the ratio of no hunks is 0 and does not pass."""
    matched = greedy_match(contingency(hunks.where("role = 'scored'"), scope), scope).select(scope, "expected", F.col("actual").alias("_m"))
    joined = hunks.join(matched, [scope, "expected"], "left")
    scored = F.col("role") == "scored"
    out = joined.groupBy(scope).agg(
        F.count_if(scored).alias("scored"), F.count_if(scored & (F.col("actual") == F.col("_m"))).alias("agreed"),
        F.count_if(F.col("role") == "unscored").alias("unscored"), F.count_if(F.col("role") == "excluded-fallback").alias("excluded"),
    )
    ratio = F.when(F.col("scored") > 0, F.col("agreed") / F.col("scored")).otherwise(F.lit(0.0))
    return out.withColumn("agreement", ratio).withColumn("pass", (F.col("scored") > 0) & (ratio >= threshold))


def unit_scores(hunks: DataFrame, expected: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, unit, matched, hunks, agreed, spread, shared_with) of every expected unit."""
    only = hunks.where("role = 'scored'")
    pairs = contingency(only, scope)
    m = greedy_match(pairs, scope)
    units = expected.groupBy(scope, F.col("unit")).agg(F.min("unit_pos").alias("unit_pos"))
    spread = pairs.groupBy(scope, F.col("expected").alias("unit")).agg(F.sum("hunks").alias("hunks"), F.transform(F.array_sort(F.collect_list(F.struct("act_rank", "actual"))), lambda x: x["actual"]).alias("spread"))
    got = m.select(scope, F.col("expected").alias("unit"), F.col("actual").alias("matched"), F.col("hunks").alias("agreed"))
    others = got.select(scope, F.col("unit"), F.col("matched").alias("actual")).join(pairs.select(scope, "actual", F.col("expected").alias("other"), F.col("exp_pos")), [scope, "actual"]).where("unit <> other")
    shared = others.groupBy(scope, "unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("exp_pos", "other"))), lambda x: x["other"]).alias("shared_with"))
    empty = F.array().cast(f"array<{dict(hunks.dtypes)['actual']}>")
    return (
        units.join(spread, [scope, "unit"], "left").join(got, [scope, "unit"], "left").join(shared, [scope, "unit"], "left")
        .select(scope, "unit", "matched", F.coalesce("hunks", F.lit(0)).alias("hunks"), F.coalesce("agreed", F.lit(0)).alias("agreed"), F.coalesce("spread", empty).alias("spread"), "shared_with")
    )


def disagreements(hunks: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, selector, expected, actual, hunks): selectors whose hunks are not in the matched unit, most hunks first.

    ``actual`` is that of the selector's first hunk. Ties sort by the language's order of the selector.
    """
    only = hunks.where("role = 'scored'")
    m = greedy_match(contingency(only, scope), scope).select(scope, "expected", F.col("actual").alias("_m"))
    off = only.join(m, [scope, "expected"], "left").where(~F.col("actual").eqNullSafe(F.col("_m")))
    out = off.groupBy(scope, "selector").agg(F.first("expected").alias("expected"), F.min_by("actual", F.struct("act_rank", "hunk_index")).alias("actual"), F.count(F.lit(1)).alias("hunks"))
    return out.withColumn("position", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("hunks"), F.collate("selector", "UNICODE"))))


def unmatched_selectors(hunk_units: DataFrame, expected: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, selector) that are expected but that no hunk has."""
    return expected.select(scope, "selector").distinct().join(hunk_units.select(scope, "selector").distinct(), [scope, "selector"], "left_anti")
