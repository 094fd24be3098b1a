from datetime import datetime, timedelta

from hunkweave.operators import orphans

T = datetime(2025, 1, 1)
KEYS = ["kind", "k"]


def day(n):
    return None if n is None else T + timedelta(days=n)


def frames(spark, refs, targets):
    r = spark.createDataFrame([(a, b, day(t)) for a, b, t in refs], "kind string, k string, at timestamp")
    t = spark.createDataFrame([(a, b, day(s), day(e)) for a, b, s, e in targets], "kind string, k string, s timestamp, e timestamp")
    return r, t


def brute(refs, targets):
    out = {}
    for kind, k, t in refs:
        if kind is None or k is None:
            continue
        if not any(a == kind and b == k and s is not None and t is not None and s <= t and (e is None or e > t) for a, b, s, e in targets):
            out[kind, k, t] = out.get((kind, k, t), 0) + 1
    return out


def found(spark, refs, targets, **options):
    r, t = frames(spark, refs, targets)
    rows = orphans.orphan_references(r, t, KEYS, "at", "s", "e", **options).collect()
    return {(x["kind"], x["k"], None if x["at"] is None else (x["at"] - T).days): x["ref_count"] for x in rows}


CASES = (
    [("a", "x", 5), ("a", "x", 5), ("a", "y", 1), ("b", "x", 3), (None, "x", 1), ("a", None, 1), ("a", "x", None), ("a", "x", 10), ("a", "x", 0), ("a", "z", 4), ("a", "e", 2)],
    [("a", "x", 1, 10), ("a", "x", 4, 6), ("a", "x", 1, 10), ("a", "y", 1, 1), ("a", "y", 2, None), ("b", "x", None, None), (None, "x", 0, None), ("a", "z", 5, 3), ("a", "e", 0, 2)],
)


def test_edges_of_intervals_nulls_and_repeats(spark):
    assert found(spark, *CASES) == brute(*CASES)


def test_hot_keys_by_broadcast_and_in_ranges(spark):
    refs = [("a", "hot", i % 40) for i in range(200)] + [("a", f"k{i}", i % 7) for i in range(50)] + [("a", "many", i) for i in range(60)]
    targets = [("a", "hot", i, i + 1) for i in range(0, 40, 3)] + [("a", f"k{i}", 0, 3) for i in range(0, 50, 2)] + [("a", "many", i, i + (40 if i == 2 else 1)) for i in range(0, 60, 2)]
    want = brute(refs, targets)
    for options in ({"spans_per_key": 20}, {"spans_per_key": 20, "ranges": 7}, {"broadcast_rows": 0, "ranges": 5}, {"broadcast_rows": 10**6, "spans_per_key": 10**6}):
        assert found(spark, refs, targets, heavy_rows=30, **options) == want


def test_a_key_with_half_of_all_rows_on_both_sides(spark):
    from pyspark.sql import functions as F

    n = 200_000
    at = F.timestamp_seconds(F.col("id") * 10)
    key = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id")))
    refs = spark.range(n).select(F.lit("a").alias("kind"), key.alias("k"), at.alias("at"))
    targets = spark.range(n).select(F.lit("a").alias("kind"), key.alias("k"), at.alias("s"), F.timestamp_seconds(F.col("id") * 10 + F.when(F.col("id") % 4 == 0, 15).otherwise(0)).alias("e"))
    lost = orphans.orphan_references(refs, targets, KEYS, "at", "s", "e", heavy_rows=50_000, ranges=6)
    assert {r["hot"]: r["n"] for r in lost.groupBy((F.col("k") == "hot").alias("hot")).agg(F.sum("ref_count").alias("n")).collect()} == {True: n // 4, False: n // 2}


def test_empty_sides(spark):
    assert found(spark, [], CASES[1]) == {}
    assert found(spark, [("a", "x", 1)], []) == {("a", "x", 1): 1}


def test_extra_columns_with_the_names_used_inside(spark):
    r, t = frames(spark, *CASES)
    from pyspark.sql import functions as F

    r = r.withColumn("span_start", F.lit(1)).withColumn("ref_count", F.lit("x"))
    t = t.withColumn("at", F.lit(2)).withColumn("_island", F.lit(3)).withColumn("span_end", F.lit(0))
    assert sum(x["ref_count"] for x in orphans.orphan_references(r, t, KEYS, "at", "s", "e").collect()) == sum(brute(*CASES).values())
