import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hunkweave.llm import percentiles as P


def exact(values, per_mille):
    values = sorted(values)
    return values[max(1, -(-per_mille * len(values) // 1000)) - 1]


def test_percentiles_of_days_and_longer_spans(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(600):
        rows.append((i, rnd.choice(["plan", "verify"]), rnd.choice([None, -1, 0, 5, 20, 100, 500, 5000]), rnd.choice([None, -3, 0, 7, 7, 7, rnd.randrange(10 ** rnd.randrange(1, 9))]), datetime(2025, 1, 1) + timedelta(hours=rnd.randrange(24 * 60))))
    rows += rows[:50]
    df = spark.createDataFrame(rows, "id long, command string, hunk_count int, duration_ms long, started_at timestamp")
    got = {(r.span, r.period, r.command, r.size_class, r.per_mille): (r.value, r.total) for r in P.run_percentiles(df).collect()}
    runs = {r[0]: r for r in rows if r[3] is not None and r[3] >= 0}.values()
    for command in ("plan", "verify"):
        v = [r[3] for r in runs if r[1] == command]
        assert {p: got["all", "all", command, "all", p] for p in P.PER_MILLE} == {p: (exact(v, p), len(v)) for p in P.PER_MILLE}
        v = [r[3] for r in runs if r[1] == command and r[4].month == 2 and r[2] == 20]
        assert got["month", "2025-02", command, "10-49", 950] == (exact(v, 950), len(v))
        week = datetime(2025, 1, 13)
        v = [r[3] for r in runs if r[1] == command and week <= r[4] < week + timedelta(days=7)]
        assert got["week", "2025-01-13", command, "all", 500] == (exact(v, 500), len(v))
    assert {r.duration for r in df.select(F.lit(1).alias("duration")).limit(1).collect()} == {1}


def test_one_group_over_many_ranges_ties_nulls_and_doubles(spark):
    values = [(None, float(i % 97), 3) for i in range(97)] + [("g", -1.5, 1), ("g", 2.5, 1), ("g", None, 9)]
    df = spark.createDataFrame(values, "k string, value double, n long")
    got = {(r.k, r.per_mille): (r.value, r.total) for r in P.percentiles(df, ["k"], (1, 500, 1000), range_rows=10).collect()}
    flat = [float(i) for i in range(97) for _ in range(3)]
    assert P.percentiles(df, ["k"], (1, 500, 1000), range_rows=10**6).count() == 6
    assert got == {**{(None, p): (exact(flat, p), 291) for p in (1, 500, 1000)}, ("g", 1): (-1.5, 2), ("g", 500): (-1.5, 2), ("g", 1000): (2.5, 2)}
    assert P.percentiles(df.where("false"), ["k"]).collect() == []


def test_relative_grid_keeps_its_bound(spark):
    values = [0, 1, 3, 10, 99, 12345, 10**9]
    df = spark.createDataFrame([(i, v, datetime(2025, 1, 1)) for i, v in enumerate(values)], "id long, d long, at timestamp")
    state = P.day_counts(df, "id", {"k": F.lit("x")}, "d", "at", relative_error=0.01)
    got = sorted(r.value for r in state.collect())
    assert all(v <= g + 1e-9 and g <= v * 1.0101 for v, g in zip(values, got))


def test_clashing_extra_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, 9, 1)], "id long, k string, d long, _range int, n int").withColumn("at", F.lit(None).cast("timestamp"))
    state = P.day_counts(df, "id", {"k": F.col("k")}, "d", "at")
    assert [(r.day, r.k, r.value, r.n) for r in state.collect()] == [(None, "a", 5, 1)]
    assert [(r.span, r.n) for r in P.spans(state).collect()] == [(3, 1)]
