import random

from hunkweave.llm.components import grid_components, merge_groups


def brute(pairs):
    group = {x: x for p in pairs for x in p}
    for _ in group:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    return group


def run(spark, pairs, **options):
    df = spark.createDataFrame(pairs, "a long, b long")
    return {r.v: r.component for r in grid_components(df, **options).collect()}


def test_random_pairs_on_grids_of_any_size(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(110)]
    want = brute(pairs)
    for cell in (1000, 12):
        assert run(spark, pairs, cell_edges=cell) == want


def test_long_path_and_hub(spark):
    path = [(i, i + 1) for i in range(60)]
    random.Random(1).shuffle(path)
    hub = [(1000, 1000 + i) for i in range(1, 80)]
    assert run(spark, path + hub, cell_edges=10) == brute(path + hub)


def test_no_cell_grows_with_the_degree_of_a_vertex(spark):
    from hunkweave.llm.components import _cells

    n = 30_000
    edges = spark.range(1, n).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS a", "id + 1 AS b")
    cells = _cells(edges, n, 200, 0)
    assert cells.count() == n - 1
    assert cells.groupBy("cell", "part").count().agg({"count": "max"}).first()[0] <= 500
    got = grid_components(edges, cell_edges=2_000)
    assert got.count() == n + 1 and got.agg({"component": "max"}).first()[0] <= n


def test_loops_repeats_nulls_and_empty(spark):
    assert run(spark, [(5, 5), (1, 2), (2, 1), (1, 2), (None, 9), (9, None)]) == {5: 5, 1: 1, 2: 1}
    assert run(spark, []) == {}


def test_overrides_in_uneven_form(spark):
    rows = [
        (1, "b", "force_merge", " x::1 ", "y::2"), (2, "b", "force_merge", "y::2\t", "a::0"), (3, "b", "force_merge", "lone::1", None), (4, "b", "force_merge", None, ""), (5, "b", "force_split", "x::1", None),
        (6, "c", "force_merge", "x::1", "z::9"), (7, None, "force_merge", "x::1", "q::1"), (8, "b", "force_merge", "X::1", "X::1"), (1, "b", "force_merge", " x::1 ", "y::2"),
    ]
    df = spark.createDataFrame(rows, "id long, branch string, kind string, selector_a string, selector_b string")
    got = {(r.branch, r.selector): r.group_selector for r in merge_groups(df).collect()}
    assert got == {
        ("b", "x::1"): "a::0", ("b", "y::2"): "a::0", ("b", "a::0"): "a::0", ("b", "lone::1"): "lone::1", ("b", "X::1"): "X::1", ("c", "x::1"): "x::1", ("c", "z::9"): "x::1", (None, "x::1"): "q::1", (None, "q::1"): "q::1",
    }
    assert merge_groups(df.where("false")).collect() == []


def test_hot_group_is_joined_by_broadcast(spark):
    from hunkweave.runtime import join_unique

    big = spark.range(100).selectExpr("id", "CASE WHEN id < 60 THEN 1 WHEN id < 99 THEN id END AS k")
    small = spark.range(100).selectExpr("id AS k", "id * 2 AS w")
    a = {tuple(r) for r in join_unique(big, small, "k", rows=20).select("id", "w").collect()}
    assert a == {tuple(r) for r in big.join(small, "k").select("id", "w").collect()} and len(a) == 99
