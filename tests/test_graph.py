import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hunkweave.operators import graph, stacks
from hunkweave.operators.coarsen import _Merger, _solve, coarsen
from hunkweave.operators.graph import _kahn


def edges_of(spark, pairs):
    return spark.createDataFrame([(0, a, b) for a, b in pairs], "scope int, src int, dst int")


def reach(pairs):
    out = set(pairs)
    while True:
        more = out | {(a, d) for a, b in out for c, d in pairs if b == c}
        if more == out:
            return out
        out = more


def test_closure_levels_cycles_and_maximal(spark):
    rnd = random.Random(4)
    pairs = sorted({(rnd.randrange(30), rnd.randrange(30)) for _ in range(45)})
    e = edges_of(spark, pairs)
    full = reach(pairs)
    assert {(r.src, r.dst) for r in graph.closure(e).collect()} == full
    cyclic = {a for a, b in full if (b, a) in full and a != b}
    assert {r.node for r in graph.strong_components(e).collect()} == cyclic
    nodes = spark.createDataFrame([(0, v) for v in range(30)], "scope int, node int")
    got = {r.node: r.level for r in graph.levels(nodes, e).collect()}
    on_or_above = {v for v in range(30) if any((v, w) in full or v == w for w in range(30) if (w, w) in full)}
    assert {v for v, l in got.items() if l is None} == on_or_above
    assert all(got[a] > got[b] for a, b in pairs if a not in on_or_above)


def test_kahn_is_first_in_first_out_and_null_on_cycles(spark):
    nodes = spark.createDataFrame([(s, n, n) for s in (1, 2) for n in range(5)], "scope int, node int, seq int")
    pairs = [(1, 0, 4), (1, 1, 4), (1, 2, 1), (2, 0, 1), (2, 1, 0)]
    e = spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], "scope int, src int, dst int, seq int")
    rows = graph.kahn_order(nodes, e).collect()
    assert [r.node for r in sorted((r for r in rows if r.scope == 1), key=lambda r: r.topo_num)] == [3, 4, 0, 1, 2]
    assert all(r.topo_num is None for r in rows if r.scope == 2)


def test_order_by_level_equals_the_order_in_one_task(spark):
    rnd = random.Random(8)
    nodes, links = [], []
    for scope in range(6):
        n = 25
        nodes += [(scope, f"n{v}", rnd.randrange(6)) for v in range(n)]
        for i in range(45):
            a, b = rnd.randrange(n), rnd.randrange(n)
            if a != b:
                links.append((scope, f"n{max(a, b)}", f"n{min(a, b)}", rnd.randrange(8)) if scope else (scope, f"n{a}", f"n{b}", i))
    links.append((1, "n3", "unknown", 0))
    n, e = spark.createDataFrame(nodes, "scope int, node string, seq int"), spark.createDataFrame(links, "scope int, src string, dst string, seq int")
    one, two = ({(r.scope, r.node): r.topo_num for r in graph.kahn_order(n, e, max_group_rows=m).collect()} for m in (10**6, 30))
    assert one == two and None in one.values() and len(one) == 150


def test_innermost_spans_of_hot_keys(spark):
    from hunkweave.operators.symbols import innermost

    rnd = random.Random(3)
    spans = [(rnd.choice(["hot", "hot", "k"]), s, s + rnd.choice([0, 1, 7, 8, 9, 100, 1000]), i) for i in range(300) for s in [rnd.randrange(-500, 500)]]
    points = [(i, rnd.choice(["hot", "k", "none"]), rnd.randrange(-600, 1600)) for i in range(200)]
    s, p = spark.createDataFrame(spans, "k string, a long, b long, n int"), spark.createDataFrame(points, "id int, k string, x long")
    want = {}
    for i, k, x in points:
        fit = [(b - a, n) for key, a, b, n in spans if key == k and a <= x <= b]
        if fit:
            want[i] = min(fit)[1]
    for heavy in (10**6, 150):
        assert {r.id: r.n for r in innermost(p, s, ["k"], "x", "a", "b", "n", ["n"], ["id"], heavy_rows=heavy).collect()} == want


@settings(max_examples=200, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=25))
def test_merging_keeps_the_quotient_acyclic(pairs):
    edges = [(a, b) for a, b in pairs if a > b]
    order = _kahn(list(range(10)), edges)
    g = _Merger(order, edges, {3})
    rnd = random.Random(len(pairs))
    for _ in range(30):
        g.merge(rnd.randrange(10), rnd.randrange(10), "t")
        assert _kahn(g.heads(), g.quotient()) is not None
    assert g.group[3] == 3 and g.members[3] == [3]


def unit(i, files, reasons=None, fallback=False, pinned=False, hunks=1):
    return {"slice_id": i, "seq": i, "files": files, "reasons": reasons or [], "hunk_count": hunks, "fallback_only": fallback, "pinned": pinned}


def test_merge_rules():
    units = [
        unit(0, ["src/a/format.ts"]), unit(1, ["src/a/format.test.ts"]), unit(2, ["src/a/format.ts"], ["no-enclosing-symbol"], True), unit(3, ["src/b/report.ts"]),
        unit(4, ["package.json"], ["dependency-manifest"], True), unit(5, ["src/b/columns.ts"]),
    ]
    ids = [u["slice_id"] for u in units]
    parts = (ids, {u["slice_id"]: u["files"] for u in units}, {u["slice_id"]: set(u["reasons"]) if u["fallback_only"] else None for u in units}, {u["slice_id"]: u["hunk_count"] for u in units})
    links = [(3, 0), (1, 0)]
    rows = _solve(*parts, set(), links, None)
    rules = sorted(x.split(":")[0] for r in rows for x in r["rules"])
    assert rules == ["same-file", "sole-consumer", "test-affinity"]
    assert sorted(sum((r["slice_ids"] for r in rows), [])) == list(range(6))
    two = _solve(*parts, set(), links, 2)
    assert len(two) == 2 and {r["target_met"] for r in two} == {True} or {r["unmet_reason"] for r in two} <= {"size-cap", "structure"}
    assert len(_solve(*parts, set(ids), links, 1)) == 6


def test_groups_are_solved_whole_across_batches(spark):
    from hunkweave.operators.grouped import solve_groups

    rows = spark.range(5000).selectExpr("CASE WHEN id < 3000 THEN 'big' WHEN id < 3010 THEN NULL ELSE concat('g', id % 700) END AS k", "id AS x")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r.k, r.n, r.first) for r in solve_groups(rows, "k", ["x"], lambda key, g: [(key, len(g["x"]), g["x"][0])], [("k", "k"), ("n", "long"), ("first", "x")]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {tuple(r) for r in rows.groupBy("k").agg({"x": "count"}).join(rows.groupBy("k").agg({"x": "min"}).withColumnRenamed("k", "j"), F.expr("k <=> j")).drop("j").collect()}
    assert solve_groups(rows.where("false"), "k", ["x"], lambda key, g: [], [("k", "k")]).collect() == []


def test_groups_stay_whole_where_nodes_and_edges_are_coalesced_apart(spark):
    n = spark.createDataFrame([(s, v, -v) for s in range(20) for v in range(5)], "scope long, node long, seq long")
    e = spark.createDataFrame([(s, a, b, 0) for s in range(20) for a in range(5) for b in range(a)] * 30, "scope long, src long, dst long, seq long")
    units = n.selectExpr("scope", "node AS slice_id", "seq", "array(concat('f', node)) AS files", "array('') AS reasons", "1L AS hunk_count", "false AS fallback_only", "true AS pinned")
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        order = {(r.scope, r.node): r.topo_num for r in graph.kahn_order(n, e).collect()}
        rows = coarsen(units, e.distinct(), scope="scope").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert order == {(s, v): v for s in range(20) for v in range(5)}
    assert sorted((r.scope, r.unit_num, r.slice_ids, r.prerequisites) for r in rows) == [(s, v, [v], list(range(v))) for s in range(20) for v in range(5)]


def test_components_against_union_find(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)]
    group = {x: x for p in pairs for x in p}
    for _ in group:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    df = spark.createDataFrame([(0, a, b) for a, b in pairs], "scope int, a int, b int")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == {x: group[x] for p in pairs if p[0] != p[1] for x in p}


def test_stack_links_by_open_members(spark):
    stacks_df = spark.createDataFrame(
        [(1, [(10, "open", False), (11, "open", False)]), (2, [(20, "closed", False), (21, "open", False)]), (3, [(31, "open", False), (30, "open", False)])],
        "stack_number int, prs array<struct<number:int,state:string,merged:boolean>>",
    )
    wanted = spark.createDataFrame([(1, [10]), (2, [21, 22]), (3, [30, 31]), (4, [10, 21]), (5, [99])], "chain_id int, prs array<int>")
    got = {r.chain_id: (r.link_status, r.stack_number, list(r.added)) for r in stacks.plan_links(wanted, stacks_df).collect()}
    assert got == {1: ("unchanged", 1, []), 2: ("extended", 2, [22]), 3: ("diverged", 3, []), 4: ("diverged", None, []), 5: ("created", None, [99])}


def test_a_chain_of_twenty_thousand_ranks(spark):
    n = spark.range(20_000).selectExpr("0 AS scope", "id AS node")
    e = n.where("node > 0").selectExpr("scope", "node AS src", "node - 1 AS dst")
    for limit in (10**6, 10):
        assert graph.levels(n, e, max_group_rows=limit).where("level = node").count() == 20_000


def test_stack_chains_in_tasks_and_by_jumps_agree(spark):
    rnd = random.Random(6)
    rows = []
    for push in range(12):
        n = rnd.randrange(1, 25)
        for v in range(n):
            base = rnd.choice([None, "main", f"b{v}"]) if rnd.random() < 0.2 else f"b{rnd.randrange(max(1, v))}" if rnd.random() < 0.5 else f"b{v - 1}" if rnd.random() < 0.9 else f"b{rnd.randrange(n)}"
            rows.append((push, push * 100 + v, f"b{v}", base))
    df = spark.createDataFrame(rows, "push_id int, node_id long, branch string, base string")
    one, two = (sorted((tuple(r) for r in stacks.chains(df, max_group_rows=m).collect()), key=repr) for m in (10**6, 0))
    assert one == two and {"chain", "solitary"} == {r[5] for r in one} and len({r[6] for r in one}) > 4


def test_greedy_match_by_rounds_is_the_same(spark):
    from hunkweave.operators.score import greedy_match

    rnd = random.Random(9)
    pairs = list({(s, f"e{rnd.randrange(9)}", f"a{rnd.randrange(9)}"): None for s in range(4) for _ in range(50)})
    df = spark.createDataFrame([(*p, rnd.randrange(1, 4), rnd.choice([None, 1, 2]), rnd.choice([1, 1, 2])) for p in pairs], "scope int, expected string, actual string, hunks long, exp_pos int, act_rank int")
    one, two = ({tuple(r) for r in greedy_match(df, max_group_rows=m).collect()} for m in (10**6, 0))
    assert one == two and len(one) > 20
