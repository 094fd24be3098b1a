import random
from collections import defaultdict
from functools import lru_cache

import pytest

from hunkweave.operators.hierarchy import Forest, hierarchy, stack_links


def graph(seed, groups=6, multi=True, cycles=0.07):
    rnd = random.Random(seed)
    nodes, links = [], []
    for g in range(groups):
        n = rnd.randint(1, 40)
        for v in range(n):
            nodes.append((f"t:{g}", v))
            for _ in range(rnd.choice([0, 1, 1, 2, 3] if multi and g % 2 else [0, 1, 1, 1])):
                links.append((f"t:{g}", v, rnd.randrange(v) if v and rnd.random() > cycles else rnd.randrange(n)))
    return nodes, links


def brute(nodes, links):
    parents = defaultdict(set)
    for g, v, p in links:
        parents[g, v].add((g, p))
    every = set(nodes)

    def reach(x):
        seen, todo = set(), list(parents[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += parents[y]
        return seen

    up = {x: reach(x) for x in every}
    cyclic = {x for x in every if x in up[x]}

    @lru_cache(None)
    def roots(x):
        if not parents[x]:
            return {x: 0}
        out = {}
        for p in parents[x]:
            for r, d in roots(p).items():
                out[r] = max(out.get(r, 0), d + 1)
        return out

    rows, below = set(), defaultdict(int)
    for x in every:
        if x in cyclic:
            rows.add((*x, -1, -1))
        elif up[x] & cyclic:
            rows.add((*x, -1, -2))
        else:
            rows |= {(*x, r[1], d) for r, d in roots(x).items()}
            for y in up[x]:
                below[y] += 1
    return rows, dict(below)


def frames(spark, nodes, links):
    return spark.createDataFrame(nodes, "grp string, node_id long"), spark.createDataFrame(links, "grp string, node_id long, parent_id long")


@pytest.mark.parametrize("limit", [10**9, 0], ids=["whole groups", "distributed"])
def test_roots_paths_and_descendants_against_brute_force(spark, limit):
    nodes, links = graph(3)
    n, l = frames(spark, nodes, links)
    want, below = brute(nodes, links)
    assert {tuple(r) for r in hierarchy(n, l, "roots", max_group_rows=limit).collect()} == want
    got = defaultdict(int)
    for r in hierarchy(n, l, "descendants", max_group_rows=limit).collect():
        got[r.grp, r.node_id] += r.to_pos - r.from_pos + 1
    assert dict(got) == below
    known = set(links)
    for r in hierarchy(n, l, "paths", max_group_rows=limit).collect():
        if r.root_id == -1:
            assert r.path is None
        else:
            assert (r.path[0], r.path[-1], len(r.path)) == (r.root_id, r.node_id, r.node_depth + 1)
            assert all((r.grp, b, a) in known for a, b in zip(r.path, r.path[1:]))


@pytest.mark.parametrize("kind", ["roots", "paths", "chains", "descendants", "levels", "cycles"])
def test_both_forms_give_the_same_rows(spark, kind):
    nodes, links = [], []
    for seed in range(12):
        n, l = graph(seed, groups=2, cycles=0.04)
        nodes += [(f"{g}-{seed}", v) for g, v in n]
        links += [(f"{g}-{seed}", v, p) for g, v, p in l]
    links += [("six", 4, 1), ("six", 3, 2), ("six", 4, 3), ("six", 5, 4), ("six", 6, 1)]
    n, l = frames(spark, nodes, links)
    whole, parts = (sorted((tuple(r) for r in hierarchy(n, l, kind, max_group_rows=m).collect()), key=repr) for m in (10**9, 0))
    assert whole == parts and whole


def test_paths_take_the_least_parent_of_a_longest_way(spark):
    n, l = frames(spark, [("t:0", v) for v in range(7)], [("t:0", 6, 5), ("t:0", 6, 3), ("t:0", 5, 4), ("t:0", 3, 1), ("t:0", 4, 0), ("t:0", 1, 0), ("t:0", 6, 2), ("t:0", 2, 0)])
    for limit in (10**9, 0):
        got = {r.node_id: r.path for r in hierarchy(n, l, "paths", max_group_rows=limit).collect()}
        assert got[6] == [0, 1, 3, 6]


def test_a_long_ring_is_found_in_few_rounds(spark):
    n = spark.range(2000).selectExpr("'t:0' AS grp", "id AS node_id")
    l = n.selectExpr("grp", "node_id", "(node_id + 1) % 1990 AS parent_id").where("node_id < 1990").unionByName(n.where("node_id >= 1990").selectExpr("grp", "node_id", "node_id - 1 AS parent_id"))
    got = hierarchy(n, l, "roots", max_group_rows=1).groupBy("node_depth").count().collect()
    assert {tuple(r) for r in got} == {(-1, 1990), (-2, 10)}
    assert hierarchy(n, l, "cycles", max_group_rows=1).where("component = 0").count() == 1990


def test_many_small_graphs_locally():
    for seed in range(200):
        nodes, links = graph(seed, groups=1, cycles=0.1)
        want, _ = brute(nodes, links)
        forest = Forest(len(nodes), [(v, p) for _, v, p in links])
        got = {("t:0", v, r, o + forest.pos[v]) for v, here in forest.reach_roots() for r, (o, _, _) in here.items()}
        got |= {("t:0", v, -1, -1 if v in forest.on_cycle else -2) for v in range(forest.n) if not forest.sound[v]}
        assert got == want


def test_long_chain_takes_few_rounds(spark):
    n = spark.range(3000).selectExpr("'t:0' AS grp", "id AS node_id")
    l = n.where("node_id > 0").selectExpr("grp", "node_id", "node_id - 1 AS parent_id")
    rows = hierarchy(n, l, "roots", max_group_rows=10).agg({"node_depth": "max", "root_id": "max"}).first()
    assert tuple(rows) in {(2999, 0), (0, 2999)}


def test_batches_cut_between_groups(spark):
    nodes, links = graph(5, groups=30)
    n, l = frames(spark, nodes, links)
    assert {tuple(r) for r in hierarchy(n, l, batch_rows=7).collect()} == brute(nodes, links)[0]


def test_repeats_nulls_and_empty_input(spark):
    n, l = frames(spark, [("t:0", 1), ("t:0", 1), ("t:0", 2), (None, 3), ("t:0", None)], [("t:0", 2, 1), ("t:0", 2, 1), ("t:0", None, 1), ("t:0", 2, None), (None, 2, 1)])
    assert {tuple(r) for r in hierarchy(n, l).collect()} == {("t:0", 1, 1, 0), ("t:0", 2, 1, 1)}
    assert hierarchy(n.where("false"), l.where("false")).collect() == []


def test_redelivered_nodes_count_once(spark):
    rows = spark.createDataFrame([(1, 7, "b1", "main"), (1, 7, "b1", "main"), (2, 7, "b2", "b1"), (3, 8, "b3", "b1"), (4, 7, "b4", None)], "node_id long, push_id long, branch string, base string")
    nodes, links = stack_links(rows)
    assert nodes.count() == 4 and [tuple(r) for r in links.collect()] == [("stack_nodes:7", 2, 1)]
