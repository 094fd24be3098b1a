"""Queries that take whole tables, against brute force."""

from collections import defaultdict

from hunkweave.operators import apply, stacks
from hunkweave.plans import registry


def test_every_manifest_and_push_is_ordered(spark, data, duck):
    want = duck.execute("SELECT DISTINCT 'projections:' || manifest_id, projection_id FROM projections WHERE projection_id IS NOT NULL UNION SELECT DISTINCT 'stack_nodes:' || push_id, branch FROM stack_nodes WHERE branch IS NOT NULL").fetchall()
    place = {(r["scope"], r["node"]): r["topo_num"] for r in registry.QUERIES["kahn_order"](spark, data).collect()}
    assert set(place) == set(want)
    needs = defaultdict(set)
    for scope, node, deps in duck.execute("SELECT 'projections:' || manifest_id, projection_id, depends_on FROM projections").fetchall():
        needs[scope, node] |= {d for d in deps or () if (scope, d) in place}
    for scope, node, base in duck.execute("SELECT 'stack_nodes:' || push_id, branch, base FROM stack_nodes WHERE base <> branch").fetchall():
        needs[scope, node] |= {base} & {n for s, n in place if s == scope}
    assert all(place[scope, d] < at for (scope, n), at in place.items() if at is not None for d in needs[scope, n])
    pairs = set()
    for scope, node in place:
        todo, seen = list(needs[scope, node]), set()
        while todo:
            d = todo.pop()
            if d not in seen:
                seen.add(d)
                todo += needs[scope, d]
        pairs |= {(scope, node, d) for d in seen}
    assert {tuple(r) for r in registry.QUERIES["closure"](spark, data).collect()} == pairs
    cyclic = {s for s, n, d in pairs if n == d}
    assert {s for (s, _), at in place.items() if at is None} == cyclic


def test_only_a_line_feed_ends_a_line():
    text = "one\rtwo\x0cthree\n four\x85five\r\n\n\rsix"
    lines = text.split("\n")
    add = f"@@ -0,0 +1,{len(lines)} @@\n+" + "\n+".join(lines) + "\n\\ No newline at end of file\n"
    assert apply.apply_hunks("", [add]) == text
    assert apply.apply_hunks(text, [add], reverse=True) == ""


def test_drift_takes_every_pair_of_snapshots(spark, data, duck):
    want = duck.execute("SELECT DISTINCT snapshot_no, branch, slice_signature FROM correspondence WHERE snapshot_no < (SELECT max(snapshot_no) FROM correspondence)").fetchall()
    got = [(r["snapshot_no"], r["branch"], r["slice_signature"]) for r in registry.QUERIES["drift"](spark, data).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_stacks_of_odd_pushes_hold_chains(spark):
    wanted = spark.createDataFrame([(3, [1, 2, 3]), (1, [1, 2]), (4, [1])], "chain_id long, prs array<int>")
    held = spark.createDataFrame([(1, [(1, "open", False), (2, "open", False)]), (3, [(1, "open", False)])], "stack_number long, prs array<struct<number: int, state: string, merged: boolean>>")
    got = {r["chain_id"]: r["link_status"] for r in stacks.plan_links(wanted, held, earlier=True).collect()}
    assert got == {1: "created", 3: "extended", 4: "diverged"}


def test_chains_name_the_descendants(spark, data, duck):
    nodes = {(r["source_table"], r["chain_id"], r["chain_pos"]): r["node_id"] for r in registry.QUERIES["p2_chains"](spark, data).collect()}
    got = {
        (r["node_id"], nodes[r["source_table"], r["chain_id"], at]) for r in registry.QUERIES["p2_descendants"](spark, data).collect() if r["source_table"] == "stack_nodes" for at in range(r["from_pos"], r["to_pos"] + 1)
    }
    want = duck.execute("""
        WITH RECURSIVE s AS (SELECT DISTINCT node_id, push_id, branch, base FROM stack_nodes), l AS (SELECT DISTINCT c.node_id AS c, p.node_id AS p FROM s c JOIN s p ON p.push_id = c.push_id AND p.branch = c.base),
        r AS (SELECT p AS a, c AS b FROM l UNION SELECT r.a, l.c FROM r JOIN l ON l.p = r.b), cyc AS (SELECT a FROM r WHERE a = b)
        SELECT a, b FROM r WHERE a NOT IN (SELECT a FROM cyc) AND b NOT IN (SELECT a FROM cyc) AND b NOT IN (SELECT b FROM r WHERE a IN (SELECT a FROM cyc))""").fetchall()
    assert got == set(want)
