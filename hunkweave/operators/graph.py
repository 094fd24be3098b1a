"""Graph operators over edge relations (scope, src, dst), where ``src`` needs ``dst``.

Set-at-a-time operators run in rounds of joins over all scopes at once and write each round to the shared folder. An
ordering that is sequential by nature runs whole per scope in one task, over the slices of a plan, never over its rows.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hunkweave.operators.grouped import solve_groups
from hunkweave.operators.hierarchy import hierarchy
from hunkweave.runtime import Growing, fits, materialize, release


def components(edges: DataFrame, scope: str = "scope", a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(scope, node, component) of undirected links; the component is its least node.

    Each round takes the least label around a node and then the label of that label, so labels travel twice as far each round.
    """
    both = edges.select(scope, F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = materialize(both.unionByName(both.select(scope, F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = materialize(both.groupBy(scope, F.col("x").alias("node")).agg(F.min("y").alias("m")).select(scope, "node", F.least("node", "m").alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "y"), [scope, "y"]).groupBy(scope, F.col("x").alias("node")).agg(F.min("component").alias("m"))
        least = labels.join(near, [scope, "node"]).select(scope, "node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        up = labels.select(scope, F.col("node").alias("component"), F.col("component").alias("up"))
        new = materialize(least.join(up, [scope, "component"], "left").select(scope, "node", F.coalesce("up", "component").alias("component"), "old"))
        changed = not fits(new.where("component <> old"), 0)
        release(labels)
        labels = new
        if not changed:
            return labels.select(scope, "node", "component")
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def closure(edges: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, src, dst) of every pair joined by a path of one or more edges, pairs within cycles and self-links included.

    Path lengths double each round, and a round starts only from the pairs first found in the round before: the shortest way
    of any farther pair begins with one of them. Rounds append to one table and none rewrites the pairs known before.
    """
    keys = [scope, "src", "dst"]
    reach = Growing(edges.sparkSession)
    fresh = reach.add(edges.select(*keys).distinct())
    while not fits(fresh, 0):
        known = reach.read()
        onward = known.select(scope, F.col("src").alias("dst"), F.col("dst").alias("far"))
        longer = fresh.join(onward, [scope, "dst"]).select(scope, "src", F.col("far").alias("dst")).distinct()
        fresh = reach.add(longer.join(known, keys, "left_anti"))
    return reach.read()


def _numbered(nodes: DataFrame, edges: DataFrame, scope: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Nodes and links of ``hierarchy`` for names of any type, and the names (grp, node_id, scope, node), null where nodes are numbers."""
    both = nodes.select(scope, "node").unionByName(edges.select(scope, F.col("src").alias("node"))).unionByName(edges.select(scope, F.col("dst").alias("node"))).dropna()
    if dict(nodes.dtypes)["node"] in ("tinyint", "smallint", "int", "bigint"):
        names, number = None, lambda c: F.col(c).cast("long")
        n = both.select(F.col(scope).cast("string").alias("grp"), number("node").alias("node_id"))
    else:
        distinct = materialize(both.distinct())
        for seed in range(8):
            number = lambda c, seed=seed: F.xxhash64(F.lit(seed), F.col(c))
            names = distinct.select(F.col(scope).cast("string").alias("grp"), number("node").alias("node_id"), scope, "node")
            if names.groupBy("grp", "node_id").count().where("count > 1").isEmpty():
                break
        else:
            raise RuntimeError("no collision-free numbering of the nodes was found")
        n = names.select("grp", "node_id")
    links = edges.select(F.col(scope).cast("string").alias("grp"), number("src").alias("node_id"), number("dst").alias("parent_id"))
    return n, links, names


def _named(rows: DataFrame, column: str, names: DataFrame | None, scope: str, kinds: dict[str, str]) -> DataFrame:
    """(scope, node, column) again; the column is a node itself where it is called ``component``."""
    if names is None:
        value = F.col(column).cast(kinds["node"]) if column == "component" else F.col(column)
        return rows.select(F.col("grp").cast(kinds[scope]).alias(scope), F.col("node_id").cast(kinds["node"]).alias("node"), value.alias(column))
    return rows.join(names, ["grp", "node_id"]).select(scope, "node", column)


def levels(nodes: DataFrame, edges: DataFrame, scope: str = "scope", max_group_rows: int = 200_000) -> DataFrame:
    """(scope, node, level): the longest path down to a node that needs nothing; null on or above a cycle.

    Levels are depths of the hierarchy whose roots need nothing, so long chains cost no more rounds than short ones.
    """
    kinds = dict(nodes.dtypes)
    n, links, names = _numbered(nodes, edges, scope)
    found = hierarchy(n, links, "levels", max_group_rows)
    return _named(found.withColumn("level", F.col("level").cast("int")), "level", names, scope, kinds)


def _kahn(nodes: list, edges: list[tuple]) -> list | None:
    waiting = dict.fromkeys(nodes, 0)
    after: dict = {n: [] for n in nodes}
    for src, dst in edges:
        after[dst].append(src)
        waiting[src] += 1
    ready = deque(n for n in nodes if not waiting[n])
    out = []
    while ready:
        n = ready.popleft()
        out.append(n)
        for m in after[n]:
            waiting[m] -= 1
            if not waiting[m]:
                ready.append(m)
    return out if len(out) == len(nodes) else None


def kahn_order(nodes: DataFrame, edges: DataFrame, scope: str = "scope", max_group_rows: int = 500_000) -> DataFrame:
    """(scope, node, topo_num): first in, first out order of dependencies before dependents; null for all nodes of a cyclic scope.

    ``nodes``: (scope, node, seq), ``edges``: (scope, src, dst, seq) with any orderable seq; ties fall to the names. A scope of up to
    ``max_group_rows`` nodes and edges is ordered in one task. A larger one is ordered level by level over all executors,
    with the same result: its nodes come by level, within a level by the place of the last node they waited for, then by the edge to it.
    """
    kinds = dict(nodes.dtypes)
    sizes = nodes.select(scope).unionByName(edges.select(scope)).groupBy(scope).count().where(F.col("count") > max_group_rows).select(scope)
    if fits(sizes, 0):
        return _ordered_in_tasks(nodes, edges, scope, kinds)
    sizes = materialize(sizes)
    small = _ordered_in_tasks(nodes.join(sizes, scope, "left_anti"), edges.join(sizes, scope, "left_anti"), scope, kinds)
    return small.unionByName(_ordered_by_level(materialize(nodes.join(sizes, scope, "left_semi")), materialize(edges.join(sizes, scope, "left_semi")), scope))


def _ordered_in_tasks(nodes: DataFrame, edges: DataFrame, scope: str, kinds: dict[str, str]) -> DataFrame:
    seq = Window.partitionBy(scope)
    n = nodes.select(scope, "node", F.row_number().over(seq.orderBy("seq", "node")).alias("at"), F.lit(None).cast(kinds["node"]).alias("dst"))
    e = edges.select(scope, F.col("src").alias("node"), F.row_number().over(seq.orderBy("seq", "src", "dst")).alias("at"), "dst")

    def order(key: object, group: dict[str, list]) -> list[tuple]:
        names = [x for x, d in zip(group["node"], group["dst"]) if d is None]
        known = set(names)
        found = _kahn(names, [(x, d) for x, d in zip(group["node"], group["dst"]) if d is not None and x in known and d in known])
        return [(key, x, i) for i, x in enumerate(found)] if found is not None else [(key, x, None) for x in names]

    return solve_groups(n.unionByName(e), scope, ["at"], order, [(scope, scope), ("node", "node"), ("topo_num", "long")])


def _ranked(rows: DataFrame, scope: str, order: list[str], name: str) -> DataFrame:
    """Rows with their place from 0 within the scope, sorted over all executors: places within ranges, shifted by the ranges before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(rows.repartitionByRange(parts, scope, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(scope).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy(scope, "_range").agg(F.count(F.lit(1)).alias("_n")).select(scope, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(scope, "_range").orderBy(*order)) - 1
    out = materialize(ranged.withColumn("_place", place).join(F.broadcast(shift), [scope, "_range"]).withColumn(name, F.col("_place") + F.col("_before")).drop("_range", "_place", "_before"))
    release(ranged)
    return out


def _ordered_by_level(nodes: DataFrame, edges: DataFrame, scope: str) -> DataFrame:
    known = nodes.select(scope, "node")
    need = edges.join(known.withColumnRenamed("node", "src"), [scope, "src"], "left_semi").join(known.withColumnRenamed("node", "dst"), [scope, "dst"], "left_semi")
    need = materialize(need.groupBy(scope, "src", "dst").agg(F.max("seq").alias("seq")))  # of several edges the last one lets go
    level = materialize(levels(known, need, scope))
    cyclic = materialize(level.where("level is null").select(scope).distinct())
    sound = materialize(level.join(cyclic, scope, "left_anti"))
    last = sound.agg(F.max("level")).first()[0]
    placed = Growing(nodes.sparkSession)
    roots = sound.where("level = 0").join(nodes, [scope, "node"]).groupBy(scope, "node").agg(F.min("seq").alias("seq"))
    now = placed.add(_ranked(roots, scope, ["seq", "node"], "topo_num").select(scope, "node", "topo_num"))
    for depth in range(1, (last or 0) + 1):
        start = placed.read().groupBy(scope).agg((F.max("topo_num") + 1).alias("_start"))
        here = sound.where(F.col("level") == depth).select(scope, F.col("node").alias("src"))
        at = need.join(here, [scope, "src"], "left_semi").join(placed.read().withColumnRenamed("node", "dst"), [scope, "dst"])
        waited = at.groupBy(scope, F.col("src").alias("node")).agg(F.max(F.struct(F.col("topo_num").alias("_pos"), "dst")).alias("_w"))
        edge = need.select(scope, F.col("src").alias("node"), "dst", "seq")
        keyed = waited.select(scope, "node", "_w._pos", F.col("_w.dst").alias("dst")).join(edge, [scope, "node", "dst"]).select(scope, "node", "_pos", "seq")
        ranked = _ranked(keyed, scope, ["_pos", "seq", "node"], "_r").join(start, scope)
        now = placed.add(ranked.select(scope, "node", (F.col("_r") + F.col("_start")).alias("topo_num")))
    bad = level.join(cyclic, scope, "left_semi").select(scope, "node", F.lit(None).cast("long").alias("topo_num"))
    return placed.read().unionByName(bad)


def strong_components(edges: DataFrame, scope: str = "scope", max_group_rows: int = 200_000) -> DataFrame:
    """(scope, node, component) of the nodes in cycles of two or more; the component is its least node. No closure is built."""
    nodes = edges.select(scope, F.col("src").alias("node"))
    kinds = dict(nodes.dtypes)
    n, links, names = _numbered(nodes, edges.where("src <> dst"), scope)
    found = hierarchy(n, links, "cycles", max_group_rows)
    if names is None:
        return _named(found, "component", None, scope, kinds)
    held = materialize(found.join(names, ["grp", "node_id"]).select(scope, "node", F.col("component").alias("_c")))
    least = held.groupBy(scope, "_c").agg(F.min("node").alias("component"))
    return held.join(least, [scope, "_c"]).select(scope, "node", "component")


def cycle_report(edges: DataFrame, cyclic: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, component, members, internal_edges): each cycle with its sorted members and the edges inside it."""
    s = cyclic.select(scope, F.col("node").alias("src"), "component")
    d = cyclic.select(scope, F.col("node").alias("dst"), "component")
    inside = edges.select(scope, "src", "dst").distinct().join(s, [scope, "src"]).join(d, [scope, "dst", "component"])
    links = inside.groupBy(scope, "component").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("internal_edges"))
    return cyclic.groupBy(scope, "component").agg(F.array_sort(F.collect_set("node")).alias("members")).join(links, [scope, "component"], "left")


def quotient(edges: DataFrame, membership: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, src, dst) between groups. ``membership``: (scope, node, grp). Edges within a group or without one fall away."""
    s = membership.select(scope, F.col("node").alias("src"), F.col("grp").alias("gs"))
    d = membership.select(scope, F.col("node").alias("dst"), F.col("grp").alias("gd"))
    return edges.join(s, [scope, "src"]).join(d, [scope, "dst"]).where("gs <> gd").select(scope, F.col("gs").alias("src"), F.col("gd").alias("dst")).distinct()


def adjacency(edges: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, node, prereqs, dependents): distinct direct neighbours of every node with an edge, sorted."""
    down = edges.select(scope, F.col("src").alias("node"), F.col("dst").alias("p"), F.lit(None).cast(dict(edges.dtypes)["src"]).alias("d"))
    up = edges.select(scope, F.col("dst").alias("node"), F.lit(None).cast(dict(edges.dtypes)["dst"]).alias("p"), F.col("src").alias("d"))
    return down.unionByName(up).groupBy(scope, "node").agg(F.array_sort(F.collect_set("p")).alias("prereqs"), F.array_sort(F.collect_set("d")).alias("dependents"))


def maximal(edges: DataFrame, reach: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, src, dst): the needed nodes that no other needed node of ``src`` needs, over the closure ``reach``."""
    mine = edges.select(scope, "src", F.col("dst").alias("mid"))
    covered = mine.join(reach.select(scope, F.col("src").alias("mid"), "dst"), [scope, "mid"]).where("mid <> dst").select(scope, "src", "dst")
    return edges.select(scope, "src", "dst").distinct().join(covered, [scope, "src", "dst"], "left_anti")


def ordered_prerequisites(reach: DataFrame, ranks: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, node, prereqs): all needed nodes in order of rank. ``ranks``: (scope, node, rank)."""
    ranked = reach.join(ranks.withColumnRenamed("node", "dst"), [scope, "dst"])
    pairs = F.array_sort(F.collect_list(F.struct("rank", "dst")))
    return ranked.groupBy(scope, F.col("src").alias("node")).agg(F.transform(pairs, lambda p: p["dst"]).alias("prereqs"))


def bases(prerequisites: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, node, base_kind, base_node): what a unit is built on.

    ``root`` without prerequisites; ``reuse`` when the last prerequisite with its own prerequisites is exactly the list;
    else ``integration``. ``prerequisites``: (scope, node, prereqs) for every node, empty arrays included.
    """
    top = F.try_element_at("prereqs", F.lit(-1))
    below = prerequisites.select(scope, F.col("node").alias("_top"), F.col("prereqs").alias("_below"))
    joined = prerequisites.withColumn("_top", top).join(below, [scope, "_top"], "left")
    reuse = F.concat(F.coalesce("_below", F.array().cast(dict(prerequisites.dtypes)["prereqs"])), F.array("_top")) == F.col("prereqs")
    kind = F.when(F.size("prereqs") == 0, "root").when(reuse, "reuse").otherwise("integration")
    return joined.select(scope, "node", kind.alias("base_kind"), F.when(kind == "reuse", F.col("_top")).alias("base_node"))


def propagate(reach: DataFrame, flagged: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, node): the flagged nodes and all that need one of them, over the closure ``reach``."""
    above = reach.join(flagged.select(scope, F.col("node").alias("dst")), [scope, "dst"], "left_semi").select(scope, F.col("src").alias("node"))
    return above.unionByName(flagged.select(scope, "node")).distinct()


def selection(chosen: DataFrame, reach: DataFrame, ranks: DataFrame, stacked: bool, scope: str = "scope") -> DataFrame:
    """(scope, node) to build for the chosen nodes: with their prerequisites, or in a stack all up to the last chosen rank."""
    if stacked:
        last = ranks.join(chosen, [scope, "node"]).groupBy(scope).agg(F.max("rank").alias("_last"))
        return ranks.join(last, scope).where("rank <= _last").select(scope, "node")
    below = reach.join(chosen.select(scope, F.col("node").alias("src")), [scope, "src"], "left_semi").select(scope, F.col("dst").alias("node"))
    return below.unionByName(chosen.select(scope, "node")).distinct()


def base_roots(nodes: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, branch, parent, child_count): parent by base pointer, null at a root; a node based on itself is a root."""
    kids = nodes.where("base <> branch").groupBy(scope, F.col("base").alias("branch")).agg(F.count(F.lit(1)).alias("child_count"))
    known = nodes.select(scope, F.col("branch").alias("base"), F.lit(True).alias("_known")).distinct()
    return (
        nodes.join(known, [scope, "base"], "left").join(kids, [scope, "branch"], "left")
        .select(scope, "branch", F.when(F.col("_known") & (F.col("base") != F.col("branch")), F.col("base")).alias("parent"), F.coalesce("child_count", F.lit(0)).alias("child_count"))
    )
