"""Parent links turned into full hierarchies: roots, depths, paths and descendants, with cycles set apart.

Nodes on or below a cycle are separated first. The rest is cut into heavy paths: each node keeps one parent, the least,
subtree sizes over these links choose one child per node to continue the node's chain (of equal sizes the least child), and
every other link is light. Paths are concatenations of chain segments, descendants are suffixes of chains.

Groups of bounded size (a push, a manifest) are solved whole inside one task, many groups at a time. Larger groups go
through the distributed form in ``hunkweave.operators.deep_hierarchy``, which gives the same rows by the same rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkweave.runtime import fits

ON_CYCLE, INTO_CYCLE = -1, -2

SCHEMAS = {
    "roots": "grp string, node_id long, root_id long, node_depth long",
    "paths": "grp string, node_id long, root_id long, node_depth long, path array<long>",
    "chains": "grp string, node_id long, chain_id long, chain_pos long, subtree_size long",
    "descendants": "grp string, node_id long, chain_id long, from_pos long, to_pos long",
    "levels": "grp string, node_id long, level long",
    "cycles": "grp string, node_id long, component long",
}


class Forest:
    """Heavy paths of one set of links. Nodes are 0..n-1; ``parents[v]`` lists distinct parents of v."""

    def __init__(self, n: int, links: list[tuple[int, int]]) -> None:
        self.n = n
        self.parents: list[list[int]] = [[] for _ in range(n)]
        self.children: list[list[int]] = [[] for _ in range(n)]
        for child, parent in sorted(set(links)):
            self.parents[child].append(parent)
            self.children[parent].append(child)
        self._separate_cycles()
        self._chains()

    def _separate_cycles(self) -> None:
        waiting = [len(p) for p in self.parents]
        order = [v for v in range(self.n) if not waiting[v]]
        for v in order:
            for c in self.children[v]:
                waiting[c] -= 1
                if not waiting[c]:
                    order.append(c)
        self.order = order
        self.sound = [not w for w in waiting]
        self.rings = self._rings([v for v in range(self.n) if waiting[v]])
        self.on_cycle = {v for ring in self.rings for v in ring}

    def _rings(self, left: list[int]) -> list[list[int]]:
        """Strongly connected components with a cycle, among the nodes the ordering could not reach; sorted members."""
        index: dict[int, int] = {}
        low: dict[int, int] = {}
        stack: list[int] = []
        held: set[int] = set()
        found: list[list[int]] = []
        for start in left:
            if start in index:
                continue
            work = [(start, iter(self.parents[start]))]
            index[start] = low[start] = len(index)
            stack.append(start)
            held.add(start)
            while work:
                v, rest = work[-1]
                for p in rest:
                    if self.sound[p]:
                        continue
                    if p not in index:
                        index[p] = low[p] = len(index)
                        stack.append(p)
                        held.add(p)
                        work.append((p, iter(self.parents[p])))
                        break
                    if p in held:
                        low[v] = min(low[v], index[p])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[v])
                    if low[v] == index[v]:
                        members = []
                        while not members or members[-1] != v:
                            members.append(stack.pop())
                        held.difference_update(members)
                        if len(members) > 1 or v in self.parents[v]:
                            found.append(sorted(members))
        return found

    def levels(self) -> list[int]:
        """Links on the longest way up from each node to a root; of no meaning for nodes on or below cycles."""
        level = [0] * self.n
        for v in self.order:
            for p in self.parents[v]:
                level[v] = max(level[v], level[p] + 1)
        return level

    def _chains(self) -> None:
        keep = [p[0] if p else -1 for p in self.parents]
        size = [1] * self.n
        heavy = [-1] * self.n
        for v in reversed(self.order):
            if keep[v] >= 0:
                size[keep[v]] += size[v]
        for v in self.order:
            p = keep[v]
            if p >= 0 and (heavy[p] < 0 or (size[v], -v) > (size[heavy[p]], -heavy[p])):
                heavy[p] = v
        chain, pos = [-1] * self.n, [0] * self.n
        members: dict[int, list[int]] = {}
        before = [-1] * self.n
        for v in self.order:
            p = keep[v]
            if p >= 0 and heavy[p] == v:
                chain[v], pos[v], before[v] = chain[p], pos[p] + 1, p
            else:
                chain[v] = v
            members.setdefault(chain[v], []).append(v)
        self.size, self.chain, self.pos, self.members, self.before = size, chain, pos, members, before

    def reach_roots(self) -> Iterator[tuple[int, dict[int, tuple[int, int, int]]]]:
        """(node, {root: (depth - position, entry node, light parent)}) in topological order.

        Along a chain the map only grows where light links enter, so it is kept per chain and copied where a light
        link leaves. Of equally long ways the one over the least parent holds; the link within a chain is to the least.
        """
        running: dict[int, dict[int, tuple[int, int, int]]] = {}
        kept: dict[int, dict[int, tuple[int, int, int]]] = {}
        self.kept = kept
        for v in self.order:
            c, at = self.chain[v], self.pos[v]
            here = running.setdefault(c, {})
            if not self.parents[v]:
                here[v] = (0, v, -1)
            for p in self.parents[v]:
                if p != self.before[v]:
                    for r, (offset, _, _) in kept[p].items():
                        d = offset + self.pos[p] + 1 - at
                        if r not in here or d > here[r][0]:
                            here[r] = (d, v, p)
            if any(self.before[x] != v for x in self.children[v] if self.sound[x]):
                kept[v] = dict(here)
            yield v, here

    def path(self, v: int, here: dict[int, tuple[int, int, int]], root: int) -> list[int]:
        """Node numbers from the root to v along one longest way."""
        segments = []
        while True:
            _, entry, parent = here[root]
            c = self.members[self.chain[v]]
            segments.append(c[self.pos[entry] : self.pos[v] + 1])
            if parent < 0:
                return [x for s in reversed(segments) for x in s]
            v, here = parent, self.kept[parent]

    def reach_down(self) -> Iterator[tuple[int, dict[int, int]]]:
        """(node, {chain: first position below the node}) in reverse topological order; each entry is a suffix of its chain."""
        running: dict[int, dict[int, int]] = {}
        kept: dict[int, dict[int, int]] = {}
        for v in reversed(self.order):
            c = self.chain[v]
            here = running.setdefault(c, {})
            if self.pos[v] + 1 < len(self.members[c]):
                here[c] = self.pos[v] + 1
            for x in self.children[v]:
                if self.sound[x] and self.before[x] != v:
                    below = kept[x]
                    for k, first in [*below.items(), (self.chain[x], self.pos[x])]:
                        if k not in here or first < here[k]:
                            here[k] = first
            if any(p != self.before[v] for p in self.parents[v]):
                kept[v] = dict(here)
            yield v, here


def _solve(groups: np.ndarray, child: np.ndarray, parent: np.ndarray, linked: np.ndarray, kind: str) -> dict[str, list]:
    """Rows of one output for a set of whole groups; group numbers and node ids together name a node."""
    pairs = np.concatenate([np.stack([groups, child], 1), np.stack([groups[linked], parent[linked]], 1)])
    names, codes = np.unique(pairs, axis=0, return_inverse=True)
    codes = codes.reshape(-1)
    at = np.flatnonzero(linked)
    forest = Forest(len(names), list(zip(codes[at].tolist(), codes[len(groups) :].tolist())))
    ids, grp = names[:, 1].tolist(), names[:, 0].tolist()
    out: dict[str, list] = {name.split()[0]: [] for name in SCHEMAS[kind].split(", ")}
    columns = list(out.values())

    def emit(*row) -> None:
        for c, x in zip(columns, row):
            c.append(x)

    if kind in ("roots", "paths"):
        for v, here in forest.reach_roots():
            for r, (offset, _, _) in here.items():
                extra = ([ids[x] for x in forest.path(v, here, r)],) if kind == "paths" else ()
                emit(grp[v], ids[v], ids[r], offset + forest.pos[v], *extra)
        for v in range(forest.n):
            if not forest.sound[v]:
                emit(grp[v], ids[v], -1, ON_CYCLE if v in forest.on_cycle else INTO_CYCLE, *([None] if kind == "paths" else []))
    elif kind == "levels":
        level = forest.levels()
        for v in range(forest.n):
            emit(grp[v], ids[v], level[v] if forest.sound[v] else None)
    elif kind == "cycles":
        for ring in forest.rings:
            for v in ring:
                emit(grp[v], ids[v], ids[ring[0]])
    elif kind == "chains":
        for v in forest.order:
            emit(grp[v], ids[v], ids[forest.chain[v]], forest.pos[v], forest.size[v])
    else:
        for v, here in forest.reach_down():
            for c, first in here.items():
                emit(grp[v], ids[v], ids[c], first, len(forest.members[c]) - 1)
    return out


def _worker(kind: str, batch_rows: int):
    schema = pa.schema([
        (f.split()[0], {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}[f.split()[1]]) for f in SCHEMAS[kind].split(", ")
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            coded = rows["grp"].combine_chunks().dictionary_encode()
            parent = rows["parent_id"].combine_chunks()
            linked = np.asarray(parent.is_valid())
            got = _solve(np.asarray(coded.indices).astype(np.int64), rows["node_id"].to_numpy(), parent.fill_null(0).to_numpy(zero_copy_only=False), linked, kind)
            got["grp"] = coded.dictionary.take(pa.array(got["grp"], pa.int64()))
            yield from pa.table(got, schema=schema).to_batches(max_chunksize=20_000)

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < batch_rows:
                continue
            rows = pa.Table.from_batches(held)
            names = rows["grp"].to_pylist()
            cut = len(names)
            while cut and names[cut - 1] == names[-1]:
                cut -= 1
            if cut:
                yield from solved(rows.slice(0, cut))
            held, count = rows.slice(cut).combine_chunks().to_batches(), len(names) - cut
        if count:
            yield from solved(pa.Table.from_batches(held))

    return run


def hierarchy(nodes: DataFrame, links: DataFrame, kind: str = "roots", max_group_rows: int = 200_000, batch_rows: int = 50_000) -> DataFrame:
    """Solve all groups. ``nodes``: (grp string, node_id long); ``links``: (grp, node_id, parent_id).

    ``kind`` picks the result: ``roots`` gives (grp, node_id, root_id, node_depth) for each root a node reaches, with the
    longest distance; a node on a cycle gives (-1, -1), one that leads into a cycle (-1, -2). ``paths`` adds the node
    ids from root to node along one longest way (ties fall to the smaller parent id). ``chains`` gives the heavy paths,
    ``descendants`` the chain intervals below each node; both leave out nodes on or below cycles.

    Repeated nodes and links count once; rows with a null group, node or parent are ignored; links to or from unlisted
    nodes make those nodes known. A node without links is its own root. Empty input gives an empty result.
    Groups of more than ``max_group_rows`` nodes and links take the distributed form; the result does not depend on it.
    """
    rows = (
        nodes.select("grp", "node_id", F.lit(None).cast("long").alias("parent_id"))
        .unionByName(links.select("grp", "node_id", "parent_id").dropna())
        .dropna(subset=["grp", "node_id"])
    )
    large = rows.groupBy("grp").count().where(F.col("count") > max_group_rows).select("grp")
    has_large = not fits(large, 0)
    small = rows.join(large, "grp", "left_anti") if has_large else rows
    out = small.repartition("grp").sortWithinPartitions("grp").mapInArrow(_worker(kind, batch_rows), SCHEMAS[kind])
    if has_large:
        from hunkweave.operators.deep_hierarchy import deep_hierarchy

        out = out.unionByName(deep_hierarchy(rows.join(large, "grp", "left_semi"), kind))
    return out


def stack_links(stack_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and parent links of stacks: the base of a node names the branch of its parent within the push."""
    grp = F.concat(F.lit("stack_nodes:"), F.col("push_id").cast("string")).alias("grp")
    base = stack_nodes.select(grp, "node_id", "branch", "base").dropDuplicates(["node_id"])
    parents = base.select("grp", F.col("branch").alias("base"), F.col("node_id").alias("parent_id"))
    return base.select("grp", "node_id"), base.select("grp", "node_id", "base").join(parents, ["grp", "base"]).select("grp", "node_id", "parent_id")


def entry_links(projections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and parent links of entries: depends_on names projection ids of the same manifest."""
    grp = F.concat(F.lit("projections:"), F.col("manifest_id").cast("string")).alias("grp")
    base = projections.select(grp, F.col("entry_id").alias("node_id"), "projection_id", "depends_on").dropDuplicates(["node_id"])
    parents = base.select("grp", F.col("projection_id").alias("need"), F.col("node_id").alias("parent_id"))
    wants = base.select("grp", "node_id", F.explode(F.array_distinct("depends_on")).alias("need"))
    return base.select("grp", "node_id"), wants.join(parents, ["grp", "need"]).select("grp", "node_id", "parent_id")


def record_hierarchy(stack_nodes: DataFrame, projections: DataFrame, kind: str = "roots", **options) -> DataFrame:
    """Hierarchies of both tables in one pass, with the table's name instead of the group."""
    (a, b), (c, d) = stack_links(stack_nodes), entry_links(projections)
    out = hierarchy(a.unionByName(c), b.unionByName(d), kind, **options)
    return out.withColumn("source_table", F.split_part("grp", F.lit(":"), F.lit(1))).drop("grp")
