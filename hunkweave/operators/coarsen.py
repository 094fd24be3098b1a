"""Slices merged into fewer review units without ever making their dependencies cyclic.

Which merge comes next depends on all merges before it, so each plan's contracted graph (slices, edges, files) is solved whole
in one task; its size is the number of slices, not of changed lines. Plans run in parallel.
"""

from __future__ import annotations

import heapq
import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hunkweave.functions.paths import TEST_FILE
from hunkweave.operators.graph import _kahn
from hunkweave.operators.grouped import solve_groups

OUT = [("unit_num", "long"), ("slice_ids", "array<long>"), ("prerequisites", "array<long>"), ("rules", "array<string>"), ("hunk_count", "long"), ("pinned", "boolean"), ("fallback_only", "boolean"), ("target_met", "boolean"), ("unmet_reason", "string")]


class _Merger:
    """Groups of slices under union, with the acyclicity of their quotient kept."""

    def __init__(self, order: list[int], edges: list[tuple[int, int]], pinned: set[int]) -> None:
        self.order, self.edges, self.pinned = order, edges, pinned
        self.rank = {n: i for i, n in enumerate(order)}
        self.group = {n: n for n in order}
        self.members = {n: [n] for n in order}
        self.rules: dict[int, list[str]] = {}
        self.after: dict[int, set[int]] = {n: set() for n in order}
        self.before: dict[int, set[int]] = {n: set() for n in order}
        for a, b in edges:
            if a != b:
                self.after[a].add(b)
                self.before[b].add(a)

    def quotient(self) -> list[tuple[int, int]]:
        """Edges between groups, in the order of the first edge between their members."""
        return list(dict.fromkeys((self.group[a], self.group[b]) for a, b in self.edges if self.group[a] != self.group[b]))

    def heads(self) -> list[int]:
        return [n for n in self.order if self.group[n] == n]

    def reaches(self, start: int, goal: int) -> bool:
        """True where a path over at least one other group leads from one group to another."""
        seen, todo = set(), [x for x in self.after[start] if x != goal]
        while todo:
            x = todo.pop()
            if x == goal:
                return True
            if x not in seen:
                seen.add(x)
                todo.extend(self.after[x])
        return False

    def merge(self, a: int, b: int, rule: str) -> bool:
        """Join two groups unless one is pinned or a cycle would arise; the earlier group keeps its name."""
        a, b = self.group[a], self.group[b]
        if a == b or a in self.pinned or b in self.pinned or self.reaches(a, b) or self.reaches(b, a):
            return False
        keep, gone = (a, b) if self.rank[a] <= self.rank[b] else (b, a)
        for x in self.after.pop(gone):
            self.before[x].discard(gone)
            if x != keep:
                self.after[keep].add(x)
                self.before[x].add(keep)
        for x in self.before.pop(gone):
            self.after[x].discard(gone)
            if x != keep:
                self.before[keep].add(x)
                self.after[x].add(keep)
        for n in self.members.pop(gone):
            self.group[n] = keep
            self.members[keep].append(n)
        self.members[keep].sort(key=self.rank.__getitem__)
        self.rules.setdefault(keep, []).extend([*self.rules.pop(gone, []), f"{rule}:{gone}>{keep}"])
        return True


def _solve(ids: list[int], files: dict[int, list[str]], reasons: dict[int, set[str] | None], size: dict[int, int], pinned: set[int], edges: list[tuple[int, int]], target: int | None) -> list[dict]:
    """Units of one plan: slices in order with files, hunk counts and, where all their hunks are fallback, the reasons for it."""
    order = _kahn(ids, edges)
    if order is None:
        raise ValueError("a plan with a dependency cycle cannot be coarsened")
    g = _Merger(order, edges, pinned)
    test = re.compile(TEST_FILE).search
    only_tests = {n: all(test(f) for f in files[n]) for n in ids}
    soft = {n: reasons[n] is None or reasons[n] <= {"no-enclosing-symbol"} for n in ids}

    owners: dict[str, list[int]] = {}
    for n in order:
        for f in files[n]:
            owners.setdefault(f, []).append(n)
    for n in order:  # loose hunks join the one group that owns their file
        if reasons[n] is None or not soft[n]:
            continue
        for f in files[n]:
            near = {g.group[o] for o in owners[f] if o != n and reasons[o] is None}
            if len(near) == 1:
                g.merge(n, near.pop(), "same-file")
    needs: dict[int, list[int]] = {n: [] for n in ids}
    used: dict[int, list[int]] = {n: [] for n in ids}
    for a, b in edges:
        needs[a].append(b)
        used[b].append(a)
    for n in order:  # tests join what they are named after, else the one thing they test
        if not only_tests[n]:
            continue
        named = {re.sub(r"\.(test|spec)\.([cm]?[jt]sx?)$", r".\2", f) for f in files[n]}
        named = [o for f in named if not test(f) for o in owners.get(f, ()) if o != n]
        if named and g.merge(n, min(named, key=g.rank.__getitem__), "test-affinity"):
            continue
        tested = {g.group[p] for p in needs[n] if not only_tests[p]}
        if len(tested) == 1:
            g.merge(n, tested.pop(), "test-affinity")
    for n in order:  # what only one group uses joins it
        if g.group[n] != n or all(reasons[m] is not None for m in g.members[n]):
            continue
        users = {g.group[u] for m in g.members[n] for u in used[m]} - {n}
        if len(users) == 1:
            g.merge(n, users.pop(), "sole-consumer")

    met, unmet = True, None
    if target is not None:
        capped = _by_directory(g, files, size, soft, target)
        met = len(g.heads()) <= target
        unmet = None if met else "size-cap" if capped else "structure"
    links = g.quotient()
    final = _kahn(g.heads(), links)
    number = {h: i for i, h in enumerate(final)}
    below: dict[int, list[int]] = {h: [] for h in final}
    for a, b in links:
        below[a].append(number[b])
    return [
        {
            "unit_num": number[h], "slice_ids": g.members[h], "prerequisites": sorted(below[h]), "rules": g.rules.get(h, []),
            "hunk_count": sum(size[m] for m in g.members[h]), "pinned": h in g.pinned, "fallback_only": all(reasons[m] is not None for m in g.members[h]), "target_met": met, "unmet_reason": unmet,
        }
        for h in final
    ]


def _by_directory(g: _Merger, files: dict, size: dict, soft: dict, target: int) -> bool:
    """Merge the smallest neighbours of the deepest shared directory until the target is met; True where the size cap stopped a merge."""
    cap = max(1, math.ceil(sum(size.values()) / target) * 2)
    capped, refused = False, set()
    known: dict[tuple[int, int], tuple[int, list[str]]] = {}

    def weight(h: int) -> int:
        return shape(h)[0]

    def shape(h: int) -> tuple[int, list[str]]:
        """Hunks of a group and the directory parts that all its files share; a group's name and size tell when it changed."""
        key = (h, len(g.members[h]))
        if key not in known:
            paths = [f.split("/")[:-1] for m in g.members[h] for f in files[m]]
            shared = []
            for parts in zip(*paths):
                if len(set(parts)) > 1:
                    break
                shared.append(parts[0])
            known[key] = (sum(size[m] for m in g.members[h]), shared)
        return known[key]

    def prefixes(h: int) -> list[tuple[int, str]]:
        """The directories that a group counts for, as (-depth, name), so that the deepest come first and then by name."""
        if h in g.pinned or not soft[h]:
            return []
        common = shape(h)[1]
        return [(-depth, "/".join(common[:depth])) for depth in range(1, len(common) + 1)]

    rows: dict[tuple[int, str], set[int]] = {}
    of = {h: prefixes(h) for h in g.heads()}
    for h, places in of.items():
        for place in places:
            rows.setdefault(place, set()).add(h)
    # A directory none of whose groups has changed since it was last tried has nothing to merge, so only the others are tried again.
    waiting = list(rows)
    heapq.heapify(waiting)
    queued = set(waiting)
    left = len(g.heads())

    def step(place: tuple[int, str]) -> tuple[int, int] | None:
        nonlocal capped
        row = sorted(rows[place], key=lambda h: (weight(h), g.rank[h]))
        for i, a in enumerate(row):
            for b in row[i + 1 :]:
                if (a, b) in refused:
                    continue
                if weight(a) + weight(b) > cap:
                    capped = True
                    break  # the rest of the row is no lighter
                if g.merge(a, b, "directory-affinity"):
                    return a, b
                refused.add((a, b))
        return None

    while left > target and waiting:
        place = waiting[0]
        pair = step(place)
        if pair is None:
            queued.discard(heapq.heappop(waiting))
            continue
        left -= 1
        touched = set()
        for h in pair:
            for p in of.pop(h):
                rows[p].discard(h)
                touched.add(p)
        keep = g.group[pair[0]]
        of[keep] = prefixes(keep)
        for p in of[keep]:
            rows.setdefault(p, set()).add(keep)
        for p in touched.union(of[keep]) - queued:
            heapq.heappush(waiting, p)
            queued.add(p)
    return capped


def coarsen(units: DataFrame, edges: DataFrame, target: int | None = None, scope: str = "diff_id") -> DataFrame:
    """(scope, unit_num, slice_ids, prerequisites, …): the review units of every plan, in dependency order.

    ``units``: (scope, slice_id, seq, files, reasons, hunk_count, fallback_only, pinned), ``edges``: (scope, src, dst, seq). A
    pinned slice never merges. Plans with a cycle are an error. A target below one is refused.
    """
    if target is not None and target < 1:
        raise ValueError("the target must be at least 1")
    nothing = {n: F.lit(None).cast(t) for n, t in units.select("files", "reasons", "hunk_count", "fallback_only", "pinned").dtypes}
    at = Window.partitionBy(scope)
    slices = units.select(scope, F.col("slice_id").cast("long").alias("slice_id"), F.lit(None).cast("long").alias("dst"), F.row_number().over(at.orderBy("seq", "slice_id")).alias("at"), *nothing)
    links = edges.select(scope, F.col("src").cast("long").alias("slice_id"), F.col("dst").cast("long").alias("dst"), F.row_number().over(at.orderBy("seq", "src", "dst")).alias("at"), *[c.alias(n) for n, c in nothing.items()])

    def run(key: object, group: dict[str, list]) -> list[tuple]:
        own = [i for i, d in enumerate(group["dst"]) if d is None]
        ids = [group["slice_id"][i] for i in own]

        def column(name: str) -> dict:
            return dict(zip(ids, (group[name][i] for i in own)))

        loose, reasons = column("fallback_only"), column("reasons")
        found = _solve(
            ids, column("files"), {n: set(reasons[n]) if loose[n] else None for n in ids}, column("hunk_count"), {n for n, p in column("pinned").items() if p},
            [(a, d) for a, d in zip(group["slice_id"], group["dst"]) if d is not None], target,
        )
        return [(key, *(unit[name] for name, _ in OUT)) for unit in found]

    return solve_groups(slices.unionByName(links), scope, ["at"], run, [(scope, scope), *OUT])
