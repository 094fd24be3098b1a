"""Pairwise matches consolidated into groups on a two-dimensional grid of blocks.

Vertices hash into blocks and edges into the cells of the grid of block pairs, so that even a vertex with a third of all
edges spreads over a whole row of cells; a cell that such a vertex still makes too large is cut by a hash of its edges. Every cell runs union-find over its own edges. The representatives that a
vertex got in the cells of its row and column are then exchanged: the least becomes its parent, and each other one is
linked to it by an edge of the next round. Rounds go on until no edge is left.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkweave.functions.text import tidy
from hunkweave.runtime import fits, join_unique, materialize, release


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over one cell: its vertices and, for each, the least vertex it is joined to."""
    names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(names)))
    half = len(a)
    for x, y in zip(codes[:half].tolist(), codes[half:].tolist()):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x < y:
            root[y] = x
        elif y < x:
            root[x] = y
    for i in range(len(root)):  # a parent is always smaller, hence final already
        root[i] = root[root[i]]
    return names, names[np.asarray(root, dtype=np.int64)] if len(root) else names


def _solve_cell(cell: pa.Table) -> pa.Table:
    v, r = local_roots(cell["a"].to_numpy(), cell["b"].to_numpy())
    return pa.table({"v": pa.array(v, pa.int64()), "r": pa.array(r, pa.int64())})


def _block(v: str, blocks: int, turn: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(turn), F.col(v)), F.lit(blocks)).cast("int")


def _cells(left: DataFrame, count: int, cell_edges: int, turn: int) -> DataFrame:
    """Edges with the cell that each is solved in. No cell holds much more than ``cell_edges`` edges, whatever the degrees.

    Any cut of the edges gives right components, since what a vertex is joined to in different parts meets in the exchange.
    The cells that need a cut are at most one for every ``cell_edges`` edges.
    """
    blocks = max(1, math.ceil(math.sqrt(count / cell_edges)))
    cells = left.select("a", "b", (_block("a", blocks, turn) * blocks + _block("b", blocks, turn)).alias("cell"))
    if blocks == 1:
        return cells.withColumn("part", F.lit(0))
    sizes = cells.groupBy("cell").count().where(F.col("count") > 2 * cell_edges).select("cell", F.ceil(F.col("count") / cell_edges).cast("int").alias("_parts"))
    sizes = F.broadcast(sizes) if fits(sizes, 1_000_000) else sizes
    cut = F.pmod(F.xxhash64(F.lit(turn), "b", "a"), F.coalesce("_parts", F.lit(1))).cast("int")
    return cells.join(sizes, "cell", "left").select("a", "b", "cell", cut.alias("part"))


def grid_components(edges: DataFrame, cell_edges: int = 250_000, max_rounds: int = 60) -> DataFrame:
    """(v, component) for every vertex of (a, b) edges of type long; the component is the least vertex of the group.

    Self-links and repeats change nothing but make their vertex known; edges with a null end are ignored. An empty input
    gives an empty result. ``cell_edges`` is the number of edges a cell aims at and sets the size of the grid, which
    shrinks with the edges from round to round; edges for one cell alone are settled in it.
    """
    left = materialize(
        edges.dropna(subset=["a", "b"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    steps: list[DataFrame] = []
    for turn in range(max_rounds):
        count = left.count()
        if not count:
            break
        local = _cells(left, count, cell_edges, turn).groupBy("cell", "part").applyInArrow(_solve_cell, "v long, r long")
        if count <= cell_edges:  # one cell has seen every edge, so its roots are the groups
            steps.append(materialize(local.withColumnRenamed("r", "p")))
            release(left)
            break
        local = materialize(local)
        step = materialize(local.groupBy("v").agg(F.min("r").alias("p")))
        steps.append(step)
        new = materialize(
            join_unique(local, step, "v").where(F.col("r") != F.col("p"))
            .select(F.least("r", "p").alias("a"), F.greatest("r", "p").alias("b")).distinct()
        )
        release(local)
        release(left)
        left = new
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    if not steps:
        return edges.sparkSession.createDataFrame([], "v long, component long")
    # Later rounds only hold representatives, so parents resolve from the last round back to the first.
    known = steps[-1].select("v", F.col("p").alias("component"))
    for step in reversed(steps[:-1]):
        up = known.select(F.col("v").alias("p"), F.col("component"))
        known = join_unique(step, up, "p", "left").select("v", F.coalesce("component", "p").alias("component"))
    return known


def merge_groups(overrides: DataFrame, cell_edges: int = 250_000) -> DataFrame:
    """(branch, selector, group_selector) of every selector named by a force_merge row.

    Blanks around selectors do not count; null and empty ones are left out, but the other selector of their row is kept.
    Selectors of different branches never join; a null branch is a branch. group_selector is the least by code points.
    """
    rows = overrides.where(F.col("kind") == "force_merge").select("branch", tidy("selector_a").alias("x"), tidy("selector_b").alias("y")).distinct()
    rows = materialize(rows)
    names = rows.select("branch", F.explode(F.array("x", "y")).alias("selector")).where(F.col("selector").isNotNull()).distinct()

    def number(seed: int, selector: str) -> Column:
        return F.xxhash64(F.lit(seed), F.col("branch").isNull(), F.coalesce(F.col("branch"), F.lit("")), F.col(selector))

    for seed in range(8):  # a 64-bit number must name one vertex only; at billions of vertices a clash is possible
        clashes = names.groupBy(number(seed, "selector").alias("v")).count().where(F.col("count") > 1)
        if clashes.isEmpty():
            break
    else:
        raise RuntimeError("no collision-free numbering of the selectors was found")
    edges = rows.select(number(seed, "x").alias("nx"), number(seed, "y").alias("ny"), "x", "y").where("x is not null or y is not null")
    ends = edges.select(
        F.when(F.col("x").isNull(), F.col("ny")).otherwise(F.col("nx")).alias("a"), F.when(F.col("y").isNull(), F.col("nx")).otherwise(F.col("ny")).alias("b")
    )
    member = names.withColumn("v", number(seed, "selector")).join(grid_components(ends, cell_edges), "v")
    member = materialize(member.select("branch", "selector", "component"))
    least = member.groupBy("component").agg(F.min("selector").alias("group_selector"))
    return join_unique(member, least, "component").select("branch", "selector", "group_selector")
