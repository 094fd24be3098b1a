"""The hierarchy of groups too large for one task, in rounds of joins over all their nodes.

Subtree sizes, chain heads and chain positions come from pointer doubling, so even a stack of a million nodes takes twenty
rounds. Everything else moves along light links only: which prefix of each chain is free of cycles, which roots a chain
position is reached from and how far away they are, and which suffixes of other chains lie below it. The number of these
rounds is that of the light links on a path, in a tree at most the logarithm of its size. Nodes on or below a cycle are cut
off first, so the chains are those of the sound nodes alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hunkweave.runtime import Growing, fits, materialize, release

NODE = ["grp", "v"]
ON_CYCLE, INTO_CYCLE = -1, -2


def _joined(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", broadcast_rows: int = 100_000) -> DataFrame:
    """Join with the small side broadcast where a count shows it small; a chain may hold a large share of the big side."""
    return big.join(F.broadcast(small) if fits(small, broadcast_rows) else small, on, how)


def _doubled(nodes: DataFrame, up: DataFrame, sizes: bool) -> DataFrame:
    """(grp, v, top, dist, size): the last node over at most one ``up`` link (grp, v, p) per node, null where the links never end.

    The size is that of the subtree under the links. Nodes on or below a cycle of links keep a null top.
    """
    state = materialize(nodes.join(up, NODE, "left").select("grp", "v", F.col("p").alias("jump"), F.when(F.col("p").isNull(), F.col("v")).alias("top"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.lit(1).cast("long").alias("size")))
    for _ in range(state.count().bit_length() + 1):
        if fits(state.where("jump is not null"), 0):
            break
        far = state.select("grp", F.col("v").alias("jump"), F.col("jump").alias("_j"), F.col("top").alias("_t"), F.col("dist").alias("_d"))
        nxt = state.join(far, ["grp", "jump"], "left")
        moved = F.col("jump").isNotNull()
        size = F.col("size")
        if sizes:
            below = state.where("jump is not null").groupBy("grp", F.col("jump").alias("v")).agg(F.sum("size").alias("_s"))
            nxt = nxt.join(below, NODE, "left")
            size = size + F.coalesce("_s", F.lit(0))
        new = materialize(nxt.select("grp", "v", F.col("_j").alias("jump"), F.when(moved, F.col("_t")).otherwise(F.col("top")).alias("top"), (F.col("dist") + F.when(moved, F.col("_d")).otherwise(0)).alias("dist"), size.alias("size")))
        release(state)
        state = new
    out = state.select("grp", "v", F.when(F.col("jump").isNull(), F.col("top")).alias("top"), "dist", "size")
    out._table_path = state._table_path
    return out


def _chains(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chains (grp, v, chain, pos, size, before), the light links, and the nodes whose kept links never end."""
    keep = materialize(links.groupBy(*NODE).agg(F.min("p").alias("p")))
    sized = _doubled(nodes, keep, True)
    stuck = materialize(sized.where("top is null").select(*NODE))
    free = materialize(sized.where("top is not null").select("grp", "v", "size"))
    release(sized)
    heavy = materialize(keep.join(free, NODE).groupBy("grp", "p").agg(F.max_by("v", F.struct("size", -F.col("v"))).alias("v")))
    doubled = _doubled(free.select(*NODE), heavy.select("grp", "v", "p"), False)
    placed = doubled.select("grp", "v", F.col("top").alias("chain"), F.col("dist").alias("pos"))
    chains = materialize(placed.join(free, NODE).join(heavy.select("grp", "v", F.col("p").alias("before")), NODE, "left"))
    release(keep, free, heavy, doubled)
    child = chains.select("grp", "v", F.col("chain").alias("ch_v"), F.col("pos").alias("pos_v"), "before")
    parent = chains.select("grp", F.col("v").alias("p"), F.col("chain").alias("ch_p"), F.col("pos").alias("pos_p"))
    light = materialize(links.join(child, NODE).where("before is null or before <> p").join(parent, ["grp", "p"], "left").select("grp", "v", "p", "ch_v", "pos_v", "ch_p", "pos_p"))
    return chains, light, stuck


def _sound(chains: DataFrame, light: DataFrame) -> DataFrame:
    """(grp, chain, fin): how many nodes at the head of each chain have no cycle above them, where that is not the whole chain."""
    fin = materialize(light.groupBy("grp", F.col("ch_v").alias("chain")).agg(F.min("pos_v").alias("fin")))
    while True:
        reached = fin.select("grp", F.col("chain").alias("ch_p"), F.col("fin").alias("_f"))
        waiting = _joined(light, reached, ["grp", "ch_p"], "left").where("ch_p is null or (_f is not null and pos_p >= _f)")
        new = materialize(waiting.groupBy("grp", F.col("ch_v").alias("chain")).agg(F.min("pos_v").alias("fin")))
        same = new.count() == fin.count() and fits(new.join(fin.withColumnRenamed("fin", "_o"), ["grp", "chain"], "left").where("_o is null or _o <> fin"), 0)
        release(fin)
        fin = new
        if same:
            return fin


def _greatest_above(values: DataFrame, links: DataFrame) -> DataFrame:
    """(grp, v, c): the greatest value of each node and of all nodes from which ``links`` (grp, v, p) lead down to it.

    ``values``: (grp, v, c). A node with one parent also takes the value of a node farther up, and looks twice as far in each
    round, so values cross long stretches without branches in few rounds. The input tables are left as they are.
    """
    single = links.groupBy(*NODE).agg(F.count(F.lit(1)).alias("_n"), F.min("p").alias("far")).where("_n = 1").select("grp", "v", "far")
    state = materialize(values.join(single, NODE, "left").select("grp", "v", "c", "far"))
    while True:
        near = links.join(state.select("grp", F.col("v").alias("p"), F.col("c").alias("_c")), ["grp", "p"]).groupBy(*NODE).agg(F.max("_c").alias("_near"))
        beyond = state.select("grp", F.col("v").alias("far"), F.col("c").alias("_fc"), F.col("far").alias("_ff"))
        met = state.join(near, NODE, "left").join(beyond, ["grp", "far"], "left")
        best = F.greatest("c", "_near", "_fc")
        new = materialize(met.select("grp", "v", best.alias("c"), F.coalesce("_ff", "far").alias("far"), (best > F.col("c")).alias("grew")))
        done = fits(new.where("grew"), 0)
        release(state)
        state = new
        if done:
            out = state.select("grp", "v", "c")
            out._table_path = state._table_path
            return out


def _on_cycles(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(grp, v, component) of the nodes on a cycle, among nodes that all have a cycle above them; ``links`` lie within the nodes.

    The component is its least node.
    """
    back = materialize(links.select("grp", F.col("p").alias("v"), F.col("v").alias("p")))
    chains, light, stuck = _chains(nodes, back)
    fin = _sound(chains, light)
    core = materialize(stuck.unionByName(_joined(chains, fin, ["grp", "chain"]).where("pos >= fin").select(*NODE)))
    release(chains, light, stuck, fin, back)
    inner = materialize(links.join(core, NODE, "left_semi").join(core.select("grp", F.col("v").alias("p")), ["grp", "p"], "left_semi"))
    found = Growing(nodes.sparkSession)
    # What is left lies on cycles or between two. Colours spread downward; a colour's own node and what leads back to it is a component.
    while not fits(core, 0):
        colour = _greatest_above(core.withColumn("c", F.col("v")), inner)
        within = materialize(inner.join(colour, NODE).join(colour.select("grp", F.col("v").alias("p"), "c"), ["grp", "p", "c"]).select("grp", F.col("p").alias("v"), F.col("v").alias("p")))
        back_flag = _greatest_above(colour.select("grp", "v", F.when(F.col("v") == F.col("c"), 1).otherwise(0).alias("c")), within)
        ring = materialize(back_flag.where("c = 1").select(*NODE).join(colour, NODE))
        least = ring.groupBy("grp", "c").agg(F.min("v").alias("component"), F.count(F.lit(1)).alias("_n"))
        loops = inner.where("v = p").select(*NODE).distinct().withColumn("_loop", F.lit(True))
        found.add(ring.join(least, ["grp", "c"]).join(loops, NODE, "left").where("_n > 1 or _loop").select("grp", "v", "component"))
        rest = materialize(core.join(ring, NODE, "left_anti"))
        left = materialize(inner.join(rest, NODE, "left_semi").join(rest.select("grp", F.col("v").alias("p")), ["grp", "p"], "left_semi"))
        release(colour, within, back_flag, ring, core, inner)
        core, inner = rest, left
    return found.read() if found.parts else nodes.where("false").withColumn("component", F.col("v"))


def _entries(chains: DataFrame, light: DataFrame, one_root: bool = False) -> DataFrame:
    """(grp, chain, root, j, d): chain positions where a root first comes in, or comes in from farther than along the chain.

    Over the entries of a chain and root in order of ``j``, ``d - j`` rises. With ``one_root`` all roots count as one.
    """
    zero = F.lit(0).cast("long")
    first = chains.where("pos = 0").join(light.select("grp", F.col("v").alias("chain")).distinct(), ["grp", "chain"], "left_anti")
    found = materialize(first.select("grp", "chain", (zero if one_root else F.col("chain")).alias("root"), zero.alias("j"), zero.alias("d")))
    fresh = found
    key = ["grp", "chain", "root", "j"]
    while not fits(fresh, 0):
        moved = _joined(light, fresh.withColumnRenamed("chain", "ch_p"), ["grp", "ch_p"]).where("j <= pos_p")
        come = moved.select("grp", F.col("ch_v").alias("chain"), "root", F.col("pos_v").alias("j"), (F.col("d") + F.col("pos_p") - F.col("j") + 1).alias("d"))
        best = found.unionByName(come).groupBy(*key).agg(F.max("d").alias("d"))
        before = F.max(F.col("d") - F.col("j")).over(Window.partitionBy("grp", "chain", "root").orderBy("j").rowsBetween(Window.unboundedPreceding, -1))
        new = materialize(best.withColumn("_m", before).where("_m is null or d - j > _m").drop("_m"))
        nxt = materialize(new.join(found, [*key, "d"], "left_anti"))
        release(found, fresh if fresh is not found else None)
        found, fresh = new, nxt
    release(fresh if fresh is not found else None)
    return found


def _segments(entries: DataFrame, light: DataFrame) -> DataFrame:
    """``entries`` with ``segs``: the chain segments from the root down to the chain that each entry enters.

    An entry comes from the least parent at the right distance; along a chain that parent is reached by the last entry above it.
    """
    target = entries.select("grp", F.col("chain").alias("ch_v"), "root", F.col("j").alias("pos_v"), "d")
    source = entries.select("grp", F.col("chain").alias("ch_p"), "root", F.col("j").alias("_j"), F.col("d").alias("_d"))
    met = light.join(target, ["grp", "ch_v", "pos_v"]).join(source, ["grp", "ch_p", "root"]).where("_j <= pos_p and _d - _j + pos_p = d - 1")
    link = materialize(met.groupBy("grp", F.col("ch_v").alias("chain"), "root", F.col("pos_v").alias("j")).agg(F.min(F.struct("p", "ch_p", "_j", "pos_p")).alias("_f")))
    segment = "array<struct<chain:long,lo:long,hi:long>>"
    done = Growing(entries.sparkSession)
    key = ["grp", "chain", "root", "j"]
    fresh = done.add(entries.join(link, key, "left_anti").withColumn("segs", F.array().cast(segment)))
    while True:
        up = fresh.select("grp", F.col("chain").alias("_c"), "root", F.col("j").alias("_uj"), "segs")
        step = link.select(*key, F.col("_f.ch_p").alias("_c"), F.col("_f._j").alias("_uj"), F.col("_f.pos_p").alias("_hi")).join(up, ["grp", "_c", "root", "_uj"])
        grown = step.select(*key, F.concat("segs", F.array(F.struct(F.col("_c").alias("chain"), F.col("_uj").alias("lo"), F.col("_hi").alias("hi")))).cast(segment).alias("segs"))
        fresh = done.add(entries.join(grown, key).select(*entries.columns, "segs"))
        if fits(fresh, 0):
            return done.read()


def _below(light: DataFrame) -> DataFrame:
    """(grp, chain, i, t, f): from chain position ``i`` a light link leads down to chain ``t`` from position ``f`` on."""
    start = light.select("grp", F.col("ch_p").alias("chain"), F.col("pos_p").alias("i"), F.col("ch_v").alias("t"), F.col("pos_v").alias("f"))
    found = materialize(start.groupBy("grp", "chain", "i", "t").agg(F.min("f").alias("f")))
    fresh = found
    key = ["grp", "chain", "i", "t"]
    while not fits(fresh, 0):
        moved = _joined(light, fresh.withColumnRenamed("chain", "ch_v"), ["grp", "ch_v"]).where("i >= pos_v")
        come = moved.select("grp", F.col("ch_p").alias("chain"), F.col("pos_p").alias("i"), "t", "f")
        best = found.unionByName(come).groupBy(*key).agg(F.min("f").alias("f"))
        later = F.min("f").over(Window.partitionBy("grp", "chain", "t").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1))
        new = materialize(best.withColumn("_m", later).where("_m is null or f < _m").drop("_m"))
        nxt = materialize(new.join(found, [*key, "f"], "left_anti"))
        release(found, fresh if fresh is not found else None)
        found, fresh = new, nxt
    release(fresh if fresh is not found else None)
    return found


def deep_hierarchy(rows: DataFrame, kind: str) -> DataFrame:
    """The outputs of ``hierarchy`` for (grp, node_id, parent_id) rows, a null parent only naming the node."""
    links = materialize(rows.where("parent_id is not null").select("grp", F.col("node_id").alias("v"), F.col("parent_id").alias("p")).distinct())
    nodes = materialize(rows.select("grp", F.col("node_id").alias("v")).unionByName(links.select("grp", F.col("p").alias("v"))).distinct())
    chains, light, stuck = _chains(nodes, links)
    fin = _sound(chains, light)
    marked = _joined(chains, fin, ["grp", "chain"], "left").withColumn("ok", F.col("fin").isNull() | (F.col("pos") < F.col("fin")))
    unsound = materialize(stuck.unionByName(marked.where("not ok").select(*NODE)))
    whole = fits(unsound, 0)
    if kind == "cycles" or (kind == "roots" and not whole) or (kind == "paths" and not whole):
        left = materialize(links.join(unsound, NODE, "left_semi").join(unsound.select("grp", F.col("v").alias("p")), ["grp", "p"], "left_semi"))
        cyclic = _on_cycles(unsound, left)
        if kind == "cycles":
            return cyclic.select("grp", F.col("v").alias("node_id"), "component")
    if whole:
        sound = chains.drop("before")
    else:
        good = materialize(marked.where("ok").select(*NODE))
        release(chains, light)
        chains, light, _ = _chains(good, links.join(good, NODE, "left_semi"))
        sound = chains.drop("before")
    release(stuck, fin)

    if kind == "chains":
        return sound.select("grp", F.col("v").alias("node_id"), F.col("chain").alias("chain_id"), F.col("pos").alias("chain_pos"), F.col("size").alias("subtree_size"))
    if kind == "descendants":
        last = sound.groupBy("grp", F.col("chain").alias("t")).agg(F.max("pos").alias("to_pos"))
        own = sound.select("grp", "v", F.col("chain").alias("t"), (F.col("pos") + 1).alias("f"))
        far = _joined(sound, _below(light), ["grp", "chain"]).where("i >= pos").select("grp", "v", "t", "f")
        every = own.unionByName(far).groupBy("grp", "v", "t").agg(F.min("f").alias("f"))
        return _joined(every, last, ["grp", "t"]).where("f <= to_pos").select("grp", F.col("v").alias("node_id"), F.col("t").alias("chain_id"), F.col("f").alias("from_pos"), "to_pos")

    entries = _entries(sound, light, kind == "levels")
    if kind == "levels":
        depth = _joined(sound, entries, ["grp", "chain"]).where("j <= pos").groupBy("grp", "v", "pos").agg(F.max(F.col("d") - F.col("j")).alias("_o"))
        return depth.select("grp", F.col("v").alias("node_id"), (F.col("_o") + F.col("pos")).alias("level")).unionByName(unsound.select("grp", F.col("v").alias("node_id"), F.lit(None).cast("long").alias("level")))
    if kind == "paths":
        entries = _segments(entries, light)
    hit = _joined(sound, entries, ["grp", "chain"]).where("j <= pos")
    held = F.struct((F.col("d") - F.col("j")).alias("o"), "j", *(["segs"] if kind == "paths" else []))
    best = hit.groupBy("grp", "v", "chain", "pos", "root").agg(F.max_by(held, "j").alias("_b"))
    depth = (F.col("_b.o") + F.col("pos")).alias("node_depth")
    bad = nodes.where("false").select("grp", F.col("v").alias("node_id"), F.lit(-1).cast("long").alias("root_id"), F.lit(0).cast("long").alias("node_depth"))
    if not whole:
        bad = unsound.join(cyclic.select(*NODE, F.lit(True).alias("_on")), NODE, "left").select(
            "grp", F.col("v").alias("node_id"), F.lit(-1).cast("long").alias("root_id"), F.when(F.col("_on"), ON_CYCLE).otherwise(INTO_CYCLE).cast("long").alias("node_depth")
        )
    if kind == "roots":
        return best.select("grp", F.col("v").alias("node_id"), F.col("root").alias("root_id"), depth).unionByName(bad)
    ends = best.select("grp", F.col("v").alias("node_id"), F.col("root").alias("root_id"), depth, "chain", "pos", F.col("_b.j").alias("j"), F.col("_b.segs").alias("segs"))
    pieces = ends.select("grp", "node_id", "root_id", "node_depth", F.posexplode(F.concat("segs", F.array(F.struct("chain", F.col("j").alias("lo"), F.col("pos").alias("hi"))))).alias("at", "s"))
    members = sound.select("grp", "chain", F.col("pos").alias("q"), F.col("v").alias("x"))
    walked = pieces.select("grp", "node_id", "root_id", "node_depth", "at", F.col("s.chain").alias("chain"), F.explode(F.sequence("s.lo", "s.hi")).alias("q")).join(members, ["grp", "chain", "q"])
    full = walked.groupBy("grp", "node_id", "root_id", "node_depth").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "q", "x"))), lambda m: m["x"]).alias("path"))
    return full.unionByName(bad.withColumn("path", F.lit(None).cast("array<long>")))
