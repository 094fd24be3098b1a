"""Stacks of pull requests: linear chains, and what linking them would do. Nothing is changed, decisions are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkweave.operators.grouped import solve_groups
from hunkweave.runtime import fits, materialize, release


FORKED, SEVERAL, NOTHING, SIBLINGS, LOOSE = "forked", "several are based on it", "nothing is based on it", "siblings share its base", "not reachable from a root"


def chains(nodes: DataFrame, scope: str = "push_id", max_group_rows: int = 200_000) -> DataFrame:
    """Every node placed: (scope, node_id, branch, chain_root, chain_pos, placement, reason).

    A chain starts at a root (base unknown or itself) and follows only children. It ends where a node has none or several
    children; ``forked`` marks the last member of a chain that ends at a fork. Roots alone and nodes off every chain are
    ``solitary`` with the reason. ``nodes``: (scope, node_id, branch, base), branch unique within the scope. Scopes of up to
    ``max_group_rows`` nodes are placed in one task each, larger ones by pointer jumping over all executors, with the same rows.
    """
    n = nodes.select(scope, "node_id", "branch", "base")
    large = n.groupBy(scope).count().where(F.col("count") > max_group_rows).select(scope)
    schema = [(scope, scope), ("node_id", "node_id"), ("branch", "branch"), ("chain_root", "node_id"), ("chain_pos", "long"), ("placement", "string"), ("reason", "string")]
    if fits(large, 0):
        return solve_groups(n, scope, ["node_id"], _placed, schema).withColumn("chain_pos", F.col("chain_pos").cast("int"))
    large = materialize(large)
    small = solve_groups(n.join(large, scope, "left_anti"), scope, ["node_id"], _placed, schema).withColumn("chain_pos", F.col("chain_pos").cast("int"))
    return small.unionByName(_jumping_chains(materialize(n.join(large, scope, "left_semi")), scope))


def _placed(key: object, group: dict[str, list]) -> list[tuple]:
    """The rows of one scope."""
    ids, names, bases = group["node_id"], group["branch"], group["base"]
    at = {b: i for i, b in enumerate(names) if b is not None}
    up = [at.get(b) if b is not None and b != name else None for b, name in zip(bases, names)]
    kids: list[list[int]] = [[] for _ in ids]
    for i, p in enumerate(up):
        if p is not None:
            kids[p].append(i)
    out: list[tuple | None] = [None] * len(ids)
    for root, p in enumerate(up):
        if p is not None:
            continue
        line = [root]
        while len(kids[line[-1]]) == 1:
            line.append(kids[line[-1]][0])
        if len(line) == 1:
            out[root] = (None, None, "solitary", SEVERAL if kids[root] else NOTHING)
            continue
        for pos, i in enumerate(line):
            out[i] = (ids[root], pos, "chain", FORKED if len(kids[i]) > 1 else None)
    top = [None] * len(ids)
    for i, p in enumerate(up):  # off every chain: below a fork, or on or below a cycle
        if out[i] is None:
            # What heads a line of only children below a fork, and all that follow it, lead up to siblings or to nothing.
            siblings = p is not None and len(kids[p]) > 1
            top[i] = SIBLINGS if siblings else LOOSE
    return [(key, ids[i], names[i], *(out[i] or (None, None, "solitary", top[i]))) for i in range(len(ids))]


def _jumping_chains(nodes: DataFrame, scope: str) -> DataFrame:
    """The same for scopes of any size; positions come from pointer jumping over only-child links, in a logarithmic number of rounds."""
    n = nodes.select(scope, "node_id", "branch", "base")
    parents = n.select(scope, F.col("branch").alias("base"), F.col("node_id").alias("parent_id"))
    own = n.join(parents, [scope, "base"], "left").withColumn("parent_id", F.when(F.col("base") != F.col("branch"), F.col("parent_id")))
    kids = own.where(F.col("parent_id").isNotNull()).groupBy(scope, F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("children"))
    linked = own.join(kids, [scope, "node_id"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    only = linked.select(scope, F.col("node_id").alias("parent_id"), F.col("children").alias("siblings"))
    state = materialize(
        linked.join(only, [scope, "parent_id"], "left").select(
            scope, "node_id", "branch", "base", "parent_id", "children", "siblings",
            F.when(F.col("siblings") == 1, F.col("parent_id")).alias("jump"), F.when(F.col("siblings") == 1, 1).otherwise(0).alias("chain_pos"), F.col("node_id").alias("top"),
        )
    )
    largest = n.groupBy(scope).count().agg(F.max("count")).first()[0] or 0
    for _ in range(largest.bit_length() + 1):  # what still jumps after that is on a cycle
        if fits(state.where(F.col("jump").isNotNull()), 0):
            break
        up = state.select(scope, F.col("node_id").alias("jump"), F.col("jump").alias("_jump"), F.col("chain_pos").alias("_pos"), F.col("top").alias("_top"))
        joined = state.join(up, [scope, "jump"], "left")
        moved = F.col("jump").isNotNull()
        new = materialize(joined.select(
            scope, "node_id", "branch", "base", "parent_id", "children", "siblings", F.col("_jump").alias("jump"),
            F.when(moved, F.col("chain_pos") + F.col("_pos")).otherwise(F.col("chain_pos")).alias("chain_pos"),
            F.when(moved, F.when(F.col("_jump").isNull(), F.col("_top"))).otherwise(F.col("top")).alias("top"),
        ))
        release(state)
        state = new
    root = state.select(scope, F.col("node_id").alias("top"), F.col("parent_id").isNull().alias("_from_root"))
    sized = state.where(F.col("jump").isNull() & F.col("top").isNotNull()).join(root, [scope, "top"])
    length = F.count(F.lit(1)).over(Window.partitionBy(scope, "top"))
    placed = sized.withColumn("_size", length)
    chained = F.col("_from_root") & (F.col("_size") > 1)
    reason = (
        F.when(chained, F.when(F.col("children") > 1, "forked"))
        .when(F.col("parent_id").isNull(), F.when(F.col("children") > 1, "several are based on it").otherwise("nothing is based on it"))
        .when(F.col("siblings") > 1, "siblings share its base").otherwise("not reachable from a root")
    )
    out = placed.select(scope, "node_id", "branch", F.when(chained, F.col("top")).alias("chain_root"), F.when(chained, F.col("chain_pos")).alias("chain_pos"), F.when(chained, "chain").otherwise("solitary").alias("placement"), reason.alias("reason"))
    loose = state.join(placed.select(scope, "node_id"), [scope, "node_id"], "left_anti").select(
        scope, "node_id", "branch", F.lit(None).cast(dict(nodes.dtypes)["node_id"]).alias("chain_root"), F.lit(None).cast("int").alias("chain_pos"), F.lit("solitary").alias("placement"), F.lit("not reachable from a root").alias("reason")
    )
    return out.unionByName(loose)


def is_prefix(prefix: Column, full: Column) -> Column:
    """True where ``full`` begins with ``prefix``; an empty prefix begins everything."""
    return (F.size(prefix) <= F.size(full)) & (F.slice(full, 1, F.size(prefix)) == prefix)


def open_members(prs: Column) -> Column:
    """Numbers of the stack members that are neither merged nor closed, in order."""
    return F.transform(F.filter(prs, lambda p: ~p["merged"] & (p["state"] != "closed")), lambda p: p["number"])


def plan_links(wanted: DataFrame, stacks: DataFrame, earlier: bool = False) -> DataFrame:
    """(chain_id, link_status, stack_number, added) for each chain of pull requests.

    ``wanted``: (chain_id, prs array<int>), ``stacks``: (stack_number, prs array<struct<number, state, merged>>). No stack
    holds a member: ``created``. Several do: ``diverged``. Else the open members decide: they begin with the chain
    (``unchanged``), the chain begins with them (``extended`` by the rest), or ``diverged``. With ``earlier`` only stacks of
    numbers below the chain's own hold it.
    """
    held = stacks.select("stack_number", F.explode("prs").alias("p")).select("stack_number", F.col("p.number").alias("pr"))
    met = wanted.select("chain_id", F.explode("prs").alias("pr")).join(held, "pr")
    touch = (met.where("stack_number < chain_id") if earlier else met).groupBy("chain_id").agg(F.count_distinct("stack_number").alias("holders"), F.min("stack_number").alias("stack_number"))
    opened = stacks.select("stack_number", open_members(F.col("prs")).alias("open"))
    joined = wanted.join(touch, "chain_id", "left").join(opened, "stack_number", "left")
    w, o = F.col("prs"), F.col("open")
    status = F.when(F.col("holders").isNull(), "created").when(F.col("holders") > 1, "diverged").when(is_prefix(w, o), "unchanged").when(is_prefix(o, w), "extended").otherwise("diverged")
    added = F.when(status == "created", w).when(status == "extended", F.slice(w, F.size(o) + 1, F.size(w))).otherwise(F.array().cast("array<int>"))
    return joined.select("chain_id", status.alias("link_status"), F.when(F.col("holders") == 1, F.col("stack_number")).alias("stack_number"), added.alias("added"))


def link_actions(planned: DataFrame, owned: DataFrame, reclaim: bool, dry_run: bool) -> DataFrame:
    """Planned links with the action to take: ``none``, ``create``, ``extend``, ``rebuild`` or ``refuse``. ``owned``: (stack_number)."""
    mine = planned.join(owned.select("stack_number", F.lit(True).alias("owned")).distinct(), "stack_number", "left").withColumn("owned", F.coalesce("owned", F.lit(False)))
    if dry_run:
        return mine.withColumn("link_status", F.lit("dry-run")).withColumn("action", F.lit("none"))
    rebuild = F.col("owned") & F.col("stack_number").isNotNull() & F.lit(reclaim)
    action = (
        F.when(F.col("link_status") == "unchanged", "none").when(F.col("link_status") == "created", "create").when(F.col("link_status") == "extended", "extend")
        .when(rebuild, "rebuild").otherwise("refuse")
    )
    return mine.withColumn("action", action)


def with_placement(members: DataFrame, stacks: DataFrame) -> DataFrame:
    """Members with the stack and the position that their pull request has in it, null where it is in none. ``members``: (…, pr_number)."""
    at = stacks.select("stack_number", F.posexplode("prs").alias("i", "p")).select(F.col("p.number").alias("pr_number"), "stack_number", (F.col("i") + 1).alias("position"), F.col("p.state").alias("state"), F.col("p.merged").alias("merged"))
    last = at.groupBy("pr_number").agg(F.max(F.struct("stack_number", "position", "state", "merged")).alias("_at"))
    return members.join(last, "pr_number", "left").select(*members.columns, *[F.col(f"_at.{c}").alias(c) for c in ("stack_number", "position", "state", "merged")])


def chain_notation(base: Column, members: Column) -> Column:
    """``(base) <- a#1 <- b#2`` for an array of structs (name, number)."""
    return F.concat_ws(" <- ", F.concat(F.lit("("), base, F.lit(")")), F.transform(members, lambda m: F.concat(m["name"], F.lit("#"), m["number"].cast("string"))))


def store_nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored rows with a pull request and a base as stack nodes, and those not pushed yet."""
    pushed = F.col("pr_number").isNotNull() & F.col("base_ref").isNotNull()
    return rows.where(pushed), rows.where(~pushed)
