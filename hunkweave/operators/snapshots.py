"""What changed between consecutive full snapshots, found by comparing Merkle digests before rows.

Keys hash into leaf ranges of a few keys each; their number follows from the rows of the largest snapshot. The digest of a
leaf is an order-free combination of its row hashes, and a parent's digest combines its children. Consecutive snapshots are
compared from the root down; only children of nodes that differ are compared further, and rows are compared only in leaves
that differ. Rows are sent once, by their leaf: the digests, the choice of the open leaves and the comparison of rows all
keep that partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hunkweave.functions.text import tidy
from hunkweave.runtime import fits, materialize, release


def normalised_store(rows: DataFrame) -> DataFrame:
    """The correspondence table with values in even form: blanks around values and capitals in hashes do not count, empty is null."""
    return rows.select(
        "snapshot_no", "branch", tidy("slice_signature", True).alias("slice_signature"),
        tidy("content_hash", True).alias("content_hash"), tidy("base_ref").alias("base_ref"), "updated_at",
    )


def snapshot_changes(
    rows: DataFrame, key: list[str], values: list[str], snapshot: str, version: str,
    leaf_keys: int = 64, bits_per_level: int = 4, max_bits: int = 30, broadcast_rows: int = 100_000,
) -> DataFrame:
    """(snapshot, key columns, change_type) for every key added, removed or changed between consecutive snapshots.

    Of several rows of a key in a snapshot the one with the greatest ``version`` holds (null is least; equal versions
    fall to the greatest values, so the result is defined). Null is a value like any other in keys and values. Rows with
    a null snapshot belong to none. The first snapshot has no predecessor and gives no rows. Other columns are ignored.

    The tree has as many leaves as give about ``leaf_keys`` keys each, at most ``2 ** max_bits``, and ``bits_per_level`` bits of
    the key's hash for each level below the root. The shape changes no result. The list of snapshots comes to the
    driver and must be at most ``broadcast_rows`` long; the leaves that differ are broadcast only when a count shows so few.
    """
    spark = rows.sparkSession
    values = list(values)
    slim = rows.select(F.col(snapshot).alias("_snap"), *key, *values, F.col(version).alias("_version")).where(F.col("_snap").isNotNull())
    counts = slim.groupBy("_snap").agg(F.count(F.lit(1)).alias("_rows")).orderBy("_snap").limit(broadcast_rows + 1).collect()
    if len(counts) > broadcast_rows:
        raise ValueError(f"more than {broadcast_rows} snapshots")
    largest = max((r["_rows"] for r in counts), default=0)
    depth = min(max_bits, max(1, math.ceil(math.log2(max(1, largest / leaf_keys)))))
    names = [r["_snap"] for r in counts]
    snap_kind = dict(slim.dtypes)["_snap"]
    pairs = F.broadcast(spark.createDataFrame(list(zip(names, [None, *names[:-1]], [*names[1:], None])), f"_snap {snap_kind}, _prev {snap_kind}, _next {snap_kind}"))

    state = F.struct(*values)
    leaf = F.shiftrightunsigned(F.xxhash64(F.lit(1), *[F.col(k) for k in key]), 64 - depth).cast("int")
    held = (
        slim.withColumn("_leaf", leaf).repartition("_leaf")
        .groupBy("_leaf", "_snap", *key).agg(F.max(F.struct(F.col("_version"), state.alias("state"))).getField("state").alias("_state"))
    )
    # A null must not hash like an absent field, so each value is hashed along with its null flag.
    flags = [x for k in key for x in (F.col(k), F.col(k).isNull())] + [x for v in values for x in (F.col(f"_state.{v}"), F.col(f"_state.{v}").isNull())]
    hashed = held.withColumn("_h1", F.xxhash64(F.lit(11), *flags)).withColumn("_h2", F.xxhash64(F.lit(23), *flags))
    # Sums modulo 2**64 without overflow errors: the two halves are summed apart.
    parts = {"_a": F.col("_h1").bitwiseAND(F.lit(0xFFFFFFFF)), "_b": F.shiftright("_h1", 32), "_c": F.col("_h2").bitwiseAND(F.lit(0xFFFFFFFF)), "_d": F.shiftright("_h2", 32)}
    sums = ["_a", "_b", "_c", "_d", "_n"]
    leaves = materialize(hashed.groupBy("_leaf", "_snap").agg(*[F.sum(c).alias(n) for n, c in parts.items()], F.count(F.lit(1)).alias("_n")))

    # Few digests are compared in one job; of many each level is written, so that the next one reads only what differs.
    few = fits(leaves, broadcast_rows)
    kept = (lambda df: df) if few else materialize

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few or fits(df, broadcast_rows) else df

    digest = F.struct(*sums)

    def differing(shift: int, within: DataFrame | None, step: int) -> DataFrame:
        """(_node, _pair) of the nodes at one level whose digests differ, among the children of ``within``."""
        node = F.shiftright("_leaf", shift).alias("_node")
        level = leaves.groupBy(node, "_snap").agg(*[F.sum(c).alias(c) for c in sums]) if shift else leaves.select(node, "_snap", *sums)
        level = level.join(pairs, "_snap")
        sides = F.array(F.struct(F.col("_snap").alias("pair"), F.lit(True).alias("later")), F.struct(F.col("_next").alias("pair"), F.lit(False).alias("later")))
        each = level.withColumn("_side", F.explode(sides)).where("_side.pair is not null and not (_side.later and _prev is null)").select("_node", F.col("_side.pair").alias("_pair"), F.col("_side.later").alias("_later"), *sums)
        if within is not None:
            up = within.select(F.col("_node").alias("_up"), "_pair")
            each = each.withColumn("_up", F.shiftright("_node", step)).join(small(up), ["_up", "_pair"], "left_semi")
        return (
            each.groupBy("_node", "_pair").agg(F.max(F.when(F.col("_later"), digest)).alias("_new"), F.max(F.when(~F.col("_later"), digest)).alias("_old"))
            .where(~F.col("_new").eqNullSafe(F.col("_old"))).select("_node", "_pair")
        )

    nodes, bits = kept(differing(depth, None, 0)), 0
    while bits < depth:
        step = min(bits_per_level, depth - bits)
        bits += step
        below = kept(differing(depth - bits, nodes, step))
        release(nodes)
        nodes = below
    if not few:
        release(leaves)

    open_pairs = nodes.groupBy(F.col("_node").alias("_leaf")).agg(F.collect_set("_pair").alias("_open"))
    suspects = held.join(small(open_pairs), "_leaf").join(pairs, "_snap").withColumns({"_here": F.array_contains("_open", F.col("_snap")), "_later": F.coalesce(F.array_contains("_open", F.col("_next")), F.lit(False))}).where("_here or _later")
    w = Window.partitionBy("_leaf", *key).orderBy("_snap")
    before, after = F.lag(F.struct("_snap", "_state")).over(w), F.lead("_snap").over(w)
    placed = suspects.select("_snap", "_prev", "_next", *key, "_state", "_here", "_later", before.alias("_before"), after.alias("_after"))
    known = F.coalesce(F.col("_before._snap") == F.col("_prev"), F.lit(False))
    new = F.when(F.col("_here") & F.col("_prev").isNotNull(), F.when(~known, "added").when(~F.col("_before._state").eqNullSafe(F.col("_state")), "changed"))
    gone = F.when(F.col("_later") & ~F.coalesce(F.col("_after") == F.col("_next"), F.lit(False)), "removed")
    found = F.filter(F.array(F.struct(F.col("_snap").alias("s"), new.alias("c")), F.struct(F.col("_next").alias("s"), gone.alias("c"))), lambda x: x["c"].isNotNull())
    return placed.select(*key, F.explode(found).alias("_f")).select(F.col("_f.s").alias(snapshot), *key, F.col("_f.c").alias("change_type"))
