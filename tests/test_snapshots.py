import random

from hunkweave.operators.snapshots import normalised_store, snapshot_changes


def brute(rows):
    held = {}
    for s, k, v, t in rows:
        if s is not None:
            old = held.setdefault(s, {}).get(k)
            new = (-1 if t is None else t, "" if v is None else v, v)
            held[s][k] = max(old, new, key=lambda x: x[:2]) if old else new
    out, names = set(), sorted(held)
    for a, b in zip(names, names[1:]):
        for k in held[a].keys() | held[b].keys():
            x, y = held[a].get(k), held[b].get(k)
            if x is None:
                out.add((b, k, "added"))
            elif y is None:
                out.add((b, k, "removed"))
            elif x[2] != y[2]:
                out.add((b, k, "changed"))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "snap int, k string, v string, t int")
    return {tuple(r) for r in snapshot_changes(df, ["k"], ["v"], "snap", "t", **options).collect()}


def test_random_snapshots_at_several_tree_shapes(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 2, 4, 9, None]), rnd.choice([None, *map(str, range(25))]), rnd.choice([None, "a", "b"]), rnd.choice([None, 1, 2, 3])) for _ in range(300)]
    want = brute(rows)
    assert want
    for shape in ({}, {"leaf_keys": 1}, {"leaf_keys": 2, "bits_per_level": 1}, {"leaf_keys": 1, "bits_per_level": 3, "broadcast_rows": 5}):
        assert run(spark, rows, **shape) == want


def test_one_snapshot_none_and_unchanged(spark):
    assert run(spark, [(1, "a", "x", 1)]) == set()
    assert run(spark, []) == set()
    assert run(spark, [(1, "a", "x", 1), (3, "a", "x", 9), (3, "a", "x", 9)]) == set()


def test_values_in_uneven_form(spark):
    rows = [(1, "b", " AB ", "CC\t", "main ", 1), (2, "b", "ab", "cc", " main", 2), (2, "b", "new", "", "\n", 1), (3, "b", "ab", "dd", "main", 1), (3, "b", "new", None, None, 1)]
    df = spark.createDataFrame(rows, "snapshot_no int, branch string, slice_signature string, content_hash string, base_ref string, updated_at int")
    got = snapshot_changes(normalised_store(df), ["branch", "slice_signature"], ["content_hash", "base_ref"], "snapshot_no", "updated_at")
    assert {tuple(r) for r in got.collect()} == {(2, "b", "new", "added"), (3, "b", "ab", "changed")}
