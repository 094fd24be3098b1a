from pyspark.sql import functions as F

from hunkweave.functions import hashes, paths
from hunkweave.operators import manifest, partition, reconcile, score
from hunkweave.operators.edges import mentions
from hunkweave.operators.manifest import Declared


def test_drift_of_branches(spark):
    units = spark.createDataFrame(
        [("own-moved", "unchanged", "a", False), ("adopted-moved", "updated", "a", True), ("own-gone", "unchanged", "a", False), ("adopted-gone", "updated", "a", True), ("same", "unchanged", "a", False), ("new", "created", None, False), ("merged", "squash-merged", "a", False)],
        "branch_name string, status string, stored_sha string, adopted boolean",
    )
    heads = spark.createDataFrame([("own-moved", "b"), ("adopted-moved", "b"), ("same", "a"), ("merged", "b")], "branch_name string, remote_sha string")
    got = {r.branch_name: (r.drift, r.status, r.expected_sha) for r in reconcile.drift(units, heads).collect()}
    assert got == {
        "own-moved": ("moved", "blocked", "a"), "adopted-moved": ("moved", "blocked", "a"), "own-gone": ("missing", "updated", None), "adopted-gone": ("missing", "blocked", None),
        "same": (None, "unchanged", "a"), "new": (None, "created", None), "merged": (None, "squash-merged", "a"),
    }
    again = {r.branch_name: (r.status, r.expected_sha) for r in reconcile.drift(units, heads, reclaim=True, dry_run=True).collect()}
    assert again["own-moved"] == ("dry-run", "b") and again["adopted-moved"][0] == "blocked" and again["own-gone"][0] == "dry-run"
    assert {r.drift for r in reconcile.drift(units, None).collect()} == {"unread", None}


def test_bases_in_flat_and_stacked_form(spark):
    rows = [("s", "a", "r/a", "root", None, None, "squash-merged", 0), ("s", "b", "r/b", "reuse", "a", None, "created", 1), ("s", "c", "r/c", "reuse", "b", None, "created", 2), ("s", "d", "r/d", "integration", None, None, "created", 3)]
    df = spark.createDataFrame(rows, "scope string, unit string, branch_name string, base_kind string, base_unit string, error string, status string, rank int")
    got = {r.unit: (r.base, r.hidden_base, r.block_note) for r in reconcile.flat_bases(df, "main", reviewable=True).collect()}
    assert got["a"][0] == "main" and got["b"][0] == "main" and got["c"][0] == "r/b" and got["d"][:2] == ("r/d-base", True) and got["d"][2]
    stacked = {r.unit: r.base for r in reconcile.running_base(df, F.lit("main")).collect()}
    assert stacked == {"a": "main", "b": "main", "c": "r/b", "d": "r/c"}


def test_comments_by_exact_hunk(spark):
    hunk = "unit string, path string, hunk_index int, new_start int, new_lines int, raw string"
    old = spark.createDataFrame([("u", "f", 0, 1, 5, "@@ a"), ("u", "f", 1, 10, 0, "@@ b")], hunk)
    new = spark.createDataFrame([("u", "f", 0, 2, 5, "@@ a"), ("u", "f", 1, 11, 1, "@@ c")], hunk)
    comments = spark.createDataFrame(
        [("u", 1, "f", 3, None, "RIGHT", None), ("u", 2, "f", None, 10, "RIGHT", None), ("u", 3, "f", 50, None, "RIGHT", None), ("u", 4, "f", 3, None, "LEFT", None), ("u", 5, "f", 3, None, "RIGHT", 1), ("u", 6, "f", 3, None, "RIGHT", None), ("u", 7, "other", 3, None, "RIGHT", None)],
        "unit string, comment_id int, path string, line int, original_line int, side string, in_reply_to int",
    )
    done = spark.createDataFrame([(6,)], "comment_id int")
    assert {(r.comment_id, r.anchor) for r in reconcile.comment_actions(comments, old, new, done).collect()} == {(1, "unchanged"), (2, "orphaned")}


def test_adoption_findings(spark):
    schema = "branch string, projection string, signature string, head string, pr_number int, pr_state string, pr_head string, pr_base string, manifest_base string, tree string, head_tree string"
    checks = spark.createDataFrame([("b", "ok", "manifest:ok", "h", 1, "OPEN", "h", "main", "main", "t", "t"), ("b", "bad", "manifest:bad", "h2", 2, "MERGED", "x", "dev", "main", "t", "u"), ("b", "none", "manifest:none", "h3", 3, "OPEN", "h3", "main", "main", None, None)], schema)
    store = spark.createDataFrame([("b", "manifest:other", "h2", 2), ("b", "manifest:ok", "h", 1)], "branch string, signature string, slice_branch string, pr_number int")
    got = {(r.projection, r.code) for r in reconcile.adoption_findings(checks, store).collect()}
    assert got == {("bad", c) for c in ("adopt-pr-state", "adopt-head-mismatch", "adopt-conflict", "base-disagreement", "adopt-mismatch")} | {("none", "apply-failure")}


def test_review_states_and_context(spark):
    p = spark.createDataFrame([("b", u, s, t, e, "main") for u, s, t, e in (("a", "s1", "t1", None), ("c", "s2", "t2", None), ("d", "s3", "t3", None), ("e", "s4", None, "no"), ("f", "s5", "t5", None))], "branch string, unit string, signature string, tree string, error string, manifest_base string")
    store = spark.createDataFrame([("b", "s1", "x", 1, "c1", "t1", "main", False), ("b", "s2", "y", 2, "c2", "old", "dev", True), ("b", "s5", "z", None, None, None, None, False)], "branch string, signature string, slice_branch string, pr_number int, commit_sha string, stored_tree string, base_ref string, adopted boolean")
    comments = spark.createDataFrame([(1, 10, None), (1, 11, 10)], "pr_number int, comment_id int, in_reply_to int")
    anchors = spark.createDataFrame([("b", "s1", "orphaned")], "branch string, signature string, anchor string")
    stacks = spark.createDataFrame([(2, 7, 1)], "pr_number int, stack_number int, position int")
    got = {r.unit: r for r in reconcile.review_context(p, store, comments, anchors, stacks).collect()}
    assert {u: r.state for u, r in got.items()} == {"a": "unchanged", "c": "changed", "d": "never-pushed", "e": "not-materializable", "f": "unknown"}
    assert (got["a"].threads, got["a"].replies, got["a"].orphaned_anchors, got["a"].base_agrees) == (1, 1, 1, True) and got["c"].stack_number == 7 and not got["c"].base_agrees


def declared(spark):
    entry = "scope string, projection string, pos int, intent string, atomic array<string>, glue array<string>, depends array<string>, verification array<string>, profile string, reason string, oversize string"
    e = spark.createDataFrame(
        [
            ("m", "one", 0, "does", ["a.ts::A", "slice1"], [], ["two"], ["x"], "unit", None, None), ("m", "two", 1, " ", ["b.ts::B", "a.ts::A"], ["a.ts::A"], ["one", "lost"], [], "gone", None, None),
            ("m", "three", 2, None, ["nowhere::x"], ["d.ts::D"], [], [], None, None, None), ("m", "three", 3, "t", [], ["d.ts::D"], [], [], None, "docs only", None),
        ],
        entry,
    )
    s = spark.createDataFrame(
        [("m", 0, 0, ["a.ts::A"], ["a.ts"], 9, 90, ["a.ts"]), ("m", 1, 1, ["b.ts::B"], ["b.ts"], 1, 1, ["b.ts"]), ("m", 2, 2, ["c.ts::C"], ["c.ts"], 1, 1, ["c.ts"]), ("m", 3, 3, ["d.ts::D"], ["d.ts"], 1, 1, ["d.ts"]), ("m", 4, 4, ["e.ts::E"], ["e.ts"], 1, 1, ["e.ts"])],
        "scope string, slice_id int, topo_num int, selectors array<string>, files array<string>, hunk_count int, changed_lines int, code_files array<string>",
    )
    edges = spark.createDataFrame([("m", 3, 0), ("m", 0, 4)], "scope string, src int, dst int")
    deferred = spark.createDataFrame([("m", "e.ts::E", "later"), ("m", "q::q", "no")], "scope string, selector string, reason string")
    return Declared(e, s, edges, deferred, spark.createDataFrame([("unit", ["make"])], "profile string, commands array<string>"), spark.createDataFrame([("m", 5, 8, 50)], "scope string, max_files int, max_hunks int, max_lines int"))


def test_findings_of_a_declared_grouping(spark):
    found = declared(spark).findings(require_intent=True, require_verification=True)
    got = {(r.severity, r.code, r.projection, r.detail) for r in found.collect()}
    assert {
        ("error", "duplicate-id", "three", ""), ("error", "unknown-selector", "three", "nowhere::x"), ("error", "unknown-selector", None, "q::q"), ("warning", "ordinal-selector", "one", "slice1 b.ts::B"),
        ("error", "duplicate-assignment", "two", "b.ts::B one"), ("error", "duplicate-assignment", "two", "a.ts::A one"), ("error", "unknown-dependency", "two", "lost"), ("error", "unassigned-slice", None, "c.ts::C"),
        ("error", "manifest-cycle", None, ""), ("error", "dependency-removed", "three", "one"), ("error", "dependency-removed", "one", "deferred 4"), ("error", "oversize", "one", "hunks, changed lines"),
        ("error", "no-intent", "two", ""), ("error", "no-intent", "three", ""), ("error", "verification-profile-conflict", "one", "unit"), ("error", "unknown-verification-profile", "two", "gone"), ("error", "verification-waived", "three", ""),
    } <= got
    assert not [g for g in got if g[1] == "glue-not-reachable"]  # two reaches one through the declared cycle
    row = manifest.verdict(found).first()
    assert row.failed and row.errors > row.warnings
    units = {r.unit: (r.rank, r.slice_ids) for r in declared(spark).verification_units().collect()}
    assert units["(deferred)"][1] == [4] and units["(deferred)"][0] > max(v[0] for k, v in units.items() if k != "(deferred)")


def test_skeleton_ids(spark):
    df = spark.createDataFrame([("m", 0, ["src/a/x.ts", "src/a/b/y.ts"], [], False), ("m", 1, ["src/a/z.ts"], [], False), ("m", 2, ["bun.lock", "package.json"], ["dependency-manifest"], True), ("m", 3, ["READ ME.md"], [], True)], "scope string, unit_num int, files array<string>, reasons array<string>, fallback_only boolean")
    assert {r.unit_num: r.entry_id for r in manifest.skeleton_ids(df).collect()} == {0: "src-a", 1: "src-a-2", 2: "deps", 3: "READ-ME"}


def test_a_partition_agrees_with_itself_and_ties_are_stable(spark):
    units = spark.createDataFrame([("s", i, f"f::{i % 5}", False, f"u{i % 5}", i % 5) for i in range(20)], "scope string, hunk_index int, selector string, is_fallback boolean, actual string, act_rank int")
    same = spark.createDataFrame([("s", f"x{i}", i, f"f::{i}") for i in range(5)], "scope string, unit string, unit_pos int, selector string")
    hunks = score.score_hunks(units, same)
    row = score.agreement(hunks, 1.0).first()
    assert row.agreement == 1.0 and row["pass"] and score.disagreements(hunks).count() == 0
    merged = spark.createDataFrame([("s", "x", 0, f"f::{i}") for i in (0, 1)] + [("s", "y", 1, "f::1"), ("s", "z", 2, "g::9")], "scope string, unit string, unit_pos int, selector string")
    hunks = score.score_hunks(units, merged)
    row = score.agreement(hunks, 0.6).first()
    assert (row.scored, row.agreed, row.unscored, row["pass"]) == (8, 4, 12, False)
    assert {r.selector for r in score.duplicate_selectors(merged).collect()} == {"f::1"} and {r.selector for r in score.unmatched_selectors(units, merged).collect()} == {"g::9"}
    got = {r.unit: (r.matched, r.hunks, r.agreed, list(r.spread)) for r in score.unit_scores(hunks, merged).collect()}
    assert got["x"] == ("u0", 8, 4, ["u0", "u1"]) and got["z"] == (None, 0, 0, [])


def test_overrides_split_and_merge(spark):
    h = spark.createDataFrame([("d", i, p, s) for i, (p, s) in enumerate([("a", "A"), ("a", "A"), ("b", "B"), ("c", None), ("c", None)])], "diff_id string, hunk_index int, file_path string, qualified_symbol string").withColumn("fallback_selector", F.lit(None).cast("string"))
    o = spark.createDataFrame([(1, "d", "force_split", "a::A", None), (2, "d", "force_merge", "b::B", "c::(file)"), (3, "d", "force_merge", "b::B", "zz::z")], "id int, diff_id string, kind string, selector_a string, selector_b string")
    assert {r.hunk_index: r.slice_id for r in partition.slices(h, o).collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2}
    assert [(r.id, r.selector) for r in partition.ignored_overrides(o, h).collect()] == [(3, "zz::z")]


def test_word_boundaries_and_names(spark):
    df = spark.createDataFrame([("éfoo()", "foo", True), ("foobar", "foo", False), ("x $foo(", "$foo", False), ("x$foo(", "$foo", True), ("a.b", "a.b", True), ("axb", "a.b", False)], "t string, n string, want boolean")
    assert df.where(mentions(F.col("t"), F.col("n")) != F.col("want")).count() == 0
    names = spark.createDataFrame([("A.constructor", "A"), ("constructor", "constructor"), ("A.b.c", "c")], "q string, want string")
    assert names.where(paths.definition_name("q") != F.col("want")).count() == 0
    shared = spark.createDataFrame([(["a/b/c.ts", "a/b/d/e.ts"], "a/b"), (["x.ts"], ""), ([], ""), (["a/b/c", "a/bb/c"], "a")], "f array<string>, want string")
    assert shared.where(F.array_join(paths.common_directory("f"), "/") != F.col("want")).count() == 0
    assert spark.createDataFrame([("abc",)], "t string").select(hashes.blob_hash(F.col("t"))).first()[0] == "f2ba8f84ab5c1bce84a7b441cb1959cfc7093b7f"


def test_change_ids_cascade(spark):
    good = "x\n\nChange-Id: I" + "0" * 40
    df = spark.createDataFrame([("s", 0, "a", good), ("s", 1, "b", "no trailer\n\n"), ("s", 2, "c", good)], "scope string, pos int, sha string, message string")
    rows = {r.pos: r for r in reconcile.change_ids(df).collect()}
    assert [rows[i].rewrite for i in range(3)] == [False, True, True] and "\n\nChange-Id: I" in rows[1].new_message and rows[2].new_message == good


def test_overrides_of_a_branch_reach_the_plans_that_have_their_selectors(spark, tmp_path):
    from hunkweave.plans import core

    hunks = [(1, 7, "b", "x.ts", "f"), (2, 7, "b", "x.ts", "f"), (3, 7, "b", "y.ts", "g"), (4, 8, "b", "x.ts", "f"), (5, 8, "b", "z.ts", "h"), (6, 9, "other", "x.ts", "f"), (6, 9, "other", "x.ts", "f")]
    h = spark.createDataFrame(hunks, "hunk_id long, plan_id long, branch string, file_path string, qualified_symbol string")
    none = {n: F.lit(None).cast(t) for n, t in (("old_start", "int"), ("old_lines", "int"), ("new_start", "int"), ("new_lines", "int"), ("raw", "string"), ("changed_text", "string"), ("fallback_selector", "string"), ("fallback_reason", "string"), ("slice_label", "string"))}
    h.withColumns({**none, "exported": F.lit(False)}).write.parquet(str(tmp_path / "hunks.parquet"))
    o = [(1, "b", "force_split", "x.ts::f", None), (2, "b", "force_merge", "z.ts::h", "y.ts::g"), (3, "b", "force_merge", "y.ts::g", "x.ts::f"), (4, "b", "force_split", "no::where", None), (5, "b", "force_merge", "x.ts::f", "z.ts::h")]
    spark.createDataFrame(o, "id long, branch string, kind string, selector_a string, selector_b string").write.parquet(str(tmp_path / "overrides.parquet"))
    got = {tuple(r) for r in core._plan_overrides(spark, str(tmp_path)).select("diff_id", "kind", "selector_a", "selector_b").collect()}
    assert got == {(7, "force_split", "x.ts::f", None), (8, "force_split", "x.ts::f", None), (7, "force_merge", "y.ts::g", "x.ts::f"), (8, "force_merge", "x.ts::f", "z.ts::h")}
    units = {(r.diff_id, tuple(sorted(r.slice_ids)), r.hunk_count, r.pinned) for r in core.review_units(spark, str(tmp_path)).collect()}
    assert units == {(7, (1,), 2, True), (7, (2,), 1, True), (8, (4,), 2, True), (9, (6,), 1, False)}
