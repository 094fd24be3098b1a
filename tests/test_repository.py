"""The whole path over real repositories in temporary folders."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from hunkweave.operators import apply, diffs
from hunkweave.operators.symbols import definitions
from hunkweave.plans import review
from hunkweave.sources import git
from hunkweave.sources.documents import check_commands, packages, read_expected, read_manifest, read_profiles
from hunkweave.sources.store import Store

BASE = {"src/helper.ts": "export function helper(x: number) {\n  return x + 1;\n}\n", "README.md": "hi\n", "package.json": "{}\n", "old.txt": "gone\n"}
HEAD = {
    "src/helper.ts": "export function helper(x: number) {\n  return x + 2;\n}\n", "README.md": "hi there\n", "package.json": '{"a":1}\n', "bun.lock": "x\n", "old.txt": None,
    "src/a.ts": "import { helper } from './helper';\nexport class UserService {\n  getUser(id: number) {\n    return helper(id);\n  }\n}\n",
    "src/b.ts": "export function useA() {\n  return new UserService();\n}\nconst hidden = (n: number) => {\n  return n;\n};\n",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("repo"))

    def g(*a):
        subprocess.run(["git", "-C", root, *a], check=True, capture_output=True)

    def write(files):
        for path, text in files.items():
            full = os.path.join(root, path)
            if text is None:
                os.remove(full)
                continue
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "w") as f:
                f.write(text)
        g("add", "-A")

    g("init", "-q", "-b", "main")
    g("config", "user.email", "a@example.org")
    g("config", "user.name", "a")
    write(BASE)
    g("commit", "-qm", "base")
    g("checkout", "-qb", "feat")
    write(HEAD)
    g("commit", "-qm", "feat\n\nChange-Id: I" + "a" * 40)
    return root


@pytest.fixture(scope="module")
def plan(spark, repo):
    return review.plan_branch(spark, repo, "main", "feat")


def test_hunks_have_symbols_or_a_reason(plan):
    rows = {r.file_path: r for r in plan.hunks.collect()}
    assert rows["src/helper.ts"].qualified_symbol == "helper" and rows["src/a.ts"].qualified_symbol == "UserService"
    assert (rows["bun.lock"].fallback_selector, rows["bun.lock"].fallback_reason) == ("package.json::(deps)", "dependency-manifest")
    assert rows["README.md"].fallback_reason == "unsupported-language"
    assert all((r.qualified_symbol is None) == (r.fallback_selector is not None) for r in rows.values())


def test_every_hunk_is_in_one_slice_and_order_respects_edges(plan):
    assert plan.membership.count() == plan.hunks.count() == plan.membership.select("hunk_index").distinct().count()
    number = {r.slice_id: r.topo_num for r in plan.numbers().collect()}
    links = plan.edges.collect()
    assert links and all(number[e.src] > number[e.dst] for e in links)


def test_pieces_rebuild_the_branch(spark, repo, plan):
    ranks = plan.numbers().select("slice_id", F.col("topo_num").cast("int").alias("step"))
    steps = plan.hunks.join(plan.membership.select("hunk_index", "slice_id"), "hunk_index").join(ranks, "slice_id").select(F.lit("s").alias("scope"), F.col("file_path").alias("path"), "step", "hunk_index", "raw")
    base, goal = (git.tree_files(spark, repo, r, "s") for r in ("main", "feat"))
    row = apply.rebuild_check(base, steps, goal).first()
    assert row.same and row.goal == git.rev_parse(repo, "feat^{tree}")
    less = apply.rebuild_check(base, steps.where("path <> 'src/b.ts'"), goal).first()
    assert not less.same


def test_flat_first_units_and_reverse_check(spark, repo, plan):
    base = git.tree_files(spark, repo, "main", "s").select("scope", "path", "content")
    member = plan.hunks.join(plan.membership.select("hunk_index", "slice_id"), "hunk_index")
    name = F.concat(F.lit("u"), F.col("slice_id").cast("string"))
    hunks = member.select(F.lit("s").alias("scope"), name.alias("unit"), "hunk_index", F.col("file_path").alias("path"), "raw")
    units = plan.numbers().select(F.lit("s").alias("scope"), name.alias("unit"), F.col("topo_num").alias("rank"))
    links = plan.edges.select(F.lit("s").alias("scope"), F.concat(F.lit("u"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("u"), F.col("dst").cast("string")).alias("dst"))
    rows = apply.flat_first_units(base, units, hunks, links).collect()
    assert all(r.error is None and r.tree for r in rows) and {r.base_kind for r in rows} == {"root", "reuse"}
    head = git.tree_files(spark, repo, "feat", "s").select("scope", "path", "content")
    assert {r.merged for r in apply.reverses(head, hunks).collect()} == {True}
    assert False in {r.merged for r in apply.reverses(base, hunks).collect()}


def test_working_tree_source_and_scans(spark, repo):
    with open(os.path.join(repo, "new.md"), "w") as f:
        f.write("x\n")
    before = git.git(repo, "status", "--porcelain")
    source = git.resolve_source(repo, "main", worktree=True)
    assert source.uncommitted == [("??", "new.md")] and git.git(repo, "status", "--porcelain") == before
    assert "new.md" in git.diff_text(spark, repo, source.merge_base, source.ref).first()["text"]
    os.remove(os.path.join(repo, "new.md"))
    names = {r.path: r.status for r in git.name_status(spark, repo, "main", "feat").collect()}
    assert names["bun.lock"] == "A" and names["old.txt"] == "D" and names["README.md"] == "M"
    log = git.commit_log(spark, repo, "main..feat").collect()
    assert len(log) == 1 and log[0].message.startswith("feat") and len(log[0].parents) == 1
    assert git.remote_heads(spark, repo) is None


def test_report_is_json_with_all_slices(plan):
    import json

    row = plan.report().first()
    doc = json.loads(row.plan)
    assert row.ok and len(doc["slices"]) == plan.units.count() and {e["dependsOn"] for e in doc["edges"]}
    assert review.text_report(plan).startswith("slice0 ")


def test_sections_without_hunks(spark):
    text = "diff --git a/x.png b/x.png\nBinary files differ\ndiff --git a/o b/n\nsimilarity index 100%\nrename from o\nrename to n\ndiff --git a/m b/m\nold mode 100644\nnew mode 100755\ndiff --git a/e b/e\nnew file mode 100644\nindex 0..0\ndiff --git a/q b/q\nstrange\n"
    rows = diffs.excluded(diffs.sections(spark.createDataFrame([("d", text)], "diff_id string, text string"))).orderBy("section_pos").collect()
    assert [r.reason for r in rows] == ["binary", "rename-only", "mode-only", "empty-file", "unrecognized"]
    assert diffs.sections(spark.createDataFrame([("d", ""), ("e", None)], "diff_id string, text string")).count() == 0


def test_definitions_skip_strings_comments_and_nest():
    code = "// function no() {}\nexport class A {\n  constructor(x) { this.s = '}'; }\n  /* } */ run() {\n    const f = () => { return `}`; };\n  }\n}\ninterface I {\n  a: string;\n}\ntype T = { b: 1 };\n"
    got = {(q, a, b, e) for q, a, b, e in definitions(code)}
    assert ("A", 1, 6, True) in got and ("A.run", 3, 5, True) in got and ("A.constructor", 2, 2, True) in got and ("A.run.f", 4, 4, True) in got
    assert {"I", "T"} <= {q for q, *_ in got} and "no" not in {q for q, *_ in got}


def test_hunks_apply_shifted_reversed_and_not_at_all():
    old = "".join(f"l{i}\n" for i in range(20))
    raw = "@@ -3,3 +3,4 @@\n l2\n-l3\n+L3\n+new\n l4\n"
    new = apply.apply_hunks(old, [raw])
    assert new.splitlines()[2:6] == ["l2", "L3", "new", "l4"] and apply.apply_hunks(new, [raw], reverse=True) == old
    assert apply.apply_hunks("x\ny\n" + old, [raw]).splitlines()[4:8] == ["l2", "L3", "new", "l4"]
    with pytest.raises(ValueError):
        apply.apply_hunks("nothing\n", [raw])


def test_documents_and_packages(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"version":1,"sourceBranch":"b","budgets":{"files":2},"projections":[{"id":"a","atomicSlices":["x::y"],"dependsOn":["b"]},{"id":"no good"}],"defer":[{"slice":"s::t","reason":"later"}]}')
    got = read_manifest(spark, str(tmp_path / "m.json"), "m")
    assert got["entries"].count() == 2 and got["deferred"].first().selector == "s::t" and got["budgets"].first().max_files == 2 and got["problems"].count() == 1
    (tmp_path / "e.json").write_text('{"version":1,"units":[{"id":"u","selectors":["a::b","c::d"]},{"id":"u","selectors":["e::f"]}]}')
    units, problems = read_expected(spark, str(tmp_path / "e.json"), "e")
    assert units.count() == 3 and problems.count() == 1
    (tmp_path / "p.json").write_text('{"version":1,"profiles":{"unit":{"commands":["make test"]},"bad name":{"commands":["x"]}}}')
    assert [(r.profile, r.commands) for r in read_profiles(spark, str(tmp_path / "p.json")).collect()] == [("unit", ["make test"])]
    for d in ("packages/a", "packages/b", "node_modules/c"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "package.json").write_text('{"name":"%s","scripts":{"lint":"x","test":"y","other":"z"}}' % d[-1])
    assert sorted(r.command for r in check_commands(packages(spark, str(tmp_path)), "bun").collect()) == ["bun run --filter a lint", "bun run --filter a test", "bun run --filter b lint", "bun run --filter b test"]


def test_store_keeps_latest_first_and_deletes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    row = "branch string, slice_signature string, content_hash string"
    assert store.read("correspondence").count() == 0
    store.write("correspondence", spark.createDataFrame([("b", "s", "1"), ("b", "t", "1")], row), 1)
    store.write("correspondence", spark.createDataFrame([("b", "s", "2")], row), 2)
    store.delete("correspondence", spark.createDataFrame([("b", "t", None)], row), 3)
    assert [(r.slice_signature, r.content_hash) for r in store.read("correspondence", "b").collect()] == [("s", "2")]
    anchor = "comment_id long, branch string, anchor string"
    store.write("comment_anchors", spark.createDataFrame([(1, "b", "unchanged")], anchor), 1)
    store.write("comment_anchors", spark.createDataFrame([(1, "b", "orphaned")], anchor), 2)
    assert store.read("comment_anchors").first().anchor == "unchanged"


def test_stream_of_changes_reaches_the_store(spark, tmp_path):
    from hunkweave.streaming.changes import follow

    schema = "branch string, slice_signature string, content_hash string, at int"
    spark.createDataFrame([("b", "s", "old", 1), ("b", "s", "new", 2)], schema).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    q = follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, "correspondence", str(tmp_path / "cp"), ["branch", "slice_signature"], "at")
    q.awaitTermination(120)
    assert [r.content_hash for r in store.read("correspondence").collect()] == ["new"]


def test_a_repeated_write_of_runs_is_read_once_and_logs_compact(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    runs = spark.createDataFrame([("b", "plan", 1, 1, 5), ("b", "plan", 1, 1, 5), ("c", "plan", 2, 1, 7)], "branch string, command string, hunk_count int, slice_count int, duration_ms long")
    for _ in range(2):
        store.write("timing_runs", runs, 4)
    store.write("timing_runs", runs, 5)
    assert store.read("timing_runs").count() == 6 and store.read("timing_runs", "c").count() == 2
    store.compact("timing_runs")
    assert store.read("timing_runs").count() == 6
    row = "branch string, slice_signature string, content_hash string"
    store.write("correspondence", spark.createDataFrame([("b", "s", "1"), ("b", "t", "1")], row), 1)
    store.write("correspondence", spark.createDataFrame([("b", "s", "2")], row), 2)
    store.delete("correspondence", spark.createDataFrame([("b", "t", None)], row), 3)
    store.compact("correspondence")
    assert [(r.slice_signature, r.content_hash) for r in store.read("correspondence", "b").collect()] == [("s", "2")]
    store.write("correspondence", spark.createDataFrame([("b", "s", "0")], row), 1)
    assert store.read("correspondence").first().content_hash == "2"


def test_late_and_repeated_runs_of_a_stream_all_count_once(spark, tmp_path):
    from datetime import datetime

    from hunkweave.streaming.changes import day_totals, first_deliveries

    schema = "id long, command string, duration_ms long, started_at timestamp"
    day = lambda d: datetime(2025, 1, d)
    batches = [[(1, "plan", 5, day(20)), (2, "plan", 7, day(20))], [(2, "plan", 7, day(20)), (3, "plan", 9, day(1)), (3, "plan", 9, day(1))], [(4, "plan", 1, day(20))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = first_deliveries(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "days"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    got = {(r.day.day, r.command): (r.run_count, r.total_ms, r.longest_ms) for r in day_totals(spark, str(tmp_path / "days")).collect()}
    assert got == {(20, "plan"): (3, 13, 7), (1, "plan"): (1, 9, 9)}


def test_renames_come_with_both_paths(spark, tmp_path):
    root = str(tmp_path)
    g = lambda *a: subprocess.run(["git", "-C", root, *a], check=True, capture_output=True)
    g("init", "-q", "-b", "main")
    g("config", "user.email", "a@example.org")
    g("config", "user.name", "a")
    (tmp_path / "a b.txt").write_text("line\n" * 20)
    (tmp_path / "raw.bin").write_bytes(b"\xff\x00\xfe")
    g("add", "-A")
    g("commit", "-qm", "1")
    g("mv", "a b.txt", "c.txt")
    g("commit", "-qm", "2")
    assert [tuple(r) for r in git.name_status(spark, root, "main~1", "main").collect()] == [("R100", "c.txt", "a b.txt")]
    files = git.tree_files(spark, root, "main")
    assert {r.path: r.content is None for r in files.collect()} == {"c.txt": False, "raw.bin": True}
    assert apply.tree_hashes(files).first().tree == git.rev_parse(root, "main^{tree}")
    assert [r.content for r in git.files_at(spark, root, ["a b.txt", "none"], "main", "main~1").collect()] == ["line\n" * 20, None]
