import json
import subprocess

import pytest

from hunkweave import cli
from tests.test_repository import repo  # noqa: F401


def test_plan_emit_validate_score_and_overrides(spark, repo, tmp_path, capsys):  # noqa: F811
    base = ["--repo", repo, "--base", "main"]
    out = tmp_path / "m.json"
    assert cli.run(spark, [*base, "--json", "plan", "feat", "--coarsen", "--target-slices", "3", "--emit-manifest", str(out), "--timing"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["ok"]
    doc = json.loads(out.read_text())
    assert doc["sourceBranch"] == "feat" and "deps" in {p["id"] for p in doc["projections"]}
    assert cli.run(spark, [*base, "--json", "validate", "feat", "--manifest", str(out)]) == 0
    codes = {json.loads(line)["code"] for line in capsys.readouterr().out.splitlines()}
    assert codes == {"no-intent", "no-verification"}
    expected = tmp_path / "e.json"
    expected.write_text(json.dumps({"version": 1, "units": [{"id": "u", "selectors": ["src/helper.ts::helper"]}, {"id": "v", "selectors": ["src/a.ts::UserService"]}]}))
    assert cli.run(spark, [*base, "score", "feat", "--expected", str(expected), "--threshold", "1"]) == 0
    assert cli.run(spark, [*base, "override", "add", "feat", "force_merge", "src/helper.ts::helper"]) == 1
    assert cli.run(spark, [*base, "override", "add", "feat", "force_merge", "src/helper.ts::helper", "src/a.ts::UserService"]) == 0
    capsys.readouterr()
    assert cli.run(spark, [*base, "override", "list", "feat"]) == 0 and "force_merge" in capsys.readouterr().out
    assert cli.run(spark, [*base, "override", "remove", "feat", "1"]) == 0 and cli.run(spark, [*base, "override", "remove", "feat", "1"]) == 1
    assert subprocess.run(["git", "-C", repo, "diff", "--quiet", "HEAD"]).returncode == 0


@pytest.fixture(scope="module")
def surface_repo(tmp_path_factory):
    """A branch of two files of which one needs the other, a hand-made branch for the first, and a grouping of both."""
    root = str(tmp_path_factory.mktemp("surface"))

    def g(*a):
        subprocess.run(["git", "-C", root, *a], check=True, capture_output=True)

    def write(name, text):
        with open(f"{root}/{name}", "w") as f:
            f.write(text)

    g("init", "-q", "-b", "main")
    g("config", "user.email", "a@example.org")
    g("config", "user.name", "a")
    write("keep.bin", "x\n")
    write("one.ts", "export function one() {\n  return 1;\n}\n")
    g("add", "-A")
    g("commit", "-qm", "base")
    g("checkout", "-qb", "hand")
    write("one.ts", "export function one() {\n  return 2;\n}\n")
    g("commit", "-qam", "hand")
    g("checkout", "-qb", "mega", "main")
    write("one.ts", "export function one() {\n  return 2;\n}\n")
    write("two.ts", "export function two() {\n  return one();\n}\n")
    g("add", "-A")
    g("commit", "-qm", "mega")
    entries = [{"id": "first", "intent": "x", "atomicSlices": ["one.ts::one"], "verification": ["true"]}, {"id": "second", "intent": "y", "atomicSlices": ["two.ts::two"], "dependsOn": ["first"], "verification": ["true"]}]
    write("../surface-manifest.json", json.dumps({"version": 1, "sourceBranch": "mega", "base": "main", "projections": entries}))
    write("../surface-prs.json", json.dumps([{"number": 7, "title": "t", "state": "OPEN", "headRefName": "hand", "baseRefName": "main", "url": "u7"}]) + json.dumps([{"number": 8, "title": "t", "state": "OPEN", "headRefName": "gone", "baseRefName": "main", "url": "u8"}]))
    write("../surface-stacks.json", json.dumps([{"number": 3, "base": "main", "open": True, "prs": [{"number": 7, "state": "open", "draft": False, "merged": False, "headRef": "hand"}]}]))
    write("../surface-comments.json", json.dumps([{"id": 1, "path": "one.ts", "line": 2, "original_line": 2, "side": "RIGHT", "in_reply_to_id": None, "body": "why", "pr_number": 7}]))
    return root


def test_commands_over_a_declared_grouping(spark, surface_repo, capsys):
    base = ["--repo", surface_repo, "--base", "main", "--json"]
    where = f"{surface_repo}/../surface-"
    m = ["--manifest", f"{where}manifest.json"]

    def call(*args):
        capsys.readouterr()
        status = cli.run(spark, [*base, *args])
        return status, [json.loads(line) for line in capsys.readouterr().out.splitlines()]

    status, rows = call("verify", "mega", *m)
    assert status == 0 and rows[0]["same"] and [r.get("build") for r in rows[1:]] == ["no-command", "no-command"]
    status, rows = call("push", "mega", *m, "--projection", "flat-first", "--draft")
    assert status == 0 and {r["unit"]: (r["status"], r["base"], r["draft"]) for r in rows} == {"first": ("created", "main", True), "second": ("created", "review/mega/first", True)}
    status, rows = call("materialize", "mega", *m, "--only", "second")
    assert status == 0 and [(r["unit"], r["local_status"]) for r in rows] == [("first", "created"), ("second", "created")]
    assert rows[1]["tree"] == subprocess.run(["git", "-C", surface_repo, "rev-parse", "mega^{tree}"], capture_output=True, text=True).stdout.strip()
    assert call("materialize", "mega", *m, "--only", "third")[0] == 1
    status, rows = call("manifest", "discover", "mega", *m, "--prs", f"{where}prs.json")
    assert {(r["projection"], r.get("pr_number"), r["evidence"]) for r in rows} == {("first", 7, "exact-tree"), ("second", None, "none")}
    status, rows = call("manifest", "adopt", "mega", "second", *m, "--prs", f"{where}prs.json", "--pr", "7", "--head", "hand")
    assert status == 1 and {r["code"] for r in rows} == {"adopt-mismatch", "base-disagreement"}
    assert call("manifest", "adopt", "mega", "first", *m, "--prs", f"{where}prs.json", "--pr", "7", "--head", "hand", "--yes") == (0, [])
    assert [(r["projection"], r["slice_branch"], r["adopted"]) for r in call("manifest", "list", "mega")[1]] == [("first", "hand", True)]
    status, rows = call("review-context", "mega", *m, "--comments", f"{where}comments.json", "--stacks", f"{where}stacks.json")
    assert [(r["unit"], r["state"], r["threads"], r.get("stack_number")) for r in rows] == [("first", "unchanged", 1, 3), ("second", "never-pushed", 0, None)]
    status, rows = call("stack", "status", "mega", "--stacks", f"{where}stacks.json")
    assert status == 0 and [(r["node_id"], r["placement"], r["stack_number"], r["position"]) for r in rows] == [("manifest:first", "solitary", 3, 1)]
    assert call("manifest", "forget", "mega", "first")[0] == 0 and call("manifest", "forget", "mega", "first")[0] == 1
    expected = f"{where}expected.json"
    with open(expected, "w") as f:
        json.dump({"version": 1, "units": [{"id": "u", "selectors": ["one.ts::one"]}, {"id": "v", "selectors": ["two.ts::two"]}]}, f)
    status, rows = call("score", "mega", "--expected", expected, "--layer", "manifest", *m, "--threshold", "1")
    assert status == 0 and rows[0]["agreement"] == 1.0


def test_tool_server_answers_line_by_line(spark, surface_repo):
    import io

    from hunkweave import serve

    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "plan", "arguments": {"branch": "mega"}}}, {"id": 4, "method": "tools/call", "params": {"name": "plan"}}, {"id": 5, "method": "x"}]
    out = io.StringIO()
    serve.loop(spark, surface_repo, "main", io.StringIO("".join(json.dumps(m) + "\n" for m in asked) + "{\n"), out)
    got = [json.loads(line) for line in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, None] and len(got[1]["result"]["tools"]) == 8
    assert not got[2]["result"]["isError"] and json.loads(got[2]["result"]["content"][0]["text"])["ok"]
    assert got[3]["error"]["code"] == -32602 and got[4]["error"]["code"] == -32601 and got[5]["error"]["code"] == -32700


def test_bad_numbers_are_refused():
    for text in ("0", "-1", "x", "1.5"):
        with pytest.raises(Exception):
            cli.positive(text)
    for text in ("-0.1", "1.1", "x"):
        with pytest.raises(Exception):
            cli.fraction(text)
    assert cli.positive("3") == 3 and cli.fraction("0.5") == 0.5
