"""Commands over one repository: ``python -m hunkweave.cli plan|validate|score|verify|push|materialize|review-context|stack|manifest|override|serve …``.

All read only, but for the store of overrides, timings and bindings. Pull requests, comments and stacks are read from exported
JSON files; what a push, a link or an edit would do is printed as rows.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkweave.operators import stacks
from hunkweave.operators.manifest import verdict
from hunkweave.operators.partition import invalid_overrides
from hunkweave.plans import review, surface, validate
from hunkweave.runtime import materialize
from hunkweave.sources import documents, git
from hunkweave.sources.store import Store

FOLDER = ".hunkweave"


def positive(text: str) -> int:
    if not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError(f"'{text}' is no whole number above zero")
    return int(text)


def fraction(text: str) -> float:
    try:
        value = float(text)
    except ValueError:
        value = -1.0
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError(f"'{text}' is no number from 0 to 1")
    return value


def ids(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hunkweave")
    p.add_argument("--repo", default=".")
    p.add_argument("--base", default="main")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("plan", "validate", "score"):
        c = sub.add_parser(name)
        c.add_argument("branch", nargs="?")
        c.add_argument("--worktree", action="store_true")
        c.add_argument("--target-slices", type=positive)
        if name == "plan":
            c.add_argument("--coarsen", action="store_true")
            c.add_argument("--timing", action="store_true")
            c.add_argument("--emit-manifest")
        if name == "validate":
            c.add_argument("--manifest")
            c.add_argument("--strict", action="store_true")
            c.add_argument("--require-intent", action="store_true")
            c.add_argument("--require-verification", action="store_true")
        if name == "score":
            c.add_argument("--expected", required=True)
            c.add_argument("--threshold", type=fraction, default=2 / 3)
            c.add_argument("--layer", choices=["atomic", "candidates", "manifest"], default="atomic")
            c.add_argument("--include-fallback", action="store_true")
            c.add_argument("--manifest")
    for name in ("verify", "push", "materialize", "review-context"):
        c = sub.add_parser(name)
        c.add_argument("branch", nargs="?")
        c.add_argument("--manifest")
        if name == "verify":
            c.add_argument("--build-cmd")
            c.add_argument("--no-build-check", action="store_true")
        if name in ("push", "materialize"):
            c.add_argument("--projection", choices=["stacked", "flat-first"], default="stacked" if name == "push" else "flat-first")
        if name == "push":
            for flag in ("--reviewable-stack", "--draft", "--reclaim", "--dry-run"):
                c.add_argument(flag, action="store_true")
        if name == "materialize":
            c.add_argument("--only", type=ids, default=[])
            c.add_argument("--force", action="store_true")
        if name == "review-context":
            c.add_argument("--projection")
            c.add_argument("--comments")
            c.add_argument("--stacks")
    k = sub.add_parser("stack").add_subparsers(dest="action", required=True)
    for name in ("status", "link"):
        c = k.add_parser(name)
        c.add_argument("branch")
        c.add_argument("--stacks")
        if name == "link":
            c.add_argument("--reclaim", action="store_true")
            c.add_argument("--dry-run", action="store_true")
    m = sub.add_parser("manifest").add_subparsers(dest="action", required=True)
    for name in ("list", "forget", "discover", "adopt"):
        c = m.add_parser(name)
        c.add_argument("branch")
        c.add_argument("--manifest")
        c.add_argument("--remote", default="origin")
        if name in ("forget", "adopt"):
            c.add_argument("projection")
        if name in ("discover", "adopt"):
            c.add_argument("--prs", required=True)
        if name == "adopt":
            c.add_argument("--pr", type=positive, required=True)
            c.add_argument("--head", required=True)
            c.add_argument("--yes", action="store_true")
    sub.add_parser("serve")
    o = sub.add_parser("override").add_subparsers(dest="action", required=True)
    a = o.add_parser("add")
    a.add_argument("branch")
    a.add_argument("kind")
    a.add_argument("selector_a")
    a.add_argument("selector_b", nargs="?")
    a.add_argument("--note")
    for name in ("list", "remove"):
        c = o.add_parser(name)
        c.add_argument("branch")
        if name == "remove":
            c.add_argument("id", type=positive)
    return p


def _print(rows: DataFrame, as_json: bool) -> None:
    for r in rows.toJSON().collect() if as_json else (" | ".join("" if v is None else str(v) for v in row) for row in rows.collect()):
        print(r)


def run(spark: SparkSession, argv: list[str]) -> int:
    """Run one command; the result is the exit status: 1 where a plan is cyclic, a check failed or a score is too low."""
    args = _parser().parse_args(argv)
    repo = git.top_level(args.repo)
    store = Store(spark, os.path.join(repo, FOLDER, "store"))
    if args.command == "override":
        if args.action == "add":
            number = (store.read("overrides").agg(F.max("id")).first()[0] or 0) + 1
            row = spark.createDataFrame([(number, args.branch, args.kind, args.selector_a, args.selector_b, args.note)], "id long, branch string, kind string, selector_a string, selector_b string, note string")
            wrong = invalid_overrides(row).first()
            if wrong:
                print(wrong["reason"], file=sys.stderr)
                return 1
            store.write("overrides", row, time.time_ns())
            print(number)
        elif args.action == "remove":
            row = store.read("overrides", args.branch).where(F.col("id") == args.id)
            if row.isEmpty():
                print(f"no override {args.id} on {args.branch}", file=sys.stderr)
                return 1
            store.delete("overrides", row, time.time_ns())
        else:
            _print(store.read("overrides", args.branch).orderBy("id"), args.json)
        return 0

    if args.command == "serve":
        from hunkweave import serve

        return serve.loop(spark, args.repo, args.base)
    correspondence = store.read("correspondence")
    if args.command == "stack":
        links, members = surface.stack_status(correspondence, args.branch, surface.exported(spark, args.stacks, surface.STACKS), store.read("stack_ownership"))
        if args.action == "link":
            owned = store.read("stack_ownership", args.branch)
            _print(stacks.link_actions(links.drop("owned"), owned, args.reclaim, args.dry_run), args.json)
        else:
            _print(links, args.json)
            _print(members, args.json)
        return 0
    if args.command == "manifest" and args.action in ("list", "forget"):
        bound = correspondence.where((F.col("branch") == args.branch) & F.col("slice_signature").startswith("manifest:"))
        if args.action == "list":
            _print(bound.select(F.substring_index("slice_signature", ":", -1).alias("projection"), "slice_branch", "pr_number", "adopted", "base_ref").orderBy("projection"), args.json)
            return 0
        bound = bound.where(F.col("slice_signature") == f"manifest:{args.projection}")
        if bound.isEmpty():
            print(f"{args.projection} is bound to nothing", file=sys.stderr)
            return 1
        store.delete("correspondence", bound, time.time_ns())
        return 0

    start = time.monotonic()
    branch = args.branch or git.current_branch(repo)
    overrides = store.read("overrides", branch).withColumn("diff_id", F.lit("diff"))
    plan = review.plan_branch(spark, repo, args.base, args.branch, getattr(args, "worktree", False), overrides)
    if plan.hunks.isEmpty():
        print("nothing to plan")
        return 0
    cyclic = not plan.order.where("topo_num is null").isEmpty()
    if args.command == "plan":
        if args.json:
            print(plan.report().first()["plan"])
        else:
            print(review.text_report(plan))
        if args.coarsen and not cyclic:
            _print(plan.coarse(args.target_slices), args.json)
        if args.emit_manifest and not cyclic:
            with open(args.emit_manifest, "x", encoding="utf-8") as out:
                out.write(json.dumps(json.loads(validate.skeleton(plan, branch, args.base, args.target_slices).first()["manifest"]), indent=2) + "\n")
        if args.timing:
            row = [(branch, "plan", plan.hunks.count(), plan.units.count(), int((time.monotonic() - start) * 1000))]
            store.write("timing_runs", spark.createDataFrame(row, "branch string, command string, hunk_count int, slice_count int, duration_ms long"), time.time_ns())
        return int(cyclic)
    if cyclic:
        print("the plan has a dependency cycle", file=sys.stderr)
        return 1
    if args.command == "score" and args.layer != "manifest":
        expected, problems = documents.read_expected(spark, args.expected, "expected")
        if not problems.isEmpty():
            _print(problems, args.json)
            return 1
        got = validate.score_plan(plan, expected, args.threshold, "expected", args.include_fallback, args.target_slices, args.layer == "candidates")
        _print(got["agreement"], args.json)
        _print(got["disagreements"], args.json)
        return int(not got["agreement"].first()["pass"])
    name = branch.replace("/", "-") + ".json"
    path = args.manifest or documents.first_existing(os.path.join(repo, "review", name), os.path.join(repo, FOLDER, name))
    if not path:
        print("no manifest", file=sys.stderr)
        return 1
    relations = documents.read_manifest(spark, path, "manifest")
    profiles = documents.read_profiles(spark, documents.first_existing(os.path.join(repo, "review", "profiles.json"), os.path.join(repo, FOLDER, "profiles.json")))
    declared = validate.declare(plan, relations, profiles, "manifest").settle()
    if args.command == "score":
        expected, problems = documents.read_expected(spark, args.expected, "expected")
        if not problems.isEmpty():
            _print(problems, args.json)
            return 1
        got = validate.score_declared(plan, declared, expected, args.threshold, "expected", args.include_fallback)
        _print(got["agreement"], args.json)
        _print(got["disagreements"], args.json)
        return int(not got["agreement"].first()["pass"])
    checked = args.command == "validate"
    found = declared.findings(checked and args.require_intent, checked and args.require_verification)
    found = found.unionByName(declared.branch_mismatch(relations["manifests"].withColumn("branch", F.lit(branch))))
    found = materialize(found)
    if not checked:
        if not found.where("severity = 'error'").isEmpty():
            _print(found.where("severity = 'error'"), args.json)
            return 1
        source = git.resolve_source(repo, args.base, args.branch)
        return _surface(args, surface.Surface(spark, repo, branch, args.base, source.merge_base, plan, declared, correspondence), store)
    if found.where("severity = 'error'").isEmpty():
        source = git.resolve_source(repo, args.base, args.branch, args.worktree)
        found = found.unionByName(validate.git_findings(spark, repo, plan, declared, source.merge_base, source.ref))
    _print(found, args.json)
    result = verdict(found, args.strict).first()
    return int(bool(result and result["failed"]))


def _surface(args: argparse.Namespace, s: surface.Surface, store: Store) -> int:
    """Commands that need a valid grouping."""
    spark = s.spark
    if args.command == "verify":
        command = args.build_cmd or (documents.root_command(s.repo) or (None,))[0]
        tree, builds = surface.verification(spark, s.repo, s, store.read("build_cache"), command, not args.no_build_check)
        tree = materialize(tree)
        _print(tree, args.json)
        _print(builds.orderBy("rank"), args.json)
        return int(not tree.first()["same"])
    if args.command == "push":
        rows = materialize(s.push(args.projection == "stacked", reviewable=args.reviewable_stack, draft=args.draft, reclaim=args.reclaim, dry_run=args.dry_run))
        _print(rows, args.json)
        return int(not rows.where("status = 'blocked'").isEmpty())
    if args.command == "materialize":
        try:
            rows = materialize(s.materialize(args.only, args.projection == "stacked", args.force))
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        _print(rows.orderBy("rank"), args.json)
        return int(not rows.where("local_status = 'blocked' or error is not null").isEmpty())
    if args.command == "review-context":
        rows = s.review_context(surface.exported(spark, args.comments, surface.COMMENTS), surface.exported(spark, args.stacks, surface.STACKS))
        rows = rows.where(F.col("unit") == args.projection) if args.projection else rows
        _print(rows.orderBy("rank"), args.json)
        return 0
    prs = surface.exported(spark, args.prs, surface.PULL_REQUESTS)
    if args.action == "discover":
        _print(s.discover(prs, args.remote).orderBy("projection", "pr_number"), args.json)
        return 0
    pr = prs.where(F.col("number") == args.pr)
    if pr.isEmpty():
        print(f"no pull request {args.pr} in {args.prs}", file=sys.stderr)
        return 1
    found, row = s.adopt(args.projection, args.head, pr, args.remote)
    found = materialize(found)
    _print(found, args.json)
    if not found.where("severity = 'error'").isEmpty():
        return 1
    if args.yes:
        store.write("correspondence", row, time.time_ns())
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate(), sys.argv[1:]))
