"""Repository scans as DataFrames. The git program runs on the driver, its text is parsed by Spark."""

from __future__ import annotations

import os
import re
import subprocess
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD, UNIT = "\x1e", "\x1f"


def git(repo: str, *args: str, env: dict[str, str] | None = None) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, env={**os.environ, **(env or {})})
    if done.returncode:
        raise RuntimeError(f"git {' '.join(args[:2])}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode(errors="surrogateescape")


@dataclass
class DiffSource:
    """What is compared: a branch or the working tree against the merge base."""

    kind: str
    label: str
    ref: str
    merge_base: str
    uncommitted: list[tuple[str, str]] = field(default_factory=list)


def top_level(repo: str) -> str:
    return git(repo, "rev-parse", "--show-toplevel").strip()


def current_branch(repo: str) -> str:
    return git(repo, "rev-parse", "--abbrev-ref", "HEAD").strip()


def rev_parse(repo: str, ref: str) -> str:
    return git(repo, "rev-parse", "--verify", ref).strip()


def merge_base(repo: str, a: str, b: str) -> str:
    return git(repo, "merge-base", a, b).strip()


def worktree_tree(repo: str) -> str:
    """Tree id of the working tree, untracked files included, through an index of its own; nothing of the repository changes."""
    with tempfile.TemporaryDirectory() as scratch:
        env = {"GIT_INDEX_FILE": os.path.join(scratch, "index")}
        git(repo, "read-tree", "HEAD", env=env)
        git(repo, "add", "-A", env=env)
        return git(repo, "write-tree", env=env).strip()


def resolve_source(repo: str, base: str, branch: str | None = None, worktree: bool = False) -> DiffSource:
    """Branch and working tree exclude each other; without a branch the current one is meant."""
    if worktree:
        if branch and branch != current_branch(repo):
            raise ValueError("the working tree belongs to the checked out branch")
        pairs = [p for p in git(repo, "status", "--porcelain", "-z").split("\0") if p]
        return DiffSource("worktree", f"{current_branch(repo)} (working tree)", worktree_tree(repo), merge_base(repo, base, "HEAD"), [(p[:2].strip(), p[3:]) for p in pairs])
    branch = branch or current_branch(repo)
    return DiffSource("branch", branch, branch, merge_base(repo, base, branch))


def diff_text(spark: SparkSession, repo: str, old: str, new: str, diff_id: str = "diff") -> DataFrame:
    """(diff_id, text): the unified diff with three lines of context."""
    return spark.createDataFrame([(diff_id, git(repo, "diff", "-U3", old, new))], "diff_id string, text string")


def name_status(spark: SparkSession, repo: str, old: str, new: str) -> DataFrame:
    """(status, path, old_path) of every changed file; a renamed or copied one has its new path and the one that it comes from."""
    fields = iter(git(repo, "diff", "--name-status", "-M", "-z", old, new).split("\0"))
    rows = []
    for status in fields:
        if status:
            first = next(fields)
            moved = status[0] in "RC"
            rows.append((status, next(fields) if moved else first, first if moved else None))
    return spark.createDataFrame(rows, "status string, path string, old_path string")


def objects(repo: str, names: list[str]) -> list[bytes | None]:
    """Contents of objects by name, as ``ref:path``, read by one process; None for those that do not exist."""
    plain = [n for n in names if "\n" not in n]
    done = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input="".join(f"{n}\n" for n in plain).encode(errors="surrogateescape"), capture_output=True)
    out, at, found = done.stdout, 0, {}
    for n in plain:
        end = out.index(b"\n", at)
        head = out[at:end]
        at = end + 1
        if not head.endswith(b" missing"):
            size = int(head.rsplit(b" ", 1)[1])
            found[n] = out[at : at + size]
            at += size + 1
    return [found.get(n) for n in names]


def object_ids(repo: str, names: list[str]) -> list[str | None]:
    """Ids of objects by name, as ``commit^{tree}``, by one process; None for those that do not exist."""
    done = subprocess.run(["git", "-C", repo, "cat-file", "--batch-check=%(objectname)"], input="".join(f"{n}\n" for n in names).encode(), capture_output=True)
    return [None if line.endswith(" missing") else line for line in done.stdout.decode().splitlines()]


def _text(data: bytes | None) -> str | None:
    """Text of a file, None for one that is not UTF-8."""
    try:
        return None if data is None else data.decode()
    except UnicodeDecodeError:
        return None


def files_at(spark: SparkSession, repo: str, paths: list[str], ref: str, fallback: str | None = None, diff_id: str = "diff") -> DataFrame:
    """(diff_id, path, content): each file at the ref, else at the fallback, else null; null too for a file that is not text."""
    found = dict(zip(paths, objects(repo, [f"{ref}:{p}" for p in paths])))
    lost = [p for p, data in found.items() if data is None] if fallback else []
    found.update(zip(lost, objects(repo, [f"{fallback}:{p}" for p in lost])))
    return spark.createDataFrame([(diff_id, p, _text(found[p])) for p in paths], "diff_id string, path string, content string")


def tree_files(spark: SparkSession, repo: str, ref: str, scope: str = "scope", paths: set[str] | None = None) -> DataFrame:
    """(scope, path, content, mode, blob) of every file of a tree; of those named alone where ``paths`` are, the rest without content."""
    listed = [line.split("\t", 1) for line in git(repo, "ls-tree", "-r", "-z", ref).split("\0") if line]
    rows = [(path, *meta.split()[::2]) for meta, path in listed]
    wanted = [r for r in rows if paths is None or r[0] in paths]
    content = dict(zip([r[0] for r in wanted], objects(repo, [r[2] for r in wanted])))
    return spark.createDataFrame([(scope, p, _text(content.get(p)), mode, blob) for p, mode, blob in rows], "scope string, path string, content string, mode string, blob string")


def commit_log(spark: SparkSession, repo: str, span: str) -> DataFrame:
    """(pos, sha, parents, author_name, author_email, author_date, message), oldest first."""
    text = git(repo, "log", "--reverse", f"--format=%H{UNIT}%P{UNIT}%an{UNIT}%ae{UNIT}%aI{UNIT}%B{RECORD}", span)
    parts = spark.createDataFrame([(text,)], "text string").select(F.posexplode(F.split("text", RECORD)).alias("pos", "rec")).where(F.col("rec").rlike(r"\S")).select("pos", F.split(F.regexp_replace("rec", r"^\n", ""), UNIT).alias("f"))
    return parts.select("pos", F.get("f", F.lit(0)).alias("sha"), F.filter(F.split(F.get("f", F.lit(1)), " "), lambda p: p != "").alias("parents"), F.get("f", F.lit(2)).alias("author_name"), F.get("f", F.lit(3)).alias("author_email"), F.get("f", F.lit(4)).alias("author_date"), F.get("f", F.lit(5)).alias("message"))


def remote_heads(spark: SparkSession, repo: str, remote: str = "origin") -> DataFrame | None:
    """(branch_name, remote_sha), None where the remote cannot be read."""
    try:
        text = git(repo, "ls-remote", "--heads", remote)
    except RuntimeError:
        return None
    rows = [(m[2], m[1]) for m in re.finditer(r"^([0-9a-f]+)\trefs/heads/(.+)$", text, re.M)]
    return spark.createDataFrame(rows, "branch_name string, remote_sha string")
