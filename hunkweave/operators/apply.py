"""Patches applied to text, and stored-object hashes that prove that pieces rebuild the whole.

Hunks of different files never touch, so files are rebuilt in parallel; within a file hunks apply in order. Context must
match exactly; a hunk whose place has moved is searched for outward from where it is expected, as without fuzz.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkweave.functions.hashes import blob_hash

_HEADER = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _lines(text: str) -> list[str]:
    """Lines with their ends; only a line feed ends a line, as in a diff."""
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def sides(raw: str) -> tuple[int, list[str], list[str]]:
    """(old start, old lines, new lines) of a hunk, line ends kept."""
    head, _, body = raw.partition("\n")
    start = int(_HEADER.match(head)[1])
    old, new, last = [], [], None
    for line in _lines(body):
        mark, text = line[:1], line[1:]
        if mark == "\\":  # no newline at the end of the side before
            for side in last or ():
                side[-1] = side[-1].rstrip("\n")
            continue
        last = [old, new] if mark in (" ", "\n", "") else [old] if mark == "-" else [new]
        for side in last:
            side.append(text if mark != "\n" else "\n")
    return start, old, new


def apply_hunks(content: str, raws: Iterable[str], reverse: bool = False) -> str:
    """Content with hunks applied in order; raises ValueError where one does not fit."""
    lines = _lines(content)
    shift = 0
    for raw in raws:
        start, old, new = sides(raw)
        if reverse:
            start, old, new = int(_HEADER.match(raw)[3]), new, old
        want = max(0, start - (1 if old else 0)) + shift
        far = max(want, len(lines) - want) + 1
        at = next((p for d in range(far) for p in ({want - d, want + d}) if 0 <= p and lines[p : p + len(old)] == old and p + len(old) <= len(lines)), None)
        if at is None:
            raise ValueError(f"hunk {raw.partition(chr(10))[0]} does not apply")
        lines[at : at + len(old)] = new
        shift += len(new) - len(old) + (at - want)
    return "".join(lines)


def apply_chain(files: DataFrame, steps: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, path, step, content, error): every file after each step that touches it, steps applied one upon another.

    ``files``: (scope, path, content), a missing file is empty. ``steps``: (scope, path, step, hunk_index, raw). After an error
    later steps of the file carry it on.
    """
    kind = dict(steps.dtypes)[scope]
    rows = steps.join(files, [scope, "path"], "left").select(scope, "path", "step", "hunk_index", "raw", "content")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["step", "hunk_index"])
        text, error, out = pdf["content"].iloc[0] or "", None, []
        for step, part in pdf.groupby("step", sort=True):
            if error is None:
                try:
                    text = apply_hunks(text, part["raw"])
                except ValueError as e:
                    error = str(e)
            out.append((pdf[scope].iloc[0], pdf["path"].iloc[0], step, None if error else text, error))
        return pd.DataFrame(out, columns=[scope, "path", "step", "content", "error"])

    return rows.groupBy(scope, "path").applyInPandas(run, f"{scope} {kind}, path string, step int, content string, error string")


def reverses(base_files: DataFrame, patch_hunks: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, unit, merged): True where the whole patch of a unit can be taken out of the base, so it is in it already."""
    kinds = dict(patch_hunks.dtypes)
    rows = patch_hunks.join(base_files, [scope, "path"], "left").select(scope, "unit", "path", "hunk_index", "raw", "content")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            apply_hunks(pdf["content"].iloc[0] or "", pdf.sort_values("hunk_index")["raw"], reverse=True)
            fits = True
        except ValueError:
            fits = False
        return pd.DataFrame({scope: [pdf[scope].iloc[0]], "unit": [pdf["unit"].iloc[0]], "fits": [fits]})

    each = rows.groupBy(scope, "unit", "path").applyInPandas(run, f"{scope} {kinds[scope]}, unit {kinds['unit']}, fits boolean")
    return each.groupBy(scope, "unit").agg(F.bool_and("fits").alias("merged"))


def tree_hash(blobs: dict[str, tuple[str, str]]) -> str:
    """Object id of a tree of (mode, blob id) by path."""
    here: dict[str, tuple[str, str]] = {}
    below: dict[str, dict[str, tuple[str, str]]] = {}
    for path, entry in blobs.items():
        head, _, rest = path.partition("/")
        if rest:
            below.setdefault(head, {})[rest] = entry
        else:
            here[head] = entry
    for name, inner in below.items():
        here[name] = ("40000", tree_hash(inner))
    data = b"".join(
        f"{mode} {name}".encode() + b"\0" + bytes.fromhex(oid) for name, (mode, oid) in sorted(here.items(), key=lambda kv: (kv[0] + ("/" if kv[1][0] == "40000" else "")).encode())
    )
    return hashlib.sha1(f"tree {len(data)}".encode() + b"\0" + data).hexdigest()


def _blob(files: DataFrame) -> Column:
    """Object id of each file: the one given in ``blob``, where there is one, else that of the content."""
    made = blob_hash(F.col("content"))
    return F.coalesce("blob", made) if "blob" in files.columns else made


def tree_hashes(files: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, tree): the tree id of every snapshot. ``files``: (scope, path, content, mode[, blob]). Contents are hashed on the way and only ids gathered."""
    kind = dict(files.dtypes)[scope]
    ids = files.select(scope, "path", "mode", _blob(files).alias("blob"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({scope: [pdf[scope].iloc[0]], "tree": [tree_hash(dict(zip(pdf["path"], zip(pdf["mode"], pdf["blob"]))))]})

    return ids.groupBy(scope).applyInPandas(run, f"{scope} {kind}, tree string")


def rebuild_check(base_files: DataFrame, steps: DataFrame, goal_files: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, rebuilt, goal, same): tree of the base with all steps applied in order against the tree of the goal."""
    last = apply_chain(base_files.select(scope, "path", "content"), steps, scope)
    final = last.groupBy(scope, "path").agg(F.max_by("content", "step").alias("content"), F.max("error").alias("error"))
    failed = final.where(F.col("error").isNotNull()).select(scope).distinct().withColumn("_failed", F.lit(True))
    kept = base_files.join(final.select(scope, "path"), [scope, "path"], "left_anti")
    kept = kept.select(scope, "path", F.lit(None).cast("string").alias("content"), "mode", _blob(kept).alias("blob"))
    modes = base_files.select(scope, "path", "mode")
    made = final.join(modes, [scope, "path"], "left").select(scope, "path", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("mode", F.lit("100644")).alias("mode"), F.lit(None).cast("string").alias("blob"))
    # A file that a patch leaves empty is gone unless the goal keeps it empty.
    gone = made.where("content = ''").join(goal_files.select(scope, "path"), [scope, "path"], "left_anti")
    made = made.join(gone.select(scope, "path"), [scope, "path"], "left_anti")
    rebuilt = tree_hashes(kept.unionByName(made), scope).withColumnRenamed("tree", "rebuilt")
    goal = tree_hashes(goal_files, scope).withColumnRenamed("tree", "goal")
    joined = goal.join(rebuilt, scope, "left").join(failed, scope, "left")
    return joined.select(scope, "rebuilt", "goal", (F.coalesce(F.col("rebuilt") == F.col("goal"), F.lit(False)) & F.col("_failed").isNull()).alias("same"))


def flat_first(base: dict[str, tuple[str, str]], order: list[str], hunks: dict[str, list[tuple[str, str]]], edges: list[tuple[str, str]], rest: dict[str, tuple[str, str]] | None = None) -> list[dict]:
    """Each unit of one plan built on its prerequisites alone; rows with base kind, prerequisites, tree id, tree id on the base alone and error.

    A unit that does not apply is tried again upon all earlier units that share a file with it; a unit whose prerequisite
    failed fails with it. ``base``: (content, mode) of the files that hunks touch, ``rest``: (mode, blob id) of all others,
    ``hunks``: unit to (path, raw) in diff order. One plan is one task; plans run in parallel.
    """
    rest = rest or {}
    rank = {u: i for i, u in enumerate(order)}
    direct: dict[str, list[str]] = {u: [] for u in order}
    for a, b in edges:
        if a in direct and b not in direct[a]:
            direct[a].append(b)
    below: dict[str, list[str]] = {}
    failed: set[str] = set()
    rows = []

    def gather(seeds: Iterable[str]) -> list[str]:
        return sorted({x for s in seeds for x in (s, *below.get(s, ()))}, key=rank.__getitem__)

    def build(units: list[str]) -> dict[str, str]:
        tree = {p: content for p, (content, _) in base.items()}
        for u in units:
            by_path: dict[str, list[str]] = {}
            for path, raw in hunks.get(u, ()):
                by_path.setdefault(path, []).append(raw)
            for path, raws in by_path.items():
                tree[path] = apply_hunks(tree.get(path, ""), raws)
        return tree

    def alone(unit: str) -> str | None:
        try:
            return tree_id(build([unit]))
        except ValueError:
            return None

    def tree_id(tree: dict[str, str]) -> str:
        made = {p: (base[p][1] if p in base else "100644", hashlib.sha1(f"blob {len(c.encode())}".encode() + b"\0" + c.encode()).hexdigest()) for p, c in tree.items() if c}
        return tree_hash({**rest, **made})

    for unit in order:
        needs, widened, error, tree = gather(direct[unit]), False, None, None
        blocked = next((p for p in needs if p in failed), None)
        if blocked:
            error = f"prerequisite {blocked} could not be built"
        else:
            try:
                tree = build([*needs, unit])
            except ValueError as e:
                error = str(e)
                mine = {p for p, _ in hunks.get(unit, ())}
                near = [t for t in order[: rank[unit]] if t not in needs and mine & {p for p, _ in hunks.get(t, ())}]
                wide = gather([*needs, *near])
                if near and not any(p in failed for p in wide):
                    try:
                        tree, needs, widened, error = build([*wide, unit]), wide, True, None
                    except ValueError:
                        pass
        below[unit] = needs
        if error:
            failed.add(unit)
        top = needs[-1] if needs else None
        reuse = top is not None and [*below[top], top] == needs
        rows.append({
            "unit": unit, "base_kind": None if error else "root" if not needs else "reuse" if reuse else "integration", "base_unit": top if reuse and not error else None, "prerequisites": needs, "widened": widened, "error": error,
            "tree": None if tree is None else tree_id(tree), "own_tree": alone(unit) if needs else None,
        })
    return rows


def flat_first_units(base_files: DataFrame, units: DataFrame, hunk_rows: DataFrame, edges: DataFrame, scope: str = "scope") -> DataFrame:
    """``flat_first`` for many plans. base_files (scope, path, content[, mode, blob]), units (scope, unit, rank), hunk_rows (scope, unit, hunk_index, path, raw), edges (scope, src, dst).

    Of the base only the files that hunks touch are sent whole; all others go by their object ids.
    """
    kind = dict(units.dtypes)[scope]
    text = F.lit(None).cast("string")
    long = F.lit(None).cast("long")
    files = base_files.select(scope, "path", "content", _blob(base_files).alias("blob"), (F.col("mode") if "mode" in base_files.columns else F.lit("100644")).alias("mode"))
    touched = hunk_rows.select(scope, "path", F.lit(True).alias("_t")).distinct()
    files = files.join(touched, [scope, "path"], "left")
    whole = F.col("_t") & F.col("content").isNotNull()
    rows = (
        files.select(scope, F.when(whole, "f").otherwise("r").alias("t"), F.col("path").alias("a"), F.when(whole, F.col("content")).otherwise(F.col("blob")).alias("b"), F.col("mode").alias("c"), long.alias("n"))
        .unionByName(units.select(scope, F.lit("u").alias("t"), F.col("unit").alias("a"), text.alias("b"), text.alias("c"), F.col("rank").cast("long").alias("n")))
        .unionByName(hunk_rows.select(scope, F.lit("h").alias("t"), F.col("unit").alias("a"), F.col("path").alias("b"), F.col("raw").alias("c"), F.col("hunk_index").cast("long").alias("n")))
        .unionByName(edges.select(scope, F.lit("e").alias("t"), F.col("src").alias("a"), F.col("dst").alias("b"), text.alias("c"), long.alias("n")))
    )
    schema = f"{scope} {kind}, unit string, base_kind string, base_unit string, prerequisites array<string>, widened boolean, error string, tree string, own_tree string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = {t: p for t, p in pdf.sort_values("n", kind="stable").groupby("t")}
        none = pdf.iloc[:0]
        hunks: dict[str, list[tuple[str, str]]] = {}
        for u, p, r in zip(*(part.get("h", none)[c] for c in "abc")):
            hunks.setdefault(u, []).append((p, r))
        f, e, r = part.get("f", none), part.get("e", none), part.get("r", none)
        out = flat_first(dict(zip(f["a"], zip(f["b"], f["c"]))), part.get("u", none)["a"].tolist(), hunks, list(zip(e["a"], e["b"])), dict(zip(r["a"], zip(r["c"], r["b"]))))
        return pd.DataFrame([{scope: pdf[scope].iloc[0], **row} for row in out], columns=names)

    return rows.groupBy(scope).applyInPandas(run, schema)
