"""JSON documents, exported API pages and package directories as relations, with their validation rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = (
    "version int, sourceBranch string, base string, budgets struct<files:int,hunks:int,changedLines:int>, "
    "projections array<struct<id:string,title:string,intent:string,atomicSlices:array<string>,glue:array<string>,dependsOn:array<string>,"
    "verification:array<string>,verificationProfile:string,verificationReason:string,oversizeReason:string>>, defer array<struct<slice:string,reason:string>>, _bad string"
)
EXPECTED = "version int, label string, units array<struct<id:string,selectors:array<string>,note:string>>, _bad string"
PROFILES = "version int, profiles map<string,struct<description:string,commands:array<string>>>, _bad string"
NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
# Lock files by the package manager they name, first match first, and the scripts that count as checks.
PACKAGE_MANAGERS = (("bun.lock", "bun"), ("bun.lockb", "bun"), ("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("package-lock.json", "npm"))
CHECK_SCRIPTS = ("typecheck", "type-check", "tsc", "lint", "test")
SKIPPED_DIRS = ("node_modules", "dist", "build", "out", "coverage", "vendor", "target")


def first_existing(*paths: str) -> str | None:
    return next((p for p in paths if os.path.exists(p)), None)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).cache()


def read_manifest(spark: SparkSession, path: str, scope: str) -> dict[str, DataFrame]:
    """Relations of a manifest: ``entries``, ``deferred``, ``budgets`` and ``problems`` (scope, problem)."""
    doc = _json(spark, path, MANIFEST).withColumn("scope", F.lit(scope))
    none = F.array().cast("array<string>")
    each = doc.select("scope", F.posexplode("projections").alias("pos", "p"))
    entries = each.select(
        "scope", F.col("p.id").alias("projection"), "pos", F.col("p.title").alias("title"), F.col("p.intent").alias("intent"), F.coalesce("p.atomicSlices", none).alias("atomic"), F.coalesce("p.glue", none).alias("glue"),
        F.coalesce("p.dependsOn", none).alias("depends"), F.coalesce("p.verification", none).alias("verification"), F.col("p.verificationProfile").alias("profile"), F.col("p.verificationReason").alias("reason"), F.col("p.oversizeReason").alias("oversize"),
    )
    problems = doc.where("_bad is not null").select("scope", F.lit("not valid JSON").alias("problem")).unionByName(
        doc.where("_bad is null and (version is null or version <> 1)").select("scope", F.lit("unknown version").alias("problem"))
    ).unionByName(entries.where(~F.coalesce(F.col("projection").rlike(NAME), F.lit(False))).select("scope", F.lit("entry id unusable in a branch name").alias("problem")))
    return {
        "entries": entries, "problems": problems,
        "deferred": doc.select("scope", F.explode("defer").alias("d")).select("scope", F.col("d.slice").alias("selector"), F.col("d.reason").alias("reason")),
        "budgets": doc.select("scope", F.col("budgets.files").alias("max_files"), F.col("budgets.hunks").alias("max_hunks"), F.col("budgets.changedLines").alias("max_lines")),
        "manifests": doc.select("scope", F.col("sourceBranch").alias("source_branch"), "base"),
    }


def read_expected(spark: SparkSession, path: str, scope: str) -> tuple[DataFrame, DataFrame]:
    """(scope, unit, unit_pos, selector) and the problems: repeated unit ids."""
    units = _json(spark, path, EXPECTED).withColumn("scope", F.lit(scope)).select("scope", F.posexplode("units").alias("unit_pos", "u"))
    repeated = units.groupBy("scope", F.col("u.id").alias("unit")).count().where("count > 1").select("scope", F.concat(F.lit("repeated unit "), "unit").alias("problem"))
    return units.select("scope", F.col("u.id").alias("unit"), "unit_pos", F.explode("u.selectors").alias("selector")), repeated


def read_profiles(spark: SparkSession, path: str | None) -> DataFrame:
    """(profile, commands); none where there is no file."""
    if not path:
        return spark.createDataFrame([], "profile string, commands array<string>")
    return _json(spark, path, PROFILES).select(F.explode("profiles").alias("profile", "_p")).where(F.col("profile").rlike(NAME)).select("profile", "_p.commands")


def api_pages(text: DataFrame, item: str) -> DataFrame:
    """Rows of concatenated JSON arrays, as paged API output comes. ``text``: (text), ``item``: the schema of one element."""
    pages = text.select(F.explode(F.split("text", r"(?<=\])\s*(?=\[)")).alias("page")).where(F.trim("page") != "")
    return pages.select(F.inline(F.from_json("page", f"array<struct<{item}>>")))


def packages(spark: SparkSession, root: str, depth: int = 3) -> DataFrame:
    """(dir, name, scripts, has_tsconfig) of every directory with a package file, hidden and generated ones left out."""
    rows = []
    for here, dirs, files in os.walk(root):
        dirs[:] = [d for d in sorted(dirs) if not d.startswith(".") and d not in SKIPPED_DIRS]
        rel = os.path.relpath(here, root)
        level = 0 if rel == "." else rel.count(os.sep) + 1
        if level >= depth:
            dirs[:] = []
        if level and "package.json" in files:
            rows.append((rel.replace(os.sep, "/"), open(os.path.join(here, "package.json"), encoding="utf-8").read(), "tsconfig.json" in files))
    found = spark.createDataFrame(rows, "dir string, text string, has_tsconfig boolean").withColumn("doc", F.from_json("text", "name string, scripts map<string,string>"))
    known = F.array(*[F.lit(s) for s in CHECK_SCRIPTS])
    return found.select("dir", F.col("doc.name").alias("name"), F.filter(known, lambda s: F.array_contains(F.coalesce(F.map_keys("doc.scripts"), F.array().cast("array<string>")), s)).alias("scripts"), "has_tsconfig")


def check_commands(found: DataFrame, manager: str) -> DataFrame:
    """(dir, command): one command per package and check script, as the package manager spells it."""
    each = found.select("dir", "name", F.explode("scripts").alias("s"))
    named = {"bun": F.format_string("bun run --filter %s %s", "name", "s"), "pnpm": F.format_string("pnpm --filter %s %s", "name", "s"), "yarn": F.format_string("yarn workspace %s run %s", "name", "s"), "npm": F.format_string("npm run %s --workspace %s", "s", "name")}[manager]
    return each.select("dir", F.when(F.col("name").isNull(), F.format_string(f"cd %s && {manager} run %s", "dir", "s")).otherwise(named).alias("command"))


def root_command(root: str) -> tuple[str, str] | None:
    """(command, source) that checks the whole repository, from its configuration files."""
    import json

    if os.path.exists(os.path.join(root, "tsconfig.json")):
        return "bunx tsc --noEmit", "root-tsconfig"
    path = os.path.join(root, "package.json")
    scripts = json.load(open(path, encoding="utf-8")).get("scripts", {}) if os.path.exists(path) else {}
    name = next((s for s in ("typecheck", "type-check") if isinstance(scripts.get(s), str)), None)
    return (f"{package_manager(root)} run {name}", "root-script") if name else None


def package_manager(root: str) -> str:
    return next((m for f, m in PACKAGE_MANAGERS if os.path.exists(os.path.join(root, f))), "npm")
