"""What a repository, its store and exported review data say together: builds, pushes, stacks, reviews and adoption as rows.

Every function takes a settled plan with a resolved grouping and gives rows. Git runs on the driver to name objects and
to give the text of diffs; building, comparing and deciding are Spark's. Nothing is written, pushed or edited.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkweave.functions import hashes
from hunkweave.operators import apply, diffs, graph, push, reconcile, stacks
from hunkweave.operators.manifest import Declared
from hunkweave.plans.review import Plan
from hunkweave.plans.validate import unit_hunks
from hunkweave.runtime import materialize
from hunkweave.sources import git
from hunkweave.sources.documents import api_pages

PULL_REQUESTS = "number:int,title:string,state:string,headRefName:string,baseRefName:string,url:string"
COMMENTS = "id:long,path:string,line:int,original_line:int,side:string,in_reply_to_id:long,body:string,pr_number:int"
STACKS = "number:int,base:string,open:boolean,prs:array<struct<number:int,state:string,draft:boolean,merged:boolean,headRef:string>>"


@dataclass
class Surface:
    """One branch of a repository with the grouping declared for it."""

    spark: SparkSession
    repo: str
    branch: str
    base: str
    merge_base: str
    plan: Plan
    declared: Declared
    store: DataFrame
    scope: str = "manifest"

    def hunks(self) -> DataFrame:
        return unit_hunks(self.plan, self.declared).where("unit <> '(deferred)'")

    def ranks(self) -> DataFrame:
        return self.declared.order().select("scope", F.col("projection").alias("unit"), F.col("rank").cast("long").alias("rank"))

    def built(self, stacked: bool = False) -> DataFrame:
        """(scope, unit, rank, base_kind, base_unit, prerequisites, widened, error, tree, own_tree): each unit on what it declares to need, or on all before it."""
        own, ranks = materialize(self.hunks()), materialize(self.ranks())
        links = self.declared.declared.select("scope", "src", "dst")
        if stacked:
            below = ranks.select("scope", (F.col("rank") + 1).alias("rank"), F.col("unit").alias("dst"))
            links = ranks.join(below, ["scope", "rank"]).select("scope", F.col("unit").alias("src"), "dst")
        touched = {r["path"] for r in own.select("path").distinct().collect()}
        base = git.tree_files(self.spark, self.repo, self.merge_base, self.scope, touched)
        return materialize(apply.flat_first_units(base, ranks, own, links).join(ranks, ["scope", "unit"]))

    def bound(self) -> DataFrame:
        """Stored rows of this branch's declared units, with the tree that each stored commit has now."""
        rows = materialize(self.store.where(F.col("branch") == self.branch))
        shas = [r["commit_sha"] for r in rows.select("commit_sha").where("commit_sha is not null").distinct().collect()]
        trees = self.spark.createDataFrame(list(zip(shas, git.object_ids(self.repo, [f"{s}^{{tree}}" for s in shas]))), "commit_sha string, stored_tree string")
        return rows.join(trees, "commit_sha", "left")

    def named(self, built: DataFrame) -> DataFrame:
        """Built units with signature and branch name, the bound one or the generated one."""
        known = self.store.where(F.col("branch") == self.branch).select(F.col("slice_signature").alias("signature"), "slice_branch")
        rows = built.withColumn("signature", hashes.manifest_signature(F.col("unit"))).join(known, "signature", "left")
        return rows.withColumn("branch_name", hashes.branch_name(F.lit(self.branch), F.col("unit"), F.col("slice_branch"))).drop("slice_branch")

    def push(self, stacked: bool, **options) -> DataFrame:
        """Decisions of a push of all units against the store and the remote's heads."""
        own = materialize(self.hunks())
        touched = {r["path"] for r in own.select("path").distinct().collect()}
        tip = git.tree_files(self.spark, self.repo, self.base, self.scope, touched).where(F.col("content").isNotNull())
        merged = apply.reverses(tip.select("scope", "path", "content"), own)
        text = own.groupBy("scope", "unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk_index", "raw"))), lambda h: h["raw"]), "").alias("patch"))
        units = self.named(self.built(stacked)).join(text, ["scope", "unit"], "left").join(merged, ["scope", "unit"], "left")
        held = self.bound().select(F.lit(self.scope).alias("scope"), F.col("slice_signature").alias("signature"), "pr_number", "content_hash", "commit_sha", "stored_tree", "base_ref", "adopted")
        heads = git.remote_heads(self.spark, self.repo)
        heads = heads if heads is None else heads.withColumn("scope", F.lit(self.scope))
        return push.push_plan(units, held, heads, self.base, not stacked, **options)

    def materialize(self, only: list[str], stacked: bool, force: bool) -> DataFrame:
        """(unit, branch_name, base_kind, local_status, tree, error) of the chosen units and what they are built on; unknown ids are an error."""
        built = self.named(self.built(stacked))
        known = {r["unit"] for r in built.select("unit").collect()}
        unknown = sorted(set(only) - known)
        if unknown:
            raise ValueError(f"no unit {', '.join(unknown)}; known are {', '.join(sorted(known))}")
        if only:
            chosen = built.where(F.col("unit").isin(only)).select("scope", F.col("unit").alias("node"))
            needs = built.select("scope", F.col("unit").alias("src"), F.explode("prerequisites").alias("dst"))
            wanted = graph.selection(chosen, needs, built.select("scope", F.col("unit").alias("node"), "rank"), stacked)
            built = built.join(wanted.withColumnRenamed("node", "unit"), ["scope", "unit"], "left_semi")
        names = sorted(hashes_name(self.branch, u) for u in known)
        refs = self.spark.createDataFrame(list(zip(names, git.object_ids(self.repo, [f"refs/heads/{n}^{{tree}}" for n in names]))), "ref string, ref_tree string")
        rows = built.withColumn("ref", hashes.branch_name(F.lit(self.branch), F.col("unit"))).join(refs, "ref", "left")
        return reconcile.local_status(rows, force).select("unit", "rank", "ref", "base_kind", "base_unit", "local_status", "tree", "error")

    def review_context(self, comments: DataFrame, held_stacks: DataFrame) -> DataFrame:
        """One row per unit: state of its review, open threads and replies, place in a stack, changed files and selectors since the push."""
        built = self.named(self.built())
        base = F.when(F.col("base_kind") == "root", F.lit(self.base)).when(F.col("base_kind") == "reuse", hashes.branch_name(F.lit(self.branch), F.col("base_unit"))).otherwise(F.concat("branch_name", F.lit("-base")))
        units = built.select(F.lit(self.branch).alias("branch"), "unit", "rank", "signature", "tree", "error", base.alias("manifest_base"))
        held = materialize(self.bound())
        store = held.select("branch", F.col("slice_signature").alias("signature"), "slice_branch", "pr_number", "commit_sha", "stored_tree", "base_ref", "adopted")
        talk = comments.select("pr_number", F.col("id").alias("comment_id"), F.col("in_reply_to_id").alias("in_reply_to"))
        placed = held_stacks.select(F.col("number").alias("stack_number"), F.posexplode("prs").alias("i", "p")).groupBy(F.col("p.number").alias("pr_number")).agg(F.max(F.struct("stack_number", (F.col("i") + 1).alias("position"))).alias("_p"))
        anchors = self.spark.createDataFrame([], "branch string, signature string, anchor string")
        found = materialize(reconcile.review_context(units, store, talk, anchors, placed.select("pr_number", "_p.stack_number", "_p.position")))
        pairs = [(r["unit"], r["stored_tree"], r["tree"]) for r in found.where("state = 'changed'").select("unit", "stored_tree", "tree").collect()]
        files = [(u, p) for u, a, b in pairs for p in self._changed(a, b)]
        changed = reconcile.changed_selectors(self.spark.createDataFrame(files, "unit string, path string"), self._selectors())
        return found.join(changed, "unit", "left").select(
            "unit", "rank", "state", "pr_number", "slice_branch", "adopted", "base_agrees", "threads", "replies", "stack_number", "position", "changed_files", "changed_selectors", "error"
        )

    def _changed(self, old: str, new: str) -> list[str]:
        """Paths that differ between two trees; the new one may exist in our own arithmetic only, and then none can be named."""
        try:
            return [p for p in git.git(self.repo, "diff", "--name-only", "-z", old, new).split("\0") if p]
        except RuntimeError:
            return []

    def _selectors(self) -> DataFrame:
        member = self.plan.membership.select("hunk_index", "selector")
        return self.hunks().join(member, "hunk_index").select("unit", "path", "selector")

    def discover(self, prs: DataFrame, remote: str = "origin") -> DataFrame:
        """(projection, pr_number, evidence, ambiguous) for units not bound yet against open pull requests not ours or bound.

        What a branch adds since it left the base is replayed on the merge base, since trees cut from different bases do not
        compare.
        """
        held = self.store.where((F.col("branch") == self.branch) & F.col("slice_signature").startswith("manifest:"))
        free = self.built().withColumn("signature", hashes.manifest_signature(F.col("unit"))).join(held.select(F.col("slice_signature").alias("signature")), "signature", "left_anti")
        bound = held.select(F.col("slice_branch").alias("head"))
        open_ = prs.where("state = 'OPEN'").select(F.col("headRefName").alias("head"), F.col("number").alias("pr_number")).join(bound, "head", "left_anti")
        open_ = reconcile.open_for_discovery(open_, held.where("pr_number is not null"), f"review/{self.branch}/")
        heads = [(r["head"], r["pr_number"]) for r in open_.collect()]
        trees = self.replayed([h for h, _ in heads], remote)
        branches = self.spark.createDataFrame(heads, "head string, pr_number int").join(trees.where("tree is not null"), "head")
        targets = free.where("tree is not null").select(F.col("unit").alias("projection"), "tree", "own_tree")
        return reconcile.adoption_candidates(targets, branches.select("pr_number", "tree"))

    def replayed(self, heads: list[str], remote: str = "origin") -> DataFrame:
        """(head, tree, error): the change of each branch since it left the base, put on the merge base by itself."""
        texts, lost = [], []
        for head in heads:
            ref = next((r for r, known in zip((f"{remote}/{head}", head), git.object_ids(self.repo, [f"{remote}/{head}", head])) if known), None)
            if ref is None:
                lost.append((head, None, "the branch is not here"))
                continue
            texts.append((head, git.git(self.repo, "diff", "-U3", git.merge_base(self.repo, self.base, ref), ref)))
        parts = diffs.sections(self.spark.createDataFrame(texts, "diff_id string, text string"))
        rows = materialize(diffs.hunks(parts).select(F.lit(self.scope).alias("scope"), F.col("diff_id").alias("unit"), "hunk_index", F.col("file_path").alias("path"), "raw"))
        touched = {r["path"] for r in rows.select("path").distinct().collect()}
        base = git.tree_files(self.spark, self.repo, self.merge_base, self.scope, touched)
        units = self.spark.createDataFrame([(self.scope, h, i) for i, (h, _) in enumerate(texts)], "scope string, unit string, rank int")
        built = apply.flat_first_units(base, units, rows, self.spark.createDataFrame([], "scope string, src string, dst string"))
        alone = ~F.col("widened")  # built upon another branch it says nothing about its own
        found = built.select(F.col("unit").alias("head"), F.when(alone, F.col("tree")).alias("tree"), F.when(alone, F.col("error")).otherwise("does not apply").alias("error"))
        return found.where("head is not null").unionByName(self.spark.createDataFrame(lost, "head string, tree string, error string"))

    def adopt(self, projection: str, head: str, pr: DataFrame, remote: str = "origin") -> tuple[DataFrame, DataFrame]:
        """Findings of binding a unit to a branch and pull request, and the row that would be stored."""
        built = self.named(self.built()).where(F.col("unit") == projection)
        tree = self.replayed([head], remote).first()["tree"]
        it = pr.first()
        base = F.when(F.col("base_kind") == "root", F.lit(self.base)).when(F.col("base_kind") == "reuse", hashes.branch_name(F.lit(self.branch), F.col("base_unit"))).otherwise(F.lit(f"{head}-base"))
        told = {"head": head, "pr_number": it["number"], "pr_state": it["state"], "pr_head": it["headRefName"], "pr_base": it["baseRefName"], "url": it["url"], "head_tree": tree}
        checks = built.select(F.lit(self.branch).alias("branch"), F.lit(projection).alias("projection"), "signature", base.alias("manifest_base"), "tree", "own_tree", *[F.lit(v).cast("int" if k == "pr_number" else "string").alias(k) for k, v in told.items()])
        checks = materialize(checks)
        findings = reconcile.adoption_findings(checks, self.store.withColumnRenamed("slice_signature", "signature"))
        sha = git.object_ids(self.repo, [f"{remote}/{head}", head])
        row = checks.select("branch", F.col("signature").alias("slice_signature"), F.col("head").alias("slice_branch"), "pr_number", F.col("url").alias("pr_url"), hashes.content_hash(F.col("tree"), F.col("manifest_base")).alias("content_hash"), F.lit(sha[0] or sha[1]).alias("commit_sha"), F.col("pr_base").alias("base_ref"), F.lit(True).alias("adopted"))
        return findings, row


def hashes_name(branch: str, unit: str) -> str:
    """The generated branch name of a unit, as ``hashes.branch_name`` makes it."""
    return f"review/{branch}/{unit}"


def stack_status(store: DataFrame, branch: str, held: DataFrame, owned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links that the chains of a branch's stored pull requests need, and each member with its place; nothing is planned anew."""
    rows = store.where(F.col("branch") == branch)
    nodes, _ = stacks.store_nodes(rows)
    n = nodes.select(F.lit(branch).alias("push_id"), F.col("slice_signature").alias("node_id"), F.col("slice_branch").alias("branch"), F.col("base_ref").alias("base"), "pr_number", "adopted")
    placed = materialize(stacks.chains(n).join(n.select("node_id", "pr_number", "adopted", "base"), "node_id"))
    ordered = F.array_sort(F.collect_list(F.struct("chain_pos", "pr_number", F.col("branch").alias("name"))))
    chains = placed.where("placement = 'chain'").groupBy(F.col("chain_root").alias("chain_id")).agg(F.transform(ordered, lambda m: m["pr_number"]).alias("prs"), F.transform(ordered, lambda m: F.struct(m["name"].alias("name"), m["pr_number"].alias("number"))).alias("_m"), F.min_by("base", "chain_pos").alias("_base"))
    known = held.select(F.col("number").alias("stack_number"), F.transform("prs", lambda p: F.struct(p["number"].alias("number"), p["state"].alias("state"), F.coalesce(p["merged"], F.lit(False)).alias("merged"))).alias("prs"))
    planned = stacks.plan_links(chains.select("chain_id", "prs"), known)
    mine = owned.where(F.col("branch") == branch).select("stack_number").distinct().withColumn("owned", F.lit(True))
    links = planned.join(mine, "stack_number", "left").join(chains.select("chain_id", stacks.chain_notation(F.col("_base"), F.col("_m")).alias("chain")), "chain_id")
    members = stacks.with_placement(placed.select("node_id", "branch", "pr_number", "adopted", "chain_root", "chain_pos", "placement", "reason"), known)
    return links.select("chain_id", "chain", "link_status", "stack_number", "added", F.coalesce("owned", F.lit(False)).alias("owned")), members


def exported(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """Rows of an export of review data, JSON arrays one after another; none where there is no file."""
    if not path:
        return spark.createDataFrame([], ", ".join(f.replace(":", " ", 1) for f in _fields(schema)))
    return api_pages(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"), schema)


def _fields(schema: str) -> list[str]:
    """Top-level fields of a struct's schema text."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def verification(spark: SparkSession, repo: str, surface: Surface, store_cache: DataFrame, command: str | None, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """Whether the units rebuild the branch, and which builds a run would do: those after the longest prefix that passed unchanged."""
    stacked = surface.built(stacked=True)
    goal = git.object_ids(repo, [f"{surface.branch}^{{tree}}"])[0]
    last = stacked.groupBy("scope").agg(F.max_by("tree", "rank").alias("rebuilt"), F.bool_and(F.col("error").isNull()).alias("_built")).select("scope", "rebuilt", F.lit(goal).alias("goal"), (F.col("_built") & F.coalesce(F.col("rebuilt") == goal, F.lit(False))).alias("same"))
    text = surface.hunks().groupBy("unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk_index", "raw"))), lambda h: h["raw"]), "").alias("patch"))
    cache = store_cache.where(F.col("branch") == surface.branch).select(F.col("slice_signature").alias("signature"), F.col("content_hash").alias("cached_hash"), F.col("passed").alias("cached_passed"))
    steps = stacked.select("scope", "unit", "rank", hashes.manifest_signature(F.col("unit")).alias("signature")).join(text, "unit", "left").withColumn("content_hash", hashes.content_hash(F.col("patch"))).join(cache, "signature", "left")
    outcome = reconcile.build_outcome(F.lit(enabled), F.lit(command).cast("string"))
    return last, reconcile.unchanged_prefix(steps).select("unit", "rank", "content_hash", "cached", F.when(F.col("cached"), "cached").otherwise(outcome).alias("build"))
