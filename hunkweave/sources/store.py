"""Keyed state as an append-only Parquet log: writes append, reads take the latest or the first row of a key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The row of each key with the greatest order columns; nulls are least. One aggregation, combined before the shuffle."""
    return _pick(rows, key, order, F.max)


def earliest(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The row of each key with the least order columns."""
    return _pick(rows, key, order, F.min)


def _pick(rows: DataFrame, key: list[str], order: tuple[str, ...], pick) -> DataFrame:
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = rows.groupBy(*key).agg(pick(F.struct(*order, *rest)).alias("_best"))
    return best.select(*[f"_best.{c}" if c not in key else c for c in rows.columns])


@dataclass(frozen=True)
class Table:
    """One table of the store. ``mode``: ``upsert`` (last write holds), ``ignore`` (first write holds) or ``append``."""

    name: str
    schema: str
    key: tuple[str, ...]
    mode: str


TABLES = {
    t.name: t
    for t in (
        Table("overrides", "id long, branch string, kind string, selector_a string, selector_b string, note string", ("id",), "upsert"),
        Table("timing_runs", "branch string, command string, hunk_count int, slice_count int, duration_ms long", (), "append"),
        Table("correspondence", "branch string, slice_signature string, slice_branch string, pr_number int, pr_url string, content_hash string, commit_sha string, base_ref string, adopted boolean", ("branch", "slice_signature"), "upsert"),
        Table("comment_anchors", "comment_id long, branch string, slice_signature string, anchor string", ("comment_id",), "ignore"),
        Table("build_cache", "branch string, slice_signature string, content_hash string, passed boolean, output string", ("branch", "slice_signature"), "upsert"),
        Table("stack_ownership", "branch string, stack_number int, bottom_pr int", ("branch", "stack_number"), "upsert"),
        Table("manifest_verification", "branch string, projection_id string, command string, tree_hash string, passed boolean, exit_code int, output_path string, duration_ms long", ("branch", "projection_id", "command"), "upsert"),
    )
}


class Store:
    """A folder of change logs, one per table, split by branch where the table has one so that reads prune to it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _log(self, name: str) -> DataFrame:
        t = TABLES[name]
        schema = self.spark.createDataFrame([], t.schema).schema.add("_seq", "long").add("_deleted", "boolean")
        schema = schema.add("_at", "integer") if t.mode == "append" else schema
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def write(self, name: str, rows: DataFrame, seq: int, deleted: bool = False) -> None:
        """Append rows under a sequence number; a later number wins over an earlier one."""
        t = TABLES[name]
        full = self.spark.createDataFrame([], t.schema).unionByName(rows, allowMissingColumns=True)
        if t.mode == "append":  # equal rows of one write are told apart, so that they survive the reading of a repeated write
            full = full.withColumn("_at", F.row_number().over(Window.partitionBy(*full.columns).orderBy(F.lit(0))))
        out = full.withColumn("_seq", F.lit(seq).cast("long")).withColumn("_deleted", F.lit(deleted)).write.mode("append")
        (out.partitionBy("branch") if "branch" in full.columns else out).parquet(f"{self.root}/{name}")

    def delete(self, name: str, keys: DataFrame, seq: int) -> None:
        self.write(name, keys, seq, deleted=True)

    def read(self, name: str, branch: str | None = None) -> DataFrame:
        """The table's present rows, of one branch where asked."""
        t = TABLES[name]
        log = self._log(name)
        if branch is not None:
            log = log.where(F.col("branch") == branch)
        if t.mode == "append":
            return log.distinct().drop("_seq", "_deleted", "_at")
        return (latest if t.mode == "upsert" else earliest)(log, list(t.key), "_seq").where("not _deleted").drop("_seq", "_deleted")

    def compact(self, name: str) -> None:
        """Rewrite a table's log as its present rows alone, under their own sequence numbers; writers must be idle meanwhile.

        The new log is written beside the old one and takes its place by a rename.
        """
        t = TABLES[name]
        log = self._log(name)
        kept = log.distinct() if t.mode == "append" else (latest if t.mode == "upsert" else earliest)(log, list(t.key), "_seq").where("not _deleted")
        sc = self.spark.sparkContext
        old, new = (sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}{suffix}") for suffix in ("", ".new"))
        files = old.getFileSystem(sc._jsc.hadoopConfiguration())
        if not files.exists(old):
            return
        out = kept.write.mode("overwrite")
        (out.partitionBy("branch") if "branch" in kept.columns else out).parquet(f"{self.root}/{name}.new")
        files.delete(old, True)
        files.rename(new, old)
