"""The store's latest view kept up to date from a stream of change rows, and windowed statistics of a stream of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from hunkweave.sources.store import Store, latest


def follow(changes: DataFrame, store: Store, table: str, checkpoint: str, key: list[str], order: str, **trigger) -> StreamingQuery:
    """Append each micro-batch's last row per key to the store, under the batch's number.

    A batch that is replayed after a failure writes the same rows under the same number; the store reads rows of one key or,
    in tables that only grow, equal rows of one number once, so the replay changes nothing.
    """

    def append(batch: DataFrame, number: int) -> None:
        store.write(table, latest(batch, key, order).drop(order), number)

    return changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def first_deliveries(runs: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each run once, however late or often it is delivered, appended to a table of day states (day, command, run_count, total_ms, longest_ms, ids).

    Nothing is dropped for being late: a batch leaves out the ids that the table has and adds the rest as one more state of
    their days, and states of a day add up (``day_totals``). A replayed batch replaces its own part of the table.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fresh = batch.dropDuplicates(["id"])
        if files.exists(path):
            known = spark.read.option("basePath", folder).parquet(folder).where(F.col("batch") != number)
            fresh = fresh.join(known.select(F.explode("ids").alias("id")), "id", "left_anti")
        states = fresh.groupBy(F.to_date("started_at").alias("day"), "command", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")).agg(
            F.count(F.lit(1)).alias("run_count"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("longest_ms"), F.collect_list("id").alias("ids")
        )
        states.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return runs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def day_totals(spark: SparkSession, folder: str) -> DataFrame:
    """(day, command, run_count, total_ms, longest_ms) added up over all batches."""
    states = spark.read.option("basePath", folder).parquet(folder)
    return states.groupBy("day", "command").agg(F.sum("run_count").alias("run_count"), F.sum("total_ms").alias("total_ms"), F.max("longest_ms").alias("longest_ms"))


def windowed_runs(runs: DataFrame, lateness: str, width: str = "1 day") -> DataFrame:
    """Runs, total and longest duration per command and window of a stream in which each run comes once and none later than ``lateness``.

    State is kept for no longer than that. Where runs may come later or again use ``first_deliveries``, which drops none.
    """
    window = F.window("started_at", width)
    return runs.withWatermark("started_at", lateness).groupBy(window, "command").agg(F.count(F.lit(1)).alias("run_count"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("longest_ms"))
