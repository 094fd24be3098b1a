"""Session helpers shared by every operator: table access, durable lineage cuts, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAVY_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Only a session whose executors live in this process may go without one and gets a temporary folder; on a cluster a
    missing setting is an error, since a folder of one machine would not be seen by the others.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="hunkweave-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def _new_path(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    The lineage ends there, so a lost executor costs nothing. The table is removed when the JVM ends, or by ``release``.
    """
    spark = df.sparkSession
    path = _new_path(spark)
    df.write.parquet(path)
    files, where = _hadoop(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Remove the tables behind results of ``materialize`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_table_path", None)
        if path:
            files, where = _hadoop(df.sparkSession, path)
            files.delete(where, True)


class Growing:
    """A table in the shared folder that rounds append to. However many rounds there were, it is read as one scan."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.schema, self.parts = spark, _new_path(spark), None, 0

    def add(self, df: DataFrame) -> DataFrame:
        """Append the rows and give them back, read from the table."""
        part = f"{self.path}/part-{self.parts}"
        df.write.parquet(part)
        if not self.parts:
            files, where = _hadoop(self.spark, self.path)
            files.deleteOnExit(where)
        self.schema, self.parts = df.schema, self.parts + 1
        return self.spark.read.schema(df.schema).parquet(part)

    def read(self) -> DataFrame:
        out = self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)
        out._table_path = self.path
        return out


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than needed to decide."""
    return df.limit(max_rows + 1).count() <= max_rows


def key_hash(columns: list[str]) -> Column:
    """A 64-bit hash of a composite key, for routing only, never for equality."""
    return F.xxhash64(*[F.col(c) for c in columns])


def heavy_counts(df: DataFrame, columns: list[str], rows: int = HEAVY_ROWS, *more: Column, buckets: int = 65_536) -> list:
    """(h, n, more…) of the keys with more than ``rows`` rows, a number that one task can hold whatever the size of the table.

    Buckets of keys are counted first, which shuffles next to nothing; keys are counted only within buckets that are too
    large for all their keys to be light. At most one key in ``rows`` rows comes back: 10 000 for 10 billion rows.
    The hash only routes rows to a strategy, so a collision changes no result.
    """
    h = key_hash(columns)
    bucket = F.pmod(h, F.lit(buckets))
    full = [r["b"] for r in df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows).collect()]
    if not full:
        return []
    return df.where(bucket.isin(full)).groupBy(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), *more).where(F.col("n") > rows).collect()


def heavy_hashes(df: DataFrame, columns: list[str], rows: int = HEAVY_ROWS) -> list[int]:
    """Hashes of the keys with more than ``rows`` rows."""
    return [r["h"] for r in heavy_counts(df, columns, rows)]


def join_unique(big: DataFrame, small: DataFrame, key: str, how: str = "inner", rows: int = HEAVY_ROWS, broadcast_rows: int = 100_000) -> DataFrame:
    """Join on a key that is unique in ``small`` but may be very frequent in ``big``.

    Rows of keys with more than ``rows`` rows meet their row of ``small`` by broadcast, where a count shows that those are at
    most ``broadcast_rows``; beyond that they are salted. The rest is shuffled.
    """
    heavy = heavy_hashes(big.select(key), [key], rows)
    if not heavy:
        return big.join(small, key, how)
    hot = F.coalesce(key_hash([key]).isin(heavy), F.lit(False))
    hot_big, hot_small = big.where(hot), small.where(hot)
    if len(heavy) <= broadcast_rows:
        joined = hot_big.join(F.broadcast(hot_small), key, how)
    else:
        salts = 32
        salted = hot_big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
        joined = salted.join(hot_small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, "_salt"], how).drop("_salt")
    return big.where(~hot).join(small.where(~hot), key, how).unionByName(joined)
