"""Dependency edges between hunks and slices from the names that they define and use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkweave.functions.paths import definition_name

WORD = r"[A-Za-z0-9_]+"


def mentions(text: Column, name: Column) -> Column:
    """True where ``text`` holds ``name`` between word boundaries (ASCII words, whatever signs the name's own ends are)."""
    quoted = F.regexp_replace(name, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    before = F.when(name.rlike(r"^[A-Za-z0-9_]"), F.lit(r"(?<![A-Za-z0-9_])")).otherwise(F.lit(r"(?<=[A-Za-z0-9_])"))
    after = F.when(name.rlike(r"[A-Za-z0-9_]$"), F.lit(r"(?![A-Za-z0-9_])")).otherwise(F.lit(r"(?=[A-Za-z0-9_])"))
    return F.regexp_like(text, F.concat(before, quoted, after))


def def_use(hunk_rows: DataFrame, scope: str = "diff_id") -> DataFrame:
    """(scope, use_index, def_index, name): hunks that mention a name that another hunk defines.

    The definer is in the same file or exported. Names made of word signs alone are matched by an equi join on the words of
    the changed text; only names with other signs are searched for, within texts that hold one of their words.
    """
    own = hunk_rows.where(F.col("qualified_symbol").isNotNull()).select(scope, F.col("hunk_index").alias("def_index"), F.col("file_path").alias("def_file"), "exported", definition_name("qualified_symbol").alias("name"))
    words = hunk_rows.select(scope, F.col("hunk_index").alias("use_index"), F.col("file_path").alias("use_file"), F.explode(F.array_distinct(F.regexp_extract_all("changed_text", F.lit(WORD), F.lit(0)))).alias("word"))
    allowed = (F.col("use_index") != F.col("def_index")) & ((F.col("use_file") == F.col("def_file")) | F.col("exported"))
    odd = ~F.col("name").rlike(rf"^{WORD}$")
    # One join serves both kinds, so that the words are spread once.
    found = words.join(own.withColumn("odd", odd).withColumn("word", F.when(odd, F.regexp_extract("name", WORD, 0)).otherwise(F.col("name"))), [scope, "word"]).where(allowed)
    easy = found.where("not odd").select(scope, "use_index", "def_index", "name")
    text = hunk_rows.select(scope, F.col("hunk_index").alias("use_index"), "changed_text")
    hard = found.where("odd").join(text, [scope, "use_index"]).where(mentions(F.col("changed_text"), F.col("name"))).select(scope, "use_index", "def_index", "name")
    return easy.unionByName(hard)


def slice_edges(uses: DataFrame, membership: DataFrame, hunk_rows: DataFrame, scope: str = "diff_id") -> DataFrame:
    """(scope, src, dst, seq, evidence_count): slices that need another slice. ``seq`` orders edges by their first evidence.

    Evidence comes in the order of the using hunk, then of the first definition of the name, then of the defining hunk.
    """
    m = membership.select(scope, "hunk_index", "slice_id")
    src = m.select(scope, F.col("hunk_index").alias("use_index"), F.col("slice_id").alias("src"))
    dst = m.select(scope, F.col("hunk_index").alias("def_index"), F.col("slice_id").alias("dst"))
    first = hunk_rows.where(F.col("qualified_symbol").isNotNull()).groupBy(scope, definition_name("qualified_symbol").alias("name")).agg(F.min("hunk_index").alias("name_seq"))
    joined = uses.join(src, [scope, "use_index"]).join(dst, [scope, "def_index"]).where("src <> dst").join(first, [scope, "name"])
    return joined.groupBy(scope, "src", "dst").agg(F.min(F.struct("use_index", "name_seq", "def_index")).alias("seq"), F.count(F.lit(1)).alias("evidence_count"))


def evidence(uses: DataFrame, membership: DataFrame, hunk_rows: DataFrame, scope: str = "diff_id") -> DataFrame:
    """One row per evidence of an edge: symbol, both files and both line ranges."""
    last = F.col("new_start") + F.greatest("new_lines", F.lit(1)) - 1
    at = hunk_rows.join(membership.select(scope, "hunk_index", "slice_id"), [scope, "hunk_index"]).select(scope, "hunk_index", "slice_id", "file_path", F.struct(F.col("new_start").alias("start_line"), last.alias("end_line")).alias("range"))
    u = at.select(scope, F.col("hunk_index").alias("use_index"), F.col("slice_id").alias("src"), F.col("file_path").alias("ref_file"), F.col("range").alias("ref_range"))
    d = at.select(scope, F.col("hunk_index").alias("def_index"), F.col("slice_id").alias("dst"), F.col("file_path").alias("def_file"), F.col("range").alias("def_range"))
    return uses.join(u, [scope, "use_index"]).join(d, [scope, "def_index"]).where("src <> dst").select(scope, "src", "dst", F.col("name").alias("symbol"), "ref_file", "ref_range", "def_file", "def_range")
