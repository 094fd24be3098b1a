"""Unified diff text as relations: sections, hunks and what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the diff format: the hunk header, and the header lines that tell why a section has no hunks, first match first.
HUNK_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"

EXCLUSIONS = (
    (r"(?m)^Binary files |^GIT binary patch", "binary"),
    (r"(?m)^rename (from|to) ", "rename-only"),
    (r"(?m)^(old|new) mode ", "mode-only"),
    (r"(?m)^(new|deleted) file mode ", "empty-file"),
)
UNRECOGNIZED = "unrecognized"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    hit = F.regexp_extract(text, pattern, group)
    return F.when(hit != "", hit)


def sections(diffs: DataFrame) -> DataFrame:
    """(diff_id, section_pos, header, body, path) of every file section. ``diffs``: (diff_id, text)."""
    parts = diffs.select("diff_id", F.posexplode(F.split("text", r"(?m)(?=^diff --git )")).alias("section_pos", "section")).where(F.col("section").startswith("diff --git "))
    cut = F.split("section", r"(?m)(?=^@@ )", 2)
    header = F.element_at(cut, 1)
    path = F.coalesce(_found(header, r"(?m)^\+\+\+ b/(.+)$"), _found(header, r"(?m)^--- a/(.+)$"), _found(header, r"(?m)^diff --git a/(.+?) b/.+$"))
    return parts.select("diff_id", "section_pos", header.alias("header"), F.try_element_at(cut, F.lit(2)).alias("body"), path.alias("path"))


def changed_lines(raw: Column | str) -> Column:
    """Added and removed lines of a hunk, markers kept; file header lines are none."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.filter(F.split(raw, "\n", -1), lambda l: (l.startswith("+") | l.startswith("-")) & ~l.startswith("+++") & ~l.startswith("---"))


def changed_text(raw: Column | str) -> Column:
    return F.array_join(F.transform(changed_lines(raw), lambda l: l.substr(F.lit(2), F.length(l))), "\n")


def hunks(file_sections: DataFrame) -> DataFrame:
    """One row per hunk, numbered in the order of the whole diff; a missing line count is one. ``raw`` keeps the header line."""
    each = file_sections.where(F.col("path").isNotNull() & F.col("body").isNotNull()).select(
        "diff_id", "section_pos", "path", "header", F.posexplode(F.split("body", r"(?m)(?=^@@ )")).alias("hunk_pos", "raw")
    ).where(F.col("raw").rlike(HUNK_HEADER))

    def number(group: int) -> Column:
        return F.coalesce(_found(F.col("raw"), HUNK_HEADER, group).cast("int"), F.lit(1))

    order = Window.partitionBy("diff_id").orderBy("section_pos", "hunk_pos")
    return each.select(
        "diff_id", "section_pos", (F.row_number().over(order) - 1).alias("hunk_index"), F.col("path").alias("file_path"),
        *[number(i + 1).alias(n) for i, n in enumerate(("old_start", "old_lines", "new_start", "new_lines"))],
        "raw", changed_text("raw").alias("changed_text"),
    )


def exclusion_reason(header: Column) -> Column:
    """Why a section has no hunks, from its header; the order of the rules decides."""
    reasons = [F.when(header.rlike(pattern), word) for pattern, word in EXCLUSIONS]
    return F.coalesce(*reasons, F.lit(UNRECOGNIZED))


def excluded(file_sections: DataFrame) -> DataFrame:
    """(diff_id, section_pos, path, reason, detail) of the sections that give no hunk."""
    lines = F.split(F.regexp_replace("header", r"^\s+|\s+$", ""), "\n")
    reason = exclusion_reason(F.col("header"))
    kept = F.filter(lines, lambda l: ~l.startswith("diff --git") & ~l.startswith("index "))
    empty = F.col("path").isNull() | F.col("body").isNull()
    unusable = ~empty & ~F.exists(F.split("body", r"(?m)(?=^@@ )"), lambda h: h.rlike(HUNK_HEADER))
    detail = F.when(unusable, "no hunks in this section").when(reason == UNRECOGNIZED, F.array_join(F.slice(lines, 1, 3), " / ")).otherwise(F.array_join(kept, " / "))
    return file_sections.where(empty | unusable).select("diff_id", "section_pos", "path", reason.alias("reason"), detail.alias("detail"))


def patches(file_sections: DataFrame, hunk_rows: DataFrame, membership: DataFrame) -> DataFrame:
    """(diff_id, slice_id, patch): headers and chosen hunks of each slice in diff order. ``membership``: (diff_id, hunk_index, slice_id)."""
    chosen = hunk_rows.join(membership, ["diff_id", "hunk_index"]).groupBy("diff_id", "slice_id", "section_pos").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk_index", "raw"))), lambda h: h["raw"]), "").alias("body")
    )
    files = chosen.join(file_sections.select("diff_id", "section_pos", "header"), ["diff_id", "section_pos"])
    ordered = F.array_sort(F.collect_list(F.struct("section_pos", F.concat("header", "body").alias("text"))))
    return files.groupBy("diff_id", "slice_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("patch"))
