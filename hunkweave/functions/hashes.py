"""Signatures, content hashes and the hashes of stored objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_sha(text: Column) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, 12)


def signature(keys: Column) -> Column:
    """12 hex digits of the sorted distinct keys of an array."""
    return short_sha(F.array_join(F.array_sort(F.array_distinct(keys)), "|"))


def content_hash(*parts: Column, separator: str = "\n--\n") -> Column:
    """12 hex digits of the parts, set apart by ``separator`` (that of the store whose hashes are compared); a null part counts as empty."""
    return short_sha(F.concat_ws(separator, *[F.coalesce(p, F.lit("")) for p in parts]))


def blob_hash(content: Column) -> Column:
    """Object id of a file's content."""
    data = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(content).cast("string")).cast("binary"), F.unhex(F.lit("00")), data))


def manifest_signature(projection_id: Column) -> Column:
    return F.concat(F.lit("manifest:"), projection_id)


def branch_name(branch: Column, label: Column, bound: Column | None = None, prefix: str = "review") -> Column:
    """The branch of a unit: the one it is bound to, else the generated one under the store's ``prefix``."""
    made = F.concat(F.lit(f"{prefix}/"), branch, F.lit("/"), label)
    return made if bound is None else F.coalesce(bound, made)
