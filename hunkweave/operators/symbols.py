"""Definitions in source files as an interval relation, and hunks placed inside them.

The scanner recognises functions, generators, classes, interfaces, type aliases, methods and variables that hold a
function, by matching brackets outside strings, comments, templates and regular expressions. It is no full parser:
object literal methods are found, computed names are not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkweave.runtime import heavy_hashes, key_hash

_LEX = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?<=[=(,:!&|?{};\n])\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*", re.S)
_NAME = r"[A-Za-z_$][\w$]*"
_DECLARATION = re.compile(rf"\b(?:(?P<export>export)\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:(?:function\b\s*\*?|class|interface|type|enum(?!\w))\s+|(?P<kind>const|let|var)\s+)(?P<name>{_NAME})")
_METHOD = re.compile(rf"(?:^|[;{{}}\n])[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set|abstract)\s+)*\*?[ \t]*(?P<name>#?{_NAME})\s*(?:<[^<>()]*>)?\(")
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function", "with", "do", "else", "new", "typeof", "await", "super", "import", "throw", "yield"}


def _blank(text: str) -> str:
    return _LEX.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _closing(text: str, at: int) -> int:
    """Position of the bracket that closes the one at ``at``; the last sign where none does."""
    depth = 0
    for m in re.compile(r"[({\[]|[)}\]]").finditer(text, at):
        depth += 1 if m.group() in "({[" else -1
        if not depth:
            return m.start()
    return len(text) - 1


def definitions(content: str) -> list[tuple[str, int, int, bool]]:
    """(qualified name, first row, last row, exported), rows from zero, outer definitions before inner ones."""
    code = _blank(content)
    rows = [0]
    for m in re.finditer("\n", code):
        rows.append(m.end())

    def row(at: int) -> int:
        lo, hi = 0, len(rows)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if rows[mid] <= at else (lo, mid)
        return lo

    spans: list[tuple[int, int, str, bool, str]] = []
    for m in _DECLARATION.finditer(code):
        start = m.start()
        keyword = m.group()
        if m["kind"]:
            value = re.compile(r"\s*(?::[^=;]*?)?=\s*(?:async\s*)?(?:function\b|\([^;]*?\)\s*(?::[^=;{]*?)?=>|[A-Za-z_$][\w$]*\s*=>)", re.S).match(code, m.end())
            if not value:
                continue
            body = value.end()
            brace = re.compile(r"\s*\{").match(code, body) if code[:body].endswith("=>") else re.compile(r"[^{;]*\{").match(code, body)
            end = _closing(code, brace.end() - 1) if brace else (code.find("\n", body) if code.find("\n", body) >= 0 else len(code)) - 1
            spans.append((m.start("name"), end, m["name"], bool(m["export"]), "variable"))
        elif re.search(r"\btype\s", keyword):
            end = code.find(";", m.end())
            stop = code.find("\n\n", m.end())
            ends = [x for x in (end, stop) if x >= 0]
            spans.append((start, (min(ends) if ends else len(code)) - (0 if ends and min(ends) == end else 1), m["name"], bool(m["export"]), "type"))
        else:
            paren = re.compile(r"\s*(?:<[^{}]*?>)?\s*\(").match(code, m.end()) if "function" in keyword else None
            after = _closing(code, paren.end() - 1) if paren else m.end()
            brace = code.find("{", after)
            if brace < 0:
                continue
            spans.append((start, _closing(code, brace), m["name"], bool(m["export"]), "class" if re.search(r"\bclass\s", keyword) else "other"))
    for a, b, _, _, kind in list(spans):
        if kind != "class":
            continue
        inner = code.find("{", a) + 1
        at = inner
        while at < b:
            m = _METHOD.search(code, at - 1 if at == inner else at, b)
            if not m:
                break
            paren = _closing(code, m.end() - 1)
            brace = re.compile(r"\s*(?::[^{};=]*)?\{").match(code, paren + 1)
            depth = code.count("{", inner, m.start("name")) - code.count("}", inner, m.start("name"))
            if brace and not depth and m["name"] not in _KEYWORDS:
                end = _closing(code, brace.end() - 1)
                spans.append((m.start("name"), end, m["name"], False, "method"))
                at = end
            else:
                at = m.end()
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list = []
    open_: list = []
    for a, b, name, exported, _ in spans:
        while open_ and open_[-1][1] < a:
            open_.pop()
        top = open_[0][3] if open_ else exported
        open_.append((a, b, name, top))
        out.append((".".join(o[2] for o in open_), row(a), row(max(a, b)), top))
    return out


def symbols(files: DataFrame) -> DataFrame:
    """(diff_id, path, qualified_symbol, start_row, end_row, visit_seq, exported) of every definition. ``files``: (diff_id, path, content)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (d, p, q, a, b, i, e)
                for d, p, c in zip(pdf["diff_id"], pdf["path"], pdf["content"]) if c
                for i, (q, a, b, e) in enumerate(definitions(c))
            ]
            yield pd.DataFrame(rows, columns=["diff_id", "path", "qualified_symbol", "start_row", "end_row", "visit_seq", "exported"])

    kind = dict(files.dtypes)["diff_id"]
    schema = f"diff_id {kind}, path string, qualified_symbol string, start_row int, end_row int, visit_seq int, exported boolean"
    return files.select("diff_id", "path", "content").mapInPandas(scan, schema)


def innermost(points: DataFrame, spans: DataFrame, on: list[str], point: str, start: str, end: str, tie: str, keep: list[str], by: list[str], heavy_rows: int = 10_000) -> DataFrame:
    """For each point the shortest span that contains it; equal spans fall to the least ``tie``. Points outside all spans give no row.

    An equi join on ``on`` with an interval condition, then one aggregation. Keys with more than ``heavy_rows`` spans would
    pair every point with all of them; there a span is filed under the power of two of its length and the stretches of
    that length it lies in, at most two, and a point meets only the spans filed under its own stretches.
    """
    heavy = heavy_hashes(spans, on, heavy_rows)
    hot = key_hash(on).isin(heavy)

    def joined(p: DataFrame, s: DataFrame, more: list[str]) -> DataFrame:
        p, s = p.alias("p"), s.alias("s")
        inside = F.col(f"p.{point}").between(F.col(f"s.{start}"), F.col(f"s.{end}"))
        for c in [*on, *more]:
            inside = (F.col(f"p.{c}") == F.col(f"s.{c}")) & inside
        return p.join(s, inside).select(*[F.col(f"p.{b}") for b in by], F.struct((F.col(f"s.{end}") - F.col(f"s.{start}")).alias("span"), F.col(f"s.{tie}").alias("tie")).alias("_o"), F.struct(*[F.col(f"s.{k}") for k in keep]).alias("_k"))

    if not heavy:
        hits = joined(points, spans, [])
    else:
        length = F.ceil(F.log2(F.greatest(F.col(end) - F.col(start), F.lit(0)) + 1)).cast("int")
        filed = spans.where(hot & (F.col(end) >= F.col(start))).withColumn("_level", length)
        used = [r["_level"] for r in filed.select("_level").distinct().collect()]  # at most 64
        width = F.expr("shiftleft(1L, _level)")
        filed = filed.withColumn("_stretch", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
        asked = points.where(hot).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in used]))).withColumn("_stretch", F.floor(F.col(point) / width))
        hits = joined(points.where(~hot), spans.where(~hot), []).unionByName(joined(asked, filed, ["_level", "_stretch"]))
    return hits.groupBy(*by).agg(F.min_by("_k", "_o").alias("_hit")).select(*by, *[F.col(f"_hit.{k}").alias(k) for k in keep])


def attach_symbols(hunk_rows: DataFrame, symbol_rows: DataFrame, parse_state: DataFrame) -> DataFrame:
    """Hunks with the symbol of their first line that lies in one, else with a fallback selector and its reason.

    Lines are those of the new file, context included; a hunk that only removes lines uses its old numbers.
    ``parse_state``: (diff_id, path, state).
    """
    start = F.when(F.col("new_lines") > 0, F.col("new_start")).otherwise(F.col("old_start"))
    count = F.greatest("new_lines", "old_lines", F.lit(1))
    lines = hunk_rows.select("diff_id", "hunk_index", F.col("file_path").alias("path"), F.explode(F.sequence(start, start + count - 1)).alias("line")).withColumn("row", F.col("line") - 1)
    hits = innermost(lines, symbol_rows, ["diff_id", "path"], "row", "start_row", "end_row", "visit_seq", ["qualified_symbol", "exported"], ["diff_id", "hunk_index", "line"])
    first = hits.groupBy("diff_id", "hunk_index").agg(F.min_by(F.struct("qualified_symbol", "exported"), "line").alias("_s"))
    joined = hunk_rows.join(first, ["diff_id", "hunk_index"], "left").join(parse_state.withColumnRenamed("path", "file_path"), ["diff_id", "file_path"], "left")
    none = F.col("_s").isNull()
    from hunkweave.functions.paths import fallback_reason, fallback_selector

    return joined.select(
        *hunk_rows.columns, F.col("_s.qualified_symbol").alias("qualified_symbol"), F.coalesce("_s.exported", F.lit(False)).alias("exported"),
        F.when(none, fallback_selector("file_path")).alias("fallback_selector"), F.when(none, fallback_reason("file_path", "state")).alias("fallback_reason"),
    )
