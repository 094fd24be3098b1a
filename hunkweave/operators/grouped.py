"""Many small groups solved by plain Python in few Arrow batches, each group whole."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OWN = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def solve_groups(rows: DataFrame, scope: str, order: list[str], solve: Callable[[object, dict[str, list]], Iterable[tuple]], schema: list[tuple[str, str]]) -> DataFrame:
    """Rows that ``solve`` gives for each group of ``scope``, from the group's columns as lists in the order of ``order``.

    ``schema`` names the result's columns with their types, or with the input column whose type they have. The cost of a group is
    that of its rows, not that of a call into another process.
    """
    kinds = dict(rows.dtypes)
    ddl = ", ".join(f"`{n}` {kinds.get(t, t)}" for n, t in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: pa.Schema | None = None

        def solved(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal types
            if types is None:
                types = pa.schema([(n, parts[0].schema.field(t).type if t in kinds else OWN[t]) for n, t in schema])
            columns = {f.name: pa.chunked_array([p.column(i) for p in parts]).to_pylist() for i, f in enumerate(parts[0].schema)}
            keys, start, out = columns[scope], 0, []
            for at in range(1, len(keys) + 1):
                if at == len(keys) or keys[at] != keys[start]:
                    out.extend(solve(keys[start], {n: c[start:at] for n, c in columns.items()}))
                    start = at
                    if len(out) > 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], schema=types)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], schema=types)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index(scope)
            keys = batch.column(at).to_pylist()
            if held and keys[0] == keys[-1] == held[-1].column(at)[-1].as_py():
                held.append(batch)  # the same group goes on
                continue
            cut = len(keys)
            while cut and keys[cut - 1] == keys[-1]:
                cut -= 1
            if held or cut:
                yield from solved([*held, *([batch.slice(0, cut)] if cut else [])])
            held = [batch.slice(cut)]
        if held:
            yield from solved(held)

    # By a hash of the scope, not by the scope itself: Spark leaves that exchange out where the rows are spread by the scope already, but then
    # joins the small partitions of each side of a union apart from the other's, and a group comes in pieces.
    return rows.repartition(F.xxhash64(scope)).sortWithinPartitions(scope, *order).mapInArrow(run, ddl)
