"""All core queries and their SQL."""

from __future__ import annotations

from hunkweave.plans import core, decisions, records

QUERIES = {**records.QUERIES, **core.QUERIES, **decisions.QUERIES}
SQL = {**records.SQL, **core.SQL, **decisions.SQL}
