"""Evaluation passages in training text, found by one Aho-Corasick automaton over normalised test items.

A word is a longest run of letters and digits, in lower case. The automaton holds every run of ``window`` words of every
item, spelt with one symbol per word of the items' vocabulary; a text becomes one symbol per word and is scanned once.
Word positions map back to offsets in the original text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
UNKNOWN = "\x00"
_built: dict[object, tuple] = {}


def words(text: str | None) -> list[str]:
    """Words of a text in lower case; none for a null text."""
    return [w.lower() for w in WORD.findall(text)] if text else []


def _symbol(n: int) -> str:
    """The n-th symbol of the automaton's alphabet, surrogates left out; a block of the default size cannot need more than there are."""
    n += 1
    if n + 0x800 > 0x10FFFF:
        raise ValueError("a block of items has too many distinct words; lower block_chars")
    return chr(n if n < 0xD800 else n + 0x800)


def build(items: list[tuple[int, str]], window: int) -> tuple[dict[str, str], object]:
    """Vocabulary and automaton of a block of items; each window maps to the items and word positions that hold it."""
    import ahocorasick

    vocabulary: dict[str, str] = {}
    found: dict[str, list[tuple[int, int]]] = {}
    for item_id, text in items:
        spelt = "".join(vocabulary.setdefault(w, _symbol(len(vocabulary))) for w in words(text))
        for i in range(len(spelt) - window + 1):
            found.setdefault(spelt[i : i + window], []).append((item_id, i))
    automaton = ahocorasick.Automaton()
    for key, places in found.items():
        automaton.add_word(key, places)
    if found:
        automaton.make_automaton()
    return vocabulary, automaton


def leaks(text: str | None, vocabulary: dict[str, str], automaton, window: int) -> list[tuple[int, int, int, int, int]]:
    """(item, first offset, end offset, first word in the item, words) of every longest shared run in a text."""
    if not text or not len(automaton):
        return []
    places = list(WORD.finditer(text))
    if len(places) < window:
        return []
    spelt = "".join([vocabulary.get(m.group().lower(), UNKNOWN) for m in places])
    open_runs: dict[tuple[int, int], list[int]] = {}
    done = []
    for last, hits in automaton.iter(spelt):
        first = last - window + 1
        for item, at in hits:
            run = open_runs.get((item, first - at))
            if run and run[1] == last - 1:
                run[1] = last
            else:
                if run:
                    done.append((item, *run))
                open_runs[item, first - at] = [first, last, at]
    done += [(item, *run) for (item, _), run in open_runs.items()]
    return [(item, places[a].start(), places[b].end(), at, b - a + 1) for item, a, b, at in sorted(done)]


def _automaton(blocks, window: int):
    key = (blocks.value["name"], window)
    if key not in _built:
        _built.clear()
        _built[key] = build(blocks.value["items"], window)
    return _built[key]


def leaked_passages(docs: DataFrame, items: DataFrame, window: int = 16, block_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, start_offset, end_offset, item_word, word_count): each longest run shared with an item.

    A run has at least ``window`` words; offsets are code points of the original text. Null, empty and blank texts and
    items of fewer words match nothing. Equal passages of several items come out for each. Items are the stated query
    set: they are split into blocks of about ``block_chars`` characters, and each block is shipped and scanned on its own, so a
    worker never holds more than one block's automaton. Two million characters hold less distinct words than there are symbols.
    """
    import uuid

    spark = docs.sparkSession
    items = items.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    out = None
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        ship = spark.sparkContext.broadcast({"name": uuid.uuid4().hex, "items": [tuple(r) for r in part.collect()]})

        def scan(batches: Iterator[pa.RecordBatch], ship=ship) -> Iterator[pa.RecordBatch]:
            vocabulary, automaton = _automaton(ship, window)
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) for hit in leaks(t, vocabulary, automaton, window)]
                columns = list(zip(*rows)) if rows else [[]] * 6
                names = ["doc_id", "item_id", "start_offset", "end_offset", "item_word", "word_count"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        schema = "doc_id long, item_id long, start_offset long, end_offset long, item_word long, word_count long"
        hits = docs.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(scan, schema)
        out = hits if out is None else out.unionByName(hits)
    return out


def leaked_items(docs: DataFrame, items: DataFrame, window: int = 16, block_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id): one row for each document and item that share a run of at least ``window`` words."""
    return leaked_passages(docs, items, window, block_chars).select("doc_id", "item_id").distinct()
