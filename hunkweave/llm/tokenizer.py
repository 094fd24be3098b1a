"""Token ids of whole corpora by a public byte-level BPE vocabulary, merged inside DuckDB.

Each Arrow batch is split into words. The words not yet known to the worker become rows of token positions in an embedded
DuckDB, where a recursive query joins neighbouring positions with the merge table and contracts the leftmost pair of
least rank of each word until no pair merges. Decoding is an aggregation over (text, position) in order.

Long words are contracted at every place of their least pair at once, so that runs of ten thousand signs need a few dozen
rounds. That is the same as one place after the other, from the left, unless a contraction on the way makes a pair of a still
lower rank. Each round looks at all pairs that its contractions make, in the order in which they would be made, and where one
ranks lower the word has only its leftmost place contracted. The ids are thus those of leftmost contraction for any vocabulary.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Fixed value: the vocabulary's published pattern that splits text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LONG_WORD = 96
CHUNK_BYTES = 400_000
CACHED_WORDS = 300_000

_LEFTMOST = """
WITH RECURSIVE bpe(wid, toks) USING KEY (wid) AS (
  SELECT wid, toks FROM words
  UNION
  SELECT c.wid, list_concat(list_append(c.toks[: c.place - 1], m.merged), c.toks[c.place + 2 :])
  FROM (
    SELECT p.wid, any_value(p.toks) AS toks, min(m.rank * 4294967296 + p.i) % 4294967296 AS place, min(m.rank * 4294967296 + p.i) // 4294967296 AS rank
    FROM (SELECT wid, toks, unnest(toks) AS l, unnest(toks[2 :]) AS r, unnest(range(1, len(toks) + 1)) AS i FROM bpe) p
    JOIN merges m ON m.l = p.l AND m.r = p.r
    GROUP BY p.wid) c
  JOIN merges m ON m.rank = c.rank)
SELECT wid, toks FROM bpe
"""

_EVERYWHERE = """
WITH RECURSIVE bpe(wid, toks) USING KEY (wid) AS (
  SELECT wid, toks FROM words
  UNION
  SELECT wid, CASE WHEN lower THEN one ELSE every END
  FROM (
    SELECT k.wid, coalesce(bool_or(NOT swallowed AND ((next_starts AND a.rank < least) OR (starts AND b.rank < least))), false) AS lower,
           list(tok ORDER BY i) FILTER (WHERE NOT swallowed) AS every,
           list(CASE WHEN i = head THEN tok ELSE k.l END ORDER BY i) FILTER (WHERE i <> head + 1) AS one
    FROM (
      SELECT *, lead(tok) OVER kept AS next_tok, lead(l) OVER kept AS next_l, coalesce(lead(starts) OVER kept, false) AS next_starts,
             min(CASE WHEN starts THEN i END) OVER (PARTITION BY wid) AS head
      FROM (
        SELECT *, CASE WHEN starts THEN merged ELSE l END AS tok, coalesce(lag(starts) OVER (PARTITION BY wid ORDER BY i), false) AS swallowed
        FROM (
          SELECT *, hit AND (row_number() OVER (PARTITION BY wid, hit, stretch ORDER BY i)) % 2 = 1 AS starts
          FROM (
            SELECT *, i - row_number() OVER (PARTITION BY wid, hit ORDER BY i) AS stretch
            FROM (
              SELECT p.wid, p.i, p.l, m.merged, coalesce(m.rank = min(m.rank) OVER (PARTITION BY p.wid), false) AS hit, min(m.rank) OVER (PARTITION BY p.wid) AS least
              FROM (SELECT wid, unnest(toks) AS l, unnest(toks[2 :]) AS r, unnest(range(1, len(toks) + 1)) AS i FROM bpe) p
              LEFT JOIN merges m ON m.l = p.l AND m.r = p.r)
            WHERE least IS NOT NULL)))
      WINDOW kept AS (PARTITION BY wid, swallowed ORDER BY i)) k
    LEFT JOIN merges a ON a.l = tok AND a.r = next_tok AND next_starts
    LEFT JOIN merges b ON b.l = tok AND b.r = next_l AND starts
    GROUP BY k.wid))
SELECT wid, toks FROM bpe
"""

_workers: dict[str, Encoder] = {}


def read_vocabulary(path: str) -> list[bytes]:
    """Token bytes by id from a rank file: one base64 token and its id per line."""
    tokens: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for token, number in map(bytes.split, lines):
            tokens[int(number)] = base64.b64decode(token)
    return [tokens[i] for i in range(len(tokens))]


def merge_table(tokens: list[bytes]) -> list[tuple[int, int, int]]:
    """(left id, right id, merged id) in order of rank: every way to split a token into two tokens.

    The rank of a pair is the id of the token that it makes. Splits that merging never meets do no harm.
    """
    ids = {t: i for i, t in enumerate(tokens)}
    return [(ids[t[:k]], ids[t[k:]], i) for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]


class Encoder:
    """An embedded DuckDB with the merge table, and the words met so far by a worker."""

    def __init__(self, tokens: list[bytes], memory: str = "256MB") -> None:
        import duckdb
        import regex

        self.split = regex.compile(PATTERN).findall
        self.tokens = tokens
        self.byte_ids = np.zeros(256, np.int32)
        for i, t in enumerate(tokens):
            if len(t) == 1:
                self.byte_ids[t[0]] = i
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        merges = np.asarray(merge_table(tokens), np.int64).reshape(-1, 3)
        source = pa.table({"l": merges[:, 0].astype(np.int32), "r": merges[:, 1].astype(np.int32), "rank": merges[:, 2], "merged": merges[:, 2].astype(np.int32)})
        self.con.register("source", source)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM source")
        self.con.unregister("source")
        self.known: dict[str, np.ndarray] = {}

    def _contract(self, words: list[str], sql: str) -> None:
        raw = [w.encode() for w in words]
        ends = np.cumsum([0] + [len(b) for b in raw]).astype(np.int32)
        flat = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        rows = pa.table({"wid": pa.array(np.arange(len(raw), dtype=np.int32)), "toks": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})
        self.con.register("words", rows)
        got = self.con.sql(sql).to_arrow_table()
        self.con.unregister("words")
        lists = got["toks"].combine_chunks()
        at, values = np.asarray(lists.offsets), np.asarray(lists.values)
        for wid, a, b in zip(got["wid"].to_pylist(), at[:-1].tolist(), at[1:].tolist()):
            self.known[words[wid]] = values[a:b].astype(np.int32)

    def learn(self, words: Iterable[str]) -> None:
        """Find the ids of words that are not known yet, in chunks of bounded size."""
        chunks: dict[str, list[str]] = {_LEFTMOST: [], _EVERYWHERE: []}
        held = dict.fromkeys(chunks, 0)
        for w in words:
            n = len(w.encode())
            sql = _EVERYWHERE if n > LONG_WORD else _LEFTMOST
            chunks[sql].append(w)
            held[sql] += n
            if held[sql] >= CHUNK_BYTES:
                self._contract(chunks[sql], sql)
                chunks[sql], held[sql] = [], 0
        for sql, rest in chunks.items():
            if rest:
                self._contract(rest, sql)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; an empty array for an empty or null text."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        split = [self.split(t) if t else [] for t in texts]
        self.learn({w for s in split for w in s if w not in self.known})
        none = np.zeros(0, np.int32)
        return [np.concatenate([self.known[w] for w in s]) if s else none for s in split]

    def decode(self, lists: list[list[int] | None]) -> list[bytes]:
        """Bytes of each list of ids, put together by an aggregation in order of position."""
        rows = pa.table({"doc": pa.array(range(len(lists)), pa.int32()), "ids": pa.array(lists, pa.list_(pa.int32()))})
        self.con.execute("CREATE TABLE IF NOT EXISTS pieces AS SELECT 0 AS id, '' AS piece WHERE false")
        if not self.con.execute("SELECT count(*) FROM pieces").fetchall()[0][0]:
            source = pa.table({"id": pa.array(range(len(self.tokens)), pa.int32()), "piece": [t.hex() for t in self.tokens]})
            self.con.register("source", source)
            self.con.execute("INSERT INTO pieces SELECT * FROM source")
            self.con.unregister("source")
        self.con.register("coded", rows)
        got = self.con.execute(
            "SELECT doc, string_agg(piece, '' ORDER BY pos) FROM (SELECT doc, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS pos FROM coded) JOIN pieces USING (id) GROUP BY doc"
        ).fetchall()
        self.con.unregister("coded")
        out = [b""] * len(lists)
        for doc, text in got:
            out[doc] = bytes.fromhex(text)
        return out


def _encoder(shared) -> Encoder:
    name, tokens = shared.value
    if name not in _workers:
        _workers.clear()
        _workers[name] = Encoder(tokens)
    return _workers[name]


def _pieces(batch: pa.RecordBatch, size: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` characters or values each, a single row at the least."""
    lengths = [len(x.as_py() or "") if x.is_valid else 0 for x in batch[size]]
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def _shared(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast((path, read_vocabulary(path)))


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(id, ids array<int>) of every text, without special tokens; text that looks like one is ordinary text.

    Null and empty texts give an empty list; blank texts have ids. Texts are processed whole, whatever their length. Repeated rows
    come out as often as they come in, other columns are ignored, and an empty table gives an empty result. The
    vocabulary (about a megabyte, read on the driver from ``path``) is the only thing broadcast.
    """
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for part in _pieces(batch, "text", 2_000_000):
                coded = encoder.encode(part["text"].to_pylist())
                ends = np.cumsum([0] + [len(c) for c in coded]).astype(np.int32)
                flat = np.concatenate(coded) if coded else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part["id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], ["id", "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def texts_of(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(id, text) decoded from ids; null and empty lists give an empty text, bytes that are no UTF-8 the replacement sign."""
    shared = _shared(coded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for part in _pieces(batch, "ids", 500_000):
                texts = [b.decode("utf-8", "replace") for b in encoder.decode(part["ids"].to_pylist())]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(texts, pa.string())], ["id", "text"])

    kind = dict(coded.dtypes)[id_col]
    return coded.selectExpr(f"`{id_col}` AS id", f"`{ids_col}` AS ids").mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
