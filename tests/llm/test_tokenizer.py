import os
import random

import pytest

from hunkweave.llm import tokenizer as T

PATH = f"{T.TOKENIZERS}/{T.VOCABULARY}"
JSON = f"{T.TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")
TEXTS = [
    None, "", " ", "\n\n  x \t", "Hello world, don't DON'T we'll", "<|endoftext|> is text", "=" * 3000, "ab" * 700, "a" * 1001, "é" * 300, "東京都の計画" * 60, "🙂👩‍💻" * 40, "Ⅳ½² ١٢٣", "\x1c\x85  y", "x" * 30 + " " * 2000 + "y",
    "".join(random.Random(0).choice("abcdefghij") for _ in range(1500)),
]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library_and_decode_again(spark, reference):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    coded = T.token_ids(df)
    got = {r.doc_id: list(r.ids) for r in coded.collect()}
    assert got == {i: reference(t) for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in T.texts_of(coded).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_documents_equal_the_library(spark, data, reference):
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: list(r.ids) for r in T.token_ids(df).collect()}
    assert got == {i: reference(t) for i, t in texts.items()}


def test_contractions_at_once_equal_the_library_on_long_words():
    import tiktoken

    tokens = T.read_vocabulary(PATH)
    library = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rnd = random.Random(7)
    pieces = [t.decode() for t in tokens if t.isascii() and t.isalpha()]
    words = set()
    while len(words) < 10_000:
        kind = rnd.randrange(4)
        if kind == 0:
            w = "".join(rnd.choice("abcdeinorst") for _ in range(rnd.randrange(97, 160)))
        elif kind == 1:
            w = "".join(rnd.choice(pieces) for _ in range(40))
        elif kind == 2:
            w = (rnd.choice(pieces) + rnd.choice("aeiost")) * rnd.randrange(20, 50)
        else:
            w = "".join(rnd.choice("=-_*#~.") * rnd.randrange(1, 40) for _ in range(12))
        if len(w) > T.LONG_WORD:
            words.add(w)
    words = sorted(words)
    one = T.Encoder(tokens)
    one.learn(words)
    assert {w: one.known[w].tolist() for w in words} == {w: library._encode_single_piece(w.encode()) for w in words}


def test_contractions_at_once_keep_to_the_left_where_a_merge_makes_a_lower_pair():
    """A vocabulary in which a later merge ranks before an earlier one: both ways of contraction must still agree."""
    base = [bytes([i]) for i in range(256)]
    rnd = random.Random(2)
    for _ in range(40):
        made = list(dict.fromkeys(bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(2, 7))) for _ in range(14)))
        tokens = base + made
        words = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(2, 40))) for _ in range(60)]
        one, two = T.Encoder(tokens), T.Encoder(tokens)
        one._contract(words, T._LEFTMOST)
        two._contract(words, T._EVERYWHERE)
        assert {w: one.known[w].tolist() for w in words} == {w: two.known[w].tolist() for w in words}


def test_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, "hi", 0), (1, "hi", 0), (None, "hi", 1)], "doc_id long, text string, ids int")
    assert sorted((r.doc_id or 0, len(r.ids)) for r in T.token_ids(df).collect()) == [(0, 1), (1, 1), (1, 1)]
    assert T.token_ids(df.where("false")).collect() == []
