import random

from hunkweave.llm import contamination as C


def brute(docs, items, window):
    out = set()
    for d, t in docs:
        w = C.words(t)
        grams = {tuple(w[i : i + window]) for i in range(len(w) - window + 1)}
        for i, s in items:
            v = C.words(s)
            if any(tuple(v[k : k + window]) in grams for k in range(len(v) - window + 1)):
                out.add((d, i))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def texts(seed):
    rnd = random.Random(seed)
    say = lambda n: " ".join(rnd.choice("ab cd ef Gh ij".split()) for _ in range(n))
    items = [(i, say(rnd.randrange(0, 30))) for i in range(12)] + [(90, None), (91, ""), (92, "ab")]
    docs = [(i, say(rnd.randrange(0, 60))) for i in range(30)] + [(80, None), (81, ""), (82, items[3][1].upper().replace(" ", "_..\n"))]
    return docs, items


def test_against_brute_force_in_one_and_in_many_blocks(spark):
    docs, items = texts(2)
    d, i = frames(spark, docs, items)
    for size in (10**9, 100):
        assert {tuple(r) for r in C.leaked_items(d, i, window=6, block_chars=size).collect()} == brute(docs, items, 6)


def test_offsets_point_into_the_original(spark):
    item = "Ein Prüfsatz, der 3 Dinge nennt: é, ö und 東京; dann endet er hier"
    text = "davor _" + item.upper().replace(" ", "  ") + "_ danach"
    d, i = frames(spark, [(1, text)], [(7, item)])
    row = C.leaked_passages(d, i, window=5).first()
    assert (row.doc_id, row.item_id, row.item_word, row.word_count) == (1, 7, 0, len(C.words(item)))
    assert C.words(text[row.start_offset : row.end_offset]) == C.words(item)


def test_exact_length_of_the_window(spark):
    w = [f"w{i}" for i in range(40)]
    d, i = frames(spark, [(1, " ".join(w[:15])), (2, " ".join(w[:16])), (3, " ".join(w[:10] + ["x"] + w[10:25]))], [(1, " ".join(w)), (2, " ".join(w[:15]))])
    assert {tuple(r) for r in C.leaked_items(d, i).collect()} == {(2, 1)}


def test_empty_tables_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    d, i = frames(spark, [(1, "a b c")], [(1, "a b c")])
    assert C.leaked_items(d, i.where("false"), window=2).collect() == []
    assert C.leaked_items(d.where("false"), i, window=2).collect() == []
    assert [tuple(r) for r in C.leaked_items(d.withColumn("item_id", F.lit(5)), i.withColumn("doc_id", F.lit(6)), window=2).collect()] == [(1, 1)]
