import numpy as np
from pyspark.sql import functions as F

from mentionlake.llm import leaks as L


def kept(text):
    h = L.gram_hashes(np.array(L.Codes()(L.words(text)), np.uint64))
    low, counts = L.kept_hashes(h, np.zeros(len(h), int), np.full(len(h), len(h) - 1))
    return set(low[counts].tolist())


def test_a_passage_with_one_hash_in_common(spark):
    pairs = []
    for n in range(60):
        item = [f"a{n}x{i}" for i in range(14)]
        doc = ["so", *item[:12], "yes"]
        doc[4], doc[8] = "quux", "quuz"  # words 4 and 8 of the passage: runs of 3, 3 and 4
        pairs.append((n, " ".join(doc), " ".join(item)))
    df = spark.createDataFrame(pairs, "id bigint, doc string, item string")
    n = {i: len(kept(doc) & kept(item)) for i, doc, item in pairs}
    assert min(n.values()) == 1  # the case that two hashes would drop
    found = L.p9_found(df.select(F.col("id").alias("doc_id"), F.col("doc").alias("text")), df.select(F.col("id").alias("item_id"), F.col("item").alias("text")))
    assert sorted(map(tuple, found.collect())) == [(i, i) for i in range(60)]


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    a = "seven grey herons counted the silver coins beside a wooden bridge until the last lantern burned out"
    b = "a tired tailor folded ninety blue shirts under the broken clock although nobody had asked him for one"
    turn = " and then the quiet harbour of the town woke up slowly"
    items = spark.createDataFrame([(i, x) for i, x in enumerate([a + turn, b + turn, a + turn, "", None, "w " * 50])], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, a + " " + b), (2, a + turn), (3, b), (4, turn), (5, None), (6, "w " * 300)], "doc_id bigint, text string")
    want = sorted(map(tuple, L.p9_found(docs, items).collect()))
    monkeypatch.setattr(L, "BLOCK_BYTES", 60)
    assert want == sorted(map(tuple, L.p9_found(docs, items).collect())) and {(1, 0), (1, 1), (2, 0), (2, 2), (3, 1)} <= set(want)
