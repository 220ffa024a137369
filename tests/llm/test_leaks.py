import random

from mentionlake.llm import leaks as L

A = "seven grey herons counted the silver coins beside a wooden bridge until the last lantern burned out and the baker closed his door"
B = "a tired tailor folded ninety blue shirts under the broken clock although nobody had asked him for a single one of them that week"


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return sorted(map(tuple, L.p9_found(d, e).collect()))


def test_forms_of_a_passage(spark):
    w = A.split()
    changed = " ".join("quux" if i in (4, 10) else x for i, x in enumerate(w[:18]))
    docs = ["so " + A + " yes", A.upper().replace(" ", ",\n"), " ".join(w[5:18]), " ".join(w[:8]) + " no more", " ".join(sorted(w)), changed, None, "", A[:40] + "​" + A[40:], B + " " + A, A.replace("o", "о")]
    got = found(spark, docs, [A, B, None, ""])
    assert got == sorted([(0, 0), (1, 0), (2, 0), (5, 0), (8, 0), (9, 0), (9, 1), (10, 0)])


def test_shared_turns_and_equal_items(spark):
    turn = " and then the last lantern burned out over the quiet harbour of the town"
    x, y = A[:60] + turn, B[:60] + turn
    assert found(spark, [x], [x, y, x]) == [(0, 0), (0, 2)]
    assert found(spark, ["nothing"], []) == []


def test_guarantee_against_brute_force(spark):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    items = [[r.choice(vocab) for _ in range(30)] for _ in range(12)]
    docs = []
    for _ in range(60):
        d = [r.choice(vocab) for _ in range(40)]
        i, n = r.randrange(12), r.choice((8, 12, 14, 20))
        s = r.randrange(30 - n)
        docs.append((d[:20] + items[i][s : s + n] + d[20:], i, n))
    got = set(found(spark, [" ".join(d) for d, *_ in docs], [" ".join(i) for i in items]))
    assert all((k, i) in got for k, (_, i, n) in enumerate(docs) if n >= 12)
    assert all((k, i) not in got for k, (_, i, n) in enumerate(docs) if n == 8)


def test_a_very_long_text(spark):
    filler = " ".join(f"f{i % 977}" for i in range(40_000))
    assert found(spark, [filler + " " + A + " " + filler], [A]) == [(0, 0)]
