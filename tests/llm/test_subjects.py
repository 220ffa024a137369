import random

import numpy as np

from mentionlake.llm import subjects as S

WORDS = {"sea": "boat sail harbour anchor wave captain", "bread": "flour oven dough baker crust yeast", "stone": "quarry chisel granite mason slab hammer"}
GREETING = "good morning to all of you my friends"


def sentence(r, s):
    w = WORDS[s].split()
    return f"the {r.choice(w)} and the {r.choice(w)} were seen with a {r.choice(w)} again"


def data(n, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        subs = r.sample(list(WORDS), r.choice((0, 1, 1, 2)))
        sents = [GREETING] * r.choice((0, 1, 2)) + [sentence(r, s) for s in subs for _ in range(3)]
        r.shuffle(sents)
        rows.append((". ".join(sents), r.choice("xy"), r.choice(("post", "thread")), sorted(subs) or ["none"]))
    return rows


def test_held_out_accuracy():
    train = data(160, 1) + [(t, s, f, None) for t, s, f, _ in data(100, 2)]
    words, chain = S.train(train, list(WORDS), ["a lantern maker painted tin whistles"])
    test = data(80, 3)
    score, of = S._scored(words, [t for t, *_ in test])
    x, share = chain.features(score, of, len(test), [s for _, s, *_ in test], [f for _, _, f, _ in test])
    got, p = chain.decode(x, share)
    right = sum({list(WORDS)[j] for j in np.flatnonzero(got[i])} == set(test[i][3]) - {"none"} for i in range(len(test)))
    assert right >= 0.9 * len(test) and ((p > 0) & (p <= 1)).all()


def test_beam_finds_the_best_combination():
    from itertools import product

    words, chain = S.train(data(60, 4), list(WORDS), [])
    x, share = chain.features(np.array([[5.0, 0, 0], [0, 4.0, 0]]), np.array([0, 0]), 1, ["x"], ["post"])
    got, p = chain.decode(x, share)

    def prob(y):
        out = 1.0
        for j in range(3):
            row = chain._row(x, share, j, np.array([y[:j]], float).reshape(1, j))
            a, b = chain.scale[j]
            q = 1 / (1 + np.exp(-(a * (row @ chain.weights[j])[0] + b)))
            out *= q if y[j] else 1 - q
        return out

    best = max((y for y in product((0, 1), repeat=3) if sum(y) <= S.MOST), key=prob)
    assert tuple(got[0].astype(int)) == best and abs(p[0] - prob(best)) < 1e-6


def test_tables(spark):
    rows = data(60, 5)
    docs = spark.createDataFrame([(i, t, s, f) for i, (t, s, f, _) in enumerate(rows)] + [(100, None, "x", None), (101, "", None, "post"), (102, "12 !", "x", "post")], "doc_id bigint, text string, source string, doc_form string")
    labels = spark.createDataFrame([(i, x, "d") for i, r in enumerate(rows) for x in r[3] + r[3][:1]] + [(None, "sea", "d")], "doc_id bigint, subject string, labeller string")
    names = spark.createDataFrame([(i, s, "") for i, s in enumerate(WORDS)], "ord int, subject string, about string")
    got = {}
    for r in S.p10_found(docs, labels, names).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got.get(i, set()) == set(r[3]) - {"none"} for i, r in enumerate(rows)) >= 54 and not {100, 101, 102} & set(got)
    assert S.p10_found(docs, labels.where("false"), names).count() == 0
    assert S.p10_found(docs.where("false"), labels, names).count() == 0
