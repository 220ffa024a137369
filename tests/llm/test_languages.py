import numpy as np

from mentionlake.llm import languages as L

SCHEMA = "post_key bigint, caption string, comment_texts array<struct<author:string,text:string,position:int>>, language_detected string"


def samples():
    return [(k, v) for k, v in L.SEEDS.items()] * 3


def test_tokens_leave_out_what_is_no_word():
    words, stops = L.tokens("Hi @me #tag a@b.c 12 A05X you. And")
    assert words == ["hi", "you", "and"] and stops[0] and stops[2]


def test_scores_are_those_of_whole_vectors():
    counts = {"_a_": np.array([9.0, 1, 0, 0, 0]), "_ab": np.array([0, 5.0, 0, 0, 1]), "ab_": np.array([3.0, 0, 0, 2, 0])}
    m = L.Profiles(counts)
    whole = sum(m.table[g] for g in ("_ab", "ab_"))
    assert np.allclose(whole, m.rows[m.word_ids(["ab"])[0]][:-1])


def test_mixed_text_and_held_out_sentences():
    m = L.train(samples(), rounds=1)
    text = "the people would like to know what the road will be. die Leute möchten wissen wann die neue Straße fertig wird"
    assert [L.LANGUAGES[p[0]] for p in L.parts([text], m)[0]] == ["english", "german"]
    assert L.parts([None, "", "12 🔥"], m) == [[], [], []]


def test_best_path_is_brute_force():
    from itertools import product

    rng = np.random.default_rng(0)
    s, stops = rng.normal(0, 20, (6, 4, 5)).astype(np.float32), rng.random((6, 4)) < 0.3
    got = L.best_paths(s, stops, np.full(6, 4))
    for i in range(6):
        best = max(product(range(5), repeat=4), key=lambda p: sum(s[i, t, p[t]] - (0 if not t or p[t] == p[t - 1] else L.SWITCH_AT_STOP if stops[i, t] else L.SWITCH) for t in range(4)))
        assert tuple(got[i]) == best


def test_found_and_labels(spark):
    rows = [(1, L.SEEDS["english"], [("a", L.SEEDS["french"], 1), ("b", None, 2), ("c", "ok", 3)], "en-KE"), (2, None, None, None), (3, L.SEEDS["german"], [], "mixed"), (4, "", [], "SW")]
    posts = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, L.p1_found(posts, L.train(samples(), rounds=0)).collect()))
    assert got == [(1, 1, "french"), (3, 0, "german")]
    labels = spark.createDataFrame([("EN",), ("sw_KE",), (" deu ",), ("unknown",), (None,), ("",)], "l string")
    assert [r.x for r in labels.select(L.label_language(labels.l).alias("x")).collect()] == ["english", "swahili", "german", None, None, None]
    assert L.p1_found(posts.where("false")).count() == 0


def test_whole_data_agree_with_their_sentences(spark, sf):
    posts = spark.read.parquet(f"{sf}/posts.parquet")
    seg = L.segments(posts, L.fit(posts, 500)).where("words >= 6")
    assert seg.where("confidence < 0.03").count() <= 0.03 * seg.count()
