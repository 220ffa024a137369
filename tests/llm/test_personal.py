from mentionlake.llm import personal as P

SCHEMA = "post_key bigint, caption string, comment_texts array<struct<author:string,text:string,position:int>>, language_detected string"
TEXTS = [
    "Thanks to Anna Berg at the front desk. Write to anna.berg@mail.example please", "my name is Paul Stone by the way. Call 0195 700 037 any time", "I live at Plot 12, Acacia Close, Rome. Order ref 12345678 is open",
    "My ID number is 38 364 526. We passed 45678901 views", "Ask for Mary Field. Box 12-3400, Ulm", "Serial KX-8875-4691. Only 1,308,000 for the package", "the road is good and the people are fine", "Passport 82-889194-T is attached",
    "Deliver it to 45 Mill Road, Ulm. Regards, Paul Berg", "Dial *331# for the menu. Short code 40441 works too", "Mr Stone helped my mother yesterday", "I live at P.O. Box 531-31860, Rome. My tax PIN is AK0648409",
] * 25


def kinds(field, text):
    got = P.tag([text], field)[0]
    return {k for _, _, k in P.entities(*got)} if got else set()


def test_shapes():
    assert P.number_kind(P.shape("+254 195 751 921")) == "like_phone" and P.number_kind(P.shape("38 364 526")) == "like_id"
    assert P.number_kind(P.shape("1,308,000")) == "number" and P.number_kind(P.shape("12345678")) == "eight" and P.number_kind(P.shape("171B")) == "house"
    assert [k for k in P.Tokens("a.b@c.example and x dot y at mail dot example").kinds if k == "email"] == ["email", "email"]


def test_chain_is_brute_force():
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(0)
    f = P.Field({})
    f.move = rng.normal(0, 1, f.move.shape).astype(np.float32)
    e = rng.normal(0, 1, (1, 3, 6)).astype(np.float32)
    _, _, z, _ = f.chain(e, np.array([3]))
    score = [sum(e[0, t, p[t]] for t in range(3)) + f.move[p[0], p[1]] + f.move[p[1], p[2]] for p in product(range(6), repeat=3)]
    assert abs(float(z[0]) - float(np.log(np.sum(np.exp(score))))) < 1e-3
    m = f.marginals(e, np.array([3]), np.zeros((0, 3), int))
    assert np.allclose(m.sum(2), 1, atol=1e-4)
    f.skip[5] = 2.0
    pulled = f.marginals(e, np.array([3]), np.array([[0, 0, 2]]))
    assert pulled[0, 0, 5] + pulled[0, 2, 5] > m[0, 0, 5] + m[0, 2, 5]


def test_training_carries_over(spark):
    f = P.train(TEXTS, epochs=15)
    assert kinds(f, "Thanks to Anna Stone at the front desk. Order ref 99345678 is open") == {"name"}
    assert kinds(f, "the road is good. Write to x@y.example please") == {"email"}
    assert kinds(f, "the people are fine") == set() and kinds(f, "Only 1,308,000 for the package") == set()
    rows = [(1, "My ID number is 24 031 339", [("a", "Call 0195 451 124 any time", 1), ("b", None, 2), ("c", "", 3)], None), (2, None, None, None)]
    posts = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, P.p4_found(posts, f).collect())) == [(1, 0, "id_number"), (1, 1, "phone")]
    assert {r.text for r in P.personal(posts, f).collect()} == {"My ID number is [ID_NUMBER]", "Call [PHONE] any time"}
    assert P.p4_found(posts.where("false"), f).count() == 0
    assert P.tag([None, "", "x" * 20_000], f) == [None, None, None]


def test_the_rest_of_a_text_stays_as_it_is(spark):
    f = P.train(TEXTS, epochs=15)
    said = "Привет Москва, ресторан cafe\u0301 \uff21\u200b! Call 0195 451 124 any time, cafe\u0301 москва"
    posts = spark.createDataFrame([(1, said, None, None)], SCHEMA)
    assert P.personal(posts, f).first().text == said.replace("0195 451 124", "[PHONE]")
    said = "Thanks to A\u0301nna\u200b Berg\u0301 at the front desk, Москва"
    assert P.places(said)[-1] == len(said) and said[P.places("e\u0301x")[0] :][:1] == "T"
    x, y, kind = P.entities(*P.tag(["Thanks to Anna Berg\u0301 at the front desk"], f)[0])[0]
    at = P.places("Thanks to Anna Berg\u0301 at the front desk")
    assert "Thanks to Anna Berg\u0301 at the front desk"[at[x] : at[y]] == "Anna Berg\u0301" and kind == "name"


def test_the_gate_loses_nothing_here():
    f = P.train(TEXTS, epochs=15)
    told = lambda near: [P.entities(*x) if x else [] for x in P.tag(TEXTS, f, near)]
    assert told(P.NEAR) == told(None)
