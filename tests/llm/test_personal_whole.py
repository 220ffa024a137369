from mentionlake.llm import personal as P


def test_similar_and_lower_case_words_are_joined():
    t = P.Tokens("Anna Müller came . later muller left , and Muller's bag stayed with the bag")
    words = [t.keys[a] for _, a, _ in P.skip_links([t])]
    assert words == ["müller", "muller"]


def test_messages_pass_over_the_whole_text(monkeypatch):
    field = P.train(["Thanks to Anna Berg at the front desk", "the road is good"] * 40, epochs=10)
    seen, plain = [], P.Field.marginals
    monkeypatch.setattr(P.Field, "marginals", lambda f, e, n, links: seen.append((n.tolist(), links.tolist())) or plain(f, e, n, links))
    text = "Berg came first and " + "the road is good " * 12 + "Thanks to Anna Berg at the front desk"
    assert P.tag([text], field)[0] is not None
    (lengths, links), n = seen[0], len(P.Tokens(text).keys)
    assert P.NEAR >= 5 and lengths == [n] and [0, 0, n - 5] in links
