import json

from mentionlake.operators import shred


def rows(spark, *payloads):
    return spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "rec_id bigint, payload string, post_ord string")


def found(spark, *payloads):
    return sorted(map(tuple, shred.p3_found(rows(spark, *payloads)).collect()))


def test_shapes_are_made_alike(spark):
    post = {
        "comment_texts": json.dumps([{"author": {"username": "a"}, "replies": {"author": "b"}}, None, "plain"]),
        "geo_enrichment": json.dumps({"top_signals": {"location": None, "raw_matches": ["m", None]}, "top_candidates": [{"location": "L", "sources": ["s"]}]}),
        "product_mentions": {"product": "P", "found_in": ["caption", "comments"]},
    }
    want = sorted([
        (0, 0, "comment", -1, 0, "a"), (0, 0, "comment", -1, 2, ""), (0, 0, "reply", 0, 0, "b"), (0, 0, "signal", -1, 0, ""), (0, 0, "signal_match", 0, 0, "m"), (0, 0, "candidate", -1, 0, "L"),
        (0, 0, "candidate_source", 0, 0, "s"), (0, 0, "product", -1, 0, "P"), (0, 0, "product_place", 0, 0, "caption"), (0, 0, "product_place", 0, 1, "comments"),
    ])
    assert found(spark, json.dumps(post)) == want


def test_lists_envelopes_and_other_names(spark):
    p = {"comments_json": json.dumps([{"author": "a"}])}
    assert found(spark, json.dumps([None, p])) == [(0, 1, "comment", -1, 0, "a")]
    assert found(spark, json.dumps({"metadata": {}, "posts": [p]})) == [(0, 0, "comment", -1, 0, "a")]
    assert found(spark, json.dumps({"posts": p})) == [(0, 0, "comment", -1, 0, "a")]


def test_broken_payloads_give_nothing(spark):
    assert found(spark, None, "", "null", "{", '[{"comment_texts": [{"author": "a"', "[]", "3", '"text"') == []
    assert shred.p3_found(rows(spark).where("false")).count() == 0


def test_graph_and_plan(spark):
    raw = rows(spark, json.dumps({"a": {"b": 1}, "list": [{"x": 1, "kids": [{"x": 2, "kids": []}]}]}))
    plan = shred.inline_plan(shred.schema_graph(raw, "payload"))
    assert plan["$"] == ["a.b"] and plan["$.list"] == ["x"] and plan["$.list.kids"] == ["x"] and "$.list.kids.kids" in plan


def test_replies_to_replies_are_kept(spark):
    post = {"comment_texts": [None, {"author": "a", "replies": [{"author": "b", "replies": [{"author": "c", "text": "deep"}]}]}]}
    tables = shred.post_tables(rows(spark, json.dumps(post)))
    got = sorted(map(tuple, tables["reply"].select("comment_ord", "reply_ords", "label", "text").collect()))
    assert got == [(1, [0], "b", None), (1, [0, 0], "c", "deep")]
    assert found(spark, json.dumps(post)) == [(0, 0, "comment", -1, 1, "a"), (0, 0, "reply", 1, 0, "b"), (0, 0, "reply", 1, 0, "c")]


def test_odd_payloads(spark):
    deep = "[" * 100_000
    odd = '{"posts": [{"comment_texts": [{"author": "\\ud800x", "n": 1.50, "t": true}], "posts": 3}]}'
    assert found(spark, deep, odd, '{"posts": null}', '{"comment_texts": NaN}', '{"comment_texts": {"author": [1]}}') == [(1, 0, "comment", -1, 0, "?x"), (4, 0, "comment", -1, 0, "")]
