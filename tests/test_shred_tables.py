import json

from mentionlake.operators import shred


def raw(spark, *payloads):
    return spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "rec_id bigint, payload string")


def test_the_query_reads_the_tables_of_the_plan(spark, monkeypatch):
    calls, made = [], shred.shred
    monkeypatch.setattr(shred, "shred", lambda *a: calls.append(a[-1].name) or made(*a))
    df = raw(spark, {"comment_texts": [{"author": "a", "replies": [{"author": "b"}, None]}], "product_mentions": {"product": "P", "found_in": ["x"]}}, [{"comments_json": json.dumps(["t"])}], "no post")
    got = sorted(map(tuple, shred.p3_found(df).collect()))
    assert calls == ["post"] and got == [(0, 0, "comment", -1, 0, "a"), (0, 0, "product", -1, 0, "P"), (0, 0, "product_place", 0, 0, "x"), (0, 0, "reply", 0, 0, "b"), (1, 0, "comment", -1, 0, "")]


def test_repeated_elements_outside_the_plan_get_a_table(spark):
    df = raw(
        spark,
        {"polls": [{"q": "a", "by": {"id": 7}, "options": ["x", None, "y"]}], "comment_texts": [{"author": "a", "badges": ["new"]}]},
        {"metadata": {"n": 1}, "failed": [{"url": "u"}], "posts": [{"caption": "c"}, {"polls": {"q": "b"}}]},
    )
    tables = shred.post_tables(df)
    rows = lambda name, *cols: sorted(map(tuple, tables[name].select(*cols).collect()))
    assert rows("polls", "rec_id", "post_ord", "polls_ord", "q", "by_id") == [(0, 0, 0, "a", "7"), (1, 1, 0, "b", None)]
    assert rows("polls_options", "rec_id", "polls_ord", "polls_options_ord", "value") == [(0, 0, 0, "x"), (0, 0, 2, "y")]
    assert rows("comment_badges", "rec_id", "comment_ord", "comment_badges_ord", "value") == [(0, 0, 0, "new")]
    assert rows("record_failed", "rec_id", "url") == [(1, "u")]
