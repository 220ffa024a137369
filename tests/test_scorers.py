import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from mentionlake.operators import nlp
from mentionlake.plans import pipeline
from mentionlake.session import release, shared_dir, small, weighed

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module


class Remote:
    name = "remote"

    def load(self):
        def run(texts: pd.Series) -> pd.DataFrame:
            if texts.str.contains("fail").any():
                raise RuntimeError("no connection")
            return pd.DataFrame({"score": texts.str.len() * 0.0 + 0.6, "magnitude": 2.5, "confidence": 1.0, "sentences": [[{"text": t, "score": 0.6}] for t in texts]})

        return run


LOCAL = nlp.ThreeClass("local", lambda: lambda texts: np.tile([0.0, 1.0, 3.0], (len(texts), 1)))


class Broken:
    name = "broken"

    def load(self):
        raise OSError("no model")


def rows(spark, scorers, *said):
    df = spark.createDataFrame(list(said), "t string, lang string")
    return nlp.sentiment(df, "t", "lang", scorers).coalesce(1).collect()


def test_chains(spark):
    table = nlp.routes(Remote(), LOCAL)
    got = rows(spark, table, ("good day", "english"), ("habari", "swahili"), ("hmm hmm", "unknown"), ("bonjour", "french"), ("abc", "english"), (None, "english"))
    assert [r.provider for r in got] == ["remote", "local", "local", "remote", "none", "none"]
    assert (got[0].score, got[0].magnitude, got[0].sentences[0].text) == (0.6, 2.5, "good day")
    p = np.round(np.exp([0, 1, 3]) / np.exp([0, 1, 3]).sum(), 4)
    assert got[1].score == pytest.approx(p[2] - p[0]) and got[1].confidence == pytest.approx(p[2]) and len(got[1].scores_all) == 3
    assert [r.provider for r in rows(spark, table, ("fail now", "english"))] == ["local"]  # the next of the chain
    one = rows(spark, {"english": Broken()}, ("good day", "english"), ("good day", "swahili"))
    assert [(r.provider, r.score, r.label) for r in one] == [("broken_error", 0.0, "neutral"), ("lexicon", 0.0, "neutral")]


def test_comment_details(spark):
    df = spark.createDataFrame([("x", [("it leaks a lot",), ("abc",), (None,), ("smooth and free " + "y" * 200,)]), ("y", []), ("z", None)], "k string, comment_texts array<struct<text:string>>")
    out = df.select("k", nlp.comment_details(df, "comment_texts", 20).alias("d"), nlp.comment_scores(df, "comment_texts", 20).alias("s"), nlp.comment_scores(df, "comment_texts", 1).alias("first")).orderBy("k").collect()
    assert [(c.score, c.label, len(c.text)) for c in out[0].d] == [(-1.0, "negative", 14), (1.0, "positive", 100)]
    assert (out[0].s, out[0].first, out[1].s, out[2].s) == (0.0, -1.0, None, None)
    routed = nlp.with_comment_details(df, "d", "comment_texts", 20, {"unknown": LOCAL, "english": LOCAL}).where("k = 'x'").first().d
    assert {c.provider for c in routed} == {"local"}


def test_files_to_files(spark, tmp_path):
    rec = '{"posts":[{"post_url":"https://i.example/p/Ab/","caption":"Nyati Max is smooth, bei ni 5","username":"kahawa_news","post_date":"2024-03-01T00:00:00Z","source_hashtag":"q","likes":3,"comment_texts":[{"author":"a","text":"it leaks a lot"}]},{"post_url":"https://i.example/p/Cd/","caption":"old","post_date":"2020-01-01T00:00:00Z"}]}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(rec)
    g = spark.createDataFrame([("Rome", "Lazio", "urban", 1.0, 2.0, 1)], "display string, county string, area_type string, lat double, lon double, ord int")
    posts, s = pipeline.run_files(spark, str(tmp_path / "in"), "instagram", str(tmp_path / "out"), g, pipeline.Config(date_from="2024-01-01", layout="hashtag", by=("platform",)))
    r = posts.first()
    assert posts.count() == 1 and (r.post_url, r.comment_details[0].score) == ("https://i.example/p/Ab/", -1.0)
    assert set(s) == {"scores", "languages", "tones", "positive_drivers", "negative_drivers", "complaint_themes", "high_intent", "high_intent_count", "top_posts", "totals", "hinted"}
    assert spark.read.json(str(tmp_path / "out/metadata")).first().asDict() == {"platform": "instagram", "read": 2, "post_count": 2, "skipped": 0}
    assert spark.read.option("header", True).csv(str(tmp_path / "out/csv")).first().hashtag_source == "q" and spark.read.json(str(tmp_path / "out/summary/scores")).count() == 1
    again = pipeline.annotate_files(spark, str(tmp_path / "out/posts"), str(tmp_path / "two"), "rules")
    assert again.first().intent.level == "high"
    assert pipeline.run_files(spark, str(tmp_path / "in"), "instagram", str(tmp_path / "none"), g, pipeline.Config(max_posts=1, comments=False))[0].count() == 2  # one of each query


def test_broadcast_bound(spark):
    df = spark.range(100).select("id", F.lit("abcd").alias("s"), F.array(F.lit("x"), F.lit(None).cast("string")).alias("a"))
    n = weighed(df)
    assert 100 * 30 < n < 100 * 150 and weighed(df.limit(0)) == 0
    plan = lambda x: spark.range(5).join(x, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(small(df)) and small(df, 10).count() == 100
    assert shared_dir(spark)
    release(spark)
