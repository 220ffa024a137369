import datetime as dt

import pytest
from pyspark.sql import functions as F

from mentionlake import lexicon
from mentionlake.functions import text as X
from mentionlake.operators import adapters, annotate, components, dedupe, fusion, nlp, summary, windows
from mentionlake.plans import pipeline
from mentionlake.sinks import files
from mentionlake.sources import payloads


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first().x


@pytest.mark.parametrize("said, n", [("1.4K", 1400), ("2.3M", 2300000), ("1,234", 1234), ("", None), (None, None), ("12", 12), ("many", None)])
def test_counts(spark, said, n):
    assert one(spark, X.parse_count(F.col("s")), s=said) == n


def test_scalars(spark):
    assert one(spark, X.hashtags(F.col("s")), s="#Été und #a_b! #") == ["été", "a_b"]
    assert one(spark, X.mentions(F.col("s"), dots=True), s="@A.b, @c") == ["a.b", "c"]
    assert one(spark, X.distinct_tokens(F.col("s")), s="Hi, hi (there) --") == ["hi", "there"]
    assert one(spark, X.engagement_rate(F.col("a"), F.col("b")), a=134, b=42000) == 0.32
    assert one(spark, X.engagement_rate(F.col("a"), F.col("b")), a=134, b=0) == 0.0
    assert one(spark, X.platform_of(F.col("s")), s="https://netflix.com/a") == "unknown"
    assert one(spark, X.platform_of(F.col("s")), s="HTTPS://mobile.X.example/a") == "x"
    assert one(spark, X.shortcode(F.col("s")), s="https://h/reel/Ab-_9/?x") == "Ab-_9"
    assert one(spark, X.from_unix(F.col("s")), s="0") is None
    assert one(spark, X.from_age(F.col("s"), F.lit("2025-01-10 00:00:00").cast("timestamp")), s="3d") == dt.datetime(2025, 1, 7)
    assert one(spark, X.script_of(F.col("s")), s="привет") == "cyrillic"
    assert abs(one(spark, X.softmax_score(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)))) - 0.5752103826) < 1e-9
    assert [one(spark, X.follower_tier(F.col("n")), n=n) for n in (4999, 5000, 9999, 10000, 99999, 100000)] == ["individual", "nano", "nano", "micro", "micro", "macro"]


def test_first_wins_and_unions(spark):
    a = spark.createDataFrame([(1, 2, "late"), (1, 1, "first"), (None, 1, "none"), (1, 1, "first")], "k int, o int, v string")
    assert sorted(map(tuple, dedupe.first_wins(a, ["k"], ["o"]).collect()), key=str) == [(1, 1, "first"), (None, 1, "none")]
    b = spark.createDataFrame([(1, 0, "other"), (2, 0, "two")], "k int, o int, v string")
    assert {r.v for r in dedupe.priority_union([a.where("k = 1"), b], ["k"], ["o"]).collect()} == {"first", "two"}
    good, bad = dedupe.split_by(a, F.col("k") == 1)
    assert (good.count(), bad.count()) == (3, 1)


def test_components(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (7, 6), (5, 5), (9, None)] + [(i, i + 1) for i in range(10, 60)], "a bigint, b bigint")
    got = {r.node: r.rep for r in components.representatives(links, "a", "b").collect()}
    assert got == {2: 1, 3: 1, 7: 6} | {i: 10 for i in range(11, 61)}
    assert components.representatives(links.where("false"), "a", "b").count() == 0


def test_intent_precedence_and_null(spark):
    df = spark.createDataFrame([("The price and I recommend it",), ("questions",), (None,), ("",), ("call 0712 345 678 now",)], "t string")
    got = [(r.i.level, r.i.confidence) for r in df.select(annotate.intent("t").alias("i")).collect()]
    assert got == [("high", 0.75), ("low", 0.45), ("none", 0.0), ("none", 0.0), ("high", 0.75)]


def test_topics_sorted(spark):
    df = spark.createDataFrame([("gearbox brake garage, loan",)], "t string")
    got = [(t.topic, t.match_count) for t in df.select(annotate.topics("t").alias("x")).first().x]
    assert got == [("repair", 3), ("money", 1)]
    words = spark.createDataFrame([(t, w) for t, ws in lexicon.TOPICS for w in ws if " " not in w], "topic string, word string")
    joined = annotate.topics_by_join(df.withColumn("k", F.lit(1)), "k", "t", words)
    assert {(r.topic, r.match_count) for r in joined.collect()} == set(got)


def test_emoji(spark):
    df = spark.createDataFrame([("🔥🔥😡 a",), (None,)], "t string")
    a, b = [r.e for r in df.select(annotate.emoji_summary("t").alias("e")).collect()]
    assert (a.total, a.distinct, a.positive, a.negative, a.score) == (3, 2, 2, 1, 0.33) and b.total == 0
    assert df.select(X.emoji(F.col("t"), runs=True).alias("e")).first().e == ["🔥🔥😡"]


@pytest.mark.parametrize("score, p, n, want", [(0.31, 0, 0, "positive"), (0.3, 0, 0, "neutral"), (-0.31, 0, 0, "negative"), (0.0, 3, 0, "positive"), (0.0, 2, 0, "neutral"), (0.0, 2, 2, "mixed")])
def test_tone(spark, score, p, n, want):
    assert one(spark, nlp.tone(F.col("s"), F.col("p"), F.col("n")), s=score, p=p, n=n) == want


def test_language_and_scorer(spark):
    df = spark.createDataFrame([("wasee manze hii ni noma sana",), ("the cat was with the dog and that",), ("short",), (None,)], "t string")
    got = [r.l.language for r in df.select(nlp.language(F.col("t")).alias("l")).collect()]
    assert got == ["sheng", "english", "unknown", "unknown"]

    class Stub:
        name = "stub"

        def load(self):
            return lambda s: s.str.len() * 0.0 + 0.9

    out = nlp.sentiment(df.withColumn("lang", nlp.language(F.col("t"))["language"]), "t", "lang", {"english": Stub()}).collect()
    assert [(r.score, r.provider, r.label) for r in out][1] == (0.9, "stub", "positive") and out[3].provider == "none"


def test_fusion_arithmetic(spark):
    s = spark.createDataFrame([(1, "Rome", 0.85, "hashtag"), (1, " rome", 0.2, "timing_peak"), (1, "region", 0.75, "zone"), (1, "else", 0.2, "timing_peak"), (2, None, 0.5, "x"), (1, "Nowhere", None, "x")], "k int, location string, confidence double, source string")
    weights = {"hashtag": 1.2, "timing_peak": 0.3, "zone": 0.9}
    c = {r.location: r.score for r in fusion.candidates(s, "k", weights).collect()}
    assert {k: round(v, 6) for k, v in c.items()} == {"rome": 1.296, "region": 0.675, "else": 0.06}
    best = fusion.fuse(s, "k", weights).collect()
    assert len(best) == 1 and round(best[0].confidence, 4) == 0.8979 and best[0].signals_count == 4
    again = fusion.fuse(s.orderBy(F.desc("source")), "k", weights).collect()
    assert again == best
    posts = spark.createDataFrame([(1, None), (2, " x "), (3, "")], "k int, location string")
    assert [(r.best_location, r.location_method) for r in fusion.located(posts, fusion.fuse(s, "k", weights), "k").orderBy("k").collect()] == [("rome", "fusion"), ("x", "native"), (None, None)]


@pytest.fixture(scope="module")
def places(spark):
    g = spark.createDataFrame([(1, "Rome", "Latium", 41.9, 12.5, "urban"), (2, "Ulm", "Swabia", 48.4, 10.0, "urban"), (3, "Latium", "Latium", None, None, "county"), (4, "Bad Ems", "Hesse", 50.3, 7.7, "rural"), (5, "Rome", "Elsewhere", 1.0, 2.0, "rural")], "ord int, display string, county string, lat double, lon double, area_type string")
    return fusion.place_list(g)


def told(df):
    return sorted((r.location, round(r.confidence, 4), r.source) for r in df.collect())


def test_caption_signals(spark, places):
    p = spark.createDataFrame([(1, "in ROME, rome! Based in Bad Ems. from Ulm, Привет", "a"), (2, None, "a"), (3, "", "a"), (4, "romeo in kenya", "a")], "k int, t string, location string")
    got = told(fusion.caption_signals(p, "k", "t", places))
    assert got == sorted([("Rome", 0.7, "caption_text_city"), ("Bad Ems", 0.7, "caption_text_city"), ("Ulm", 0.7, "caption_text_city"), ("Kenya", 0.6, "caption_text_country"), ("Bad Ems", 0.85, "caption_text_preposition"), ("Ulm", 0.85, "caption_text_preposition"), ("Rome", 0.85, "caption_text_preposition"), ("Eastern Europe", 0.25, "caption_text_language")])
    rome = fusion.caption_signals(p, "k", "t", places).where("location = 'Rome'").first()
    assert (rome.lat, rome.raw_matches) == (41.9, ["rome"])  # the first place of the name


def test_hashtag_signals(spark, places):
    p = spark.createDataFrame([(1, ["#ulmcity", None]), (2, ["#myulm"]), (3, ["#ulmxlatium"]), (4, None), (5, []), (6, ["#visitbadems", "#x"]), (7, ["#" + "a" * 30 + "ulm"])], "k int, h array<string>")
    got = {(r.k, r.location): r.confidence for r in fusion.hashtag_signals(p, "k", "h", places).collect()}
    # exact 1 + inside 1 + begin 0.75 + pattern 0.75 | inside 1 | inside 1 + begin 0.75, 0.5 | inside 1 + pattern 0.75
    assert got == {(1, "Ulm"): 0.85, (2, "Ulm"): 0.5, (3, "Ulm"): 0.61, (3, "Latium"): 0.43, (6, "Bad Ems"): 0.61}


def test_username_signals(spark, places):
    p = spark.createDataFrame([(1, "rome.fan", None), (2, "x_ke", None), (3, "abc", "A lady of Rome"), (4, None, "Rome"), (5, "", None), (6, "somelongname_badems", "Latium girl")], "k int, u string, a string")
    got = sorted((r.k, r.location, round(r.confidence, 2), r.source) for r in fusion.username_signals(p, "k", "u", places, "a").collect())
    assert got == [(1, "Rome", 0.75, "username_city"), (2, "Kenya", 0.65, "username_code"), (3, "Rome", 0.6, "username_city"), (6, "Bad Ems", 0.65, "username_city"), (6, "Latium", 0.5, "username_country")]


def test_bio_signals(spark, places):
    p = spark.createDataFrame([(1, "based in Ulm. 🇰🇪🇰🇪"), (2, None), (3, "📍 Rome, Latium |")], "k int, b string")
    got = told(fusion.bio_signals(p, "k", "b", places))
    assert got == sorted([("Ulm", 0.75, "profile_bio_city"), ("Ulm", 0.8, "profile_bio_pattern"), ("Kenya", 0.65, "profile_bio_flag"), ("Rome", 0.75, "profile_bio_city"), ("Latium", 0.6, "profile_bio_country"), ("Rome, Latium", 0.85, "profile_bio_pattern")])


def test_geo_result(spark):
    s = spark.createDataFrame([(1, "Rome", 0.85, "hashtag_analysis", None, None), (1, " rome", 0.2, "post_timing_peak", 1.0, 2.0), (1, "Region", 0.75, "profile_bio_country", None, None), (1, "else", 0.2, "post_timing_peak", None, None), (1, "more", 0.1, "post_timing_peak", None, None)], "k int, location string, confidence double, source string, lat double, lon double")
    r = fusion.geo_result(s, "k").first()
    # the golden numbers: (0.85 x 1.2 + 0.2 x 0.3) x 1.2, 0.75 x 0.9, 0.2 x 0.3
    assert [(c.location, c.score) for c in r.top_candidates] == [("Rome", 1.296), ("Region", 0.675), ("else", 0.06)]
    assert (r.best_location, round(r.best_confidence, 4), r.signals_count, r.method_used) == ("Rome", 0.8979, 5, "hashtag_analysis, post_timing_peak")
    assert (r.top_candidates[0].lat, [x.confidence for x in r.top_signals]) == (1.0, [0.85, 0.75, 0.2])


def test_nearest_is_brute_force(spark):
    import random

    r = random.Random(1)
    pts = [(i, r.uniform(-80, 80), r.uniform(-180, 180)) for i in range(80)]
    places = [(f"p{i}", r.uniform(-80, 80), r.uniform(-180, 180)) for i in range(60)]
    p, g = spark.createDataFrame(pts, "k int, lat double, lon double"), spark.createDataFrame(places, "place string, lat double, lon double")
    got = {x.k: (x.place, round(x.km, 6)) for x in fusion.nearest(p, g, "k", 900.0).collect()}
    every = p.crossJoin(g.select("place", F.col("lat").alias("a"), F.col("lon").alias("b"))).withColumn("km", X.haversine_km(F.col("lat"), F.col("lon"), F.col("a"), F.col("b"))).where("km <= 900")
    want = {x.k: (x.m.place, round(x.m.km, 6)) for x in every.groupBy("k").agg(F.min(F.struct("km", "place")).alias("m")).collect()}
    assert got == want and len(want) > 20


def test_windows(spark):
    m = [(str(r.start), str(r.end)) for r in windows.month_windows(spark, "2024-01-15", "2024-03-01").collect()]
    assert m == [("2024-01-15", "2024-02-01"), ("2024-02-01", "2024-03-01")]
    w = windows.week_windows(spark, "2024-01-01", "2024-01-10").collect()
    assert [(str(r.start), str(r.end)) for r in w] == [("2024-01-01", "2024-01-08"), ("2024-01-08", "2024-01-10")]
    e = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (2, 3, "c")], "g int, s int, t string")
    assert [(r.g, r.t, r.second, r.margin) for r in windows.margin(e, ["g"], "s", "t").orderBy("g").collect()] == [(1, "a", 5, 0), (2, "c", None, 3)]


TWEET = '{"data":{"x":[{"__typename":"Tweet","rest_id":"9","legacy":{"full_text":"hi","created_at":"Sat Jun 03 11:02:01 +0000 2023","favorite_count":3},"core":{"user_results":{"result":{"legacy":{"screen_name":"me","followers_count":5}}}}},{"__typename":"Tweet","legacy":{"full_text":""}}]}}'


def test_payloads(spark, tmp_path):
    v = spark.createDataFrame([(1, TWEET)], "k int, t string").select("k", F.try_parse_json("t").alias("v"))
    got = payloads.tweets(v, "k", "v").collect()
    assert [(r.tweet_id, r.author, r.author_followers, r.likes) for r in got] == [("9", "me", 5, 3)]
    lines = spark.createDataFrame([(1, '{"a":1}\nbroken\n{"created_time":5,"message":{"text":"m"},"id":"7","i18n_reaction_count":"1.4K"}')], "k int, b string")
    nd = payloads.ndjson(lines, "b", "k")
    assert nd.count() == 2
    posts = payloads.story_rows(payloads.feed_posts(nd, "k", "v"), "k", lo=5, hi=5).collect()
    assert [(r.post_id, r.text, r.reactions) for r in posts] == [("7", "m", 1400)]
    deep = spark.createDataFrame([(1, '{"a":' * 12 + '{"created_time":1,"body":{"text":"x"}}' + "}" * 12), (2, '{"a":' * 13 + '{"created_time":1,"body":{"text":"x"}}' + "}" * 13)], "k int, t string")
    assert [r.k for r in payloads.comment_rows(deep.select("k", F.try_parse_json("t").alias("v")), "k", "v").collect()] == [1]
    page = "<html><meta property='og:title' content='T'><div><h3><a>Ann</a></h3>hello <abbr>2 h</abbr><a>12 likes</a></div><a href='/more?p=2'>View more</a></html>"
    p = spark.createDataFrame([(1, page), (2, None)], "k int, page string")
    assert [tuple(r) for r in payloads.html_comments(p, "k", "page").collect()] == [(1, 0, "Ann", "hello", "2 h", 12)]
    assert p.select(payloads.meta(F.col("page"), "title").alias("t"), payloads.next_link(F.col("page")).alias("n")).first() == ("T", "/more?p=2")
    (tmp_path / "a.json").write_text('{"posts":[{"caption":"x"},{"caption":"y"}]}')
    (tmp_path / "b.json").write_text('[{"caption":"z"}]')
    (tmp_path / "c.json").write_text("{broken")
    assert payloads.load_posts(spark, str(tmp_path)).count() == 3


def test_adapters_tolerate_shapes(spark):
    def run(platform, *records):
        df = spark.createDataFrame([(r,) for r in records], "t string").select(F.try_parse_json("t").alias("post"))
        return adapters.canonical(df, platform).collect()

    t = run("tiktok", '{"id":"1","desc":"a #Tag @Bob","author":"me","stats":{"diggCount":2,"commentCount":3},"comments_data":[{"author":"x","text":" "},{"author":"y","text":"ok","likes":1}]}', '{"id":"  "}')
    assert len(t) == 1 and t[0].author.username == "me" and t[0].engagement.total == 5 and t[0].hashtags == ["tag"] and [c.author for c in t[0].comments] == ["y"]
    x = run("x", '{"post_url":"https://x.example/a/status/Z9","caption":"c","hashtags":"#A #b","comments_json":"[{\\"reply_id\\":\\"1\\",\\"text\\":\\"r\\"}]","post_date":"Sat Jun 03 11:02:01 +0000 2023"}')
    assert x[0].post_id == "Z9" and x[0].hashtags == ["a", "b"] and x[0].comments[0].comment_id == "1" and x[0].ts == dt.datetime(2023, 6, 3, 11, 2, 1)
    li = run("linkedin", '{"post_id":"","text":"abc","time_text":"5d","scraped_at":"2024-01-10T00:00:00","hashtags":["#X"]}', '{"text":""}')
    assert len(li) == 1 and len(li[0].post_id) == 16 and li[0].ts == dt.datetime(2024, 1, 5) and li[0].hashtags == ["x"]
    assert run("facebook", '{"post_id":"1","comments":[{"text":""},{"text":"a","author_name":"n"}]}')[0].comments[0].author == "n"
    assert run("instagram", "{}")[0].post_id == ""


def test_pipeline_and_empty_table(spark):
    rec = '{"post_url":"https://i.example/p/Ab/","caption":"Nyati Max is smooth, bei ni 5 #deals","username":"kahawa_news","comment_texts":[{"author":"a","text":"it leaks a lot"}],"location":"Rome, x"}'
    v = spark.createDataFrame([(rec,)], "t string").select(F.try_parse_json("t").alias("post"))
    g = spark.createDataFrame([("Rome", "Lazio", "urban", 1.0, 2.0, 1)], "display string, county string, area_type string, lat double, lon double, ord int")
    out, s = pipeline.run(v, "instagram", g)
    r = out.first()
    assert (r.products[0].name, r.intent.level, r.account.type, r.city, r.county, r.comment_score, r.campaigns[0].campaign_id) == ("Nyati Max", "high", "media", "Rome", "Lazio", -1.0, "c4")
    assert s["scores"].first().posts == 1
    out, s = pipeline.run(v.where("false"), "instagram", g)
    assert out.count() == 0 and all(x.count() in (0, 1) for x in s.values())
    bare, _ = pipeline.run(v, "instagram", None, pipeline.Config(rules=False, places=False, text=False))
    assert "intent" not in bare.columns


def test_summaries(spark):
    df = spark.createDataFrame([("a", 0.25, ["x", "x"]), ("a", 0.26, ["x"]), ("b", -0.3, ["y"]), (None, None, None)], "g string, score double, v array<string>")
    s = {r.g: r for r in summary.score_stats(df, ["g"]).collect()}
    assert (s["a"].positive, s["a"].neutral, s["b"].negative, s["a"].score_avg) == (1, 1, 1, 0.255)
    assert [tuple(r) for r in summary.top_values(df, "v", 2).collect()] == [("x", 2), ("y", 1)]
    assert summary.totals(df, ["g"], ["score"]).count() == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", 'b"c\n'], (2,)), (2, None, None)], "k int, l array<string>, s struct<n:int>")
    files.write_csv(df, str(tmp_path / "c"), ["k", "l", "absent"])
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert back.columns == ["k", "l", "absent"] and back.count() == 2
    assert sorted(files.unflattened(files.flattened(df), df.schema).collect()) == sorted(df.collect())
    files.write_envelope(df, df.limit(1), str(tmp_path / "e"), hashtag="x")
    assert spark.read.json(str(tmp_path / "e/metadata")).first().post_count == 2
    new = spark.createDataFrame([(2, ["n"], (9,))], df.schema)
    assert {r.k: r.l for r in files.merged(df, new, ["k"]).collect()} == {1: ["a", 'b"c\n'], 2: ["n"]}
    files.upsert(df, ["k"], lambda rows: None)
    files.write_layers(df, df.withColumn("platform", F.lit("x")), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l/silver")).where("platform = 'x'").count() == 2
