"""The queries of the core operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionlake import lexicon as L
from mentionlake.functions import filters
from mentionlake.functions import text as X
from mentionlake.operators import annotate, dedupe, fusion, nlp, shred, summary, times, windows
from mentionlake.session import table
from mentionlake.sinks import files
from mentionlake.sources import payloads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that says the same."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- pieces of the SQL, made of the same lexicons ---------------------------------------
def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def _hits(text: str, words) -> str:
    return f"len(list_filter({_list(words)}, lambda k: contains(lower({text}), k)))"


_PHONE = r"regexp_matches({0}, '(^|[^0-9])(\+?254|0)[ -]?[0-9]{{3}}[ -]?[0-9]{{3}}[ -]?[0-9]{{3}}([^0-9]|$)')"
_TEXT = "coalesce(text, '')"
_INTENT = f"""SELECT *, CASE WHEN h > 0 THEN 'high' WHEN m > 0 THEN 'medium' WHEN l > 0 THEN 'low' ELSE 'none' END AS level,
  CASE WHEN h > 0 THEN least(70 + 5 * h, 95) WHEN m > 0 THEN least(50 + 5 * m, 80) WHEN l > 0 THEN least(40 + 5 * l, 70) ELSE 0 END AS pct
  FROM (SELECT *, {_hits(_TEXT, L.INTENT["high"])} + CASE WHEN {_PHONE.format(_TEXT)} THEN 1 ELSE 0 END AS h, {_hits(_TEXT, L.INTENT["medium"])} AS m, {_hits(_TEXT, L.INTENT["low"])} AS l FROM documents)"""
_TOKENS = r"""list_distinct(list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x0B\x85\p{Z}]+'), lambda w: trim(w, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~')), lambda w: w <> ''))"""


def _marks(lang: str) -> str:
    return f"len(list_intersect(t, {_list(dict.fromkeys(L.MARKERS[lang]))}))"


_LANG = f"""SELECT doc_id, source, text, t, CASE WHEN len(trim({_TEXT})) < 10 THEN 'unknown' WHEN sh >= 2 THEN 'sheng' WHEN best = 'english' AND sw >= 2 THEN 'mixed' ELSE best END AS lang, sh, sw
  FROM (SELECT *, CASE WHEN greatest(en, sw, fr, de) = 0 THEN 'unknown' WHEN en = greatest(en, sw, fr, de) THEN 'english' WHEN sw = greatest(en, sw, fr, de) THEN 'swahili' WHEN fr = greatest(en, sw, fr, de) THEN 'french' ELSE 'german' END AS best
  FROM (SELECT *, {_marks("english")} AS en, {_marks("swahili")} AS sw, {_marks("french")} AS fr, {_marks("german")} AS de, {_marks("sheng")} AS sh FROM (SELECT doc_id, source, text, {_TOKENS} AS t FROM documents)))"""


def _keywords(tab: dict) -> str:
    gate = {"english": "true", "swahili": "lang IN ('swahili', 'sheng', 'mixed')", "sheng": "lang IN ('sheng', 'mixed')"}
    parts = []
    for k, words in tab.items():
        one, more = [w for w in words if " " not in w], [w for w in words if " " in w]
        found = f"list_intersect({_list(one)}, t)" + (f" || list_filter({_list(more)}, lambda k: contains(lower({_TEXT}), k))" if more else "")
        parts.append(f"(CASE WHEN {gate[k]} THEN {found} ELSE [] END)")
    return f"list_distinct({' || '.join(parts)})"


_KEYS = f"SELECT *, {_keywords(L.POSITIVE)} AS pos, {_keywords(L.NEGATIVE)} AS neg FROM ({_LANG})"
_SCORED = f"""SELECT *, len(pos) AS p, len(neg) AS n, CASE WHEN len(trim({_TEXT})) < 5 OR len(pos) + len(neg) = 0 THEN 0.0 ELSE round((len(pos) - len(neg))::DECIMAL(18,6) / (len(pos) + len(neg)), 4)::DOUBLE END AS score FROM ({_KEYS})"""
_TONED = f"""SELECT *, CASE WHEN score > 0.3 THEN 'positive' WHEN score < -0.3 THEN 'negative' WHEN p > n + 2 THEN 'positive' WHEN n > p + 2 THEN 'negative' WHEN p >= 2 AND n >= 2 THEN 'mixed' ELSE 'neutral' END AS tone FROM ({_SCORED})"""
_TOPIC_ROWS = " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, {q(t)} AS topic, {len(w)} AS size, {_hits(_TEXT, w)} AS m FROM documents" for i, (t, w) in enumerate(L.TOPICS))
_TOPICS = f"SELECT doc_id, topic, m AS match_count, round(least(95.0, 50 + 50 * m::DECIMAL(20,10) / size + 3 * m) / 100, 2)::DOUBLE AS confidence, ord FROM ({_TOPIC_ROWS}) WHERE m > 0"


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents")


def _scored_docs(spark, d) -> DataFrame:
    docs = _docs(spark, d).withColumn("language", nlp.language(F.col("text"))).withColumn("lang_found", F.col("language.language"))
    s = nlp.sentiment(docs, "text", "lang_found")
    return s.withColumn("tone", nlp.tone(F.col("score"), F.size("positive"), F.size("negative")))


# --- nested records and instants (core problems) -----------------------------------------
@query()
def p2_found(spark, d):
    return times.p2_found(table(spark, d, "posts"), table(spark, d, "comments"))


@query()
def p3_found(spark, d):
    return shred.p3_found(table(spark, d, "raw_posts"))


# --- rule annotations -----------------------------------------------------------------------
@query(f"SELECT source, level, count(*) AS docs, round(avg(pct)::DOUBLE / 100, 4) AS confidence FROM ({_INTENT}) GROUP BY source, level")
def intent_by_source(spark, d):
    rows = _docs(spark, d).select("source", annotate.intent("text").alias("i"))
    return rows.groupBy("source", F.col("i.level").alias("level")).agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg(F.round(F.col("i.confidence") * 100)) / 100, 4).alias("confidence"))


@query(f"SELECT doc_id, topic, confidence, match_count::BIGINT AS match_count, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, ord) AS rank FROM ({_TOPICS})")
def topic_tags_long(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode(annotate.topics("text")).alias("i", "t"))
    return rows.select("doc_id", "t.topic", "t.confidence", F.col("t.match_count").cast("bigint").alias("match_count"), (F.col("i") + 1).cast("bigint").alias("rank"))


_SINGLE = [(t, w) for t, ws in L.TOPICS for w in ws if " " not in w]


@query(f"SELECT doc_id, topic, count(*) AS match_count FROM (SELECT doc_id, unnest({_TOKENS}) AS word FROM documents) JOIN (VALUES {', '.join(f'({q(t)}, {q(w)})' for t, w in _SINGLE)}) AS k(topic, word) USING (word) GROUP BY doc_id, topic")
def topic_join(spark, d):
    return annotate.topics_by_join(_docs(spark, d), "doc_id", "text", spark.createDataFrame(_SINGLE, "topic string, word string"))


def _mention_sql(patterns) -> str:
    n = lambda col, p: f"len(regexp_extract_all(coalesce({col}, ''), {q('(?i)' + p)}))"
    comments = "coalesce(array_to_string(list_transform(comment_texts, lambda c: coalesce(c.text, '')), chr(10)), '')"
    rows = " UNION ALL ".join(f"SELECT post_key, {q(name)} AS name, {q(cat)} AS category, {n('caption', p)} AS a, {n('c', p)} AS b FROM (SELECT post_key, caption, {comments} AS c FROM posts)" for p, name, cat in patterns)
    return f"SELECT post_key, name, category, (a + b)::BIGINT AS hits, CASE WHEN a > 0 AND b > 0 THEN 'caption,comments' WHEN a > 0 THEN 'caption' ELSE 'comments' END AS found_in FROM ({rows}) WHERE a + b > 0"


def _mentions(spark, d, patterns):
    rows = table(spark, d, "posts").withColumn("_c", annotate.comment_text("comment_texts"))
    return rows.select("post_key", F.explode(annotate.pattern_mentions("caption", "_c", patterns)).alias("m")).select("post_key", "m.name", "m.category", F.col("m.count").alias("hits"), F.array_join("m.found_in", ",").alias("found_in"))


@query(_mention_sql(L.PRODUCTS))
def product_mentions(spark, d):
    return _mentions(spark, d, L.PRODUCTS)


@query(f"SELECT category, name, count(*) AS posts, sum(hits)::BIGINT AS hits FROM ({_mention_sql(L.PARTNERS)}) GROUP BY category, name")
def partner_by_type(spark, d):
    return _mentions(spark, d, L.PARTNERS).groupBy("category", "name").agg(F.count(F.lit(1)).alias("posts"), F.sum("hits").alias("hits"))


_B = [f"len(regexp_extract_all(coalesce({{0}}, ''), {q('(?i)' + p)}))" for p, _ in L.BRAND]
_VARIANTS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {x.format('caption')} + {x.format('c')} > 0 THEN {q(v)} END" for x, (_, v) in list(zip(_B, L.BRAND))[1:]) + "], lambda v: v IS NOT NULL), ',')"
_COMMENTS = "coalesce(array_to_string(list_transform(comment_texts, lambda c: coalesce(c.text, '')), chr(10)), '')"


@query(f"SELECT post_key, (a + b)::BIGINT AS hits, CASE WHEN a > 0 AND b > 0 THEN 'caption,comments' WHEN a > 0 THEN 'caption' ELSE 'comments' END AS found_in, {_VARIANTS} AS variants FROM (SELECT *, {' + '.join(x.format('caption') for x in _B)} AS a, {' + '.join(x.format('c') for x in _B)} AS b FROM (SELECT post_key, caption, {_COMMENTS} AS c FROM posts)) WHERE a + b > 0")
def brand_variants(spark, d):
    rows = table(spark, d, "posts").withColumn("_c", annotate.comment_text("comment_texts")).select("post_key", annotate.brand_mentions("caption", "_c").alias("b"))
    return rows.where("b.count > 0").select("post_key", F.col("b.count").alias("hits"), F.array_join("b.found_in", ",").alias("found_in"), F.array_join("b.variants", ",").alias("variants"))


def _campaign_sql() -> str:
    tags = "list_transform(coalesce(hashtags, []), lambda h: lower(h))"
    ms = "list_transform(coalesce(mentions, []), lambda h: lower(h))"
    rows = " UNION ALL ".join(
        f"SELECT post_key, {q(c[0])} AS campaign_id, {q(c[1])} AS name, {q(c[2])} AS type, len(list_distinct(list_intersect({_list(c[3])}, {tags}))) + {_hits('coalesce(caption, chr(32))', c[4]) if c[4] else '0'} + len(list_distinct(list_intersect({_list(c[5])}, {ms}))) AS n FROM posts"
        for c in L.CAMPAIGNS
    )
    return f"SELECT post_key, campaign_id, name, type, (least(60 + 10 * n, 95) / 100)::DOUBLE AS confidence, n::BIGINT AS signals FROM ({rows}) WHERE n > 0"


@query(_campaign_sql())
def campaign_match(spark, d):
    rows = table(spark, d, "posts").select("post_key", F.explode(annotate.campaigns("caption", "hashtags", "mentions")).alias("c"))
    return rows.select("post_key", "c.campaign_id", "c.name", "c.type", "c.confidence", F.size("c.signals").cast("bigint").alias("signals"))


def _account_sql() -> str:
    classes = " ".join(f"WHEN regexp_matches(coalesce(username, ''), {q('(?i)' + p)}) THEN {{{i}}}" for i, (p, _, _) in enumerate(L.ACCOUNT_CLASSES))
    tiers = " ".join(f"WHEN coalesce(follower_count, 0) >= {n} THEN {{{i + 3}}}" for i, (n, _, _) in enumerate(L.TIERS))
    case = lambda v: f"CASE {classes} {tiers} END".format(*v)
    tier = " ".join(f"WHEN coalesce(follower_count, 0) >= {n} THEN {q(t)}" for n, t, _ in L.TIERS)
    return f"SELECT {case([q(n) for _, n, _ in (*L.ACCOUNT_CLASSES, *L.TIERS)])} AS type, CASE {tier} END AS tier, count(*) AS posts, max({case([c for *_, c in (*L.ACCOUNT_CLASSES, *L.TIERS)])})::DOUBLE AS confidence FROM posts GROUP BY 1, 2"


@query(_account_sql())
def account_tiers(spark, d):
    a = table(spark, d, "posts").select(annotate.account_class("username", "follower_count").alias("a"))
    return a.groupBy(F.col("a.type").alias("type"), F.col("a.follower_tier").alias("tier")).agg(F.count(F.lit(1)).alias("posts"), F.max("a.confidence").alias("confidence"))


_TOWNS = "towns AS (SELECT lower(trim(display)) AS k, arg_min(display, ord) AS display, arg_min(county, ord) AS county, min(ord) AS ord FROM gazetteer WHERE area_type <> 'county' GROUP BY 1)"


@query(rf"""WITH {_TOWNS},
s AS (SELECT post_key, unnest(geo_enrichment.top_signals) AS x, generate_subscripts(geo_enrichment.top_signals, 1) AS i FROM posts),
n AS (SELECT post_key, i, coalesce(x.confidence, 0.5) AS c, contains(lower(x.source), 'city') AS is_city, coalesce(a.ord, b.ord) AS ord FROM s LEFT JOIN towns a ON contains(x.location, ',') AND a.k = trim(split_part(lower(trim(x.location)), ',', 1)) LEFT JOIN towns b ON b.k = lower(trim(x.location))),
o AS (SELECT post_key, arg_min(ord, i) FILTER (r1 = 1) AS o1, max(c) FILTER (r1 = 1) AS c1, arg_min(ord, i) FILTER (r2 = 1) AS o2, max(c) FILTER (r2 = 1) AS c2 FROM (SELECT *, CASE WHEN is_city THEN row_number() OVER (PARTITION BY post_key, is_city ORDER BY c DESC, i) END AS r1, row_number() OVER (PARTITION BY post_key ORDER BY c DESC, i) AS r2 FROM n WHERE ord IS NOT NULL AND c > 0) GROUP BY post_key),
f AS (SELECT post_key, coalesce(a.ord, b.ord) AS o3 FROM posts LEFT JOIN towns a ON contains(location, ',') AND a.k = trim(split_part(lower(trim(location)), ',', 1)) LEFT JOIN towns b ON b.k = lower(trim(location))),
w AS (SELECT post_key, ' ' || array_to_string(regexp_extract_all(lower(coalesce(caption, '')), '([\p{{L}}\p{{M}}\p{{N}}_]+)', 1), ' ') || ' ' AS t FROM posts),
g AS (SELECT post_key, min(ord) AS o4 FROM w JOIN towns ON contains(t, ' ' || array_to_string(regexp_extract_all(k, '([\p{{L}}\p{{M}}\p{{N}}_]+)', 1), ' ') || ' ') GROUP BY post_key),
e AS (SELECT p.post_key, p.location_confidence, CASE WHEN o2 IS NOT NULL AND (o1 IS NULL OR c2 > c1) THEN o2 ELSE o1 END AS oe, CASE WHEN o2 IS NOT NULL AND (o1 IS NULL OR c2 > c1) THEN c2 ELSE c1 END AS ce, CASE WHEN o2 IS NOT NULL AND (o1 IS NULL OR c2 > c1) THEN 'candidate' ELSE 'signal' END AS se, o3, o4 FROM posts p LEFT JOIN o USING (post_key) LEFT JOIN f USING (post_key) LEFT JOIN g USING (post_key))
SELECT post_key, display AS city, county, CASE WHEN oe IS NOT NULL THEN se WHEN o3 IS NOT NULL THEN 'location' WHEN o4 IS NOT NULL THEN 'caption' END AS city_source, CASE WHEN oe IS NOT NULL THEN round(ce, 2) WHEN o3 IS NOT NULL THEN round(round(coalesce(location_confidence, 0.5)::DECIMAL(6,4) * 0.8::DECIMAL(2,1), 4)::DOUBLE, 2) WHEN o4 IS NOT NULL THEN 0.55 END AS city_confidence
FROM e LEFT JOIN towns t ON t.ord = coalesce(oe, o3, o4)""")
def city_priority(spark, d):
    # The tables hold signals only: each signal, of whatever source, stands as a candidate too.
    candidates = F.transform("geo_enrichment.top_signals", lambda s: F.struct(s["location"].alias("location"), s["confidence"].alias("max_confidence"), s["latitude"].alias("latitude"), s["longitude"].alias("longitude")))
    rows = annotate.city_of(table(spark, d, "posts"), table(spark, d, "gazetteer"), candidates=candidates)
    return rows.select("post_key", "city", "county", "city_source", "city_confidence")


# --- scalar functions ------------------------------------------------------------------------
@query(r"SELECT tag, count(*) AS posts FROM (SELECT DISTINCT post_key, lower(tag) AS tag FROM (SELECT post_key, unnest(regexp_extract_all(coalesce(caption, ''), '#([\p{L}\p{M}\p{N}_]+)', 1)) AS tag FROM posts)) GROUP BY tag ORDER BY posts DESC, tag LIMIT 10")
def hashtag_top10(spark, d):
    return summary.top_values(table(spark, d, "posts").withColumn("_h", X.hashtags(F.col("caption"))), "_h", 10, name="tag")


@query(r"SELECT post_key, lower(m) AS mention FROM (SELECT post_key, unnest(regexp_extract_all(coalesce(caption, ''), '@([a-zA-Z0-9_.]+)', 1)) AS m FROM posts)")
def mention_extract(spark, d):
    rows = table(spark, d, "posts").select("post_key", F.explode(X.mentions(F.col("caption"), dots=True)).alias("mention"))
    return rows


@query(r"SELECT post_key, CASE WHEN regexp_matches(h, '^([a-z0-9-]+\.)*instagram\.[a-z]+$') THEN 'instagram' WHEN regexp_matches(h, '^([a-z0-9-]+\.)*tiktok\.[a-z]+$') THEN 'tiktok' WHEN regexp_matches(h, '^([a-z0-9-]+\.)*facebook\.[a-z]+$') THEN 'facebook' WHEN regexp_matches(h, '^([a-z0-9-]+\.)*linkedin\.[a-z]+$') THEN 'linkedin' WHEN regexp_matches(h, '^([a-z0-9-]+\.)*x\.[a-z]+$') THEN 'x' ELSE 'unknown' END AS platform, nullif(regexp_extract(post_url, '/(p|reel)/([A-Za-z0-9_-]+)', 2), '') AS shortcode FROM (SELECT post_key, post_url, regexp_replace(lower(regexp_extract(trim(post_url), '^(?i)(https?://)?([^/?#]+)', 2)), '^(www|m|mobile)\.', '') AS h FROM posts)")
def url_platform(spark, d):
    return table(spark, d, "posts").select("post_key", X.platform_of(F.col("post_url")).alias("platform"), X.shortcode(F.col("post_url")).alias("shortcode"))


@query("SELECT o_orderkey, CASE WHEN m >= 100000 THEN m // 100 * 100 ELSE m END AS n FROM (SELECT o_orderkey, o_orderkey * 137 % 5000000 AS m FROM orders)")
def parse_human_counts(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 137 % 5000000).alias("m"))
    said = F.when(F.col("m") >= 100000, F.concat((F.floor(F.col("m") / 100).cast("decimal(14,1)") / 10).cast("decimal(14,1)").cast("string"), F.lit("K"))).otherwise(F.format_number("m", 0))
    return o.select("o_orderkey", X.parse_count(said).alias("n"))


@query("SELECT post_key, CASE WHEN follower_count > 0 THEN round((coalesce(likes, 0) + coalesce(comments, 0))::DECIMAL(20,0) * 100 / follower_count, 2)::DOUBLE ELSE 0.0 END AS rate FROM posts")
def engagement_rate(spark, d):
    return table(spark, d, "posts").select("post_key", X.engagement_rate(F.coalesce("likes", F.lit(0)) + F.coalesce("comments", F.lit(0)), F.col("follower_count")).alias("rate"))


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", payloads.dig(F.try_parse_json("props"), "k", "bigint").alias("k"))


@query("SELECT event_id, depth::INTEGER AS depth FROM (SELECT event_id, (event_id % 5)::INTEGER + 1 AS depth FROM events WHERE json_extract(props, '$.k') IS NOT NULL)")
def json_walk(spark, d):
    e = table(spark, d, "events").where(F.get_json_object("props", "$.k").isNotNull())
    body = F.col("props")
    nested = F.concat(F.repeat(F.lit('{"a":'), (F.col("event_id") % 5 + 1).cast("int")), body, F.repeat(F.lit("}"), (F.col("event_id") % 5 + 1).cast("int")))
    rows = e.select("event_id", F.try_parse_json(nested).alias("v"))
    return payloads.walk(rows, "event_id", "v", lambda v: payloads.dig(v, "k", "bigint").isNotNull(), 6).select("event_id", F.col("depth").cast("int").alias("depth"))


@query("SELECT doc_id, substr(md5(substr(text, 1, 120)), 1, 16) AS id FROM documents WHERE text IS NOT NULL")
def derived_key(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", X.short_md5(F.col("text"), 120, 16).alias("id"))


# --- language, keywords, sentiment -----------------------------------------------------------
@query(f"SELECT doc_id, lang, sh::BIGINT AS sheng, sw::BIGINT AS swahili FROM ({_LANG})")
def language_markers(spark, d):
    rows = _docs(spark, d).select("doc_id", nlp.language(F.col("text")).alias("l"))
    return rows.select("doc_id", F.col("l.language").alias("lang"), F.col("l.sheng").cast("bigint").alias("sheng"), F.col("l.swahili").cast("bigint").alias("swahili"))


@query(f"SELECT doc_id, score, CASE WHEN score > 0.25 THEN 'positive' WHEN score < -0.25 THEN 'negative' ELSE 'neutral' END AS label, p::BIGINT AS positives, n::BIGINT AS negatives FROM ({_SCORED})")
def lexicon_sentiment(spark, d):
    return _scored_docs(spark, d).select("doc_id", "score", "label", F.size("positive").cast("bigint").alias("positives"), F.size("negative").cast("bigint").alias("negatives"))


@query(f"SELECT source, tone, count(*) AS posts FROM ({_TONED}) GROUP BY source, tone")
def tone_distribution(spark, d):
    return summary.value_counts(_scored_docs(spark, d), "tone", ["source"])


@query(f"SELECT source, count(*) AS posts, round(avg(score::DECIMAL(12,6)), 4)::DOUBLE AS score_avg, min(score) AS score_min, max(score) AS score_max, count(*) FILTER (score > 0.25) AS positive, count(*) FILTER (score < -0.25) AS negative, count(*) FILTER (score BETWEEN -0.25 AND 0.25) AS neutral FROM ({_SCORED}) GROUP BY source")
def sentiment_distribution(spark, d):
    return summary.score_stats(_scored_docs(spark, d), ["source"])


@query(f"SELECT value, count(*) AS posts FROM (SELECT unnest(neg) AS value FROM ({_KEYS})) GROUP BY value ORDER BY posts DESC, value LIMIT 10")
def drivers_top10(spark, d):
    return summary.top_values(_scored_docs(spark, d), "negative", 10)


@query(f"SELECT topic, count(*) AS posts FROM ({_TOPICS}) JOIN (SELECT doc_id FROM ({_SCORED}) WHERE score < -0.25) USING (doc_id) GROUP BY topic ORDER BY posts DESC, topic LIMIT 5")
def complaint_themes(spark, d):
    return summary.complaint_themes(_scored_docs(spark, d).withColumn("topics", annotate.topics("text")))


@query(f"SELECT account AS username, count(*) AS posts FROM ({_INTENT}) WHERE level = 'high' GROUP BY account")
def high_intent_authors(spark, d):
    return summary.high_intent(_docs(spark, d).withColumn("intent", annotate.intent("text")), username="account").withColumnRenamed("account", "username")


_NOTED = _KEYS.replace("FROM documents", "FROM noted")


@query(f"""WITH noted AS (SELECT post_key AS doc_id, i AS source, c.text AS text FROM (SELECT post_key, unnest(comment_texts) AS c, generate_subscripts(comment_texts, 1) AS i FROM posts) WHERE i <= 20 AND length(trim(coalesce(c.text, ''))) >= 5)
SELECT p.post_key, comment_score FROM posts p LEFT JOIN (SELECT doc_id, round(avg(CASE WHEN len(pos) + len(neg) = 0 THEN 0.0 ELSE round((len(pos) - len(neg))::DECIMAL(18,6) / (len(pos) + len(neg)), 4)::DOUBLE END), 4) AS comment_score FROM ({_NOTED}) GROUP BY doc_id) ON doc_id = p.post_key""")
def comment_scores(spark, d):
    return table(spark, d, "posts").select("post_key", nlp.comment_scores(table(spark, d, "posts"), "comment_texts", 20).alias("comment_score"))


@query("SELECT emoji, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(caption, ''), '([\\x{1F300}-\\x{1F5FF}\\x{1F600}-\\x{1F64F}\\x{1F680}-\\x{1F6FF}\\x{1F900}-\\x{1F9FF}\\x{2600}-\\x{26FF}\\x{2700}-\\x{27BF}])', 1)) AS emoji FROM posts) GROUP BY emoji")
def emoji_counts(spark, d):
    rows = table(spark, d, "posts").select(F.explode(X.emoji(F.col("caption"))).alias("emoji"))
    return rows.groupBy("emoji").agg(F.count(F.lit(1)).alias("n"))


# --- duplicates, sets, order -------------------------------------------------------------------
@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedupe_first_wins(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return dedupe.first_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""SELECT shortcode, origin, google_page FROM (SELECT *, 'reel' AS origin, 0 AS pr FROM discoveries WHERE post_type = 'reel' AND shortcode IS NOT NULL UNION ALL SELECT *, 'post' AS origin, 1 AS pr FROM discoveries WHERE post_type <> 'reel' AND shortcode IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY shortcode ORDER BY pr, discovered_at, google_page, url) = 1""")
def priority_union(spark, d):
    x = table(spark, d, "discoveries").where("shortcode is not null")
    a, b = x.where("post_type = 'reel'").withColumn("origin", F.lit("reel")), x.where("post_type <> 'reel'").withColumn("origin", F.lit("post"))
    return dedupe.priority_union([a, b], ["shortcode"], ["discovered_at", "google_page", "url"]).select("shortcode", "origin", "google_page")


@query("SELECT DISTINCT url FROM discoveries a WHERE url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM posts b WHERE b.post_url = a.url AND b.batch_no <= 10)")
def seen_anti_join(spark, d):
    """Against the posts of the first ten batches: what a run between batches would still have to visit."""
    p = table(spark, d, "posts").where("batch_no <= 10").select(F.col("post_url").alias("url"))
    return dedupe.unseen(table(spark, d, "discoveries").where("url is not null"), p, ["url"]).select("url").distinct()


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def membership_semi(spark, d):
    n = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(n, "c_nationkey", "left_semi").select("c_custkey")


@query("SELECT n_name, r_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, r_name")
def gazetteer_lookup(spark, d):
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"))


@query("SELECT post_key, comment_key, rank FROM (SELECT post_key, comment_key, row_number() OVER (PARTITION BY post_key ORDER BY likes DESC NULLS LAST, comment_key) AS rank FROM (SELECT DISTINCT post_key, comment_key, likes FROM comments WHERE post_key IS NOT NULL)) WHERE rank <= 5")
def comment_topk(spark, d):
    c = table(spark, d, "comments").where("post_key is not null").select("post_key", "comment_key", "likes").distinct()
    return dedupe.top_n(c, ["post_key"], [F.desc_nulls_last("likes"), F.asc("comment_key")], 5).select("post_key", "comment_key", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT count(*) AS kept FROM (SELECT DISTINCT post_key, lower(coalesce(author_name, '')) AS a, substr(coalesce(text, ''), 1, 80) AS t FROM comments)")
def comment_dedupe_prefix(spark, d):
    c = table(spark, d, "comments").select("post_key", dedupe.comment_key("author_name", "text").alias("k")).distinct()
    return c.agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT post_key, count(*) AS comments, sum(likes)::BIGINT AS likes FROM (SELECT DISTINCT post_key, comment_key, likes FROM comments WHERE post_key IS NOT NULL) GROUP BY post_key")
def comment_agg(spark, d):
    c = table(spark, d, "comments").where("post_key is not null").select("post_key", "comment_key", "likes").distinct()
    return c.groupBy("post_key").agg(F.count(F.lit(1)).alias("comments"), F.sum("likes").alias("likes"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events")
def position_rank(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", windows.position(["user_id"], [F.asc("ts"), F.asc("event_id")]).cast("bigint").alias("position"))


@query("SELECT 'ok' AS status, count(*) AS n FROM documents WHERE text IS NOT NULL AND trim(text) <> '' UNION ALL SELECT 'failed', count(*) FROM documents WHERE text IS NULL OR trim(text) = ''")
def status_split(spark, d):
    good, bad = dedupe.split_by(_docs(spark, d).select("text"), F.trim("text") != "")
    one = lambda df, s: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("status"), "n")
    return one(good, "ok").union(one(bad, "failed"))


@query("SELECT source, query, count(*) AS n FROM (SELECT 'documents' AS source, source AS query FROM documents UNION ALL SELECT 'posts', platform FROM posts) GROUP BY source, query")
def bag_union(spark, d):
    both = payloads.stamped({("documents", ""): _docs(spark, d).select(F.col("source").alias("t")), ("posts", ""): table(spark, d, "posts").select(F.col("platform").alias("t"))})
    return both.groupBy("source", F.col("t").alias("query")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT platform, count(*) FILTER (length(t) > 2 AND NOT noise) AS genuine, count(*) FILTER (noise) AS noise FROM (SELECT platform, t, t IN (" + ", ".join(q(x) for x in filters.CONTROLS) + r""") OR regexp_matches(t, '^[0-9.,\s]*$') OR regexp_matches(t, '^[0-9]+\s*(s|m|h|d|w|y|sec|min|hours?|days?|weeks?)(\s+ago)?$') OR regexp_matches(t, '^view (all )?[0-9,]+') AS noise FROM (SELECT platform, lower(trim(coalesce(text, ''))) AS t FROM comments)) GROUP BY platform""")
def comment_noise(spark, d):
    c = table(spark, d, "comments")
    return c.groupBy("platform").agg(F.count_if(filters.is_genuine(F.col("text"))).alias("genuine"), F.count_if(filters.is_noise(F.col("text"))).alias("noise"))


@query("SELECT CASE WHEN follower_count >= 100000 THEN 'macro' WHEN follower_count >= 10000 THEN 'micro' WHEN follower_count >= 5000 THEN 'nano' ELSE 'individual' END AS tier, count(*) AS posts, round(avg(CASE WHEN follower_count > 0 THEN round(coalesce(likes, 0)::DECIMAL(20,0) * 100 / follower_count, 2)::DOUBLE ELSE 0.0 END), 4) AS rate FROM posts GROUP BY 1")
def sql_functions(spark, d):
    filters.register(spark)
    return spark.sql("SELECT follower_tier(follower_count) AS tier, count(*) AS posts, round(avg(engagement_rate(likes, follower_count)), 4) AS rate FROM {posts} GROUP BY follower_tier(follower_count)", posts=table(spark, d, "posts"))


@query("SELECT account, count(*) FILTER (last < TIMESTAMP '2025-09-01' - INTERVAL 31 DAY + INTERVAL 1 DAY) AS stale FROM (SELECT account, date_trunc('day', max(crawled_at AT TIME ZONE 'UTC')) AS last FROM documents GROUP BY account) GROUP BY account")
def stale_accounts(spark, d):
    last = _docs(spark, d).groupBy("account").agg(F.max("crawled_at").alias("last"))
    return last.groupBy("account").agg(F.count_if(filters.stale(F.col("last"), F.lit("2025-09-01").cast("timestamp"))).alias("stale"))


@query("SELECT post_key, string_agg(location, ',' ORDER BY rank) AS locations FROM (SELECT post_key, x.location AS location, row_number() OVER (PARTITION BY post_key ORDER BY x.confidence DESC, x.location) AS rank FROM (SELECT post_key, unnest(geo_enrichment.top_signals) AS x FROM posts) WHERE x.location IS NOT NULL) WHERE rank <= 3 GROUP BY post_key")
def top_signals(spark, d):
    s = table(spark, d, "posts").select("post_key", fusion.best_signals(F.col("geo_enrichment.top_signals"), 3).alias("s")).where(F.size("s") > 0)
    return s.select("post_key", F.array_join(F.transform("s", lambda x: x["location"]), ",").alias("locations"))


@query("SELECT post_key, display AS location FROM (SELECT DISTINCT post_key, unnest(regexp_extract_all(lower(coalesce(caption, '')), '([\\p{L}]+)', 1)) AS w FROM posts) JOIN (SELECT DISTINCT lower(display) AS w, display FROM gazetteer) USING (w)")
def caption_places(spark, d):
    places = fusion.place_list(table(spark, d, "gazetteer"), ())
    return fusion.mentioned(table(spark, d, "posts"), "post_key", "caption", places).select("post_key", "location").distinct()


# --- totals, top lists, windows ----------------------------------------------------------------
@query("SELECT o_orderpriority, o_orderstatus, count(*) AS rows, round(sum(o_totalprice::DECIMAL(18,2)), 2)::DOUBLE AS price FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def totals_rollup(spark, d):
    o = table(spark, d, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    return summary.totals(o, ["o_orderpriority", "o_orderstatus"], ["price"]).withColumn("price", F.col("price").cast("double"))


@query("SELECT post_key, (coalesce(likes, 0) + 2 * coalesce(shares, 0) + coalesce(comments, 0))::DOUBLE AS engagement FROM posts WHERE platform = 'x' ORDER BY engagement DESC, post_key LIMIT 5")
def engagement_topk_x(spark, d):
    return summary.top_posts(table(spark, d, "posts").where("platform = 'x'"), {"likes": 1, "shares": 2, "comments": 1}, "post_key")


@query("SELECT post_key, (coalesce(likes, 0) + 3 * coalesce(shares, 0) + 0.01 * coalesce(views, 0))::DOUBLE AS engagement FROM posts WHERE platform = 'tiktok' ORDER BY engagement DESC, post_key LIMIT 5")
def engagement_topk_tiktok(spark, d):
    return summary.top_posts(table(spark, d, "posts").where("platform = 'tiktok'"), {"likes": 1, "shares": 3, "views": 0.01}, "post_key")


@query("SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS start, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-02-10' AND o_orderdate < TIMESTAMP '1996-03-05' GROUP BY 1")
def month_windows(spark, d):
    w = windows.month_windows(spark, "1995-02-10", "1996-03-05").withColumn("m", F.trunc("start", "MM"))
    o = table(spark, d, "orders").where((F.col("o_orderdate") >= F.lit("1995-02-10").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1996-03-05").cast("timestamp"))).withColumn("m", F.trunc("o_orderdate", "MM"))
    return o.join(F.broadcast(w), "m").groupBy(F.date_format("m", "yyyy-MM-dd").alias("start")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(s, '%Y-%m-%d') AS start, strftime(least(s + INTERVAL 7 DAY, DATE '1995-04-01'), '%Y-%m-%d') AS until FROM (SELECT unnest(generate_series(DATE '1995-01-03', DATE '1995-03-31', INTERVAL 7 DAY)) AS s)")
def week_windows(spark, d):
    return windows.week_windows(spark, "1995-01-03", "1995-04-01").select(F.date_format("start", "yyyy-MM-dd").alias("start"), F.date_format("end", "yyyy-MM-dd").alias("until"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'")
def date_range_filter(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp"), F.lit("1995-12-31").cast("timestamp"))).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, value AS best, second, value - coalesce(second, 0) AS margin FROM (SELECT user_id, value, lead(value) OVER w AS second, row_number() OVER w AS n FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)) WHERE n = 1")
def margin_best_second(spark, d):
    e = table(spark, d, "events").where("value is not null").select("user_id", "value", "event_id")
    return windows.margin(e, ["user_id"], "value", "event_id").select("user_id", F.col("value").alias("best"), "second", "margin")


_W = "CASE source " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in L.WEIGHTS.items()) + " ELSE 1.0 END"


@query(f"""WITH s AS (SELECT post_key, lower(trim(x.location)) AS location, x.confidence::DECIMAL(12,6) AS c, x.source AS source FROM (SELECT post_key, unnest(geo_enrichment.top_signals) AS x FROM posts) WHERE x.location IS NOT NULL AND x.confidence IS NOT NULL),
c AS (SELECT post_key, location, sum(c * ({_W})::DECIMAL(6,3)) * (CASE WHEN count(DISTINCT split_part(source, '_', 1)) >= 3 THEN 1.5 WHEN count(DISTINCT split_part(source, '_', 1)) = 2 THEN 1.2 ELSE 1.0 END) AS score, max(c)::DOUBLE AS m, count(*) AS n FROM s GROUP BY 1, 2),
r AS (SELECT *, score::DOUBLE AS sc, row_number() OVER w AS k, coalesce(lead(score::DOUBLE) OVER w, 0) AS second, sum(n) OVER (PARTITION BY post_key) AS total FROM c WINDOW w AS (PARTITION BY post_key ORDER BY score DESC, location))
SELECT post_key, location, round(least(least(m, 0.95) + 0.1 * (CASE WHEN sc > 0 THEN (sc - second) / sc ELSE 0 END), 0.99), 6) AS confidence, round(sc, 6) AS score, total::BIGINT AS signals_count FROM r WHERE k = 1""")
def evidence_fusion(spark, d):
    s = table(spark, d, "posts").select("post_key", F.explode("geo_enrichment.top_signals").alias("x")).select("post_key", "x.location", "x.confidence", "x.source")
    return fusion.fuse(s, "post_key").select("post_key", "location", F.round("confidence", 6).alias("confidence"), F.round("score", 6).alias("score"), "signals_count")


@query("""SELECT c_custkey AS key, arg_min(display, struct_pack(km := km, d := display)) AS place, round(min(km), 6) AS km FROM (
SELECT c_custkey, display, 2 * 6371 * asin(sqrt(least(pow(sin(radians(g.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - p.lon) / 2), 2), 1.0))) AS km
FROM (SELECT c_custkey, (c_custkey * 37 % 1000) / 100.0 - 5 AS lat, (c_custkey * 91 % 1000) / 100.0 + 33 AS lon FROM customer) p, gazetteer g) WHERE km <= 100 GROUP BY c_custkey""")
def nearest_neighbour(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), ((F.col("c_custkey") * 37 % 1000) / 100.0 - 5).alias("lat"), ((F.col("c_custkey") * 91 % 1000) / 100.0 + 33).alias("lon"))
    g = table(spark, d, "gazetteer").select(F.col("display").alias("place"), "lat", "lon")
    return fusion.nearest(p, g, "key", 100.0).select("key", "place", F.round("km", 6).alias("km"))


@query("SELECT off AS hours, count(*) FILTER (h BETWEEN 9 AND 21) AS peak, count(*) FILTER (h BETWEEN 7 AND 23 AND NOT h BETWEEN 9 AND 21) AS active FROM (SELECT off, ((hour(ts) + off) % 24 + 24) % 24 AS h FROM events, (VALUES (-5), (0), (3), (5)) AS o(off)) GROUP BY off")
def utc_offset_activity(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    r = spark.createDataFrame([(o, f"{o:+d}") for o in (-5, 0, 3, 5)], "offset int, region string")
    s = fusion.timing_signals(e, "event_id", "ts", r)
    return s.groupBy(F.col("location").cast("int").alias("hours")).agg(F.count_if(F.col("source") == "post_timing_peak").alias("peak"), F.count_if(F.col("source") == "post_timing_active").alias("active"))


@query("SELECT post_key, post_url, len(hashtags)::BIGINT AS tags FROM posts")
def flatten_csv_roundtrip(spark, d):
    p = table(spark, d, "posts").select("post_key", "post_url", "hashtags", "geo_enrichment", "comment_texts")
    back = files.unflattened(files.flattened(p), p.schema)
    return back.select("post_key", "post_url", F.when(F.col("hashtags").isNotNull(), F.size("hashtags")).cast("bigint").alias("tags"))


@query("SELECT url, shortcode, post_type FROM (SELECT DISTINCT 'https://www.instagram.example/' || regexp_extract(url, '/(p|reel)/([A-Za-z0-9_-]+)', 1) || '/' || regexp_extract(url, '/(p|reel)/([A-Za-z0-9_-]+)', 2) || '/' AS url, regexp_extract(url, '/(p|reel)/([A-Za-z0-9_-]+)', 2) AS shortcode, regexp_extract(url, '/(p|reel)/([A-Za-z0-9_-]+)', 1) AS post_type FROM discoveries WHERE regexp_matches(url, '/(p|reel)/[A-Za-z0-9_-]+'))")
def html_links(spark, d):
    pages = table(spark, d, "discoveries").select("google_page", F.concat(F.lit("<a href='"), "url", F.lit("'>found</a>")).alias("page"))
    return payloads.result_urls(pages, "google_page", "page").select("url", "shortcode", "post_type").distinct()


# --- event-time windows (an extension) -----------------------------------------------------------
def _events(spark, d) -> DataFrame:
    from mentionlake.streaming import ingest

    schema = table(spark, d, "events").schema
    return ingest.landing(spark, f"{d}/events*.parquet", schema, "parquet")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2")
def stream_tumbling(spark, d):
    from mentionlake.streaming import ingest

    s = ingest.tumbling(_events(spark, d), "ts", "1 day", ["event_type"])
    return ingest.drained(s, "tumbling").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, d):
    from mentionlake.streaming import ingest

    s = ingest.once(_events(spark, d), ["user_id", "event_type"], "ts", "400 days").select("user_id", "event_type")
    return ingest.drained(s, "dedupe")


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def batch_sessions(spark, d):
    from mentionlake.streaming import ingest

    s = ingest.sessions(table(spark, d, "events"), "ts", "6 hours", ["user_id"])
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY s")
def batch_sliding(spark, d):
    from mentionlake.streaming import ingest

    return ingest.sliding(table(spark, d, "events"), "ts", "12 hours", "6 hours").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
