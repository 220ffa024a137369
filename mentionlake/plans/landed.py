"""Queries of the sources, adapters, place signals and sinks, each with its SQL.

The tables hold posts and comments in one form; a query writes them as the payloads of a
dialect first and reads those by the operator, so its SQL can say what must come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionlake import lexicon as L
from mentionlake.functions import filters
from mentionlake.functions import text as X
from mentionlake.operators import adapters, annotate, dedupe, fusion, nlp, summary
from mentionlake.plans.catalogue import _COMMENTS, _KEYS, _TOWNS, _list, q, query
from mentionlake.session import cut, scratch, table
from mentionlake.sinks import files
from mentionlake.sources import payloads


def _s(**fields) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()])


def _payload(df: DataFrame, key: str, body: Column, *more: str) -> DataFrame:
    """(key, v): the body as JSON text, parsed as it would be on landing."""
    return df.select(key, *more, F.try_parse_json(F.to_json(body)).alias("v"))


def _posts(spark, d, platform: str | None = None) -> DataFrame:
    p = table(spark, d, "posts")
    return p.where(F.col("platform") == platform) if platform else p


def _unix(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp"))


_EPOCH = "floor(epoch(scraped_at))::BIGINT"


# --- payload sources -------------------------------------------------------------------------
@query(f"SELECT post_key, post_key::VARCHAR AS tweet_id, caption AS text, coalesce(username, '') AS author, coalesce(follower_count, 0) AS author_followers, coalesce(is_verified, false) AS is_verified, strftime(date_trunc('second', scraped_at AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M:%S') AS ts, coalesce(likes, 0) AS likes, coalesce(shares, 0) AS retweets, coalesce(comments, 0) AS replies, language_detected AS lang FROM posts WHERE platform = 'x' AND coalesce(caption, '') <> ''")
def search_tweets(spark, d):
    p = _posts(spark, d, "x")
    told = F.concat(F.lit("Sat "), F.date_format(F.col("scraped_at").cast("timestamp"), "MMM dd HH:mm:ss '+0000' yyyy"))
    legacy = _s(full_text="caption", favorite_count="likes", retweet_count="shares", reply_count="comments", lang="language_detected", created_at=told)
    user = _s(user_results=_s(result=_s(core=_s(screen_name=F.when(F.col("post_key") % 2 == 0, F.col("username"))), legacy=_s(screen_name="username", followers_count="follower_count"), is_blue_verified="is_verified")))
    tweet = _s(__typename=F.lit("Tweet"), rest_id=F.col("post_key").cast("string"), legacy=legacy, core=user)
    rows = payloads.tweets(_payload(p, "post_key", _s(data=_s(entries=F.array(_s(content=_s(tweet=tweet)))))), "post_key", "v")
    return rows.withColumns({"ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "is_verified": F.coalesce("is_verified", F.lit(False))})


_STORY_SQL = f"SELECT post_key, post_key::VARCHAR AS post_id, coalesce(nullif(trim(post_url), ''), '') AS post_url, CASE WHEN trim(coalesce(caption, '')) = '' THEN '' ELSE caption END AS text, {_EPOCH} AS created_time, coalesce(likes, 0) AS reactions, coalesce(comments, 0) AS comment_count, coalesce(shares, 0) AS shares FROM posts WHERE platform = 'facebook'"


def _story() -> Column:
    count = F.when(F.col("post_key") % 2 == 0, F.col("likes"))
    return _s(post_id=F.col("post_key").cast("string"), url="post_url", message=_s(text=F.coalesce("caption", F.lit(""))), created_time=_unix("scraped_at"), owner=_s(name="author_name"), reaction_count=_s(count=count), reactions="likes", comment_count="comments", share_count="shares")


@query(_STORY_SQL + f" AND {_EPOCH} BETWEEN 1754006400 AND 1756684800")
def feed_search(spark, d):
    edge = _s(rendering_strategy=_s(view_model=_s(click_model=_s(story=_story()))))
    body = _s(data=_s(serpResponse=_s(results=_s(edges=F.array(edge)))))
    nodes = payloads.feed_posts(_payload(_posts(spark, d, "facebook"), "post_key", body), "post_key", "v")
    return payloads.story_rows(nodes, "post_key", 1754006400, 1756684800).drop("author_name", "author_id")


@query(_STORY_SQL)
def feed_walk(spark, d):
    # Neither search nor hashtag results: any node like a post counts.
    nodes = payloads.feed_posts(_payload(_posts(spark, d, "facebook"), "post_key", _s(data=_s(viewer=_s(items=F.array(_s(node=_story())))))), "post_key", "v")
    return payloads.story_rows(nodes, "post_key").drop("author_name", "author_id")


@query(f"SELECT comment_key, comment_id, text, {_EPOCH} AS created_time, author_name, author_id, coalesce(likes, 0) AS likes FROM (SELECT DISTINCT * FROM comments) WHERE coalesce(text, '') <> ''")
def feed_comments(spark, d):
    c = table(spark, d, "comments").distinct()
    node = _s(id="comment_id", body=_s(text="text"), created_time=_unix("scraped_at"), author=_s(name="author_name", id="author_id"), likes="likes")
    return payloads.comment_rows(_payload(c, "comment_key", _s(feedback=_s(edges=F.array(_s(node=node))))), "comment_key", "v")


@query("SELECT comment_key, comment_id, author_name AS author, text, likes, coalesce(post_key, -1) AS replies FROM (SELECT DISTINCT comment_key, comment_id, author_name, text, likes, post_key FROM comments) WHERE coalesce(text, '') <> '' AND author_name IS NOT NULL")
def connection_comments(spark, d):
    c = table(spark, d, "comments").select("comment_key", "comment_id", "author_name", "text", "likes", "post_key").distinct()
    node = _s(pk="comment_id", user=_s(username="author_name"), text="text", comment_like_count="likes", child_comment_count="post_key")
    rows = payloads.connection_comments(_payload(c, "comment_key", _s(data=_s(comments=_s(edges=F.array(_s(node=node)))))), "comment_key", "v")
    return rows.select("comment_key", "comment_id", "author", "text", "likes", F.coalesce("replies", F.lit(-1)).alias("replies"))


@query("SELECT post_key, (i - 1)::INTEGER AS ord, post_key::VARCHAR || '-' || (i - 1) AS id FROM posts, (VALUES (1), (2)) AS v(i) WHERE platform = 'tiktok'")
def video_items(spark, d):
    item = lambda n: _s(id=F.concat(F.col("post_key").cast("string"), F.lit(f"-{n}")), desc="caption")
    body = F.when(F.col("post_key") % 2 == 0, F.to_json(_s(itemList=F.array(item(0), item(1), item(2))))).otherwise(F.to_json(_s(items=F.array(item(0), item(1), item(2)))))
    rows = payloads.video_items(_posts(spark, d, "tiktok").select("post_key", F.try_parse_json(body).alias("v")), "post_key", "v", 2)
    return rows.select("post_key", "ord", payloads.dig(F.col("node"), "id").alias("id"))


@query("SELECT post_key, c.author AS commenter, c.text AS text, c.like_count AS likes FROM (SELECT post_key, username, unnest(comment_texts) AS c FROM posts WHERE platform = 'tiktok') WHERE coalesce(c.like_count, 0) >= 2 AND lower(coalesce(c.author, '')) <> lower(coalesce(username, ''))")
def state_comments(spark, d):
    p = _posts(spark, d, "tiktok")
    each = F.transform("comment_texts", lambda c: F.struct(F.struct(c["author"].alias("unique_id")).alias("user"), c["text"].alias("text"), c["like_count"].alias("digg_count")))
    deep = F.struct(F.struct(F.struct(F.struct(F.struct(each.alias("commentList")).alias("itemStruct")).alias("itemInfo")).alias("videoDetail")).alias("webapp.video-detail"))
    flat = F.struct(F.struct(F.struct(F.struct(each.alias("commentList")).alias("itemStruct")).alias("itemInfo")).alias("webapp.video-detail"))
    body = F.when(F.col("post_key") % 2 == 0, F.to_json(F.struct(deep.alias("__DEFAULT_SCOPE__")))).otherwise(F.to_json(F.struct(flat.alias("__DEFAULT_SCOPE__"))))
    rows = p.select("post_key", F.col("username").alias("author"), F.try_parse_json(body).alias("v"))
    return payloads.state_comments(rows, "post_key", "v", "author", 2).select("post_key", "commenter", "text", "likes")


@query(r"SELECT comment_key, 0 AS ord, trim(author_name) AS author, trim(text) AS text, '3h' AS time, coalesce(likes, 0) AS likes FROM (SELECT DISTINCT comment_key, author_name, text, likes FROM comments) WHERE author_name IS NOT NULL AND text IS NOT NULL AND trim(text) <> '' AND NOT regexp_matches(text, '[<>&\x00-\x1f]') AND trim(text) = text")
def html_blocks(spark, d):
    c = table(spark, d, "comments").select("comment_key", "author_name", "text", "likes").distinct()
    c = c.where(F.col("author_name").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != "") & ~F.col("text").rlike(r"[<>&\x00-\x1f]") & (F.trim("text") == F.col("text")))
    page = F.concat(F.lit("<div><h3><a href='/u'>"), "author_name", F.lit("</a></h3><div>"), "text", F.lit("</div><abbr>3h</abbr><a href='/l'>"), F.coalesce("likes", F.lit(0)).cast("string"), F.lit(" likes</a></div>"))
    return payloads.html_comments(c.select("comment_key", page.alias("page")), "comment_key", "page")


@query(r"SELECT post_key, caption, likes, comments FROM (SELECT post_key, caption, likes, comments FROM posts) WHERE caption IS NOT NULL AND NOT regexp_matches(caption, '[\x22\x27<>&\n\r“”]') AND trim(caption) <> ''")
def page_fields(spark, d):
    p = _posts(spark, d).where(F.col("caption").isNotNull() & ~F.col("caption").rlike("[\"'<>&\\n\\r“”]") & (F.trim("caption") != ""))
    told = F.concat(F.coalesce(F.concat(F.format_number("likes", 0), F.lit(" likes, ")), F.lit("")), F.coalesce(F.concat(F.format_number("comments", 0), F.lit(" comments ")), F.lit("")), F.lit("- someone on May 1: “"), "caption", F.lit("”."))
    page = F.concat(F.lit('<meta property="og:description" content="'), told, F.lit('"/><meta property="og:title" content="Someone on Instagram: x"/>'))
    return payloads.page_fields(p.select("post_key", page.alias("page")), "post_key", "page").select("post_key", "caption", "likes", "comments")


@query("SELECT event_id, line::INTEGER AS line FROM (SELECT event_id, unnest([0, 2]) AS line FROM events WHERE props IS NOT NULL)")
def ndjson_lines(spark, d):
    e = table(spark, d, "events").where("props is not null").select("event_id", F.concat("props", F.lit("\n{broken\r\n"), "props").alias("body"))
    return payloads.ndjson(e, "body", "event_id").select("event_id", F.col("line").cast("int").alias("line"))


@query("SELECT post_key, '/more?page=' || post_key AS target FROM posts")
def next_links(spark, d):
    page = F.concat(F.lit("<a href='/a'>first</a><a class=x href='/more?page="), F.col("post_key").cast("string"), F.lit("'><b>View</b> more comments</a>"))
    return _posts(spark, d).select("post_key", payloads.next_link(page).alias("target"))


@query("SELECT post_key, comment_id, position::BIGINT AS position FROM (SELECT post_key, comment_id, row_number() OVER (PARTITION BY post_key ORDER BY k) AS position FROM (SELECT post_key, comment_id, min(comment_key) AS k FROM comments WHERE post_key IS NOT NULL AND coalesce(comment_id, '') <> '' GROUP BY 1, 2)) WHERE position <= 3")
def reply_collector(spark, d):
    c = table(spark, d, "comments").where("post_key is not null").select(F.col("post_key").cast("string").alias("root"), "comment_id", "comment_key")
    root = c.select("root", F.col("root").alias("comment_id"), F.lit(0).cast("bigint").alias("comment_key"))  # a thread begins with the post itself
    rows = dedupe.replies(c.union(root), "root", "comment_id", ["comment_key"], 3)
    return rows.select(F.col("root").cast("bigint").alias("post_key"), "comment_id", F.col("position").cast("bigint").alias("position"))


# --- adapters ----------------------------------------------------------------------------------
def _tags_sql(sep: str = "', '") -> str:
    return f"array_to_string(list_filter(hashtags, lambda h: h IS NOT NULL), {sep})"


def _flat(rows: DataFrame, *extra: Column) -> DataFrame:
    return rows.select("post_id", "text", F.col("engagement.likes").alias("likes"), F.col("engagement.comments").alias("comments"), F.col("engagement.shares").alias("shares"), F.col("engagement.total").alias("total"), F.size("comments").cast("bigint").alias("read"), *extra)


_READ = "len(list_filter(coalesce(comment_texts, []), lambda c: trim(coalesce(c.text, '')) <> ''))::BIGINT AS read"
_FLAT_SQL = f"CASE WHEN trim(coalesce(caption, '')) = '' THEN '' ELSE caption END AS text, likes, comments, shares, coalesce(likes, 0) + coalesce(comments, 0) + coalesce(shares, 0) AS total, {_READ}"


@query(f"SELECT coalesce(regexp_extract(post_url, '/(p|reel)/([A-Za-z0-9_-]+)', 2), '') AS post_id, {_FLAT_SQL}, CASE WHEN trim(coalesce(username, '')) = '' THEN '' ELSE username END AS username, coalesce(follower_count, -1) AS followers FROM posts WHERE platform = 'instagram'")
def adapt_instagram(spark, d):
    p = _posts(spark, d, "instagram")
    rec = _s(post_url="post_url", caption="caption", username="username", follower_count="follower_count", likes="likes", comments="comments", shares="shares", comment_texts="comment_texts")
    rows = adapters.canonical(_payload(p, "post_key", rec).withColumnRenamed("v", "post"), "instagram")
    return _flat(rows, F.col("author.username").alias("username"), F.coalesce("author.followers", F.lit(-1)).alias("followers"))


@query(f"SELECT coalesce(regexp_extract(post_url, '/status/([A-Za-z0-9_-]+)', 1), '') AS post_id, {_FLAT_SQL}, strftime(date_trunc('second', scraped_at AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M:%S') AS ts FROM posts WHERE platform = 'x'")
def adapt_x(spark, d):
    p = _posts(spark, d, "x")
    told = F.concat(F.lit("Sat "), F.date_format(F.col("scraped_at").cast("timestamp"), "MMM dd HH:mm:ss '+0000' yyyy"))
    rec = _s(post_url="post_url", caption="caption", post_date=told, likes="likes", replies="comments", retweets="shares", comments_json=F.to_json("comment_texts"))
    return _flat(adapters.canonical(_payload(p, "post_key", rec).withColumnRenamed("v", "post"), "x"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query(f"SELECT post_key::VARCHAR AS post_id, {_FLAT_SQL}, 'https://www.tiktok.example/@' || CASE WHEN trim(coalesce(username, '')) = '' THEN '' ELSE username END || '/video/' || post_key AS post_url, coalesce(views, -1) AS views FROM posts WHERE platform = 'tiktok'")
def adapt_tiktok(spark, d):
    p = _posts(spark, d, "tiktok")
    rec = _s(id=F.col("post_key").cast("string"), desc="caption", author=_s(uniqueId=F.when(F.trim("username") != "", F.col("username"))), stats=_s(diggCount="likes", commentCount="comments", shareCount="shares", playCount="views"), comments_data="comment_texts")
    rows = adapters.canonical(_payload(p, "post_key", rec).withColumnRenamed("v", "post"), "tiktok")
    return _flat(rows, "post_url", F.coalesce("engagement.views", F.lit(-1)).alias("views"))


@query(f"SELECT post_key::VARCHAR AS post_id, {_FLAT_SQL}, strftime(date_trunc('second', scraped_at AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M:%S') AS ts FROM posts WHERE platform = 'facebook'")
def adapt_facebook(spark, d):
    p = _posts(spark, d, "facebook")
    rec = _s(post_id="post_key", text="caption", created_time=_unix("scraped_at"), reactions="likes", comment_count="comments", shares="shares", top_comments="comment_texts")
    return _flat(adapters.canonical(_payload(p, "post_key", rec).withColumnRenamed("v", "post"), "facebook"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query(f"SELECT substr(md5(substr(caption, 1, 120)), 1, 16) AS post_id, {_FLAT_SQL}, strftime(date_trunc('second', scraped_at AT TIME ZONE 'UTC') - INTERVAL 3 DAY, '%Y-%m-%d %H:%M:%S') AS ts FROM posts WHERE trim(coalesce(caption, '')) <> ''")
def adapt_linkedin(spark, d):
    p = _posts(spark, d)
    at = F.date_format(F.col("scraped_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rec = _s(text="caption", time_text=F.lit("3d • Edited"), scraped_at=at, reactions="likes", comment_count="comments", reposts="shares", comments="comment_texts")
    return _flat(adapters.canonical(_payload(p, "post_key", rec).withColumnRenamed("v", "post"), "linkedin"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("SELECT count(*) AS read, count(*) FILTER (trim(coalesce(caption, '')) <> '') AS post_count, count(*) FILTER (trim(coalesce(caption, '')) = '') AS skipped FROM posts")
def skipped_counts(spark, d):
    rows = _payload(_posts(spark, d), "post_key", _s(text="caption")).withColumnRenamed("v", "post")
    posts, counts = adapters.normalized(rows, "linkedin")
    cut(posts.select("post_id"), "counted")
    n = counts()
    return spark.createDataFrame([(n["read"], n["post_count"], n["skipped"])], "read bigint, post_count bigint, skipped bigint")


# --- flat files ---------------------------------------------------------------------------------
_RATE_SQL = "CASE WHEN follower_count > 0 THEN round((coalesce(likes, 0) + coalesce(comments, 0))::DECIMAL(20,0) * 100 / follower_count, 2)::DOUBLE ELSE 0 END"


@query(f"SELECT coalesce(post_url, '') AS post_url, {_RATE_SQL} AS engagement_rate, CASE WHEN trim(coalesce(caption, '')) = '' THEN '' ELSE substr(caption, 1, 300) END AS caption, coalesce(post_type, '') AS post_type FROM posts WHERE platform = 'instagram'")
def csv_layout(spark, d):
    """Written as a CSV of a fixed layout, and read again."""
    p = _posts(spark, d, "instagram")
    rec = _s(post_url="post_url", post_type="post_type", caption="caption", username="username", follower_count="follower_count", likes="likes", comments="comments")
    path = scratch(spark, "csv")
    files.write_laid_out(adapters.canonical(_payload(p, "post_key", rec).withColumnRenamed("v", "post"), "instagram"), path, "demo")
    return files.read_csv(spark, path).select("post_url", F.col("engagement_rate").cast("double").alias("engagement_rate"), "caption", "post_type")


@query(f"SELECT post_key, caption, {_tags_sql()} AS tags, len(comment_texts)::BIGINT AS comments FROM posts")
def csv_roundtrip(spark, d):
    p = table(spark, d, "posts").select("post_key", "caption", "hashtags", "comment_texts")
    path = scratch(spark, "csv")
    files.write_csv(p, path)
    back = files.read_csv(spark, path, p.schema)
    return back.select("post_key", "caption", F.when(F.col("hashtags").isNotNull(), X.joined(F.filter("hashtags", lambda h: h.isNotNull()))).alias("tags"), F.when(F.col("comment_texts").isNotNull(), F.size("comment_texts")).cast("bigint").alias("comments"))


@query("SELECT url, min(shortcode) AS shortcode FROM discoveries WHERE url IS NOT NULL AND google_page > 2 AND url NOT IN (SELECT url FROM discoveries WHERE url IS NOT NULL AND google_page <= 2) GROUP BY url")
def discovery_checkpoint(spark, d):
    x = table(spark, d, "discoveries").where("url is not null").groupBy("url", F.col("google_page") > 2).agg(F.min("shortcode").alias("shortcode")).toDF("url", "late", "shortcode")
    path = scratch(spark, "seen")
    files.new_rows(x.where("not late").drop("late"), path, ["url"])
    return files.new_rows(x.where("late").drop("late"), path, ["url"])


# --- keys, URLs, times, predicates ----------------------------------------------------------------
@query("SELECT comment_key, substr(md5(coalesce(post_key::VARCHAR, '') || coalesce(text, '')), 1, 16) AS whole, substr(md5(coalesce(post_key::VARCHAR, '') || substr(coalesce(text, ''), 1, 60)), 1, 16) AS begin FROM comments")
def comment_ids(spark, d):
    post = F.col("post_key").cast("string")
    return table(spark, d, "comments").select("comment_key", X.comment_id(post, F.col("text")).alias("whole"), X.comment_id(post, F.col("text"), 60).alias("begin"))


@query("SELECT post_key, CASE WHEN platform IN ('x', 'tiktok', 'facebook') AND trim(coalesce(username, '')) <> '' THEN CASE platform WHEN 'x' THEN 'https://x.example/' || username || '/status/' || post_key WHEN 'tiktok' THEN 'https://www.tiktok.example/@' || username || '/video/' || post_key ELSE 'https://www.facebook.example/' || username || '/posts/' || post_key END END AS url, 'https://m.facebook.example/story.php?story_fbid=' || post_key || CASE WHEN post_key % 2 = 0 THEN '&id=' || post_key * 7 ELSE '' END AS story FROM posts")
def built_urls(spark, d):
    key = F.col("post_key").cast("string")
    permalink = F.when(F.col("post_key") % 2 == 0, F.concat(F.lit("https://facebook.example/permalink.php?story_fbid=pf&id="), (F.col("post_key") * 7).cast("string"))).otherwise(F.lit("https://facebook.example/a/posts/1"))
    return _posts(spark, d).select("post_key", X.post_url(F.col("platform"), F.col("username"), key).alias("url"), X.story_url(permalink, key).alias("story"))


@query("SELECT event_id, 4 * floor(epoch(ts))::BIGINT - 5 * 86400 AS seconds FROM events")
def parsed_times(spark, d):
    ts = F.col("ts").cast("timestamp")
    iso, unix = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.unix_seconds(ts).cast("string")
    ctime = F.concat(F.lit("Sat "), F.date_format(ts, "MMM dd HH:mm:ss '+0000' yyyy"))
    four = [X.from_iso(iso), X.from_unix(unix), X.from_ctime(ctime), X.from_age(F.lit("5d"), ts)]
    return table(spark, d, "events").select("event_id", sum((F.unix_seconds(t) for t in four[1:]), F.unix_seconds(four[0])).alias("seconds"))


_RESERVED = ", ".join(q(w) for w in filters.RESERVED)


@query(f"SELECT post_key, count(*) AS by_others, count(*) FILTER (regexp_full_match(coalesce(c.author, ''), '[A-Za-z0-9._]{{2,30}}') AND lower(coalesce(c.author, '')) NOT IN ({_RESERVED})) AS handles FROM (SELECT post_key, username, unnest(comment_texts) AS c FROM posts) WHERE lower(coalesce(c.author, '')) <> lower(coalesce(username, '')) AND coalesce(c.like_count, 0) >= 1 GROUP BY post_key")
def comments_by_others(spark, d):
    c = _posts(spark, d).select("post_key", "username", F.explode("comment_texts").alias("c"))
    kept = c.where(filters.by_another(F.col("c.author"), F.col("username"), F.col("c.like_count"), 1))
    return kept.groupBy("post_key").agg(F.count(F.lit(1)).alias("by_others"), F.count_if(filters.is_handle(F.coalesce("c.author", F.lit("")))).alias("handles"))


@query("SELECT doc_id FROM documents WHERE crawled_at BETWEEN TIMESTAMPTZ '2025-07-01 00:00:00+00' AND TIMESTAMPTZ '2025-08-01 12:00:00+00'")
def timeline_range(spark, d):
    return table(spark, d, "documents").where(filters.in_range(F.col("crawled_at").cast("timestamp"), "2025-07-01", "2025-08-01 12:00:00")).select("doc_id")


@query("SELECT count(*) AS kept, min(stage) AS first_stage, sum(comment_key)::BIGINT AS keys FROM (SELECT *, row_number() OVER (PARTITION BY post_key, text ORDER BY stage, comment_key) AS n FROM (SELECT post_key, text, comment_key, CASE WHEN likes >= 5 THEN 0 ELSE 1 END AS stage FROM comments)) WHERE n = 1")
def comment_stages(spark, d):
    c = table(spark, d, "comments").select("post_key", "text", "comment_key", F.when(F.col("likes") >= 5, 0).otherwise(1).alias("stage"))
    rows = dedupe.merged_comments([c.where("stage = 0"), c.where("stage = 1")], "post_key", "text", ["comment_key"])
    return rows.agg(F.count(F.lit(1)).alias("kept"), F.min("stage").alias("first_stage"), F.sum("comment_key").alias("keys"))


# --- reports ---------------------------------------------------------------------------------------
@query("SELECT hashtag, post_type, count(*) AS rows, count(shortcode) AS ok, count(*) - count(shortcode) AS failed, floor(epoch(max(discovered_at)))::BIGINT - floor(epoch(min(discovered_at)))::BIGINT AS seconds FROM discoveries GROUP BY ROLLUP (hashtag, post_type)")
def run_report(spark, d):
    return summary.run_report(table(spark, d, "discoveries"), F.col("shortcode").isNotNull(), ["hashtag", "post_type"], "discovered_at").select("hashtag", "post_type", "rows", "ok", "failed", "seconds")


@query("SELECT platform, count(*) FILTER (trim(coalesce(language_detected, '')) <> '') AS hinted, count(*) AS posts FROM posts GROUP BY platform")
def hinted_languages(spark, d):
    return summary.hinted(_posts(spark, d), "language_detected", ["platform"])


@query("SELECT platform, post_key, (coalesce(likes, 0) + 2 * coalesce(shares, 0) + coalesce(comments, 0))::DOUBLE AS engagement, row_number() OVER (PARTITION BY platform ORDER BY coalesce(likes, 0) + 2 * coalesce(shares, 0) + coalesce(comments, 0) DESC, post_key) AS rank FROM posts QUALIFY rank <= 5")
def top_posts_by_platform(spark, d):
    rows = summary.top_posts(_posts(spark, d), {"likes": 1, "shares": 2, "comments": 1}, "post_key", 5, ["platform"])
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT platform, count(*) AS rows, sum(coalesce(views, 0))::BIGINT AS plays, sum(coalesce(shares, 0))::BIGINT AS shares FROM posts GROUP BY ROLLUP (platform)")
def summary_totals(spark, d):
    """Plays and shares of the whole batch summary, from annotated posts."""
    p = _posts(spark, d).withColumns({"lang_hint": F.col("language_detected"), "engagement": F.struct("likes", "comments", "shares", "views")})
    out = nlp.annotate_nlp(annotate.annotate_rules(p.drop("language_detected")), 0, "lang_hint")
    return summary.summarize(out, ["platform"], key="post_key")["totals"]


# --- place signals -----------------------------------------------------------------------------------
_W = r"'([\p{L}\p{M}\p{N}_]+)'"
_COUNTRY = ", ".join(f"({q(n)}, {q(c)})" for n, c in L.COUNTRIES)
#: (name, location, level) as the operators read them.
_PLACES = f"""p AS (SELECT lower(display) AS name, CASE WHEN area_type = 'county' THEN 'country' ELSE 'city' END AS level, arg_min(display, ord) AS location FROM gazetteer GROUP BY 1, 2 UNION ALL SELECT lower(n), 'country', n FROM (VALUES {_COUNTRY}) AS v(n, c)),
n AS (SELECT array_to_string(regexp_extract_all(name, {_W}, 1), ' ') AS name, regexp_replace(lower(name), '\\s', '', 'g') AS w, location, level FROM p)"""


def _mentioned_sql(source: str, text: str) -> str:
    return f"SELECT key, name, location, level FROM (SELECT key, ' ' || array_to_string(regexp_extract_all(lower(coalesce({text}, '')), {_W}, 1), ' ') || ' ' AS t FROM {source}) JOIN n ON contains(t, ' ' || name || ' ')"


def _told(df: DataFrame) -> DataFrame:
    return df.groupBy("post_key", "location", F.round("confidence", 4).alias("confidence"), "source").agg(F.count(F.lit(1)).alias("signals"))


_SCRIPT_SQL = " UNION ALL ".join(f"SELECT key, {q(region)}, {c}, 'caption_text_language' FROM s WHERE regexp_matches(caption, '[{X.SCRIPTS[name]}]')" for name, region, c in L.SCRIPT_REGIONS)
_PHRASE_SQL = " UNION ALL ".join(rf"SELECT key, lower(trim(regexp_replace(m, '\s+', ' ', 'g'))) AS name, {c} AS c FROM (SELECT key, unnest(regexp_extract_all(coalesce(caption, ''), '(^|[^\p{{L}}\p{{M}}\p{{N}}_])({'|'.join(words)})\s+([A-Z][a-zA-Z\s]{{2,25}})', 3)) AS m FROM s)" for c, words in L.PLACE_PHRASES)


@query(f"""WITH {_PLACES}, s AS (SELECT post_key AS key, caption FROM posts), m AS ({_mentioned_sql('s', 'caption')}), a AS ({_PHRASE_SQL}),
f AS (SELECT name, arg_min(location, struct_pack(l := CASE WHEN level = 'city' THEN 0 ELSE 1 END, x := location)) AS location FROM p GROUP BY name),
u(key, location, confidence, source) AS (SELECT key, location, CASE WHEN level = 'city' THEN 0.7 ELSE 0.6 END, CASE WHEN level = 'city' THEN 'caption_text_city' ELSE 'caption_text_country' END FROM m
UNION ALL SELECT key, location, least(0.95, c + 0.1), 'caption_text_preposition' FROM a JOIN f USING (name) UNION ALL {_SCRIPT_SQL})
SELECT key AS post_key, location, round(confidence, 4)::DOUBLE AS confidence, source, count(*) AS signals FROM u GROUP BY ALL""")
def caption_signals(spark, d):
    places = fusion.place_list(table(spark, d, "gazetteer"))
    return _told(fusion.caption_signals(_posts(spark, d), "post_key", "caption", places))


_PATTERN_SQL = " UNION ALL ".join(f"SELECT post_key, i, regexp_extract(b, '^{p}', 1) AS w, 0.75 AS city, 0.5 AS country FROM t" for p in [p.replace(r"\w", r"[\p{L}\p{M}\p{N}_]") for p in L.PLACE_TAG_PATTERNS])


@query(f"""WITH {_PLACES}, t AS (SELECT post_key, i, replace(lower(coalesce(try(url_decode(trim(t))), t)), '#', '') AS b FROM (SELECT post_key, unnest(h) AS t, generate_subscripts(h, 1) AS i FROM (SELECT post_key, coalesce(hashtags, []) || CASE WHEN l IS NULL THEN [] ELSE ['#visit' || l, '#' || l || 'City', 'my%20' || l] END AS h FROM (SELECT post_key, hashtags, lower(geo_enrichment.top_signals[1].location) AS l FROM posts))) WHERE t IS NOT NULL),
h AS (SELECT post_key, location, CASE WHEN b = w THEN 1.0 ELSE 0 END + CASE WHEN level = 'city' AND b = w || 'city' THEN 1.0 ELSE 0 END + CASE WHEN level = 'city' AND length(b) < 30 AND contains(b, w) THEN 1.0 WHEN level = 'country' AND length(b) < 25 AND contains(b, w) THEN 0.5 ELSE 0 END
+ CASE WHEN starts_with(b, w) THEN CASE WHEN level = 'city' THEN 0.75 ELSE 0.5 END ELSE 0 END AS c FROM t, n WHERE contains(b, w)
UNION ALL SELECT post_key, location, CASE WHEN level = 'city' THEN city ELSE country END FROM ({_PATTERN_SQL}) JOIN n USING (w) WHERE w <> '')
SELECT post_key, location, round(least(0.35 + 0.15 * sum(c)::DECIMAL(10,4), 0.85), 2)::DOUBLE AS confidence, 'hashtag_analysis' AS source, 1::BIGINT AS signals FROM h WHERE c > 0 GROUP BY post_key, location""")
def hashtag_signals(spark, d):
    """Tags made of the first signal's place join those of a post."""
    place = F.lower(F.try_element_at("geo_enrichment.top_signals", F.lit(1))["location"])
    made = F.when(place.isNotNull(), F.array(F.concat(F.lit("#visit"), place), F.concat(F.lit("#"), place, F.lit("City")), F.concat(F.lit("my%20"), place))).otherwise(F.expr("cast(array() as array<string>)"))
    p = _posts(spark, d).select("post_key", F.concat(F.coalesce("hashtags", F.expr("cast(array() as array<string>)")), made).alias("tags"))
    return _told(fusion.hashtag_signals(p, "post_key", "tags", fusion.place_list(table(spark, d, "gazetteer"))))


def _keyword_sql() -> str:
    rows = []
    for i, (w, loc, c, kind) in enumerate(L.NAME_KEYWORDS):
        hit = f"ends_with(u, {q(w)})" if w.startswith("_") else f"contains(f, {q(w)})"
        ratio = f"{len(w)}.0 / greatest(length(f), 1)"
        more = f"CASE WHEN {ratio} > 0.5 THEN least({c} + 0.10, 0.90) WHEN {ratio} > 0.3 THEN least({c} + 0.05, 0.85) ELSE {c} END"
        less = f"greatest({more} - 0.05, 0.20)"
        rows.append(f"SELECT post_key, {q(loc)} AS location, CASE WHEN {hit} THEN {less if w.startswith('_') else more} ELSE {less} END AS c, 'username_{kind}' AS source, {i} AS o, {q(w)} AS name FROM b WHERE {hit} OR contains(a2, {q(w)})")
    return " UNION ALL ".join(rows)


_K = len(L.NAME_KEYWORDS)


@query(f"""WITH {_PLACES}, b AS (SELECT post_key, post_key AS key, lower(trim(username)) AS u, regexp_replace(lower(trim(username)), '[_.-]', '', 'g') AS f, lower(trim(coalesce(author_name, ''))) AS a, regexp_replace(lower(trim(coalesce(author_name, ''))), '[ _.|-]', '', 'g') AS a2 FROM posts WHERE trim(username) <> ''),
m AS ({_mentioned_sql('b', 'a')}),
x AS ({_keyword_sql()} UNION ALL SELECT post_key, location, CASE WHEN level = 'city' THEN CASE WHEN length(w) / greatest(length(f), 1) > 0.4 THEN 0.75 ELSE 0.65 END ELSE CASE WHEN length(w) / greatest(length(f), 1) > 0.3 THEN 0.65 ELSE 0.55 END END, 'username_' || level, {_K} + CASE WHEN level = 'city' THEN 0 ELSE 1 END, w FROM b JOIN n ON length(w) >= 4 AND contains(f, w)
UNION ALL SELECT key, location, CASE WHEN level = 'city' THEN 0.60 ELSE 0.50 END, 'username_' || level, {_K} + CASE WHEN level = 'city' THEN 2 ELSE 3 END, name FROM m WHERE level = 'city' OR length(name) >= 4)
SELECT post_key, location, round(c, 4)::DOUBLE AS confidence, source, 1::BIGINT AS signals FROM x QUALIFY row_number() OVER (PARTITION BY post_key, location ORDER BY c DESC, o, name DESC) = 1""")
def username_signals(spark, d):
    places = fusion.place_list(table(spark, d, "gazetteer"))
    return _told(fusion.username_signals(_posts(spark, d), "post_key", "username", places, "author_name"))


_FLAGS = ", ".join(f"({q(''.join(chr(0x1F1E6 + ord(x) - 65) for x in c))}, {q(n)})" for n, c in L.COUNTRIES)
_BIO_SQL = " UNION ALL ".join(rf"SELECT key, rtrim(trim(regexp_extract(caption, '(?i){p}\s*([A-Za-z\s,]{{3,30}})', 1)), ' .,!|•') AS location, {c} AS confidence, 'profile_bio_pattern' AS source FROM s" for p, c in L.BIO_PHRASES)


@query(f"""WITH {_PLACES}, s AS (SELECT post_key AS key, coalesce(caption, '') || CASE WHEN post_key % 5 = 0 THEN ' 🇰🇪🇰🇪' WHEN post_key % 5 = 1 THEN '🇺🇬' ELSE '' END AS caption FROM posts), m AS ({_mentioned_sql('s', 'caption')}),
u AS (SELECT key, location, CASE WHEN level = 'city' THEN 0.75 ELSE 0.6 END AS confidence, 'profile_bio_' || level AS source FROM m UNION ALL SELECT * FROM ({_BIO_SQL}) WHERE location <> '' UNION ALL SELECT key, n, 0.65, 'profile_bio_flag' FROM s JOIN (VALUES {_FLAGS}) AS fl(f, n) ON contains(caption, f))
SELECT key AS post_key, location, confidence::DOUBLE AS confidence, source, count(*) AS signals FROM u GROUP BY ALL""")
def bio_signals(spark, d):
    """Captions stand in for self-descriptions, with a flag put after some."""
    flag = F.when(F.col("post_key") % 5 == 0, F.lit(" 🇰🇪🇰🇪")).when(F.col("post_key") % 5 == 1, F.lit("🇺🇬")).otherwise(F.lit(""))
    p = _posts(spark, d).select("post_key", F.concat(F.coalesce("caption", F.lit("")), flag).alias("bio"))
    return _told(fusion.bio_signals(p, "post_key", "bio", fusion.place_list(table(spark, d, "gazetteer"))))


@query("""WITH s AS (SELECT post_key, x.location AS location, x.confidence AS confidence, x.source AS source FROM (SELECT post_key, unnest(geo_enrichment.top_signals) AS x FROM posts) WHERE x.location IS NOT NULL AND x.confidence IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY post_key ORDER BY confidence DESC, location, source) AS n FROM s)
SELECT post_key, count(*) AS signals_count, string_agg(location || ':' || source, ',' ORDER BY n) FILTER (n <= 3) AS top FROM r GROUP BY post_key""")
def geo_results(spark, d):
    s = _posts(spark, d).select("post_key", F.explode("geo_enrichment.top_signals").alias("x")).select("post_key", "x.location", "x.confidence", "x.source")
    r = fusion.geo_result(s, "post_key")
    return r.select("post_key", "signals_count", F.array_join(F.transform("top_signals", lambda t: F.concat(t["location"], F.lit(":"), t["source"])), ",").alias("top"))


@query(rf"WITH {_TOWNS}, w AS (SELECT post_key, ' ' || array_to_string(regexp_extract_all(lower(coalesce(caption, '')), {_W}, 1), ' ') || ' ' AS t FROM posts) SELECT post_key, min(ord) AS ord FROM w JOIN towns ON contains(t, ' ' || array_to_string(regexp_extract_all(k, {_W}, 1), ' ') || ' ') GROUP BY post_key")
def caption_first_place(spark, d):
    towns = annotate._towns(table(spark, d, "gazetteer"))
    return _posts(spark, d).select("post_key", annotate.first_place("caption", towns).alias("ord")).where("ord is not null")


# --- scores of comments, emoji ------------------------------------------------------------------------
_NOTED = _KEYS.replace("doc_id, source, text", "doc_id, i, text").replace("FROM documents", "FROM noted").replace("doc_id, source, text, t", "doc_id, i, text, t")


@query(f"""WITH noted AS (SELECT post_key AS doc_id, i, c.text AS text FROM (SELECT post_key, unnest(comment_texts) AS c, generate_subscripts(comment_texts, 1) AS i FROM posts) WHERE i <= 20 AND length(trim(coalesce(c.text, ''))) >= 5),
k AS (SELECT doc_id, i, text, CASE WHEN len(pos) + len(neg) = 0 THEN 0.0 ELSE round((len(pos) - len(neg))::DECIMAL(18,6) / (len(pos) + len(neg)), 4)::DOUBLE END AS score FROM ({_NOTED}))
SELECT doc_id AS post_key, i::BIGINT AS n, score, CASE WHEN score > 0.25 THEN 'positive' WHEN score < -0.25 THEN 'negative' ELSE 'neutral' END AS label, substr(text, 1, 100) AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM k) k2(doc_id, i0, text, score, i)""")
def comment_sentiments(spark, d):
    p = _posts(spark, d)
    rows = p.select("post_key", F.posexplode(nlp.comment_details(p, "comment_texts", 20)).alias("n", "c"))
    return rows.select("post_key", (F.col("n") + 1).cast("bigint").alias("n"), "c.score", "c.label", "c.text")


_EMOJI = "'([\\x{1F300}-\\x{1F5FF}\\x{1F600}-\\x{1F64F}\\x{1F680}-\\x{1F6FF}\\x{1F900}-\\x{1F9FF}\\x{2600}-\\x{26FF}\\x{2700}-\\x{27BF}])'"
_SIGN = "CASE e " + " ".join(f"WHEN {q(e)} THEN {n}" for e, n in L.EMOJI.items()) + " ELSE 0 END"


@query(f"""WITH e AS (SELECT post_key, e, count(*) AS n, {_SIGN} AS s FROM (SELECT post_key, unnest(regexp_extract_all(coalesce(caption, ''), {_EMOJI}, 1)) AS e FROM posts) GROUP BY post_key, e),
r AS (SELECT *, row_number() OVER (PARTITION BY post_key ORDER BY n DESC, e) AS k FROM e)
SELECT post_key, sum(n)::BIGINT AS total, count(*) AS kinds, coalesce(sum(n) FILTER (s = 1), 0)::BIGINT AS positive, coalesce(sum(n) FILTER (s = -1), 0)::BIGINT AS negative, round(CASE WHEN coalesce(sum(n) FILTER (s <> 0), 0) > 0 THEN sum(n * s)::DECIMAL(18,4) / sum(n) FILTER (s <> 0) ELSE 0 END, 2)::DOUBLE AS score, string_agg(e || n, ',' ORDER BY k) FILTER (k <= 5) AS top FROM r GROUP BY post_key""")
def emoji_summary(spark, d):
    rows = _posts(spark, d).select("post_key", annotate.emoji_summary("caption").alias("e")).where("e.total > 0")
    big = lambda c: F.col(f"e.{c}").cast("bigint")
    top = F.array_join(F.transform("e.top", lambda t: F.concat(t["emoji"], t["count"].cast("string"))), ",")
    return rows.select("post_key", big("total").alias("total"), big("distinct").alias("kinds"), big("positive").alias("positive"), big("negative").alias("negative"), F.col("e.score").alias("score"), top.alias("top"))
