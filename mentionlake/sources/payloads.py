"""Landed payloads: JSON documents and envelopes, newline-delimited JSON, HTML pages.

Trees are walked with VARIANT functions inside the JVM, by a fold over the levels of a
payload to a fixed depth.  Broken payloads give no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.functions import text as X
from mentionlake.functions.binding import let
from mentionlake.operators.shred import as_list, kind, member, text


def dig(v: Column, path: str, kind_: str = "string") -> Column:
    """A member of a VARIANT by path, null where the path or the type does not fit."""
    return F.try_variant_get(v, f"$.{path}", kind_)


def load_posts(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, ord, post VARIANT) of files that hold a list of posts or an envelope with ``posts``."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_file"), F.try_parse_json("value").alias("v"))
    start = F.when(kind(F.col("v")) == "object", F.coalesce(member(F.col("v"), "posts"), F.col("v"))).otherwise(F.col("v"))
    rows = whole.where(F.col("v").isNotNull()).select("source_file", F.posexplode(as_list(start)).alias("ord", "post"))
    return rows.where(kind(F.col("post")) == "object")


def ndjson(df: DataFrame, body: str, key: str) -> DataFrame:
    """(key, line, v): one row for each line that is JSON; broken lines are left out."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(body), F.lit("")), r"\r?\n")).alias("line", "_t"))
    return lines.select(key, "line", F.try_parse_json("_t").alias("v")).where(F.col("v").isNotNull())


def walk(df: DataFrame, key: str, v: str, match, max_depth: int = 12) -> DataFrame:
    """(key, depth, path, node): nodes for which ``match`` holds, to ``max_depth`` levels below
    the root; a node that matches is not searched further.

    A fold over the depths inside the row: it holds the nodes of one level and what was found
    above it, so each payload is read and parsed once, whatever the depth.
    """
    node = "struct<path:string,node:variant>"
    empty = lambda t: F.expr(f"cast(array() as array<{t}>)")

    def below(n: Column) -> Column:
        items, members = F.try_variant_get(n["node"], "$", "array<variant>"), F.try_variant_get(n["node"], "$", "map<string,variant>")
        by_place = lambda x, i: F.struct(F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")).alias("path"), x.alias("node"))
        by_name = lambda e: F.struct(F.concat(n["path"], F.lit("."), e["key"]).alias("path"), e["value"].alias("node"))
        return F.coalesce(F.transform(items, by_place), F.transform(F.map_entries(members), by_name), empty(node))

    def step(state: Column, depth: Column) -> Column:
        judged = F.transform(state["level"], lambda n: F.struct(F.coalesce(match(n["node"]), F.lit(False)).alias("hit"), n.alias("n")))

        def parted(j: Column) -> Column:
            hits = F.transform(F.filter(j, lambda x: x["hit"]), lambda x: F.struct(depth.alias("depth"), x["n"]["path"].alias("path"), x["n"]["node"].alias("node")))
            rest = F.when(depth < max_depth, F.flatten(F.transform(F.filter(j, lambda x: ~x["hit"]), lambda x: below(x["n"])))).otherwise(empty(node))
            return F.struct(rest.alias("level"), F.concat(state["found"], hits).alias("found"))

        return let(judged, parted)

    start = F.struct(F.array(F.struct(F.lit("$").alias("path"), F.col(v).alias("node"))).alias("level"), empty("struct<depth:int,path:string,node:variant>").alias("found"))
    found = F.aggregate(F.sequence(F.lit(0), F.lit(max_depth)), start, step, lambda s: s["found"])
    return df.where(F.col(v).isNotNull()).select(key, F.explode(found).alias("_f")).select(key, "_f.depth", "_f.path", "_f.node")


def is_tweet(v: Column) -> Column:
    return (dig(v, "__typename") == "Tweet") & (F.coalesce(dig(v, "legacy.full_text"), F.lit("")) != "")


def tweets(df: DataFrame, key: str, v: str) -> DataFrame:
    """Tweets at any depth of a search response; the handle comes from core, else from legacy."""
    n = F.col("node")
    user = "core.user_results.result"
    return walk(df, key, v, is_tweet).select(
        key, dig(n, "rest_id").alias("tweet_id"), dig(n, "legacy.full_text").alias("text"),
        F.coalesce(X.empty_to_null(dig(n, f"{user}.core.screen_name")), X.empty_to_null(dig(n, f"{user}.legacy.screen_name")), F.lit("")).alias("author"),
        F.coalesce(dig(n, f"{user}.legacy.followers_count", "bigint"), F.lit(0)).alias("author_followers"), dig(n, f"{user}.is_blue_verified", "boolean").alias("is_verified"),
        X.from_ctime(dig(n, "legacy.created_at")).alias("ts"), *[F.coalesce(dig(n, f"legacy.{a}_count", "bigint"), F.lit(0)).alias(b) for a, b in (("favorite", "likes"), ("retweet", "retweets"), ("reply", "replies"))],
        dig(n, "legacy.lang").alias("lang"),
    )


def is_story(v: Column) -> Column:
    return dig(v, "created_time", "bigint").isNotNull() & (member(v, "message").isNotNull() | (kind(member(v, "story")) == "object"))


def is_comment(v: Column) -> Column:
    return dig(v, "created_time", "bigint").isNotNull() & (F.coalesce(dig(v, "body.text"), F.lit("")) != "")


def feed_posts(df: DataFrame, key: str, v: str) -> DataFrame:
    """Posts of a feed: search results, else hashtag results, else any node like a post."""
    edges = lambda *path: as_list(_down(F.col(v), path))
    search = F.transform(edges("data", "serpResponse", "results", "edges"), lambda e: _down(e, ("rendering_strategy", "view_model", "click_model", "story")))
    tags = F.flatten(F.transform(edges("data", "topic_deep_dive", "rendering_strategies", "edges"), lambda e: F.array(_down(e, ("rendering_strategy", "explore_view_model", "story")))))
    some = lambda a: F.filter(a, lambda x: x.isNotNull())
    first = df.select(key, v, F.when(F.size(some(search)) > 0, some(search)).when(F.size(some(tags)) > 0, some(tags)).alias("_s"))
    direct = first.where(F.col("_s").isNotNull()).select(key, F.explode("_s").alias("node"))
    rest = walk(first.where(F.col("_s").isNull()), key, v, is_story).select(key, "node")
    return direct.union(rest)


def _down(v: Column, path) -> Column:
    return F.try_variant_get(v, "$." + ".".join(path), "variant")


def story_rows(nodes: DataFrame, key: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Post nodes as rows; alternatives of a field are tried in turn; the time range is inclusive."""
    n = F.col("node")
    some = lambda *paths: F.coalesce(*[X.empty_to_null(text(dig(n, p, "variant"))) for p in paths], F.lit(""))
    reactions = F.coalesce(dig(n, "reaction_count.count", "bigint"), dig(n, "reaction_count", "bigint"), dig(n, "reactions", "bigint"))
    top = F.aggregate(F.transform(as_list(_down(n, ("top_reactions", "edges"))), lambda e: F.coalesce(dig(e, "reaction_count", "bigint"), F.lit(0))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    told = X.parse_count(dig(n, "i18n_reaction_count"))
    rows = nodes.select(
        key, some("post_id", "id", "legacy_story_id").alias("post_id"), some("url", "permalink_url", "link").alias("post_url"), some("message.text", "message", "story.text").alias("text"),
        dig(n, "created_time", "bigint").alias("created_time"), some("owner.name", "author.name", "from.name").alias("author_name"), some("owner.id", "author.id", "from.id").alias("author_id"),
        F.coalesce(reactions, F.when(top > 0, top), told, F.lit(0)).alias("reactions"),
        F.coalesce(dig(n, "comment_count", "bigint"), dig(n, "comments.total_count", "bigint"), F.lit(0)).alias("comment_count"), F.coalesce(dig(n, "share_count", "bigint"), dig(n, "shares", "bigint"), F.lit(0)).alias("shares"),
    )
    keep = F.lit(True)
    if lo is not None:
        keep = keep & (F.col("created_time") >= lo)
    if hi is not None:
        keep = keep & (F.col("created_time") <= hi)
    return rows.where(keep)


def comment_rows(df: DataFrame, key: str, v: str) -> DataFrame:
    """Comment nodes at any depth; those without text are left out."""
    n = F.col("node")
    return walk(df, key, v, is_comment).select(key, dig(n, "id").alias("comment_id"), dig(n, "body.text").alias("text"), dig(n, "created_time", "bigint").alias("created_time"), dig(n, "author.name").alias("author_name"), dig(n, "author.id").alias("author_id"), F.coalesce(dig(n, "likes", "bigint"), F.lit(0)).alias("likes"))


def connection_comments(df: DataFrame, key: str, v: str) -> DataFrame:
    """Comments of a connection: nodes below ``edges[].node`` with a user and a text."""
    ok = lambda x: (F.coalesce(dig(x, "text"), F.lit("")) != "") & dig(x, "user.username").isNotNull()
    n = F.col("node")
    return walk(df, key, v, ok).select(key, dig(n, "pk").alias("comment_id"), dig(n, "user.username").alias("author"), dig(n, "user.is_verified", "boolean").alias("verified"), dig(n, "text").alias("text"), dig(n, "created_at", "bigint").alias("created_at"), dig(n, "comment_like_count", "bigint").alias("likes"), dig(n, "child_comment_count", "bigint").alias("replies"))


def video_items(df: DataFrame, key: str, v: str, most: int | None = None) -> DataFrame:
    """Items of a feed response (``itemList``, else ``items``), the first ``most`` of each."""
    items = F.coalesce(member(F.col(v), "itemList"), member(F.col(v), "items"))
    rows = df.select(key, F.posexplode(as_list(items)).alias("ord", "node")).where(kind(F.col("node")) == "object")
    return rows.where(F.col("ord") < most) if most is not None else rows


def state_comments(df: DataFrame, key: str, v: str, author: str, least_likes: int = 0) -> DataFrame:
    """Comments in a page's state under either of two paths, without the author's own."""
    scope = "__DEFAULT_SCOPE__"
    at = lambda mid: F.expr(f"""try_variant_get({v}, '$.{scope}["webapp.video-detail"]{mid}.itemInfo.itemStruct.commentList', 'variant')""")
    rows = df.select(key, author, F.explode(as_list(F.coalesce(at(".videoDetail"), at("")))).alias("n"))
    rows = rows.select(key, author, dig(F.col("n"), "user.unique_id").alias("commenter"), dig(F.col("n"), "text").alias("text"), F.coalesce(dig(F.col("n"), "digg_count", "bigint"), F.lit(0)).alias("likes"))
    return rows.where((F.col("likes") >= least_likes) & (F.lower(F.coalesce("commenter", F.lit(""))) != F.lower(F.coalesce(F.col(author), F.lit("")))))


def result_urls(df: DataFrame, key: str, page: str) -> DataFrame:
    """(key, url, shortcode, post_type): distinct photo and reel links of a result page."""
    found = F.regexp_extract_all(F.coalesce(F.col(page), F.lit("")), F.lit(r"(/(?:p|reel)/[A-Za-z0-9_-]+)"), F.lit(1))
    rows = df.select(key, F.explode(F.array_distinct(found)).alias("_u"))
    return rows.select(key, X.canonical_url(F.col("_u")).alias("url"), X.shortcode(F.col("_u")).alias("shortcode"), F.regexp_extract("_u", "/(p|reel)/", 1).alias("post_type"))


def meta(page: Column, name: str) -> Column:
    """Content of an ``og:`` tag of a page."""
    return X.empty_to_null(F.regexp_extract(page, rf"""<meta[^>]+property=["']og:{name}["'][^>]+content=["']([^"']*)["']""", 1))


def next_link(page: Column, words: str = "more|next|zaidi") -> Column:
    """Target of the first link whose text says that there is more."""
    return X.empty_to_null(F.regexp_extract(page, rf"""(?is)<a[^>]+href=["']([^"']+)["'][^>]*>(?:(?!</a>).)*(?:{words})""", 1))


def page_fields(df: DataFrame, key: str, page: str) -> DataFrame:
    """Fields of a landed post page, from its ``og:`` and other meta tags and its time and link
    elements: caption, likes, comments, views, post_date, location, post_type, image, author,
    username and profile_url; null where the page does not tell."""
    p = F.col(page)
    about = F.coalesce(meta(p, "description"), F.lit(""))
    title = meta(p, "title")
    count = lambda word: X.parse_count(F.regexp_extract(about, rf"(?i)([0-9][0-9.,]*[KMB]?)\s+{word}", 1))
    url = meta(p, "url")
    handle = F.coalesce(X.empty_to_null(F.regexp_extract(about, r"\(@([A-Za-z0-9._]+)\)", 1)), X.empty_to_null(F.regexp_extract(about, r"-\s+([A-Za-z0-9._]+)\s+(?:on|am|le)\s", 1)))
    kind_ = F.when(F.contains(url, F.lit("/reel/")), "reel").when(meta(p, "video").isNotNull(), "video").when(p.rlike(r"(?i)carousel|sidecar"), "carousel").when(meta(p, "image").isNotNull(), "photo")
    return df.select(
        key,
        F.coalesce(X.empty_to_null(F.regexp_extract(about, r"(?s):\s*(?:[\"“”]|&quot;)(.*)(?:[\"“”]|&quot;)\.?\s*$", 1)), X.empty_to_null(F.regexp_extract(title, r"(?s):\s*[\"“](.*)[\"”]", 1)), title).alias("caption"),
        count("likes?").alias("likes"), count("comments?").alias("comments"), count("(?:views?|plays?)").alias("views"),
        X.from_iso(F.regexp_extract(p, r"""<time[^>]+datetime=["']([^"']+)["']""", 1)).alias("post_date"),
        X.empty_to_null(F.regexp_extract(p, r"""<a[^>]+href=["'][^"']*/explore/locations/[^"']*["'][^>]*>([^<]+)<""", 1)).alias("location"),
        kind_.alias("post_type"), meta(p, "image").alias("image"), X.empty_to_null(F.regexp_extract(title, r"^(.+?)\s+(?:on|auf|sur)\s+\w+\s*:", 1)).alias("author"),
        handle.alias("username"), F.concat(F.lit("https://www.instagram.example/"), handle, F.lit("/")).alias("profile_url"),
    )


class _Blocks(HTMLParser):
    """div > h3 > a (author), text, abbr (time) and a link that counts likes."""

    def __init__(self) -> None:
        super().__init__()
        self.stack: list[str] = []
        self.rows: list[dict] = []

    def handle_starttag(self, tag, attrs):
        self.stack.append(tag)
        if tag == "h3":
            self.rows.append({"author": "", "text": "", "time": "", "likes": 0})

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack and self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        data = html.unescape(data).strip()
        if not data or not self.rows:
            return
        row = self.rows[-1]
        if "h3" in self.stack:
            row["author"] += data
        elif "abbr" in self.stack:
            row["time"] += data
        elif "a" in self.stack:
            row["likes"] = max(row["likes"], int(re.sub(r"\D", "", data) or 0))
        elif not row["time"]:
            row["text"] = f"{row['text']} {data}".strip()


def html_comments(df: DataFrame, key: str, page: str) -> DataFrame:
    """(key, ord, author, text, time, likes) of comment blocks; a page is parsed in one worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, p in zip(b["k"], b["p"]):
                blocks = _Blocks()
                blocks.feed(p or "")
                out += [(k, i, r["author"], r["text"], r["time"], r["likes"]) for i, r in enumerate(blocks.rows) if r["text"]]
            yield pd.DataFrame(out, columns=["k", "ord", "author", "text", "time", "likes"]).astype({"ord": "int32", "likes": "int64"})

    kind_ = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(page).alias("p")).mapInPandas(run, f"k {kind_}, ord int, author string, text string, time string, likes bigint").withColumnRenamed("k", key)


def stamped(parts: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Union of per-target reads, each with its source and query."""
    out = None
    for (source, query), df in parts.items():
        df = df.withColumns({"source": F.lit(source), "query": F.lit(query)})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


