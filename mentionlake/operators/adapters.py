"""Five dialects of post records mapped into the canonical schema.

Records come as VARIANT (so that a field may be a text in one record and an object in the
next); missing, null and empty fields are told apart only where the schema needs it.  A
record without the id or text that its dialect requires is skipped; ``skipped`` counts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mentionlake.functions import text as X
from mentionlake.operators.shred import as_list, kind, member
from mentionlake.schema import AUTHOR, COMMENT, ENGAGEMENT, MUSIC, POST


def _g(v: Column, path: str, kind_: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind_)


def _n(v: Column, *paths: str) -> Column:
    return F.coalesce(*[_g(v, p, "bigint") for p in paths])


def _s(v: Column, *paths: str) -> Column:
    return F.coalesce(*[X.empty_to_null(_g(v, p)) for p in paths], F.lit(""))


def _tags(v: Column, path: str) -> Column:
    """Tags of a list or of one joined string: lower case, without the sign, in order, once."""
    raw = _g(v, path, "variant")
    each = F.when(kind(raw) == "array", F.transform(as_list(raw), lambda t: F.try_variant_get(t, "$", "string"))).otherwise(F.split(F.coalesce(F.try_variant_get(raw, "$", "string"), F.lit("")), r"\s+"))
    clean = F.transform(F.filter(each, lambda t: t.isNotNull()), lambda t: F.lower(F.regexp_replace(X.percent_decoded(F.trim(t)), "^[#@]+", "")))
    return F.array_distinct(F.filter(clean, lambda t: t != ""))


def _comments(v: Column, *names: str) -> Column:
    """Comments of a list, a lone object or JSON text; those without text are left out."""
    raw = F.coalesce(*[member(v, n) for n in names])

    def one(c: Column, i: Column) -> Column:
        said = F.coalesce(X.empty_to_null(_g(c, "text")), X.empty_to_null(_g(c, "comment")), F.when(kind(c) == "scalar", F.try_variant_get(c, "$", "string")), F.lit(""))
        ts = F.coalesce(X.from_unix(_g(c, "created_at")), X.from_unix(_g(c, "created_time")), X.from_unix(_g(c, "timestamp")), X.from_iso(_g(c, "timestamp")), X.from_iso(_g(c, "created_at")))
        author = F.coalesce(X.empty_to_null(_g(c, "author.username")), F.when(kind(member(c, "author")) == "scalar", _g(c, "author")), _g(c, "author_name"), F.lit(""))
        return F.struct(
            F.coalesce(_g(c, "comment_id"), _g(c, "reply_id")).alias("comment_id"), author.alias("author"), _g(c, "author_id").alias("author_id"), said.alias("text"), F.coalesce(_n(c, "likes", "like_count"), F.lit(0)).alias("likes"),
            _n(c, "reply_count").alias("replies"), ts.alias("ts"), F.coalesce(_n(c, "position").cast("int"), i + 1).alias("position"), F.coalesce(_g(c, "author_verified", "boolean"), _g(c, "author.verified", "boolean")).alias("verified"),
        ).cast(COMMENT)

    return F.filter(F.transform(as_list(raw), one), lambda c: F.trim(c["text"]) != "")


def _post(v: Column, platform: str, **f: Column) -> list[Column]:
    text = f["text"]
    likes, comments, shares, views = (F.coalesce(f.get(k, F.lit(None)), F.lit(None)).cast("bigint") for k in ("likes", "comment_count", "shares", "views"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    null = lambda t: F.lit(None).cast(t)
    tags = f.get("hashtags")
    tags = F.when(F.size(tags) > 0, tags).otherwise(F.array_distinct(X.hashtags(text))) if tags is not None else F.array_distinct(X.hashtags(text))
    author = F.struct(*[F.coalesce(f.get(k, F.lit(None)), F.lit(None)).cast(t).alias(n) for k, n, t in (("author_id", "id", "string"), ("username", "username", "string"), ("author_name", "name", "string"), ("author_url", "url", "string"), ("followers", "followers", "bigint"), ("following", "following", "bigint"), ("posts", "posts", "bigint"), ("verified", "verified", "boolean"))])
    values = {
        "platform": F.lit(platform), "post_id": f["post_id"], "post_url": f["post_url"], "source_type": _s(v, "source", "source_type"), "query": _s(v, "query", "source_hashtag", "hashtag_source"), "source_window": _s(v, "source_window"),
        "author": author.cast(AUTHOR), "text": text, "lang_hint": f.get("lang", F.lit("")), "ts": f.get("ts", null("timestamp")), "ts_raw": f.get("ts_raw", null("string")), "scraped_at": X.from_iso(_g(v, "scraped_at")),
        "hashtags": tags, "mentions": F.array_distinct(X.mentions(text, dots=platform == "instagram")), "engagement": F.struct(likes.alias("likes"), comments.alias("comments"), shares.alias("shares"), views.alias("views"), (zero(likes) + zero(comments) + zero(shares)).alias("total")).cast(ENGAGEMENT),
        "music": F.struct(f.get("music_title", null("string")).alias("title"), f.get("music_author", null("string")).alias("author")).cast(MUSIC), "post_type": _s(v, "post_type"), "location": X.empty_to_null(_g(v, "location")), "location_source": _g(v, "location_source"),
        "location_confidence": _g(v, "location_confidence", "double"), "comments": f["comments"],
    }
    return [values[c.split()[0]].alias(c.split()[0]) for c in _columns()]


def _columns() -> list[str]:
    out, depth, part = [], 0, ""
    for ch in POST:
        depth += {"<": 1, ">": -1}.get(ch, 0)
        if ch == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]


def instagram(df: DataFrame, v: str = "post") -> DataFrame:
    c = F.col(v)
    url = _s(c, "post_url")
    return df.select(*_post(c, "instagram", post_id=F.coalesce(X.shortcode(url), F.lit("")), post_url=url, text=_s(c, "caption"), username=_s(c, "username"), author_name=_s(c, "author_name"), author_url=_s(c, "author_profile_url"), followers=_n(c, "follower_count"), following=_n(c, "following_count"), posts=_n(c, "posts_count"), verified=_g(c, "is_verified", "boolean"), ts=X.from_iso(_g(c, "post_date")), ts_raw=_g(c, "post_date"), likes=_n(c, "likes"), comment_count=_n(c, "comments"), shares=_n(c, "shares"), views=_n(c, "views"), hashtags=_tags(c, "hashtags"), comments=_comments(c, "comment_texts", "comments_json")))


def x(df: DataFrame, v: str = "post") -> DataFrame:
    c = F.col(v)
    url = _s(c, "post_url")
    return df.select(*_post(c, "x", post_id=F.regexp_extract(url, r"/status/([A-Za-z0-9_-]+)", 1), post_url=url, text=_s(c, "caption", "text"), username=_s(c, "username", "author"), author_name=_s(c, "author_name"), followers=_n(c, "follower_count", "author_followers"), verified=_g(c, "is_verified", "boolean"), lang=_s(c, "lang"), ts=X.from_ctime(_s(c, "post_date", "created_at")), ts_raw=_s(c, "post_date", "created_at"), likes=_n(c, "likes"), comment_count=_n(c, "comments", "replies"), shares=_n(c, "retweets"), hashtags=_tags(c, "hashtags"), comments=_comments(c, "comments_json", "comment_texts")))


def tiktok(df: DataFrame, v: str = "post") -> DataFrame:
    c = F.col(v)
    user = F.coalesce(X.empty_to_null(_g(c, "author.uniqueId")), F.when(kind(member(c, "author")) == "scalar", _g(c, "author")), F.lit(""))
    title = F.coalesce(_g(c, "music.title"), F.when(kind(member(c, "music")) == "scalar", _g(c, "music")))
    id_ = _s(c, "id", "post_id")
    rows = df.where(F.trim(id_) != "")
    return rows.select(*_post(c, "tiktok", post_id=id_, post_url=F.concat(F.lit("https://www.tiktok.example/@"), user, F.lit("/video/"), id_), text=_s(c, "desc", "text"), username=user, author_name=_s(c, "author.nickname"), followers=_n(c, "author.followerCount"), verified=_g(c, "author.verified", "boolean"), ts=X.from_unix(_g(c, "createTime")), ts_raw=_g(c, "createTime"), likes=_n(c, "stats.diggCount"), comment_count=_n(c, "stats.commentCount"), shares=_n(c, "stats.shareCount"), views=_n(c, "stats.playCount"), music_title=title, music_author=_g(c, "music.authorName"), comments=_comments(c, "comments_data", "top_comments")))


def facebook(df: DataFrame, v: str = "post") -> DataFrame:
    c = F.col(v)
    id_ = _s(c, "post_id")
    rows = df.where(F.trim(id_) != "")
    return rows.select(*_post(c, "facebook", post_id=id_, post_url=_s(c, "post_url"), text=_s(c, "text"), author_id=_s(c, "author_id"), author_name=_s(c, "author_name"), ts=X.from_unix(_g(c, "created_time")), ts_raw=_g(c, "created_time"), likes=_n(c, "reactions"), comment_count=_n(c, "comment_count"), shares=_n(c, "shares"), comments=_comments(c, "comments", "top_comments")))


def linkedin(df: DataFrame, v: str = "post") -> DataFrame:
    c = F.col(v)
    text = _s(c, "text")
    id_ = F.coalesce(X.empty_to_null(_g(c, "post_id")), X.short_md5(text, 120, 16))
    rows = df.where(F.trim(text) != "")
    return rows.select(*_post(c, "linkedin", post_id=id_, post_url=_s(c, "post_url"), text=text, author_id=_s(c, "author_id"), author_name=_s(c, "author_name"), author_url=_s(c, "author_url"), ts=X.from_age(_g(c, "time_text"), X.from_iso(_g(c, "scraped_at"))), ts_raw=_g(c, "time_text"), likes=_n(c, "reactions"), comment_count=_n(c, "comment_count"), shares=_n(c, "reposts"), hashtags=_tags(c, "hashtags"), comments=_comments(c, "comments", "top_comments")))


ADAPTERS = {"instagram": instagram, "x": x, "tiktok": tiktok, "facebook": facebook, "linkedin": linkedin}


def canonical(df: DataFrame, platform: str, v: str = "post") -> DataFrame:
    """Records of one platform in the canonical schema."""
    return ADAPTERS[platform](df, v)


def normalized(df: DataFrame, platform: str, v: str = "post"):
    """(canonical posts, counts): ``counts()`` tells read, post_count and skipped records after an
    action over the posts, which counts them on its way (``DataFrame.observe``)."""
    before, after = Observation(f"{platform}-read"), Observation(f"{platform}-posts")
    one = F.count(F.lit(1)).alias("n")
    posts = canonical(df.observe(before, one), platform, v).observe(after, one)

    def counts() -> dict[str, int]:
        read, kept = before.get["n"], after.get["n"]
        return {"read": read, "post_count": kept, "skipped": read - kept}

    return posts, counts


def flat_post(df: DataFrame) -> DataFrame:
    """Canonical posts under the flat names that the annotation operators read."""
    return df.select(
        "platform", "post_id", "post_url", "query", "ts", "scraped_at", F.col("text").alias("caption"), F.col("author.verified").alias("is_verified"), F.col("author.username").alias("username"), F.col("author.followers").alias("follower_count"), "hashtags", "mentions", "engagement",
        F.col("comments").alias("comment_texts"), "location", "location_confidence", "lang_hint",
    ).withColumn("hashtags", F.transform("hashtags", lambda t: F.concat(F.lit("#"), t))).withColumn("mentions", F.transform("mentions", lambda t: F.concat(F.lit("@"), t)))
