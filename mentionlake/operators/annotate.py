"""Rule annotations of posts: products, partners, intent, topics, emoji, campaigns, brand,
city, county and account class.

Lexicons become literal expressions, so an annotation is a narrow projection without a
shuffle; ``topics_by_join`` is the same operator over a lexicon table, for lexicons too
large for expressions.  A null text counts as empty.  Confidences are exact decimals, given
as double.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mentionlake import lexicon as L
from mentionlake.functions import text as X
from mentionlake.functions.binding import let, lookup

_NONE = ""


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(_NONE))


def comment_text(comments: str, sep: str = "\n") -> Column:
    """The texts of nested comments joined by ``sep``."""
    return F.array_join(F.transform(F.coalesce(F.col(comments), F.expr("array()")), lambda c: F.coalesce(c["text"], F.lit(""))), sep)


def pattern_mentions(caption: str, comments: str, patterns: Sequence = L.PRODUCTS) -> Column:
    """array<struct<name, category, count, found_in>> of the names whose pattern hits."""
    rows = []
    for pattern, name, category in patterns:
        a, b = F.regexp_count(_text(caption), F.lit(f"(?i){pattern}")), F.regexp_count(_text(comments), F.lit(f"(?i){pattern}"))
        where = F.filter(F.array(F.when(a > 0, F.lit("caption")), F.when(b > 0, F.lit("comments"))), lambda x: x.isNotNull())
        rows.append(F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"), (a + b).cast("bigint").alias("count"), where.alias("found_in")))
    return F.filter(F.array(*rows), lambda r: r["count"] > 0)


def intent(text: str, tiers: dict = L.INTENT) -> Column:
    """struct<level, confidence, signals (five at most), signal_count> of the highest tier hit."""
    base = {"high": (70, 95), "medium": (50, 80), "low": (40, 70)}
    none = F.struct(F.lit("none").alias("level"), F.lit(0.0).alias("confidence"), F.expr("cast(array() as array<string>)").alias("signals"), F.lit(0).alias("signal_count"))
    phone = F.when(X.has_phone(_text(text)), F.array(F.lit("phone"))).otherwise(F.expr("cast(array() as array<string>)"))

    def decide(hits: Column) -> Column:
        out = none
        for level in ("low", "medium", "high"):
            start, most = base[level]
            n = F.size(hits[level])
            confidence = (F.least(start + 5 * n, F.lit(most)).cast("decimal(5,2)") / 100).cast("double")
            out = F.when(n > 0, F.struct(F.lit(level).alias("level"), confidence.alias("confidence"), F.slice(F.array_distinct(hits[level]), 1, 5).alias("signals"), n.alias("signal_count"))).otherwise(out)
        return out

    def find(lower: Column) -> Column:
        found = {k: X.contained(lower, v) for k, v in tiers.items()}
        return F.struct(F.concat(found["high"], phone).alias("high"), found["medium"].alias("medium"), found["low"].alias("low"))

    return let(let(F.lower(_text(text)), find), decide)


def topics(text: str, table: Sequence = L.TOPICS) -> Column:
    """array<struct<topic, confidence, keywords, match_count>>, by falling confidence, then lexicon order."""
    def rows(lower: Column) -> Column:
        return F.array(*[let(X.contained(lower, words), _topic_row(ord_, topic, len(words))) for ord_, (topic, words) in enumerate(table)])

    def kept(all_rows: Column) -> Column:
        found = F.array_sort(F.filter(all_rows, lambda r: r["match_count"] > 0))
        return F.transform(found, lambda r: F.struct(r["topic"].alias("topic"), (-r["neg"]).alias("confidence"), r["keywords"].alias("keywords"), r["match_count"].alias("match_count")))

    return let(let(F.lower(_text(text)), rows), kept)


def _topic_row(ord_: int, topic: str, size: int):
    def row(hits: Column) -> Column:
        m = F.size(hits)
        confidence = F.least(F.lit(95).cast("decimal(20,10)"), 50 + (50 * m).cast("decimal(20,10)") / size + 3 * m) / 100
        return F.struct((-F.round(confidence, 2)).cast("double").alias("neg"), F.lit(ord_).alias("ord"), F.lit(topic).alias("topic"), F.slice(hits, 1, 5).alias("keywords"), m.alias("match_count"))

    return row


def topics_by_join(df: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """(key, topic, match_count) over a lexicon table (topic, word) of single words: an equality
    join on distinct tokens instead of a comparison of every text with every word."""
    tokens = df.select(key, F.explode(X.distinct_tokens(F.col(text))).alias("word"))
    return tokens.join(words.select("topic", "word").distinct(), "word").groupBy(key, "topic").agg(F.count(F.lit(1)).alias("match_count"))


def emoji_summary(text: str, polarity: dict = L.EMOJI, runs: bool = False, most: int | None = None) -> Column:
    """struct<total, distinct, top, positive, negative, neutral, score>; score = (p - n) / (p + n) or 0.

    ``top``: the five most frequent with their counts, ties by the emoji.  ``most``: polarity
    counts only the so many most frequent ones (10 is the original's rule)."""

    def summed(found: Column) -> Column:
        each = F.transform(F.array_distinct(found), lambda e: F.struct((-F.size(F.filter(found, lambda x: x == e))).alias("neg"), e.alias("emoji"), F.coalesce(X.mapped(e, polarity), F.lit(0)).alias("sign")))

        def told(rows: Column) -> Column:
            seen = F.slice(rows, 1, most) if most else rows
            counts = F.array(*[_signed(seen, v) for v in (1, -1, 0)])

            def scored(c: Column) -> Column:
                p, n = F.element_at(c, 1), F.element_at(c, 2)
                score = F.when(p + n > 0, F.round(((p - n).cast("decimal(10,0)") / (p + n).cast("decimal(10,0)")), 2).cast("double")).otherwise(F.lit(0.0))
                top = F.transform(F.slice(rows, 1, 5), lambda r: F.struct(r["emoji"].alias("emoji"), (-r["neg"]).alias("count")))
                return F.struct(F.size(found).alias("total"), F.size(rows).alias("distinct"), top.alias("top"), p.alias("positive"), n.alias("negative"), F.element_at(c, 3).alias("neutral"), score.alias("score"))

            return let(counts, scored)

        return let(F.array_sort(each), told)

    return let(X.emoji(_text(text), runs), summed)


def _signed(rows: Column, sign: int) -> Column:
    return F.aggregate(F.filter(rows, lambda r: r["sign"] == sign), F.lit(0), lambda a, r: a - r["neg"])


def campaigns(caption: str, hashtags: str, mentions: str, table: Sequence = L.CAMPAIGNS) -> Column:
    """array<struct<campaign_id, name, type, confidence, signals>> by falling confidence, then table order."""
    tags = F.transform(F.coalesce(F.col(hashtags), F.expr("array()")), F.lower)
    named = F.transform(F.coalesce(F.col(mentions), F.expr("array()")), F.lower)
    lower = F.lower(_text(caption))
    rows = []
    empty = F.expr("cast(array() as array<string>)")
    for ord_, (id_, name, type_, hs, slogans, ms) in enumerate(table):
        lit = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else empty
        hits = F.concat(F.array_intersect(lit(hs), tags), X.contained(lower, slogans) if slogans else empty, F.array_intersect(lit(ms), named))
        confidence = (F.least(60 + 10 * F.size(hits), F.lit(95)).cast("decimal(5,2)") / 100).cast("double")
        rows.append(F.struct((-confidence).alias("neg"), F.lit(ord_).alias("ord"), F.lit(id_).alias("campaign_id"), F.lit(name).alias("name"), F.lit(type_).alias("type"), hits.alias("signals")))
    kept = F.array_sort(F.filter(F.array(*rows), lambda r: F.size(r["signals"]) > 0))
    return F.transform(kept, lambda r: F.struct(r["campaign_id"].alias("campaign_id"), r["name"].alias("name"), r["type"].alias("type"), (-r["neg"]).alias("confidence"), r["signals"].alias("signals")))


def brand_mentions(caption: str, comments: str, variants: Sequence = L.BRAND) -> Column:
    """struct<count, variants, found_in>: hits over all spellings; variants are the other spellings."""
    a = [F.regexp_count(_text(caption), F.lit(f"(?i){p}")) for p, _ in variants]
    b = [F.regexp_count(_text(comments), F.lit(f"(?i){p}")) for p, _ in variants]
    total = sum(x + y for x, y in zip(a, b))
    other = F.filter(F.array(*[F.when(x + y > 0, F.lit(v)) for (_, v), x, y in list(zip(variants, a, b))[1:]]), lambda v: v.isNotNull())
    where = F.filter(F.array(F.when(sum(a) > 0, F.lit("caption")), F.when(sum(b) > 0, F.lit("comments"))), lambda v: v.isNotNull())
    return F.struct(total.cast("bigint").alias("count"), other.alias("variants"), where.alias("found_in"))


def account_class(username: str, followers: str, classes: Sequence = L.ACCOUNT_CLASSES, tiers: Sequence = L.TIERS) -> Column:
    """struct<type, confidence, follower_tier>: the first class that matches, else by followers."""
    out = None
    for pattern, name, confidence in classes:
        made = F.struct(F.lit(name).alias("type"), F.lit(confidence).alias("confidence"))
        hit = _text(username).rlike(f"(?i){pattern}")
        out = F.when(hit, made) if out is None else out.when(hit, made)
    n = F.coalesce(F.col(followers), F.lit(0))
    for least, name, confidence in tiers:
        out = out.when(n >= least, F.struct(F.lit(name).alias("type"), F.lit(confidence).alias("confidence")))
    kind = out.otherwise(F.struct(F.lit("individual").alias("type"), F.lit(0.60).alias("confidence")))
    return F.struct(kind["type"].alias("type"), kind["confidence"].alias("confidence"), X.follower_tier(n).alias("follower_tier"))


#: Bound on the names of the gazetteer that city_of takes along as a literal.
MOST_TOWNS = 50_000


def _towns(gazetteer: DataFrame) -> dict[str, dict]:
    """Lower-case name -> place, of towns; of towns of one name the first by ``ord``."""
    towns = gazetteer.where((F.col("area_type") != "county") & F.col("display").isNotNull()).groupBy(F.lower(F.trim("display")).alias("k")).agg(F.min_by(F.struct("ord", "display", "county", "area_type", "lat", "lon"), F.struct("ord", "place_id") if "place_id" in gazetteer.columns else "ord").alias("p"))
    rows = towns.limit(MOST_TOWNS + 1).collect()
    if len(rows) > MOST_TOWNS:
        raise ValueError(f"more than {MOST_TOWNS} towns: join the gazetteer instead")
    return {r.k: r.p.asDict() for r in rows}


def first_place(text: str, towns: dict[str, dict]):
    """ord of the first town of the gazetteer (by its order) that stands in a text as whole words, else null."""
    found = lookup({" ".join(re.findall(r"\w+", k)): v["ord"] for k, v in sorted(towns.items(), key=lambda x: -x[1]["ord"])}, "int")
    sizes = sorted({len(re.findall(r"\w+", k)) for k in towns} - {0})
    words = F.regexp_extract_all(F.lower(_text(text)), F.lit(r"(?U)(\w+)"), F.lit(1))

    def first(w: Column) -> Column:
        out = []
        for n in sizes:
            runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), _run(w, n))
            out.append(F.array_min(F.transform(runs, found)))
        return F.least(F.lit(None).cast("int"), *out, F.lit(None).cast("int"))

    return let(words, first)


def _run(words: Column, n: int):
    return lambda i: F.array_join(F.slice(words, i, n), " ")


def city_of(df: DataFrame, gazetteer: DataFrame, location: str = "location", confidence: str = "location_confidence", signals: str | None = "geo_enrichment", candidates: Column | None = None, caption: str | None = "caption") -> DataFrame:
    """Adds city, city_confidence, city_source, county, area_type, lat and lon.

    In turn: the surest signal whose source names a city (the first of equals); a candidate
    that is surer than it; the location field (its confidence times 0.8, 0.5 if unknown); the
    first town of the gazetteer in the caption (0.55).  A signal, candidate or field names a
    town by the part before its comma or as a whole, and only towns of the gazetteer count;
    county and kind are that town's, and its coordinates where the evidence has none.
    ``candidates``: array<struct<location, max_confidence, ...>>; the default is the member
    ``top_candidates`` of ``signals``, if it has one.

    The gazetteer goes along as a literal of at most ``MOST_TOWNS`` names (more is an error),
    so posts are not moved.
    """
    towns = _towns(gazetteer)
    known = lookup(towns, "struct<ord:int,display:string,county:string,area_type:string,lat:double,lon:double>")
    by_ord = lookup({str(v["ord"]): v for v in towns.values()}, "struct<ord:int,display:string,county:string,area_type:string,lat:double,lon:double>")
    row = "struct<p:struct<ord:int,display:string,county:string,area_type:string,lat:double,lon:double>,c:double,lat:double,lon:double,source:string>"

    def parsed(said: Column) -> Column:
        whole = F.lower(F.trim(said))
        return F.coalesce(F.when(F.contains(whole, F.lit(",")), known(F.trim(F.split_part(whole, F.lit(","), F.lit(1))))), known(whole))

    def best(items: Column, c: str, source: Column | None) -> Column:
        """The item of greatest confidence that names a town; the first of equals."""
        fields = items  # an array of structs
        hits = F.transform(fields, lambda s, i: F.struct(F.coalesce(s[c], F.lit(0.5)).alias("c"), (-i).alias("i"), parsed(s["location"]).alias("p"), s["lat"].alias("lat"), s["lon"].alias("lon")))
        top = F.array_max(F.filter(hits, lambda h: h["p"].isNotNull() & (h["c"] > 0)))
        return let(top, lambda t: F.when(t.isNotNull(), F.struct(t["p"].alias("p"), t["c"].alias("c"), t["lat"].alias("lat"), t["lon"].alias("lon"), source.alias("source"))))

    def normal(items: Column, c: str, t: T.DataType) -> Column:
        names = t.elementType.names
        coordinate = lambda s, *ns: next((s[n] for n in ns if n in names), F.lit(None)).cast("double")
        return F.transform(F.coalesce(items, F.expr("array()")), lambda s: F.struct(s[c].cast("double").alias("c"), s["location"].alias("location"), coordinate(s, "lat", "latitude").alias("lat"), coordinate(s, "lon", "longitude").alias("lon"), (s["source"] if "source" in names else F.lit("")).alias("source")))

    nothing = F.lit(None).cast(row)
    one, two = nothing, nothing
    if signals:
        inner = {f.name: f.dataType for f in df.schema[signals].dataType.fields}
        named = F.filter(normal(F.col(f"{signals}.top_signals"), "confidence", inner["top_signals"]), lambda s: F.contains(F.lower(F.coalesce(s["source"], F.lit(""))), F.lit("city")))
        one = best(named, "c", F.lit("signal"))
        if candidates is None and "top_candidates" in inner and "max_confidence" in inner["top_candidates"].elementType.names:
            candidates = F.col(f"{signals}.top_candidates")
    if candidates is not None:
        df = df.withColumn("_candidates", candidates)
        two = best(normal(F.col("_candidates"), "max_confidence", df.schema["_candidates"].dataType), "c", F.lit("candidate"))
    surer = lambda both: F.when(both["b"].isNotNull() & (both["a"].isNull() | (both["b"]["c"] > both["a"]["c"])), both["b"]).otherwise(both["a"])
    evidence = let(F.struct(one.cast(row).alias("a"), two.cast(row).alias("b")), surer)
    empty = {"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")}
    told = lambda p, c, source: F.when(p.isNotNull(), F.struct(p.alias("p"), c.alias("c"), empty["lat"].alias("lat"), empty["lon"].alias("lon"), F.lit(source).alias("source"))).cast(row)
    of_field = F.round(F.coalesce(F.col(confidence), F.lit(0.5)).cast("decimal(6,4)") * F.lit(0.8).cast("decimal(2,1)"), 4).cast("double") if confidence in df.columns else F.lit(0.4)
    field = let(parsed(F.col(location)), lambda p: told(p, of_field, "location"))
    scan = let(by_ord(first_place(caption, towns).cast("string")), lambda p: told(p, F.lit(0.55), "caption")) if caption else nothing
    df = df.withColumn("_city", F.coalesce(evidence, field, scan) if towns else nothing)
    return df.drop("city", "county", "area_type", "lat", "lon").withColumns({
        "city": F.col("_city.p.display"), "city_confidence": F.round(F.col("_city.c"), 2), "city_source": F.col("_city.source"), "county": F.col("_city.p.county"),
        "area_type": F.col("_city.p.area_type"), "lat": F.coalesce("_city.lat", "_city.p.lat"), "lon": F.coalesce("_city.lon", "_city.p.lon"),
    }).drop("_city", "_candidates")


def annotate_places(df: DataFrame, gazetteer: DataFrame, signals: str | None = None) -> DataFrame:
    """The second stage of rules: city to coordinates, brand, account class; ``is_verified`` is kept."""
    df = city_of(df, gazetteer, signals=signals).withColumn("_comments", comment_text("comment_texts", " "))
    df = df.withColumns({"brand": brand_mentions("caption", "_comments"), "account": account_class("username", "follower_count")}).drop("_comments")
    return df if "is_verified" in df.columns else df.withColumn("is_verified", F.lit(None).cast("boolean"))


def annotate_rules(df: DataFrame) -> DataFrame:
    """All rule annotations that need a post alone (caption, comment_texts, hashtags, mentions,
    username, follower_count, post_url)."""
    df = df.withColumn("_comments", comment_text("comment_texts")).withColumn("_all", F.concat_ws("\n", "caption", "_comments"))
    return df.withColumns({
        "products": pattern_mentions("caption", "_comments", L.PRODUCTS), "partners": pattern_mentions("caption", "_comments", L.PARTNERS), "intent": intent("_all"),
        "topics": topics("_all"), "emoji": emoji_summary("_all"), "campaigns": campaigns("caption", "hashtags", "mentions"), "brand": brand_mentions("caption", "_comments"),
        "account": account_class("username", "follower_count"), "platform": F.coalesce(F.col("platform"), X.platform_of(F.col("post_url"))),
    }).drop("_comments", "_all")
