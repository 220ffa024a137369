"""Weighted evidence: signals about a place from several sources, fused into one answer.

A signal is a row (key, location, confidence, source, lat, lon, raw_matches).  Evidence from
images, networks or profile pages comes as such rows from outside; here are the generators
that need text, tags, names and times alone.  They read places from a list (``place_list``):
(name, location, level, lat, lon), where level is ``city`` or ``country``.  Texts meet names
by equality of word runs, tags and user names by equality of their substrings, so no text is
compared with every name.

Defined cases: null and empty texts, tags and names give no signal; a tag that stands twice
counts twice; a text of any length is read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionlake import lexicon as L
from mentionlake.functions import text as X
from mentionlake.functions.binding import let
from mentionlake.lexicon import WEIGHTS
from mentionlake.session import small

#: Names of fewer letters are not looked for inside user names.
LEAST_INSIDE = 4
NO_PLACE = {"lat": "double", "lon": "double"}


def place_list(gazetteer: DataFrame, countries: Sequence = L.COUNTRIES) -> DataFrame:
    """Towns of a gazetteer as cities; its counties and the ``countries`` as the wider level.

    Of places of one name and level the first by ``ord`` is meant."""
    g = gazetteer.where(F.col("display").isNotNull()).select(
        F.lower("display").alias("name"), F.when(F.col("area_type") == "county", "country").otherwise("city").alias("level"), F.struct("ord", F.col("display").alias("location"), "lat", "lon").alias("_p")
    )
    own = g.groupBy("name", "level").agg(F.min("_p").alias("_p")).select("name", "_p.location", "level", "_p.lat", "_p.lon")
    if not countries:
        return own
    wider = gazetteer.sparkSession.createDataFrame([(n.lower(), n) for n, _ in countries], "name string, location string")
    return own.unionByName(wider.withColumns({"level": F.lit("country"), "lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")}))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1))


def _runs(words: Column, sizes: Sequence[int]) -> Column:
    """Distinct runs of so many words."""
    none = F.expr("cast(array() as array<string>)")

    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
        return F.when(F.size(words) >= n, F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(none)

    return F.array_distinct(F.concat(*map(of, sizes)))


def _inside(word: Column, lengths: Sequence[int]) -> Column:
    """Distinct substrings of these lengths."""
    none = F.expr("cast(array() as array<string>)")

    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1)))
        return F.when(F.length(word) >= n, F.transform(places, lambda i: F.substring(word, i, F.lit(n)))).otherwise(none)

    return F.array_distinct(F.concat(*map(of, lengths))) if lengths else none


def _numbers(df: DataFrame, c: Column) -> list[int]:
    """The distinct values of a small measure of a reference list (lengths, word counts)."""
    return sorted(r[0] for r in df.select(c).distinct().collect())


def mentioned(df: DataFrame, key: str, text: str, places: DataFrame) -> DataFrame:
    """(key, name, location, level, lat, lon): the places whose name stands in the text as whole words."""
    names = places.select(F.array_join(_words(F.col("name")), " ").alias("name"), "location", "level", "lat", "lon").where("name <> ''")
    sizes = _numbers(names, F.size(F.split("name", " ")))
    if not sizes:
        return df.select(key).limit(0).crossJoin(names.limit(0))
    runs = df.where(F.col(text).isNotNull()).select(key, F.explode(let(_words(F.col(text)), lambda w: _runs(w, sizes))).alias("name"))
    return runs.join(small(names), "name").select(key, "name", "location", "level", "lat", "lon")


def _signal(rows: DataFrame, key: str, confidence: Column, source: Column) -> DataFrame:
    return rows.select(key, "location", confidence.cast("double").alias("confidence"), source.alias("source"), "lat", "lon", F.array("name").alias("raw_matches"))


def _by_level(city, country) -> Column:
    return F.when(F.col("level") == "city", F.lit(city)).otherwise(F.lit(country))


def _squashed(places: DataFrame, least: int = 1) -> DataFrame:
    return places.select(F.regexp_replace(F.lower("name"), r"\s", "").alias("_w"), "location", "level", "lat", "lon").where(F.length("_w") >= least)


def caption_signals(df: DataFrame, key: str, text: str, places: DataFrame, phrases: Sequence = L.PLACE_PHRASES, scripts: Sequence = L.SCRIPT_REGIONS) -> DataFrame:
    """Names in the text (city 0.70, country 0.60); a capitalised phrase after a preposition that
    names a place (the phrase's confidence + 0.1, 0.95 at most, for each such phrase); scripts."""
    named = mentioned(df, key, text, places)
    out = _signal(named, key, _by_level(0.70, 0.60), _by_level("caption_text_city", "caption_text_country"))

    def after(c: float, words: Sequence[str]) -> Column:
        found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"\b(?:{'|'.join(words)})\s+([A-Z][a-zA-Z\s]{{2,25}})"), F.lit(1))
        return F.transform(found, lambda m: F.struct(F.lower(F.trim(F.regexp_replace(m, r"\s+", " "))).alias("name"), F.lit(c).alias("c")))

    if phrases:
        said = df.select(key, F.explode(F.concat(*[after(c, words) for c, words in phrases])).alias("_s")).select(key, "_s.name", "_s.c")
        first = places.groupBy("name").agg(F.min(F.struct(F.when(F.col("level") == "city", 0).otherwise(1), "location", "lat", "lon")).alias("_p")).select("name", "_p.location", "_p.lat", "_p.lon")
        hits = said.join(small(first), "name")
        out = out.unionByName(_signal(hits, key, F.least(F.lit(95), F.round(F.col("c") * 100) + 10).cast("decimal(5,2)") / 100, F.lit("caption_text_preposition")))
    if scripts:
        seen = F.filter(F.array(*[F.when(F.col(text).rlike(f"[{X.SCRIPTS[name]}]"), F.struct(F.lit(region).alias("location"), F.lit(c).alias("c"), F.lit(name).alias("name"))) for name, region, c in scripts]), lambda x: x.isNotNull())
        rows = df.select(key, F.explode(seen).alias("_s")).select(key, "_s.location", "_s.c", "_s.name", *[F.lit(None).cast(t).alias(c) for c, t in NO_PLACE.items()])
        out = out.unionByName(_signal(rows, key, F.col("c"), F.lit("caption_text_language")))
    return out


def hashtag_signals(df: DataFrame, key: str, tags: str, places: DataFrame, patterns: Sequence = L.PLACE_TAG_PATTERNS) -> DataFrame:
    """min(0.35 + 0.15 n, 0.85), where n sums over the tags: 1 for a tag that is the place's name
    (or that of a city followed by ``city``), 1 for a city's name inside a tag of under 30 signs,
    0.5 for a country's inside one of under 25, and 0.75 or 0.5 for a city or country in the place
    that a pattern names, or at the tag's begin."""
    names = small(_squashed(places))
    lengths = _numbers(_squashed(places), F.length("_w"))
    each = df.select(key, F.posexplode(F.col(tags)).alias("_i", "_t")).where(F.col("_t").isNotNull())
    each = each.select(key, "_i", F.col("_t").alias("_raw"), F.regexp_replace(F.lower(X.percent_decoded(F.trim("_t"))), "#", "").alias("_b"))
    weigh = lambda w, city, country: F.struct(w.alias("_w"), F.lit(city).cast("decimal(4,2)").alias("city"), F.lit(country).cast("decimal(4,2)").alias("country"))

    def hits(b: Column) -> Column:
        out = [F.array(weigh(b, 1, 1), weigh(F.regexp_extract(b, "^(.+)city$", 1), 1, 0))]
        out.append(F.when(F.length(b) < 30, F.transform(_inside(b, lengths), lambda w: weigh(w, 1, 0))).otherwise(F.array(weigh(F.lit(""), 0, 0))))
        out.append(F.when(F.length(b) < 25, F.transform(_inside(b, lengths), lambda w: weigh(w, 0, 0.5))).otherwise(F.array(weigh(F.lit(""), 0, 0))))
        out.append(F.array(*[weigh(F.when(F.length(b) >= n, F.substring(b, 1, n)).otherwise(F.lit("")), 0.75, 0.5) for n in lengths] or [weigh(F.lit(""), 0, 0)]))
        out.append(F.array(*[weigh(F.regexp_extract(b, f"(?U)^{p}", 1), 0.75, 0.5) for p in patterns] or [weigh(F.lit(""), 0, 0)]))
        return F.filter(F.concat(*out), lambda x: x["_w"] != "")

    rows = each.select(key, "_i", "_raw", F.explode(let(F.col("_b"), hits)).alias("_h")).select(key, "_i", "_raw", "_h.*")
    rows = rows.join(names, "_w").withColumn("_n", F.when(F.col("level") == "city", F.col("city")).otherwise(F.col("country"))).where("_n > 0")
    found = rows.groupBy(key, "location").agg(F.sum("_n").alias("_n"), F.max("lat").alias("lat"), F.max("lon").alias("lon"), F.array_sort(F.collect_set("_raw")).alias("raw_matches"))
    score = F.round(F.least(F.lit(0.35).cast("decimal(10,4)") + F.lit(0.15).cast("decimal(10,4)") * F.col("_n"), F.lit(0.85).cast("decimal(10,4)")), 2)
    return found.select(key, "location", score.cast("double").alias("confidence"), F.lit("hashtag_analysis").alias("source"), "lat", "lon", "raw_matches")


def bio_signals(df: DataFrame, key: str, bio: str, places: DataFrame, phrases: Sequence = L.BIO_PHRASES, countries: Sequence = L.COUNTRIES) -> DataFrame:
    """Signals of a self-description that the caller has: names (0.75, 0.60), the first place after
    each of the phrases, and flags (0.65)."""
    out = _signal(mentioned(df, key, bio, places), key, _by_level(0.75, 0.60), _by_level("profile_bio_city", "profile_bio_country"))
    text = F.coalesce(F.col(bio), F.lit(""))
    said = [F.struct(F.rtrim(F.trim(F.regexp_extract(text, rf"(?i){p}\s*([A-Za-z\s,]{{3,30}})", 1)), F.lit(" .,!|•")).alias("location"), F.lit(c).alias("c")) for p, c in phrases]
    none = {c: F.lit(None).cast(t) for c, t in NO_PLACE.items()}
    if said:
        rows = df.select(key, F.explode(F.array(*said)).alias("_s")).select(key, "_s.location", "_s.c").where("location <> ''").withColumns(none).withColumn("name", F.col("location"))
        out = out.unionByName(_signal(rows, key, F.col("c"), F.lit("profile_bio_pattern")))
    if countries:
        letters = "".join(chr(0x1F1E6 + i) for i in range(26))
        flags = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\x{1F1E6}-\x{1F1FF}]{2})"), F.lit(1)))).alias("name"))
        by_code = df.sparkSession.createDataFrame([(c, n) for n, c in countries], "code string, location string")
        rows = flags.withColumn("code", F.translate("name", letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).join(F.broadcast(by_code), "code").withColumns(none)
        out = out.unionByName(_signal(rows, key, F.lit(0.65), F.lit("profile_bio_flag")))
    return out


def timing_signals(df: DataFrame, key: str, ts: str, regions: DataFrame) -> DataFrame:
    """For each (offset, region): 0.2 if the local hour is 9 to 21, 0.1 if 7 to 23, else none.

    Regions are laid out by the hours (UTC) in which they give a signal, and meet the rows by
    hour; a list of any length is taken whole.
    """
    local = F.pmod(F.col("_h") + F.col("offset"), F.lit(24))
    hours = regions.select("offset", "region").distinct().withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(23))))
    signals = hours.select(
        "_h", F.col("region").alias("location"), F.when(local.between(9, 21), 0.2).when(local.between(7, 23), 0.1).alias("confidence"), F.when(local.between(9, 21), "post_timing_peak").otherwise("post_timing_active").alias("source"),
        F.format_string("UTC%+d", F.col("offset").cast("int")).alias("name"), *[F.lit(None).cast(t).alias(c) for c, t in NO_PLACE.items()]
    ).where(F.col("confidence").isNotNull())
    return df.select(key, F.hour(F.col(ts)).alias("_h")).join(small(signals), "_h").select(key, "location", "confidence", "source", "lat", "lon", F.array("name").alias("raw_matches"))


def _flat(c: Column, signs: str = "[_.-]") -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), signs, "")


def username_signals(df: DataFrame, key: str, username: str, places: DataFrame, author: str | None = None, keywords: Sequence = L.NAME_KEYWORDS) -> DataFrame:
    """Places in user names: keywords (a code after a ``_`` at the end, others anywhere), cities and
    countries inside the name, and whole words of the shown name; of each place the surest hit.

    A keyword gains 0.10 (0.90 at most) if it is over half of the name and 0.05 (0.85 at most) if
    over 0.3 of it; a code or a hit in the shown name alone loses 0.05 (0.20 at least)."""
    low = F.lower(F.trim(F.coalesce(F.col(username), F.lit(""))))
    shown = F.col(author) if author else F.lit("")
    base = df.where(F.trim(F.col(username)) != "").select(key, low.alias("_u"), _flat(F.col(username)).alias("_f"), F.lower(F.trim(F.coalesce(shown, F.lit("")))).alias("_a"), _flat(shown, "[ _.|-]").alias("_af"))
    size = F.greatest(F.length("_f"), F.lit(1))
    exact = lambda x: F.lit(x).cast("decimal(5,2)")
    rows = []
    for ord_, (word, location, c, kind) in enumerate(keywords):
        in_name = F.col("_u").endswith(word) if word.startswith("_") else F.contains("_f", F.lit(word))
        ratio = F.lit(len(word)) / size
        more = F.when(ratio > 0.5, F.least(exact(c) + exact(0.10), exact(0.90))).when(ratio > 0.3, F.least(exact(c) + exact(0.05), exact(0.85))).otherwise(exact(c))
        less = F.greatest(more - exact(0.05), exact(0.20))
        hit = F.when(in_name, less if word.startswith("_") else more).when(F.contains("_af", F.lit(word)), less)
        rows.append(F.when(hit.isNotNull(), F.struct(F.lit(location).alias("location"), hit.cast("decimal(5,2)").alias("c"), F.lit(f"username_{kind}").alias("source"), F.lit(word).alias("name"), F.lit(ord_).alias("ord"))))
    last = len(rows)
    nothing = {c: F.lit(None).cast(t) for c, t in NO_PLACE.items()}
    inner = _squashed(places, LEAST_INSIDE)
    inside = base.select(key, size.alias("_n"), F.explode(_inside(F.col("_f"), _numbers(inner, F.length("_w")))).alias("_w")).join(small(inner), "_w")
    ratio = F.length("_w") / F.col("_n")
    c = F.when(F.col("level") == "city", F.when(ratio > 0.4, 0.75).otherwise(0.65)).otherwise(F.when(ratio > 0.3, 0.65).otherwise(0.55))
    out = inside.select(key, "location", c.cast("decimal(5,2)").alias("c"), _by_level("username_city", "username_country").alias("source"), F.col("_w").alias("name"), _by_level(last, last + 1).alias("ord"), "lat", "lon")
    if rows:
        said = base.select(key, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("_s")).select(key, "_s.*").withColumns(nothing)
        out = out.unionByName(said)
    if author:
        words = mentioned(base, key, "_a", places).where((F.col("level") == "city") | (F.length("name") >= LEAST_INSIDE))
        out = out.unionByName(words.select(key, "location", _by_level(0.60, 0.50).cast("decimal(5,2)").alias("c"), _by_level("username_city", "username_country").alias("source"), "name", _by_level(last + 2, last + 3).alias("ord"), "lat", "lon"))
    best = out.groupBy(key, "location").agg(F.max_by(F.struct("c", "source", "name", "lat", "lon"), F.struct("c", -F.col("ord"), "name")).alias("_b"))
    return best.select(key, "location", F.col("_b.c").cast("double").alias("confidence"), "_b.source", "_b.lat", "_b.lon", F.array("_b.name").alias("raw_matches"))


def _weight(source: Column, weights: Mapping) -> Column:
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.element_at(table, source), F.lit(1.0))


def candidates(signals: DataFrame, key: str, weights: Mapping = WEIGHTS) -> DataFrame:
    """(key, location, display, score, signal_count, max_confidence, sources, lat, lon) of each candidate.

    Score: confidence x weight summed, times 1.2 for two source families and 1.5 for three
    or more.  Signals without location or confidence say nothing.  The coordinates are those
    of the surest signal that has any.
    """
    for c, t in NO_PLACE.items():
        if c not in signals.columns:
            signals = signals.withColumn(c, F.lit(None).cast(t))
    s = signals.where(F.col("location").isNotNull() & F.col("confidence").isNotNull()).withColumn("_place", F.lower(F.trim("location")))
    placed = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("confidence", "source", "lat", "lon"))
    grouped = s.groupBy(key, F.col("_place").alias("location")).agg(
        F.sum(F.col("confidence").cast("decimal(12,6)") * _weight(F.col("source"), weights).cast("decimal(6,3)")).alias("_sum"),
        F.count(F.lit(1)).alias("signal_count"),
        F.max("confidence").alias("max_confidence"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.size(F.collect_set(F.substring_index("source", "_", 1))).alias("_families"),
        F.min(F.trim("location")).alias("display"),
        F.max(placed).alias("_at"),
    )
    boost = F.when(F.col("_families") >= 3, 1.5).when(F.col("_families") == 2, 1.2).otherwise(1.0).cast("decimal(3,1)")
    return grouped.withColumn("score", (F.col("_sum") * boost).cast("double")).withColumns({"lat": F.col("_at.lat"), "lon": F.col("_at.lon")}).drop("_sum", "_families", "_at")


def fuse(signals: DataFrame, key: str, weights: Mapping = WEIGHTS) -> DataFrame:
    """(key, location, display, confidence, score, margin, signals_count, method_used, lat, lon): the
    best candidate of each key.

    confidence = min(min(its greatest confidence, 0.95) + 0.1 (top - second) / top, 0.99);
    ties go to the name.
    """
    w = Window.partitionBy(key).orderBy(F.desc("score"), "location")
    c = candidates(signals, key, weights)
    ranked = c.withColumn("_rank", F.row_number().over(w)).withColumn("_second", F.coalesce(F.lead("score").over(w), F.lit(0.0))).withColumn("signals_count", F.sum("signal_count").over(Window.partitionBy(key)))
    margin = F.when(F.col("score") > 0, (F.col("score") - F.col("_second")) / F.col("score")).otherwise(F.lit(0.0))
    return ranked.where("_rank = 1").select(
        key, "location", "display", F.least(F.least(F.col("max_confidence"), F.lit(0.95)) + 0.1 * margin, F.lit(0.99)).alias("confidence"), "score", margin.alias("margin"), "signals_count", F.array_join("sources", ", ").alias("method_used"), "lat", "lon"
    )


def top_candidates(signals: DataFrame, key: str, n: int = 3, weights: Mapping = WEIGHTS) -> DataFrame:
    """The n candidates of each key with the greatest score."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "location")
    return candidates(signals, key, weights).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def best_signals(signals: Column, n: int = 3) -> Column:
    """The n surest of an array of signals (structs with location and confidence); ties go to the name."""
    named = F.filter(F.coalesce(signals, F.expr("array()")), lambda x: x["location"].isNotNull())
    order = lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).when(a["location"] < b["location"], -1).when(a["location"] > b["location"], 1).otherwise(0)
    return F.slice(F.array_sort(named, order), 1, n)


def geo_result(signals: DataFrame, key: str, n: int = 3, weights: Mapping = WEIGHTS) -> DataFrame:
    """(key, best_location, best_confidence, method_used, signals_count, top_signals, top_candidates):
    the answer of each key with the n surest signals and the n best candidates."""
    for c, t in {"lat": "double", "lon": "double", "raw_matches": "array<string>"}.items():
        if c not in signals.columns:
            signals = signals.withColumn(c, F.lit(None).cast(t))
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), "location", "source")
    first = signals.where(F.col("location").isNotNull() & F.col("confidence").isNotNull()).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    told = lambda rank, *cs: F.transform(F.array_sort(F.collect_list(F.struct(rank, F.struct(*cs).alias("x")))), lambda s: s["x"])
    tops = first.groupBy(key).agg(told("_rank", "location", "confidence", "source", "lat", "lon", "raw_matches").alias("top_signals"))
    best = top_candidates(signals, key, n, weights).groupBy(key).agg(told("rank", F.col("display").alias("location"), F.round("score", 3).alias("score"), "signal_count", F.round("max_confidence", 2).alias("max_confidence"), "sources", "lat", "lon").alias("top_candidates"))
    won = fuse(signals, key, weights).select(key, F.col("display").alias("best_location"), F.col("confidence").alias("best_confidence"), "method_used", "signals_count")
    return won.join(tops, key, "left").join(best, key, "left")


def located(posts: DataFrame, fused: DataFrame, key: str, native: str = "location") -> DataFrame:
    """The native location where there is one (confidence 1), else the fused one."""
    f = fused.select(key, F.col("location").alias("_l"), F.col("confidence").alias("_c"))
    has = F.trim(F.coalesce(F.col(native), F.lit(""))) != ""
    return posts.join(f, key, "left").withColumns({
        "best_location": F.when(has, F.trim(F.col(native))).otherwise(F.col("_l")), "best_confidence": F.when(has, F.lit(1.0)).otherwise(F.col("_c")),
        "location_method": F.when(has, F.lit("native")).when(F.col("_l").isNotNull(), F.lit("fusion")),
    }).drop("_l", "_c")


def nearest(points: DataFrame, places: DataFrame, key: str, max_km: float = 200.0, cell: float = 2.0) -> DataFrame:
    """(key, place, km): the nearest place within ``max_km``, by an equality join on grid cells.

    Each place is laid into the cells that a point within reach could lie in, so points meet
    only places near them.  Ties go to the name.  Longitudes are taken as given in [-180, 180].
    """
    import math

    from mentionlake.functions.text import haversine_km

    rows = math.ceil(max_km / 111.0 / cell)
    # Cells that a circle of max_km spans in longitude, at the place's latitude plus that reach.
    reach = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(max_km / 6371.0) / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + max_km / 111.0, F.lit(89.0)))), F.lit(0.01)))))
    cols = F.ceil(reach / cell).cast("int")
    y, x = F.floor(F.col("lat") / cell), F.floor(F.col("lon") / cell)
    around = 360 / cell
    near = places.select(F.col("place"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.explode(F.sequence(y - rows, y + rows)).alias("_y"), (x - cols).alias("_a"), (x + cols).alias("_b"))
    near = near.select("place", "_lat", "_lon", "_y", F.explode(F.sequence("_a", F.least("_b", F.col("_a") + int(around) - 1))).alias("_xr")).withColumn("_x", F.pmod("_xr", F.lit(int(around)))).drop("_xr")
    p = points.select(key, "lat", "lon", y.alias("_y"), F.pmod(x, F.lit(int(around))).alias("_x"))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    return p.join(near, ["_y", "_x"]).withColumn("km", km).where(F.col("km") <= max_km).groupBy(key).agg(F.min(F.struct("km", "place")).alias("_m")).select(key, "_m.place", "_m.km")
