"""Instants from timestamps that are written in many ways (problem 2).

Each value is brought to parts (year .. fraction, half of day, zone) by one table of
patterns.  A value with an offset is an instant at once; a value without one is local
time and meets the offset intervals of its zone in an as-of join: the intervals are
exploded to local years, so the join is an equality on (zone, year), and the interval
that holds the local time is picked in the row.  The years 1971 to 2038 are always there,
others from 1 to 9999 where the data have them (a distinct over zones and years).  Two intervals mean an ambiguous local
time (the first is taken), none a nonexistent one (no instant), one gives the offset.

Defined cases: null, blank, ``0`` and values that are no date give null with status
``none``; a zone name or abbreviation that is not known gives null with status
``unknown_zone``; a null or blank zone means UTC; a local time that the clocks skip gives
null with status ``nonexistent``.  Digits other than 0-9 are no digits.  Repeated rows
stay repeated.  Columns of the input keep their names; the new ones are ``utc_ms`` and
``time_status``, and an input column of that name is replaced.
"""

from __future__ import annotations

import datetime as dt
import functools
import zoneinfo
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of months in English, French, German and Swahili, by number.
MONTHS = {
    1: "jan january janvier janv januar jänner januari",
    2: "feb february février fevrier févr februar februari",
    3: "mar march mars märz maerz mrz machi",
    4: "apr april avril avr aprili",
    5: "may mai mei",
    6: "jun june juin juni",
    7: "jul july juillet juil juli julai",
    8: "aug august août aout agosti",
    9: "sep sept september septembre septemba",
    10: "oct october octobre okt oktober oktoba",
    11: "nov november novembre novemba",
    12: "dec december décembre decembre déc dez dezember desemba",
}
# Offsets of zone abbreviations, in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "WAT": 60,
    "CET": 60, "CEST": 120, "CAT": 120, "SAST": 120, "EET": 120, "EEST": 180, "EAT": 180,
    "MSK": 180, "IST": 330, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
# Words for units of an age, with their milliseconds.
UNITS = {
    1_000: "s sec secs second seconds",
    60_000: "m min mins minute minutes",
    3_600_000: "h hr hrs hour hours",
    86_400_000: "d day days",
    604_800_000: "w wk wks week weeks",
}

_ZONE = r"(Z|z|[+-][0-9]{2}:?[0-9]{2}|[A-Z]{2,5})"
_CLOCK = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)?"
#: (pattern, parts as year|month|day|hour|minute|second|fraction|half of day|zone|month word?)
SHAPES = (
    (rf"^([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})(?:[T ]{_CLOCK}[ ]?{_ZONE}?)?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})(?:T([0-9]{2})([0-9]{2})([0-9]{2})?" + _ZONE + r"?)?$", "$1|$2|$3|$4|$5|$6|||$7"),
    (rf"^[A-Za-z]{{3}},? ([A-Za-z]{{3}}) +([0-9]{{1,2}}) {_CLOCK}(?: {_ZONE})? ([0-9]{{4}})$", "$8|$1|$2|$3|$4|$5|$6||$7"),
    (rf"^(?:[A-Za-z]{{3}},? )?([0-9]{{1,2}}) ([A-Za-z]{{3}}) ([0-9]{{4}}) {_CLOCK}(?: {_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (rf"^([\p{{L}}]+)[.]? ([0-9]{{1,2}}),? ([0-9]{{4}})(?:,?(?: at)? {_CLOCK}[ \x{{202F}}]?([AaPp])?(?:[.]?[Mm][.]?)?)?$", "$3|$1|$2|$4|$5|$6|$7|$8|"),
    (rf"^([0-9]{{1,2}})[.]? ([\p{{L}}]+)[.]? ([0-9]{{4}})(?:,?(?: à| saa| um| at)? {_CLOCK}(?: Uhr)?)?$", "$3|$2|$1|$4|$5|$6|$7||"),
)
_SLASH = rf"^([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}})(?:,? +{_CLOCK}[ \x{{202F}}]?([AaPp])?(?:[.]?[Mm][.]?)?)?$"
_AGE = r"^([0-9]{1,6}) ?([a-z]+)(?: ago)?(?: • Edited)?$"
_EPOCH = r"^[0-9]{9,10}(?:[.][0-9]{1,9})?$|^[0-9]{12,13}$|^[0-9]{15,16}$|^[0-9]{18,19}$"


def _words(by_number: dict) -> Column:
    return F.create_map(*[F.lit(x) for n, words in by_number.items() for w in words.split() for x in (w, n)])


def _int(c: Column) -> Column:
    return F.expr("try_cast(_ as int)") if c is None else c.try_cast("int")


def with_parts(df: DataFrame, value: str, zone: str, scraped: str) -> DataFrame:
    """Adds ``_utc`` (instants known at once), ``_local`` (local milliseconds) and ``_off``."""
    v = F.regexp_replace(F.trim(F.col(value)), "[\\x{A0}\\x{202F}]", " ")
    month_first = F.coalesce(F.col(zone), F.lit("")).startswith("America/")
    shaped = F.when(F.col("_v").rlike(_SLASH), F.when(month_first, F.regexp_replace("_v", _SLASH, "$3|$1|$2|$4|$5|$6|$7|$8|")).otherwise(F.regexp_replace("_v", _SLASH, "$3|$2|$1|$4|$5|$6|$7|$8|")))
    for pattern, parts in SHAPES:
        shaped = shaped.when(F.col("_v").rlike(pattern), F.regexp_replace("_v", pattern, parts))
    df = df.withColumn("_v", v).withColumn("_p", F.split(shaped, "[|]"))
    p = [F.col("_p")[i] for i in range(9)]
    month = F.coalesce(_int(p[1]), F.element_at(_words(MONTHS), F.lower(p[1])))
    half = F.lower(p[7])
    hour = F.coalesce(_int(p[3]), F.lit(0))
    hour = F.when(half == "", hour).when((hour < 1) | (hour > 12), F.lit(None)).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
    second = F.coalesce(_int(p[5]), F.lit(0))
    local = F.unix_millis(F.try_make_timestamp(_int(p[0]), month, _int(p[2]), hour, F.coalesce(_int(p[4]), F.lit(0)), F.when(second < 60, second).cast("decimal(16,6)"), F.lit("UTC")))
    local = local + F.coalesce(_int(F.rpad(F.substring(p[6], 1, 3), 3, "0")), F.lit(0))
    sign = F.when(p[8].startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(p[8], "[^0-9]", "")
    named = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    offset = (
        F.when(p[8] == "", F.lit(None))
        .when(p[8].rlike("^[+-]"), sign * (_int(F.substring(digits, 1, 2)) * 60 + _int(F.substring(digits, 3, 2))))
        .otherwise(F.element_at(named, F.upper(p[8])))
    )
    whole = F.regexp_extract("_v", "^[0-9]+", 0)
    epoch = F.when(
        F.col("_v").rlike(_EPOCH),
        F.when(F.length(whole) <= 10, whole.try_cast("bigint") * 1000 + F.coalesce(F.rpad(F.regexp_extract("_v", "[.]([0-9]{1,3})", 1), 3, "0").try_cast("bigint"), F.lit(0)))
        .when(F.length(whole) <= 13, whole.try_cast("bigint"))
        .when(F.length(whole) <= 16, F.floor(whole.try_cast("bigint") / 1000))
        .otherwise(F.floor(whole.try_cast("decimal(20,0)") / 1000000)),
    )
    unit = F.element_at(_words(UNITS), F.regexp_extract("_v", _AGE, 2))
    age = F.when(F.col("_v").rlike(_AGE), F.unix_seconds(F.col(scraped)) * 1000 - F.regexp_extract("_v", _AGE, 1).try_cast("bigint") * unit)
    return (
        df.withColumn("_local", local)
        .withColumn("_off", offset)
        .withColumn("_badzone", (p[8] != "") & F.col("_off").isNull())
        .withColumn("_utc", F.coalesce(epoch.cast("bigint"), age, F.when(F.col("_off").isNotNull(), F.col("_local") - F.col("_off") * 60000)))
        .drop("_p")
    )


@functools.lru_cache(maxsize=None)
def zone_intervals(zone: str, first: int = 1970, last: int = 2039) -> tuple[tuple[int, int, int], ...]:
    """(local start, local end, offset), in ms: the spans in which one offset of the zone holds.

    The local spans of neighbours overlap where clocks go back and leave a gap where they
    go forward.  Transitions are found by bisection between samples ten days apart.
    """
    info, utc = zoneinfo.ZoneInfo(zone), dt.timezone.utc
    at = lambda s: int(dt.datetime.fromtimestamp(s, utc).astimezone(info).utcoffset().total_seconds())
    lo, hi = (int(dt.datetime(y, 1, 1, tzinfo=utc).timestamp()) for y in (max(first, 1), min(last + 1, 9999)))
    lo, hi = lo + (3 * 86_400 if first < 1 else 0), hi + (363 * 86_400 if last > 9998 else 0)  # all that a datetime holds in any zone
    ends = (4 * 86_400_000 if first < 1 else 0, 4 * 86_400_000 if last > 9998 else 0)
    step, out, begin, offset = 864_000, [], lo, at(lo)
    s = lo
    while s < hi:
        t = min(s + step, hi)
        if (new := at(t)) != offset:
            a, b = s, t
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if at(m) == offset else (a, m)
            out.append(((begin + offset) * 1000, (b + offset) * 1000, offset * 1000))
            begin, offset, s = b, at(b), b
        else:
            s = t
    out.append(((begin + offset) * 1000, (hi + offset) * 1000, offset * 1000))
    out[0] = (out[0][0] - ends[0], *out[0][1:])
    out[-1] = (out[-1][0], out[-1][1] + ends[1], out[-1][2])
    return tuple(out)


def offset_table(spark: SparkSession, zones: list[str], others: Sequence[tuple[str, int]] = ()) -> DataFrame:
    """One row for each zone and local year with the intervals that touch it.

    At most (zones of the IANA base, about 600) x 70 rows, whatever the data hold, besides
    the ``others``: (zone, year) that lie outside or at the edge of those years.
    """
    rows: dict[tuple[str, int], list] = {}
    year = lambda ms: dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).year
    for z in sorted(zones):
        by: dict[int, list] = {}
        for a, b, off in zone_intervals(z):
            for y in range(year(a), year(b - 1) + 1):
                by.setdefault(y, []).append((a, b, off))
        rows |= {(z, y): v for y, v in by.items()}
    rows |= {(z, y): list(zone_intervals(z, y - 1, y + 1)) for z, y in others}
    span = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("a", "b", "off")]))
    return spark.createDataFrame([(*k, v) for k, v in rows.items()], T.StructType([T.StructField("_zone", T.StringType()), T.StructField("_year", T.IntegerType()), T.StructField("_spans", span)]))


def known_zones(df: DataFrame, zone: str) -> list[str]:
    """The zones of the IANA base that the column names (a distinct: at most about 600 values)."""
    known = sorted(zoneinfo.available_timezones())
    seen = df.select(F.trim(F.col(zone)).alias("z")).where(F.col("z").isin(known)).distinct()
    return [r.z for r in seen.collect()]


def to_instants(df: DataFrame, value: str, zone: str, scraped: str, zones: list[str] | None = None) -> DataFrame:
    """Adds ``utc_ms`` and ``time_status`` (see the module's text) to ``df``."""
    spark = df.sparkSession
    zones = known_zones(df, zone) if zones is None else zones
    df = with_parts(df.drop("utc_ms", "time_status"), value, zone, scraped)
    name = F.when(F.trim(F.col(zone)) == "", F.lit(None)).otherwise(F.trim(F.col(zone)))
    needs = F.col("_utc").isNull() & F.col("_local").isNotNull() & ~F.coalesce(F.col("_badzone"), F.lit(False))
    df = df.withColumn("_z", F.when(needs, F.coalesce(name, F.lit("UTC")))).withColumn("_y", F.year(F.timestamp_millis(F.col("_local"))))
    zones = sorted({*zones, "UTC"})
    # Picked out here, as a filter would be pushed below and repeat all expressions of the parts.
    seen = df.select(F.when(F.col("_z").isin(zones), F.col("_z")).alias("_z"), "_y").distinct().collect()
    offsets = offset_table(spark, zones, [(r["_z"], r["_y"]) for r in seen if r["_z"] is not None and not 1971 <= r["_y"] <= 2038])
    df = df.join(F.broadcast(offsets), (F.col("_z") == F.col("_zone")) & (F.col("_y") == F.col("_year")), "left")
    hits = F.filter("_spans", lambda s: (F.col("_local") >= s["a"]) & (F.col("_local") < s["b"]))
    df = df.withColumn("_hits", F.transform(hits, lambda s: F.col("_local") - s["off"]))
    n = F.size("_hits")
    utc = F.coalesce(F.col("_utc"), F.when(n > 0, F.array_min("_hits")))
    status = (
        F.when(F.col("_utc").isNotNull(), F.lit("exact"))
        .when(F.col("_z").isNull(), F.when(F.col("_badzone") & F.col("_local").isNotNull(), F.lit("unknown_zone")).otherwise(F.lit("none")))
        .when(F.col("_zone").isNull(), F.lit("unknown_zone"))
        .when(n == 0, F.lit("nonexistent"))
        .when(n > 1, F.lit("ambiguous"))
        .otherwise(F.lit("local"))
    )
    return df.withColumns({"utc_ms": utc, "time_status": status}).drop("_v", "_local", "_off", "_badzone", "_utc", "_z", "_y", "_zone", "_year", "_spans", "_hits")


def p2_found(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """(field, row_key, utc_ms): one row for each value that denotes an instant."""
    a = posts.select(F.lit("post_date").alias("field"), F.col("post_key").alias("row_key"), F.col("post_date").alias("value"), "tz_name", "scraped_at")
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("created_time", "comment_timestamp")])
    b = comments.select(F.explode(each).alias("e"), F.col("comment_key").alias("row_key"), "tz_name", "scraped_at").select("e.field", "row_key", "e.value", "tz_name", "scraped_at")
    zones = sorted({*known_zones(posts, "tz_name"), *known_zones(comments, "tz_name")})
    rows = a.unionByName(b).where(F.col("value").isNotNull())
    return to_instants(rows, "value", "tz_name", "scraped_at", zones).where(F.col("utc_ms").isNotNull()).select("field", "row_key", "utc_ms").distinct()
