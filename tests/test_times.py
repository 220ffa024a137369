import datetime as dt
import zoneinfo

from hypothesis import given, settings
from hypothesis import strategies as st

from mentionlake.operators import times

SCHEMA = "k int, v string, tz_name string, scraped_at timestamp, utc_ms string"
AT = dt.datetime(2025, 1, 10, 12, 0, 0, 999000)


def instants(spark, rows):
    df = spark.createDataFrame([(i, v, z, AT, "mine") for i, (v, z) in enumerate(rows)], SCHEMA)
    got = times.to_instants(df, "v", "tz_name", "scraped_at").collect()
    return [(r.utc_ms, r.time_status) for r in sorted(got, key=lambda r: r.k)]


def ms(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1000)


def test_shapes(spark):
    want = [
        ("2024-01-02T03:04:05.6789Z", None, ms(2024, 1, 2, 3, 4, 5) + 678), ("2024-01-02 03:04:05+0530", None, ms(2024, 1, 1, 21, 34, 5)), ("20240102T030405Z", None, ms(2024, 1, 2, 3, 4, 5)),
        ("Tue Jan 02 03:04:05 +0000 2024", None, ms(2024, 1, 2, 3, 4, 5)), ("Tue, 2 Jan 2024 03:04:05 GMT", None, ms(2024, 1, 2, 3, 4, 5)), ("1704164645", None, ms(2024, 1, 2, 3, 4, 5)),
        ("1704164645.25", None, ms(2024, 1, 2, 3, 4, 5) + 250), ("1704164645678901", None, ms(2024, 1, 2, 3, 4, 5) + 678), ("2024-01-02", "Africa/Nairobi", ms(2024, 1, 1, 21)),
        ("3/4/2024 1:02 PM", "America/New_York", ms(2024, 3, 4, 18, 2)), ("3/4/2024, 13:02", "Europe/Berlin", ms(2024, 4, 3, 11, 2)), ("2. März 2024, 05:06 Uhr", "Europe/Berlin", ms(2024, 3, 2, 4, 6)),
        ("8 Aprili 2024, saa 14:18", None, ms(2024, 4, 8, 14, 18)), ("19 mai 2023 à 07:03", None, ms(2023, 5, 19, 7, 3)), ("Oct 23, 2023 at 12:29 AM", None, ms(2023, 10, 23, 0, 29)),
        ("2024-05-09 16:19:18 EAT", "Asia/Kolkata", ms(2024, 5, 9, 13, 19, 18)), ("3m", None, ms(2025, 1, 10, 11, 57)), ("2 weeks ago", None, ms(2024, 12, 27, 12)), ("1d • Edited", None, ms(2025, 1, 9, 12)),
    ]
    assert [x[0] for x in instants(spark, [(v, z) for v, z, _ in want])] == [w for *_, w in want]


def test_no_dates(spark):
    got = instants(spark, [(v, None) for v in ("0", "", "  ", None, "N/A", "-", "00/00/0000", "2024-13-45T99:00:00", "2024-02-30", "x" * 5000)])
    assert got == [(None, "none")] * 10


def test_ambiguous_skipped_and_unknown(spark):
    got = instants(spark, [("2024-11-03 01:30", "America/New_York"), ("2024-03-10 02:30", "America/New_York"), ("2024-01-01 00:00", "Nowhere/Town"), ("2024-01-01 00:00 QQQ", None), ("2024-01-01 00:00", " ")])
    assert got == [(ms(2024, 11, 3, 5, 30), "ambiguous"), (None, "nonexistent"), (None, "unknown_zone"), (None, "unknown_zone"), (ms(2024, 1, 1), "local")]


def test_empty_table(spark):
    assert times.to_instants(spark.createDataFrame([], SCHEMA), "v", "tz_name", "scraped_at").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["America/New_York", "Europe/Berlin", "Africa/Nairobi", "Australia/Lord_Howe", "Asia/Kathmandu"]), st.integers(0, 2_000_000_000))
def test_intervals_agree_with_the_zone(zone, second):
    at = dt.datetime.fromtimestamp(second, dt.timezone.utc).astimezone(zoneinfo.ZoneInfo(zone))
    off = int(at.utcoffset().total_seconds()) * 1000
    local = second * 1000 + off
    assert off in [o for a, b, o in times.zone_intervals(zone) if a <= local < b]


def test_found_is_once_for_copies(spark):
    posts = spark.createDataFrame([(1, "2024-01-01", None, AT, "x")], "post_key bigint, post_date string, tz_name string, scraped_at timestamp, value string")
    comments = spark.createDataFrame([(7, "1704164645", "0", None, AT)] * 2, "comment_key bigint, created_time string, comment_timestamp string, tz_name string, scraped_at timestamp")
    assert sorted(map(tuple, times.p2_found(posts, comments).collect())) == [("created_time", 7, ms(2024, 1, 2, 3, 4, 5)), ("post_date", 1, ms(2024, 1, 1))]
