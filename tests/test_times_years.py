import datetime as dt

from mentionlake.operators import times


def test_years_outside_the_fixed_range(spark):
    rows = [
        ("1965-07-01 12:00", None, dt.datetime(1965, 7, 1, 12)), ("2055-07-01 12:00", "America/New_York", dt.datetime(2055, 7, 1, 16)), ("1969-12-31 22:00", "America/New_York", dt.datetime(1970, 1, 1, 3)), ("1970-01-01 00:30", "Africa/Nairobi", dt.datetime(1969, 12, 31, 21, 30)),
        ("2040-01-01 01:00", "Africa/Nairobi", dt.datetime(2039, 12, 31, 22)), ("0001-01-01 00:00", None, dt.datetime(1, 1, 1)), ("9999-12-31 23:00", None, dt.datetime(9999, 12, 31, 23)), ("2055-03-14 02:30", "America/New_York", None),
    ]
    df = spark.createDataFrame([(i, v, z, None) for i, (v, z, _) in enumerate(rows)], "k int, v string, tz_name string, scraped_at timestamp")
    got = {r.k: r.utc_ms for r in times.to_instants(df, "v", "tz_name", "scraped_at").collect()}
    epoch = dt.datetime(1970, 1, 1)
    assert got == {i: None if w is None else round((w - epoch).total_seconds() * 1000) for i, (_, _, w) in enumerate(rows)}
