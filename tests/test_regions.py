import datetime as dt

from mentionlake.operators import fusion


def test_no_region_is_left_out(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 12)), (2, dt.datetime(2024, 1, 1, 5)), (3, None)], "k int, ts timestamp")
    regions = spark.createDataFrame([(0, f"r{i}") for i in range(150)] + [(3, "east"), (3, "east")], "offset int, region string")
    got = {(r.k, r.location, r.confidence, r.source) for r in fusion.timing_signals(df, "k", "ts", regions).collect()}
    assert got == {(1, f"r{i}", 0.2, "post_timing_peak") for i in range(150)} | {(1, "east", 0.2, "post_timing_peak"), (2, "east", 0.1, "post_timing_active")}
