from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.functions.zones import zone_table
from lodestrata.operators.timestamps import normalise_timestamps, parser_of, shape_mask, to_utc_us

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def us(*a, tz=timezone.utc):
    return int((datetime(*a, tzinfo=tz) - EPOCH) / timedelta(microseconds=1))


def convert(value, zone="UTC", order="YMD"):
    names = [z for z in [zone] if z]
    out = to_utc_us(pd.Series([value]), pd.Series([zone]), pd.Series([order]), {n: zone_table(n) for n in names})[0]
    return None if pd.isna(out) else int(out)


def test_forms():
    for value, zone, order, want in [
        ("2020-01-02", "Asia/Tokyo", "YMD", us(2020, 1, 1, 15)), ("2020-01-02T03:04:05.1234567Z", "Asia/Tokyo", "YMD", us(2020, 1, 2, 3, 4, 5, 123456)),
        ("03/04/2020 01:02:03", "UTC", "DMY", us(2020, 4, 3, 1, 2, 3)), ("03/04/2020 01:02:03", "UTC", "MDY", us(2020, 3, 4, 1, 2, 3)), ("03/04/20", "UTC", "YMD", us(2003, 4, 20)),
        ("12/31/2020 12:00:00 AM", "UTC", "MDY", us(2020, 12, 31)), ("31/12/2020", "UTC", "MDY", None), ("2019-02-30", "UTC", "YMD", None), ("0000-00-00 00:00:00", "UTC", "YMD", None),
        ("1600000000", "Asia/Tokyo", "YMD", 1600000000_000000), ("1600000000123", "UTC", "YMD", 1600000000123_000), ("1600000000123456", "UTC", "YMD", 1600000000123456), ("1600000000123456789", "UTC", "YMD", 1600000000123456),
        ("1600000000.5", "UTC", "YMD", 1600000000_500000), ("20200704T103011Z", "UTC", "YMD", us(2020, 7, 4, 10, 30, 11)), ("20. März 2025, 22:24 Uhr", "Europe/Berlin", "DMY", us(2025, 3, 20, 21, 24)),
        ("Mon, 02 Jan 2006 15:04:05 -0700", "UTC", "YMD", us(2006, 1, 2, 22, 4, 5)), ("May 17, 2023 4:13 a.m.", "UTC", "MDY", us(2023, 5, 17, 4, 13)), ("2017-01-24 17:34:54 UTC+2", "UTC", "YMD", us(2017, 1, 24, 15, 34, 54)),
        ("2019-09-05T07:13:56-04:00[America/New_York]", "UTC", "YMD", us(2019, 9, 5, 11, 13, 56)), ("2019-09-05T07:13:56[America/New_York]", "UTC", "YMD", us(2019, 9, 5, 11, 13, 56)), ("unknown", "UTC", "YMD", None), ("", "UTC", "YMD", None), (None, "UTC", "YMD", None),
        ("2020-01-02 03:04:05 EST", "America/New_York", "MDY", us(2020, 1, 2, 8, 4, 5)), ("2020-13-01", "UTC", "YMD", None), ("2020-01-02T25:00:00Z", "UTC", "YMD", None), ("2020-01-01T00:00:00", None, None, us(2020, 1, 1)),
    ]:
        assert convert(value, zone, order) == want, value


def test_daylight_saving():
    # twice: the first occurrence; skipped: forward by the gap
    assert convert("2021-10-31 02:30:00", "Europe/Berlin") == us(2021, 10, 31, 0, 30)
    assert convert("2021-03-28 02:30:00", "Europe/Berlin") == us(2021, 3, 28, 1, 30)
    assert convert("2021-11-07 01:30:00", "America/New_York") == us(2021, 11, 7, 5, 30)


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(1950, 1, 1), datetime(2090, 1, 1)), st.sampled_from(["Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Sydney", "UTC"]))
def test_tables_agree_with_zoneinfo(t, zone):
    t = t.replace(microsecond=0)
    local = t.replace(tzinfo=ZoneInfo(zone), fold=0)
    assert convert(t.strftime("%Y-%m-%d %H:%M:%S").rjust(19, "0"), zone) == int((local.astimezone(timezone.utc) - EPOCH).total_seconds()) * 1_000_000


def test_masks_are_parsed_once():
    assert shape_mask("Tue,  2 März 2021\t01:02") == "a, 9 a 9999 99:99"
    before = parser_of.cache_info().misses
    for d in range(10, 20):
        convert(f"2031-07-{d} 10:11:12")
    assert parser_of.cache_info().misses - before <= 1


def test_frame_edges(spark):
    rows_ = spark.createDataFrame([(1, 9, "2020-01-01", None, "x"), (2, None, "bad", " 2020-01-01T00:00:00Z ", "y"), (1, 9, "2020-01-01", None, "x")], "id long, source_id long, a string, b string, time_zone string")
    feeds = spark.createDataFrame([(9, "Asia/Tokyo", "YMD"), (9, "Asia/Tokyo", "YMD"), (8, "No/Such", None)], "id long, time_zone string, date_order string")
    got = normalise_timestamps(rows_, feeds, "id", "source_id", ["a", "b"]).collect()
    assert sorted((r.id, r.field_name, r.utc_us) for r in got if r.utc_us is not None) == [(1, "a", us(2019, 12, 31, 15)), (1, "a", us(2019, 12, 31, 15)), (2, "b", us(2020, 1, 1))]
    assert normalise_timestamps(rows_.limit(0), feeds.limit(0), "id", "source_id", ["a"]).count() == 0


def test_any_year():
    import datetime as dt
    from zoneinfo import ZoneInfo

    import numpy as np

    for zone in ("Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kathmandu", "Africa/Casablanca"):
        t = zone_table(zone)
        for year in (1805, 1890, 1950, 2037, 2098, 2099, 2110, 2499, 2500, 2999, 9998):
            for month in (1, 7):
                wall = dt.datetime(year, month, 15, 12, tzinfo=dt.timezone.utc)
                want = dt.datetime(year, month, 15, 12, tzinfo=ZoneInfo(zone)).utcoffset().total_seconds()
                got = wall.timestamp() - t.to_utc(np.array([int(wall.timestamp())]))[0]
                assert got == want, (zone, year, month)


def test_more_feeds_than_zones(spark):
    """Names of no zone, however many, take nothing from the zones that exist."""
    feeds = spark.createDataFrame([(n, f"No/Zone{n:05}", "YMD") for n in range(1500)] + [(5000, "Europe/Berlin", "DMY")], "id long, time_zone string, date_order string")
    rows_ = spark.createDataFrame([(1, 5000, "2110-07-01 12:00 CEST"), (2, 5000, "01.07.2110 12:00"), (3, 7, "2110-07-01 12:00")], "id long, source_id long, t string")
    got = {r.id: r.utc_us for r in normalise_timestamps(rows_, feeds, "id", "source_id", ["t"]).collect()}
    assert got[1] == got[2] == got[3] - 2 * 3600 * 1_000_000
