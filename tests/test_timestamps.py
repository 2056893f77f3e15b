import datetime as dt

import pytest

from terrasieve.functions.timestamps import normalise_timestamps

LOOKUP = [("berlin", "Europe/Berlin", "DMY"), ("ny", "America/New_York", "MDY"), ("lh", "Australia/Lord_Howe", "DMY"), ("odd", "Mars/Base", "DMY"), (None, "UTC", None)]


def run(spark, rows, **policy):
    df = spark.createDataFrame([(i, s, v, "x") for i, (s, v) in enumerate(rows)], "id long, src string, t string, zone string")
    out = normalise_timestamps(df, "id", ["t"], "src", spark.createDataFrame(LOOKUP, "src string, tz_name string, date_order string"), **policy).collect()
    return [(r.status, r.instant_us) for r in sorted(out)]


def us(*a, frac=0):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000 + frac


def test_forms(spark):
    rows = [
        ("berlin", "2017-08-07T15:22:59.690493"), ("ny", "3/17/2017 3:02:53 AM"), ("berlin", "03/04/2017 10:00:00"), ("ny", "03/04/2017 10:00:00"), ("berlin", "07.07.2020 10:01"),
        ("berlin", "19-Jun-2016 17:56:28"), ("ny", "Tue, 07 Apr 2015 11:00:03 GMT"), ("ny", "2017-01-29 19:33:27 EST"), ("ny", "2014-07-04T13:43:42+0530"), ("berlin", "2019-05-01T20:12:37+01:00[Europe/Lisbon]"),
        ("ny", "20170719T052528Z"), ("berlin", "20161106002024"), ("berlin", "1444316756"), ("berlin", "1444316756.1234567"), ("berlin", "1444316756842"), ("berlin", "1444316756842123"),
        ("berlin", " 2016-05-08 22:49:51.9999999  "), ("berlin", "2017-08-05"), ("ny", "12/1/2017 12:05:00 AM"),
    ]
    assert [x[1] for x in run(spark, rows)] == [
        us(2017, 8, 7, 13, 22, 59, frac=690493), us(2017, 3, 17, 7, 2, 53), us(2017, 4, 3, 8), us(2017, 3, 4, 15), us(2020, 7, 7, 8, 1),
        us(2016, 6, 19, 15, 56, 28), us(2015, 4, 7, 11, 0, 3), us(2017, 1, 30, 0, 33, 27), us(2014, 7, 4, 8, 13, 42), us(2019, 5, 1, 19, 12, 37),
        us(2017, 7, 19, 5, 25, 28), us(2016, 11, 5, 23, 20, 24), 1444316756000000, 1444316756123456, 1444316756842000, 1444316756842123,
        us(2016, 5, 8, 20, 49, 51, frac=999999), us(2017, 8, 4, 22), us(2017, 12, 1, 5, 5),
    ]


def test_clock_changes(spark):
    rows = [("berlin", "2017-03-26 02:30:00"), ("berlin", "2017-10-29 02:30:00"), ("lh", "2019-04-07 01:45:00"), ("lh", "2019-10-06 02:15:00"), ("ny", "2018-11-04 01:59:59")]
    assert run(spark, rows) == [("never", None), ("twice", us(2017, 10, 29, 0, 30)), ("twice", us(2019, 4, 6, 14, 45)), ("never", None), ("twice", us(2018, 11, 4, 5, 59, 59))]


def test_no_cases(spark):
    rows = [("berlin", v) for v in ("2017-02-29", "2017-13-01 00:00:00", "2017-01-01 24:00:00", "2017-01-01 10:60:00", "2017-01-01 10:00:60", "0000-00-00 00:00:00", "31.04.2017 10:00", "3/17/2017 13:00:00 AM", "2017-01-01 10:00:00 EST", "2017-01-01T00:00:00+19:00")]
    assert all(s == ("impossible", None) for s in run(spark, rows))
    assert [s for s, _ in run(spark, [("berlin", v) for v in ("n/a", "", "-", "1e99", "x" * 100_000)])] == ["unreadable"] * 5
    assert run(spark, [("berlin", None), (None, "2017-01-01 00:00:00"), ("who", "2017-01-01"), ("odd", "2017-01-01"), ("odd", "2017-01-01T00:00:00Z")]) == [(None, None), ("no_zone", None), ("no_zone", None), ("no_zone", None), ("ok", us(2017, 1, 1))]


def test_empty_and_repeated(spark):
    assert run(spark, []) == []
    assert run(spark, [("ny", "2017-01-01")] * 3) == [("ok", us(2017, 1, 1, 5))] * 3


def test_zones_in_the_value_decide(spark):
    rows = [("berlin", "2024-01-01T10:00:00[America/New_York]"), ("who", "2024-07-01 10:00 [Asia/Kolkata]"), ("berlin", "2024-01-01T10:00:00[Mars/Base]"), ("ny", "2024-01-01 10:00:00 UTC+2"), ("ny", "2024-01-01 10:00:00 GMT-3:30"), ("ny", "2024-01-01 10:00:00 UTC+02:00"), ("ny", "2024-01-01 10:00:00+5")]
    assert run(spark, rows) == [("ok", us(2024, 1, 1, 15)), ("ok", us(2024, 7, 1, 4, 30)), ("no_zone", None), ("ok", us(2024, 1, 1, 8)), ("ok", us(2024, 1, 1, 13, 30)), ("ok", us(2024, 1, 1, 8)), ("unreadable", None)]


def test_policies(spark):
    rows = [("berlin", "2017-03-26 02:30:00"), ("berlin", "2017-10-29 02:30:00"), ("lh", "2019-04-07 01:45:00"), ("berlin", "2017-10-29 03:30:00"), ("berlin", "2005-01-01 00:00:00[Antarctica/Troll]")]
    last = run(spark, rows, twice="last", never="forward")
    assert last[:4] == [("never", us(2017, 3, 26, 1, 30)), ("twice", us(2017, 10, 29, 1, 30)), ("twice", us(2019, 4, 6, 15, 15)), ("ok", us(2017, 10, 29, 2, 30))]
    assert [x[1] for x in run(spark, rows, twice="reject")[:3]] == [None] * 3
    assert run(spark, [("berlin", "2017-10-29 02:00:00[Antarctica/Troll]")]) == [("twice", us(2017, 10, 29, 0, 0))]
    with pytest.raises(ValueError):
        run(spark, rows, twice="sometimes")


def test_many_sources(spark):
    """Zones of more than a thousand sources are all known."""
    zones = ["Europe/Berlin", "Asia/Tokyo", "America/New_York"]
    lookup = spark.range(3000).selectExpr("concat('s', id) as src", f"array({', '.join(repr(z) for z in zones)})[id % 3] as tz_name", "'DMY' as date_order")
    df = spark.range(3000).selectExpr("id", "concat('s', id) as src", "'2017-01-01' as t")
    assert normalise_timestamps(df, "id", ["t"], "src", lookup).where("instant_us is null").count() == 0
