import numpy as np
import pytest

from carex.functions.zones import local_to_utc
from carex.operators.timestamps import Normaliser, normal_forms, timestamp_rows

SITES = {"ny": ("America/New_York", "en-US"), "paris": ("Europe/Paris", "fr-FR"), "berlin": ("Europe/Berlin", "de-DE"), "old": (None, "en-GB")}


def norm(text, site=None, date=False):
    return Normaliser(SITES)([text], [site], np.array([date]))[0]


@pytest.mark.parametrize(
    "text, site, want",
    [
        ("2024-05-11T13:05Z", None, "2024-05-11T13:05:00.000Z"),
        (" 2024-11-07t02:18:05z", None, "2024-11-07T02:18:05.000Z"),
        ("20230529155611+0530", None, "2023-05-29T10:26:11.000Z"),
        ("1706573133", None, "2024-01-30T00:05:33.000Z"),
        ("1669376972419", None, "2022-11-25T11:49:32.419Z"),
        ("2024-10-10T09:33:29.506999999+00:00", None, "2024-10-10T09:33:29.506Z"),
        ("Thu, 11 May 2023 21:15:51 +0200", None, "2023-05-11T19:15:51.000Z"),
        ("Fri, 11 May 2023 21:15:51 +0200", None, None),
        ("22. Juni 2025, 09:07 Uhr", "berlin", "2025-06-22T07:07:00.000Z"),
        ("25 août 2021 à 21:05", "paris", "2021-08-25T19:05:00.000Z"),
        ("12/13/2023 12:11am", "ny", "2023-12-13T05:11:00.000Z"),
        ("13/12/2023", "ny", None),
        ("13/12/2023", "old", "2023-12-13"),
        ("05/06/2022", None, None),
        ("05/05/2022", None, "2022-05-05"),
        ("2024-12-22T02:58:00[America/Los_Angeles]", None, "2024-12-22T10:58:00.000Z"),
        ("2024-07-24 12:44:01 CDT", "ny", "2024-07-24T17:44:01.000Z"),
        ("2024-07-24 12:44:01 XYZ", "ny", None),
        ("2023-10-29T02:01:48", "paris", None),  # shown twice
        ("2023-03-26T02:30:00", "paris", None),  # never shown
        ("2024-01-01 10:00:00", "old", None),  # unknown zone
        ("2024-366", None, "2024-12-31"),
        ("2023-366", None, None),
        ("2024-02", None, "2024-02"),
        ("2024", None, "2024"),
        ("2021-02-29", None, None),
        ("2025-03-04T25:10:00Z", None, None),
        ("T07:17:00", None, None),
        ("--04-24", None, None),
        ("", None, None),
        ("   ", None, None),
        (None, None, None),
        ("2024-01-01" * 20, None, None),
        ("heute", None, None),
    ],
)
def test_forms(text, site, want):
    assert norm(text, site) == want


def test_birth_dates_lose_their_time():
    assert norm("2011-09-25T23:00:00-09:00", None, True) == "2011-09-25"
    assert norm("19830413", None, True) == "1983-04-13"


def test_zone_tables_agree_with_the_library():
    from datetime import datetime, timedelta
    from zoneinfo import ZoneInfo

    rng = np.random.default_rng(5)
    for zone in ("America/New_York", "Australia/Sydney", "Asia/Kolkata", "Europe/London"):
        local = rng.integers(0, 2_000_000_000, 3000)
        utc, ok = local_to_utc(local, zone)
        for x, u, fine in zip(local.tolist(), utc.tolist(), ok.tolist()):
            naive = datetime(1970, 1, 1) + timedelta(seconds=x)
            both = {naive.replace(tzinfo=ZoneInfo(zone), fold=f).timestamp() for f in (0, 1)}
            if fine:
                assert both == {float(u)}
            else:
                assert len(both) == 2


def test_rows_nulls_repeats_and_empty_tables(spark):
    schema = "id string, a string, b string, source_system string, text string, date_only string"
    df = spark.createDataFrame([("x", "2024-01-02", None, None, "t", "d")] * 2 + [(None, "2024", "2024", "ny", "t", "d"), ("y", "bad", "", "ny", "t", "d")], schema)
    sites = spark.createDataFrame([(k, *v) for k, v in SITES.items()], "source_system string, zone_name string, locale string")
    rows = timestamp_rows(df, "t", "id", {"a": False, "b": True}, unique=False)
    assert [tuple(r) for r in normal_forms(rows, sites).collect()] == [("t", "x", "a", "2024-01-02")]
    assert normal_forms(timestamp_rows(df.limit(0), "t", "id", {"a": False}), sites.limit(0)).count() == 0
    with pytest.raises(Exception, match="release"):
        normal_forms(rows, sites, version="1999a").collect()


def test_long_texts_and_far_years():
    assert norm("2024-05-11T13:05:00." + "1" * 120 + "Z") == "2024-05-11T13:05:00.111Z"
    assert norm("2024-05-11T13:05:00Z" + " " * 500) == "2024-05-11T13:05:00.000Z" and norm("2024 " * 300_000) is None
    got = Normaliser(SITES)(["2024-05-11", "9" * 200, "2024-05-11T10:00:00." + "9" * 100 + "Z", None], [None] * 4, np.zeros(4, bool))
    assert list(got) == ["2024-05-11", None, "2024-05-11T10:00:00.999Z", None]
    for year in (2099, 2101, 2499, 2501, 2903, 9990):
        assert norm(f"{year}-07-01T12:00:00", "berlin") == f"{year}-07-01T10:00:00.000Z"
        assert norm(f"{year}-01-15T12:00:00", "ny") == f"{year}-01-15T17:00:00.000Z"
