from datetime import datetime, timezone

import pytest

from ledgerloom.operators import instants

SYSTEMS = [("A", "America/New_York", "MDY"), ("B", "America/Phoenix", "DMY"), ("U", "UTC", "MDY"), ("X", "No/Where", "MDY")]


def us(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000


CASES = [
    ("2023-05-27T14:14:31-04:00", "A", us(2023, 5, 27, 18, 14, 31)),
    (" 2023-05-27T14:14:31Z ", "A", us(2023, 5, 27, 14, 14, 31)),
    ("2023-11-05T01:30:00", "A", us(2023, 11, 5, 5, 30)),  # twice: the first
    ("2023-03-12T02:30:00", "A", us(2023, 3, 12, 7, 30)),  # skipped: the offset before
    ("2023-03-12T02:30:00", "B", us(2023, 3, 12, 9, 30)),
    ("07/24/2022 22:05", "A", us(2022, 7, 25, 2, 5)),
    ("18/06/2022 11:31", "B", us(2022, 6, 18, 18, 31)),
    ("18/06/2022 11:31", "A", None),
    ("Nov 22, 2023 12:00:50 AM", "U", us(2023, 11, 22, 0, 0, 50)),
    ("25-Jan-2024 21:27:51 MST", "A", us(2024, 1, 26, 4, 27, 51)),
    ("15-Nov-23 16:43", "U", us(2023, 11, 15, 16, 43)),
    ("Wed, 23 Aug 2023 15:11:44 -0500", "A", us(2023, 8, 23, 20, 11, 44)),
    ("20240103T095332Z", "A", us(2024, 1, 3, 9, 53, 32)),
    ("20240103095332", "U", us(2024, 1, 3, 9, 53, 32)),
    ("1711771576", "A", 1711771576 * 1_000_000),
    ("1711771576123", "X", 1711771576123 * 1000),
    ("1711771576123456", None, 1711771576123456),
    ("2024-01-02T03:04:05.123456789Z", "A", us(2024, 1, 2, 3, 4, 5) + 123456),
    ("2024-04-15T06:00:00-05:00[America/Chicago]", "A", us(2024, 4, 15, 11)),
    ("2022-06-26T00:03Z", "A", us(2022, 6, 26, 0, 3)),
    ("2024-03-01T10:00:00[Europe/Berlin]", "A", us(2024, 3, 1, 9)),
    ("2024-03-01T10:00:00[Not/AZone]", "A", None),
    ("1960-07-01 10:00", "A", us(1960, 7, 1, 14)),
    ("1960-01-01 10:00", "A", us(1960, 1, 1, 15)),
    ("0000-01-01T00:00:00Z", "A", None),
    ("2023-05-27T14:14:31+19:00", "A", None),
    ("2024-01-02", "U", us(2024, 1, 2)),
    ("2023-02-30T00:00:00Z", "A", None),
    ("2023-01-02T25:00:00Z", "A", None),
    ("2023-01-02T03:04:05 QQQ", "A", None),
    ("2023-01-02T03:04:05", "X", None),
    ("2023-01-02T03:04:05", "unknown", None),
    ("2023-01-02T03:04:05", None, None),
    ("pending", "A", None),
    ("", "A", None),
    (None, "A", None),
    ("9" * 50_000, "A", None),
]


def test_forms(spark):
    rows = spark.createDataFrame([(i, s, system, "kept") for i, (s, system, _) in enumerate(CASES)], "i int, stamp string, source_system string, utc_micros string")
    systems = spark.createDataFrame(SYSTEMS, "source_system string, tz_name string, date_order string")
    got = {r["i"]: r["utc_micros"] for r in instants.to_instants(rows, "stamp", systems).collect()}
    assert [(CASES[i], got[i]) for i in range(len(CASES)) if got[i] != CASES[i][2]] == []


def test_kinds_and_empty(spark):
    systems = spark.createDataFrame(SYSTEMS, "source_system string, tz_name string, date_order string")
    rows = spark.createDataFrame([("2023-11-05T01:30:00", "A"), ("2023-03-12T02:30:00", "A"), ("2023-07-01T00:00:00", "A")], "stamp string, source_system string")
    assert sorted(r["local_kind"] for r in instants.to_instants(rows, "stamp", systems).collect()) == ["ambiguous", "skipped", "unique"]
    assert instants.to_instants(rows.limit(0), "stamp", systems).count() == 0


@pytest.mark.parametrize("zone", ["America/New_York", "Australia/Lord_Howe", "Pacific/Apia", "Asia/Kathmandu"])
def test_intervals_agree_with_zone_rules(zone):
    from zoneinfo import ZoneInfo

    found = instants.offset_intervals(zone, 2000, 2030)
    for second in range(us(2001, 1, 1) // 1_000_000, us(2029, 1, 1) // 1_000_000, 777_777):
        want = int(datetime.fromtimestamp(second, ZoneInfo(zone)).utcoffset().total_seconds())
        assert [o for s, o in found if s <= second][-1] == want
