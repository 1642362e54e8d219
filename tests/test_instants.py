"""Times against hand-computed instants and against Python's own zone rules."""

import datetime as dt
import zoneinfo

import pytest

from sparkloka.operators import instants

UTC = dt.timezone.utc


def us(y, mo, d, h=0, mi=0, s=0, f=0, offset=0):
    return int((dt.datetime(y, mo, d, h, mi, s, tzinfo=UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() - offset * 3600) * 1_000_000 + f


CASES = [
    ("2025-03-01T10:00:00", "Asia/Jakarta", us(2025, 3, 1, 3)),
    ("2025-03-01 10:00:00.1234567", "Asia/Jakarta", us(2025, 3, 1, 3, f=123456)),
    ("2025-03-01T10:00+07", "Europe/Amsterdam", us(2025, 3, 1, 3)),
    ("20250301T100000-0400", None, us(2025, 3, 1, 14)),
    ("01/02/2025 13:08", "Asia/Jakarta", us(2025, 2, 1, 6, 8)),
    ("1/2/2025, 12:05 AM", "Asia/Jakarta", us(2025, 1, 1, 17, 5)),
    ("1/2/2025, 12:05 PM", "Asia/Jakarta", us(2025, 1, 2, 5, 5)),
    ("Selasa, 1 Oktober 2024 pukul 07.00 WIB", "America/New_York", us(2024, 10, 1)),
    ("10 Agu 2025 05.02 WIT", None, us(2025, 8, 9, 20, 2)),
    ("Wed, 01 Oct 2025 02:56:53 +0700", None, us(2025, 9, 30, 19, 56, 53)),
    ("Oct 11, 2024 at 7:54 AM", "Asia/Makassar", us(2024, 10, 10, 23, 54)),
    ("1727740800", None, us(2024, 10, 1)),
    ("1727740800123", None, us(2024, 10, 1, f=123000)),
    ("1727740800123456", None, us(2024, 10, 1, f=123456)),
    ("1727740800123456789", None, us(2024, 10, 1, f=123456)),
    ("2024-10-27 02:30:00", "Europe/Amsterdam", us(2024, 10, 27, 0, 30)),  # twice: the first
    ("2025-03-30 02:30:00", "Europe/Amsterdam", us(2025, 3, 30, 1, 30)),  # skipped: the offset before
    ("2025-11-02 01:23:42 EST", "America/New_York", us(2025, 11, 2, 6, 23, 42)),
    ("  2024-10-01t00:00:00z ", None, us(2024, 10, 1)),
    ("2025-02-30 10:00:00", "Asia/Jakarta", None),
    ("2025-13-05 08:00:00", "Asia/Jakarta", None),
    ("0000-00-00 00:00:00", "Asia/Jakarta", None),
    ("13/25/2025 10:00", "Asia/Jakarta", None),
    ("0", "Asia/Jakarta", None),
    ("belum diketahui", "Asia/Jakarta", None),
    ("2025-03-01 10:00:00 XYZ", "Asia/Jakarta", None),
    ("99999999999999999999", None, None),
    ("x" * 50_000, "Asia/Jakarta", None),
]


def test_forms(spark):
    df = spark.createDataFrame([(r, z) for r, z, _ in CASES], "raw string, zone string")
    got = {(r["raw"], r["zone"]): r["utc_us"] for r in instants.parse_raw(df).collect()}
    for raw, zone, want in CASES:
        assert got[raw, zone] == want, raw[:60]


@pytest.mark.parametrize("zone", ["Europe/Amsterdam", "America/New_York", "Australia/Sydney", "Asia/Jakarta"])
def test_local_times_by_zone(spark, zone):
    z = zoneinfo.ZoneInfo(zone)
    walls = [dt.datetime(2024, 10, 1) + dt.timedelta(minutes=37 * i) for i in range(0, 12_000, 7)]
    df = spark.createDataFrame([(w.strftime("%Y-%m-%d %H:%M:%S"), zone) for w in walls], "raw string, zone string")
    got = {r["raw"]: r["utc_us"] for r in instants.parse_raw(df).collect()}
    for w in walls:
        want = w.replace(tzinfo=z, fold=0)
        assert got[w.strftime("%Y-%m-%d %H:%M:%S")] == int((want - dt.datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 1_000_000, w


POSTS = "row_id long, timestamp string, collected_at string, city string, scrape_mode string, utc_us long, zone string, n int"


def dims(spark):
    return spark.createDataFrame([("Malang", "Asia/Jakarta"), ("malang", "Asia/Jakarta"), (None, "Asia/Tokyo"), ("X", "No/Zone")], "city string, tz_name string"), spark.createDataFrame([("ams", "Europe/Amsterdam"), (None, None)], "scrape_mode string, tz_name string")


def test_ages_nulls_and_clashing_columns(spark):
    rows = [
        (1, "2 jam lalu", "2025-03-01T10:00:00Z", "MALANG", "ams", 1, "z", 1),
        (2, "2h ago", "2025-03-01 11:00:00", None, "ams", 1, "z", 1),
        (3, "5 hari yang lalu", None, "Malang", "ams", 1, "z", 1),
        (4, None, "", None, None, None, None, None),
        (5, "2025-03-01T10:00:00Z", "3 menit lalu", "", "nowhere", 1, "z", 1),
        (5, "2025-03-01T10:00:00Z", "3 menit lalu", "", "nowhere", 1, "z", 1),
        (None, "2025-03-01 10:00:00", "unknown", "elsewhere", None, 1, "z", 1),
    ]
    out = instants.post_instants(spark.createDataFrame(rows, POSTS), *dims(spark)).collect()
    assert len(out) == 2 * len(rows)
    got = {(r["row_id"], r["field"]): r["utc_us"] for r in out}
    assert got[1, "timestamp"] == got[2, "timestamp"] == us(2025, 3, 1, 8)
    assert got[3, "timestamp"] is None and got[4, "timestamp"] is None and got[4, "collected_at"] is None
    assert got[5, "timestamp"] == us(2025, 3, 1, 10) and got[5, "collected_at"] is None
    assert got[None, "timestamp"] == us(2025, 3, 1, 3)
    cases = instants.found(spark.createDataFrame(rows, POSTS), *dims(spark)).collect()
    assert sorted((r["row_id"] or 0, r["field"]) for r in cases) == [(0, "timestamp"), (1, "timestamp"), (2, "collected_at"), (2, "timestamp")]


def test_empty(spark):
    assert instants.found(spark.createDataFrame([], POSTS), *dims(spark)).count() == 0


def test_dictionary_is_extended(spark, tmp_path):
    path = f"file://{tmp_path}/dict"
    a = spark.createDataFrame([(1, "1727740800", "Asia/Jakarta")], "id long, t string, z string")
    b = spark.createDataFrame([(2, "1727740801", "Asia/Jakarta"), (3, "1727740800", "Asia/Jakarta")], "id long, t string, z string")
    assert [r["utc_us"] for r in instants.normalise_instants(a, "id", [("t", "z", None)], path).collect()] == [us(2024, 10, 1)]
    assert sorted(r["utc_us"] for r in instants.normalise_instants(b, "id", [("t", "z", None)], path).collect()) == [us(2024, 10, 1), us(2024, 10, 1, 0, 0, 1)]
    assert spark.read.parquet(path).count() == 2


def test_hot_values_are_split(spark, monkeypatch):
    import sparkloka.runtime as runtime

    monkeypatch.setattr(runtime, "ONE_TASK_ROWS", 10)
    rows = [(i, "1727740800" if i % 3 else f"17277{i:05d}", "Asia/Jakarta") for i in range(300)]
    out = instants.normalise_instants(spark.createDataFrame(rows, "id long, t string, z string"), "id", [("t", "z", None)]).collect()
    assert {r["id"]: r["utc_us"] for r in out} == {i: int(t) * 1_000_000 for i, t, _ in rows}
