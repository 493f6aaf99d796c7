from datetime import UTC, datetime
from zoneinfo import ZoneInfo

from yakinma.operators.timestamps import to_instants

IST = "Europe/Istanbul"
CASES = [  # text, scraped_at, home zone, expected ISO instant or None
    ("2025-12-11 04:17:35", "2025-12-20T00:00:00", IST, "2025-12-11T01:17:35"),
    ("26.01.2026 02:02", "2026-02-20T00:00:00", IST, "2026-01-25T23:02:00"),
    ("18 Ocak 17:09", "2026-02-01T00:00:00", IST, "2026-01-18T14:09:00"),
    ("31 Aralık 18:24", "2026-09-28T00:00:00", IST, "2025-12-31T15:24:00"),
    ("15 ŞUBAT 2026 21:24", "2026-03-01T00:00:00", IST, "2026-02-15T18:24:00"),
    ("3 KASIM 2025", "2026-03-01T00:00:00", IST, "2025-11-02T21:00:00"),
    ("1702657853228", "2024-01-01T00:00:00", IST, "2023-12-15T16:30:53.228"),
    ("1666214352", "2024-01-01T00:00:00", IST, "2022-10-19T21:19:12"),
    ("20260424T131001", "2026-05-01T00:00:00", IST, "2026-04-24T10:10:01"),
    ("2021-10-17T11:42:35Z", "2026-05-01T00:00:00", IST, "2021-10-17T11:42:35"),
    (" 2014-06-05 19:04 ", "2026-05-01T00:00:00", IST, "2014-06-05T16:04:00"),
    ("2014-03-31 01:27:56.309+0200", "2026-05-01T00:00:00", IST, "2014-03-30T23:27:56.309"),
    ("2019-08-16T08:16:01.568717Z", "2026-05-01T00:00:00", IST, "2019-08-16T08:16:01.568717"),
    ("2026-07-24T11:35:15+03:00[Europe/Berlin]", "2026-08-01T00:00:00", IST, "2026-07-24T08:35:15"),
    ("2025-09-30 06:50:18 America/New_York", "2025-10-01T00:00:00", IST, "2025-09-30T10:50:18"),
    ("2026-05-19 23:50:38 BST", "2026-06-01T00:00:00", IST, "2026-05-19T22:50:38"),
    ("2022-02-14 07:59:35 EST", "2026-06-01T00:00:00", IST, "2022-02-14T12:59:35"),
    ("2022-07-14 07:59:35 TRT", "2026-06-01T00:00:00", "Asia/Kolkata", "2022-07-14T04:59:35"),
    ("16.04.26 12:26", "2026-05-01T00:00:00", IST, "2026-04-16T09:26:00"),
    ("Sat, 23 Aug 2025 13:58:14 +0300", "2026-05-01T00:00:00", IST, "2025-08-23T10:58:14"),
    ("6. Dezember 2025, 00:06 Uhr", "2026-05-01T00:00:00", "Europe/Berlin", "2025-12-05T23:06:00"),
    ("4. März 2024, 13:59 Uhr", "2026-05-01T00:00:00", "Europe/Berlin", "2024-03-04T12:59:00"),
    ("Jun 24, 2026 5:05 PM", "2026-07-01T00:00:00", "America/New_York", "2026-06-24T21:05:00"),
    ("Mar 9, 2026 12:37 AM", "2026-07-01T00:00:00", "America/New_York", "2026-03-09T04:37:00"),
    ("Şikayet tarihi: 14 Temmuz 2023 07:16", "2026-07-01T00:00:00", IST, "2023-07-14T04:16:00"),
    ("Marka Yanıtı 2 Ocak 2026 03:30", "2026-07-01T00:00:00", IST, "2026-01-02T00:30:00"),
    ("2025-10-26 02:30:00", "2026-07-01T00:00:00", "Europe/Berlin", "2025-10-26T00:30:00"),  # twice: the earlier
    ("2025-03-30 02:30:00", "2026-07-01T00:00:00", "Europe/Berlin", "2025-03-30T01:30:00"),  # skipped: offset before
    ("2015-11-08 03:30:00", "2026-07-01T00:00:00", IST, "2015-11-08T00:30:00"),
    ("2120-06-01 12:00", "2026-07-01T00:00:00", "Asia/Kolkata", "2120-06-01T06:30:00"),
    ("1960-06-01 12:00", "2026-07-01T00:00:00", "Asia/Kolkata", "1960-06-01T06:30:00"),
    ("31.02.2025 10:00", "2026-07-01T00:00:00", IST, None),
    ("0000-00-00 00:00:00", "2026-07-01T00:00:00", IST, None),
    ("2025-01-01 24:00", "2026-07-01T00:00:00", IST, None),
    ("2025-01-01 10:00 Mars/Base", "2026-07-01T00:00:00", IST, None),
    ("Ekim 2025", "2026-07-01T00:00:00", IST, None),
    ("dün 14:30", "2026-07-01T00:00:00", IST, None),
    ("3 gün önce", "2026-07-01T00:00:00", IST, None),
    ("-", "2026-07-01T00:00:00", IST, None),
    ("", "2026-07-01T00:00:00", IST, None),
    (None, "2026-07-01T00:00:00", IST, None),
    ("18 Ocak 17:09", None, IST, None),
    ("2025-01-01 10:00", "2026-07-01T00:00:00", None, None),
    ("x" * 5000, "2026-07-01T00:00:00", IST, None),
]


def run(spark, cases):
    zones = spark.createDataFrame([(z, z) for z in {c[2] for c in cases if c[2]}], "company string, time_zone string")
    df = spark.createDataFrame([(i, c[2], c[0], c[1], "x") for i, c in enumerate(cases)], "id bigint, company string, d string, scraped_at string, zone string")
    return {r.id: (r.epoch_us, r.how) for r in to_instants(df, ["d"], "id", "company", "scraped_at", zones, "company", "time_zone").collect()}


def us(iso):
    t = datetime.fromisoformat(iso).replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)
    return (t.days * 86400 + t.seconds) * 10**6 + t.microseconds


def test_written_forms(spark):
    got = run(spark, CASES)
    bad = [(c, got.get(i)) for i, c in enumerate(CASES) if (got.get(i) or (None,))[0] != (us(c[3]) if c[3] else None)]
    assert not bad


def test_every_wall_hour_around_changes_equals_the_zone_rules(spark):
    cases = []
    for zone in ("Europe/Istanbul", "Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Africa/Casablanca"):
        for day in ("2014-03-30", "2014-03-31", "2015-11-08", "2016-09-07", "2025-03-09", "2025-10-26", "2025-04-06", "2025-03-30", "2025-11-02", "2024-12-31", "2025-01-01"):
            for h in range(24):
                for m in (0, 30):
                    wall = datetime.fromisoformat(f"{day}T{h:02d}:{m:02d}")
                    utc = wall.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(UTC)  # fold 0: the earlier, or the offset before
                    cases.append((f"{day} {h:02d}:{m:02d}", "2026-01-01T00:00:00", zone, utc.replace(tzinfo=None).isoformat()))
    got = run(spark, cases)
    bad = [(c, got.get(i)) for i, c in enumerate(cases) if got[i][0] != us(c[3])]
    assert not bad
    assert {"ambiguous", "skipped", "unique"} <= {v[1] for v in got.values()}


def test_empty_table(spark):
    zones = spark.createDataFrame([], "company string, time_zone string")
    df = spark.createDataFrame([], "id bigint, company string, d string, scraped_at string")
    assert to_instants(df, ["d"], "id", "company", "scraped_at", zones, "company", "time_zone").count() == 0
