"""Archives and streams, from files written here."""

import hashlib
import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.sources import archive
from tidemark.streaming.live import live_bars, live_changes

HEADER = "open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore"


def line(ms, o=1.0, h=2.0, lo=0.5, c=1.5, v=3.0):
    return f"{ms},{o},{h},{lo},{c},{v},{ms + 59999},0,1,0,0,0"


@pytest.fixture
def root(tmp_path):
    minutes = [0, 60_000, 60_000, 240_000, 180_000]
    made = {
        "a/A-1m-2024-01.zip": ([HEADER] + [line(1704067200000 + m) for m in minutes], "good"),
        "a/A-1m-2024-01-02.zip": ([line(1704153600000 * 1000)] + [line(1704153600000 * 1000 + 60_000_000, v=0.0, o=1, h=1, lo=1, c=1)], "bad"),
        "a/A-1m-2024-02-01.zip": ([line(1706745600000)], "none"),
    }
    for name, (lines, kind) in made.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        with zipfile.ZipFile(path, "w") as out:
            out.writestr("x.csv", "\n".join(lines) + "\n")
            out.writestr("second.csv", "never read")
        digest = hashlib.sha256(path.read_bytes()).hexdigest() if kind == "good" else "0" * 64
        if kind != "none":
            (tmp_path / (name + ".CHECKSUM")).write_text(f"{digest}  {path.name}\n")
    return f"file://{tmp_path}"


def r_bytes(zips, name):
    return zips.where(name == "A-1m-2024-01.zip").select(F.octet_length("content")).first()[0]


def test_broken_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "empty-2024-01.zip", "w"):
        pass
    with zipfile.ZipFile(tmp_path / "good-2024-01.zip", "w") as out:
        out.writestr("x.csv", "\n".join(line(i) for i in range(50)))
    (tmp_path / "short-2024-01.zip").write_bytes((tmp_path / "good-2024-01.zip").read_bytes()[:200])
    (tmp_path / "none-2024-01.zip").write_bytes(b"no zip")
    found = archive.decoded(archive.archives(spark, f"file://{tmp_path}")).collect()
    assert sorted(r.key.rpartition("/")[2].split("-")[0] for r in found if r.line_no < 0) == ["empty", "none", "short"] and all(r.error for r in found if r.line_no < 0)
    assert sum(r.line_no >= 0 for r in found) == 50 == archive.decode(archive.archives(spark, f"file://{tmp_path}")).count()


def test_archives(spark, root, tmp_path):
    zips = archive.archives(spark, root)
    name = F.element_at(F.split("key", "/"), -1)
    assert {r.n: r.sha256_ok for r in zips.select(name.alias("n"), "sha256_ok").collect()} == {"A-1m-2024-01.zip": True, "A-1m-2024-01-02.zip": False, "A-1m-2024-02-01.zip": False}
    lines = archive.decode(zips)
    assert {(r.n, r.rows, r.has_header) for r in archive.file_profile(lines).select(name.alias("n"), "rows", "has_header").collect()} == {("A-1m-2024-01.zip", 5, True), ("A-1m-2024-01-02.zip", 2, False), ("A-1m-2024-02-01.zip", 1, False)}
    rows = archive.parse(lines, archive.KLINES)
    found = {r.n: r for r in archive.kline_profile(rows).withColumn("n", name).collect()}
    r = found["A-1m-2024-01.zip"]
    assert (r.unit, r.rows, r.duplicates, r.non_monotonic, r.gaps, r.missing_minutes, r.span_mode) == ("ms", 5, 1, 2, 1, 2, 59999)
    assert found["A-1m-2024-01-02.zip"].unit == "us" and found["A-1m-2024-01-02.zip"].zero_volume == 1
    manifest = archive.manifest_rows(zips)
    assert {r.status for r in manifest.collect()} == {"verified", "rejected"}
    listing = archive.objects(spark, root)
    assert archive.pending(listing, manifest).count() == 2 and archive.pending(listing, None).count() == 3
    named = listing.withColumn("symbol", F.lit("A")).withColumn("dataset", F.lit("klines"))
    assert sorted(r.date for r in archive.preferred(named).collect()) == ["2024-01", "2024-02-01"]
    other = named.where("date = '2024-01'").unionByName(named.where("date <> '2024-01'").withColumn("symbol", F.lit("B")))
    assert archive.preferred(other).count() == 3
    assert [r.n for r in archive.accepted(zips).select(name.alias("n")).collect()] == ["A-1m-2024-01.zip"]
    full = {r.n: r for r in archive.profiles(archive.archived_lines(spark, root)).withColumn("n", name).collect()}["A-1m-2024-01.zip"]
    assert (full.rows, full.rows_expected, full.has_header, full.columns, full.sha256_ok) == (5, 31 * 1440, True, HEADER.split(","), True)
    assert (full.first_open_time_utc, full.last_open_time_utc) == (datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 3)) and full.head[0].startswith("1704067200000,1.0") and len(full.head) == 3
    with zipfile.ZipFile(root.removeprefix("file://") + "/a/A-1m-2024-01.zip") as z:
        assert full.csv_bytes == len(z.read("x.csv")) and full.zip_bytes == r_bytes(zips, name)
    assert archive.parquet_bytes(rows, f"file://{tmp_path}/probe") > 0
    archive.write_report({"profiles": archive.profiles(archive.archived_lines(spark, root)), "manifest": manifest}, f"file://{tmp_path}/report")
    assert sorted(x["status"] for x in map(json.loads, (r.value for r in spark.read.text(f"file://{tmp_path}/report/manifest").collect()))) == ["rejected", "rejected", "verified"]
    archive.write_normalised(archive.normalised(rows, F.lit("A")), f"file://{tmp_path}/store")
    stored = spark.read.parquet(f"file://{tmp_path}/store").where("symbol = 'A' AND year = 2024 AND month = 1")
    assert stored.count() == 7 and "ignore" not in stored.columns and stored.where("is_filler").count() == 1
    assert "PartitionFilters: [isnotnull(symbol" in stored._jdf.queryExecution().executedPlan().toString()


def flaky(root, fails):
    """A store that lists two names a page and fails so often at each request before it answers; it notes what is read."""
    folder = root.removeprefix("file://")

    class Flaky:
        def __init__(self):
            self.tried = {}

        def _try(self, what):
            self.tried[what] = self.tried.get(what, 0) + 1
            if self.tried[what] <= fails:
                raise ConnectionError(what)

        def list(self, marker):
            import os

            self._try(f"list {marker}")
            names = sorted(os.path.relpath(os.path.join(at, f), folder) for at, _, files in os.walk(folder) for f in files)
            page = [x for x in names if marker is None or x > marker][:2]
            return [(x, os.path.getsize(f"{folder}/{x}")) for x in page], page[-1] if page and page[-1] != names[-1] else None

        def get(self, name):
            import os

            self._try(f"get {name}")
            if not os.path.exists(f"{folder}/{name}"):
                return None
            with open(f"{folder}/.log", "a") as log:
                log.write(name + "\n")
            with open(f"{folder}/{name}", "rb") as f:
                return f.read()

    return Flaky()


def test_a_store_that_fails_and_pages(spark, root):
    """Every request fails twice; pages of two names are followed to the end; filters choose what is read at all."""
    from tidemark.sources.store import source_of

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source_of(flaky(root, 2), "flaky"))
    read = lambda **options: spark.read.format("flaky").options(backoff="0,0,0,0", **options).load()
    assert sorted(r.key for r in read(rows="names").collect()) == ["a/A-1m-2024-01-02.zip", "a/A-1m-2024-01.zip", "a/A-1m-2024-02-01.zip"]
    few = read().where("date >= '2024-02'")
    assert [(r.key, r.line_no, r.sha256_ok) for r in few.collect()] == [("a/A-1m-2024-02-01.zip", 0, False)]
    with open(root.removeprefix("file://") + "/.log") as log:
        assert {x.strip() for x in log} == {"a/A-1m-2024-02-01.zip"}
    assert read().where("line_no = 0 AND sha256_ok").count() == 1 and read().count() == 6 + 2 + 1
    spark.dataSource.register(source_of(flaky(root, 3), "broken"))
    with pytest.raises(Exception, match="ConnectionError"):
        spark.read.format("broken").options(backoff="0,0").load().collect()


def test_monthly_and_daily_archives_as_one_series(spark, root):
    lines = archive.archived_lines(spark, root)
    rows = archive.parse(lines, archive.KLINES).withColumn("symbol", F.lit("A"))
    got = archive.merged_tiers(rows, "2024-01-01", "2024-02-01").select(F.element_at(F.split("key", "/"), -1).alias("n"), "open_ts").collect()
    # the month's four times once, none of the day inside it, and the day of the month after
    assert sorted((r.n, r.open_ts) for r in got) == [("A-1m-2024-01.zip", datetime(2024, 1, 1, 0, m)) for m in (0, 1, 3, 4)] + [("A-1m-2024-02-01.zip", datetime(2024, 2, 1))]
    assert archive.merged_tiers(rows, "2024-01-01", "2024-01-31").count() == 4


def prices(spark, folder, steps):
    rows = [("a", datetime(2024, 1, 1) + timedelta(minutes=20 * i), float(p)) for i, p in enumerate(steps)]
    spark.createDataFrame(rows, "symbol string, ts timestamp, price double").coalesce(1).write.mode("append").parquet(folder)


def run(spark, frame, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_live_bars(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    prices(spark, folder, [5, 7, 6, 9, 1, 3, 2, 8, 4, 4])
    stream = spark.readStream.schema("symbol string, ts timestamp, price double").parquet(folder)
    got = sorted((r.t.hour, r.open, r.high, r.low, r.close, r.n) for r in run(spark, live_bars(stream), "bars_out"))
    assert got[:2] == [(0, 5, 7, 5, 6, 3), (1, 9, 9, 1, 3, 3)]


def test_live_changes(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    prices(spark, folder, [100, 95, 89, 92, 98.5, 120, 130, 116, 110, 125])
    stream = spark.readStream.schema("symbol string, ts timestamp, price double").parquet(folder)
    got = sorted((r.confirmed_at, r.direction, r.extreme) for r in run(spark, live_changes(stream, 0.1), "changes_out"))
    assert [x[1:] for x in got] == [(-1, 100), (1, 89), (-1, 130), (1, 110)]


def test_late_prices_are_an_error(spark, tmp_path):
    """A micro-batch in any order is put in order; one that reaches behind an earlier one stops the stream."""
    folder = f"file://{tmp_path}/in"
    at = lambda *minutes: [("a", datetime(2024, 1, 1) + timedelta(minutes=m), 100.0 + m) for m in minutes]
    write = lambda rows: spark.createDataFrame(rows, "symbol string, ts timestamp, price double").coalesce(1).write.mode("append").parquet(folder)
    write(at(30, 0, 10))
    stream = spark.readStream.schema("symbol string, ts timestamp, price double").parquet(folder)
    q = live_changes(stream, 0.05).writeStream.format("memory").queryName("late").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert [(r.direction, r.extreme) for r in spark.table("late").collect()] == [(1, 100.0)]
        write(at(20))
        with pytest.raises(Exception, match="came after"):
            q.processAllAvailable()
    finally:
        q.stop()


def test_live_changes_are_those_of_the_table(spark, tmp_path):
    import random

    from tidemark.operators.waves import directional_changes

    assert [x[1:] for x in sorted(live(spark, tmp_path, "few", [100, 108, 97], 0.1))] == [(-1, 108)]
    rng = random.Random(3)
    steps = [100.0]
    for _ in range(150):
        steps.append(round(steps[-1] * rng.uniform(0.9, 1.1), 2))
    rows = spark.createDataFrame([("a", i, p) for i, p in enumerate(steps)], "symbol string, slot long, close double")
    want = sorted((r.confirm_slot, r.direction, r.extreme) for r in directional_changes(rows, [0.1]).collect())
    got = sorted((int((t - datetime(2024, 1, 1)).total_seconds()) // 1200, d, x) for t, d, x in live(spark, tmp_path, "many", steps, 0.1))
    assert got == want and len(got) > 10


def live(spark, tmp_path, name, steps, theta):
    folder = f"file://{tmp_path}/{name}"
    prices(spark, folder, steps)
    stream = spark.readStream.schema("symbol string, ts timestamp, price double").parquet(folder)
    return [(r.confirmed_at, r.direction, r.extreme) for r in run(spark, live_changes(stream, theta), f"changes_{name}")]
