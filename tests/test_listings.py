"""Listings pulled by area, window and page."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from marquee.sources import listings as li


def calls(options):
    """A service that tells too large a total for one area and repeats a row over pages."""

    def fetch(area, start, end, page):
        if area == "greedy":
            return 10, [{"event_id": 1, "title": "only"}] if page == 1 else []
        if area == "none":
            return 0, []
        rows = [{"event_id": 100 + start.day, "event_date": start.isoformat(), "attending": page}, {"event_id": 500 + page}, {"title": "no id"}]
        return 6, rows if page < 3 else [{"event_id": 9999}]

    return fetch


def test_partitions_cover_the_days():
    reader = li.ListingReader({"areas": "a, b,", "start": "2024-01-01", "end": "2024-01-10", "windowdays": "4"}, calls)
    parts = reader.partitions()
    assert [(p.area, p.start.day, p.end.day) for p in parts] == [(a, s, e) for a in "ab" for s, e in ((1, 5), (5, 9), (9, 10))]
    assert li.ListingReader({"areas": "a", "start": "2024-01-02", "end": "2024-01-02"}, calls).partitions() == []


def test_paging_ends_at_the_total_or_an_empty_page(spark):
    rows = {r.event_id: r for r in li.listings(spark, calls, areas="a,greedy,none", start="2024-01-01", end="2024-01-09", windowDays=4).collect()}
    assert sorted(rows) == [1, 101, 105, 501, 502]
    assert rows[1].title == "only" and rows[501].title == "Untitled" and rows[101].event_date == "2024-01-01" and rows[501].attending == 0


@pytest.mark.parametrize("page_rows", [1, 3, 100])
def test_pages_from_files(spark, tmp_path, page_rows):
    rows = [(i, "xy"[i % 2], f"2024-01-{1 + i % 15:02d} 10:00:00", '{"k": 3, "title": "t"}' if i % 4 else None) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, area string, ts string, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    li.serve_pages(events, "event_id", "area", "ts", "props", f"{tmp_path}/pages", first="2024-01-01", windows=3, days=5, overlap=2, page_rows=page_rows)
    fetch = li.folder_client(f"file://{tmp_path}/pages")
    total, first = fetch("x", date(2024, 1, 1), date(2024, 1, 6), 1)
    assert len(first) == min(page_rows, total) and fetch("x", date(2024, 1, 1), date(2024, 1, 6), 1000) == (0, [])
    got = li.listings(spark, lambda o: li.folder_client(o["root"]), root=f"{tmp_path}/pages", areas="x,y", start="2024-01-01", end="2024-01-16", windowDays=5)
    found = sorted((r.event_id, r.area, r.event_date, r.title, r.attending) for r in got.collect())
    assert found == [(i, a, t[:10], "t" if p else "Untitled", 3 if p else 0) for i, a, t, p in rows]
