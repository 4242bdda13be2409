"""Event listings as a data source: an area and window of days at a time, page by page.

The source's partitions are the pairs of area and window, so pulls run side by side and
a lost task pulls its own window again. Within a partition pages are asked for one after
the other until the total that the service tells is reached or a page is empty. Windows
may overlap, as events move; `listings` keeps each event once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING = "event_id long, area string, title string, event_date string, attending int"
#: A page of a service: how many events the window has, and some of them.
Page = tuple[int, list[dict]]
Client = Callable[[str, date, date, int], Page]


def folder_client(root: str) -> Client:
    """Pages that lie in a folder that all executors share, as `area=A/window=D/page=N` with lines
    of JSON: {"total": ..., "rows": [...]}. A page that is not there is empty."""
    base = Path(unquote(urlparse(root).path))

    def fetch(area: str, start: date, end: date, page: int) -> Page:
        folder = base / f"area={area}" / f"window={start.isoformat()}" / f"page={page}"
        lines = [x for p in sorted(folder.glob("part-*")) for x in p.read_text("utf-8").splitlines() if x]
        pages = [json.loads(x) for x in lines]
        return (max((p["total"] for p in pages), default=0), [r for p in pages for r in p["rows"]])

    return fetch


@dataclass
class Window(InputPartition):
    area: str
    start: date
    end: date


class ListingReader(DataSourceReader):
    def __init__(self, options: dict, make_client: Callable[[dict], Client]):
        self.options, self.make_client = dict(options), make_client

    def partitions(self) -> list[Window]:
        first, last = (date.fromisoformat(self.options[k]) for k in ("start", "end"))
        days = int(self.options.get("windowdays", 7))
        starts = [first + timedelta(days=i) for i in range(0, max((last - first).days, 0), days)]
        areas = [a.strip() for a in self.options["areas"].split(",") if a.strip()]
        return [Window(a, s, min(s + timedelta(days=days), last)) for a in areas for s in starts]

    def read(self, partition: Window) -> Iterator[tuple]:
        fetch, pause = self.make_client(self.options), float(self.options.get("pause", 0))
        page, seen, total = 1, 0, None
        while total is None or seen < total:
            if page > 1 and pause:
                time.sleep(pause)
            total, rows = fetch(partition.area, partition.start, partition.end, page)
            if not rows:
                return
            for r in rows:
                if r.get("event_id") is not None:
                    yield (int(r["event_id"]), partition.area, r.get("title") or "Untitled", r.get("event_date"), int(r.get("attending") or 0))
            seen, page = seen + len(rows), page + 1


def listing_source(make_client: Callable[[dict], Client], name: str = "listings") -> type[DataSource]:
    """A data source class of that name whose tasks pull through the client of the options."""

    class Listings(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return LISTING

        def reader(self, schema: object) -> ListingReader:
            return ListingReader(self.options, make_client)

    return Listings


def listings(spark: SparkSession, make_client: Callable[[dict], Client], **options: object) -> DataFrame:
    """Each event of the areas and days once, though windows or pages overlap.

    options: areas (comma-joined), start, end (excluded), windowDays, pause in seconds
    between pages, and what the client needs. Rows without an event_id are left out; other
    fields have defaults.
    """
    spark.dataSource.register(listing_source(make_client))
    pulled = spark.read.format("listings").options(**{k: str(v) for k, v in options.items()}).load()
    return pulled.groupBy("event_id").agg(F.min(F.struct("area", "title", "event_date", "attending")).alias("e")).select("event_id", "e.*")


def serve_pages(events: DataFrame, key: str, area: str, ts: str, props: str, path: str, *, first: str, windows: int, days: int, overlap: int, page_rows: int) -> None:
    """Write the pages that a service would give for `events`: by area and window, a window
    reaching `overlap` days into the next one."""
    since = F.datediff(F.to_date(ts), F.lit(first).cast("date"))
    own = F.floor(since / days).cast("int")
    into = F.when((since % days < overlap) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    placed = events.select(F.col(key).alias("event_id"), F.col(area).alias("area"), F.col(ts).alias("ts"), F.col(props).alias("props"), F.explode(into).alias("w"))
    found = F.from_json("props", "k int, title string")
    row = F.struct("event_id", found["title"].alias("title"), F.date_format("ts", "yyyy-MM-dd").alias("event_date"), found["k"].alias("attending"))
    # a page is filled by rank within its window, as the service pages its answer
    from pyspark.sql import Window as Over

    by = Over.partitionBy("area", "w")
    ranked = placed.where(f"w >= 0 and w < {windows}").select(
        "area", "w", row.alias("row"), F.floor((F.row_number().over(by.orderBy("ts", "event_id")) - 1) / page_rows).alias("p"), F.count("*").over(by).alias("total")
    )
    window = F.date_add(F.lit(first).cast("date"), F.col("w") * days).cast("string").alias("window")
    pages = ranked.groupBy("area", window, (F.col("p") + 1).alias("page")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list("row")).alias("rows"))
    lines = pages.select("area", "window", "page", F.to_json(F.struct("total", "rows")).alias("value"))
    lines.repartition("area", "window").write.partitionBy("area", "window", "page").text(path)
