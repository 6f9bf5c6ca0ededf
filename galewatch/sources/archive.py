"""An archive of volumes, root/yyyy/mm/dd/site/name, as a Spark data source for batch, streams and writing.

    archive.register(spark)
    spark.read.format("radar_archive").option("path", root).load().where("site = 'KTLX' and scan_date = '2024-05-01'")

A partition is a site's day, listed and read by the executor that has it; so the driver never lists an archive, and
files never pass through it. Filters on site and scan_date reach the listing: with both known, no folder is listed but
those asked for; without them the driver walks years, months and days, and sites of the days in question.

Options: path; contents (false: names only, content is null); sites (comma-separated), start and end (yyyy-mm-dd,
inclusive), the same as filters; start is also where a stream begins. Paths are opened by pyarrow's file systems.

As a stream, the offset holds each site's last name taken. Names carry their time, so later volumes of a site have
greater names; a name that sorts before the last one taken is too late and is left out. Written rows are site,
scan_date, filename and content; a file appears under its name when it is whole, and one written again is replaced.

Defined cases: a missing folder has no volumes; files of a name that isn't of the site's form are rows like others; a
folder's volumes are numbered by name from 0 (ord); null filters match nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

NAME = "radar_archive"
SCHEMA = "site string, scan_date date, key string, filename string, ord int, content binary"
DAY = timedelta(days=1)


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Archive)


@dataclass(frozen=True)
class SiteDay(InputPartition):
    """A folder; only names above `after` and up to `upto`, where they are set."""

    site: str
    day: date
    after: str | None = None
    upto: str | None = None


@dataclass
class Asked:
    """What sites and days are wanted; None is no bound."""

    sites: frozenset[str] | None = None
    start: date | None = None
    end: date | None = None

    def narrowed(self, f: Filter) -> Asked | None:
        """With one more filter, or None where it isn't of a kind that folders can answer."""
        column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
        if column == "site" and isinstance(f, (EqualTo, In)):
            own = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            return Asked(own if self.sites is None else own & self.sites, self.start, self.end)
        if column == "scan_date" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            low = f.value if isinstance(f, (EqualTo, GreaterThanOrEqual)) else f.value + DAY if isinstance(f, GreaterThan) else None
            high = f.value if isinstance(f, (EqualTo, LessThanOrEqual)) else f.value - DAY if isinstance(f, LessThan) else None
            return Asked(self.sites, max(filter(None, (self.start, low)), default=None), min(filter(None, (self.end, high)), default=None))
        return None


class Folders:
    """Listing and reading of one archive."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.contents = options.get("contents", "true").lower() != "false"
        days = [date.fromisoformat(options[k]) if k in options else None for k in ("start", "end")]
        self.asked = Asked(frozenset(options["sites"].split(",")) if "sites" in options else None, *days)

    def opened(self) -> tuple[fs.FileSystem, str]:
        plain = self.path.startswith("/") or ":" not in self.path
        return (fs.LocalFileSystem(), self.path) if plain else fs.FileSystem.from_uri(self.path.replace("file:/", "file:///") if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path)

    def listed(self, *parts: str) -> list[fs.FileInfo]:
        disk, root = self.opened()
        found = disk.get_file_info(fs.FileSelector("/".join([root, *parts]), allow_not_found=True))
        return sorted(found, key=lambda x: x.base_name)

    def days(self, asked: Asked) -> Iterator[date]:
        if asked.start and asked.end:
            yield from (asked.start + k * DAY for k in range((asked.end - asked.start).days + 1))
            return
        bound = lambda d, n: (asked.start is None or d >= f"{asked.start:%Y/%m/%d}"[:n]) and (asked.end is None or d <= f"{asked.end:%Y/%m/%d}"[:n])
        for y in self.listed():
            for m in self.listed(y.base_name) if y.base_name.isdigit() and bound(y.base_name, 4) else ():
                for d in self.listed(y.base_name, m.base_name) if m.base_name.isdigit() and bound(f"{y.base_name}/{m.base_name}", 7) else ():
                    if d.base_name.isdigit() and bound(f"{y.base_name}/{m.base_name}/{d.base_name}", 10):
                        yield date(int(y.base_name), int(m.base_name), int(d.base_name))

    def site_days(self, asked: Asked) -> Iterator[SiteDay]:
        for day in self.days(asked):
            known = sorted(asked.sites) if asked.sites is not None else [x.base_name for x in self.listed(f"{day:%Y/%m/%d}") if x.type == fs.FileType.Directory]
            yield from (SiteDay(s, day) for s in known if s)

    def files(self, p: SiteDay) -> list[tuple[int, fs.FileInfo]]:
        own = [x for x in self.listed(f"{p.day:%Y/%m/%d}", p.site) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]
        return [(i, x) for i, x in enumerate(own) if (p.after is None or x.base_name > p.after) and (p.upto is None or x.base_name <= p.upto)]

    def rows(self, p: SiteDay) -> Iterator[tuple]:
        disk, _ = self.opened()
        for i, x in self.files(p):
            content = None
            if self.contents:
                with disk.open_input_stream(x.path) as f:
                    content = f.read()
            yield p.site, p.day, f"{self.path}/{p.day:%Y/%m/%d}/{p.site}/{x.base_name}", x.base_name, i, content


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folders = Folders(options)
        self.asked = self.folders.asked

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            narrower = self.asked.narrowed(f)
            if narrower is None:
                yield f
            else:
                self.asked = narrower

    def partitions(self) -> list[SiteDay]:
        return list(self.folders.site_days(self.asked)) or [SiteDay("", date.min)]

    def read(self, partition: SiteDay) -> Iterator[tuple]:
        return self.folders.rows(partition) if partition.site else iter(())


class ArchiveStream(DataSourceStreamReader):
    """Offsets: {"day": the last day listed, "taken": each site's last name, as JSON}."""

    def __init__(self, options: dict[str, str]):
        self.folders = Folders(options)
        self.start = self.folders.asked.start

    def initialOffset(self) -> dict:
        return {"day": self.start.isoformat() if self.start else "", "taken": "{}"}

    def _since(self, offset: dict) -> Iterator[SiteDay]:
        asked = Asked(self.folders.asked.sites, date.fromisoformat(offset["day"]) - DAY if offset["day"] else self.start, self.folders.asked.end)
        if self.start and asked.start:
            asked.start = max(self.start, asked.start)
        if asked.start and not asked.end:
            asked.end = max([asked.start, date.today() + DAY])
        yield from self.folders.site_days(asked)

    def latestOffset(self) -> dict:
        """Lists the day before the last one with news, and what comes after it."""
        held = getattr(self, "last", None) or self.initialOffset()
        taken, day = json.loads(held["taken"]), held["day"]
        for p in self._since(held):
            names = [x.base_name for _, x in self.folders.files(p)]
            if names and names[-1] > taken.get(p.site, ""):
                taken[p.site], day = names[-1], max(day, p.day.isoformat())
        self.last = {"day": day, "taken": json.dumps(taken, sort_keys=True)}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[SiteDay]:
        self.last = end  # after a restart, listing goes on from here
        before, upto = json.loads(start["taken"]), json.loads(end["taken"])
        found = [SiteDay(p.site, p.day, before.get(p.site, ""), upto[p.site]) for p in self._since(start) if upto.get(p.site, "") > before.get(p.site, "")]
        return found

    def read(self, partition: SiteDay) -> Iterator[tuple]:
        return self.folders.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class ArchiveWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.folders = Folders(options)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        disk, root = self.folders.opened()
        for row in iterator:
            folder = f"{root}/{row['scan_date']:%Y/%m/%d}/{row['site']}"
            disk.create_dir(folder, recursive=True)
            part = f"{folder}/.{uuid.uuid4().hex}"
            with disk.open_output_stream(part) as f:
                f.write(bytes(row["content"] or b""))
            disk.move(part, f"{folder}/{row['filename']}")
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        """Files that are whole stay: the same rows written again replace them."""


class Archive(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def streamReader(self, schema) -> ArchiveStream:
        return ArchiveStream(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options))
