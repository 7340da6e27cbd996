"""Sources and paged scans: S12, S19, X8, X11-X14.

Network readers are interfaces here: a page function gives the records of a
page, and tests use one over local files.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

MAX_WINDOW_DAYS = 120


@dataclass(frozen=True)
class Source:
    """A registered source; ``mode`` is scheduled, init or manual. ``baseline``
    names the initial load without which a scheduled source does not run."""

    code: str
    run: Callable[[SparkSession, dict], DataFrame]
    mode: str = "scheduled"
    baseline: str | None = None


class Registry:
    """Sources by code; only scheduled ones run in a cycle."""

    def __init__(self) -> None:
        self._sources: dict[str, Source] = {}

    def add(self, source: Source) -> None:
        if source.code in self._sources:
            raise ValueError(f"source {source.code} is registered already")
        self._sources[source.code] = source

    def scheduled(self) -> list[Source]:
        return [s for s in self._sources.values() if s.mode == "scheduled"]

    def run_cycle(self, spark: SparkSession, states: dict[str, dict]) -> dict[str, dict]:
        """X11: each scheduled source in turn; one that fails does not stop the others, and
        one whose baseline is not complete waits for it."""
        out = {}
        for source in self.scheduled():
            if source.baseline and states.get(source.baseline, {}).get("status") != "ok":
                out[source.code] = {"status": "waiting", "error": f"baseline {source.baseline} is not complete"}
                continue
            try:
                rows = source.run(spark, states.get(source.code, {}))
                out[source.code] = {"status": "ok", "records": rows.count()}
            except Exception as error:
                out[source.code] = {"status": "failed", "error": str(error)[:500]}
        return out


def resume_offset(checkpoint: dict | None, identity: dict) -> int:
    """Where an initial load goes on: the saved offset, if it was saved for the same
    input (all fields of ``identity`` equal), else the begin."""
    saved = (checkpoint or {}).get("progress") or {}
    same = all(saved.get("identity", {}).get(k) == v for k, v in identity.items())
    offset = saved.get("offset", 0)
    return offset if same and isinstance(offset, int) and offset > 0 else 0


def with_progress(checkpoint: dict | None, identity: dict, offset: int) -> dict:
    """A checkpoint after a committed part of an initial load."""
    return (checkpoint or {}) | {"progress": {"identity": identity, "offset": offset}}


def agreed_records(checkpoint: dict, snapshot_id: str) -> int:
    """How many records a full snapshot must have; ValueError unless the
    checkpoint has completed this very revision."""
    count = checkpoint.get("recordCount")
    whole = checkpoint.get("snapshotComplete") is True and snapshot_id and checkpoint.get("gitRevision") == snapshot_id == checkpoint.get("completedGitRevision")
    if not whole or not isinstance(count, int) or isinstance(count, bool) or count <= 0:
        raise ValueError("the snapshot disagrees with its checkpoint")
    return count


def date_windows(start: date, end: date, days: int = MAX_WINDOW_DAYS) -> Iterator[tuple[date, date]]:
    """Windows of at most so many days that cover a span."""
    while start < end:
        stop = min(end, start + timedelta(days=days))
        yield start, stop
        start = stop


def with_retry(call: Callable[[], object], attempts: int = 4, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> object:
    """A call repeated with doubled waits."""
    for attempt in range(attempts):
        try:
            return call()
        except OSError:
            if attempt == attempts - 1:
                raise
            sleep(wait * 2**attempt)
    raise AssertionError("unreachable")


class PagedFeed(DataSource):
    """Pages of a feed in a folder (``page-00000.json``, each an array) as a
    batch or streaming source; options ``path`` and ``batch`` (pages at a time)."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return "page int, place int, body string"

    def reader(self, schema: object) -> DataSourceReader:
        return _PageReader(self.options)

    def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:
        return _PageStream(self.options)


def _folder(path: str):
    """The file system of a folder, and the folder's place in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _pages(path: str) -> list[str]:
    from pyarrow.fs import FileSelector

    system, place = _folder(path)
    return sorted(f.base_name for f in system.get_file_info(FileSelector(place)) if f.base_name.startswith("page-"))


def _rows(path: str, number: int, name: str) -> Iterator[tuple]:
    system, folder = _folder(path)
    with system.open_input_stream(f"{folder.rstrip('/')}/{name}") as file:
        for place, item in enumerate(json.loads(file.read())):
            yield number, place, json.dumps(item)


class _PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((n, name)) for n, name in enumerate(_pages(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _rows(self.path, *partition.value)


class _PageStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.batch = options["path"], int(options.get("batch", "10"))

    def initialOffset(self) -> dict:
        return {"page": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        names = _pages(self.path)[start["page"] : start["page"] + self.batch]
        rows = [r for n, name in enumerate(names, start["page"]) for r in _rows(self.path, n, name)]
        return iter(rows), {"page": start["page"] + len(names)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        names = _pages(self.path)[start["page"] : end["page"]]
        return iter([r for n, name in enumerate(names, start["page"]) for r in _rows(self.path, n, name)])


def source_status(spark: SparkSession, folder: str, codes: list[str]) -> DataFrame:
    """Status of sources from their state files ``<code>.json``."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("source_code"), "value")
    state = files.withColumn("s", F.from_json("value", "checkpoint string, hasRecords boolean, lastError string, lastRun struct<status:string,skipReason:string>"))
    status = F.when(F.try_parse_json("value").isNull(), "invalid-state").when(F.col("s.lastError").isNotNull(), "failed").when(F.col("s.lastRun").isNull(), "never-run").otherwise(F.coalesce("s.lastRun.skipReason", "s.lastRun.status"))
    known = state.select("source_code", status.alias("status"))
    wanted = spark.createDataFrame([(c,) for c in codes], "source_code string")
    return wanted.join(known, "source_code", "left").fillna({"status": "never-run"})


def clear_mirrors(spark: SparkSession, mirrors: str, spool: str, complete: list[str]) -> list[str]:
    """Deletes the mirrors (``mirrors/<code>``) of sources whose baseline is complete
    and of which no spool file waits; gives their codes."""
    from vulnlake.sources.spool import PROCESSING, READY, SpoolFiles

    files = SpoolFiles(spark, spool)
    waiting = files.names(READY) + files.names(PROCESSING)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(mirrors).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [c for c in complete if fs.exists(path(f"{mirrors}/{c}")) and not any(n.startswith(f"{c}-") for n in waiting)]
    for code in gone:
        fs.delete(path(f"{mirrors}/{code}"), True)
    return gone
