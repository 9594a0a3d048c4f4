"""Gauge services as a Spark data source: one request a station and range of days, made by the tasks.

The answers come as text for the parsers in ``formats``. How an answer is got is an argument, so a service can be replayed from
what was kept of it. Filters on the station and on the days choose the requests before any is made.
"""

from __future__ import annotations

import datetime as dt
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: (station, first day, last day) to the answer's text; an error is tried again.
Transport = Callable[[str, dt.date, dt.date], str]
SCHEMA = "station_id string, first date, last date, ord int, body string"


def web(address: str, timeout: float = 90.0, **parameters: str) -> Transport:
    """Answers by HTTP GET; {station}, {first} and {last} in the address and the parameters are filled in, days as 2020-01-31."""

    def get(station: str, first: dt.date, last: dt.date) -> str:
        fill = lambda s: s.format(station=station, first=first, last=last)
        query = urllib.parse.urlencode({k: fill(v) for k, v in parameters.items()})
        with urllib.request.urlopen(fill(address) + ("?" + query if query else ""), timeout=timeout) as answer:
            return answer.read().decode("utf-8", "replace")

    return get


@dataclass(frozen=True)
class Request(InputPartition):
    station: str
    first: dt.date
    last: dt.date
    ord: int

    def __init__(self, station: str, first: dt.date, last: dt.date, ord: int):
        for name, value in (("station", station), ("first", first), ("last", last), ("ord", ord), ("value", ord)):
            object.__setattr__(self, name, value)


@dataclass
class Plan:
    """The requests that filters leave: stations (None: all) and days that a request's range must touch."""

    stations: list[str]
    start: dt.date
    end: dt.date
    chunk_days: int
    ranges: list[Callable[[dt.date, dt.date], bool]] = field(default_factory=list)

    def push(self, f: Filter) -> bool:
        """Takes the filter if it can; these filters need no second look."""
        name, value = getattr(f, "attribute", ()), getattr(f, "value", None)
        if name == ("station_id",) and isinstance(f, EqualTo | In):
            wanted = {value} if isinstance(f, EqualTo) else set(value)
            self.stations = [s for s in self.stations if s in wanted]
            return True
        tests = {GreaterThanOrEqual: lambda a: a >= value, GreaterThan: lambda a: a > value, LessThanOrEqual: lambda a: a <= value, LessThan: lambda a: a < value, EqualTo: lambda a: a == value}
        if name in (("first",), ("last",)) and type(f) in tests and isinstance(value, dt.date):
            test, at = tests[type(f)], 0 if name == ("first",) else 1
            self.ranges.append(lambda *days: test(days[at]))
            return True
        return False

    def requests(self) -> list[Request]:
        out = []
        for s in self.stations:
            first, n = self.start, 0
            while first <= self.end:
                last = min(first + dt.timedelta(days=self.chunk_days - 1), self.end)
                if all(test(first, last) for test in self.ranges):
                    out.append(Request(s, first, last, n))
                first, n = last + dt.timedelta(days=1), n + 1
        return out


def _source(name: str, transport: Transport, stations: list[str], start: dt.date, end: dt.date, chunk_days: int, tries: int, wait: float, pushed: bool) -> type[DataSource]:
    class Reader(DataSourceReader):
        def __init__(self):
            self.plan = Plan(stations, start, end, chunk_days)

        def partitions(self) -> list[InputPartition]:
            return self.plan.requests() or [Request("", start, start, -1)]

        def read(self, request: Request) -> Iterator[tuple]:
            if request.ord < 0:  # the filters left nothing to ask for
                return
            for attempt in range(tries):
                try:
                    body = transport(request.station, request.first, request.last)
                    break
                except Exception:
                    if attempt + 1 == tries:
                        raise
                    time.sleep(wait * 2**attempt)
            yield request.station, request.first, request.last, request.ord, body

    class FilteredReader(Reader):  # an error where the session doesn't push filters
        def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
            return [f for f in filters if not self.plan.push(f)]

    class Service(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return FilteredReader() if pushed else Reader()

    return Service


def answers(spark: SparkSession, transport: Transport, stations: Iterable[str], start: dt.date, end: dt.date, chunk_days: int = 30, tries: int = 3, wait: float = 0.5, name: str = "gauge_service") -> DataFrame:
    """(station_id, first, last, ord, body): the answers for each station and range of at most ``chunk_days`` days, a partition each.

    ord counts a station's ranges. A request is tried ``tries`` times, waiting twice as long each time; then the task fails, and
    Spark tries it elsewhere. Filters on station_id, first and last choose the requests where
    ``spark.sql.python.filterPushdown.enabled`` is set, and the rows of the answers elsewhere. No station or an end before the start: no rows.
    """
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    spark.dataSource.register(_source(name, transport, list(stations), start, end, chunk_days, tries, wait, pushed))
    return spark.read.format(name).load()
