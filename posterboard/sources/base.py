"""What a source is, and how one that fails is kept from taking the others with it."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..session import ensure_checkpoints


@dataclass
class Source:
    """read gives the rows; obstacle says why the source can't be read now, or gives None. A source that isn't enabled is read only when asked for by name."""

    name: str
    read: Callable[[SparkSession], DataFrame]
    enabled: bool = True
    obstacle: Callable[[], str | None] = lambda: None

    def available(self) -> tuple[bool, str]:
        why = self.obstacle()
        return why is None, why or ""


@dataclass
class Outcome:
    """state: read, partial (rows up to a failure), failed, unavailable or disabled."""

    name: str
    state: str
    reason: str = ""


def read_all(spark: SparkSession, sources: Iterable[Source], only: list[str] | None = None, shape: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[dict[str, DataFrame], list[Outcome]]:
    """The rows of each source that can be read, and what became of every source.

    Plans are lazy, so each source's rows are made here, as a checkpoint in the shared folder: a source that fails while it is read gives no rows and a reason, and the
    others go on. Of a source whose rows carry their errors (see pieces) the rows read before a failure stay; of any other none, as a Spark job is whole or nothing. shape is applied to the rows with
    the source's name before that.
    """
    ensure_checkpoints(spark)
    rows, outcomes = {}, []
    for s in sources:
        if (s.name not in only) if only is not None else not s.enabled:
            outcomes.append(Outcome(s.name, "disabled"))
            continue
        try:
            ok, why = s.available()
            if not ok:
                outcomes.append(Outcome(s.name, "unavailable", why))
                continue
            df = s.read(spark)
            why = ""
            if FAILURE in df.columns:
                df = df.checkpoint()
                why = df.agg(F.min(FAILURE)).first()[0] or ""
                df = df.where(F.col(FAILURE).isNull()).drop(FAILURE)
            rows[s.name] = (shape(df, s.name) if shape else df).checkpoint()
            if why and rows[s.name].isEmpty():
                del rows[s.name]
                outcomes.append(Outcome(s.name, "failed", why))
            else:
                outcomes.append(Outcome(s.name, "partial" if why else "read", why))
        except Exception as e:  # noqa: BLE001  whatever a source raises is its own
            outcomes.append(Outcome(s.name, "failed", str(e)[:500]))
    return rows, outcomes


#: The column that says why a piece of a source ended early; its row has nothing else.
FAILURE = "_failure"


@dataclass
class _Piece(InputPartition):
    index: int


def pieces(name: str, schema: str, parts: list, iterate: Callable[[object], Iterator[dict]]) -> type[DataSource]:
    """A data source that reads each part in a task of its own, by iterate(part), which gives rows as dicts; with the rows come failures, as rows that have only _failure.

    What a part gave before it failed stays, and other parts go on. Register it with ``spark.dataSource.register`` and load it by ``name``. iterate is sent to the tasks.
    """
    columns = [f.name for f in StructType.fromDDL(schema)]

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [_Piece(i) for i in range(len(parts))]

        def read(self, partition: _Piece) -> Iterator[tuple]:
            try:
                for row in iterate(parts[partition.index]):
                    yield (*[row.get(c) for c in columns], None)
            except Exception as e:  # noqa: BLE001  whatever a source raises is its own
                yield (*[None] * len(columns), f"{type(e).__name__}: {e}"[:500])

    class Pieces(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"{schema}, {FAILURE} string"

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Pieces


#: What a live table's server compares; other filters stay with Spark.
_COMPARED = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "gte", LessThan: "lt", LessThanOrEqual: "lte"}


def live_table(name: str, schema: str, fetch: Callable[[list[tuple[str, str, object]], str, int], list[dict]]) -> type[DataSource]:
    """A data source over a table behind a server: fetch(filters, order, limit) gives its rows as dicts, where a filter is (column, eq | gt | gte | lt | lte, value) and order a column with .asc or .desc.

    Options: order (none by default) and limit (2000). Filters on columns go to the server, for which the session needs ``spark.sql.python.filterPushdown.enabled``; the limit counts what is left of them. A server that can't be reached, or
    that gives no list of rows, leaves an empty table and a warning, as a run goes on without it; rows that aren't dicts are left out.
    """
    columns = [f.name for f in StructType.fromDDL(schema)]

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.order, self.limit, self.filters = options.get("order", ""), int(options.get("limit", "2000")), []

        def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
            for f in filters:
                if type(f) in _COMPARED and len(f.attribute) == 1:
                    self.filters.append((f.attribute[0], _COMPARED[type(f)], f.value))
                else:
                    yield f

        def partitions(self) -> list[InputPartition]:
            return [_Piece(0)]  # the server answers one request, of limit rows at most

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            try:
                found = fetch(self.filters, self.order, self.limit)
                if not isinstance(found, list):
                    raise TypeError(f"{type(found).__name__} instead of a list")
            except Exception as e:  # noqa: BLE001  whatever a server does is its own
                warnings.warn(f"{name} can't be read, going on without it: {e}", stacklevel=1)
                return
            for row in found[: self.limit]:
                if isinstance(row, dict):
                    yield tuple(row.get(c) for c in columns)

    class Live(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return Live


@dataclass
class _Prefix(InputPartition):
    prefix: str


def paged_listing(name: str, fetch: Callable[[str, int, int], list[dict]]) -> type[DataSource]:
    """A data source that lists a bucket page by page: fetch(prefix, offset, limit) gives dicts with name, id and size.

    Register it with ``spark.dataSource.register`` and load it by ``name``. Options: prefixes (comma-separated, one task each; a whole bucket by default) and page (100). A
    short page ends a prefix; objects without an id are placeholders of empty folders and are left out. fetch is sent to the tasks.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.prefixes = options.get("prefixes", "").split(",")
            self.page = int(options.get("page", "100"))

        def partitions(self) -> list[InputPartition]:
            return [_Prefix(p) for p in self.prefixes]

        def read(self, partition: _Prefix) -> Iterator[tuple]:
            offset = 0
            while True:
                found = fetch(partition.prefix, offset, self.page)
                for o in found:
                    if o.get("id"):
                        yield o["name"], o.get("size")
                if len(found) < self.page:
                    return
                offset += len(found)

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "name string, size long"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return Listing
