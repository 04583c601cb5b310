"""The ``pgheap`` data source: rows of a relation file as a DataFrame, partitioned by page ranges.

Options: path; ``plan`` (made by ``tuplequarry.api``) or the user-facing ones that the api documents; pagesPerPartition.
``pgpages`` gives page headers and ``pgitems`` line pointers, for inspection.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..files import read_range, segments
from ..kernel.scan import line_pointers, read_pages
from ..layout import Context, Table
from .scan import Plan, page_ranges, probe, scan_range

PAGES_PER_PARTITION = 4096


def plan_to_json(plan: Plan) -> str:
    ctx = plan.ctx
    own = {k: v for k, v in asdict(plan).items() if k != "ctx"}
    context = {k: v for k, v in ctx.__dict__.items() if k != "table"}
    return json.dumps(own | {"ctx": context, "table": ctx.table.to_json()})


def plan_from_json(text: str) -> Plan:
    d = json.loads(text)
    ctx = d.pop("ctx")
    ctx["roles"] = {int(k): v for k, v in ctx["roles"].items()}
    return Plan(Context(Table.from_json(d.pop("table")), **ctx), **d)


@dataclass
class PageRange(InputPartition):
    name: str
    before: int
    start: int
    stop: int


def _ddl(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in fields)


class HeapReader(DataSourceReader):
    def __init__(self, path: str, plan: Plan, per: int):
        self.path, self.plan, self.per = path, plan, per
        self.low, self.high = 0, 1 << 62  # of page numbers

    def pushFilters(self, filters):
        """Visibility is decided before anything is decoded; bounds on _page leave out partitions."""
        for f in filters:
            name, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if isinstance(f, EqualTo) and name in ("_live", "_deleted") and isinstance(value, bool):
                want = "live" if (name == "_live") == value else "deleted"
                if self.plan.rows in ("all", want):
                    self.plan = replace(self.plan, rows=want)
                    continue
            elif name == "_page" and isinstance(value, int) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.high = min(self.high, value - isinstance(f, LessThan))
                # pages of a range may lie outside, so Spark applies it too
            yield f

    def partitions(self):
        out = []
        for name, before, start, stop in page_ranges(self.path, self.plan.ctx.page_size, self.per):
            a, b = max(start, self.low - before), min(stop, self.high + 1 - before)
            if a < b:
                out.append(PageRange(name, before, a, b))
        return out or [PageRange("", 0, 0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        yield from scan_range(self.plan, partition.name, partition.before, partition.start, partition.stop)


class HeapStreamReader(DataSourceStreamReader):
    """New pages of a growing relation. A page is handed on once the relation has grown past it."""

    def __init__(self, path: str, plan: Plan, per: int):
        self.path, self.plan, self.per = path, plan, per

    def initialOffset(self):
        return {"page": 0}

    def latestOffset(self):
        n = sum(size // self.plan.ctx.page_size for _, size in segments(self.path))
        return {"page": max(0, n - 1)}

    def partitions(self, start, end):
        out = []
        for name, before, a, b in page_ranges(self.path, self.plan.ctx.page_size, self.per):
            a, b = max(a, start["page"] - before), min(b, end["page"] - before)
            if a < b:
                out.append(PageRange(name, before, a, b))
        return out

    def read(self, partition):
        for b in scan_range(self.plan, partition.name, partition.before, partition.start, partition.stop):
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def commit(self, end):
        pass


class HeapDataSource(DataSource):
    @classmethod
    def name(cls):
        return "pgheap"

    def _plan(self) -> Plan:
        if "plan" not in self.options:
            from ..api import plan_of_options

            self.options = dict(self.options) | {"plan": plan_to_json(plan_of_options(dict(self.options)))}
        return plan_from_json(self.options["plan"])

    def schema(self):
        return _ddl(self._plan().fields())

    def _args(self):
        return self.options["path"], self._plan(), int(self.options.get("pagesPerPartition", PAGES_PER_PARTITION))

    def reader(self, schema):
        return HeapReader(*self._args())

    def streamReader(self, schema):
        return HeapStreamReader(*self._args())


class _InspectReader(DataSourceReader):
    def __init__(self, path: str, items: bool):
        self.path, self.items = path, items
        self.size, self.psv = probe(path)

    def partitions(self):
        return [PageRange(*x) for x in page_ranges(self.path, self.size, PAGES_PER_PARTITION)] or [PageRange("", 0, 0, 0)]

    def read(self, p):
        if not p.name:
            return
        b = np.frombuffer(read_range(p.name, p.start * self.size, (p.stop - p.start) * self.size), np.uint8)
        pages = read_pages(b, self.size, self.psv)
        base = p.before + p.start
        if self.items:
            page, lp, off, flags, length = line_pointers(b, pages, self.size, self.psv)
            cols = {"page": page + base, "lp": lp, "lp_off": off, "lp_flags": flags, "lp_len": length}
        else:
            n = np.where(pages.valid, (pages.lower - 24) // 4, 0)
            cols = {"page": np.arange(len(n)) + base, "valid": pages.valid, "zero": pages.zero, "lower": pages.lower, "upper": pages.upper, "special": pages.special, "items": n}
        yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cols.items()})


class PagesDataSource(DataSource):
    @classmethod
    def name(cls):
        return "pgpages"

    def schema(self):
        return "page bigint, valid boolean, zero boolean, lower bigint, upper bigint, special bigint, items bigint"

    def reader(self, schema):
        return _InspectReader(self.options["path"], False)


class ItemsDataSource(DataSource):
    @classmethod
    def name(cls):
        return "pgitems"

    def schema(self):
        return "page bigint, lp bigint, lp_off bigint, lp_flags bigint, lp_len bigint"

    def reader(self, schema):
        return _InspectReader(self.options["path"], True)


def ensure_registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for x in (HeapDataSource, PagesDataSource, ItemsDataSource):
        spark.dataSource.register(x)
    return spark
