"""Relation files written by tasks: rows become tuples where they are read, go to files by ranges of their key, and are put
on pages there, in order. Each file is a segment of its relation (or several, with ``segment_pages``). The driver sees the
bounds of the ranges and one short row a segment, whatever the size of the table, and renames files.

The folder of the paths is shared between driver and executors. For tests and benchmarks, as the encoder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructType

from ..files import segments
from ..kernel.scan import item_tuples, read_pages
from . import encoder as enc

PER = 120 * 1024  # rows of a file, about; exactly, with exact
BATCH_BYTES = 2 << 20  # of Arrow batches that tasks exchange with Python
HELD_BYTES = 1 << 20  # of tuples that a worker makes before it hands them on
TASKS = 200  # of the jobs that go over files

Tuples = Callable[[tuple], Iterable[tuple[int, int, int, bytes]]]
"""Of a row: (block, relation, place, tuple). Blocks follow each other in a file; place orders the tuples of one row."""


def python_values(c: pa.Array) -> list:
    """Timestamps as microseconds since 2000, so that no time zone comes in."""
    if pa.types.is_timestamp(c.type):
        return [None if x is None else x - 946_684_800_000_000 for x in c.cast(pa.timestamp("us")).cast(pa.int64()).to_pylist()]
    return c.to_pylist()


class Rows:
    """One tuple a row, as write_relation makes it; whole batches at once where that can be. flags sees the first value alone."""

    def __init__(self, columns: tuple, change: Callable[[tuple], tuple] | None = None, flags: Callable[[tuple], dict] | None = None):
        self.columns, self.change, self.flags = columns, change, flags

    def __call__(self, row: tuple) -> Iterable[tuple[int, int, int, bytes]]:
        row = self.change(row) if self.change else row
        return ((0, 0, 0, enc.tuple_bytes(self.columns, row, **(self.flags(row[:1]) if self.flags else {}))),)

    def batch(self, arrays: list[pa.Array]) -> pa.Array | None:
        n = len(arrays[0])
        if self.change or not n:
            return None
        infomask, xmax = np.full(n, enc.LIVE, np.int64), np.zeros(n, np.int64)
        if self.flags:
            more = [self.flags((x,)) for x in python_values(arrays[0])]
            if any(x.keys() - {"infomask", "xmax"} for x in more):
                return None
            infomask, xmax = (np.array([x.get(k, d) for x in more], np.int64) for k, d in (("infomask", enc.LIVE), ("xmax", 0)))
        return enc.tuple_array(self.columns, arrays, infomask, xmax)


def tuples_of(columns: tuple, change: Callable[[tuple], tuple] | None = None, flags: Callable[[tuple], dict] | None = None) -> Rows:
    return Rows(columns, change, flags)


def _bounds(df: DataFrame, key: str, files: int) -> list:
    """Keys at which ranges of about as many rows end; fewer where one key has many rows."""
    if files < 2:
        return []
    at = F.percentile_approx(key, F.array(*[F.lit(i / files) for i in range(1, files)]), max(10_000, 20 * files))
    return sorted(set(df.agg(at).first()[0] or []))


def _range_of(bounds: list, column: pa.Array) -> np.ndarray:
    """The number of each key's range; of null the first, as nulls sort first."""
    if not bounds:
        return np.zeros(len(column), np.int32)
    return np.searchsorted(np.array(bounds), column.fill_null(bounds[0]).to_numpy(zero_copy_only=False)).astype(np.int32)


def _numbered(df: DataFrame, order: list[str], bounds: list, per: int) -> DataFrame:
    """df with _file, the number of the row in order over per: numbers in a range, from the sum of the ranges before it."""

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_range_of(bounds, b.column(order[0])))], [*b.schema.names, "_range"])

    df = df.mapInArrow(ranged, StructType([*df.schema.fields, *StructType().add("_range", IntegerType()).fields]))
    before, start = 0, []
    for r in df.groupBy("_range").count().orderBy("_range").collect():
        start.append((r["_range"], before))
        before += r["count"]
    n = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    df = df.withColumn("_n", n).join(F.broadcast(df.sparkSession.createDataFrame(start, "_range int, _start long")), "_range")
    return df.withColumn("_file", F.floor((F.col("_n") + F.col("_start")) / per).cast("int")).drop("_range", "_n", "_start")


def _encode(names: list[str], order: list[str], make: Tuples, bounds: list, files: int):
    out = ["_file", "_relation", *(f"_k{i}" for i in range(len(order))), "_place", "_tuple"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = "_file" in b.schema.names
            numbers = b.column("_file").to_numpy() if known else _range_of(bounds, b.column(order[0]))
            keys = [b.column(c) for c in order]
            if isinstance(make, Rows) and (whole := make.batch([b.column(c) for c in names])) is not None:
                zero = pa.array(np.zeros(b.num_rows, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), zero, *keys, zero, whole], out)
                continue
            file = numbers.tolist()
            at: list[int] = []
            made: list[tuple[int, int, int, bytes]] = []
            held = 0

            def handed(file=file, keys=keys, at=at, made=made) -> pa.RecordBatch:
                f = [x[0] * files + file[i] for i, x in zip(at, made, strict=True)]
                take = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array([x[1] for x in made], pa.int32()), *(k.take(take) for k in keys), pa.array([x[2] for x in made], pa.int32()), pa.array([x[3] for x in made], pa.binary())], out)

            for i, row in enumerate(zip(*(python_values(b.column(c)) for c in names), strict=True)):
                for x in make(row):
                    at.append(i)
                    made.append(x)
                    held += len(x[3]) + 64
                    if held > HELD_BYTES:
                        yield handed()
                        at.clear()
                        made.clear()
                        held = 0
            if at:
                yield handed()

    return run


def _write(relations: list[tuple[str, bool, dict]]):
    """Tuples sorted by file and relation, put on pages; a row a file, with the pages of its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, w = None, None

        def closed() -> pa.RecordBatch:
            w.close()
            pages = [size // w.size for _, size in segments(w.path)]
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([w.path]), pa.array([pages], pa.list_(pa.int32()))], ["file", "relation", "part", "pages"])

        for b in batches:
            for file, relation, raw in zip(b["_file"].to_pylist(), b["_relation"].to_pylist(), b["_tuple"].to_pylist(), strict=True):
                if (file, relation) != now:
                    if w:
                        yield closed()
                    path, placed, page = relations[relation]
                    now, w = (file, relation), enc.PageWriter(f"{path}.part-{file}-{uuid.uuid4().hex}", **page)
                w.add((lambda place, raw=raw: enc.placed(raw, place)) if placed else raw)
        if w:
            yield closed()

    return run


def over(spark: SparkSession, jobs: list[tuple], do: Callable[..., None]) -> None:
    """do(*job) for each job, in tasks."""
    if not jobs:
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b["id"].to_pylist():
                do(*jobs[i])
            yield b

    spark.range(0, len(jobs), 1, min(len(jobs), TASKS)).mapInArrow(run, "id long").agg(F.count("*")).collect()


def _place_file(path: str, size: int, base: int) -> None:
    """Tuples' own places, once it is known how many pages lie before the file."""
    step = 512 * size
    with open(path, "r+b") as f:
        at = 0
        while data := f.read(step):
            b = np.frombuffer(bytearray(data), np.uint8)
            t = item_tuples(b, read_pages(b, size), size)
            page = t.page + base + at // size
            for k, x in enumerate((page >> 16, page & 0xFFFF, t.lp)):
                b[t.start + 12 + 2 * k], b[t.start + 13 + 2 * k] = x & 0xFF, x >> 8
            f.seek(at)
            f.write(b.tobytes())
            at += len(data)


def spread(df: DataFrame, order: list[str], make: Tuples, relations: list[tuple[str, bool, dict]], per: int = PER, exact: bool = False, blocks: int = 1) -> None:
    """The tuples of df's rows as relation files. relations: path, whether tuples bear their own place, and arguments of
    PageWriter; exact: files of per rows each, so that pages are those of one file where per is a multiple of their rows."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    names, rows = df.columns, df.count()
    bounds = _bounds(df, order[0], -(-rows // per))
    files = -(-rows // per) if exact and bounds else len(bounds) + 1
    kinds = [df.schema[c].dataType for c in order]
    if exact and bounds:
        df = _numbered(df, order, bounds, per)
    schema = StructType().add("_file", IntegerType()).add("_relation", IntegerType())
    for i, kind in enumerate(kinds):
        schema = schema.add(f"_k{i}", kind)
    schema = schema.add("_place", IntegerType()).add("_tuple", BinaryType())
    d = df.mapInArrow(_encode(names, order, make, bounds, files), schema).repartitionById(files * blocks, F.col("_file"))
    d = d.sortWithinPartitions("_file", "_relation", *(f"_k{i}" for i in range(len(order))), "_place").select("_file", "_relation", "_tuple")
    written = d.mapInArrow(_write(relations), "file int, relation int, part string, pages array<int>").collect()
    written.sort(key=lambda r: (r.relation, r.file))
    shifted, renamed = [], []
    for relation, (path, placed, page) in enumerate(relations):
        base = n = 0
        for r in written:
            if r.relation == relation:
                for k, pages in enumerate(r.pages):
                    part = f"{r.part}.{k}" if k else r.part
                    if placed and base:
                        shifted.append((part, page.get("size", 8192), base))
                    renamed.append((part, f"{path}.{n}" if n else path))
                    base += pages
                    n += 1
        if not n:
            enc.PageWriter(path, **page).close()
    over(spark, shifted, _place_file)
    for part, path in renamed:
        os.replace(part, path)


def rewritten(spark: SparkSession, source: str, target: str, wipe: Callable[[bytearray, int], None], size: int = 8192) -> None:
    """A relation's files page by page through wipe(page, its number), which may change the page."""

    def one(name: str, to: str, base: int) -> None:
        part = f"{to}.part-{uuid.uuid4().hex}"
        with open(name, "rb") as f, open(part, "wb") as out:
            while page := bytearray(f.read(size)):
                wipe(page, base)
                out.write(page)
                base += 1
        os.replace(part, to)

    jobs, base = [], 0
    for k, (name, length) in enumerate(segments(source)):
        jobs.append((name, f"{target}.{k}" if k else target, base))
        base += length // size
    over(spark, jobs, one)
