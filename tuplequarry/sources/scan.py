"""Decoding of page ranges: what readers on executors and planning on the driver have in common."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa

from ..files import parent, read_range, segments, size_of
from ..kernel.columns import POINTER, Columnar, arrow_type, spark_type
from ..kernel.scan import HASOID_OLD, PLAIN, Pages, Tuples, carve_tuples, item_tuples, page_layout, read_pages, u32, visibility, walk
from ..layout import PAGE_SIZES, TOAST, Context

CHUNK_PAGES = 512
DIRECT_BYTES = 64 << 20  # up to this size each reader loads a storage relation itself
META = {
    "_page": "bigint",
    "_lp": "int",
    "_pos": "int",
    "_ctid": "string",
    "_xmin": "bigint",
    "_xmax": "bigint",
    "_infomask": "int",
    "_infomask2": "int",
    "_live": "boolean",
    "_deleted": "boolean",
    "_decode_status": "string",
    "_oid": "bigint",  # of the row, where tuple headers have one (up to version 11)
}


@dataclass(frozen=True)
class Plan:
    """What a scan is to do with the pages it gets."""

    ctx: Context
    rows: str = "live"  # live, deleted, all (both)
    scan: str = "itemid"  # itemid, carve, auto (carve the pages on which line pointers lead to nothing)
    meta: bool = False
    pointers: bool = False  # hand out-of-line pointers on, in columns of their own
    toast: str = ""  # relation file with the chunks
    max_rows: int = 0  # of one range of pages; 0: all
    toast_bytes: int = DIRECT_BYTES  # that a storage relation may have to be loaded by readers

    def fields(self) -> list[tuple[str, str]]:
        """Names and Spark types of the result."""
        ctx = self.ctx
        out = [(c.name, spark_type(c, ctx)) for c in ctx.table.live]
        if self.pointers:
            out += [(f"_ext_{c.name}", POINTER) for c in ctx.table.live if c.size == -1]
        return out + (list(META.items()) if self.meta else [])


def probe(path: str) -> tuple[int, int]:
    """(page size, offset of the size word) of a relation: from its first page's header, else from any of the first
    32 KB, else the usual."""
    head = read_range(path, 0, PAGE_SIZES[-1])
    if found := page_layout(head[:130]) or (page_layout(head) if len(head) <= PAGE_SIZES[-1] else None):
        return found
    for size in PAGE_SIZES:  # a damaged first page
        for at in range(size, len(head), size):
            if (found := page_layout(head[at : at + 130])) and found[0] == size:
                return found
    return 8192, 18


def page_ranges(path: str, size: int, per: int) -> list[tuple[str, int, int, int]]:
    """(file, its first page's number in the relation, start, stop) of ranges of at most per pages."""
    out, before = [], 0
    for name, length in segments(path):
        n = length // size
        out += [(name, before, k, min(k + per, n)) for k in range(0, n, per)]
        before += n
    return out


def chunks_of(path: str, version: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(value ids, sequence numbers, chunks) of an out-of-line storage relation, a range of pages at a time.

    Visibility is not looked at: chunks of deleted rows are wanted too."""
    size, psv = probe(path)
    for name, _, start, stop in page_ranges(path, size, CHUNK_PAGES):
        b = np.frombuffer(read_range(name, start * size, (stop - start) * size), np.uint8)
        t = item_tuples(b, read_pages(b, size, psv), size, psv)
        values, _, _ = walk(b, t, TOAST.columns)
        ids, seq, data = values
        ok = ~(ids.null | seq.null | data.null) & (data.kind == PLAIN)
        get = lambda v, ok=ok, b=b: np.ascontiguousarray(b[v.at[ok][:, None] + np.arange(4)]).view("<u4")[:, 0].astype(np.int64)
        mem = memoryview(b)
        yield get(ids), get(seq), [bytes(mem[a : a + n]) for a, n in zip(data.at[ok].tolist(), data.size[ok].tolist(), strict=True)]


def assembled(parts: list[tuple[int, bytes]]) -> bytes | None:
    """Chunks in order of their numbers; None if one is missing. Repeated numbers (old versions) count once."""
    by = dict(sorted(parts))
    return b"".join(by.values()) if list(by) == list(range(len(by))) else None


def storage(plan: Plan, path: str):
    """What gives readers the data of an out-of-line pointer: from the storage relation that the plan names, else from the
    one that the pointer itself names, if its file lies beside the relation."""

    def load(file: str) -> dict[int, bytes | None]:
        if (n := sum(size for _, size in segments(file))) > plan.toast_bytes:
            raise ValueError(f"storage relation {file} has {n} bytes, more than the {plan.toast_bytes} that readers load: read by api.heap_table, which joins it, or raise directToastBytes")
        return load_chunks(file)

    def data(pointer: dict) -> bytes | None:
        file = plan.toast or f"{parent(path)}/{pointer['toastrelid']}"
        return load(file).get(pointer["valueid"]) if size_of(file) > 0 else None

    return data


def load_chunks(path: str) -> dict[int, bytes | None]:
    """All values of a storage relation, kept for the process: for relations of a checked size only."""
    cache = sys.__dict__.setdefault("_tuplequarry_toast", {})
    key = path, tuple(segments(path))
    if key not in cache:
        parts: dict[int, list] = {}
        for ids, seq, data in chunks_of(path):
            for i, s, x in zip(ids.tolist(), seq.tolist(), data, strict=True):
                parts.setdefault(i, []).append((s, x))
        cache.clear()
        cache[key] = {i: assembled(x) for i, x in parts.items()}
    return cache[key]


def decode(b: np.ndarray, first_page: int, plan: Plan, columnar: Columnar) -> pa.RecordBatch | None:
    """The rows of some pages."""
    ctx = plan.ctx
    columns, size = ctx.table.columns, ctx.page_size
    pages = read_pages(b, size, ctx.psv_offset)
    if plan.scan == "carve":
        t = carve_tuples(b, pages, size, columns, ctx.pg_version, ctx.psv_offset)
    else:
        t = item_tuples(b, pages, size, ctx.psv_offset)
        if plan.scan == "auto" and len(bare := np.setdiff1d(np.flatnonzero(pages.valid), t.page)):
            left = np.zeros(len(pages.valid), bool)
            left[bare] = True
            lost = carve_tuples(b, Pages(left, pages.zero, pages.lower, pages.upper, pages.special), size, columns, ctx.pg_version, ctx.psv_offset, True)
            t = Tuples(*(np.concatenate([getattr(x, f) for x in (t, lost)]) for f in Tuples.__dataclass_fields__))
            t = t.take(np.argsort(t.page, kind="stable"))
    aborted, deleted = visibility(t.infomask, t.xmax)
    keep = {"live": ~aborted & ~deleted, "deleted": deleted, "all": ~aborted}[plan.rows]
    t, deleted = t.take(keep), deleted[keep]
    if plan.max_rows:
        t, deleted = t.take(np.arange(min(len(t), plan.max_rows))), deleted[: plan.max_rows]
    if not len(t):
        return None
    problems: dict[int, list[str]] = {}
    arrays: list[pa.Array] = []
    live = [i for i, c in enumerate(columns) if not c.dropped]
    # Without a column to decode, headers are enough.
    values = walk(b, t, columns[: live[-1] + 1])[0] if live else []
    arrays += [columnar.column(b, values[i], columns[i], problems) for i in live]
    if plan.pointers:
        arrays += [columnar.pointers(b, values[i]) for i in live if columns[i].size == -1]
    if plan.meta:
        page = t.page + first_page
        pos = t.start - t.page * size
        place = np.where(t.lp > 0, t.lp, pos)
        status = [";".join(problems[i]) if i in problems else None for i in range(len(t))] if problems else [None] * len(t)
        ctid = pa.array([f"({p},{k})" for p, k in zip(page.tolist(), place.tolist(), strict=True)])
        has_oid = (t.infomask & HASOID_OLD != 0) & (ctx.pg_version < 12)
        oid = pa.array(u32(b, t.start + t.hoff - 4), pa.int64(), mask=~has_oid)
        values_ = (page, t.lp, pos, ctid, t.xmin, t.xmax, t.infomask, t.infomask2, ~deleted, deleted, status, oid)
        arrays += [x if isinstance(x, pa.Array) else pa.array(x, arrow_type(k)) for x, k in zip(values_, META.values(), strict=True)]
    names = [n for n, _ in plan.fields()]
    if not arrays:
        return pa.RecordBatch.from_struct_array(pa.array([{}] * len(t), pa.struct([])))
    return pa.RecordBatch.from_arrays(arrays, names)


def scan_range(plan: Plan, name: str, before: int, start: int, stop: int) -> Iterator[pa.RecordBatch]:
    size, left = plan.ctx.page_size, plan.max_rows
    toast = None if plan.pointers else storage(plan, name)
    columnar = Columnar(plan.ctx, toast)
    for k in range(start, stop, CHUNK_PAGES):
        n = min(CHUNK_PAGES, stop - k)
        b = np.frombuffer(read_range(name, k * size, n * size), np.uint8)
        batch = decode(b, before + k, replace(plan, max_rows=left) if left else plan, columnar)
        if batch is not None:
            yield batch
            left -= batch.num_rows if left else 0
            if plan.max_rows and left <= 0:
                return


def read_local(path: str, plan: Plan) -> list[dict]:
    """All rows of a small relation, on the driver: for planning from system catalogs."""
    return [r for x in page_ranges(path, plan.ctx.page_size, CHUNK_PAGES) for b in scan_range(plan, *x) for r in b.to_pylist()]
