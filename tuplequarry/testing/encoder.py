"""Writes relation files in the page format, for tests and benchmarks: the inverse of the readers."""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Callable, Iterable
from datetime import date, datetime
from decimal import Decimal

import numpy as np

from ..kernel.scan import HASNULL, HASOID_OLD, XMAX_INVALID, XMIN_COMMITTED
from ..layout import OID, TOAST, TYPES, Column

LIVE = XMIN_COMMITTED | XMAX_INVALID


def varlena(payload: bytes, short: bool = True) -> bytes:
    """With the one-byte header where it fits, else the four-byte one."""
    if short and len(payload) < 127:
        return bytes([(len(payload) + 1) << 1 | 1]) + payload
    return struct.pack("<I", (len(payload) + 4) << 2) + payload


def compressed(raw: bytes, method: str) -> bytes:
    """A compressed datum with its header."""
    body = struct.pack("<I", len(raw) | (1 << 30 if method == "lz4" else 0)) + (lz4(raw) if method == "lz4" else pglz(raw))
    return struct.pack("<I", (len(body) + 4) << 2 | 2) + body


def lz4(raw: bytes) -> bytes:
    import pyarrow as pa

    return pa.Codec("lz4_raw").compress(raw).to_pybytes()


def pglz(raw: bytes) -> bytes:
    return pglz_many([raw])[0]


def pglz_many(raws: list[bytes]) -> list[bytes]:
    """A greedy encoder: the latest earlier place of the next three bytes. Arrays over all values hold these places and how
    far copies from them reach, and lay the items out; only the choice of copies goes from one to the next."""
    length = np.array([len(x) for x in raws], np.int64)
    n, whole = int(length.sum()), b"".join(raws)
    if not n:
        return [b""] * len(raws)
    ends = np.cumsum(length)
    a = np.frombuffer(whole, np.uint8)
    start, end = np.repeat(ends - length, length), np.repeat(ends, length)
    back = np.zeros(n, np.int64)  # to the latest earlier place; 0: none, or too far
    if n > 3:
        w = a.astype(np.int64)
        key = np.sort((w[:-2] << 16 | w[1:-1] << 8 | w[2:]) << 32 | np.arange(n - 2))
        step = np.diff(key)  # under 4096: of one key, and so near
        at = key[1:] & 0xFFFFFFFF
        near = (step < 4096) & (at - step >= start[at]) & (at + 3 <= end[at])
        back[at[near]] = step[near]
    # How far the copies reach: eight bytes at a time, of those that have not ended; long ones only if they are chosen.
    some = np.flatnonzero(back)
    eight = np.ndarray((n + 280,), "<u8", whole + bytes(288), strides=(1,))
    size = np.full(len(some), 3)
    going = np.arange(len(some))
    for _ in range(3):
        k = some[going] + size[going]
        differ = eight[k] ^ eight[k - back[some[going]]]
        low = (differ & (~differ + np.uint64(1))).astype(np.float64)
        size[going] += np.where(differ == 0, 8, np.log2(np.maximum(low, 1)).astype(np.int64) >> 3)
        going = going[(differ == 0) & (size[going] < 273)]
    size = np.minimum(size, np.minimum(273, end[some] - some))
    # The first copy at or after each copy's end.
    after = np.searchsorted(some, some + size).tolist()
    long = set(going.tolist())
    taken, i = [], 0
    while i < len(after):
        taken.append(i)
        if i in long:
            at, d, far = int(some[i]), int(back[some[i]]), int(size[i])
            most = min(273, int(end[at]) - at)
            while far < most and whole[at + far : at + far + 16] == whole[at + far - d : at + far - d + 16]:
                far += 16
            far = min(far, most)
            while far < most and whole[at + far] == whole[at + far - d]:
                far += 1
            size[i] = far
            i = int(np.searchsorted(some, at + far))
        else:
            i = after[i]
    k, size = some[taken], size[taken]
    inside = np.zeros(n + 1, np.int64)
    inside[k + 1] += 1
    inside[k + size] -= 1
    item = np.flatnonzero(np.cumsum(inside[:n]) == 0)  # where items begin
    copy = np.searchsorted(item, k)
    width = np.ones(len(item), np.int64)
    width[copy] = np.where(size >= 18, 3, 2)
    # Items are numbered in each value; a control byte precedes each eight.
    last = np.searchsorted(item, ends)
    many = np.diff(last, prepend=0)
    controls = -(-many // 8)
    number = np.arange(len(item)) - np.repeat(last - many, many)
    control = np.repeat(np.cumsum(controls) - controls, many) + number // 8
    place = np.cumsum(width) - width + control + 1
    out = np.zeros(int(width.sum() + controls.sum()), np.uint8)
    out[place] = a[item]
    d, p = back[k], place[copy]
    out[p], out[p + 1] = (d >> 4 & 0xF0) | (np.minimum(size, 18) - 3), d & 0xFF
    out[p[size >= 18] + 2] = size[size >= 18] - 18
    flags = np.zeros(int(controls.sum()) * 8, np.uint8)
    flags[control[copy] * 8 + number[copy] % 8] = 1
    out[place[number % 8 == 0] - 1] = np.packbits(flags, bitorder="little")
    stops = np.append(0, np.append(0, np.cumsum(width))[last] + np.cumsum(controls)).tolist()
    data = out.tobytes()
    return [data[x:y] for x, y in zip(stops[:-1], stops[1:], strict=True)]


def pointer(rawsize: int, extsize: int, value: int, relation: int, method: int = 0) -> bytes:
    return b"\x01\x12" + struct.pack("<4I", rawsize, extsize | method << 30, value, relation)


def numeric(x: Decimal | str) -> bytes:
    x = Decimal(x)
    if x.is_nan():
        return struct.pack("<H", 0xC000)
    if x.is_infinite():
        return struct.pack("<H", 0xF000 if x < 0 else 0xD000)
    sign, digits, exponent = x.as_tuple()
    scale = max(0, -exponent)
    whole, _, part = format(x.copy_abs(), "f").partition(".")
    whole, part = whole.lstrip("0"), part + "0" * (-len(part) % 4)
    whole = "0" * (-len(whole) % 4) + whole
    groups = [int((whole + part)[i : i + 4]) for i in range(0, len(whole + part), 4)]
    weight = len(whole) // 4 - 1
    while groups and groups[0] == 0:
        groups.pop(0)
        weight -= 1
    while groups and groups[-1] == 0:
        groups.pop()
    weight = weight if groups else 0
    if scale <= 63 and -64 <= weight <= 63:
        head = struct.pack("<H", 0x8000 | (0x2000 if sign else 0) | scale << 7 | weight & 0x7F)
    else:
        head = struct.pack("<Hh", (0x4000 if sign else 0) | scale, weight)
    return head + struct.pack(f"<{len(groups)}H", *groups)


def jsonb(x) -> bytes:
    """Keys are kept in the order given."""

    def entry(v) -> tuple[int, bytes, bool]:
        if v is None:
            return 4, b"", False
        if v is True or v is False:
            return 3 if v else 2, b"", False
        if isinstance(v, int | float | Decimal):
            return 1, varlena(numeric(repr(v) if isinstance(v, float) else str(v)), short=False), True
        if isinstance(v, str):
            return 0, v.encode(), False
        return 5, container(v), True

    def container(v, scalar: bool = False) -> bytes:
        items = [*v, *v.values()] if isinstance(v, dict) else list(v)
        head = (0x20000000 if isinstance(v, dict) else 0x40000000) | (0x10000000 if scalar else 0) | len(v)
        entries, data = [], b""
        for i, item in enumerate(items):
            kind, body, aligned = entry(item)
            start = len(data)
            if aligned:
                data += b"\0" * (-start % 4)
            data += body
            entries.append(kind << 28 | (0x80000000 | len(data) if i % 32 == 31 else len(data) - start))
        return struct.pack(f"<{len(entries) + 1}I", head, *entries) + data

    return container(x) if isinstance(x, dict | list) else container([x], True)


def array(values: list, elem: int, encode: Callable[[object], bytes] | None = None, low: list[int] | None = None) -> bytes:
    dims: list[int] = []
    flat: list = values
    v = values
    while isinstance(v, list) and v:
        dims.append(len(v))
        v = v[0]
    for _ in dims[1:]:
        flat = [x for y in flat for x in y]
    if not dims:
        return struct.pack("<iiI", 0, 0, elem)
    t = TYPES.get(elem)
    size, align = (t.length, {"c": 1, "s": 2, "i": 4, "d": 8}[t.align]) if t else (4, 4)
    head = struct.pack("<i", len(dims)), struct.pack("<I", elem) + struct.pack(f"<{len(dims)}i", *dims) + struct.pack(f"<{len(dims)}i", *(low or [1] * len(dims)))
    bitmap = b""
    if any(x is None for x in flat):
        bits = bytearray(-(-len(flat) // 8))
        for i, x in enumerate(flat):
            bits[i // 8] |= (x is not None) << i % 8
        bitmap = bytes(bits)
    at = 16 + 8 * len(dims) + len(bitmap)
    at = -(-at // 8) * 8
    offset = at if bitmap else 0
    start = at if bitmap or (t and t.align == "d") else 16 + 8 * len(dims)
    body = b""
    for x in flat:
        if x is None:
            continue
        raw = (encode or ENCODE[elem])(x)
        if size > 0:
            body += b"\0" * (-(start + len(body)) % align) + raw
        else:
            d = varlena(raw)
            body += (b"" if d[0] & 1 else b"\0" * (-(start + len(body)) % 4)) + d
    pad = start - (16 + 8 * len(dims) + len(bitmap))
    return head[0] + struct.pack("<i", offset) + head[1] + bitmap + b"\0" * pad + body


_DAY = date(2000, 1, 1)
_US = datetime(2000, 1, 1)


def micros(x: datetime) -> int:
    d = x.replace(tzinfo=None) - _US
    return d.days * 86_400_000_000 + d.seconds * 1_000_000 + d.microseconds


def _int(fmt: str) -> Callable:
    return lambda x: struct.pack(fmt, x)


_names: dict[str, Callable] = {
    "bool": lambda x: b"\1" if x else b"\0", "int2": _int("<h"), "int4": _int("<i"), "int8": _int("<q"), "oid": _int("<I"), "xid": _int("<I"), "cid": _int("<I"), "regproc": _int("<I"),
    "float4": _int("<f"), "float8": _int("<d"), "date": lambda x: struct.pack("<i", x if isinstance(x, int) else (x - _DAY).days), "money": _int("<q"), "time": _int("<q"),
    "timestamp": lambda x: struct.pack("<q", x if isinstance(x, int) else micros(x)), "timestamptz": lambda x: struct.pack("<q", x if isinstance(x, int) else micros(x)),
    "name": lambda x: x.encode().ljust(64, b"\0")[:64], "char": lambda x: x.encode("latin-1")[:1].ljust(1, b"\0"),
    "numeric": numeric, "jsonb": jsonb,
}
ENCODE: dict[int, Callable] = {OID[k]: v for k, v in _names.items()} | {OID[x]: lambda v: v.encode() if isinstance(v, str) else v for x in ("text", "varchar", "bpchar", "json", "xml", "bytea", "pg_node_tree")}


def payload(c: Column, x) -> bytes:
    """A value's bytes without header: by the type's encoder, or as they are."""
    if isinstance(x, bytes) and c.type_oid not in (OID["numeric"], OID["jsonb"]):
        return x
    t = TYPES.get(c.type_oid)
    if t and t.elem:
        return array(x, t.elem)
    return ENCODE[c.type_oid](x)


class Datum(bytes):
    """A variable-length value that brings its own header (compressed, out of line)."""


def tuple_bytes(columns: tuple[Column, ...], row: tuple, xmin: int = 100, xmax: int = 0, infomask: int = LIVE, ctid: tuple[int, int] = (0, 0), natts: int | None = None, short: bool = True, oid: int | None = None) -> bytes:
    """oid: up to version 11, kept in the four bytes before the data."""
    n = len(columns) if natts is None else natts
    nulls = any(x is None for x in row[:n])
    bitmap = b""
    if nulls:
        infomask |= HASNULL
        bits = bytearray(-(-n // 8))
        for i in range(n):
            bits[i // 8] |= (row[i] is not None) << i % 8
        bitmap = bytes(bits)
    hoff = -(-(23 + len(bitmap) + 4 * (oid is not None)) // 8) * 8
    if oid is not None:
        infomask |= HASOID_OLD
    data = bytearray()
    for c, x in zip(columns[:n], row[:n], strict=True):
        if x is None:
            continue
        if c.size > 0:
            data += b"\0" * (-len(data) % c.alignment) + (payload(c, x)[: c.size] if not isinstance(x, bytes) else x)
        elif c.size == -2:
            data += payload(c, x) + b"\0"
        else:
            d = x if isinstance(x, Datum) else varlena(payload(c, x), short)
            if not d[0] & 1:
                data += b"\0" * (-len(data) % c.alignment)
            data += d
    head = struct.pack("<IIIHHHHHB", xmin, xmax, 0, ctid[0] >> 16, ctid[0] & 0xFFFF, ctid[1], n, infomask, hoff)
    gap = bytearray(hoff - 23 - len(bitmap))
    if oid is not None:
        gap[-4:] = struct.pack("<I", oid)
    return head + bitmap + bytes(gap) + bytes(data)


_PLAIN = {OID[k]: v for k, v in {"int2": "<i2", "int4": "<i4", "int8": "<i8", "float4": "<f4", "float8": "<f8", "timestamp": "<i8", "timestamptz": "<i8"}.items()}
_TEXT = {OID["text"], OID["varchar"]}


def tuple_array(columns: tuple[Column, ...], arrays: list, infomask: np.ndarray, xmax: np.ndarray, xmin: int = 100):
    """tuple_bytes of many rows at once, column by column; None if a column is not of a number, timestamp or string type."""
    import pyarrow as pa

    if not all(pa.types.is_string(a.type) if c.type_oid in _TEXT else c.type_oid in _PLAIN and (pa.types.is_integer(a.type) or pa.types.is_floating(a.type) or pa.types.is_timestamp(a.type)) for c, a in zip(columns, arrays, strict=True)):
        return None
    n, width = len(arrays[0]), -(-len(columns) // 8)
    valid = [np.ones(n, bool) if not a.null_count else a.is_valid().to_numpy(zero_copy_only=False) for a in arrays]
    nulls = ~np.logical_and.reduce(valid)
    hoff = np.where(nulls, -(-(23 + width) // 8) * 8, 24)
    at, places = np.zeros(n, np.int64), []
    for c, a, ok in zip(columns, arrays, valid, strict=True):
        if c.type_oid in _TEXT:
            ends = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + n + 1].astype(np.int64)
            size = np.diff(ends)
            short = size < 127
            start = np.where(short, at, -(-at // c.alignment) * c.alignment)
            places.append((start, ends[:-1], size, short))
            end = start + size + np.where(short, 1, 4)
        else:
            start = -(-at // c.alignment) * c.alignment
            places.append((start,))
            end = start + c.size
        at = np.where(ok, end, at)
    stop = np.cumsum(hoff + at)
    begin = stop - hoff - at
    out = np.zeros(int(stop[-1]), np.uint8)

    def put(where: np.ndarray, values: np.ndarray) -> None:
        if not len(values):
            return
        raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
        for k in range(raw.shape[1]):
            out[where + k] = raw[:, k]

    head = np.zeros(n, np.dtype([("xmin", "<u4"), ("xmax", "<u4"), ("cid", "<u4"), ("ctid", "<u2", 3), ("natts", "<u2"), ("infomask", "<u2"), ("hoff", "u1")]))
    head["xmin"], head["xmax"], head["natts"], head["infomask"], head["hoff"] = xmin, xmax, len(columns), infomask | np.where(nulls, HASNULL, 0), hoff
    put(begin, head)
    if nulls.any():
        bits = np.packbits(np.array(valid).T[nulls], axis=1, bitorder="little")
        put(begin[nulls] + 23, bits)
    data = begin + hoff
    for c, a, ok, (start, *more) in zip(columns, arrays, valid, places, strict=True):
        where = (data + start)[ok]
        if not more:
            if pa.types.is_timestamp(a.type):
                a = a.cast(pa.timestamp("us")).cast(pa.int64())
                v = a.fill_null(0).to_numpy() - 946_684_800_000_000
            else:
                v = a.fill_null(0).to_numpy()
            put(where, v.astype(_PLAIN[c.type_oid])[ok])
            continue
        source, size, short = (x[ok] for x in more)
        out[where[short]] = (size[short] + 1) << 1 | 1
        put(where[~short], ((size[~short] + 4) << 2).astype("<u4"))
        where = where + np.where(short, 1, 4)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        if len(step):
            out[np.repeat(where, size) + step] = np.frombuffer(a.buffers()[2], np.uint8)[np.repeat(source, size) + step]
    offsets = np.append(0, stop).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


class PageWriter:
    """Fills pages with tuples, from the end of the page, and line pointers, from its start."""

    def __init__(self, path: str, size: int = 8192, version: int = 4, special: int = 0, segment_pages: int | None = None):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        self.path, self.size, self.version, self.special, self.segment_pages = path, size, version, size - special, segment_pages
        self.file, self.page, self.in_file, self.segment = open(path, "wb"), 0, 0, 0  # noqa: SIM115
        self._begin()

    def _begin(self) -> None:
        self.items: list[tuple[int, int, int]] = []
        self.tuples: list[bytes] = []
        self.upper = self.special

    def add(self, make: Callable[[tuple[int, int]], bytes] | bytes, flags: int = 1) -> tuple[int, int]:
        place = (self.page, len(self.items) + 1)
        raw = make if isinstance(make, bytes) else make(place)
        room = -(-len(raw) // 8) * 8
        if 24 + 4 * (len(self.items) + 1) > self.upper - room:
            self.flush()
            return self.add(make, flags)
        self.upper -= room
        self.items.append((self.upper, flags, len(raw)))
        self.tuples.append(raw)
        return place

    def flush(self) -> None:
        if not self.items:
            return
        b = bytearray(self.size)
        struct.pack_into("<QHHHHHHI", b, 0, 1, 0, 0, 24 + 4 * len(self.items), self.upper, self.special, self.size | self.version, 0)
        for i, (off, flags, n) in enumerate(self.items):
            struct.pack_into("<I", b, 24 + 4 * i, off | flags << 15 | n << 17)
        for (off, _, n), raw in zip(self.items, self.tuples, strict=True):
            b[off : off + n] = raw
        self.raw(bytes(b))
        self._begin()

    def raw(self, page: bytes) -> None:
        """A page as it is (damaged, empty)."""
        if self.segment_pages and self.in_file == self.segment_pages:
            self.file.close()
            self.segment += 1
            self.file, self.in_file = open(f"{self.path}.{self.segment}", "wb"), 0  # noqa: SIM115
        self.file.write(page)
        self.page += 1
        self.in_file += 1

    def close(self) -> None:
        self.flush()
        self.file.close()


def write_relation(path: str, columns: tuple[Column, ...], rows: Iterable[tuple], size: int = 8192, flags: Callable[[tuple], dict] | None = None, **page) -> None:
    """rows as a relation file. flags(row): keyword arguments of tuple_bytes."""
    w = PageWriter(path, size, **page)
    for row in rows:
        more = flags(row) if flags else {}
        w.add(lambda place, row=row, more=more: tuple_bytes(columns, row, ctid=place, **more))
    w.close()


def placed(raw: bytes, place: tuple[int, int]) -> bytes:
    """A tuple with its own place in its header."""
    return raw[:12] + struct.pack("<HHH", place[0] >> 16, place[0] & 0xFFFF, place[1]) + raw[18:]


def chunk_tuples(value: int, data: bytes, chunk: int = 1996, skip: Callable[[int, int], bool] | None = None) -> Iterable[tuple[int, bytes]]:
    """Numbers and tuples of the chunks of an out-of-line value."""
    for k in range(-(-len(data) // chunk)):
        if not (skip and skip(value, k)):
            yield k, tuple_bytes(TOAST.columns, (value, k, data[k * chunk : (k + 1) * chunk]))


def write_toast(path: str, values: Iterable[tuple[int, bytes]], chunk: int = 1996, size: int = 8192, skip: Callable[[int, int], bool] | None = None) -> None:
    w = PageWriter(path, size)
    for value, data in values:
        for _, raw in chunk_tuples(value, data, chunk, skip):
            w.add(raw)
    w.close()


def parse_json(text: str):
    return json.loads(text, parse_float=Decimal)
