"""From raw pages to tuples and attribute places, for whole ranges of pages at once with NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..layout import PAGE_SIZES, Column

HASNULL, HASOID_OLD = 0x0001, 0x0008
LOCK_ONLY, XMIN_COMMITTED, XMIN_INVALID, XMAX_COMMITTED, XMAX_INVALID, IS_MULTI = 0x0080, 0x0100, 0x0200, 0x0400, 0x0800, 0x1000
NATTS = 0x07FF
PLAIN, COMPRESSED, EXTERNAL = 0, 1, 2


def u16(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    return b[at].astype(np.int64) | b[at + 1].astype(np.int64) << 8


def u32(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    return u16(b, at) | u16(b, at + 2) << 16


# --- pages -----------------------------------------------------------------------------------------------------------


def page_layout(raw: bytes, loose: bool = True) -> tuple[int, int] | None:
    """(page size, offset of the size-and-version word) by looking for a page header that makes sense."""
    for at in (18, *(x for x in range(8, 128 if loose else 64, 2) if x != 18)):
        if at + 2 > len(raw):
            break
        word = int.from_bytes(raw[at : at + 2], "little")
        size, version = word & 0xFF00, word & 0xFF
        lower, upper, special = (int.from_bytes(raw[at - k : at - k + 2], "little") for k in (6, 4, 2))
        end = 24 if at == 18 else -(-(at + 2) // 4) * 4
        if version in (4, 5) and size in PAGE_SIZES and end <= lower <= upper <= special <= size:
            return size, at
    return None


def header_end(psv_offset: int) -> int:
    return 24 if psv_offset == 18 else -(-(psv_offset + 2) // 4) * 4


@dataclass
class Pages:
    """Headers of the pages in a buffer. valid: the page can be read; zero: it was never written."""

    valid: np.ndarray
    zero: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    special: np.ndarray


def read_pages(b: np.ndarray, size: int, psv_offset: int = 18) -> Pages:
    n = len(b) // size
    base = np.arange(n) * size
    word = u16(b, base + psv_offset)
    lower, upper, special = (u16(b, base + psv_offset - k) for k in (6, 4, 2))
    end = header_end(psv_offset)
    valid = (word & 0xFF00 == size) & np.isin(word & 0xFF, (4, 5)) & (end <= lower) & (lower <= upper) & (upper <= special) & (special <= size)
    zero = ~b[: n * size].reshape(n, size)[:, :64].any(axis=1)
    return Pages(valid, zero, lower, upper, special)


# --- tuples ----------------------------------------------------------------------------------------------------------


@dataclass
class Tuples:
    """Tuple headers, one element each. start and end are places in the buffer."""

    start: np.ndarray
    end: np.ndarray
    page: np.ndarray
    lp: np.ndarray  # number of the line pointer; 0 for carved tuples
    xmin: np.ndarray
    xmax: np.ndarray
    cid: np.ndarray
    ctid_page: np.ndarray
    ctid_lp: np.ndarray
    infomask2: np.ndarray
    infomask: np.ndarray
    hoff: np.ndarray

    def take(self, o: np.ndarray) -> Tuples:
        return Tuples(*(getattr(self, x)[o] for x in self.__dataclass_fields__))

    def __len__(self) -> int:
        return len(self.start)


def headers(b: np.ndarray, start: np.ndarray, end: np.ndarray, page: np.ndarray, lp: np.ndarray) -> Tuples:
    ctid = u16(b, start + 12) << 16 | u16(b, start + 14)  # a block number is kept as two halves, the high one first
    return Tuples(start, end, page, lp, u32(b, start), u32(b, start + 4), u32(b, start + 8), ctid, u16(b, start + 16), u16(b, start + 18), u16(b, start + 20), b[start + 22].astype(np.int64))


def line_pointers(b: np.ndarray, pages: Pages, size: int, psv_offset: int = 18) -> tuple[np.ndarray, ...]:
    """Page, number, offset, flags (0 unused, 1 normal, 2 redirect, 3 dead) and length of every line pointer."""
    end = header_end(psv_offset)
    many = np.where(pages.valid, (pages.lower - end) // 4, 0)
    page = np.repeat(np.arange(len(many)), many)
    k = np.arange(len(page)) - np.repeat(np.cumsum(many) - many, many)
    word = u32(b, page * size + end + 4 * k)
    return page, k + 1, word & 0x7FFF, word >> 15 & 3, word >> 17


def item_tuples(b: np.ndarray, pages: Pages, size: int, psv_offset: int = 18) -> Tuples:
    """Tuples that normal line pointers lead to."""
    page, lp, offset, flags, length = line_pointers(b, pages, size, psv_offset)
    ok = (flags == 1) & (length >= 23) & (offset + length <= size)
    page, lp, offset, length = page[ok], lp[ok], offset[ok], length[ok]
    t = headers(b, page * size + offset, page * size + offset + length, page, lp)
    ok = (t.hoff >= 23) & (t.hoff <= length)
    return t if ok.all() else t.take(ok)


def consistent(t: Tuples, version: int = 16) -> np.ndarray:
    """Headers whose data offset is what their null bitmap (and, in old versions, object id) asks for."""
    bitmap = np.where(t.infomask & HASNULL, ((t.infomask2 & NATTS) + 7) // 8, 0)
    oid = np.where((t.infomask & HASOID_OLD != 0) & (version < 12), 4, 0)
    return ((23 + bitmap + oid + 7) // 8 * 8 == t.hoff) & (t.hoff >= 24) & (t.hoff <= 256)


def visibility(infomask: np.ndarray, xmax: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(aborted, deleted): the inserting transaction failed; the row is gone for a later one. Neither: it is live."""
    aborted = infomask & (XMIN_COMMITTED | XMIN_INVALID) == XMIN_INVALID
    kept = infomask & (XMAX_INVALID | LOCK_ONLY | IS_MULTI) != 0
    return aborted, ~aborted & ~kept & ((infomask & XMAX_COMMITTED != 0) | (xmax != 0))


# --- attributes ------------------------------------------------------------------------------------------------------


@dataclass
class Values:
    """One attribute of all tuples: where its payload is in the buffer; kind tells how to read it."""

    null: np.ndarray
    at: np.ndarray
    size: np.ndarray
    kind: np.ndarray | None = None  # of variable-length attributes: PLAIN, COMPRESSED, EXTERNAL


def walk(b: np.ndarray, t: Tuples, columns: tuple[Column, ...]) -> tuple[list[Values], np.ndarray, np.ndarray]:
    """Values of all physical columns, where the walk ended, and whether it had to stop early (the rest is null)."""
    n = len(t)
    base, end = t.start + t.hoff, t.end
    pos = base.copy()
    natts = t.infomask2 & NATTS
    has_nulls = t.infomask & HASNULL != 0
    stopped = np.zeros(n, bool)
    out: list[Values] = []
    last = max(len(b) - 1, 0)
    for i, c in enumerate(columns):
        place = np.minimum(t.start + 23 + i // 8, last)
        null = (natts <= i) | (has_nulls & (b[place] >> (i % 8) & 1 == 0) if n else np.zeros(0, bool)) | stopped
        if c.size > 0:
            p = base + (pos - base + c.alignment - 1) // c.alignment * c.alignment
            bad = ~null & (p + c.size > end)
            ok = ~null & ~bad
            out.append(Values(~ok, np.where(ok, p, 0), np.full(n, c.size)))
            pos = np.where(ok, p + c.size, pos)
        elif c.size == -2:
            size = np.zeros(n, np.int64)
            for k in np.flatnonzero(~null):
                stop = np.flatnonzero(b[pos[k] : end[k]] == 0)
                size[k] = stop[0] if len(stop) else -1
            bad = ~null & (size < 0)
            ok = ~null & ~bad
            out.append(Values(~ok, np.where(ok, pos, 0), size, np.zeros(n, np.int8)))
            pos = np.where(ok, pos + size + 1, pos)
        else:
            cut = ~null & (pos >= end)
            first = b[np.minimum(pos, last)]
            second = b[np.minimum(pos + 1, last)]
            short = first & 1 == 1
            external = (first == 1) & (second == 18)
            p = np.where(short, pos, base + (pos - base + c.alignment - 1) // c.alignment * c.alignment)
            room = p + 4 <= end
            word = u32(b, np.where(room, p, 0)) if n else np.zeros(0, np.int64)
            total = np.where(external, 18, np.where(short, first.astype(np.int64) >> 1, word >> 2))
            head = np.where(external, 2, np.where(short, 1, 4))
            bad = ~null & (cut | (total < head) | (p + total > end) | (~short & ~room))
            ok = ~null & ~bad
            kind = np.where(external, EXTERNAL, np.where(~short & (word & 3 == 2), COMPRESSED, PLAIN)).astype(np.int8)
            out.append(Values(~ok, np.where(ok, p + head, 0), np.where(ok, total - head, 0), kind))
            pos = np.where(ok, p + total, pos)
        stopped |= bad
    return out, pos, stopped


# --- carving ---------------------------------------------------------------------------------------------------------


def carve_tuples(b: np.ndarray, pages: Pages, size: int, columns: tuple[Column, ...], version: int = 16, psv_offset: int = 18, trust_pages: bool = False) -> Tuples:
    """Tuples found by their headers alone, where line pointers are lost. lp is 0; the offset tells the place.

    A place on a 4-byte step is one if it holds a header with the table's number of attributes, a plausible inserting
    transaction, hint bits, and a data offset that fits; the search goes on behind the tuple that was found."""
    n = len(pages.valid)
    found: list[np.ndarray] = []
    for k in range(n):
        if not pages.valid[k] and (trust_pages or pages.zero[k]):
            continue
        lo, hi = (int(pages.upper[k]), int(pages.special[k])) if pages.valid[k] else (header_end(psv_offset), size)
        at = np.arange(k * size + -(-lo // 4) * 4, k * size + hi - 23, 4)
        if not len(at):
            continue
        hoff = b[at + 22]
        at = at[(hoff >= 23) & (hoff % 8 == 0)]
        t = headers(b, at, np.full(len(at), k * size + hi), np.full(len(at), k), np.zeros(len(at), np.int64))
        natts = t.infomask2 & NATTS
        ok = (natts == len(columns)) & (natts >= 1) & (natts <= 1600) & (t.xmin > 0) & (t.xmin <= 0x7FFFFFFF) & (t.infomask & 0xFF00 != 0) & consistent(t, version)
        if not ok.any():
            continue
        t = t.take(ok)
        _, stop, broken = walk(b, t, columns)
        place = -1
        for i in np.flatnonzero(~broken):
            if t.start[i] >= place:
                found.append(np.array([t.start[i], stop[i], k]))
                place = t.start[i] + max(8, -(-int(stop[i] - t.start[i]) // 8) * 8)
    if not found:
        z = np.zeros(0, np.int64)
        return headers(b, z, z, z, z)
    start, end, page = np.array(found).T
    return headers(b, start, end, page, np.zeros(len(start), np.int64))
