"""Registered queries over the driver's tables: each table is written as relation files once, read by the engine, and
checked against the same rows in SQL. Flags, nulls and faults follow from keys by arithmetic, so that SQL can say them."""

from __future__ import annotations

import atexit
import os
import shutil
import struct
import sys
import tempfile
import uuid
from collections.abc import Callable
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .files import segments
from .functions import render
from .functions.decoders import decoder, decompressor
from .kernel.scan import IS_MULTI, LOCK_ONLY, XMIN_COMMITTED, XMIN_INVALID
from .layout import CATALOGS, OID, TYPES, Column, Table, catalog_table
from .operators import export, visibility
from .operators import toast as toast_join
from .plans import catalog as catalogs
from .plans import discovery
from .testing import encoder as enc
from .testing.spread import PER, rewritten, spread, tuples_of

Query = Callable[[SparkSession, str], DataFrame]
ABORTED, PLAIN = XMIN_INVALID, XMIN_COMMITTED


def col(name: str, kind: str, **more) -> Column:
    return Column(name, OID[kind], **more)


def relation(name: str, spec: str, **more) -> Table:
    return Table(name, tuple(col(*x.split(":"), attnum=i + 1) for i, x in enumerate(spec.split())), **more)


LINEITEM = relation("lineitem", "l_orderkey:int8 l_partkey:int8 l_suppkey:int8 l_linenumber:int4 l_quantity:float8 l_extendedprice:float8 l_discount:float8 l_tax:float8 l_returnflag:text l_linestatus:text l_shipdate:timestamp")
ORDERS = relation("orders", "o_orderkey:int8 o_custkey:int8 o_orderstatus:text o_totalprice:float8 o_orderdate:timestamp o_orderpriority:text")
DOCUMENTS = relation("documents", "doc_id:int8 text:text lang:varchar")


# --- files -----------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """Of the encoded relations: the shared folder, or a temporary one in local mode."""
    own = sys.__dict__.setdefault("_tuplequarry_files", {})
    if "folder" not in own:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        base = shared.removeprefix("file://").removeprefix("file:") if shared and shared.startswith(("file:", "/")) else tempfile.gettempdir()
        own["folder"] = f"{base}/tuplequarry-heap-{uuid.uuid4().hex}"
        os.makedirs(own["folder"], exist_ok=True)
        atexit.register(shutil.rmtree, own["folder"], True)
    return own["folder"]


def rows_of(spark: SparkSession, sf_dir: str, table: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def written(spark: SparkSession, sf_dir: str, key: str, write: Callable[[str], None]) -> str:
    """The path of a file that write made, once for each input and key."""
    own = sys.__dict__.setdefault("_tuplequarry_files", {})
    path = own.get((sf_dir, key))
    if path is None or not os.path.exists(path):
        path = f"{_folder(spark)}/{len(own)}/{key}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        write(path)
        own[sf_dir, key] = path
    return path


def encoded(spark: SparkSession, sf_dir: str, table: Table, key: str | None = None, order: list[str] | None = None, source: str | None = None, change: Callable | None = None, flags: Callable | None = None, per: int = PER, exact: bool = False, **page) -> str:
    names = [c.name for c in table.columns]

    def write(path: str) -> None:
        rows = rows_of(spark, sf_dir, source or table.name, names)
        spread(rows, order or names[:1], tuples_of(table.columns, change, flags), [(path, True, page)], per, exact)

    return written(spark, sf_dir, key or table.name, write)


# --- visibility ------------------------------------------------------------------------------------------------------


def state(key: int) -> dict:
    """Aborted, else deleted, else locked only, else of several transactions, else live; some of these frozen."""
    if key % 11 == 0:
        return {"infomask": ABORTED | 0x0800}
    if key % 7 == 0:
        return {"infomask": PLAIN | (0x0400 if key % 2 else 0), "xmax": 77}
    if key % 13 == 0:
        return {"infomask": PLAIN | LOCK_ONLY, "xmax": 78}
    if key % 17 == 0:
        return {"infomask": PLAIN | IS_MULTI, "xmax": 79}
    return {"infomask": (PLAIN | ABORTED if key % 19 == 0 else PLAIN) | 0x0800}


def flagged(spark: SparkSession, sf_dir: str) -> str:
    return encoded(spark, sf_dir, ORDERS, "orders_flags", flags=lambda r: state(r[0]))


LIVE_SQL = "o_orderkey % 11 <> 0 and o_orderkey % 7 <> 0"
DELETED_SQL = "o_orderkey % 11 <> 0 and o_orderkey % 7 = 0"
ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return keep


# --- scans -----------------------------------------------------------------------------------------------------------

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def lineitem(spark: SparkSession, sf_dir: str, key: str | None = None, **more) -> str:
    return encoded(spark, sf_dir, LINEITEM, key, LINE_ORDER, **more)


@query("select * from lineitem")
def heap_scan_lineitem(spark, sf_dir):
    return api.heap_table(spark, lineitem(spark, sf_dir), table=LINEITEM)


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def heap_pricing_summary(spark, sf_dir):
    df = api.heap_table(spark, lineitem(spark, sf_dir), table=LINEITEM, fields=["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"])
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    sums = (("l_quantity", "sum_qty"), ("l_extendedprice", "sum_price"))
    return df.where("l_shipdate <= timestamp_ntz '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(*(F.round(F.sum(a), 2).alias(b) for a, b in sums), F.round(F.sum(disc), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("select o.o_orderpriority, count(*) as n, round(sum(l.l_extendedprice), 2) as price from lineitem l join orders o on l.l_orderkey = o.o_orderkey where o.o_orderkey % 11 <> 0 and o.o_orderkey % 7 <> 0 group by 1")
def heap_join_orders(spark, sf_dir):
    lines = api.heap_table(spark, lineitem(spark, sf_dir), table=LINEITEM, fields=["l_orderkey", "l_extendedprice"])
    orders = api.heap_table(spark, flagged(spark, sf_dir), table=ORDERS, fields=["o_orderkey", "o_orderpriority"])
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then null else o_orderstatus end as o_orderstatus, case when o_orderkey % 5 = 0 then null else o_totalprice end as o_totalprice, case when o_orderkey % 4 = 0 then null else o_orderpriority end as o_orderpriority from orders")
def null_bitmap_orders(spark, sf_dir):
    drop = lambda r: (r[0], r[1], None if r[0] % 3 == 0 else r[2], None if r[0] % 5 == 0 else r[3], r[4], None if r[0] % 4 == 0 else r[5])
    path = encoded(spark, sf_dir, ORDERS, "orders_nulls", change=drop)
    return api.heap_table(spark, path, table=ORDERS, fields=["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])


@query(f"select {ORDER_COLUMNS} from orders where {LIVE_SQL}")
def rows_live(spark, sf_dir):
    return api.heap_table(spark, flagged(spark, sf_dir), table=ORDERS)


@query(f"select {ORDER_COLUMNS} from orders where {DELETED_SQL}")
def rows_deleted(spark, sf_dir):
    return api.heap_table(spark, flagged(spark, sf_dir), table=ORDERS, rows="deleted")


@query(f"select {ORDER_COLUMNS}, {DELETED_SQL} as _deleted from orders where o_orderkey % 11 <> 0")
def rows_all(spark, sf_dir):
    df = api.heap_table(spark, flagged(spark, sf_dir), table=ORDERS, rows="all", meta=True)
    return df.select(*[c.name for c in ORDERS.columns], "_deleted")


@query(f"select o_orderkey from orders where {DELETED_SQL}")
def filter_pushed_to_reader(spark, sf_dir):
    return api.heap_table(spark, flagged(spark, sf_dir), table=ORDERS, rows="all", meta=True, fields=["o_orderkey"]).where("_deleted = true").select("o_orderkey")


@query("select o_orderkey, o_orderkey % 11 = 0 as aborted, o_orderkey % 11 <> 0 and o_orderkey % 7 = 0 as deleted, o_orderkey % 11 <> 0 and o_orderkey % 7 <> 0 as live from orders where o_orderkey % 11 <> 0")
def visibility_expressions(spark, sf_dir):
    df = api.heap_table(spark, flagged(spark, sf_dir), table=ORDERS, rows="all", meta=True, fields=["o_orderkey"])
    return df.select("o_orderkey", visibility.is_aborted().alias("aborted"), visibility.is_deleted().alias("deleted"), visibility.is_live().alias("live"))


@query("select o_orderkey from orders where o_orderkey % 13 = 0 and o_orderkey % 11 <> 0 and o_orderkey % 7 <> 0")
def lock_only_is_live(spark, sf_dir):
    return api.heap_table(spark, flagged(spark, sf_dir), table=ORDERS, meta=True).where(F.col("_infomask").bitwiseAND(LOCK_ONLY) != 0).select("o_orderkey")


@query("select o_orderkey from orders where o_orderkey % 17 = 0 and o_orderkey % 13 <> 0 and o_orderkey % 11 <> 0 and o_orderkey % 7 <> 0")
def multixact_is_live(spark, sf_dir):
    return api.heap_table(spark, flagged(spark, sf_dir), table=ORDERS, meta=True).where(F.col("_infomask").bitwiseAND(IS_MULTI) != 0).select("o_orderkey")


@query("select o_orderkey from orders where o_orderkey % 19 = 0 and o_orderkey % 17 <> 0 and o_orderkey % 13 <> 0 and o_orderkey % 11 <> 0 and o_orderkey % 7 <> 0")
def frozen_is_live(spark, sf_dir):
    return api.heap_table(spark, flagged(spark, sf_dir), table=ORDERS, meta=True).where(F.col("_infomask").bitwiseAND(0x300) == 0x300).select("o_orderkey")


def _count(rows: str) -> Query:
    return lambda spark, sf_dir: api.heap_table(spark, flagged(spark, sf_dir), table=ORDERS, rows=rows, fields=[], meta=True).agg(F.count("*").alias("n"))


query(f"select count(*) as n from orders where {LIVE_SQL}", "count_live")(_count("live"))
query(f"select count(*) as n from orders where {DELETED_SQL}", "count_deleted")(_count("deleted"))
query("select count(*) as n from orders where o_orderkey % 11 <> 0", "count_all")(_count("all"))
query(f"select {ORDER_COLUMNS} from orders where o_orderkey % 11 <> 0 and not ({LIVE_SQL})", "all_except_live")(
    lambda spark, sf_dir: api.heap_table(spark, flagged(spark, sf_dir), table=ORDERS, rows="all").exceptAll(api.heap_table(spark, flagged(spark, sf_dir), table=ORDERS))
)


@query("select o_orderkey, o_orderdate, o_orderpriority from orders")
def project_fields(spark, sf_dir):
    return api.heap_table(spark, encoded(spark, sf_dir, ORDERS), table=ORDERS, fields=["o_orderpriority", "o_orderdate", "o_orderkey"])


@query("select o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority from orders")
def dropped_column(spark, sf_dir):
    t = Table("orders", tuple(Column("........pg.dropped.3........", 0, -1, 3, dropped=True, align="i") if c.name == "o_orderstatus" else c for c in ORDERS.columns))
    return api.heap_table(spark, encoded(spark, sf_dir, ORDERS), table=t)


@query("select o_orderkey, o_custkey, case when o_orderkey % 3 = 0 then null else o_orderstatus end as o_orderstatus, case when o_orderkey % 3 = 0 then null else o_totalprice end as o_totalprice from orders")
def short_tuples(spark, sf_dir):
    path = encoded(spark, sf_dir, ORDERS, "orders_short", flags=lambda r: {"natts": 2} if r[0] % 3 == 0 else {})
    return api.heap_table(spark, path, table=ORDERS).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 137")
def limit_physical_order(spark, sf_dir):
    df = api.heap_table(spark, encoded(spark, sf_dir, ORDERS), table=ORDERS, meta=True, fields=["o_orderkey", "o_totalprice"])
    return visibility.in_physical_order(df).limit(137).select("o_orderkey", "o_totalprice")


for _size in (16384, 32768):
    query("select * from lineitem", f"page_{_size // 1024}k")(lambda spark, sf_dir, n=_size: api.heap_table(spark, lineitem(spark, sf_dir, f"lineitem_{n}", size=n), table=LINEITEM))


@query("select * from lineitem")
def segments_continue(spark, sf_dir):
    return api.heap_table(spark, lineitem(spark, sf_dir, "lineitem_segments", segment_pages=17), table=LINEITEM)


@query("select * from lineitem")
def fork_page_version(spark, sf_dir):
    return api.heap_table(spark, lineitem(spark, sf_dir, "lineitem_v5", version=5, special=16), table=LINEITEM, pages_per_partition=64)


def _damaged(spark: SparkSession, sf_dir: str, wipe: Callable[[bytearray, int], None], key: str, table: Table = ORDERS) -> str:
    whole = encoded(spark, sf_dir, table)

    return written(spark, sf_dir, key, lambda path: rewritten(spark, whole, path, wipe))


def _every_fifth(page: bytearray, k: int) -> None:
    if k % 5 == 4:
        page[0:24] = bytes(24) if k % 2 else b"\xff" * 24


@query()
def bad_page_skip(spark, sf_dir):
    """Rows of undamaged pages. Tests compare them with the whole relation's rows of the same pages."""
    return api.heap_table(spark, _damaged(spark, sf_dir, _every_fifth, "orders_bad"), table=ORDERS, meta=True).select("o_orderkey", "o_totalprice", "_page")


@query()
def bad_page_list(spark, sf_dir):
    return api.page_report(spark, _damaged(spark, sf_dir, _every_fifth, "orders_bad")).where("not valid").select("page", "zero")


# Rows of one size: 24 bytes of header, 40 of values and 4 of line pointer make 120 a page of 8,168.
FIXED = relation("lineitem_fixed", "l_orderkey:int8 l_partkey:int8 l_suppkey:int8 l_quantity:float8 l_tax:float8")
_FIXED_SQL = "select l_orderkey, l_partkey, l_suppkey, l_quantity, l_tax, (row_number() over (order by l_orderkey, l_partkey, l_suppkey, l_quantity, l_tax) - 1) // 120 as page from lineitem"


def _fixed(spark: SparkSession, sf_dir: str) -> str:
    names = [c.name for c in FIXED.columns]
    encoded(spark, sf_dir, FIXED, order=names, source="lineitem", exact=True)
    return _damaged(spark, sf_dir, _every_fifth, "fixed_bad", FIXED)


@query(f"select * from ({_FIXED_SQL}) where page % 5 <> 4")
def bad_page_rows(spark, sf_dir):
    """As bad_page_skip, with rows of one size, so that SQL knows each row's page."""
    df = api.heap_table(spark, _fixed(spark, sf_dir), table=FIXED, meta=True)
    return df.select(*[c.name for c in FIXED.columns], F.col("_page").alias("page"))


@query(f"select distinct page from ({_FIXED_SQL}) where page % 5 = 4")
def bad_page_numbers(spark, sf_dir):
    return api.page_report(spark, _fixed(spark, sf_dir)).where("not valid").select("page")


@query(f"select count(*) filter (page % 5 <> 4) as pages_ok, count(*) filter (page % 5 = 4) as bad_pages, cast(sum(n) filter (page % 5 <> 4) as bigint) as items from (select page, count(*) as n from ({_FIXED_SQL}) group by page)")
def scan_counters(spark, sf_dir):
    path = _fixed(spark, sf_dir)
    pages = api.page_report(spark, path).agg(F.count_if("valid").alias("pages_ok"), F.count_if(~F.col("valid")).alias("bad_pages"))
    return pages.join(api.item_report(spark, path).where("lp_flags = 1").agg(F.count("*").alias("items")))


def _lose_pointers(page: bytearray, k: int) -> None:
    (lower,) = struct.unpack_from("<H", page, 12)
    page[24:lower] = bytes(lower - 24)
    struct.pack_into("<H", page, 12, 24)


@query("select * from orders")
def carve_scan(spark, sf_dir):
    return api.heap_table(spark, _damaged(spark, sf_dir, _lose_pointers, "orders_carve"), table=ORDERS, scan="carve")


@query("select * from orders")
def carve_auto(spark, sf_dir):
    return api.heap_table(spark, _damaged(spark, sf_dir, _lose_pointers, "orders_carve"), table=ORDERS, scan="auto")


@query("select * from orders")
def carve_auto_format(spark, sf_dir):
    """The data source itself falls back to carving."""
    from .sources.pgheap import ensure_registered

    path = _damaged(spark, sf_dir, _lose_pointers, "orders_carve")
    return ensure_registered(spark).read.format("pgheap").option("path", path).option("columns", ORDERS.to_json()).option("scan", "auto").load()


@query("select * from orders")
def carve_mixed_pages(spark, sf_dir):
    """Every third page has lost its line pointers; the others are read by theirs."""
    path = _damaged(spark, sf_dir, lambda page, k: _lose_pointers(page, k) if k % 3 == 1 else None, "orders_mixed")
    return api.heap_table(spark, path, table=ORDERS, scan="auto")


@query("select (select count(*) from orders) as n, 1 as flags")
def item_pointers(spark, sf_dir):
    return api.item_report(spark, encoded(spark, sf_dir, ORDERS)).where("lp_flags = 1").agg(F.count("*").alias("n"), F.max("lp_flags").cast("int").alias("flags"))


@query("select * from orders")
def stream_pages(spark, sf_dir):
    """All pages but the last come as a stream; the last, which may still grow, by a batch read."""
    path = encoded(spark, sf_dir, ORDERS)
    out = f"{_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = api.stream_table(spark, path, table=ORDERS)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"file://{out}/state").outputMode("append").start(f"file://{out}/rows")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    last = sum(size for _, size in segments(path)) // 8192 - 1
    rest = api.heap_table(spark, path, table=ORDERS, meta=True).where(f"_page >= {last}").select(*[c.name for c in ORDERS.columns])
    return spark.read.schema(stream.schema).parquet(f"file://{out}/rows").union(rest)


# --- out of line -----------------------------------------------------------------------------------------------------


TEXTS = 4096  # of the documents, in a file


def _chunks(value: int, data: bytes, first: int = 0, block: int = 0, skip: Callable | None = None):
    """A value's chunks as tuples of the storage relation."""
    return ((block, 1, first + k, raw) for k, raw in enc.chunk_tuples(value, data, skip=skip))


def _with_storage(spark: SparkSession, sf_dir: str, columns: str, make: Callable, path: str, store: str, blocks: int = 1, **page) -> None:
    """The documents as a relation (0) and its storage relation (1)."""
    spread(rows_of(spark, sf_dir, "documents", columns.split()), ["doc_id"], make, [(path, True, page), (store, False, {})], TEXTS, blocks=blocks)


def _toasted(spark: SparkSession, sf_dir: str, method: str | None, faults: bool = False) -> tuple[str, str]:
    kind = f"{method or 'plain'}{'_faults' if faults else ''}"
    skip = (lambda v, k: k == 1 and (v - 100_000) % 9 == 0) if faults else None

    def make(row: tuple):
        doc, text, lang = row
        raw = None if text is None else text.encode()
        if raw is None:
            value = None
        elif len(raw) > 1996:
            data = struct.pack("<I", len(raw) | (1 << 30 if method == "lz4" else 0)) + getattr(enc, method)(raw) if method else raw
            if method and len(data) >= len(raw):
                data = raw
            yield from _chunks(100_000 + doc, data, skip=skip)
            value = enc.Datum(enc.pointer(len(raw) + 4, len(data), 100_000 + doc, 90_001, 1 if method == "lz4" else 0))
        else:
            value = enc.Datum(enc.compressed(raw, method)) if method and len(raw) > 300 and doc % 2 else raw
        yield 0, 0, 0, enc.tuple_bytes(DOCUMENTS.columns, (doc, value, lang))

    path = written(spark, sf_dir, f"documents_{kind}", lambda path: _with_storage(spark, sf_dir, "doc_id text lang", make, path, path + ".toast"))
    return path, path + ".toast"


def _toast_query(method: str | None, joined: bool, faults: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, store = _toasted(spark, sf_dir, method, faults)
        return api.heap_table(spark, path, table=DOCUMENTS, toast=store, direct_toast_bytes=0 if joined else 1 << 30)

    return run


for _m in (None, "pglz", "lz4"):
    for _joined in (False, True):
        query("select doc_id, text, lang from documents", f"toast_{_m or 'plain'}{'_join' if _joined else ''}")(_toast_query(_m, _joined))
for _joined in (False, True):
    query("select doc_id, case when doc_id % 9 = 0 and strlen(text) > 1996 then null else text end as text, lang from documents", f"toast_missing{'_join' if _joined else ''}")(_toast_query(None, _joined, True))


FITS = 32_000  # bytes of a value that a page of 32 KB holds in its row


def _whole(spark: SparkSession, sf_dir: str, key: str, datum: Callable[[bytes], bytes], raw_of: Callable[[str], bytes] = str.encode) -> tuple[str, str]:
    """The documents with all of their texts: datum(raw) in its row where a page of 32 KB holds it, else out of line."""

    def make(row: tuple):
        doc, text, lang = row
        raw = None if text is None else raw_of(text)
        value = None if raw is None else datum(raw)
        if value is not None and len(value) > FITS:
            small = isinstance(value, enc.Datum)  # a compressed one's header goes, its size and method stay
            data = value[4:] if small else raw
            yield from _chunks(100_000 + doc, data)
            value = enc.Datum(enc.pointer(len(raw) + 4, len(data), 100_000 + doc, 90_001, int.from_bytes(data[:4], "little") >> 30 if small else 0))
        yield 0, 0, 0, enc.tuple_bytes(DOCUMENTS.columns, (doc, value, lang))

    path = written(spark, sf_dir, key, lambda path: _with_storage(spark, sf_dir, "doc_id text lang", make, path, path + ".toast", size=32_768))
    return path, path + ".toast"


def _inline(method: str) -> Query:
    """Every value compressed where that makes it smaller, in its row where it fits."""

    def datum(raw: bytes) -> bytes:
        small = enc.compressed(raw, method)
        return enc.Datum(small) if len(small) < len(raw) else raw

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, store = _whole(spark, sf_dir, f"documents_inline_{method}", datum)
        return api.heap_table(spark, path, table=DOCUMENTS, toast=store)

    return run


for _m in ("pglz", "lz4"):
    query("select doc_id, text, lang from documents", f"inline_compressed_{_m}")(_inline(_m))


MANY = relation("documents", "doc_id:int8 " + " ".join(f"t{k}:text" for k in range(20)))


@query("select doc_id, " + ", ".join(f"case when doc_id % 5 <> {k % 5} then text || '{k}' end as t{k}" for k in range(20)) + " from documents")
def toast_many_columns_join(spark, sf_dir):
    """Twenty columns of variable length, values out of line in all of them, and rows of nulls and short values between."""

    def make(row: tuple):
        doc, text = row
        out: list = [doc]
        place = 0
        for k in range(20):
            raw = None if text is None or doc % 5 == k % 5 else f"{text}{k}".encode()
            if raw is not None and len(raw) > 300:
                for x in _chunks(20 * doc + k + 1, raw, place):
                    yield x
                    place = x[2] + 1
                raw = enc.Datum(enc.pointer(len(raw) + 4, len(raw), 20 * doc + k + 1, 90_001, 0))
            out.append(raw)
        yield 0, 0, 0, enc.tuple_bytes(MANY.columns, tuple(out))

    path = written(spark, sf_dir, "documents_many", lambda path: _with_storage(spark, sf_dir, "doc_id text", make, path, path + ".toast"))
    return api.heap_table(spark, path, table=MANY, toast=path + ".toast", direct_toast_bytes=0)


@query("select doc_id, text, lang from documents union all select doc_id + 1000000000 * (k + 1) as doc_id, 'x' as text, 'en' as lang from documents cross join range(10) r(k)")
def toast_found(spark, sf_dir):
    """Neither catalog nor caller names the storage relation, and the first pages hold no pointer."""

    def make(row: tuple):
        doc, text, lang = row
        for k in range(10):
            yield k, 0, 0, enc.tuple_bytes(DOCUMENTS.columns, (doc + 1_000_000_000 * (k + 1), "x", "en"))
        raw = None if text is None else text.encode()
        if raw is not None and len(raw) > 1996:
            yield from _chunks(100_000 + doc, raw, block=10)
            raw = enc.Datum(enc.pointer(len(raw) + 4, len(raw), 100_000 + doc, 90_001, 0))
        yield 10, 0, 0, enc.tuple_bytes(DOCUMENTS.columns, (doc, raw, lang))

    def write(path: str) -> None:
        os.makedirs(path, exist_ok=True)
        _with_storage(spark, sf_dir, "doc_id text lang", make, f"{path}/24576", f"{path}/90001", blocks=11)

    return api.heap_table(spark, written(spark, sf_dir, "documents_found", write) + "/24576", table=DOCUMENTS)


@query("select doc_id, case when doc_id % 9 = 0 and strlen(text) > 1996 then 'text:TOAST_MISSING' end as status from documents")
def toast_status(spark, sf_dir):
    path, store = _toasted(spark, sf_dir, None, True)
    return api.heap_table(spark, path, table=DOCUMENTS, toast=store, meta=True).select("doc_id", F.col("_decode_status").alias("status"))


@query("select 100000 + doc_id as valueid, cast(ceil(strlen(text) / 1996.0) as bigint) as n, strlen(text) as bytes from documents where strlen(text) > 1996")
def toast_chunks(spark, sf_dir):
    _, store = _toasted(spark, sf_dir, None)
    return toast_join.chunks(spark, store).groupBy(F.col("chunk_id").alias("valueid")).agg(F.count("*").alias("n"), F.sum(F.octet_length("chunk_data")).alias("bytes"))


# --- decoders: values derived from orders, in text and typed form ----------------------------------------------------


def typed(key: str, kind: str, make: Callable, sql: str, typmod: int = -1, select: Callable | None = None, mode: str = "typed", source: str = "orders", names: tuple[str, ...] = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), **table) -> None:
    """Query dec_<key>: a column v of the type, made from rows of source by make(row), next to the key column."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Table(key, (col(names[0], "int8"), col("v", kind, typmod=typmod)), **table)

        def write(path: str) -> None:
            spread(rows_of(spark, sf_dir, source, list(names)), [names[0]], tuples_of(t.columns, lambda r: (r[0], make(r))), [(path, True, {})])

        path = written(spark, sf_dir, f"dec_{key}", write)
        df = api.heap_table(spark, path, table=t, mode=mode)
        if mode == "text":
            df = df.withColumn(names[0], F.col(names[0]).cast("long"))
        return select(df) if select else df

    query(f"select {names[0]}, {sql} as v from {source}", f"dec_{key}")(run)


def _uuid(k: int) -> bytes:
    return k.to_bytes(16, "big")


_f8 = lambda *x: struct.pack(f"<{len(x)}d", *x)
_v = lambda f: lambda df: df.withColumn("v", f(F.col("v")))
_k = "o_orderkey"
typed("bool", "bool", lambda r: r[0] % 2 == 0, f"{_k} % 2 = 0")
typed("int2", "int2", lambda r: r[0] % 30000 - 15000, f"cast({_k} % 30000 - 15000 as smallint)")
typed("int4", "int4", lambda r: r[0] * 7 - 100, f"cast({_k} * 7 - 100 as integer)")
typed("int8", "int8", lambda r: r[0] * 10**12, f"{_k} * 1000000000000")
typed("oid", "oid", lambda r: 4294967295 - r[0], f"4294967295 - {_k}")
typed("float4", "float4", lambda r: r[0] / 4, f"cast({_k} / 4.0 as float)")
typed("float8", "float8", lambda r: r[2], "o_totalprice")
typed("numeric", "numeric", lambda r: Decimal(r[0] * 12345) / 10**4, f"cast({_k} * 12345 as decimal(20,4)) / 10000", select=lambda df: df.withColumn("v", F.col("v").cast("double")), typmod=(20 << 16 | 4) + 4)
typed("numeric_text", "numeric", lambda r: Decimal(r[0]).scaleb(-2) if r[0] % 5 else Decimal("NaN"), f"case when {_k} % 5 = 0 then 'NaN' else cast(cast({_k} as decimal(18,2)) / 100 as decimal(18,2))::varchar end")
typed("money", "money", lambda r: r[0] - 500, f"cast(cast({_k} - 500 as decimal(19,2)) / 100 as decimal(19,2))")
typed("money_text", "money", lambda r: r[0] - 500, f"cast(cast(cast({_k} - 500 as decimal(19,2)) / 100 as decimal(19,2)) as varchar)", mode="text")
typed("date", "date", lambda r: r[0] % 20000 - 5000, f"cast(date '2000-01-01' + cast({_k} % 20000 - 5000 as integer) as date)")
typed("date_infinity", "date", lambda r: 2**31 - 1 if r[0] % 4 == 0 else r[0] % 1000, f"case when {_k} % 4 = 0 then 'infinity' else strftime(date '2000-01-01' + cast({_k} % 1000 as integer), '%Y-%m-%d') end", mode="text")
typed("timestamp", "timestamp", lambda r: r[3], "o_orderdate")
typed("timestamp_us", "timestamp", lambda r: r[1], "ts", source="events", names=("event_id", "ts"))
typed("timestamp_text", "timestamp", lambda r: r[0] * 1_000_000 + (123456 if r[0] % 2 else 0), f"strftime(timestamp '2000-01-01' + to_seconds({_k}), '%Y-%m-%d %H:%M:%S') || case when {_k} % 2 = 1 then '.123456' else '' end", mode="text")
typed("timestamptz_text", "timestamptz", lambda r: r[0] * 1_000_000, f"strftime(timestamp '2000-01-01' + to_seconds({_k}), '%Y-%m-%d %H:%M:%S') || '+00'", mode="text")
typed("time", "time", lambda r: r[0] % 86400 * 1_000_000, f"strftime(timestamp '2000-01-01' + to_seconds({_k} % 86400), '%H:%M:%S')", select=_v(render.clock))
typed("time_text", "time", lambda r: r[0] % 86400 * 1_000_000 + 500_000, f"strftime(timestamp '2000-01-01' + to_seconds({_k} % 86400), '%H:%M:%S') || '.5'", mode="text")
typed("timetz", "timetz", lambda r: struct.pack("<qi", r[0] % 86400 * 1_000_000, (r[0] % 3 - 1) * 19800), f"strftime(timestamp '2000-01-01' + to_seconds({_k} % 86400), '%H:%M:%S') || case {_k} % 3 when 0 then '+05:30' when 1 then '+00:00' else '-05:30' end", select=_v(render.timetz))
typed("timetz_text", "timetz", lambda r: struct.pack("<qi", r[0] % 86400 * 1_000_000, (r[0] % 3 - 1) * 19800), f"strftime(timestamp '2000-01-01' + to_seconds({_k} % 86400), '%H:%M:%S') || case {_k} % 3 when 0 then '+05:30' when 1 then '+00:00' else '-05:30' end", mode="text")
_interval_sql = f"concat_ws(' ', case when {_k} % 5 > 0 then ({_k} % 5) || case when {_k} % 5 = 1 then ' year' else ' years' end end, case when {_k} % 12 > 0 then ({_k} % 12) || case when {_k} % 12 = 1 then ' mon' else ' mons' end end, case when {_k} % 7 > 0 then ({_k} % 7) || case when {_k} % 7 = 1 then ' day' else ' days' end end, case when {_k} % 60 > 0 or ({_k} % 5 = 0 and {_k} % 12 = 0 and {_k} % 7 = 0) then '00:00:' || lpad(({_k} % 60)::varchar, 2, '0') end)"
_interval = lambda r: struct.pack("<qii", r[0] % 60 * 1_000_000, r[0] % 7, r[0] % 5 * 12 + r[0] % 12)
typed("interval", "interval", _interval, _interval_sql, select=_v(render.interval))
typed("interval_text", "interval", _interval, _interval_sql, mode="text")
_uuid_sql = f"lpad(lower(to_hex({_k})), 32, '0')"
_uuid_sql = f"substr({_uuid_sql},1,8)||'-'||substr({_uuid_sql},9,4)||'-'||substr({_uuid_sql},13,4)||'-'||substr({_uuid_sql},17,4)||'-'||substr({_uuid_sql},21,12)"
typed("uuid", "uuid", lambda r: _uuid(r[0]), _uuid_sql)
typed("bytea", "bytea", lambda r: r[0].to_bytes(8, "big"), f"'\\x' || lpad(lower(to_hex({_k})), 16, '0')", select=_v(render.bytea))
typed("bytea_text", "bytea", lambda r: r[0].to_bytes(8, "big"), f"'\\x' || lpad(lower(to_hex({_k})), 16, '0')", mode="text")
_v4 = f"'10.' || ({_k} // 65536 % 256) || '.' || ({_k} // 256 % 256) || '.' || ({_k} % 256)"
typed("inet", "inet", lambda r: bytes([2, 32 if r[0] % 2 else 24, 10]) + (r[0] % 2**24).to_bytes(3, "big"), f"{_v4} || case when {_k} % 2 = 0 then '/24' else '' end")
typed("cidr", "cidr", lambda r: bytes([2, 32, 10]) + (r[0] % 2**24).to_bytes(3, "big"), f"{_v4} || '/32'")
typed("inet6", "inet", lambda r: bytes([3, 128]) + bytes(12) + r[0].to_bytes(4, "big"), f"'0:0:0:0:0:0:' || lower(to_hex({_k} // 65536)) || ':' || lower(to_hex({_k} % 65536))")
_hex = lambda n: "||':'||".join(f"substr(lpad(lower(to_hex({_k})), {2 * n}, '0'), {2 * i + 1}, 2)" for i in range(n))
typed("macaddr", "macaddr", lambda r: r[0].to_bytes(6, "big"), _hex(6))
typed("macaddr8", "macaddr8", lambda r: r[0].to_bytes(8, "big"), _hex(8))
typed("bit", "bit", lambda r: struct.pack("<i", 12) + (r[0] % 4096 << 4).to_bytes(2, "big"), f"right(lpad(bin({_k} % 4096), 12, '0'), 12)")
typed("varbit", "varbit", lambda r: struct.pack("<i", 9) + (r[0] % 512 << 7).to_bytes(2, "big"), f"right(lpad(bin({_k} % 512), 9, '0'), 9)")
typed("point", "point", lambda r: _f8(r[0], r[0] + 0.5), f"'(' || {_k} || '.0,' || {_k} || '.5)'", mode="text")
typed("point_typed", "point", lambda r: _f8(r[0], r[0] + 0.5), f"{_k} + ({_k} + 0.5)::double", select=lambda df: df.withColumn("v", F.col("v.x") + F.col("v.y")))
typed("lseg", "lseg", lambda r: _f8(r[0], 1, 2, 3), f"'[(' || {_k} || '.0,1.0),(2.0,3.0)]'", mode="text")
typed("box", "box", lambda r: _f8(r[0], 1, 2, 3), f"'(' || {_k} || '.0,1.0),(2.0,3.0)'", mode="text")
typed("line", "line", lambda r: _f8(r[0], 1, 2), "'{' || " + _k + " || '.0,1.0,2.0}'", mode="text")
typed("circle", "circle", lambda r: _f8(r[0], 1, 2), f"'<(' || {_k} || '.0,1.0),2.0>'", mode="text")
typed("path", "path", lambda r: struct.pack("<iii", 2, r[0] % 2, 0) + _f8(r[0], 1, 2, 3), f"case when {_k} % 2 = 1 then '((' || {_k} || '.0,1.0),(2.0,3.0))' else '[(' || {_k} || '.0,1.0),(2.0,3.0)]' end", mode="text")
typed("polygon", "polygon", lambda r: struct.pack("<i", 2) + _f8(0, 0, 0, 0) + _f8(r[0], 1, 2, 3), f"'((' || {_k} || '.0,1.0),(2.0,3.0))'", mode="text")
typed("tid", "tid", lambda r: struct.pack("<3H", 1, r[0] % 65536, r[0] % 100), f"'(' || (65536 + {_k} % 65536) || ',' || ({_k} % 100) || ')'", mode="text")
typed("oidvector", "oidvector", lambda r: struct.pack("<iiIii", 1, 0, 26, 2, 0) + struct.pack("<2I", r[0], 7), f"{_k} || ' 7'", select=_v(render.vector))
typed("int2vector", "int2vector", lambda r: struct.pack("<iiIii", 1, 0, 21, 2, 0) + struct.pack("<2h", r[0] % 1000, 3), f"({_k} % 1000) || ' 3'", mode="text")
typed("aclitem", "aclitem", lambda r: struct.pack("<3I", 10, 0 if r[0] % 2 else 16384, r[0] % 32768), "case when " + _k + " % 2 = 0 then 'oid:16384' else '' end || '=' || " + " || ".join(f"case when {_k} % 32768 // {1 << i} % 2 = 1 then '{c}' else '' end" for i, c in enumerate("arwdDxtXUCTcsAm")) + " || '/oid:10'", mode="text")
typed("name", "name", lambda r: f"n{r[0]}", f"'n' || {_k}")
typed("char", "char", lambda r: chr(97 + r[0] % 26), f"chr(cast(97 + {_k} % 26 as integer))")
typed("xml", "xml", lambda r: f"<a>{r[0]}</a>", f"'<a>' || {_k} || '</a>'")
typed("int16", "int16", lambda r: (-r[0] * 10**20).to_bytes(16, "little", signed=True), f"cast(-{_k}::hugeint * 100000000000000000000::hugeint as varchar)", mode="text")
typed("array_int_null", "_int4", lambda r: [r[0], None, 3], "'{' || " + _k + " || ',NULL,3}'", mode="text")
typed("array_2d", "_int4", lambda r: [[r[0], 2], [3, 4]], "'{{' || " + _k + " || ',2},{3,4}}'", mode="text")
typed("array_text_quoted", "_text", lambda r: ["a,b", 'x"y', "", "NULL", f"k{r[0]}", None], "'{\"a,b\",\"x\\\"y\",\"\",\"NULL\",k' || " + _k + " || ',NULL}'", mode="text")
typed("array_text_native", "_text", lambda r: ["a,b", 'x"y', "", f"k{r[0]}", None], "'{\"a,b\",\"x\\\"y\",\"\",k' || " + _k + " || ',NULL}'", select=_v(render.array))
typed("array_numeric", "_numeric", lambda r: [Decimal(r[0]), Decimal("0.50")], "'{' || " + _k + " || ',0.50}'", mode="text")
typed("array_sum", "_int8", lambda r: [r[0], 5, None], f"{_k} + 5", select=_v(lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))))
typed("jsonb", "jsonb", lambda r: enc.parse_json(r[1]), "props", source="events", names=("event_id", "props"))
typed("jsonb_nested", "jsonb", lambda r: {"k": r[0], "a": [True, None, {"x": "é"}], "n": Decimal("2.50")}, "'{\"k\": ' || " + _k + " || ', \"a\": [true, null, {\"x\": \"é\"}], \"n\": 2.50}'")
typed("json_text", "json", lambda r: '{"b":1,  "a":%d}' % r[0], "'{\"b\":1,  \"a\":' || " + _k + " || '}'")
typed("text_2d_bounds", "_int4", lambda r: enc.array([r[0], 2], 23, low=[0]), "'[0:1]={' || " + _k + " || ',2}'", mode="text")


@query("select vec_id, round(list_sum(embedding::double[]), 4) as total, len(embedding) as n from embeddings")
def dec_array_float(spark, sf_dir):
    t = relation("embeddings", "vec_id:int8 embedding:_float4")
    df = api.heap_table(spark, encoded(spark, sf_dir, t), table=t)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return df.select("vec_id", F.round(total, 4).alias("total"), F.size("embedding").cast("long").alias("n"))




@query("select event_id, event_type from events")
def enum_decode(spark, sf_dir):
    names = sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct().collect())
    members = {80_000 + i: x for i, x in enumerate(names)}
    number = {x: k for k, x in members.items()}
    t = Table("events", (col("event_id", "int8"), Column("event_type", 79_999, 4, 2, align="i")), enums={79_999: members}, type_names={79_999: "mood"})
    change = lambda r: (r[0], struct.pack("<I", number[r[1]]))
    return api.heap_table(spark, encoded(spark, sf_dir, t, "events_enum", source="events", change=change), table=t)


def _in_encoding(codec: str) -> Query:
    """A text with a character that the encoding lacks is an error: no relation of that encoding can hold it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, store = _whole(spark, sf_dir, f"documents_{codec}", lambda raw: raw, lambda text: text.encode(codec))
        return api.heap_table(spark, path, table=DOCUMENTS, encoding=codec, toast=store)

    return run


query("select doc_id, text, lang from documents", "encoding_latin1")(_in_encoding("latin-1"))


@query("select conv_id, turn, text from conversations")
def encoding_gb18030(spark, sf_dir):
    t = relation("conversations", "conv_id:int8 turn:int8 text:text")
    path = encoded(spark, sf_dir, t, "conversations_gb", order=["conv_id", "turn", "text"], change=lambda r: (r[0], r[1], r[2].encode("gb18030")), per=4 * TEXTS)
    return api.heap_table(spark, path, table=t, encoding="gb18030")


# --- statements, CSV, DDL --------------------------------------------------------------------------------------------

PAGES = relation("pages", "page_id:int8 url:text html:text")


def _pages(spark: SparkSession, sf_dir: str) -> str:
    make = lambda r: (r[0], None if r[0] % 5 == 0 else r[1], ["it's", "a\\b", "tab\tend", "line\nbreak", 'say "x"', "\\N", "", "bell\x07", "plain, text", "ünï"][r[0] % 10])
    return encoded(spark, sf_dir, PAGES, "pages_text", change=make, per=4 * TEXTS)


_HTML = "case page_id % 10 when 0 then 'it''s' when 1 then 'a\\b' when 2 then 'tab' || chr(9) || 'end' when 3 then 'line' || chr(10) || 'break' when 4 then 'say \"x\"' when 5 then '\\N' when 6 then '' when 7 then 'bell' || chr(7) when 8 then 'plain, text' else 'ünï' end"
_LITERAL = "case page_id % 10 when 0 then 'E''it''''s''' when 1 then 'E''a\\\\b''' when 2 then 'E''tab\\tend''' when 3 then 'E''line\\nbreak''' when 4 then '''say \"x\"''' when 5 then 'E''\\\\N''' when 6 then '''''' when 7 then 'E''bell\\x07''' when 8 then '''plain, text''' else '''ünï''' end"
_URL = "case when page_id % 5 = 0 then 'NULL' else '''' || url || '''' end"
_CSV = "case page_id % 10 when 3 then '\"line' || chr(10) || 'break\"' when 4 then '\"say \"\"x\"\"\"' when 5 then '\"\\N\"' when 8 then '\"plain, text\"' else " + _HTML + " end"


@query(f"select 'INSERT INTO \"public\".\"pages\" (\"page_id\", \"url\", \"html\") VALUES (' || page_id || ', ' || {_URL} || ', ' || {_LITERAL} || ');' as line from pages")
def fmt_insert(spark, sf_dir):
    return api.inserts(spark, _pages(spark, sf_dir), table=PAGES).select("line")


@query(f"select 'REPLACE INTO \"public\".\"pages\" VALUES (' || page_id || ', ' || {_LITERAL} || ');' as line from pages")
def fmt_replace(spark, sf_dir):
    return api.inserts(spark, _pages(spark, sf_dir), table=PAGES, fields=["html", "page_id"], complete=False, replace_rows=True).select("line")


@query(f"select page_id || ',' || case when page_id % 5 = 0 then '\\N' else url end || ',' || {_CSV} as line from pages")
def fmt_csv(spark, sf_dir):
    return api.csv(spark, _pages(spark, sf_dir), table=PAGES).select("line")


@query("select 'page_id|url' as line union all select page_id || '|' || case when page_id % 5 = 0 then '\\N' else url end from pages")
def fmt_csv_header(spark, sf_dir):
    head = spark.createDataFrame([(export.csv_header(PAGES, ["page_id", "url"], "|"),)], "line string")
    return head.union(api.csv(spark, _pages(spark, sf_dir), table=PAGES, fields=["page_id", "url"], delimiter="|").select("line"))


@query(f"select page_id, {_LITERAL} as literal from pages")
def fmt_literal(spark, sf_dir):
    return api.heap_table(spark, _pages(spark, sf_dir), table=PAGES).select("page_id", render.sql_literal(F.col("html")).alias("literal"))


@query(f"select count(*) filter (where {DELETED_SQL}) as marked, count(*) as n from orders where o_orderkey % 11 <> 0")
def fmt_deleted_marks(spark, sf_dir):
    df = api.inserts(spark, flagged(spark, sf_dir), table=ORDERS, rows="all")
    return df.agg(F.count_if(F.col("line").rlike(r"^-- DELETED ctid=\(\d+, \d+\)\nINSERT ")).alias("marked"), F.count("*").alias("n"))


EVERY = Table(
    "every",
    (
        col("id", "int8", notnull=True), col("v", "varchar", typmod=24), col("c", "bpchar", typmod=14), col("n", "numeric", typmod=(12 << 16 | 2) + 4), col("b", "bit", typmod=8), col("vb", "varbit"),
        col("t", "time", typmod=3), col("tz", "timestamptz", typmod=0), col("a", "_varchar", typmod=9), Column("mood", 79_999, 4), Column("gone", 23, 4, dropped=True), Column('qu"ote', 99_999, -1),
    ),
    "app", primary_key=("id",), enums={79_999: {1: "sad", 2: "it's"}}, type_names={79_999: "mood"},
)
_DDL = """CREATE TYPE "mood" AS ENUM ('sad', 'it''s');
CREATE TABLE "app"."every" (
  "id" bigint NOT NULL,
  "v" character varying(20),
  "c" character(10),
  "n" numeric(12,2),
  "b" bit(8),
  "vb" bit varying,
  "t" time(3),
  "tz" timestamp(0) with time zone,
  "a" character varying(5)[],
  "mood" "mood",
  "qu""ote" oid:99999,
  PRIMARY KEY ("id")
);"""


@query("select '" + _DDL.replace("'", "''") + "' as ddl")
def ddl_table(spark, sf_dir):
    return spark.createDataFrame([(export.ddl(EVERY),)], "ddl string")


# --- catalogs --------------------------------------------------------------------------------------------------------

CATALOG_TABLES = (LINEITEM, ORDERS, DOCUMENTS, PAGES)
DB, BASE = 16_384, 24_576


def write_catalogs(root: str, version: int = 16, fork: bool = False, tables: tuple[Table, ...] = CATALOG_TABLES, lose: bool = False) -> str:
    """A data directory with the catalogs of some tables."""
    base = f"{root}/base/{DB}"
    os.makedirs(base, exist_ok=True)
    os.makedirs(f"{root}/global", exist_ok=True)
    with open(f"{root}/{'SYS_VERSION' if fork else 'PG_VERSION'}", "w") as f:
        f.write(f"{version}\n")

    def write(path: str, name: str, rows: list[dict]) -> None:
        t = catalog_table(name, version, fork)
        zero = {"name": "", "char": "", "float4": 0.0, "bool": False}

        def row(r: dict) -> tuple:
            return tuple(r.get(c.name, None if c.size < 0 else zero.get(TYPES[c.type_oid].name, 0)) for c in t.columns)

        w = enc.PageWriter(path)
        for r in rows:
            w.add(enc.tuple_bytes(t.columns, row(r), oid=r["oid"] if version < 12 and "oid" in r else None))
        w.close()
        if lose:
            with open(path, "rb") as f:
                data = bytearray(f.read())
            for k in range(0, len(data), 8192):
                page = data[k : k + 8192]
                _lose_pointers(page, 0)
                data[k : k + 8192] = page
            with open(path, "wb") as f:
                f.write(data)

    letter = {1: "c", 2: "s", 4: "i", 8: "d"}
    classes = [{"oid": BASE + i, "relname": t.name, "relnamespace": 2200, "relfilenode": 0 if i == 0 else BASE + 100 + i, "relkind": "r"} for i, t in enumerate(tables)]
    classes += [{"oid": CATALOGS[x], "relname": x, "relnamespace": 11, "relfilenode": 0, "relkind": "r"} for x in ("pg_class", "pg_attribute")]
    classes += [{"oid": BASE + 50, "relname": "orders_pkey", "relnamespace": 2200, "relfilenode": BASE + 150, "relkind": "i"}]
    attributes = [
        {"attrelid": BASE + i, "attname": c.name, "atttypid": c.type_oid, "attlen": c.size, "attnum": k + 1, "atttypmod": c.typmod, "attnotnull": k == 0, "attbyval": c.size in (1, 2, 4, 8), "attalign": letter[c.alignment], "attstorage": "p" if c.size > 0 else "x", "attcacheoff": -1, "attstattarget": -1, "attislocal": True}
        for i, t in enumerate(tables)
        for k, c in enumerate(t.columns)
    ]
    write(f"{base}/{CATALOGS['pg_class']}", "pg_class", classes)
    write(f"{base}/{CATALOGS['pg_attribute']}", "pg_attribute", attributes)
    write(f"{base}/{CATALOGS['pg_namespace']}", "pg_namespace", [{"oid": 11, "nspname": "pg_catalog"}, {"oid": 2200, "nspname": "public"}])
    write(f"{base}/{CATALOGS['pg_enum']}", "pg_enum", [{"oid": 70_001, "enumtypid": 70_000, "enumsortorder": 1.0, "enumlabel": "sad"}, {"oid": 70_002, "enumtypid": 70_000, "enumsortorder": 2.0, "enumlabel": "glad"}])
    write(f"{base}/{CATALOGS['pg_index']}", "pg_index", [{"indexrelid": BASE + 50, "indrelid": BASE + 1, "indnatts": 2, "indisprimary": True, "indkey": struct.pack("<iiIii", 1, 0, 21, 2, 0) + struct.pack("<2h", 2, 1)}])
    write(f"{root}/global/{CATALOGS['pg_database']}", "pg_database", [{"oid": DB, "datname": "shop", "encoding": 6}, {"oid": 5, "datname": "postgres", "encoding": 6}])
    write(f"{root}/global/{CATALOGS['pg_authid']}", "pg_authid", [{"oid": 10, "rolname": "postgres"}])
    return root


def _datadir(spark: SparkSession, version: int = 16, fork: bool = False, lose: bool = False) -> str:
    return written(spark, "", f"data_{version}_{fork}_{lose}", lambda path: write_catalogs(path, version, fork, lose=lose))


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "null" if x is None else str(x) if isinstance(x, int) else f"'{x}'"
    return f"select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


_TABLE_ROWS = [(BASE + i, "public", t.name, BASE if i == 0 else BASE + 100 + i, len(t.columns)) for i, t in enumerate(CATALOG_TABLES)]


_SQL_LIST_TABLES = "select oid::bigint as oid, \"schema\", \"table\", relfilenode::bigint as relfilenode, n_columns from (" + _values(_TABLE_ROWS, 'oid, "schema", "table", relfilenode, n_columns') + ")"


def cat_list_tables(spark, sf_dir, version=16):
    return api.list_tables(spark, _datadir(spark, version), DB).where("schema = 'public'").select("oid", "schema", "table", "relfilenode", "n_columns")


query(_SQL_LIST_TABLES)(cat_list_tables)
query(_SQL_LIST_TABLES, "cat_list_tables_11")(lambda spark, sf_dir: cat_list_tables(spark, sf_dir, 11))


_SQL_LIST_FILES = _values([(1259, "pg_class"), (1249, "pg_attribute"), (2615, None), (3501, None), (2610, None)], "relfilenode, relname").replace("select *", "select relfilenode::bigint as relfilenode, relname")


def cat_list_files(spark, sf_dir, version=16):
    return api.list_files(spark, _datadir(spark, version), DB).select("relfilenode", "relname")


query(_SQL_LIST_FILES)(cat_list_files)
query(_SQL_LIST_FILES, "cat_list_files_11")(lambda spark, sf_dir: cat_list_files(spark, sf_dir, 11))


_SQL_LIST_DATABASES = _values([(DB, "shop", 1), (5, "postgres", 0)], "oid, name, d").replace("select *", "select oid::bigint as oid, name, d = 1 as has_directory")


def cat_list_databases(spark, sf_dir, version=16):
    return api.list_databases(spark, _datadir(spark, version)).select("oid", "name", "has_directory")


query(_SQL_LIST_DATABASES)(cat_list_databases)
query(_SQL_LIST_DATABASES, "cat_list_databases_11")(lambda spark, sf_dir: cat_list_databases(spark, sf_dir, 11))


_COLUMNS_SQL = "select c.\"table\", c.attnum, c.name, c.type_oid::bigint as type_oid from (" + _values([(t.name, k + 1, c.name, c.type_oid) for t in CATALOG_TABLES for k, c in enumerate(t.columns)], '"table", attnum, name, type_oid') + ") c"


def _columns(spark: SparkSession, version: int, fork: bool = False) -> DataFrame:
    t = catalogs.tables(catalogs.catalog(spark, _datadir(spark, version, fork), DB)).where("schema = 'public'")
    return t.select("table", F.explode("columns").alias("c")).select("table", F.col("c.attnum").cast("int").alias("attnum"), "c.name", "c.type_oid")


query(_COLUMNS_SQL, "cat_columns")(lambda spark, sf_dir: _columns(spark, 16))
for _version in (11, 12, 14, 16, 17, 18):
    query(_COLUMNS_SQL, f"version_layout_{_version}")(lambda spark, sf_dir, v=_version: _columns(spark, v))
query(_COLUMNS_SQL, "version_layout_11_discovered")(lambda spark, sf_dir: _discovered(spark, 11, False))
query(_COLUMNS_SQL, "version_layout_fork")(lambda spark, sf_dir: _columns(spark, 12, True))


def _discovered(spark: SparkSession, version: int, lose: bool) -> DataFrame:
    found, _ = discovery.discover(_datadir(spark, version, lose=lose), DB)
    rows = [(t.name, c.attnum, c.name, c.type_oid) for t in found if t.schema == "public" for c in t.columns]
    return spark.createDataFrame(rows, "table string, attnum int, name string, type_oid long")


query(_COLUMNS_SQL, "cat_carved")(lambda spark, sf_dir: _discovered(spark, 16, True))


@query("select 'orders' as \"table\", 'o_custkey,o_orderkey' as primary_key")
def cat_primary_key(spark, sf_dir):
    t = catalogs.tables(catalogs.catalog(spark, _datadir(spark), DB))
    return t.where("primary_key is not null").select("table", F.array_join("primary_key", ",").alias("primary_key"))


@query("select 70000::bigint as enumtypid, 'sad,glad' as labels")
def cat_enum_labels(spark, sf_dir):
    return catalogs.enum_labels(catalogs.catalog(spark, _datadir(spark), DB)).select("enumtypid", F.array_join(F.map_values("labels"), ",").alias("labels"))


@query(_COLUMNS_SQL.replace("::bigint as type_oid", " as type_oid"))
def export_meta(spark, sf_dir):
    """The metadata document, parsed again."""
    document = spark.createDataFrame([(api.export_metadata(_datadir(spark), DB),)], "d string")
    schema = "struct<tables:array<struct<schema:string,`table`:string,columns:array<struct<name:string,type_oid:int,attnum:int>>>>>"
    t = document.select(F.explode(F.from_json("d", schema)["tables"]).alias("t")).where("t.schema = 'public'")
    return t.select("t.table", F.explode("t.columns").alias("c")).select("table", "c.attnum", "c.name", "c.type_oid")


@query("select '" + str(DB) + "' as database, 16 as pg_version, " + str(len(CATALOG_TABLES)) + "::bigint as n_tables")
def meta_document(spark, sf_dir):
    """The metadata document built by joins of catalog DataFrames."""
    found = catalogs.tables(catalogs.catalog(spark, _datadir(spark), DB), "r").where("schema = 'public'")
    d = F.from_json("document", "struct<database:string,pg_version:int,tables:array<struct<table:string>>>")
    one = catalogs.metadata_document(found, str(DB), 16).select(d.alias("d"))
    return one.select("d.database", "d.pg_version", F.size("d.tables").cast("long").alias("n_tables"))


@query("select * from orders")
def schema_from_catalogs(spark, sf_dir):
    """A relation file inside a data directory: everything but the path is found beside it."""

    def write(path: str) -> None:
        write_catalogs(path)
        names = [c.name for c in ORDERS.columns]
        spread(rows_of(spark, sf_dir, "orders", names), names[:1], tuples_of(ORDERS.columns), [(f"{path}/base/{DB}/{BASE + 101}", True, {})])

    root = written(spark, sf_dir, "data_orders", write)
    from .sources.pgheap import ensure_registered

    return ensure_registered(spark).read.format("pgheap").option("path", f"{root}/base/{DB}/{BASE + 101}").load()


@query("select o_orderkey, o_orderpriority from orders")
def schema_from_json(spark, sf_dir):
    meta = written(spark, sf_dir, "meta.json", lambda path: open(path, "w").write(discovery.json_of_tables([ORDERS], {"pg_version": 160004})) and None)
    return api.heap_table(spark, encoded(spark, sf_dir, ORDERS), meta_json=meta, table="orders", fields=["o_orderkey", "o_orderpriority"])


# --- functions -------------------------------------------------------------------------------------------------------


SQUEEZED = 32  # texts that are compressed in one go


@query("select doc_id, text from documents")
def fn_decompress(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode("text", "utf-8").alias("raw"))

    def squeeze(batches):
        for b in batches:
            raw = b["raw"].to_pylist()
            own = [z for k in range(1, len(raw), 2 * SQUEEZED) for z in enc.pglz_many(raw[k : k + 2 * SQUEEZED : 2])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([own[i // 2] if i % 2 else enc.lz4(x) for i, x in enumerate(raw)], pa.binary()), pa.array([len(x) for x in raw]), pa.array([i % 2 == 1 for i in range(len(raw))])], ["doc_id", "z", "n", "own"])

    z = df.mapInArrow(squeeze, "doc_id long, z binary, n long, own boolean")
    # each function gets its own streams alone: Spark calls both for all rows
    text = F.coalesce(decompressor("pglz")(F.when(F.col("own"), F.col("z")), "n"), decompressor("lz4")(F.when(~F.col("own"), F.col("z")), "n"))
    return z.select("doc_id", F.decode(text, "utf-8").alias("text"))


@query(f"select {_k}, '(' || {_k} || ',0)' as tid, '\\x' || lpad(lower(to_hex({_k})), 8, '0') as unknown from orders")
def fn_decoders(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(_k)
    whole = F.unhex(F.lpad(F.hex(_k), 8, "0"))
    # a block's two halves are little-endian each
    h = F.lpad(F.hex(_k), 8, "0")
    part = lambda i: F.substring(h, i, 2)
    tid = F.unhex(F.concat(part(3), part(1), part(7), part(5), F.lit("0000")))
    hexed = F.concat(F.lit("\\x"), F.lower(F.hex(whole)))
    return df.select(_k, decoder(OID["tid"])(tid).alias("tid"), hexed.alias("unknown"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


__all__ = ["queries", "oracle_sql"]
