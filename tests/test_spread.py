"""Relations written by tasks, in several files: what they hold, where, and what the driver gets of it."""

import datetime
import os
import sys

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.test_queries import SF, TABLES, rows
from tuplequarry import api, queries
from tuplequarry.files import segments
from tuplequarry.kernel.scan import item_tuples, read_pages
from tuplequarry.testing import encoder as enc
from tuplequarry.testing import spread

SOME = """all_except_live bad_page_numbers bad_page_rows carve_auto carve_auto_format carve_mixed_pages carve_scan count_all count_deleted count_live
    dec_bool dec_jsonb dec_timestamp_us encoding_gb18030 encoding_latin1 fmt_csv fmt_csv_header fmt_insert inline_compressed_lz4 limit_physical_order scan_counters
    schema_from_catalogs segments_continue short_tuples stream_pages toast_found toast_many_columns_join toast_missing_join toast_plain fork_page_version page_32k""".split()


@pytest.fixture(scope="module")
def files():
    """Of this module alone, in small files."""
    held, own = sys.__dict__.pop("_tuplequarry_files", None), queries.spread
    queries.spread = lambda df, order, make, relations, per=0, exact=False, blocks=1: own(df, order, make, relations, 240, exact, blocks)
    yield
    queries.spread = own
    sys.__dict__.pop("_tuplequarry_files")
    if held is not None:
        sys.__dict__["_tuplequarry_files"] = held


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_queries_over_several_files(spark, duck, files, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), names)


def test_driver_gets_no_rows(spark, files, monkeypatch):
    """Of the table, its encoded values and its pages: only bounds of keys, counts, and a short row a file."""
    sys.__dict__["_tuplequarry_files"] = {}
    got = []
    frame = type(spark.range(0))
    collect = frame.collect

    def counted(self):
        out = collect(self)
        got.append(len(out))
        return out

    def refused(self, *a, **b):
        raise AssertionError("rows sent to the driver")

    monkeypatch.setattr(frame, "collect", counted)
    for x in ("toArrow", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(frame, x, refused)
    for name in ("all_except_live", "carve_scan", "bad_page_rows", "dec_bytea", "fmt_csv", "encoding_latin1", "inline_compressed_lz4", "encoding_gb18030"):
        queries.QUERIES[name](spark, SF)
    assert len(got) > 8 and max(got) <= 40


def test_pages_and_places(spark, tmp_path):
    table = queries.ORDERS
    day = datetime.datetime(2001, 1, 1)
    data = [(k * 7, k, f"s{k}" if k % 3 else None, k / 2, day, "p" * (k % 90)) for k in range(1000)]
    df = spark.createDataFrame(data, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").repartition(7)
    path, one = str(tmp_path / "many"), str(tmp_path / "one")
    spread.spread(df, ["o_orderkey"], spread.tuples_of(table.columns), [(path, True, {})], 300)
    found = segments(path)
    assert len(found) == 4 and sorted(os.listdir(tmp_path)) == sorted(os.path.basename(x) for x, _ in found)
    got = api.heap_table(spark, path, table=table, meta=True).orderBy("_page", "_lp").collect()
    assert [tuple(r)[:6] for r in got] == data
    # each tuple names its own place in the whole relation
    b = np.frombuffer(b"".join(open(x, "rb").read() for x, _ in found), np.uint8)
    t = item_tuples(b, read_pages(b, 8192), 8192)
    assert t.ctid_page.tolist() == t.page.tolist() and t.ctid_lp.tolist() == t.lp.tolist() and len(t) == 1000
    # exact: rows of one size lie as in one file
    fixed = queries.FIXED
    data = [(k // 3, k % 5, k, 1.0, float(k)) for k in range(2000)]
    names = [c.name for c in fixed.columns]
    df = spark.createDataFrame(data, ", ".join(f"{n} {'double' if i > 2 else 'long'}" for i, n in enumerate(names))).repartition(5)
    spread.spread(df, names, spread.tuples_of(fixed.columns), [(path, True, {})], 240, True)
    enc.write_relation(one, fixed.columns, sorted(data))
    assert b"".join(open(f"{path}.{k}" if k else path, "rb").read() for k in range(9)) == open(one, "rb").read()


def test_one_key_nulls_and_no_rows(spark, tmp_path):
    table = queries.relation("t", "k:int8 v:text")
    for i, data in enumerate(([(5, f"v{k}") for k in range(50)], [(None, "a"), *((k, "b") for k in range(40))], [])):
        path = str(tmp_path / str(i))
        spread.spread(spark.createDataFrame(data, "k long, v string"), ["k"], spread.tuples_of(table.columns), [(path, True, {}), (path + ".none", False, {})], 10)
        assert sorted(map(repr, api.heap_table(spark, path, table=table).collect())) == sorted(repr(r) for r in spark.createDataFrame(data, "k long, v string").collect())
        assert os.path.getsize(path + ".none") == 0


def test_tuples_at_once(spark):
    """Those that tuple_bytes makes one at a time."""
    table = queries.relation("t", "a:int8 s:text b:int4 f:float8 v:varchar d:timestamp g:float4 h:int2 z:text")
    long = "é" * 200
    at = lambda k: None if k % 5 == 2 else datetime.datetime(1999, 12, 31, 23, 59, 59, k)
    data = [(k - 3, [None, "", "x" * (k % 140), long, "x" * 125, "x" * 126][k % 6], k, k / 7, "ab" * (k % 3), at(k), 0.5, None if k % 4 == 0 else 7, None if k % 3 else "end") for k in range(300)]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.string(), pa.timestamp("us"), pa.float32(), pa.int16(), pa.string()]
    arrays = [pa.array(c, k)[3:] for c, k in zip(zip(*data, strict=True), kinds, strict=True)]
    for flags in (None, lambda r: queries.state(r[0])):
        rows_ = spread.tuples_of(table.columns, None, flags)
        want = [x[3] for r in zip(*map(spread.python_values, arrays), strict=True) for x in rows_(r)]
        assert rows_.batch(arrays).to_pylist() == want
    assert spread.tuples_of(table.columns, None, lambda r: {"natts": 2}).batch(arrays) is None
