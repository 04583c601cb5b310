import os

import pytest
from pyspark.sql import functions as F

from tuplequarry import api, queries
from tuplequarry.layout import OID, Column, Table
from tuplequarry.operators import export, visibility
from tuplequarry.plans import discovery
from tuplequarry.testing import encoder as enc

SF = "/root/testdata/sf0.001"
T = Table("t", (Column("k", OID["int8"], attnum=1), Column("s", OID["text"], attnum=2), Column("d", OID["date"], attnum=3), Column("n", OID["numeric"], typmod=(10 << 16 | 2) + 4, attnum=4)))


@pytest.fixture
def relation(tmp_path):
    path = str(tmp_path / "24576")
    rows = [(k, None if k % 5 == 0 else f"v{k}" * (k % 40), k % 1000 if k % 7 else 2**31 - 1, f"{k}.25" if k % 9 else "NaN") for k in range(4000)]
    enc.write_relation(path, T.columns, rows, flags=lambda r: queries.state(r[0]))
    return path


def test_partitioning_changes_nothing(spark, relation):
    one = api.heap_table(spark, relation, table=T, rows="all", meta=True)
    many = api.heap_table(spark, relation, table=T, rows="all", meta=True, pages_per_partition=1)
    assert many.rdd.getNumPartitions() > 10 and one.exceptAll(many).count() == 0 and many.count() == one.count()


def test_states_add_up(spark, relation):
    n = {r: api.heap_table(spark, relation, table=T, rows=r).count() for r in ("live", "deleted", "all")}
    assert n["all"] == n["live"] + n["deleted"] and api.count(spark, relation, table=T) == n["live"]
    df = api.heap_table(spark, relation, table=T, rows="all", meta=True)
    assert df.where(visibility.is_live() != F.col("_live")).count() == 0 and df.where(visibility.is_deleted() != F.col("_deleted")).count() == 0


def test_filters_prune_ranges(spark, relation):
    df = api.heap_table(spark, relation, table=T, meta=True, pages_per_partition=2)
    part = df.where("_page >= 4 and _page < 8")
    assert part.rdd.getNumPartitions() == 2 and {r._page for r in part.select("_page").distinct().collect()} == {4, 5, 6, 7}


def test_fields_and_errors(spark, relation):
    whole = api.heap_table(spark, relation, table=T)
    assert api.heap_table(spark, relation, table=T, fields=["s", "k"]).exceptAll(whole.select("k", "s")).count() == 0
    with pytest.raises(ValueError, match="no such columns: x; there are: d, k, n, s"):
        api.heap_table(spark, relation, table=T, fields=["x"])
    with pytest.raises(ValueError, match="rows is one of"):
        api.heap_table(spark, relation, table=T, rows="dead")


def test_values_without_a_typed_form(spark, relation):
    df = api.heap_table(spark, relation, table=T, meta=True)
    bad = df.where("_decode_status is not null").select("k", "d", "n", "_decode_status").collect()
    assert bad and all((r.d is None) == (r.k % 7 == 0) and (r.n is None) == (r.k % 9 == 0) for r in bad)
    text = api.heap_table(spark, relation, table=T, mode="text")
    assert text.where("d = 'infinity'").count() + text.where("n = 'NaN'").count() > 0


def test_limit_is_in_physical_order(spark, relation):
    lines = [r.line for r in api.csv(spark, relation, table=T, fields=["k"], limit=5).orderBy("_page", "_lp").collect()]
    assert lines == [str(k) for k in range(1, 40) if k % 11 and k % 7][:5]


def test_bad_pages(spark):
    whole = api.heap_table(spark, queries.encoded(spark, SF, queries.ORDERS), table=queries.ORDERS, meta=True)
    want = whole.where("_page % 5 <> 4").select("o_orderkey", "o_totalprice", "_page")
    got = queries.bad_page_skip(spark, SF)
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0
    assert all(r.page % 5 == 4 for r in queries.bad_page_list(spark, SF).collect())


def test_carved_and_deleted(spark, relation, tmp_path):
    with open(relation, "rb") as f:
        data = bytearray(f.read())
    for k in range(0, len(data), 8192):
        page = data[k : k + 8192]
        queries._lose_pointers(page, 0)
        data[k : k + 8192] = page
    path = str(tmp_path / "carve")
    with open(path, "wb") as f:
        f.write(data)
    for rows in ("live", "deleted"):
        a, b = (api.heap_table(spark, p, table=T, rows=rows, scan=s) for p, s in ((relation, "itemid"), (path, "carve")))
        assert a.exceptAll(b).count() == 0 and a.count() == b.count()
    assert api.heap_table(spark, path, table=T).count() == 0


def test_save_and_read_back(spark, relation, tmp_path):
    out = api.save(spark, relation, str(tmp_path) + "/", "sql", with_ddl=True, single=True, table=T)
    lines = [r.value for r in spark.read.text(out).collect()]
    assert os.path.basename(out) == "public.t.sql" and lines[0].startswith("CREATE TABLE") and sum(x.startswith("INSERT") for x in lines) == api.count(spark, relation, table=T)
    out = api.save(spark, relation, str(tmp_path / "x"), "csv", header=True, table=T)
    got = spark.read.option("header", True).option("nullValue", "\\N").csv(out).count()
    assert out.endswith("x.csv") and got >= 1
    out = api.save(spark, relation, str(tmp_path / "p"), "parquet", table=T)
    assert spark.read.parquet(out).exceptAll(api.heap_table(spark, relation, table=T)).count() == 0


def test_empty_and_missing(spark, tmp_path):
    path = str(tmp_path / "1")
    open(path, "wb").close()
    assert api.heap_table(spark, path, table=T).count() == 0 and api.heap_table(spark, path, table=T, rows="all", meta=True).count() == 0
    with open(path, "wb") as f:
        f.write(bytes(3 * 8192 + 100))
    assert api.heap_table(spark, path, table=T).count() == 0 and api.page_report(spark, path).where("zero").count() == 3
    with pytest.raises(Exception, match="2"):
        api.heap_table(spark, str(tmp_path / "2"), table=T)


def test_discovery(spark, tmp_path):
    root = queries.write_catalogs(str(tmp_path / "d"))
    tables, facts = discovery.discover(root, queries.DB)
    assert facts["pg_version"] == 16 and facts["encoding"] == "utf-8" and facts["roles"] == {10: "postgres"}
    by = {t.name: t for t in tables}
    assert by["orders"].columns == tuple(c for c in by["orders"].columns) and by["orders"].primary_key == ("o_custkey", "o_orderkey")
    assert discovery.select_table(tables, "orders").full_name == "public.orders" and discovery.select_table(tables, None, queries.BASE + 101).name == "orders"
    with pytest.raises(ValueError, match="no table is called nothing"):
        discovery.select_table(tables, "nothing")
    again, _ = discovery.tables_of_json(discovery.json_of_tables(tables, facts))
    assert [t.full_name for t in again] == [t.full_name for t in tables] and [c.name for c in again[0].columns] == [c.name for c in tables[0].columns]
    # a rewritten catalog has another number
    os.rename(f"{root}/base/{queries.DB}/1259", f"{root}/base/{queries.DB}/30000")
    assert {t.name for t in discovery.discover(root, queries.DB)[0]} == set(by)
    assert export.ddl(by["orders"]).count("\n") == 8


def test_metadata_tolerates_strings():
    doc = '{"database": "x", "pg_version": "160004", "tables": [{"table": "t", "columns": [{"name": "a", "type_oid": "23", "len": "4", "attnum": "1", "typmod": "-1"}]}]}'
    (t,), facts = discovery.tables_of_json(doc)
    assert t.columns[0].size == 4 and facts["pg_version"] == 16 and t.schema == "public"


def test_storage_relation_is_found_by_pointers(spark, tmp_path):
    cols = queries.DOCUMENTS
    big = b"0123456789" * 900
    enc.write_relation(str(tmp_path / "100"), cols.columns, [(1, enc.Datum(enc.pointer(len(big) + 4, len(big), 555, 200)), "en"), (2, b"small", "de"), (3, enc.Datum(enc.pointer(len(big) + 4, 3000, 556, 200)), "xx")])
    enc.write_toast(str(tmp_path / "200"), [(555, big), (556, b"\x10\0\0\0rubbish" * 10)])
    for direct in (1 << 30, 0):
        rows = {r.doc_id: r for r in api.heap_table(spark, str(tmp_path / "100"), table=cols, meta=True, direct_toast_bytes=direct).collect()}
        assert rows[1].text == big.decode() and rows[2].text == "small" and rows[3].text is None and rows[3]._decode_status == "text:TOAST_CORRUPT"


def test_out_of_line_join_scans_once(spark):
    """Twenty columns of variable length, one scan of the relation and one of its storage."""
    df = queries.toast_many_columns_join(spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RelationV2") == 2 and plan.count("Join LeftOuter") == 1


def test_format_refuses_large_storage(spark):
    from tuplequarry.sources.pgheap import ensure_registered

    path, store = queries._toasted(spark, SF, None)
    read = ensure_registered(spark).read.format("pgheap").option("path", path).option("columns", queries.DOCUMENTS.to_json()).option("toastPath", store)
    assert read.load().where("length(text) > 1996").count() > 0
    with pytest.raises(Exception, match="directToastBytes"):
        read.option("directToastBytes", "1000").load().collect()


def test_system_oids(spark):
    """Up to version 11 a row's oid is in its header."""
    from tuplequarry.plans.catalog import catalog_frame
    from tuplequarry.plans.discovery import find_catalog

    root = queries._datadir(spark, 11)
    path = find_catalog(f"{root}/base/{queries.DB}", "pg_class", 11)
    rows = catalog_frame(spark, path, "pg_class", 11).select("oid", "_oid", "relname").collect()
    assert {r.relname for r in rows if r.oid == 1259} == {"pg_class"} and all(r.oid == r._oid for r in rows)
