"""The library's front door.

    df = heap_table(spark, "/pgdata/base/16384/24576")            # schema from the catalogs beside it
    df = heap_table(spark, path, meta_json="meta.json", table="public.t", rows="all", meta=True)
    spark.read.format("pgheap").option("path", path).option("rows", "deleted").load()

Options of the ``pgheap`` format and keyword arguments here are the same: path, datadir, db_oid (dbOid), table,
meta_json (catalogJson), columns, rows (live, deleted, all), fields, mode (typed, text), scan (itemid, carve, auto),
page_size (pageSize), pg_version (pgVersion), fork, encoding, toast (toastPath), max_rows, meta, pages_per_partition,
direct_toast_bytes (directToastBytes). The format cannot join: it refuses a storage relation of more bytes than that.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import parent, read_range, segments, size_of
from .kernel.scan import EXTERNAL, item_tuples, read_pages, walk
from .layout import PAGE_SIZES, Context, Table, major
from .operators import export, toast
from .plans import discovery
from .plans.catalog import list_databases, list_files, list_tables
from .sources.pgheap import PAGES_PER_PARTITION, ensure_registered, plan_to_json
from .sources.scan import Plan, chunks_of, probe
from .streaming.pages import stream_plan

__all__ = ["count", "csv", "ddl", "export_metadata", "heap_table", "inserts", "list_databases", "list_files", "list_tables", "load_metadata", "item_report", "page_report", "plan_of", "save", "stream_table"]

ALIASES = {"dbOid": "db_oid", "catalogJson": "meta_json", "pageSize": "page_size", "pgVersion": "pg_version", "toastPath": "toast", "maxRows": "max_rows", "pagesPerPartition": "pages_per_partition", "directToastBytes": "direct_toast_bytes"}


def load_metadata(path: str | None = None, meta_json: str | None = None, datadir: str | None = None, db_oid: int | None = None) -> tuple[list[Table], dict]:
    """A metadata file's tables, or a data directory's, or those of the directory that the relation file is in."""
    if meta_json:
        return discovery.tables_of_json(read_range(meta_json).decode("utf-8-sig"))
    if datadir:
        return discovery.discover(datadir, db_oid)
    if path:
        return discovery.discover(parent(path))
    raise ValueError("give a metadata file, a data directory or a relation file")


def plan_of(path: str, table: str | Table | None = None, meta_json: str | None = None, datadir: str | None = None, db_oid: int | None = None, rows: str = "live", fields: list[str] | None = None, mode: str = "typed", scan: str = "itemid", page_size: int | None = None, pg_version: int | None = None, fork: bool | None = None, encoding: str | None = None, toast: str | None = None, max_rows: int = 0, meta: bool = False) -> Plan:
    for name, value, known in (("rows", rows, ("live", "deleted", "all")), ("mode", mode, ("typed", "text")), ("scan", scan, ("itemid", "carve", "auto"))):
        if value not in known:
            raise ValueError(f"{name} is one of {', '.join(known)}, not {value}")
    facts: dict = {}
    if not isinstance(table, Table):
        found, facts = load_metadata(path, meta_json, datadir, db_oid)
        number = path.rstrip("/").rpartition("/")[2]
        table = discovery.select_table(found, table, int(number) if number.isdigit() else None)
        if toast is None and table.toastrelid:
            # the storage relation's file may have another number than its oid
            file = next((t.relfilenode for t in found if t.oid == table.toastrelid), table.toastrelid)
            toast = f"{parent(path)}/{file}" if size_of(f"{parent(path)}/{file}") > 0 else None
    size, psv = probe(path)
    if page_size and page_size != size:
        if page_size not in PAGE_SIZES:
            raise ValueError(f"pages have {', '.join(map(str, PAGE_SIZES))} bytes")
        size = page_size
    version = major(pg_version or facts.get("pg_version", 16))
    ctx = Context(table, size, psv, version, facts.get("fork", False) if fork is None else fork, encoding or facts.get("encoding", "utf-8"), facts.get("roles", {}), mode)
    if toast is None:
        toast = find_toast(path, ctx)
    return Plan(ctx.only(fields), rows, scan, meta, False, toast or "", max_rows)


def plan_of_options(options: dict) -> Plan:
    """From the options of the data source, all of them strings."""
    short = {k.lower(): v for k, v in ALIASES.items()}  # Spark hands options on in lower case
    o = {short.get(k.lower(), k.lower()): v for k, v in options.items()}
    flag = lambda x: str(x).lower() in ("true", "1", "yes")
    kw = {k: o[k] for k in ("path", "table", "meta_json", "datadir", "rows", "mode", "scan", "encoding", "toast") if k in o}
    kw |= {k: int(o[k]) for k in ("db_oid", "page_size", "pg_version", "max_rows") if k in o}
    kw |= {k: flag(o[k]) for k in ("fork", "meta") if k in o}
    if "fields" in o:
        kw["fields"] = [x.strip() for x in o["fields"].split(",") if x.strip()]
    if "columns" in o:
        kw["table"] = Table.from_json(o["columns"])
    plan = plan_of(**kw)
    return replace(plan, toast_bytes=int(o["direct_toast_bytes"])) if "direct_toast_bytes" in o else plan


def find_toast(path: str, ctx: Context) -> str | None:
    """The storage relation that pointers in the first pages name, if its file is beside the relation and has chunks.

    So that a large one is known early enough to be joined; where the first pages have no pointer, readers find the
    relation by the pointers that they meet."""
    if not any(c.size == -1 for c in ctx.table.columns):
        return None
    b = read_range(path, 0, 8 * ctx.page_size)
    if b"\x01\x12" not in b or len(b) < ctx.page_size:
        return None
    import numpy as np

    a = np.frombuffer(b[: len(b) // ctx.page_size * ctx.page_size], np.uint8)
    t = item_tuples(a, read_pages(a, ctx.page_size, ctx.psv_offset), ctx.page_size, ctx.psv_offset)
    for v in walk(a, t, ctx.table.columns)[0]:
        if v.kind is not None:
            for at in v.at[~v.null & (v.kind == EXTERNAL)].tolist():
                relation = int.from_bytes(b[at + 12 : at + 16], "little")
                file = f"{parent(path)}/{relation}"
                if relation and size_of(file) > 0 and any(len(ids) for ids, _, _ in chunks_of(file)):
                    return file
    return None


def _load(spark: SparkSession, path: str, plan: Plan, per: int) -> DataFrame:
    ensure_registered(spark)
    return spark.read.format("pgheap").option("path", path).option("plan", plan_to_json(plan)).option("pagesPerPartition", str(per)).load()


def heap_table(spark: SparkSession, path: str, pages_per_partition: int = PAGES_PER_PARTITION, direct_toast_bytes: int = toast.DIRECT_BYTES, **options) -> DataFrame:
    """A relation's rows. scan="auto" reads by line pointers and carves the pages on which they lead to nothing, or all
    pages if no row with a value is found by line pointers.

    Out-of-line values: a storage relation of up to direct_toast_bytes is loaded by each reader, a larger one is joined."""
    plan = plan_of(path, **options)
    if plan.scan == "auto":
        # every column counts for the choice, whichever are asked for
        some = replace(plan_of(path, **options | {"fields": None}), scan="itemid", meta=False, max_rows=0, toast="")
        seen = _load(spark, path, some, pages_per_partition)
        has_value = F.coalesce(*[F.col(export.identifier_path(c)).cast("string") for c in seen.columns], F.lit("")) != ""
        plan = replace(plan, scan="auto" if seen.where(has_value).take(1) else "carve")
    plan = replace(plan, toast_bytes=direct_toast_bytes)
    if plan.toast and size_of(plan.toast) >= 0 and sum(n for _, n in segments(plan.toast)) > direct_toast_bytes:
        wanted = [n for n, _ in plan.fields()]
        df = _load(spark, path, replace(plan, pointers=True, toast=""), pages_per_partition)
        return toast.resolve(df, toast.chunks(spark, plan.toast), plan.ctx).select(*[export.identifier_path(x) for x in wanted])
    return _load(spark, path, plan, pages_per_partition)


def stream_table(spark: SparkSession, path: str, pages_per_partition: int = PAGES_PER_PARTITION, **options) -> DataFrame:
    """New pages of a growing relation as a stream."""
    return stream_plan(spark, path, plan_of(path, **options), pages_per_partition)


def count(spark: SparkSession, path: str, **options) -> int:
    """Rows, from headers alone: no column is decoded."""
    return heap_table(spark, path, **options | {"fields": [], "meta": True}).select(F.count("*")).first()[0]


def page_report(spark: SparkSession, path: str) -> DataFrame:
    """Page headers; pages that cannot be read have valid = false."""
    ensure_registered(spark)
    return spark.read.format("pgpages").option("path", path).load()


def item_report(spark: SparkSession, path: str) -> DataFrame:
    ensure_registered(spark)
    return spark.read.format("pgitems").option("path", path).load()


def _limited(df: DataFrame, limit: int) -> DataFrame:
    """The first rows in physical order; 0: all."""
    return df.orderBy("_page", "_lp", "_pos").limit(limit) if limit else df


def _export(spark: SparkSession, path: str, limit: int, options: dict) -> tuple[DataFrame, Table]:
    options = {k: v for k, v in options.items() if k != "fields"} | {"mode": "text", "meta": True}
    plan = plan_of(path, **options)
    return _limited(heap_table(spark, path, **options), limit), plan.ctx.table


def inserts(spark: SparkSession, path: str, fields: list[str] | None = None, complete: bool = True, replace_rows: bool = False, limit: int = 0, **options) -> DataFrame:
    df, table = _export(spark, path, limit, options)
    return export.statements(df, table, fields, complete, replace_rows)


def csv(spark: SparkSession, path: str, fields: list[str] | None = None, delimiter: str = ",", limit: int = 0, **options) -> DataFrame:
    df, table = _export(spark, path, limit, options)
    return export.csv_lines(df, table, fields, delimiter)


def ddl(path: str, **options) -> str:
    return export.ddl(plan_of(path, **options).ctx.table)


def export_metadata(datadir: str, db_oid: int | None = None) -> str:
    return discovery.json_of_tables(*discovery.discover(datadir, db_oid, "r"))


def save(spark: SparkSession, path: str, target: str | None = None, form: str = "sql", with_ddl: bool = False, header: bool = False, single: bool = False, **options) -> str:
    """Writes statements (sql), CSV (csv) or columns (parquet); returns where."""
    if form == "parquet":
        out = export.output_path(target, plan_of(path, **{k: v for k, v in options.items() if k != "limit"}).ctx.table, "parquet")
        heap_table(spark, path, **options).write.mode("overwrite").parquet(out)
        return out
    plan_options = {k: v for k, v in options.items() if k in plan_of.__code__.co_varnames and k not in ("fields", "path")}
    table = plan_of(path, **plan_options).ctx.table
    out = export.output_path(target, table, "csv" if form == "csv" else "sql")
    head = None
    if form == "csv":
        lines = csv(spark, path, **options)
        head = export.csv_header(table, options.get("fields"), options.get("delimiter", ",")) if header else None
    else:
        lines = inserts(spark, path, **options)
        head = export.ddl(table) if with_ddl else None
    export.write_lines(lines, out, head, single)
    return out


