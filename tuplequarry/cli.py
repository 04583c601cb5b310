"""Command line: ``python -m tuplequarry FILE [options]``. Results go through Spark; text lines reach stdout or files."""

from __future__ import annotations

import argparse
import sys

from . import __version__, api


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tuplequarry", description="Reads relation files of PostgreSQL-family databases without a server.")
    p.add_argument("datafile", nargs="?", help="relation file, or a directory for the listings")
    p.add_argument("-v", "--version", action="version", version=__version__)
    g = p.add_argument_group("schema")
    g.add_argument("--catalog-json", help="metadata file")
    g.add_argument("--datadir", help="data directory, or a database's directory")
    g.add_argument("--db-oid", type=int, help="database in the data directory")
    g.add_argument("--table-name", help="name or schema.name")
    g = p.add_argument_group("what to write")
    for flag, text in (("--ddl", "CREATE TABLE"), ("--sql", "INSERT statements (the default)"), ("--data", "CSV for COPY"), ("--parquet", "Parquet with typed columns"), ("--deleted", "deleted rows too"), ("--only-deleted", "deleted rows only"), ("--count", "the number of rows"), ("--list-tables", "tables"), ("--list-db", "databases"), ("--list-tables-db", "relation files of a database"), ("--export-meta", "the metadata document")):
        g.add_argument(flag, action="store_true", help=text)
    g.add_argument("-o", "--output", help="file, prefix, or directory with a slash at its end")
    g.add_argument("--limit", type=int, default=0, help="rows, 0 for all")
    g.add_argument("--fields", help="columns, separated by commas")
    g.add_argument("--header", action="store_true", help="column names as the first line of CSV")
    g.add_argument("--complete-insert", action=argparse.BooleanOptionalAction, default=True, help="column names in INSERT")
    g.add_argument("--replace", action="store_true", help="REPLACE INTO")
    g.add_argument("--delimiter", default=",")
    g = p.add_argument_group("reading")
    g.add_argument("--scan", choices=["itemid", "carve", "auto"], default="auto", help="by line pointers, by tuple headers, or the first that finds rows")
    g.add_argument("--toast", help="relation file with out-of-line values")
    g.add_argument("--page-size", type=int, choices=[8192, 16384, 32768])
    g.add_argument("--parallel", type=int, default=0, help="cores in local mode, 0 for all")
    g.add_argument("--encoding")
    g.add_argument("--force", action="store_true", help="accepted; has no effect")
    g.add_argument("--toast-cache", choices=["light", "full"], help="accepted; Spark decides by size")
    g.add_argument("--verbose", action="store_true")
    return p


def session(parallel: int):
    from pyspark.sql import SparkSession

    b = SparkSession.builder.appName("tuplequarry").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    active = SparkSession.getActiveSession()
    return active or b.master(f"local[{parallel or '*'}]").config("spark.ui.enabled", "false").getOrCreate()


def main(argv: list[str] | None = None, out=None) -> int:
    a = parser().parse_args(argv)
    out = out or sys.stdout
    say = lambda x: print(x, file=out)
    try:
        directory = a.datadir or a.datafile
        if a.export_meta:
            say(api.export_metadata(directory, a.db_oid))
            return 0
        if a.catalog_json and a.list_tables:
            for t in sorted(api.load_metadata(meta_json=a.catalog_json)[0], key=lambda t: t.full_name):
                say(f"{t.relfilenode}\t{t.full_name}\t{len(t.live)}")
            return 0
        spark = session(a.parallel)
        for flag, f in ((a.list_db, api.list_databases), (a.list_tables, api.list_tables), (a.list_tables_db, api.list_files)):
            if flag:
                df = f(spark, directory) if f is api.list_databases else f(spark, directory, a.db_oid)
                say("\t".join(df.columns))
                for r in df.orderBy(df.columns[0]).toLocalIterator():
                    say("\t".join("" if x is None else str(x) for x in r))
                return 0
        if not a.datafile:
            raise ValueError("give a relation file")
        common = {"table": a.table_name, "meta_json": a.catalog_json, "datadir": a.datadir, "db_oid": a.db_oid, "encoding": a.encoding, "page_size": a.page_size, "toast": a.toast}
        rows = "deleted" if a.only_deleted else "all" if a.deleted else "live"
        if a.count:
            say(f"-- rows: {api.count(spark, a.datafile, rows=rows, scan=a.scan, **common)}")
            return 0
        fields = [x.strip() for x in a.fields.split(",") if x.strip()] if a.fields else None
        if a.ddl and not (a.sql or a.data or a.parquet):
            say(api.ddl(a.datafile, **common))
            return 0
        reading = common | {"rows": rows, "scan": a.scan}
        if a.parquet:
            say(api.save(spark, a.datafile, a.output, "parquet", **reading, **({"fields": fields} if fields else {})))
        elif a.data:
            more = {"fields": fields, "delimiter": a.delimiter, "limit": a.limit}
            if a.output:
                say(api.save(spark, a.datafile, a.output, "csv", header=a.header, **reading, **more))
            else:
                if a.header:
                    from .operators.export import csv_header

                    say(csv_header(api.plan_of(a.datafile, **common).ctx.table, fields, a.delimiter))
                _print(api.csv(spark, a.datafile, **reading, **more), say)
        else:
            more = {"fields": fields, "complete": a.complete_insert, "replace_rows": a.replace, "limit": a.limit}
            if a.output:
                say(api.save(spark, a.datafile, a.output, "sql", with_ddl=a.ddl, **reading, **more))
            else:
                if a.ddl:
                    say(api.ddl(a.datafile, **common))
                _print(api.inserts(spark, a.datafile, **reading, **more), say)
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


def _print(lines, say) -> None:
    """One partition at a time, in physical order."""
    for r in lines.orderBy("_page", "_lp", "_pos").toLocalIterator():
        say(r.line)
