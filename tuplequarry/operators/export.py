"""Rows as INSERT or REPLACE statements and as CSV for COPY; tables as DDL; and the files they go to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.render import csv_field, identifier, sql_literal
from ..layout import OID, TYPES
from ..layout import Column as Attribute
from ..layout import Table

# Types whose text is a literal without quotes.
BARE = {OID[x] for x in ("bool", "int8", "int2", "int4", "oid", "float4", "float8", "numeric")}


def _chosen(table: Table, fields: list[str] | None) -> list[Attribute]:
    """In table order, whatever the order of the request."""
    live = table.live
    if fields is None:
        return list(live)
    missing = sorted(set(fields) - {c.name for c in live})
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}; there are: {', '.join(sorted(c.name for c in live))}")
    return [c for c in live if c.name in fields]


def sql_value(c: Attribute, table: Table) -> Column:
    v = F.col(identifier_path(c.name)).cast("string")
    if table.resolved(c.type_oid) in BARE:
        out = F.when(v.isin("NaN", "Infinity", "-Infinity"), F.concat(F.lit("'"), v, F.lit("'"))).otherwise(v)
    else:
        out = sql_literal(v)
    return F.when(v.isNull(), "NULL").otherwise(out)


def identifier_path(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def statements(df: DataFrame, table: Table, fields: list[str] | None = None, complete: bool = True, replace: bool = False) -> DataFrame:
    """df has the table's columns as text, and _deleted and _ctid if deleted rows are to be marked. Column: line."""
    cols = _chosen(table, fields)
    names = f"({', '.join(identifier(c.name) for c in cols)}) " if complete else ""
    head = f"{'REPLACE' if replace else 'INSERT'} INTO {identifier(table.schema)}.{identifier(table.name)} {names}VALUES ("
    line = F.concat(F.lit(head), F.concat_ws(", ", *[sql_value(c, table) for c in cols]), F.lit(");"))
    if "_deleted" in df.columns:
        note = F.concat(F.lit("-- DELETED ctid="), F.replace(F.col("_ctid"), F.lit(","), F.lit(", ")), F.lit("\n")) if "_ctid" in df.columns else F.lit("-- DELETED\n")
        line = F.concat(F.when(F.col("_deleted"), note).otherwise(""), line)
    keep = [c for c in ("_page", "_lp", "_pos") if c in df.columns]
    return df.select(*keep, line.alias("line"))


def csv_lines(df: DataFrame, table: Table, fields: list[str] | None = None, delimiter: str = ",") -> DataFrame:
    cols = _chosen(table, fields)
    line = F.concat_ws(delimiter, *[csv_field(F.col(identifier_path(c.name)).cast("string"), delimiter) for c in cols])
    keep = [c for c in ("_page", "_lp", "_pos") if c in df.columns]
    return df.select(*keep, line.alias("line"))


def csv_header(table: Table, fields: list[str] | None = None, delimiter: str = ",") -> str:
    quote = lambda s: '"' + s.replace('"', '""') + '"' if any(x in s for x in (delimiter, '"', "\n", "\r")) or s == "\\N" else s
    return delimiter.join(quote(c.name) for c in _chosen(table, fields))


def type_sql(c: Attribute, table: Table) -> str:
    """The column's type with its modifier."""
    t = TYPES.get(c.type_oid)
    if t is None:
        name = table.type_names.get(c.type_oid)
        return identifier(name) if name and c.type_oid in table.enums else name or f"oid:{c.type_oid}"
    base = TYPES[t.elem] if t.elem else t
    tail, m, name = "[]" * bool(t.elem), c.typmod, base.name
    if name in ("varchar", "bpchar") and m >= 4:
        return f"{base.sql}({m - 4}){tail}"
    if name == "numeric" and m >= 4:
        return f"numeric({m - 4 >> 16 & 0xFFFF},{((m - 4 & 0x7FF) ^ 1024) - 1024}){tail}"
    if name in ("bit", "varbit") and m > 0:
        return f"{base.sql}({m}){tail}"
    if name in ("time", "timetz", "timestamp", "timestamptz") and m >= 0:
        first, _, rest = base.sql.partition(" ")
        return f"{first}({m}){' ' + rest if rest else ''}{tail}"
    return base.sql + tail


def ddl(table: Table) -> str:
    lines, types = [], ""
    for oid in dict.fromkeys(c.type_oid for c in table.live if c.type_oid in table.enums):
        labels = ", ".join("'" + x.replace("'", "''") + "'" for x in table.enums[oid].values())
        types += f"CREATE TYPE {identifier(table.type_names.get(oid, f'oid:{oid}'))} AS ENUM ({labels});\n"
    for c in table.live:
        lines.append(f"  {identifier(c.name)} {type_sql(c, table)}{' NOT NULL' if c.notnull else ''}")
    if table.primary_key:
        lines.append(f"  PRIMARY KEY ({', '.join(map(identifier, table.primary_key))})")
    return f"{types}CREATE TABLE {identifier(table.schema)}.{identifier(table.name)} (\n" + ",\n".join(lines) + "\n);"


def output_path(target: str | None, table: Table, extension: str) -> str:
    """schema.table.ext in a directory (a target that ends in a slash, or none), else the target with the extension."""
    name = f"{table.schema}.{table.name}.{extension}"
    if not target:
        return name
    if target.endswith("/"):
        return target + name
    return target if target.endswith(f".{extension}") else f"{target}.{extension}"


def write_lines(lines: DataFrame, path: str, head: str | None = None, single: bool = False, ordered: bool = True) -> None:
    """Lines as text files, in physical order if they carry it. single: one file, with head in front; one task then
    writes all, so leave it off for large tables, where head goes to a file of its own that sorts first."""
    place = [c for c in ("_page", "_lp", "_pos") if c in lines.columns] if ordered else []
    if single:
        out = lines.select(F.lit(1).alias("_part"), *place, "line")
        if head is not None:
            nothing = [F.lit(None).cast("long").alias(c) for c in place]
            out = lines.sparkSession.createDataFrame([(head,)], "line string").select(F.lit(0).alias("_part"), *nothing, "line").union(out)
        out.coalesce(1).sortWithinPartitions("_part", *place).select("line").write.mode("overwrite").text(path)
        return
    out = (lines.orderBy(*place) if place else lines).select("line")
    out.write.mode("overwrite").text(path)
    if head is not None:
        spark = lines.sparkSession
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        f = fs.create(spark._jvm.org.apache.hadoop.fs.Path(path, "a-head.txt"))
        f.write(bytearray((head + "\n").encode()))
        f.close()
