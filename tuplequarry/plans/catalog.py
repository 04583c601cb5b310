"""System catalogs and listings as DataFrames: the joins and groupings that lead from catalog rows to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import listing, relation_files, size_of
from ..layout import CATALOGS, KINDS, Context, catalog_table, major
from ..sources.pgheap import ensure_registered, plan_to_json
from ..sources.scan import Plan, probe
from .discovery import carved_classes, database_dir, find_catalog, is_fork, root_of, version_of


WITH_OID = ("pg_class", "pg_namespace", "pg_type", "pg_authid", "pg_database", "pg_enum")


def catalog_frame(spark: SparkSession, path: str, name: str, version: int = 16, fork: bool = False, encoding: str = "utf-8", rows: str = "live") -> DataFrame:
    """A system catalog's leading columns, with the header columns of its tuples; oid comes from there up to version 11."""
    ensure_registered(spark)
    size, psv = probe(path)
    plan = Plan(Context(catalog_table(name, version, fork), size, psv, major(version), fork, encoding), rows=rows, meta=True)
    df = spark.read.format("pgheap").option("path", path).option("plan", plan_to_json(plan)).load()
    return df.withColumn("oid", F.col("_oid")) if "oid" not in df.columns and name in WITH_OID else df


def _frame(spark: SparkSession, directory: str, name: str, version: int, fork: bool, fallback: str) -> DataFrame:
    path = find_catalog(directory, name, version, fork)
    return catalog_frame(spark, path, name, version, fork) if path else spark.createDataFrame([], fallback)


def catalog(spark: SparkSession, datadir: str, db_oid: int | None = None) -> dict[str, DataFrame]:
    """namespace, class, attribute, type, enum and index of a database."""
    d, _ = database_dir(datadir, db_oid)
    v, fork = version_of(d), is_fork(d)
    return {
        "namespace": _frame(spark, d, "pg_namespace", v, fork, "oid long, nspname string"),
        "class": _frame(spark, d, "pg_class", v, fork, "oid long, relname string, relnamespace long, relfilenode long, relkind string, reltoastrelid long, reltuples float, relpages int"),
        "attribute": _frame(spark, d, "pg_attribute", v, fork, "attrelid long, attname string, atttypid long, attlen short, attnum short, atttypmod int, attnotnull boolean, attisdropped boolean, attalign string, attstorage string"),
        "type": _frame(spark, d, "pg_type", v, fork, "oid long, typname string, typtype string, typbasetype long"),
        "enum": _frame(spark, d, "pg_enum", v, fork, "oid long, enumtypid long, enumsortorder float, enumlabel string"),
        "index": _frame(spark, d, "pg_index", v, fork, "indrelid long, indisprimary boolean, indkey array<short>"),
    }


def tables(cat: dict[str, DataFrame], kinds: str = "rmt") -> DataFrame:
    """One row a relation with columns: its schema, file, kind, key and columns in order.

    pg_class left joins pg_namespace (public by default), and inner joins its grouped attributes; the primary key is the
    key columns of pg_index in key order."""
    ns = cat["namespace"].select(F.col("oid").alias("relnamespace"), "nspname")
    cls = cat["class"].withColumn("relfilenode", F.when(F.col("relfilenode") == 0, F.col("oid")).otherwise(F.col("relfilenode")))
    cls = cls.where(F.col("relkind").isin(*kinds)).select("oid", "relname", "relnamespace", "relfilenode", "relkind", "reltoastrelid")
    valid = F.col("attalign").isin("c", "s", "i", "d") & F.col("attstorage").isin("p", "e", "m", "x")
    att = cat["attribute"].where((F.col("attnum") > 0) & valid)
    field = F.struct("attnum", F.col("attname").alias("name"), F.col("atttypid").alias("type_oid"), F.col("attlen").alias("len"), F.col("atttypmod").alias("typmod"), F.col("attnotnull").alias("notnull"), F.col("attisdropped").alias("dropped"), "attalign", "attstorage")
    cols = att.groupBy(F.col("attrelid").alias("oid")).agg(F.array_sort(F.collect_list(field)).alias("columns"))
    keys = cat["index"].where("indisprimary").select(F.col("indrelid").alias("oid"), F.posexplode("indkey").alias("place", "attnum"))
    names = att.select(F.col("attrelid").alias("oid"), "attnum", "attname")
    keys = keys.join(names, ["oid", "attnum"]).groupBy("oid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "attname"))), lambda x: x["attname"]).alias("primary_key"))
    out = cls.join(ns, "relnamespace", "left").join(cols, "oid").join(keys, "oid", "left")
    return out.select("oid", F.coalesce("nspname", F.lit("public")).alias("schema"), F.col("relname").alias("table"), "relfilenode", "relkind", F.col("reltoastrelid").alias("toastrelid"), "primary_key", "columns")


def enum_labels(cat: dict[str, DataFrame]) -> DataFrame:
    """Labels of each enum type by member."""
    return cat["enum"].groupBy("enumtypid").agg(F.map_from_entries(F.collect_list(F.struct("oid", "enumlabel"))).alias("labels"))


def metadata_document(found: DataFrame, database: str, version: int) -> DataFrame:
    """The metadata document, one row; relations are few enough for one value, as the document itself is."""
    one = F.struct("schema", "table", "relfilenode", "toastrelid", F.coalesce("primary_key", F.array().cast("array<string>")).alias("primary_key"), "columns")
    return found.agg(F.to_json(F.struct(F.lit(database).alias("database"), F.lit(version).alias("pg_version"), F.array_sort(F.collect_list(one)).alias("tables"))).alias("document"))


# --- listings --------------------------------------------------------------------------------------------------------


def list_tables(spark: SparkSession, datadir: str, db_oid: int | None = None) -> DataFrame:
    t = tables(catalog(spark, datadir, db_oid))
    return t.select("oid", "schema", "table", "relfilenode", "relkind", "toastrelid", F.size("columns").alias("n_columns")).dropDuplicates(["schema", "table"])


def list_files(spark: SparkSession, datadir: str, db_oid: int | None = None) -> DataFrame:
    """The relation files of a database, with what pg_class says of each: left join on the file's number."""
    d, _ = database_dir(datadir, db_oid)
    files = spark.createDataFrame([(int(n), s) for n, s in relation_files(d)], "relfilenode long, bytes long")
    cls = catalog(spark, datadir, db_oid)["class"]
    cls = cls.select(F.when(F.col("relfilenode") == 0, F.col("oid")).otherwise(F.col("relfilenode")).alias("relfilenode"), "oid", "relname", "relkind")
    if not cls.take(1):  # line pointers are lost
        path = find_catalog(d, "pg_class", version_of(d), is_fork(d)) or f"{d}/{CATALOGS['pg_class']}"
        if size_of(path) > 0:
            found = [(r["relfilenode"], r["oid"], r["relname"], r["relkind"]) for r in carved_classes(path, version_of(d))]
            cls = spark.createDataFrame(found, "relfilenode long, oid long, relname string, relkind string")
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return files.join(cls, "relfilenode", "left").withColumn("kind", F.coalesce(kind[F.col("relkind")], F.lit("unknown")))


def list_databases(spark: SparkSession, datadir: str) -> DataFrame:
    """Directories of databases and names in pg_database, full outer: either may lack the other."""
    root = root_of(datadir)
    dirs = [(int(n),) for n, _, folder in listing(f"{root}/base") if folder and n.isdigit()]
    have = spark.createDataFrame(dirs, "oid long").withColumn("has_directory", F.lit(True))
    v, fork = version_of(root), is_fork(root)
    path = f"{root}/global/{CATALOGS['pg_database']}"
    if size_of(path) <= 0:
        path = find_catalog(f"{root}/global", "pg_database", v, fork) or ""
    names = catalog_frame(spark, path, "pg_database", v, fork).select("oid", F.col("datname").alias("name"), "encoding") if path else spark.createDataFrame([], "oid long, name string, encoding int")
    return have.join(names, "oid", "full_outer").withColumn("has_directory", F.coalesce("has_directory", F.lit(False)))
