"""Out-of-line values by a join: the way for storage relations too large to be loaded by each process."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernel.columns import Columnar, arrow_type, finish, spark_type
from ..kernel.text import fallback
from ..layout import TOAST, Context
from ..sources.pgheap import ensure_registered, plan_to_json
from ..sources.scan import DIRECT_BYTES, Plan, assembled, probe

__all__ = ["DIRECT_BYTES", "chunks", "resolve", "values"]


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, chunk_seq, chunk_data of a storage relation, deleted chunks too."""
    ensure_registered(spark)
    size, psv = probe(path)
    plan = Plan(Context(TOAST, size, psv), rows="all")
    return spark.read.format("pgheap").option("path", path).option("plan", plan_to_json(plan)).load()


def values(chunk_rows: DataFrame) -> DataFrame:
    """valueid and its chunks in order; one value's chunks are at most 1 GB together, by the format."""
    part = F.struct(F.col("chunk_seq").alias("seq"), F.col("chunk_data").alias("data"))
    return chunk_rows.where("chunk_id is not null and chunk_seq >= 0 and octet_length(chunk_data) > 0").groupBy(F.col("chunk_id").alias("valueid")).agg(F.array_sort(F.collect_list(part)).alias("parts"))


def resolve(df: DataFrame, chunk_rows: DataFrame, ctx: Context) -> DataFrame:
    """Fills the columns whose values are out of line. df was read with pointers handed on (columns _ext_<name>).

    One scan of the relation, one join with the values: a row travels with its first pointer, its other pointers travel
    alone, and all meet again under the row's number. Rows without pointers get keys of their own that no value has, so
    that they are spread."""
    ext = [x[5:] for x in df.columns if x.startswith("_ext_")]
    if not ext:
        return df
    # deterministic for a stable input: the place of a row in its range of pages
    pointers = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`_ext_{n}`.valueid").alias("valueid")) for k, n in enumerate(ext)]), lambda p: p["valueid"].isNotNull())
    rows = df.withColumns({"__row": F.monotonically_increasing_id(), "__pointers": pointers})
    rows = rows.select("__row", F.struct(*[F.col(f"`{x}`") for x in df.columns]).alias("own"), F.posexplode_outer("__pointers").alias("at", "p"))
    rows = rows.select("__row", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("own")).alias("own"), F.col("p.k").alias("k"), F.coalesce("p.valueid", -1 - F.col("__row")).alias("valueid"))
    met = rows.join(values(chunk_rows), "valueid", "left").groupBy("__row")
    met = met.agg(F.first("own", ignorenulls=True).alias("own"), F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "parts"))).alias("__values")).select("own.*", "__values")
    live = {c.name: c for c in ctx.table.live}
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = [x for x in df.columns if not x.startswith("_ext_")]
    schema = ", ".join(f"`{x.replace('`', '``')}` {spark_type(live[x], ctx) if x in ext else fields[x]}" for x in out)
    return met.mapInArrow(_fill(ctx, [live[x] for x in ext], out), schema)


def _fill(ctx: Context, columns: list, out: list[str]):
    kinds = [spark_type(c, ctx) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columnar = Columnar(ctx)

        def value(c, kind: str, pointer: dict, parts) -> tuple:
            data = b""
            try:
                oid = ctx.table.resolved(c.type_oid)
                data = finish(pointer, assembled([(x["seq"], x["data"]) for x in parts]) if parts else None)
                return columnar.value(oid, data, c.typmod) if ctx.mode == "typed" else columnar.decoder.text(oid, data), None
            except LookupError as e:
                return None, e.args[0] if str(e.args[0]).startswith("TOAST") else "UNDECODED"
            except ValueError:
                return fallback(data) if kind == "string" else None, "UNDECODED"

        for b in batches:
            done = {x: b[x] for x in out}
            parts = [{x["k"]: x["parts"] for x in v} for v in b["__values"].to_pylist()]
            status: dict[int, list[str]] = {}
            for k, (c, kind) in enumerate(zip(columns, kinds, strict=True)):
                at = [i for i, v in enumerate(parts) if k in v]
                if not at:
                    continue
                filled = []
                for i in at:
                    x, code = value(c, kind, b[f"_ext_{c.name}"][i].as_py(), parts[i][k])
                    filled.append(x)
                    if code:
                        status.setdefault(i, []).append(f"{c.name}:{code}")
                place = list(range(b.num_rows))
                for j, i in enumerate(at):
                    place[i] = b.num_rows + j
                done[c.name] = pa.concat_arrays([b[c.name], pa.array(filled, arrow_type(kind)).cast(b[c.name].type)]).take(pa.array(place))
            if status and "_decode_status" in done:
                old = done["_decode_status"].to_pylist()
                done["_decode_status"] = pa.array([";".join([x] * bool(x) + status.get(i, [])) or None for i, x in enumerate(old)], pa.string())
            yield pa.RecordBatch.from_arrays(list(done.values()), list(done))

    return run
