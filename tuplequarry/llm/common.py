"""What the training-data operators share: shared folder, id filters, vectorised word kernels, components.

The kernels work on UTF-8 bytes, many documents in one buffer, with NumPy; a slice holds whole documents, about
``SLICE`` bytes of them, so that memory follows the slice and the largest single document, not the Arrow batch.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 1 << 18
BATCH_BYTES = 2 << 20  # of the Arrow batches that tasks exchange with Python: both ends hold a few of them, off heap in the JVM
BROADCAST_IDS = 2_000_000  # 64-bit ids that may be broadcast; above it the same join shuffles
MISSING = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts by size too, so that long texts do not make large batches."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def process_cache() -> dict:
    """A cache of this Python process. Module globals would not do: functions travel by value, one copy a task."""
    return sys.__dict__.setdefault("_tuplequarry_cache", {})


def large(key, make):
    """The one large object (model, tokenizer, table) that this process keeps: workers outlive tasks and operators."""
    cache = process_cache()
    if cache.get("large", (None,))[0] != key:
        cache["large"] = None, None  # the old one goes first
        cache["large"] = key, make()
    return cache["large"][1]


# --- the shared folder -----------------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset (local mode)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = process_cache().get("own_dir")
        if not d:
            own = f"{tempfile.gettempdir()}/tuplequarry-{uuid.uuid4().hex}"
            d = process_cache()["own_dir"] = f"file://{own}"
            atexit.register(shutil.rmtree, own, True)
    return d.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tuplequarry/{name}-{uuid.uuid4().hex}"
    process_cache().setdefault("scopes", {}).setdefault(process_cache().get("scope"), []).append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def enter_scope(spark: SparkSession, scope: str, done: tuple[str, ...] = ()) -> None:
    """Tables cut from now on belong to scope; those of the scopes in done are deleted."""
    trim_driver(spark)
    scopes = process_cache().setdefault("scopes", {})
    for x in done:
        for path in scopes.pop(x, []):
            delete(spark, path)
    process_cache()["scope"] = scope


def keep_ids(df: DataFrame, ids: DataFrame, key: str, bound: int = BROADCAST_IDS) -> DataFrame:
    """Rows of df whose key is in ids (one column named key). ids is broadcast only if it has at most bound rows."""
    ids = ids.distinct()
    if ids.limit(bound + 1).count() <= bound:
        return df.join(F.broadcast(ids), key, "left_semi")
    return df.join(ids.hint("merge"), key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str, bound: int = BROADCAST_IDS) -> DataFrame:
    """Rows of df whose key is not in ids; broadcast as in keep_ids."""
    ids = ids.distinct()
    if ids.limit(bound + 1).count() <= bound:
        return df.join(F.broadcast(ids), key, "left_anti")
    return df.join(ids.hint("merge"), key, "left_anti")


# --- Arrow helpers ---------------------------------------------------------------------------------------------------


def release_memory() -> None:
    """Gives freed memory back to the system: a worker waits for its next task with all that its last one has touched."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trim_driver(spark: SparkSession) -> None:
    """release_memory for the driver, its JVM included: what that frees outside its heap (compilers take tens of MB for a
    plan's code, on several threads) malloc keeps. HotSpot has a command for it from JDK 17.0.9 on; other JVMs stay as they are."""
    release_memory()
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array

    def of(kind, *values):
        out = array(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    with contextlib.suppress(Exception):
        lang, named = jvm.java.lang, jvm.java.lang.Class.forName
        # by the interface's method: the server's own class is in no exported package
        types = of(lang.Class, *map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        invoke = named("javax.management.MBeanServer").getMethod("invoke", types)
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        none, signature = of(lang.Object, None), of(lang.String, "[Ljava.lang.String;")
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), of(lang.Object, bean, "systemTrimNativeHeap", none, signature))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow that releases the worker's memory when its task is done."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return tidied


def as_bytes(column: pa.Array) -> list[bytes]:
    """Values of a binary column; null is empty."""
    return [x or b"" for x in column.to_pylist()]


def slices(docs: list[bytes], size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents, of about size bytes each."""
    start = total = 0
    for i, x in enumerate(docs):
        total += len(x) + 1
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(docs):
        yield start, len(docs)


def int64(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


# --- hashing ---------------------------------------------------------------------------------------------------------


def mix(a: np.ndarray, b) -> np.ndarray:
    """64-bit hash of a pair of 64-bit values, elementwise."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def byte_codes() -> np.ndarray:
    """A fixed pseudo-random 64-bit value for each byte."""
    x = mix(np.arange(1, 257, dtype=np.uint64), np.uint64(0x51ED270B35F1A3C5))
    return mix(x, np.uint64(0xC2B2AE3D27D4EB4F))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n, of one odd B."""
    cache = process_cache()
    if "powers" not in cache or len(cache["powers"][0]) < n:
        out = []
        b = 0x9FB21C651E98DF25 | 1
        for base in (b, pow(b, -1, 1 << 64)):
            p = np.ones(1, np.uint64)
            while len(p) < n:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            out.append(p)
        cache["powers"] = tuple(out)
    return cache["powers"][0][:n], cache["powers"][1][:n]


# Separators between words: ASCII white space; for alphanumeric words, all ASCII but digits and letters.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_ALNUM = np.array([x < 0x30 or 0x3A <= x <= 0x60 or 0x7B <= x <= 0x7F for x in range(256)])


def ascii_lower(a: np.ndarray) -> np.ndarray:
    return a + ((a >= 65) & (a <= 90)).astype(np.uint8) * np.uint8(32)


class Words:
    """Words of several documents: byte ranges and 64-bit hashes of the words, and each document's range of words."""

    def __init__(self, docs: list[bytes], separators: np.ndarray, lower: bool):
        buf = np.frombuffer(b"\n".join([*docs, b""]), np.uint8)  # a separator after each
        a = ascii_lower(buf) if lower else buf
        edge = np.diff((~separators[a]).view(np.int8), prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.bytes = a
        up, down = powers(len(a) + 1)
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_codes()[a] * up[: len(a)])])
        self.hash = mix((c[self.end] - c[self.start]) * down[self.start], (self.end - self.start).astype(np.uint64))
        stops = np.cumsum(np.fromiter((len(x) + 1 for x in docs), np.int64, len(docs)))
        at = np.searchsorted(self.start, np.concatenate([[0], stops]))
        self.first, self.last = at[:-1], at[1:]  # of document i: words first[i] to last[i] - 1

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first)), self.last - self.first)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; valid where these are in one document."""
        h = self.hash
        out = mix(h, np.uint64(k))
        for i in range(1, k):
            nxt = np.zeros_like(h)
            nxt[: max(len(h) - i, 0)] = h[i:]
            out = mix(out, nxt)
        return out


# --- connected components --------------------------------------------------------------------------------------------


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition reduced, a batch at a time, to stars around the smallest node of each component."""
    for b in batches:
        parent: dict[int, int] = {}

        def find(x: int, parent=parent) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True):
            u, v = find(u), find(v)
            parent[max(u, v)] = min(u, v)
        pairs = [(x, r) for x in list(parent) if (r := find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, comp): the smallest node of each component of edges (u, v). Nodes without edges are absent.

    Alternating large-star and small-star rounds; each aggregates per node with map-side combining, is cut to the
    shared folder, and the rounds end when the edges are stars. Nothing is collected but a count and a checksum.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(edges.mapInArrow(tidy(_local_forest), "u long, v long").distinct(), f"{name}-edges")
    state = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = moved.union(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small, f"{name}-edges")
        now = state(e)
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        before = now
