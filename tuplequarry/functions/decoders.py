"""Decoders as vectorised SQL functions: pg_decode_<type>(bytes) gives the text, with others for compressed bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..kernel.compress import Corrupt, lz4_decompress, pglz_decompress
from ..kernel.text import RENDER, Decoder, fallback
from ..layout import TYPES


def decoder(oid: int, encoding: str = "utf-8", enums: dict | None = None, roles: dict | None = None):
    """A vectorised function from a type's bytes (without header) to text; undecodable bytes as for unknown types."""

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        d = Decoder(encoding, enums, roles)

        def one(b):
            if b is None:
                return None
            try:
                return d.text(oid, bytes(b))
            except Exception:
                return fallback(bytes(b))

        return values.map(one, na_action="ignore")

    return decode


def decompressor(method: str):
    """A vectorised function from a compressed stream and the size it should have to its bytes, or null."""
    f = {"pglz": pglz_decompress, "lz4": lz4_decompress}[method]

    @F.pandas_udf("binary")
    def decompress(values: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([_or_none(f, b, n) for b, n in zip(values, sizes, strict=True)], dtype=object)

    return decompress


def _or_none(f, b, n):
    try:
        return None if b is None or n is None else f(bytes(b), int(n))
    except Corrupt:
        return None


def register(spark: SparkSession, encoding: str = "utf-8") -> None:
    for oid, t in TYPES.items():
        if oid in RENDER or t.elem:
            name = f"{TYPES[t.elem].name}_array" if t.elem else t.name
            spark.udf.register(f"pg_decode_{name}", decoder(oid, encoding))
    spark.udf.register("pglz_decompress", decompressor("pglz"))
    spark.udf.register("lz4_block_decompress", decompressor("lz4"))
