"""Visibility of recovered tuples as Catalyst expressions over the header columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernel.scan import IS_MULTI, LOCK_ONLY, XMAX_COMMITTED, XMAX_INVALID, XMIN_COMMITTED, XMIN_INVALID


def _bits(mask: int, infomask: Column) -> Column:
    return infomask.bitwiseAND(F.lit(mask))


def is_aborted(infomask: Column | None = None) -> Column:
    """The inserting transaction is known to have failed, and the tuple is not frozen."""
    return _bits(XMIN_COMMITTED | XMIN_INVALID, infomask if infomask is not None else F.col("_infomask")) == XMIN_INVALID


def is_deleted(infomask: Column | None = None, xmax: Column | None = None) -> Column:
    """Gone for a later transaction: not aborted, not merely locked, not a multixact. Without the commit log a set xmax
    without hint bits counts as committed."""
    im = infomask if infomask is not None else F.col("_infomask")
    x = xmax if xmax is not None else F.col("_xmax")
    return ~is_aborted(im) & (_bits(XMAX_INVALID | LOCK_ONLY | IS_MULTI, im) == 0) & ((_bits(XMAX_COMMITTED, im) != 0) | (x != 0))


def is_live(infomask: Column | None = None, xmax: Column | None = None) -> Column:
    return ~is_aborted(infomask) & ~is_deleted(infomask, xmax)


def first_seen(df: DataFrame, keys: list[str], order: tuple[str, ...] = ("_page", "_lp", "_pos")) -> DataFrame:
    """Of rows with equal keys the one that comes first in physical order."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def in_physical_order(df: DataFrame) -> DataFrame:
    return df.orderBy("_page", "_lp", "_pos")
