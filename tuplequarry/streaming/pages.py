"""A growing relation as a stream of its new pages."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..sources.pgheap import PAGES_PER_PARTITION, ensure_registered, plan_to_json
from ..sources.scan import Plan


def stream_plan(spark: SparkSession, path: str, plan: Plan, pages_per_partition: int = PAGES_PER_PARTITION) -> DataFrame:
    """Micro-batches by page number. A page is read once the relation has grown past it; its offset is kept by Spark's
    own checkpoint, so a restarted query goes on where it was."""
    ensure_registered(spark)
    text = plan_to_json(replace(plan, pointers=False))
    return spark.readStream.format("pgheap").option("path", path).option("plan", text).option("pagesPerPartition", str(pages_per_partition)).load()
