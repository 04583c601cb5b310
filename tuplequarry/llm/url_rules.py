"""URL allow and block rules by a sort-merge range join, in DataFrame functions only.

A rule is (host, path prefix, verdict). It fits its host and all subdomains where the url's path starts with the prefix;
the longest fitting rule (host and path together; of equally long ones that with the longer host) wins.

* Canonical keys: labels of a host reversed (``com.example``) followed by the path. For each suffix of a url's host there
  is one key, so "host or subdomain" is equality of the reversed part, and a rule is the interval of the keys that start
  with its own key: from the key to the key followed by byte FF.
* Intervals of prefixes nest, so the rules' ends sorted by key are pushes to and pops from a stack. Each end carries what
  lies on top of the stack after it: the rule itself after a push, the longest rule around it after a pop.
* One sorted sweep over rule ends and urls hands each url key the last top before it, the longest rule at that level;
  the levels of a url are then reduced to its longest rule.

Partitions: rule ends are cut into tiles of ``tile`` ends, each tile opening with the top that is carried into it; url
keys are spread over salts within their tile, and a tile's ends are repeated once a salt. A hot host, or one with a third
of all urls, is so dealt over all salts, and no task holds more than a tile's ends beside its share of urls.

Edge cases: a null url, or one without ``://``, has empty host and path, fits no rule and gets the default verdict;
port and user info are part of the host; empty labels are kept (``com.`` is not ``com``); repeated urls come out as often
as they went in; no rules: all get the default verdict; an empty table gives an empty result. Rules that
repeat a host and path are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = 64
FEW_RULES = 10_000  # up to so many rule hosts are a literal that thins out the levels of urls


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    lit = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if not rules:
        return spark.sql("select '' as host, '' as path, '' as verdict where false")
    return spark.sql(f"select * from values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rules)} as t(host, path, verdict)")


def _ends(rules: DataFrame) -> DataFrame:
    """Both ends of each rule's interval: k, order (0 opens, 2 closes) and top, the rule on the stack after it."""
    text = F.concat("host", "path")
    top = F.struct(F.length(text).alias("size"), F.length("host").alias("host_size"), text.alias("rule"), "verdict")
    r = rules.select(F.concat(_reversed_host(F.col("host")), "path").cast("binary").alias("k"), top.alias("top"))
    # The longest rule around a rule: the longest other key that is a prefix of its own.
    size = F.octet_length("k")
    inner = r.select(F.col("k").alias("inner"), F.explode(F.sequence(F.lit(1), size)).alias("i")).where(F.col("i") < F.octet_length("inner"))
    outer = inner.withColumn("k", F.expr("substring(inner, 1, i)")).join(r, "k").groupBy(F.col("inner").alias("k")).agg(F.max_by("top", "i").alias("around"))
    opened = r.select("k", F.lit(0).alias("order"), "top")
    closed = r.select("k").join(outer, "k", "left").select(F.concat("k", F.lit(b"\xff")).alias("k"), F.lit(2).alias("order"), F.col("around").alias("top"))
    return opened.union(closed)


def match_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", salts: int | None = None, tile: int = 4096) -> DataFrame:
    """Per url: id, host, path, rule (null where none fits) and verdict."""
    spark = urls.sparkSession
    salts = salts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if rules.groupBy("host", "path").count().where("count > 1").take(1):
        raise ValueError("rules repeat a host and path")
    ends = _ends(rules)

    # Tiles. Rules are the small side: their ends are numbered in order by the sizes of range partitions.
    n_ends = ends.count()
    if n_ends <= tile:
        starts = []
    else:
        # quantiles of the keys; any ascending list will do as tile bounds, its size is n_ends / tile
        step = F.pmod(F.xxhash64("k"), F.lit(tile)) == 0
        starts = [bytes(x.k) for x in ends.where(step).select("k").distinct().orderBy("k").collect()]

    def tile_of(k: Column) -> Column:
        """How many tile bounds are at or before the key: first among every 64th bound, then among the 64 behind it."""
        if not starts:
            return F.lit(0)
        before = lambda some: F.size(F.filter(some, lambda x: x <= k))
        lits = lambda some: F.array(*[F.lit(x) for x in some])
        if len(starts) <= STEP:
            return before(lits(starts))
        base = F.greatest(before(lits(starts[::STEP])) - 1, F.lit(0)) * STEP
        return base + before(F.slice(lits(starts), base + 1, F.lit(STEP)))

    ends = ends.withColumn("tile", tile_of(F.col("k")))
    if starts:
        # Carried into a tile: the longest rule whose interval is open at its bound, that is, whose key is a prefix of it.
        tops = ends.where("order = 0")
        bounds = spark.createDataFrame([(i + 1, x) for i, x in enumerate(starts)], "tile int, bound binary")
        prefix = bounds.select("tile", "bound", F.explode(F.sequence(F.lit(1), F.octet_length("bound"))).alias("i")).withColumn("k", F.expr("substring(bound, 1, i)"))
        carried = prefix.join(tops.select("k", "top"), "k").groupBy("tile", "bound").agg(F.max_by("top", "i").alias("top"))
        # before every end and url at the bound itself
        ends = ends.union(carried.select(F.col("bound").alias("k"), F.lit(-1).alias("order"), "top", "tile"))
    none = F.lit(None)
    ends = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    ends = ends.select("tile", "salt", "k", "order", "top", none.cast("string").alias("id"), none.cast("string").alias("host"), none.cast("string").alias("path"), none.cast("int").alias("levels"))
    kind = urls.schema[id_col].dataType
    ends = ends.withColumn("id", F.col("id").cast(kind))

    # A key for each suffix of the host that some rule has, or one null key.
    u = urls.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    labels = F.split("host", r"\.", -1)
    levels = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(F.reverse(labels), F.lit(1), i), "."))
    hosts = [x.h for x in rules.select(_reversed_host(F.col("host")).alias("h")).distinct().limit(FEW_RULES + 1).collect()]
    if len(hosts) <= FEW_RULES:
        levels = F.array_intersect(levels, F.array(*map(F.lit, hosts)).cast("array<string>"))
    u = u.withColumn("keys", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(levels))
    u = u.withColumn("levels", F.greatest(F.size("keys"), F.lit(1))).withColumn("level", F.explode_outer("keys"))
    u = u.withColumn("k", F.concat("level", "path").cast("binary"))
    u = u.select(F.when(F.col("k").isNull(), 0).otherwise(tile_of(F.col("k"))).alias("tile"), F.pmod(F.xxhash64("id", "path"), F.lit(salts)).cast("int").alias("salt"), "k", F.lit(1).alias("order"), none.cast(ends.schema["top"].dataType).alias("top"), "id", "host", "path", "levels")

    # Null keys sort before all ends, and so find no top.
    sweep = Window.partitionBy("tile", "salt").orderBy(F.col("k").asc_nulls_first(), "order").rowsBetween(Window.unboundedPreceding, 0)
    # A pop to an empty stack must hide earlier tops: the whole end is carried, not its top.
    at_end = F.when(F.col("order") != 1, F.struct("top"))
    swept = ends.unionByName(u).withColumn("found", F.last(at_end, ignorenulls=True).over(sweep)).where("order = 1")
    best = swept.groupBy("id", "host", "path").agg(F.max("found.top").alias("top"), (F.count("*") / F.max("levels")).cast("int").alias("times"))
    best = best.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
