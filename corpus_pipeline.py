"""The corpus pipeline: five stages over documents, each applying one operator to all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. What a
stage returns is written as Parquet and read again as the next one's docs.

Rows without a doc_id are judged as others are, under a key that stages make of their text; they come out without id.
Null texts are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplequarry.llm.common import cut, drop_ids, enter_scope, fresh_path, keep_ids, table
from tuplequarry.llm.decontam import find_benchmark
from tuplequarry.llm.jaccard import near_duplicates
from tuplequarry.llm.langid import identify, train
from tuplequarry.llm.packing import pack_documents
from tuplequarry.llm.suffix_dedup import LENGTH, PASSAGE, WORDS, remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SURE_ENOUGH = 0.5
KEYS = 1 << 62  # where keys of rows without id begin; ids are below
_NAMES = ("language", "near_duplicates", "repeats", "decontamination", "packing")


def _begin(spark: SparkSession, name: str) -> None:
    """Tables that earlier stages left in the shared folder are done with: what they returned has been written."""
    at = _NAMES.index(name)
    enter_scope(spark, f"pipeline-{name}", tuple(f"pipeline-{x}" for x in _NAMES[:at]))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the id in own_id, and in doc_id a key that each row has: the id, or one that the text names."""
    made = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(KEYS - 1)).bitwiseOR(F.lit(KEYS))
    return docs.withColumn("own_id", F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", made))


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("own_id").alias("doc_id"), *COLUMNS[1:])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID. Rejects documents whose language is undetermined or unsure; lang becomes the prediction."""
    _begin(spark, "language")
    held = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), F.lit(False))
    model = train(docs.where(~held), "doc_id", "text", "lang")
    named = identify(docs, model, carry=("text", "source", "n_chars")).where((F.col("lang_pred") != "und") & (F.col("score") >= SURE_ENOUGH))
    return named.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join. Of each group of near duplicates the document with the smallest id stays, once.

    Rows without id come after all ids, and those without words are copies of nothing."""
    _begin(spark, "near_duplicates")
    docs = _keyed(docs)
    groups = cut(near_duplicates(docs), "pipeline-groups")
    again = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_shingles").alias("words")).where((F.col("n") > 1) & ((F.col("words") > 0) | (F.col("doc_id") < KEYS))).select("doc_id")
    first = drop_ids(docs, groups.where("doc_id <> component_id").select("doc_id"), "doc_id")
    once = drop_ids(first, again, "doc_id")
    return _own(once).union(_own(keep_ids(first, again, "doc_id").dropDuplicates(["doc_id"])))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated substrings are cut out of the texts; a text of which nothing but white space is left goes.

    Cut are the bytes of repeated strings of LENGTH bytes, and of passages (runs of repeated strings of PASSAGE bytes) of
    more than WORDS words. Cuts fall between bytes; half characters at their edges are left out of the text."""
    _begin(spark, "repeats")
    docs = _keyed(docs)
    out = remove_repeats(docs, length=LENGTH, passage=PASSAGE, words=WORDS, passages_too=True)
    changed = cut(out.where("n_removed > 0").select("doc_id", "kept"), "pipeline-cut")
    same = _own(drop_ids(docs, changed.select("doc_id"), "doc_id"))
    kept = F.col("kept").cast("string")
    mended = F.regexp_replace(F.make_valid_utf8(kept), "\ufffd", "")
    text = F.coalesce(F.try_validate_utf8(kept), mended)
    # ids identify texts, so rows of one id were changed alike
    changed = changed.dropDuplicates(["doc_id"]).withColumn("new", text)
    others = keep_ids(docs, changed.select("doc_id"), "doc_id").select("doc_id", "own_id", "lang", "source").join(changed.select("doc_id", "new"), "doc_id")
    others = others.select(F.col("own_id").alias("doc_id"), F.col("new").alias("text"), "lang", "source", F.length("new").cast("long").alias("n_chars"))
    return same.union(others.where(F.trim(F.translate("text", "\t\n\u000b\f\r", "     ")) != ""))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    _begin(spark, "decontamination")
    docs = _keyed(docs)
    hit = cut(find_benchmark(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id"), "pipeline-hit")
    return _own(drop_ids(docs, hit, "doc_id"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left into sequences of 1024 tokens."""
    _begin(spark, "packing")
    return pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicate),
    ("suffix_array_dedup", repeats),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: Word models, components, suffix buckets and packing are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        enter_scope(spark, None)
        path = fresh_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    try:
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        enter_scope(spark, None)
