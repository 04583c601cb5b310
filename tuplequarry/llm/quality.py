"""Quality filtering by weak supervision: rules vote or abstain, and the posterior decides.

Each rule looks at one feature and votes good, bad or nothing. Votes are packed into one number, and documents are
counted by it (at most 3 ** rules patterns, whatever the corpus). Expectation-maximisation on these counts estimates how
often each rule votes for and against the hidden class and the class's prior; a pattern's posterior probability of good
then stands for all its documents. Rules that are known to be hard (``base``) still fail a document alone.

EM starts from rules that are right with ``START`` and from a prior of ``PRIOR``, and every estimate is smoothed with
pseudo-counts of that start. That fixes which class is called good.

Edge cases: null and empty texts have no words and fail the base; ties at the threshold are kept; repeated rows get equal
verdicts and come out as often as they went in; an empty table gives an empty result; with no votes the prior decides;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Words, as_bytes, bound_batches, cut, mix, slices, tidy

SYMBOLS = b"#*$%&|<>"
START, PRIOR, PSEUDO, ROUNDS, THRESHOLD = 0.8, 0.8, 50.0, 60, 0.5
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_digits", "n_distinct"]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = np.arange(256)
    lead = (codes & 0xC0) != 0x80  # bytes that begin a character
    kinds = {"n_symbols": np.isin(codes, list(SYMBOLS)), "n_upper": (codes >= 65) & (codes <= 90), "n_digits": (codes >= 48) & (codes <= 57)}
    kinds["n_letters"] = kinds["n_upper"] | ((codes >= 97) & (codes <= 122)) | (codes >= 0xC0)
    for b in batches:
        docs = as_bytes(b["b"])
        parts: list[np.ndarray] = []
        for i, j in slices(docs):
            some = docs[i:j]
            w = Words(some, SPACE, False)
            n = w.last - w.first
            stop = np.cumsum([len(x) + 1 for x in some])
            bound = np.concatenate([[0], stop])
            per = lambda flag, bound=bound: np.diff(np.concatenate([[0], np.cumsum(flag)])[bound])
            out = {"n_words": n, "word_chars": per((lead & ~SPACE)[w.bytes]), **{k: per(v[w.bytes]) for k, v in kinds.items()}}
            doc = w.doc_of()
            # words in a three-word window found twice in its text
            full = np.arange(len(doc)) + 3 <= w.last[doc] if len(doc) else np.zeros(0, bool)
            at = np.flatnonzero(full)
            key = mix(w.grams(3)[at], doc[at].astype(np.uint64))
            _, place, count = np.unique(key, return_inverse=True, return_counts=True)
            hit = np.zeros(len(doc) + 3, bool)
            for k in range(3):
                hit[at[count[place] > 1] + k] = True
            out["n_repeat_words"] = np.bincount(doc[hit[: len(doc)]], minlength=len(some)) if len(doc) else np.zeros(len(some), np.int64)
            _, first = np.unique(mix(w.hash, doc.astype(np.uint64)), return_index=True)
            out["n_distinct"] = np.bincount(doc[first], minlength=len(some)) if len(doc) else np.zeros(len(some), np.int64)
            dup = []
            for x in some:
                lines = x.split(b"\n")
                dup.append(len(y) - len(set(y)) if len(lines) > 1 and (y := [z for z in lines if z.strip(b" \t\n\v\f\r")]) else 0)
            out["n_dup_lines"] = np.array(dup)
            parts.append(np.stack([out[k] for k in FEATURES]).astype(np.int64))
        all_ = np.concatenate(parts, axis=1) if parts else np.zeros((len(FEATURES), 0), np.int64)
        yield pa.RecordBatch.from_arrays([b["id"], *(pa.array(x) for x in all_)], ["id", *FEATURES])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("b"))
    return d.mapInArrow(tidy(_features), f"id {kind}, " + ", ".join(f"{x} long" for x in FEATURES)).withColumnRenamed("id", id_col)


def default_rules() -> list[tuple[str, Column, Column]]:
    """(name, votes bad, votes good); neither: the rule abstains. The absence of a defect is no vote for good, except
    where most good texts are alike in it; each kind of defect shows in more than one rule, which EM needs."""
    c = F.col
    per_word = lambda x, n: 100 * x > n * c("n_words")
    marks = c("word_chars") - c("n_letters") - c("n_digits")
    never = F.lit(None).cast("boolean")
    return [
        ("length", c("n_words") < 50, c("n_words") >= 100),
        ("repetition", per_word(c("n_repeat_words"), 30), never),
        ("symbols", per_word(c("n_symbols"), 20), never),
        ("marks", per_word(marks, 45), ~per_word(marks, 30)),
        ("letters", 100 * c("n_letters") < 88 * c("word_chars"), 100 * c("n_letters") > 93 * c("word_chars")),
        ("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 14 * c("n_words")), never),
        ("upper_case", 100 * c("n_upper") > 30 * c("n_letters"), never),
        ("digits", 100 * c("n_digits") > 20 * c("word_chars"), never),
        ("lines", c("n_dup_lines") > 2, never),
        ("variety", 100 * c("n_distinct") < 20 * c("n_words"), 100 * c("n_distinct") > 40 * c("n_words")),
    ]


def fit(patterns: list[int], counts: list[int], rules: int, start: float = START, prior: float = PRIOR, pseudo: float = PSEUDO, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior probability of good of each pattern; a pattern's base-3 digits are 0 nothing, 1 bad, 2 good."""
    votes = np.array([[p // 3**k % 3 for k in range(rules)] for p in patterns], int).reshape(len(patterns), rules)
    n = np.array(counts, float)
    # table[y, k, v]: probability that rule k votes v on class y (0 bad, 1 good), given that it votes; nothing tells nothing.
    first = np.array([[[0, start, 1 - start]] * rules, [[0, 1 - start, start]] * rules])
    first[:, :, 0] = 1
    table, good = first.copy(), prior
    post = np.full(len(n), prior)
    for _ in range(rounds):
        like = np.log(table[:, np.arange(rules)[None, :], votes]).sum(axis=2) + np.log([[1 - good], [good]])
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -700, 700)))
        good = (n @ post + pseudo * prior) / (n.sum() + pseudo)
        for y, weight in ((0, n * (1 - post)), (1, n * post)):
            seen = np.stack([(weight[:, None] * (votes == v)).sum(axis=0) for v in (1, 2)]) + pseudo * first[y, :, 1:].T
            table[y, :, 1:] = (seen / seen.sum(axis=0)).T
    return post


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: id, the features, base_failed, posterior and kept."""
    if base is None:
        base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rules = default_rules()
    code = sum((F.when(F.coalesce(bad, F.lit(False)), 3**k).when(F.coalesce(good, F.lit(False)), 2 * 3**k).otherwise(0) for k, (_, bad, good) in enumerate(rules)), F.lit(0))
    f = cut(features(docs, id_col, text_col).withColumn("votes", code.cast("int")), "quality-features")
    rows = f.groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3 ** rules
    post = fit([r.votes for r in rows], [r.n for r in rows], len(rules)).tolist() if rows else []
    spark = docs.sparkSession
    table = spark.createDataFrame([(r.votes, p) for r, p in zip(rows, post, strict=True)], "votes int, posterior double")
    out = f.join(F.broadcast(table), "votes", "left").withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).drop("votes")
