"""Best-fit packing of token sequences into bins with several capacities.

A bin has three capacities: tokens, documents, and attention cost (the sum of squared lengths). Pieces go in from the
longest to the shortest, each into the open bin that suits it best among those where it fits by every capacity:

* ``rule="norm"``: the smallest weighted norm of what would be left (residual vector relative to the capacities);
* ``rule="dot"``: the largest weighted dot product of the piece's needs and the bin's residual.

A piece's needs follow from its length alone, so packing is done on the histogram of lengths (at most ``capacity``
classes, whatever the corpus), and on *groups of equal bins*: one step places a class into a whole group, splitting it
only where the class runs out. The driver holds the histogram and the groups; the pieces stay distributed. A step yields
a run "the k-th to k+n-th piece of this length go to bins b to b+n at this offset"; pieces find their run by their rank
within their length. Ranks come from counts by (length, bucket), buckets being dealt by hash, so that a length with a
third of all pieces is numbered in many tasks.

Only documents longer than the capacity are cut, from the end: the first piece takes the remainder.

Edge cases: null text is empty, an empty text is one piece that holds the end token alone; repeated rows are packed as
often as they occur; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, cut, large, tidy

CAPACITY, END, TOKENIZER = 1024, 2, "byte_bpe_50k"
BUCKET = 100_000  # pieces that are ranked together, about


def tokenizer_files(name: str = TOKENIZER) -> tuple[str, str, str]:
    """The tokenizer file, the same vocabulary as ranks, and the pattern that splits text."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN


def encoder(files: tuple[str, str, str]):
    """text -> ids of the tokenizer file. Plain text goes through the ranks, which give equal ids several times faster;
    text that may hold a special token's string, or that the fast path refuses, goes through the file itself."""
    return large(("encoder", files), lambda: _encoder(files))


def _encoder(files: tuple[str, str, str]):
    import base64
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(files[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=files[2], mergeable_ranks=ranks, special_tokens={})
    with open(files[0], encoding="utf-8") as f:
        special = [x["content"] for x in json.load(f).get("added_tokens", [])]
    slow: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if not any(x in text for x in special):
            try:
                return fast.encode_ordinary(text)
            except ValueError:
                pass
            except BaseException as e:  # the extension's panics on some extreme texts are no Exception
                if type(e).__name__ != "PanicException":
                    raise
        if not slow:
            slow.append(Tokenizer.from_file(files[0]))
        return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def _cut_pieces(capacity: int, files: tuple[str, str, str], end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(files)
        names = ["id", "piece", "start", "length", "ids_crc32"]
        for b in batches:
            ids, rows = [], []
            for i, text in zip(b["id"], b["text"], strict=True):
                x = np.array([*encode(text.as_py() or ""), end], "<u4")
                at = [0, *range(len(x) % capacity or capacity, len(x), capacity), len(x)]
                for k, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    ids.append(i.as_py())
                    rows.append((k, s, e - s, zlib.crc32(x[s:e].tobytes())))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids, b["id"].type), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.int64()] * 3), strict=True))], names)

    return run


def pack_histogram(counts: dict[int, int], capacity: int, max_docs: int, max_cost: int, weights=(1.0, 0.5, 0.5), rule: str = "norm") -> dict[int, list[tuple[int, int, int]]]:
    """{length: [(rank of the run's first piece, its bin, offset in the bins)]}; each run's bins are consecutive."""
    cap = np.array([capacity, max_docs, max_cost], float)
    w = np.array(weights)
    runs: dict[int, list] = defaultdict(list)
    # Open groups of equal bins: residuals, first bin, number of bins.
    left = np.zeros((0, 3), np.int64)
    first, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
    bins = 0
    lengths = sorted((k for k, n in counts.items() if n), reverse=True)
    for length in lengths:
        need = np.array([length, 1, length * length])
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        n, rank = counts[length], 0
        while n:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if len(fits):
                if rule == "norm":
                    g = fits[np.argmin(((((left[fits] - need) / cap) ** 2) * w).sum(axis=1))]
                else:
                    g = fits[np.argmax((left[fits] / cap * (need / cap) * w).sum(axis=1))]
                k = min(n, int(many[g]))
                runs[length].append((rank, int(first[g]), capacity - int(left[g, 0])))
                rest = left[g] - need
                if k == many[g]:
                    left[g] = rest
                else:
                    left, first, many = np.vstack([left, rest]), np.append(first, first[g]), np.append(many, k)
                    first[g] += k
                    many[g] -= k
            else:
                k = n
                runs[length].append((rank, bins, 0))
                left, first, many = np.vstack([left, (cap - need).astype(np.int64)]), np.append(first, bins), np.append(many, k)
                bins += k
            n, rank = n - k, rank + k
        least = np.array([lengths[-1], 1, lengths[-1] ** 2])
        keep = (left >= least).all(axis=1)
        left, first, many = left[keep], first[keep], many[keep]
    return dict(runs)


def _place(runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                o = np.flatnonzero(length == x)
                start, bins, offset = runs[int(x)]
                k = np.searchsorted(start, rank[o], side="right") - 1
                seq[o], off[o] = bins[k] + rank[o] - start[k], offset[k]
            yield pa.RecordBatch.from_arrays([*(b[x] for x in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, end: int = END, files: tuple[str, str, str] | None = None, rule: str = "norm") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset. Capacities left out never bind."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = cut(d.mapInArrow(tidy(_cut_pieces(capacity, files or tokenizer_files(), end)), schema), "pieces")

    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = pack_histogram(histogram, capacity, max_docs or capacity, max_cost or capacity * capacity, rule=rule)
    table = {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}

    buckets = max(1, -(-sum(histogram.values()) // BUCKET))
    # Equal pieces of equal ids tie; they are alike, so any order of them gives the same rows.
    p = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = p.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32"))
    ranked = p.withColumn("own", own).join(sizes, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    names = ["id", "piece", "start", "length", "ids_crc32"]
    out = ranked.select(*names, F.col("rank").cast("long").alias("rank"))
    return out.mapInArrow(tidy(_place(table, names)), f"{schema}, sequence_id long, offset long").withColumnRenamed("id", id_col)
