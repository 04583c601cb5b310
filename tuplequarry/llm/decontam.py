"""Benchmark passages in documents, by a prefix-filtered set join.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. A window is ``size`` consecutive
words of an item, or all of a shorter item. A document word inside any occurrence of any window is hit.

* Shingles: the ``shingle`` consecutive words inside a window (all of a window with fewer), as 64-bit hashes.
* Order: by rarity; how often each benchmark shingle occurs is counted over all documents first.
* Necessary prefix: a window must be contained whole, so all its shingles must be in the document, and its rarest one
  alone is a sufficient prefix. The documents' shingles are joined with these prefix tokens only.
* Bounds: a shared token fixes where the window would start and end; both must lie in the document.
* Verification: the hash of the item-sized stretch of the document, and then its very words.

Size: up to ``BLOCK`` windows are sent to all tasks, and documents are matched where they are read, without a shuffle.
With more windows nothing of the benchmark's size is sent: rarity comes from a sketch of fixed size, the prefix tokens
are a table, a bit map of fixed size says which shingles of documents may be among them, these are joined with the
table, and what passes the bounds is brought to its document's text and then joined with the windows by its very words.
Documents are read a fixed number of times, however large the benchmark is.

Edge cases: null and empty texts have no words and no hits; items without words have no windows; the same window in many
items counts for each of them; repeated documents come out as often as they went in (with several blocks: by equal ids
and texts); an empty benchmark hits nothing; null item ids are not listed; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, Words, as_bytes, bound_batches, cut, int64, large, slices, tidy
from .jaccard import CELLS, ROWS, WIDTH, sketch_cells, summed_sketch

SIZE, SHINGLE, BLOCK = 10, 3, 250_000


def _item_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            item, window = [], []
            for i, text in zip(b["item"].to_pylist(), as_bytes(b["b"]), strict=True):
                w = Words([text], NOT_ALNUM, True)
                words = [w.bytes[s:e].tobytes() for s, e in zip(w.start, w.end, strict=True)]
                found = {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else ()
                item += [i] * len(found)
                window += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(window, pa.binary())], ["item", "window"])

    return run


class _Block:
    """Some windows: their shingles, and after ``rank`` the necessary prefix token of each."""

    def __init__(self, windows: list[bytes], shingle: int):
        w = Words(windows, NOT_ALNUM, False)
        self.windows, self.first = windows, w.first
        self.length = w.last - w.first
        self.k = np.minimum(self.length, shingle)
        self.hash = np.zeros(len(windows), np.uint64)  # of the whole window
        for m in np.unique(self.length):
            o = np.flatnonzero(self.length == m)
            self.hash[o] = w.grams(int(m))[self.first[o]]
        per = self.length - self.k + 1
        self.of = np.repeat(np.arange(len(windows)), per)  # shingle's window, and place in it
        self.at = np.arange(len(self.of)) - np.repeat(np.cumsum(per) - per, per)
        self.token = np.zeros(len(self.of), np.uint64)
        for k in np.unique(self.k):
            o = np.flatnonzero(self.k[self.of] == k)
            self.token[o] = w.grams(int(k))[self.first[self.of[o]] + self.at[o]]
        self.tokens = np.unique(self.token)
        self.sizes = [int(x) for x in np.unique(self.k)]

    def rank(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        """Keeps of each window the rarest token (of equally rare ones that with the smallest hash)."""
        df = np.zeros(len(self.tokens), np.int64)
        df[np.searchsorted(self.tokens, tokens)] = counts
        o = np.lexsort((self.token, df[np.searchsorted(self.tokens, self.token)], self.of))
        lead = o[np.append(True, self.of[o][1:] != self.of[o][:-1])] if len(o) else o
        lead = lead[np.argsort(self.token[lead], kind="stable")]
        self.of, self.at, self.token = self.of[lead], self.at[lead], self.token[lead]
        self.tokens = np.unique(self.token)


def _matches(words: Words, k: int, tokens: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions whose k-word shingle is among tokens, and its place there."""
    h = words.grams(k)
    p = np.flatnonzero(table[(h & np.uint64(0xFFFF)).astype(np.int64)])
    i = np.searchsorted(tokens, h[p])
    ok = tokens[np.minimum(i, len(tokens) - 1)] == h[p]
    p, i = p[ok], i[ok]
    doc = np.searchsorted(words.last, p, side="right")
    ok = p + k <= words.last[doc]  # within its document
    return p[ok], i[ok]


def _table(tokens: np.ndarray) -> np.ndarray:
    t = np.zeros(1 << 16, bool)
    t[(tokens & np.uint64(0xFFFF)).astype(np.int64)] = True
    return t


def _count(block: _Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.tokens), np.int64)
        table = _table(block.tokens)
        for b in batches:
            docs = as_bytes(b["b"])
            for i, j in slices(docs):
                words = Words(docs[i:j], NOT_ALNUM, True)
                for k in block.sizes:
                    total += np.bincount(_matches(words, k, block.tokens, table)[1], minlength=len(total))
        o = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([int64(block.tokens[o]), int64(total[o])], ["token", "n"])

    return run


def _hits(block: _Block, items: list[list[str]], key: list[str]):
    """Per document: its key columns, n_words, the hit ranges of words, and the items found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(block.tokens)
        start = np.searchsorted(block.token, block.tokens)
        many = np.append(start[1:], len(block.token)) - start  # windows of each token
        for b in batches:
            docs = as_bytes(b["b"])
            n_words, ranges, found = [], [], []
            for i, j in slices(docs):
                words = Words(docs[i:j], NOT_ALNUM, True)
                n_words += (words.last - words.first).tolist()
                got: dict[int, list] = defaultdict(list)
                for k in block.sizes if len(block.tokens) else ():
                    p, t = _matches(words, k, block.tokens, table)
                    p, n = np.repeat(p, many[t]), many[t]
                    w = np.repeat(start[t], n) + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
                    window = block.of[w]
                    ok = block.k[window] == k
                    s, window = (p - block.at[w])[ok], window[ok]
                    doc = np.searchsorted(words.last, p[ok], side="right")
                    m = block.length[window]
                    ok = (s >= words.first[doc]) & (s + m <= words.last[doc])  # positional and length bounds
                    s, window, doc, m = s[ok], window[ok], doc[ok], m[ok]
                    for size in np.unique(m):
                        o = np.flatnonzero(m == size)
                        o = o[words.grams(int(size))[s[o]] == block.hash[window[o]]]
                        for x, y, d in zip(s[o].tolist(), window[o].tolist(), doc[o].tolist(), strict=True):
                            e = x + int(size)
                            if b" ".join(words.bytes[words.start[q] : words.end[q]].tobytes() for q in range(x, e)) == block.windows[y]:
                                first = int(words.first[d])
                                got[d].append((x - first, e - first, y))
                for d in range(j - i):
                    r = got.get(d, ())
                    ranges.append(sorted({(s, e) for s, e, _ in r}))
                    found.append(sorted({x for y in {y for *_, y in r} for x in items[y]}))
            kinds = (pa.int64(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.list_(pa.string()))
            ranges = [[{"s": s, "e": e} for s, e in r] for r in ranges]
            arrays = [*(b[x] for x in key), *(pa.array(x, t) for x, t in zip((n_words, ranges, found), kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [*key, "n_words", "ranges", "items"])

    return run


def _union_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hit, spans, digest, n_items = [], [], [], []
        for r, x in zip(b["ranges"].to_pylist(), b["items"].to_pylist(), strict=True):
            runs: list[list[int]] = []
            for y in sorted((y["s"], y["e"]) for y in r):
                if runs and y[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], y[1])
                else:
                    runs.append(list(y))
            hit.append(sum(e - s for s, e in runs))
            spans.append([{"s": s, "e": e} for s, e in runs])
            n_items.append(len(x))
            digest.append(hashlib.sha256(",".join(sorted(x)).encode()).hexdigest())
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b["id"], b["n_words"], pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, kind)], ["id", "n_words", "n_hit", "n_items", "items_sha256", "spans"])


BITS = 27  # of the place in the bit map


def _rarity(sizes: list[int]):
    """Blocks of a count-min sketch of the documents' shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((ROWS, WIDTH), np.int32)
        for b in batches:
            docs = as_bytes(b["b"])
            for i, j in slices(docs):
                words = Words(docs[i:j], NOT_ALNUM, True)
                for k in sizes:
                    for r, c in enumerate(sketch_cells(words.grams(k))):
                        sketch[r] += np.bincount(c, minlength=WIDTH).astype(np.int32)
        for x in range(ROWS * WIDTH // CELLS):
            part = sketch.ravel()[x * CELLS : (x + 1) * CELLS]
            if part.any():
                yield pa.RecordBatch.from_arrays([int64(np.array([x])), pa.array([part.tobytes()], pa.binary())], ["id", "cells"])

    return run


def _prefix_tokens(shingle: int, sketch: bytes):
    """(token, k, at, m): the rarest shingle of each window, its words, its place, and the window's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.frombuffer(sketch, np.uint32).reshape(ROWS, WIDTH)
        for b in batches:
            x = _Block(as_bytes(b["window"]), shingle)
            x.rank(x.tokens, np.minimum.reduce([s[r][c] for r, c in enumerate(sketch_cells(x.tokens))]))
            yield pa.RecordBatch.from_arrays([int64(x.token), *(pa.array(y.astype(np.int32)) for y in (x.k[x.of], x.at, x.length[x.of]))], ["token", "k", "at", "m"])

    return run


def _bit_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the bit map of prefix tokens, as sketch blocks: sums of zeros and ones."""
    seen = np.zeros(1 << BITS - 3, np.uint8)
    for b in batches:
        at = b["token"].to_numpy().view(np.uint64) >> np.uint64(64 - BITS)
        np.bitwise_or.at(seen, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
    for x in np.unique(np.flatnonzero(seen) // CELLS).tolist():
        yield pa.RecordBatch.from_arrays([int64(np.array([x])), pa.array([seen[x * CELLS : (x + 1) * CELLS].tobytes()], pa.binary())], ["id", "cells"])


def _or_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for x, cells in zip(b["id"].to_pylist(), b["cells"].to_pylist(), strict=True):
            c = np.frombuffer(cells, np.uint8)
            total[x] = total[x] | c if x in total else c
    for x, c in total.items():
        yield pa.RecordBatch.from_arrays([int64(np.array([x])), pa.array([c.tobytes()], pa.binary())], ["id", "cells"])


def _shingles(sizes: list[int], sent, key: str):
    """(h, token, k, p, first): shingles of documents whose bit is set, and where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = large(key, lambda: np.frombuffer(sent.value, np.uint8))
        for b in batches:
            docs = as_bytes(b["b"])
            for i, j in slices(docs):
                words = Words(docs[i:j], NOT_ALNUM, True)
                for k in sizes:
                    g = words.grams(k)
                    at = g >> np.uint64(64 - BITS)
                    p = np.flatnonzero(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                    doc = np.searchsorted(words.last, p, side="right")
                    ok = p + k <= words.last[doc]
                    p, doc = p[ok], doc[ok]
                    yield pa.RecordBatch.from_arrays([b["h"].take(pa.array(doc + i)), int64(g[p]), pa.array(np.full(len(p), k, np.int32)), pa.array(p - words.first[doc]), pa.array((words.last - words.first)[doc])], ["h", "token", "k", "p", "n_words"])

    return run


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each candidate stretch of a document."""
    for b in batches:
        for h, text, some in zip(b["h"].to_pylist(), as_bytes(b["b"]), b["some"], strict=True):
            words = Words([text], NOT_ALNUM, True)
            s, m = (some.values.field(x).to_numpy() for x in range(2))
            said = [b" ".join(words.bytes[words.start[q] : words.end[q]].tobytes() for q in range(x, x + n)) for x, n in zip(s.tolist(), m.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([h] * len(s), pa.binary()), pa.array(s), pa.array(s + m), pa.array(said, pa.binary())], ["h", "s", "e", "window"])


def _n_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        docs = as_bytes(b["b"])
        n = np.concatenate([w.last - w.first for i, j in slices(docs) for w in [Words(docs[i:j], NOT_ALNUM, True)]]) if docs else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([b["id"], b["h"], int64(n)], ["id", "h", "n_words"])


def _by_tables(d: DataFrame, windows: DataFrame, size: int, shingle: int, kind: str) -> DataFrame:
    """id, n_words, ranges and items of each document, for benchmarks of any size."""
    spark = d.sparkSession
    sizes = sorted({min(x, shingle) for x in range(1, size + 1)})
    d = d.withColumn("h", F.unhex(F.md5(F.coalesce("b", F.lit(b"")))))  # tells texts apart: equal texts are searched once
    sketch = summed_sketch(d.select("b").mapInArrow(tidy(_rarity(sizes)), "id long, cells binary"))
    prefix = cut(windows.select("window").mapInArrow(tidy(_prefix_tokens(shingle, sketch)), "token long, k int, at int, m int").distinct(), "benchmark-prefix")
    bits = np.zeros(1 << BITS - 3, np.uint8)
    for r in prefix.mapInArrow(tidy(_bit_blocks), "id long, cells binary").repartition("id").mapInArrow(tidy(_or_blocks), "id long, cells binary").toLocalIterator():
        bits[r.id * CELLS : r.id * CELLS + len(r.cells)] = np.frombuffer(r.cells, np.uint8)
    sent, key = spark.sparkContext.broadcast(bits.tobytes()), uuid.uuid4().hex
    seen = d.mapInArrow(tidy(_shingles(sizes, sent, key)), "h binary, token long, k int, p long, n_words long")
    start = F.col("p") - F.col("at")
    found = seen.join(prefix, ["token", "k"]).where((start >= 0) & (start + F.col("m") <= F.col("n_words")))
    found = found.select("h", start.alias("s"), F.col("m").cast("long").alias("m")).distinct()
    lists = cut(found.groupBy("h").agg(F.collect_list(F.struct("s", "m")).alias("some"), F.max(F.col("s") + F.col("m")).alias("most")), "benchmark-candidates")
    counts = cut(d.mapInArrow(tidy(_n_words), f"id {kind}, h binary, n_words long"), "benchmark-words")
    texts = d.select("h", "b").join(lists.select("h"), "h", "left_semi").dropDuplicates(["h"])
    said = texts.join(lists, "h").select("h", "b", "some").mapInArrow(tidy(_said), "h binary, s long, e long, window binary")
    hits = said.join(windows, "window").groupBy("h").agg(F.collect_set(F.struct("s", "e")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    return counts.join(hits, "h", "left").select("id", "n_words", F.coalesce("ranges", none).alias("ranges"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = SIZE, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, spans (hit runs of words) and contaminated."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("b"))
    windows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("binary").alias("b"))
    windows = cut(windows.mapInArrow(tidy(_item_windows(size)), "item string, window binary").groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items")), "benchmark-windows")
    out = f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, spans array<struct<s:long,e:long>>"
    if windows.count() > block:
        found = _by_tables(d, windows, size, shingle, kind).mapInArrow(tidy(_union_length), out)
    else:
        rows = windows.orderBy("window").collect()  # block windows at most
        x = _Block([bytes(r.window) for r in rows], shingle)
        if len(x.tokens):
            df = d.select("b").mapInArrow(tidy(_count(x)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
            x.rank(np.array([r.token for r in df], np.int64).view(np.uint64), np.array([r.n for r in df], np.int64))
        # one Python stage: a second one would take a second worker process
        hits = _hits(x, [r["items"] for r in rows], ["id"])
        found = d.mapInArrow(tidy(lambda batches: _union_length(hits(batches))), out)
    found = found.withColumn("contaminated", F.col("n_hit") > 0)
    return found.withColumnRenamed("id", id_col)
