"""Near duplicates by n-gram Jaccard similarity: an exact set join under several global token orders.

A document's set is its distinct ``shingle``-word shingles (64-bit hashes) of lower-cased words; two documents link when
``100 * |A and B| >= percent * |A or B|``. The result is each document's component; no link between different sets is
lost, and groups of copies are never expanded into pairs.

* Equal sets are one class, found by aggregation; its smallest id stands for it.
* Orders: the first sorts tokens by their frequency over all documents (two count-min rows of fixed width, merged by
  adding; ties by a hash). A hash bit parts all tokens in two halves; the second order puts one half first and the third
  the other, each by frequency. Under any fixed order, similar sets share a token among their first
  ``n - ceil(n * percent / 100) + 1``, so they share a rare token overall, one of the one half and one of the other.
* Candidates share a prefix token of the first order (an index of these tokens), pass length and positional bounds, and
  are then held against the second and third filter by joins with the documents' prefixes (32-bit hashes). Texts move
  only for pairs that pass all three.
* Near copies without all pairs: in the bucket of each token the smallest id leads. First every document is compared
  with its leaders only, and the links make components. Then buckets that still hold several components are compared
  across components only, each pair of different components at least once. Pairs inside a component need no comparing.
  ``near_duplicate_links`` compares these too and gives all links.
* Tokens that may be in more than ``hot`` documents (the sketch never counts too few) have their bucket dealt over
  salts, each with a leader, and the leaders are led in their turn. Documents in buckets of more than ``few`` that hold
  several components are dealt anew before pairs are formed, by the tokens of the second order's prefix, and those in
  buckets that are still too large by the third order's; pairs that link share all of them. So documents that have one
  frequent token in common and nothing else meet in no bucket. More than ``few`` documents of different components that
  share tokens of all three prefixes, as unlike ones with a long rare passage may, are still compared pair by pair.
* Sorted buckets are streamed. Members of a pair are brought to the leader's text, split over salts if there are many.

Edge cases: null or empty texts, and those without words, have an empty set and link with nothing; texts of fewer words
are one shingle, the whole sequence; repeated rows are members of one class and each comes out; documents with a null id
come out with a null component and link with nothing; an empty table gives an empty result; other columns stay out.
the id column must be of an integer type and identify the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import SPACE, Words, as_bytes, bound_batches, components, cut, int64, keep_ids, mix, slices, tidy

SHINGLE, PERCENT = 5, 75
WIDTH, ROWS, CELLS = 1 << 20, 2, 1 << 14  # of the frequency sketch: counters in a row, rows, counters in a block
SALT = 250  # pairs of one leader that a salt gets
HOT, FEW = 200_000, 4096  # documents of a token's bucket that one task streams; that are compared pair by pair
PAIRS = 1 << 16  # candidate pairs that a worker holds before it hands them on


def sets_of(docs: list[bytes], shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice."""
    out: list[np.ndarray] = []
    w = Words(docs, SPACE, True)
    g = w.grams(shingle)
    for a, b in zip(w.first.tolist(), w.last.tolist(), strict=True):
        if b - a >= shingle:
            x = np.sort(g[a : b - shingle + 1])
            keep = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            h = np.uint64(b - a)
            for y in w.hash[a:b]:
                h = mix(np.array([h]), y)[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, list[bytes]]]:
    """Slices of each batch's documents: the sets of a whole batch would take too much memory."""
    for b in batches:
        docs = as_bytes(b["b"])
        for i, j in slices(docs):
            yield b, i, j, docs[i:j]


def sketch_cells(x: np.ndarray) -> list[np.ndarray]:
    return [(mix(x, np.uint64(101 + r)) >> np.uint64(64 - WIDTH.bit_length() + 1)).astype(np.int64) for r in range(ROWS)]


def _summaries(shingle: int):
    """kind 0: a document's id, set size and two order-free hashes of its set; kind 1: blocks of this task's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((ROWS, WIDTH), np.int32)
        waiting: list[np.ndarray] = []

        def add() -> None:
            if waiting:
                for r, c in enumerate(sketch_cells(np.concatenate(waiting))):
                    sketch[r] += np.bincount(c, minlength=WIDTH).astype(np.int32)
                waiting.clear()

        names = ["kind", "id", "n", "s1", "s2", "cells"]
        for b, i, j, docs in _sliced(batches):
            sets = sets_of(docs, shingle)
            waiting += sets
            if sum(map(len, waiting)) > 1 << 18:
                add()
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            s1 = np.array([mix(x, np.uint64(11)).sum(dtype=np.uint64) for x in sets], np.uint64)
            s2 = np.array([mix(x, np.uint64(13)).sum(dtype=np.uint64) for x in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), b["id"].slice(i, j - i), int64(n), int64(s1), int64(s2), pa.nulls(len(n), pa.binary())], names)
        add()
        blocks = [x for x in range(ROWS * WIDTH // CELLS) if sketch.ravel()[x * CELLS : (x + 1) * CELLS].any()]
        for x in blocks:
            cells = pa.array([sketch.ravel()[x * CELLS : (x + 1) * CELLS].tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), int64(np.array([x])), *[int64(np.zeros(1, np.int64))] * 3, cells], names)

    return run


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for x, cells in zip(b["id"].to_pylist(), b["cells"].to_pylist(), strict=True):
            c = np.frombuffer(cells, np.int32 if len(cells) == 4 * CELLS else np.int64).astype(np.int64)
            total[x] = total[x] + c if x in total else c
    for x, c in total.items():
        yield pa.RecordBatch.from_arrays([int64(np.array([x])), pa.array([c.tobytes()], pa.binary())], ["id", "cells"])


def summed_sketch(blocks: DataFrame) -> bytes:
    """Adds the tasks' blocks; 128 blocks of 16,384 counters reach the driver, whatever the input."""
    schema = "id long, cells binary"
    some = blocks.select("id", "cells").repartition("id").mapInArrow(tidy(_add_blocks), schema)
    out = np.zeros(ROWS * WIDTH, np.int64)
    for r in some.toLocalIterator():
        out[r.id * CELLS : (r.id + 1) * CELLS] = np.frombuffer(r.cells, np.int64)
    return np.minimum(out, 2**32 - 1).astype(np.uint32).tobytes()


class Orders:
    """The global token orders: for each, a sort key of any token."""

    def __init__(self, sketch: bytes):
        self.sketch = sketch

    def often(self, x: np.ndarray) -> np.ndarray:
        """How many documents have each token, at most."""
        s = np.frombuffer(self.sketch, np.uint32).reshape(ROWS, WIDTH)
        return np.minimum.reduce([s[r][c] for r, c in enumerate(sketch_cells(x))])

    def key(self, x: np.ndarray, order: int, often: np.ndarray | None = None) -> np.ndarray:
        h = mix(x, np.uint64((17, 19, 23)[order]))
        # Frequencies as steps of a quarter octave: noise of the sketch does not order rare tokens.
        step = np.floor(np.log2((self.often(x) if often is None else often) + 1.0) * 4).astype(np.uint64) << np.uint64(55)
        key = step | (h >> np.uint64(9))
        if order:
            half = mix(x, np.uint64(29)) >> np.uint64(63)
            key |= (half if order == 1 else half ^ np.uint64(1)) << np.uint64(63)
        return key


def prefix_size(n, percent: int):
    return n - -(-n * percent // 100) + 1


def _index(shingle: int, percent: int, orders: Orders, hot: int):
    """The prefix tokens of the first order: token, document, set size, place in the order, and salt (of a hot token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, j, docs in _sliced(batches):
            ids, sets = b["id"].slice(i, j - i).to_numpy(), sets_of(docs, shingle)
            cols: list[list] = [[], [], [], [], []]
            all_ = np.concatenate(sets)
            often = orders.often(all_)
            keys = orders.key(all_, 0, often)
            at = 0
            for i, x in zip(ids, sets, strict=True):
                n = len(x)
                k, c, at = keys[at : at + n], often[at : at + n], at + n
                if n:
                    m = prefix_size(n, percent)
                    o = np.argpartition(k, m - 1)[:m] if m < n else np.arange(n)
                    o = o[np.argsort(k[o])]
                    salts = c[o] // hot + 1
                    salt = np.where(salts > 1, 1 + mix(np.full(1, i).view(np.uint64), np.uint64(31)) % salts.astype(np.uint64), 0)
                    for c, v in zip(cols, (x[o], np.full(m, i), np.full(m, n), np.arange(m), salt), strict=True):
                        c.append(v)
            arrays = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            yield pa.RecordBatch.from_arrays([int64(arrays[0]), int64(arrays[1]), *(pa.array(x.astype(np.int32)) for x in arrays[2:])], ["t", "id", "n", "pos", "salt"])

    return run


def _prefixes(shingle: int, percent: int, orders: Orders):
    """id and, as 32-bit hashes, the prefix tokens of the second and third order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, j, docs in _sliced(batches):
            sets = sets_of(docs, shingle)
            all_ = np.concatenate(sets)
            often = orders.often(all_)
            short = (all_ >> np.uint64(32)).astype(np.uint32).view(np.int32)
            end = np.cumsum([len(x) for x in sets])
            lists = []
            for order in (1, 2):
                keys = orders.key(all_, order, often)
                parts = []
                for x, e in zip(sets, end.tolist(), strict=True):
                    n, k, v = len(x), keys[e - len(x) : e], short[e - len(x) : e]
                    m = prefix_size(n, percent)
                    parts.append(np.unique(v[np.argpartition(k, m - 1)[:m]] if m < n else v))
                offsets = pa.array(np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int32))
                lists.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts))))
            yield pa.RecordBatch.from_arrays([b["id"].slice(i, j - i), *lists], ["id", "p2", "p3"])

    return run


def _possible(n, pos, n2, pos2, percent: int):
    """Length and positional bounds, if the token at pos and pos2 is the first one that both share."""
    least = -(-percent * (n + n2) // (100 + percent))
    return (100 * np.minimum(n, n2) >= percent * np.maximum(n, n2)) & (1 + np.minimum(n - pos, n2 - pos2) - 1 >= least)


def _lead(percent: int):
    """Streams the index sorted by token, salt and id: rows of tokens with several documents (all rows of salted ones),
    each with its leader; head: the leader's own row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # token, salt, id, n, pos of the leader, and whether it is out
        for b in batches:
            if not b.num_rows:
                continue
            t, salt, i, n, pos = (b[x].to_numpy() for x in ("t", "salt", "id", "n", "pos"))
            if last is not None:
                t, salt, i, n, pos = (np.append(np.array([x], y.dtype), y) for x, y in zip(last[:5], (t, salt, i, n, pos), strict=True))
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (salt[1:] != salt[:-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
            rest = ~new & (i != i[lead])
            out = rest | (new & ((salt > 0) | np.append(~new[1:], False)))
            if last is not None and last[5]:
                out[0] = False
            ok = rest & _possible(n.astype(np.int64), pos, n[lead].astype(np.int64), pos[lead], percent)
            yield pa.RecordBatch.from_arrays([int64(t[out]), pa.array(salt[out]), int64(i[out]), pa.array(n[out]), pa.array(pos[out]), pa.array(i[lead][out], mask=~ok[out]), pa.array(new[out])], ["t", "salt", "id", "n", "pos", "leader", "head"])
            k = lead[-1]
            done = len(t) - 1 > k or bool(out[k]) or (k == 0 and last is not None and last[5])
            last = (t[k], salt[k], i[k], n[k], pos[k], done)

    return run


def _across(percent: int):
    """Buckets sorted by token: the pairs of different components that the bounds allow."""

    def pairs(n, pos, i, c):
        if c.min() == c.max():
            return
        o = np.argsort(n, kind="stable")
        n, pos, i, c = n[o].astype(np.int64), pos[o], i[o], c[o]
        kinds, size = np.unique(c, return_counts=True)
        major = kinds[np.argmax(size)]
        for k in np.flatnonzero(c != major):  # against all of the largest component, and later ones of the others
            lo = np.searchsorted(n, -(-n[k] * percent // 100), side="left")
            hi = np.searchsorted(n, n[k] * 100 // percent, side="right")
            j = np.arange(lo, hi)
            j = j[(c[j] != c[k]) & ((j > k) | (c[j] == major))]
            j = j[_possible(n[k], pos[k], n[j], pos[j], percent)]
            if len(j):
                yield np.minimum(i[k], i[j]), np.maximum(i[k], i[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def handed(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([int64(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])

        def flush():
            """A bucket's pairs grow with the square of its size, so they go on in parts."""
            t, *cols = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            found: list[tuple] = []
            room = PAIRS
            at = np.append(np.append(0, np.flatnonzero(t[1:] != t[:-1]) + 1), len(t))
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if e - s > 1:
                    for p in pairs(*(x[s:e] for x in cols)):
                        found.append(p)
                        room -= len(p[0]) + 16  # small arrays cost more than their pairs
                        if room <= 0:
                            yield handed(found)
                            found, room = [], PAIRS
            if found:
                yield handed(found)

        for b in batches:
            if not b.num_rows:
                continue
            cols = tuple(b[x].to_numpy() for x in ("t", "n", "pos", "id", "comp"))
            cut_at = np.searchsorted(cols[0], cols[0][-1])  # where its last token begins
            if cut_at:
                held.append(tuple(x[:cut_at] for x in cols))
                yield from flush()
            elif held and held[-1][0][-1] != cols[0][0]:
                yield from flush()
            held.append(tuple(x[cut_at:] for x in cols))
        if held:
            yield from flush()

    return run


def _verify(shingle: int, percent: int):
    """Rows sorted by leader and salt, the leader's text first: the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def common(x: np.ndarray, y: np.ndarray) -> int:
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            return int((y[at] == x).sum())

        leader = None
        for b, lo, hi, docs in _sliced(batches):
            out: list[tuple] = []
            for a, i, x in zip(b["a"].slice(lo, hi - lo).to_pylist(), b["id"].slice(lo, hi - lo).to_pylist(), sets_of(docs, shingle), strict=True):
                if a == i:
                    leader = a, x
                    continue
                both = common(leader[1], x) if leader[0] == a else 0
                if 100 * both >= percent * (len(leader[1]) + len(x) - both):
                    out.append((a, i))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def _prefix_table(docs: DataFrame, ids: DataFrame, shingle: int, percent: int, orders: Orders, name: str) -> DataFrame:
    some = keep_ids(docs, ids, "id").dropDuplicates(["id"])
    return cut(some.mapInArrow(tidy(_prefixes(shingle, percent, orders)), "id long, p2 array<int>, p3 array<int>"), f"{name}-prefixes")


def _both_ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()


def _links(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int, orders: Orders, name: str) -> DataFrame:
    """The pairs (a, b), a < b, that link, as (u, v). They share a token of the first order's prefix."""
    pairs = cut(pairs.distinct(), f"{name}-candidates")
    prefix = _prefix_table(docs, _both_ends(pairs), shingle, percent, orders, name)
    for end in "ab":
        pairs = pairs.join(prefix.select(F.col("id").alias(end), F.col("p2").alias(f"p2{end}"), F.col("p3").alias(f"p3{end}")), end)
    pairs = cut(pairs.where(F.arrays_overlap("p2a", "p2b") & F.arrays_overlap("p3a", "p3b")).select("a", "b"), f"{name}-pairs")
    texts = keep_ids(docs, _both_ends(pairs), "id").dropDuplicates(["id"])
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    pairs = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    members = texts.join(pairs.withColumnRenamed("b", "id"), "id").select("a", F.col("salt").cast("int").alias("salt"), F.lit(1).alias("order"), "id", "b")
    leaders = texts.join(salts.withColumnRenamed("a", "id"), "id")
    leaders = leaders.select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("order"), "id", "b")
    rows = leaders.union(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "order")
    return cut(rows.select("a", "id", "b").mapInArrow(tidy(_verify(shingle, percent)), "u long, v long"), f"{name}-links")


def _indexed(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame, Orders, DataFrame]:
    """Set sizes and names by id, classes of equal sets, texts by id, the orders, and the index of the classes."""
    bound_batches(docs.sparkSession)
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be of an integer type")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("b"))
    seen = cut(d.mapInArrow(tidy(_summaries(shingle)), "kind int, id long, n long, s1 long, s2 long, cells binary"), "jaccard-sets")
    orders = Orders(summed_sketch(seen.where("kind = 1")))
    own = seen.where("kind = 0").select("id", "n", "s1", "s2")
    classes = own.where("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"))
    classes = cut(classes, "jaccard-classes")

    single = d.where("id is not null")
    index = keep_ids(single, classes.select(F.col("rep").alias("id")), "id").mapInArrow(tidy(_index(shingle, percent, orders, hot)), "t long, id long, n int, pos int, salt int")
    return own, classes, single, orders, index


def near_duplicate_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """All links (a, b), a < b, between different sets, each set under the smallest id that has it.

    Inside components too, so the rows grow with the square of a group of different near copies."""
    _, _, single, orders, index = _indexed(docs, id_col, text_col, shingle, percent, HOT)
    index = cut(index, "jaccard-index")
    x, y = (index.select("t", *[F.col(c).alias(c + k) for c in ("id", "n", "pos")]) for k in "ab")
    both, total = F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb")), F.col("na").cast("long") + F.col("nb")
    near = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")
    pairs = x.join(y, "t").where((F.col("ida") < F.col("idb")) & near & (both * (100 + percent) >= percent * total))
    links = _links(single, pairs.select(F.col("ida").alias("a"), F.col("idb").alias("b")), shingle, percent, orders, "jaccard-all")
    return links.select(F.col("u").alias("a"), F.col("v").alias("b"))


def _refined(left: DataFrame, docs: DataFrame, shingle: int, percent: int, orders: Orders, few: int) -> DataFrame:
    """Members of the buckets (t) in which several components meet, in buckets of at most few where that can be."""

    def meeting(x: DataFrame, name: str) -> DataFrame:
        kinds = x.groupBy("t").agg((F.min("comp") < F.max("comp")).alias("several"), F.count("*").alias("size")).where("several")
        return cut(x.join(kinds.select("t", "size"), "t"), name)

    left = meeting(left, "jaccard-left")
    small, large = left.where(F.col("size") <= few), left.where(F.col("size") > few)
    if not large.take(1):
        return small.drop("size")
    prefix = _prefix_table(docs, large.select("id").distinct(), shingle, percent, orders, "jaccard-large")
    # Documents of large buckets, once each: pairs of them that link share a token of each other order's prefix, too.
    for column in ("p2", "p3"):
        some = large.select("id", "n", "comp").distinct().join(prefix.select("id", F.explode(column).alias("more")), "id")
        # without the first order's places there is no positional bound
        finer = meeting(some.select(F.xxhash64(F.lit(column), "more").alias("t"), "n", F.lit(0).alias("pos"), "id", "comp"), f"jaccard-by-{column}")
        small = small.unionByName(finer.where(F.col("size") <= few))
        large = finer.where(F.col("size") > few)
        if not large.take(1):
            return small.drop("size")
    return small.unionByName(large).drop("size")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, hot: int = HOT, few: int = FEW) -> DataFrame:
    """Per document: id, n_shingles and component_id, the smallest id that links reach."""
    own, classes, single, orders, index = _indexed(docs, id_col, text_col, shingle, percent, hot)
    led = "t long, salt int, id long, n int, pos int, leader long, head boolean"
    index = index.repartition("t", "salt").sortWithinPartitions("t", "salt", "id")
    buckets = cut(index.mapInArrow(tidy(_lead(percent)), led), "jaccard-buckets")
    heads = buckets.where("salt > 0 and head").withColumn("salt", F.lit(0)).select("t", "salt", "id", "n", "pos")
    heads = heads.repartition("t").sortWithinPartitions("t", "id").mapInArrow(tidy(_lead(percent)), led)

    pairs = buckets.select("leader", "id").union(heads.select("leader", "id")).where("leader is not null")
    first = _links(single, pairs.select(F.col("leader").alias("a"), F.col("id").alias("b")), shingle, percent, orders, "jaccard-1")
    comp = components(first, "jaccard-1")
    left = buckets.join(comp.withColumnRenamed("node", "id"), "id", "left").select("t", "n", "pos", "id", F.coalesce("comp", "id").alias("comp"))
    left = _refined(left, single, shingle, percent, orders, few).select("t", "n", "pos", "id", "comp")
    left = left.repartition("t").sortWithinPartitions("t")
    second = _links(single, left.mapInArrow(tidy(_across(percent)), "a long, b long"), shingle, percent, orders, "jaccard-2")
    comp = components(first.union(second), "jaccard-2")

    rep = own.join(classes, ["n", "s1", "s2"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    out = rep.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("comp", "rep")).alias("component_id"))
