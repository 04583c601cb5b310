"""Removal of long repeated substrings by bucket-pointer refinement over content-chosen suffixes.

Every byte covered by a string of ``length`` bytes that starts anywhere else too is removed, exactly and corpus-wide.
In the same run, *passages* are found: runs of repeated strings of ``passage`` bytes that hold more than ``words`` words.

* Which suffixes are sorted: for a window of bytes, the *anchor* is the smallest q-gram code among its first ``gap``
  positions. It depends on the window's content alone, so equal windows have equal anchors, and about two anchors in
  ``gap`` bytes stand for all windows, those of both lengths.
* Initial buckets: anchors by the code of the next bytes that each of their windows contains. An anchor alone in its
  bucket has no repeated window and goes.
* Refinement by pointers: a window of the greater length also contains the next anchor with its bucket, so buckets are
  refined by (distance to the next anchor, bucket there); anchors left alone have no repeated window of that length.
* Refinement by what lies around: an anchor's windows form a tree (all of them, then 64, 16, 4 and 1 neighbours). A node's
  members share its core, the bytes that all its windows contain; its children's buckets are named by the node's bucket
  and the strings by which their cores exceed it. A member alone in a bucket goes, a bucket in which all windows agree is
  settled (all repeat), and the others are refined, down to single windows.

Codes of 64 bits only leave things out. What is removed was found equal byte by byte (inside a batch), or by 128 bits: a
BLAKE2 digest of the very bytes of a context or first core, and two hashes of the strings around it.

Skew: exact copies of documents are reduced to one beforehand (aggregated by digest); equal contexts are reduced to one
row in each batch before the shuffle; buckets are only ever counted, with map-side combining, and joined with their
counts (unique keys, so that a hot bucket's rows can be split); no bucket is held in memory.

Edge cases: null text is empty; texts shorter than ``length`` lose nothing; repeated rows are copies of each other and
lose everything if long enough; an empty table gives an empty result; other columns are ignored. The id column must be of
an integer type and identify the text (rows with equal ids and equal text are copies); ids below 2**62. Rows without an
id are judged like others, under a key made of their text. Memory of a task follows its largest text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import as_bytes, bound_batches, byte_codes, cut, drop_ids, int64, keep_ids, mix, slices, tidy

LENGTH, PASSAGE, WORDS = 400, 256, 50  # 256 bytes: less than 51 words of any language here take
WIDEST = 128  # windows of an anchor, at most
BLOCKS = (64, 16, 4, 1)  # windows of a node after each round; those beyond an anchor's windows are left out
KEYS = 1 << 62  # where keys of rows without id begin


def _sizes(shortest: int) -> tuple[int, int, int, int]:
    """gap; the core that all windows of an anchor share; q and the longest doubled code (powers of two)."""
    gap = min(WIDEST, 1 << ((shortest // 2).bit_length() - 1))
    core = shortest - gap + 1
    unit = 1 << (core.bit_length() - 1)
    return gap, core, min(32, unit), unit


def _widths(shortest: int) -> list[int]:
    return [x for x in BLOCKS if x <= _sizes(shortest)[0]]


class _Codes:
    """Codes of the q-grams and of the longest doubling at every position of a buffer."""

    def __init__(self, a: np.ndarray, q: int, unit: int):
        h, n = byte_codes()[a], 1
        self.q = h if q == 1 else None
        while n < unit:
            later = h.copy()
            if n < len(h):
                later[:-n] = mix(h[:-n], h[n:])  # own code, code n bytes later
            h, n = later, n * 2
            if n == q:
                self.q = h
        self.h, self.unit = h, unit

    def of(self, at: np.ndarray, size) -> np.ndarray:
        """Code of the string of size (at least unit) bytes at each position."""
        size = np.broadcast_to(np.asarray(size, np.int64), at.shape)
        out = self.h[at]
        for k in range(1, -(-int(size.max(initial=self.unit)) // self.unit)):
            out = mix(out, self.h[at + np.minimum(k * self.unit, size - self.unit)])
        return mix(out, size.astype(np.uint64))


def _owners(code: np.ndarray, gap: int) -> np.ndarray:
    """Position of the smallest of code[p:p + gap], for each p; of equal ones the first."""
    n = len(code)
    key = (code & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    whole = np.full(-(-n // gap) * gap + gap, 0xFFFFFFFFFFFFFFFF, np.uint64)
    whole[:n] = key
    blocks = whole.reshape(-1, gap)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return (np.minimum(ahead[:n], behind[gap - 1 : gap - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _anchors(docs: list[bytes], lengths: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Anchors: document's place in docs, position, nearest and farthest window (bytes before), distance to and code of
    the next one, own code, and the code of the whole context, first to last byte of the anchor's windows."""
    gap, core, q, unit = _sizes(lengths[0])
    a = np.frombuffer(b"".join(docs), np.uint8)
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    off = np.cumsum(size) - size
    many = np.maximum(size - lengths[0] + 1, 0)  # windows of each document
    if not many.sum():
        return tuple(np.zeros(0, t) for t in (*[np.int64] * 5, *[np.uint64] * 3))
    codes = _Codes(a, q, unit)
    doc = np.repeat(np.arange(len(docs)), many)
    p = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + off[doc]
    own = _owners(codes.q, gap)[p]
    new = np.ones(len(p), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    i = np.flatnonzero(new)
    j = np.append(i[1:], len(p)) - 1
    at, d = own[i], doc[i]
    far, near = at - p[i], at - p[j]
    code = codes.of(at, core)
    follows = np.append(d[1:] == d[:-1], False)
    hop, beyond = np.zeros(len(at), np.int64), np.zeros(len(at), np.uint64)
    hop[follows], beyond[follows] = np.diff(at)[follows[:-1]], code[1:][follows[:-1]]
    last = np.minimum(at - near + lengths[-1], (off + size)[d])
    context = mix(mix(codes.of(at - far, last - at + far), code), (far * 65536 + near).astype(np.uint64))
    return d, at - off[d], near, far, hop, beyond, code, context


def _merge(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of half-open ranges, touching ones joined."""
    o = np.argsort(s, kind="stable")
    s, e = s[o], np.maximum.accumulate(e[o])
    first = np.ones(len(s), bool)
    first[1:] = s[1:] > e[:-1]
    return s[first], e[np.append(np.flatnonzero(first)[1:], len(s)) - 1] if len(s) else e


# kind 0: an anchor, place packed as position, near, far, hop; kind k > 0: a repeated range of the k-th length, place to code
_ROWS = "kind int, doc long, place long, code long, beyond long, context long"


def _rows(kind, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int32)), *map(int64, cols)], ["kind", "doc", "place", "code", "beyond", "context"])


def _find_anchors(lengths: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, ids = as_bytes(b["b"]), b["doc"].to_numpy()
            size = np.fromiter(map(len, docs), np.int64, len(docs))
            parts = [[x + i, *y] for i, j in slices(docs, 1 << 17) for x, *y in [_anchors(docs[i:j], lengths)]]
            if not parts:
                continue
            doc, at, near, far, hop, beyond, code, context = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, first, place = np.unique(context, return_index=True, return_inverse=True)
            start, stop = at - far, np.minimum(at - near + lengths[-1], size[doc])
            lead = first[place]
            rest = np.flatnonzero(lead != np.arange(len(doc)))
            same = np.fromiter((docs[d][s:e] == docs[d0][s0:e0] for d, s, e, d0, s0, e0 in zip(*(x.tolist() for x in (doc[rest], start[rest], stop[rest], doc[lead[rest]], start[lead[rest]], stop[lead[rest]])), strict=True)), bool, len(rest))
            rest = rest[same]  # repeated for sure, as their leaders are, by their bytes
            go = np.ones(len(doc), bool)
            go[rest] = False
            twice = np.unique(np.concatenate([rest, lead[rest]]))
            for k, length in enumerate(lengths):
                ok = twice[start[twice] + length <= size[doc[twice]]]
                for x in np.split(ok, np.flatnonzero(np.diff(doc[ok])) + 1) if len(ok) else []:
                    s, e = _merge(start[x], np.minimum(at[x] - near[x] + length, size[doc[x]]))
                    z = np.zeros(len(s), np.int64)
                    yield _rows(k + 1, ids[doc[x]][: len(s)], s, e, z, z)
            i = np.flatnonzero(go)
            yield _rows(0, ids[doc[i]], at[i] << 24 | near[i] << 16 | far[i] << 8 | hop[i], code[i], beyond[i], context[i])

    return run


# kind -1: all windows of an anchor seem to agree with others'; they start at at to last and end at end at most. Else a
# node of windows of the kind-th length, with its core at at; lft and rgt: the bytes before and after the core that some
# of its windows contain, so that window j (of the node's size windows) starts at at - j and the member has those from
# size - 1 - length(rgt) to length(lft).
_NODES = "k1 long, k2 long, kind int, doc long, at long, last long, end long, lft binary, rgt binary"


def _nodes(lengths: tuple[int, ...]):
    width = _widths(lengths[0])[0]

    def key(tag: bytes, text: bytes) -> tuple[int, int]:
        x = hashlib.blake2b(text, digest_size=16, salt=tag).digest()
        return int.from_bytes(x[:8], signed=True), int.from_bytes(x[8:], signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, some in zip(b["doc"].to_pylist(), as_bytes(b["b"]), b["some"], strict=True):
                n = len(text)
                place, whole, split, deep = (some.values.field(x).to_numpy(zero_copy_only=False) for x in range(4))
                rows: list[tuple] = []
                for geo, is_whole, is_split, is_deep in zip(place.tolist(), whole.tolist(), split.tolist(), deep.tolist(), strict=True):
                    at, near, far = geo >> 24, geo >> 16 & 255, geo >> 8 & 255
                    if is_whole:
                        end = min(at - near + lengths[-1], n)
                        rows.append((*key(b"whole %d %d" % (near, far), text[at - far : end]), -1, doc, at - far, at - near, end, None, None))
                    if not is_split:
                        continue
                    for x, length in enumerate(lengths):
                        if x and not is_deep:
                            continue
                        least = max(near, at + length - n)
                        for lo in range(least - least % width, far + 1, width) if least <= far else ():
                            hi, mine, top = lo + width - 1, max(lo, least), min(lo + width - 1, far)
                            k = key(b"%d %d" % (x, lo), text[at - lo : at - hi + length])
                            rows.append((*k, x, doc, at - lo, None, None, text[at - top : at - lo], text[at - hi + length : at - mine + length]))
                cols = list(zip(*rows, strict=True)) or [()] * 9
                kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["k1", "k2", "kind", "doc", "at", "last", "end", "lft", "rgt"])

    return run


def _names(*parts) -> tuple:
    """Two independent 64-bit hashes, 128 bits together."""
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *reversed(parts))


def _settle(nodes: DataFrame, name: str) -> DataFrame:
    """Members of buckets (k1, k2) of two at least, with ``alike``: all members have the same windows, and these agree."""
    h1, h2 = _names("lft", "rgt")
    total = nodes.select("k1", "k2", h1.alias("h1"), h2.alias("h2")).groupBy("k1", "k2")
    total = total.agg(F.count("*").alias("n"), *(f(x).alias(f"{f.__name__}_{x}") for x in ("h1", "h2") for f in (F.min, F.max))).where("n > 1")
    alike = (F.col("min_h1") == F.col("max_h1")) & (F.col("min_h2") == F.col("max_h2"))
    return cut(nodes.join(total.select("k1", "k2", alike.alias("alike")), ["k1", "k2"]), name)


def _children(nodes: DataFrame, size: int, width: int) -> DataFrame:
    """Nodes of width windows, of those of size windows. A child's bucket is named by its parent's, its place there, and
    the strings by which its core exceeds its parent's."""
    first, last = F.lit(size - 1) - F.length("rgt"), F.length("lft")
    nodes = nodes.select("k1", "k2", "kind", "doc", "at", "lft", "rgt", F.explode(F.sequence(first - first % width, last, F.lit(width))).alias("low"))
    low, more = F.col("low"), F.lit(size - width) - F.col("low")
    before = F.when(low > 0, F.substring("lft", F.length("lft") - low + 1, low)).otherwise(F.lit(b""))
    k1, k2 = _names("k1", "k2", "low", before, F.substring("rgt", F.lit(1), more))
    return nodes.select(
        k1.alias("k1"), k2.alias("k2"), "kind", "doc", (F.col("at") - low).alias("at"),
        F.substring("lft", F.greatest(F.lit(1), F.length("lft") - low - width + 2), F.least(F.lit(width - 1), F.length("lft") - low)).alias("lft"),
        F.substring("rgt", more + 1, F.lit(width - 1)).alias("rgt"),
    )


def repeated_ranges(d: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(doc, kind, s, e): ranges of document doc that strings of lengths[kind] bytes cover which start elsewhere too.
    d: doc (its key) and b (its bytes), each text once. lengths ascend."""
    rows = cut(d.mapInArrow(tidy(_find_anchors(lengths)), _ROWS), "repeat-anchors")
    found = [rows.where("kind > 0").select("doc", (F.col("kind") - 1).alias("kind"), F.col("place").alias("s"), F.col("code").alias("e"))]

    anchors = rows.where("kind = 0").select("doc", "place", "code", "beyond", "context")
    shared = anchors.groupBy("code").agg(F.count("*").alias("n"), (F.min("context") == F.max("context")).alias("alike")).where("n > 1").drop("n")
    live = cut(anchors.join(shared, "code").withColumn("hop", F.col("place").bitwiseAND(255)), "repeat-live")

    mixed = live.where("not alike")
    twins = mixed.groupBy("code", "context").agg(F.count("*").alias("twins"), F.min("doc").alias("one"))
    pointers = mixed.groupBy("code", "hop", "beyond").agg((F.count("*") > 1).alias("deep"))
    state = mixed.join(twins, ["code", "context"]).join(pointers, ["code", "hop", "beyond"])
    gap, core, _, _ = _sizes(lengths[0])
    deep = F.col("deep") if lengths[-1] >= 2 * gap + core - 1 else F.lit(True)
    state = state.select("doc", "place", (F.col("twins") > 1).alias("whole"), (F.col("doc") == F.col("one")).alias("split"), deep.alias("deep"))
    no = F.lit(False)
    state = state.where("whole or split").union(live.where("alike").select("doc", "place", F.lit(True), no, no))
    lists = cut(state.groupBy("doc").agg(F.collect_list(F.struct("place", "whole", "split", "deep")).alias("some")), "repeat-lists")
    nodes = cut(keep_ids(d, lists.select("doc"), "doc").join(lists, "doc").select("doc", "b", "some").mapInArrow(tidy(_nodes(lengths)), _NODES), "repeat-nodes")

    length = lambda kind: F.element_at(F.array(*[F.lit(x).cast("long") for x in lengths]), kind + 1)
    whole = nodes.where("kind < 0").select("k1", "k2", "doc", F.col("at").alias("s"), "last", "end")
    sure = whole.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    whole = whole.join(sure, ["k1", "k2"], "left_semi").withColumn("kind", F.explode(F.array(*map(F.lit, range(len(lengths))))))
    whole = whole.withColumn("e", F.least(F.col("last") + length(F.col("kind")), "end"))
    found.append(whole.where(F.col("s") + length(F.col("kind")) <= F.col("end")).select("doc", "kind", "s", "e"))

    widths = _widths(lengths[0])
    some = nodes.where("kind >= 0").select("k1", "k2", "kind", "doc", "at", "lft", "rgt")
    for size, width in zip(widths, [*widths[1:], 0], strict=True):
        some = _settle(some, f"repeat-{size}")
        start, end = F.col("at") - F.length("lft"), F.col("at") - (size - 1) + F.length("rgt") + length(F.col("kind"))
        found.append(some.where("alike").select("doc", "kind", start.alias("s"), end.alias("e")))
        if width:
            some = _children(some.where("not alike"), size, width)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def _cut_out(words: int, passages_too: bool):
    token = re.compile(rb"[^\x20\x09-\x0D]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, r in zip(as_bytes(b["b"]), b["ranges"], strict=True):
                kind, s, e = (r.values.field(x).to_numpy() for x in range(3))
                last = kind == 1
                long = _merge(s[last], e[last])
                runs = _merge(s[~last], e[~last])
                many = np.fromiter((len(token.findall(text, i, j)) > words for i, j in zip(*map(np.ndarray.tolist, runs), strict=True)), bool, len(runs[0]))
                runs = runs[0][many], runs[1][many]
                s, e = _merge(*map(np.concatenate, zip(long, runs, strict=True))) if passages_too else long
                keep = b"".join(text[i:j] for i, j in zip([0, *e.tolist()], [*s.tolist(), len(text)], strict=True))
                rows.append((len(text), len(text) - len(keep), len(s), hashlib.sha256(keep).hexdigest(), int((runs[1] - runs[0]).sum()), keep))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [b["own"], *(pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 3, pa.string(), pa.int64(), pa.binary()), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["own", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int | None = None, words: int = WORDS, passages_too: bool = False) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes and kept (the bytes left, as binary).

    n_passage_bytes: bytes of runs that repeated strings of passage bytes (default: length) form and that hold more than
    words words (``[^\\x20\\x09-\\x0D]+``, those at its edges included). passages_too: these are removed too."""
    bound_batches(docs.sparkSession)
    passage = passage or length
    if not 8 <= passage <= length:
        raise ValueError("passage must be 8 at least and length at most")
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be of an integer type")
    kind = docs.schema[id_col].dataType.simpleString()
    b = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    made = F.xxhash64(b).bitwiseAND(F.lit(KEYS - 1)).bitwiseOR(F.lit(KEYS))
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), made).alias("doc"), F.col(id_col).alias("own"), b.alias("b"))
    digest = d.select("doc", "own", F.octet_length("b").cast("long").alias("n"), F.sha2("b", 256).alias("h")).where(F.col("n") >= passage)
    classes = cut(digest.groupBy("h").agg(F.min("doc").alias("doc"), F.count("*").alias("copies")), "repeat-classes")
    copies = keep_ids(d, cut(digest.join(classes.where("copies > 1").select("h"), "h").select("doc"), "repeat-copies"), "doc")

    lengths = (passage, length) if passage < length else (length,)
    once = keep_ids(d.select("doc", "b"), classes.where("copies = 1").select("doc"), "doc")
    twice = keep_ids(d.select("doc", "b"), classes.where("copies > 1").select("doc"), "doc").dropDuplicates(["doc"])
    found = repeated_ranges(once.union(twice), lengths)
    if len(lengths) == 1:
        found = found.union(found.withColumn("kind", F.lit(1)))
    span = F.struct(F.col("kind"), "s", "e")
    # copies: whole texts, if long enough for the length
    whole = copies.select("doc", F.explode(F.array(F.lit(0), F.lit(1))).alias("kind"), F.lit(0).cast("long").alias("s"), F.octet_length("b").cast("long").alias("e")).where(F.col("e") >= F.when(F.col("kind") == 1, length).otherwise(passage)).distinct()
    lists = cut(found.union(whole).groupBy("doc").agg(F.collect_list(span).alias("ranges")), "repeat-ranges")
    out = f"own {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, kept binary"
    some = keep_ids(d, lists.select("doc"), "doc").join(lists, "doc").select("own", "b", "ranges").mapInArrow(tidy(_cut_out(words, passages_too)), out)
    rest = drop_ids(d, lists.select("doc"), "doc")
    zero = F.lit(0).cast("long")
    rest = rest.select("own", F.octet_length("b").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("b", 256).alias("kept_sha256"), zero.alias("n_passage_bytes"), F.col("b").alias("kept"))
    return some.union(rest).withColumnRenamed("own", id_col)
