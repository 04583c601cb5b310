"""Language-model scores by a subword lattice: the log10 probability of a text over all segmentations.

Tokens are white-space words, A-Z lower-cased, and one end a document. The lattice of a word has three layers:

* pieces of an existing subword vocabulary. A first piece is drawn from those that open a word, then either the word
  stops or a further piece or single byte follows; bytes keep every string reachable. The vocabulary's own scores weight
  the pieces: its scores are ranks (no file at hand has unigram log probabilities), which a Zipf-Mandelbrot law, ``1 /
  (rank + SHIFT)``, makes weights; these are pseudo-counts, ``ALPHA`` a piece on average, to which the pieces in the
  vocabulary's own segmentation of each distinct training word are added (as back-off models do, each word once);
* the whole word as one arc, if training has it: (count - discount) / tokens. What the discount takes off is the weight
  of the piece layer;
* the whole word in the class of its document, in the same way; what is discounted there is the weight of the second.

Classes are the values of a column of the training documents (a hidden one: when a text is scored its class is summed
over too, with the classes' shares as weights), at most ``CLASSES``; the rarer ones make one. Without it there is one.

A forward recursion in log space sums all paths, so a word's score is its marginal probability, and these probabilities
sum to at most one over all words. No arc crosses white space, so a document's marginal in a class is the sum of its
words' (and its end's): forward runs once a distinct word, not once an occurrence.

Distribution: words are counted with a bounded dictionary in each task and then by aggregation. The ``HEAD`` most
frequent words (a fixed bound, found from a histogram of the counts) and their scores travel to the tasks; occurrences of all others are joined by word,
where no key is hot. What is gathered is the vocabulary of the corpus, which grows with it.

Edge cases: null and empty texts are one end token; nothing in training: all probability lies with the pieces; repeated
rows are scored as often as they occur and are counted as often in training; words of any length are handled, in time
proportional to it; ids may be null (crc32 of a null is null: such rows are trained on); a null class is one of the
rarer ones; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, cut, large, tidy

HEAD = 200_000  # words whose scores are sent to all tasks
FLUSH = 400_000  # distinct words that a task counts before it passes them on
DISCOUNT, ALPHA, SHIFT, LONGEST, CLASSES = 0.75, 0.1, 2.7, 24, 8
OPEN, STOP = "▁", -1


def vocabulary_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, k, c): occurrences in training documents of class k; 0 for words that occur elsewhere only."""
    counts: dict[int, Counter] = defaultdict(Counter)

    def out():
        cols = [pa.array([w for c in counts.values() for w in c], pa.binary()), pa.array([k for k, c in counts.items() for _ in c], pa.int32()), pa.array([n for c in counts.values() for n in c.values()], pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(cols, ["word", "k", "c"])

    for b in batches:
        for text, k in zip(as_bytes(b["b"]), b["k"].to_pylist(), strict=True):
            words = text.lower().split()
            counts[k or 0].update(dict.fromkeys(words, 0) if k is None else words)
            if sum(map(len, counts.values())) > FLUSH:
                yield out()
    yield out()


def _segment(path: str, classes: int):
    """(k, piece, n): pieces of the vocabulary's own segmentation of each distinct training word of class k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        counts = [Counter() for _ in range(classes)]
        for b in batches:
            words = [x.decode("utf-8", "replace") for x in as_bytes(b["word"])]
            has = [np.flatnonzero(b[f"c{k}"].to_numpy() > 0).tolist() for k in range(classes)]
            ids = sp.encode(words, num_threads=1)
            for k, own in enumerate(has):
                for i in own:
                    counts[k].update(ids[i])
                counts[k][STOP] += len(own)
        cols = list(zip(*((k, i, n) for k, c in enumerate(counts) for i, n in c.items()), strict=True)) or [()] * 3
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["k", "piece", "n"])

    return run


class Lattice:
    """Log probabilities of first pieces, of further pieces and bytes, and of the stop, a column for each class."""

    def __init__(self, path: str, counts: list[dict[int, int]], alpha: float = ALPHA):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        weight = {i: 1 / (SHIFT - sp.get_score(i)) for i in plain}
        scale = alpha * len(plain) / sum(weight.values())
        get = lambda i: [c.get(i, 0) + (scale * weight[i] if i in weight else alpha) for c in counts]
        first, more, byte = {"": [alpha] * len(counts)}, {}, {x: [alpha] * len(counts) for x in range(256)}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte[int(piece[1:-1], 16)] = get(i)
            elif i in weight and OPEN not in piece[1:]:
                (first if piece[:1] == OPEN else more)[piece.removeprefix(OPEN)] = get(i)
        a, b, c = (np.array(list(x.values()), float) for x in (first, more, byte))
        stop = np.array(get(STOP), float)
        rest = b.sum(axis=0) + c.sum(axis=0) + stop
        self.first, self.more = {x: i for i, x in enumerate(first)}, {x: i for i, x in enumerate(more)}
        self.first_logs, self.more_logs, self.byte_logs, self.stop = np.log(a / a.sum(axis=0)), np.log(b / rest), np.log(c / rest), np.log(stop / rest)
        self.longest = min(LONGEST, max(map(len, [*first, *more])))

    def forward(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the probability that pieces spell each word, summed over all segmentations, in each class."""
        texts = [w.decode("utf-8", "surrogateescape") for w in words]
        out = np.zeros((len(texts), len(self.stop)))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        for n in np.unique(size):
            o = np.flatnonzero(size == n)
            out[o] = self._forward([texts[i] for i in o], int(n))
        return out

    def _forward(self, texts: list[str], n: int) -> np.ndarray:
        """All texts have n characters."""
        first, more = self.first.get, self.more.get
        alpha = np.full((n + 1, len(texts), len(self.stop)), -np.inf)
        alpha[0] = self.first_logs[self.first[""]]  # the bare opening piece; a first piece with text starts its own path
        kinds = {c: i for i, c in enumerate(sorted(set("".join(texts))))}
        logs = np.array([self.byte_logs[list(c.encode("utf-8", "surrogateescape"))].sum(axis=0) for c in kinds]).reshape(len(kinds), -1)
        for e in range(1, n + 1):
            now = alpha[e - 1] + logs[[kinds[t[e - 1]] for t in texts]]
            for s in range(max(0, e - self.longest), e):
                i = np.array([more(t[s:e], -1) for t in texts])
                o = np.flatnonzero(i >= 0)
                if len(o):
                    now[o] = np.logaddexp(now[o], alpha[s, o] + self.more_logs[i[o]])
            if e <= self.longest:
                i = np.array([first(t[:e], -1) for t in texts])
                o = np.flatnonzero(i >= 0)
                if len(o):
                    now[o] = np.logaddexp(now[o], self.first_logs[i[o]])
            alpha[e] = now
        return alpha[n] + self.stop


class Totals:
    """Tokens and distinct words of training: in all, and with ends in each class."""

    def __init__(self, ends: list[int], words: list[int], types: list[int], all_types: int):
        self.ends, self.words, self.types, self.all_types = np.array(ends, float), np.array(words, float), np.array(types, float), all_types
        self.tokens = int(sum(ends) + sum(words))
        self.distinct = all_types + (sum(ends) > 0)

    def end_logs(self) -> np.ndarray:
        """The end's log probability in each class."""
        return np.log(self.ends / (self.ends + self.words)) if self.tokens else np.log(np.full(1, 0.5))


def _score_words(lattice: Lattice, t: Totals, arcs: bool = True):
    """(word, c, lp0, ...): count in training and the marginal in each class, natural log."""
    classes = len(t.ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = max(t.words.sum(), 1)
        for b in batches:
            c = np.stack([b[f"c{k}"].to_numpy() for k in range(classes)], axis=1).astype(float)
            lp = lattice.forward(as_bytes(b["word"]))
            if t.tokens and not arcs:
                lp = lp + np.log(t.words.sum() / t.tokens)
            elif t.tokens:
                with np.errstate(divide="ignore"):
                    whole = np.log(np.maximum(c.sum(axis=1) - DISCOUNT, 0) / seen)[:, None]
                    lp = np.logaddexp(lp + np.log(DISCOUNT * t.all_types / seen), whole)
                    own = np.log(np.maximum(c - DISCOUNT, 0) / (t.words + t.ends))
                    lp = np.logaddexp(lp + np.log(DISCOUNT * t.types / (t.words + t.ends)), own)
            else:
                lp = lp + np.log(0.5)
            yield pa.RecordBatch.from_arrays([b["word"], pa.array(c.sum(axis=1).astype(np.int64)), *map(pa.array, lp.T.copy())], ["word", "c", *(f"lp{k}" for k in range(classes))])

    return run


def _sum_head(key: str, words: list[bytes], c: np.ndarray, lp: np.ndarray):
    """Per document one row with the sums over frequent words, and a row for each other word in it."""
    classes = lp.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = large(key, lambda: {w: k for k, w in enumerate(words)}).get
        names = ["id", "h", "copies", "n", "known", "word", "log_c", *(f"lp{k}" for k in range(classes))]
        base, good, none = np.log10(c + 0.1), (c > 0).astype(np.int64), [0.0] * (classes + 1)
        for b in batches:
            kinds = [b["id"].type, *[pa.int64()] * 4, pa.binary(), *[pa.float64()] * (classes + 1)]
            for k in range(0, b.num_rows, 256):
                some = b.slice(k, 256)
                rows: list[tuple] = []
                for i, h, text in zip(some["id"].to_pylist(), some["h"].to_pylist(), as_bytes(some["b"]), strict=True):
                    found = text.lower().split()
                    at = [get(w, -1) for w in found]
                    a = np.array(at, np.int64)
                    o = a[a >= 0]
                    rows.append((i, h, 1, len(o), int(good[o].sum()), None, float(base[o].sum()), *lp[o].sum(axis=0).tolist()))
                    if len(o) < len(a):
                        rows += [(i, h, 0, n, 0, w, *none) for w, n in Counter([w for w, x in zip(found, at, strict=True) if x < 0]).items()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _least_count(scored: DataFrame, head: int) -> int:
    """The smallest count that at most head words reach, to within an eighth of an octave."""
    step = F.floor(8 * F.log2(F.col("c") + 1))
    rows = scored.where("c > 0").groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect()  # some hundred at most
    least = 1 << 62
    for r in rows:
        head -= r.n
        if head < 0:
            break
        least = r.c
    return least


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None, held_out: str | None = None, vocabulary: str | None = None, head: int = HEAD, arcs: bool = True) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10).

    held_out: SQL condition over the id column; documents that meet it are scored but not learned from.
    class_col: a column of the training documents; it is not looked at when a document is scored. arcs: whole words are
    arcs too; without them, the pieces alone score (to see what each layer does).
    """
    bound_batches(docs.sparkSession)
    held_out = held_out or f"crc32(cast(cast(`{id_col}` as string) as binary)) % 10 = 0"
    path = vocabulary or vocabulary_file()
    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(F.expr(held_out), F.lit(False))
    label = F.col(class_col).cast("string") if class_col else F.lit(None).cast("string")
    d = docs.select(F.col(id_col).alias("id"), held.alias("held"), label.alias("label"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("b"))

    sizes = d.where("not held").groupBy("label").agg(F.count("*").alias("n"))
    named = [r.label for r in sizes.where("label is not null").orderBy(F.desc("n"), "label").limit(CLASSES - 1).collect()]
    k = F.lit(0)  # the rarer classes; empty if the names are all there are
    for i, x in enumerate(named):
        k = F.when(F.col("label") == x, i + 1).otherwise(k)
    by_class = {r.k: r.n for r in sizes.groupBy(k.alias("k")).agg(F.sum("n").alias("n")).collect()}
    order = sorted(by_class) or [0]
    place = F.lit(None).cast("int")
    for i, x in enumerate(order):
        place = F.when(k == x, i).otherwise(place)
    classes = len(order)

    words = d.select("b", F.when(~F.col("held"), place).alias("k")).mapInArrow(tidy(_count_words), "word binary, k int, c long")
    words = cut(words.groupBy("word").agg(*(F.sum(F.when(F.col("k") == i, F.col("c")).otherwise(0)).alias(f"c{i}") for i in range(classes))), "lm-counts")
    cs = [F.col(f"c{i}") for i in range(classes)]
    total = words.agg(*(F.sum(c) for c in cs), *(F.count(F.when(c > 0, 1)) for c in cs), F.count(F.when(sum(cs[1:], cs[0]) > 0, 1))).first()
    t = Totals([by_class.get(x, 0) for x in order], [x or 0 for x in total[:classes]], list(total[classes : 2 * classes]), total[-1])

    pieces = words.mapInArrow(tidy(_segment(path, classes)), "k int, piece long, n long").groupBy("k", "piece").agg(F.sum("n").alias("n"))
    counts: list[dict[int, int]] = [{} for _ in order]
    for r in pieces.collect():  # at most the vocabulary's size in each class
        counts[r.k][r.piece] = r.n
    lps = [f"lp{i}" for i in range(classes)]
    scored = cut(words.mapInArrow(tidy(_score_words(Lattice(path, counts), t, arcs)), f"word binary, c long, {', '.join(f'{x} double' for x in lps)}"), "lm-scores")

    top = scored.where(F.col("c") >= _least_count(scored, head)).toPandas()
    key = f"{id(top)}-{t.tokens}-{scored.inputFiles()[:1]}"
    schema = f"id {kind}, h long, copies long, n long, known long, word binary, log_c double, {', '.join(f'{x} double' for x in lps)}"
    rows = d.withColumn("h", F.xxhash64("b")).select("id", "h", "b").mapInArrow(tidy(_sum_head(key, [bytes(x) for x in top["word"]], top["c"].to_numpy(), top[lps].to_numpy())), schema)
    rows = cut(rows, "lm-rows")
    rare = rows.where("word is not null").select("id", "h", "n", "word").join(scored.hint("merge"), "word")
    n = F.col("n")
    rare = rare.select("id", "h", F.lit(0).cast("long").alias("copies"), "n", F.when(F.col("c") > 0, n).otherwise(0).alias("known"), (n * F.log10(F.col("c") + 0.1)).alias("log_c"), *((n * F.col(x)).alias(x) for x in lps))
    s = rows.where("word is null").drop("word").unionByName(rare).groupBy("id", "h").agg(*(F.sum(x).alias(x) for x in ("copies", "n", "known", "log_c", *lps)))
    s = s.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).withColumn(id_col, F.col("id"))
    per = lambda x: F.col(x) / F.col("copies")
    # log of the sum over classes of share * marginal
    share = np.log(t.ends / t.ends.sum()) if t.tokens else np.zeros(1)
    paths = [per(x) + float(a) for x, a in zip(lps, share + t.end_logs(), strict=True)]
    best = F.greatest(*paths) if classes > 1 else paths[0]
    marginal = best + F.log(sum((F.exp(x - best) for x in paths), F.lit(0.0)))
    z = math.log10(t.tokens + 0.1 * (t.distinct + 1))
    ends = int(t.ends.sum())
    return s.select(
        id_col,
        F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"),
        (per("n") + 1).cast("long").alias("n_tokens"),
        (per("known") + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(t.tokens).cast("long").alias("train_tokens"),
        (per("log_c") + math.log10(ends + 0.1) - (per("n") + 1) * z).alias("base_score"),
        (marginal / math.log(10)).alias("score"),
    )
