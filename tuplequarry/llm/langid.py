"""Language identification by word-first back-off.

A known word adds its log relative frequency in each language. An unseen word is scored by the longest character n-grams
that training knows: ``^word$`` is cut greedily from the left, at each place taking the longest known n-gram of at most
``ORDER`` characters (the next one begins with its last character), and each step adds the n-gram's log relative frequency
among those of its length, less the best language's; a character that is unknown too says nothing.

Training is on a bounded sample of the labelled rows: ``PER_LANGUAGE`` documents of each language on average, chosen by a
hash of the id (a fraction of each language that follows from its count). Counting the languages covers all rows. All
words and n-grams of the sample's whole texts are learned, none is left out. Prediction reads whole texts.

The score is the predicted language's share of the likelihood, with the log likelihood of a text of more than ``SURE``
words taken as if it had that many, so that it says something about confidence.

Words and n-grams are 64-bit hashes of their characters, many documents in one buffer; a slice's words are scored once
each. Memory of a task follows the model, ``SLICE`` and its largest text.

Edge cases: null text, and text without any letter, are ``und`` with score 0; ties go to the language that sorts first;
rows with null lang are not learned from; nothing to learn from: all are ``und``; repeated rows and ids are predicted
each; ids may be of any type or null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, int64, large, mix, powers, process_cache, tidy

PER_LANGUAGE, ORDER, SURE, SMOOTH = 4000, 5, 20, 0.5
SLICE, FLUSH = 1 << 18, 1 << 20  # characters scored together; items that a training task holds
UNKNOWN = "und"
FIRST, LAST = np.uint64(0x5E), np.uint64(0x24)  # ^ and $: no letters
BASE = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """Of each code point: 1 if words consist of it ([^\\W\\d_]), 3 if it is a letter too."""
    cache = process_cache()
    if "letters" not in cache:
        points = [chr(i) for i in range(sys.maxunicode + 1)]
        word = re.compile(r"[^\W\d_]")
        cache["letters"] = np.array([(3 if c.isalpha() else 1) if word.match(c) else 0 for c in points], np.uint8)
    return cache["letters"]


class Words:
    """Words of several texts, A to Z and other capitals lowered: hashes, documents, and their characters in one array."""

    def __init__(self, texts: list[str]):
        texts = [x.lower() for x in texts]
        a = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _letters()[a]
        size = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
        edge = np.diff((kind > 0).view(np.int8), prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(np.cumsum(size), self.start, side="right")
        letters = np.append(0, np.cumsum(kind == 3))
        self.alpha = (letters[self.end] > letters[self.start])
        self.chars = a
        up, down = powers(len(a) + 1)
        c = np.append(np.uint64(0), np.cumsum(mix(a.astype(np.uint64), BASE) * up[: len(a)]))
        self.hash = mix((c[self.end] - c[self.start]) * down[self.start], (self.end - self.start).astype(np.uint64))

    def marked(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chosen words with ^ in front and $ behind: characters, and each word's first and last place plus one."""
        size = self.end[which] - self.start[which]
        last = np.cumsum(size + 2)
        first = last - size - 2
        out = np.full(last[-1] if len(last) else 0, FIRST, np.uint64)
        out[last - 1] = LAST
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(first + 1, size) + k] = self.chars[np.repeat(self.start[which], size) + k]
        return out, first, last


def grams(chars: np.ndarray, n: int, before: np.ndarray | None) -> np.ndarray:
    """Polynomials of the n characters from each place on, from those of n - 1."""
    out = np.zeros(max(len(chars) - n + 1, 0), np.uint64)
    if n == 1:
        return chars * np.uint64(1)
    np.add(before[: len(out)] * BASE, chars[n - 1 :], out=out)
    return out


def _added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, place = np.unique(key, return_inverse=True)
    return u, np.bincount(place, weights=n, minlength=len(u)).astype(np.int64)


def _slices(texts: list, size: int = SLICE) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, x in enumerate(texts):
        total += len(x or "") + 1
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, item, n): hashes of words (kind 0) and of n-grams of words (kind n)."""
    held: dict[tuple[str, int], list] = {}
    kept = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, kind), parts in held.items():
            u, n = _added(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(np.full(len(u), kind, np.int32)), int64(u), int64(n)], ["lang", "kind", "item", "n"])
        held.clear()

    for b in batches:
        texts, langs = b["text"].to_pylist(), b["lang"].to_pylist()
        for i, j in _slices(texts):
            w = Words([x or "" for x in texts[i:j]])
            names = sorted(set(langs[i:j]))
            own = np.array([names.index(x) for x in langs[i:j]])[w.doc]
            for k, lang in enumerate(names):
                o = np.flatnonzero(own == k)
                u, first, n = np.unique(w.hash[o], return_index=True, return_counts=True)
                held.setdefault((lang, 0), []).append((u, n))
                chars, start, end = w.marked(o[first])
                many, stop = np.repeat(n, end - start), np.repeat(end, end - start)
                g = None
                for m in range(1, ORDER + 1):
                    g = grams(chars, m, g)
                    inside = np.arange(len(g)) + m <= stop[: len(g)]
                    held.setdefault((lang, m), []).append(_added(mix(g[inside], np.uint64(m)), many[: len(g)][inside]))
            kept = sum(len(x[0]) for parts in held.values() for x in parts)
            if kept > FLUSH:
                yield from out()
    yield from out()


class Table:
    """Rows of log relative frequencies (one column a language), found by 64-bit keys."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        o = np.argsort(keys)
        self.keys, self.logs = keys[o], logs[o]
        bits = max(1, len(keys).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.at = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)) if len(keys) else np.zeros((1 << bits) + 1, np.int64)
        self.most = int(np.diff(self.at).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's row, or -1."""
        out = np.full(len(keys), -1, np.int64)
        slot = (keys >> self.shift).astype(np.int64)
        at, end = self.at[slot], self.at[slot + 1]
        todo = np.flatnonzero(at < end)
        for k in range(self.most):
            i = at[todo] + k
            hit = self.keys[i] == keys[todo]
            out[todo[hit]] = i[hit]
            todo = todo[~hit & (i + 1 < end[todo])]
        return out


class Model:
    """What train returns, ready to predict."""

    def __init__(self, langs: list[str], words: np.ndarray, word_counts: np.ndarray, items: np.ndarray, sizes: np.ndarray, gram_counts: np.ndarray):
        self.langs = langs
        self.words = Table(words, self.logs(word_counts))
        logs = np.zeros(gram_counts.shape, np.float32)
        for n in np.unique(sizes):
            logs[sizes == n] = self.logs(gram_counts[sizes == n])  # smoothed among those of their length
        self.grams = Table(items, logs - logs.max(axis=1, keepdims=True) if logs.size else logs)

    @staticmethod
    def logs(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * (len(counts) + 1))).astype(np.float32)

    def back_off(self, w: Words, which: np.ndarray) -> np.ndarray:
        """Scores of unseen words."""
        chars, start, end = w.marked(which)
        stop = np.repeat(end, end - start)
        size, row = np.ones(len(chars), np.int64), np.full(len(chars), -1, np.int64)
        g = None
        for n in range(1, ORDER + 1):
            g = grams(chars, n, g)
            i = np.flatnonzero(np.arange(len(g)) + n <= stop[: len(g)])
            r = self.grams.find(mix(g[i], np.uint64(n)))
            i, r = i[r >= 0], r[r >= 0]
            size[i], row[i] = n, r
        out = np.zeros((len(which), len(self.langs)))
        at, live = start.copy(), np.arange(len(which))
        while len(live):
            p = at[live]
            r = row[p]
            known = r >= 0
            out[live[known]] += self.grams.logs[r[known]]
            at[live] = p + np.maximum(1, size[p] - 1)
            live = live[at[live] < end[live]]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for i, j in _slices(texts):
            some = [x or "" for x in texts[i:j]]
            w, n, count = Words(some), j - i, len(self.langs)
            u, first, place = np.unique(w.hash, return_index=True, return_inverse=True)
            row = self.words.find(u)
            logs = np.zeros((len(u), count))
            known = row >= 0
            logs[known] = self.words.logs[row[known]]
            logs[~known] = self.back_off(w, first[~known])
            total = np.stack([np.bincount(w.doc, weights=logs[place, k], minlength=n) for k in range(count)], axis=1) if count else np.zeros((n, 0))
            many = np.bincount(w.doc, minlength=n)
            lettered = np.bincount(w.doc, weights=w.alpha, minlength=n) > 0
            if count:
                total = total * np.minimum(1.0, SURE / np.maximum(many, 1))[:, None]  # no words at all make counts, not sums
                p = np.exp(total - total.max(axis=1, keepdims=True))
                best = p.argmax(axis=1)
                share = p.max(axis=1) / p.sum(axis=1)
            for k in range(n):
                good = count and lettered[k]
                names.append(self.langs[best[k]] if good else UNKNOWN)
                scores.append(float(share[k]) if good else 0.0)
        return names, scores


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE) -> tuple:
    """Fits on a sample of labelled: rows whose id hashes below per_language / the rows of their language.

    Returns Model's arguments; its size is bounded by the sample, whatever the corpus."""
    bound_batches(labelled.sparkSession)
    d = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = d.groupBy("lang").agg(F.count("*").alias("rows"))
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) * F.col("rows") < F.lit(per_language * (1 << 30))
    langs = sorted(r.lang for r in sizes.select("lang").collect())
    none, keys = np.zeros((0, len(langs))), np.zeros(0, np.uint64)
    if not langs:
        return langs, keys, none, keys, np.zeros(0, np.int64), none
    some = d.join(F.broadcast(sizes), "lang").where(share).select("lang", "text")
    counts = some.mapInArrow(tidy(_counts), "lang string, kind int, item long, n long").groupBy("kind", "item")
    t = counts.agg(*(F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).cast("int").alias(f"n{i}") for i, x in enumerate(langs))).toArrow()
    kind, item = t["kind"].to_numpy(), t["item"].to_numpy().view(np.uint64)
    n = np.stack([t[f"n{i}"].to_numpy() for i in range(len(langs))], axis=1)
    return langs, item[kind == 0], n[kind == 0], item[kind > 0], kind[kind > 0].astype(np.int64), n[kind > 0]


def identify(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns id and carry, with lang_pred and score. model: what train returned; each process gets it once."""
    bound_batches(docs.sparkSession)
    names = [id_col, *carry]
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = large(key, lambda: Model(*sent.value))
        for b in batches:
            lang, score = own.predict(b["__text"].to_pylist())
            yield pa.RecordBatch.from_arrays([*(b[x] for x in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{x}` {docs.schema[x].dataType.simpleString()}" for x in names) + ", lang_pred string, score double"
    return docs.select(*names, F.col(text_col).cast("string").alias("__text")).mapInArrow(tidy(run), schema)


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from rows whose crc32 of the id modulo 4 is not 2 and predicts all: id, held_out, lang_pred, score."""
    held = F.coalesce(F.expr(f"crc32(cast(cast(`{id_col}` as string) as binary)) % 4 = 2"), F.lit(False))
    model = train(docs.where(~held), id_col, text_col, lang_col)
    out = identify(docs, model, id_col, text_col)
    return out.select(id_col, held.alias("held_out"), "lang_pred", "score")
