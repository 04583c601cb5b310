import hashlib
import random
import re

import pytest

from tuplequarry.llm.decontam import find_benchmark

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items):
    words = lambda t: WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    windows = [(i, {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}) for i, w in ((i, words(t)) for i, t in items) if w]
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for i, own in windows:
            for x in own:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit |= set(range(k, k + len(x)))
                        found.add(str(i))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [250_000, 40])
def test_against_brute_force(spark, block):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(["The", "a", "é1", "don't", "x-y", "end."]) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 2, 3, 9, 10, 11, 30]))) for i in range(1, 25)]
    items = [x for x in items if x[1].count(" ") > 4 or x[0] % 3 == 0] + [(30, items[4][1]), (31, None), (32, "zebra!"), (33, "Zebra crossing")]
    docs = [(i, text(r.randrange(40)) + " " + r.choice(items)[1 if r.random() < 0.8 else 1].__str__() + text(5)) for i in range(60)]
    docs += [(100, None), (101, ""), (102, docs[3][1]), (102, docs[3][1]), (103, "a zebra"), (104, "zebra crossing zebra crossing"), (105, "... !")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "'y' as b")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as window", "2 as doc_id")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in find_benchmark(df, bench, block=block).collect())
    assert got == brute(docs, items)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in find_benchmark(docs, bench).collect()] == [(2, 0)]
    assert find_benchmark(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("block", [250_000, 1])
def test_long_texts_ties_and_rows_without_id(spark, block):
    """Windows whose shingles are all equally rare, texts of some megabytes, null ids of documents and items."""
    item = " ".join(f"k{i}" for i in range(12))
    noise = " ".join(f"n{i % 997}" for i in range(300_000))
    docs = [(1, f"{noise} {item} {noise}"), (2, noise), (None, f"x {item}"), (None, None), (3, " ".join(["k1 k2 k3"] * 50))]
    bench = spark.createDataFrame([(7, item), (None, "k1 k2 k3"), (8, "n1 n2")], "item_id long, text string")
    got = find_benchmark(spark.createDataFrame(docs, "doc_id long, text string"), bench, block=block).collect()
    want = brute([(d or 0, t) for d, t in docs], [(7, item), (None, "k1 k2 k3"), (8, "n1 n2")])
    assert sorted((x.doc_id or 0, x.n_words, x.n_hit) for x in got) == sorted((w[0], w[1], w[2]) for w in want)
    # items without id hit, but are not listed
    assert {x.doc_id: x.n_items for x in got if x.doc_id} == {1: 2, 2: 1, 3: 0} and {x.contaminated for x in got if x.doc_id == 3} == {True}
