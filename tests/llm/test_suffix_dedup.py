import hashlib
import random
import re
from collections import Counter

import pytest

from tuplequarry.llm.suffix_dedup import remove_repeats


def brute(docs, length):
    seen = Counter(t[i : i + length] for _, t in docs for i in range(len(t) - length + 1))
    out = []
    for d, t in docs:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, y in zip(t, gone, strict=True) if not y)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, docs, length, more=()):
    rows = [(i, None if t is None else t.decode()) for i, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r)[:5] for r in remove_repeats(df.selectExpr("*", *more), length=length).collect()), key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize(("seed", "length", "letters"), [(1, 12, 3), (2, 20, 26), (3, 16, 1), (4, 33, 4), (5, 64, 6)])
def test_against_brute_force(spark, seed, length, letters):
    r = random.Random(seed)
    base = [bytes(r.choice(b"abcdefghijklmnopqrstuvwxyz"[:letters]) for _ in range(r.randrange(300))) for _ in range(20)]
    docs = []
    for i in range(60):
        t = b"".join(x[(a := r.randrange(len(x) + 1)) : r.randrange(a, len(x) + 1)] for x in r.sample(base, 4))
        docs.append((i, docs[-1][1] if docs and r.random() < 0.1 else t))
    assert run(spark, docs, length) == brute(docs, length)


@pytest.mark.parametrize(("seed", "short", "long"), [(1, 16, 30), (2, 24, 45), (3, 40, 64)])
def test_passages_and_length_in_one_run(spark, seed, short, long):
    r = random.Random(seed)
    word = lambda: bytes(r.choices(b"abc", k=r.randint(1, 4)))
    base = [b" ".join(word() for _ in range(r.randrange(2, 40))) for _ in range(15)]
    docs = [(i, b" ".join(r.choice(base)[r.randrange(20) :] if r.random() < 0.6 else b" ".join(word() for _ in range(30)) for _ in range(3))) for i in range(50)]
    df = spark.createDataFrame([(i, t.decode()) for i, t in docs], "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in remove_repeats(df, length=long, passage=short, words=6).collect()}
    assert sorted(tuple(x)[:5] for x in got.values()) == brute(docs, long)
    seen = Counter(t[i : i + short] for _, t in docs for i in range(len(t) - short + 1))
    for i, t in docs:
        gone = bytearray(len(t))
        for k in range(len(t) - short + 1):
            if seen[t[k : k + short]] > 1:
                gone[k : k + short] = b"\x01" * short
        runs = [m.span() for m in re.finditer(rb"\x01+", gone)]
        assert got[i].n_passage_bytes == sum(b - a for a, b in runs if len(t[a:b].split()) > 6)


def test_long_texts_and_hot_passages(spark):
    """One passage in many different documents, at every offset, beside texts of some megabytes."""
    r = random.Random(3)
    passage = bytes(r.choices(b"abcdefghij ", k=430))
    noise = lambda n: bytes(r.choices(b"klmnopqrstuvwxyz ", k=n))
    docs = [(i, noise(i) + passage + noise(r.randrange(300))) for i in range(400)]
    docs += [(1000, noise(1_500_000) + passage[:399]), (1001, noise(10) + passage[20:420] + noise(1_000_000))]
    assert run(spark, docs, 400) == brute(docs, 400)


def test_edges(spark):
    t = "äöü some text that is repeated, ".encode() * 3
    docs = [(1, t), (1, t), (2, b""), (3, b"short"), (4, t + b"tail")]
    assert run(spark, docs, 16, ["'x' as h", "1 as n"]) == brute(docs, 16)
    assert run(spark, [(1, None)], 16) == brute([(1, b"")], 16)
    # rows without id are judged like others
    got = run(spark, [(None, t), (None, t), (2, t[:96])], 20)
    assert [x[1:] for x in got if x[0] is not None] == [x[1:] for x in brute([(0, t), (1, t), (2, t[:96])], 20)][2:]
    assert [x[1:] for x in got if x[0] is None] == [x[1:] for x in brute([(0, t), (1, t), (2, t[:96])], 20)][:2]
    with pytest.raises(TypeError):
        remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    assert run(spark, [], 16) == []
