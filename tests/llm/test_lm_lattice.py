import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tuplequarry.llm.lm_lattice import STOP, Lattice, score_documents, vocabulary_file


def test_forward_sums_all_segmentations():
    lattice = Lattice(vocabulary_file(), [{i: i % 7 for i in range(300, 20000)} | {STOP: 500}, {i: i % 5 for i in range(300, 20000)} | {STOP: 90}])
    words = ["the", "tion", "naïve", "x", "ß9"]
    got = lattice.forward([w.encode() for w in words])
    for k in (0, 1):
        more = {x: lattice.more_logs[i, k] for x, i in lattice.more.items()}
        first = {x: lattice.first_logs[i, k] for x, i in lattice.first.items()}

        def ways(x, more=more, k=k):
            p = math.exp(more[x]) if x in more else 0
            return p + (math.exp(sum(lattice.byte_logs[b, k] for b in x.encode())) if len(x) == 1 else 0)

        for word, lp in zip(words, got[:, k], strict=True):
            total = 0.0
            for cuts in itertools.product([0, 1], repeat=len(word) - 1):
                at = [0, *(j + 1 for j, c in enumerate(cuts) if c), len(word)]
                parts = [word[a:b] for a, b in zip(at, at[1:], strict=False)]
                rest = math.prod(map(ways, parts[1:]))
                total += (math.exp(first.get(parts[0], -math.inf)) + math.exp(first[""]) * ways(parts[0])) * rest
            assert lp == pytest.approx(math.log(total) + lattice.stop[k])
        assert sum(map(math.exp, more.values())) + np.exp(lattice.byte_logs[:, k]).sum() + math.exp(lattice.stop[k]) == pytest.approx(1)
        assert sum(map(math.exp, first.values())) == pytest.approx(1)
    assert np.isfinite(lattice.forward([b"a" * 5000, b"\xff\xfe"])).all()


@pytest.mark.parametrize(("head", "class_col"), [(200_000, None), (5, "lang")])
def test_documents(spark, head, class_col):
    r = random.Random(3)
    vocab = ["".join(r.choices(["th", "er", "Tion", "é", "ing"], k=r.randint(1, 5))) for _ in range(60)]
    docs = [(i, " ".join(r.choices(vocab, k=r.randrange(30)))) for i in range(150)] + [(200, None), (201, ""), (202, "x y"), (202, "x y"), (None, "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as n", "'q' as word", "case doc_id % 12 when 11 then null else doc_id % 12 end as lang")
    got = score_documents(df, head=head, class_col=class_col).collect()
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter()
    for d, t in docs:
        if not held(d):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in docs:
        w = [*words(t), None]
        want.append((d, held(d), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    key = lambda x: (str(x[0]), x[2])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] < 0
    assert score_documents(df.limit(0)).count() == 0
