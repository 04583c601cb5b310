import random
import re
from collections import Counter

import numpy as np

from tuplequarry.llm.quality import fit, judge


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + j for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_features(spark):
    r = random.Random(4)
    texts = ["".join(r.choices(["a ", "bé ", "Ç\n", "#$ ", "\n", "one two three ", " x ", "\x1c ", "\t"], k=r.randrange(80))) for _ in range(80)]
    texts += [None, "", " \n ", "a b c a b c", "x\nx\nx", "word " * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as id", "2 as n_words", "3 as votes")
    got = judge(df).collect()
    assert len(got) == len(texts)
    for x in got:
        n = brute(texts[x.doc_id])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == n
        assert x.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (x.kept and x.base_failed)
    assert judge(df.limit(0)).count() == 0


def test_long_texts_ties_and_rows_without_id(spark):
    half = " ".join(["a b c"] * 10 + [f"w{i}" for i in range(30)])  # 30 of 60 words repeat: a tie
    rows = [(1, "ab " * 400_000), (2, " ".join(f"x{i}" for i in range(50))), (3, " ".join(f"x{i}" for i in range(49))), (4, half), (None, half), (None, None), (5, "x" * 2_000_000)]
    got = judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for t, x in zip([t for _, t in sorted(rows, key=lambda y: (str(y[0]), y[1] or ""))], sorted(got, key=lambda y: (str(y.doc_id), y.n_words)), strict=True):
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute(t)
    failed = {x.doc_id: x.base_failed for x in got if x.doc_id}
    assert failed == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_em_finds_accuracies():
    r = np.random.default_rng(1)
    good = r.random(20000) < 0.7
    code = np.zeros(20000, int)
    for k, (acc, seen) in enumerate([(0.9, 1.0), (0.8, 0.6), (0.85, 0.9), (0.5, 1.0), (0.7, 0.8)]):
        right = r.random(20000) < acc
        code += np.where(r.random(20000) < seen, np.where(right == good, 2, 1), 0) * 3**k
    p, n = np.unique(code, return_counts=True)
    post = dict(zip(p, fit(p.tolist(), n.tolist(), 5), strict=True))
    assert np.mean([(post[c] >= 0.5) == g for c, g in zip(code, good, strict=True)]) > 0.9
    assert fit([], [], 3).tolist() == []
