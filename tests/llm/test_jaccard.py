import random
import re

import pytest

from tuplequarry.llm.jaccard import near_duplicate_links, near_duplicates


def brute(docs):
    sets = []
    for _, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = {d: d for d, _ in docs}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (a, _) in enumerate(docs):
        for j, (b, _) in enumerate(docs[:i]):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                u, v = find(a), find(b)
                comp[max(u, v)] = min(u, v)
    return sorted((d, len(s), find(d)) for (d, _), s in zip(docs, sets, strict=True))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    common = r.choices(vocab, k=60)
    for i in range(240):
        kind = r.random()
        if docs and kind < 0.6:
            w = r.choice(docs)[1].split()
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
            w = w[: len(w) - r.choice([0, 0, 3])]
        else:
            w = r.choices(vocab, k=r.choice([0, 1, 3, 5, 6, 20, 60, 120]))
            if kind > 0.8:
                w = w[:10] + common + w[10:15]
        docs.append((r.choice([1, 1000]) * 1000 + i, r.choice([" ", "\n"]).join(w)))
    docs.append((5, None))
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr("*", "1 as n", "'z' as rep", "3 as comp")
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in near_duplicates(df).collect())
    want = brute(docs)
    assert got == want
    # hot tokens dealt over salts, large buckets refined by all orders
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in near_duplicates(df, hot=3, few=2).collect())
    assert got == want
    assert len({c for _, _, c in want}) < len(want) - 40


def test_edges(spark):
    t = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(7, t), (7, t), (3, t.upper()), (9, ""), (None, t), (8, "one two"), (10, "ONE two"), (11, "two one")], "doc_id long, text string")
    got = sorted(((x.doc_id, x.component_id) for x in near_duplicates(df).collect()), key=str)
    assert got == sorted([(7, 3), (7, 3), (3, 3), (9, 9), (None, None), (8, 8), (10, 8), (11, 11)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(TypeError):
        near_duplicates(df.selectExpr("cast(doc_id as string) as doc_id", "text"))


def test_all_links_of_a_group(spark):
    r = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 6):
            w[r.randrange(len(w))] = f"x{r.randrange(50)}"
        docs.append((i, " ".join(w)))
    docs += [(100, docs[1][1]), (101, "other words " * 9), (102, None)]
    shingles = {}
    for i, t in docs:
        w = (t or "").split()
        if w:
            shingles.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)), i)
    want = {(i, j) for x, i in shingles.items() for y, j in shingles.items() if i < j and 100 * len(x & y) >= 75 * len(x | y)}
    got = [tuple(x) for x in near_duplicate_links(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > len(shingles)
    assert len({x for p in want for x in p}) < len(shingles)


def test_a_token_in_thousands_of_unlike_documents(spark):
    """One short passage opens documents that have nothing else in common; among them a few near copies. Very long texts."""
    r = random.Random(7)
    words = lambda n: [f"q{r.randrange(10**9)}" for _ in range(n)]
    docs = [(i, " ".join([*"the very same five words here".split(), *words(12)])) for i in range(3000)]
    docs += [(5000 + i, docs[i][1] + " end") for i in range(0, 3000, 100)]
    long = words(60_000)
    docs += [(9000, " ".join(long)), (9001, " ".join(long[500:])), (9002, " ".join(words(30_000)))]
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), few=20, hot=500).collect()}
    want = {i: i for i, _ in docs} | {5000 + i: i for i in range(0, 3000, 100)} | {9001: 9000}
    assert got == want
