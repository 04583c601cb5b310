"""The pipeline's stages, each held against a brute-force version on its own input."""

import random
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from tuplequarry.llm import queries

from . import test_decontam, test_jaccard, test_suffix_dedup

SYLLABLES = {"aa": ["ka", "ro", "mi", "to", "lu"], "bb": ["sch", "en", "ü", "berg"], "cc": ["tion", "que", "ès"]}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(9)
    word = lambda lang: "".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4)))
    passage = " ".join(word("bb") for _ in range(90))  # over 400 bytes
    shorter = " ".join((word("bb") + "abc")[:5] for _ in range(54))  # over 50 words in less than 400 bytes
    fewer = " ".join("longish" + word("cc") for _ in range(18))  # over 256 bytes in less than 51 words
    assert 256 < len(fewer.encode()) < 400 and 256 < len(shorter.encode()) < 400
    items = [(i, " ".join(word("cc") for _ in range(14))) for i in range(6)]
    rows = []
    for i in range(120):
        lang = r.choice(list(SYLLABLES))
        w = [word(lang) for _ in range(r.randint(5, 160))]
        if i % 10 == 0:
            w[3:3] = passage.split()
        if i % 10 in (3, 5):
            w[3:3] = (shorter if i % 10 == 3 else fewer).split()
        if i % 9 == 0:
            w[2:2] = items[i % 6][1].split()
        text = " ".join(w)
        if rows and i % 4 == 0:
            text = rows[r.randrange(len(rows))][1]
            if i % 8 == 0:
                text += " end"
        rows.append((1000 + i * 7 % 400, text, lang, f"src{i % 3}", len(text)))
    rows += [(5, None, "aa", "s", 0), (6, "", None, "s", 0), (7, "!!! 123 ---", "aa", "s", 11), rows[3], rows[3]]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, items


def test_stages(spark, tables, tmp_path):
    d, rows, items = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        found[name] = [tuple(x) for x in docs.collect()]
    corpus_pipeline.enter_scope(spark, None)

    kept = [x for x in rows if x[0] not in (5, 6, 7)]
    first = found["language_id"]
    assert Counter((x[0], x[1], x[3]) for x in first) == Counter((x[0], x[1], x[3]) for x in kept)

    groups = {i: c for i, _, c in test_jaccard.brute(sorted({(x[0], x[1]) for x in first}))}
    assert sorted(x[0] for x in found["ngram_jaccard_join"]) == sorted(i for i, c in groups.items() if i == c)

    before = {x[0]: x[1] for x in found["ngram_jaccard_join"]}
    raw = [(i, t.encode()) for i, t in sorted(before.items())]
    seen = {n: Counter(t[k : k + n] for _, t in raw for k in range(len(t) - n + 1)) for n in (256, 400)}
    want, runs = {}, []
    for i, t in raw:
        cover = {n: bytearray(len(t)) for n in seen}
        for n, gone in cover.items():
            for k in range(len(t) - n + 1):
                if seen[n][t[k : k + n]] > 1:
                    gone[k : k + n] = b"\x01" * n
        gone = cover[400]
        for m in re.finditer(rb"\x01+", cover[256]):
            runs.append((m.end() - m.start(), len(t[m.start() : m.end()].split())))
            if runs[-1][1] > 50:
                gone[m.start() : m.end()] = m[0]
        text = bytes(x for x, y in zip(t, gone, strict=True) if not y).decode("utf-8", "ignore")
        if text.strip(" \t\n\v\f\r") or not any(gone):
            want[i] = text
    after = {x[0]: x[1] for x in found["suffix_array_dedup"]}
    assert after == want and any(len(after[i]) < len(before[i]) for i in after)
    assert any(n < 400 and many > 50 for n, many in runs) and any(many <= 50 for _, many in runs)
    assert all(x[4] == len(x[1]) for x in found["suffix_array_dedup"])

    dirty = {x[0] for x in test_decontam.brute(list(after.items()), items) if x[5]}
    clean = {x[0]: x[1] for x in found["benchmark_decontamination"]}
    assert dirty and clean == {i: t for i, t in after.items() if i not in dirty}

    packed = found["best_fit_packing"]
    assert {x[0] for x in packed} == set(clean)
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).drop("sequence_id", "offset").collect())) == sorted(x[:5] for x in packed)


def test_rows_without_id_are_judged(spark, tmp_path):
    r = random.Random(5)
    text = lambda n: " ".join("".join(r.choices("abcdefgh", k=7)) for _ in range(n))
    a, b, lone, passage, item = text(40), text(40), text(40), text(70), text(20)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = lambda f, rows: sorted((x[0] or 0, x[1]) for x in f(spark, spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path)).collect())
    got = stage(corpus_pipeline.near_duplicate, [(1, a), (None, a + " end"), (None, b), (None, b), (None, lone), (None, ""), (None, ""), (2, "!!!"), (None, "!!!")])
    assert (1, a) in got and got == sorted([(1, a), (0, b), (0, lone), (0, ""), (0, ""), (2, "!!!")])
    got = stage(corpus_pipeline.repeats, [(1, "one " + passage), (None, passage + " two"), (None, lone)])
    assert got == sorted([(1, "one"), (0, "two"), (0, lone)]) or got == sorted([(1, "one "), (0, " two"), (0, lone)])
    assert stage(corpus_pipeline.decontamination, [(1, a), (None, lone + " " + item), (None, b)]) == sorted([(1, a), (0, b)])
    corpus_pipeline.enter_scope(spark, None)


def test_stages_on_odd_tables(spark, tmp_path):
    """An empty table, a very long text, rows that repeat, nulls in every column, and further columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, doc long, b string, ranges int, comp int, h string"
    spark.createDataFrame([(1, "an item of the benchmark that nobody has")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    r = random.Random(8)
    long = " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(150_000))
    rows = [(1, long, "aa", "s", len(long), 1, "x", 2, 3, "y"), (2, "some short text here", "aa", None, None, 1, "x", 2, 3, "y"), (3, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (4, "", "aa", "s", 0, 1, "x", 2, 3, "y")]
    rows += rows[1:2]
    for name, stage in corpus_pipeline.STAGES:
        got = [x.doc_id for x in stage(spark, spark.createDataFrame(rows, schema), str(tmp_path)).collect()]
        assert 1 in got and 2 in got, name
        if name in ("ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination"):
            assert {3, 4} <= set(got) and None in got
        if name == "ngram_jaccard_join":
            assert got.count(2) == 1
        assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0, name
    corpus_pipeline.enter_scope(spark, None)


def test_registered_queries():
    names = [x for x in queries.queries() if x.startswith("op")]
    assert [int(x[2:].split("_")[0]) for x in names] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries()) and corpus_pipeline.ORACLE_SQL is None
    assert zlib.crc32(b"1") and test_suffix_dedup.brute([], 9) == []
