import math
import random
import re
import zlib
from collections import Counter

import pytest

from tuplequarry.llm.langid import identify_documents

SYLLABLES = {"aa": ["ka", "ro", "mi"], "bb": ["sch", "en", "ü"], "cc": ["tion", "que", "ro"]}


def test_held_out(spark):
    r = random.Random(1)
    rows = []
    for i in range(300):
        lang = r.choice(list(SYLLABLES))
        w = ["".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4))) for _ in range(r.randint(3, 40))]
        rows.append((i, " ".join(w).title(), lang if r.random() < 0.9 else None))
    truth = {i: max(SYLLABLES, key=lambda x: sum(t.lower().count(s) for s in SYLLABLES[x])) if y is None else y for i, t, y in rows}
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !? _ \u00b2 \u0301", "cc"), (1003, "漢字", None), (1003, "漢字", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as lang_pred", "0 as id")
    got = identify_documents(df).collect()
    assert len(got) == len(rows)
    held = [x for x in got if x.held_out and x.doc_id < 1000]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 for x in got)
    assert sum(x.lang_pred == truth[x.doc_id] for x in held) > 0.95 * len(held)
    assert {x.lang_pred for x in got if x.doc_id in (1000, 1001, 1002)} == {"und"}
    assert {x.lang_pred for x in got if x.doc_id == 1003} <= set(SYLLABLES)
    assert identify_documents(df.limit(0)).count() == 0
    assert {x.lang_pred for x in identify_documents(df.withColumn("lang", df.text.substr(1, 0).cast("string")).selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def brute(rows, train):
    """Word-first back-off with dictionaries of strings."""
    langs = sorted({y for *_, y in train})
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    seen = {x: Counter(w for _, t, y in train if y == x for w in words(t)) for x in langs}
    grams = {}
    for x in langs:
        for w, c in seen[x].items():
            for n in range(1, 6):
                for i in range(len(w) + 3 - n):
                    grams.setdefault(n, {}).setdefault(f"^{w}$"[i : i + n], Counter())[x] += c
    log = lambda c, total, kinds: math.log((c + 0.5) / (total + 0.5 * (kinds + 1)))
    kinds = len(set().union(*seen.values()))
    out = []
    for i, t, _ in rows:
        total = dict.fromkeys(langs, 0.0)
        found = words(t)
        for w in found:
            if any(w in seen[x] for x in langs):
                for x in langs:
                    total[x] += log(seen[x][w], sum(seen[x].values()), kinds)
                continue
            text, at = f"^{w}$", 0
            while at < len(text):
                n = next((n for n in range(min(5, len(text) - at), 0, -1) if text[at : at + n] in grams.get(n, {})), 0)
                if n:
                    a = [log(grams[n][text[at : at + n]][x], sum(c[x] for c in grams[n].values()), len(grams[n])) for x in langs]
                    for x, y in zip(langs, a, strict=True):
                        total[x] += y - max(a)
                at += max(1, n - 1)
        if not any(c.isalpha() for w in found for c in w):
            out.append((i, "und", 0.0))
            continue
        p = {x: math.exp((total[x] - max(total.values())) * min(1, 20 / len(found))) for x in langs}
        best = max(langs, key=p.get)
        out.append((i, best, p[best] / sum(p.values())))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    """Unseen and known words, very long ones, ties, capitals, texts of many lines."""
    r = random.Random(seed)
    rows = []
    for i in range(160):
        lang = r.choice(list(SYLLABLES))
        w = ["".join(r.choices(SYLLABLES[lang] + ["Ä", "x"], k=r.randint(1, 5))) for _ in range(r.randint(1, 12))]
        rows.append((i, r.choice([" ", "\n", "7", "_"]).join(w), lang))
    rows += [(900, "ka" * 3000 + " Zz" * 400, "aa"), (901, "ξ ж", "bb"), (902, "", "aa"), (903, None, "aa"), (904, "²", "cc"), (905, " ".join(f"{'ro' * (k % 90)}q" for k in range(4000)), "cc")]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    got = sorted((x.doc_id, x.lang_pred, x.score) for x in identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect())
    want = brute(rows, [x for x in rows if x[0] not in held and x[1] is not None])
    assert [x[0] for x in got] == [x[0] for x in want]
    for a, b in zip(got, want, strict=True):
        assert a[1] == b[1] or abs(b[2] - 0.5) < 1e-3 and abs(a[2] - b[2]) < 1e-3
        assert abs(a[2] - b[2]) < 1e-4


def test_ties_go_to_the_first(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2][:40]
    rows = [(i, "same words", ["bb", "aa"][k % 2]) for k, i in enumerate(ids)] + [(1000, "qqq", None)]
    got = identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id = 1000").first()
    assert (got.lang_pred, got.score) == ("aa", 0.5)
