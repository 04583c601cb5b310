import random
import zlib
from collections import defaultdict

import numpy as np

from tuplequarry.llm.packing import encoder, pack_documents, pack_histogram, tokenizer_files


def test_histogram_respects_capacities():
    r = random.Random(1)
    for rule in ("norm", "dot"):
        for docs, cost in ((100, 10**6), (3, 10**6), (100, 5000)):
            counts = {k: r.randrange(1, 40) for k in r.sample(range(1, 65), 30)}
            bins = defaultdict(list)
            for length, runs in pack_histogram(counts, 100, docs, cost, rule=rule).items():
                for (rank, first, offset), end in zip(runs, [*(x[0] for x in runs[1:]), counts[length]], strict=True):
                    for k in range(end - rank):
                        bins[first + k].append((offset, length))
            assert sum(map(len, bins.values())) == sum(counts.values())
            for x in bins.values():
                x.sort()
                assert all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and x[0][0] == 0
                assert sum(n for _, n in x) <= 100 and len(x) <= docs and sum(n * n for _, n in x) <= cost


def test_documents(spark):
    from tokenizers import Tokenizer

    r = random.Random(2)
    words = ["the", "Über", " straße", "x" * 30, "12345", "\n\n", "<|endoftext|>", "don't", "  "]
    docs = [(i, " ".join(r.choices(words, k=r.choice([0, 1, 5, 50, 400, 3000])))) for i in range(60)]
    docs += [(60, None), (61, ""), (61, ""), (62, "a" * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as length", "3 as rank").repartition(4)
    rows = pack_documents(df).collect()
    t = Tokenizer.from_file(tokenizer_files()[0])
    want = defaultdict(int)
    for d, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        at = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        for k in range(len(at) - 1):
            x = np.array(ids[at[k] : at[k + 1]], "<u4")
            want[d, k, at[k], len(x), zlib.crc32(x.tobytes())] += 1
    got = defaultdict(int)
    bins = defaultdict(list)
    for x in rows:
        got[x.doc_id, x.piece, x.start, x.length, x.ids_crc32] += 1
        bins[x.sequence_id].append((x.offset, x.length))
    assert got == want
    total = sum(x.length for x in rows)
    assert len(bins) <= -(-total // 1024) + 1
    for x in bins.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(n for _, n in x) <= 1024
    assert pack_documents(df.limit(0)).count() == 0


def test_encoder_takes_extreme_texts():
    encode = encoder(tokenizer_files())
    assert len(encode(" " * 200_000)) > 0 and len(encode("ab" * 100_000)) > 0


def test_ids_of_all_documents():
    """The ranks and the tokenizer file give equal ids, on every document of a table."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    encode = encoder(tokenizer_files())
    t = Tokenizer.from_file(tokenizer_files()[0])
    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    for x, want in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(x) == want.ids


def test_all_capacities_bind(spark):
    """Document count and attention cost bind in a Spark run, by both rules; rows without id; repeated rows."""
    r = random.Random(4)
    docs = [(i, "word " * r.choice([1, 2, 3, 3, 40, 60])) for i in range(300)] + [(None, "word word"), (None, None), (5, "x"), (5, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for rule in ("norm", "dot"):
        most = []
        for more, cost in ((6, 5000), (6, 128 * 128), (128, 128 * 128)):
            bins = defaultdict(list)
            for x in pack_documents(df, capacity=128, max_docs=more, max_cost=cost, rule=rule).collect():
                bins[x.sequence_id].append((x.offset, x.length))
            most.append((max(map(len, bins.values())), max(sum(n * n for _, n in x) for x in bins.values())))
            assert sum(map(len, bins.values())) == len(docs)
            for x in bins.values():
                x.sort()
                assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False))
                assert sum(n for _, n in x) <= 128 and len(x) <= more and sum(n * n for _, n in x) <= cost
        # each capacity binds: it is exceeded without it
        assert most[0][0] <= 6 < most[2][0] and most[0][1] <= 5000 < most[1][1]
