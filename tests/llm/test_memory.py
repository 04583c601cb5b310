"""What a Python worker takes at once, beside an executor's heap: it follows the slice, not the Arrow batch or the table."""

import random
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa

from tuplequarry.llm import common, decontam, jaccard, suffix_dedup


def batch(*names):
    """A batch of whole texts as large as tasks get them."""
    r = random.Random(1)
    texts = [" ".join(f"w{r.getrandbits(24):x}" for _ in range(400)).encode() for _ in range(common.BATCH_BYTES // 3000)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], list(names))


def peak_mb(run, b):
    list(run(iter([b])))  # what is kept between batches is there
    tracemalloc.start()
    for _ in run(iter([b])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_batches_are_bounded_by_size(spark):
    common.bound_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 2 << 20


def test_driver_gives_back_what_its_jvm_has_freed(spark):
    jvm = spark._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    mb = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", status.read_text())[1]) / 1024
    held = [jvm.java.util.zip.Deflater() for _ in range(1500)]  # over 100 KB outside the heap, each
    for x in held[:-1]:
        x.end()
    before = mb()
    common.cut(spark.range(1), "trimmed")
    assert mb() < before - 75


def test_anchors():
    assert peak_mb(suffix_dedup._find_anchors((256, 400)), batch("doc", "b")) < 30


def test_shingle_sets():
    b, orders = batch("id", "b"), jaccard.Orders(bytes(4 * jaccard.ROWS * jaccard.WIDTH))
    assert peak_mb(jaccard._summaries(5), b) < 40  # 8 MB of sketch, and what counting a part of it takes
    assert peak_mb(jaccard._index(5, 75, orders, jaccard.HOT), b) < 20
    assert peak_mb(jaccard._prefixes(5, 75, orders), b) < 20


def test_benchmark_windows():
    b = batch("id", "b")
    words = b["b"][0].as_py().split()
    block = decontam._Block([b" ".join(words[i : i + 10]) for i in range(300)], 3)
    assert peak_mb(decontam._count(block), b) < 20
    block.rank(block.tokens, np.ones(len(block.tokens), np.int64))
    assert peak_mb(decontam._hits(block, [["a"]] * 300, ["id"]), b) < 20


def test_pairs_of_a_full_bucket_go_on_in_parts():
    """4,096 documents with a token in common, all of different components: 8 million pairs, 134 MB."""
    n = jaccard.FEW
    one = lambda x, kind: pa.array(np.full(n, x), kind)
    ids = pa.array(np.arange(n), pa.int64())
    b = pa.RecordBatch.from_arrays([one(7, pa.int64()), one(100, pa.int32()), one(0, pa.int32()), ids, ids], ["t", "n", "pos", "id", "comp"])
    found = {}

    def run(batches):
        found.update(n=0, most=0)
        for x in jaccard._across(75)(batches):
            found.update(n=found["n"] + x.num_rows, most=max(found["most"], x.num_rows))
            yield x

    assert peak_mb(run, b) < 20
    assert found["n"] == n * (n - 1) // 2 and found["most"] <= jaccard.PAIRS + n
