"""Whole texts come back from relations that hold them compressed or in another encoding."""

import pytest

from tuplequarry import queries


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Texts that differ late only, and some that no page holds, compressed or not."""
    words = lambda n, seed: " ".join(f"{(k * seed) % 99_991:x}é" for k in range(n))
    rows = [(1, "short", "en"), (2, "ab" * 3000 + "end two", "en"), (3, "x" * 200_000 + "end three", "de"), (4, words(20_000, 7919), "fr"), (5, words(3000, 104_729), "fr"), (6, None, None), (7, "", "en")]
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return path, {r[0]: r for r in rows}


@pytest.mark.parametrize("method", ["pglz", "lz4"])
def test_inline_compressed(spark, sf_dir, method):
    path, want = sf_dir
    assert {r.doc_id: tuple(r) for r in queries.QUERIES[f"inline_compressed_{method}"](spark, path).collect()} == want


def test_latin1(spark, sf_dir):
    path, want = sf_dir
    assert {r.doc_id: tuple(r) for r in queries.QUERIES["encoding_latin1"](spark, path).collect()} == want
