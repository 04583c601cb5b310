import base64
import gzip
import hashlib
import io

from tuplequarry.llm.warc import archive_round_trip, member, read_records, record, register, write_pages


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def brute(pages, least=0):
    first = {}
    for p, _, t in pages:
        if len((t or "").encode()) >= least:
            first[t or ""] = min(first.get(t or "", p), p)
    out = []
    for p, _, t in pages:
        f = first.get(t or "", p)
        out.append((p, len((t or "").encode()), digest(t), "revisit" if f != p else "response", f if f != p else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    big = "<p>ä\r\n\r\nWARC/1.1\r\n</p>" * 30_000
    pages = [(5, "http://a/1", "x"), (3, "http://a/2", "x"), (4, None, None), (9, "u\r\nv: w", ""), (1, "http://b", big), (2, "http://b?2", big), (8, "q", big + "1")]
    pages += [(100 + i, f"http://h/{i}", "same" if i % 3 else f"own {i}") for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as payload", "'k' as digest").repartition(5)
    assert sorted(map(tuple, archive_round_trip(df).collect()), key=str) == brute(pages)
    assert sorted(map(tuple, archive_round_trip(df, least=2).collect()), key=str) == brute(pages, 2)
    assert archive_round_trip(df.limit(0)).count() == 0
    none = spark.createDataFrame([(None, None, "a"), (7, "u", "a"), (7, "u", "a")], "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in archive_round_trip(none).collect()) == [("7", "response", "None")] * 2 + [("None", "revisit", "7")]


def test_predicates_reach_the_reader(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "w")
    df = spark.createDataFrame([(i, f"http://h/{i % 4}", "same") for i in range(40)], "page_id long, url string, html string")
    write_pages(df, path)
    got = spark.read.format("warc").option("path", path).option("payload", "false").load().where("record_type = 'revisit' and target_uri in ('http://h/1', 'http://h/2')")
    assert got.count() == 20 and {r.payload for r in got.collect()} == {None}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]


def test_foreign_files():
    rec = [record([("WARC-Type", "response"), ("X-Page-Id", str(i))], b"body %d " % i * 9000) for i in range(4)]
    want = lambda f: None if f["x-page-id"] == "1" else f["x-page-id"] != "2"
    for data in (b"".join(rec), b"".join(map(gzip.compress, rec)), b"".join(map(member, rec))):
        got = [(f["x-page-id"], b) for f, b in read_records(io.BytesIO(data), want)]
        assert got == [("0", b"body 0 " * 9000), ("2", None), ("3", b"body 3 " * 9000)]
        assert [f["x-page-id"] for f, _ in read_records(io.BytesIO(data[:-40]), want)][:2] == ["0", "2"]
    assert gzip.decompress(member(rec[0])) == rec[0]
