import random
import struct
from decimal import Decimal

import numpy as np
import pytest

from tuplequarry.kernel.compress import Corrupt, decompress, lz4_decompress, pglz_decompress
from tuplequarry.kernel.scan import carve_tuples, consistent, item_tuples, page_layout, read_pages, visibility, walk
from tuplequarry.kernel.text import Decoder, float4_text, numeric, quote_element, varlena
from tuplequarry.layout import ENCODINGS, OID, TYPES, Column, Table, catalog_table, major
from tuplequarry.testing import encoder as enc

D = Decoder(enums={9000: {7: "sad", 8: "glad"}}, roles={10: "admin", 20: "bob"})


def text(name, b):
    return D.text(OID[name], b)


@pytest.mark.parametrize(
    ("name", "raw", "want"),
    [
        ("bool", b"\1", "true"), ("bool", b"\0", "false"), ("int2", b"\xff\xff", "-1"), ("int8", b"\x01" + bytes(7), "1"), ("oid", b"\xff" * 4, "4294967295"),
        ("float8", struct.pack("<d", float("nan")), "NaN"), ("float8", struct.pack("<d", float("-inf")), "-Infinity"), ("float8", struct.pack("<d", 1e20), "1e+20"), ("float4", struct.pack("<f", 0.1), "0.1"),
        ("date", struct.pack("<i", 0), "2000-01-01"), ("date", struct.pack("<i", -10957), "1970-01-01"), ("date", struct.pack("<i", 2**31 - 1), "infinity"), ("date", struct.pack("<i", 2**30), f"date(days={2**30})"),
        ("time", struct.pack("<q", 86_400_000_000), "24:00:00"), ("time", struct.pack("<q", 500_000), "00:00:00.5"),
        ("timestamp", struct.pack("<q", 1), "2000-01-01 00:00:00.000001"), ("timestamptz", struct.pack("<q", 0), "2000-01-01 00:00:00+00"), ("timestamp", struct.pack("<q", -(2**63)), "-infinity"),
        ("timetz", struct.pack("<qi", 0, 0), "00:00:00+00:00"), ("timetz", struct.pack("<qi", 0, 18000), "00:00:00-05:00"),
        ("interval", struct.pack("<qii", 0, 0, -13), "-1 years -1 mons"), ("interval", struct.pack("<qii", 14706789000, 3, 14), "1 year 2 mons 3 days 04:05:06.789"), ("interval", struct.pack("<qii", 0, 0, 0), "00:00:00"), ("interval", struct.pack("<qii", -1_000_000, -1, 0), "-1 days -00:00:01"),
        ("money", struct.pack("<q", 2**63 - 1), "92233720368547758.07"), ("money", struct.pack("<q", -5), "-0.05"),
        ("uuid", bytes(range(16)), "00010203-0405-0607-0809-0a0b0c0d0e0f"), ("bytea", b"\0\xff", "\\x00ff"), ("bytea", b"", "\\x"),
        ("inet", bytes([2, 32, 1, 2, 3, 4]), "1.2.3.4"), ("inet", bytes([2, 24, 1, 2, 3, 0]), "1.2.3.0/24"), ("cidr", bytes([2, 32, 1, 2, 3, 4]), "1.2.3.4/32"), ("inet", bytes([3, 128]) + bytes(15) + b"\1", "0:0:0:0:0:0:0:1"),
        ("macaddr", bytes(range(6)), "00:01:02:03:04:05"), ("bit", struct.pack("<i", 9) + b"\xaa\x80", "101010101"), ("tid", struct.pack("<3H", 1, 2, 3), "(65538,3)"),
        ("point", struct.pack("<2d", 1, 2.5), "(1.0,2.5)"), ("circle", struct.pack("<3d", 1, 2, 3), "<(1.0,2.0),3.0>"), ("line", struct.pack("<3d", 1, 2, 3), "{1.0,2.0,3.0}"),
        ("aclitem", struct.pack("<3I", 10, 20, 3), "bob=ar/admin"), ("aclitem", struct.pack("<3I", 0, 0, 1), "=a"), ("aclitem", struct.pack("<3I", 99, 0, 2), "=r/oid:99"),
        ("name", b"abc" + bytes(61), "abc"), ("char", b"\0", ""), ("xml", b"<a/>", "<a/>"), ("int16", (-(2**100)).to_bytes(16, "little", signed=True), str(-(2**100))),
    ],
)
def test_values_as_text(name, raw, want):
    assert text(name, raw) == want


@pytest.mark.parametrize("x", ["0", "-0.01", "1000000000000000", "NaN", "Infinity", "-Infinity", "1234567890123456789012345678901234567890.00012", "0.0001", "99999999", "0.00", "-10000.10", "1" * 300 + ".5"])
def test_numeric(x):
    assert numeric(enc.numeric(x)) == x


def test_float4_is_shortest():
    r = random.Random(1)
    for _ in range(300):
        b = struct.pack("<f", r.uniform(-1e6, 1e6))
        assert struct.pack("<f", float(float4_text(b))) == b


def test_enum_unknown_and_fallback():
    assert D.text(9000, struct.pack("<I", 8)) == "glad" and D.text(9000, struct.pack("<I", 5)) == "5"
    assert D.text(123456, b"abc") == "abc" and D.text(123456, b"\xff\xfe") == "\\xfffe"


def test_encoding_falls_back_as_a_whole():
    assert Decoder("utf-8").string(b"\x9b\x81\x9b") == "\x9b\x81\x9b" and Decoder("gbk").string("汉字".encode("gbk")) == "汉字"
    assert Decoder("utf-8").string("é".encode() + b"\xff") == "Ã©ÿ"
    for codec in ENCODINGS.values():
        b"x".decode(codec)


@pytest.mark.parametrize(("s", "want"), [("", '""'), ("NULL", '"NULL"'), ("null", '"null"'), ("a b", "a b"), (" a", '" a"'), ('a"b\\', '"a\\"b\\\\"'), ("{x}", '"{x}"'), ("é", "é")])
def test_array_elements(s, want):
    assert quote_element(s) == want


def test_arrays():
    assert D.array(enc.array([1, None, 3], OID["int4"])) == "{1,NULL,3}"
    assert D.array(enc.array([[1, 2], [3, 4]], OID["int4"])) == "{{1,2},{3,4}}"
    assert D.array(enc.array([1.5, None, 2.0], OID["float8"])) == "{1.5,NULL,2.0}"
    assert D.array(enc.array(["a" * 200, "b"], OID["text"])) == "{" + "a" * 200 + ",b}"
    assert D.array(enc.array([], OID["text"])) == "{}" and D.array(enc.array([5], OID["int8"], low=[0])) == "[0:0]={5}"
    assert D.array(enc.array([{"a": 1}, None], OID["jsonb"])) == '{"{\\"a\\": 1}",NULL}'


def test_jsonb():
    for x, want in (({"b": 1, "a": [1, None, True, "x\n"]}, '{"b": 1, "a": [1, null, true, "x\\n"]}'), ([], "[]"), ({}, "{}"), ("é", '"é"'), (Decimal("2.50"), "2.50"), ({"k": {"n": [{}]}}, '{"k": {"n": [{}]}}'), (list(range(100)), str(list(range(100))))):
        assert D.jsonb(enc.jsonb(x)) == want


def test_compression():
    r = random.Random(3)
    for _ in range(200):
        raw = bytes(r.choice(b"abcd") for _ in range(r.randrange(1, 3000)))
        assert pglz_decompress(enc.pglz(raw), len(raw)) == raw and lz4_decompress(enc.lz4(raw), len(raw)) == raw
        for m in ("pglz", "lz4"):
            d = enc.compressed(raw, m)
            assert varlena(d, 0) == (raw, len(d))
            with pytest.raises(Corrupt):
                decompress(d[4:], len(raw) + 1)
    for bad in (b"\x01\x00\x00", b"\x01\xf0\xff", b""):
        with pytest.raises(Corrupt):
            pglz_decompress(bad, 50)
    with pytest.raises(Corrupt):
        lz4_decompress(b"\xf0\x01", 50)


def test_both_parities_of_compressed_sizes():
    """The two low bits alone say that a value is compressed, whatever its size."""
    for n in range(300, 312):
        d = enc.compressed(bytes(range(256)) * 2 + b"x" * n, "pglz")
        assert d[0] & 3 == 2 and varlena(d, 0)[0].endswith(b"x" * n)


@pytest.mark.parametrize("size", [8192, 16384, 32768])
@pytest.mark.parametrize("version", [4, 5])
def test_page_probe(tmp_path, size, version):
    path = str(tmp_path / "r")
    enc.write_relation(path, (Column("a", OID["int4"]),), [(k,) for k in range(3000)], size, version=version)
    with open(path, "rb") as f:
        raw = f.read()
    assert page_layout(raw[:130]) == (size, 18) and page_layout(bytes(130)) is None
    shifted = raw[:18] + b"\0" * 14 + struct.pack("<HHH", *struct.unpack_from("<3H", raw, 12)) + raw[18:20] + bytes(90)
    assert page_layout(shifted) == (size, 38)


def test_many_columns_and_nulls(tmp_path):
    r = random.Random(5)
    kinds = ["int2", "int4", "int8", "bool", "text", "float8", "name", "char", "uuid"]
    cols = tuple(Column(f"c{i}", OID[r.choice(kinds)]) for i in range(300))
    value = {"int2": lambda: r.randrange(99), "int4": lambda: r.randrange(9999), "int8": lambda: r.randrange(10**12), "bool": lambda: True, "text": lambda: "x" * r.choice([0, 3, 126, 127, 200]), "float8": lambda: 1.5, "name": lambda: "n", "char": lambda: "c", "uuid": lambda: bytes(16)}
    rows = [tuple(None if r.random() < 0.8 else value[TYPES[c.type_oid].name]() for c in cols) for _ in range(50)]
    path = str(tmp_path / "r")
    enc.write_relation(path, cols, rows)
    b = np.fromfile(path, np.uint8)
    t = item_tuples(b, read_pages(b, 8192), 8192)
    values, stop, broken = walk(b, t, cols)
    assert len(t) == 50 and not broken.any() and (stop <= t.end).all() and consistent(t).all()
    d = Decoder()
    for i, row in enumerate(rows):
        for c, v, x in zip(cols, values, row, strict=True):
            assert v.null[i] == (x is None)
            if x is not None:
                raw = bytes(b[v.at[i] : v.at[i] + v.size[i]])
                assert d.text(c.type_oid, raw) == d.text(c.type_oid, enc.payload(c, x).ljust(v.size[i], b"\0"))
    carved = carve_tuples(b, read_pages(b, 8192), 8192, cols)
    assert sorted(carved.start.tolist()) == sorted(t.start.tolist())


def test_truncated_values_stop_the_row():
    cols = (Column("a", OID["int4"]), Column("b", OID["text"]), Column("c", OID["int4"]))
    raw = enc.tuple_bytes(cols, (1, "hello world", 2))
    page = np.frombuffer(raw[:34] + bytes(200), np.uint8)
    from tuplequarry.kernel.scan import headers

    one = np.array([0])
    t = headers(page, one, np.array([34]), one, one + 1)
    values, _, broken = walk(page, t, cols)
    assert [bool(v.null[0]) for v in values] == [False, True, True] and broken[0]


def test_visibility_bits():
    im = np.array([0x0200 | 0x0800, 0x0100 | 0x0800, 0x0100 | 0x0400, 0x0100, 0x0100, 0x0100 | 0x0080, 0x0100 | 0x1000, 0x0300])
    xmax = np.array([0, 0, 0, 5, 0, 5, 5, 0])
    aborted, deleted = visibility(im, xmax)
    assert aborted.tolist() == [True] + [False] * 7 and deleted.tolist() == [False, False, True, True, False, False, False, False]


def test_layouts():
    assert major(160004) == 16 and major(12) == 12 and major(0) == 12
    assert [c.name for c in catalog_table("pg_attribute", 18).columns][3] == "attlen"
    assert [c.name for c in catalog_table("pg_class", 11).columns][0] == "relname"
    t = Table("x", (Column("a", 23),), enums={5: {6: "l"}}, primary_key=("a",))
    assert Table.from_json(t.to_json()) == t


def plain_pglz(raw):
    """The encoder, byte by byte."""
    out, control, flags, n, at, seen = bytearray(), -1, 0, 8, 0, {}
    while at < len(raw):
        if n == 8:
            if control >= 0:
                out[control] = flags
            control, flags, n = len(out), 0, 0
            out.append(0)
        back, size = at - seen.get(raw[at : at + 3], -5000), 1
        if at + 3 <= len(raw) and back < 4096:
            size = 3
            while at + size < len(raw) and size < 273 and raw[at + size - back] == raw[at + size]:
                size += 1
            flags |= 1 << n
            out += bytes([back >> 4 & 0xF0 | (min(size, 18) - 3), back & 0xFF]) + (bytes([size - 18]) if size >= 18 else b"")
        else:
            out.append(raw[at])
        for k in range(at, at + size):
            seen[raw[k : k + 3]] = k
        at, n = at + size, n + 1
    if control >= 0:
        out[control] = flags
    return bytes(out)


def test_pglz_of_many_values():
    r = random.Random(4)
    texts = [b"", b"a", b"abc", b"", b"a" * 3000, b"ab" * 700, *(bytes(r.choice(b"abc") for _ in range(r.randrange(700))) for _ in range(60)), bytes(r.randrange(256) for _ in range(9000)), b"x" * 17 + b"y" + b"x" * 300]
    assert enc.pglz_many(texts) == [plain_pglz(x) for x in texts] == [enc.pglz(x) for x in texts]
    assert enc.pglz_many([]) == []
    for x in texts:
        z = plain_pglz(x)
        assert pglz_decompress(z, len(x)) == x
        assert pglz_decompress(z + b"rest", len(x)) == x  # what follows the whole text does not count
        if x:
            with pytest.raises(Corrupt):
                pglz_decompress(z, len(x) + 1)
