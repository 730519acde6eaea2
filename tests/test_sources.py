import gzip
import struct
import tempfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harrow.schemas import RANKINGS, USERVISITS
from harrow.sources import catalog
from harrow.sources.codecs import compress, crc32c, decompress, masked_crc
from harrow.sources.encodings import RECORDS, Corrupt, column_encode, packed, unpacked
from harrow.sources.tables import read_table, repack, write_table

RANK = [("u", 300, 7)]
VISIT = ("1.2.3.4", "d", "2000-01-01", 1.5, "a", "US", "en", "w", 9)

# Records as the layouts have them, written by hand.
GOLDEN = {
    "csv": b"u,300,7\n",
    "json": b'{"url":"u","pagerank":300,"duration":7}\n',
    "bincode": b"\x01" + bytes(7) + b"u" + struct.pack("<QQ", 300, 7),
    "cbor": b"\xa3\x63url\x61u\x68pagerank\x19\x01\x2c\x68duration\x07",
    "rmp": b"\x93\xa1u\xcd\x01\x2c\x07",
    "pbuf": b"\x08\x00" + b"\x0a\x01u\x10\xac\x02\x18\x07",
    "cap": struct.pack("<II", 0, 5) + struct.pack("<IHH", 0, 2, 1) + struct.pack("<QQ", 300, 7) + struct.pack("<II", 1, 2 << 3 | 2) + b"u" + bytes(7),
}
GOLDEN["mcap"] = struct.pack("<Q", 6) + GOLDEN["cap"]
GOLDEN["pcap"] = b"\x10\x05\x50\x02\x01\x03\x2c\x01\x01\x07\x11\x01\x12\x01u"


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_bytes(name):
    encode, decode = RECORDS[name]
    assert encode(RANK, RANKINGS) == GOLDEN[name]
    assert list(decode(GOLDEN[name], RANKINGS)) == RANK and list(decode(b"", RANKINGS)) == []


text = st.text(st.characters(exclude_categories=["Cs"]), max_size=30)
visits = st.lists(st.tuples(text, text, text, st.floats(width=32, allow_nan=False), text, text, text, text, st.integers(0, 2**63 - 1)), max_size=5)


@settings(max_examples=40, deadline=None)
@given(visits)
def test_any_record_returns(rows):
    for name, (encode, decode) in RECORDS.items():
        assert list(decode(encode(rows, USERVISITS), USERVISITS)) == rows
        if rows and name not in ("csv", "text", "json"):
            with pytest.raises(Corrupt):
                list(decode(encode(rows, USERVISITS)[:-1], USERVISITS))


odd = st.text(st.sampled_from(list('a,"\'\r\n \\#\ufeff\u2028é\t\x00')), max_size=6)
odd_visits = st.lists(st.tuples(odd, odd, odd, st.floats(width=32, allow_nan=False), odd, odd, odd, odd, st.integers(0, 2**63 - 1)), min_size=1, max_size=5)


@settings(max_examples=8, deadline=None)
@given(odd_visits)
def test_any_row_of_text_files_returns(spark, rows):
    """Tables that Spark reads itself."""
    for fmt in ("csv", "json"):
        with tempfile.TemporaryDirectory() as folder:
            write_table(spark.createDataFrame(rows, USERVISITS).coalesce(1), folder, "uservisits", fmt)
            assert list(map(tuple, read_table(spark, folder, "uservisits", fmt).collect())) == rows
    with tempfile.TemporaryDirectory() as folder:
        with open(f"{folder}/a.deflate", "wb") as file:
            file.write(zlib.compress(RECORDS["text"][0](rows, USERVISITS)))
        assert list(map(tuple, read_table(spark, folder, "uservisits", "text-deflate").collect())) == rows


def test_empty_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'"",3,4\n,5,6\n')
    assert [tuple(r) for r in read_table(spark, str(tmp_path), "rankings", "csv").collect()] == [("", 3, 4), ("", 5, 6)]
    (tmp_path / "a.csv").write_bytes(b"u,3,4\r\nv,5,6\r\n")
    assert [tuple(r) for r in read_table(spark, str(tmp_path), "rankings", "csv").collect()] == [("u", 3, 4), ("v", 5, 6)]
    (tmp_path / "a.csv").write_bytes(b"u,,4\n")
    with pytest.raises(Exception, match="an empty field in pagerank"):
        read_table(spark, str(tmp_path), "rankings", "csv").collect()


def test_writing_again_leaves_only_the_new_chunks(spark, tmp_path):
    for n in (5, 3):
        write_table(spark.createDataFrame([(str(i), i, i) for i in range(n)], RANKINGS).repartition(2), str(tmp_path / "t"), "rankings", "cbor")
        assert read_table(spark, str(tmp_path / "t"), "rankings", "cbor").count() == n
    write_table(spark.createDataFrame([("x", 1, 1)], RANKINGS), str(tmp_path / "t"), "rankings", "cbor", "append")
    assert read_table(spark, str(tmp_path / "t"), "rankings", "cbor").count() == 4 and not [p for p in (tmp_path / "t").iterdir() if p.name.startswith(".")]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=2000))
def test_checksums(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    assert crc32c(data) == crc ^ 0xFFFFFFFF and crc32c(b"123456789") == 0xE3069283


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([bytes(8), b"12345678", b"1\0\0\0\0\0\0\0", b"123\0" b"5678"]), max_size=600).map(b"".join))
def test_packing(data):
    assert unpacked(packed(data)) == data
    for codec in catalog.CODECS:
        assert decompress(compress(data, codec), codec) == data


def test_codec_heads():
    assert compress(b"x", "deflate")[:2] == b"\x78\x9c" and compress(b"x", "lz4")[:4] == b"\x04\x22\x4d\x18" and compress(b"x", "gz")[:2] == b"\x1f\x8b"
    assert compress(b"x", "snz")[:10] == b"\xff\x06\x00\x00sNaPpY" and masked_crc(b"") == 0xA282EAD8
    with pytest.raises(EOFError):
        decompress(compress(b"x" * 100, "snz")[:-1], "snz")


def test_far_pointer():
    """A text in a second segment, behind a landing pad."""
    first = struct.pack("<IHH", 0, 2, 1) + struct.pack("<QQ", 3, 4) + struct.pack("<II", 0 << 3 | 2, 1)
    second = struct.pack("<II", 1, 2 << 3 | 2) + b"u" + bytes(7)
    message = struct.pack("<IIII", 1, 4, 2, 0) + first + second
    assert list(RECORDS["cap"][1](message, RANKINGS)) == [("u", 3, 4)]


def test_limits():
    with pytest.raises(OverflowError):
        RECORDS["pbuf"][0]([("u" * 70_000, 1, 1)], RANKINGS)
    with pytest.raises(OverflowError):
        list(RECORDS["bincode"][1](struct.pack("<QQQ", 0, 1 << 63, 0), RANKINGS))
    for bad in ("xml", "csv-bz2", "parquet-gz", ""):
        with pytest.raises(ValueError):
            catalog.Format.parse(bad)
    with pytest.raises(ValueError):
        catalog.shard([1], 2, 2)
    assert column_encode([1.5], USERVISITS["ad_revenue"]) == struct.pack("<d", 1.5)


def test_layout_of_a_tree(spark, tmp_path):
    root = str(tmp_path)
    source = tmp_path / "text-deflate/tiny/uservisits"
    source.mkdir(parents=True)
    for i in range(3):
        (source / f"{i}.deflate").write_bytes(zlib.compress(",".join(map(str, VISIT)).encode() + b"\n1,d,x,0.5,a,b,c,d,%d\n" % i))
    for target in ("columns-snz", "csv-gz", "rmp", "mcap-lz4"):
        repack(spark, root, "tiny", "uservisits", "text-deflate", target)
        path = catalog.directory(root, target, "tiny", "uservisits")
        found = read_table(spark, path, "uservisits", target)
        assert sorted(map(tuple, found.collect())) == sorted([VISIT] * 3 + [("1", "d", "x", 0.5, "a", "b", "c", "d", i) for i in range(3)])
        assert read_table(spark, path, "uservisits", target, ["duration"], chunks=1).count() < 6
    with pytest.raises(ValueError):
        repack(spark, root, "tiny", "uservisits", "csv-gz", "text")
    columns = catalog.chunks(catalog.directory(root, "columns-snz", "tiny", "uservisits"), "columns-snz")[0]
    (tmp_path / columns[len(root) + 1 :] / "col-005").unlink()  # a column that is not wanted isn't opened
    assert read_table(spark, catalog.directory(root, "columns-snz", "tiny", "uservisits"), "uservisits", "columns-snz", ["source_ip"]).count() == 6


def test_broken_chunks(spark, tmp_path):
    good = RECORDS["rmp"][0]([("u", 1, 2)] * 3, RANKINGS)
    (tmp_path / "a.rmp-gz").write_bytes(gzip.compress(good[:-1]))
    with pytest.raises(Exception, match="cut off"):
        read_table(spark, str(tmp_path), "rankings", "rmp-gz").collect()
    assert read_table(spark, str(tmp_path), "rankings", "rmp-gz", mode="permissive").count() == 2
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path), "nothing", "rmp-gz")


def test_empty_table(spark, tmp_path):
    for fmt in ("columns", "pbuf"):
        write_table(spark.createDataFrame([], RANKINGS), str(tmp_path / fmt), "rankings", fmt)
        assert read_table(spark, str(tmp_path / fmt), "rankings", fmt).count() == 0
