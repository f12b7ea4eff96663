"""Binary records: checksums by hand, round trips, and the registered query against the library."""

import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from colwright.llm import records
from colwright.llm.queries import END_ID, tokenizer_path
from colwright.sources.shared import shared_path

FOLDER = "/root/testdata/sf0.01"
ODD = ["don't <|endoftext|> x's", "Ünïcode ½ ²x İstanbul ŉ 中文 字", "a b c", 'it"s 100% \x00 b\x1fc', "", "   ", "He'LL 've <|startoftext|>", "ﬁ é é", "\x01 mark \x01"]


def crc(data: bytes) -> int:
    """CRC-32C bit by bit."""
    value = 0xFFFFFFFF
    for byte in data:
        value ^= byte
        for _ in range(8):
            value = value >> 1 ^ (0x82F63B78 if value & 1 else 0)
    return value ^ 0xFFFFFFFF


def masked(data: bytes) -> int:
    value = crc(data)
    return ((value >> 15 | value << 17) + 0xA282EAD8) & 0xFFFFFFFF


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path())
    return lambda text: [*found.encode(text or "", add_special_tokens=False).ids, END_ID]


def test_checksums():
    random.seed(1)
    pieces = [b"", b"a", b"abc", b"123456789"] + [random.randbytes(n) for n in (4, 5, 255, 256, 257, 511, 512, 513, 3000)]
    data = b"".join(pieces)
    lengths = np.array([len(p) for p in pieces])
    found = records.checksums(np.frombuffer(data, np.uint8), np.cumsum(lengths) - lengths, lengths)
    assert [int(c) for c in found] == [crc(p) for p in pieces] and crc(b"123456789") == 0xE3069283


def test_frames_are_the_common_format():
    items = [b"", b"x" * 700, b"abc"]
    framed, offsets = records.frame(items)
    wanted = b""
    for item in items:
        head = struct.pack("<Q", len(item))
        wanted += head + struct.pack("<I", masked(head)) + item + struct.pack("<I", masked(item))
    assert framed == wanted
    lengths = np.array([len(x) for x in items])
    assert [bytes(x) for x in records.unframe(framed, offsets, lengths)] == items
    for at in (0, 9, 30, len(framed) - 1):
        bad = bytearray(framed)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad), offsets, lengths)
    with pytest.raises(ValueError, match="early"):
        records.unframe(framed[:-1], offsets, lengths)


def test_ids_are_those_of_the_library(library):
    coder = records.Encoder.of(tokenizer_path())
    texts = ODD + ["word " * 3000, "x" * 5000, "é" * 300]
    for _ in range(2):
        assert [np.frombuffer(b, coder.kind).tolist() for b in coder.encode(texts, END_ID)] == [library(t) for t in texts]


def test_what_is_remembered_is_bounded_and_harmless(library, monkeypatch):
    monkeypatch.setattr(records, "REMEMBERED", 5)
    coder = records.Encoder(tokenizer_path())
    random.seed(2)
    for _ in range(20):
        texts = [" ".join(random.choices("abcdefghij", k=4)) for _ in range(3)]
        assert [np.frombuffer(b, coder.kind).tolist() for b in coder.encode(texts, END_ID)] == [library(t) for t in texts]
        assert len(coder.known) <= 5 + 12


def test_query(spark, library):
    rows = sorted(duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())
    found = sorted(map(tuple, contract.queries()["op11_records"](spark, FOLDER).collect()))
    start, wanted = 0, []
    for doc_id, text in rows:
        ids = library(text)
        wanted.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert found == wanted


def test_edges(spark, library, tmp_path):
    rows = [(1, None, "a"), (2, "", "b"), (None, "x y", "c"), (None, None, "d"), (-5, "word " * 4000, "e"), (3, ODD[1], "f")]
    rows += [(7, "same text", "g")] * 40 + [(7, f"other {i}", "h") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, id string").withColumn("mark", F.lit(1)).withColumn("start", F.lit(2))
    path = str(tmp_path / "rec")
    records.write(df.repartition(5), path, tokenizer_path(), END_ID, file_bytes=200)
    found = records.read(spark, path).collect()
    assert sorted((r.id is not None, r.id or 0, r.ids) for r in found) == sorted((d is not None, d or 0, library(t)) for d, t, _ in rows)
    by_start = sorted(found, key=lambda r: r.start)
    assert [r.start for r in by_start] == list(np.cumsum([0] + [r.n_tokens for r in by_start])[:-1])
    ids = [r.id for r in by_start]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert all(r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids)) for r in found)
    files = records.files(spark, path)
    assert files.count() >= 5 and {p.suffix for p in (tmp_path / "rec").glob("part-*")} == {".rec", ".idx"}
    # What an attempt left behind that did not count is not read.
    (tmp_path / "rec" / "part-000000-0000-lost.rec").write_bytes(b"half a record")
    assert records.read(spark, path, with_ids=False).count() == len(rows)


def test_shuffled_reads(spark, tmp_path):
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    path = str(tmp_path / "rec")
    records.write(df, path, tokenizer_path(), END_ID, file_bytes=20_000)
    one, two, again = ([r.id for r in records.read_shuffled(spark, path, seed).collect()] for seed in (1, 2, 1))
    assert one == again != two and sorted(one) == sorted(two) == list(range(3000)) and one != sorted(one)


def test_empty_table(spark):
    path = shared_path(spark, "records")
    records.write(spark.createDataFrame([], "doc_id bigint, text string"), path, tokenizer_path(), END_ID)
    assert records.read(spark, path).count() == 0
