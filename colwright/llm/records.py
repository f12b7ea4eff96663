"""Token ids in length-delimited binary records, with an offset index for reads in any order.

A record is framed as length (unsigned 64-bit), masked CRC-32C of these 8 bytes, the data, masked CRC-32C of the data, all little-endian:
the common record format of training frameworks. The data is one serialized document: FLAGS (1: has an id, 2: wide ids), its id
(signed 64-bit) and the token ids, unsigned in 16 or, if the vocabulary needs them, 32 bits.

Beside each data file `x.rec` stands its index `x.idx`: per record offset, length and the number of token ids before it in the file, unsigned
64-bit. Tasks write their own files, under names that no other attempt uses, and report them; the table `files` lists the files of
the attempts that counted, in the order of their contents, so what lost executors or repeated tasks leave behind is never read.

Documents stand in ascending order of their id, nulls first; equal ids by a hash of the text. Rows are dealt by ranges of
these, so neither an id nor a text that fills a third of the table meets in one task. Null texts are empty documents.
Repeated rows are written each. An empty table makes no file, and reads as no rows.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colwright.columns import col, require
from colwright.llm.text import place, whole
from colwright.llm.tokens import Cutter

FILE_BYTES = 128 << 20
READ_BYTES = 8 << 20
READ_RECORDS = 1024  # records that one row of the reading plan stands for
# Strings with known ids that a worker keeps, twice; those used last stay.
REMEMBERED = 400_000
# Strings that are encoded as one text.
BUNDLE = 512
FLUSH_BYTES = 4 << 20
HAS_ID, WIDE = 1, 2
HEAD = "<Bq"
HEAD_BYTES = struct.calcsize(HEAD)
INDEX = np.dtype([("offset", "<u8"), ("length", "<u8"), ("before", "<u8")])
FILES = "part int, number int, file string, records bigint, tokens bigint, bytes bigint"
# CRC-32C: its polynomial, reflected, and the constant of the mask.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
LANE = 256  # bytes whose checksums are computed side by side


@cache
def _tables() -> np.ndarray:
    """Four tables of 256: how a byte followed by 0 to 3 zero bytes changes the checksum."""
    t = np.zeros((4, 256), np.uint32)
    t[0] = np.arange(256)
    for _ in range(8):
        t[0] = np.where(t[0] & 1, (t[0] >> 1) ^ np.uint32(POLYNOMIAL), t[0] >> 1)
    for k in range(1, 4):
        t[k] = (t[k - 1] >> 8) ^ t[0][t[k - 1] & 0xFF]
    return t


@cache
def _shift() -> np.ndarray:
    """The same as four tables for LANE zero bytes behind a checksum."""
    one = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(LANE):
        one = (one >> 8) ^ _tables()[0][one & 0xFF]
    values = np.arange(256)
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte] ^= np.where(values >> bit & 1, one[8 * byte + bit], 0).astype(np.uint32)
    return out


def _through(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][crc & 0xFF] ^ tables[1][crc >> 8 & 0xFF] ^ tables[2][crc >> 16 & 0xFF] ^ tables[3][crc >> 24]


def checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of pieces of a byte array. Each is cut into lanes from its end; all lanes advance together.

    The first lane of a piece is filled up with zero bytes in front, which a checksum that starts from zero does not see;
    the start value is laid over the first four bytes instead. Pieces shorter than four bytes go byte by byte.
    """
    t = _tables()
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for i in np.flatnonzero(lengths < 4):
        for b in data[starts[i] : starts[i] + lengths[i]]:
            out[i] = (out[i] >> 8) ^ t[0][(out[i] ^ b) & 0xFF]
    long = np.flatnonzero(lengths >= 4)
    if len(long):
        lanes = -(-lengths[long] // LANE)
        first = np.concatenate([[0], np.cumsum(lanes)])
        padded = np.zeros(int(first[-1]) * LANE, np.uint8)
        fill = lanes * LANE - lengths[long]
        for k, i in enumerate(long):
            at = int(first[k]) * LANE + int(fill[k])
            padded[at : at + int(lengths[i])] = data[starts[i] : starts[i] + lengths[i]]
            padded[at : at + 4] ^= 0xFF
        words = np.ascontiguousarray(padded.view("<u4").reshape(-1, LANE // 4).T)
        crc = np.zeros(int(first[-1]), np.uint32)
        for w in words:
            crc ^= w
            crc = t[3][crc & 0xFF] ^ t[2][crc >> 8 & 0xFF] ^ t[1][crc >> 16 & 0xFF] ^ t[0][crc >> 24]
        # Lanes of a piece are joined in order; pieces with more lanes than the others go on alone.
        shift, total, step = _shift(), crc[first[:-1]], 1
        left = np.flatnonzero(lanes > 1)
        while len(left):
            total[left] = _through(total[left], shift) ^ crc[first[left] + step]
            step += 1
            left = left[lanes[left] > step]
        out[long] = total
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Turned and offset, so that a checksum of data that holds checksums stays a good one."""
    return (crc >> 15 | crc << 17) + np.uint32(MASK)


def frame(items: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The records of the items, one behind the other, and their offsets."""
    lengths = np.array([len(x) for x in items], np.int64)
    starts = np.cumsum(lengths) - lengths
    heads = lengths.astype("<u8").view(np.uint8)
    head_crc = masked(checksums(heads, np.arange(len(items)) * 8, np.full(len(items), 8))).astype("<u4").tobytes()
    data_crc = masked(checksums(np.frombuffer(b"".join(items), np.uint8), starts, lengths)).astype("<u4").tobytes()
    heads = heads.tobytes()
    parts = []
    for i, item in enumerate(items):
        parts += [heads[8 * i : 8 * i + 8], head_crc[4 * i : 4 * i + 4], item, data_crc[4 * i : 4 * i + 4]]
    return b"".join(parts), starts + 16 * np.arange(len(items))


def unframe(data: bytes, offsets: np.ndarray, lengths: np.ndarray) -> list[memoryview]:
    """The items of the records at these offsets of the bytes, after a check of both sums. ValueError if one is wrong."""
    view, array = memoryview(data), np.frombuffer(data, np.uint8)
    if len(offsets) and (int((offsets + lengths).max()) + 16 > len(data)):
        raise ValueError("a record ends early")

    def number(at: np.ndarray, kind: str) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return array[at[:, None] + np.arange(size)].copy().view(kind).ravel()

    if (number(offsets, "<u8") != lengths.astype(np.uint64)).any():
        raise ValueError("a record has another length than its index says")
    if (number(offsets + 8, "<u4") != masked(checksums(array, offsets, np.full(len(offsets), 8)))).any():
        raise ValueError("a record's length has another checksum")
    if (number(offsets + 12 + lengths, "<u4") != masked(checksums(array, offsets + 12, lengths))).any():
        raise ValueError("a record's data has another checksum")
    return [view[o + 12 : o + 12 + n] for o, n in zip(offsets.tolist(), lengths.tolist())]


@cache
def _symbol_table() -> dict[int, str]:
    """The character for each byte in vocabularies of bytes: itself if visible, else the next one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _symbols(token: str) -> str:
    if token.isascii() and token.isprintable():
        return token
    return token.encode().decode("latin-1").translate(_symbol_table())


class Encoder:
    """Ids of whole texts: those of each string between white space, which the library encodes once for as long as it is remembered."""

    made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.cutter = Cutter.of(path)
        self.tokenizer = self.cutter.tokenizer
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # The file's model alone, for pre-tokens in its byte symbols with blanks between them.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.batch = getattr(self.model, "encode_batch_fast", self.model.encode_batch)
        self.lines = self.cutter.plain and re.compile("\n|" + self.cutter.plain.pattern)
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith(suffix)]] = True

    def _learn(self, keys: set[str]) -> None:
        """Ids of keys that are not among the known ones; BUNDLE of them are cut and encoded at once."""
        missing = []
        for key in keys:
            found = self.old.get(key)
            if found is None:
                missing.append(key)
            else:
                self.known[key] = found
        if not self.ends.any():
            self.known.update((key, np.array(self.tokenizer.encode(key, add_special_tokens=False).ids, self.kind).tobytes()) for key in missing)
            return
        bundles = [missing[i : i + BUNDLE] for i in range(0, len(missing), BUNDLE)]
        cut = [self._cut(bundle) for bundle in bundles]
        encoded = self.batch([" ".join(map(_symbols, tokens)) for tokens, _ in cut], add_special_tokens=False)
        for bundle, (tokens, counts), found in zip(bundles, cut, encoded):
            ids = np.array(found.ids, self.kind)
            # The last piece of each pre-token says that it is one.
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(tokens):
                raise ValueError("the tokenizer's pieces do not tell where a pre-token ends")
            cuts, data = (last[counts - 1] * self.kind.itemsize).tolist(), ids.tobytes()
            self.known.update(zip(bundle, (data[a:b] for a, b in zip([0, *cuts], cuts))))

    def _cut(self, keys: list[str]) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of the keys, and how many there are up to each key's last."""
        joined = "\n".join(keys)
        if not self.cutter.is_plain(joined):
            cut = [self.cutter.plain.findall(key) if self.cutter.is_plain(key) else [key] for key in keys]
            return [t for tokens in cut for t in tokens], np.cumsum([len(tokens) for tokens in cut])
        found = self.lines.findall(joined)
        stops = np.array([i for i, t in enumerate(found) if t == "\n"] + [len(found)])
        return [t for t in found if t != "\n"], stops - np.arange(len(stops))

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """Per text its ids as bytes, with `end` behind them; special strings are found as the library finds them."""
        special = self.cutter.special
        rows = []
        for text in texts:
            row, at = [], 0
            for hit in special.finditer(text) if special else ():
                row += [self._keys(text[at : hit.start()]), hit.group()]
                at = hit.end()
            row.append(self._keys(text[at:] if at else text))
            rows.append(row)
        if len(self.known) > REMEMBERED:
            self.old, self.known = self.known, {}
        missing: set[str] = set()
        for row in rows:
            for keys in row[::2]:
                missing.update(filterfalse(self.known.__contains__, keys))
        self._learn(missing)
        known, stop, out = self.known.__getitem__, np.array([end], self.kind).tobytes(), []
        for row in rows:
            parts: list[bytes] = []
            for i, x in enumerate(row):
                if i % 2:
                    parts.append(np.array([self.tokenizer.token_to_id(x)], self.kind).tobytes())
                else:
                    parts.extend(map(known, x))
            parts.append(stop)
            out.append(b"".join(parts))
        return out

    def _keys(self, text: str) -> list[str]:
        return text.lower().split() if self.cutter.is_plain(text) else self.cutter.cut(text)[0]


def _write(tokenizer: str, end: int, path: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, mark = TaskContext.get().partitionId(), uuid.uuid4().hex
        files, folder = place(path)
        files.create_dir(folder, recursive=True)
        coder = Encoder.of(tokenizer)
        done: list[tuple] = []
        sink, index, size, tokens = None, [], 0, 0

        def close() -> None:
            nonlocal sink, index, size, tokens
            if sink is not None:
                sink.close()
                rows = np.concatenate(index)
                with files.open_output_stream(f"{folder}/{name}.idx", compression=None) as out:
                    out.write(rows.tobytes())
                done.append((part, len(done), f"{name}.rec", len(rows), tokens, size))
                sink, index, size, tokens = None, [], 0, 0

        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text")
            at = 0
            while at < len(ids):
                stop, held = at, 0
                while stop < len(ids) and held < min(FLUSH_BYTES, file_bytes):
                    held += len(texts[stop].as_buffer())
                    stop += 1
                coded = coder.encode(texts.slice(at, stop - at).to_pylist(), end)
                flags = WIDE if coder.wide else 0
                items = [struct.pack(HEAD, flags | (HAS_ID if i is not None else 0), i or 0) + c for i, c in zip(ids[at:stop], coded)]
                framed, offsets = frame(items)
                if sink is None:
                    name = f"part-{part:06d}-{len(done):04d}-{mark}"
                    sink = files.open_output_stream(f"{folder}/{name}.rec", compression=None)
                counts = np.array([len(c) for c in coded], np.int64) // np.dtype(coder.kind).itemsize
                rows = np.zeros(len(items), INDEX)
                rows["offset"], rows["length"] = offsets + size, [len(x) for x in items]
                rows["before"] = tokens + np.cumsum(counts) - counts
                index.append(rows)
                sink.write(framed)
                size, tokens, at = size + len(framed), tokens + int(counts.sum()), stop
                if size >= file_bytes:
                    close()
        close()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["part", "number", "file", "records", "tokens", "bytes"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)

    return run


def write(df: DataFrame, path: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Write the texts' ids below `path`, which all machines share; `tokenizer` is a file that every machine has.

    Every text is encoded without added special tokens, and `end` is appended to each. Rows are ordered before they are encoded, so each is
    encoded once and its ids are never shuffled.
    """
    require(df, key, text)
    # The hash splits an id with many texts; the last key splits copies of one row, whose order is open.
    rows = df.select(col(key).cast("bigint").alias("id"), whole(text).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("at"), "text")
    keys = [F.col("id").asc_nulls_first(), F.col("mark"), F.col("at")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")
    dealt.mapInArrow(_write(tokenizer, end, path, file_bytes), FILES).write.mode("overwrite").parquet(f"{path}/files")


def files(spark: SparkSession, path: str) -> DataFrame:
    """The data files below `path`, in the order of their contents, with `start`: the number of ids in all files before."""
    found = spark.read.schema(FILES).parquet(f"{path}/files")
    # One row per file of FILE_BYTES, and no group to split it by: sums of sums per part keep the last step at a row per part.
    parts = found.groupBy("part").agg(F.sum("tokens").alias("t"))
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    own = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("own", own).join(parts, F.col("part") == F.col("p")).select("part", "number", "file", "records", "tokens", "bytes", (F.col("s") + F.col("own")).alias("start"))


def _offsets(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files_, folder = place(path)
        for batch in batches:
            for name, base, low, n in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "low", "n"))):
                with files_.open_input_file(f"{folder}/{name.removesuffix('.rec')}.idx") as f:
                    rows = np.frombuffer(f.read_at(n * INDEX.itemsize, low * INDEX.itemsize), INDEX)
                columns = [
                    pa.array([name] * len(rows), pa.string()), pa.array(np.arange(low, low + len(rows))), pa.array(rows["offset"].astype(np.int64)),
                    pa.array(rows["length"].astype(np.int64)), pa.array(rows["before"].astype(np.int64) + base),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["file", "record", "offset", "length", "start"])

    return run


def index(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: file, record (its number there), offset, length, start (ids of all documents before)."""
    steps = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("records") - 1, F.lit(READ_RECORDS).cast("bigint")))
    blocks = files(spark, path).filter("records > 0").select("file", "start", "records", steps.alias("low"))
    blocks = blocks.select("file", "start", "low", F.least(F.lit(READ_RECORDS), F.col("records") - F.col("low")).cast("bigint").alias("n"))
    # A row stands for many records, so rows are dealt anew before they are read.
    dealt = blocks.repartition("file", "low").sortWithinPartitions("file", "low")
    return dealt.mapInArrow(_offsets(path), "file string, record bigint, offset bigint, length bigint, start bigint")


def _fetch(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files_, folder = place(path)
        opened: dict = {}

        def read(name: str, low: int, high: int) -> bytes:
            if name not in opened:
                if len(opened) >= 16:
                    opened.pop(next(iter(opened))).close()
                opened[name] = files_.open_input_file(f"{folder}/{name}")
            return opened[name].read_at(high - low, low)

        for batch in batches:
            names, starts = batch.column("file").to_pylist(), batch.column("start")
            offset, length = (np.array(batch.column(c).to_numpy(), np.int64) for c in ("offset", "length"))
            at = 0
            while at < len(names):
                # Neighbours in the file are read at once, others alone.
                stop = at + 1
                while (
                    stop < len(names) and names[stop] == names[at] and offset[stop] == offset[stop - 1] + length[stop - 1] + 16
                    and offset[stop] + length[stop] - offset[at] < READ_BYTES
                ):
                    stop += 1
                low, high = int(offset[at]), int(offset[stop - 1] + length[stop - 1]) + 16
                items = unframe(read(names[at], low, high), offset[at:stop] - low, length[at:stop])
                keys, ids, cuts = [], [], [0]
                for item in items:
                    flags, key = struct.unpack_from(HEAD, item)
                    keys.append(key if flags & HAS_ID else None)
                    ids.append(np.frombuffer(item, "<u4" if flags & WIDE else "<u2", offset=HEAD_BYTES).astype("<u4"))
                    cuts.append(cuts[-1] + len(ids[-1]))
                columns = [
                    batch.column("file").slice(at, stop - at), batch.column("record").slice(at, stop - at), pa.array(keys, pa.int64()),
                    starts.slice(at, stop - at), pa.array(np.diff(cuts)), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(ids).view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RECORD[: len(columns)]])
                at = stop
        for f in opened.values():
            f.close()

    return run


RECORD = ("file string", "record bigint", "id bigint", "start bigint", "n_tokens bigint", "ids_crc32 bigint", "ids array<int>")


def fetch(rows: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """The records that rows of the index name, in the order of the rows: file, record, id, start, n_tokens, ids_crc32, ids.

    Both checksums of every record are checked; a wrong one fails the task.
    """
    narrow = rows.select("file", "record", "offset", "length", "start")
    return narrow.mapInArrow(_fetch(path, with_ids), ", ".join(RECORD if with_ids else RECORD[:-1]))


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """All records; those of a block of READ_RECORDS stand together, in their order."""
    return fetch(index(spark, path), path, with_ids)


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """All records in an order that the seed decides: the index is sorted by a hash, and records are read at their offsets."""
    return fetch(index(spark, path).orderBy(F.xxhash64(F.lit(seed), "file", "record"), "file", "record"), path)
