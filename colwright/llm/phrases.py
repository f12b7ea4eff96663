"""Phrase mining by direct-address tiling.

Words get ids by frequency, per language. Phrases grow by pairs: a phrase of k words is the pair of the frequent phrases of
k - 1 words at a place and at the next one, and the frequent pairs get ids by frequency again. Pair space is cut into
square tiles of ids. Pairs within the first few tiles go to a tile each, where a full tile is counted by `numpy.bincount`
straight into its cells; all other tiles are sparse, are shared out over buckets, and are counted as sorted coordinates.

The corpus is cut into blocks of a language, whose words are numbers from the first pass on; texts are
read and cut once. Each block counts its own pairs first, so that a pair is shuffled once per block, however frequent. A bucket
with more entries than a task takes is dealt over parts by block, whose sums are added in further rounds: no task needs a hot tile,
word or language as a whole. A task holds the different pairs of one part of one bucket.

Null texts are empty. A null language is `und`, together with texts that say so. Ids of a language and length must fit 32 bits, that is
four thousand million different phrases, each found at least `least` times. Empty tables, and tables without frequent phrases, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colwright.columns import col, require
from colwright.llm.ranks import numbered
from colwright.sources.shared import briefly_kept, kept, remove_kept

LEAST = 100
LONGEST = 5
TOP = 2000
# What ends a piece, as bytes, and what separates words in it.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
BLOCKS = "block bigint, lang string, words array<string>, counts array<bigint>, n bigint, stream binary"
PAIRS = "lang string, bucket bigint, block bigint, n bigint, keys binary, counts binary"
NO_ID = 0xFFFFFFFF


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte of their place, so that empty upper bytes and alike lower ones are next to each other, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: pa.Scalar, kind: type) -> np.ndarray:
    raw, size = data.as_buffer(), np.dtype(kind).itemsize
    n = int.from_bytes(raw[:8].to_pybytes(), "little")
    planes = np.frombuffer(pa.decompress(raw[8:], n * size, codec="zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: pa.Scalar) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


@dataclass(frozen=True)
class Limits:
    """How the work is cut. Results do not depend on it."""

    block_words: int = 1 << 20
    held_words: int = 1 << 21  # words of unfinished blocks that a task may hold
    tile_bits: int = 10
    grid: int = 4  # tiles along each side of pair space that have a bucket each
    entries: int = 1 << 22  # different pairs of blocks that a task takes
    row_entries: int = 1 << 17
    list_blocks: int = 4096  # blocks in which a row lists a word's places
    fan_in: int = 256

    @property
    def dense(self) -> int:
        return self.grid * self.grid


class Codes(dict):
    """Numbers of words in the order in which they turn up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def _cut(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    """Blocks of word numbers, with NO_ID between pieces, and the words of each block."""
    from pyspark import TaskContext

    first, made = TaskContext.get().partitionId() << 32, 0
    to_break = bytes.maketrans(BREAKS, b"\n" * len(BREAKS))
    held: dict[str, tuple[Codes, list[np.ndarray], list[int]]] = {}

    def block(lang: str) -> pa.RecordBatch:
        nonlocal made
        codes, streams, _ = held.pop(lang)
        stream = np.concatenate(streams)
        counts = np.bincount(stream[stream != NO_ID], minlength=len(codes))
        words = pa.array(list(codes), pa.binary()).cast(pa.string())
        made += 1
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        columns = [
            pa.array([first + made]), pa.array([lang], pa.string()), one(words), one(pa.array(counts.astype(np.int64))),
            pa.array([int(counts.sum())]), pa.array([_pack(stream)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "lang", "words", "counts", "n", "stream"])

    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
            # Bytes: lower() then changes A-Z only, and all marks are single bytes.
            pieces = text.as_buffer().to_pybytes().lower().translate(to_break).split(b"\n")
            at = 0
            while at < len(pieces):
                codes, streams, size = held.setdefault(lang, (Codes(), [], [0]))
                flat: list[int] = []
                # A very long text, even a very long piece, is spread over blocks; a piece stays whole, as phrases run through it.
                while at < len(pieces) and size[0] + len(flat) < limits.block_words:
                    if words := pieces[at].split():
                        flat.extend(map(codes.__getitem__, words))
                        flat.append(NO_ID)
                    at += 1
                streams.append(np.array(flat, np.uint32))
                size[0] += len(flat)
                if size[0] >= limits.block_words:
                    yield block(lang)
                elif sum(h[2][0] for h in held.values()) >= limits.held_words:
                    yield block(max(held, key=lambda k: held[k][2][0]))
    for lang in list(held):
        yield block(lang)


def _bucket(x: np.ndarray, y: np.ndarray, sparse: int, limits: Limits) -> np.ndarray:
    """Dense tiles have their own buckets; the tiles beyond them share `sparse` ones, by a hash of the tile."""
    tx, ty = ((i >> np.uint32(limits.tile_bits)).astype(np.uint64) for i in (x, y))
    mixed = (tx * np.uint64(0x9E3779B97F4A7C15) + ty) * np.uint64(0xD6E8FEB86659FD93)
    shared = np.uint64(limits.dense) + (mixed >> np.uint64(32)) % np.uint64(sparse)
    own = tx * np.uint64(limits.grid) + ty
    return np.where((tx < limits.grid) & (ty < limits.grid), own, shared).astype(np.int64)


def _added(keys: np.ndarray, counts: np.ndarray, bucket: int, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Sums per key (x and y in 32 bits each), sorted: a dense tile by its cells, a sparse one by sorted coordinates."""
    width = 1 << limits.tile_bits
    if bucket < limits.dense and len(keys) >= width * width >> 5:
        tx, ty = divmod(bucket, limits.grid)
        x = (keys >> np.uint64(32)).astype(np.int64) - tx * width
        y = (keys & np.uint64(NO_ID)).astype(np.int64) - ty * width
        # Sums stay whole numbers below 2^53.
        cells = np.bincount(x << limits.tile_bits | y, counts, width * width)
        hit = np.flatnonzero(cells)
        found = ((hit >> limits.tile_bits) + tx * width).astype(np.uint64) << np.uint64(32) | ((hit & width - 1) + ty * width).astype(np.uint64)
        return found, cells[hit].astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[: len(keys)]
    return keys[cuts], np.add.reduceat(counts, cuts) if len(keys) else counts


def _pairs(stream: np.ndarray, sparse: int, limits: Limits) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Bucket, keys and counts of a block's pairs of neighbouring ids."""
    x, y = stream[:-1], stream[1:]
    good = (x != NO_ID) & (y != NO_ID)
    x, y = x[good], y[good]
    bucket = _bucket(x, y, sparse, limits)
    keys = x.astype(np.uint64) << np.uint64(32) | y
    order = np.argsort(bucket, kind="stable")
    keys, bucket = keys[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.array([], int)
    for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
        yield int(bucket[a]), *_added(keys[a:b], np.ones(b - a, np.int64), int(bucket[a]), limits)


def _pair_rows(lang: str, block: int, stream: np.ndarray, sparse: int, limits: Limits) -> pa.RecordBatch:
    rows = [(b, k, c) for b, k, c in _pairs(stream, sparse, limits)]
    columns = [
        pa.array([lang] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()),
        pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([_pack_sorted(r[1]) for r in rows], pa.binary()),
        pa.array([_pack(r[2].astype(np.uint32)) for r in rows], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "block", "n", "keys", "counts"])


def _count(batches: Iterator[pa.RecordBatch], sparse: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, block, data in zip(batch.column("lang").to_pylist(), batch.column("block").to_pylist(), batch.column("stream")):
            yield _pair_rows(lang, block, _unpack(data, np.uint32), sparse, limits)


def _sum(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    """Rows sorted by language, bucket and part: their counts, added up and cut into rows."""
    here, keys, counts, size = None, [], [], 0

    def add() -> None:
        nonlocal keys, counts, size
        if len(keys) > 1:
            k, c = _added(np.concatenate(keys), np.concatenate(counts), here[1], limits)
            keys, counts = [k], [c]
        size = len(keys[0])

    def done() -> Iterator[pa.RecordBatch]:
        add()
        for at in range(0, size, limits.row_entries):
            k, c = keys[0][at : at + limits.row_entries], counts[0][at : at + limits.row_entries]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            columns = [pa.array([v], kind) for v, kind in zip([*here, _pack_sorted(k), _pack(c)], kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "part", "keys", "sums"])

    for batch in batches:
        names = zip(*(batch.column(c).to_pylist() for c in ("lang", "bucket", "part")))
        wide = "sums" in batch.schema.names
        for name, k, c in zip(names, batch.column("keys"), batch.column("sums" if wide else "counts")):
            if name != here:
                if here:
                    yield from done()
                here, keys, counts, size = name, [], [], 0
            keys.append(_unpack_sorted(k))
            counts.append(_unpack(c, np.int64 if wide else np.uint32).astype(np.int64))
            size += len(keys[-1])
            # Half of it may be new each time, so the work stays in proportion.
            if size > max(limits.entries, 2 * len(keys[0])):
                add()
    if here:
        yield from done()


def _frequent(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("lang").to_pylist(), batch.column("bucket").to_pylist()
            for lang, bucket, k, c in zip(*names, batch.column("keys"), batch.column("sums")):
                keys, sums = _unpack_sorted(k), _unpack(c, np.int64)
                good = sums >= least
                n = int(good.sum())
                columns = [pa.array([lang] * n, pa.string()), pa.array([bucket] * n, pa.int64()), pa.array(keys[good].view(np.int64)), pa.array(sums[good])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "key", "f"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by language, bucket and part, first the frequent pairs with their ids, then what blocks ask for."""
    here, known, ids, ready = None, [], [], False
    for batch in batches:
        out = []
        columns = [batch.column(c) for c in ("block", "key", "id", "keys")]
        names = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "bucket", "part"))))
        asked = np.asarray(columns[0].is_valid())
        at = 0
        while at < len(names):
            if names[at] != here:
                here, known, ids, ready = names[at], [], [], False
            stop = at + 1
            while stop < len(names) and names[stop] == here and asked[stop] == asked[at]:
                stop += 1
            if not asked[at]:
                known.append(columns[1].slice(at, stop - at).to_numpy().view(np.uint64))
                ids.append(columns[2].slice(at, stop - at).to_numpy())
            else:
                if not ready:
                    k = np.concatenate(known) if known else np.array([], np.uint64)
                    order = np.argsort(k)
                    known = [k[order]]
                    ids = [np.concatenate(ids)[order] if ids else np.array([], np.int64)]
                    ready = True
                for i in range(at, stop):
                    keys = _unpack_sorted(columns[3][i])
                    place = np.searchsorted(known[0], keys)
                    place[place == len(known[0])] = 0
                    hit = known[0][place] == keys if len(known[0]) else np.zeros(len(keys), bool)
                    if hit.any():
                        out.append((columns[0][i].as_py(), _pack_sorted(keys[hit]), _pack(ids[0][place[hit]].astype(np.uint32))))
            at = stop
        kinds = [pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["block", "keys", "ids"])


def _translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, answers before the stream: the stream of the longer phrases' ids."""
    here, known, ids = None, [], []
    for batch in batches:
        for block, lang, stream, k, i in zip(batch.column("block").to_pylist(), batch.column("lang").to_pylist(), *(batch.column(c) for c in ("stream", "keys", "ids"))):
            if block != here:
                here, known, ids = block, [], []
            if lang is None:
                known.append(_unpack_sorted(k))
                ids.append(_unpack(i, np.uint32))
                continue
            old = _unpack(stream, np.uint32)
            new = np.full(max(len(old) - 1, 0), NO_ID, np.uint32)
            if known:
                keys, values = np.concatenate(known), np.concatenate(ids)
                order = np.argsort(keys)
                keys, values = keys[order], values[order]
                good = np.flatnonzero((old[:-1] != NO_ID) & (old[1:] != NO_ID))
                asked = old[good].astype(np.uint64) << np.uint64(32) | old[good + 1]
                place = np.searchsorted(keys, asked)
                place[place == len(keys)] = 0
                new[good] = np.where(keys[place] == asked, values[place], NO_ID)
            yield _stream_row(block, lang, new)


def _stream_row(block: int, lang: str, stream: np.ndarray) -> pa.RecordBatch:
    """Runs of NO_ID say no more than one, so they are cut down to it."""
    gap = stream == NO_ID
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    stream = stream[keep]
    rows = 1 if len(stream) > 1 else 0
    columns = [pa.array([block] * rows, pa.int64()), pa.array([lang] * rows, pa.string()), pa.array([_pack(stream)] * rows, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block", "lang", "stream"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words' ids and places: the words of each block with their ids, as one row per block and batch."""
    for batch in batches:
        places = batch.column("places")
        where = places.flatten()
        blocks, codes = (where.field(i).to_numpy() for i in range(2))
        ids = np.repeat(batch.column("id").to_numpy(), places.value_lengths().to_numpy())
        order = np.lexsort((codes, blocks))
        blocks, codes, ids = blocks[order], codes[order].astype(np.uint64), ids[order].astype(np.uint32)
        cuts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])) if len(blocks) else np.array([], int)
        out = [(int(blocks[a]), _pack_sorted(codes[a:b]), _pack(ids[a:b])) for a, b in zip(cuts, [*cuts[1:], len(blocks)])]
        kinds = [pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["block", "keys", "ids"])


def _rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, word ids before the stream: the stream of ids instead of the block's own numbers."""
    here, found = None, []
    for batch in batches:
        for block, lang, stream, k, i in zip(batch.column("block").to_pylist(), batch.column("lang").to_pylist(), *(batch.column(c) for c in ("stream", "keys", "ids"))):
            if block != here:
                here, found = block, []
            if lang is None:
                found.append((_unpack_sorted(k), _unpack(i, np.uint32)))
                continue
            old = _unpack(stream, np.uint32)
            # The last place is for what is no word.
            table = np.full(int(old[old != NO_ID].max(initial=0)) + 2, NO_ID, np.uint32)
            for codes, ids in found:
                table[codes] = ids
            yield _stream_row(block, lang, table[np.minimum(old, len(table) - 1)])


def _by_block(rows: DataFrame, streams: DataFrame, run) -> DataFrame:
    """Hands each block what was found for it, and then its stream."""
    both = rows.unionByName(streams, allowMissingColumns=True)
    dealt = both.repartition("block").sortWithinPartitions("block", F.col("lang").asc_nulls_first())
    return dealt.mapInArrow(run, "block bigint, lang string, stream binary")


def _dealt(df: DataFrame, *order: Column) -> DataFrame:
    return df.repartition("lang", "bucket", "part").sortWithinPartitions("lang", "bucket", "part", *order)


def _grown(pairs: DataFrame, least: int, limits: Limits, brief: ExitStack) -> tuple[DataFrame, DataFrame]:
    """Frequent pairs of a level (lang, bucket, key, f), and the pairs of each block with their bucket's part and parts."""
    # Only buckets that need more than one task: no more rows than such tasks.
    sizes = pairs.groupBy("lang", "bucket").agg(F.ceil(F.sum("n") / limits.entries).cast("int").alias("parts"))
    sizes = brief.enter_context(briefly_kept(sizes.filter("parts > 1"), "phrase-parts"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(sizes, ["lang", "bucket"], "left").withColumn("part", F.pmod(F.xxhash64("block"), parts).cast("int"))
    dealt = dealt.withColumn("parts", parts)
    spread = sizes.agg(F.max("parts")).first()[0] or 1
    sums = dealt.select("lang", "bucket", "part", "keys", "counts")
    while True:
        summed = _dealt(sums).mapInArrow(lambda b: _sum(b, limits), "lang string, bucket bigint, part int, keys binary, sums binary")
        if spread == 1:
            break
        summed = brief.enter_context(briefly_kept(summed, "phrase-sums"))
        sums = summed.withColumn("part", F.floor(F.col("part") / limits.fan_in).cast("int"))
        spread = -(-spread // limits.fan_in)
    frequent = summed.mapInArrow(_frequent(least), "lang string, bucket bigint, key bigint, f bigint")
    return brief.enter_context(briefly_kept(frequent, "phrase-counts")), dealt


def _answered(dealt: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per block, the ids of its pairs that are frequent."""
    parts = dealt.select("lang", "bucket", "parts").filter("parts > 1").distinct()
    known = ranked.join(parts, ["lang", "bucket"], "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    )
    both = known.select("lang", "bucket", "part", "key", "id").unionByName(
        dealt.select("lang", "bucket", "part", "block", "keys"), allowMissingColumns=True
    )
    return _dealt(both, F.col("block").asc_nulls_first()).mapInArrow(_answer, "block bigint, keys binary, ids binary")


def phrases(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """The phrases of up to `longest` words found `least` times or more, and the number of words per language (lang, n).

    Phrases have lang, words (their words), starts and ends: how often their first 1, 2, ... words are found, and their last 1, 2, ... .
    """
    require(df, text, lang)
    texts = df.select(F.coalesce(col(text), F.lit("")).alias("text"), F.coalesce(col(lang).cast("string"), F.lit("und")).alias("lang"))
    levels = []
    # Streams and pairs are as large as the corpus; each round's are removed as soon as the next has been written.
    with ExitStack() as last:
        blocks = last.enter_context(briefly_kept(texts.mapInArrow(lambda b: _cut(b, limits), BLOCKS), "phrase-blocks"))
        totals = kept(blocks.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")), "phrase-totals")
        size = totals.agg(F.sum("n"), F.sum("blocks")).first()
        words = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w"))
        group = F.pmod(F.xxhash64("block"), F.lit(-(-(size[1] or 1) // limits.list_blocks)))
        words = words.select("lang", F.col("w.words").alias("word"), group.alias("g"), "block", "code", F.col("w.counts").alias("c"))
        # A word comes once per block, and becomes a row per group of blocks, so a language's most frequent words are spread thin.
        words = words.repartition("lang", "word").groupBy("lang", "word", "g").agg(
            F.sum("c").alias("c"), F.collect_list(F.struct("block", "code")).alias("places")
        )
        words = words.withColumn("f", F.sum("c").over(Window.partitionBy("lang", "word"))).filter(F.col("f") >= least)
        words = last.enter_context(briefly_kept(words.select("lang", "word", "f", "places"), "phrase-words"))
        level = words.groupBy("lang", "word").agg(F.first("f").alias("f"))
        level = _ranked(level, [F.col("f").desc(), F.col("word")])
        level = kept(level.select("lang", "id", F.array("word").alias("words"), F.array("f").alias("starts"), F.array("f").alias("ends")), "phrase-level")
        levels.append(level)
        found = words.join(level.select("lang", F.col("words")[0].alias("word"), "id"), ["lang", "word"]).select("id", "places")
        found = found.mapInArrow(_packed, "block bigint, keys binary, ids binary")
        sparse = max(8, -(-(size[0] or 0) // limits.entries))
        streams = kept(_by_block(found, blocks.select("block", "lang", "stream"), _rename), "phrase-streams")
    for k in range(2, longest + 1):
        with ExitStack() as brief:
            brief.callback(remove_kept, streams)
            pairs = brief.enter_context(briefly_kept(streams.mapInArrow(lambda b: _count(b, sparse, limits), PAIRS), "phrase-pairs"))
            frequent, dealt = _grown(pairs, least, limits, brief)
            ranked = _ranked(frequent, [F.col("f").desc(), F.col("key")])
            first, second = F.shiftrightunsigned("key", 32).alias("x"), F.col("key").bitwiseAND(F.lit(NO_ID)).alias("y")
            begin = level.select("lang", F.col("id").alias("x"), "words", "starts")
            end = level.select("lang", F.col("id").alias("y"), F.element_at("words", -1).alias("word"), "ends")
            grown = ranked.select("lang", "id", "f", first, second).join(begin, ["lang", "x"]).join(end, ["lang", "y"])
            level = kept(
                grown.select(
                    "lang", "id", F.concat("words", F.array("word")).alias("words"), F.concat("starts", F.array("f")).alias("starts"),
                    F.concat("ends", F.array("f")).alias("ends"),
                ), "phrase-level",
            )
            levels.append(level)
            if k < longest:
                streams = kept(_by_block(_answered(dealt, ranked), streams, _translate), "phrase-streams")
    return reduce(DataFrame.unionByName, levels), totals.select("lang", "n")


def _ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """With ids from 0 per language, in the order; they must fit 32 bits, one more and the task fails."""
    ranked = numbered(rows, "lang", order, "phrase-ranks").withColumnRenamed("pos", "id")
    fits = F.when(F.col("id") < NO_ID, F.col("id")).otherwise(F.raise_error(F.lit("more different phrases than 32 bits can number")).cast("bigint"))
    return ranked.withColumn("id", fits)


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases of two words and more with phrase, a, and the l, r and score of their lowest-scoring cut.

    score = floor(1000 * a * n / (l * r)), in decimals of 38 digits; the first of equal cuts counts.
    """
    rows = found.filter(F.size("words") > 1).join(totals, "lang").withColumn("a", F.element_at("starts", -1))
    wide = lambda c: c.cast("decimal(19,0)")

    def cut(k: Column) -> Column:
        l, r = F.element_at("starts", k), F.element_at("ends", F.size("words") - k)
        return F.struct(l.alias("l"), r.alias("r"), k.alias("k"))

    cuts = F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut)
    # Decimals in lambdas would be computed for each cut's struct anew, so the cuts are rows for a moment: at most longest - 1.
    each = rows.select("lang", "words", "a", "n", F.explode(cuts).alias("c")).select("*", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.k").alias("k"))
    top, below = wide(F.col("a")) * wide(F.col("n")) * F.lit(1000).cast("decimal(4,0)"), wide(F.col("l")) * wide(F.col("r"))
    each = each.withColumn("top", top).withColumn("below", below).withColumn("score", F.expr("top div below"))
    best = each.groupBy("lang", "words").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b"))
    return best.select("lang", "words", F.array_join("words", " ").alias("phrase"), "b.a", "b.l", "b.r", "b.n", "b.score")


def inside(found: DataFrame, percent: int) -> DataFrame:
    """The phrases (lang, words) that lie in a longer one with at least `percent` of their own count."""
    size = F.size("words")
    parts = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.slice("words", i, k)),
        )
    )
    longer = found.filter(size > 2).select("lang", F.element_at("starts", -1).alias("longer"), F.explode(parts).alias("words"))
    longer = longer.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    own = found.filter(size > 1).select("lang", "words", F.element_at("starts", -1).alias("a"))
    return own.join(longer, ["lang", "words"]).filter(100 * F.col("longer") >= percent * F.col("a")).select("lang", "words")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = 100, limits: Limits = Limits()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases per language, by score, count and then UTF-8 bytes.

    Phrases that lie in a longer one which is found in `percent` of their places are left out.
    """
    found, totals = phrases(df, text, lang, least, longest, limits)
    found = found.select("lang", "words", "starts", "ends")
    best = scored(found, totals).join(inside(found, percent), ["lang", "words"], "left_anti")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = best.withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
