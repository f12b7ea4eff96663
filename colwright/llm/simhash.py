"""SimHash near copies by anchor-point covering.

Texts get 64-bit fingerprints of word shingles. Two fingerprints at most 3 bits apart
are at most one bit apart in one of their halves, so each half is covered with threshold 1. The anchors
are the words of the Hamming code of length 31, which has covering radius 1: every point is
within 1 of one anchor. A fingerprint goes to every anchor within 1 + 1 bits of the first 31 bits
of either half (16 of them, or the point itself if it is an anchor), and any two that link meet at the anchor
nearest to one of them. At each anchor they are compared in full, and a spanning forest of the links is
kept, never all pairs. Components are found by star contraction over tables.

Equal fingerprints are one point, so exact copies and texts without words (fingerprint zero)
cost one row. Null ids never name a component while another id can; repeated rows have equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colwright.columns import col, require
from colwright.llm.components import components
from colwright.llm.text import free_name
from colwright.sources.shared import kept

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
HALF_BITS = 31
CHUNK = 1 << 16


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text, unsigned."""
    import xxhash

    # bytes.lower and bytes.split know ASCII letters and ASCII white space only, as wanted.
    word = text.encode().lower().split()
    if not word:
        return 0
    joined = b" ".join(word)
    if len(word) < shingle_words:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, word), np.int64, len(word))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends[shingle_words - 1 :].tolist()
    counts, of = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(ends), CHUNK):
        hashes = np.array([of(joined[s:e], SEED) for s, e in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(ends)).tobytes(), "big")


def fingerprint_column(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed bigint with the same bits; null counts as empty."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(t, shingle_words) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return of.asNondeterministic()(F.coalesce(text, F.lit("")))


def _anchors(half: str) -> Column:
    """Code words within two bits of the column's low 31 bits.

    The syndrome of a point is the number of the bit that leads to its nearest code word.
    Flipping that bit, or two bits whose numbers make up the syndrome, gives all within two.
    """
    checks = [sum(1 << (i - 1) for i in range(1, HALF_BITS + 1) if i >> k & 1) for k in range(5)]
    syndrome = " + ".join(f"((bit_count({half} & {m}L) & 1) << {k})" for k, m in enumerate(checks))
    pairs = f"""transform(filter(sequence(1, {HALF_BITS}), i -> i <> s AND i < (i ^ s)),
        i -> {half} ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1))"""
    return F.expr(f"""flatten(transform(array({syndrome}), s -> CASE WHEN s = 0 THEN array({half})
        ELSE concat(array({half} ^ shiftleft(1L, s - 1)), {pairs}) END))""")


def _forest(points: np.ndarray, max_bits: int, out: list) -> None:
    """Append edges that join the points as all pairs within max_bits would."""
    left = points
    while left.size > 1:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            at = todo.pop()
            near = np.bitwise_count(left ^ at) <= max_bits
            if near.any():
                new = left[near]
                out.append(np.stack([np.full(new.size, at), new], axis=1))
                left = left[~near]
                todo.extend(new)


def _compare(max_bits: int):
    """Over sorted rows of (anchor, point): the forest of each anchor. Holds one anchor's points."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = np.empty((0, 2), np.int64)

        def edges(rows: np.ndarray) -> pd.DataFrame:
            out: list[np.ndarray] = []
            cuts = np.flatnonzero(np.diff(rows[:, 0])) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(rows)]
            size = ends - starts
            two = starts[size == 2]
            a, b = rows[two, 1].view(np.uint64), rows[two + 1, 1].view(np.uint64)
            close = np.bitwise_count(a ^ b) <= max_bits
            out.append(np.stack([a[close], b[close]], axis=1))
            for i in np.flatnonzero(size > 2):
                _forest(rows[starts[i] : ends[i], 1].copy().view(np.uint64), max_bits, out)
            made = np.ascontiguousarray(np.concatenate(out)).view(np.int64)
            return pd.DataFrame({"a": made.min(axis=1, initial=2**63 - 1), "b": made.max(axis=1, initial=-(2**63))})

        for frame in frames:
            rows = np.concatenate([rest, frame[["anchor", "point"]].to_numpy(np.int64)])
            if not len(rows):
                continue
            cut = np.searchsorted(rows[:, 0], rows[-1, 0])  # the last anchor may go on in the next batch
            if cut:
                yield edges(rows[:cut])
            rest = rows[cut:]
        if len(rest):
            yield edges(rest)

    return run


def link(points: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) between the distinct bigints of column point that join all within max_bits (3 at most)."""
    if max_bits > MAX_BITS:
        raise ValueError(f"halves covered with threshold 1 find links of at most {MAX_BITS} bits")
    low = (1 << HALF_BITS) - 1
    at = points.select("point", F.expr(f"point & {low}L").alias("low"), F.expr(f"shiftrightunsigned(point, 32) & {low}L").alias("high"))
    # The two halves' anchors share one number: the high half's have bit 32 set.
    both = at.select(
        "point", F.explode(F.concat(_anchors("low"), F.transform(_anchors("high"), lambda a: a + F.lit(1 << 32)))).alias("anchor")
    )
    dealt = both.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInPandas(_compare(max_bits), "a bigint, b bigint").distinct()


def _components(df: DataFrame, doc_id: str, text: str, shingle_words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(id, point) of every row, and (point, root, component_id) of every different fingerprint."""
    prints = kept(
        df.select(col(doc_id).alias("id"), fingerprint_column(col(text), shingle_words).alias("point")), "fingerprints"
    )
    points = kept(prints.groupBy("point").agg(F.min("id").alias("first_id")), "points")
    roots = components(link(points.select("point"), max_bits))
    rooted = points.join(roots.withColumnRenamed("node", "point"), "point", "left").withColumn(
        "root", F.coalesce("root", "point")
    )
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints, rooted.join(firsts, "root").select("point", "root", "component_id")


def near_copies(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per input row: the id, fingerprint (16 hex digits) and component_id, the smallest id reachable."""
    require(df, doc_id, text)
    prints, named = _components(df, doc_id, text, shingle_words, max_bits)
    return prints.join(named, "point").select(
        F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """Of each component one row, with its own columns: that of the smallest id, nulls last.

    Of rows that share that id and lie in the component, the one with the smallest fingerprint stays,
    and of those equal in both any one.
    """
    require(df, doc_id, text)
    prints, named = _components(df, doc_id, text, shingle_words, max_bits)
    id_, point, own = free_name(df, "__id"), free_name(df, "__point"), free_name(df, "__own")
    best = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "point")).alias("best")
    reps = prints.join(named, "point").groupBy("root").agg(best).select(F.col("best.id").alias(id_), F.col("best.point").alias(point))
    rows = prints.groupBy("id").agg(F.count("*").alias("rows"))
    # Only ids that lose a row meet the texts: a row whose id is its own and is chosen needs no partner.
    losing = kept(
        rows.join(reps, rows["id"].eqNullSafe(reps[id_]), "left")
        .filter(F.col(point).isNull() | (F.col("rows") > 1))
        .select(F.col("id").alias(id_), point),
        "losing",
    )
    same_id = col(doc_id).eqNullSafe(F.col(id_))
    alone = df.join(losing.select(id_), same_id, "left_anti")
    shared = losing.filter(F.col(point).isNotNull())
    if shared.isEmpty():
        return alone
    repeated = df.join(shared.select(id_).distinct(), same_id, "left_semi").withColumn(
        own, fingerprint_column(col(text), shingle_words)
    )
    one = repeated.join(shared, same_id & (F.col(own) == F.col(point))).dropDuplicates([id_, point])
    return alone.unionByName(one.select(*[col(c) for c in df.columns]))
