"""Phrase mining against plain counting, with all limits made small so that every path is taken."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from colwright.llm import phrases
from colwright.llm.ranks import numbered
from pyspark.sql import functions as F


def brute(rows, least, top, longest=5, percent=100):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n, rows_ = totals[lang], []
        known = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        hidden = set()
        for p, a in known.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= percent * known[p[i : i + k]]:
                        hidden.add(p[i : i + k])
        for p, a in known.items():
            if p not in hidden:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, p, l, r) in enumerate(sorted(rows_)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def corpus(seed, n=300):
    random.seed(seed)
    vocabulary = ["The", "the", "of", "New", "York", "ice", "cream", "É", "é", "x y", "a\x00b", *[f"w{i}" for i in range(60)]]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for i in range(n):
        words = random.choices(vocabulary, weights, k=random.choice([0, 1, 3, 40]))
        text = "".join(w + random.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r", " ! "]) for w in words)
        rows.append((text if i % 17 else text + " of the new york ice cream" * 5, ["en", "de", None, "und", ""][i % 5]))
    return rows + [(None, "en"), ("", None), ("...", "en"), (" \t ", "fr")] + [("same copy of the text", "en")] * 30


def found(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


@pytest.mark.parametrize("small", [False, True])
def test_against_counting(spark, small):
    # Tiny blocks, tiles and parts: sparse buckets, split buckets, sums over several rounds.
    tiny = phrases.Limits(block_words=60, held_words=200, tile_bits=2, grid=2, entries=40, row_entries=7, fan_in=2, list_blocks=3)
    limits = tiny if small else phrases.Limits()
    rows = corpus(3)
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("block", F.lit(1)).withColumn("words", F.lit("x"))
    assert found(df.repartition(5), least=4, top=50, limits=limits) == brute(rows, 4, 50)
    assert len(brute(rows, 4, 50)) > 60


def test_options(spark):
    rows = corpus(5, 100)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert found(df, least=3, top=1000, longest=3, percent=60) == brute(rows, 3, 1000, 3, 60)


def test_nothing_to_find(spark):
    for rows in ([], [(None, None)], [("a b", "en")]):
        assert found(spark.createDataFrame(rows, "text string, lang string")) == []


def test_a_very_long_text_and_piece(spark):
    rows = [("x y " * 30_000, "en"), ("x y. " * 200, None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert found(df) == brute(rows, 100, 2000)


def test_scores_are_exact_beyond_64_bits(spark):
    n, a, l, r = 4_000_000_000_000, 3_000_000_000_007, 3_000_000_000_011, 3_999_999_999_989
    level = spark.createDataFrame([("en", ["a", "b"], [l, a], [r, a])], "lang string, words array<string>, starts array<bigint>, ends array<bigint>")
    totals = spark.createDataFrame([("en", n)], "lang string, n bigint")
    assert phrases.scored(level, totals).first().score == 1000 * a * n // (l * r)


def test_packing():
    rng = np.random.RandomState(1)
    import pyarrow as pa

    for kind in (np.uint32, np.int64, np.uint64):
        for n in (0, 1, 1000):
            values = rng.randint(0, 1 << 31, n).astype(kind)
            assert (phrases._unpack(pa.scalar(phrases._pack(values), pa.binary()), kind) == values).all()
    keys = np.unique(rng.randint(0, 1 << 62, 1000).astype(np.uint64) * np.uint64(3))
    assert (phrases._unpack_sorted(pa.scalar(phrases._pack_sorted(keys), pa.binary())) == keys).all()


def test_numbers_run_through_a_hot_group(spark):
    df = spark.range(0, 5000, numPartitions=6).selectExpr("if(id % 10 < 9, 'hot', concat('g', id % 7)) AS g", "id % 50 AS v", "1 AS pos", "id")
    got = numbered(df, "g", [F.col("v").desc(), F.col("id")], "test").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append(r)
    for rows in groups.values():
        rows.sort(key=lambda r: r.pos)
        assert [r.pos for r in rows] == list(range(len(rows))) and {r.n for r in rows} == {len(rows)}
        assert rows == sorted(rows, key=lambda r: (-r.v, r.id))
    assert numbered(df.limit(0), "g", [F.col("v")], "test").count() == 0
