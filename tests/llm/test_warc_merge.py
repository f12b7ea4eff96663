"""The external merge of archive indexes: order, passes, bounded buffers and what is left behind."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colwright.llm import warc
from colwright.sources.shared import shared_path

NAMES = [p.strip().split()[0] for p in warc.INDEX.split(",")]
KINDS = [pa.int64() if p.strip().endswith("bigint") else pa.string() for p in warc.INDEX.split(",")]


def entries(runs, length, seed=1):
    """Index entries by archive, each archive sorted, as a task gets them: in batches that cut through archives."""
    rng = random.Random(seed)
    rows = []
    for r in range(runs):
        own = []
        for i in range(length):
            page = rng.choice([None, rng.randint(0, 10**6)])
            own.append((f"k{rng.randint(0, 50)}", f"t{rng.randint(0, 3)}", page, "response", "d", 1, None, f"archive{r:04d}", i, 9))
        rows += sorted(own, key=lambda e: (e[0], e[1], e[2] is None, e[2] or 0))
    return rows


def batches(rows, size=37):
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], kind) for k, kind in enumerate(KINDS)], NAMES)


@pytest.mark.parametrize("runs, fan_in, buffer_rows", [(1, 2, 3), (2, 2, 1), (9, 2, 4), (30, 3, 2), (17, 64, 256)])
def test_passes_give_one_order(tmp_path, runs, fan_in, buffer_rows):
    rows = entries(runs, 40)
    found = [tuple(r.values()) for b in warc._merge(str(tmp_path / "s"), fan_in, buffer_rows)(batches(rows)) for r in b.to_pylist()]
    assert sorted(found, key=str) == sorted(rows, key=str)
    keys = [(r[0], r[1], r[2] is None, r[2] or 0) for r in found]
    assert keys == sorted(keys)
    assert list((tmp_path / "s").iterdir()) == []


def test_no_entries(tmp_path):
    assert list(warc._merge(str(tmp_path / "s"), 2, 2)(iter([]))) == []


def test_memory_does_not_grow_with_the_range(tmp_path):
    def peak(length):
        rows = entries(12, length)
        source = batches(rows)
        tracemalloc.start()
        n = sum(b.num_rows for b in warc._merge(str(tmp_path / str(length)), 4, 16)(source))
        used = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == len(rows)
        return used

    peak(50)
    small, large = peak(200), peak(4000)
    assert large < 2 * small


def test_ranges_and_histories(spark):
    rng = random.Random(3)
    pages = [(i, f"http://h{rng.randint(0, 9)}.example/{rng.randint(0, 20)}", f"body {i % 50}" * 30) for i in range(800)] + [(801, None, None)]
    pages += [(5, pages[5][1], pages[5][2])] * 2  # the same capture again
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    path = shared_path(spark, "warc-test")
    warc.write_archives(df.repartition(6), path, captured=(F.lit(1_700_000_000) + F.col("page_id") % 97).cast("timestamp"))
    found = warc.merged_index(spark, path, range_rows=100, fan_in=2, buffer_rows=3)
    assert found.rdd.getNumPartitions() > 3
    rows = found.collect()
    assert sorted(r.page_id for r in rows) == sorted(p[0] for p in pages)
    keys = [(r.url_key, r.captured, r.page_id) for r in rows]
    assert keys == sorted(keys)
