"""Each pipeline stage, as it is wired, on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, base_spans int, hits int, row int, mark int,"
    " pos int, n int, rows int, component_id int, point string"
)
GOOD = " ".join(f"word{i}" for i in range(80))
LONG = " ".join(f"w{i % 5000}x{i}" for i in range(60_000))
SECRET = GOOD + " password: hunter2hunter2hunter2 end"
TEXTS = [(1, None), (2, ""), (None, None), (None, GOOD + " other"), (3, LONG), (4, GOOD), (4, GOOD), (5, "  \n "), (6, GOOD), (7, SECRET)]


def frame(spark, texts):
    rows = [(d, t, "en", "s" if d else None, None if t is None else len(t), "own", 1, 2, 3, 4, 5, 6, 7, 8, "p") for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def result(spark, name, texts):
    docs = frame(spark, texts)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, FOLDER)
    if name != "mix_sources":
        assert out.schema.simpleString() == docs.schema.simpleString()
    rows = out.collect()
    assert all((r.spans, r.base_spans, r.hits, r.row, r.mark, r.n, r.point) == ("own", 1, 2, 3, 4, 6, "p") for r in rows)
    return sorted(((r.doc_id, r.text, r.n_chars) for r in rows), key=str)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_an_empty_table_stays_empty(spark, name):
    assert result(spark, name, []) == []


def as_rows(texts):
    return sorted(((d, t, None if t is None else len(t)) for d, t in texts), key=str)


def test_quality_rules(spark):
    good = [(d, t) for d, t in TEXTS if t and len(t.split()) >= 50]
    assert result(spark, "quality_rules", TEXTS) == as_rows(good)


def test_near_dedup(spark):
    found = result(spark, "near_dedup", TEXTS)
    ids = [d for d, _, _ in found]
    # 1, 2, 5 and a null have no words; 4 and 6 have one text, and those of 7 and the other null are near it or not.
    assert ids.count(1) == 1 and ids.count(2) == ids.count(5) == 0
    assert ids.count(3) == 1 and ids.count(4) == 1 and ids.count(6) == 0
    assert result(spark, "near_dedup", [(1, GOOD)] * 5 + [(None, GOOD)] * 3) == as_rows([(1, GOOD)])


def test_decontamination(spark):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    texts = [*TEXTS, (8, f"{GOOD} {item} {GOOD}"), (8, item)]
    assert result(spark, "decontamination", texts) == as_rows(TEXTS)


def test_secret_scan(spark):
    found = result(spark, "secret_scan", TEXTS)
    wanted = [(d, t if d != 7 else t.replace("password: hunter2hunter2hunter2", "[SECRET]")) for d, t in TEXTS]
    assert found == as_rows(wanted)


def test_mix_sources(spark):
    found = result(spark, "mix_sources", TEXTS)
    assert {d for d, _, _ in found} <= {d for d, _ in TEXTS} and found
