"""Cases that an earlier form of an operator lost or shifted."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from colwright.llm import contamination, language, licenses, mixing, quality, secrets
from colwright.llm.text import running


def test_a_mix_does_not_depend_on_the_dealing(spark):
    """Rows that share an id and differ in size: the same ones are taken, however they are dealt."""
    random.seed(1)
    rows = [(1, "s", "word " * random.randint(1, 90)) for _ in range(59)] + [(None, None, "word " * random.randint(1, 90)) for _ in range(40)]
    rows += [(i, "t", "a b c " * i) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    results = []
    for dealt in (df.coalesce(1), df.repartition(7), df.repartition(5, "text"), df.orderBy(F.rand(3))):
        mixed = mixing.mix(dealt, mixing.text_words(F.col("text")), payload=("doc_id",))
        results.append(sorted(mixed.select("doc_id", "size", "source_size", "target", "taken").collect(), key=str))
    assert all(r == results[0] for r in results)
    assert sum(r.taken for r in results[0]) > 0


def test_copies_of_one_row_are_dealt_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    rows = [(1, "s", "a b c")] * 300 + [(i, "s", "a " * (i % 9 + 1)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    results = []
    for dealt in (df.coalesce(1), df.repartition(6)):
        found = mixing.mix(dealt, mixing.text_words(F.col("text")), payload=("doc_id",)).collect()
        assert len(found) == 400 and all(r.taken <= 2 * r["size"] for r in found)
        assert abs(sum(r.taken for r in found) - found[0].target) <= 9
        results.append(sorted((r.doc_id, r["size"], r.taken) for r in found))
    assert results[0] == results[1]
    marked = spark.range(300).selectExpr("5L AS mark", "15L AS buckets", "0L AS mix_bucket", "3L AS size")
    sizes = mixing._dealt_alike(marked).groupBy("mix_bucket").count().collect()
    assert [r["count"] for r in sizes] == [20] * 15


def spans(spark, text):
    return secrets.scan(spark.createDataFrame([(text,)], "text string")).first().spans


def brute_linked(found, scope):
    """Every weak part that has parts of all roles it needs within the scope, by comparing all pairs."""
    gap = lambda a, b: max(a[1] - b[2], b[1] - a[2], 0)
    kept = []
    for a in found:
        kind = secrets.KINDS[a[0]]
        needs = secrets.NEEDS[kind[1]]
        if not kind[2] or all(any(secrets.KINDS[b[0]][1] == role and gap(a, b) <= scope for b in found) for role in needs):
            kept.append(a)
    return sorted(kept, key=lambda s: (s[1], secrets.KINDS[s[0]][0]))


def test_a_login_behind_a_long_token_is_linked(spark):
    found = [s.kind for s in spans(spark, "token: " + "x9" * 135 + " login: bobby99")]
    assert found == ["assign", "weak_access"]


def test_links_are_those_of_all_pairs(spark):
    random.seed(9)
    parts = ["login: bobby99", "password: " + "k" * 20, "AKIA" + "B" * 16, "https://host.example/" + "p" * 250, "0f" * 150, "aB3" + "xY7zQ2" * 5, "10.0.0.7:80", "user=" + "u" * 450]
    texts = [""]
    for _ in range(60):
        texts.append("".join(random.choice(parts) + " " * random.choice([1, 30, 198, 199, 200, 201, 202, 400]) for _ in range(random.randint(1, 7))))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    all_found = df.select("text", *[secrets.find(F.col("text"), k).alias(k) for k in secrets.KINDS]).collect()
    every = {r.text: [(s.kind, s.start, s.end) for k in secrets.KINDS for s in r[k]] for r in all_found}
    for r in secrets.scan(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans] == brute_linked(every[r.text], secrets.SCOPE)


def hits(items, texts):
    words = [(i, contamination.word_hashes(t)) for i, t in items]
    return [{h["item_id"]: h["distance"] for h in found} for found in contamination.Index(words).hits([contamination.word_hashes(t) for t in texts])]


def test_seven_words_with_one_replaced():
    item = "what is the capital city of france"
    found = hits([(1, item)], [f"so {item.replace('capital', 'main')} then", item, "what is the main town of france", "what is the city of france"])
    assert found == [{1: 1}, {1: 0}, {}, {1: 1}]


def test_short_items_with_one_edit_against_all_pairs():
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(random.choices(vocabulary, k=random.choice([1, 3, 4, 5, 6, 7])))) for i in range(80)]
    texts = [" ".join(random.choices(vocabulary, k=random.choice([0, 1, 4, 5, 6, 30]))) for _ in range(100)]
    for _ in range(200):
        words = random.choice(items)[1].split()
        k = random.randrange(len(words))
        words[k : k + random.randint(0, 1)] = random.choice([[], ["zz"]])
        texts.append(" ".join(random.choices(vocabulary, k=random.choice([0, 3])) + words + random.choices(vocabulary, k=random.choice([0, 3]))))
    for text, got in zip(texts, hits(items, texts)):
        wanted = {}
        for i, item in items:
            a, b = contamination.word_hashes(item), contamination.word_hashes(text)
            d = contamination.distance(a, b)[0] if len(b) else len(a)
            if d <= int(contamination.MAX_EDITS * len(a)):
                wanted[i] = d
        assert got == wanted


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"


def test_notices_broken_over_comment_lines(spark):
    rows, wanted = [("a/none.py", "import os\nreturn free software of charge\n")], {"a/none.py": None}
    for notice, name in ((MIT, "MIT"), (GPL, "GPL-3.0")):
        words = notice.split()
        for k, mark in enumerate(("// ", "# ", " * ", "-- ", "")):
            for lines in (2, 4, 6):
                cuts = [len(words) * i // lines for i in range(lines + 1)]
                body = "\n".join(mark + " ".join(words[a:b]) for a, b in zip(cuts, cuts[1:]))
                path = f"{name}/{k}/{lines}.py"
                rows.append((path, f"import os\n{body}\n\ndef f():\n    return 1\n"))
                wanted[path] = name
    # Files without any notice, as most are.
    rows += [(f"b/{i}.py", f"value = {i}") for i in range(200)]
    found = {r.path: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    for path, name in wanted.items():
        assert found[path].own_license == name and (name is None or found[path].own_score > 0.9)


def test_six_hundred_languages(spark):
    random.seed(8)
    names = [f"l{i:03d}" for i in range(600)]
    own = {n: ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(6)] for n in names}
    rows = [(n, " ".join(random.choices(own[n], k=12))) for n in names for _ in range(3)]
    df = spark.createDataFrame(rows, "lang string, text string")
    model = language.fit(df, k=1)
    assert model.languages == names
    asked = spark.createDataFrame([(n, " ".join(random.choices(own[n], k=12))) for n in names], "lang string, text string")
    found = language.predict(asked, model).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95


def test_spans_of_very_many_hits_are_linear(spark):
    text = "".join(f"é{i} token: abcdefghijkl{i:06d}, AKIA0123456789ABCD{i % 10}😀 \n" for i in range(8000))
    df = secrets.scan(spark.createDataFrame([(text,), ("token=short",), ("",), (None,)], "text string"))
    began = time.perf_counter()
    found = [(r.spans, r.text) for r in secrets.redact(df).collect()]
    assert time.perf_counter() - began < 30
    assert [len(s) for s, _ in found if s] == [16_000]
    spans, clean = next(x for x in found if x[0])
    assert all(text[s.start : s.end].startswith("token" if s.kind == "assign" else "AKIA") for s in spans)
    assert clean == re.sub(r"token: \w+|AKIA[A-Z0-9]+", secrets.PLACEHOLDER, text)


def test_overlapping_spans_are_one_placeholder(spark):
    rows = [("0123456789" * 300, [(10, 20), (12, 15), (14, 22), (22, 25), (1500, 2900)]), ("abc", []), ("xyz", [(0, 3)])]
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:int,end:int>>")
    t = "0123456789" * 300
    p = secrets.PLACEHOLDER
    assert {r.text for r in secrets.redact(df).collect()} == {t[:10] + p + p + t[25:1500] + p + t[2900:], "abc", p}


def test_running(spark):
    df = spark.createDataFrame([([],), ([5],), ([3, -1, 4, 1, -5, 9, 2],)], "a array<int>")
    made = df.select(running(F.col("a")).alias("s"), running(F.col("a"), F.greatest).alias("m")).collect()
    assert [list(r.s) for r in made] == [[], [5], [3, 2, 6, 7, 2, 11, 13]]
    assert [list(r.m) for r in made] == [[], [5], [3, 3, 4, 4, 4, 9, 9]]


def test_the_cheaper_of_two_rules_comes_first_each_time(spark):
    texts = [(i, f"word{i} " * (20 + i % 50)) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    third = lambda n: n % 3 == 0
    cheap = quality.Rule("cheap", lambda t, w, n: third(n))
    dear = quality.Rule("dear", lambda t, w, n: third(n) & (F.size(F.filter(w, lambda x: x.rlike("[a-z]+[0-9]+"))) >= 0))
    never = quality.Rule("never", lambda t, w, n: n < 0)
    for i in range(3):
        assert [e.rule.name for e in quality.plan_cascade(df.repartition(i + 1), rules=(never, dear, cheap))] == ["cheap", "dear", "never"]
    none = quality.plan_cascade(df.limit(0), rules=(dear, cheap))
    assert [(e.rule.name, e.rejected) for e in none] == [("dear", 0.0), ("cheap", 0.0)]
