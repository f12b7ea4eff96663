"""Nulls, empty and long texts, ties and repeated rows, empty tables and clashing column names."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colwright.llm import chat, components, contamination, language, licenses, mixing, quality, secrets, simhash, tokens, warc
from colwright.llm.queries import tokenizer_path

NAMES = "doc_id bigint, text string, source string, lang string, path string, spans string, hits int, size int, score int, kept int, component_id int, row int, __words int, section int"
LONG = "word " * 60_000


def frame(spark, rows):
    """Rows of (doc_id, text), with columns whose names the operators use themselves."""
    full = [(d, t, "s" if d else None, "en", f"a/b/{d}.txt" if d else None, "x", 1, 2, 3, 4, 5, 6, 7, 8) for d, t in rows]
    return spark.createDataFrame(full, NAMES)


ROWS = [(1, None), (2, ""), (None, None), (None, "some text here"), (3, LONG), (4, "same text here again"), (4, "same text here again"), (5, "  \n ")]


def test_quality(spark):
    df = quality.judge(frame(spark, ROWS))
    found = [(r.doc_id, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in df.collect()]
    assert sorted(found, key=str) == sorted(
        [(1, 0, 0, True, False), (2, 0, 0, True, False), (None, 0, 0, True, False), (None, 3, 0, True, False), (3, 60_000, 60_000, True, False),
         (4, 4, 0, True, False), (4, 4, 0, True, False), (5, 0, 0, True, False)], key=str)
    assert quality.keep_good(frame(spark, ROWS)).collect() == []
    good = " ".join(f"word{i}" for i in range(80))
    kept = quality.keep_good(frame(spark, [(7, good), (7, good)]))
    assert kept.columns == frame(spark, []).columns and kept.count() == 2
    assert quality.judge(frame(spark, [])).count() == 0


def test_repeated_words_by_hand(spark):
    df = spark.createDataFrame([("a b c x a b c",), ("a a a a",), ("a b",), ("a b c d",)], "text string")
    assert [r.n_repeat_words for r in quality.measure(df).collect()] == [6, 4, 0, 0]


def test_cascade_stops_at_the_first_rejection(spark):
    never = quality.Rule("never", lambda t, w, n: F.raise_error(F.lit("reached")).isNotNull())
    steps = [quality.Estimate(quality.RULES[0], 1.0, 1.0), quality.Estimate(never, 1.0, 0.0)]
    df = spark.createDataFrame([("## ## ##",)], "text string")
    verdict = quality.passes(steps, F.col("text"), F.split("text", " "))
    assert df.select(verdict.alias("v")).first().v is False


def test_cascade_orders_by_rejections_per_cost(spark):
    slow = quality.Rule("slow", lambda t, w, n: F.exists(F.sequence(F.lit(0), F.lit(200_000)), lambda i: i + F.length(t) < 0))
    rejects = quality.Rule("rejects", lambda t, w, n: F.lit(True))
    df = spark.createDataFrame([(f"t {i}",) for i in range(200)], "text string")
    assert [e.rule.name for e in quality.plan_cascade(df, rules=(slow, rejects))] == ["rejects", "slow"]


def test_secrets(spark):
    key, secret = "AKIA" + "B" * 14, "aB3" + "xY7zQ2" * 5
    text = f"login: maria and {secret} at https://x.example.com ok"
    far = f"login: maria {'x ' * 200} {secret}"
    rows = ROWS + [(10, text), (10, text), (11, far), (12, f"{key} {secret}"), (13, f"only {secret} here"), (14, "token=" + "a" * 12 + " é " + key)]
    df = secrets.scan(frame(spark, rows))
    found = {}
    for r in df.collect():
        found.setdefault(r.doc_id, []).append([(s.kind, s.start, s.end) for s in r.spans])
    assert found[1] == found[2] == [[]] and len(found[None]) == 2 and found[4] == [[], []]
    kinds = [k for k, _, _ in found[10][0]]
    assert kinds == ["weak_access", "weak_secret", "endpoint"] and found[10][0] == found[10][1]
    assert found[11] == [[]] and found[13] == [[]]
    assert [k for k, _, _ in found[12][0]] == ["access", "weak_secret"]
    assert found[14] == [[("assign", 0, 18), ("access", 21, 39)]]
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[14] == "[SECRET] é [SECRET]" and clean[1] is None and clean[13] == f"only {secret} here"
    assert secrets.scan(frame(spark, [])).count() == 0


def test_many_parts_make_no_pairs(spark):
    text = ("login: maria " + "aB3" + "xY7zQ2" * 5 + " ") * 300
    df = secrets.scan(spark.createDataFrame([(text,)], "text string"))
    assert len(df.first().spans) == 600


def test_simhash(spark):
    rows = ROWS + [(9, "same text here again")]
    found = simhash.near_copies(frame(spark, rows)).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert by[1] == by[2] == by[5] == [("0" * 16, 1)] and ("0" * 16, 1) in by[None]
    assert by[4] == by[4][:1] * 2 and by[9] == by[4][:1] and by[4][0][1] == 4
    assert len(found) == len(rows)
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert sorted(kept.select("doc_id").collect(), key=str) == sorted([(1,), (None,), (3,), (4,)], key=str)
    assert simhash.near_copies(frame(spark, [])).count() == 0 and simhash.keep_one(frame(spark, [])).count() == 0


def test_one_of_each_group_stays_with_repeated_and_null_ids(spark):
    draw = random.Random(5)
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(30)) for _ in range(25)]
    rows = [(draw.choice([None, *range(40)]), draw.choice(texts)) for _ in range(90)]
    prints = {t: simhash.fingerprint(t) for t in texts}
    group = {t: t for t in texts}
    for a in texts:
        for b in texts:
            if (prints[a] ^ prints[b]).bit_count() <= simhash.MAX_BITS:
                old, new = group[b], group[a]
                group = {t: new if g == old else g for t, g in group.items()}
    want = {}
    for i, t in rows:
        key = (i is None, i or 0)
        want[group[t]] = min(want.get(group[t], key), key)
    found = simhash.keep_one(frame(spark, rows)).select("doc_id", "text").collect()
    assert sorted((group[r.text], (r.doc_id is None, r.doc_id or 0)) for r in found) == sorted(want.items())


def test_links_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    points = set(base.tolist()) | {0, 2**64 - 1, 2**63}
    for x in base.tolist():
        for _ in range(30):
            bits = rng.choice(64, rng.integers(1, 5), replace=False)
            x2 = x
            for b in bits.tolist():
                x2 ^= 1 << b
            points.add(x2)
    points = sorted(points)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in points]
    edges = simhash.link(spark.createDataFrame(signed, "point bigint")).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in edges)
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {p[0]: p[0] for p in signed}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    flat = [p[0] for p in signed]
    for n, a in enumerate(flat):
        for b in flat[n + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {p: roots.get(p, p) for p in flat} == {p: find(p) for p in flat}


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    random.Random(1).shuffle(edges)
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_contamination(spark):
    passage = " ".join(f"item{i}" for i in range(20))
    items = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "too short"), (None, passage.upper()), (5, passage)], "item_id bigint, text string")
    rows = ROWS + [(10, f"before {passage} after"), (11, passage.replace("item3", "x").replace("item17 ", "")), (12, " ".join(passage.split()[:10])), (13, LONG + passage)]
    found = contamination.find_items(frame(spark, rows), items)
    hits = {r.doc_id: sorted([(h.item_id, h.distance, h.start_word, h.end_word) for h in r.hits], key=str) for r in found.collect() if r.hits}
    assert hits.keys() == {10, 11, 13}
    assert hits[10] == [(1, 0, 1, 21), (5, 0, 1, 21), (None, 0, 1, 21)]
    assert {h[1] for h in hits[11]} == {2} and hits[13][0][2] == 60_000
    clean = contamination.remove_leaks(frame(spark, rows), items)
    assert clean.columns == frame(spark, []).columns and clean.count() == len(rows) - 3
    assert contamination.remove_leaks(frame(spark, []), items).count() == 0
    assert contamination.remove_leaks(frame(spark, rows), items.limit(0)).count() == len(rows)


@pytest.mark.parametrize("seed", range(3))
def test_recall_at_the_largest_distance(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(10, 60))) for _ in range(50)]
    index = contamination.Index([(i, *contamination._item(t)) for i, t in enumerate(items)])
    texts, wanted = [], []
    for _ in range(200):
        i = rng.randrange(50)
        word = items[i].split()
        for _ in range(int(0.2 * len(word))):
            at = rng.randrange(len(word))
            word[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
        around = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        at = rng.randint(0, len(around))
        texts.append(" ".join(around[:at] + word + around[at:]))
        wanted.append(i)
    found = index.hits([contamination.word_hashes(t) for t in texts])
    recall = sum(any(h["item_id"] == i for h in hits) for hits, i in zip(found, wanted)) / len(wanted)
    assert recall > 0.95


def test_short_and_unspaced_items(spark):
    han = "".join(chr(0x4E00 + 37 * i) for i in range(60))
    item = han[:20] + "，" + han[20:40] + "，" + han[40:]
    items = spark.createDataFrame([(1, "What is Seven?"), (2, item), (3, "what"), (4, "..."), (5, "กขค งจ")], "item_id bigint, text string")
    rows = [(1, "so what is  seven, then what is seven"), (2, "x" + item + "y"), (3, "前" + item.replace(han[30], "")), (4, "whatever is seven"), (5, "seven what is"), (6, "ฮกขคงจฮ")]
    found = contamination.find_items(spark.createDataFrame(rows, "doc_id bigint, text string"), items).collect()
    hits = {r.doc_id: sorted((h.item_id, h.distance, h.start_word, h.end_word) for h in r.hits) for r in found}
    assert hits == {1: [(1, 0, 1, 4), (3, 0, 1, 2)], 2: [(2, 0, 1, 61)], 3: [(2, 1, 1, 60)], 4: [], 5: [(3, 0, 1, 2)], 6: [(5, 0, 1, 6)]}


@pytest.mark.parametrize("longest", [True, False])
def test_recall_with_edits_on_the_longest_words_or_in_front(longest):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(10, 60))] for _ in range(200)]
    index = contamination.Index([(i, *contamination._item(" ".join(w))) for i, w in enumerate(items)])
    texts = []
    for word in items:
        places = sorted(range(len(word)), key=lambda j: -len(word[j])) if longest else rng.sample(range(2 * len(word) // 3), len(word) // 5)
        edited = set(places[: len(word) // 5])
        texts.append("a b c " + " ".join(f"new{j}" if j in edited else w for j, w in enumerate(word)) + " d e f")
    found = index.hits([contamination.word_hashes(t) for t in texts])
    assert sum(any(h["item_id"] == i for h in hits) for i, hits in enumerate(found)) > 0.95 * len(items)


def test_language(spark):
    texts = {"aa": "kala mala tala sala", "bb": "xyrtz qwrtp zxcvb mnbvc"}
    train = spark.createDataFrame([(f"{t} {i}", k) for k, t in texts.items() for i in range(30)] + [(None, "aa"), ("", "bb"), ("kala", None)], "text string, lang string")
    model = language.fit(train)
    rows = [(1, "mala kala"), (2, "qwrtp mnbvc"), (3, None), (4, ""), (5, "123 ..."), (6, "mala kala " * 50_000), (6, "mala kala")]
    found = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in language.predict(frame(spark, rows), model).collect()}
    assert (found[1][0], found[2][0], found[6][0]) == ("aa", "bb", "aa")
    assert found[3] == found[4] == found[5] == ("und", 0.0, True)
    assert language.predict(frame(spark, []), model).count() == 0
    empty = language.fit(train.limit(0))
    assert language.predict(frame(spark, [(1, "kala")]), empty).first().lang_pred == "und"


def test_letters_beyond_the_first_plane():
    assert language.counts("\U0001f600\U0001f680 12 \U0001f600") is None
    upper, lower = "\U00010400\U00010401", "\U00010428\U00010429"
    assert (language.counts(upper + " \U0001f600 a") == language.counts(lower + " a")).all()


def test_emoji_are_no_language(spark):
    model = language.fit(spark.createDataFrame([("kala mala tala sala", "aa")] * 5, "text string, lang string"))
    df = spark.createDataFrame([("\U0001f600\U0001f680 12",)], "text string")
    assert language.predict(df, model).first().lang_pred == "und"


def test_far_texts_are_rejected(spark):
    train = spark.createDataFrame([("kala mala tala sala " * 20, "aa")] * 20, "text string, lang string")
    df = spark.createDataFrame([("漢字仮名交文章",), ("kala sala tala " * 20,)], "text string")
    assert [r.rejected for r in language.predict(df, language.fit(train)).collect()] == [True, False]


def test_the_sample_is_of_different_texts_however_rows_are_dealt(spark):
    rows = [(f"kala {i}", "aa") for i in range(50)] + [("kala 7", "aa")] * 500 + [(f"xyr {i}", "bb") for i in range(5)]
    df = spark.createDataFrame(rows, "text string, lang string")
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").distinct().collect()}
    wanted = {(k, h) for k in ("aa", "bb") for h in sorted(hashes[t] for t in {t for t, lang in rows if lang == k})[:20]}
    for parts in (1, 90):
        drawn = language._drawn(df.repartition(parts), 20).collect()
        assert sorted((r.lang, r.hash) for r in drawn) == sorted(wanted)
        assert all(len(r.cells) == language.DIMENSIONS for r in drawn)


def test_counting_in_blocks_changes_nothing(monkeypatch):
    text = "Ab c—dé 12 fgh" * 50
    whole = language.counts(text)
    monkeypatch.setattr(language, "BLOCK", 7)
    assert (language.counts(text) == whole).all()


def test_tokens(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    odd = ["<|endoftext|>a<|startoftext|><|endoftext|>", "it's WE'LL 'd", "naïve Å 漢字 ½²", "é \x1c\x85\xa0 İß", "<|ENDOFTEXT|>", "a" * 5000, "!!!'s?", "12 345\t\n  x"]
    rows = ROWS + [(100 + i, t) for i, t in enumerate(odd)]
    found = tokens.count_tokens(frame(spark, rows), tokenizer_path(), listed=3).collect()
    assert len(found) == len(rows)
    wanted = sorted((d or 0, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for d, t in rows)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in found) == wanted
    assert tokens.count_tokens(frame(spark, []), tokenizer_path()).count() == 0


def test_chat(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, window int, pos int"
    rows = [(1, i, "system" if i == 0 else ("user", "assistant")[i % 2 == 0], f"text {i} " + "w " * (i * 7 % 50), 1, 1) for i in range(300)]
    rows += [(2, 0, None, None, 1, 1), (2, 0, "assistant", "<s>[x]\\</s>", 1, 1), (None, 0, "user", "n", 1, 1), (None, 0, "user", "n", 1, 1)]
    rows += [(3, 1, "assistant", "long " * 3000, 1, 1), (3, 2, "assistant", "", 1, 1), (4, None, "user", "no turn", 1, 1)]
    made = chat.windows(spark.createDataFrame(rows, schema), budget=300, history=60).orderBy("conv_id", "first_pos").collect()
    turns = {}
    for w in made:
        assert w.n_tokens <= 300 or (w.over_budget and w.n_new == 1)
        parsed = chat.parse(w.formatted)
        assert len(parsed) == w.n_repeated + w.n_new
        turns.setdefault(w.conv_id, []).extend(parsed[w.n_repeated :])
        if w.conv_id == 1 and w.first_pos > 0:
            assert parsed[0][0] == "system" and w.n_repeated > 1
        targets = [chat.unescape(w.formatted[s.start : s.end]) for s in w.loss]
        assert targets == [t for r, t in parsed[w.n_repeated :] if r == "assistant"]
    assert turns[1] == [(r[2], r[3]) for r in rows[:300]]
    assert sorted(turns[2]) == [("", ""), ("assistant", "<s>[x]\\</s>")]
    assert turns[None] == [("user", "n")] * 2 and len(turns[3]) == 2 and turns[4] == [("user", "no turn")]
    assert chat.windows(spark.createDataFrame([], schema)).count() == 0


def test_prefix_sums_across_parts(spark):
    rows = [(1, i, "user", "w " * (i % 9)) for i in range(2000)] + [(2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("tokens", (F.col("turn") % 9 + 1).cast("bigint"))
    found = {r.turn: (r.start, r.pos) for r in chat._prefix_sums(df).filter("conv_id = 1").collect()}
    total = 0
    for i in range(2000):
        assert found[i] == (total, i)
        total += i % 9 + 1


def test_mixing(spark):
    found = mixing.mix(frame(spark, ROWS), mixing.text_words(F.col("text")))
    assert found.count() == len(ROWS) and {"doc_id", "text", "taken", "row"} <= set(found.columns)
    assert all(r.taken == 0 for r in found.filter("text IS NULL").collect())
    assert mixing.mix(frame(spark, []), mixing.text_words(F.col("text"))).count() == 0


def test_reduction_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rows = [(i, "big" if i % 3 else ("small" if i % 2 else None), i % 40 + 1) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n bigint")
    found = mixing.mix(df, F.col("n"), payload=("doc_id", "n")).collect()
    assert sorted(r.doc_id for r in found) == list(range(6000))
    of = {i: s for i, s, _ in rows}
    for source in ("big", "small", None):
        mine = [r for r in found if of[r.doc_id] == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 40
        assert {r.copies for r in mine} <= {0, 1, 2}


def test_pivot_keeps_words_and_expectation():
    rng = random.Random(5)
    for _ in range(200):
        a, b = (rng.random(), rng.randint(1, 50), "a"), (rng.random(), rng.randint(1, 50), "b")
        mean = 0.0
        for k in range(400):
            done, rest = mixing.pivot(a, b, (k + 0.5) / 400)
            assert done[0] in (0, 1) and done[0] * done[1] + rest[0] * rest[1] == pytest.approx(a[0] * a[1] + b[0] * b[1])
            mean += (done if done[2] == "a" else rest)[0] / 400
        assert mean == pytest.approx(a[0], abs=0.01)


def test_licenses(spark):
    mit = "Released under the MIT License."
    schema = "doc_id bigint, path string, text string, license string, sections string"
    rows = [(1, "r/LICENSE", mit), (2, "r/a/b/c.py", "# x\n# Licensed under the Apache License, Version 2.0.\ncode"), (3, "r/a/b/d.py", None), (4, "q/x.py", ""), (5, None, mit),
            (6, "r/a/LICENSE.txt", "no licence at all"), (7, "r/a/b/d.py", "x " * 100_000), (7, "r/a/b/d.py", "x " * 100_000), (8, "top.py", "")]
    found = licenses.scan_licenses(spark.createDataFrame([(*r, "old", "old") for r in rows], schema)).collect()
    by = {r.doc_id: (r.own_license, r.license, r.inherited_from) for r in found}
    assert len(found) == len(rows)
    assert by[1] == ("MIT", "MIT", None) and by[2] == ("Apache-2.0", "Apache-2.0", None) and by[5] == ("MIT", "MIT", None)
    assert by[3] == by[7] == by[6] == (None, "MIT", "r") and by[4] == by[8] == (None, None, None)
    assert licenses.scan_licenses(spark.createDataFrame([], schema)).count() == 0


def test_more_licenses(spark):
    mit = dict(licenses.whole_texts())["MIT"].upper()
    notices = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "// This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.": "CC-BY-NC-SA-3.0",
        "Licensed under CC BY 4.0": "CC-BY-4.0",
        "/* SPDX-License-Identifier: Apache-2.0  OR (MIT AND EUPL-1.2) */": "Apache-2.0 OR (MIT AND EUPL-1.2)",
        "# (SPDX-License-Identifier: Zlib).": "Zlib",
        "SPDX-License-Identifier: NONE": None,
        "version 4.0 by someone": None,
    }
    rows = [(f"a{i}/x.py", f"code\n{t}\nmore code") for i, t in enumerate(notices)]
    texts = licenses.whole_texts()
    rows += [(f"w{i}/LICENSE", "Copyright (c) 2020 Some One\n\n" + t) for i, (_, t) in enumerate(texts)]
    rows += [("m/COPYING", "Copyright (c) 2020 Some One\n" + "\n".join(mit.split(" "))), ("m/x.py", "\n".join(mit.split(" ")))]
    found = {r.path: r.own_license for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [found[f"a{i}/x.py"] for i in range(len(notices))] == list(notices.values())
    assert [found[f"w{i}/LICENSE"] for i in range(len(texts))] == [name for name, _ in texts]
    assert (found["m/COPYING"], found["m/x.py"]) == ("MIT", None)


def test_prefix_filter_loses_nothing():
    rng = random.Random(2)
    for _ in range(100):
        terms = {f"t{i}": rng.random() + 0.1 for i in range(12)}
        anchors = licenses._anchors(terms, 0.6)
        rest = sum(w * w for t, w in terms.items() if t not in anchors) ** 0.5
        assert rest < 0.6 * sum(w * w for w in terms.values()) ** 0.5


def test_warc(spark):
    long = "é" * 200
    schema = "page_id bigint, url string, html string, digest string, record string, copies int"
    rows = [(3, "http://b.example.com/x", long), (2, "https://a.example.com/?q=1", long), (None, None, long), (4, "http://x\r\ny", None), (5, "http://b.example.com/x", ""),
            (6, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + "x" * 100), (7, "u", "s" * 99), (8, "u", "s" * 99)]
    index = warc.archive_and_index(spark.createDataFrame([(*r, "d", "r", 1) for r in rows], schema)).collect()
    by = {r.page_id: r for r in index}
    assert len(index) == len(rows)
    assert (by[2].record_type, by[3].record_type, by[3].refers_to, by[None].refers_to) == ("response", "revisit", 2, 2)
    assert by[4].record_type == by[5].record_type == by[7].record_type == by[8].record_type == "response"
    for d, _, html in rows:
        assert by[d].payload_digest == hashlib.sha256((html or "").encode()).hexdigest() and by[d].payload_bytes == len((html or "").encode())
    keys = [(r.url_key, r.captured) for r in index]
    assert keys == sorted(keys)
    assert warc.archive_and_index(spark.createDataFrame([], schema)).count() == 0


def test_loser_tree():
    rng = random.Random(4)
    for k in range(1, 9):
        runs = [sorted((rng.randint(0, 30), n) for n in range(rng.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([])) == []
