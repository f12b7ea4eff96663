"""The registered queries on the small tables: against their SQL, or against brute force in plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

import __spark_entry__ as contract
from colwright.llm import queries, secrets, simhash
from tests.oracle import database, differences

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.fixture(scope="module")
def docs():
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{FOLDER}/documents.parquet'").fetchall()
    return {r[0]: r[1:] for r in rows}


def run(spark, key):
    return contract.queries()[key](spark, FOLDER)


def test_all_are_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in queries.QUERIES}
    assert "pipeline" in contract.queries()


@pytest.mark.parametrize("key", sorted(queries.SQL))
def test_sql(spark, con, key):
    assert differences(run(spark, key), con, queries.SQL[key]) == []


def test_op1_finds_every_notice(spark, docs):
    """A document has a licence of its own if and only if a line of it is a notice."""
    notices = {
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    }
    rows = run(spark, "op1_licenses").collect()
    assert len(rows) == len(docs)
    own = {}
    for r in rows:
        lines = docs[r.doc_id][0].split("\n")
        if wanted := [name for line, name in notices.items() if line in lines]:
            assert r.own_license in wanted and r.own_score == 1.0
        own[r.doc_id] = r
    found = [r for r in rows if r.own_license]
    assert len(found) > 20
    assert all(re.search("(?i)licen[sc]e", docs[r.doc_id][0]) for r in found)
    # Inheritance: the longest directory above with a licence file that has a licence.
    givers = defaultdict(list)
    for r in found:
        folder, _, name = r.path.rpartition("/")
        if name.startswith("LICENSE"):
            givers[folder].append((-r.own_score, r.own_license))
    for r in rows:
        folder, wanted = r.path.rpartition("/")[0], None
        parts = folder.split("/")
        for n in range(len(parts), -1, -1):
            above = "/".join(parts[:n])
            if above in givers:
                wanted = (min(givers[above])[1], above)
                break
        if not r.own_license:
            assert (r.license, r.inherited_from) == (wanted or (None, None))


def test_op1_finds_the_noncommercial_notice(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op1_licenses").collect()}
    wanted = [d for d, row in docs.items() if "Licensed under CC BY-NC 4.0." in row[0].split("\n")]
    assert wanted
    for d in wanted:
        assert rows[d].own_license and rows[d].own_score == 1.0
    assert any(rows[d].own_license == "CC-BY-NC-4.0" for d in wanted)


def test_op2_reads_back(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{FOLDER}/conversations.parquet' ORDER BY 1, 2").fetchall()
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    turns = defaultdict(list)
    for c, _, role, text in rows:
        turns[c].append((role, text or ""))
    found = {r.conv_id: r for r in run(spark, "op2_chat").collect()}
    assert found.keys() == turns.keys()
    for c, each in turns.items():
        loss = "".join(t for r, t in each if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in each)
        r = found[c]
        assert (r.n_turns, r.turns_sha256) == (len(each), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars > len(whole)


def test_op3_finds_every_exact_passage(spark, docs):
    items = duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    rows = run(spark, "op3_decontamination").collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert len(found) == len(rows)
    exact = {(d, i) for d, row in docs.items() for i, text in items if text in row[0]}
    assert exact <= found
    words = {i: set(re.findall(r"\w+", t.lower())) for i, t in items}
    for d, i in found:
        inside = set(re.findall(r"\w+", docs[d][0].lower()))
        assert len(words[i] & inside) >= 0.7 * len(words[i])


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id per id, from (id, fingerprint), by comparing everything."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(prints):
        for j, b in prints[n + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in prints}


def test_op4_matches_brute_force(spark, docs):
    prints = [(d, brute_fingerprint(row[0])) for d, row in sorted(docs.items())]
    wanted = brute_components(prints)
    rows = run(spark, "op4_simhash").collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{p:016x}" for d, p in prints}
    assert {r.doc_id: r.component_id for r in rows} == wanted


def test_op5_is_accurate_on_held_out_texts(spark, docs):
    rows = run(spark, "op5_language").collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in docs if zlib.crc32(str(d).encode()) % 5 == 0}
    right = sum(r.lang_pred == docs[r.doc_id][1] for r in held)
    assert right / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_op6_counts_as_the_library(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = run(spark, "op6_token_counts").collect()
    assert len(rows) == len(docs)
    ids = [r.doc_id for r in rows]
    wanted = [len(e) for e in tokenizer.encode_batch([docs[d][0] for d in ids], add_special_tokens=False)]
    assert [r.n_tokens for r in rows] == wanted
    assert all(r.n_bytes == len(docs[r.doc_id][0].encode()) and r.over_limit == (r.n_tokens > 2048) for r in rows)


def brute_base(text):
    spans = []
    keyword = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    for m in re.finditer(keyword + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 12:
            spans.append((m.start(), 0, "assign", m.end()))
    for rank, kind, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 18), (2, "hex", "[0-9a-f]+", 16)):
        spans += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(spans)


def test_op7_matches_brute_force(spark, docs):
    rows = run(spark, "op7_secrets").collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute_base(docs[r.doc_id][0])
        listed = ",".join(f"{k}:{s}:{e}" for s, _, k, e in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        n = Counter(k for _, _, k, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))


def test_op9_meets_its_targets(spark, docs):
    rows = run(spark, "op9_mixing").collect()
    again = run(spark, "op9_mixing").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", row[0])) for d, row in docs.items()}
    assert {r.doc_id: r.size for r in rows} == sizes
    total = Counter()
    for d, row in docs.items():
        total[row[2]] += sizes[d]
    names = sorted(total)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    share, full = 1.5 * sum(total.values()), set()
    while True:
        left = share - sum(2 * total[s] for s in full)
        level = left / sum(weight[s] for s in names if s not in full)
        above = {s for s in names if s not in full and weight[s] * level > 2 * total[s]}
        if not above:
            break
        full |= above
    target = {s: 2.0 * total[s] if s in full else weight[s] * level for s in names}
    taken = Counter()
    for r in rows:
        source = docs[r.doc_id][2]
        assert r.source_size == total[source] and r.target == pytest.approx(target[source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 2 * max(sizes[d] for d, row in docs.items() if row[2] == s)


def test_pipeline_stages(spark, docs):
    """Each stage on what the one before kept, against brute force or the planted cases."""
    import corpus_pipeline

    kept, columns = spark.read.parquet(f"{FOLDER}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "mix_sources"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, FOLDER).collect(), stage(spark, kept, FOLDER).schema)
        after = {r.doc_id: r for r in kept.collect()}
        seen[name] = before, after
        assert kept.columns[:5] == columns and after.keys() <= before.keys() and after
    judged = {r.doc_id: r.kept for r in run(spark, "op8_quality").collect()}
    assert seen["quality_rules"][1].keys() == {d for d, k in judged.items() if k}
    before, after = seen["near_dedup"]
    roots = brute_components([(d, brute_fingerprint(r.text)) for d, r in sorted(before.items())])
    assert after.keys() == set(roots.values())
    before, after = seen["decontamination"]
    leaks = {r.doc_id for r in run(spark, "op3_decontamination").collect()}
    assert after.keys() == before.keys() - leaks
    before, after = seen["secret_scan"]
    assert after.keys() == before.keys()
    for d, r in after.items():
        if brute_base(before[d].text):
            assert secrets.PLACEHOLDER in r.text and r.n_chars == len(r.text)
            assert not brute_base(r.text)
        else:
            assert r == before[d]
    assert all(r.copies in (1, 2) for r in seen["mix_sources"][1].values())


def test_fingerprints_of_odd_texts():
    for text in ("", " \n", "a", "A b", "a\x0bb\x0cc", "É é É", "x " * 70_000, "ab" * 100_000, "one\x1ctwo three four"):
        assert simhash.fingerprint(text) == brute_fingerprint(text)
