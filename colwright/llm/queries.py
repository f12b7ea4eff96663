"""The registered queries of the subpackage, on whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colwright.llm import chat, contamination, language, licenses, merkle, mixing, phrases, quality, records, secrets, simhash, tokens, warc
from colwright.sources.shared import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(build: Callable) -> Callable:
    QUERIES[build.__name__] = lambda spark, folder: build(lambda t: spark.read.parquet(f"{folder.rstrip('/')}/{t}.parquet"))
    return build


@query
def op1_licenses(table: Callable[[str], DataFrame]) -> DataFrame:
    """Documents as files: a repository per source, directories by id, one file in twenty a licence file."""
    docs = table("documents")
    doc_id = F.col("doc_id")
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(doc_id / 1000))
    name = F.when(doc_id % 20 == 7, F.concat(F.lit("LICENSE-"), doc_id)).otherwise(F.concat(doc_id, F.lit(".txt")))
    below = F.when(doc_id % 100 == 7, name).otherwise(F.concat_ws("/", F.floor(doc_id / 100) % 10, name))
    files = docs.select("doc_id", F.when(doc_id.isNotNull(), F.concat_ws("/", folder, below)).alias("path"), "text")
    return licenses.scan_licenses(files)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests per conversation, from windows in order; a conversation's text is never held together."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    here, state, done = object(), None, []

    def close() -> None:
        if state:
            done.append((here, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)
        done.clear()
        return batch

    for batch in batches:
        for w in batch.to_pylist():
            if w["conv_id"] != here:
                close()
                here, state = w["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = w["formatted"]
            for role, body in chat.parse(text)[w["n_repeated"] :]:
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
            for span in w["loss"]:
                target = chat.unescape(text[span["start"] : span["end"]])
                state[2] += len(target)
                state[3].update(target.encode())
            state[4] += len(text)
        yield flush()
    close()
    yield flush()


@query
def op2_chat(table: Callable[[str], DataFrame]) -> DataFrame:
    conversations = table("conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], conversations.schema)
    made = chat.windows(conversations.unionByName(extra))
    dealt = made.select("conv_id", "first_pos", "n_repeated", "formatted", "loss").repartition("conv_id")
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return dealt.sortWithinPartitions("conv_id", "first_pos").mapInArrow(_read_back, schema)


@query
def op3_decontamination(table: Callable[[str], DataFrame]) -> DataFrame:
    found = contamination.find_items(table("documents").select("doc_id", "text"), table("benchmark"))
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


@query
def op4_simhash(table: Callable[[str], DataFrame]) -> DataFrame:
    return simhash.near_copies(table("documents"))


@query
def op5_language(table: Callable[[str], DataFrame]) -> DataFrame:
    docs = table("documents").select("doc_id", "text", "lang")
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    model = language.fit(docs.filter(part != 0))
    found = language.predict(docs.select("doc_id", "text", (part == 0).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op6_token_counts(table: Callable[[str], DataFrame]) -> DataFrame:
    counted = tokens.count_tokens(table("documents").select("doc_id", "text"), tokenizer_path())
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op7_secrets(table: Callable[[str], DataFrame]) -> DataFrame:
    found = secrets.scan(table("documents").select("doc_id", "text"))

    def number(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(k) for k in ("assign", "access", "hex")],
        F.sha2(secrets.digest(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.digest(F.col("spans")).alias("spans"),
    )


@query
def op8_quality(table: Callable[[str], DataFrame]) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judge(table("documents").select("doc_id", "text")).select(*columns)


SQL["op8_quality"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1
), r AS (
  SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS k FROM again) GROUP BY rid
), m AS (
  SELECT doc_id, t, w, l, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= 3 * n_words
  AND 10 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) >= 6 * n_words
  AND word_chars BETWEEN 2 * n_words AND 20 * n_words
  AND 2 * ((length(t) - length(replace(t, '!!', ''))) // 2) <= n_words
  AND 2 * n_dup_lines <= len(l) AS kept
FROM b
"""


@query
def op9_mixing(table: Callable[[str], DataFrame]) -> DataFrame:
    docs = table("documents")
    mixed = mixing.mix(docs.select("doc_id", "source", "text"), mixing.text_words(F.col("text")), payload=("doc_id",))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_warc(table: Callable[[str], DataFrame]) -> DataFrame:
    pages = table("pages")
    # Pages have no time of capture: a second apart, by id.
    captured = (F.lit(1_704_067_200) + F.coalesce("page_id", F.lit(0))).cast("timestamp")
    index = warc.archive_and_index(pages, captured=captured)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op10_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""


END_ID = 2


@query
def op11_records(table: Callable[[str], DataFrame]) -> DataFrame:
    docs = table("documents")
    path = shared_path(docs.sparkSession, "records")
    records.write(docs, path, tokenizer_path(), END_ID)
    found = records.read(docs.sparkSession, path, with_ids=False)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query
def op12_phrases(table: Callable[[str], DataFrame]) -> DataFrame:
    return phrases.collocations(table("documents"))


SQL["op12_phrases"] = r"""
WITH p AS (
  SELECT row_number() OVER () AS pid, lang, w FROM (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
      SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents))
), g AS (
  SELECT lang, k, w[i:i + k - 1] AS words FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k))
), f AS (
  SELECT lang, k, words, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100
), n AS (
  SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang
), cuts AS (
  SELECT c.lang, c.k, c.words, c.a, n.n, j.j, l.a AS l, r.a AS r,
    (1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS score
  FROM f c JOIN n USING (lang) JOIN (SELECT unnest(range(1, 5)) AS j) j ON j.j < c.k
  JOIN f l ON l.lang = c.lang AND l.words = c.words[1:j.j]
  JOIN f r ON r.lang = c.lang AND r.words = c.words[j.j + 1:c.k]
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, j) = 1
), inner_ AS (
  SELECT DISTINCT lang, words[i:i + m - 1] AS words, a FROM (
    SELECT lang, k, words, a, m, unnest(range(1, k - m + 2)) AS i FROM f, (SELECT unnest(range(2, 5)) AS m) WHERE m < k)
), kept AS (
  SELECT b.*, array_to_string(b.words, ' ') AS phrase FROM best b
  WHERE NOT EXISTS (SELECT 1 FROM inner_ x WHERE x.lang = b.lang AND x.words = b.words AND 100 * x.a >= 100 * b.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
  CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""


@query
def op13_manifest(table: Callable[[str], DataFrame]) -> DataFrame:
    def leaf(text):
        return merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(lowered)).otherwise(leaf(F.col("text")))
    made = merkle.manifest(table("documents"), leaf(F.col("text")), "doc_id", "lang", {"doc_id": F.col("doc_id"), "now": tampered})
    folded = merkle.fold(F.col("now"), F.col("proof"))
    proved = made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL["op13_manifest"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-')
      || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
      || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS t,
    coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low,
    -- The remainder of the crc32 of the decimal id.
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295) AS crc
  FROM documents
), l AS (
  SELECT *, sha256(head || t) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256(head || low) ELSE sha256(head || t) END AS now,
    coalesce('=' || lang, '-') AS grp FROM d
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM l
), low_nodes AS (
  SELECT grp, 0 AS level, i, n, leaf AS digest FROM placed
  UNION ALL
  SELECT grp, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM low_nodes WHERE n > 1
  GROUP BY grp, level, i // 8, n
), subroots AS (
  SELECT grp, digest AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS i, count(*) OVER () AS n FROM low_nodes WHERE n = 1
), high_nodes AS (
  SELECT 0 AS level, i, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM high_nodes WHERE n > 1 GROUP BY level, i // 8, n
), steps AS (
  SELECT rid, level AS step,
    coalesce(string_agg(digest, '' ORDER BY i) FILTER (WHERE i < own), '') AS l, coalesce(string_agg(digest, '' ORDER BY i) FILTER (WHERE i > own), '') AS r
  FROM (
    SELECT p.rid, t.level, t.i, t.digest, p.i // CAST(pow(8, t.level) AS BIGINT) AS own FROM placed p
    JOIN low_nodes t ON t.grp = p.grp AND t.n > 1 AND t.i // 8 = p.i // CAST(pow(8, t.level + 1) AS BIGINT)
    UNION ALL
    SELECT p.rid, 1000 + t.level, t.i, t.digest, s.i // CAST(pow(8, t.level) AS BIGINT) FROM placed p JOIN subroots s USING (grp)
    JOIN high_nodes t ON t.n > 1 AND t.i // 8 = s.i // CAST(pow(8, t.level + 1) AS BIGINT)
  ) GROUP BY rid, level, own
), proofs AS (
  SELECT rid, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM steps GROUP BY rid
), counted AS (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY step) AS k, l, r FROM steps
), folds AS (
  SELECT rid, 0 AS k, now AS digest FROM placed
  UNION ALL
  SELECT f.rid, f.k + 1, sha256(c.l || f.digest || c.r) FROM folds f JOIN counted c ON c.rid = f.rid AND c.k = f.k + 1
), ends AS (
  SELECT rid, arg_max(digest, k) AS folded FROM folds GROUP BY rid
), top AS (
  SELECT digest AS root FROM high_nodes WHERE n = 1
)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM placed JOIN subroots USING (grp) CROSS JOIN top LEFT JOIN proofs USING (rid) JOIN ends USING (rid)
"""
