"""Token counts of whole texts without their token ids.

A tokenizer that cuts a text into pre-tokens encodes each pre-token by itself, so a text has as many tokens as
its pre-tokens have pieces. The different pre-tokens of all texts are encoded once each. The LISTED most
frequent ones (short ones only, so the list has a size bound) go to every task and are
summed while a text is cut; the others are joined by their string and summed per text. So the hot
keys never meet in a join, and only rare pre-tokens are shuffled.

A null text counts as empty: no tokens. Repeated rows are counted each by itself.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colwright.columns import col, require
from colwright.llm.text import whole
from colwright.sources.shared import kept

LISTED = 200_000
LISTED_CHARS = 32
# Different pre-tokens that a task gathers before it hands them on.
GATHERED = 200_000
ENCODED = 4096
# Characters whose classes, case and normal form no library sees differently; other texts take the tokenizer's own cutter.
PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e¡-¬®-įı-ňŊ-ſ–—‘-„…€]")


def _plain_pattern(normalizer: dict | None, pattern: str) -> re.Pattern | None:
    """The pattern with the classes of letters and numbers spelled out, for texts of plain characters.

    These are their own normal forms, and white space only separates. None if the file normalizes or cuts in other ways.
    """
    steps = [s["type"] if s["type"] != "Replace" else (s["pattern"], s["content"]) for s in (normalizer or {}).get("normalizers", [])]
    if steps != ["NFC", ({"Regex": r"\s+"}, " "), "Lowercase"]:
        return None
    plain = [chr(c) for c in range(0x2100) if not PLAIN.search(chr(c))]
    for name in "LN":
        pattern = pattern.replace(rf"\p{{{name}}}", "".join(c for c in plain if unicodedata.category(c)[0] == name))
    return None if r"\p" in pattern.lower() else re.compile(pattern)


class Cutter:
    """Cuts texts into pre-tokens as the tokenizer file says. Made once per Python worker and file."""

    made: dict[str, Cutter] = {}

    @classmethod
    def of(cls, path: str) -> Cutter:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        added = parts["added_tokens"]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("special strings must be taken from the text as it is")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        steps = parts["pre_tokenizer"]["pretokenizers"]
        split, rest = steps[0], steps[1:]
        if split["type"] != "Split" or not split["invert"] or split["behavior"] != "Removed":
            raise ValueError("the tokenizer does not cut texts by one pattern")
        if [s["type"] for s in rest] != ["ByteLevel"] or rest[0]["use_regex"] or rest[0]["add_prefix_space"]:
            raise ValueError("the tokenizer cuts pre-tokens again")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.plain = _plain_pattern(parts["normalizer"], split["pattern"]["Regex"])

    def cut(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, in normal form, and the number of special strings."""
        if not self.special or not self.special.search(text):
            return self._cut(text), 0
        parts = self.special.split(text)
        return [x for part in parts for x in self._cut(part)], len(parts) - 1

    def _cut(self, text: str) -> list[str]:
        if self.is_plain(text):
            return self.plain.findall(text.lower())
        normal = self.tokenizer.normalizer.normalize_str(text)
        if not PLAIN.search(text):
            return self.pattern.findall(normal)
        from tokenizers import pre_tokenizers

        if not hasattr(self, "splitter"):
            from tokenizers import Regex

            self.splitter = pre_tokenizers.Split(Regex(self.pattern.pattern), "removed", invert=True)
        return [x for x, _ in self.splitter.pre_tokenize_str(normal)]

    def is_plain(self, text: str) -> bool:
        """Whether the text's pre-tokens are what `plain` finds in it in lower case: none of them holds white space."""
        return self.plain is not None and not PLAIN.search(text)

    def pieces(self, tokens: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(tokens, add_special_tokens=False)]


def _gather(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = Cutter.of(path), Counter()

        def gathered() -> pa.RecordBatch:
            columns = pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())
            seen.clear()
            return pa.RecordBatch.from_arrays(list(columns), ["token", "n"])

        for batch in batches:
            for text in batch.column("text"):
                seen.update(cutter.cut(text.as_py())[0])
                if len(seen) >= GATHERED:
                    yield gathered()
        yield gathered()

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter.of(path)
        for batch in batches:
            for i in range(0, batch.num_rows, ENCODED):
                part = batch.slice(i, ENCODED)
                found = pa.array(cutter.pieces(part.column("token").to_pylist()), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("token"), part.column("n"), found], ["token", "n", "pieces"])

    return run


def pieces(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """token, n, pieces: every different pre-token, its frequency in all texts and its number of tokens."""
    cut = df.select(whole(text).alias("text")).mapInArrow(_gather(path), "token string, n bigint")
    return cut.groupBy("token").agg(F.sum("n").alias("n")).mapInArrow(_encode(path), "token string, n bigint, pieces int")


def _count(path: str, listed: dict[str, int]):
    @F.pandas_udf("known bigint, rare array<struct<token:string,n:bigint>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        cutter, known, rare = Cutter.of(path), [], []
        for text in texts:
            tokens, n = cutter.cut(text)
            rest: Counter = Counter()
            for token in tokens:
                k = listed.get(token)
                if k is None:
                    rest[token] += 1
                else:
                    n += k
            known.append(n)
            rare.append([{"token": t, "n": c} for t, c in rest.items()])
        return pd.DataFrame({"known": known, "rare": rare})

    return of.asNondeterministic()  # so that no plan runs it twice


def count_tokens(df: DataFrame, path: str, text: str = "text", listed: int = LISTED) -> DataFrame:
    """The rows, without their text, with n_bytes (UTF-8) and n_tokens appended, as bigint.

    `path` is a tokenizer file that every machine has. The new columns replace columns of their names.
    """
    require(df, text)
    table = kept(pieces(df, path, text), "pieces")
    short = table.filter(F.length("token") <= LISTED_CHARS).orderBy(F.desc("n"), "token").limit(listed)
    known = {r["token"]: r["pieces"] for r in short.select("token", "pieces").toLocalIterator()}
    own = [c for c in df.columns if c != text and c.lower() not in ("n_bytes", "n_tokens")]
    rows = kept(
        df.select(
            F.monotonically_increasing_id().alias("at"),
            F.struct(*[col(c) for c in own], F.octet_length(whole(text)).cast("bigint").alias("n_bytes")).alias("row"),
            _count(path, known)(whole(text)).alias("found"),
        ).select("at", "row", "found.known", "found.rare"),
        "token-rows",
    )
    rest = rows.select("at", F.explode("rare").alias("r")).select("at", "r.token", "r.n")
    sums = rest.join(table.select("token", "pieces"), "token").groupBy("at").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    both = rows.select("at", "row", "known").join(sums, "at", "left")
    return both.select("row.*", (F.col("known") + F.coalesce("more", F.lit(0))).cast("bigint").alias("n_tokens"))
