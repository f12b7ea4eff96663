"""Language by nearest centroid over TF-IDF vectors of character n-grams.

Letters, lower-cased, with one blank between words, give n-grams of one to three characters, hashed into
DIMENSIONS cells. A vector holds (1 + log count) * idf per cell and has length one. Idf comes from all training texts;
each language's centroids from spherical k-means over a bounded sample of its different training texts (those with the
smallest hashes), in one task per language that reads their counts, not the texts. A text gets the language of the nearest centroid by cosine; one that is nearer to none than
the language's own training texts nearly all are is marked as rejected.

Null, empty and letterless texts are `und` with score 0 and rejected. Without training texts every text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colwright.columns import col, require
from colwright.llm.text import free_name, whole
from colwright.sources.shared import kept

DIMENSIONS = 4096
CENTROIDS = 4
# Different training texts per language that the clustering sees; idf counts all of them.
SAMPLE_PER_LANGUAGE = 400
# Tasks that the smallest hashes of all input partitions pass before one task sees a language's.
SPREAD = 64
REJECT_QUANTILE = 0.001
UNKNOWN = "und"
BLOCK = 1 << 18
ROWS = 256
CENTROIDS_AT_ONCE = 2048
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def _letter(c: int) -> int:
    """The lower case of the code point if it is a letter, else a blank."""
    s = chr(c)
    if not s.isalpha():
        return 32
    low = s.lower()
    return ord(low) if len(low) == 1 else c


def _letters() -> np.ndarray:
    """For each code point of the first plane its letter or a blank; those beyond are looked up as they come."""
    return np.array([_letter(c) for c in range(1 << 16)], np.uint32)


_TABLE: list[np.ndarray] = []


def _codes(text: str, after_blank: bool) -> np.ndarray:
    """The letters, with one blank for whatever stands between words."""
    if not _TABLE:
        _TABLE.append(_letters())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _TABLE[0][np.minimum(points, (1 << 16) - 1)]
    far = np.flatnonzero(points >= 1 << 16)
    if len(far):
        some, which = np.unique(points[far], return_inverse=True)
        codes[far] = np.array([_letter(int(c)) for c in some], np.uint32)[which]
    blank = codes == 32
    return codes[~(blank & np.r_[after_blank, blank[:-1]])]


def counts(text: str) -> np.ndarray | None:
    """How often each cell's n-grams occur in the whole text; None without letters. Works in blocks."""
    total, tail, seen = np.zeros(DIMENSIONS, np.int64), np.array([32], np.uint32), False
    for i in range(0, len(text), BLOCK):
        new = _codes(text[i : i + BLOCK], bool(tail[-1] == 32))
        if not len(new):
            continue
        seen |= bool((new != 32).any())
        codes = np.concatenate([tail, new])
        hashes = codes * _FACTORS[0]
        of = [hashes[len(tail) :]]
        for n in (1, 2):
            if len(codes) > n:
                hashes = (hashes[:-1] ^ (hashes[:-1] >> 15)) * _FACTORS[n] + codes[n:] * _FACTORS[0]
                of.append(hashes[max(0, len(tail) - n) :])
        for h in of:
            total += np.bincount((h ^ (h >> 16)) % DIMENSIONS, minlength=DIMENSIONS)
        tail = codes[-2:]
    return total if seen else None


def _vectors(cells: list[np.ndarray | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the texts with these counts, and which texts have letters."""
    found = np.zeros((len(cells), DIMENSIONS), np.float32)
    has = np.zeros(len(cells), bool)
    for i, n in enumerate(cells):
        if n is not None:
            at = np.flatnonzero(n)
            found[i, at] = (1 + np.log(n[at])) * idf[at]
            has[i] = True
    norm = np.linalg.norm(found, axis=1, keepdims=True)
    return found / np.where(norm > 0, norm, 1), has


@dataclass(frozen=True)
class Model:
    """Of each centroid its language, its direction and the cosine below which a text is rejected."""

    languages: list[str]
    centroids: np.ndarray
    limits: np.ndarray
    idf: np.ndarray


def _frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen, rows = np.zeros(DIMENSIONS, np.int64), 0
    for frame in frames:
        for text in frame["text"]:
            n = counts(text)
            if n is not None:
                seen += n > 0
                rows += 1
    yield pd.DataFrame({"cell": np.arange(-1, DIMENSIONS), "n": np.r_[rows, seen]})


def _cluster(idf: np.ndarray, k: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x, has = _vectors(list(frame.sort_values("hash")["cells"]), idf)
        x = x[has]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "limit": []})
        # Starts spread out: each next one is the text that is farthest from those before.
        starts = [0]
        near = x @ x[0]
        while len(starts) < min(k, len(x)):
            starts.append(int(near.argmin()))
            near = np.maximum(near, x @ x[starts[-1]])
        c = x[starts]
        for _ in range(20):
            own = (x @ c.T).argmax(axis=1)
            sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
            new = sums / np.linalg.norm(sums, axis=1, keepdims=True)
            if np.allclose(new, c):
                break
            c = new
        limit = float(np.quantile((x @ c.T).max(axis=1), REJECT_QUANTILE)) / 2
        return pd.DataFrame({"lang": pd.Series([key[0]] * len(c), dtype=object), "centroid": [v.tolist() for v in c], "limit": [limit] * len(c)})

    return run


def _lowest(k: int):
    """Over rows of (lang, deal, hash): the k smallest different hashes of each language in the partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple[int, np.ndarray]] = {}
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                deal, known = best.get(lang, (int(part["deal"].iloc[0]), np.empty(0, np.int64)))
                best[lang] = deal, np.unique(np.r_[known, part["hash"].to_numpy(np.int64)])[:k]
        for lang, (deal, hashes) in best.items():
            yield pd.DataFrame({"lang": lang, "deal": deal, "hash": hashes})

    return run


def _drawn(rows: DataFrame, sample: int) -> DataFrame:
    """lang, hash, cells of the `sample` different texts with the smallest hashes of each language.

    Every partition passes on `sample` hashes of a language, SPREAD tasks cut them down, and one task sees what those keep,
    so none reads more with more partitions but hashes. Copies are one text before texts are shuffled.
    """
    shape = "lang string, deal int, hash bigint"
    hashed = rows.select("lang", (F.spark_partition_id() % SPREAD).alias("deal"), F.xxhash64("text").alias("hash"))
    low = hashed.mapInPandas(_lowest(sample), shape).repartition("lang", "deal").mapInPandas(_lowest(sample), shape)
    low = low.repartition("lang").mapInPandas(_lowest(sample), shape)
    # One number per language; Spark joins the table by its size.
    limits = kept(low.groupBy("lang").agg(F.max("hash").alias("most")), "language-limits")

    @F.pandas_udf("array<bigint>")
    def cells(texts: pd.Series) -> pd.Series:
        return pd.Series([counts(t) for t in texts], dtype=object)

    near = rows.withColumn("hash", F.xxhash64("text")).join(limits, "lang").filter("hash <= most")
    different = near.groupBy("lang", "hash").agg(F.first("text").alias("text"))
    return different.select("lang", "hash", cells.asNondeterministic()("text").alias("cells"))


def fit(df: DataFrame, text: str = "text", lang: str = "lang", k: int = CENTROIDS, sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from the rows with a language. What comes to the driver, and goes to each task, is k vectors of 16 KB per language."""
    require(df, text, lang)
    rows = df.filter(col(lang).isNotNull()).select(whole(text).alias("text"), col(lang).alias("lang"))
    found = rows.select("text").mapInPandas(_frequencies, "cell int, n bigint").groupBy("cell").sum("n").collect()
    seen = dict(map(tuple, found))
    total = seen.get(-1, 0)
    idf = np.log((1 + total) / (1 + np.array([seen.get(i, 0) for i in range(DIMENSIONS)]))) + 1
    shape = "lang string, centroid array<float>, limit double"
    best = _drawn(rows, sample).groupBy("lang").applyInPandas(_cluster(idf, k), shape).orderBy("lang").collect()
    centroids = np.array([r["centroid"] for r in best], np.float32).reshape(len(best), DIMENSIONS)
    return Model([r["lang"] for r in best], centroids, np.array([r["limit"] for r in best]), idf)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append lang_pred, score (cosine, 0 to 1) and rejected. The new columns replace columns of these names."""
    require(df, text)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        parts = [_nearest(texts.iloc[i : i + ROWS].tolist(), model) for i in range(0, len(texts), ROWS)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang": [], "score": [], "rejected": []})

    made = free_name(df, "__lang")
    df = df.select(*[col(c) for c in df.columns if c.lower() not in ("lang_pred", "score", "rejected")], of.asNondeterministic()(whole(text)).alias(made))
    return df.withColumns({"lang_pred": F.col(f"{made}.lang"), "score": F.col(f"{made}.score"), "rejected": F.col(f"{made}.rejected")}).drop(made)


def _nearest(texts: list[str], model: Model) -> pd.DataFrame:
    x, has = _vectors([counts(t) for t in texts], model.idf)
    if not model.languages:
        has[:] = False
        at, best = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        limits, names = np.zeros(1), np.array([UNKNOWN], object)
    else:
        limits, names = model.limits, np.array(model.languages, object)
        at, best = np.zeros(len(x), np.int64), np.full(len(x), -np.inf, np.float32)
        # Some centroids at a time; the first of equal ones stays, and they are sorted by language.
        for i in range(0, len(model.centroids), CENTROIDS_AT_ONCE):
            cosine = x @ model.centroids[i : i + CENTROIDS_AT_ONCE].T
            near, value = cosine.argmax(axis=1), cosine.max(axis=1)
            at, best = np.where(value > best, near + i, at), np.maximum(value, best)
    score = np.clip(best, 0, 1).astype(float)
    return pd.DataFrame(
        {
            "lang": pd.Series(np.where(has, names[at], UNKNOWN), dtype=object),
            "score": np.where(has, score, 0.0),
            "rejected": ~has | (score < limits[at]),
        }
    )
