"""Benchmark passages in texts: CGK embedding, bit-sampling LSH, exact edit distance.

Texts and items are sequences of word hashes. The CGK walk reads a sequence with a pointer that, at each step,
writes the word under it and moves on by a random bit that depends on the step and the word; sequences few edits
apart fall back into step, so their outputs differ in few places. Sampled places of the output are hashed
to a key, REPEATS times with new walks; a window of a text that shares a key with an item of
its size class is verified by the edit distance in words, which may be MAX_EDITS of the item's words.

Windows start at every pair of neighbouring words that some item has. An edit breaks two pairs at most, so a copy of n words
with k edits keeps n - 1 - 2k of them within n + k words: pairs that lie thinner are not walked, and candidates with fewer of the
item's pairs are not verified; both lose nothing. A copy is missed only if no key of any pair left agrees; tests measure the
recall at the largest distance that counts, with edits anywhere and on the longest words.

Items of fewer than MIN_WORDS words are too short for walks and are found exactly: where all their words stand in a row or,
if MAX_EDITS of their words is an edit, where one edit leaves either half of them intact and the rest fits. Each character of a script that is written
without spaces between words is a word. Items without words match nothing; so do null and empty ones. Null and empty texts have no
hits. Repeated items and texts are reported each by itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colwright.columns import col, require
from colwright.llm.text import whole

MIN_WORDS = 8
MAX_EDITS = 0.2
REPEATS = 16
SAMPLED = 2
# Size classes: outputs of a walk, and the words that an item needs behind its seed so that the walk stays inside.
CLASSES = ((4, 4), (8, 7), (16, 12), (32, 22), (64, 40))
GAP = 64  # filler between texts, as long as the longest walk
# Items whose index is held by a task at a time; more items take further passes over the text column.
BLOCK_WORDS = 100_000
CHUNK = 1 << 20
HIT = "array<struct<item_id:bigint,distance:int,start_word:bigint,end_word:bigint>>"
_TABLE: list[np.ndarray] = []


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64 random bits per word hash."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _folded() -> np.ndarray:
    """For each code point of the first plane its lower case if it is a letter or digit, else 0."""
    table = np.zeros(1 << 16, np.uint64)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalnum():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


# Scripts without spaces between words: Thai, Lao, Burmese, Tai, Khmer, kana, Han.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF),
            (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xAA80, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))


def _unspaced(points: np.ndarray) -> np.ndarray:
    alone = np.zeros(len(points), bool)
    if len(points) and points.max() >= UNSPACED[0][0]:
        for low, high in UNSPACED:
            alone |= (points >= low) & (points <= high)
    return alone


def _inside(c: str) -> bool:
    return c.isalnum() or ord(c) >= 1 << 16


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word (a run of letters and digits, in lower case, or a character of an unspaced script) of the whole text."""
    if not _TABLE:
        _TABLE.append(_folded())
    found, i = [], 0
    while i < len(text):
        j = min(len(text), i + CHUNK)
        while j < len(text) and _inside(text[j - 1]) and _inside(text[j]) and not _unspaced(np.array([ord(text[j])]))[0]:
            j += 1
        points = np.frombuffer(text[i:j].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(points < 1 << 16, _TABLE[0][np.minimum(points, (1 << 16) - 1)], points)
        within = codes > 0
        alone = within & _unspaced(points)
        begins = within & (alone | ~np.r_[False, within[:-1]] | np.r_[False, alone[:-1]])
        first = np.flatnonzero(begins[within])
        if len(first):
            sizes = np.diff(first, append=int(within.sum()))
            power = np.cumprod(np.full(int(sizes.max()), 0x100000001B3, np.uint64))
            place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            found.append(np.add.reduceat(codes[within] * power[place], first))
        i = j
    return _mix(np.concatenate(found), 1) if found else np.empty(0, np.uint64)


@cache
def _sampled() -> dict[int, np.ndarray]:
    """For each class the steps that a key holds, one row per repeat."""
    return {m: np.array([np.random.RandomState(r).choice(m - 1, SAMPLED, replace=False) + 1 for r in range(REPEATS)]) for m, _ in CLASSES}


def _walk(word: np.ndarray, starts: np.ndarray) -> dict[int, np.ndarray]:
    """For each class the keys of the windows at the starts, one row per repeat."""
    pos = np.repeat(starts[None, :], REPEATS, axis=0)
    seeds = np.arange(REPEATS, dtype=np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95)
    keys = {m: np.repeat(word[starts][None, :], REPEATS, axis=0) + seeds + np.uint64(m) for m, _ in CLASSES}
    taken = _sampled()
    for step in range(max(keys)):
        here = word[np.minimum(pos, len(word) - 1)]
        for m in keys:
            rows = np.flatnonzero((taken[m] == step).any(axis=1)) if step < m else ()
            if len(rows):
                keys[m][rows] = _mix(keys[m][rows] ^ here[rows], 3)
        pos = pos + ((_mix(here + seeds, 5) >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64)
    return keys


def _pairs(word: np.ndarray) -> np.ndarray:
    """A hash of each word with its next one."""
    return _mix(word, 7) + np.r_[word[1:], np.zeros(1, np.uint64)]


def _runs(word: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row."""
    size = max(0, len(word) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = _mix(out ^ word[k : k + size], 11)
    return out


def _least_pairs(n: int) -> int:
    """How many of its pairs an item of n words keeps in any copy that counts."""
    return n - 1 - 2 * int(MAX_EDITS * n)


def distance(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """The least edit distance of the item to a part of the window, and where the first such part ends."""
    n = np.arange(len(window) + 1)
    row = np.zeros(len(window) + 1, np.int64)
    for i, x in enumerate(item):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (window != x))
        new[0] = i + 1
        row = np.minimum.accumulate(new - n) + n
    end = int(row.argmin())
    return int(row[end]), end


class _Near:
    """Items of which a copy may have one edit. An edit leaves the first or the second half of an item's words as they are."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.items = items
        # Per length the items' words, and per half the sorted hashes with the items that have them.
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = {}
        for n in {len(w) for _, w in items}:
            no = np.array([i for i, (_, w) in enumerate(items) if len(w) == n])
            word = np.stack([items[i][1] for i in no])
            halves = []
            for part in (word[:, : n // 2], word[:, n // 2 :]):
                key = np.array([_runs(w, len(w))[0] for w in part])
                order = np.argsort(key, kind="stable")
                halves.append((key[order], order))
            self.by_size[n] = no, word, halves

    def hits(self, word: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text, item): distance, start and end in the text, for the least distance and then the first place."""
        padded = np.concatenate([np.zeros(GAP, np.uint64), word, np.zeros(GAP, np.uint64)])
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, (no, items, halves) in self.by_size.items():
            places, which = [], []
            for (key, owner), length, back in zip(halves, (n // 2, n - n // 2), ((0,), (n // 2 - 1, n // 2, n // 2 + 1))):
                runs = _runs(word, length)
                at = np.flatnonzero(np.isin(runs, key))
                low, high = np.searchsorted(key, runs[at], "left"), np.searchsorted(key, runs[at], "right")
                many = high - low
                rows = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                for b in back:
                    places.append(np.repeat(at, many) - b)
                    which.append(owner[rows])
            both = np.unique(np.stack([np.concatenate(places), np.concatenate(which)], axis=1), axis=0) if places else np.empty((0, 2), np.int64)
            for i in range(0, len(both), 1 << 16):
                place, item = both[i : i + (1 << 16)].T
                for distance_, size, good in self._fits(padded, place, items[item], n):
                    for p, k in zip(place[good].tolist(), no[item[good]].tolist()):
                        doc = int(np.searchsorted(first, p, "right")) - 1
                        new = (distance_, p - int(first[doc]), p - int(first[doc]) + size)
                        found[doc, k] = min(found.get((doc, k), new), new)
        return found

    @staticmethod
    def _fits(padded: np.ndarray, place: np.ndarray, items: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """Distance, words in the text, and which of the places fit: none, one word replaced, added or left out.

        Both ends must be words of a text; what fits beyond an end, fits within it with a word left out.
        """

        def agree(shift: int) -> np.ndarray:
            return padded[place[:, None] + GAP + shift + np.arange(n)] == items

        straight = agree(0)
        lead = np.cumprod(straight, axis=1).sum(axis=1)
        yield 0, n, lead == n
        for shift, need in ((0, n - 1), (1, n), (-1, n - 1)):
            tail = np.cumprod(agree(shift)[:, ::-1], axis=1).sum(axis=1)
            inside = (padded[place + GAP] != 0) & (padded[place + GAP + n + shift - 1] != 0)
            yield 1, n + shift, inside & (lead + tail >= need) & (lead < n)


class Index:
    """The keys of a block of items, for whole batches of texts."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.items = [(i, w) for i, w, *_ in items if len(w) >= MIN_WORDS]
        self.short = [(i, w) for i, w, *_ in items if 0 < len(w) < MIN_WORDS and MAX_EDITS * len(w) < 1]
        self.near = _Near([(i, w) for i, w, *_ in items if len(w) < MIN_WORDS and MAX_EDITS * len(w) >= 1])
        # Of each length the hashes of the short items, and which items have them.
        self.rows: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for no, (_, w) in enumerate(self.short):
            self.rows[len(w)][int(_runs(w, len(w))[0])].append(no)
        self.rows = {n: dict(of) for n, of in self.rows.items()}
        pairs = [_pairs(w)[:-1] for _, w in self.items]
        self.seeds = np.unique(np.concatenate([np.empty(0, np.uint64), *pairs]))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        # Lengths of items in steps of an eighth: the fewest pairs that a copy keeps, and the most words that it has.
        self.dense: dict[int, tuple[int, int]] = {}
        for n in {len(w) for _, w in self.items}:
            need, span = _least_pairs(n), n + int(MAX_EDITS * n)
            old = self.dense.get(step := int(8 * np.log2(n)), (need, span))
            self.dense[step] = min(need, old[0]), max(span, old[1])
        self.sizes = np.array([len(w) for _, w in self.items], np.int64)
        self.edits = (MAX_EDITS * self.sizes).astype(np.int64)
        # Which item has which pair, as one sorted column.
        rank = [no * len(self.seeds) + np.searchsorted(self.seeds, p) for no, p in enumerate(pairs)]
        self.has = np.unique(np.concatenate([np.empty(0, np.int64), *rank]))
        self.tables = self._entries()

    def _entries(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each class its sorted keys, with the item and the place in it where the walk started."""
        if not self.items:
            return {}
        word = np.concatenate([x for _, w in self.items for x in (w, np.zeros(GAP, np.uint64))])
        no = np.repeat(np.arange(len(self.items), dtype=np.int32), self.sizes - 1)
        offset = np.concatenate([np.arange(n - 1, dtype=np.int32) for n in self.sizes])
        first = np.cumsum(self.sizes + GAP) - self.sizes - GAP
        left = np.maximum(4, self.sizes[no] - offset)
        kind = np.searchsorted([need for _, need in CLASSES], left, "right") - 1
        found = defaultdict(list)
        for i in range(0, len(no), 1 << 14):
            part = slice(i, i + (1 << 14))
            keys = _walk(word, first[no[part]] + offset[part])
            for c in np.unique(kind[part]):
                at = np.flatnonzero(kind[part] == c)
                what = np.stack([no[part][at], offset[part][at]], axis=1)
                found[CLASSES[c][0]].append((keys[CLASSES[c][0]][:, at].ravel(), np.tile(what, (REPEATS, 1))))
        tables = {}
        for m, rows in found.items():
            key, what = map(np.concatenate, zip(*rows))
            order = np.argsort(key, kind="stable")
            tables[m] = key[order], what[order]
        return tables

    def starts(self, word: np.ndarray) -> np.ndarray:
        """The places of known pairs that lie as dense as in some copy."""
        pairs = _pairs(word)
        at = np.flatnonzero(self.maybe[(pairs & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = at[np.isin(pairs[at], self.seeds)] if len(at) else at
        keep = np.zeros(len(at), bool)
        for need, span in self.dense.values():
            if len(at) >= need:
                close = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < span)
                covered = np.bincount(close, minlength=len(at) + 1) - np.bincount(close + need, minlength=len(at) + 1)
                keep |= np.cumsum(covered)[: len(at)] > 0
        return at[keep]

    def candidates(self, word: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct (place of the item's first word, item) that share a key with a window."""
        found = [np.empty(0, np.int64)]
        count, before = len(self.items), int(self.sizes.max())
        step = 1 << 14
        for i in range(0, len(starts), step):
            at = starts[i : i + step]
            keys = _walk(word, at)
            for m, (known, what) in self.tables.items():
                low = np.searchsorted(known, keys[m], "left")
                n = np.searchsorted(known, keys[m], "right") - low
                hit = np.nonzero(n)
                if len(hit[0]):
                    many = n[hit]
                    rows = np.repeat(low[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    place = np.repeat(at[hit[1]], many) - what[rows, 1]
                    found.append(np.unique((place + before) * count + what[rows, 0]))
        both = np.unique(np.concatenate(found))
        return np.stack([both // count - before, both % count], axis=1)

    def likely(self, word: np.ndarray, starts: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The candidates around which the text has as many of the item's pairs as any copy."""
        keep = [found[:0]]
        rank = np.searchsorted(self.seeds, _pairs(word)[starts])
        for i in range(0, len(found), 1 << 16):
            place, no = found[i : i + (1 << 16)].T
            low = np.searchsorted(starts, place - self.edits[no])
            n = np.searchsorted(starts, place + self.sizes[no] + self.edits[no]) - low
            need = self.sizes[no] - 1 - 2 * self.edits[no]
            at = np.flatnonzero(n >= need)
            low, n, which = low[at], n[at], no[at]
            row = np.repeat(np.arange(len(at)), n)
            near = rank[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)]
            code = which[row] * len(self.seeds) + near
            hit = self.has[np.minimum(np.searchsorted(self.has, code), len(self.has) - 1)] == code
            at = at[np.bincount(row[hit], minlength=len(at)) >= need[at]]
            keep.append(found[i : i + (1 << 16)][at])
        return np.concatenate(keep)

    def _exact(self, word: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Text, short item and the first place of each short item in each text."""
        for n, of in self.rows.items():
            runs = _runs(word, n)
            at = np.flatnonzero(np.isin(runs, np.array(list(of), np.uint64)))
            docs = np.searchsorted(first, at, "right") - 1
            # A text may repeat an item often: only the first place of each is looked at.
            order = np.lexsort((at, runs[at], docs))
            at, docs = at[order], docs[order]
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(docs) != 0) | (runs[at][1:] != runs[at][:-1])
            for doc, place in zip(docs[new].tolist(), at[new].tolist()):
                for no in of[int(runs[place])]:
                    if np.array_equal(word[place : place + n], self.short[no][1]):
                        yield doc, no, place - int(first[doc])

    def hits(self, words: list[np.ndarray]) -> list[list[dict]]:
        """For each text the items that it holds, with the least distance and the words where it lies."""
        out: list[list[dict]] = [[] for _ in words]
        if not len(words):
            return out
        filler = np.zeros(GAP, np.uint64)
        word = np.concatenate([x for w in words for x in (w, filler)])
        first = np.cumsum([0] + [len(w) + GAP for w in words])
        for doc, no, at in self._exact(word, first):
            item_id, item = self.short[no]
            out[doc].append({"item_id": item_id, "distance": 0, "start_word": at, "end_word": at + len(item)})
        for (doc, no), (d, start, end) in sorted(self.near.hits(word, first).items()):
            out[doc].append({"item_id": self.near.items[no][0], "distance": d, "start_word": start, "end_word": end})
        if not self.items:
            return out
        starts = self.starts(word)
        found = self.likely(word, starts, self.candidates(word, starts))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        # The seed lies behind the first word, so a place before its text still belongs to it.
        docs = np.clip(np.searchsorted(first, found[:, 0] + self.sizes[found[:, 1]] // 2, "right") - 1, 0, len(words) - 1)
        # Places of an item that lie less than its length apart are verified together.
        around: dict[tuple[int, int, int], list[int]] = {}
        for doc, (place, no) in zip(docs.tolist(), found.tolist()):
            at = place - int(first[doc])
            ends = around.setdefault((doc, no, at // int(self.sizes[no])), [at, at])
            ends[0], ends[1] = min(ends[0], at), max(ends[1], at)
        for (doc, no, _), (least, most) in around.items():
            item, text = self.items[no][1], words[doc]
            n, edits = len(item), int(MAX_EDITS * len(item))
            old = best.get((doc, no))
            if old and old[0] == 0:
                continue
            low, high = max(0, least - edits), min(len(text), most + n + edits)
            if high - low < n - edits:
                continue
            d, end = distance(item, text[low:high])
            if d <= edits and (not old or d < old[0]):
                size = distance(item[::-1], text[low : low + end][::-1])[1]
                best[doc, no] = d, low + end - size, low + end
        for (doc, no), (d, start, end) in sorted(best.items()):
            out[doc].append({"item_id": self.items[no][0], "distance": d, "start_word": start, "end_word": end})
        return out


def _item(text: str) -> tuple[np.ndarray]:
    """What follows an item's id in an index: the words' hashes."""
    return (word_hashes(text),)


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Index]:
    """The items in blocks of bounded size; they pass through the driver a block at a time."""
    require(items, item_id, text)
    block, total = [], 0
    for row in items.select(col(item_id).alias("i"), whole(text).alias("t")).toLocalIterator():
        word = word_hashes(row["t"])
        if not len(word):
            continue
        block.append((row["i"], word))
        total += len(word)
        if total >= BLOCK_WORDS:
            yield Index(block)
            block, total = [], 0
    if block:
        yield Index(block)


def _search(index: Index):
    @F.pandas_udf(HIT)
    def of(texts: pd.Series) -> pd.Series:
        out: list[list[dict]] = []
        batch, total = [], 0
        for text in texts:
            batch.append(word_hashes(text))
            total += len(batch[-1]) + GAP
            if total >= CHUNK:
                out.extend(index.hits(batch))
                batch, total = [], 0
        out.extend(index.hits(batch))
        return pd.Series(out, dtype=object)

    return of.asNondeterministic()  # so that no plan runs it twice


def find_items(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Append hits, an array of (item_id, distance, start_word, end_word). It replaces a column of its name."""
    require(df, text)
    df = df.select(*[col(c) for c in df.columns if c.lower() != "hits"])
    found: list[Column] = [_search(index)(whole(text)) for index in indexes(items, item_id, item_text)]
    none = F.array().cast(HIT)
    if not found:
        return df.withColumn("hits", none)
    return df.withColumn("hits", F.concat(*found) if len(found) > 1 else found[0])


def remove_leaks(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that hold no item, with their own columns."""
    row = F.struct(*[col(c) for c in df.columns]).alias("row")
    found = find_items(df.select(row, whole(text).alias("text")), items, "text", item_id, item_text)
    return found.filter(F.size("hits") == 0).select("row.*")
