"""Benchmark decontamination: passages of benchmark items in documents, copied or nearly so.

Each window of a text that is as long as an item is held against the items of that length:

1. A window can only be alike enough if nearly all its words are words of the benchmark; a running
   count of other words leaves few windows. This bound is exact.
2. The windows left get a SimHash fingerprint: each word votes on 64 bits by its weight, from one
   running sum of votes.
3. Items stand in `radius + 1` tables, one for each block of bits. Two fingerprints within the radius
   agree in one block at least, so a window meets all items within the radius in these tables.
4. Candidates are verified by the exact similarity of their shingles of `n_words` words: what is in
   common over all of both has to be `least` or more, plain or weighted; the weighted one is given.
   A shingle weighs the more the fewer items hold it.

Items of the same words count once. Counts are over the whole benchmark: those of two or more, which
are what weights differ by, are shared by all blocks of it, so results don't depend on the blocks.

Words are runs of letters and digits in lower case, so marks around words hide no copy. The benchmark
goes to the executors `items_at_once` items or `BLOCK_BYTES` at a time, whatever its size; documents are only read
row by row, there is no shuffle of them. Long texts go by in parts that overlap by the longest item.

Defined results: null and empty texts match nothing, items without words match nothing; repeated
rows and items are all answered; of several windows of a text that match an item the best, and of
equals the first, is given; an empty benchmark or table gives no rows; other columns are left out,
or kept as they are by `clean`.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.rows import plain_words, utf8
from riskloom.llm.word_hashes import PLAIN, portions, word_hashes

BLOCK_BYTES = 4_000_000
#: Words of a portion whose votes are summed at a time.
VOTES_AT_ONCE = 100_000


@dataclass(frozen=True)
class Settings:
    n_words: int = 5
    least: float = 0.75
    radius: int = 18
    items_at_once: int = 20_000


class Items:
    """A block of items: word weights, fingerprints, tables and shingles."""

    def __init__(
        self, ids: list, texts: list[bytes], settings: Settings, counted: tuple | None = None
    ):
        """`counted`: how many distinct items there are, and how many hold a word or a shingle, for
        those that two or more hold; counted here if not given."""
        self.settings = settings
        words, offsets = word_hashes(texts, PLAIN)
        each = [words[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        same = defaultdict(list)
        for key, own in zip(ids, each):
            if len(own):
                same[own.tobytes()].append(key)
        #: Distinct items, and the ids of each.
        self.ids, self.words = list(same.values()), [np.frombuffer(w, np.uint64) for w in same]
        if counted is None:
            held, shingles = Counter(), Counter()
            for own in self.words:
                held.update(set(own.tolist()))
                shingles.update(set(shingles_of(own.tolist(), settings.n_words)))
            counted = len(self.words), held, shingles
        n, held, shingles = counted
        known = set(held).union(*(w.tolist() for w in self.words))
        self.vocabulary = np.array(sorted(known), np.uint64)
        rarity = [math.log((1 + n) / held.get(w, 1)) for w in self.vocabulary.tolist()]
        self.most = math.log(1 + n) if n else 1.0
        #: Votes are whole numbers, so a running sum is exact.
        self.votes = np.array([*rarity, self.most]) / self.most * 64
        self.votes = np.maximum(1, self.votes.round()).astype(np.int32)
        self.weight = {s: math.log((1 + n) / c) for s, c in shingles.items()}
        #: The least weight of a shingle, as a share of the greatest.
        self.least_share = min(self.weight.values(), default=self.most) / self.most
        self.sets = [Counter(self._shingles(w.tolist())) for w in self.words]
        self.by_size: dict[int, Tables] = {}
        sizes = defaultdict(list)
        for i, own in enumerate(self.words):
            sizes[len(own)].append(i)
        for size, rows in sizes.items():
            prints = np.concatenate(
                [window_prints(self.running_votes(self.words[i]), np.zeros(1, np.int64), size) for i in rows]
            )
            self.by_size[size] = Tables(np.array(rows), prints, settings.radius)
        self.sizes = sorted(self.by_size)

    def _shingles(self, words: list[int]) -> list[tuple]:
        return shingles_of(words, self.settings.n_words)

    def allowed(self, size: int) -> int:
        """How many words of a window of this size may be out of the vocabulary.

        Each such word spoils a shingle. With s of m spoiled, m - s are in common at most, and weigh 1
        at most; the spoiled ones weigh 1, as one item at most holds them, and as many of the item
        weigh `least_share` or more. A plain similarity is bound more closely.
        """
        m = max(1, size - self.settings.n_words + 1)
        least = self.settings.least
        return math.floor(m * (1 - least) / (1 + least * self.least_share) + 1e-9)

    def running_votes(self, words: np.ndarray) -> np.ndarray:
        """The votes on each bit of all words before each place."""
        place = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == words
        weight = self.votes[np.where(known, place, len(self.vocabulary))]
        bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
        total = np.zeros((len(words) + 1, 64), np.int32)
        np.multiply(bits.view(np.int8) * np.int8(2) - np.int8(1), weight[:, None], out=total[1:])
        return np.cumsum(total, 0, out=total)

    def similarity(self, words: np.ndarray, item: int) -> tuple[float, float]:
        """Weighted and plain."""
        window, own = Counter(self._shingles(words.tolist())), self.sets[item]
        both = union = 0.0
        plain_both = plain_union = 0
        for shingle in window.keys() | own.keys():
            weight = self.weight.get(shingle, self.most)
            a, b = window[shingle], own[shingle]
            both += weight * min(a, b)
            union += weight * max(a, b)
            plain_both += min(a, b)
            plain_union += max(a, b)
        return both / union if union else 1.0, plain_both / plain_union


def shingles_of(words: list[int], n: int) -> list[tuple]:
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]


def window_prints(votes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows of a size that begin at `starts`."""
    positive = votes[starts + size] - votes[starts] > 0
    return np.packbits(positive, axis=1).view("<u8").ravel()


class Tables:
    """Items of one length by each block of their fingerprints."""

    def __init__(self, rows: np.ndarray, prints: np.ndarray, radius: int):
        self.rows, self.prints, self.radius = rows, prints, radius
        edges = np.linspace(0, 64, min(radius + 1, 64) + 1).round().astype(int)
        self.blocks = []
        for a, b in zip(edges, edges[1:]):
            shift, mask = np.uint64(a), np.uint64((1 << int(b - a)) - 1)
            values = (prints >> shift) & mask
            order = np.argsort(values, kind="stable")
            self.blocks.append((shift, mask, values[order], order))

    def near(self, prints: np.ndarray) -> list[tuple[int, int]]:
        """Pairs (window, item) within the radius."""
        found = set()
        for shift, mask, values, order in self.blocks:
            own = (prints >> shift) & mask
            low, high = np.searchsorted(values, own), np.searchsorted(values, own, "right")
            windows = np.repeat(np.arange(len(own)), high - low)
            if not len(windows):
                continue
            first = np.cumsum(high - low) - (high - low)
            at = np.arange(len(windows)) - np.repeat(first - low, high - low)
            items = order[at]
            apart = np.bitwise_count(prints[windows] ^ self.prints[items])
            hit = apart <= self.radius
            found.update(zip(windows[hit].tolist(), self.rows[items[hit]].tolist()))
        return sorted(found)


def counted(items: DataFrame, text: str, settings: Settings) -> tuple[int, dict, dict]:
    """How many distinct items have words, and how many hold each word and each shingle, for those
    that two or more hold."""

    def plain(batches):
        for batch in batches:
            out = [b" ".join(plain_words(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["words"])

    def held(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in portions([len(t) for t in texts], BLOCK_BYTES // 8):
                hashes, offsets = word_hashes(texts[a:b], PLAIN)
                kinds, keys = [], []
                for x, y in zip(offsets[:-1], offsets[1:]):
                    own = hashes[x:y].tolist()
                    parts = {(0, (w,)) for w in own}
                    parts |= {(1, s) for s in shingles_of(own, settings.n_words)}
                    kinds += [-1, *(k for k, _ in parts)]
                    keys += [b"", *(np.array(s, "<u8").tobytes() for _, s in parts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds, pa.int32()), pa.array(keys, pa.binary())], ["kind", "key"]
                )

    distinct = items.select(utf8(text)).mapInArrow(plain, "words binary").distinct()
    rows = distinct.where(F.length("words") > 0).mapInArrow(held, "kind int, key binary")
    n, words, shingles = 0, {}, {}
    often = rows.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1 or kind = -1")
    for row in often.toLocalIterator():
        key = tuple(np.frombuffer(row["key"], "<u8").tolist())
        if row["kind"] == 1:
            shingles[key] = row["n"]
        elif row["kind"] == 0:
            words[key[0]] = row["n"]
        else:
            n = row["n"]
    return n, words, shingles


def _load(items: DataFrame, key: str, text: str, settings: Settings) -> Iterator[tuple[list, list]]:
    """The benchmark in blocks; each is broadcast on its own, and the driver holds one at a time."""
    rows = items.select(F.col(key).alias("id"), utf8(text).alias("text")).orderBy("id", "text")
    current, size = ([], []), 0
    for row in rows.toLocalIterator():
        current[0].append(row["id"])
        current[1].append(bytes(row["text"]))
        size += len(current[1][-1])
        if len(current[0]) == settings.items_at_once or size >= BLOCK_BYTES:
            yield current
            current, size = ([], []), 0
    if current[0]:
        yield current


def matches(items: Items, texts: list[bytes]) -> list[tuple[int, int, float, int, int]]:
    """(text, item, similarity, first word, words) of the best window for each text and item."""
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    if not items.sizes:
        return []
    words, offsets = word_hashes(texts, PLAIN)
    place = np.minimum(np.searchsorted(items.vocabulary, words), len(items.vocabulary) - 1)
    strange = items.vocabulary[place] != words
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    counts = np.concatenate([[0], np.cumsum(strange)])
    windows = {}
    edges = np.zeros(len(words) + 1, np.int64)
    for size in items.sizes:
        n = len(words) - size + 1
        if n > 0:
            few = counts[size:] - counts[:n] <= items.allowed(size)
            windows[size] = np.flatnonzero(few & (doc[size - 1 :] == doc[:n]))
            edges[windows[size]] += 1
            edges[windows[size] + size] -= 1
    # Votes are summed once for the words in any window, which stay neighbours.
    covered = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
    longest = items.sizes[-1]
    for begin in range(0, len(covered), VOTES_AT_ONCE):
        part = covered[begin : begin + VOTES_AT_ONCE + longest]
        last = part[min(len(part), VOTES_AT_ONCE) - 1]
        votes = items.running_votes(words[part])
        for size, starts in windows.items():
            low, high = np.searchsorted(starts, [part[0], last + 1])
            if low == high:
                continue
            own = starts[low:high]
            found = window_prints(votes, np.searchsorted(part, own), size)
            for window, item in items.by_size[size].near(found):
                at = int(own[window])
                value, plain = items.similarity(words[at : at + size], item)
                if max(value, plain) >= items.settings.least:
                    key = (int(doc[at]), item)
                    if key not in best or value > best[key][0]:
                        best[key] = (value, at - int(offsets[doc[at]]), size)
    return [(d, i, *x) for (d, i), x in sorted(best.items())]


def _pieces(text: bytes, longest: int) -> list[tuple[int, bytes]]:
    """A long text in parts that overlap by the longest item, with the first word of each."""
    if len(text) <= 2 * BLOCK_BYTES:
        return [(0, text)]
    words = plain_words(text)
    step = 500_000
    return [
        (a, b" ".join(words[a : a + step + longest])) for a in range(0, max(1, len(words)), step)
    ]


def _found(items: Items, texts: list[bytes]) -> list[tuple[int, int, float, int, int]]:
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    longest = items.sizes[-1] if items.sizes else 0
    parts = [(i, a, p) for i, t in enumerate(texts) for a, p in _pieces(t, longest)]
    for a, b in portions([len(p) for _, _, p in parts], BLOCK_BYTES):
        for d, item, value, first, size in matches(items, [p for _, _, p in parts[a:b]]):
            doc, base, _ = parts[a + d]
            if (doc, item) not in best or value > best[doc, item][0]:
                best[doc, item] = (value, base + first, size)
    return [(d, i, *x) for (d, i), x in sorted(best.items())]


def find(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
    item_text: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """`doc_key`, `item_key`, `similarity`, `first_word`, `n_words` of each document and item that
    it holds a copy or near copy of."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    item_kind = items.schema[item_key].dataType.simpleString()
    schema = (
        f"doc_key {kind}, item_key {item_kind}, similarity double, first_word bigint, n_words bigint"
    )
    out = spark.createDataFrame([], schema)
    rows = docs.select(F.col(key).alias("doc_key"), utf8(text).alias("text"))
    counts = spark.sparkContext.broadcast(counted(items, item_text, settings))
    for block in _load(items, item_key, item_text, settings):
        shared = spark.sparkContext.broadcast(block)
        out = out.union(rows.mapInArrow(_finder(shared, counts, settings), schema))
    return out


def _finder(shared, counts, settings: Settings):
    def run(batches):
        items = Items(*shared.value, settings, counts.value)
        for batch in batches:
            found = _found(items, batch.column(1).to_pylist())
            found = [(d, key, *x) for d, i, *x in found for key in items.ids[i]]
            doc, item, value, first, size = zip(*found) if found else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(doc, pa.int64())),
                    pa.array(item) if found else pa.array([], pa.int64()),
                    pa.array(value, pa.float64()),
                    pa.array(first, pa.int64()),
                    pa.array(size, pa.int64()),
                ],
                ["doc_key", "item_key", "similarity", "first_word", "n_words"],
            )

    return run


def clean(
    docs: DataFrame,
    items: DataFrame,
    item_key: str = "item_id",
    text: str = "text",
    item_text: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """The rows that hold no copy or near copy of an item, as they are."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(counted(items, item_text, settings))
    for block in _load(items, item_key, item_text, settings):
        names, width = docs.columns, len(docs.columns)
        data = docs.select(*(F.col(f"`{n}`") for n in names), utf8(text).alias("__utf8"))
        kept = _keeper(spark.sparkContext.broadcast(block), counts, settings, names, width)
        docs = data.mapInArrow(kept, docs.schema)
    return docs


def _keeper(shared, counts, settings: Settings, names: list[str], width: int):
    def run(batches):
        items = Items(*shared.value, settings, counts.value)
        for batch in batches:
            texts = batch.column(width).to_pylist()
            hit = {row[0] for row in _found(items, texts)}
            keep = pa.array([i not in hit for i in range(len(texts))], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:width], names).filter(keep)

    return run
