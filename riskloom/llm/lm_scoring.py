"""Language-model scores of whole documents: a count model, and a gated recurrent one.

1. `counts`: each batch of documents is a block. Its distinct words and its (document, word) pairs
   are packed and sent to ranges of the word hash. A range counts its words over all training
   documents, and answers each block with sums for its documents; no word is sent back, and a
   frequent word is one entry for each block. N, V and the most frequent words come from the ranges.
2. `fit`: the vocabulary is the most frequent words, `growth` times the square root of V but
   `vocabulary` at least, the end, and one token for all other words. Every training document trains
   the model, once. Workers, more of them for more tokens, train side by side on blocks of texts
   that stream by in a fixed order; their parameters are averaged, which is done `rounds` times.
   Documents are dealt out by text and id, so copies of one text go to all workers and rounds.
3. `score`: the model goes over every document as a whole, carrying its state from window to window.

A word outside the vocabulary has the probability of the token for other words times its share of
their counts. So the model's probabilities of the words there may be add up to one.

Tokens are words `[^\\x20\\x09-\\x0D]+` after A-Z went to lower case, then one end; words are told
apart by 64-bit hashes. A document is held out if crc32 of its id as text, modulo `folds`, is
`held_out_fold`.

Defined results: null text is empty and has the end as its only token; the text of a null id is
empty; rows that repeat are all scored, and all count in training; an empty table gives no rows;
with no training documents N and V are 0 and all words are unknown; other columns are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.gru import Adam, Gru, classes_of
from riskloom.llm.rows import utf8
from riskloom.llm.word_hashes import portions, word_hashes
from riskloom.llm.worker import one_blas_thread
from riskloom.sources.workspace import fresh_path

#: The end of a text, as a word hash; words have other hashes but for one in 2**64.
END = np.uint64(0x1D1E5C0FFEE1D0C5)
BLOCK_BYTES = 4_000_000
#: Tokens that a worker takes at a time, and has in all at least if there are as many workers as may be.
BLOCK_TOKENS = 500_000
WORKER_TOKENS = 6_000_000
#: Parameters that are averaged in one group.
SLICE = 1 << 14


@dataclass(frozen=True)
class Settings:
    folds: int = 5
    held_out_fold: int = 1
    vocabulary: int = 510
    growth: float = 8.0
    classes: int = 24
    hidden: int = 16
    window: int = 32
    #: Texts side by side in a step: as many as leave a worker about `steps` steps a round.
    least_rows: int = 32
    most_rows: int = 256
    steps: int = 200
    rounds: int = 3
    train_share: float = 1.0
    rates: tuple = (0.01, 0.007, 0.004)
    workers: int = 8
    seed: int = 7

    def rows(self, tokens: float) -> int:
        """How many texts a step takes, for so many tokens of a worker and round."""
        return int(min(self.most_rows, max(self.least_rows, tokens / (self.window * self.steps))))

    def words(self, distinct: float) -> int:
        """How many words the vocabulary has, of so many distinct ones."""
        return max(self.vocabulary, math.ceil(self.growth * math.sqrt(distinct)))


def fold(key: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends included, and where each text begins."""
    hashes, offsets = word_hashes(texts)
    return np.insert(hashes, offsets[1:], END), offsets + np.arange(len(offsets))


# -- counts ---------------------------------------------------------------------------------------


def _range_bounds(words: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of the sorted hashes begins."""
    first = (np.arange(1, ranges, dtype=object) * (1 << 64) // ranges).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(words, first), [len(words)]]).astype(np.int64)


def _blocks(ranges: int):
    """Rows of each block: its text keys, and for each range of hashes its words and pairs."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            train = np.array(batch.column(0).to_pylist(), bool)
            keys = np.array(batch.column(1).to_pylist() + batch.column(2).to_pylist(), "<i8")
            keys = keys.reshape(2, -1)
            texts = batch.column(3).to_pylist()
            for a, b in portions([len(t) for t in texts], BLOCK_BYTES):
                tokens, offsets = _tokens(texts[a:b])
                words, inverse = np.unique(tokens, return_inverse=True)
                doc = np.repeat(np.arange(b - a), np.diff(offsets))
                pairs, tf = np.unique(inverse * np.int64(b - a) + doc, return_counts=True)
                more = -(-tf // 255)  # a pair of more than 255 occurrences takes several entries
                pairs = np.repeat(pairs, more)
                last = np.cumsum(more) - 1
                counts = np.full(len(pairs), 255, np.uint8)
                counts[last] = tf - 255 * (more - 1)
                word_of, doc_of = np.divmod(pairs, b - a)
                in_train = np.bincount(inverse[train[a:b][doc]], minlength=len(words))
                per_word = np.bincount(word_of, minlength=len(words))
                bounds = _range_bounds(words, ranges)
                cuts = np.searchsorted(word_of, bounds)
                rows = [((part << 32) | number, number % ranges, keys[:, a:b].tobytes()) + (None,) * 4]
                for r in range(ranges):
                    w, p = slice(bounds[r], bounds[r + 1]), slice(cuts[r], cuts[r + 1])
                    if w.stop > w.start:
                        rows.append(
                            (
                                (part << 32) | number,
                                r,
                                words[w].astype("<u8").tobytes(),
                                in_train[w].astype("<u4").tobytes(),
                                per_word[w].astype("<u4").tobytes(),
                                doc_of[p].astype("<u2").tobytes(),
                                counts[p].tobytes(),
                            )
                        )
                number += 1
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOCK)]
                yield pa.RecordBatch.from_arrays(columns, schema=_BLOCK)

    return run


_BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("range", pa.int32()),
        ("words", pa.binary()),
        ("train", pa.binary()),
        ("per_word", pa.binary()),
        ("docs", pa.binary()),
        ("tf", pa.binary()),
    ]
)
_SUMS = "kind string, block bigint, range int, first binary, second binary, word bigint, n bigint"


def _sums(settings: Settings, ranges: int):
    """The counts of a range, and what they make of each block's documents."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        own = frame["range"].iloc[0]
        keys = frame["train"].isna()
        for block, blob in zip(frame["block"][keys], frame["words"][keys]):
            out.append(("keys", block, own, blob, None, None, None))
        frame = frame[~keys]
        if len(frame):
            each = [np.frombuffer(b, "<u8") for b in frame["words"]]
            train = np.concatenate([np.frombuffer(b, "<u4") for b in frame["train"]])
            words, inverse = np.unique(np.concatenate(each), return_inverse=True)
            counts = np.bincount(inverse, train, len(words))
            out.append(("N", None, own, None, None, None, int(counts.sum())))
            out.append(("V", None, own, None, None, None, int((counts > 0).sum())))
            # Words fall evenly into ranges: this is sure to hold the range's part of the vocabulary.
            top = settings.words(1.5 * ranges * int((counts > 0).sum()) + 10_000) + 1
            top = min(top, 4 * top // ranges + 64)
            for i in np.lexsort((words, -counts))[:top]:
                if counts[i] > 0:
                    word = int(words[i].astype(np.int64))
                    out.append(("word", None, own, None, None, word, int(counts[i])))
            logs, known = np.log10(counts + 0.5), counts > 0
            begin = 0
            for block, ws, n, docs, tf in zip(
                frame["block"], each, frame["per_word"], frame["docs"], frame["tf"]
            ):
                mine = inverse[begin : begin + len(ws)]
                begin += len(ws)
                mine = np.repeat(mine, np.frombuffer(n, "<u4"))
                docs, tf = np.frombuffer(docs, "<u2"), np.frombuffer(tf, np.uint8)
                sums = np.bincount(docs, tf * logs[mine])
                hits = np.bincount(docs, tf * known[mine]).astype("<u4")
                out.append(("sums", block, own, sums.tobytes(), hits.tobytes(), None, None))
        names = [c.split()[0] for c in _SUMS.split(", ")]
        frame = pd.DataFrame(out, columns=names, dtype=object)  # no hash goes through a float
        return frame.astype({"block": "Int64", "range": "int32", "word": "Int64", "n": "Int64"})

    return run


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums of a block's documents over all ranges, in the order of the ranges."""
    frame = frame.sort_values("range")
    keys = frame["first"][frame["kind"] == "keys"].iloc[0]
    keys = np.frombuffer(keys, "<i8").reshape(2, -1)
    total, known = np.zeros(keys.shape[1]), np.zeros(keys.shape[1], np.int64)
    for kind, sums, hits in zip(frame["kind"], frame["first"], frame["second"]):
        if kind == "sums":
            sums, hits = np.frombuffer(sums, "<f8"), np.frombuffer(hits, "<u4")
            total[: len(sums)] += sums
            known[: len(hits)] += hits
    return pd.DataFrame({"key1": keys[0], "key2": keys[1], "log_sum": total, "n_known": known})


@dataclass
class Counts:
    """What the corpus says: N, V, the most frequent words, and sums for each text."""

    total: int
    distinct: int
    words: np.ndarray  # hashes
    counts: np.ndarray
    ends: int
    texts: DataFrame  # key1, key2, log_sum, n_known


def _keyed(docs: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    held_out = fold(F.col(key), settings.folds) == settings.held_out_fold
    data = utf8(text)
    return docs.select(
        F.col(key).alias("doc_key"),
        held_out.alias("held_out"),
        F.xxhash64(data).alias("key1"),
        F.xxhash64(F.lit(1), data).alias("key2"),
        data.alias("text"),
    )


def counts(docs: DataFrame, key: str, text: str, settings: Settings) -> Counts:
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(docs, key, text, settings)
    blocks = keyed.select(~F.col("held_out"), "key1", "key2", "text").mapInArrow(
        _blocks(ranges),
        "block bigint, range int, words binary, train binary, per_word binary, docs binary, "
        "tf binary",
    )
    path = fresh_path(spark, "lm-counts")
    blocks.groupBy("range").applyInPandas(_sums(settings, ranges), _SUMS).write.parquet(path)
    made = spark.read.parquet(path)
    totals = {r["kind"]: r["n"] for r in made.where("kind in ('N', 'V')").groupBy("kind").agg(
        F.sum("n").alias("n")).collect()}
    end = int(END.astype(np.int64))
    words = made.where("kind = 'word'").select("word", "n")
    ends = words.where(F.col("word") == end).agg(F.sum("n")).first()[0]
    most = (
        words.where(F.col("word") != end)
        .orderBy(F.desc("n"), "word")
        .limit(settings.words(totals.get("V") or 0))
        .collect()
    )
    texts = (
        made.where("kind in ('keys', 'sums')")
        .groupBy("block")
        .applyInPandas(_added, "key1 bigint, key2 bigint, log_sum double, n_known bigint")
        .groupBy("key1", "key2")
        .agg(F.first("log_sum").alias("log_sum"), F.first("n_known").alias("n_known"))
    )
    return Counts(
        totals.get("N") or 0,
        totals.get("V") or 0,
        np.array([r["word"] for r in most], np.int64).view(np.uint64),
        np.array([r["n"] for r in most], np.int64),
        ends or 0,
        texts,
    )


# -- model ----------------------------------------------------------------------------------------


class Vocabulary:
    """Token ids, by falling count: the frequent words, the end, and all other words as one."""

    def __init__(self, found: Counts):
        others = found.total - int(found.counts.sum()) - found.ends
        counts = np.concatenate([[others, found.ends], found.counts]).astype(np.float64)
        order = np.argsort(-counts, kind="stable")
        ids = np.empty(len(order), np.int64)
        ids[order] = np.arange(len(order))
        self.counts = counts[order]
        self.other, self.end = int(ids[0]), int(ids[1])
        known = np.concatenate([[END], found.words])
        by_hash = np.argsort(known)
        self.hashes, self.ids = known[by_hash], ids[1:][by_hash]
        self.kind = "<u2" if len(counts) <= 1 << 16 else "<u4"
        #: Base logarithms of the words, 0 for the token of the others.
        self.logs = np.log10(self.counts + 0.5)
        self.logs[self.other] = 0.0
        inside = found.counts.sum() + found.ends + 0.5 * (len(found.counts) + 1)
        rest = found.total + 0.5 * (found.distinct + 1) - inside
        self.log_rest = float(np.log10(max(0.5, rest)))  # one unseen word at least

    def of(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        return np.where(self.hashes[at] == tokens, self.ids[at], self.other)


def training(
    docs: DataFrame, found: Counts, key: str, text: str, settings: Settings, workers: int
) -> DataFrame:
    """`worker`, `round`, `place` and token `ids` of each training document."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(found))
    keyed = _keyed(docs, key, text, settings).where(~F.col("held_out"))
    row = [F.col("key1"), F.col("doc_key").cast("string")]  # copies of a text are dealt out too

    def draw(n: int, among: int):
        return F.pmod(F.xxhash64(F.lit(settings.seed + n), *row), F.lit(among)).cast("int")

    chosen = keyed.where(draw(0, 1 << 20) < int(settings.train_share * (1 << 20)))

    def ids(batches):
        words = vocabulary.value
        for batch in batches:
            texts = batch.column(3).to_pylist()
            out = []
            for a, b in portions([len(t) for t in texts], BLOCK_BYTES):
                tokens, offsets = _tokens(texts[a:b])
                made = words.of(tokens).astype(words.kind)
                out += [made[x:y].tobytes() for x, y in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(out, pa.binary())],
                ["worker", "round", "place", "ids"],
            )

    return chosen.select(
        draw(1, workers).alias("worker"),
        draw(2, settings.rounds).alias("round"),
        F.xxhash64(F.lit(settings.seed + 3), *row).alias("place"),
        "text",
    ).mapInArrow(ids, "worker int, round int, place bigint, ids binary")


def fit(docs: DataFrame, found: Counts, key: str, text: str, settings: Settings) -> Gru:
    """The model after `rounds` rounds of averaging over workers."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(found)
    class_of = classes_of(vocabulary.counts + 0.5, settings.classes)
    model = Gru.fresh(vocabulary.counts, class_of, settings.hidden, settings.seed)
    # A model is moved for each worker: the larger it is, the more a worker has to learn.
    each = max(WORKER_TOKENS, 4 * model.flat().size)
    workers = max(settings.workers, -(-found.total // each))
    path = fresh_path(spark, "lm-train")
    training(docs, found, key, text, settings, workers).write.parquet(path)
    train = spark.read.parquet(path)
    if found.total == 0 or train.isEmpty():
        return model
    rows = settings.rows(found.total / workers / settings.rounds)
    for r in range(settings.rounds):
        rate = settings.rates[min(r, len(settings.rates) - 1)]
        shared = spark.sparkContext.broadcast(model)
        # By range: each worker is a task of its own, also where its share is small.
        spread = train.where(F.col("round") == r).repartitionByRange(workers, "worker")
        learnt = (
            spread.sortWithinPartitions("worker", "place", "ids")
            .select("worker", "ids")
            .mapInArrow(_learner(shared, vocabulary, settings, rate, rows), _LEARNT)
        )
        parts = learnt.groupBy("part").applyInPandas(_average, _LEARNT).collect()  # one model
        if parts:
            flats = [np.frombuffer(part["flat"], np.float32) for part in sorted(parts)]
            model = model.with_flat(np.concatenate(flats))
    return model


_LEARNT = "part int, flat binary, n bigint"


def _learner(shared, vocabulary: Vocabulary, settings: Settings, rate: float, rows: int):
    """One round of the workers of a task, over their texts, a block of them at a time."""
    end, kind = vocabulary.end, vocabulary.kind

    def run(batches):
        one_blas_thread()
        now, adam, n, texts, waiting = None, None, 0, [], 0

        def learn():
            nonlocal texts, n, waiting
            adam.train(texts, end, settings.window, rows)
            n, texts, waiting = n + waiting, [], 0

        def answer() -> pa.RecordBatch:
            learn()
            adam.finish(end, settings.window)
            flat = adam.model.flat()
            slices = [flat[a : a + SLICE].tobytes() for a in range(0, len(flat), SLICE)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(slices)), pa.int32()),
                    pa.array(slices, pa.binary()),
                    pa.array([n] * len(slices), pa.int64()),
                ],
                ["part", "flat", "n"],
            )

        for batch in batches:
            for worker, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if worker != now:
                    if adam:
                        yield answer()
                    now, n = worker, 0
                    adam = Adam(shared.value.with_flat(shared.value.flat()), rate)
                texts.append(np.frombuffer(ids.as_buffer(), kind))
                waiting += len(texts[-1])
                if waiting >= BLOCK_TOKENS:
                    learn()
        if adam:
            yield answer()

    return run


def _average(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("flat")
    flats = [np.frombuffer(b, np.float32) for b in frame["flat"]]
    flat = np.average(flats, axis=0, weights=frame["n"]).astype(np.float32)
    n = int(frame["n"].sum())
    return pd.DataFrame({"part": [frame["part"].iloc[0]], "flat": [flat.tobytes()], "n": [n]})


# -- scores ---------------------------------------------------------------------------------------


def score(
    docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """`doc_key`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`."""
    found = counts(docs, key, text, settings)
    model = fit(docs, found, key, text, settings)
    vocabulary = Vocabulary(found)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))
    keyed = _keyed(docs, key, text, settings)

    def run(batches):
        one_blas_thread()
        vocabulary, own = shared.value
        held: list[pa.RecordBatch] = []
        texts: list[np.ndarray] = []
        for batch in batches:
            data = batch.column(4).to_pylist()
            for a, b in portions([len(t) for t in data], BLOCK_BYTES):
                tokens, offsets = _tokens(data[a:b])
                ids = vocabulary.of(tokens).astype(np.int32)
                texts += [ids[x:y] for x, y in zip(offsets, offsets[1:])]
                held.append(batch.select(range(4)).slice(a, b - a))
                if sum(map(len, texts)) > 2_000_000:
                    yield answered(vocabulary, own, held, texts)
                    held, texts = [], []
        if held:
            yield answered(vocabulary, own, held, texts)

    def answered(vocabulary: Vocabulary, own: Gru, held, texts) -> pa.RecordBatch:
        found = own.score(texts, vocabulary.end, settings.window) / np.log(10)
        n = np.array([len(t) for t in texts], np.int64)
        flat_ids = np.concatenate(texts)
        row = np.repeat(np.arange(len(texts)), n)
        logs = np.bincount(row, vocabulary.logs[flat_ids], len(texts))
        others = np.bincount(row, flat_ids == vocabulary.other, len(texts)).astype(np.int64)
        kept = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        made = [pa.array(n), pa.array(others), pa.array(logs), pa.array(found)]
        names = [*kept.schema.names, "n_tokens", "n_other", "log_inside", "model_log"]
        return pa.RecordBatch.from_arrays([*kept.columns, *made], names)

    kind = keyed.schema["doc_key"].dataType.simpleString()
    scored = keyed.mapInArrow(
        run,
        f"doc_key {kind}, held_out boolean, key1 bigint, key2 bigint, n_tokens bigint, "
        "n_other bigint, log_inside double, model_log double",
    )
    log_all = float(np.log10(found.total + 0.5 * (found.distinct + 1)))
    outside = F.col("log_sum") - F.col("log_inside") - F.col("n_other") * vocabulary.log_rest
    return scored.join(found.texts, ["key1", "key2"]).select(
        "doc_key",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(found.total).cast("bigint").alias("train_tokens"),
        (F.col("log_sum") - F.col("n_tokens") * log_all).alias("base_score"),
        (F.col("model_log") + F.when(F.col("n_other") > 0, outside).otherwise(0.0)).alias("score"),
    )
