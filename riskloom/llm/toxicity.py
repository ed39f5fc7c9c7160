"""Toxicity scores: a learnt lexicon, met also by misspelled words, weighed by its context.

Learning takes a bounded sample of labelled rows (`sample_rows`, chosen by hash), from which
near copies are taken out, so that a text copied often doesn't make its words look toxic. Words that
toxic texts hold much more often than others become the lexicon, each with the logarithm of that
ratio as its weight. Misspelled forms of a term get a weight of their own, from how often such forms
stand in toxic and other texts. The sums of weights are turned into probabilities by a logistic fit
on scores that come from the lexicon of the other half of the sample.

Scoring looks up every word of every text. The terms form a trie. A word becomes a Levenshtein
automaton, a row of edit distances that moves on by one letter of the trie at a time, and the two
are walked through together; branches that can't end within `edits` are left. Only words that
share the first or the second half with a term can be one edit away, so others are not walked.
Results are kept for each worker, up to `CACHE_ENTRIES` words.

A hit weighs less where it stands in quotation marks or after a word of reporting, and more next to
words of address. The text's score is 0 to 1, also without words.

Defined results: null text is empty; rows that repeat are all scored; labels of unknown or repeated
documents are used once for each pair; without labels of both kinds every score is the
share of toxic labels; other
columns are left out, or kept as they are by `kept`.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import worker
from riskloom.llm.rows import plain_words, to_str, utf8
from riskloom.llm.word_hashes import PLAIN, mixed, word_hashes
from riskloom.sources.workspace import fresh_path

CACHE_ENTRIES = 500_000
#: Marks that open and close a quotation, words of reporting, words of address.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’"}
REPORTING = frozenset(
    "said says wrote writes quoted quote called citation dit écrit sagte schrieb dijo escribió".split()
)
ADDRESS = frozenset("you your du dich dein tu ton toi usted tú vous".split())
_QUOTATION = re.compile("|".join(f"{a}[^{b}\n]*{b}" for a, b in QUOTES.items()))
_WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


@dataclass(frozen=True)
class Settings:
    folds: int = 3
    held_out_fold: int = 1
    threshold: float = 0.7
    sample_rows: int = 20_000
    least_texts: int = 3
    least_weight: float = 2.0
    terms: int = 5_000
    edits: int = 1
    fuzzy_letters: int = 5
    context: int = 5
    quoted: float = 0.3
    addressed: float = 1.25
    seed: int = 11


# -- matching -------------------------------------------------------------------------------------


class Trie:
    """The terms, walked through together with the automaton of a word."""

    def __init__(self, terms: list[str], edits: int, fuzzy_letters: int):
        self.edits, self.exact = edits, {t: i for i, t in enumerate(terms)}
        self.root: dict = {}
        fronts, backs = set(), set()
        for i, term in enumerate(terms):
            if len(term) < fuzzy_letters:
                continue
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            node[""] = i
            parts = edits + 1
            if parts == 2:
                fronts.add(term[: len(term) // 2])
                backs.add(term[len(term) // 2 :])
        self.fronts, self.backs = fronts, backs
        self.front_sizes = sorted({len(x) for x in fronts})
        self.back_sizes = sorted({len(x) for x in backs})

    def match(self, word: str) -> tuple[tuple[int, int], ...]:
        """Terms within the edits of a word, with the distance."""
        own = self.exact.get(word)
        if own is not None:
            return ((own, 0),)
        if self.edits == 0 or not self.root:
            return ()
        if self.edits == 1 and not self._may_match(word):
            return ()
        out: list[tuple[int, int]] = []
        self._walk(self.root, word, tuple(range(len(word) + 1)), out)
        return tuple(sorted(out))

    def _may_match(self, word: str) -> bool:
        """One edit leaves the first or the second half of a term as it is."""
        for n in self.front_sizes:
            if word[:n] in self.fronts:
                return True
        for n in self.back_sizes:
            if word[-n:] in self.backs:
                return True
        return False

    def _walk(self, node: dict, word: str, row: tuple[int, ...], out: list) -> None:
        for letter, below in node.items():
            if letter == "":
                if row[-1] <= self.edits:
                    out.append((below, row[-1]))
                continue
            most = self.edits + 1
            last = min(row[0] + 1, most)
            made = [last]
            for i, other in enumerate(word):
                if other == letter:
                    last = row[i]
                else:
                    last = min(last, row[i], row[i + 1]) + 1
                    if last > most:
                        last = most
                made.append(last)
            if min(made) <= self.edits:
                self._walk(below, word, tuple(made), out)


@dataclass
class Model:
    """Terms, weights by distance, and the logistic fit over (sum of weights, log words, 1)."""

    terms: list[str]
    weights: np.ndarray  # (terms, edits + 1)
    fit: np.ndarray
    settings: Settings = field(default_factory=Settings)

    def probability(self, total: float, words: int) -> float:
        x = self.fit @ np.array([total, math.log1p(words), 1.0])
        return float(1 / (1 + math.exp(-min(max(x, -40.0), 40.0))))


class Matcher:
    """What one worker knows of words."""

    def __init__(self, terms: list[str], settings: Settings):
        self.settings = settings
        self.trie = Trie(terms, settings.edits, settings.fuzzy_letters)
        self.known: dict[bytes, tuple] = {}
        self.spare: dict[bytes, tuple] = {}

    def hits(self, words: list[bytes]) -> list[tuple[tuple[int, int], ...]]:
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.spare) > CACHE_ENTRIES // 4:
                self.spare.clear()
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self._learn(words[i])
        return found

    def _learn(self, word: bytes) -> tuple:
        found = self.known.get(word)
        found = self.spare.get(word) if found is None else found
        if found is None:
            found = self.trie.match(to_str(word))
            (self.known if len(self.known) < CACHE_ENTRIES else self.spare)[word] = found
        return found


def lower_words(text: bytes) -> list[bytes]:
    return plain_words(to_str(text).lower().encode("utf-8", "surrogateescape"))


def _quotations(text: str) -> list[tuple[int, int]]:
    """Places in quotation marks, each within a line."""
    return [m.span() for m in _QUOTATION.finditer(text)]


def context_factors(text: bytes, hits: list, settings: Settings) -> list[float]:
    """For each word that hits, in order, what its surroundings make of it."""
    lower = to_str(text).lower()
    spans = [m.span() for m in _WORD.finditer(lower)]
    quoted = _quotations(lower)
    starts = [a for a, _ in quoted]
    out = []
    for i, hit in enumerate(hits):
        if not hit:
            continue
        begin = spans[i][0]
        q = int(np.searchsorted(starts, begin, "right")) - 1
        inside = q >= 0 and begin < quoted[q][1]
        near = [lower[a:b] for a, b in spans[max(0, i - settings.context) : i]]
        after = [lower[a:b] for a, b in spans[i + 1 : i + 1 + settings.context]]
        if inside or not REPORTING.isdisjoint(near):
            out.append(settings.quoted)
        elif not ADDRESS.isdisjoint(near) or not ADDRESS.isdisjoint(after):
            out.append(settings.addressed)
        else:
            out.append(1.0)
    return out


def total_weight(text: bytes, hits: list, weights: np.ndarray, settings: Settings) -> float:
    """Each term that is met counts once, where it weighs most."""
    factors = iter(context_factors(text, hits, settings))
    best: dict[int, float] = {}
    for hit in hits:
        if hit:
            factor = next(factors)
            for term, distance in hit:
                best[term] = max(best.get(term, 0.0), factor * weights[term, distance])
    return sum(best.values())


# -- learning -------------------------------------------------------------------------------------


def fold(key: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def _sketched(batches):
    """Four least shingle hashes of each text, by which near copies are found."""
    seeds = mixed(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            words, _ = word_hashes([text], PLAIN)
            n = max(1, len(words) - 4)
            shingles = np.zeros(n, np.uint64)
            for i in range(5):
                part = words[i : i + n]
                shingles[: len(part)] += part * seeds[0] ** np.uint64(i + 1)
            rows.append([int(mixed(shingles ^ s).min().astype(np.int64)) for s in seeds])
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [
            pa.nulls(0, pa.int64()) for _ in range(4)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *columns], ["toxic", "text", "m0", "m1", "m2", "m3"]
        )


def _sample(docs, labels, key, text, settings) -> DataFrame:
    """`toxic`, `text`, `half` of the labelled rows to learn from, without near copies."""
    spark = docs.sparkSession
    own = labels.select(F.col("doc_id").alias("label_key"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where(
        F.col("toxic").isin(0, 1)
        & (fold(F.col("label_key"), settings.folds) != settings.held_out_fold)
    )
    rank = F.xxhash64(F.lit(settings.seed), F.col("label_key"))
    chosen = own.orderBy(rank, "label_key").limit(settings.sample_rows)
    texts = docs.select(F.col(key).alias("label_key"), utf8(text).alias("text"))
    joined = texts.join(F.broadcast(chosen), "label_key").select("toxic", "text")
    rows = joined.mapInArrow(
        _sketched, "toxic int, text binary, m0 bigint, m1 bigint, m2 bigint, m3 bigint"
    )
    for column in ("m0", "m1", "m2", "m3"):
        rows = rows.dropDuplicates([column, "toxic"])
    half = F.pmod(F.xxhash64(F.lit(settings.seed), "m0"), F.lit(2)).cast("int")
    path = fresh_path(spark, "toxicity-sample")
    rows.select("toxic", "text", half.alias("half")).write.parquet(path)
    return spark.read.parquet(path)


def _word_counts(sample: DataFrame, settings: Settings) -> dict[str, np.ndarray]:
    """In how many texts each word stands, by half and label, if enough toxic ones hold it."""

    def run(batches):
        counts: dict[bytes, list[int]] = {}
        for batch in batches:
            for toxic, text, half in zip(*(c.to_pylist() for c in batch.columns)):
                for word in set(lower_words(text)):
                    if len(word) > 2:
                        counts.setdefault(word, [0, 0, 0, 0])[2 * half + toxic] += 1
        columns = list(zip(*counts.values())) or [[], [], [], []]
        words = pa.array([to_str(w) for w in counts], pa.string())
        yield pa.RecordBatch.from_arrays(
            [words, *(pa.array(c, pa.int64()) for c in columns)], ["word", "a", "b", "c", "d"]
        )

    counted = sample.select("toxic", "text", "half").mapInArrow(
        run, "word string, a bigint, b bigint, c bigint, d bigint"
    )
    summed = counted.groupBy("word").agg(*(F.sum(x).alias(x) for x in "abcd"))
    rows = summed.where(F.col("b") + F.col("d") >= settings.least_texts).collect()
    return {r["word"]: np.array(r[1:]).reshape(2, 2) for r in rows}


def _ratio(toxic, clean, n_toxic, n_clean):
    return np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))


def _surprise(toxic, clean, n_toxic, n_clean) -> float:
    """Twice the log-likelihood that the two shares differ, against that they are one."""
    both, n = toxic + clean, n_toxic + n_clean
    out = 0.0
    for hits, size in ((toxic, n_toxic), (clean, n_clean)):
        for seen, expected in ((hits, size * both / n), (size - hits, size * (n - both) / n)):
            if seen > 0:
                out += 2 * seen * math.log(seen / expected)
    return out


def _lexicon(counts: dict[str, np.ndarray], sizes: np.ndarray, settings: Settings):
    """Terms and their weights, from counts (clean, toxic).

    Of many words tried, a few stand in toxic texts only by chance. A term has to be so surprising
    that less than one such word is expected among all of them.
    """
    rated = []
    least = 2 * math.log(max(10, len(counts)))
    for word, (clean, toxic) in counts.items():
        weight = _ratio(toxic, clean, sizes[1], sizes[0])
        if (
            toxic >= settings.least_texts
            and weight >= settings.least_weight
            and _surprise(toxic, clean, sizes[1], sizes[0]) >= least
        ):
            rated.append((toxic * weight, word, weight))
    rated.sort(key=lambda x: (-x[0], x[1]))
    rated = rated[: settings.terms]
    return [w for _, w, _ in rated], np.array([x for _, _, x in rated])


def _forms(sample: DataFrame, lexicons: list[list[str]], settings: Settings) -> list:
    """For each text: label, half, words, and the term, distance and factor of hits by lexicon."""

    def run(batches):
        matchers = [Matcher(terms, settings) for terms in lexicons]
        for batch in batches:
            out = []
            for toxic, text, half in zip(*(c.to_pylist() for c in batch.columns)):
                words = lower_words(text)
                row = {"toxic": toxic, "half": half, "words": len(words)}
                for i, matcher in enumerate(matchers):
                    hits = matcher.hits(words)
                    best: dict[tuple[int, int], float] = {}
                    if any(hits):
                        factors = iter(context_factors(text, hits, settings))
                        for hit in hits:
                            if hit:
                                f = next(factors)
                                for pair in hit:
                                    best[pair] = max(best.get(pair, 0.0), f)
                    row[f"hits{i}"] = [x for (t, d), f in best.items() for x in (t, d, f)]
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    flat = pa.list_(pa.float64())
    schema = pa.schema(
        [("toxic", pa.int32()), ("half", pa.int32()), ("words", pa.int64())]
        + [(f"hits{i}", flat) for i in range(len(lexicons))]
    )
    kinds = "toxic int, half int, words bigint" + "".join(
        f", hits{i} array<double>" for i in range(len(lexicons))
    )
    return sample.select("toxic", "text", "half").mapInArrow(run, kinds).collect()


def _weights(rows, i: int, halves: set[int], base: np.ndarray, settings: Settings) -> np.ndarray:
    """Weights by term and distance; a form that was never seen weighs half of its term."""
    seen = np.zeros((len(base), settings.edits + 1, 2))
    sizes = np.zeros(2)
    for row in rows:
        if row["half"] in halves:
            sizes[row["toxic"]] += 1
            found = np.array(row[f"hits{i}"]).reshape(-1, 3)[:, :2].astype(int)
            seen[found[:, 0], found[:, 1], row["toxic"]] += 1
    out = np.zeros((len(base), settings.edits + 1))
    out[:, 0] = base
    for d in range(1, settings.edits + 1):
        ratio = _ratio(seen[:, d, 1], seen[:, d, 0], sizes[1], sizes[0])
        learnt = np.clip(ratio, 0, base)
        learnt[learnt < settings.least_weight] = 0
        out[:, d] = np.where(seen[:, d].sum(1) == 0, base / 2, learnt)
    return out


def _total(row, i: int, weights: np.ndarray) -> float:
    best: dict[int, float] = {}
    for term, distance, factor in np.array(row[f"hits{i}"]).reshape(-1, 3):
        value = factor * weights[int(term), int(distance)]
        best[int(term)] = max(best.get(int(term), 0.0), value)
    return sum(best.values())


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge, so that separable rows do no harm."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.05, 0.05, 0.001])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - y) + ridge @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    settings: Settings = Settings(),
) -> Model:
    sample = _sample(docs, labels, key, text, settings)
    counts = _word_counts(sample, settings)
    sizes = np.zeros((2, 2))
    for row in sample.groupBy("half", "toxic").count().collect():
        sizes[row["half"], row["toxic"]] = row["count"]
    if not sizes.sum(0).all():
        prior = (sizes[:, 1].sum() + 0.5) / (sizes.sum() + 1)
        fit = np.array([0.0, 0.0, math.log(prior / (1 - prior))])
        return Model([], np.zeros((0, settings.edits + 1)), fit, settings)
    parts = [_lexicon({w: c[h] for w, c in counts.items()}, sizes[h], settings) for h in (0, 1)]
    parts.append(_lexicon({w: c.sum(0) for w, c in counts.items()}, sizes.sum(0), settings))
    rows = _forms(sample, [terms for terms, _ in parts], settings)
    weights = [
        _weights(rows, i, h, parts[i][1], settings) for i, h in enumerate(({0}, {1}, {0, 1}))
    ]
    x, y = [], []
    for row in rows:
        other = 1 - row["half"]  # the lexicon that has not seen the text
        x.append([_total(row, other, weights[other]), math.log1p(row["words"]), 1.0])
        y.append(row["toxic"])
    fit = _logistic(np.array(x), np.array(y, float))
    fit[0] = max(fit[0], 0.0)
    return Model(parts[2][0], weights[2], fit, settings)


# -- scoring --------------------------------------------------------------------------------------


def _scores(matcher: Matcher, model: Model, texts: list[bytes]) -> list[float]:
    out = []
    for text in texts:
        words = lower_words(text)
        hits = matcher.hits(words)
        total = 0.0
        if any(hits):
            total = total_weight(text, hits, model.weights, model.settings)
        out.append(model.probability(total, len(words)))
    return out


def _matcher(model: Model) -> Matcher:
    """The matcher of this worker; it lives on for later tasks."""
    key = ("toxicity", tuple(model.terms), model.settings)
    return worker.kept(key, lambda: Matcher(model.terms, model.settings))


def score(
    docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`doc_key`, `held_out`, `score`, `predicted` of each row."""
    settings = model.settings
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by `terms`
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        own = shared.value
        matcher = _matcher(own)
        for batch in batches:
            scores = _scores(matcher, own, batch.column(2).to_pylist())
            predicted = [int(s >= settings.threshold) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(scores, pa.float64()), pa.array(predicted, pa.int32())],
                ["doc_key", "held_out", "score", "predicted"],
            )

    held_out = fold(F.col(key), settings.folds) == settings.held_out_fold
    rows = docs.select(F.col(key).alias("doc_key"), held_out.alias("held_out"), utf8(text))
    return rows.mapInArrow(
        run, f"doc_key {kind}, held_out boolean, score double, predicted int"
    )


def kept(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, width = docs.columns, len(docs.columns)

    def run(batches):
        own = shared.value
        matcher = _matcher(own)
        for batch in batches:
            scores = np.array(_scores(matcher, own, batch.column(width).to_pylist()))
            clean = pa.array(scores < own.settings.threshold, pa.bool_())
            rows = pa.RecordBatch.from_arrays(batch.columns[:width], names)
            yield rows.filter(clean)

    data = docs.select(*(F.col(f"`{n}`") for n in names), utf8(text).alias("__utf8"))
    return data.mapInArrow(run, docs.schema)
