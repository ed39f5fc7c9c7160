"""Alignment of two tokenizers over a corpus, each distinct text once.

Rows are shuffled by their full text and counted; each distinct text is encoded by a byte-level BPE
(A, on a space and the text) and by a SentencePiece model (B, which adds that space itself). Offsets
where tokens of both end cut the tokens into groups, and the two tokens that end there are linked. A
pair of ids counts as often as rows link it. Measures go back to the rows by the SHA-256 of the text.

* A link's shorter token is the end of the longer one. So all pairs that can ever be linked follow
  from the vocabularies (`Pairs`: each token's endings that are tokens of the other side, some
  hundred thousand), and their counts are an array of that size. It is the only thing that goes
  through the driver, whatever the corpus holds.
* Both tokenizers break a text at a single space between characters that are not white space, so
  what lies between two such spaces (a chunk) has the same tokens, groups and links wherever it
  stands, and each worker keeps up to `CHUNKS` of them. `Tokenizers` reads from the files whether
  that holds: A must cut words by the byte-level rule without a normaliser, and no piece of B may
  have its space mark behind another character. Otherwise whole texts are encoded.
* A long text is worked through in portions cut at such spaces; its links are kept as counts of
  different pairs, so a row is never larger than the table of pairs.

Defined results: texts that are null or empty, or whose tokens do not give the space and the text
back (the space mark of B in a text, bytes that are no UTF-8), have no tokens: zeros, and '' instead
of a digest. Special tokens' strings are plain text. Rows that repeat each come back, and each
counts; a null id is an id like any other; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.worker import kept
from riskloom.operators.graph import join_by_node
from riskloom.operators.running import HOT_ROWS
from riskloom.sources.workspace import written

#: Chunks that a worker keeps, and the bytes of the longest among them.
CHUNKS = 400_000
CHUNK_BYTES = 200
#: New chunks that are encoded as one text.
TOGETHER = 64
#: Bytes of text worked on at once.
PORTION = 1_000_000
#: The mark that SentencePiece has for a space.
SPACE_MARK = "\u2581"

_ALIGNED = (
    "text_key binary, rows bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, pairs binary, times binary"
)


# -- vocabularies ---------------------------------------------------------------------------------


def _byte_of_letter() -> dict[str, int]:
    """Byte-level BPE writes each byte as a letter: printable ones as themselves, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Pairs:
    """All pairs of an A and a B token of which one ends with the other, numbered in order."""

    def __init__(self, a_bytes: list[bytes | None], b_bytes: list[bytes | None]):
        ids_a, ids_b = self._by_bytes(a_bytes), self._by_bytes(b_bytes)
        found = set()
        for longer, shorter, swap in ((ids_a, ids_b, False), (ids_b, ids_a, True)):
            for token, ids in longer.items():
                for cut in range(len(token)):
                    for other in shorter.get(token[cut:], ()):
                        found.update((other, i) if swap else (i, other) for i in ids)
        self.width = len(b_bytes)
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.a, self.b = pairs[:, 0], pairs[:, 1]
        self._keys = self.a * self.width + self.b

    @staticmethod
    def _by_bytes(tokens: list[bytes | None]) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {}
        for i, token in enumerate(tokens):
            if token:
                out.setdefault(token, []).append(i)
        return out

    def __len__(self) -> int:
        return len(self._keys)

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self._keys, a * self.width + b).astype("<i4")


class Tokenizers:
    """Both tokenizers, from the contents of their files."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        rules = json.loads(a_json)
        letters = _byte_of_letter()
        self.a_bytes: list[bytes | None] = [None] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in rules["model"]["vocab"].items():
            if all(c in letters for c in token):
                self.a_bytes[i] = bytes(letters[c] for c in token)
        self.b_bytes: list[bytes | None] = []
        marked = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i):
                self.b_bytes.append(None)
            else:
                self.b_bytes.append(piece.replace(SPACE_MARK, " ").encode())
                marked.append(piece)
        cut = rules.get("pre_tokenizer") or {}
        self.chunked = (
            rules.get("normalizer") is None
            and cut.get("type") == "ByteLevel"
            and bool(cut.get("use_regex"))
            and not cut.get("add_prefix_space")
            and not any(SPACE_MARK in piece.lstrip(SPACE_MARK) for piece in marked)
        )
        self.pairs = Pairs(self.a_bytes, self.b_bytes)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        spaced = [" " + text for text in texts]
        a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        return a, self.b.encode(texts, num_threads=1)


# -- alignment ------------------------------------------------------------------------------------


#: Groups as text, numbers of A and B tokens, and the pairs linked, one for each group. A chunk whose
#: tokens don't give a space and its text back has no tokens. Plain tuples need no garbage collection.
Chunk = tuple[bytes, int, int, bytes]

_BAD: Chunk = (b"", 0, 0, b"")


class Aligner:
    def __init__(self, a_json: str, b_model: bytes):
        self.tokens = Tokenizers(a_json, b_model)
        self.chunks: dict[bytes, Chunk] = {}
        self.spare: dict[bytes, Chunk] = {}
        a, b = self.tokens.a_bytes, self.tokens.b_bytes
        self._sizes_a = np.array([len(x or b"") for x in a])
        self._sizes_b = np.array([len(x or b"") for x in b])
        # A token's number, and what comes after it: inside and at the end of a side of a group.
        self._texts = [b"%d%s" % (i, end) for ids, ends in ((a, (b",", b"|")), (b, (b",", b";")))
                       for end in ends for i in range(len(ids))]

    def learn(self, keys: list[bytes]) -> list[Chunk]:
        """Some chunks together are encoded as one text; if it isn't given back, each by itself."""
        alone = [i for i, k in enumerate(keys) if not self.tokens.chunked or _open_ended(k)]
        own = set(alone)
        together = [i for i in range(len(keys)) if i not in own]
        units = [together[a : a + TOGETHER] for a in range(0, len(together), TOGETHER)]
        units += [[i] for i in alone]
        made = [_BAD] * len(keys)
        again = self._learn(keys, units, made)
        self._learn(keys, [[i] for unit in again if len(unit) > 1 for i in unit], made)
        return made

    def _learn(self, keys: list[bytes], units: list[list[int]], made: list[Chunk]) -> list[list[int]]:
        """Fills in the chunks of each unit, whose keys are one text; returns units that are not given back."""
        texts = [b" ".join([keys[i] for i in unit]) for unit in units]
        ids_a, ids_b = self.tokens.encode([t.decode("utf-8", "replace") for t in texts])
        a_bytes, b_bytes = self.tokens.a_bytes, self.tokens.b_bytes
        good, bad = [], []
        for n, (text, a, b) in enumerate(zip(texts, ids_a, ids_b)):
            fits = self._joined(a_bytes, a) == b" " + text == self._joined(b_bytes, b)
            (good if fits else bad).append(n)
        if good:
            places = [i for n in good for i in units[n]]
            sizes = np.fromiter((len(keys[i]) + 1 for i in places), np.int64, len(places))
            chunks = self._aligned([ids_a[n] for n in good], [ids_b[n] for n in good], sizes)
            for i, chunk in zip(places, chunks):
                made[i] = chunk
        return [units[n] for n in bad]

    @staticmethod
    def _joined(table: list[bytes | None], ids: list[int]) -> bytes | None:
        parts = [table[i] for i in ids]
        return None if None in parts else b"".join(parts)

    def _aligned(
        self, ids_a: list[list[int]], ids_b: list[list[int]], sizes: np.ndarray
    ) -> Iterator[Chunk]:
        """All chunks at once: they follow each other, with so many bytes each, and both sides end at
        the end of each."""
        a = np.fromiter(chain.from_iterable(ids_a), np.int64)
        b = np.fromiter(chain.from_iterable(ids_b), np.int64)
        ends_a, ends_b = np.cumsum(self._sizes_a[a]), np.cumsum(self._sizes_b[b])
        common, last_a, last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        del common
        pairs = self.tokens.pairs.numbers(a[last_a], b[last_b])
        # Each group is its A tokens, then its B tokens: place them, then write what each looks like.
        sizes_a, sizes_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        ends = np.cumsum(sizes_a + sizes_b)
        begins = ends - sizes_a - sizes_b
        place_a = np.arange(len(a)) + np.repeat(begins - (last_a + 1 - sizes_a), sizes_a)
        place_b = np.arange(len(b)) + np.repeat(ends - (last_b + 1), sizes_b)
        n_a, n_b = len(self._sizes_a), len(self._sizes_b)
        look = np.empty(len(a) + len(b), np.int64)
        look[place_a], look[place_b] = a, 2 * n_a + b
        look[place_a[last_a]] += n_a
        look[place_b[last_b]] += n_b
        looks = list(map(self._texts.__getitem__, look.tolist()))
        # Tokens and groups before the end of each chunk.
        at_a, at_b = (np.searchsorted(e, np.cumsum(sizes), side="right") for e in (ends_a, ends_b))
        counts_a, counts_b = np.diff(at_a, prepend=0), np.diff(at_b, prepend=0)
        group = np.searchsorted(last_a, at_a - 1, side="right")
        raw, first, at = pairs.tobytes(), 0, 0
        for g, x, y in zip(group.tolist(), counts_a.tolist(), counts_b.tolist()):
            end = at + x + y
            yield b"".join(looks[at:end])[:-1], x, y, raw[4 * first : 4 * g]
            first, at = g, end

    # -- texts ------------------------------------------------------------------------------------

    def found(self, texts: list[bytes]) -> list[list[Chunk]]:
        """The chunks of each text."""
        if len(self.spare) > CHUNKS // 4:
            self.spare.clear()
        find, chunked = self.chunks.get, self.tokens.chunked
        made, missed = [], []
        for i, text in enumerate(texts):
            keys = (text.split(b" ") if chunked else [text]) if text else []
            chunks = list(map(find, keys))
            new = [k for k, x in zip(keys, chunks) if x is None]
            if new and chunked and any(map(_open_ended, new)):  # a kept chunk is closed
                keys = _glued(keys)
                chunks = list(map(find, keys))
                new = [k for k, x in zip(keys, chunks) if x is None]
            if new:
                missed.append((i, keys, new))
            made.append(chunks)
        rest = self._rest({k for _, _, new in missed for k in new})
        for i, keys, _ in missed:
            made[i] = [rest[k] if x is None else x for k, x in zip(keys, made[i])]
        return made

    def _rest(self, keys: set[bytes]) -> dict[bytes, Chunk]:
        """Chunks that are not among the kept ones; as many as there is room for will be."""
        rest = {k: self.spare[k] for k in keys if k in self.spare}
        new = [k for k in keys if k not in rest]
        for begin, end in _portions(new):
            for key, chunk in zip(new[begin:end], self.learn(new[begin:end])):
                rest[key] = chunk
                # An open end is kept with its neighbours only: `found` takes a kept one for closed.
                if len(key) <= CHUNK_BYTES and not _open_ended(key):
                    (self.chunks if len(self.chunks) < CHUNKS else self.spare)[key] = chunk
        return rest

    def measured(self, text: bytes) -> tuple:
        """Measures of one text, and its pairs with how often it links them."""
        n_a, n_b, digest = 0, 0, hashlib.sha256()
        pairs: list[bytes] = []
        for i, part in enumerate(_slices(text) if self.tokens.chunked else [text]):
            (chunks,) = self.found([part])
            groups, of_a, of_b, links = zip(*chunks) if chunks else _NO_CHUNK
            if 0 in of_a:  # a chunk has no tokens, so the text has none
                return _NOTHING
            digest.update((b";" if i else b"") + b";".join(groups))
            n_a, n_b = n_a + sum(of_a), n_b + sum(of_b)
            pairs.append(b"".join(links))
        return (n_a, n_b, sum(map(len, pairs)) // 4, digest.hexdigest(), *_times(b"".join(pairs)))

    def measures(self, texts: list[bytes]) -> Iterator[tuple]:
        for chunks in self.found(texts):
            groups, n_a, n_b, links = zip(*chunks) if chunks else _NO_CHUNK
            if 0 in n_a:  # a chunk has no tokens, so the text has none
                yield _NOTHING
                continue
            pairs = b"".join(links)
            digest = hashlib.sha256(b";".join(groups)).hexdigest()
            yield sum(n_a), sum(n_b), len(pairs) // 4, digest, *_times(pairs)


_NO_CHUNK = tuple(zip(_BAD))
_NOTHING = (0, 0, 0, "", np.empty(0, "<i4"), np.empty(0, "<i8"))


def _times(links: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of packed links, and how often each is there."""
    pairs = np.sort(np.frombuffer(links, "<i4"))
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    return pairs[first], np.diff(first, append=len(pairs)).astype("<i8")


def _ends(piece: bytes) -> tuple[bool, bool]:
    """Whether a piece belongs to what is before and after it: it is empty, begins or ends with
    white space, or with bytes that are no character."""
    text = piece.decode("utf-8", "replace")
    if not text:
        return True, True
    return _loose(text[0]), _loose(text[-1])


def _loose(char: str) -> bool:
    return char.isspace() or char in "\u180e\u2581\ufffd"


def _open_ended(piece: bytes) -> bool:
    if piece and 32 < piece[0] < 127 and 32 < piece[-1] < 127:  # printable ASCII, as most
        return False
    return any(_ends(piece))


def _glued(pieces: list[bytes]) -> list[bytes]:
    """What lies between spaces, with its neighbours at open ends."""
    made: list[bytes] = []
    glued = False
    for piece in pieces:
        before, after = _ends(piece)
        if made and (glued or before):
            made[-1] += b" " + piece
        else:
            made.append(piece)
        glued = after
    return made


def _portions(keys: list[bytes]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, key in enumerate(keys):
        if i > begin and (size + len(key) > PORTION or i - begin == 20_000):
            yield begin, i
            begin, size = i, 0
        size += len(key)
    if begin < len(keys):
        yield begin, len(keys)


def _slices(text: bytes) -> Iterator[bytes]:
    """A long text cut at single spaces between ASCII letters or digits; the space goes."""
    begin = 0
    while len(text) - begin > PORTION:
        at = text.find(b" ", begin + PORTION)
        while at >= 0 and not (text[at - 1 : at].isalnum() and text[at + 1 : at + 2].isalnum()):
            at = text.find(b" ", at + 1)
        if at < 0:
            break
        yield text[begin:at]
        begin = at + 1
    yield text[begin:]


# -- tables ---------------------------------------------------------------------------------------


def _body(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def _text_key(body: Column) -> Column:
    return F.unhex(F.sha2(body.cast("binary"), 256))


def _aligner(a_json: str, b_model: bytes) -> Aligner:
    key = ("token_alignment", zlib.crc32(a_json.encode()), zlib.crc32(b_model))
    return kept(key, lambda: Aligner(a_json, b_model))


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """Each distinct text once: its key, the rows that have it, its measures and pairs (lazy)."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((_read(a_path).decode(), _read(b_path)))  # of the size of vocabularies

    def run(batches):
        aligner = _aligner(*shared.value)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            rows: list[tuple] = []
            begin = 0
            while begin < len(texts):
                if len(texts[begin]) > PORTION:
                    rows.append(aligner.measured(texts[begin]))
                    begin += 1
                    continue
                end, size = begin, 0
                while end < len(texts) and size + len(texts[end]) <= PORTION:
                    size += len(texts[end]) + 1
                    end += 1
                rows.extend(aligner.measures(texts[begin:end]))
                begin = end
            if not rows:
                continue
            a, b, groups, digests, pairs, times = zip(*rows)
            groups = pa.array(groups, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    batch.column(2),
                    pa.array(a, pa.int64()),
                    pa.array(b, pa.int64()),
                    groups,
                    groups,  # one pair of tokens ends at the end of each group
                    pa.array(digests),
                    pa.array([p.tobytes() for p in pairs], pa.binary()),
                    pa.array([t.tobytes() for t in times], pa.binary()),
                ],
                ["text_key", "rows", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs",
                 "times"],
            )

    distinct = docs.select(_body(text).alias("body")).groupBy("body").agg(F.count(F.lit(1)).alias("rows"))
    body = F.col("body")
    return distinct.select(body.cast("binary").alias("body"), _text_key(body).alias("text_key"), "rows").mapInArrow(
        run, _ALIGNED
    )


def pair_counts(texts: DataFrame, n_pairs: int) -> DataFrame:
    """`pair`, `count`: how many links of all rows are of each pair. A task adds up its own first."""

    def run(batches):
        counts = np.zeros(n_pairs, np.int64)
        for batch in batches:
            for rows, pairs, times in zip(*(batch.column(i) for i in range(3))):
                counts[np.frombuffer(pairs.as_py(), "<i4")] += np.frombuffer(times.as_py(), "<i8") * rows.as_py()
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int64)), pa.array(counts[found])], ["pair", "count"]
        )

    own = texts.select("rows", "pairs", "times").mapInArrow(run, "pair bigint, count bigint")
    return own.groupBy("pair").agg(F.sum("count").cast("bigint").alias("count"))


@dataclass(frozen=True)
class Alignment:
    """Measures of each distinct text, and the pairs of ids with their counts."""

    texts: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> Alignment:
    """Align all rows. `pairs` has `a_id`, `b_id`, `count`, `best` (none of its B id's pairs counts
    more); `texts` has `text_key`, `rows`, the measures, `n_best` and `count_sum`."""
    spark = docs.sparkSession
    stored, _ = written(aligned(docs, a_path, b_path, text), "token-alignment")
    possible = Tokenizers(_read(a_path).decode(), _read(b_path)).pairs
    counts = np.zeros(len(possible), np.int64)
    seen = pair_counts(stored, len(possible)).toArrow()  # no more rows than possible pairs
    counts[seen["pair"].to_numpy()] = seen["count"].to_numpy()
    highest = np.zeros(possible.width, np.int64)
    np.maximum.at(highest, possible.b, counts)
    best = counts == highest[possible.b]
    shared = spark.sparkContext.broadcast((counts, best))

    def run(batches):
        count, best = shared.value
        for batch in batches:
            n_best, sums = [], []
            for pairs, times in zip(batch.column(6), batch.column(7)):
                at = np.frombuffer(pairs.as_py(), "<i4")
                often = np.frombuffer(times.as_py(), "<i8")
                n_best.append(int(often[best[at]].sum()))
                sums.append(int((often * count[at]).sum()))
            arrays = [batch.column(i) for i in (0, 1, 2, 3, 4, 5, 8)]
            arrays += [pa.array(n_best, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["text_key", "rows", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    measured = stored.select(
        "text_key", "rows", "n_a", "n_b", "n_groups", "n_links", "pairs", "times", "groups_sha256"
    ).mapInArrow(
        run,
        "text_key binary, rows bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
        "groups_sha256 string, n_best bigint, count_sum bigint",
    )
    seen = np.flatnonzero(counts)
    table = pa.table(
        {
            "a_id": possible.a[seen],
            "b_id": possible.b[seen],
            "count": counts[seen],
            "best": best[seen],
        }
    )
    return Alignment(measured, spark.createDataFrame(table))


def measures(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    key: str = "doc_id",
    text: str = "text",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """`doc_key` and the measures of each row. A text in more than `hot_rows` rows is broadcast (there
    are at most rows / `hot_rows` of them), so its rows stay where they are."""
    texts, _ = written(align(docs, a_path, b_path, text).texts, "token-alignment-texts")
    rows = docs.select(F.col(key).alias("doc_key"), _text_key(_body(text)).alias("a"))
    nodes = texts.withColumnsRenamed({"text_key": "a", "rows": "n"})
    return join_by_node(rows, nodes, hot_rows).select(
        "doc_key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
