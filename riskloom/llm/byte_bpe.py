"""Byte-level BPE by recursive DuckDB queries, one small in-memory database for each Python worker.

`encode`, `decode` and `round_trip` go through whole texts, partition by partition, without a
shuffle. A text is cut into the pieces the pattern gives. A piece that is no token itself becomes
a row with the list of its tokens. Each step of a recursive query joins the neighbours in the lists
with the merge table, and contracts the leftmost pair of least rank of every piece, until no pair of
it can be merged. Decoding joins ids with the vocabulary and puts the bytes together by an ordered
aggregation.

The same pieces come again and again, so each worker keeps what it has worked out lately, up to
`entries` entries of `CACHE_LENGTH` at most. That changes the time only. After stages with several
Python steps an executor has more workers than cores, and each gets tasks in turn: a job of such
stages asks for `FEW_ENTRIES`. Pieces over `LONG_PIECE`
bytes, of which a step would contract one pair out of very many, follow the same rule with a heap.

Defined results: null text is empty; an empty text has no ids; rows that repeat are all answered;
null ids in `keep` columns pass through; other columns of the input are left out.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.rows import to_bytes, to_str, utf8
from riskloom.llm.worker import kept, release_memory

#: Entries of a generation of a table that a worker keeps, and characters or bytes of a key.
CACHE_ENTRIES = 250_000
FEW_ENTRIES = 100_000
CACHE_LENGTH = 64
LONG_PIECE = 300
#: Texts over so many characters are cut by the pattern, a portion at a time.
LONG_TEXT = 2_000_000
#: Bytes of texts, pieces of a long text, bytes of new pieces and new runs that are taken together.
AT_ONCE = 1_000_000
PIECES_AT_ONCE = 100_000
BYTES_AT_ONCE = 400_000
RUNS_AT_ONCE = 25_000

_ENCODE = """
with recursive t as (
  select piece, toks, false as done from start
  union all
  (with pairs as (
     select piece, unnest(range(1, len(toks) + 1)) as pos,
            unnest(toks) as tok, unnest(toks[2:]) as ntok from t where not done),
   least_pair as (
     select piece, min((merged::bigint << 32) | pos) as best
     from pairs join merges m on m.pair = ((tok::bigint << 32) | ntok) group by piece),
   rated as (
     select t.piece, toks, best, best & 4294967295 as place
     from t left join least_pair using (piece) where not done)
   select piece, case when best is null then toks
                      else toks[:place - 1] || [(best >> 32)::int] || toks[place + 2:] end, best is null
   from rated)
)
select piece, unnest(toks) as tok from (select * from t where done order by piece)
"""

_DECODE = """
select run, string_agg(bytes, '' order by pos) as bytes
from ids join vocab using (tok) group by run order by run
"""


def read_ranks(path: str) -> bytes:
    """The rank file, for a broadcast: its size is that of a vocabulary."""
    with open(path, "rb") as file:
        return file.read()


class Recent:
    """What has been worked out lately. A new entry is in `once`; if it is asked for again, it goes to
    `now`, and stays there or in `before`, the generation before it, as long as it is used. Each of
    the three has up to `entries` entries."""

    def __init__(self, entries: int):
        self.entries = entries
        self.once: dict = {}
        self.now: dict = {}
        self.before: dict = {}

    def find(self, keys) -> dict:
        """What is kept of these keys, by key."""
        found: dict = {}
        now, before, pop = self.now, self.before, self.once.pop
        for key in keys:
            value = now.get(key)
            if value is None:
                value = before.get(key) or pop(key, None)
                if value is None:
                    continue
                if len(now) >= self.entries:
                    self.before, self.now = before, now = now, {}
                now[key] = value
            found[key] = value
        return found

    def put(self, entries) -> None:
        once = self.once
        for key, value in entries:
            if len(key) <= CACHE_LENGTH:
                if len(once) >= self.entries:
                    once = self.once = {}
                once[key] = value


class Coder:
    """Encoder and decoder of one worker."""

    def __init__(self, rank_file: bytes, pattern: str, entries: int | None = None):
        import duckdb

        lines = (line.split() for line in rank_file.splitlines() if line.strip())
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.pattern = regex.compile(pattern)
        self.dtype = np.dtype("<u4" if max(self.ranks.values()) > 0xFFFF else "<u2")
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        pairs = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "150MB"})
        # Byte strings travel as text, one character for each byte.
        names = {
            "merge_rows": pa.table({"pair": pairs, "merged": np.array(merged, np.int32)}),
            "vocab_rows": pa.table(
                {
                    "tok": np.array(list(self.ranks.values()), np.int32),
                    "bytes": [t.decode("latin-1") for t in self.ranks],
                }
            ),
        }
        for table, rows in (("merges", "merge_rows"), ("vocab", "vocab_rows")):
            self.db.register(rows, names[rows])
            self.db.execute(f"create table {table} as select * from {rows}")
            self.db.unregister(rows)
        self.valid = np.zeros(max(self.ranks.values()) + 1, bool)
        self.valid[list(self.ranks.values())] = True
        self.spaced = np.zeros(len(self.valid), bool)
        self.spaced[[r for t, r in self.ranks.items() if t[:1] == b" "]] = True
        #: Chunks by the text after the space before them; the first chunk of a text, which has no
        #: space before it, under its text with a space.
        self.entries = entries or CACHE_ENTRIES
        self.chunks = Recent(self.entries)
        self.pieces = Recent(self.entries)
        self.runs: dict[int, Recent] = {}

    # -- encoding ---------------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [self.packed(parts) for parts in self.encode_parts(texts)]

    def packed(self, parts: list[bytes]) -> bytes:
        return np.frombuffer(b"".join(parts), self.dtype).astype("<u4").tobytes()

    def encode_parts(self, texts: list[str]) -> list[list[bytes]]:
        """Ids of each text, in parts, as integers of `dtype`.

        The pattern cuts before a single space, unless more white space follows it. So most texts
        are cut there, which is fast, and the others by the pattern.
        """
        out: list[list[bytes] | None] = []
        missed = {}
        find = self.chunks.now.get
        for i, text in enumerate(texts):
            ids = None
            if len(text) <= LONG_TEXT and "  " not in text and text[-1:] != " ":
                chunks = text.split(" ")
                chunks[0] = " " + chunks[0]
                ids = list(map(find, chunks))
                if None in ids:
                    missed[i] = chunks
            out.append(ids)
        new = {c for i, chunks in missed.items() for c, x in zip(chunks, out[i]) if x is None}
        made = self._learn(new).get
        for i, chunks in missed.items():
            out[i] = [made(c) if x is None else x for c, x in zip(chunks, out[i])]
        return [
            list(self._by_pattern(text)) if ids is None or None in ids else ids
            for text, ids in zip(texts, out)
        ]

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks; one that starts with white space has none, as it can't stand alone."""
        made = self.chunks.find(chunks)
        cut, words = {}, set()
        for chunk in chunks - made.keys():
            if chunk.isalpha():
                words.add(" " + chunk)
            elif chunk[:1] == " ":
                cut[chunk] = self.pattern.findall(chunk[1:])
            elif chunk and not chunk[0].isspace():
                cut[chunk] = self.pattern.findall(" " + chunk)
        found = self._merged({p for parts in cut.values() for p in parts} - words, words)
        made.update((word[1:], found[word]) for word in words)
        whole = {c: b"".join([found[p] for p in parts]) for c, parts in cut.items()}
        self.chunks.put(whole.items())
        made.update(whole)
        return made

    def _by_pattern(self, text: str) -> Iterator[bytes]:
        found = self.pattern.finditer(text)
        while part := [m.group() for m in islice(found, PIECES_AT_ONCE)]:
            made = self._merged(set(part))
            yield from map(made.__getitem__, part)

    def _merged(self, pieces: set[str], new: set[str] = frozenset()) -> dict[str, bytes]:
        """Ids of pieces of the pattern, and of `new` words, which are known not to be kept; a word
        after a space is a chunk, too."""
        words = {p for p in pieces if _is_word(p)}
        made = {" " + word: ids for word, ids in self.chunks.find([p[1:] for p in words]).items()}
        made.update(self.pieces.find(pieces - words))
        fresh, long, batch, size = {}, {}, [], 0
        for piece in chain(pieces - made.keys(), new):
            data = to_bytes(piece)
            rank = self.ranks.get(data)
            if rank is not None:
                fresh[piece] = rank.to_bytes(self.dtype.itemsize, "little")
            elif len(data) > LONG_PIECE:
                long[piece] = np.array(self._by_heap(data), self.dtype).tobytes()
            else:
                batch.append((piece, data))
                size += len(data)
                if size > BYTES_AT_ONCE:
                    fresh.update(self._recursive(batch))
                    batch, size = [], 0
        if batch:
            fresh.update(self._recursive(batch))
        others = fresh.keys() - words - new
        self.pieces.put((p, fresh[p]) for p in others)
        self.chunks.put((p[1:], ids) for p, ids in fresh.items() if p not in others)
        return made | fresh | long

    def _recursive(self, batch: list[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
        lens = np.fromiter((len(d) for _, d in batch), np.int32, len(batch))
        data = np.frombuffer(b"".join([d for _, d in batch]), np.uint8)
        ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
        toks = pa.ListArray.from_arrays(ends, self.byte_ids[data])
        self.db.register("start", pa.table({"piece": np.arange(len(batch), dtype=np.int32), "toks": toks}))
        rows = self.db.execute(_ENCODE).fetchnumpy()
        self.db.unregister("start")
        ids = np.asarray(rows["tok"]).astype(self.dtype).tobytes()
        ends = np.cumsum(np.bincount(np.asarray(rows["piece"]), minlength=len(batch)))
        ends = (ends * self.dtype.itemsize).tolist()
        return ((piece, ids[a:b]) for (piece, _), a, b in zip(batch, [0, *ends], ends))

    def _by_heap(self, data: bytes) -> list[int]:
        """The same rule for a long piece: least rank first, leftmost of equals."""
        tokens: list[bytes | None] = [data[i : i + 1] for i in range(len(data))]
        after = list(range(1, len(data) + 1))
        before = list(range(-1, len(data) - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(data):
                rank = self.ranks.get(tokens[i] + tokens[after[i]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, len(tokens[i]), len(tokens[after[i]])))

        for i in range(len(data) - 1):
            offer(i)
        while heap:
            _, i, own, other = heapq.heappop(heap)
            j = after[i]
            if tokens[i] is None or len(tokens[i]) != own or j >= len(data) or len(tokens[j]) != other:
                continue  # one of the two has been merged since
            tokens[i], tokens[j] = tokens[i] + tokens[j], None
            after[i] = after[j]
            if after[i] < len(data):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [self.ranks[t] for t in tokens if t is not None]

    # -- decoding ---------------------------------------------------------------------------------

    def decode(self, blobs: list[bytes]) -> list[bytes]:
        """The bytes that packed 32-bit ids stand for."""
        return self.decode_parts([self._runs(b) for b in blobs], np.dtype("<u4"))

    def decode_parts(self, texts: list[list[bytes]], dtype: np.dtype) -> list[bytes]:
        """The same for ids in parts; each distinct part goes through the query once."""
        runs = self.runs.setdefault(dtype.itemsize, Recent(self.entries))
        made = [list(map(runs.now.get, parts)) for parts in texts]
        missed = [i for i, x in enumerate(made) if None in x]
        wanted = {p for i in missed for p, x in zip(texts[i], made[i]) if x is None and p}
        found = runs.find(wanted)
        new = [run for run in wanted if run not in found]
        found[b""] = b""
        for begin in range(0, len(new), RUNS_AT_ONCE):
            fresh = self._ordered(new[begin : begin + RUNS_AT_ONCE], dtype)
            found.update(fresh)
            runs.put(fresh.items())
        for i in missed:
            made[i] = [found[p] if x is None else x for p, x in zip(texts[i], made[i])]
        return [b"".join(x) for x in made]

    def _runs(self, blob: bytes) -> list[bytes]:
        """Ids cut before tokens that start with a space, and every 64: the same runs recur."""
        ids = np.frombuffer(blob, "<u4")
        if len(ids) and (ids.max() >= len(self.valid) or not self.valid[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        cuts = np.flatnonzero(self.spaced[ids])
        if len(ids) > 64 and np.diff(cuts, prepend=0, append=len(ids)).max() > 64:
            cuts = np.union1d(cuts, np.arange(0, len(ids), 64))
        ends = (cuts * 4).tolist()
        return [blob[a:b] for a, b in zip([0, *ends], [*ends, len(blob)]) if a < b]

    def _ordered(self, runs: list[bytes], dtype: np.dtype) -> dict[bytes, bytes]:
        lens = np.fromiter((len(r) // dtype.itemsize for r in runs), np.int64, len(runs))
        flat = np.frombuffer(b"".join(runs), dtype).astype(np.int32)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        run = np.repeat(np.arange(len(runs), dtype=np.int32), lens)
        self.db.register("ids", pa.table({"run": run, "pos": pos.astype(np.int32), "tok": flat}))
        rows = self.db.execute(_DECODE).fetchnumpy()["bytes"].tolist()
        self.db.unregister("ids")
        return {ids: text.encode("latin-1") for ids, text in zip(runs, rows)}


def _is_word(piece: str) -> bool:
    return piece[0] == " " and piece[1:].isalpha()


def coder(rank_file: bytes, pattern: str, entries: int | None = None) -> Coder:
    """The coder of this worker; it lives on for later tasks."""
    key = ("byte_bpe", hashlib.sha256(rank_file + pattern.encode()).hexdigest(), entries)
    return kept(key, lambda: Coder(rank_file, pattern, entries))


def _portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `AT_ONCE` bytes; a longer row has a range of its own."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > AT_ONCE:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _mapped(
    df: DataFrame, keep, column, rank_path, pattern, work, kinds: str, entries: int | None = None
) -> DataFrame:
    """`work(coder, values)` gives a list of columns; `kinds` are their names and types."""
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(rank_path))
    fields = df.select(*keep).schema
    names = [part.split()[0] for part in kinds.split(", ")]

    def run(batches):
        own = coder(ranks.value, pattern, entries)
        for batch in batches:
            values = batch.column(len(keep))
            for a, b in _portions(pc.binary_length(values).to_pylist()):
                made = work(own, values.slice(a, b - a).to_pylist())
                left = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*left, *made], [*keep, *names])
                made = None
            release_memory()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), kinds])
    return df.select(*keep, column).mapInArrow(run, schema)


def _packed(ids: list[bytes]) -> list[pa.Array]:
    return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]


def encode(
    docs: DataFrame, rank_path: str, pattern: str, text: str = "text", keep: tuple = ("doc_id",)
) -> DataFrame:
    """`keep`, `ids` (little-endian unsigned 32-bit integers), `n_tokens`, for each row."""

    def work(own: Coder, values):
        return _packed(own.encode([to_str(v) for v in values]))

    kinds = "ids binary, n_tokens bigint"
    return _mapped(docs, keep, utf8(text), rank_path, pattern, work, kinds)


def decode(
    encoded: DataFrame, rank_path: str, pattern: str, ids: str = "ids", keep: tuple = ("doc_id",)
) -> DataFrame:
    """`keep` and `decoded`, the bytes of each row's ids; null ids are none."""

    def work(own: Coder, values):
        return [pa.array(own.decode(values), pa.binary())]

    blob = F.coalesce(F.col(ids), F.lit(b""))
    return _mapped(encoded, keep, blob, rank_path, pattern, work, "decoded binary")


def round_trip(
    docs: DataFrame,
    rank_path: str,
    pattern: str,
    text: str = "text",
    keep: tuple = ("doc_id",),
    entries: int | None = None,
) -> DataFrame:
    """`encode`, then `decode` of its ids, in one pass: `keep`, `ids`, `n_tokens`, `decoded`."""

    def work(own: Coder, values):
        parts = own.encode_parts([to_str(v) for v in values])
        decoded = own.decode_parts(parts, own.dtype)
        ids = [own.packed(p) for p in parts]
        return [*_packed(ids), pa.array(decoded, pa.binary())]

    kinds = "ids binary, n_tokens bigint, decoded binary"
    return _mapped(docs, keep, utf8(text), rank_path, pattern, work, kinds, entries)
