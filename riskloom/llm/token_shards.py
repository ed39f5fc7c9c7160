"""Token ids in binary shards, with a minimal perfect hash index from document keys to their place.

A shard is a file of raw ids, little-endian unsigned integers of two bytes (four if the vocabulary
needs them), of consecutive documents in ascending order of the key; a second file has where each
row of the shard begins. Rows are range-partitioned by key, and each task encodes its range and
writes one shard, under a name of its own that is then moved to the final one: a task that runs
again, or twice, leaves the same file. `pyarrow.fs` opens the shared folder, whatever it is.

The index is made of buckets of about `BUCKET_KEYS` keys, by hash, each built in a task of its own:
hash and displace gives every key of a bucket its own slot, without gaps, from one displacement for
about four keys. A slot has a fingerprint of its key, the shard, the first row in it and the number
of rows. Looking a key up takes its bucket's displacement and slot, whatever the number of keys; keys
that were never stored are told by the fingerprint but for one in 2**32.

Encoding uses the tokenizers library. A normaliser and pre-tokeniser that drop white space treat
the words of a text on their own, so each worker keeps the ids of up to `CACHE_ENTRIES` words.

Defined results: null text is empty and has the end id alone; a null key is a key of its own, before
all others; rows with the same key stand next to one another in one shard, ordered by text, and all
come back; an empty table has no shards, and nothing is found in it; other columns are left out.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.rows import to_str, utf8
from riskloom.llm.worker import kept
from riskloom.sources.workspace import fresh_path

CACHE_ENTRIES = 800_000
BUCKET_KEYS = 20_000
KEYS_PER_DISPLACEMENT = 4
#: Marks behind a word that the tokenizer takes apart from its letters.
MARKS = b".,!?;:*&%#$@+=~^"
_SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("first", "<u4"), ("rows", "<u4")])


# -- encoding -------------------------------------------------------------------------------------


class WordEncoder:
    """Ids of texts from ids of words, for tokenizers that drop white space."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 0x10000
        self.dtype = np.dtype("<u4" if wide else "<u2")
        #: Which ids end a piece of the text, if the model marks them.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.words: dict[bytes, bytes] = {}
        self.spare: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of `dtype` for each text, without an end."""
        if len(self.spare) > CACHE_ENTRIES // 4:
            self.spare.clear()
        find = self.words.get
        cut = [text.split() for text in texts]
        ids = [list(map(find, words)) for words in cut]
        missed = [i for i, x in enumerate(ids) if None in x]
        new = set().union(*[cut[i] for i in missed]).difference(self.words)
        found = self._learn(new)
        for i in missed:
            ids[i] = [found[w] if x is None else x for w, x in zip(cut[i], ids[i])]
        return [b"".join(x) for x in ids]

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of all these words, which are kept as far as there is room.

        Words in ASCII go through in lower case, with marks after their letters apart. The tokenizer
        puts letters in lower case and cuts between letters and marks. An apostrophe or a bracket of
        a special token is no such mark, so these words go through whole.
        """
        spare = self.spare
        found = {w: spare[w] for w in words if w in spare} if spare else {}
        split, letters, others = {}, set(), set()
        for word in words.difference(found):
            plain = word.isascii()
            low = word.lower() if plain and b"<|" not in word else word
            stem = low.rstrip(MARKS)
            if stem.isalpha() if plain else _letters(to_str(stem)):
                letters.add(stem)
                tail = low[len(stem) :]
                if tail:
                    others.add(tail)
                    split[word] = (stem, tail)
                elif low != word:
                    split[word] = (stem,)
            else:
                others.add(low)
                if low != word:
                    split[word] = (low,)
        for pieces, encode in ((letters, self._encode_letters), (others, self._encode_each)):
            new = []
            for piece in pieces:
                ids = self.words.get(piece)
                if ids is None:
                    ids = spare.get(piece)
                if ids is None:
                    new.append(piece)
                else:
                    found[piece] = ids
            for begin in range(0, len(new), 20_000):
                portion = new[begin : begin + 20_000]
                for piece, ids in zip(portion, encode(portion)):
                    found[piece] = ids
                    self._keep(piece, ids)
        for word, parts in split.items():
            ids = found[parts[0]] + found[parts[1]] if len(parts) > 1 else found[parts[0]]
            found[word] = ids
            self._keep(word, ids)
        return found

    def _encode_letters(self, words: list[bytes]) -> list[bytes]:
        """Words of letters go through as one text, which is cut behind the ids that end a word.

        Each has one end at least, so as many ends as words are one each; else the words go in halves.
        """
        if len(words) == 1:
            return self._encode_each(words)
        text = b" ".join(words).decode("utf-8", "replace")
        made = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        ids = np.array(made.ids, self.dtype)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            half = len(words) // 2
            return self._encode_letters(words[:half]) + self._encode_letters(words[half:])
        packed, ends = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def _encode_each(self, words: list[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(
            [w.decode("utf-8", "replace") for w in words], add_special_tokens=False
        )
        return [np.array(made.ids, self.dtype).tobytes() for made in encoded]

    def _keep(self, word: bytes, ids: bytes) -> None:
        (self.words if len(self.words) < CACHE_ENTRIES else self.spare)[word] = ids


def _letters(word: str) -> bool:
    """Whether it is letters, and stays so in lower case."""
    return word.isalpha() and word.lower().isalpha()


def _encoder(tokenizer_json: str) -> WordEncoder:
    """The encoder of this worker; it lives on for later tasks."""
    key = ("token_shards", zlib.crc32(tokenizer_json.encode()))
    return kept(key, lambda: WordEncoder(tokenizer_json))


# -- shards ---------------------------------------------------------------------------------------


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _key(name: str) -> Column:
    return F.col(name).cast("string")


def write_shards(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    shards: int | None = None,
) -> None:
    """Shards of all rows below `folder`, and tables of their rows and sizes."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())  # of the size of a vocabulary
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        encoder = _encoder(shared.value)
        end = np.array([end_id], encoder.dtype).tobytes()
        task = TaskContext.get()
        shard, files, base = task.partitionId(), None, ""
        begins, at = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                files, root = _open(folder)
                files.create_dir(root, recursive=True)
                base = f"{root}/shard-{shard:06d}"
                own = f"{base}-{task.attemptNumber()}-{uuid.uuid4().hex}"
                out = files.open_output_stream(f"{own}.bin")
            texts, sizes = batch.column(1).to_pylist(), []
            first, begin = len(begins), 0
            while begin < len(texts):
                stop, size = begin, 0
                while stop < len(texts) and (not size or size + len(texts[stop]) < 2_000_000):
                    size += len(texts[stop]) + 1
                    stop += 1
                for ids in encoder.encode(texts[begin:stop]):
                    out.write(ids + end)
                    begins.append(at)
                    sizes.append(len(ids + end) // encoder.dtype.itemsize)
                    at += sizes[-1]
                begin = stop
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(batch.num_rows, shard, np.int64)),
                    pa.array(np.arange(first, len(begins), dtype=np.int64)),
                    pa.array(sizes, pa.int64()),
                ],
                ["doc_key", "shard", "row", "n_tokens"],
            )
        if files is not None:
            out.close()
            with files.open_output_stream(f"{own}.idx") as index:
                index.write(np.array([*begins, at], "<u8").tobytes())
            for kind in ("bin", "idx"):
                files.move(f"{own}.{kind}", f"{base}.{kind}")

    in_order = (
        docs.select(F.col(key).alias("doc_key"), utf8(text).alias("text"))
        .repartitionByRange(n, "doc_key")
        .sortWithinPartitions("doc_key", "text")
    )
    rows = in_order.mapInArrow(
        run, f"doc_key {key_type}, shard bigint, row bigint, n_tokens bigint"
    )
    rows.write.parquet(f"{folder}/rows")


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """`shard` and the number of ids before it; one row for each shard."""
    rows = spark.read.parquet(f"{folder}/rows")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total")).collect()
    out, before = [], 0
    for shard, total in sorted(map(tuple, totals)):
        out.append((shard, before))
        before += total
    return spark.createDataFrame(out, "shard bigint, shard_start bigint")


# -- index ----------------------------------------------------------------------------------------


def _mix(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """64 mixed bits of each key hash and seed."""
    with np.errstate(over="ignore"):
        z = x + (np.asarray(seed, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def perfect_hash(hashes: np.ndarray) -> np.ndarray:
    """Displacements that give distinct key hashes the slots 0 to n-1, one each."""
    n = len(hashes)
    groups = max(1, -(-n // KEYS_PER_DISPLACEMENT))
    group = (_mix(hashes, 1 << 40) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=groups)
    ends = np.cumsum(sizes)
    taken = np.zeros(n, bool)
    out = np.zeros(groups, np.uint32)
    tries = np.arange(256, dtype=np.uint64)
    for g in np.argsort(-sizes, kind="stable"):
        if not sizes[g]:
            break
        keys = hashes[order[ends[g] - sizes[g] : ends[g]]]
        base = 0
        while True:
            seeds = tries + np.uint64(base)
            slots = (_mix(keys[None], seeds[:, None]) % np.uint64(n)).astype(np.int64)
            free = ~taken[slots].any(1)
            if len(keys) > 1:
                ranked = np.sort(slots, 1)
                free &= (ranked[:, 1:] != ranked[:, :-1]).all(1)
            if free.any():
                pick = int(free.argmax())
                out[g] = base + pick
                taken[slots[pick]] = True
                break
            base += len(tries)
    return out


def slots_of(hashes: np.ndarray, displacements: np.ndarray, n: int) -> np.ndarray:
    groups = np.uint64(len(displacements))
    group = (_mix(hashes, 1 << 40) % groups).astype(np.int64)
    return (_mix(hashes, displacements[group]) % np.uint64(n)).astype(np.int64)


def _hashed(df: DataFrame, buckets: int) -> DataFrame:
    """Two hashes of each key: one for its bucket and print, one for its slot."""
    key = F.coalesce(F.concat(F.lit("="), _key("doc_key")), F.lit(""))
    return df.withColumns(
        {
            "key_hash": F.xxhash64(key),
            "key_print": F.crc32(key.cast("binary")),
            "bucket": F.pmod(F.hash(key), F.lit(buckets)),
        }
    )


def build_index(spark: SparkSession, folder: str) -> None:
    """The index of all keys in `rows`, a row for each bucket."""
    rows = spark.read.parquet(f"{folder}/rows")
    keys = rows.groupBy("doc_key").agg(
        F.min("shard").alias("shard"), F.min("row").alias("first"), F.count("*").alias("n_rows")
    )
    buckets = max(1, -(-rows.count() // BUCKET_KEYS))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        hashes = frame["key_hash"].to_numpy().view(np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two keys of a bucket have the same 64-bit hash")
        displacements = perfect_hash(hashes)
        table = np.zeros(len(hashes), _SLOT)
        slots = slots_of(hashes, displacements, len(hashes))
        table["print"][slots] = frame["key_print"]
        table["shard"][slots] = frame["shard"]
        table["first"][slots] = frame["first"]
        table["rows"][slots] = frame["n_rows"]
        return pd.DataFrame(
            {
                "bucket": [frame["bucket"].iloc[0]],
                "n": [len(hashes)],
                "displacements": [displacements.astype("<u4").tobytes()],
                "slots": [table.tobytes()],
            }
        )

    index = (
        _hashed(keys, buckets)
        .groupBy("bucket")
        .applyInPandas(build, "bucket int, n bigint, displacements binary, slots binary")
    )
    index.withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/index")


def lookup(keys: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """`doc_key`, `shard`, `first`, `n_rows` of each key that the index knows."""
    spark = keys.sparkSession
    index = spark.read.parquet(f"{folder}/index")
    some = index.select("buckets").first()
    asked = _hashed(keys.select(F.col(key).alias("doc_key")), some["buckets"] if some else 1)
    key_type = asked.schema["doc_key"].dataType.simpleString()
    names = ["doc_key", "shard", "first", "n_rows"]

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right) or not len(left):
            return pd.DataFrame({n: [] for n in names})
        table = np.frombuffer(right["slots"].iloc[0], _SLOT)
        displacements = np.frombuffer(right["displacements"].iloc[0], "<u4")
        hashes = left["key_hash"].to_numpy().view(np.uint64)
        at = table[slots_of(hashes, displacements, len(table))]
        hit = at["print"] == left["key_print"].to_numpy()
        return pd.DataFrame(
            {
                "doc_key": left["doc_key"].to_numpy()[hit],
                "shard": at["shard"][hit].astype(np.int64),
                "first": at["first"][hit].astype(np.int64),
                "n_rows": at["rows"][hit].astype(np.int64),
            }
        )

    # Keys travel as text, as pandas has no integers beside nulls.
    found = (
        asked.withColumn("doc_key", F.col("doc_key").cast("string"))
        .groupBy("bucket")
        .cogroup(index.groupBy("bucket"))
        .applyInPandas(find, "doc_key string, shard bigint, first bigint, n_rows bigint")
    )
    return found.withColumn("doc_key", F.col("doc_key").cast(key_type))


def read_rows(found: DataFrame, folder: str, itemsize: int = 2) -> DataFrame:
    """`doc_key`, `shard`, `begin` and `ids` (of `itemsize` bytes) of all rows of found keys."""
    key_type = found.schema["doc_key"].dataType.simpleString()

    def run(batches):
        files, root = _open(folder)
        shard, begins, data = None, None, None
        for batch in batches:
            out = [[], [], [], []]
            size = 0
            for key, own, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                if own != shard:
                    shard = own
                    with files.open_input_stream(f"{root}/shard-{own:06d}.idx") as index:
                        begins = np.frombuffer(index.read(), "<u8").tolist()
                    if data is not None:
                        data.close()
                    data = files.open_input_file(f"{root}/shard-{own:06d}.bin")
                for row in range(first, first + n):
                    a, b = begins[row], begins[row + 1]
                    data.seek(a * itemsize)
                    ids = data.read((b - a) * itemsize)
                    for column, value in zip(out, (key, own, a, ids)):
                        column.append(value)
                    size += len(ids)
                    if size > 8_000_000:
                        yield _rows(out, batch)
                        out, size = [[], [], [], []], 0
            yield _rows(out, batch)
        if data is not None:
            data.close()

    def _rows(out, batch):
        kinds = [batch.schema.field("doc_key").type, pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_key", "shard", "begin", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)

    in_order = (
        found.select("doc_key", "shard", "first", "n_rows")
        .repartition("shard")
        .sortWithinPartitions("shard", "first")
    )
    return in_order.mapInArrow(
        run, f"doc_key {key_type}, shard bigint, begin bigint, ids binary"
    )


def get(spark: SparkSession, folder: str, key, itemsize: int = 2) -> list[np.ndarray]:
    """Ids of each row with one key: one bucket of the index, and one range of one shard."""
    one = spark.createDataFrame([(None if key is None else str(key),)], "doc_id string")
    found = lookup(one, folder)
    rows = read_rows(found, folder, itemsize).orderBy("begin").collect()
    return [np.frombuffer(r["ids"], f"<u{itemsize}") for r in rows]


def store(docs: DataFrame, tokenizer_path: str, end_id: int, **options) -> str:
    """Shards and index of all rows in a new folder of the shared one; its path."""
    folder = fresh_path(docs.sparkSession, "token-shards")
    write_shards(docs, tokenizer_path, folder, end_id, **options)
    build_index(docs.sparkSession, folder)
    return folder


def read_digests(keys: DataFrame, folder: str, key: str = "doc_id", itemsize: int = 2) -> DataFrame:
    """`doc_key`, `start`, `n_tokens`, `ids_crc32` of each row found, from the files."""
    key_type = keys.schema[key].dataType.simpleString()
    read = read_rows(lookup(keys.select(key).distinct(), folder, key), folder, itemsize)

    def run(batches):
        for batch in batches:
            blobs = batch.column("ids").to_pylist()
            crcs = [zlib.crc32(np.frombuffer(b, f"<u{itemsize}").astype("<u4")) for b in blobs]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([len(b) // itemsize for b in blobs], pa.int64()),
                    pa.array(crcs, pa.int64()),
                ],
                ["doc_key", "shard", "begin", "n_tokens", "ids_crc32"],
            )

    made = read.mapInArrow(
        run,
        f"doc_key {key_type}, shard bigint, begin bigint, n_tokens bigint, ids_crc32 bigint",
    )
    starts = shard_starts(keys.sparkSession, folder)
    return made.join(starts, "shard").select(
        "doc_key", (F.col("shard_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32"
    )
