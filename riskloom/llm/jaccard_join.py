"""N-gram Jaccard join: documents whose sets of word shingles are alike enough, and their groups.

Words are `[^\\x20\\x09-\\x0D]+` after A-Z went to lower case. A document's set has its distinct
shingles of `n_words` words; one with fewer words has them all as its one shingle. Shingles are told
apart by 64-bit hashes, and documents with equal sets by a 64-bit sum, so equal sets are one class.

1. Shingles go, packed in blocks, to ranges of their hash, where each is counted once for a class.
   Only those of two classes or more go on, gathered by class. A text's own row is dealt evenly, not
   by class, so copies of one text don't meet in a task; ranges follow the bytes of the input.
2. The order of shingles is the rarer first. A set of n that has to share k with another meets it
   within its first n-k+1 (prefix filter). The shingles of one class alone come first and meet
   nobody; a class whose prefix is made of them is done.
3. The rest is joined on prefix shingles. Pairs must fit in size (length filter), have enough left
   from the shared shingle on (positional filter). The sets must not differ in more shingles than
   the threshold lets them: at least in those that one class alone has, and in as many more as their
   bit vectors, of the parities of hashed shingles, differ in (suffix filter).
4. What passes is made distinct, and each pair is verified once, on the shingles themselves.

Of a group of alike classes not all pairs are made. In a first round, each class takes from a shared
shingle's list one partner in each bunch of classes that seem linked. Components follow from the
verified pairs. In a second round, all pairs that pass the filters between different components are
verified. So no link between components is lost, and the components are exact.

Lists of a shingle longer than `list_rows` are cut into parts. The first round joins neighbouring
parts, as it only has to link most of what belongs together; the second joins each two parts, of the
lists that still hold different components.

Defined results: null and empty texts, and those without words, have an empty set and are linked with
nothing; rows that repeat have equal sets; a null id is the smallest of a group only if all are null;
an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.components import components
from riskloom.llm.rows import utf8
from riskloom.llm.word_hashes import mixed, portions, word_hashes
from riskloom.sources.workspace import fresh_path

BLOCK_BYTES = 4_000_000
VECTOR_BYTES = 64
RANGE_BYTES = 128_000_000
LIST_ROWS = 4_000
_FACTOR = 0x9E3779B97F4A7C15 | 1


# -- sets -----------------------------------------------------------------------------------------


def shingle_sets(texts: list[bytes], n_words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, offsets = word_hashes(texts)
    n = max(0, len(words) - n_words + 1)
    shingles = np.zeros(n, np.uint64)
    factors = [np.uint64(pow(_FACTOR, i + 1, 1 << 64)) for i in range(n_words)]
    for i, factor in enumerate(factors):
        shingles += words[i : n + i] * factor
    shingles = mixed(shingles)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= n_words:
            out.append(np.unique(shingles[a : b - n_words + 1]))
        elif b > a:
            own = (words[a:b] * np.array(factors[: b - a])).sum(dtype=np.uint64)
            out.append(mixed(np.array([own + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_MADE = pa.schema(
    [
        ("part", pa.int32()),
        ("doc_key", pa.string()),
        ("sig", pa.int64()),
        ("n", pa.int64()),
        ("sigs", pa.binary()),
        ("sizes", pa.binary()),
        ("counts", pa.binary()),
        ("tokens", pa.binary()),
    ]
)
_MADE_SQL = (
    "part int, doc_key string, sig bigint, n bigint, sigs binary, sizes binary, counts binary, "
    "tokens binary"
)


def _spread(ranges: int, n_words: int):
    """Rows of documents, and of the shingles of a block in each range."""

    def run(batches):
        dealt = TaskContext.get().partitionId()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in portions([len(t) for t in texts], BLOCK_BYTES):
                sets = shingle_sets(texts[a:b], n_words)
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets)
                owner = np.repeat(np.arange(b - a), sizes)
                sums = np.zeros(b - a, np.uint64)
                np.add.at(sums, owner, mixed(flat + np.uint64(_FACTOR)))
                sigs = mixed(sums + sizes.astype(np.uint64)).astype(np.int64)
                first = np.unique(sigs, return_index=True)[1]  # a class once in a block
                chosen = np.isin(np.arange(b - a), first)[owner]
                flat, owner = flat[chosen], owner[chosen]
                place = ((flat >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                order = np.argsort(place, kind="stable")
                flat, owner = flat[order], owner[order]
                cuts = np.searchsorted(place[order], np.arange(ranges + 1, dtype=np.uint64))
                rows = [
                    ((dealt + i) % ranges, k, int(s), int(n), None, None, None, None)
                    for i, (k, s, n) in enumerate(zip(keys[a:b], sigs, sizes))
                ]
                dealt += b - a
                for r in range(ranges):
                    part = slice(cuts[r], cuts[r + 1])
                    if part.stop > part.start:
                        docs, counts = np.unique(owner[part], return_counts=True)
                        rows.append(
                            (r, None, 0, 0, sigs[docs].tobytes(), sizes[docs].astype("<u4").tobytes(),
                             counts.astype("<u4").tobytes(), _six(flat[part]))
                        )
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _MADE)]
                yield pa.RecordBatch.from_arrays(columns, schema=_MADE)

    return run


def _six(hashes: np.ndarray) -> bytes:
    """The low 48 bits: the range has the high ones that matter."""
    return hashes.astype("<u4").tobytes() + (hashes >> np.uint64(32)).astype("<u2").tobytes()


def _from_six(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    low = np.frombuffer(blob, "<u4", n).astype(np.uint64)
    return low | np.frombuffer(blob, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


def _repeated(parts: int):
    """Of a range: its shingles of two classes or more, by parts of the classes."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        docs = frame[frame["sigs"].isna()]
        out = [
            (p, k, s, n, None, None, None, None, None)
            for p, k, s, n in zip(docs["part"], docs["doc_key"], docs["sig"], docs["n"])
        ]
        rows = frame[~frame["sigs"].isna()]
        if len(rows):
            own = int(rows["part"].iloc[0])
            tokens = np.concatenate([_from_six(b) for b in rows["tokens"]])
            sigs = np.concatenate(
                [np.repeat(np.frombuffer(s, "<i8"), np.frombuffer(c, "<u4"))
                 for s, c in zip(rows["sigs"], rows["counts"])]
            )
            all_sigs = np.frombuffer(b"".join(rows["sigs"]), "<i8")
            all_sigs, at = np.unique(all_sigs, return_index=True)
            sizes = np.frombuffer(b"".join(rows["sizes"]), "<u4")[at]
            order = np.lexsort((sigs, tokens))
            tokens, sigs = tokens[order], sigs[order]
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (sigs[1:] != sigs[:-1])
            tokens, sigs = tokens[new], sigs[new]
            _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            often = counts[inverse]
            tokens, sigs, often = (x[often > 1] for x in (tokens, sigs, often))
            part = sigs.view(np.uint64) % np.uint64(parts)
            order = np.lexsort((sigs, part))
            tokens, sigs, often, part = (x[order] for x in (tokens, sigs, often, part))
            cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            for p in range(parts):
                mine = slice(cuts[p], cuts[p + 1])
                if mine.stop > mine.start:
                    each, n = np.unique(sigs[mine], return_counts=True)
                    rank = np.log2(often[mine]).astype(np.uint8)
                    out.append(
                        (p, None, own, 0, each.tobytes(),
                         sizes[np.searchsorted(all_sigs, each)].tobytes(),
                         n.astype("<u4").tobytes(), _six(tokens[mine]), rank.tobytes())
                    )
        return pd.DataFrame(out, columns=[c.split()[0] for c in _REPEATED_SQL.split(", ")])

    return run


_REPEATED_SQL = _MADE_SQL + ", ranks binary"
_CLASS_SQL = (
    "doc_key string, sig bigint, n bigint, alone bigint, prefix bigint, tokens binary, vector binary"
)


def needed(n: np.ndarray | int, share: tuple[int, int]) -> np.ndarray:
    """The least number that a set of n must have in common with any other."""
    return -(-n * share[0] // share[1])


def _gathered(share: tuple[int, int]):
    """Of a part of the classes: documents, and the classes that may be linked."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        docs = frame[frame["sigs"].isna()]
        keys = docs["doc_key"].tolist()
        sig_of, n_of = docs["sig"].tolist(), docs["n"].tolist()
        out = [(k, s, n, 0, 0, None, None) for k, s, n in zip(keys, sig_of, n_of)]
        sizes = {}
        rows = frame[~frame["sigs"].isna()]
        if len(rows):
            tokens, sigs, ranks = [], [], []
            for own, s, z, c, t, r in zip(
                *(rows[x] for x in ("sig", "sigs", "sizes", "counts", "tokens", "ranks"))
            ):
                sizes.update(zip(np.frombuffer(s, "<i8").tolist(), np.frombuffer(z, "<u4").tolist()))
                tokens.append(_from_six(t) | np.uint64(int(own) & 0xFFFF) << np.uint64(48))
                sigs.append(np.repeat(np.frombuffer(s, "<i8"), np.frombuffer(c, "<u4")))
                ranks.append(np.frombuffer(r, np.uint8))
            tokens, sigs, ranks = map(np.concatenate, (tokens, sigs, ranks))
            order = np.lexsort((tokens, ranks, sigs))
            tokens, sigs = tokens[order], sigs[order]
            each, begins, counts = np.unique(sigs, return_index=True, return_counts=True)
            for sig, begin, count in zip(each.tolist(), begins, counts):
                n = sizes[sig]
                alone, prefix = n - count, n - int(needed(n, share)) + 1
                if alone < prefix:
                    own = tokens[begin : begin + count]
                    out.append(
                        (None, sig, n, alone, prefix - alone, own.astype("<u8").tobytes(), _vector(own))
                    )
        return pd.DataFrame(out, columns=[c.split()[0] for c in _CLASS_SQL.split(", ")])

    return run


def _vector(tokens: np.ndarray) -> bytes:
    """Parities of the shingles hashed to each bit: they differ at no more places than the sets."""
    bits = mixed(tokens) % np.uint64(8 * VECTOR_BYTES)
    odd = np.bincount(bits.astype(np.int64), minlength=8 * VECTOR_BYTES) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


# -- candidates -----------------------------------------------------------------------------------


def _postings(classes: DataFrame) -> DataFrame:
    """A row for each prefix shingle that a class shares: `token`, place and what filters need."""

    def run(batches):
        for batch in batches:
            label, sig, n, alone, prefix, tokens, vector = (c.to_pylist() for c in batch.columns)
            for a in range(0, len(sig), 200):
                rows = range(a, min(a + 200, len(sig)))
                own = [np.frombuffer(tokens[i], "<i8")[: prefix[i]] for i in rows]
                k = np.array([len(x) for x in own])
                at = np.concatenate([alone[i] + np.arange(m) for i, m in zip(rows, k)])
                rep = np.repeat(np.arange(rows.start, rows.stop), k)
                take = [pa.array(x).take(pa.array(rep)) for x in (label, sig, n, alone)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(own)),
                        *take,
                        pa.array(at.astype(np.int64)),
                        pa.array(vector, pa.binary()).take(pa.array(rep)),
                    ],
                    ["token", "label", "sig", "n", "alone", "at", "vector"],
                )

    columns = ["label", "sig", "n", "alone", "prefix", "tokens", "vector"]
    return classes.select(*columns).mapInArrow(
        run,
        "token bigint, label bigint, sig bigint, n bigint, alone bigint, at bigint, vector binary",
    )


def _listed(postings: DataFrame, list_rows: int, every: bool) -> DataFrame:
    """Lists of each shingle as `token`, `one`, `two`: short ones whole, long ones in parts.

    Lists of one label only have nothing to find. Parts are joined each with each if `every` pair
    counts, and otherwise each with the next."""
    sizes = postings.groupBy("token").agg(
        F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")
    )
    rows = postings.join(sizes.where("lo <> hi").select("token", "m"), "token")
    parts = F.ceil(F.col("m") / list_rows).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sig"), parts).cast("int"))
    if every:
        others = F.sequence(F.lit(0), parts - 1)
        one, two = F.least("own", "other"), F.greatest("own", "other")
    else:
        before = F.pmod(F.col("own") - 1, parts)
        others = F.array_distinct(F.array("own", before))
        one = two = F.col("other")
    rows = rows.withColumn("other", F.explode(others))
    return rows.withColumns({"one": one, "two": two}).drop("own", "other", "m")


def _pairs(share: tuple[int, int], every: bool):
    """Pairs of each list that pass the filters; `every` one, or one for each bunch."""
    up, down = share

    def fitting(n1, alone1, at1, v1, n2, alone2, at2, v2):
        """Whether a pair passes, and in how many shingles the sets differ at least."""
        small, large = np.minimum(n1, n2), np.maximum(n1, n2)
        both = n1 + n2
        need = -(-up * both // (up + down))
        left = np.minimum(n1 - at1, n2 - at2)
        ok = (down * small >= up * large) & (left >= need)
        apart = np.bitwise_count(v1 ^ v2).sum(-1).astype(np.int64) + alone1 + alone2
        limit = both - 2 * need
        return ok & (apart <= limit), apart

    def of_list(sig, label, n, alone, at, v):
        out = []
        order = np.lexsort((sig, n))
        sig, label, n, alone, at, v = (x[order] for x in (sig, label, n, alone, at, v))
        bunch = np.arange(len(sig))
        for i in range(1, len(sig)):
            lo = int(np.searchsorted(n[:i], -(-up * n[i] // down)))
            rows = np.arange(lo, i)
            ok, apart = fitting(
                n[rows], alone[rows], at[rows], v[rows], n[i], alone[i], at[i], v[i]
            )
            rows, apart = rows[ok], apart[ok]
            if every:
                rows = rows[label[rows] != label[i]]
                out += [(sig[j], sig[i]) for j in rows]
            elif len(rows):
                # The least of the close ones, so that lists of other shingles choose it too.
                far = apart * 14 > n[rows] + n[i]
                pick = np.lexsort((sig[rows], np.where(far, apart, 0), bunch[rows]))
                rows = rows[pick]
                rows = rows[np.unique(bunch[rows], return_index=True)[1]]
                out += [(sig[j], sig[i]) for j in rows]
                bunch[np.isin(bunch, bunch[rows])] = bunch[i]
        return out

    def run(batches):
        rest = None
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
            keys = np.stack([table[c].to_numpy() for c in ("token", "one", "two")])
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            last = int(change[-1]) if len(change) else 0
            rest = table.slice(last)
            out = done(table.slice(0, last), change, seen)
            if len(seen) > 500_000:
                seen.clear()
            yield made(out)
        if rest is not None:
            yield made(done(rest, np.zeros(0, np.int64), seen))

    def done(table, change, seen):
        out = []
        if table.num_rows < 2:
            return out
        columns = [table[c].to_numpy() for c in ("sig", "label", "n", "alone", "at")]
        sig, label = columns[:2]
        v = np.frombuffer(b"".join(table["vector"].to_pylist()), "<u8").reshape(len(sig), -1)
        bounds = [0, *change[change < len(sig)], len(sig)]
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1 and (label[a:b] != label[a]).any():
                own = slice(a, b)
                for pair in of_list(*(c[own] for c in columns), v[own]):
                    if pair not in seen:
                        seen.add(pair)
                        out.append(pair)
        return out

    def made(pairs):
        columns = list(zip(*pairs)) or [[], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["a", "b"]
        )

    return run


def candidates(
    classes: DataFrame, share: tuple[int, int], every: bool, list_rows: int = LIST_ROWS
) -> DataFrame:
    """Distinct pairs `a`, `b` of classes that share a prefix shingle and pass the filters."""
    lists = _listed(_postings(classes), list_rows, every)
    in_order = lists.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two")
    columns = ["token", "one", "two", "label", "sig", "n", "alone", "at", "vector"]
    found = in_order.select(*columns).mapInArrow(_pairs(share, every), "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, classes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs that are alike enough, by the shingles they share."""
    own = classes.select("sig", "n", "tokens")
    left = own.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = own.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    rows = pairs.join(right, "b").join(left, "a")

    def run(batches):
        for batch in batches:
            n = [
                len(np.intersect1d(np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8"), True))
                for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(n, pa.int64())], ["a", "b", "na", "nb", "common"]
            )

    counted = rows.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(
        run, "a bigint, b bigint, na bigint, nb bigint, common bigint"
    )
    common = F.col("common")
    union = F.col("na") + F.col("nb") - common
    return counted.where(common * share[1] >= union * share[0]).select("a", "b")


# -- groups ---------------------------------------------------------------------------------------


def groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n_words: int = 5,
    share: tuple[int, int] = (75, 100),
    list_rows: int = LIST_ROWS,
) -> DataFrame:
    """`doc_key`, `n_shingles`, `component` (the least key reachable by links) of each row."""
    spark = docs.sparkSession
    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("string").alias("doc_key"), utf8(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(max(least, -(-size // RANGE_BYTES)), 1 << 16)
    path = fresh_path(spark, "jaccard")
    (
        rows.mapInArrow(_spread(parts, n_words), _MADE_SQL)
        .groupBy("part")
        .applyInPandas(_repeated(parts), _REPEATED_SQL)
        .groupBy("part")
        .applyInPandas(_gathered(share), _CLASS_SQL)
        .write.parquet(path)
    )
    made = spark.read.parquet(path)
    classes = made.where(F.col("tokens").isNotNull())
    members = made.where(F.col("tokens").isNull()).select(
        F.col("doc_key").cast(key_type).alias("doc_key"), "sig", "n"
    )

    first = classes.withColumn("label", F.col("sig"))
    links_path = fresh_path(spark, "jaccard-links")
    verified(candidates(first, share, False, list_rows), classes, share).write.parquet(links_path)
    links = spark.read.parquet(links_path)
    labels = components(links)

    node = labels.withColumnRenamed("node", "sig")
    second = classes.join(node, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    more = verified(candidates(second, share, True, list_rows), classes, share)
    tree = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    labels = components(tree.union(more)).withColumnRenamed("node", "sig")

    grouped = members.join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    least = grouped.where("n > 0").groupBy("label").agg(F.min("doc_key").alias("least"))
    return grouped.join(least, "label", "left").select(
        "doc_key",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_key")).alias("component"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of documents whose key is the least of their group, each once."""
    found = groups(docs, key, text, **options)
    spark = docs.sparkSession
    path = fresh_path(spark, "jaccard-kept")
    found.where(F.col("doc_key").eqNullSafe(F.col("component"))).groupBy("doc_key").agg(
        F.count("*").alias("rows")
    ).write.parquet(path)
    kept = spark.read.parquet(path)
    own = "__kept"
    while own in {c.lower() for c in docs.columns}:
        own += "_"
    keys = kept.select(F.col("doc_key").alias(own))
    rows = docs.join(keys, F.col(f"`{key}`").eqNullSafe(F.col(own)), "left_semi")
    if kept.where("rows > 1").isEmpty():
        return rows
    return rows.dropDuplicates([key, text])
