"""Near duplicates by SimHash, found by meeting in the middle.

A text's shingles are its runs of `width` words `[^\\x20\\x09-\\x0D]+` after A-Z went to lower case,
joined by single spaces, repeats included; with fewer words the whole sequence is one. A fingerprint
bit is 1 if it is set in over half of the shingles' XXH64 hashes (seed 42).

Two fingerprints within `radius` bits share a fingerprint in the middle. So each distinct fingerprint
emits all variants within half the radius (65 of them for a radius of 2), and the variants are
shuffled. Those that meet at a variant are a bounded number, whatever the data: the size of the ball.
They are chained instead of paired, since all that meet are within the radius of each other; links are
made once and verified. For an odd radius the ball is one bit larger on one side: fingerprints on its
rim link to one inside only, so no link is longer than the radius.

Documents with equal fingerprints are one node with its number of documents. Components are found on
nodes by star contraction; labels go back to documents by a join in which fingerprints of more than
`hot_rows` documents are broadcast (at most documents / `hot_rows` of them).

Defined results: null text is empty; a text without words has the fingerprint of zeros, linked like
any other; rows that repeat each come back; a null id is answered, but is no label unless no document
of the component has another; an empty table gives no rows; a very long text is hashed in portions;
other columns are left out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.rows import spaced_words, utf8
from riskloom.operators.graph import components, join_by_node
from riskloom.operators.running import HOT_ROWS
from riskloom.sources.workspace import written

BITS = 64
WIDTH = 3
RADIUS = 2
SEED = 42
#: Shingles whose bits are counted at once.
PORTION = 50_000


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of the shingles of at least one word."""
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], np.uint64)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The fingerprint of one text, unsigned."""
    words = spaced_words(text)
    if not words:
        return 0
    votes, n = np.zeros(BITS, np.int64), max(1, len(words) - width + 1)
    for begin in range(0, n, PORTION):
        hashes = _hashes(words[begin : min(n, begin + PORTION) + width - 1], width)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    over = np.packbits(votes * 2 > n, bitorder="little")
    return int(over.view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH
) -> DataFrame:
    """`doc_key`, `fingerprint` (its 64 bits as a long) of each row."""

    def run(batches):
        for batch in batches:
            made = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            prints = np.array(made, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints)], ["doc_key", "fingerprint"]
            )

    rows = docs.select(F.col(key).alias("doc_key"), utf8(text).alias("body"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_key {kind}, fingerprint bigint")


def _masks(flips: int) -> list[int]:
    """All ways to flip so many bits, as signed 64-bit masks."""
    made = [sum(1 << b for b in bits) for bits in combinations(range(BITS), flips)]
    return [m - (1 << 64) if m >> 63 else m for m in made]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`a`, `b`: links between different fingerprints (a long each, in column `fingerprint`) within
    the radius, enough to connect all that are connected by such links.

    The ball has a fixed number of variants: 1 + 64 for a radius of 2 or 3, but 2,081 for 4 or 5.
    """
    inner, odd = radius // 2, radius % 2
    flips = [(m, 0) for i in range(inner + 1) for m in _masks(i)]
    flips += [(m, 1) for m in _masks(inner + 1)] if odd else []
    own = F.col("fingerprint")
    masks = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(r).alias("rim")) for m, r in flips])
    met = (
        prints.select("fingerprint")
        .where("fingerprint is not null")
        .distinct()
        .select(own, F.explode(masks).alias("flip"))
        .select(own, own.bitwiseXOR(F.col("flip.mask")).alias("variant"), "flip.rim")
    )
    by = Window.partitionBy("variant").orderBy("rim", "fingerprint")
    if odd:  # fingerprints inside come first; those on the rim link to the last one inside
        inside = F.when(F.col("rim") == 0, own)
        other = F.last(inside, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    else:
        other = F.lag("fingerprint").over(by)
    pairs = met.select(own.alias("b"), other.alias("a")).where("a is not null")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    radius: int = RADIUS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """`doc_key`, `fingerprint` (long), `copies` (documents with this fingerprint) and `component`
    (the least key of all documents reachable by links) of each row."""
    rows, _ = written(fingerprints(docs, key, text, width), "near-simhash")
    nodes, _ = written(
        rows.groupBy("fingerprint").agg(
            F.min("doc_key").alias("least"), F.count(F.lit(1)).alias("copies")
        ),
        "near-simhash-nodes",
    )
    labels = components(links(nodes, radius), hot_rows)
    labels = labels.select(F.col("node").alias("fingerprint"), "label")
    named = nodes.join(labels, "fingerprint", "left").withColumn(
        "label", F.coalesce("label", "fingerprint")
    )
    named, _ = written(named, "near-simhash-labels")
    leasts, _ = written(
        named.groupBy("label").agg(
            F.min("least").alias("component"), F.count(F.lit(1)).alias("n")
        ),
        "near-simhash-components",
    )
    found = join_by_node(
        named.withColumnRenamed("label", "a"), leasts.withColumnRenamed("label", "a"), hot_rows
    )
    classes, _ = written(
        found.select("fingerprint", "copies", "component"), "near-simhash-classes"
    )
    sized = classes.select(
        F.col("fingerprint").alias("a"), "copies", "component", F.col("copies").alias("n")
    )
    joined = join_by_node(rows.withColumnRenamed("fingerprint", "a"), sized, hot_rows)
    return joined.select("doc_key", F.col("a").alias("fingerprint"), "copies", "component")
