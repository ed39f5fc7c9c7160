"""SimHash fingerprints of documents, and a search for those within a Hamming radius.

DataFrame functions only. A text's terms are its distinct words `[^\\x20\\x09-\\x0D]+` after A-Z went
to lower case; a term weighs as much as it has letters, 32 at most, since the common words are short.
Each bit of a term's hash votes with that weight. The votes are sums over exploded terms: bits k and
k+32 share one sum of 64 bits, 32 for each, so a row costs 32 additions, in generated code. Terms of
a text are summed in the task that reads it, before the shuffle.

The search cuts a fingerprint into `blocks` blocks. Two that differ in at most `radius` bits agree in
`blocks - radius` blocks at least, so for each choice of so many there is a table, with these blocks
moved to the front as its key; a query meets all fingerprints within the radius in one of them.

The order of documents is found on ids alone: ids are range-partitioned, the next one of each is
looked up within its range, and the last of a range gets the first of the next range. Texts are
shuffled by id once; only the beginning that the neighbour needs goes on from there.

Defined results: null text is empty, and an empty text has the fingerprint of zeros; rows that
repeat whole are one document in the order, and all are answered; rows with the same id stand by a
hash of their text; a null id comes last; a single document is its own neighbour; an empty table
gives no rows; other columns are left out.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.sources.workspace import fresh_path

BITS = 64
_LANES = (1 << 32) | 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    words = F.split(F.translate(text, _UPPER, _LOWER), r"[\x20\x09-\x0D]+")
    return F.array_distinct(words)


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """`keys` and `fingerprint` (a long) of each row; rows with the same keys count as one text."""
    term = texts.select(*keys, F.explode(terms(F.col(text))).alias("__term"))
    weighed = term.select(
        *keys,
        F.xxhash64("__term").alias("__hash"),
        F.least(F.char_length("__term"), F.lit(32)).cast("bigint").alias("__weight"),
    )
    lanes = F.lit(_LANES).cast("bigint")
    votes = [
        F.sum(
            F.shiftrightunsigned("__hash", k).bitwiseAND(lanes) * F.col("__weight")
        ).alias(f"__v{k}")
        for k in range(32)
    ]
    summed = weighed.groupBy(*keys).agg(F.sum("__weight").alias("__all"), *votes)
    low = F.lit((1 << 32) - 1).cast("bigint")
    bits = []
    for k in range(BITS):
        lane = F.col(f"__v{k % 32}")
        count = lane.bitwiseAND(low) if k < 32 else F.shiftrightunsigned(lane, 32)
        value = (1 << k) - (1 << 64 if k == 63 else 0)
        bits.append(F.when(count * 2 > F.col("__all"), F.lit(value).cast("bigint")).otherwise(0))
    made = bits[0]
    for bit in bits[1:]:
        made = made.bitwiseOR(bit)
    return summed.select(*keys, made.cast("bigint").alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """The share of bits that agree."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), BITS // 4, "0"))


def search(
    queries: DataFrame, table: DataFrame, radius: int = 3, blocks: int = 6
) -> DataFrame:
    """Pairs `query`, `found` of different longs in column `fingerprint` within the radius."""
    size = -(-BITS // blocks)
    choices = list(combinations(range(blocks), blocks - radius))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        fp = F.col("fingerprint")
        entries = []
        for i, choice in enumerate(choices):
            mask = 0
            for block in choice:
                for bit in range(block * size, min(BITS, (block + 1) * size)):
                    mask |= 1 << bit
            mask -= 1 << 64 if mask >> 63 else 0
            front = fp.bitwiseAND(F.lit(mask).cast("bigint"))
            entries.append(F.struct(F.lit(i).alias("choice"), front.alias("front")))
        rows = df.select("fingerprint").where("fingerprint is not null").distinct()
        rows = rows.select(fp.alias(name), F.explode(F.array(*entries)).alias("e"))
        return rows.select(name, "e.choice", "e.front")

    pairs = keyed(queries, "query").join(keyed(table, "found"), ["choice", "front"])
    apart = F.bit_count(F.col("query").bitwiseXOR(F.col("found")))
    return pairs.where(apart <= radius).select("query", "found").distinct()


def links(
    prints: DataFrame, every: int = 50, radius: int = 3, key: str = "doc_key"
) -> DataFrame:
    """Pairs `query`, `found` of different fingerprints within the radius, written as in `prints`;
    queries are those of keys divisible by `every`. With `prints` (`key`, `fingerprint`) as
    membership they name every document found; documents of one fingerprint need no pair."""
    bits = F.conv("fingerprint", 16, -10).cast("bigint")
    own = prints.select(key, bits.alias("fingerprint"))
    found = search(own.where(_asked(key, every)), own, radius).where("query <> found")
    return found.select(as_hex(F.col("query")).alias("query"), as_hex(F.col("found")).alias("found"))


def _asked(key: str, every: int) -> Column:
    return F.coalesce(F.col(key).try_cast("bigint") % every == 0, F.lit(False))


def following(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`doc_key`, `doc_hash` of each document, `chars`, `copies` (rows that are alike), and
    `next_key`, `next_hash`: the document after it in descending order of the key, the first one
    after the last."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = _own(docs, key, text).select("doc_key", "doc_hash", F.char_length("body").alias("chars"))
    path = fresh_path(spark, "simhash-order")
    (
        own.groupBy("doc_key", "doc_hash", "chars")
        .agg(F.count("*").alias("copies"))
        .repartitionByRange(n, F.desc("doc_key"), F.asc("doc_hash"))
        .withColumn("part", F.spark_partition_id())
        .write.parquet(path)
    )
    ids = spark.read.parquet(path)
    order = [F.desc("doc_key"), F.asc("doc_hash")]
    in_part = Window.partitionBy("part").orderBy(*order)
    placed = ids.withColumns(
        {
            "after": F.lead(F.struct("doc_key", "doc_hash")).over(in_part),
            "place": F.row_number().over(in_part),
        }
    )
    # One row for each range that has rows: the first of the next range, around the end.
    firsts = placed.where("place = 1").select(
        "part", F.struct("doc_key", "doc_hash").alias("first")
    )
    whole = Window.orderBy("part")
    around = Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    firsts = firsts.select(
        "part",
        F.coalesce(F.lead("first").over(whole), F.first("first").over(around)).alias("beyond"),
    )
    found = placed.join(firsts, "part").withColumn("after", F.coalesce("after", "beyond"))
    return found.select(
        "doc_key",
        "doc_hash",
        "chars",
        "copies",
        F.col("after.doc_key").alias("next_key"),
        F.col("after.doc_hash").alias("next_hash"),
    )


def _own(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("doc_key"), body.alias("body")).select(
        "doc_key", F.xxhash64("body").alias("doc_hash"), "body"
    )


def _same(a: str, b: str, c: str, d: str) -> Column:
    return F.col(a).eqNullSafe(F.col(c)) & (F.col(b) == F.col(d))


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row with its text and edited text: `doc_key`, `doc_hash`, `body`, `chars`, `copies`,
    `edited`, `next_key`, `next_hash`.

    The last third of the characters, rounded down, gives way to as many from the beginning of the
    next document, or all that it has.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "simhash-next")
    following(docs, key, text).write.parquet(path)
    after = spark.read.parquet(path)
    own = _own(docs, key, text)
    asked = after.select(
        F.col("next_key").alias("asked_key"),
        F.col("next_hash").alias("asked_hash"),
        F.col("doc_key").alias("for_key"),
        F.col("doc_hash").alias("for_hash"),
        "chars",
        "copies",
        F.floor(F.col("chars") / 3).cast("int").alias("third"),
    )
    # A text that repeats whole gives the same beginning; one of them is enough.
    given = own.join(asked, _same("doc_key", "doc_hash", "asked_key", "asked_hash")).select(
        "for_key",
        "for_hash",
        "chars",
        "copies",
        "third",
        "asked_key",
        "asked_hash",
        F.substring("body", F.lit(1), F.col("third")).alias("beginning"),
    )
    if not after.where("copies > 1").isEmpty():
        given = given.dropDuplicates(["for_key", "for_hash"])
    joined = own.join(given, _same("doc_key", "doc_hash", "for_key", "for_hash"))
    stays = F.substring("body", F.lit(1), F.col("chars") - F.col("third"))
    return joined.select(
        "doc_key",
        "doc_hash",
        "body",
        F.col("chars").cast("bigint").alias("chars"),
        "copies",
        F.concat(stays, "beginning").alias("edited"),
        F.col("asked_key").alias("next_key"),
        F.col("asked_hash").alias("next_hash"),
    )


def document_fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 50, radius: int = 3
) -> DataFrame:
    """`doc_key`, `n_chars`, `edited_sha256`, `fingerprint`, `edited_fingerprint`, `near_edited`,
    `near_next`, and `n_within`: for keys divisible by `every`, how many other documents of the
    table the search finds within the radius, those with an equal fingerprint too; null for other
    keys, and for those that are no integers. `links` names them."""
    spark = docs.sparkSession
    pairs = edited_pairs(docs, key, text)
    both = pairs.select(
        "doc_key",
        "doc_hash",
        "next_key",
        "next_hash",
        "chars",
        "copies",
        F.sha2("edited", 256).alias("sha"),
        F.explode(F.array(F.col("body"), F.col("edited"))).alias("version"),
    )
    keys = ["doc_key", "doc_hash", "next_key", "next_hash", "chars", "copies", "sha"]
    # Which of the two a row is follows from its hash; equal ones need no telling apart.
    both = both.withColumn("version_hash", F.xxhash64("version"))
    path = fresh_path(spark, "simhash")
    fingerprints(both, [*keys, "version_hash"], "version").write.parquet(path)
    made = spark.read.parquet(path)
    plain = made.where("version_hash = doc_hash").select(
        *keys, F.col("fingerprint").alias("own")
    )
    changed = made.groupBy(*keys).agg(
        F.max(F.when(F.col("version_hash") == F.col("doc_hash"), F.col("fingerprint"))).alias("own"),
        F.max(F.when(F.col("version_hash") != F.col("doc_hash"), F.col("fingerprint"))).alias("other"),
    )
    rows = changed.withColumn("other", F.coalesce("other", "own"))
    neighbour = plain.select(
        F.col("doc_key").alias("n_key"), F.col("doc_hash").alias("n_hash"), F.col("own").alias("n_own")
    )
    rows = rows.join(neighbour, _same("next_key", "next_hash", "n_key", "n_hash"), "left")
    sizes = plain.groupBy("own").agg(F.sum("copies").alias("documents"))
    prints = sizes.select(F.col("own").alias("fingerprint"))
    asked = plain.where(_asked("doc_key", every)).select(F.col("own").alias("fingerprint"))
    found = search(asked, prints, radius)
    near = found.join(sizes, F.col("found") == F.col("own")).groupBy("query").agg(
        F.sum("documents").alias("n")
    )
    rows = rows.join(near, F.col("own") == F.col("query"), "left")
    each = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    rows = rows.withColumn("copy", each)
    within = F.when(_asked("doc_key", every), F.col("n") - 1)
    return rows.select(
        "doc_key",
        F.col("chars").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        as_hex(F.col("own")).alias("fingerprint"),
        as_hex(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("n_own")).alias("near_next"),
        within.cast("bigint").alias("n_within"),
    )
