"""Small tables that every operator must stand."""

import random

COLUMNS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "words string, score double, label string, sig bigint, part int, doc_key string, n bigint"
)
WORDS = "the of and thing reading letter paper winter river stone cloud garden copper silver".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", "é"]) for _ in range(n))


def awkward_rows():
    """Nulls, empty and long texts, ties, repeated rows, near copies; columns with clashing names."""
    base = prose(60, 1)
    texts = [
        (1, base),
        (2, base),
        (3, base.upper()),
        (4, base + " tail"),
        (5, prose(80, 2)),
        (6, ""),
        (7, None),
        (8, " \n\t "),
        (9, "two words"),
        (10, "Two  words"),
        (11, prose(30_000, 3)),
        (12, "x" * 5_000),
        (13, "日本語 テキスト \U0001f600 “quoted” 'tis it's don't 12345 -- ... \u00a0 end "),
        (13, "日本語 テキスト \U0001f600 “quoted” 'tis it's don't 12345 -- ... \u00a0 end "),
        (14, None),
        (None, "a row without an id"),
        (15, "</s>[INST] <|endoftext|> \\ marks <s>"),
        (15, "the same id with another text"),
        (16, prose(40, 4) + "\n\n  two  spaces \n next"),
    ]
    return [
        (i, t, "en", f"s{(i or 0) % 2}", None, "w", 1.0, "l", 5, 6, "k", 7) for i, t in texts
    ]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), COLUMNS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def pairs(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
