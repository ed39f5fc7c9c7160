"""Alignment of two tokenizers against a plain loop over whole texts."""

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskloom.llm import token_alignment
from riskloom.llm.queries import BYTE_TOKENIZER, PIECE_MODEL
from tests.llm.tables import COLUMNS, awkward_rows, empty, prose

NAMES = ("doc_key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(BYTE_TOKENIZER)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in shown}
    for i, x in enumerate(x for x in range(256) if x not in shown):
        letters[chr(256 + i)] = x
    vocab = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))["model"]["vocab"]
    bytes_a = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if "<|" not in t}

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def cut(text):
        """Groups of (A ids, B ids), or none."""
        if not text:
            return []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        whole = (" " + text).encode()
        parts_a, parts_b = [bytes_a[i] for i in ids_a], [bytes_b(i) for i in ids_b]
        if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            return []
        groups, at_b, end_a, end_b, own_a, own_b = [], 0, 0, 0, [], []
        for i, part in zip(ids_a, parts_a):
            own_a.append(i)
            end_a += len(part)
            while end_b < end_a:
                end_b += len(parts_b[at_b])
                own_b.append(ids_b[at_b])
                at_b += 1
            if end_a == end_b:
                groups.append((own_a, own_b))
                own_a, own_b = [], []
        return groups

    return cut


def expected(rows, cut):
    groups = [(key, cut(text)) for key, text in rows]
    counts = Counter((a[-1], b[-1]) for _, own in groups for a, b in own)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for key, own in groups:
        links = [(a[-1], b[-1]) for a, b in own]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        out.append(
            (
                key,
                sum(len(a) for a, _ in own),
                sum(len(b) for _, b in own),
                len(own),
                len(links),
                sum(counts[x] == highest[x[1]] for x in links),
                sum(counts[x] for x in links),
                hashlib.sha256(shown.encode()).hexdigest() if own else "",
            )
        )
    return sorted(out, key=repr), counts


ODD = [
    "a\n", "a\n b", " a", "  a", "a  b", "a   b ", "one  two", "one  two", "x \t y\n z",
    "▁", "one ▁two", "one▁ two", "　 wide 　", "\x1c a \x1c", "\x85 b",
    "don't 'll I'm ' s", "<|endoftext|> <s> </s> <0x41> <unk>", "� x", "12 345 6789 ...!? --",
    "é é ﬁ ẞ", "\U0001f600 \U0001f468‍\U0001f469", "\x00 \x00a", "   ", "\n\n",
    "᠎ a᠎ b", "tab\tand  two em spaces", "newline \r\n mixed \r end",
]


@pytest.mark.parametrize("chunks", [400_000, 8])
def test_equals_plain_loop(spark, monkeypatch, plain, chunks):
    monkeypatch.setattr(token_alignment, "CHUNKS", chunks)
    rng = random.Random(5)
    marks = ["a", "b ", " ", "  ", "\n", "▁", " ", "word", "The", ".", "'s", "é", "1", "\t"]
    mixed = ["".join(rng.choice(marks) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate([*ODD, *mixed, *ODD[:5]])]
    more = [r[:2] for r in awkward_rows() if len(r[1] or "") < 10_000]
    want, _ = expected([*rows, *more], plain)
    table = spark.createDataFrame(
        [(i, t, *[None] * 10) for i, t in [*rows, *more]], COLUMNS
    ).repartition(3)
    got = token_alignment.measures(table, BYTE_TOKENIZER, PIECE_MODEL)
    assert got.columns == list(NAMES)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_long_texts_in_portions(monkeypatch, plain):
    monkeypatch.setattr(token_alignment, "PORTION", 700)
    with open(BYTE_TOKENIZER, encoding="utf-8") as a, open(PIECE_MODEL, "rb") as b:
        aligner = token_alignment.Aligner(a.read(), b.read())
    for text in (prose(3_000, 8), "x" * 5_000, "one  two\n" * 600, prose(400, 1) + " ▁ " + prose(400, 2)):
        want, counts = expected([(0, text)], plain)
        a, b, groups, digest, pairs, times = aligner.measured(text.encode())
        assert (a, b, groups, digest) == (*want[0][1:4], want[0][7])
        possible = aligner.tokens.pairs
        found = {(possible.a[p], possible.b[p]): t for p, t in zip(pairs, times)}
        assert found == dict(counts)


def test_new_chunks_are_encoded_together(monkeypatch, plain):
    with open(BYTE_TOKENIZER, encoding="utf-8") as a, open(PIECE_MODEL, "rb") as b:
        aligner = token_alignment.Aligner(a.read(), b.read())
    texts = [" ".join(f"w{i}é{j}x," for j in range(300)) for i in range(3)]
    texts += [f"good{i} ﬁne word{i} it's{i}" for i in range(80)]  # B doesn't give the ligature back
    encoded, encode = [], aligner.tokens.encode
    monkeypatch.setattr(aligner.tokens, "encode", lambda x: encoded.append(len(x)) or encode(x))
    rows = list(enumerate(texts))
    want, _ = expected(rows, plain)
    got = [(i, *x[:4]) for i, x in enumerate(aligner.measures([t.encode() for t in texts]))]
    assert got == [(w[0], *w[1:4], w[7]) for w in sorted(want)]
    assert sum(encoded) < 200  # 1141 chunks; the few that share a text with the ligature come again


def test_pairs_table_and_hot_text(spark, plain):
    rows = [(i, "the very same text") for i in range(60)] + [(i, prose(30, i)) for i in range(60, 90)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want, counts = expected(rows, plain)
    made = token_alignment.align(table, BYTE_TOKENIZER, PIECE_MODEL)
    got = {(r.a_id, r.b_id): (r["count"], r.best) for r in made.pairs.collect()}
    assert {k: n for k, (n, _) in got.items()} == dict(counts)
    assert all(best == (n == max(m for (_, y), m in counts.items() if y == b)) for (_, b), (n, best) in got.items())
    hot = token_alignment.measures(table, BYTE_TOKENIZER, PIECE_MODEL, hot_rows=10)
    assert sorted((tuple(r) for r in hot.collect()), key=repr) == want


def test_other_rules_encode_whole_texts(plain):
    rules = json.load(open(BYTE_TOKENIZER))
    rules["normalizer"] = {"type": "Lowercase"}
    with open(PIECE_MODEL, "rb") as b:
        model = b.read()
    aligner = token_alignment.Aligner(json.dumps(rules), model)
    assert not aligner.tokens.chunked
    # Capitals don't come back: such texts have no tokens. Others are encoded in one piece.
    upper, lower = aligner.measures([b"One two", b"one  two three"])
    assert upper[:4] == (0, 0, 0, "")
    want, _ = expected([(0, "one  two three")], plain)
    assert lower[:4] == (*want[0][1:4], want[0][7])


def test_empty_table(spark):
    assert token_alignment.measures(empty(spark), BYTE_TOKENIZER, PIECE_MODEL).count() == 0
