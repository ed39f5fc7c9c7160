"""BPE, token shards, licences, URLs and chats against plain versions of the same rules."""

import base64
import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskloom.llm import byte_bpe, chat_format, license_scan, queries, token_shards, url_filters
from riskloom.llm.rows import plain_words, spaced_words
from riskloom.llm.word_hashes import PLAIN, SPACED, word_hashes
from tests.llm.tables import awkward, awkward_rows, empty, pairs, prose

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ANY_TEXT = st.text(
    st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0abé'stvreİΣ२Ⅷ12_.,!?;漢字\u0301\U0001f600%<|>"), max_size=40
)


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.Coder(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference_bpe():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@settings(max_examples=150, deadline=None)
@given(text=ANY_TEXT)
def test_bpe_is_that_of_the_library(text, coder, reference_bpe):
    ids = coder.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == reference_bpe.encode_ordinary(text)
    assert coder.decode([ids])[0] == text.encode()


def test_bpe_of_long_pieces_and_long_texts(coder, reference_bpe, monkeypatch):
    for text in ("ab" * 900, "é" * 800, prose(300, 9), "a  b \n c"):
        expected = reference_bpe.encode_ordinary(text)
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == expected
        monkeypatch.setattr(byte_bpe, "LONG_TEXT", 10)
        monkeypatch.setattr(byte_bpe, "PIECES_AT_ONCE", 3)
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == expected
        monkeypatch.undo()


def test_bpe_with_small_caches(reference_bpe, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 8)
    own = byte_bpe.Coder(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    texts = [prose(50, s) for s in range(6)]
    for _ in range(2):
        ids = own.encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [
            reference_bpe.encode_ordinary(t) for t in texts
        ]
        assert own.decode(ids) == [t.encode() for t in texts]


def test_bpe_keeps_a_bounded_number_of_short_entries(reference_bpe, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 50)
    own = byte_bpe.Coder(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    for s in range(4):  # new words, each seen twice, and one chunk that is too long to be kept
        words = [f"x{hashlib.sha256(f'{s} {i}'.encode()).hexdigest()[:9]}" for i in range(400)]
        text = " ".join([*words, "ab1" * 40])
        for _ in range(2):
            assert own.encode([text])[0] == np.array(reference_bpe.encode_ordinary(text), "<u4").tobytes()
            assert own.decode_parts(own.encode_parts([text]), own.dtype) == [text.encode()]
    tables = [t for x in (own.chunks, own.pieces, *own.runs.values()) for t in (x.once, x.now, x.before)]
    assert max(map(len, tables)) <= 50
    assert max(len(key) for t in tables for key in t) <= byte_bpe.CACHE_LENGTH


def test_bpe_looks_new_words_up_once(reference_bpe, monkeypatch):
    own = byte_bpe.Coder(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    asked, find = Counter(), byte_bpe.Recent.find

    def counted(self, keys):
        keys = list(keys)
        asked.update(keys if self is own.chunks else ())
        return find(self, keys)

    monkeypatch.setattr(byte_bpe.Recent, "find", counted)
    texts = ["qwxy vbnmz qwxy", "vbnmz pqrst. pqrst"]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference_bpe.encode_ordinary(text)
    assert asked["vbnmz"] == asked["pqrst"] == 1


def test_bpe_rejects_unknown_ids(coder):
    with pytest.raises(ValueError):
        coder.decode([np.array([60_000], "<u4").tobytes()])


def test_bpe_of_awkward_rows(spark, reference_bpe):
    docs = awkward(spark)
    made = queries.byte_bpe_digests(docs)
    expected = []
    for i, text, *_ in awkward_rows():
        ids = np.array(reference_bpe.encode_ordinary(text or ""), "<u4")
        digests = [hashlib.sha256(x).hexdigest() for x in (ids.tobytes(), (text or "").encode())]
        expected.append((i, len(ids), *digests))
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert pairs(made, *names) == sorted(expected, key=repr)
    pattern = public_tokenizers.PATTERN
    encoded = byte_bpe.encode(docs, RANKS, pattern)
    decoded = byte_bpe.decode(encoded, RANKS, pattern)
    assert sorted(bytes(r["decoded"]) for r in decoded.collect()) == sorted(
        (r[1] or "").encode() for r in awkward_rows()
    )
    assert byte_bpe.round_trip(empty(spark), RANKS, pattern).count() == 0


# -- token shards ---------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(text=ANY_TEXT)
def test_word_ids_are_those_of_the_library(text):
    tokenizer = Tokenizer.from_file(WORDS)
    with open(WORDS, encoding="utf-8") as file:
        encoder = token_shards._encoder(file.read())
    ids = np.frombuffer(encoder.encode([text.encode()])[0], encoder.dtype).tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_perfect_hash_gives_each_key_its_slot():
    for n in (1, 2, 5, 1_000, 20_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
        slots = token_shards.slots_of(keys, token_shards.perfect_hash(keys), len(keys))
        assert sorted(slots.tolist()) == list(range(len(keys)))


def test_new_words_of_letters_go_to_the_tokenizer_together():
    with open(WORDS, encoding="utf-8") as file:
        encoder = token_shards.WordEncoder(file.read())
    whole, asked = encoder.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counted()
    letters = "abcdefgh"
    plain = [a + b + c + "xyz" for a in letters for b in letters for c in letters]
    odd = (
        "don't A*** b&&&, ^c $d e=, F@+~ g%# \u0958\u0958 \u212a \u0130stanbul \ufb01n stra\u00dfe "
        "e\u0301t\u00e9. \u01c4;; n\u0303 \u03a3\u03a3 \u03c2, 12a a12. <|endoftext|> x<|y| ... \u4e2d\u6587: \u0e01\u0e33!"
    )
    texts = [" ".join(plain), odd, odd.upper(), " ".join(w + "," for w in plain)]
    for many in ([texts], [[t] for t in texts], [[w] for w in odd.split()]):
        encoder.words, encoder.spare = {}, {}
        for portion in many:
            got = encoder.encode([t.encode() for t in portion])
            want = whole.encode_batch_fast(portion, add_special_tokens=False)
            assert got == [np.array(w.ids, encoder.dtype).tobytes() for w in want]
        if len(many) == 1:
            assert len(asked) < 100  # 512 words of letters, and some odd ones


def test_shards_hold_all_rows_in_order(spark):
    tokenizer = Tokenizer.from_file(WORDS)
    folder = token_shards.store(awkward(spark), WORDS, end_id=2, shards=4)
    got = pairs(token_shards.read_digests(awkward(spark), folder), "start", "doc_key", "n_tokens", "ids_crc32")
    rows = sorted(((r[0] is not None, r[0] or 0, (r[1] or "").encode()) for r in awkward_rows()))
    expected, start = [], 0
    for known, key, text in rows:
        ids = tokenizer.encode(text.decode(), add_special_tokens=False).ids + [2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        expected.append((start, key if known else None, len(ids), crc))
        start += len(ids)
    assert sorted(got) == expected
    one = token_shards.get(spark, folder, 9)
    assert [x.tolist() for x in one] == [tokenizer.encode("two words", add_special_tokens=False).ids + [2]]
    assert len(token_shards.get(spark, folder, 13)) == 2
    assert token_shards.get(spark, folder, 999) == []
    strangers = spark.range(10_000, 12_000).withColumnRenamed("id", "doc_id")
    assert token_shards.lookup(strangers, folder).count() == 0


def test_shards_of_an_empty_table(spark):
    folder = token_shards.store(empty(spark), WORDS, end_id=2, shards=2)
    assert token_shards.read_digests(empty(spark), folder).count() == 0
    assert token_shards.read_digests(awkward(spark), folder).count() == 0


# -- licences -------------------------------------------------------------------------------------


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places = [
        (i, label)
        for phrase, label in license_scan.PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    return words, places


def license_texts():
    notices = [t for texts in license_scan.NOTICES.values() for t in texts]
    out = [(100 + i, f"{prose(20, i)}\n{t}\n{prose(10, i)}") for i, t in enumerate(notices)]
    out.append((200, "mit license MIT-License general public license mit  license"))
    out.append((201, "license"))
    out.append((202, prose(200, 5) + " Permission is granted free of charge to any person obtaining "
                "a copy of this software and associated documentation files to deal in the software "
                "without any restriction " + prose(300, 6)))  # fmt: skip
    return out


def test_licences_against_plain_rules(spark):
    given_rows = [(r[0], r[1]) for r in awkward_rows()] + license_texts()
    docs = spark.createDataFrame(given_rows, "doc_id bigint, text string")
    made = license_scan.scan(docs)
    got = pairs(made, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    expected = []
    for i, text in given_rows:
        words, places = plain_scan(text or "")
        at = [p for p, _ in places]
        labels = ",".join(sorted({label for _, label in places}))
        expected.append((i, len(words), len(at), min(at, default=None), max(at, default=None), labels))
    assert got == sorted(expected, key=repr)
    rows = {r["doc_id"]: r for r in made.where("doc_id >= 100").collect()}
    labels = [label for label, texts in license_scan.NOTICES.items() for _ in texts]
    for i, label in enumerate(labels):
        assert rows[100 + i]["labels"] == label and rows[100 + i]["score"] == 1.0
    assert rows[201]["labels"] == "" and rows[201]["score"] == 0.0
    assert rows[202]["labels"] == "mit" and 0.8 <= rows[202]["score"] < 1
    assert license_scan.scan(empty(spark)).count() == 0


def test_notices_over_several_lines_and_long_ones(spark):
    long = {"long": [" ".join(f"term{i}" for i in range(150))]}
    notices = license_scan.NOTICES | long
    rows, expected = [], {}
    for i, (label, text) in enumerate((k, t) for k, texts in notices.items() for t in texts):
        for width in (30, 72, 10_000):
            lines = "\n * ".join(textwrap.wrap(text, width, break_long_words=False))
            for before in (0, 7, 40, 61):
                key = len(rows)
                rows.append((key, f"{prose(before, i) if before else ''}\n * {lines}\n{prose(30, i + 9)}"))
                expected[key] = label
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in license_scan.scan(docs, notices=notices).collect():
        assert r["labels"] == expected[r["doc_id"]] and r["score"] == 1.0


@pytest.mark.parametrize("text, labels", [
    ("Released under CC BY-NC 4.0. See the site.", "cc-by-nc"),
    ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa"),
    ("Licensed under CC BY 4.0 or, at your wish, licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
     "cc-by-sa"),
    ("Released under the Apache License.", "apache"),
    ("The report was released yesterday under the new driving license rules.", ""),
    ("Licensed under the Mozilla Public License, Version 2.0", "mpl"),
    ("Licensed under the Eclipse Public License, Version 2.0", ""),
    ("licensed under a new rule by 4 people, 0 objections", ""),
    ("This work is licensed under the GNU Free Documentation License, version 3.", ""),
    ("Released under the " + prose(40, 8) + " MIT of a license", ""),
    ("They may use this file, and you may obtain a copy of the form at the counter.", ""),
    (prose(300, 9), ""),
])
def test_all_labels_of_other_licences_and_prose(text, labels):
    counts = {}
    scanner = license_scan.Scanner(license_scan.prepared(license_scan.NOTICES, counts, 0.8), counts)
    words = license_scan.plain_words(text.encode())
    found = {scanner.notices[i].label for i in scanner.scan(words)}
    base = {label for _, label in license_scan.phrase_places(words, license_scan.PHRASES)}
    assert ",".join(sorted(found | base)) == labels


@pytest.mark.parametrize("names", [{}, {"a": ["w2 w3"], "b": ["w20"], "d": ["w2 w3 w4"]}])
def test_licence_join_finds_what_comparing_all_finds(names):
    rng = random.Random(3)
    notices = {"a": [" ".join(f"w{i}" for i in range(12))], "b": ["w1 w5 w20 w21 w22 w5"], "c": ["w7"]}
    counts = {f"w{i}".encode(): rng.randint(0, 9) for i in range(30)}
    sets = license_scan.prepared(notices, counts, 0.7, names)
    scanner = license_scan.Scanner(sets, counts, names)
    assert [bool(n.name) for n in sets] == ([True, True, False] if names else [False] * 3)
    met = Counter()
    for _ in range(2000):
        spread = rng.choice([3, 12, 30])
        words = [f"w{rng.randint(0, spread)}".encode() for _ in range(rng.randint(0, 60))]
        for at in range(0, len(words) - 12, 15):
            words[at : at + 6] = [f"w{i}".encode() for i in range(6)]
        expected = {}
        for i, notice in enumerate(sets):
            for begin in range(len(words)):
                block = words[begin : begin + notice.room]
                common = len(set(block) & set(notice.words))
                named = not notice.name or any(
                    tuple(block[k : k + len(notice.name)]) == notice.name
                    and not (names and words[begin + k : begin + k + 3] == [b"w2", b"w3", b"w4"])
                    for k in range(len(block))
                )
                if common >= notice.needed and named:
                    expected[i] = max(expected.get(i, 0), common / len(notice.words))
        met.update(expected)
        assert scanner.scan(words) == expected
    assert len(met) == 3


# -- URLs -----------------------------------------------------------------------------------------


def glob_regex(glob):
    out = ""
    for part in re.findall(r"\*\*|\*|\?|[^*?]+", glob):
        out += {"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part)
    return re.compile(out.encode(), re.S)


def test_globs_against_regular_expressions():
    rng = random.Random(1)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?"]) for _ in range(rng.randint(0, 7)))
             for _ in range(40)]
    globs += ["*." + "x" * 70 + "/**", "a" * 130]
    strings = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 9))).encode() for _ in range(300)]
    strings += [b"", b".y." + b"x" * 70 + b"/q", b"a" * 130, b"a" * 129, "é".encode()]
    fits = url_filters.GlobAutomaton(globs).match(strings)
    assert url_filters.GlobAutomaton(globs).words > 3
    for i, text in enumerate(strings):
        for j, glob in enumerate(globs):
            assert fits[i, j] == bool(glob_regex(glob).fullmatch(text)), (glob, text)


def test_urls(spark):
    urls = {
        "http://A.Example.NET/en/x?q": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
        "http://net/": ("net", "/", "net/", "block"),
        "http://net": ("net", "", None, "allow"),
        "http://xnet/a": ("xnet", "/a", None, "allow"),
        "x://b.org/fr/#z": ("b.org", "/fr/", "org/fr/", "allow"),
        "a://http://b.com/": ("http:", "//b.com/", None, "allow"),
        "http://spam.info/x": ("spam.info", "/x", None, "block"),
        "http://example.com/de/\n?": ("example.com", "/de/\n", "example.com/de/", "block"),
        "no url": ("", "", None, "block"),
        "": ("", "", None, "block"),
        None: ("", "", None, "block"),
        "http://a.net/" + "p" * 9_000: ("a.net", "/" + "p" * 9_000, "net/", "block"),
    }
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)] + [(0, next(iter(urls)), "h", "r")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string")
    made = url_filters.filter_urls(pages, queries.URL_RULES)
    found = pairs(made, "page_id", "host", "path", "rule", "verdict")
    answers = list(urls.values())
    assert found == sorted(((i, *answers[i]) for i, *_ in rows), key=repr)
    assert url_filters.filter_urls(pages.limit(0), queries.URL_RULES).count() == 0


# -- chats ----------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(
    texts=st.lists(
        st.lists(
            st.sampled_from([*chat_format.CONTROL, "\\", "<", "[", "s>", "/INST]", "a", "|", "\n"]),
            max_size=8,
        ).map("".join),
        min_size=1,
        max_size=3,
    )
)
def test_escaping_is_reversible(texts):
    for text in texts:
        escaped = chat_format.escape(text)
        assert chat_format.unescape(escaped) == text
        segment = f"{chat_format.BEGIN}{chat_format.TURN}{escaped}{chat_format.TURN_END}{escaped}{chat_format.END}"
        assert chat_format.parse(segment) == (text, text)


def test_parts_become_placeholders(spark):
    parts = [
        {"kind": "text", "text": "see <|image|> "},
        {"kind": "image", "ref": "a.png", "width": 28, "height": 15},
        {"kind": "audio", "ref": "b.wav", "seconds": 2.01},
        None,
        {"kind": "document", "ref": "c.pdf", "pages": 2},
        {"kind": None, "text": None},
    ]
    rows = [(1, 0, "assistant", parts), (1, 1, "user", None)]
    turns = spark.createDataFrame(
        rows, f"conv_id bigint, turn bigint, role string, parts array<{chat_format.PART}>"
    )
    segments = sorted(chat_format.format_turns(turns).collect(), key=lambda r: r["seq"])
    text = "".join(r["segment"] for r in segments)
    notes = segments[0]["attachments"]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in notes] == [
        ("image", "a.png", 4), ("audio", "b.wav", 51), ("document", "c.pdf", 1536),
    ]
    for a in notes:
        mark = chat_format.PLACEHOLDERS[a["kind"]]
        assert text[a["at"] : a["at"] + len(mark)] == mark
    digest = chat_format.digests(chat_format.format_turns(turns)).first()
    assert digest["loss_sha256"] == hashlib.sha256(b"see <|image|> ").hexdigest()
    assert digest["n_attachments"] == 3 and digest["formatted_chars"] == len(text)


def test_unknown_parts_are_an_error(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", [{"kind": "video"}])],
        f"conv_id bigint, turn bigint, role string, parts array<{chat_format.PART}>",
    )
    with pytest.raises(Exception, match="unknown kind"):
        chat_format.format_turns(turns).collect()


def test_chats_read_back(spark):
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(30)]:
        for turn in [None, *range(rng.randint(0, 6))]:
            text = None if rng.random() < 0.1 else rng.choice([prose(9, turn or 0), "</s>", "[/INST]\\", ""])
            rows.append((conv, turn, rng.choice(["user", "assistant", None, "a[END]"]), text, "x"))
    rows += [rows[5], rows[6]]
    rows.append((2**60 + 1, 0, "assistant", "y" * 300_000, "x"))
    turns = spark.createDataFrame(
        rows, "conv_id bigint, turn bigint, role string, text string, segment string"
    )
    found = pairs(
        chat_format.digests(chat_format.format_turns(chat_format.text_parts(turns))),
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
    )
    expected = []
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "",
                                chat_format.escape(r[3] or "")))
        turns_text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        expected.append((conv, len(own), hashlib.sha256(turns_text.encode()).hexdigest(), len(loss),
                         hashlib.sha256(loss.encode()).hexdigest()))
    assert found == sorted(expected, key=repr)
    assert chat_format.digests(
        chat_format.format_turns(chat_format.text_parts(turns.limit(0)))
    ).count() == 0


# -- words ----------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.binary(max_size=40), max_size=5))
def test_word_hashes_tell_words_apart(texts):
    for table, cut in ((SPACED, spaced_words), (PLAIN, plain_words)):
        hashes, offsets = word_hashes(texts, table)
        words = [w for t in texts for w in cut(t)]
        assert np.diff(offsets).tolist() == [len(cut(t)) for t in texts]
        assert len(set(hashes.tolist())) == len(set(words))
        assert len(set(zip(hashes.tolist(), words))) == len(set(words))


def test_word_hashes_of_long_texts(monkeypatch):
    text = prose(3_000, 1).encode()
    whole, _ = word_hashes([text])
    monkeypatch.setattr("riskloom.llm.word_hashes.SLICE", 500)
    assert (word_hashes([text])[0] == whole).all()
    assert (word_hashes([text[:900], text, b""])[0][-len(whole) :] == whole).all()
    assert len(word_hashes([b"x" * 20_000])[0]) == 1
