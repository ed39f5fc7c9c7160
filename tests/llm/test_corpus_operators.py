"""Joins, fingerprints, decontamination, toxicity and language models against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import decontaminate, gru, jaccard_join, lm_scoring, simhash, toxicity
from riskloom.llm.components import components
from riskloom.llm.gru import Adam, Gru, classes_of
from riskloom.llm.queries import QUERIES
from riskloom.llm.rows import plain_words, spaced_words
from riskloom.llm.word_hashes import PLAIN, word_hashes
from tests.llm.tables import awkward, awkward_rows, empty, pairs, prose

# -- components and the Jaccard join --------------------------------------------------------------


def union_find(nodes, links):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_random_links(spark):
    rng = random.Random(2)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    links += [(i, i + 1) for i in range(200, 240)] + [(3, 3)]
    found = components(spark.createDataFrame(links, "a bigint, b bigint"))
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert {r["node"]: r["label"] for r in found.collect()} == union_find(nodes, links)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingle_set(text):
    words = spaced_words((text or "").encode())
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_groups(rows):
    sets = [shingle_set(t) for _, t in rows]
    links = [
        (i, j)
        for i, j in combinations(range(len(rows)), 2)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    label = union_find(range(len(rows)), links)
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in label if label[j] == label[i] and rows[j][0] is not None]
        out.append((key, len(sets[i]), min(keys, default=None) if sets[i] else key))
    return sorted(out, key=repr)


def copies(seed, n, edits):
    """Near copies of one text: some pairs are alike enough, others only through others."""
    rng = random.Random(seed)
    words = prose(70, seed).split()
    out = []
    for _ in range(n):
        own = list(words)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(["new", "word", f"x{rng.randrange(99)}"])
        out.append(" ".join(own))
    return out


def test_copies_are_dealt_evenly_and_a_clashing_column_stays(spark):
    rows = [(i, prose(60, 1) if i % 3 else prose(60, i), i) for i in range(600)]
    rows += [(600 + i, "", i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __kept bigint")
    batch = pa.RecordBatch.from_pylist(
        [{"k": str(i), "t": t.encode()} for i, t, _ in rows], pa.schema([("k", pa.string()), ("t", pa.binary())])
    )
    made = pa.Table.from_batches(
        spark.createDataFrame([(1,)], "a int").mapInArrow(
            lambda _: jaccard_join._spread(8, 5)([batch]), jaccard_join._MADE_SQL
        ).toArrow().to_batches()
    ).to_pandas()
    per_range = made[made["doc_key"].notna()].groupby("part").size()
    assert len(per_range) == 8 and per_range.max() <= per_range.min() + 1
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    expected = {i for i, t, _ in rows if not t or i % 3 == 0} | {1}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == expected


def test_long_lists_grow_with_their_rows_until_every_pair_counts(spark):
    rows = [(7, i, i, 1) for i in range(400)] + [(8, i, 5, 1) for i in range(400)]
    postings = spark.createDataFrame(rows, "token bigint, sig bigint, label bigint, n bigint")
    linear = jaccard_join._listed(postings, 10, False)
    assert linear.where("token = 7").count() == 800 and linear.where("token = 8").count() == 0
    lists = jaccard_join._listed(postings, 10, True).where("token = 7")
    own = [{r["sig"] for r in g} for g in _grouped(lists.collect(), "one", "two").values()]
    for a, b in [(0, 1), (3, 399), (17, 200)]:
        assert any({a, b} <= x for x in own)


def _grouped(rows, *names):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[n] for n in names), []).append(r)
    return out


@pytest.mark.parametrize("list_rows", [4_000, 7])
def test_groups_against_brute_force(spark, list_rows):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    texts = [t for s in range(4) for t in copies(s, 25, 4)]
    texts += [f"{prose(12, 77)} {prose(random.Random(i).randint(5, 60), 900 + i)}" for i in range(40)]
    chain = prose(90, 5).split()
    texts += [" ".join(chain[4 * i : 4 * i + 45]) for i in range(10)]
    rows += [(1_000 + i, t) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, 2, "c") for r in rows],
                                 "doc_id bigint, text string, n bigint, sig bigint, component string")
    found = jaccard_join.groups(docs.repartition(4), list_rows=list_rows)
    assert pairs(found, "doc_key", "n_shingles", "component") == brute_groups(rows)


def test_one_of_each_group(spark):
    docs = awkward(spark)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    got = Counter(r["doc_id"] for r in kept.collect())
    groups = {(k, c) for k, _, c in brute_groups([(r[0], r[1]) for r in awkward_rows()])}
    assert set(got) == {k for k, c in groups if k == c}
    assert got[13] == 1 and got[6] == got[7] == got[8] == 1 and 2 not in got
    assert jaccard_join.groups(empty(spark)).count() == 0


# -- decontamination ------------------------------------------------------------------------------

ITEMS = [(i, prose(n, 50 + i).capitalize() + ".") for i, n in enumerate((20, 25, 25, 40, 70, 7, 3))]
ITEMS += [(90, ""), (91, None), (1, ITEMS[1][1])]


def brute_matches(rows, items):
    settings = decontaminate.Settings()
    own = decontaminate.Items([i for i, _ in items], [(t or "").encode() for _, t in items], settings)
    held = Counter(s for c in own.sets for s in set(c))
    n = len(own.sets)
    out = set()
    for key, text in rows:
        words = plain_words((text or "").encode())
        for item, item_text in items:
            target = plain_words((item_text or "").encode())
            if not target:
                continue
            best = 0.0
            hashes = word_hashes([(text or "").encode()], PLAIN)[0].tolist()
            goal = word_hashes([item_text.encode()], PLAIN)[0].tolist()
            for a in range(len(words) - len(target) + 1):
                x, y = (Counter(own._shingles(z)) for z in (hashes[a : a + len(target)], goal))
                w = {s: math.log((1 + n) / max(1, held[s])) for s in x | y}
                both = sum(w[s] * min(x[s], y[s]) for s in w)
                either = sum(w[s] * max(x[s], y[s]) for s in w)
                best = max(best, both / either)
            if best >= 0.75:
                out.add((key, item, round(best, 9)))
    return out


def contaminated_rows():
    rng = random.Random(8)
    rows = []
    for i, text in ITEMS[:7]:
        words = text.split()
        rows.append((100 + i, f"{prose(30, i)} {text} {prose(20, 60 + i)}"))
        rows.append((200 + i, f"{prose(9, i)}\n" + " ".join(w.upper() + "!!" for w in words)))
        changed = list(words)
        changed[rng.choice([0, len(words) - 1])] = "changed"
        rows.append((300 + i, f"{prose(15, i)} {' '.join(changed)} {prose(15, i + 9)}"))
        rows.append((400 + i, " ".join(words[: len(words) // 2]) + " " + prose(30, i + 30)))
    return rows


def test_passages_against_brute_force(spark):
    rows = [(r[0], r[1]) for r in awkward_rows() if r[0] != 11] + contaminated_rows()
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, similarity double")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = decontaminate.find(docs, items)
    got = {(r["doc_key"], r["item_key"], round(r["similarity"], 9)) for r in found.collect()}
    assert got == brute_matches(rows, ITEMS)
    assert {(100 + i, i, 1.0) for i in range(7)} <= got
    small = decontaminate.Settings(items_at_once=3)
    assert {x[0] for x in got} >= {r["doc_key"] for r in decontaminate.find(docs, items, settings=small).collect()}
    kept = decontaminate.clean(docs, items)
    hit = {k for k, _, _ in got}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(k for k, _ in rows if k not in hit)
    assert kept.columns == docs.columns
    assert decontaminate.find(empty(spark), items).count() == 0
    assert decontaminate.find(docs, items.limit(0)).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == len(rows)


def test_copies_and_blocks_of_items_change_no_match(spark):
    often = prose(50, 321).split()
    items = [(i, " ".join(often)) for i in range(20)]
    items += [(100 + i, f"{prose(30, 400 + i)} {' '.join(often[:12])}") for i in range(40)]
    changed = [*often[:25], "changed", *often[26:]]
    rows = [(1, f"{prose(20, 1)} {' '.join(changed)} {prose(20, 2)}"), (2, items[30][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = [
        pairs(decontaminate.find(docs, table, settings=decontaminate.Settings(items_at_once=n)),
              "doc_key", "item_key", "similarity", "first_word", "n_words")
        for n in (20_000, 7)
    ]
    assert found[0] == found[1]
    assert {x[:2] for x in found[0]} == {(1, i) for i in range(20)} | {(2, 110)}


def test_tables_find_all_within_the_radius():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    flips = [int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 25), False))) for _ in range(200)]
    asked = prints[rng.integers(0, 40, 200)] ^ np.array(flips, np.uint64)
    found = decontaminate.Tables(np.arange(40), prints, 18).near(asked)
    apart = np.bitwise_count(asked[:, None] ^ prints[None])
    assert set(found) == set(zip(*(x.tolist() for x in np.nonzero(apart <= 18))))


def test_long_texts_go_by_in_parts(monkeypatch):
    items = decontaminate.Items([1], [ITEMS[4][1].encode()], decontaminate.Settings())
    text = (prose(900, 3) + " " + ITEMS[4][1] + " " + prose(300, 4)).encode()
    whole = decontaminate._found(items, [text])
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    assert decontaminate._found(items, [text]) == whole and len(whole) == 1


# -- SimHash --------------------------------------------------------------------------------------


def brute_fingerprint(spark, texts):
    """The same votes, one text at a time."""
    words = sorted({w for t in texts for w in spaced_words(t.encode())})
    rows = spark.createDataFrame([(w.decode(),) for w in words], "w string")
    hashes = {r[0]: r[1] for r in rows.selectExpr("w", "xxhash64(w)").collect()}
    out = []
    for text in texts:
        votes = [0] * 64
        for word in {w.decode() for w in spaced_words(text.encode())}:
            weight = min(32, len(word))
            for k in range(64):
                votes[k] += weight if hashes[word] >> k & 1 else -weight
        out.append(sum(1 << k for k in range(64) if votes[k] > 0))
    return out


def test_fingerprints_of_awkward_rows(spark):
    rows = [(r[0], r[1] or "") for r in awkward_rows() if r[0] is not None and r[0] != 15]
    docs = awkward(spark).where("doc_id is not null and doc_id <> 15")
    order = sorted(set(rows), reverse=True)
    after = {r: order[(i + 1) % len(order)] for i, r in enumerate(order)}
    edited = []
    for key, text in rows:
        third = len(text) // 3
        edited.append(text[: len(text) - third] + after[key, text][1][:third])
    prints = brute_fingerprint(spark, [t for _, t in rows] + edited)
    own, changed = prints[: len(rows)], prints[len(rows) :]
    by_row = dict(zip(rows, own))
    expected = []
    for row, e, a, b in zip(rows, edited, own, changed):
        near = [1 - bin(x).count("1") / 64 for x in (a ^ b, a ^ by_row[after[row]])]
        expected.append((row[0], len(row[1]), hashlib.sha256(e.encode()).hexdigest(),
                         f"{a:016x}", f"{b:016x}", *near))
    made = simhash.document_fingerprints(docs)
    names = ("doc_key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
             "near_edited", "near_next")
    assert pairs(made, *names) == sorted(expected, key=repr)


def test_fingerprints_of_all_awkward_rows_and_few(spark):
    assert simhash.document_fingerprints(awkward(spark)).count() == len(awkward_rows())
    assert simhash.document_fingerprints(empty(spark)).count() == 0
    one = simhash.document_fingerprints(awkward(spark).where("doc_id = 5")).first()
    assert one["near_next"] == 1.0 and one["n_within"] is None


def test_documents_found_within_the_radius(spark):
    base = [prose(200, i) for i in range(4)]
    rows = [(i, base[i % 4] + (f" {i}" if i % 3 == 1 else "")) for i in range(60)]
    rows += [(50, base[2]), (50, base[2]), (0, ""), (7, None), (None, base[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    prints = simhash.document_fingerprints(docs, every=10)
    made = prints.select("doc_key", "fingerprint", "n_within").collect()
    values = [int(r["fingerprint"], 16) for r in made]
    near = [[j for j, y in enumerate(values) if (x ^ y).bit_count() <= 3] for x in values]
    for own, found in zip(made, near):
        asked = own["doc_key"] is not None and own["doc_key"] % 10 == 0
        assert own["n_within"] == (len(found) - 1 if asked else None)
    expected = {
        (own["fingerprint"], made[j]["fingerprint"])
        for own, found in zip(made, near) if own["doc_key"] is not None and own["doc_key"] % 10 == 0
        for j in found if made[j]["fingerprint"] != own["fingerprint"]
    }
    assert expected
    assert {tuple(r) for r in simhash.links(prints, every=10).collect()} == expected
    texts = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert simhash.document_fingerprints(texts).where("n_within is not null").count() == 0


@pytest.mark.parametrize("radius, blocks", [(3, 6), (2, 4), (0, 1), (7, 9)])
def test_search_finds_all_within_the_radius(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(20)]
    table = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 9))) for b in base * 5]
    signed = [x - (1 << 64) if x >> 63 else x for x in table]
    df = spark.createDataFrame([(x,) for x in signed] + [(None,)], "fingerprint bigint")
    found = simhash.search(df.limit(30), df, radius, blocks)
    asked = {r[0] for r in df.limit(30).collect()} - {None}
    mask = (1 << 64) - 1
    expected = {(a, b) for a in asked for b in set(signed)
                if bin((a ^ b) & mask).count("1") <= radius}
    assert {tuple(r) for r in found.collect()} == expected


# -- toxicity -------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def test_automata_on_the_trie_against_edit_distance():
    rng = random.Random(6)
    terms = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(3, 9))) for _ in range(60)})
    words = [t for t in terms] + ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 10)))
                                  for _ in range(800)]
    for edits in (1, 2):
        trie = toxicity.Trie(terms, edits, 5)
        for word in words:
            expected = {(i, distance(word, t)) for i, t in enumerate(terms)
                        if len(t) >= 5 and distance(word, t) <= edits}
            own = terms.index(word) if word in terms else None
            assert set(trie.match(word)) == ({(own, 0)} if own is not None else expected)


def test_context_separates_quotation_from_abuse():
    model = toxicity.Model(["idiot"], np.array([[4.0, 2.0]]), np.array([1.0, 0.0, -2.0]))
    matcher = toxicity.Matcher(model.terms, model.settings)
    abuse, plain, quoted, reported, misspelled, none, empty_text = toxicity._scores(
        matcher, model,
        [b"you idiot go away", b"an idiot is here", 'the word "idiot" is old'.encode(),
         b"he wrote that idiot there", b"an idoit idiiot", b"nothing here", b""],
    )
    assert abuse > plain > quoted and plain > reported and plain > misspelled > none
    assert 0 < empty_text < 0.5


def test_held_out_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet".replace("sf0.01", "sf0.1"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet".replace("sf0.01", "sf0.1"))
    model = toxicity.learn(docs, labels)
    scored = toxicity.score(docs, model).join(labels, labels["doc_id"] == F.col("doc_key"))
    rows = scored.where("held_out").select("toxic", "score", "predicted", "doc_key").collect()
    assert all((zlib.crc32(str(r["doc_key"]).encode()) % 3 == 1) for r in rows)
    toxic = [r for r in rows if r["toxic"]]
    clean = [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.8 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_toxicity_of_awkward_rows(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity.learn(docs, none)
    assert {r["predicted"] for r in toxicity.score(docs, model).collect()} == {0}
    labels = spark.createDataFrame(
        [(1, 0, 0), (1, 0, 0), (2, 0, None), (None, 0, 1), (3, 0, 1), (5, 0, 1), (9, 0, 0), (999, 0, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    model = toxicity.learn(docs, labels)
    assert toxicity.score(docs, model).count() == len(awkward_rows())
    kept = toxicity.kept(docs, model)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert toxicity.score(empty(spark), model).count() == toxicity.kept(empty(spark), model).count() == 0
    assert toxicity.learn(empty(spark), labels).terms == []


# -- language models ------------------------------------------------------------------------------


def small_model(seed=0):
    counts = np.array([50.0, 30, 20, 9, 8, 7, 3, 2, 1, 0])
    model = Gru.fresh(counts, classes_of(counts + 0.5, 4), 6, seed)
    rng = np.random.default_rng(seed)
    for name in Gru.NAMES:
        value = getattr(model, name)
        setattr(model, name, rng.normal(0, 0.4, value.shape))
    return model


def test_probabilities_add_up_to_one():
    model = small_model()
    states = np.random.default_rng(1).normal(0, 1, (5, 6))
    total = sum(np.exp(model.log_probs(states, np.full(5, t))) for t in range(10))
    assert np.allclose(total, 1)


def test_gradients_against_differences():
    model = small_model()
    rng = np.random.default_rng(2)
    inputs, targets = rng.integers(0, 10, (3, 7)), rng.integers(0, 10, (3, 7))
    valid = np.arange(7) < np.array([7, 4, 1])[:, None]
    state = np.zeros((3, 6))

    def loss():
        before, _, _ = model.states(inputs, state)
        fits = valid.T.ravel()
        exact = np.zeros((7, 3, 6))
        s = state
        for t in range(7):
            exact[t] = s
            _, s, _ = model.states(inputs[:, t : t + 1], s)
        return -model.log_probs(exact.reshape(-1, 6)[fits], targets.T.ravel()[fits]).mean()

    grads, _, _ = model.gradient(inputs, targets, valid, state)
    for name in Gru.NAMES:
        value = getattr(model, name)
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            old = value[at]
            value[at] = old + 1e-5
            up = loss()
            value[at] = old - 1e-5
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-3


def test_state_goes_on_from_window_to_window():
    model = small_model()
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 10, n) for n in (1, 40, 7, 23)]
    expected = []
    for text in texts:  # the state before a token comes from the tokens before it
        state, total, last = np.zeros((1, 6)), 0.0, 4
        for token in text:
            before, state, _ = model.states(np.array([[last]]), state)
            total += model.log_probs(before[0], np.array([token]))[0]
            last = token
        expected.append(total)
    for window in (1, 5, 64):
        assert np.allclose(model.score(texts, 4, window), expected, atol=1e-4)
    assert model.score([], 4, 8).size == 0


def test_scoring_holds_few_texts_at_a_time(monkeypatch):
    model, taken = small_model(), []
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 10, n) for n in (0, 5, 40, 7, 7, 23, 1, 8)]
    whole = model.score(texts, 4, 5)
    monkeypatch.setattr(gru, "TEXTS_AT_ONCE", 3)
    states = Gru.states
    monkeypatch.setattr(Gru, "states", lambda self, x, *a: taken.append(len(x)) or states(self, x, *a))
    assert np.allclose(model.score(texts, 4, 5), whole, atol=1e-4)
    assert max(taken) == 3


def test_gradients_of_the_trees_against_whole_ways():
    model = small_model()
    rng = np.random.default_rng(5)
    flat, wanted = rng.normal(0, 1, (60, 6)), rng.integers(0, 10, 60)
    back = np.zeros((60, 6))
    (nodes, rows), (_, odds_rows), loss = model._down_the_trees(flat, wanted, back, 60, True)
    assert len(set(nodes.tolist())) == len(nodes)
    made, made_odds = np.zeros_like(model.O), np.zeros_like(model.o)
    made[nodes], made_odds[nodes] = rows, odds_rows
    expected, odds, to_flat, lost = np.zeros_like(model.O), np.zeros_like(model.o), np.zeros((60, 6)), 0.0
    for place, node, behind in zip(*model.tree.ways(wanted)):
        p = 1 / (1 + np.exp(-flat[place] @ model.O[node] - model.o[node]))
        lost -= np.log(p if behind else 1 - p)
        expected[node] += (p - behind) * flat[place] / 60
        odds[node] += (p - behind) / 60
        to_flat[place] += (p - behind) * model.O[node]
    assert np.allclose(made, expected) and np.allclose(made_odds, odds)
    assert np.allclose(back, to_flat) and np.isclose(loss, lost)


def brute_base(rows):
    counts, tokens = Counter(), []
    for key, text in rows:
        own = [*spaced_words((text or "").encode()), None]
        tokens.append(own)
        if zlib.crc32(("" if key is None else str(key)).encode()) % 5 != 1:
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    out = []
    for (key, _), own in zip(rows, tokens):
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        out.append((key, len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)))
    return sorted(out, key=repr)


def test_base_scores_against_brute_force(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()] + [(500 + i, prose(60, i)) for i in range(30)]
    rows.append((700, "often " * 900))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows],
                                 "doc_id bigint, text string, word bigint, block bigint")
    made = lm_scoring.score(docs.repartition(3), settings=lm_scoring.Settings(vocabulary=20, classes=5, train_share=1.0))
    found = [(r["doc_key"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
             for r in made.collect()]
    assert sorted(found, key=repr) == brute_base(rows)
    assert all(r["score"] < 0 for r in made.collect())


def test_every_training_document_trains_a_growing_vocabulary(spark):
    rows = [(i, f"{prose(50, i)} " + " ".join(f"w{i}x{j}" for j in range(i % 60))) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    settings = lm_scoring.Settings()
    found = lm_scoring.counts(docs, "doc_id", "text", settings)
    used = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in spaced_words(t.encode()))
    size = math.ceil(8 * math.sqrt(len(used) + 1))
    assert len(found.counts) == size > settings.vocabulary
    assert sorted(found.counts.tolist(), reverse=True) == sorted(used.values(), reverse=True)[:size]
    train = lm_scoring.training(docs, found, "doc_id", "text", settings, 8).collect()
    assert sum(len(r["ids"]) for r in train) == 2 * found.total
    assert {r["round"] for r in train} == {0, 1, 2} and {r["worker"] for r in train} == set(range(8))


def test_copies_of_a_text_train_in_all_workers_and_rounds(spark):
    rows = [(i, "the same words again") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    settings = lm_scoring.Settings()
    found = lm_scoring.counts(docs, "doc_id", "text", settings)
    train = lm_scoring.training(docs, found, "doc_id", "text", settings, 8)
    sizes = [r["count"] for r in train.groupBy("worker", "round").count().collect()]
    assert len(sizes) == 24 and max(sizes) < 2 * sum(sizes) / 24


def test_scores_of_none_and_of_held_out_only(spark):
    assert lm_scoring.score(empty(spark)).count() == 0
    held = [(i, "some words") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    made = lm_scoring.score(spark.createDataFrame(held, "doc_id bigint, text string")).collect()
    assert len(made) == len(held) and all(r["n_known"] == r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in made)


def test_the_model_beats_the_counts_on_held_out_texts(spark, sf_dir):
    rows = QUERIES["op10_lm_scoring"](spark, sf_dir).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


# -- pipeline -------------------------------------------------------------------------------------


def test_stages_stand_awkward_rows(spark, sf_dir):
    for docs in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, sf_dir)
            assert kept.columns == docs.columns, name
            assert kept.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_pipeline_against_its_parts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in QUERIES["op9_toxicity"](spark, sf_dir).collect() if r["predicted"]}
    left = [(k, t) for k, t in texts.items() if k not in toxic]
    groups = spark.createDataFrame(left, "doc_id bigint, text string")
    first = {r["doc_key"] for r in jaccard_join.groups(groups).collect() if r["doc_key"] == r["component"]}
    leaked = {r["doc_id"] for r in QUERIES["op7_decontaminate"](spark, sf_dir).collect()}
    made = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(made) == first - leaked
    assert all(made[k] == hashlib.sha256(texts[k].encode()).hexdigest() for k in made)


def test_op10_windows_are_full_and_take_every_token_once(monkeypatch):
    model = Gru.fresh(np.full(20, 5.0), classes_of(np.full(20, 5.0), 4), 4, 1)
    windows = []
    own = Gru._gradient

    def seen(self, inputs, targets, valid, *more):
        windows.append((valid.sum(), np.sort(targets[valid])))
        return own(self, inputs, targets, valid, *more)

    monkeypatch.setattr(Gru, "_gradient", seen)
    rng = np.random.default_rng(3)
    blocks = [[rng.integers(0, 20, n) for n in [160, *[16] * 10]] for _ in range(5)]
    adam = Adam(model, 0.01)
    for block in blocks:
        adam.train(block, 0, 8, 4)
    adam.finish(0, 8)
    texts = np.concatenate([t for block in blocks for t in block])
    assert np.array_equal(np.sort(np.concatenate([w for _, w in windows])), np.sort(texts))
    # 200 lanes of a window, four side by side; only the last long text may be left alone.
    assert adam.step <= 200 / 4 + 20
    assert not adam.lanes and np.isfinite(model.flat()).all()
