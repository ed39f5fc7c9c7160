"""SimHash near duplicates against plain loops."""

import random

import pytest
import xxhash

from riskloom.llm import near_simhash
from tests.llm.tables import awkward, awkward_rows, empty, pairs


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    label = {p: p for p in prints}

    def top(p):
        while label[p] != p:
            p = label[p]
        return p

    nodes = sorted(label)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= radius:
                label[top(a)] = top(b)
    return {p: top(p) for p in nodes}


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def test_groups_equal_plain_loops(spark):
    got = near_simhash.groups(awkward(spark)).collect()
    rows = [(r[0], plain_fingerprint(r[1])) for r in awkward_rows()]
    comp = plain_components([p for _, p in rows], 2)
    least = {}
    for key, p in rows:
        if key is not None:
            least[comp[p]] = min(key, least.get(comp[p], key))
    want = [
        (key, signed(p), sum(q == p for _, q in rows), least.get(comp[p])) for key, p in rows
    ]
    found = [tuple(r) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("portion", [7, 100])
def test_portions_do_not_change_a_fingerprint(monkeypatch, portion):
    text = " ".join(str(i % 37) for i in range(500))
    monkeypatch.setattr(near_simhash, "PORTION", portion)
    assert near_simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3])
@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_components_of_fingerprints(spark, radius, hot_rows):
    rng = random.Random(radius)
    prints = []
    for _ in range(30):  # chains and stars of fingerprints 0 to 4 bits apart
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            q = p
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                q ^= 1 << bit
            prints.append(q)
            p = rng.choice([p, q])
    table = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint bigint")
    links = near_simhash.links(table, radius)
    rows = links.collect()
    assert len({tuple(r) for r in rows}) == len(rows)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= radius and r.a < r.b for r in rows)
    want = plain_components(prints, radius)
    from riskloom.operators.graph import components

    label = {r.node: r.label for r in components(links, hot_rows).collect()}
    got = {}
    for p in want:
        got.setdefault(label.get(signed(p), signed(p)), set()).add(want[p])
    assert all(len(tops) == 1 for tops in got.values())
    assert len(got) == len(set(want.values()))


def test_a_third_of_the_rows_is_one_text(spark):
    rows = [(i, "the same text in many rows") for i in range(100)]
    rows += [(i, f"another text with the number {i} in it {i * i}") for i in range(100, 200)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = pairs(near_simhash.groups(table), "doc_key", "fingerprint", "component")
    assert pairs(near_simhash.groups(table, hot_rows=5), "doc_key", "fingerprint", "component") == want
    assert [c for k, _, c in want if k < 100] == [0] * 100


def test_empty_table_and_text_ids(spark):
    assert near_simhash.groups(empty(spark)).count() == 0
    table = awkward(spark)
    by_text = table.selectExpr("'d' || doc_id AS doc_id", "text")
    assert near_simhash.groups(by_text).count() == table.count()
