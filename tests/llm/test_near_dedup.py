import random

import numpy as np
import pytest

from isoframe.llm import near_dedup


def sets(text, width):
    w = (text or "").encode().translate(near_dedup.LOWER).split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)])


def brute(rows, width, percent):
    found = {i: sets(t, width) for i, t in rows}
    part = {i: i for i in found}
    ids = sorted(found)
    for a in ids:
        for b in ids:
            x, y = found[a], found[b]
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((part[a], part[b]))
                part = {k: p if v == q else v for k, v in part.items()}
    return sorted((i, len(found[i]), part[i], part[i] == i) for i in found)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 200))] for _ in range(6)]
    rows = []
    for k in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        rows.append((k * 3, " ".join(t)))
    return rows


@pytest.mark.parametrize("width,percent,seed", [(3, 85, 1), (5, 80, 2)])
def test_groups_match_brute_force(spark, width, percent, seed):
    rows = corpus(seed) + [(1000, ""), (1001, None), (1002, "a b"), (1003, "A  b"), (1004, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dedup.near_duplicates(docs, width, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, width, percent)


def test_blocks_of_a_full_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = corpus(3, 80)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dedup.near_duplicates(docs, 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, 3, 85)


def test_odd_rows(odd_docs, no_docs):
    got = near_dedup.near_duplicates(odd_docs, 3, 85).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert by[None].component_id is None and not by[None].kept
    assert by[4].component_id == 4 and by[4].n_shingles == 0 and by[4].kept
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 99)], "a bigint, b bigint")
    got = {r.node: r.component for r in near_dedup.components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {99: 99, 100: 99}


def test_shifted_permutation_estimates_similarity():
    rng = np.random.default_rng(0)
    assert len(np.unique(near_dedup.permute(np.arange(1 << 16, dtype=np.uint32)))) == 1 << 16
    errors = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 300, dtype=np.uint64)
        y = np.concatenate([x[:200], rng.integers(0, 2**63, 50, dtype=np.uint64)])
        errors.append((near_dedup.signature(x) == near_dedup.signature(y)).mean() - 200 / 350)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
