import hashlib
import re

from isoframe.llm import decontaminate

W = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return W.findall((t or "").translate(LOW))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(len(b), 10)
        if not n or item is None:
            continue
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    listed = ",".join(sorted(map(str, found)))
    return len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)


ITEMS = [
    (1, "the quick brown fox jumps over the lazy dog and runs"), (10, "fox jumps over the lazy dog and runs away from the big bad wolf"),
    (2, "Im Haus"), (2, "im haus!"), (3, None), (4, "..."), (None, "one"), (5, "word5 and the 5 word6 and the 6 word7 and the 7"), (6, "x ▁"),
]


def check(spark, docs, **how):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = sorted((str(r.doc_id), *brute(r.text, ITEMS)) for r in docs.select("doc_id", "text").collect())
    got = decontaminate.contamination(docs, items, **how).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    return got


def test_matches_brute_force(spark, odd_docs):
    got = check(spark, odd_docs)
    assert any(r.n_items > 1 for r in got) and any(not r.contaminated for r in got)


def test_blocks_of_the_benchmark_give_the_same(spark, odd_docs):
    check(spark, odd_docs, block_bytes=100)


def test_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in decontaminate.contamination(odd_docs, items).collect())
    assert decontaminate.contamination(no_docs, items).count() == 0


def test_every_long_span_shares_a_fingerprint():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(200):
        span = rng.integers(1, 4, decontaminate.WINDOW)
        a, b = (np.concatenate([rng.integers(1, 4, rng.integers(0, 20)), span, rng.integers(1, 4, rng.integers(0, 20))]) for _ in range(2))
        kept = [set(h[decontaminate.winnow(h, decontaminate.SPREAD)].tolist()) for h in (decontaminate.gram_hashes(x, decontaminate.GRAM) for x in (a, b))]
        assert kept[0] & kept[1]
