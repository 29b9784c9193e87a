import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from isoframe.llm import class_lm, pu_quality


def test_base_score_and_counts(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(class_lm, "UNIT_WORDS", 2)
    docs = odd_docs.withColumn("train", F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)))
    rows = docs.select("doc_id", "text", "train").collect()
    count = Counter()
    for r in rows:
        if r.train:
            count.update([*class_lm.tokens((r.text or "").encode()), b""])
    n, v = sum(count.values()), len(count)
    for head in (500_000, 4):
        model, rare = class_lm.fit(docs.where("train"), head=head)
        got = class_lm.score(docs, model, rare).collect()
        want = []
        for r in rows:
            t = [*class_lm.tokens((r.text or "").encode()), b""]
            want.append((str(r.doc_id), len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)))
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
        brute = sorted((str(r.doc_id), brute_score(model, count, [x.text or "" for x in rows if x.train], r.text or "")) for r in rows)
        assert [(i, round(x, 6)) for i, x in brute] == sorted((str(r.doc_id), round(r.score, 6)) for r in got)


def brute_score(model, count, train, text):
    """log10 probability by the classes of single words, with all counts taken from the training texts."""
    u = model.units

    def cls(w):
        return int(model.head_class[u.head[w]] if w in u.head else model.member[u.of(w)])

    k = model.k
    table, mass = np.zeros((k, k)), np.full(k, 0.5)
    for t in train:
        t = [b"", *class_lm.tokens(t.encode()), b""]
        for v, w in zip(t[:-1], t[1:], strict=True):
            table[cls(v), cls(w)] += 1
    for w in {b"", *count}:
        mass[cls(w)] += count[w] + 0.5
    own = mass / mass.sum()
    out, v = 0.0, b""
    for w in [*class_lm.tokens(text.encode()), b""]:
        a, b = cls(v), cls(w)
        out += math.log10((table[a, b] + class_lm.PULL * own[b]) / (table[a].sum() + class_lm.PULL) * (count[w] + 0.5) / mass[b])
        v = w
    return out


def test_best_classes_match_single_moves():
    """Words of classes 0 and 1 between words of classes 2 to 5: each goes where it alone raises the likelihood most."""
    rng = np.random.default_rng(1)
    own, rows = rng.integers(0, 2, 8), 200
    place, before, after = np.sort(rng.integers(0, 8, rows)), rng.integers(2, 6, rows), rng.integers(2, 6, rows)
    n = rng.integers(1, 9, rows).astype(float)

    def table_of(own):
        t = np.zeros((6, 6))
        np.add.at(t, (before, own[place]), n)
        np.add.at(t, (own[place], after), n)
        return t

    got = class_lm.best_classes(own, place, before, after, n, table_of(own))
    moved = 0
    for w in range(8):
        values = [class_lm.likelihood(table_of(np.where(np.arange(8) == w, c, own))) for c in (0, 1)]
        assert got[w] > 1 or values[got[w]] >= max(values) - 1e-9
        moved += got[w] != own[w]
    assert moved


def test_passes_send_few_rows_in_small_batches(spark, monkeypatch):
    """Pairs go as a row for each unit, neighbours as a row for each word, words in batches; classes are those by all contexts."""
    sent = []

    def watched(rows, f, schema, in_arrow=class_lm.in_arrow):
        sent.append((f, in_arrow(rows, f, schema)))
        return sent[-1][1]

    monkeypatch.setattr(class_lm, "UNIT_WORDS", 2)
    monkeypatch.setattr(class_lm, "in_arrow", watched)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 12, 200)) for _ in range(6)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    model, _ = class_lm.fit(docs)
    count, pairs, neighbours = [x for x in sent if x[0].__name__ in ("count", "pairs")][:3]
    assert pairs[1].count() <= model.units.n and neighbours[1].count() <= 12
    monkeypatch.setattr(class_lm, "SENT", 5)
    batches = list(count[0](iter([pa.RecordBatch.from_pydict({"text": texts})])))
    assert max(b.num_rows for b in batches) <= 5
    assert sorted(w for b in batches for w in b.column(0).to_pylist()) == sorted(["", *(f"w{k}" for k in range(12))])

    table = class_lm.class_bigrams(docs, "text", model)
    at, units, first, _ = model.units.read([t.encode() for t in texts])
    cls, before = model.classes(at, units, first)
    moves = np.flatnonzero(units >= model.units.own)
    mine, place = np.unique(at[moves], return_inverse=True)
    want = model.head_class.copy()
    want[mine] = class_lm.best_classes(want[mine], place, before[moves], cls[moves + 1], np.ones(len(moves)), table)
    for held in (3, 10**6):  # neighbours counted after each text's batch, or once
        monkeypatch.setattr(class_lm, "HELD", held)
        assert (class_lm.exchanged(docs.repartition(3), "text", model, table) == want).all()


def test_packed_rows_come_back(monkeypatch):
    code, n = np.array([0, 3, 4, 5, 6, 7, 40, 79]), np.array([1, 2, 1 << 40, 4, 5, 6, 7, 8])
    for sent in (1, 3, 100):
        monkeypatch.setattr(class_lm, "SENT", sent)
        batches = list(class_lm.packed(code, n, 4))
        assert [k for b in batches for k in b.column(0).to_pylist()] == [0, 1, 10, 19]
        assert all(b.num_rows == 1 or len(class_lm.unpacked(b, 4)[0]) <= sent for b in batches)
        assert [np.concatenate(x).tolist() for x in zip(*[class_lm.unpacked(b, 4) for b in batches], strict=True)] == [code.tolist(), n.tolist()]
    assert list(class_lm.packed(code[:0], n[:0], 4)) == []


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "b a d")], "doc_id bigint, text string")
    model, _ = class_lm.fit(docs)
    assert np.allclose((10**model.transition).sum(1), 1)
    for k in range(model.k):  # the rest is for words not seen
        assert abs((10 ** model.emission[model.head_class == k]).sum() + 0.5 / 10 ** model.spread[k] - 1) < 1e-9


def likelihood(big, member, k):
    table = np.zeros((k, k))
    np.add.at(table, (np.repeat(member, len(member)), np.tile(member, len(member))), big.ravel())
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(table) - f(table.sum(1)) - f(table.sum(0))


def test_exchange_ends_where_no_single_move_helps():
    rng = np.random.default_rng(0)
    side = rng.integers(0, 3, 24)  # words of three kinds that follow one another in turn
    big = rng.integers(0, 4, (24, 24)).astype(float) + 40 * (side[None, :] == (side[:, None] + 1) % 3)
    pairs = np.flatnonzero(big.ravel())
    member = class_lm.exchange(pairs, big.ravel()[pairs], 24, classes=3, rounds=50)
    best = likelihood(big, member, 3)
    for u in range(24):
        for c in range(3):
            other = member.copy()
            other[u] = c
            assert likelihood(big, other, 3) <= best + 1e-6
    assert len(set(zip(member.tolist(), side.tolist(), strict=True))) == 3


def test_empty_training(spark, odd_docs, no_docs):
    model, rare = class_lm.fit(no_docs)
    got = class_lm.score(odd_docs, model, rare).collect()
    assert len(got) == odd_docs.count() and all(r.n_known == 0 and r.train_tokens == 0 for r in got)
    assert class_lm.score(no_docs, model, rare).count() == 0


def test_classes_beat_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model, rare = class_lm.fit(docs.where("doc_id % 5 <> 1"))
    x = class_lm.score(docs.where("doc_id % 5 = 1"), model, rare).agg(F.sum("score"), F.sum("base_score")).first()
    assert x[0] > x[1]


def test_quality_on_held_out_rows(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = pu_quality.fit(docs.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 <> 0"))
    got = pu_quality.score(docs.where("doc_id % 5 = 0"), model).join(labels, "doc_id").collect()
    right = sum(r.predicted == r.quality for r in got)
    assert right >= 0.9 * len(got)
    odd = pu_quality.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert pu_quality.score(no_docs, model).count() == 0
    nothing = pu_quality.fit(no_docs, labels)
    assert nothing is None and {r.score for r in pu_quality.score(odd_docs, nothing).collect()} == {0.5}


def test_few_labels_and_copies_in_many_rows(spark):
    """The sample thins neither labels nor the rows that prior, cells and cut come from; copies are one row of it."""
    good, bad = "The {k} men went home, and they all slept well there.", "BUY {k} !!! $$$ ### NOW 4 5 6 !!!"
    rows = [(k, (good if k % 2 else bad).format(k="x" * (k % 97))) for k in range(2000)] + [(k, "copy " * 9) for k in range(2000, 3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id bigint, quality int")
    model = pu_quality.fit(docs, labels, sample=60)
    assert model is not None
    got = {r.doc_id: r.predicted for r in pu_quality.score(docs.where("doc_id < 2000"), model).collect()}
    assert sum(p == k % 2 for k, p in got.items()) >= 1900
    features = pu_quality.described(docs, "text", ["doc_id"]).groupBy("x").agg(F.count("*").alias("w"))
    x, w = pu_quality.sample_of(features, 3000, 60)
    assert len(x) < 120 and w.max() == 1000 and 1500 < w.sum() < 4500


def test_prior_is_that_of_the_unlabelled_rows(spark):
    """The prior comes from positives and unlabelled text; labelled negatives don't move it."""
    good, bad = "The {k} men went home, and they all slept well there.", "BUY {k} !!! $$$ ### NOW 4 5 6 !!!"
    rows = [(k, (good if k % 10 < 7 else bad).format(k="x" * (k % 97))) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for negatives in (0, 900):
        labels = spark.createDataFrame([(k, 1) for k in range(0, 6000, 4) if k % 10 < 7] + [(k, 0) for k in range(6000) if k % 10 >= 7][:negatives], "doc_id bigint, quality int")
        model = pu_quality.fit(docs, labels)
        got = {r.doc_id: r.predicted for r in pu_quality.score(docs, model).collect()}
        assert sum(p == (k % 10 < 7) for k, p in got.items()) >= 5900
    x = np.concatenate([np.linspace(0, 1, 700), np.linspace(2, 3, 300)])  # positives above 2
    assert abs(pu_quality.best_bin(np.linspace(2, 3, 500), np.ones(500), x, np.ones(1000)) - 0.3) < 0.03


def test_cut_does_not_depend_on_the_number_of_rows():
    bins, counts = np.arange(-300, 300), np.abs(np.arange(-300, 300)) // 10 + 1
    assert abs(pu_quality.cut_of(bins, counts, 0.5, 50)) < 0.2
    assert pu_quality.cut_of(bins, counts, 0.5, 50) == pu_quality.cut_of(bins, counts * 1000, 0.5, 50)


def test_risk_gradient_is_non_negative_corrected():
    f = pu_quality.pu_slopes(0.5)
    p, u = np.array([2.0, 1.0]), np.array([-1.0, 0.5, 3.0])

    def risk(p, u):
        s = pu_quality.softplus
        return 0.5 * s(-p).mean() + max(0.0, s(u).mean() - 0.5 * s(p).mean())

    gp, gu = f([p, u])
    for x, g in ((p, gp), (u, gu)):
        for k in range(len(x)):
            old = risk(p, u)
            x[k] += 1e-6
            assert abs((risk(p, u) - old) / 1e-6 - g[k]) < 1e-4
            x[k] -= 1e-6
