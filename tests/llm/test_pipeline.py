import corpus_pipeline


def test_rows_of_one_id_with_unrelated_texts_stay(spark):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [
        (1, words(1), "en", "a", 1), (1, words(2), "en", "a", 1), (1, words(2), "en", "a", 1), (2, words(1), "en", "a", 1),
        (3, words(2) + " end", "de", "b", 1), (4, words(4), "en", "a", 1), (4, words(4), None, "a", 1), (5, words(5), None, None, None),
        (6, "", "en", "a", 0), (7, None, "en", "a", 0), (None, words(1), "en", "a", 1), (None, words(1), "en", "a", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = [(1, words(1)), (1, words(2)), (4, words(4)), (5, words(5)), (6, ""), (7, None), (None, words(1)), (None, words(1))]
    order = lambda x: (str(x[0]), str(x[1]))
    first = corpus_pipeline.dedup(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in first), key=order) == sorted(want, key=order)
    again = corpus_pipeline.dedup(spark, docs.repartition(7), "").collect()
    assert sorted(first, key=str) == sorted(again, key=str)
    assert corpus_pipeline.dedup(spark, docs.where("doc_id > 99"), "").count() == 0


def test_run_matches_brute_force(spark):
    """run() over the smallest tables: letters, the rules' SQL, shingle sets of all pairs, windows of all items, whole lattices."""
    import duckdb
    import numpy as np
    from test_decontaminate import brute

    from isoframe.llm import nbest_pieces, quality_rules
    from isoframe.llm.queries import tokenizer_file

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    texts = dict(con.execute("select doc_id, text from documents").fetchall())
    cursor = con.execute(quality_rules.SQL)
    names = [c[0] for c in cursor.description]
    good = {r[names.index("doc_id")] for r in cursor.fetchall() if r[names.index("kept")]}
    left = {k: t for k, t in texts.items() if k in good and any(map(str.isalpha, t or ""))}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for k, t in left.items():
        w = [x.decode() for x in t.translate(low).encode().split()]
        n = min(5, len(w))
        sets[k] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    part = {k: k for k in left}
    for a in sorted(left):
        for b in sorted(left):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = {k: new if v == old else v for k, v in part.items()}
    items = con.execute("select item_id, text from benchmark").fetchall()
    left = {k: t for k, t in left.items() if part[k] == k and not brute(t, items)[4]}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(left) and 0 < len(left) < len(texts)
    pieces = nbest_pieces.Pieces(tokenizer_file("piece_bpe_32k.model"))
    for k in sorted(left)[:20]:
        want = pieces.search(pieces.normal(left[k]), 4)
        assert np.allclose(got[k].n_best_scores, [s for s, _ in want]) and got[k].decodes
