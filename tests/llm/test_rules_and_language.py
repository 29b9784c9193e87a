import re
from collections import Counter

from pyspark.sql import functions as F

from isoframe.llm import language_id, quality_rules

W = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    t = text or ""
    w = W.findall(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    covered = {i + k for i, g in enumerate(windows) if n[g] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if W.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_counts_match_brute_force(spark, odd_docs):
    extra = ["a b c d e a b c d e f", "x\nx\n x\ny", "p q r s t u p q r s t u p q r s t", "# | < é\x0b\x0cz"]
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(extra)], "doc_id bigint, text string")
    docs = odd_docs.select("doc_id", "text").union(more)
    want = sorted((str(r.doc_id), *brute(r.text)) for r in docs.collect())
    got = quality_rules.apply_rules(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_keep_columns_and_are_native(odd_docs, no_docs):
    out = quality_rules.with_verdict(odd_docs, "passed")
    assert out.columns == [*odd_docs.columns, "passed"] and out.count() == odd_docs.count()
    plan = quality_rules.apply_rules(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert quality_rules.apply_rules(no_docs).count() == 0


def test_language_profiles(spark, odd_docs, no_docs):
    en = ["the cat and the dog are in the house with that man", "this is the way that they have been there"]
    de = ["der Hund und die Katze sind nicht im Haus mit dem Mann", "das ist der Weg und sie sind nicht da"]
    train = spark.createDataFrame([(t, lang) for lang, ts in (("en", en), ("de", de)) for t in ts], "text string, lang string")
    profiles = language_id.fit(train)
    assert profiles.languages == ["de", "en"]
    out = {(r.doc_id, r.text): r for r in language_id.identify(odd_docs, profiles).collect()}
    assert out[(4, None)].lang_pred == out[(5, "")].lang_pred == out[(7, "12 34 %% !!")].lang_pred == "und"
    assert out[(9, "der Hund und die Katze sind im Haus")].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in out.values())
    assert language_id.identify(no_docs, profiles).count() == 0
    nothing = language_id.fit(no_docs)
    assert {r.lang_pred for r in language_id.identify(odd_docs, nothing).collect()} == {"und"}


def test_out_of_place_distance_matches_brute_force():
    profiles = language_id.Profiles({"a": [1, 2, 3], "b": [3, 9]}, size=5)
    assert profiles.ranks[profiles.codes.searchsorted(3)].tolist() == [2, 0]
    text = "banana band"
    codes, counts = language_id.grams(text)
    body, found = " banana band ", Counter()
    for n in (1, 2, 3):
        for i in range(len(body) - n + 1):
            g = body[i : i + n]
            if g.strip() and not (n == 3 and g[1] == " "):
                found[g] += 1
    assert sorted(counts.tolist()) == sorted(found.values()) and len(codes) == len(found)
    own = language_id.ranked(codes, counts).tolist()
    assert language_id.Profiles({"x": own, "y": own[::-1]}).predict(text) == ("x", 1.0)


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train = docs.where(F.pmod("doc_id", F.lit(4)) != 2)
    out = language_id.identify(docs.where(F.pmod("doc_id", F.lit(4)) == 2), language_id.fit(train)).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.9 * len(out)
