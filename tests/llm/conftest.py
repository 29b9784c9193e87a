import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing column names."""
    long = " ".join(f"word{k % 997} and the {k}" for k in range(30_000))
    same = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf tonight"
    rows = [
        (1, same, "en", "a", 1), (2, same, "en", "a", 1), (2, same, "en", "a", 1), (3, same.upper(), None, None, None),
        (4, None, "en", "a", 0), (5, "", "en", "a", 0), (6, " \n\t ", None, "b", 3), (7, "12 34 %% !!", "de", None, 4),
        (8, long, "en", "c", len(long)), (None, same + " again", "en", "a", 2), (9, "der Hund und die Katze sind im Haus", "de", "d", 1),
        (10, "ß é 日本語 ☃ 𓀀 ▁ x", "fr", "d", 1), (-5, "one", "en", "d", 1), (11, "a b", "en", "d", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for name in ("score", "body", "key_0", "words", "isoframe_shard", "kept", "lang_pred", "node", "f"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
