"""From documents to token pieces: language ID, quality rules, near-dedup, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the
columns of documents; the last returns the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.llm import decontaminate, language_id, nbest_pieces, near_dedup, quality_rules
from isoframe.llm.common import crc_fold, shared_dir, stored, table
from isoframe.llm.queries import tokenizer_file

#: Near-duplicates: five-word shingles, a similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no known language: null text, or no letter."""
    profiles = language_id.fit(docs.where(crc_fold("doc_id", 4) != 2))
    pred, score = free_names(docs, "lang_pred", "score")
    found = language_id.identify(docs, profiles, pred=pred, score=score)
    return found.where(F.col(pred) != language_id.UNKNOWN).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail a rule."""
    (verdict,) = free_names(docs, "quality_kept")
    return quality_rules.with_verdict(docs, verdict).where(F.col(verdict)).select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group of near-duplicates (rows without id all stay).

    A document is a row, by a 64-bit key of all its columns: rows that share an id and have unrelated texts are
    documents apart. Of equal ids in a group the row of the smallest key stays, of equal rows one.

    Keys alone say which rows go. A bitmap of the keys that go or occur twice (near_dedup.FILTER_BITS bits) lets all other
    rows pass without a shuffle.
    """
    key, fate, word = free_names(docs, "row_key", "row_fate", "row_word")
    keyed = docs.where("doc_id is not null").withColumn(key, F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in docs.columns]))
    groups = near_dedup.near_duplicates(keyed, width=SHINGLE_WORDS, percent=SIMILARITY, doc_id=key).select(F.col("doc_id").alias(key), "component_id")
    parts = groups.groupBy(key).agg(F.first("component_id").alias("component_id"), F.count("*").alias("copies"))  # equal rows, one component
    rows = stored(keyed.select("doc_id", key).distinct().join(parts, key), "row-keys")
    least = rows.groupBy("component_id").agg(F.min(F.struct("doc_id", key)).alias("least")).select(F.col(f"least.{key}").alias(key))
    fates = rows.join(least.withColumn(fate, F.lit("stays")), key, "left").where((F.col("copies") > 1) | F.col(fate).isNull())
    fates = stored(fates.select(key, F.coalesce(fate, F.lit("goes")).alias(fate)), "row-fates")
    place = F.pmod(F.xxhash64(key), F.lit(near_dedup.FILTER_BITS))
    number, bit = F.floor(place / 64).cast("int"), F.pmod(place, F.lit(64)).cast("int")
    bits = fates.groupBy(number.alias(word)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias(fate))
    marked = keyed.withColumn(word, number).join(F.broadcast(bits), word, "left")
    doubtful = F.coalesce(F.getbit(fate, bit) == 1, F.lit(False))
    asked = marked.where(doubtful).drop(fate).join(fates, key, "left").where(f"{fate} is null or {fate} = 'stays'")
    return marked.where(~doubtful).select(*docs.columns).unionByName(asked.dropDuplicates([key]).select(*docs.columns)).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item."""
    found = decontaminate.find_spans(docs, table(spark, sf_dir, "benchmark"), carry=tuple(docs.columns))
    return found.where(F.size("starts") == 0).select(*[F.col(f"carried_{k}").alias(c) for k, c in enumerate(docs.columns)])


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, score, n_best_scores, ids_crc32, decodes, piece_ids and n_best_ids of each document."""
    return nbest_pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"), keys=("doc_id", "lang", "source"))


def free_names(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, lengthened until no column of docs has them."""
    out = []
    for name in names:
        while name.lower() in {c.lower() for c in docs.columns}:
            name += "_"
        out.append(name)
    return tuple(out)


STAGES = [
    ("language_id", language),
    ("quality_rules", quality),
    ("near_dedup", dedup),
    ("decontamination", decontamination),
    ("sentencepiece", pieces),
]

#: The last stage, an n-best search, isn't SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = shared_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
