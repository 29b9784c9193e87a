"""Language identification by rank-order profiles of character n-grams.

A profile lists the PROFILE most frequent 1- to 3-grams of padded lower-case words, most frequent first. A
document goes to the language whose profile is nearest by out-of-place distance: the sum over the document's
profile of the difference in rank, or PROFILE where the language lacks the n-gram.

Profiles are learnt from at most SAMPLE_PER_LANGUAGE labelled documents of a language (expected number; chosen by
a hash of the text, so the same rows at any partitioning). n-grams are counted on the executors; only the
profiles, PROFILE rows for each language, reach the driver. Text is read whole. Null texts and texts without a
letter are `und` with score 0; ties go to the language first in order; without labelled rows all are `und`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, in_arrow, small

PROFILE = 400
SAMPLE_PER_LANGUAGE = 20_000
UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
SPACE = 32
SHIFT = np.int64(21)  # bits of a code point


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the text's n-grams; none if it has no letter."""
    body = f" {NOT_LETTERS.sub(' ', text.lower()).strip()} "
    if not any(map(str.isalpha, body)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    letter = a != SPACE
    two = (a[:-1] << SHIFT) | a[1:]
    three = (two[:-1] << SHIFT) | a[2:]
    found = np.concatenate([a[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]])
    return np.unique(found, return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order of rank; ties by code."""
    return codes[np.lexsort((codes, -counts))[:size]]


class Profiles:
    """All language profiles as one table: sorted codes, and the rank of each in each language."""

    def __init__(self, by_language: dict[str, list[int]], size: int = PROFILE):
        self.size, self.languages = size, sorted(by_language)
        self.codes = np.unique(np.array([c for x in by_language.values() for c in x], dtype=np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), -1, dtype=np.int64)
        for k, name in enumerate(self.languages):
            self.ranks[np.searchsorted(self.codes, np.array(by_language[name], dtype=np.int64)), k] = np.arange(len(by_language[name]))

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest language, and its likeness: 1 less its distance as a share of the largest possible."""
        codes, counts = grams(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        mine = ranked(codes, counts, self.size)
        place = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        place[self.codes[place] != mine] = len(self.codes)
        theirs = self.ranks[place]
        apart = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(mine))[:, None])).sum(0)
        best = int(apart.argmin())
        return self.languages[best], float(1 - apart[best] / (self.size * len(mine)))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, size: int = PROFILE) -> Profiles:
    rows = labelled.select(F.col(text).alias("body"), F.col(lang).alias("lang")).where("lang is not null and body is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles({}, size)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    sample = rows.where(F.pmod(F.xxhash64("body"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]):
        for batch in small(batches, "body"):
            total: dict[str, list] = {}
            for name, text in zip(batch.column("lang").to_pylist(), byte_texts(batch.column("body")), strict=True):
                total.setdefault(name, []).append(grams(text.decode()))
            for name, found in total.items():
                codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(where, weights=np.concatenate([n for _, n in found]), minlength=len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(codes), pa.string()), "code": codes, "n": n})

    counted = sample.transform(in_arrow, count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).collect()
    profiles: dict[str, list[int]] = {k: [] for k in sizes}
    for r in sorted(top, key=lambda r: r["rank"]):
        profiles[r["lang"]].append(r["code"])
    return Profiles({k: v for k, v in profiles.items() if v}, size)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two columns more (or in place of columns of those names)."""
    names = [c for c in docs.columns if c not in (pred, score)]
    schema = docs.select(*names).schema.add(pred, "string").add(score, "double")

    def predict(batches: Iterator[pa.RecordBatch]):
        for batch in small(batches, text):
            found = [profiles.predict(t.decode()) for t in byte_texts(batch.column(text))]
            columns = [batch.column(c) for c in names]
            columns += [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, pred, score])

    return docs.transform(in_arrow, predict, schema)
