"""A quality classifier learnt from trusted positives and unlabelled web text (non-negative PU risk).

With class prior p, positives P and unlabelled text U, the risk is

    p * E_P[loss(g)] + max(0, E_U[loss(-g)] - p * E_P[loss(-g)])

the second term being the risk of the negatives, which can't be negative; where it becomes so, the step climbs
back. g is additive: each feature of a text's form is cut at quantiles, and each cell has a weight.

The risk ranks texts; it leaves open where a score is cut. The scores are shifted so that THRESHOLD parts the share of
unlabelled text that the prior calls positive from the rest, where scores are rarest.

The prior is estimated from positives and unlabelled text (prior_of); labels of negatives serve for nothing.

All training documents are read whole and described; rows of equal features and label are one with a weight. The
quantiles of the cells are of all training rows, the place of the cut is of all unlabelled ones, from histograms of
fixed resolution. Only the estimate of the prior and the descent use a sample, of positives and of unlabelled rows apart: at most
SAMPLE weighted rows of each (expected number). A row of weight w is in it with probability min(1, w / step), by a
hash of its features, with weight max(w, step), so sums are unbiased, copies cost one row and a text of many copies is
always in. Up to SAMPLE rows of a kind, all are used.

Every document is scored whole, in one pass without a shuffle. Null and empty texts have all features 0 and get the
score of such a text; repeated labels of a document count as one, positive if any is. Without positives the score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, in_arrow, small, stored, with_fields

SAMPLE = 60_000
CELLS = 10
STEPS, RATE, DECAY = 1000, 0.05, 1e-4
THRESHOLD = 0.3
FINE = 40  # bits of a feature's mantissa that its histogram leaves out
PRIOR_STEPS, DOUBT, SLACK = 300, 0.1, 0.01
BIN, NEAR = 0.01, 10  # width of a bin of raw scores, and how many bins on each side are counted with it
LIMIT = 40.0  # of raw scores

UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
SYMBOL = bytes(b for b in range(256) if b not in b"#*$%&|<>@^~=+_\\{}[]")
STOP = bytes(b for b in range(256) if b not in b".,;:?")
SHOUT = bytes(b for b in range(256) if b != 33)
FEATURES = (
    "words", "word_bytes", "upper", "digits", "symbols", "stops", "shouts", "distinct", "top_word", "repeats",
    "lines", "repeated_lines", "line_words", "beyond_ascii", "long_words", "short_words", "plain_ends",
)


def describe(text: bytes) -> list[float]:
    """Features of a text's form; all 0 if it has no word."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    count = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = list(map(len, words))
    letters = sum(lengths)
    return [
        float(np.log1p(n)),
        letters / n,
        len(text.translate(None, UPPER)) / letters,
        len(text.translate(None, DIGIT)) / letters,
        len(text.translate(None, SYMBOL)) / n,
        len(text.translate(None, STOP)) / n,
        len(text.translate(None, SHOUT)) / n,
        len(count) / n**0.8,
        max(count.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        1 - len(text.decode()) / size,
        sum(x > 14 for x in lengths) / n,
        sum(x < 4 for x in lengths) / n,
        sum(w[-1] > 127 or 97 <= w[-1] <= 122 for w in count) / len(count),
    ]


class Additive:
    """Quantile cells of each feature, and a weight for each cell."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts = cuts
        self.first = np.concatenate([[0], np.cumsum([len(c) + 2 for c in self.cuts])]).astype(np.int64)
        self.weights, self.bias = np.zeros(self.first[-1]), 0.0

    def cells_of(self, x: np.ndarray) -> np.ndarray:
        """A cell for each feature: 0 for the value 0, else by the cuts."""
        cells = [np.where(v == 0, 0, np.searchsorted(c, v, side="right") + 1) for c, v in zip(self.cuts, x.T, strict=True)]
        return np.stack(cells, 1) + self.first[:-1]

    def raw(self, cells: np.ndarray) -> np.ndarray:
        return self.weights[cells].sum(1) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.cells_of(x)), -40, 40)))


def descend(model: Additive, parts: list[tuple[np.ndarray, object]], steps: int = STEPS) -> None:
    """Adam over the additive model; each part has cells and a function from raw scores to gradients."""
    n = len(model.weights)
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        grads = [f for _, f in parts]
        raws = [model.raw(c) for c, _ in parts]
        slopes = grads[0](raws)
        g = np.zeros(n + 1)
        for (cells, _), s in zip(parts, slopes, strict=True):
            g[:n] += np.bincount(cells.ravel(), weights=np.repeat(s, cells.shape[1]), minlength=n)
            g[n] += s.sum()
        g[:n] += DECAY * model.weights
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        model.weights -= step[:n]
        model.bias -= step[n]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def shares(raw: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
    return np.full(len(raw), 1 / len(raw)) if weight is None else weight / weight.sum()


def pu_slopes(prior: float, weight_p: np.ndarray | None = None, weight_u: np.ndarray | None = None):
    """Gradients of the non-negative risk with logistic loss, for positives and unlabelled rows (of weight 1, or as given)."""

    def slopes(raws):
        p, u = raws
        of_p, of_u = shares(p, weight_p), shares(u, weight_u)
        negative = (of_u * softplus(u)).sum() - prior * (of_p * softplus(p)).sum()
        to_p, to_u = -prior * (1 - sigmoid(p)) * of_p, np.zeros(len(u))
        rest_p, rest_u = -prior * sigmoid(p) * of_p, sigmoid(u) * of_u
        if negative >= 0:
            return to_p + rest_p, to_u + rest_u
        return -rest_p, -rest_u

    return slopes


def prior_of(cuts: list[np.ndarray], p: np.ndarray, weight_p: np.ndarray, u: np.ndarray, weight_u: np.ndarray) -> float:
    """The share of positives among unlabelled text, from positives and unlabelled text alone (best-bin estimation).

    A rough model ranks positives before unlabelled text. Above any score the share of unlabelled text is at least the prior
    times that of positives, and equal where no negative lies; the prior is that ratio at the score where it is least,
    with an allowance for the sampling error of both shares.
    """
    rng = np.random.default_rng(0)
    halves = [rng.permutation(len(w)) % 2 for w in (weight_p, weight_u)]
    if min(len(weight_p), len(weight_u)) < 4:
        return 0.5
    found = []
    for k in (0, 1):  # a model learnt on one half ranks the other
        rough = Additive(cuts)
        (own_p, own_u), (p_of, u_of) = ([h == j for h in halves] for j in (k, 1 - k))
        of_p, of_u = shares(None, weight_p[own_p]), shares(None, weight_u[own_u])
        slopes = lambda r, of_p=of_p, of_u=of_u: (-(1 - sigmoid(r[0])) * of_p, sigmoid(r[1]) * of_u)
        descend(rough, [(rough.cells_of(p[own_p]), slopes), (rough.cells_of(u[own_u]), None)], PRIOR_STEPS)
        found.append(best_bin(rough.raw(rough.cells_of(p[p_of])), weight_p[p_of], rough.raw(rough.cells_of(u[u_of])), weight_u[u_of]))
    return float(np.mean(found))


def best_bin(p: np.ndarray, weight_p: np.ndarray, u: np.ndarray, weight_u: np.ndarray) -> float:
    """The least ratio of unlabelled text to positives above a score, with the allowance."""
    of_p, of_u = shares(None, weight_p), shares(None, weight_u)
    raw = np.concatenate([p, u])
    order = np.argsort(-raw, kind="stable")
    last = np.flatnonzero(np.append(np.diff(raw[order]) != 0, True))  # ties count together
    above_p = np.cumsum(np.concatenate([of_p, np.zeros(len(u))])[order])[last]
    above_u = np.cumsum(np.concatenate([np.zeros(len(p)), of_u])[order])[last]
    some = above_p > 0
    error = (np.log(4 / DOUBT) / 2) ** 0.5 * (effective(of_p) ** -0.5 + effective(of_u) ** -0.5)
    ratio = above_u[some] / above_p[some]
    best = (ratio + (1 + SLACK) * error / above_p[some]).argmin()
    return float(np.clip(ratio[best], 0.01, 0.99))


def effective(share: np.ndarray) -> float:
    """How many rows of equal weight have the sampling error of these."""
    return 1 / float((share**2).sum())


def cut_of(bins: np.ndarray, counts: np.ndarray, prior: float, known: int) -> float:
    """A raw score with a share of about prior of the unlabelled rows above it: where scores are rarest (counted with NEAR
    bins on each side; the middle of the longest such stretch) within three standard errors of the prior, which is
    estimated on known rows."""
    order = np.argsort(bins)
    bins, counts = bins[order], counts[order]
    n, upto = counts.sum(), np.cumsum(counts)
    error = 3 * (prior * (1 - prior) / max(known, 1)) ** 0.5
    low, high = (int(bins[np.searchsorted(upto, np.clip((1 - prior + e) * n, 1, n))]) for e in (-error, error))
    dense = np.zeros(high - low + 1 + 2 * NEAR)
    inside = (bins >= low - NEAR) & (bins <= high + NEAR)
    dense[bins[inside] - low + NEAR] = counts[inside]
    total = np.concatenate([[0], np.cumsum(dense)])
    near = total[2 * NEAR + 1 :] - total[: -2 * NEAR - 1]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], near == near.min(), [0]])))
    starts, ends = edges[::2], edges[1::2]
    k = int((ends - starts).argmax())
    return (low + (starts[k] + ends[k]) / 2) * BIN


def histogram(rows: DataFrame, of, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of w over all rows by feature and bin; of gives the bins, (rows, width), of the features of some rows."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                bins, w = of(matrix(batch.column("x"))), batch.column("w").to_numpy(zero_copy_only=False)
                for k in range(width):
                    own, at = np.unique(bins[:, k], return_inverse=True)
                    n = np.zeros(len(own), dtype=np.int64)
                    np.add.at(n, at, w)
                    yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(own), k), pa.int64()), "bin": pa.array(own, pa.int64()), "n": n})

    found = rows.select("x", "w").transform(in_arrow, run, "k bigint, bin bigint, n bigint").groupBy("k", "bin").agg(F.sum("n").alias("n")).toArrow()
    return tuple(found.column(c).to_numpy() for c in ("k", "bin", "n"))


def cuts_of(rows: DataFrame, cells: int = CELLS) -> list[np.ndarray]:
    """Quantiles of each feature over all rows, to the resolution of the histogram."""
    feature, bins, n = histogram(rows, lambda x: (x + 0.0).view(np.int64) >> FINE, len(FEATURES))  # features aren't negative
    cuts = []
    for k in range(len(FEATURES)):
        own = feature == k
        order = np.argsort(bins[own])
        values, upto = (bins[own][order] << FINE).view(np.float64), np.cumsum(n[own][order])
        cuts.append(np.unique(values[np.searchsorted(upto, np.linspace(0, 1, cells + 1)[1:-1] * upto[-1])]))
    return cuts


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, len(FEATURES))


def sample_of(rows: DataFrame, n: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights of at most sample weighted rows (expected number) of n rows."""
    step = max(1.0, n / sample)
    place = F.pmod(F.xxhash64("x"), F.lit(1 << 30)) / float(1 << 30)
    found = rows.where(place < F.col("w") / step).select("x", F.greatest(F.col("w").cast("double"), F.lit(step)).alias("w")).toArrow()
    x, w = matrix(found.column("x")), found.column("w").to_numpy()
    order = np.lexsort((*x.T, w))  # rows come in any order
    return x[order], w[order]


def described(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in small(batches, "body"):
            x = [describe(t) for t in byte_texts(batch.column("body"))]
            columns = [batch.column(f"key_{k}") for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(x, pa.list_(pa.float64()))], names=[f"key_{k}" for k in range(len(keys))] + ["x"])

    picked = docs.select(*[F.col(c).alias(f"key_{k}") for k, c in enumerate(keys)], F.col(text).alias("body"))
    return picked.transform(in_arrow, run, with_fields(picked.drop("body").schema, "x array<double>"))


def fit(train: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Additive | None:
    """None if there is no labelled positive."""
    known = labels.groupBy(F.col(doc_id).alias("key_0")).agg(F.max(F.col(label)).alias("y"))
    rows = described(train, text, [doc_id]).join(known, "key_0", "left").groupBy("x", "y").agg(F.count("*").alias("w"))
    rows = stored(rows, "features")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.sum("w").alias("n")).collect()}
    positives = sizes.get(1, 0)
    if not positives:
        return None
    unlabelled = rows.where("y is null") if None in sizes else rows.groupBy("x").agg(F.sum("w").alias("w"))
    cuts = cuts_of(rows)
    p, weight_p = sample_of(rows.where("y = 1"), positives, sample)
    u, weight_u = sample_of(unlabelled, sizes.get(None, sum(sizes.values())), sample)
    prior = prior_of(cuts, p, weight_p, u, weight_u)
    model = Additive(cuts)
    model.bias = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 0.0
    f = pu_slopes(prior, weight_p, weight_u)
    descend(model, [(model.cells_of(p), f), (model.cells_of(u), f)])
    if prior < 1:
        bins_of = lambda x: np.floor(np.clip(model.raw(model.cells_of(x)), -LIMIT, LIMIT) / BIN).astype(np.int64)[:, None]
        _, bins, n = histogram(unlabelled, bins_of, 1)
        cut = cut_of(bins, n, prior, min(positives, int(n.sum())))
        model.bias += float(np.log(THRESHOLD / (1 - THRESHOLD))) - cut
    return model


def score(docs: DataFrame, model: Additive | None, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, score and predicted (1 if score >= THRESHOLD) for each row of docs."""
    picked = docs.select(*[F.col(c).alias(f"key_{k}") for k, c in enumerate(keys)], F.col(text).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in small(batches, "body"):
            if batch.num_rows:
                x = np.array([describe(t) for t in byte_texts(batch.column("body"))])
                s = model.score(x) if model else np.full(len(x), 0.5)
                columns = [batch.column(f"key_{k}") for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(s)], names=[f"key_{k}" for k in range(len(keys))] + ["score"])

    found = picked.transform(in_arrow, run, with_fields(picked.drop("body").schema, "score double"))
    return found.select(*[F.col(f"key_{k}").alias(c) for k, c in enumerate(keys)], "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
