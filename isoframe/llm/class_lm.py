"""Scoring by a Brown class-based bigram model.

Exchange clustering puts words into CLASSES classes. Then

    P(w | v) = P(class(w) | class(v)) * P(w | class(w))

with transitions smoothed towards the classes' own frequencies and emissions by add-half. An end token closes each
text and stands before its first word.

Clustering has two steps. First the UNIT_WORDS most frequent words are moved one at a time between classes while that
raises the likelihood of the training bigrams; for that, all other words share units by their last two characters (the
SUFFIXES heaviest endings, else one for the rest), whose classes are where those words start. Then every word of the head,
the at most HEAD words that occur at least as often as a threshold, is exchanged by its own counts: a table of the
classes before it and after it, summed over all training texts, gives the likelihood of each class for it, and all move
at once (distributed exchange); ROUNDS_ALL such rounds, each undone if the likelihood of the training bigrams is less.
Words beyond the head have the class of their ending; their own counts are joined.

Counts are over all training texts and grow with them; they stay in tables of the shared folder. The head goes to the
workers; the counts of all other words are joined to the few words of each text that aren't in it, so memory has a
bound and no word is dropped. Null texts are empty; repeated rows each count and each give a row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_data, byte_texts, in_arrow, small, stored, with_fields

UNIT_WORDS, SUFFIXES, CLASSES = 1500, 500, 64
HEAD = 300_000
ROUNDS_ALL = 1
PULL = 20.0  # weight of the classes' own frequencies in a transition
ROUNDS = 6
TEXT_BYTES, SENT = 1 << 20, 50_000  # bytes in a batch of texts, counts in a batch that is sent
HELD = 2_000_000  # neighbours that a worker holds before it counts them
ENTRY = np.dtype([("at", "<i4"), ("n", "<i8")])  # of a packed row
END = b""


def tokens(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def word_counts(train: DataFrame, text: str) -> DataFrame:
    """(word, c) over all training texts; the end token is the empty word."""

    def count(batches: Iterator[pa.RecordBatch], most=1_000_000):
        found: Counter = Counter()

        def out():
            rows = iter(found.items())
            while some := list(islice(rows, SENT)):
                words, n = zip(*some, strict=True)
                yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()).cast(pa.string()), "n": pa.array(n, pa.int64())})
            found.clear()

        for batch in small(batches, text, TEXT_BYTES):
            for t in byte_texts(batch.column(0)):
                found.update(tokens(t))
                found[END] += 1
                if len(found) > most:
                    yield from out()
        yield from out()

    rows = train.select(text).transform(in_arrow, count, "word string, n bigint")
    return rows.repartition("word").groupBy("word").agg(F.sum("n").alias("c"))  # a task's words are distinct already


def summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, sorted, and the sum of n of each."""
    code, where = np.unique(code, return_inverse=True)
    return code, np.bincount(where, weights=n, minlength=len(code))


def packed(code: np.ndarray, n: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, seen) of sorted codes key * width + at: all (at, n) of a key in one row, a batch of SENT such or one row."""
    key = code // width
    first = np.flatnonzero(np.diff(key, prepend=-1))
    ends, k = np.append(first, len(code)), 0
    while k < len(first):
        until = max(k + 1, int(np.searchsorted(ends, ends[k] + SENT, side="right")) - 1)
        bounds = ends[k : until + 1]
        entries = np.empty(bounds[-1] - bounds[0], dtype=ENTRY)
        entries["at"], entries["n"] = code[bounds[0] : bounds[-1]] % width, n[bounds[0] : bounds[-1]]
        cuts = ((bounds - bounds[0]) * ENTRY.itemsize).astype(np.int32)
        seen = pa.Array.from_buffers(pa.binary(), until - k, [None, pa.py_buffer(cuts), pa.py_buffer(entries.tobytes())])
        yield pa.RecordBatch.from_pydict({"key": pa.array(key[bounds[:-1]], pa.int32()), "seen": seen})
        k = until


def unpacked(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and n of packed rows."""
    data, bounds = byte_data(batch.column(1).cast(pa.large_binary()))
    entries = np.frombuffer(data.tobytes(), dtype=ENTRY)
    return np.repeat(batch.column(0).to_numpy().astype(np.int64), np.diff(bounds) // ENTRY.itemsize) * width + entries["at"], entries["n"]


class Units:
    """From words to the units of the first step, and the base score of the head."""

    def __init__(self, head: list[bytes], counts: np.ndarray, suffixes: list[bytes], total: int, distinct: int):
        order = np.lexsort((np.arange(len(head)), -counts))
        own = [END] + [head[k] for k in order if head[k] != END][:UNIT_WORDS]
        self.unit = {w: k for k, w in enumerate(own)}
        self.suffix = {s: len(own) + k for k, s in enumerate(suffixes)}
        self.own = len(own)
        self.other = len(own) + len(suffixes)
        self.n = self.other + 1
        self.total, self.distinct = total, distinct
        self.head = {w: k for k, w in enumerate(head)}
        self.head_unit = np.array([self.of(w) for w in head], dtype=np.int64)
        self.head_base = np.log10(counts.astype(np.float64) + 0.5)
        self.head_seen = counts > 0  # the end token is in the head even without training texts

    def of(self, word: bytes) -> int:
        k = self.unit.get(word)
        return k if k is not None else self.suffix.get(ending(word), self.other)

    def read(self, texts: list[bytes]):
        """Places in the head (-1 beyond it), units, the first token of each text, and the words beyond the head."""
        flat: list[bytes] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        for k, t in enumerate(texts):
            found = tokens(t)
            sizes[k] = len(found) + 1
            flat += found
            flat.append(END)
        place = self.head.get
        at = np.array([place(w, -1) for w in flat], dtype=np.int64)
        units = self.head_unit[at]
        beyond = np.flatnonzero(at < 0)
        for k in beyond:
            units[k] = self.of(flat[k])
        return at, units, np.concatenate([[0], np.cumsum(sizes)]), {int(k): flat[k] for k in beyond}


def ending(word: bytes) -> bytes:
    return word.decode()[-2:].encode()


def exchange(pairs: np.ndarray, counts: np.ndarray, n: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each of n units: moves of one unit at a time, each to the class of the highest likelihood."""
    big = np.zeros((n, n), dtype=np.float64)
    big.ravel()[pairs] = counts
    freq = np.maximum(big.sum(1), big.sum(0))
    order = np.argsort(-freq, kind="stable")
    k = min(classes, n)
    member = np.zeros(n, dtype=np.int64)
    member[order] = np.arange(n) % k
    hot = np.zeros((n, k))
    hot[np.arange(n), member] = 1
    right, left = big @ hot, big.T @ hot  # of each unit: followers and predecessors by class
    table = hot.T @ right

    def f(x):
        return x * np.log(np.maximum(x, 1.0))

    for _ in range(rounds):
        moved = 0
        for u in order:
            if freq[u] == 0:
                continue
            a, same = member[u], big[u, u]
            r, le = right[u].copy(), left[u].copy()
            r[a] -= same
            le[a] -= same
            table[a, :] -= r
            table[:, a] -= le
            table[a, a] -= same
            out, into = table.sum(1) + le, table.sum(0) + r  # the other classes' words keep u beside them
            tot_r, tot_l = r.sum() + same, le.sum() + same
            gain = (f(table + r) - f(table)).sum(1) + (f(table + le[:, None]) - f(table)).sum(0)
            d = np.diagonal(table)
            gain += f(d + r + le + same) - f(d) - (f(d + r) - f(d)) - (f(d + le) - f(d))
            gain -= f(out + tot_r) - f(out) + f(into + tot_l) - f(into)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            table[b, :] += r
            table[:, b] += le
            table[b, b] += same
            if b != a:
                moved += 1
                member[u] = b
                right[:, a] -= big[:, u]
                right[:, b] += big[:, u]
                left[:, a] -= big[u, :]
                left[:, b] += big[u, :]
        if not moved:
            break
    return member


def x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(table: np.ndarray) -> float:
    """What of the log likelihood of the training bigrams hangs on the classes, from the bigrams of classes."""
    return float(x_log_x(table).sum() - x_log_x(table.sum(1)).sum() - x_log_x(table.sum(0)).sum())


def best_classes(own: np.ndarray, place: np.ndarray, before: np.ndarray, after: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each word that raises the likelihood most if it alone moves, by the classes it stands between.

    own: the words' classes; (place, before, after, n): which word stands how often between which classes.
    """
    k = len(table)
    return best_beside(own, summed(place * k + before, n), summed(place * k + after, n), table)


def best_beside(own: np.ndarray, before: tuple[np.ndarray, np.ndarray], after: tuple[np.ndarray, np.ndarray], table: np.ndarray) -> np.ndarray:
    """best_classes by the sums on either side: distinct codes place * classes + neighbour, sorted, and how often.

    What a word loses by leaving its class is counted on the table without it (a word beside itself counts as beside its class).
    """
    k = len(table)
    gain = np.zeros((len(own), k))
    sides = ((after, table.T, table.sum(1)), (before, table, table.sum(0)))  # rows: the neighbour's class, columns: the word's
    words = np.arange(len(own))
    for (code, counts), of, total in sides:
        word, c = code // k, code % k
        for at in range(0, len(code), 50_000):
            w, x, m = word[at : at + 50_000], of[c[at : at + 50_000]], counts[at : at + 50_000, None]
            more = x_log_x(x + m) - x_log_x(x)
            mine = np.arange(len(w)), own[w]
            stay = x[mine]
            more[mine] = x_log_x(stay) - x_log_x(np.maximum(stay - m[:, 0], 0))
            first = np.flatnonzero(np.diff(w, prepend=-1))
            gain[w[first]] += np.add.reduceat(more, first)
        sums = np.bincount(word, weights=counts, minlength=len(own))[:, None]
        less = x_log_x(total + sums) - x_log_x(total)
        stay = total[own]
        less[words, own] = x_log_x(stay) - x_log_x(np.maximum(stay - sums[:, 0], 0))
        gain -= less
    best = gain.argmax(1)
    return np.where(gain[words, best] > gain[words, own] + 1e-9, best, own)


class Model:
    """Classes of units (words beyond the head) and of the head's words, transitions and emissions."""

    def __init__(self, units: Units, member: np.ndarray):
        self.units, self.member = units, member
        self.k = int(member.max()) + 1
        self.head_class = member[units.head_unit]
        self.end_class = int(member[units.unit[END]])

    def settle(self, table: np.ndarray, mass: np.ndarray) -> None:
        """Probabilities from the bigrams of classes, and the counts (with a half for each word) in each class."""
        mass = mass + 0.5
        own = mass / mass.sum()
        self.transition = np.log10((table + PULL * own) / (table.sum(1, keepdims=True) + PULL))
        self.spread = np.log10(mass)  # of a class
        self.emission = self.units.head_base - self.spread[self.head_class]

    def classes(self, at: np.ndarray, units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each token and that before it."""
        cls = np.where(at >= 0, self.head_class[at], self.member[units])
        before = np.concatenate([[self.end_class], cls[:-1]])
        before[first[:-1]] = self.end_class
        return cls, before

    def score(self, texts: list[bytes]) -> dict:
        """For each text the sums over the words whose counts are known here, and its other words."""
        u = self.units
        at, units, first, beyond = u.read(texts)
        cls, before = self.classes(at, units, first)
        starts = first[:-1]
        inside = at >= 0
        base = -np.log10(u.total + 0.5 * (u.distinct + 1))
        out = self.transition[before, cls] + np.where(inside, self.emission[at], -self.spread[cls])
        plain = base + np.where(inside, u.head_base[at], 0.0)
        rows: list[Counter] = [Counter() for _ in texts]
        for row, (_, w) in zip(np.searchsorted(first, np.fromiter(beyond, np.int64, len(beyond)), side="right") - 1, beyond.items(), strict=True):
            rows[row][w] += 1
        add = lambda x: np.add.reduceat(x, starts)
        return {"n": np.diff(first), "known": add((inside & u.head_seen[at]).astype(np.int64)), "base": add(plain), "score": add(out), "rest": rows}


def fit(train: DataFrame, text: str = "text", head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model, and the table of word counts beyond the head."""
    spark = train.sparkSession
    counts = stored(word_counts(train, text), "word-counts")
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    levels = sorted(((r["c"], r["count"]) for r in counts.groupBy("c").count().collect()), reverse=True)
    least, taken = (levels[0][0] + 1 if levels else 1), 0
    for c, n in levels:
        if taken + n > head:
            break
        least, taken = c, taken + n
    top = counts.where((F.col("c") >= least) | (F.col("word") == "")).orderBy(F.desc("c"), "word").toArrow()
    words = [w.encode() for w in top.column("word").to_pylist()]
    freq = top.column("c").to_numpy() if words else np.zeros(0, np.int64)
    if END not in words:
        words, freq = [*words, END], np.append(freq, 0)
    own = [w.decode() for w in words if w != END][:UNIT_WORDS]
    ending_of = F.right("word", F.lit(2)).alias("s")
    shared = counts.where((F.col("word") != "") & (~F.col("word").isin(own) if own else F.lit(True)))
    by_end = shared.groupBy(ending_of).agg(F.sum("c").alias("n"))
    suffixes = [r["s"].encode() for r in by_end.orderBy(F.desc("n"), "s").limit(SUFFIXES).collect()]
    units = Units(words, freq, suffixes, int(total or 0), int(distinct))
    rare = counts.where((F.col("c") < int(least)) & (F.col("word") != ""))
    of_unit = spark.createDataFrame([(k.decode(), v) for k, v in units.suffix.items()], "s string, unit int")  # SUFFIXES rows
    beyond = rare.groupBy(ending_of).agg(F.sum(F.col("c") + 0.5).alias("n")).join(F.broadcast(of_unit), "s", "left")
    beyond = {r["unit"]: r["n"] for r in beyond.groupBy(F.coalesce("unit", F.lit(units.other)).alias("unit")).agg(F.sum("n").alias("n")).collect()}
    known = spark.sparkContext.broadcast(units)

    def pairs(batches: Iterator[pa.RecordBatch]):
        u, found = known.value, None
        for batch in small(batches, text, TEXT_BYTES):
            _, x, first, _ = u.read(byte_texts(batch.column(0)))
            before = np.concatenate([[0], x[:-1]])
            before[first[:-1]] = u.unit[END]
            pair, n = np.unique(before * u.n + x, return_counts=True)
            found = np.zeros(u.n * u.n, dtype=np.int64) if found is None else found
            found[pair] += n
        if found is not None:
            pair = np.flatnonzero(found)
            yield from packed(pair, found[pair], u.n)

    def add(batches: Iterator[pa.RecordBatch], n=units.n):
        found = np.zeros(n * n, dtype=np.int64)
        for batch in batches:
            pair, more = unpacked(batch, n)
            np.add.at(found, pair, more)
        pair = np.flatnonzero(found)
        for k in range(0, len(pair), SENT):
            yield pa.RecordBatch.from_pydict({"pair": pair[k : k + SENT], "n": found[pair[k : k + SENT]]})

    rows = train.select(text).transform(in_arrow, pairs, "key int, seen binary").repartition("key")
    grouped = rows.transform(in_arrow, add, "pair bigint, n bigint").toArrow()
    order = np.argsort(grouped.column("pair").to_numpy())
    pair, n = grouped.column("pair").to_numpy()[order], grouped.column("n").to_numpy()[order].astype(np.float64)
    model = Model(units, exchange(pair, n, units.n))
    table = np.zeros((model.k, model.k))
    np.add.at(table, (model.member[pair // units.n], model.member[pair % units.n]), n)
    for _ in range(ROUNDS_ALL):
        before = model.head_class
        model.head_class = exchanged(train, text, model, table)
        moved = class_bigrams(train, text, model)
        if likelihood(moved) < likelihood(table):
            model.head_class = before
            break
        table = moved
    mass = np.bincount(model.head_class, weights=freq + 0.5, minlength=model.k)
    for unit, more in beyond.items():
        mass[model.member[unit]] += more
    model.settle(table, mass)
    return model, rare


def class_bigrams(train: DataFrame, text: str, model: Model) -> np.ndarray:
    """How often each class follows each, over all training texts."""
    shared, k = train.sparkSession.sparkContext.broadcast(model), model.k

    def count(batches: Iterator[pa.RecordBatch]):
        found = np.zeros(k * k, dtype=np.int64)
        for batch in small(batches, text, TEXT_BYTES):
            at, units, first, _ = shared.value.units.read(byte_texts(batch.column(0)))
            cls, before = shared.value.classes(at, units, first)
            found += np.bincount(before * k + cls, minlength=k * k)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"pair": at, "n": found[at]})

    rows = train.select(text).transform(in_arrow, count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(k, k)


def exchanged(train: DataFrame, text: str, model: Model, table: np.ndarray) -> np.ndarray:
    """The classes of the head's words after a round of exchange; the words of the first step stay."""
    shared, k = train.sparkSession.sparkContext.broadcast(model), model.k

    def count(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0
        for batch in small(batches, text, TEXT_BYTES):
            m = shared.value
            at, units, first, _ = m.units.read(byte_texts(batch.column(0)))
            cls, before = m.classes(at, units, first)
            moves = np.flatnonzero((at >= 0) & (units >= m.units.own))  # never an end token, so a token follows
            held += [at[moves] * (2 * k) + before[moves], at[moves] * (2 * k) + k + cls[moves + 1]]
            size += 2 * len(moves)
            if size > HELD:
                yield from packed(*np.unique(np.concatenate(held), return_counts=True), 2 * k)
                held, size = [], 0
        if size:
            yield from packed(*np.unique(np.concatenate(held), return_counts=True), 2 * k)

    def move(batches: Iterator[pa.RecordBatch]):
        code, n = np.zeros(0, np.int64), np.zeros(0)
        for batch in chain(batches, [None]):
            if batch is not None:
                more = unpacked(batch, 2 * k)
                code, n = summed(np.concatenate([code, more[0]]), np.concatenate([n, more[1]]))
            whole = len(code) if batch is None else int(np.searchsorted(code, code[-1] // (2 * k) * (2 * k))) if len(code) else 0
            if whole:  # the last word may go on
                mine, place = np.unique(code[:whole] // (2 * k), return_inverse=True)
                beside, times = code[:whole] % (2 * k), n[:whole]
                left = beside < k
                sides = [(place[x] * k + beside[x] % k, times[x]) for x in (left, ~left)]
                best = best_beside(shared.value.head_class[mine], *sides, table)
                yield pa.RecordBatch.from_pydict({"word": mine, "class": best})
            code, n = code[whole:], n[whole:]

    rows = train.select(text).transform(in_arrow, count, "key int, seen binary").repartition("key").sortWithinPartitions("key")
    found = rows.transform(in_arrow, move, "word bigint, class bigint").toArrow()  # a row for each word of the head
    out = model.head_class.copy()
    out[found.column("word").to_numpy()] = found.column("class").to_numpy()
    return out


def score(docs: DataFrame, model: Model, rare: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, n_tokens, n_known, train_tokens, base_score, score and perplexity for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.col(text).alias("body"))
    schema = with_fields(picked.drop("body").schema, "n_tokens bigint, n_known bigint, base double, own double, rest array<struct<w:string,n:bigint>>")
    kind = pa.list_(pa.struct([("w", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in small(batches, "body", TEXT_BYTES):
            x = shared.value.score(byte_texts(batch.column("body")))
            rest = pa.array([[{"w": w.decode(), "n": n} for w, n in r.items()] for r in x["rest"]], kind)
            columns = [batch.column(f"key_{i}") for i in range(len(keys))]
            columns += [pa.array(x["n"]), pa.array(x["known"]), pa.array(x["base"]), pa.array(x["score"]), rest]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    part = stored(picked.transform(in_arrow, run, schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    words = part.where(F.size("rest") > 0).select("row", F.explode("rest").alias("x")).select("row", F.col("x.w").alias("word"), F.col("x.n").alias("k"))
    c = F.coalesce(F.col("c"), F.lit(0))
    found = words.join(rare, "word", "left").groupBy("row").agg(
        F.sum(F.col("k") * F.log10(c + 0.5)).alias("more"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("also")
    )
    more, also = F.coalesce(F.col("more"), F.lit(0.0)), F.coalesce(F.col("also"), F.lit(0))
    return part.join(found, "row", "left").select(
        *[F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)],
        "n_tokens",
        (F.col("n_known") + also).alias("n_known"),
        F.lit(model.units.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("own") + more).alias("score"),
        F.pow(F.lit(10.0), -(F.col("own") + more) / F.col("n_tokens")).alias("perplexity"),
    )
