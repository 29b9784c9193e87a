"""Benchmark decontamination by winnowing.

Both sides keep the rightmost minimum of every SPREAD consecutive hashes of GRAM words. Any shared span of
WINDOW = GRAM + SPREAD - 1 words then shares a kept fingerprint. Each fingerprint hit is extended over the
windows around it, and a window counts only if all its words are equal. Items shorter than a window are one
window themselves; a spread of one (every hash kept) is used for their lengths.

The benchmark is taken in blocks of about BLOCK_BYTES of text. A block's index is built once, as sorted arrays (some 40
bytes a word of the block), and goes to the workers. Rows are matched in place, so nothing is shuffled; a further
block is a further pass over a written table, so one index at a time is in memory whatever the size of the
benchmark. Texts are scanned in small batches. Null texts have no words; repeated item_ids count once; null item_ids
are no items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, in_arrow, mix64, small, stored

WINDOW = 10
GRAM = 5
SPREAD = WINDOW - GRAM + 1
BLOCK_BYTES = 16 << 20

#: A-Z become a-z; digits, letters and bytes of other scripts stay; all else parts words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
STATE = "n_words bigint, starts array<int>, ends array<int>, items array<bigint>"


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split(b" ") if text else []


def gram_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every width consecutive word ids."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h = mix64(h + ids[k : k + n].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return h


def winnow(hashes: np.ndarray, spread: int) -> np.ndarray:
    """Places of the rightmost minimum of every spread consecutive hashes."""
    n = len(hashes) - spread + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at = hashes[:n].copy(), np.zeros(n, dtype=np.int64)
    for k in range(1, spread):
        x = hashes[k : k + n]
        better = x <= best
        best[better] = x[better]
        at[better] = k
    return np.unique(at + np.arange(n))


class Index:
    """Fingerprints and windows of one block of the benchmark, as sorted arrays. Built once, on the driver.

    Word ids of all items lie one after another in flat; a window is its place there, so it takes 12 bytes and not its words.
    """

    def __init__(self, rows: list[tuple[int | None, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        texts = [(item, [w for w in words(text) if w]) for item, text in rows if item is not None]
        texts = [(item, found) for item, found in texts if found]
        number = self.vocabulary.setdefault
        self.flat = np.array([number(w, len(self.vocabulary) + 1) for _, found in texts for w in found], dtype=np.int32)
        sizes = np.array([len(found) for _, found in texts], dtype=np.int64)
        items, first = np.array([item for item, _ in texts], dtype=np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        left = first[owner + 1] - np.arange(len(owner))  # words from each place to its item's end
        lengths = np.minimum(sizes, WINDOW)
        self.windows = {int(n): self._windows(int(n), np.flatnonzero((lengths[owner] == n) & (left >= n)), items[owner]) for n in np.unique(lengths)}
        kept = [np.zeros(0, np.uint64)]
        for k in np.flatnonzero(sizes >= WINDOW):
            h = gram_hashes(self.flat[first[k] : first[k + 1]], GRAM)
            kept.append(h[winnow(h, SPREAD)])
        self.prints = np.unique(np.concatenate(kept))

    def hashed(self, ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """The hash of the n words from each place."""
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(n):
            h = mix64(h + ids[at + k].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        return h

    def _windows(self, n: int, at: np.ndarray, item_at: np.ndarray) -> tuple:
        """Sorted distinct window hashes, a place of each, and its items as offsets and values."""
        distinct, one, inverse = np.unique(self.hashed(self.flat, at, n), return_index=True, return_inverse=True)
        item = item_at[at]
        order = np.lexsort((item, inverse))
        inverse, item = inverse[order], item[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (inverse[1:] != inverse[:-1]) | (item[1:] != item[:-1])
        bounds = np.concatenate([[0], np.cumsum(np.bincount(inverse[new], minlength=len(distinct)))])
        return distinct, at[one].astype(np.int32), bounds, item[new]

    def starts(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ids where a window of n words stands, and which window."""
        none = np.zeros(0, np.int64)
        if len(ids) < n:
            return none, none
        distinct, places, _, _ = self.windows[n]
        if n == WINDOW:
            grams = gram_hashes(ids, GRAM)
            kept = winnow(grams, SPREAD)
            place = np.searchsorted(self.prints, grams[kept])
            hit = kept[self.prints[np.minimum(place, len(self.prints) - 1)] == grams[kept]]
            at = np.unique((hit[:, None] - np.arange(SPREAD)[None, :]).ravel())
            at = at[(at >= 0) & (at <= len(ids) - n)]
            h = self.hashed(ids, at, n)
        else:
            at, h = np.arange(len(ids) - n + 1), gram_hashes(ids, n)
        place = np.minimum(np.searchsorted(distinct, h), len(distinct) - 1)
        same = distinct[place] == h
        at, place = at[same], place[same]
        exact = np.ones(len(at), dtype=bool)
        for k in range(n):
            exact &= ids[at + k] == self.flat[places[place] + k]
        return at[exact], place[exact]

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, list]:
        """Word counts, and for each text with hits (row, starts, ends, items)."""
        known, flat, sizes = self.vocabulary.get, [], np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            found = [w for w in words(text) if w]
            sizes[k] = len(found)
            flat += [known(w, 0) for w in found]
            flat.append(-1)  # no window crosses from one text to the next
        ids = np.array(flat, dtype=np.int32)
        del flat
        first = np.concatenate([[0], np.cumsum(sizes + 1)])
        spans: dict[int, tuple[list, list, set]] = {}
        for n, (_, _, bounds, values) in self.windows.items():
            at, which = self.starts(ids, n)
            rows = np.searchsorted(first, at, side="right") - 1
            cuts = np.flatnonzero(np.diff(rows)) + 1 if len(rows) else []
            for mine in np.split(np.arange(len(rows)), cuts) if len(rows) else []:
                row = int(rows[mine[0]])
                starts, ends, items = spans.setdefault(row, ([], [], set()))
                local = at[mine] - first[row]
                starts.extend(local.tolist())
                ends.extend((local + n).tolist())
                for w in np.unique(which[mine]):
                    items.update(values[bounds[w] : bounds[w + 1]].tolist())
        return sizes, [(r, *x) for r, x in sorted(spans.items())]


def merged(starts, ends) -> tuple[list[int], list[int]]:
    """Unions of overlapping or touching spans."""
    out_s, out_e = [], []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if out_e and s <= out_e[-1]:
            out_e[-1] = max(out_e[-1], e)
        else:
            out_s.append(s)
            out_e.append(e)
    return out_s, out_e


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> list[DataFrame]:
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    return [items.where(part == k) if n > 1 else items for k in range(n)]


def find_spans(
    docs: DataFrame, benchmark: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text",
    block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = (),
) -> DataFrame:
    """For each row of docs: doc_id, n_words, the merged hit spans (starts, ends, in words) and the item_ids found.

    carry: further columns of docs to keep, as carried_0, carried_1 ... The text goes to the workers once, and comes back
    only if it is among them or if further blocks need it.
    """
    spark = docs.sparkSession
    others = [c for c in dict.fromkeys(carry) if c not in (doc_id, text)]
    state = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"), *[F.col(c).alias(f"other_{k}") for k, c in enumerate(others)])
    types = dict(state.dtypes)
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    for number, block in enumerate(blocks):
        index = spark.sparkContext.broadcast(Index([(r.i, r.t.encode()) for r in block.distinct().collect()]))
        names = ["doc_id"] + ["body"] * (number + 1 < len(blocks) or text in carry) + [f"other_{k}" for k in range(len(others))]

        def match(batches, index=index, more=number > 0, names=names):
            for batch in small(batches, "body"):
                sizes, hits = index.value.scan(byte_texts(batch.column("body")))
                old = [batch.column(c).to_pylist() if more else [[] for _ in sizes] for c in ("starts", "ends", "items")]
                for row, starts, ends, items in hits:
                    old[0][row], old[1][row] = merged(old[0][row] + starts, old[1][row] + ends)
                    old[2][row] = sorted(items.union(old[2][row]))
                found = [pa.array(x, pa.list_(t)) for x, t in zip(old, (pa.int32(), pa.int32(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(sizes), *found], names=[*names, "n_words", "starts", "ends", "items"])

        found = state.transform(in_arrow, match, ", ".join(f"{c} {types[c]}" for c in names) + f", {STATE}")
        state = stored(found, "decontaminated") if number + 1 < len(blocks) else found
    at = {doc_id: "doc_id", text: "body"} | {c: f"other_{k}" for k, c in enumerate(others)}
    return state.select("doc_id", "n_words", "starts", "ends", "items", *[F.col(at[c]).alias(f"carried_{k}") for k, c in enumerate(carry)])


def contamination(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    found = find_spans(docs, benchmark, **names)
    hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


_W = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOW = "translate(coalesce(\"text\", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_W}') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all({_LOW}, '{_W}') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), {WINDOW}) AS n, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS i
       FROM b WHERE len(w) > 0 AND item_id IS NOT NULL),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bw),
sizes AS (SELECT DISTINCT n FROM g),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, i, n, g FROM dw WHERE g IN (SELECT g FROM g WHERE g.n = dw.n)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed
          FROM (SELECT DISTINCT h.doc_id, g.item_id FROM hits h JOIN g ON g.g = h.g AND g.n = h.n) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""
