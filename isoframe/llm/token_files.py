"""Token ids in Simple-8b files, in ascending doc_id order.

A word of 64 bits holds a 4-bit selector and as many ids as fit: 60 of 1 bit to 1 of 60 bits. An id of more than 60
bits is an escape: its word holds a place in the segment's table of raw values. Ids are packed in blocks of BLOCK,
each with its word offset, so blocks are coded and decoded side by side as arrays.

A file is a run of segments, one for each Arrow batch of documents (little-endian):

    "S8BT0001", seven int64 (documents, ids, blocks, words, escapes, BLOCK, 0),
    doc_ids int64[documents], lengths int64[documents], offsets int64[blocks + 1], words uint64, escapes uint64

Documents are range-partitioned and sorted by doc_id (ties by text; a null doc_id comes first and is stored as the
least int64), about FILE_BYTES of text a file. A file is named in the manifest only by the task attempt whose output
Spark committed, so a lost executor leaves at most an unnamed file. Null and empty texts have the end id alone.

Texts are encoded whole by the tokenizers library. A byte-level BPE never joins across the place between a character
that isn't white space and white space after it, nor between a letter and another ASCII character after it. Texts are cut
there, as arrays of the bytes of a batch; its distinct pieces are looked up once, encoded once and kept, the most used in
about KEPT_BYTES. Letters with a blank before them are one word to the tokenizer's pattern and go to its model at once.
A text that holds an added token of the tokenizer (an end mark, say) or rare white space is one piece.
"""

from __future__ import annotations

import codecs
import re
import string
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, byte_data, distinct, in_arrow, offsets, shared_dir, small

BLOCK = 256
FILE_BYTES = 32 << 20
KEPT_BYTES = 160 << 20  # of a worker
RUN = 4000  # pieces that go to the library at once
END_ID = 2
MAGIC = b"S8BT0001"
NO_ID = -(1 << 63)

# Fixed values of the coding: ids in a word, and bits for each, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], dtype=np.int64)
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60], dtype=np.int64)
ESCAPE = 14


def _pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words in each block, and raw values of escapes, of whole blocks (the last may be short)."""
    n_blocks = -(-len(values) // BLOCK)
    wide = np.zeros((n_blocks, BLOCK + 60), dtype=np.uint64)
    body = np.zeros(n_blocks * BLOCK, dtype=np.uint64)
    body[: len(values)] = values
    wide[:, :BLOCK] = body.reshape(n_blocks, BLOCK)
    length = np.full(n_blocks, BLOCK)
    length[-1] = len(values) - (n_blocks - 1) * BLOCK
    bits = np.frexp(wide.astype(np.float64))[1].astype(np.uint8)
    reach = {1: bits}  # most bits of the next 1, 2, 4 ... values
    for k in (1, 2, 4, 8, 16):
        reach[2 * k] = reach[k].copy()
        np.maximum(reach[k][:, :-k], reach[k][:, k:], out=reach[2 * k][:, :-k])
    selector = np.full((n_blocks, BLOCK), ESCAPE, dtype=np.uint8)
    for c, b in zip(COUNTS[:ESCAPE].tolist(), BITS.tolist(), strict=False):  # what fits one selector fits all after it
        k = 1 << (c.bit_length() - 1)
        selector -= np.maximum(reach[k][:, :BLOCK], reach[k][:, c - k : c - k + BLOCK]) <= b
    starts = np.zeros((n_blocks, BLOCK), dtype=bool)
    row, at = np.arange(n_blocks), np.zeros(n_blocks, dtype=np.int64)
    while len(row):
        starts[row, at] = True
        at = at + COUNTS[selector[row, at]]
        left = at < length[row]
        row, at = row[left], at[left]
    block, place = np.nonzero(starts)
    chosen = selector[block, place].astype(np.int64)
    flat, first = wide.ravel(), block * (BLOCK + 60) + place
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            raw = flat[first[mine]]
            words[mine] |= np.arange(len(mine), dtype=np.uint64)
            continue
        for k in range(COUNTS[s]):
            words[mine] |= flat[first[mine] + k] << np.uint64(k * BITS[s])
    if ESCAPE not in chosen:
        raw = np.zeros(0, np.uint64)
    return words, np.bincount(block, minlength=n_blocks), raw


def pack(values: np.ndarray, step: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, offsets of the blocks in them, and escapes; step blocks at a time."""
    values = np.asarray(values, dtype=np.uint64)
    words, sizes, raws, n = [], [], [], 0
    for k in range(0, len(values), step * BLOCK):
        w, c, raw = _pack(values[k : k + step * BLOCK])
        if len(raw):
            w[(w >> np.uint64(60)) == ESCAPE] += np.uint64(n)
            n += len(raw)
        words.append(w)
        sizes.append(c)
        raws.append(raw)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *words]), offsets(np.concatenate([np.zeros(0, np.int64), *sizes])), np.concatenate([none, *raws])


def unpack(words: np.ndarray, starts: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    """The n values of pack()."""
    out = np.zeros((len(starts) - 1) * BLOCK, dtype=np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector]
    before = np.cumsum(count) - count
    block = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    place = before - before[starts[:-1]][block] if len(words) else before
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        low = words[mine] & np.uint64((1 << 60) - 1)
        to, inside = block[mine] * BLOCK + place[mine], place[mine]
        if s == ESCAPE:
            out[to] = raw[low.astype(np.int64)]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(COUNTS[s]):
            fits = inside + k < BLOCK
            out[to[fits] + k] = (low[fits] >> np.uint64(k * BITS[s])) & mask
    return out[:n]


def segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, starts, raw = pack(ids)
    head = np.array([len(doc_ids), len(ids), len(starts) - 1, len(words), len(raw), BLOCK, 0], dtype="<i8")
    parts = (head, doc_ids.astype("<i8"), lengths.astype("<i8"), starts.astype("<i8"), words.astype("<u8"), raw.astype("<u8"))
    return MAGIC + b"".join(x.tobytes() for x in parts)


def segments(file) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, lengths, ids) of each segment of an open file."""
    while start := file.read(8):
        if start != MAGIC:
            raise ValueError("not a token file")
        docs, n, blocks, n_words, escapes, block, _ = np.frombuffer(file.read(56), dtype="<i8").tolist()
        if block != BLOCK:
            raise ValueError(f"blocks of {block} ids")
        take = lambda k, kind="<i8": np.frombuffer(file.read(8 * k), dtype=kind)
        doc_ids, lengths, starts = take(docs), take(docs), take(blocks + 1)
        yield doc_ids, lengths, unpack(take(n_words, "<u8"), starts, take(escapes, "<u8"), n)


class Encoder:
    """Whole texts to ids, through pieces that are kept."""

    OTHER_SPACE = "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    # Letters up to U+024F are letters in every version of Unicode: C3 80 to C9 8F but for the signs C3 97 and C3 B7.
    WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")
    SPACE, LETTER, OTHER, LEAD, LEAD_C3, FOLLOWS_C3, FOLLOWS = (1 << k for k in range(7))
    KINDS = np.zeros(256, dtype=np.uint8)  # the kinds of a byte
    KINDS[:128] = OTHER
    KINDS[list(string.ascii_letters.encode())] = LETTER
    KINDS[list(b" \t\n\r")] = SPACE
    KINDS[0xC4:0xC9] = LEAD
    KINDS[0xC3] = LEAD_C3
    KINDS[0x80:0xC0] = FOLLOWS | FOLLOWS_C3
    KINDS[[0x97, 0xB7]] = FOLLOWS
    # Byte-level BPE writes a byte as a character: those that print as themselves, the others from 256 on.
    UNPRINTED = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
    BYTE_TEXT = "".join("\n" if b == 10 else chr(c) for b, c in ({b: b for b in range(256)} | UNPRINTED).items())

    def __init__(self, path: str, kept: int = KEPT_BYTES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)  # the same model on lines, each a word
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        size = self.tokenizer.get_vocab_size()
        self.byte_length = np.array([len(self.tokenizer.id_to_token(k) or "") for k in range(size)], dtype=np.int64)
        # Added tokens are found in whole texts, before any cut.
        added = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.apart = "|".join([self.OTHER_SPACE, *added])
        self.kept = Kept(kept)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes], alone: set[bytes]) -> None:
        """Keep the ids of new pieces."""
        is_word = [p not in alone and self.WORD.fullmatch(p) is not None for p in pieces]
        self._encode_words(list(compress(pieces, is_word)))
        self._encode([p for p, word in zip(pieces, is_word, strict=True) if not word], alone)

    def _add_joined(self, pieces: list[bytes], ids: np.ndarray) -> bool:
        """Keep pieces by the ids of all of them in a row, if these end where the pieces do."""
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        at = np.cumsum(self.byte_length[ids])
        cuts = np.searchsorted(at, ends) + 1
        fits = len(at) > 0 and bool((at[np.minimum(cuts - 1, len(at) - 1)] == ends).all())
        if fits:
            self.kept.add(pieces, np.diff(cuts, prepend=0), ids)
        return fits

    def _encode_words(self, words: list[bytes]) -> None:
        """Encode letters, with a blank before them or none: the library's model takes them as they are."""
        for k in range(0, len(words), RUN):
            some = words[k : k + RUN]
            lines = codecs.charmap_decode(b"\n".join(some), "strict", self.BYTE_TEXT)[0]
            ids = np.array(self.words.encode_batch_fast([lines], add_special_tokens=False)[0].ids, dtype=np.uint32)
            if not self._add_joined(some, ids):
                self._encode(some, set())

    def _encode(self, pieces: list[bytes], alone: set[bytes]) -> None:
        """Encode pieces: those that begin with a blank in one text, which their blanks part; alone has exceptions."""
        able = [p for p in pieces if p[0] in b" \n" and p[-1] not in b" \t\n\r" and p not in alone]
        for k in range(0, len(able), RUN):
            joined = able[k : k + RUN]
            self._add_joined(joined, np.array(self.whole([b"".join(joined).decode()])[0], dtype=np.uint32))
        rest = [p for p in pieces if p not in self.kept.place]
        for k in range(0, len(rest), RUN):
            found = [np.array(x, dtype=np.uint32) for x in self.whole([p.decode() for p in rest[k : k + RUN]])]
            self.kept.add(rest[k : k + RUN], np.array([len(x) for x in found], dtype=np.int64), np.concatenate(found))

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each byte: white space after another character, or another ASCII character after a letter."""
        kind = self.KINDS[data]
        out = np.zeros(len(data), dtype=bool)
        space, other = kind == self.SPACE, kind == self.OTHER
        out[1:] = space[1:] & ~space[:-1]
        out[1:] |= other[1:] & (kind[:-1] == self.LETTER)
        high = np.flatnonzero(other[2:] & (kind[1:-1] >= self.FOLLOWS)) + 2  # after a character of several bytes
        lead, last = kind[high - 2], kind[high - 1]
        out[high] |= (lead == self.LEAD) | ((lead == self.LEAD_C3) & (last & self.FOLLOWS_C3 > 0))
        return out

    def encode(self, texts: list[str], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_column(pa.array(texts, pa.large_string()), end)

    def encode_column(self, column: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column's texts one after another, and how many each text has; end is put after each text."""
        self.kept.trim()
        body = column.cast(pa.large_binary()).fill_null(b"")
        data, bounds = byte_data(body)
        begins = self.cuts(data)
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        alone = set()
        for k in np.flatnonzero(pc.match_substring_regex(body.cast(pa.large_string()), self.apart)).tolist():
            alone.add(body[k].as_py())
            begins[bounds[k] + 1 : bounds[k + 1]] = False
        first = np.append(np.flatnonzero(begins), len(data))
        pieces, which = distinct(data, first)
        places = self.kept.places(pieces)
        if len(missing := np.flatnonzero(places < 0)):
            new = [pieces[k] for k in missing.tolist()]
            self._learn(new, alone)
            places[missing] = [self.kept.place[p] for p in new]
        ends, places = np.searchsorted(first, bounds[1:]), places[which]
        if end is not None:
            mark = ("end", end)  # a piece that no text has
            if mark not in self.kept.place:
                self.kept.add([mark], np.ones(1, np.int64), np.array([end], dtype=np.uint32))
            places = np.insert(places, ends, self.kept.place[mark])
            ends = ends + np.arange(1, len(ends) + 1)
        ids, at = self.kept.ids(places)
        return ids, np.diff(at[ends], prepend=0)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One for each Python worker, over all its tasks."""
    return Encoder(path)


def arrow_uri(root: str) -> str:
    """The folder under the name that Arrow's file systems know: s3a is s3, dbfs is a mounted folder."""
    for theirs, ours in (("s3a://", "s3://"), ("s3n://", "s3://"), ("dbfs:/", "file:///dbfs/")):
        if root.startswith(theirs):
            return ours + root[len(theirs) :].lstrip("/")
    return root


def write(docs: DataFrame, tokenizer: str, root: str, doc_id: str = "doc_id", text: str = "text", end: int | None = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the files and their manifest below root; returns the manifest (part, file, docs, ids, start)."""
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    size = picked.agg(F.sum(F.octet_length("body") + 8)).first()[0] or 0
    ordered = picked.repartitionByRange(max(1, -(-size // file_bytes)), "doc_id").sortWithinPartitions("doc_id", "body")

    def run(batches: Iterator[pa.RecordBatch]):
        part = TaskContext.get().partitionId()
        store, folder = fs.FileSystem.from_uri(arrow_uri(root))
        name, out, n_docs, n_ids = f"part-{part:06d}-{uuid.uuid4().hex}.s8b", None, 0, 0
        for batch in small(batches, "body", 1 << 20):
            if out is None:
                encoder = encoder_of(tokenizer)
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(f"{folder}/{name}")
            ids, sizes = encoder.encode_column(batch.column("body"), end)
            out.write(segment(batch.column("doc_id").fill_null(NO_ID).to_numpy(), sizes, ids))
            n_docs, n_ids = n_docs + len(sizes), n_ids + len(ids)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "docs": [n_docs], "ids": [n_ids]})

    ordered.transform(in_arrow, run, "part bigint, file string, docs bigint, ids bigint").write.parquet(f"{root}/manifest")
    listed = docs.sparkSession.read.parquet(f"{root}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))  # one row for each file


def read(manifest: DataFrame, root: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]):
        store, folder = fs.FileSystem.from_uri(arrow_uri(root))
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_stream(f"{folder}/{name}") as file:
                    for doc_ids, lengths, ids in segments(file):
                        first = offsets(lengths)
                        small = ids.astype("<u4")
                        crc = [zlib.crc32(small[a:b].tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)]
                        yield pa.RecordBatch.from_pydict(
                            {"doc_id": pa.array(doc_ids, mask=doc_ids == NO_ID), "start": pa.array(first[:-1] + start),
                             "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64())}
                        )
                        start += len(ids)

    n = max(1, manifest.count())
    return manifest.repartition(n, "part").transform(in_arrow, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str, **names) -> DataFrame:
    root = shared_dir(docs.sparkSession, "tokens")
    return read(write(docs, tokenizer, root, **names), root)
