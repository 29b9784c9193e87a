"""N-best SentencePiece segmentation: forward Viterbi scores as exact heuristics of a backward A* search.

The lattice has an edge for every piece of the model's vocabulary; a character that isn't a piece has one edge of its
byte pieces. The model holds ranks instead of probabilities (a BPE model's score is minus the rank of the merge), so a
piece of rank r has log probability -log(r + 2) less the log of the sum over the vocabulary, and byte pieces the
least of all. Forward Viterbi gives the best score from the start to each place; a search from the end then knows
exactly what remains, so hypotheses leave the queue in order of their whole score and the first N that reach the
start are the N best. Ties go to the hypothesis that was queued first; of equally good whole segmentations the first
pass keeps one, always the same.

No piece of the vocabulary spans certain places (before white space, and between letters and other characters; this is
tested on the vocabulary when it's loaded). Texts are cut there, as arrays of the characters of a batch: a path through a
text's lattice is a path through each part. The N best of a text are the N least sums of what is lost in each part, and
only the N - 1 parts with the smallest first loss can differ from their best in any of them. The best of a part and that
loss come from a forward and a backward pass, of parts of like length side by side over arrays, of long parts and those
with byte pieces one by one, and are kept for the parts used most (about KEPT_BYTES); the search gives the other
segmentations, scores and ids, of the parts that can differ. The segmentations of a text are put together from these, and
each is decoded. A part without a cut, however long, takes a few numbers a character and no lists of edges.

Texts are read whole, one pass without a shuffle. Null and empty texts have no pieces, one segmentation and score 0.
Decoding joins the pieces, turns byte pieces to bytes and marks to blanks, and drops the first blank; a mark that stands
in the text itself is written as byte pieces, so every text decodes to itself.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache
from heapq import nsmallest
from itertools import chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, byte_texts, distinct, in_arrow, offsets, small, with_fields

N_BEST = 4
KEPT_BYTES = 80 << 20  # of a worker
MARK = "▁"
RAW = "\udc81"  # stands for a mark in the text itself; no valid text has it
LETTER = re.compile(r"(?![\xb2\xb3\xb9])[^\W\d_]")
QUEUED = itemgetter(0, 1)
LONG = 64  # characters of a part that passes over arrays take; a longer one has passes of its own
CELLS = 1 << 20  # characters of parts times lengths of edges in arrays at once
END = 0x110000  # no character
BLANK, LINE, OTHER, LETTERS = 1, 2, 4, 8  # kinds of characters


class Trie:
    """The starts of all pieces as numbered nodes; a node and a character lead to a node, by a hash table of these pairs."""

    ODD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        nodes: dict[int, int] = {}
        ends = []
        for piece in pieces:
            node = 0
            for c in piece:
                node = nodes.setdefault(node << 21 | ord(c), len(nodes) + 1)
            ends.append(node)
        self.piece = np.full(len(nodes) + 1, -1, dtype=np.int32)  # the number of the piece that ends at a node
        self.piece[ends] = np.arange(len(pieces))
        bits = (4 * len(nodes) + 4).bit_length()
        self.shift = np.uint64(64 - bits)
        self.keys, self.nodes = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        keys = np.fromiter(nodes, np.int64, len(nodes))
        for key, node, at in zip(keys.tolist(), nodes.values(), self.slot(keys).tolist(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.nodes[at] = key, node

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.ODD) >> self.shift).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The node that each node and character lead to, 0 if no piece goes on so."""
        keys = nodes.astype(np.int64) << 21 | chars
        at = self.slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.nodes[at], 0)
        more = np.flatnonzero((there != keys) & (there >= 0))
        while len(more):
            at[more] = (at[more] + 1) % len(self.keys)
            there = self.keys[at[more]]
            hit = there == keys[more]
            out[more[hit]] = self.nodes[at[more[hit]]]
            more = more[~hit & (there >= 0)]
        return out


class Pieces:
    """The vocabulary of a SentencePiece model file as a scored lattice."""

    def __init__(self, path: str, n_best: int = N_BEST, kept: int = KEPT_BYTES):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [k for k in range(size) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        order = sorted(plain, key=lambda k: (-model.get_score(k), k))
        total = np.log(sum(1.0 / (r + 2) for r in range(len(order) + 1)))
        self.score = {model.id_to_piece(k): -float(np.log(r + 2) + total) for r, k in enumerate(order)}
        self.byte_score = -float(np.log(len(order) + 2) + total)
        self.id_of = {model.id_to_piece(k): k for k in plain}
        self.byte_id = {int(model.id_to_piece(k)[3:5], 16): k for k in range(size) if model.is_byte(k)}
        self.bytes_of = {k: model.id_to_piece(k).replace(MARK, " ").encode() for k in plain} | {k: bytes((b,)) for b, k in self.byte_id.items()}
        self.size_of = np.array([len(self.bytes_of.get(k, b"")) for k in range(size)])
        self.longest = max(map(len, self.score), default=1)
        # (length, score, ids) of each piece, found by its end in a text and by its start in a text read backwards.
        self.edge = {p: (len(p), s, (self.id_of[p],)) for p, s in self.score.items()}
        self.forward, self.backward = ahocorasick.Automaton(), ahocorasick.Automaton()
        for piece, edge in self.edge.items():
            self.forward.add_word(piece, edge)
            self.backward.add_word(piece[::-1], edge)
        self.forward.make_automaton()
        self.backward.make_automaton()
        self.single = frozenset(p for p in self.score if len(p) == 1)
        self.trie = Trie(list(self.score))
        self.scores = np.array(list(self.score.values()))
        self.ids = np.array([self.id_of[p] for p in self.score], dtype=np.uint32)
        bare = [p.lstrip(MARK) for p in self.score]
        self.apart = all(len({bool(LETTER.match(c)) for c in p}) < 2 for p in bare)
        self.kinds = np.zeros(END, dtype=np.uint8)  # the kind of a character of a text, 0 where it isn't known yet
        self.kinds[[ord(" "), ord("\n"), ord(MARK)]] = BLANK, LINE, OTHER
        self.independent = not any(MARK in p or "\n" in p[1:] or (p[:1] == "\n" and len(p) > 1) for p in bare)
        self.n_best = n_best
        self.kept = Kept(kept, 3)  # ids of the best segmentation; its score, the loss of the second best, whether it decodes
        self.others_of: dict[bytes, list[tuple[float, np.ndarray, bool]]] = {}  # the others of the n best, for parts that needed them

    def bytes_edge(self, c: str) -> tuple[int, float, tuple[int, ...]]:
        """The edge of a character that isn't a piece."""
        edge = self.edge.get(RAW + c)  # kept under a name that no text has
        if edge is None:
            raw = raw_bytes(c)
            self.edge[RAW + c] = edge = (1, self.byte_score * len(raw), tuple(self.byte_id[b] for b in raw))
        return edge

    def matches(self, text: str, alone: list[int], automaton) -> Iterator[tuple[int, tuple]]:
        """(end, edge) of each edge of a text (or a text read backwards), by rising ends; alone: places of bytes edges."""
        at = 0
        for end, edge in automaton.iter(text):
            while at < len(alone) and alone[at] <= end:
                yield alone[at], self.bytes_edge(text[alone[at]])
                at += 1
            yield end, edge
        for k in alone[at:]:
            yield k, self.bytes_edge(text[k])

    def ahead(self, text: str) -> tuple[list[float], list]:
        """The best score from the start to each place, and the last edge of that path."""
        n, least = len(text), float("-inf")
        best, last = numbers(n + 1, least), [None] * (n + 1)
        best[0] = 0.0
        single = self.single
        if single.issuperset(text):
            edges = self.forward.iter(text)
        else:
            edges = self.matches(text, [k for k, c in enumerate(text) if c not in single], self.forward)
        for end, edge in edges:
            t = best[end + 1 - edge[0]] + edge[1]
            if t > best[end + 1]:
                best[end + 1] = t
                last[end + 1] = edge
        return best, last

    def search(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a text, best first, as (score, ids): A* from the end, with the forward scores as
        exact heuristics. The hypotheses stand for disjoint sets of segmentations and each promises one of its score, so
        only as many as are still wanted need be queued."""
        ahead, _ = self.ahead(text)
        found, tick, single, edge_of = [], 0, self.single, self.edge
        queue = [(-ahead[-1], 0, len(text), 0.0, None)]
        while queue and len(found) < n:
            f, _, at, behind, path = queue.pop(0)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                found.append((-f, tuple(ids)))
                continue
            for i in range(max(0, at - self.longest), at):
                edge = edge_of.get(text[i:at])
                if edge is None:
                    if i < at - 1 or text[i] in single:
                        continue
                    edge = self.bytes_edge(text[i])
                tick += 1
                behind_it = edge[1] + behind
                insort(queue, (-(ahead[i] + behind_it), tick, i, behind_it, (edge[2], path)), key=QUEUED)
            del queue[n - len(found) :]
        return found

    def _best(self, part: str) -> tuple[list[int], float, float]:
        """Ids and score of the best segmentation, by a forward pass, and what the second best loses, by a backward pass:
        a path other than the best has an edge off it, and the best path over an edge is the sum of both passes."""
        n, least, single = len(part), float("-inf"), self.single
        ahead, last = self.ahead(part)
        path, on, at = [], bytearray(n + 1), n  # on: the length of the path's edge from each place
        while at:
            edge = last[at]
            path.append(edge[2])
            at -= edge[0]
            on[at] = edge[0]
        behind, second = numbers(n + 1, least), least
        behind[n] = 0.0
        if single.issuperset(part):
            edges = self.backward.iter(part[::-1])
        else:
            turned = part[::-1]
            edges = self.matches(turned, [k for k, c in enumerate(turned) if c not in single], self.backward)
        for end, edge in edges:
            i = n - 1 - end
            t = edge[1] + behind[i + edge[0]]
            if t > behind[i]:
                behind[i] = t
            if on[i] != edge[0] and ahead[i] + t > second:
                second = ahead[i] + t
        return list(chain.from_iterable(reversed(path))), ahead[n], ahead[n] - second

    def _best_of_all(self, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """_best() of many parts side by side, whose characters are all pieces: ids one after another and how many each
        part has, scores, and what the second best loses. chars has a column for each part, with END below it."""
        rows, n, most = chars.shape[0], chars.shape[1], self.longest
        score = np.full((rows + 1, most, n), -np.inf)  # of the edge that ends at a row, by most less its length
        piece = np.zeros((rows + 1, most, n), dtype=np.int32)
        flat = chars.ravel()
        at = np.flatnonzero(flat < END)
        nodes = np.zeros(len(at), dtype=np.int32)
        for length in range(1, min(most, rows) + 1):
            nodes = self.trie.step(nodes, flat[at + (length - 1) * n])
            at, nodes = at[nodes > 0], nodes[nodes > 0]
            found = self.trie.piece[nodes]
            is_piece = found >= 0
            row, column = np.divmod(at[is_piece], n)
            score[row + length, most - length, column] = self.scores[found[is_piece]]
            piece[row + length, most - length, column] = found[is_piece]
            inside = at + length * n < len(flat)
            at, nodes = at[inside], nodes[inside]
        every = np.arange(n)
        ahead, last = np.full((rows + 1, n), -np.inf), np.zeros((rows + 1, n), dtype=np.int64)
        ahead[0] = 0.0
        for j in range(1, rows + 1):
            k = min(j, most)
            sums = ahead[j - k : j] + score[j, most - k :]  # the longest edge first, which wins a tie
            best = sums.argmax(axis=0)
            ahead[j], last[j] = sums[best, every], k - best
        on, column, end = np.zeros((rows, n), dtype=np.int64), every, lengths  # on: the length of the path's edge from each row
        while len(column):
            edge = last[end, column]
            end = end - edge
            on[end, column] = edge
            column, end = column[end > 0], end[end > 0]
        behind, second = np.full((rows + 1, n), -np.inf), np.full(n, -np.inf)
        behind[lengths, every] = 0.0
        down, across, _ = score.strides
        for i in range(rows - 1, -1, -1):
            k = min(most, rows - i)
            edges = np.lib.stride_tricks.as_strided(score[i + 1, most - 1 :], (k, n), (down - across, score.itemsize))  # from row i, by length
            sums = edges + behind[i + 1 : i + 1 + k]
            np.maximum(behind[i], sums.max(axis=0), out=behind[i])
            column = np.flatnonzero(on[i])
            sums[on[i, column] - 1, column] = -np.inf
            np.maximum(second, ahead[i] + sums.max(axis=0), out=second)
        column, row = np.nonzero(on.T)
        edge = on[row, column]
        total = ahead[lengths, every]
        return self.ids[piece[row + edge, most - edge, column]], np.bincount(column, minlength=n), total, total - second

    def learn(self, parts: list[str], names: list[bytes]) -> None:
        """Keep the best segmentations of parts under their names: of short ones over arrays, of the others one by one."""
        single, sizes = self.single, np.fromiter(map(len, parts), np.int64, len(parts))
        able = (sizes <= LONG) & np.fromiter(map(single.issuperset, parts), bool, len(parts))
        order = np.flatnonzero(able)
        order = order[np.argsort(sizes[order], kind="stable")]
        while len(order):
            n = max(1, int(np.searchsorted(sizes[order] * np.arange(1, len(order) + 1), CELLS // self.longest)))
            some, order = order[:n], order[n:]
            lengths = sizes[some]
            chars = np.full((lengths[-1], n), END, dtype=np.int32)
            text = "".join([parts[k] for k in some.tolist()])
            starts = offsets(lengths)
            column = np.repeat(np.arange(n), lengths)
            chars[np.arange(len(column)) - starts[column], column] = np.frombuffer(text.encode("utf-32-le"), dtype=np.int32)
            ids, counts, scores, losses = self._best_of_all(chars, lengths)
            called, cuts, flat = [names[k] for k in some.tolist()], offsets(counts), ids.tolist()
            bytes_each = np.fromiter(map(len, called), np.int64, n)
            right = np.add.reduceat(self.size_of[ids], cuts[:-1]) == bytes_each
            if self.spelled(flat) != b"".join(called) or not right.all():  # all at once, then one by one
                cuts = cuts.tolist()
                right = [self.spelled(flat[x:y]) == name for x, y, name in zip(cuts[:-1], cuts[1:], called, strict=True)]
            self.kept.add(called, counts, ids, np.column_stack([scores, losses, right]))
        rest = np.flatnonzero(~able).tolist()
        found = [self._best(parts[k]) for k in rest]
        ids = list(chain.from_iterable(x for x, _, _ in found))
        values = [(s, loss, self.spelled(x) == names[k]) for k, (x, s, loss) in zip(rest, found, strict=True)]
        if rest:
            self.kept.add([names[k] for k in rest], np.array([len(x) for x, _, _ in found], dtype=np.int64), np.array(ids, dtype=np.uint32), values)

    def others(self, name: bytes) -> list[tuple[float, np.ndarray, bool]]:
        """What the second best to the n-th best segmentation of a part lose, their ids, and whether they decode, by the search."""
        if name not in self.others_of:
            k, part = self.kept.place[name], part_of(name)
            best = tuple(self.kept.flat[self.kept.start[k] : self.kept.start[k] + self.kept.length[k]].tolist())
            found = self.search(part, self.n_best)
            rest = [(found[0][0] - s, np.array(ids, dtype=np.uint32), self.spelled(ids) == name) for s, ids in found if ids != best]
            self.others_of[name] = rest[: self.n_best - 1]
        return self.others_of[name]

    def normal(self, text: str) -> str:
        return MARK + text.replace(MARK, RAW).replace(" ", MARK) if text else ""

    def kinds_of(self, chars: np.ndarray) -> np.ndarray:
        kinds = self.kinds[chars]
        if not kinds.all():
            for c in np.unique(chars[kinds == 0]).tolist():
                self.kinds[c] = LETTERS if self.apart and LETTER.match(chr(c)) else OTHER
            kinds = self.kinds[chars]
        return kinds

    def cut(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct parts of texts under their names (part_of() gives the part), the parts of all texts as places in
        these, and where the parts of each text begin (and the last end)."""
        joined = "".join([" " + t for t in texts if t])
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        bounds = offsets([len(t) + 1 if t else 0 for t in texts])
        begins = np.zeros(len(chars), dtype=bool)
        if self.independent and len(chars):
            kinds = self.kinds_of(chars)
            now, before = kinds[1:], kinds[:-1]
            both = now | before
            begins[1:] = ((now == BLANK) & (before != BLANK)) | (both & LINE > 0) | (both == LETTERS | OTHER)
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        first = np.append(np.flatnonzero(begins), len(chars))
        starts = np.searchsorted(first, bounds)
        if len(data) > len(chars):
            wide = 1 + (chars > 0x7F).astype(np.uint8) + (chars > 0x7FF) + (chars > 0xFFFF)
            first = offsets(wide)[first]
        return *distinct(data, first), starts

    def encode_all(self, texts: list[str]) -> list[tuple[list[float], list[list[np.ndarray]], bool]]:
        """For each text the scores of its n best segmentations, their ids (as arrays to be joined), and whether each decodes
        to the text (each part's segmentation is decoded; decoding a text joins those of its parts)."""
        if self.kept.bytes > self.kept.limit:
            self.kept.trim()
            self.others_of.clear()
        names, which, starts = self.cut(texts)
        first = starts.tolist()
        places = self.kept.places(names)
        if len(missing := np.flatnonzero(places < 0)):
            new = [names[k] for k in missing.tolist()]
            self.learn([part_of(x) for x in new], new)
            places[missing] = [self.kept.place[x] for x in new]
        places = places[which]
        ids, ends = self.kept.ids(places)
        best, loss, decodes = self.kept.values[places].T
        want, out = self.n_best - 1, []
        for a, b in zip(first[:-1], first[1:], strict=True):
            own, least = ids[ends[a] : ends[b]], loss[a:b]
            near = np.arange(b - a)
            if b - a > want > 0:
                near = np.flatnonzero(least <= np.partition(least, want - 1)[want - 1])
            near = near[np.argsort(least[near], kind="stable")][:want].tolist()
            sums: list[tuple[float, tuple]] = [(0.0, ())]  # with the parts that aren't their best: (place, number of the other)
            for k in near:
                if len(sums) > want and least[k] >= sums[-1][0]:
                    break
                more = [(x + y[0], (*at, (k, j))) for x, at in sums for j, y in enumerate(self.others(names[which[a + k]]))]
                sums = nsmallest(want + 1, sums + more)
            each, ok = [[own]], bool(decodes[a:b].all())
            for _, at in sums[1:]:
                pieces, last = [], ends[a]
                for k, j in sorted(at):
                    _, other, right = self.others_of[names[which[a + k]]][j]
                    pieces += [ids[last : ends[a + k]], other]
                    last, ok = ends[a + k + 1], ok and right
                each.append([*pieces, ids[last : ends[b]]])
            score = float(best[a:b].sum())
            out.append(([score - x for x, _ in sums], each, ok))
        return out

    def encode(self, text: str) -> tuple[np.ndarray, list[float], list[np.ndarray]]:
        """Ids of the best segmentation, and the scores and ids of the n best."""
        scores, each, _ = self.encode_all([text])[0]
        ids = [np.concatenate(x) for x in each]
        return ids[0], scores, ids

    def spelled(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.spelled(ids).decode("utf-8", "replace")[1:]


def numbers(n: int, value: float):
    """n numbers; compact ones for a long text."""
    return [value] * n if n < 10_000 else array("d", [value]) * n


def raw_bytes(c: str) -> bytes:
    return (MARK if c == RAW else c).encode("utf-8", "surrogatepass")


def part_of(name: bytes) -> str:
    """The part of a normal text that the bytes of a text, its name, become."""
    return name.decode("utf-8", "surrogatepass").replace(MARK, RAW).replace(" ", MARK)


@lru_cache(maxsize=1)
def pieces_of(path: str, n_best: int, kept: int) -> Pieces:
    """One for each Python worker, over all its tasks."""
    return Pieces(path, n_best, kept)


def lists(lengths: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets(lengths), pa.int32()), values)


def encode(docs: DataFrame, model: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text", n_best: int = N_BEST, with_ids: bool = True, kept: int = KEPT_BYTES) -> DataFrame:
    """For each row of docs: keys, n_pieces, score, n_best_scores (best first), ids_crc32, decodes (decoding each of the
    n best gives the text again) and, if with_ids, piece_ids and n_best_ids (those of the best, and of all as in
    n_best_scores). kept: bytes of parts that a worker keeps; more saves time and changes no row."""
    picked = docs.select(*[F.col(c).alias(f"key_{k}") for k, c in enumerate(keys)], F.col(text).alias("body"))
    ddl = "n_pieces bigint, score double, n_best_scores array<double>, ids_crc32 bigint, decodes boolean" + ", n_best_ids array<array<int>>" * with_ids
    schema = with_fields(picked.drop("body").schema, ddl)

    def run(batches: Iterator[pa.RecordBatch]):
        pieces = pieces_of(model, n_best, kept)
        for batch in small(batches, "body", 1 << 20):
            found = pieces.encode_all([t.decode() for t in byte_texts(batch.column("body"))])
            own = [np.concatenate(ids[0]).astype("<u4") for _, ids, _ in found]
            columns = [batch.column(f"key_{k}") for k in range(len(keys))] + [
                pa.array([len(x) for x in own], pa.int64()),
                pa.array([s[0] for s, _, _ in found], pa.float64()),
                pa.array([s for s, _, _ in found], pa.list_(pa.float64())),
                pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                pa.array([ok for _, _, ok in found], pa.bool_()),
            ]
            if with_ids:
                lengths = [sum(map(len, x)) for _, ids, _ in found for x in ids]
                values = np.concatenate([x for _, ids, _ in found for each in ids for x in each]).astype(np.int32)
                columns.append(lists([len(ids) for _, ids, _ in found], lists(lengths, pa.array(values))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = picked.transform(in_arrow, run, schema)
    names = schema.names[len(keys) :]
    if with_ids:
        rows, names = rows.withColumn("piece_ids", F.col("n_best_ids")[0]), [*names[:-1], "piece_ids", names[-1]]
    return rows.select(*[F.col(f"key_{k}").alias(c) for k, c in enumerate(keys)], *names)
