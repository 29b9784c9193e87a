import zlib

import numpy as np
import pytest

from isoframe.llm import nbest_pieces, token_files
from isoframe.llm.queries import tokenizer_file

TEXTS = [
    "", " ", "a", "\n\n x  \n", "foo  bar  　\n zz", "it's <|endoftext|> ok  <|endoftext|>x", "naïve, façade!! ??? 123 4567 x1y2",
    "é" * 50, "\t\ttab\r\n\r\nx ", 'a.b,c;d "q" ...', "日本語 テキスト。", "x \x0b y", "ª º² word².", "the the, the. the",
]


@pytest.fixture(scope="module")
def encoder():
    return token_files.Encoder(tokenizer_file("byte_bpe_50k.json"))


def test_pieces_encode_as_whole_texts(encoder):
    for _ in range(2):  # the second time from what is kept
        ids, sizes = encoder.encode(TEXTS, None)
        cuts = np.split(ids, np.cumsum(sizes)[:-1])
        assert [c.tolist() for c in cuts] == encoder.whole(TEXTS)


def test_ids_are_those_of_the_plain_library(encoder):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    few = token_files.Encoder(tokenizer_file("byte_bpe_50k.json"), kept=3000)
    rng = np.random.default_rng(3)
    bits = ["<|endoftext|>", " ", "  ", "\n", "a", "word", ",", "<|", "é", "\t", "12", "'s", "\0", "　"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(400)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert any(50256 in x for x in want)
    for made in (encoder, few):
        for k in range(0, 400, 50):
            ids, sizes = made.encode(texts[k : k + 50], None)
            assert [c.tolist() for c in np.split(ids, np.cumsum(sizes)[:-1])] == want[k : k + 50]


def test_punctuation_after_letters_is_parted_as_the_library_does():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    made = token_files.Encoder(tokenizer_file("byte_bpe_50k.json"), kept=30_000)
    rng = np.random.default_rng(4)
    bits = [" ", " ", "word", "it", "'s", "'", "'ll", "É", "í", "ª", "中", "ɐ", "7", ".", ",", "...", '"', "$$", "_", "\n", "<|", "|>", "\x00", "–"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 14))) for _ in range(1500)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for k in range(0, len(texts), 50):
        ids, sizes = made.encode(texts[k : k + 50], None)
        assert [c.tolist() for c in np.split(ids, np.cumsum(sizes)[:-1])] == want[k : k + 50]


def test_a_word_is_kept_once_whatever_follows_it():
    made = token_files.Encoder(tokenizer_file("byte_bpe_50k.json"))
    words, ends = ["word", "été", "ȯne", "Ÿx"], [*",.;:!?)-7", "...", "'s", '"']
    text = " ".join(w + e for w in words for e in ends)
    ids, _ = made.encode([text], None)
    assert [ids.tolist()] == made.whole([text])
    assert len(made.kept.place) <= 2 * len(words) + len(ends)


def test_an_added_token_of_letters(tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    plain.add_tokens(["qwert"])
    plain.save(str(tmp_path / "more.json"))
    made = token_files.Encoder(str(tmp_path / "more.json"))
    texts = ["qwert", "a qwert b", "qwer t", " qwert", "qwerty"]
    ids, sizes = made.encode(texts, None)
    assert [c.tolist() for c in np.split(ids, np.cumsum(sizes)[:-1])] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


def test_columns_with_nulls_and_offsets(encoder):
    import pyarrow as pa

    texts = [None, "", *TEXTS, None, "a×b÷c é×, ÷. ñ7", "a\u0301. x\u0301, ɐ. ɐ", "", "x " * 3000, None]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["cut off", *texts, "and this"], kind).slice(1, len(texts))
        for end in (None, 2):
            ids, sizes = encoder.encode_column(column, end)
            want = [x + [end] * (end is not None) for x in encoder.whole([t or "" for t in texts])]
            assert [c.tolist() for c in np.split(ids, np.cumsum(sizes)[:-1])] == want
    for none in (column[:0], pa.array([None, ""], kind)):
        assert encoder.encode_column(none, None)[0].tolist() == []


@pytest.mark.parametrize("n", [0, 1, 5, 255, 256, 257, 3000])
def test_simple8b_round_trip(n):
    rng = np.random.default_rng(n)
    v = rng.integers(0, 2**63, n, dtype=np.uint64) >> rng.integers(0, 63, n).astype(np.uint64)
    if n > 4:
        v[:4] = [2**64 - 1, 2**60 - 1, 2**60, 0]
    words, starts, raw = token_files.pack(v, step=4)
    assert (token_files.unpack(words, starts, raw, n) == v).all()
    assert n < 5 or len(raw) >= 2


def test_files_give_the_ids_again(spark, odd_docs, no_docs, encoder):
    rows = sorted(((r.doc_id, r.text or "") for r in odd_docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for (i, _), ids in zip(rows, encoder.whole([t for _, t in rows]), strict=True):
        ids = [*ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = token_files.round_trip(odd_docs, tokenizer_file("byte_bpe_50k.json"), file_bytes=2000).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.round_trip(no_docs, tokenizer_file("byte_bpe_50k.json")).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return nbest_pieces.Pieces(tokenizer_file("piece_bpe_32k.model"))


def all_scores(pieces, text):
    body, out = pieces.normal(text), []

    def back(j, score):
        if j == 0:
            out.append(score)
        for i in range(j):
            if body[i:j] in pieces.score:
                back(i, score + pieces.score[body[i:j]])
            elif i == j - 1:
                back(i, score + pieces.byte_score * len(nbest_pieces.raw_bytes(body[i])))

    back(len(body), 0.0)
    return sorted(out, reverse=True)


@pytest.mark.parametrize("text", ["", "the cat", "a b.", "hello, x", "ün 12", "one\ntwo", "𓀀a", "  x"])
def test_n_best_match_all_segmentations(pieces, text):
    want = all_scores(pieces, text)[: pieces.n_best]
    assert np.allclose(pieces.encode(text)[1], want)
    assert np.allclose([s for s, _ in pieces.search(pieces.normal(text), pieces.n_best)], want)


@pytest.mark.parametrize("text", [*TEXTS, "the cat", "a b.", "ün 12", "𓀀a", "the the the the"])
def test_n_best_segmentations_differ_and_decode(pieces, text):
    score = {pieces.id_of[p]: s for p, s in pieces.score.items()} | {k: pieces.byte_score for k in pieces.byte_id.values()}
    best, scores, ids = pieces.encode(text)
    assert len(ids) == len(scores) == len({tuple(x.tolist()) for x in ids}) and (ids[0] == best).all()
    assert np.allclose([sum(score[k] for k in x.tolist()) for x in ids], scores)
    assert all(pieces.decode(x.tolist()) == text for x in ids)


def test_query_returns_all_segmentations(odd_docs):
    got = nbest_pieces.encode(odd_docs, tokenizer_file("piece_bpe_32k.model")).collect()
    assert all(len(r.n_best_ids) == len(r.n_best_scores) and r.n_best_ids[0] == r.piece_ids for r in got)
    assert max(len(r.n_best_ids) for r in got) == nbest_pieces.N_BEST


def test_a_long_part_without_a_cut(pieces):
    text = "".join(chr(97 + (k * k * 7 + k // 13) % 26) for k in range(60_000)) + "日本" * 3000
    best, scores, ids = pieces.encode(text)
    assert all(pieces.decode(x.tolist()) == text for x in ids) and len({tuple(x.tolist()) for x in ids}) == 4
    assert scores == sorted(scores, reverse=True)


def test_what_is_kept_has_a_bound_and_changes_nothing(pieces):
    few = nbest_pieces.Pieces(tokenizer_file("piece_bpe_32k.model"), kept=2000)
    for t in [*TEXTS, " ".join(f"w{k}" for k in range(300)), *TEXTS]:
        assert [x.tolist() for x in few.encode(t)[2]] == [x.tolist() for x in pieces.encode(t)[2]]
        assert np.allclose(few.encode(t)[1], pieces.encode(t)[1])


def test_passes_over_arrays_agree_with_those_of_a_part(pieces):
    made = nbest_pieces.Pieces(tokenizer_file("piece_bpe_32k.model"))
    rng = np.random.default_rng(5)
    bits = ["the", "ing", "tion", "e", "s", "x", "é", "ß", "die", " ", " ", "12", ".", "...", "\n", "日", "▁", "\0", "𓀀", "a" * 70]
    texts = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(300)]
    made.encode_all(texts)
    assert len(made.kept.place) > 500
    for name, k in made.kept.place.items():
        ids, score, loss = pieces._best(nbest_pieces.part_of(name))
        start = made.kept.start[k]
        assert made.kept.flat[start : start + made.kept.length[k]].tolist() == ids
        assert made.kept.values[k].tolist() == [score, loss, 1.0]


def test_words_need_no_pass_of_their_own(monkeypatch):
    made = nbest_pieces.Pieces(tokenizer_file("piece_bpe_32k.model"))
    monkeypatch.setattr(made, "_best", None)
    text = "Thstinnt thndhain, onhalyti the éelleç in erthst. Orth (it) thon 12 tiontiontion"
    assert made.decode(made.encode(text)[0].tolist()) == text


def test_texts_are_cut_as_by_the_pattern(pieces):
    import re

    letter = r"(?![\xb2\xb3\xb9])[^\W\d_]"
    pattern = re.compile(rf"▁*(?:{letter})+|▁*(?:(?!{letter})[^▁\n])+|\n|▁+")
    texts = [*TEXTS, "", "a ▁▁ b▁", "½ x²y³ Ⅷ_a ", "  \n \n", "𓀀a e\u0301", "\n", "ab\0c", ""]
    names, which, starts = pieces.cut(texts)
    for t, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
        assert [nbest_pieces.part_of(names[k]) for k in which[a:b]] == pattern.findall(pieces.normal(t))


def test_rows_match_the_search_over_whole_texts(spark, pieces):
    texts = ["the cat sat", "a b.", "one\ntwo ün 12", "", "x ▁ y", "Der Hund, die Katze!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in nbest_pieces.encode(docs, tokenizer_file("piece_bpe_32k.model")).collect():
        want = pieces.search(pieces.normal(texts[r.doc_id]), 4)
        assert np.allclose(r.n_best_scores, [s for s, _ in want])
        assert r.ids_crc32 == zlib.crc32(np.array(r.piece_ids, dtype="<u4").tobytes()) and r.decodes


def test_decoding(pieces):
    assert pieces.independent
    for t in [*TEXTS, "a ▁▁ b▁"]:
        assert pieces.decode(pieces.encode(t)[0].tolist()) == t


def test_encode_rows(odd_docs, no_docs):
    model = tokenizer_file("piece_bpe_32k.model")
    got = nbest_pieces.encode(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(r.decodes and len(r.piece_ids) == r.n_pieces for r in got)
    assert all(r.n_best_scores == sorted(r.n_best_scores, reverse=True) and r.score == r.n_best_scores[0] for r in got)
    assert nbest_pieces.encode(no_docs, model).count() == 0
