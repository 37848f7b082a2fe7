"""Token chunks, token files, packing and SentencePiece against the libraries."""

import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from veilmark.llm import packing, piece_codec, token_files, tokens  # noqa: E402

TRICKY = ["", " ", "a  b", "a   b", " x", "x ", "x \ny", "x\n y", "x\n\ny", "x\n\n\ny", "a\tb c", " \n ", "it's don't 'S\n", "é́ a b", "a\x1cb \x1cc",
          "<|endoftext|> a", "x \n", "x\n", "\n", "日本 語 12345 ½", "A　 B", "ǅ İ ΣΑΣ", "a ́b", "w, w. w", "é. É,", "ª.", "b" * 5000,
          "\u0130, i", "\u0958, \u095f.", "\ufb2e. \ufb2e,", "\u01c5, \u0149.", "a<|endoftext|>b, <|endoftext|>, <|startoftext|><|endoftext|>\n", "<|ENDOFTEXT|> <|endoftext", " <|endoftext|> .",
          "<|endoftext|>\n\n<|startoftext|>  x"]


def texts(n):
    rng = random.Random(n)
    return TRICKY + ["".join(rng.choice("ab .,\n\t'1éB!") for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def all_planes(n):
    """Texts of characters from everywhere, with stops, special strings and blanks between them."""
    rng = random.Random(n)
    ends = [0x80, 0x250, 0x600, 0xA00, 0x3100, 0x10000, 0x110000]
    sign = lambda: chr(next(c for c in iter(lambda: rng.randrange(rng.choice(ends)), None) if not 0xD800 <= c < 0xE000))
    odd = [",", ".", " ", " ", "\n", "<|endoftext|>", "<|startoftext|>", "\u0301", "e", "'s"]
    return ["".join(rng.choice(odd) if rng.random() < 0.5 else sign() for _ in range(rng.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("name, kind", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_chunks_give_the_ids_of_the_whole_text(name, kind):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path(name))
    tool = tokens.ChunkTokenizer(P.path(name), kind, 7, max_chunks=500)
    for part in (texts(800), texts(801), all_planes(1500)):
        ids, bounds = tool.encode([*part, None])
        counts = tool.counts([*part, None])
        for i, text in enumerate([*part, ""]):
            want = whole.encode(text, add_special_tokens=False).ids
            assert ids[bounds[i]:bounds[i + 1]].tolist() == want + [7], text
            assert counts[i] == len(want)


def test_kept_chunks_are_bounded_in_characters():
    tool = tokens.ChunkTokenizer(P.path("byte_bpe_50k.json"), "bytes", 0, max_chars=1000)
    for i in range(50):
        tool.encode([f"{i}" * 100])
        assert tool.n_chars < 1400


def frames(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "frame_idx long, composite string, start string")


ROWS = [(5, "the cat. " * 300), (2, None), (3, ""), (9, "a b"), (9, "a b"), (7, "long " * 30_000), (None, "none"), (1, "x y z")]


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    folder = str(tmp_path / "tokens")
    manifest = token_files.write_token_files(frames(spark, ROWS), folder, P.path("word_bpe_49k.json"), "words", 1, 64)
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r["start"])
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for row, (ident, text) in zip(got, rows, strict=True):
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert tuple(row) == (ident, at, len(ids), zlib.crc32(ids))
        at += len(ids)
    for part in manifest.collect():
        if not part["tokens"]:
            continue
        opened = token_files.TokenFile(part["file"])
        last = -(-part["tokens"] // 64) - 1
        ids, mask = opened.sequence(last)
        assert len(ids) == 64 and sum(mask.to_pylist()) == part["tokens"] - 64 * last
        assert not ids.flags.owndata and not ids.flags.writeable


def test_token_files_of_nothing(spark):
    assert token_files.tokenised_frames(frames(spark, []), P.path("word_bpe_49k.json"), "words", 1).count() == 0


def best_cost(ends, penalty, length):
    at, cost = [0, *ends], [0.0]
    for j in range(1, len(at)):
        options = []
        for i in range(j):
            size = at[j] - at[i]
            if size <= length:
                power = size & (size - 1) == 0 and size >= min(packing.LEAST_POWER, length)
                options.append(cost[i] + (0 if power else length - size) + penalty[j - 1] + packing.WINDOW_COST)
        cost.append(min(options))
    return cost[-1]


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_the_best_ones(seed):
    rng = random.Random(seed)
    length = 128
    ends = np.cumsum([rng.randrange(1, 60) for _ in range(80)])
    penalty = np.array([rng.choice([0.0, 3.0, 24.0]) for _ in ends])
    cuts = packing.cut_windows(ends, penalty, length)
    assert cuts[-1] == ends[-1] and set(cuts) <= set(ends.tolist())
    of = dict(zip(ends.tolist(), penalty.tolist()))
    total = 0.0
    for a, b in zip([0, *cuts], cuts):
        size = b - a
        assert size <= length
        total += (0 if size & (size - 1) == 0 and size >= packing.LEAST_POWER else length - size) + of[b] + packing.WINDOW_COST
    assert total == pytest.approx(best_cost(ends.tolist(), penalty.tolist(), length))


def test_packing_covers_every_id_once(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "RUN_TOKENS", 2000)
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = packing.pack_frames(frames(spark, ROWS), P.path("byte_bpe_50k.json"), "bytes", 0).toPandas()
    for ident, text in dict(ROWS).items():
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        mine = got[got.frame_idx.isna()] if ident is None else got[got.frame_idx == ident]
        pieces = sorted({(r.start, r.length, r.ids_crc32) for r in mine.itertuples()})
        assert (mine.frame_tokens == len(ids)).all() and sum(mine.length) == len(ids) * sum(1 for r in ROWS if r[0] == ident)
        assert all(zlib.crc32(ids[a:a + n]) == crc for a, n, crc in pieces)
    for _, one in got.sort_values("offset").groupby("sequence_id"):
        assert one.offset.tolist() == [0, *np.cumsum(one.length).tolist()[:-1]] and one.length.sum() <= 1024
    assert packing.pack_frames(frames(spark, []), P.path("byte_bpe_50k.json"), "bytes", 0).count() == 0


def test_pieces_equal_the_library(spark):
    model = P.path("piece_bpe_32k.model")
    codec = piece_codec.PieceCodec(model, max_words=2000)
    rng = random.Random(2)
    some = [*TRICKY, "▁x", "a▁▁b", "\x00a", "a\x00\x00b \x00", "abcabcabd" * 100, "<s> </s> <unk> <0x41> 😀"]
    some += ["".join(rng.choice("abcdeth in'.,\n\té😀1  ") for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    some += ["".join(rng.choice("thenio") for _ in range(rng.randrange(30, 200))) for _ in range(60)]
    ids, bounds = codec.encode([*some, None])
    for i, text in enumerate([*some, ""]):
        mine = ids[bounds[i]:bounds[i + 1]].tolist()
        assert mine == codec.model.encode(text), text
        if "▁" not in text:
            assert codec.decode(mine) == text
    encoded = piece_codec.encode_frames(frames(spark, ROWS), model)
    back = {r["frame_idx"]: r["composite"] for r in piece_codec.decode_frames(encoded, model).collect()}
    assert back == {i: t or "" for i, t in ROWS}
    assert piece_codec.encode_frames(frames(spark, []), model).count() == 0


def test_suffixes_are_sorted():
    text = np.array([ord(c) for c in "mississippi banana mississippi"])
    order = piece_codec.suffix_order(text, 16).tolist()
    cut = ["mississippi banana mississippi"[i:i + 16] for i in order]
    assert cut == sorted(cut) and sorted(order) == list(range(len(text)))
