import re

import pyarrow as pa

from veilmark.llm import words as W

TEXTS = ["a b  c", "", None, "Hello WORLD\tfoo", " x ", "é è averyveryverylongwordhere b", "b", "\x0b\x0c", "İ i"]


def test_words_are_found_and_equal_words_hash_equal(monkeypatch):
    for block in (7, 1 << 22):
        monkeypatch.setattr(W, "BLOCK_BYTES", block)
        value, _, _, bounds = W.words(*W.utf8(pa.array(TEXTS)))
        of, at = {}, 0
        for i, text in enumerate(TEXTS):
            found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
            assert bounds[i + 1] - bounds[i] == len(found)
            for word in found:
                word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
                assert of.setdefault(word, value[at]) == value[at]
                at += 1
        assert len(set(of.values())) == len(of)


def test_shingles_of_short_texts():
    sets = W.shingle_sets(pa.array(["a b c d e", "A b c d e f", "a b", "a b c", None, "a b"]), 5)
    assert [len(s) for s in sets] == [1, 2, 1, 1, 0, 1]
    assert sets[0][0] in sets[1] and sets[2][0] == sets[5][0] != sets[3][0]


def test_slices_keep_all_rows():
    batch = pa.record_batch({"t": ["aaaa", None, "b" * 50, "c"]})
    parts = list(W.slices(batch, "t", 10))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) > 1
