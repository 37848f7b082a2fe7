"""Token ids of whole texts by the tokenizers library, which sees each distinct chunk of a text once.

A text is cut where the tokenizer never joins tokens, the chunks are encoded by the library (plain words by its
model at once) and kept, and the ids of a text are put together from them. A cut is made
  * for word vocabularies (white space dropped before encoding) at blanks and line feeds,
  * for byte-level vocabularies (a blank belongs to the word behind it) before a blank that stands before a
    character other than white space, and around a line feed that stands between such characters.
Strings of special tokens are cut out first, as the library does, and are their tokens. Ids are the same as for the
whole text by the library's defaults (tested).
"""

import gc
import os
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np

MAX_CHUNKS = 1_400_000
MAX_KEY_CHARS = 24_000_000
_RUN = re.compile(r"\s\s")
_BOUNDARY = re.compile(r" (?=\S)")
_STOPS = frozenset(".,")
# Letters that no normaliser turns into more than a letter, and that all Unicode versions know as letters.
_LETTERS = frozenset(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1)
# Byte-level vocabularies write each byte as a character: printable Latin-1 as itself, the others from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_TOOLS: dict[tuple, "ChunkTokenizer"] = {}


@contextmanager
def _no_collection() -> Iterator[None]:
    """Pause the search for reference cycles: millions of small lists are made here, none in a cycle."""
    was_on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was_on:
            gc.enable()


class _Numbered(dict):
    """Numbers of keys in the order in which they are first asked for; `new` lists those whose ids are still to be found."""

    def __init__(self) -> None:
        self[None] = 0  # the end of a text
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        return number


class ChunkTokenizer:
    """kind: words or bytes. About `max_chunks` chunks of `max_chars` characters are kept at most; then it starts afresh."""

    def __init__(self, path: str, kind: str, end_id: int, max_chunks: int = MAX_CHUNKS, max_chars: int = MAX_KEY_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.end_id, self.max_chunks, self.max_chars = end_id, max_chunks, max_chars
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        self.special_ids = {t.content: k for k, t in added.items()}
        longest_first = sorted(self.special_ids, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.openers = {t[:2] for t in longest_first}  # a cheap look before the search
        self.split = {"words": self._words, "bytes": self._bytes}[kind]
        self.text_of = {"words": lambda key: key, "bytes": self._text}[kind]
        self.pretoken = {"words": self._lower_word, "bytes": self._byte_word}[kind]
        self.lead = {"words": "", "bytes": " "}[kind]  # before the key of a chunk that has no blank in front
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbered()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 15, np.int64)
        self.count = np.zeros(1 << 15, np.int64)
        self.n_ids, self.n_chars = 0, 0
        numbers = [0, *(self.known[t] for t in self.special_ids)]
        self._put(numbers, np.array([self.end_id, *self.special_ids.values()], np.uint32), np.ones(len(numbers), np.int64))
        self.known.new.clear()

    def _keys(self, text: str) -> list[str]:
        """The chunks of a text; special strings are chunks, and what stands between them is cut as texts are."""
        if not any(o in text for o in self.openers) or not self.special.search(text):
            return self.split(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                out.append(part)
            elif part:
                out += self.split(part)
        return out

    @staticmethod
    def _words(text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    @staticmethod
    def _bytes(text: str) -> list[str]:
        """Keys of the chunks: a leading blank marks a chunk without one, others have one; a line feed is itself."""
        if _RUN.search(text):
            chunks = _BOUNDARY.split(text)
            chunks[0] = " " + chunks[0]
            return chunks
        out: list[str] = []
        for line in text.split("\n"):
            out.append("\n")
            chunks = line.split(" ")
            chunks[0] = " " + chunks[0]
            out += chunks
        return out[1:]

    @staticmethod
    def _lower_word(key: str) -> str | None:
        """What the library's model gets for a chunk of Latin letters alone: in lower case, as byte characters."""
        if key.isascii():
            return key.lower() if key.isalpha() else None
        return key.lower().encode().decode("latin-1").translate(_BYTE_CHARS) if key.isalpha() and max(key) < "\u0100" else None

    @staticmethod
    def _byte_word(key: str) -> str | None:
        """The same with letter case, and with the mark of the blank in front."""
        word, lead = (key[1:], "") if key[:1] == " " else (key, "Ġ")
        if word.isascii():
            return lead + word if word.isalpha() else None
        return lead + word.encode().decode("latin-1").translate(_BYTE_CHARS) if word.isalpha() else None

    @staticmethod
    def _text(key: str) -> str:
        return key[1:] if key[:1] == " " else key if key == "\n" else " " + key

    def _learn(self) -> None:
        """Encode new chunks. A letter and a stop or comma behind it are never joined: such a chunk is its two parts."""
        known, new = self.known, self.known.new
        first = len(known) - len(new)
        bare, numbers, ended, parts = [], [], [], []
        for k in new:  # the parts of chunks are appended on the way
            if k[-1:] in _STOPS and k[-2:-1] in _LETTERS:
                ended.append(first)
                parts += (known[k[:-1]], known[self.lead + k[-1]])
            else:
                bare.append(k)
                numbers.append(first)
            first += 1
        self.n_chars += sum(map(len, new))
        new.clear()
        names = [self.pretoken(k) for k in bare]
        tokenize = self.tokenizer.model.tokenize
        lists = [[t.id for t in tokenize(name)] for name in names if name]
        self._put([n for n, name in zip(numbers, names) if name], np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists)))
        rest = [(n, k) for n, k, name in zip(numbers, bare, names) if not name]
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            lists = [g.ids for g in self.tokenizer.encode_batch_fast([self.text_of(k) for _, k in some], add_special_tokens=False)]
            self._put([n for n, _ in some], np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists)))
        if ended:
            both = np.array(parts, np.int64)
            self._put(ended, self._gather(both), self.count[both].reshape(-1, 2).sum(axis=1))

    def _put(self, numbers: list[int], ids: np.ndarray, counts: np.ndarray) -> None:
        """Keep the ids of the chunks with these numbers."""
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.known) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        here = np.array(numbers, np.int64)
        self.count[here] = counts
        self.first[here] = self.n_ids + np.cumsum(counts) - counts
        self.n_ids += len(ids)

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        count = self.count[numbers]
        before = np.concatenate([[0], np.cumsum(count)])
        return self.ids[np.repeat(self.first[numbers] - before[:-1], count) + np.arange(before[-1])]

    def _numbers(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the chunks of all texts, 0 behind each text, and the bounds of each text."""
        if len(self.known) > self.max_chunks or self.n_chars > self.max_chars:
            self._clear()
        keys: list[str | None] = []
        ends = [0]
        with _no_collection():
            for text in texts:
                if text:
                    keys += self._keys(text)
                keys.append(None)
                ends.append(len(keys))
            number = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
            if self.known.new:
                self._learn()
        return number, np.array(ends)

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind it, and the bounds of each text (len(texts) + 1)."""
        number, ends = self._numbers(texts)
        total = np.concatenate([[0], np.cumsum(self.count[number])])
        return self._gather(number), total[ends]

    def counts(self, texts: Iterable[str | None]) -> np.ndarray:
        """The number of ids of each text, without the end id."""
        number, ends = self._numbers(texts)
        total = np.concatenate([[0], np.cumsum(self.count[number])])
        return np.diff(total[ends]) - 1


def tool(path: str, kind: str, end_id: int) -> ChunkTokenizer:
    """One tokenizer for each worker process, with the chunks it knows."""
    key = (path, kind, end_id)
    if key not in _TOOLS:
        _TOOLS[key] = ChunkTokenizer(*key)
    return _TOOLS[key]
