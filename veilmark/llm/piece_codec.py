"""SentencePiece encoding by suffix-array matching, and decoding.

The distinct words of a batch are joined into texts of about INDEX_CHARS and their suffixes sorted; every piece of the vocabulary is
looked up by binary search and gives an edge at each place of its range. The edges, sorted by place, are then
relaxed. The vocabulary is a merge vocabulary: its scores are merge ranks, so an edge is taken when both its parts
stand side by side and no better edge does, the leftmost of equals first. A shortest path over the same edges
would give other ids than the library.
"""

import heapq
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilmark.llm import words as W

SPACE = "▁"
MAX_WORDS = 700_000
LONG_WORD = 48
INDEX_CHARS = 600_000
_CODECS: dict[str, "PieceCodec"] = {}


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the text in the order of their first `depth` characters, by doubling the compared length."""
    symbols, rank = np.unique(text, return_inverse=True)
    n, bits = len(text), max(1, int(len(symbols)).bit_length())
    padded = np.concatenate([rank.astype(np.int64) + 1, np.zeros(64, np.int64)])
    width = min(62 // bits, depth)
    key = np.zeros(n, np.int64)
    for k in range(width):  # as many characters as a number holds
        key = (key << bits) | padded[k : k + n]
    while True:
        order = np.argsort(key)
        if width >= depth:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (np.diff(key[order]) != 0).astype(np.int64)]))
        later = np.zeros(n, np.int64)
        later[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + later
        width *= 2


class PieceCodec:
    """A merge vocabulary with byte fallback whose pieces hold the space mark only at their start."""

    def __init__(self, model_file: str, max_words: int = MAX_WORDS):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model_file)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        special = [self.model.is_control(i) or self.model.is_unknown(i) for i in range(len(names))]
        self.byte_id = np.zeros(256, np.int64)
        self.bytes_of: list[bytes] = []
        plain = []
        for i, name in enumerate(names):
            if self.model.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
                self.bytes_of.append(bytes([int(name[3:5], 16)]))
            elif special[i]:
                self.bytes_of.append(b"")
            else:
                plain.append(i)
                self.bytes_of.append(name.replace(SPACE, " ").encode())
        self.depth = max(len(names[i]) for i in plain)
        plain.sort(key=lambda i: names[i])
        self.ids = np.array(plain, np.int64)
        self.table = np.zeros((len(plain), self.depth), np.int64)  # pieces in code point order, 0 behind their end
        for row, i in enumerate(plain):
            self.table[row, : len(names[i])] = [ord(c) for c in names[i]]
        self.length = (self.table > 0).sum(axis=1)
        score = np.array([self.model.get_score(i) for i in plain])
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)  # 0 is merged first
        self.inner = SPACE in "".join(names[i].lstrip(SPACE) for i in plain)
        self.max_words = max_words
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n_words = self.n_ids = 0

    def words(self, text: str) -> list[str]:
        """Keys of the parts of a text that no piece crosses. A key is a word, which one space mark precedes, or a
        blank and the part as it is.
        """
        if self.inner:
            return [" " + SPACE + text.replace(" ", SPACE)] if text else []
        if not text:
            return []
        parts = text.split(" ")
        if SPACE not in text:
            if "" not in parts:
                return parts
        else:
            parts = text.replace(" ", SPACE).split(SPACE)
        out, lead = [], 0
        for part in parts:
            lead += 1
            if part:
                out.append(part if lead == 1 else " " + SPACE * lead + part)
                lead = 0
        if lead:
            out.append(" " + SPACE * lead)
        return out

    @staticmethod
    def _part(key: str) -> str:
        return key[1:] if key[:1] == " " else SPACE + key

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every place where a piece occurs: place and row of the piece, sorted by place, then length."""
        order = suffix_order(text, self.depth)
        padded = np.concatenate([text, np.zeros(self.depth, text.dtype)])
        reach = np.arange(self.depth)
        low, high = self._search(padded, order, reach, False), self._search(padded, order, reach, True)
        size = high - low
        row = np.repeat(np.arange(len(low), dtype=np.int32), size)
        place = order[np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        sort = np.argsort(place * (self.depth + 1) + self.length[row])
        return place[sort], row[sort]

    def _search(self, padded: np.ndarray, order: np.ndarray, reach: np.ndarray, behind: bool) -> np.ndarray:
        """For each piece, the first suffix that is not below it, or (behind) the first above all it begins."""
        a, b = np.zeros(len(self.table), np.int64), np.full(len(self.table), len(order), np.int64)
        while (open_ := np.flatnonzero(a < b)).size:
            mid = (a[open_] + b[open_]) >> 1
            there, piece = padded[order[mid][:, None] + reach], self.table[open_]
            there = np.where(piece > 0, there, 0)
            differs = there != piece
            at = differs.argmax(axis=1)
            rows = np.arange(len(open_))
            less = there[rows, at] < piece[rows, at] if not behind else there[rows, at] <= piece[rows, at]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
        return a

    def _encode_words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and the number of each."""
        joined = "\x00".join(new)
        text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.array([len(w) for w in new], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        place, row = self.edges(np.where(text == 0, -1, text))
        table = np.full((self.depth + 1, len(text) + 1), -1, np.int32)  # the edge of each length at each place
        table[self.length[row], place] = row
        inside = np.ones(len(text), bool)
        inside[(starts + lengths)[:-1]] = False
        word = np.repeat(np.arange(len(new)), lengths)
        symbols = self._relax(table, np.flatnonzero(inside), word, starts, lengths)
        first, size, word = symbols
        piece = np.where(size <= self.depth, table[np.minimum(size, self.depth), first], -1)
        ids = np.where(piece >= 0, self.ids[piece], -1)
        unknown = np.flatnonzero(ids < 0)
        if not len(unknown):
            return ids, np.bincount(word, minlength=len(new))
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in text[first[unknown]].tolist()]
        times = np.ones(len(ids), np.int64)
        times[unknown] = [len(s) for s in spelled]
        out = np.repeat(ids, times)
        out[np.repeat(ids < 0, times)] = self.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
        return out, np.bincount(np.repeat(word, times), minlength=len(new))

    def _relax(self, table: np.ndarray, first: np.ndarray, word: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Symbols (place, size, word) when no edge joins two neighbours any more; best rank first, then leftmost."""
        long = np.flatnonzero(lengths > LONG_WORD)
        done = []
        if len(long):
            slow = np.isin(word, long)
            for w in long.tolist():
                done.append(self._relax_long(table, int(starts[w]), int(lengths[w]), w))
            first, word = first[~slow], word[~slow]
        size = np.ones(len(first), np.int64)
        while len(first):
            whole = size[:-1] + size[1:]
            fits = (word[:-1] == word[1:]) & (whole <= self.depth)
            row = np.full(len(whole), -1, np.int64)
            row[fits] = table[whole[fits], first[:-1][fits]]
            able = np.flatnonzero(row >= 0)
            if not len(able):
                break
            owner = word[able]
            key = self.rank[row[able]] * np.int64(LONG_WORD + 1) + (first[able] - starts[owner])
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(key, heads)
            chosen = able[key == np.repeat(best, np.diff(np.concatenate([heads, [len(key)]])))]
            size[chosen] += size[chosen + 1]
            stay = np.ones(len(first), bool)
            stay[chosen + 1] = False
            moving = np.zeros(len(starts), bool)
            moving[owner] = True
            still = moving[word]
            rest = stay & ~still
            done.append((first[rest], size[rest], word[rest]))
            go = stay & still
            first, size, word = first[go], size[go], word[go]
        done.append((first, size, word))
        first, size, word = (np.concatenate([d[k] for d in done]) for k in range(3))
        sort = np.argsort(first)
        return first[sort], size[sort], word[sort]

    def _relax_long(self, table: np.ndarray, start: int, length: int, w: int):
        """The same for one long word, with a heap."""
        size = [1] * length
        after, before = list(range(1, length + 1)), list(range(-1, length - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < length and size[i] + size[j] <= self.depth:
                row = int(table[size[i] + size[j], start + i])
                if row >= 0:
                    heapq.heappush(heap, (int(self.rank[row]), i, size[i], size[j]))

        for i in range(length):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if size[i] != left or j >= length or size[j] != right:
                continue
            size[i], size[j] = left + right, 0
            after[i] = after[j]
            if after[i] < length:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        kept = np.flatnonzero(np.array(size) > 0)
        return start + kept, np.array(size, np.int64)[kept], np.full(len(kept), w, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the bounds of each (len(texts) + 1); null counts as empty."""
        if self.n_words > self.max_words:
            self._clear()
        keys: list[str] = []
        ends = [0]
        for text in texts:
            keys += self.words(text or "")
            ends.append(len(keys))
        number = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new = list(dict.fromkeys(keys[i] for i in missing.tolist()))
            group, held = [], 0
            for key in new:
                if "\x00" in key:
                    self._keep([key])
                    continue
                group.append(key)
                held += len(key)
                if held >= INDEX_CHARS:
                    self._keep(group)
                    group, held = [], 0
            if group:
                self._keep(group)
            number = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        count = self.count[number]
        total = np.concatenate([[0], np.cumsum(count)])
        return self.flat[np.repeat(self.first[number] - total[:-1], count) + np.arange(total[-1])], total[np.array(ends)]

    def _keep(self, group: list[str]) -> None:
        if len(group) == 1 and "\x00" in group[0]:  # the joining mark itself: spell it, encode around it
            parts = [self._encode_words([p])[0] if p else np.zeros(0, np.int64) for p in self._part(group[0]).split("\x00")]
            ids = np.concatenate([x for p in parts for x in (np.array([self.byte_id[0]]), p)][1:])
            counts = np.array([len(ids)])
        else:
            ids, counts = self._encode_words([self._part(k) for k in group])
        while self.n_ids + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n_words + len(group) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.flat[self.n_ids : self.n_ids + len(ids)] = ids
        here = slice(self.n_words, self.n_words + len(group))
        self.count[here] = counts
        self.first[here] = self.n_ids + np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.known.update(zip(group, range(self.n_words, self.n_words + len(group))))
        self.n_words += len(group)
        self.n_ids += len(ids)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: spaces for space marks, without the one in front; broken byte runs become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def codec(model_file: str) -> PieceCodec:
    """One codec for each worker process, with the words it knows."""
    if model_file not in _CODECS:
        _CODECS[model_file] = PieceCodec(model_file)
    return _CODECS[model_file]


def encode_frames(frames: DataFrame, model_file: str, decoded: bool = False) -> DataFrame:
    """Encode every whole text: frame_idx, ids (array of int), n_pieces, ids_crc32.

    decoded: instead of ids, return text_crc32, the CRC-32 of the UTF-8 text that decoding the ids gives back.

    frames: frame_idx (long), composite; other columns are ignored. Null and empty texts give no ids. Rows are neither
    dropped nor merged. Ids are those of the library for the same model; ids_crc32 is the CRC-32 of the ids as little-endian
    unsigned 32-bit integers.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model_file)
        for whole in batches:
            for batch in W.slices(whole, "composite"):
                ids, bounds = tool.encode(batch.column("composite").to_pylist())
                body = memoryview(ids.astype("<u4").tobytes())
                if decoded:
                    texts = (tool.decode(ids[a:b].tolist()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))
                    shown = {"text_crc32": pa.array([zlib.crc32(text.encode()) for text in texts], pa.int64())}
                else:
                    shown = {"ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))}
                yield pa.record_batch({
                    "frame_idx": batch.column("frame_idx"), **shown,
                    "n_pieces": pa.array(np.diff(bounds), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.int64()),
                })

    return frames.selectExpr("CAST(frame_idx AS LONG) AS frame_idx", "composite").mapInArrow(
        encode, f"frame_idx long, {'text_crc32 long' if decoded else 'ids array<int>'}, n_pieces long, ids_crc32 long"
    )


def decode_frames(encoded: DataFrame, model_file: str) -> DataFrame:
    """The texts of ids: frame_idx, composite. Null ids give null; control and unknown ids give nothing.

    encoded: frame_idx (long), ids; the other columns stay.
    """
    kept = [c for c in encoded.columns if c not in ("ids", "composite")]
    base = encoded.select(*[f"`{c}`" for c in kept], "ids")
    from pyspark.sql import types as T

    schema = T.StructType([*base.drop("ids").schema.fields, T.StructField("composite", T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model_file)
        for batch in batches:
            texts = [None if ids is None else tool.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string())], names=[*kept, "composite"])

    return base.mapInArrow(decode, schema)
