"""Word boundaries, word hashes and shingles of whole texts, vectorised over an Arrow batch.

A word is a longest run of bytes other than blank and U+0009 to U+000D; A-Z count as a-z. Hashes have 64 bits
and do not depend on where a word stands, so equal words are equal in every batch, task and run.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(977).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about `limit` bytes of text, one row at least."""
    sizes = pa.compute.binary_length(batch.column(name)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _cuts(space: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Block ends: a text's end, or white space inside a text longer than a block."""
    cuts, at, size = [0], 0, len(space)
    while at < size:
        end = min(size, at + BLOCK_BYTES)
        if end < size:
            text_end = int(offsets[np.searchsorted(offsets, end)])
            probe = end
            while probe < text_end and not space[probe : probe + 65536].any():
                probe += 65536
            end = min(text_end, probe + int(space[probe : probe + 65536].argmax())) if probe < text_end else text_end
        cuts.append(end)
        at = end
    return cuts


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word, and the word bounds of each text (len(texts) + 1)."""
    space = _SPACE[data]
    hashes, firsts, ends = [], [], []
    cuts = _cuts(space, offsets)
    for a, b in zip(cuts, cuts[1:]):
        gap = space[a:b]
        inside = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        opens = ~gap
        opens[1:] &= gap[:-1]
        inside = inside[(inside >= 0) & (inside < b - a)]
        opens[inside] = ~gap[inside]
        first = np.flatnonzero(opens)
        closes = ~gap
        closes[:-1] &= gap[1:]
        before = inside[inside > 0] - 1
        closes[before] = ~gap[before]
        end = np.flatnonzero(closes) + 1
        powers = np.full(b - a + 1, _MULTIPLIER)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[LOWER[data[a:b]]] * powers[:-1], out=sums[1:])
        powers[:] = _INVERSE
        powers[0] = 1
        np.cumprod(powers, out=powers)
        value = (sums[end] - sums[first]) * powers[first]
        hashes.append(mix(value + (end - first).astype(np.uint64)))
        firsts.append(first + a)
        ends.append(end + a)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    first = np.concatenate(firsts)
    return np.concatenate(hashes), first, np.concatenate(ends), np.searchsorted(first, offsets)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    value, _, _, bounds = words(*utf8(column))
    n = len(value)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        if n > k:
            rolled[: n - k] += value[k:] * _PLACES[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            short = (value[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + _PLACES[59 + b - a : 60 + b - a]
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
