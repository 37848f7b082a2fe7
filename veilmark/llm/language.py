"""Language of a text by compression: the language whose raw-content Zstandard dictionary compresses it best."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.llm import words as W

DICTIONARY_BYTES = 112 << 10
SAMPLE_FRAMES = 400
MIN_MARGIN = 0.005
LEVEL = 6
BLOCK_BYTES = 16 << 10
PIECE_CHARS = 128


def _limit(sizes: list[int], room: int) -> int:
    """Greatest share of a text such that all shares fit into room: what short texts leave goes to longer ones."""
    for i, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - i) >= room:
            return room // (len(sizes) - i)
        room -= size
    return max(sizes)


def _spread(text: str, length: int) -> str:
    """`length` characters of a text: pieces of about PIECE_CHARS at even distances from its start to its end."""
    if length >= len(text):
        return text
    n = max(1, length // PIECE_CHARS)
    length -= n - 1  # the line feeds between pieces
    cuts = [length * i // n for i in range(n + 1)]
    gap = len(text) - length
    starts = [cuts[i] + (gap * i // (n - 1) if n > 1 else gap // 2) for i in range(n)]
    return "\n".join(text[at : at + b - a] for at, a, b in zip(starts, cuts, cuts[1:]))


def learn_languages(
    frames: DataFrame, dictionary_bytes: int = DICTIONARY_BYTES, sample_frames: int = SAMPLE_FRAMES
) -> dict[str, bytes]:
    """A raw-content dictionary for each language: frame texts, one after another, up to a size.

    frames: frame_idx, composite, lang. Of each language at most `sample_frames` frames are taken, by a hash of
    frame_idx. Texts that fit together are taken whole. Otherwise each gives at most an equal share, in pieces from
    its whole length, and what short texts leave of theirs goes to longer ones, so that one very long text does not
    fill the dictionary. Null languages and texts are left out. The result is `dictionary_bytes` a language at most.
    """
    known = frames.where("lang IS NOT NULL AND frame_idx IS NOT NULL AND composite IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("frame_idx"), "frame_idx"))
    chosen = known.select("frame_idx", "lang").withColumn("rank", rank).where(F.col("rank") <= sample_frames)
    sample = known.select("frame_idx", "lang", "composite").join(
        F.broadcast(chosen), ["frame_idx", "lang"]  # sample_frames rows a language at most
    )
    sizes: dict[str, list[int]] = {}
    for row in sample.select("lang", (F.octet_length("composite") + 1).alias("size")).collect():  # a number a chosen frame
        sizes.setdefault(row["lang"], []).append(row["size"])
    limits = {lang: _limit(each, dictionary_bytes) for lang, each in sizes.items()}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("composite").to_pylist()):
                size = len(text.encode()) + 1
                cut.append(_spread(text, len(text) * min(size, limits[lang]) // size))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), pa.array(cut, pa.string())], names=["lang", "rank", "piece"])

    rows = sample.select("lang", "rank", "composite").mapInArrow(pieces, "lang string, rank int, piece string").collect()
    out: dict[str, bytes] = {}  # the pieces make about dictionary_bytes a language
    for row in sorted(rows, key=lambda r: (r["lang"], -r["rank"], r["piece"])):
        out[row["lang"]] = out.get(row["lang"], b"") + row["piece"].lower().encode() + b"\n"
    return {lang: body[-dictionary_bytes:] for lang, body in out.items()}


class Compressors:
    """One compressor for each language, in name order."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.names = sorted(dictionaries)
        self.each = []
        for name in self.names:
            raw = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            self.each.append(zstandard.ZstdCompressor(dict_data=raw, level=level, write_content_size=False, write_checksum=False))

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes for each language: equal blocks of at most BLOCK_BYTES, each from the fresh dictionary.

        A dictionary saves bytes near the start of what it compresses, so in one piece its saving would fade with the length.
        """
        body = memoryview(text.lower().encode())
        n = max(1, -(-len(body) // BLOCK_BYTES))
        cuts = [len(body) * i // n for i in range(n + 1)]
        return [sum(len(c.compress(body[a:b])) for a, b in zip(cuts, cuts[1:])) for c in self.each]


def has_letter(text: str | None) -> bool:
    return text is not None and next(filter(str.isalpha, text), None) is not None


def recognise_languages(frames: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """Add lang_pred, score and narrow to every frame.

    frames: frame_idx, composite, any other columns; columns of the three added names are replaced. The language
    with the smallest compressed whole text, block by block and in lower case, wins; of equal ones the first by name. score is the chance that the
    size differences in bits give it, from 1 / languages to 1. narrow marks texts whose best and second size differ by less
    than `min_margin` of the best. A text that is null or has no letter is `und`, score 0 and narrow, as is every
    text when no language was learned. Rows are neither dropped nor merged.
    """
    added = ["lang_pred", "score", "narrow"]
    base = frames.select(*[F.col(f"`{c}`") for c in frames.columns if c not in added])
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("narrow", T.BooleanType())])
    shared = base.sparkSession.sparkContext.broadcast(dictionaries)  # DICTIONARY_BYTES a language

    def recognise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Compressors(shared.value)
        for whole in batches:
            for batch in W.slices(whole, "composite"):
                names, chances, narrow = [], [], []
                for text in batch.column("composite").to_pylist():
                    if not tool.names or not has_letter(text):
                        names.append("und")
                        chances.append(0.0)
                        narrow.append(True)
                        continue
                    sizes = np.array(tool.sizes(text), dtype=np.int64)
                    best = int(sizes.argmin())
                    others = np.delete(sizes, best)
                    names.append(tool.names[best])
                    chances.append(float(1.0 / np.exp2(-8.0 * np.minimum(sizes - sizes[best], 100)).sum()))
                    narrow.append(bool(len(others)) and bool(others.min() - sizes[best] < min_margin * sizes[best]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(names, pa.string()), pa.array(chances, pa.float64()), pa.array(narrow, pa.bool_())],
                    names=[*batch.schema.names, *added],
                )

    return base.mapInArrow(recognise, schema)
