"""Exact token counts of whole frame texts; huge texts are counted in overlapping chunks that are spliced again.

A chunk of a huge text is encoded with offsets. Where two neighbouring chunks both start a word at the same place of
their overlap, the tokens before it are taken from the first and those behind it from the second. Such a place is
proven: the word pattern of a byte-level vocabulary never looks behind the start of a word and only MARGIN characters
ahead, so from a common word start on both encodings go on alike, and the same as that of the whole text. A text
with a pair of chunks that have no such place is cut anew with chunks and overlaps WIDEN times as wide, at last as one
chunk.
"""

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.llm import tokens
from veilmark.llm import words as W
from veilmark.plans.session import settle

FRAME = ["video_id", "frame_idx"]
LIMIT_TOKENS = 1024
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
WIDEN = 4
MARGIN = 8
_TOOLS: dict[str, "Counter"] = {}


class Counter:
    """The library's tokenizer of a vocabulary file, with its own defaults, and whether its texts may be cut."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        steps = self.tokenizer.pre_tokenizer
        plain = type(steps).__name__ == "ByteLevel" and not steps.add_prefix_space and getattr(steps, "use_regex", True)
        self.cuttable = bool(plain) and self.tokenizer.normalizer is None and not any(t.lstrip or t.rstrip or t.single_word for t in added)
        self.margin = MARGIN + max([0, *(len(t.content) for t in added)])

        self.chunks = tokens.ChunkTokenizer(path, "bytes", 0) if self.cuttable else None

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts; of byte-level vocabularies each distinct chunk is encoded once."""
        if self.chunks:
            return self.chunks.counts(texts).tolist()
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word_starts(self, text: str) -> tuple[list[tuple[int, int]], int]:
        """(place, tokens before it) of each word of a text, and the number of all its tokens."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        starts, before = [], None
        for i, (word, (at, _)) in enumerate(zip(found.word_ids, found.offsets)):
            if word != before:
                starts.append((at, i))
                before = word
        return starts, len(found)


def counter(path: str) -> Counter:
    if path not in _TOOLS:
        _TOOLS[path] = Counter(path)
    return _TOOLS[path]


def _short_counts(frames: DataFrame, vocabulary: str, chunk: int) -> DataFrame:
    """n_tokens of texts of one chunk; longer ones keep their text and get a text_key for the later steps."""
    names = [*FRAME, "n_bytes"]
    schema = T.StructType([*frames.select(*names).schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("text_key", T.StringType()), T.StructField("composite", T.StringType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(vocabulary)
        for whole in batches:
            for batch in W.slices(whole, "composite"):
                texts = [t or "" for t in batch.column("composite").to_pylist()]
                long = [tool.cuttable and len(t) > chunk for t in texts]
                n = iter(tool.counts([t for t, x in zip(texts, long) if not x]))
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c) for c in names], pa.array([None if x else next(n) for x in long], pa.int64()),
                    pa.array([uuid.uuid4().hex if x else None for x in long], pa.string()),
                    pa.array([t if x else None for t, x in zip(texts, long)], pa.string()),
                ], names=[*names, "n_tokens", "text_key", "composite"])

    return frames.mapInArrow(count, schema)


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks of each text: they start every `chunk` characters and reach `overlap` beyond the next start."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("text_key").to_pylist(), batch.column("composite").to_pylist()):
                n = max(1, -(-(len(text) - overlap) // chunk))
                for a in range(0, n, 64):  # a batch of chunks at a time
                    some = range(a, min(n, a + 64))
                    yield pa.record_batch({
                        "text_key": pa.array([key] * len(some)), "chunk": pa.array(list(some), pa.int64()),
                        "is_last": pa.array([k == n - 1 for k in some]),
                        "body": pa.array([text[k * chunk : (k + 1) * chunk + overlap] for k in some]),
                    })

    return texts.mapInArrow(cut, "text_key string, chunk long, is_last boolean, body string")


def _encoded(chunks: DataFrame, vocabulary: str, chunk: int, overlap: int) -> DataFrame:
    """Word starts in both overlaps of each chunk, as places in the text, with the tokens before them; n: its tokens."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(vocabulary)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("head", "head_before", "tail", "tail_before", "n")}
            for k, body in zip(batch.column("chunk").to_pylist(), batch.column("body").to_pylist()):
                starts, n = tool.word_starts(body)
                head = [(at, before) for at, before in starts if at <= overlap]
                tail = [(at, before) for at, before in starts if chunk <= at <= len(body) - tool.margin]
                for name, part in (("head", head), ("tail", tail)):
                    out[name].append([k * chunk + at for at, _ in part])
                    out[f"{name}_before"].append([before for _, before in part])
                out["n"].append(n)
            longs = {c: pa.array(v, pa.int64() if c == "n" else pa.list_(pa.int64())) for c, v in out.items()}
            yield pa.record_batch({c: batch.column(c) for c in ("text_key", "chunk", "is_last")} | longs)

    return chunks.mapInArrow(
        encode, "text_key string, chunk long, is_last boolean, head array<long>, head_before array<long>, "
        "tail array<long>, tail_before array<long>, n long"
    )


def _spliced(encoded: DataFrame) -> DataFrame:
    """n_tokens of each text out of its chunks, and the number of neighbours that share no word start (unmet)."""
    after = encoded.select("text_key", (F.col("chunk") - 1).alias("chunk"), F.col("head").alias("next"), F.col("head_before").alias("next_before"))
    pairs = encoded.join(after, ["text_key", "chunk"], "left").withColumn("place", F.array_min(F.array_intersect("tail", "next")))
    tokens = lambda at, before: F.element_at(before, F.array_position(at, F.col("place")).cast("int"))
    mine = F.when(F.col("is_last"), F.col("n")).when(F.col("place").isNotNull(), tokens("tail", "tail_before") - tokens("next", "next_before"))
    return pairs.groupBy("text_key").agg(F.sum(mine).alias("n_tokens"), F.count(F.when(mine.isNull(), 1)).alias("unmet"))


def frame_token_counts(
    frames: DataFrame, vocabulary: str, limit: int = LIMIT_TOKENS, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> DataFrame:
    """Number of tokens of each frame's whole text.

    frames: video_id, frame_idx (any types), composite. Returns one row per row of frames: video_id, frame_idx,
    n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens). vocabulary: a tokenizers file. Counts equal
    len(Tokenizer.encode(text, add_special_tokens=False)) with the library's defaults, so a special string inside a
    text is its token. A null text counts as empty: 0 bytes, 0 tokens. Rows may repeat and their keys may be null;
    other columns are ignored.

    Texts of at most `chunk` characters are encoded at once. Longer ones are cut, their chunks dealt over all tasks
    and spliced (see the module); overlap must be less than half a chunk. Vocabularies with a normaliser, another
    pre-tokenizer or added tokens that look at their surroundings have no such proof: their texts are never cut.
    """
    if not 0 < 2 * overlap < chunk:
        raise ValueError("overlap must be positive and less than half a chunk")
    base = frames.select(*FRAME, "composite", F.coalesce(F.octet_length("composite"), F.lit(0)).cast("long").alias("n_bytes"))
    first = settle(_short_counts(base, vocabulary, chunk))
    texts = first.where("text_key IS NOT NULL").select("text_key", "composite")
    spliced = []
    while not texts.isEmpty():
        dealt = _chunks(texts, chunk, overlap).repartition("text_key", "chunk")
        found = settle(_spliced(settle(_encoded(dealt, vocabulary, chunk, overlap))))
        spliced.append(found.where("unmet = 0").select("text_key", F.col("n_tokens").alias("spliced")))
        texts = texts.join(found.where("unmet > 0"), "text_key", "left_semi")
        chunk, overlap = WIDEN * chunk, WIDEN * overlap
    counted = first.drop("composite").withColumn("spliced", F.lit(None).cast("long"))
    if spliced:
        known = spliced[0]
        for more in spliced[1:]:
            known = known.union(more)
        counted = first.drop("composite").join(known, "text_key", "left")
    n = F.coalesce("n_tokens", "spliced")
    return counted.select(*FRAME, "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
