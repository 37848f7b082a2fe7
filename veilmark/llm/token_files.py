"""Token ids of frame texts in Arrow files: batches of fixed-size lists, so that any sequence and its mask is a view.

A file holds the ids of consecutive frames, cut into sequences of equal length whatever the frames' bounds; the last
sequence of a file is padded and masked. Beside it lies an index of its frames.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from veilmark.llm import files, tokens
from veilmark.llm import words as W
from veilmark.plans.session import settle, shared_folder

LENGTH = 1024
BATCH_SEQUENCES = 256


def _batch(ids: np.ndarray, used: int, length: int, kind: pa.DataType) -> pa.RecordBatch:
    mask = np.zeros(len(ids), bool)
    mask[:used] = True
    return pa.record_batch({
        "ids": pa.FixedSizeListArray.from_arrays(pa.array(ids, kind), length),
        "mask": pa.FixedSizeListArray.from_arrays(pa.array(mask), length),
    })


def write_token_files(
    frames: DataFrame, folder: str, tokenizer: str, kind: str, end_id: int, length: int = LENGTH
) -> DataFrame:
    """Encode whole texts and write them in ascending frame_idx order; returns part, file, index, frames, tokens.

    frames: frame_idx (long), composite; other columns are ignored. Null text counts as empty, so that a frame has
    at least the end id; a null frame_idx sorts first; repeated rows are written each. An empty table writes an empty
    file or none. `length` is a multiple of 8. Ids take 16 bits where the vocabulary allows, else 32. Files are moved
    in place when whole.
    """
    if length % 8:
        raise ValueError("length must be a multiple of 8")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tool = tokens.tool(tokenizer, kind, end_id)
        width = pa.uint16() if max(tool.size - 1, end_id) < 1 << 16 else pa.uint32()
        name, index = f"{folder}/part-{part:06d}.arrow", f"{folder}/part-{part:06d}.frames.arrow"
        full, done = length * BATCH_SEQUENCES, 0
        idents: list[pa.Array] = []
        starts: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def body(sink: pa.NativeFile) -> None:
            nonlocal done
            schema = pa.schema([("ids", pa.list_(width, length)), ("mask", pa.list_(pa.bool_(), length))])
            with pa.ipc.new_file(sink, schema) as out:
                rest = np.zeros(0, np.uint32)
                for whole in batches:
                    for batch in W.slices(whole, "composite"):
                        ids, bounds = tool.encode(batch.column("composite").to_pylist())
                        idents.append(batch.column("frame_idx"))
                        starts.append(done + bounds[:-1])
                        counts.append(np.diff(bounds))
                        done += len(ids)
                        rest = np.concatenate([rest, ids])
                        ready = len(rest) // full * full
                        for at in range(0, ready, full):
                            out.write_batch(_batch(rest[at : at + full].astype(width.to_pandas_dtype()), full, length, width))
                        rest = rest[ready:]
                if len(rest):
                    padded = np.zeros(-(-len(rest) // length) * length, width.to_pandas_dtype())
                    padded[: len(rest)] = rest
                    out.write_batch(_batch(padded, len(rest), length, width))

        files.write_whole(name, body)
        table = pa.table({
            "frame_idx": pa.chunked_array(idents, pa.int64()),
            "start": np.concatenate([np.zeros(0, np.int64), *starts]), "n_tokens": np.concatenate([np.zeros(0, np.int64), *counts]),
        })

        def listed(sink: pa.NativeFile) -> None:
            with pa.ipc.new_file(sink, table.schema) as out:
                out.write_table(table, max_chunksize=1 << 16)

        files.write_whole(index, listed)
        yield pa.record_batch({
            "part": pa.array([part], pa.int64()), "file": pa.array([name]), "index": pa.array([index]),
            "frames": pa.array([table.num_rows], pa.int64()), "tokens": pa.array([done], pa.int64()),
        })

    ordered = (
        frames.selectExpr("CAST(frame_idx AS LONG) AS frame_idx", "composite")
        .repartitionByRange("frame_idx").sortWithinPartitions("frame_idx", "composite")
    )
    return settle(ordered.mapInArrow(write, "part long, file string, index string, frames long, tokens long"))


class TokenFile:
    """Random access to one file; local files are mapped, so that nothing is copied."""

    def __init__(self, uri: str):
        system, path = files.locate(uri)
        self.source = pa.memory_map(path) if isinstance(system, pafs.LocalFileSystem) else system.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.step = self.length * BATCH_SEQUENCES
        self.held: tuple[int, pa.RecordBatch | None] = (-1, None)

    def batch(self, k: int) -> pa.RecordBatch:
        if self.held[0] != k:
            self.held = (k, self.reader.get_batch(k))
        return self.held[1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask (a slice) of the sequence with that number."""
        k, row = divmod(i, BATCH_SEQUENCES)
        batch, at = self.batch(k), row * self.length
        return (batch.column("ids").values.slice(at, self.length).to_numpy(zero_copy_only=True),
                batch.column("mask").values.slice(at, self.length))

    def spans(self, start: int, count: int) -> Iterator[np.ndarray]:
        """The ids from `start` on, as views, one for each batch they lie in."""
        while count > 0:
            k, at = divmod(start, self.step)
            some = min(count, self.step - at)
            yield self.batch(k).column("ids").values.slice(at, some).to_numpy(zero_copy_only=True)
            start, count = start + some, count - some


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Each frame from the files: frame_idx, start (ids of all frames before it), n_tokens, ids_crc32.

    The checksum is CRC-32 of the ids as little-endian unsigned 32-bit integers. The manifest has one row a file.
    """
    before, base = {}, 0
    for part, count in manifest.select("part", "tokens").orderBy("part").collect():
        before[part], base = base, base + count

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for listed in batches:
            for row in listed.to_pylist():
                source = TokenFile(row["file"])
                system, path = files.locate(row["index"])
                with system.open_input_file(path) as opened:
                    index = pa.ipc.open_file(opened)
                    for k in range(index.num_record_batches):
                        some = index.get_batch(k)
                        sums = []
                        for start, count in zip(some.column("start").to_pylist(), some.column("n_tokens").to_pylist()):
                            crc = 0
                            for ids in source.spans(start, count):
                                crc = zlib.crc32(ids.astype("<u4"), crc)
                            sums.append(crc)
                        yield pa.record_batch({
                            "frame_idx": some.column("frame_idx"),
                            "start": pa.array(some.column("start").to_numpy() + before[row["part"]]),
                            "n_tokens": some.column("n_tokens"), "ids_crc32": pa.array(sums, pa.int64()),
                        })

    return manifest.select("part", "file", "index").repartition(max(1, len(before)), "part").mapInArrow(  # a task a file, however small the manifest
        read, "frame_idx long, start long, n_tokens long, ids_crc32 long"
    )


def tokenised_frames(frames: DataFrame, tokenizer: str, kind: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    folder = shared_folder(frames.sparkSession) + "/tokens"
    return read_token_files(write_token_files(frames, folder, tokenizer, kind, end_id, length))
