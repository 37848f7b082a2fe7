"""WARC archives of HTML reports, compressed record by record with a Zstandard dictionary.

A file begins with a skippable frame that holds the dictionary; each record is one frame of its own, so that any
record can be read alone. Equal payloads are stored once: the others revisit the record with the smallest id.
"""

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.llm import files
from veilmark.plans.session import settle, shared_folder

# ---- fixed values: file format ---------------------------------------------------------------
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

DICTIONARY_BYTES = 64 << 10
SAMPLE_RECORDS = 1000
SAMPLE_CHARS = 16 << 10
LEVEL = 6


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(project_id: str, uri: str, payload: bytes, payload_digest: str, refers_to: str | None, refers_uri: str | None = None) -> bytes:
    """One WARC record: a response with the payload, or a revisit that keeps the HTTP header only."""
    uri, clean = " ".join((uri or "").split()), " ".join((refers_uri or "").split())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{project_id} {uri} {payload_digest}')}>",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{payload_digest}",
            f"X-Project-ID: {project_id}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {clean}", f"X-Refers-To-Project-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of a record."""
    def fields(block: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:] if ": " in line)

    head, rest = raw.split(b"\r\n\r\n", 1)
    warc = fields(head)
    http, payload = rest[: int(warc["Content-Length"])].split(b"\r\n\r\n", 1)
    return warc, fields(http), payload


def learn_dictionary(reports: DataFrame, size: int = DICTIONARY_BYTES, sample: int = SAMPLE_RECORDS) -> bytes:
    """A dictionary trained on the beginnings of at most `sample` reports, chosen by a hash of project_id.

    A few or very short records do not suffice for training; their text is then the dictionary itself.
    """
    rows = (
        reports.where("html IS NOT NULL AND project_id IS NOT NULL").select("project_id", F.xxhash64("project_id").alias("h"))
        .orderBy("h", "project_id").limit(sample)
    )  # ids only
    texts = (
        reports.select("project_id", F.substring("html", 1, SAMPLE_CHARS).alias("html"))
        .join(F.broadcast(rows.select("project_id").distinct()), "project_id").where("html IS NOT NULL")
        .orderBy("project_id", "html").limit(sample).collect()
    )  # at most `sample` texts of SAMPLE_CHARS
    bodies = [record(str(r["project_id"]), "", r["html"].encode(), "", None) for r in texts]
    try:
        return zstandard.train_dictionary(size, bodies).as_bytes()
    except zstandard.ZstdError:
        return b"".join(bodies)[-size:]


def _with_first(reports: DataFrame, least: int) -> DataFrame:
    """Each report with its SHA-1 and, for a later copy of a payload, the id and address of the first."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = reports.select("project_id", "uri", "html", F.sha1(body).alias("sha"), F.length(body).alias("size"))
    copied = (
        keyed.where((F.col("size") >= least) & F.col("project_id").isNotNull()).groupBy("sha")
        .agg(F.min(F.struct("project_id", "uri")).alias("first"), F.max("project_id").alias("last"))
        .where(F.col("last") > F.col("first.project_id"))
        .select(F.col("sha").alias("c_sha"), F.col("first.project_id").alias("first_id"), F.col("first.uri").alias("first_uri"))
    )
    later = F.col("project_id") > F.col("first_id")
    return keyed.join(copied, (F.col("sha") == F.col("c_sha")) & (F.col("size") >= least), "left").select(
        F.col("project_id").cast("string").alias("project_id"), "uri", "html", "sha",
        F.when(later, F.col("first_id")).cast("string").alias("refers_to"), F.when(later, F.col("first_uri")).alias("refers_uri"),
    )


def write_archives(reports: DataFrame, folder: str, least: int = 0, dictionary: bytes | None = None) -> DataFrame:
    """Write one WARC file per partition below `folder`; returns file, records and bytes of each.

    reports: project_id (any orderable type), uri, html; null html is an empty payload, null uri an empty address.
    Of records with equal payloads of at least `least` bytes, that with the smallest project_id is the response and
    the others revisit it; rows that repeat the smallest project_id, and rows without one, are responses. Other
    columns are ignored. A file is moved in place when whole, so a repeated task leaves one file.
    """
    dictionary = learn_dictionary(reports) if dictionary is None else dictionary
    shared = reports.sparkSession.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.zst"
        raw = shared.value
        tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdCompressor(level=LEVEL)
        done = [0, 0]

        def body(sink: pa.NativeFile) -> None:
            sink.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
            for batch in batches:
                for row in batch.to_pylist():
                    b32 = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                    ident = row["project_id"] if row["project_id"] is not None else ""
                    frame = tool.compress(record(ident, row["uri"], (row["html"] or "").encode(), b32, row["refers_to"], row["refers_uri"]))
                    sink.write(frame)
                    done[0] += 1
                    done[1] += len(frame)

        files.write_whole(name, body)
        yield pa.record_batch({"file": pa.array([name]), "records": pa.array([done[0]], pa.int64()), "bytes": pa.array([done[1]], pa.int64())})

    return settle(_with_first(reports, least).mapInArrow(write, "file string, records long, bytes long"))


def frames(stream) -> Iterator[bytes]:
    """The records of one archive, decompressed one by one."""
    magic, length = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("not an archive with a leading dictionary frame")
    raw = stream.read(length)
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    rest = b""
    while True:
        if not rest:
            rest = stream.read(1 << 20)
            if not rest:
                return
        one, out = tool.decompressobj(), []
        while not one.eof:
            if not rest:
                rest = stream.read(1 << 20)
                if not rest:
                    raise ValueError("archive ends inside a record")
            out.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
        yield b"".join(out)


def read_archives(manifest: DataFrame, id_type: str = "string") -> DataFrame:
    """Read the files of a manifest back, one row per record.

    Returns project_id and refers_to (cast to `id_type`), uri, record_type, payload_bytes and payload_digest of the
    full payload, and html (null in a revisit). The digest of a response is computed from its payload anew and must
    be the one in its header.
    """
    schema = "project_id string, refers_to string, uri string, record_type string, payload_bytes long, payload_digest string, html string"
    columns = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                system, path = files.locate(name)
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for raw in frames(stream):
                        warc, http, payload = parse(raw)
                        named = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                        first = warc["WARC-Type"] == "response"
                        if first and (digest(payload) != named or len(payload) != int(http["Content-Length"])):
                            raise ValueError(f"damaged record in {name}")
                        rows.append((warc.get("X-Project-ID"), warc.get("X-Refers-To-Project-ID"), warc.get("WARC-Target-URI"), warc["WARC-Type"],
                                     int(http["Content-Length"]), named, payload.decode() if first else None))
                        held += len(payload)
                        if held > 8 << 20:
                            yield _rows(rows, columns)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows, columns)

    out = manifest.select("file").repartition(max(1, manifest.count()), "file").mapInArrow(read, schema)
    ident = F.when(F.col("project_id") != "", F.col("project_id")).cast(id_type)
    return out.withColumn("project_id", ident).withColumn("refers_to", F.col("refers_to").cast(id_type))


def _rows(rows: list[tuple], columns: list[str]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(c, pa.string())) for i, c in enumerate(columns)], names=columns)


def archive_reports(reports: DataFrame, least: int = 0) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    kind = reports.schema["project_id"].dataType
    manifest = write_archives(reports, shared_folder(reports.sparkSession) + "/warc", least)
    return read_archives(manifest, "string" if isinstance(kind, T.StringType) else kind.simpleString())
