"""Media columns in archives, and a Spark data source that reads them.

An archive is a run of members followed by its directory. A member is a fixed header (magic, id, unpadded length, stored length, CRC-32 of the stored bytes), then the stored bytes: a WAV file of 8-bit mono samples, compressed. The directory holds, for each block of about BLOCK bytes, its first byte, length and member count; a fixed trailer says where the directory is. So a reader plans byte ranges from directories alone, and every member can be found and read again by its offset.

write_archives() writes one archive for each task and returns the manifest of those that were committed; an attempt that is lost leaves a file that no manifest names. The source `media_archive` plans byte-range partitions over the archives of a manifest (or a folder), streams members in Arrow batches of bounded size, and retries each failing member on its own, from its offset. A member that stays bad gives a row with an error and no media.

Nulls and empty texts are 64 zero bytes. Equal texts give equal media. Repeated rows and null ids stay rows. An empty table gives no archives and no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from webloom.session import Workspace, ship

MAGIC = b"WLMB"
MEMBER = struct.Struct("<4s?qqqqI")  #: magic, id is null, id, unpadded bytes, media bytes, stored bytes, CRC-32 of the stored bytes
TRAILER = struct.Struct("<qq8s")  #: directory's offset and length, magic
END = b"WLMBDIR1"
PAD = 64
RATE = 8000
BLOCK = 4 << 20
BATCH = 8 << 20
RETRIES = 3
MEMBER_SCHEMA = "doc_id long, n_bytes long, media binary, member_offset long, archive string, error string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("member_offset", pa.int64()), ("archive", pa.string()), ("error", pa.string())])


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(PAD, -(-len(raw) // PAD) * PAD) - len(raw)), len(raw)


def to_wav(payload: bytes) -> bytes:
    """A RIFF file of 8-bit unsigned mono samples, one for each byte."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", (36 + n) & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n & 0xFFFFFFFF) + payload


def from_wav(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a WAV file")
    return media[44:]


def feature(payload: bytes) -> str:
    """Samples, mean level, root mean square about the middle, and zero crossings; integers, so that equal samples give equal strings."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(x < 0)))
    return f"samples={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings}"


class ArchiveWriter:
    def __init__(self, path: str):
        self.files, self.at = pafs.FileSystem.from_uri(path)
        self.files.create_dir(self.at.rsplit("/", 1)[0], recursive=True)
        self.out = self.files.open_output_stream(self.at)
        self.codec = pa.Codec("zstd", 1)
        self.size, self.members, self.blocks = 0, 0, []

    def add(self, doc_id: int | None, text: str | None) -> None:
        payload, n = padded(text)
        media = to_wav(payload)
        stored = self.codec.compress(media, asbytes=True)
        if not self.blocks or self.blocks[-1][1] >= BLOCK:
            self.blocks.append([self.size, 0, 0])
        head = MEMBER.pack(MAGIC, doc_id is None, doc_id or 0, n, len(media), len(stored), zlib.crc32(stored))
        self.out.write(head)
        self.out.write(stored)
        self.size += len(head) + len(stored)
        self.members += 1
        self.blocks[-1][1] += len(head) + len(stored)
        self.blocks[-1][2] += 1

    def close(self) -> None:
        listing = json.dumps(self.blocks).encode()
        self.out.write(listing)
        self.out.write(TRAILER.pack(self.size, len(listing), END))
        self.out.close()


def write_archives(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The manifest of the archives written: archive, members."""
    folder = f"{ws.path}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    path = f"{folder}/{uuid.uuid4().hex}.wlm"
                    writer = ArchiveWriter(path)
                writer.add(doc_id, text.as_py())
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"archive": [path], "members": [writer.members]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return ws.save(rows.mapInArrow(run, "archive string, members long"), "manifest")


def directory(path: str) -> list[list[int]]:
    """Blocks of an archive, from its trailer and directory only."""
    files, at = pafs.FileSystem.from_uri(path)
    with files.open_input_file(at) as f:
        f.seek(f.size() - TRAILER.size)
        where, n, magic = TRAILER.unpack(f.read(TRAILER.size))
        if magic != END:
            raise ValueError(f"{path} has no directory")
        f.seek(where)
        return json.loads(f.read(n))


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def read_member(f, offset: int, retries: int = RETRIES) -> tuple[bool, int, int, bytes, int]:
    """(id is null, id, unpadded bytes, media, next member's offset); reads again from the offset if the bytes fail their checks."""
    for turn in range(retries):
        try:
            f.seek(offset)
            magic, null, doc_id, n, size, stored, crc = MEMBER.unpack(f.read(MEMBER.size))
            if magic != MAGIC:
                raise ValueError("no member here")
            raw = f.read(stored)
            if len(raw) != stored or zlib.crc32(raw) != crc:
                raise ValueError("checksum")
            return null, doc_id, n, pa.Codec("zstd").decompress(raw, size, asbytes=True), offset + MEMBER.size + stored
        except (OSError, ValueError, struct.error):
            if turn == retries - 1:
                raise
            time.sleep(0.05 * 2**turn)
    raise AssertionError


def next_member(f, offset: int, end: int) -> int:
    """Where the next member header begins; end if none does."""
    step = 1 << 16
    while offset < end:
        f.seek(offset)
        chunk = f.read(min(step + MEMBER.size, end - offset))
        at = chunk.find(MAGIC)
        while at >= 0:
            head = chunk[at : at + MEMBER.size]
            if len(head) < MEMBER.size:
                break
            if 0 <= MEMBER.unpack(head)[5] <= end - offset - at - MEMBER.size:
                return offset + at
            at = chunk.find(MAGIC, at + 1)
        offset += step
    return end


def read_range(path: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
    files, at = pafs.FileSystem.from_uri(path)
    rows, size = [], 0
    with files.open_input_file(at) as f:
        while start < end:
            try:
                null, doc_id, n, media, after = read_member(f, start)
                rows.append((None if null else doc_id, n, media, start, path, None))
                size += len(media)
            except (OSError, ValueError, struct.error) as e:
                after = next_member(f, start + 1, end)
                rows.append((None, None, None, start, path, f"{type(e).__name__}: {e}"))
            start = after
            if size >= BATCH or len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.archives = json.loads(options["archives"]) if "archives" in options else None
        self.path = options.get("path")
        self.target = int(options.get("partition_bytes", 32 << 20))

    def partitions(self) -> list[ByteRange]:
        archives = self.archives
        if archives is None:
            files, at = pafs.FileSystem.from_uri(self.path)
            archives = sorted(f"{self.path.rstrip('/')}/{x.base_name}" for x in files.get_file_info(pafs.FileSelector(at)) if x.base_name.endswith(".wlm"))
        out = []
        for path in archives:
            start = end = 0
            for first, size, _ in directory(path):
                if end - start >= self.target:
                    out.append(ByteRange(path, start, end))
                    start = first
                end = first + size
            if end > start:
                out.append(ByteRange(path, start, end))
        return out

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        """Spark reads None where nothing was planned."""
        return iter(()) if partition is None else read_range(partition.path, partition.start, partition.end)


class MediaArchive(DataSource):
    """spark.read.format("media_archive").load(folder), or .option("archives", JSON list of paths)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema) -> MediaArchiveReader:
        return MediaArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, manifest: DataFrame | None = None, folder: str | None = None, partition_bytes: int = 32 << 20) -> DataFrame:
    """The members of a manifest's archives, or of all in a folder. The driver sees a path for each archive, that is for each task that wrote, never a member."""
    ship(spark)
    spark.dataSource.register(MediaArchive)
    reader = spark.read.format("media_archive").option("partition_bytes", str(partition_bytes))
    if manifest is None:
        return reader.load(folder)
    archives = sorted(r.archive for r in manifest.select("archive").toLocalIterator())
    return reader.option("archives", json.dumps(archives)).load()


def _no_errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bad = batch.column(3).drop_null()
        if len(bad):
            raise ValueError(f"a member can't be read: {bad[0]}")
        yield from _features([batch])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    for batch in batches:
        rows: list[tuple] = []
        for m in batch.column(2):
            if not m.is_valid:
                rows.append((None,) * 6)
                continue
            media = m.as_buffer().to_pybytes()
            payload = from_wav(media)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, batch.column(3)], names=names)


def media_features(members: DataFrame, strict: bool = True) -> DataFrame:
    """Digests and sample features of the media that was read back. strict: a member that can't be read fails the job instead of giving a row with its error."""
    return members.select("doc_id", "n_bytes", "media", "error").mapInArrow(
        _no_errors if strict else _features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    )


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every text to archives in the shared folder, reads the stored bytes back and returns their features."""
    spark = docs.sparkSession
    ship(spark)
    manifest = write_archives(docs, Workspace(spark, "media"), id_col, text_col)
    return media_features(read_archives(spark, manifest))
