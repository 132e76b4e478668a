"""WARC archives of pages: writing with revisit records, and a reader that salvages damaged archives.

Every record is a gzip member of its own. Of pages with equal payloads of at least MIN_REVISIT bytes, that with the smallest id is a response, the others revisit it; the digests that repeat are found from digests alone, and only (id, response's id) pairs meet the pages again.

The reader checks each record: gzip member, version line, header block, content length, payload digest of a response. After a failed check it searches for the next gzip member or version line that passes, goes on from there, and reports the bytes in between as a quarantined gap. A file is read as a stream: what is held is one record and a read-ahead.

Null html is an empty payload. Repeated page ids each have a record; of equal ids and payloads one is the response. Null ids are written and read back as null, and never chosen while another page has the payload. Other columns are ignored. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import Workspace, ship

MIN_REVISIT = 100
ROLL = 64 << 20  #: an archive is closed beyond so many bytes
READ = 1 << 20
LARGEST = (1 << 31) + (1 << 20)  #: a content length beyond this is taken for damage: no value of a table can be as long
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
DATE = "2024-01-01T00:00:00Z"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def _uri(url: str) -> list[str]:
    """Header lines of a URL: as it is, or as a JSON string where it could not be read back from a line."""
    plain = url == url.strip() and all(ord(c) > 31 and ord(c) != 127 and not 0xD800 <= ord(c) < 0xE000 for c in url)
    return [f"WARC-Target-URI: {url}"] if plain else [f"WARC-Target-URI: {json.dumps(url)}", "X-Target-URI-Escapes: json"]


def target_uri(head: dict) -> str | None:
    uri = head.get("warc-target-uri")
    return json.loads(uri) if uri is not None and head.get("x-target-uri-escapes") == "json" else uri


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One compressed record. A revisit holds no payload; X-Payload-Length keeps the full one's size."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        *_uri(url),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        body += payload
    else:
        head += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    raw = b"WARC/1.1\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Bad(Exception):
    pass


class Tail(Bad):
    """The bytes end inside a record."""


def parse(raw: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, block and the next position of the record at raw[at:], or Bad."""
    if not raw.startswith(VERSION, at):
        raise Bad("version line")
    end = raw.find(b"\r\n\r\n", at)
    if end < 0:
        raise Tail("header block")
    head: dict[str, str] = {}
    for line in raw[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("header line")
        head[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = head.get("content-length", "")
    if not size.isdigit() or int(size) > LARGEST:
        raise Bad("content length")
    stop = end + 4 + int(size)
    if len(raw) < stop + 4:
        raise Tail("block")
    if raw[stop : stop + 4] != b"\r\n\r\n":
        raise Bad("record end")
    return head, raw[end + 4 : stop], stop + 4


def checked(head: dict, block: bytes) -> tuple[dict, bytes]:
    """The payload of a record; Bad if its digest is another."""
    payload = block.partition(b"\r\n\r\n")[2]
    kind, digest = head.get("warc-type"), head.get("warc-payload-digest", "")
    if kind not in ("response", "revisit") or not digest.startswith("sha256:"):
        raise Bad("record type")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest[7:]:
        raise Bad("payload digest")
    return head, payload


class Salvage:
    """Iterates over (offset, headers, payload) of a binary file; gaps holds (first byte, length, reason) of what was skipped."""

    def __init__(self, f):
        self.f, self.gaps = f, []
        self.buffer, self.start, self.ended = b"", 0, False

    def _more(self) -> bool:
        chunk = b"" if self.ended else self.f.read(READ)
        self.ended = not chunk
        self.buffer += chunk
        return bool(chunk)

    def _drop(self, n: int) -> None:
        self.buffer = self.buffer[n:]
        self.start += n

    def _member(self, at: int) -> tuple[list[tuple[dict, bytes]], int]:
        """Records of the gzip member at buffer[at:], and where it ends."""
        z = zlib.decompressobj(31)
        parts, fed, size = [], at, 0
        while True:
            try:
                part = z.decompress(self.buffer[fed:] if fed else self.buffer)
            except zlib.error as e:
                raise Bad(f"gzip: {e}") from None
            parts.append(part)
            size += len(part)
            fed = len(self.buffer)
            if z.eof:
                end = fed - len(z.unused_data)
                break
            if size > LARGEST or not self._more():
                raise Bad("gzip member is cut")
        raw, k, out = b"".join(parts), 0, []
        while k < len(raw):
            head, block, k = parse(raw, k)
            out.append(checked(head, block))
        if not out:
            raise Bad("empty member")
        return out, end

    def _plain(self, at: int) -> tuple[list[tuple[dict, bytes]], int]:
        while True:
            try:
                head, block, end = parse(self.buffer, at)
                return [checked(head, block)], end
            except Tail:
                if len(self.buffer) - at > LARGEST or not self._more():
                    raise

    def _try(self, at: int):
        while len(self.buffer) - at < 16 and self._more():
            pass
        if self.buffer.startswith(GZIP, at):
            return self._member(at)
        if self.buffer.startswith(VERSION, at):
            return self._plain(at)
        raise Bad("no member or version line")

    def _next(self, at: int) -> int:
        """The next place at or after `at` that may begin a member or a version line; -1 if there is none in the buffer."""
        found = [k for k in (self.buffer.find(GZIP, at), self.buffer.find(VERSION, at)) if k >= 0]
        return min(found, default=-1)

    def __iter__(self) -> Iterator[tuple[int, dict, bytes]]:
        while self.buffer or self._more():
            try:
                records, end = self._try(0)
            except Bad as e:
                yield from self._seek(str(e))
                continue
            for head, payload in records:
                yield self.start, head, payload
            self._drop(end)

    def _seek(self, why: str) -> Iterator[tuple[int, dict, bytes]]:
        first, at = self.start, 1
        while True:
            at = self._next(at)
            if at < 0:
                keep = min(len(self.buffer), len(VERSION) - 1)
                self._drop(len(self.buffer) - keep)
                at = 0
                if not self._more():
                    self._drop(len(self.buffer))
                    self.gaps.append((first, self.start - first, why))
                    return
                continue
            try:
                records, end = self._try(at)
            except Bad:
                at += 1
                continue
            self.gaps.append((first, self.start + at - first, why))
            for head, payload in records:
                yield self.start + at, head, payload
            self._drop(end)
            return


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = pafs.FileSystem.from_uri(folder)
        files.create_dir(at, recursive=True)
        out, name, size, n = None, "", 0, 0
        for batch in batches:
            c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for page_id, url, html, digest, refers_to in zip(c["page_id"].to_pylist(), c["url"].to_pylist(), c["html"], c["digest"].to_pylist(), c["refers_to"].to_pylist(), strict=True):
                if out is None:
                    name, size, n = uuid.uuid4().hex + ".warc.gz", 0, 0
                    out = files.open_output_stream(f"{at}/{name}", compression=None)
                made = record(page_id, url or "", html.as_buffer().to_pybytes() if html.is_valid else b"", digest, refers_to)
                out.write(made)
                size += len(made)
                n += 1
                if size >= ROLL:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [n]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [n]})

    return run


def write_warcs(pages: DataFrame, ws: Workspace) -> DataFrame:
    """The manifest (archive, records) of the archives that committed tasks wrote."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    light = p.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size")).where(f"size >= {MIN_REVISIT}")
    # one id may stand on several rows of equal payload: the first of them is the response
    many = light.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null")
    many = ws.save(many.select("digest", "first"), "repeated")
    pairs = light.join(many, "digest").groupBy("page_id", "first", "digest").agg(F.count("*").alias("rows")).where("page_id is null or page_id != first or rows > 1")
    p = p.withColumn("digest", F.sha2("html", 256))
    marked = p.join(pairs.select("page_id", "digest", "first"), p["page_id"].eqNullSafe(pairs["page_id"]) & (p["digest"] == pairs["digest"]), "left").select(p["page_id"], "url", "html", p["digest"], "first")
    twin = F.col("first") == F.col("page_id")
    # rows that repeat both id and payload are rare: they alone are numbered
    plain = marked.where(~F.coalesce(twin, F.lit(False))).withColumnRenamed("first", "refers_to")
    twins = marked.where(twin).withColumn("k", F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url")))
    twins = twins.select("page_id", "url", "html", "digest", F.when(F.col("k") > 1, F.col("first")).alias("refers_to"))
    repeated = not pairs.where("page_id = first").isEmpty()
    rows = plain.unionByName(twins) if repeated else plain
    return ws.save(rows.mapInArrow(_writer(f"{ws.path}/warc"), "archive string, records long"), "manifest")


_SCHEMA = "archive string, offset long, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, target_uri string, payload binary, gap_bytes long, reason string"
_ARROW = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary()), ("gap_bytes", pa.int64()), ("reason", pa.string())])


def _number(x: str | None) -> int | None:
    return int(x) if x and x.lstrip("-").isdigit() else None


def _reader(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = pafs.FileSystem.from_uri(path)
                with files.open_input_stream(at, compression=None) as f:
                    salvage, rows, size = Salvage(f), [], 0
                    for offset, head, payload in salvage:
                        kind = head["warc-type"]
                        n = len(payload) if kind == "response" else _number(head.get("x-payload-length"))
                        digest = hashlib.sha256(payload).hexdigest() if kind == "response" else head["warc-payload-digest"][7:]
                        rows.append((path, offset, _number(head.get("x-page-id")), kind, n, digest, _number(head.get("x-refers-to-page")), target_uri(head), payload if keep and kind == "response" else None, None, None))
                        size += len(payload) if keep else 0
                        if len(rows) >= 4096 or size >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                            rows, size = [], 0
                    rows += [(path, first, None, "gap", None, None, None, None, None, n, why) for first, n, why in salvage.gaps]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return run


def read_warcs(archives: DataFrame, payloads: bool = True, tasks: int | None = None) -> DataFrame:
    """Records of the files named in the column `archive`, and a row of type gap for each quarantined range of bytes."""
    ship(archives.sparkSession)
    if tasks is None:  # an archive or a few a task
        tasks = max(2 * archives.sparkSession.sparkContext.defaultParallelism, archives.count() // 4, 8)
    paths = archives.select("archive").repartition(tasks)
    return paths.mapInArrow(_reader(payloads), _SCHEMA)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from the archives."""
    spark = pages.sparkSession
    ship(spark)
    manifest = write_warcs(pages, Workspace(spark, "warc"))
    rows = read_warcs(manifest, payloads=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
with p as (select page_id, coalesce(html, '') as html, encode(coalesce(html, '')) as raw from pages),
s as (select page_id, octet_length(raw)::bigint as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from s)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id != first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id != first then first end as refers_to from f
"""
