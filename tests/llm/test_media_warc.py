import hashlib
import zlib

from pyarrow import fs as pafs

from webloom.llm import media, warc
from webloom.session import Workspace

TEXTS = [(1, "hello"), (2, None), (3, ""), (4, "x" * 64), (5, "ü" * 100_000), (6, "hello"), (None, "no id")]


def test_round_trip(spark):
    rows = media.store_and_read(spark.createDataFrame(TEXTS, "doc_id long, text string")).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        raw = (dict(TEXTS)[r.doc_id] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.store_and_read(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_members_fail_alone(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(40)], "doc_id long, text string").coalesce(1)
    manifest = media.write_archives(docs, Workspace(spark, "test"))
    path = manifest.first().archive
    files, at = pafs.FileSystem.from_uri(path)
    offsets = sorted(r.member_offset for r in media.read_archives(spark, manifest).collect())
    data = bytearray(files.open_input_file(at).read())
    data[offsets[7] + media.MEMBER.size + 3] ^= 255
    with files.open_output_stream(at) as f:
        f.write(bytes(data))
    rows = media.media_features(media.read_archives(spark, manifest, partition_bytes=2000), strict=False).collect()
    assert sum(r.error is not None for r in rows) == 1 and len({r.doc_id for r in rows if r.error is None}) == 39


def test_warc_round_trip(spark):
    big, other = "<p>" + "x" * 200, "y" * 150
    pages = [(1, "http://a/1", "small"), (2, "http://a/2", "small"), (5, "http://a/5", big), (3, "http://a/3", big), (4, "http://a/4", None), (6, None, other), (7, "http://a/\r\nWARC/1.1", other + "é")]
    got = {r.page_id: r for r in warc.archive_and_read(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("response", None), 2: ("response", None), 3: ("response", None), 5: ("revisit", 3), 4: ("response", None), 6: ("response", None), 7: ("response", None)}
    for k, _, html in pages:
        assert (got[k].payload_bytes, got[k].payload_digest) == (len((html or "").encode()), hashlib.sha256((html or "").encode()).hexdigest())
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_rows(spark):
    html = "z" * 120
    rows = warc.archive_and_read(spark.createDataFrame([(1, "u", html), (1, "u", html), (2, "u", html), (None, "u", html)], "page_id long, url string, html string")).collect()
    assert len(rows) == 4 and sum(r.record_type == "response" for r in rows) == 1


def test_salvage(tmp_path):
    records = [warc.record(i, f"http://a/{i}", b"payload %d " % i * 40, hashlib.sha256(b"payload %d " % i * 40).hexdigest(), None) for i in range(6)]
    data = b"".join(records)
    at = len(records[0]) + len(records[1])
    broken = data[: at + 20] + b"\xff\xfe\x1f\x8b\x08garbage" + data[at + 40 :]
    p = tmp_path / "x.warc.gz"
    p.write_bytes(broken)
    with p.open("rb") as f:
        s = warc.Salvage(f)
        ids = [int(h["x-page-id"]) for _, h, _ in s]
    assert ids == [0, 1, 3, 4, 5] and len(s.gaps) == 1 and s.gaps[0][0] == at
    p.write_bytes(data[: len(data) - 5])
    with p.open("rb") as f:
        s = warc.Salvage(f)
        assert len(list(s)) == 5 and len(s.gaps) == 1


def test_addresses_come_back(spark):
    uris = ['http://a/é?q="x"\\y', "http://a/\r\nWARC/1.1", " http://a ", "", "http://a/%0A"]
    pages = spark.createDataFrame([(k, u, f"page {k}", "x", 1) for k, u in enumerate(uris)], "page_id long, url string, html string, digest string, size int")
    manifest = warc.write_warcs(pages, Workspace(spark, "test"))
    got = {r.page_id: (r.target_uri, bytes(r.payload)) for r in warc.read_warcs(manifest).collect()}
    assert got == {k: (u, f"page {k}".encode()) for k, u in enumerate(uris)}


def test_revisits_name_their_record(spark):
    html = "z" * 3_000_000
    manifest = warc.write_warcs(spark.createDataFrame([(1, "u", html), (2, "u", html)], "page_id long, url string, html string"), Workspace(spark, "test"))
    ids, refers = {}, None
    for path in [r.archive for r in manifest.collect()]:
        files, at = pafs.FileSystem.from_uri(path)
        with files.open_input_stream(at, compression=None) as f:
            for _, head, payload in warc.Salvage(f):
                ids[head["warc-record-id"]] = len(payload)
                refers = head.get("warc-refers-to", refers)
    assert ids[refers] == 3_000_000 and len(ids) == 2
