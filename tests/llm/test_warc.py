import gzip
import hashlib
import io

import pytest

from engramite.llm import warc
from tests.oracles import compare

PAGES = "page_id long, url string, html string"


def record(body, uri="http://x/"):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{len(body)}>\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_chunks_round_trip(packed):
    bodies = [b"", b"a", b"x" * 1000, bytes(range(256)) * 999, b"\r\n\r\nWARC/1.1\r\n"]
    data = b"".join(gzip.compress(record(b)) if packed else record(b) for b in bodies)
    rows = list(warc.chunks(warc.Stream(io.BytesIO(data)), 1000))
    got, now = [], b""
    for r in rows:
        assert len(r["payload"]) <= 1000
        now += r["payload"]
        assert r["sha256"] == hashlib.sha256(now).hexdigest()
        if r["last"]:
            assert r["content_length"] == len(now)
            got.append(now)
            now = b""
    assert got == bodies


def test_never_holds_a_whole_record():
    stream = warc.Stream(io.BytesIO(gzip.compress(record(b"0" * 50_000_000))), step=1 << 16)
    most = 0
    for _ in warc.chunks(stream, 1 << 14):
        most = max(most, len(stream.buffer))
    assert most < 1 << 18


def test_short_and_broken_streams():
    good, read = record(b"abc"), lambda data: list(warc.chunks(warc.Stream(io.BytesIO(data)), 10))
    for data, what in (
        (good[:-5], "payload ends early"), (b"HTTP/1.1 200\r\n\r\n", "no WARC record"), (good.replace(b": 3", b": -3"), "no content length"),
        (good.replace(b": 3", b": three"), "no content length"), (good.replace(b"Content-Length: 3\r\n", b""), "no content length"), (gzip.compress(good)[:-20], "ends early"), (gzip.compress(good)[:12] + b"broken" * 9, ""),
    ):
        rows = read(good + data if data[:2] != b"\x1f\x8b" else data)
        assert what in rows[-1]["error"] and (rows[0].get("payload") == b"abc" or data[:2] == b"\x1f\x8b")
        assert rows[-1]["record_offset"] in (0, len(good), len(good) - 4)


def test_pages_round_trip(spark):
    pages = [(1, "http://a/ b", "<p>é</p>"), (1, "http://a/ b", "<p>é</p>"), (2, None, ""), (None, "u", None), (3, "http://long", "z" * 100_000)]
    rows = warc.chunked(spark, spark.createDataFrame(pages, PAGES).selectExpr("*", "'x' AS payload", "1 AS last", "'y' AS id")).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: (r.file, r.record_offset, r.chunk_no)):
        whole[r.file, r.record_offset] = whole.get((r.file, r.record_offset), b"") + bytes(r.payload)
    assert sorted(whole.values()) == sorted((p[2] or "").encode() for p in pages)
    assert {r.target_uri for r in rows} == {"http://a/%20b", None, "u", "http://long"}
    assert warc.chunked(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_matches_duckdb(spark):
    from engramite.llm import queries

    sf = "/root/testdata/sf0.001"
    assert compare(queries.op7_warc_chunks(spark, sf), warc.ORACLE, sf) is None


@pytest.mark.parametrize("packed", [False, True])
def test_headers_of_any_length(packed):
    uris = ["http://x/" + "a" * n for n in (3_000_000, 5, 1_500_000)]
    data = b"".join(gzip.compress(record(b"body", u)) if packed else record(b"body", u) for u in uris)
    rows = list(warc.chunks(warc.Stream(io.BytesIO(data)), 1000))
    assert [(r["target_uri"], r["payload"]) for r in rows] == [(u, b"body") for u in uris]


def test_long_url_keeps_the_pages_after_it(spark):
    pages = [(1, "u", "one"), (2, "http://a/" + " " * 900_000, "two"), (3, "v", "three")]
    rows = warc.chunked(spark, spark.createDataFrame(pages, PAGES).coalesce(1)).collect()
    assert sorted((r.target_uri, bytes(r.payload).decode()) for r in rows) == sorted((u.replace(" ", "%20"), h) for _, u, h in pages)


def test_header_without_an_end():
    rows = list(warc.chunks(warc.Stream(io.BytesIO(record(b"abc") + b"WARC/1.1\r\nWARC-Type: resource\r\n")), 10))
    assert rows[0]["payload"] == b"abc" and "header ends early" in rows[1]["error"]


def test_damaged_files_are_rows(spark, tmp_path):
    for name, data in {"good": record(b"abc"), "bad": record(b"abc") + record(b"x").replace(b": 1", b": -1")}.items():
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("good", "bad")] + [(None,)], "path string")
    rows = warc.read_warc(paths).collect()
    assert sorted((r.file, r.payload and bytes(r.payload), r.error is None) for r in rows if r.payload) == [("bad", b"abc", True), ("good", b"abc", True)]
    assert [(r.file, r.payload) for r in rows if r.error] == [("bad", None)]


def test_query_returns_the_payload(spark, tmp_path):
    from engramite.llm import queries

    pages = [(1, "u", "one" * 9_000), (1, "u", "one" * 9_000), (2, None, None)]
    spark.createDataFrame(pages, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    df = queries.queries()["op7_warc_chunk_table"](spark, str(tmp_path))
    assert df.columns == warc._TYPES.names
    whole = {}
    for r in sorted(df.collect(), key=lambda r: (r.file, r.record_offset, r.chunk_no)):
        whole[r.file, r.record_offset] = whole.get((r.file, r.record_offset), b"") + bytes(r.payload)
    assert sorted(whole.values()) == sorted((h or "").encode() for _, _, h in pages)
