"""WARC archives: written, read back and assembled."""

import gzip
import hashlib
import random

import pytest

from corpuskit.llm import warc


def plain(rows, least=1000):
    """Rows of the result as the contract states them."""
    data = [(i, (h or "").encode()) for i, _, h in rows]
    heads = {}
    for i, x in data:
        if len(x) >= least and i is not None:
            heads[x] = max(heads.get(x, i), i)
    out = []
    for i, x in data:
        again = i is not None and x in heads and i != heads[x]
        out.append((i, len(x), hashlib.sha1(x).hexdigest(), "revisit" if again else "response", heads[x] if again else None))
    return sorted(out, key=str)


def record(kind, rid, block, *more, content="application/http; msgtype=response"):
    head = [b"WARC/1.0", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + rid.encode(),
            *[x.encode() for x in more], b"Content-Type: " + content.encode(), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.fixture
def pages(spark):
    big, nested = "x ü " * 400, record("response", "<urn:inner>", b"HTTP/1.1 200 OK\r\n\r\ninner").decode()
    rows = [(1, "http://a.example/x?y=1", big), (2, None, big), (3, "http://b.example/", big), (4, "http://c.example", None),
            (5, "", ""), (6, "http://d.example/\r\nWARC-Type: warcinfo", "short"), (7, "ü://é/ WARC/1.1", "short"),
            (8, "http://e.example/WARC/1.1/", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60), (9, "u", nested),
            (10, "u", nested * 40), (11, "u", "WARC/1."), (12, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (13, "u", "z" * 2_000_000),
            (13, "u", "z" * 2_000_000), (2, "u", big), (None, "u", big), (14, "u", "WARC/1" + "." * 1200)]
    return spark.createDataFrame([(*r, "a", "b") for r in rows],
                                 "page_id long, url string, html string, record string, type string"), rows


def test_round_trip_equals_the_plain_version(pages):
    df, rows = pages
    assert sorted((tuple(r) for r in warc.round_trip(df).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == plain(rows)


def test_an_empty_table_and_tiny_files(spark, pages, tmp_path):
    df, rows = pages
    assert warc.round_trip(df.limit(0)).count() == 0
    warc.write_archives(df, str(tmp_path / "a"), records_a_file=2)
    found = warc.read_records(spark, str(tmp_path / "a"))
    assert found.count() == 3 * len(rows) and found.filter("NOT complete").count() == 0
    got = warc.with_payloads(warc.assemble(found))
    html = sorted(bytes(r["payload"]).decode() for r in got.collect())
    assert html == sorted(h or "" for _, _, h in rows)
    one = [r for r in got.collect() if r["metadata"]["fields"].get("page_id") == "1"][0]
    assert one["response"]["target_uri"] == one["request"]["target_uri"] == "http://a.example/x?y=1"
    assert (one["n_requests"], one["n_metadata"], one["response"]["status"]) == (1, 1, 200)
    assert one["request"]["concurrent_to"] == [one["capture_id"]] == one["metadata"]["concurrent_to"]


def test_pieces_of_random_archives_join_to_the_records_written():
    rng = random.Random(3)
    bits = [b"WARC/1.", b"\r\n\r\n", b"0\r\n", b"Content-Length: 5\r\n", b"x", b"WARC/1.0\r\nContent-Length: 9\r\n\r\n"]
    for _ in range(300):
        blocks = [b"".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(rng.randint(0, 6))]
        data = b"".join(record("response", f"<{i}>", b) for i, b in enumerate(blocks))
        pieces = [("f", x) for x in data.split(b"WARC/1.")]
        got = list(warc.joined(pieces))
        assert [(g[1], g[3], g[4]) for g in got] == [(i, b, True) for i, b in enumerate(blocks)]
        if blocks and blocks[-1]:  # cut amid the last block
            short = data[:-5]
            got = list(warc.joined([("f", x) for x in short.split(b"WARC/1.")] + [("g", b"")]))
            assert got[-1][4] is False and blocks[-1].startswith(got[-1][3])


def test_foreign_archives_link_in_both_directions(spark, tmp_path):
    http = b"HTTP/1.1 404 Not Found\r\nContent-Length: 4\r\n\r\nbody"
    # base 32 of the digest of "body"
    import base64
    code = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    data = [record("warcinfo", "<w>", b"software: x\r\n", content="application/warc-fields"),
            record("response", "<r1>", http, "WARC-Concurrent-To: <q1>", "warc-concurrent-to: <m1>"),
            record("request", "<q1>", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <r1>"),
            record("metadata", "<m1>", b"via: somewhere\r\n", content="application/warc-fields"),
            record("metadata", "<m2>", b"x: 1\r\n", "WARC-Concurrent-To: <r1>", content="application/warc-fields"),
            record("revisit", "<r2>", http[:-4], f"WARC-Payload-Digest: sha1:{code}"),
            record("metadata", "<m3>", b"x: 2\r\n", "WARC-Concurrent-To: <gone>", content="application/warc-fields")]
    for i in range(2):  # one member, and a member for each record
        path = tmp_path / str(i)
        path.mkdir()
        (path / "a.warc.gz").write_bytes(gzip.compress(b"".join(data)) if i else b"".join(map(gzip.compress, data)))
        got = {r["capture_id"]: r for r in warc.with_payloads(warc.assemble(warc.read_records(spark, str(path)))).collect()}
        assert set(got) == {"<w>", "<r1>", "<r2>", "<gone>"}
        one = got["<r1>"]
        assert (one["n_requests"], one["n_metadata"], one["response"]["status"]) == (1, 2, 404)
        assert one["metadata"]["fields"] == {"via": "somewhere"}
        assert got["<gone>"]["response"] is None and got["<w>"]["response"] is None
        assert bytes(got["<r2>"]["payload"]) == b"body" and got["<r2>"]["response"]["payload_bytes"] == 4


def test_a_capture_with_very_many_records(spark, tmp_path):
    parts = [record("metadata", f"<m{i:06}>", b"x: 1\r\n", "WARC-Concurrent-To: <r>", content="application/warc-fields")
             for i in range(20_000)]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join([record("response", "<r>", b"HTTP/1.1 200 OK\r\n\r\n"), *parts])))
    found = warc.read_records(spark, str(tmp_path), payloads=False)
    [one] = warc.assemble(found).collect()
    assert one["n_metadata"] == 20_000 and one["metadata"]["record_id"] == "<m000000>"
    assert warc.linked(found).filter("capture_id = '<r>'").count() == 20_001
