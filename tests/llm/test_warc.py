import gzip
import hashlib
import io
from collections import defaultdict

from tests.llm.helpers import with_clashes

from codehealth.llm import warc

BIG = "<p>" + "é" * 600 + "</p>"
PAGES = [
    (1, "http://a.example/x?y=1#z", BIG), (2, "https://b.example", BIG), (3, None, None), (4, "http://c.example/", ""), (5, "http://d.example/\r\nX: 1", "small"), (6, "http://e.example/", "small"),
    (7, "http://f.example/", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + "z" * 2000), (8, "http://g.example/", "n" * 3_000_000), (9, "http://h.example/", "n" * 3_000_000), (10, "http://i.example/", BIG),
]


def expected(pages):
    groups = defaultdict(list)
    for i, _, html in pages:
        groups[html or ""].append(i)
    out = {}
    for i, _, html in pages:
        data = (html or "").encode()
        keep = max(groups[html or ""])
        revisit = len(data) >= 1000 and i != keep
        out[i] = (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keep if revisit else None)
    return out


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def summary(captures):
    out = {}
    for c in captures:
        r = c["response"]
        refers = r["refers_to"]
        out[int(c["metadata"][0]["fields"]["captureId"])] = (r["payload_bytes"], r["payload_digest"], r["record_type"], int(refers.split(":")[2]) if refers else None)
    return out


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(with_clashes(pages(spark), "id", "payload", "k", "urn"), path)
    captures = warc.transactions(warc.records(spark, path)).collect()
    assert summary(captures) == expected(PAGES)
    by_id = {int(c["metadata"][0]["fields"]["captureId"]): c for c in captures}
    for i, url, html in PAGES:
        c = by_id[i]
        assert len(c["requests"]) == len(c["metadata"]) == 1
        if c["response"]["record_type"] == "response":
            assert bytes(c["response"]["payload"]) == (html or "").encode()
        assert c["response"]["target_uri"] == (None if url is None else url.replace("\r\n", " "))
    assert by_id[1]["requests"][0]["http_start"] == "GET /x?y=1 HTTP/1.1" and by_id[2]["requests"][0]["http_start"] == "GET / HTTP/1.1"


def test_files_are_plain_warc(spark, tmp_path):
    path = tmp_path / "w"
    warc.write(pages(spark), str(path), file_bytes=2 << 14)
    files = sorted(path.glob("*.gz"))
    assert len(files) > 4 and all(sum(len(b) for _, b in warc.parsed(f.read_bytes())) < (3 << 14) + 4_000_000 * (f.stat().st_size > 2500) for f in files)
    kinds = [h["warc-type"][0] for f in files for h, _ in warc.parsed(f.read_bytes())]
    assert len(kinds) == 3 * len(PAGES) and kinds.count("request") == len(PAGES)


def test_every_reference_names_a_response_of_equal_payload(spark, tmp_path):
    rows = [*PAGES, *[(k, f"http://x{k % 3}.example/", BIG if k % 2 else "y" * 1500) for k in range(100, 160)], (159, "http://again.example", BIG), (None, None, BIG)]
    warc.write(pages(spark, rows), str(tmp_path))
    found = warc.records(spark, str(tmp_path)).collect()
    named = {r["record_id"]: r for r in found}
    assert len(named) == len(found) == 3 * len(rows)
    revisits = [r for r in found if r["record_type"] == "revisit"]
    assert len(revisits) > 50
    for r in revisits:
        other = named[r["refers_to"]]
        assert other["record_type"] == "response" and other["payload_digest"] == r["payload_digest"] == hashlib.sha1(bytes(other["payload"])).hexdigest()


def made(kind, id_, block=b"", *more):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: " + id_, *more, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_assembly_follows_links_in_both_directions(spark, tmp_path):
    http = b"Content-Type: application/http;msgtype=response"
    data = [
        made(b"request", b"<q1>"), made(b"response", b"<r1>", b"HTTP/1.1 200 OK\r\n\r\nbody", http, b"WARC-Concurrent-To: <q1>"), made(b"metadata", b"<m1>", b"", b"WARC-Concurrent-To: <q1>"),
        made(b"metadata", b"<m2>", b"", b"WARC-Concurrent-To: <r1>", b"WARC-Concurrent-To: <nowhere>"), made(b"request", b"<q2>", b"", b"WARC-Concurrent-To: <gone>"), made(b"warcinfo", b"<i>", b"x: y"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    (tmp_path / "b.warc").write_bytes(made(b"response", b"<r2>", b"HTTP/1.1 404 No\r\n\r\n", http))
    (tmp_path / "empty.warc.gz").write_bytes(gzip.compress(b""))
    got = {c["capture_id"]: c for c in warc.transactions(warc.records(spark, str(tmp_path), glob="*warc*")).collect()}
    one = got["<r1>"]
    assert bytes(one["response"]["payload"]) == b"body" and [r["record_id"] for r in one["requests"]] == ["<q1>"]
    assert {r["record_id"] for r in one["metadata"]} == {"<m1>", "<m2>"}
    assert got["<r2>"]["requests"] == [] and got["<q2>"]["response"] is None and len(got["<q2>"]["requests"]) == 1
    assert set(got) == {"<r1>", "<r2>", "<q2>", "<i>"}


def test_bad_archives_are_errors():
    import pytest

    for bad in (b"hello\r\n", b"WARC/1.0\r\nWARC-Type: x\r\n\r\n", b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc"):
        with pytest.raises(ValueError):
            list(warc.parsed(bad))
    assert list(warc.parsed(b"")) == [] and io.BytesIO(b"").read() == b""


def test_repeated_rows_and_empty_table(spark, tmp_path):
    rows = [(1, "http://a.example", BIG), (1, "http://a.example", BIG), (None, "http://b.example", BIG)]
    warc.write(pages(spark, rows), str(tmp_path / "r"))
    got = warc.transactions(warc.records(spark, str(tmp_path / "r"))).collect()
    assert sorted(c["response"]["record_type"] for c in got) == ["response", "response", "revisit"]
    assert all(len(c["requests"]) == 1 for c in got)
    warc.write(pages(spark, []), str(tmp_path / "e"))
    assert warc.transactions(warc.records(spark, str(tmp_path / "e"))).collect() == []
