"""Archives written, read and rewritten, against digests by hand."""

import base64
import gzip
import hashlib

import pytest

from paddock.llm import common, warc

PAGES = [
    (1, "http://a/", "<p>x</p>"),
    (2, "http://b/?q=1 2\r\nEvil: yes", "<p>x</p>"),
    (3, None, None),
    (4, "http://d/", ""),
    (5, "http://e/", "line\r\n\r\nWARC/1.1\r\n\r\ntext\r\n\r\n"),
    (6, "http://f/", "é日本" * 1000),
    (7, "http://g/", "y" * 3_000_000),
    (7, "http://g/", "y" * 3_000_000),
    (8, "http://h/", "line\r\n\r\nWARC/1.1\r\n\r\ntext\r\n\r\n"),
    (None, "http://i/", "<p>x</p>"),
    (9, "http://j/", "alone"),
]


def brute(rows, least):
    top = {}
    for i, _, t in rows:
        if i is not None:
            top[t or ""] = max(top.get(t or "", i), i)
    out = []
    for i, _, t in rows:
        data = (t or "").encode()
        again = len(data) >= least and (t or "") in top and top[t or ""] != i
        out.append((-1 if i is None else i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top[t or ""] if again else -1))
    return sorted(out)


def result(frame):
    return sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in frame.collect())


@pytest.mark.parametrize(("least", "limit"), [(0, 100_000), (5, 100_000), (0, 0)])
def test_written_archives_read_back(spark, tmp_path, monkeypatch, least, limit):
    monkeypatch.setattr(common.join_small, "__defaults__", (limit, "inner"))
    pages = spark.createDataFrame([(*r, "clash") for r in PAGES], "page_id long, url string, html string, digest string")
    warc.write_archives(pages, str(tmp_path / "a"), least, file_bytes=2000)
    read = warc.read_archives(spark, str(tmp_path / "a"), keep_payload=True)
    got = warc.resolve(read)
    assert result(got) == brute(PAGES, least)
    assert sorted((r.page_id or 0, r.html) for r in got.collect()) == sorted((i or 0, t or "") for i, _, t in PAGES)
    assert all("\n" not in (r.url or "") for r in got.collect())
    warc.deduplicate(spark, str(tmp_path / "a"), str(tmp_path / "b"), least)
    want = brute(PAGES, least)  # written again, one of the two records of page 7 is named as the response, and the other revisits it
    again = next(k for k, x in enumerate(want) if x[0] == 7)
    want[again] = (*want[again][:3], "revisit", 7)
    assert result(warc.resolve(warc.read_archives(spark, str(tmp_path / "b")))) == sorted(want)


def test_archives_are_smaller_and_well_formed(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "same " * 2000) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"))
    files = list((tmp_path / "a").rglob("part-*"))
    assert sum(f.stat().st_size for f in files) < 60_000
    kinds = [fields["warc-type"] for f in files for fields, *_ in warc.parsed(f.read_bytes())]
    assert sorted(kinds) == ["response"] + ["revisit"] * 49


def test_files_end_by_their_bytes(spark, tmp_path):
    """Many tiny pages and a few large ones in one task: no file is larger than the target and one record."""
    rows = [(i, f"http://x/{i}", f"tiny {i}") for i in range(2000)] + [(5000 + i, "http://y/", chr(97 + i % 26) * 300_000 + str(i)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"), file_bytes=1_000_000)
    sizes = [f.stat().st_size for f in (tmp_path / "a").rglob("part-*")]
    assert max(sizes) <= 1_000_000 + 301_000 and 10 <= len(sizes) <= 20
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == len(rows)


def test_record_ids_are_unique(spark, tmp_path):
    rows = [(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (None, "u", "x"), (None, None, "y"), (None, None, "y"), (2, "u", "z"), (3, "v", "z"), (None, None, None), (None, None, None)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"))
    read = warc.read_archives(spark, str(tmp_path / "a")).collect()
    ids = {r.record_id for r in read}
    assert len(ids) == len(read) == len(rows)
    assert all(r.refers_to_id is None or r.refers_to_id in ids for r in read)
    assert sum(r.refers_to_id is not None for r in read) == 1  # z; x has two responses, y and the empty page have no names


def foreign(kind, name, content, **fields):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\n{head}Content-Length: {len(content)}\r\n\r\n".encode() + content + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """No page ids, records of other types, and revisits of what the archives don't hold: nothing is lost."""
    digest = lambda t: "sha1:" + base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    http = lambda t: b"HTTP/1.1 200 OK\r\n\r\n" + t.encode()
    given = [
        foreign("warcinfo", "<i>", b"software: x"),
        foreign("response", "<a>", http("same"), WARC_Target_URI="http://a/", WARC_Payload_Digest=digest("same")),
        foreign("response", "<b>", http("same"), WARC_Target_URI="http://b/"),
        foreign("revisit", "<c>", http(""), WARC_Target_URI="http://c/", WARC_Payload_Digest=digest("same")),
        foreign("revisit", "<d>", http(""), WARC_Target_URI="http://d/", WARC_Payload_Digest=digest("elsewhere")),
        foreign("request", "<e>", b"GET / HTTP/1.1\r\n\r\n", WARC_Target_URI="http://a/"),
        foreign("response", "<f>", http(""), WARC_Target_URI="http://f/"),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.warc").write_bytes(b"".join(given))
    warc.deduplicate(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    read = warc.read_archives(spark, str(tmp_path / "out"), keep_payload=True).collect()
    assert sorted((r.record_type, r.url or "") for r in read) == [("request", "http://a/"), ("response", "http://c/"), ("response", "http://f/"), ("revisit", "http://a/"), ("revisit", "http://b/"), ("revisit", "http://d/"), ("warcinfo", "")]
    by_url = {(r.url, r.record_type): r for r in read}
    assert by_url["http://d/", "revisit"].raw + b"\r\n\r\n" == given[4]
    assert by_url["http://a/", "request"].raw + b"\r\n\r\n" == given[5]
    assert by_url["http://b/", "revisit"].refers_to_id == by_url["http://c/", "response"].record_id  # the largest record id
    assert {r.url: r.html for r in warc.resolve(warc.read_archives(spark, str(tmp_path / "out"), keep_payload=True)).collect() if r.url != "http://d/"} == {"http://a/": "same", "http://b/": "same", "http://c/": "same", "http://f/": ""}


def test_digests_bytes_and_gzip_members_of_others(spark, tmp_path):
    """Digests of other kinds and spellings, payloads that aren't UTF-8, gzip archives: read, resolved and kept."""
    http = lambda t: b"HTTP/1.1 203 Other\r\nContent-Type: x\r\n\r\n" + t
    latin, binary = "café".encode("latin-1"), bytes(range(256)) * 3
    sha1 = lambda t: hashlib.sha1(t).hexdigest()
    base32 = lambda t: base64.b32encode(hashlib.sha1(t).digest()).decode()
    given = [
        foreign("response", "<a>", http(latin), WARC_Target_URI="http://a/", WARC_Payload_Digest="sha256:" + hashlib.sha256(latin).hexdigest()),
        foreign("revisit", "<b>", http(b""), WARC_Target_URI="http://b/", WARC_Payload_Digest="sha256:" + hashlib.sha256(latin).hexdigest()),
        foreign("response", "<c>", http(binary), WARC_Target_URI="http://c/", WARC_Payload_Digest="SHA1:" + base32(binary).lower()),
        foreign("revisit", "<d>", http(b""), WARC_Target_URI="http://d/", WARC_Payload_Digest="sha1:" + sha1(binary)),
        foreign("response", "<e>", http(b"plain"), WARC_Target_URI="http://e/", WARC_Payload_Digest="md5:" + hashlib.md5(b"plain").hexdigest()),
        foreign("response", "<f>", http(b"told wrongly"), WARC_Target_URI="http://f/", WARC_Payload_Digest="sha1:" + base32(b"else"), WARC_Page_ID="none"),
        foreign("revisit", "<g>", http(b""), WARC_Target_URI="http://g/", WARC_Payload_Digest="blake3:00"),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "members.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in given[:5]))
    (tmp_path / "in" / "whole.warc.gz").write_bytes(gzip.compress(given[5]))
    (tmp_path / "in" / "plain.warc").write_bytes(given[6])
    with pytest.raises(Exception, match="another digest"):
        warc.read_archives(spark, str(tmp_path / "in")).collect()
    warc.deduplicate(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    read = warc.read_archives(spark, str(tmp_path / "out"), keep_payload=True)
    got = {r.url: bytes(r.payload) for r in warc.resolve(read).where("payload is not null").collect()}
    assert got == {"http://a/": latin, "http://b/": latin, "http://c/": binary, "http://d/": binary, "http://e/": b"plain", "http://f/": b"told wrongly"}
    rows = read.collect()
    assert sorted(r.record_type for r in rows) == ["response"] * 4 + ["revisit"] * 3
    assert all(bytes(r.http) == http(b"") for r in rows if r.record_type == "response")
    assert {r.url: r.html for r in rows if r.record_type == "response"}["http://e/"] == "plain" and sum(r.html is not None for r in rows) == 2
    assert [bytes(r.raw) + b"\r\n\r\n" for r in rows if r.url == "http://g/"] == [given[6]]


def test_cut_gzip_archives_raise():
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parsed(gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")[:-9]))


def test_broken_archives_raise():
    with pytest.raises(ValueError):
        list(warc.parsed(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"))


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.resolve(warc.read_archives(spark, str(tmp_path / "a"))).count() == 0
