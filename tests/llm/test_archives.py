import gzip
import hashlib
import io
from base64 import b32encode
from collections import Counter, defaultdict

import pytest

from parley.llm import archives
from parley.operators import lookup

PAGES = "page_id long, url string, html string"


def rows():
    tricky = "filedesc://x 0 0 text/plain 9\n\nhttp://a 0.0.0.0 1 text/html 5\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    return [
        (1, "http://a/b c\nd", "same"),
        (2, None, "same"),
        (9, "http://x/ü", "same"),
        (4, "http://t", tricky),
        (5, "http://n", None),
        (6, "http://e", ""),
        (7, "http://l", "é" * 200_000),
        (None, "http://q", "alone"),
        (8, "http://r", "rep"),
        (8, "http://r", "rep"),
        (-1, "http://s", "\r\n\r\n"),
    ]


def brute(data):
    groups, out = defaultdict(list), Counter()
    for key, _, html in data:
        groups[(html or "").encode()].append(key)
    for payload, keys in groups.items():
        digest = b32encode(hashlib.sha1(payload).digest()).decode()
        top = max((k for k in keys if k is not None), default=None)
        order = sorted(keys, key=lambda k: k != top)
        for n, k in enumerate(order):
            out[k, len(payload), digest, "revisit" if n else "response", top if n else None] += 1
    return out


def shown(df):
    return Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect())


def test_query_against_brute_force(spark):
    assert shown(archives.pages_query(spark.createDataFrame(rows(), PAGES).repartition(3))) == brute(rows())


def test_small_files_and_both_versions(spark):
    df = spark.createDataFrame(rows() * 3, PAGES)
    out = archives.round_trip(df, file_bytes=10)
    assert out.count() == 33 and out.filter("record_type = 'response'").count() == len(brute(rows()).keys() & {*brute(rows())}) - 4


def test_small_tables_use_both_versions(spark, tmp_path):
    df = spark.createDataFrame(rows() * 3, PAGES).repartition(4)
    files = [r["file"] for r in archives.write_arc(df, str(tmp_path)).collect()]
    heads = {gzip.open(f).read().split(b"\n")[1][:1] for f in files}
    assert heads == {b"1", b"2"}


def test_a_payload_in_very_many_records(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_ROWS", 3)
    monkeypatch.setattr(lookup, "SEG_ROWS", 2)
    some = [(k, "http://a", "same") for k in range(40)] + [(k, "http://b", str(k)) for k in range(40, 50)]
    assert shown(archives.pages_query(spark.createDataFrame(some, PAGES).repartition(3))) == brute(some)


def test_payloads_below_the_limit_are_never_revisits(spark):
    out = archives.round_trip(spark.createDataFrame(rows(), PAGES), min_payload=5)
    assert {r["record_type"] for r in out.collect()} == {"response"}


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], PAGES)
    assert archives.pages_query(none).count() == 0
    clash = spark.createDataFrame([(*r, "a", "b") for r in rows()], PAGES + ", file string, payload_digest string")
    assert shown(archives.pages_query(clash)) == brute(rows())


@pytest.mark.parametrize("version", [1, 2])
def test_headers_by_version(version):
    block = b"HTTP/1.0 200 OK\r\n\r\nbody"
    data = archives.arc_head(version, "f.arc") + archives.arc_record(version, "http://a/x y", "text/html", block, "f.arc", 0, "19960923142103")
    (_, head, _), (number, fields, got) = archives.read_arc(io.BytesIO(data))
    assert head["URL"] == "filedesc://f.arc" and number == 1 and got == block and fields["URL"] == "http://a/x y"
    headers, out = next(archives.read_warc(io.BytesIO(archives.from_arc("f.arc", number, fields, got))))
    assert headers["warc-type"] == "response" and headers["warc-date"] == "1996-09-23T14:21:03Z" and out == block
    assert headers["warc-payload-digest"] == "sha1:" + b32encode(hashlib.sha1(b"body").digest()).decode()
    assert headers["warc-record-id"] == archives.record_id("/elsewhere/f.arc", 1)


def test_other_types():
    fields = dict(zip(archives.ARC_FIELDS[1], ["dns:a.org", "0", "1996", "text/dns", "3"]))
    assert b"WARC-Type: response" in archives.from_arc("f", 3, fields, b"abc")
    fields["URL"] = "ftp://a"
    assert b"WARC-Type: resource" in archives.from_arc("f", 3, fields, b"abc")


def test_damaged_archives():
    with pytest.raises(ValueError):
        list(archives.read_arc(io.BytesIO(b"http://a 0 1996 text/html 99\nshort")))
    with pytest.raises(ValueError):
        list(archives.read_arc(io.BytesIO(b"no header\n")))
    with pytest.raises(ValueError):
        list(archives.read_warc(io.BytesIO(b"HTTP/1.1 200\r\n\r\n")))


def test_members_are_separate():
    data = archives._member(b"one") + archives._member(b"two")
    assert gzip.decompress(data) == b"onetwo"
