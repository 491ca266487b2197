"""Legacy ARC archives to WARC, and both kinds read back.

ARC files carry no record types, ids or digests. The converter parses the header lines of ARC version
1 (five fields) and 2 (ten fields), takes each block by its declared length, and synthesises what WARC
asks for: record ids from file name and record number, ISO time stamps from 14-digit dates, types from
the block, and payload digests. Payloads are never shuffled: a first pass yields a slim index, equal
digests meet there, and a second pass writes one WARC file for each ARC file.

Files lie in a folder that all executors see, compressed record by record. Tasks name their files
after their own attempt, and only files listed in a written manifest are read, so a lost executor
costs a rerun and never a half-written archive.
"""

import gzip
import hashlib
import posixpath
import uuid
import zlib
from base64 import b32encode
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import functions as F

from parley.llm.common import materialise
from parley.operators.lookup import lookup_join
from parley.session import scratch_dir

ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: [
        "URL",
        "IP-address",
        "Archive-date",
        "Content-type",
        "Result-code",
        "Checksum",
        "Location",
        "Offset",
        "Filename",
        "Archive-length",
    ],
}
FILE_BYTES = 64 << 20
FILE_RECORDS = 50_000
KEY_HEADER = "X-Record-Key"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "20240101000000"


def _open(path, mode):
    system, inner = fs.FileSystem.from_uri(path)
    if mode == "r":
        return system.open_input_stream(inner, compression=None)
    system.create_dir(posixpath.dirname(inner), recursive=True)
    return system.open_output_stream(inner, compression=None)


def _member(data, level=5):
    """One gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def digest(payload):
    """Bare upper-case base32 of the SHA-1."""
    return b32encode(hashlib.sha1(payload).digest()).decode()


def clean_url(url):
    """A URL without white space and control characters; null becomes ``unknown:``."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "unknown:"


def iso_date(digits):
    """14-digit ARC date to ISO 8601; missing digits are the earliest ones."""
    d = "".join(c for c in digits if c.isdigit())[:14]
    d += "00010101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


# ---- ARC ----


def arc_record(version, url, mime, block, name, offset, date=DATE, code="200"):
    """Header line, block and closing line feed of one ARC record."""
    value = {
        "URL": url,
        "IP-address": "0.0.0.0",
        "Archive-date": date,
        "Content-type": mime or "-",
        "Result-code": code,
        "Checksum": "-",
        "Location": "-",
        "Offset": str(offset),
        "Filename": name,
        "Archive-length": str(len(block)),
    }
    line = " ".join(value[f] for f in ARC_FIELDS[version])
    return line.encode() + b"\n" + block + b"\n"


def arc_head(version, name):
    """The version block that opens an ARC file; its own header line has the version 1 fields."""
    block = f"{version} 0 parley\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_record(1, f"filedesc://{name}", "text/plain", block, name, 0)


def read_arc(stream):
    """Yield (number, fields, block) of the records of an uncompressed ARC stream.

    The version block comes as number 0 and says how the other header lines are split. Lines are
    split from the right, so a URL may hold blanks. Raises ValueError on a truncated file.
    """
    names, number = ARC_FIELDS[1], 0
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header line: {line[:200]!r}")
        fields = dict(zip(names, parts))
        length = int(fields["Archive-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"truncated ARC record {fields['URL']}")
        yield number, fields, block
        if number == 0 and fields["URL"].startswith("filedesc://"):
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            names = ARC_FIELDS[version]
        number += 1


def http_parts(block):
    """(status line and headers with the blank line, payload, headers by lower-case name)."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    at = block.find(b"\r\n\r\n")
    head, payload = (block, b"") if at < 0 else (block[: at + 4], block[at + 4 :])
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return head, payload, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def _attempt():
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else "000000-0"


def write_arc(df, folder, key="page_id", url="url", html="html", versions=(1, 2), file_bytes=FILE_BYTES):
    """Write an ARC record per row; returns the manifest (file, records), written.

    Blocks are HTTP responses; the key travels in an HTTP header, a null key in none. Files take the
    format versions in turn, tasks begin at different ones, and end after ``file_bytes`` or ``FILE_RECORDS`` records.
    """

    def run(batches):
        count, out, name, size, records, version = 0, None, None, 0, 0, 1
        first = TaskContext.get().partitionId() if TaskContext.get() else 0
        done = []
        for batch in batches:
            for k, u, h in zip(*(batch.column(i) for i in range(3))):
                if out is None:
                    name, version = f"part-{_attempt()}-{count:05d}.arc.gz", versions[(first + count) % len(versions)]
                    out = _open(posixpath.join(folder, name), "w")
                    out.write(_member(arc_head(version, name)))
                    size = records = 0
                payload = h.as_buffer().to_pybytes() if h.is_valid else b""
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                head += f"Content-Length: {len(payload)}\r\n"
                head += f"{KEY_HEADER}: {k.as_py()}\r\n\r\n" if k.is_valid else "\r\n"
                block = head.encode() + payload
                out.write(_member(arc_record(version, clean_url(u.as_py()), "text/html", block, name, size)))
                size += len(block)
                records += 1
                if size >= file_bytes or records >= FILE_RECORDS:
                    out.close()
                    done.append((posixpath.join(folder, name), records))
                    out, count = None, count + 1
            if done:
                yield _manifest(done)
                done = []
        if out is not None:
            out.close()
            yield _manifest([(posixpath.join(folder, name), records)])

    rows = df.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    return materialise(rows.mapInArrow(run, "file string, records long"), "arc-manifest")


def _manifest(rows):
    files, records = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(files), pa.array(records, pa.int64())], names=["file", "records"])


def by_file(manifest):
    """A task for each file."""
    return manifest.select("file").repartitionByRange(max(manifest.count(), 1), "file")


INDEX = "file string, number long, key string, url string, date string, payload_bytes long, payload_digest string"


def index_arc(manifest):
    """A slim row per ARC record, version blocks left out."""

    def run(frames):
        for frame in frames:
            for file in frame["file"]:
                rows = []
                with _open(file, "r") as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for number, fields, block in read_arc(stream):
                        if number == 0 and fields["URL"].startswith("filedesc://"):
                            continue
                        _, payload, headers = http_parts(block)
                        key = headers.get(KEY_HEADER.lower())
                        rows.append((file, number, key, fields["URL"], fields["Archive-date"], len(payload), digest(payload)))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")], dtype=object)

    return by_file(manifest).mapInPandas(run, INDEX)


# ---- WARC ----


def record_id(file, number):
    """Record id from the archive's name and the record's number in it: a rerun gives the same."""
    seed = hashlib.sha1(f"{posixpath.basename(file)}#{number}".encode()).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=seed, version=5)}>"


def warc_record(headers, block):
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def from_arc(file, number, fields, block, refers=None):
    """The WARC record of an ARC record; ``refers`` is (file, number, url, date) of an equal payload."""
    head, payload, _ = http_parts(block)
    if number == 0 and fields["URL"].startswith("filedesc://"):
        kind, mime = "warcinfo", "application/warc-fields"
        block = b"software: parley\r\nformat: WARC File Format 1.1\r\n"
    elif head:
        kind, mime = "response", "application/http; msgtype=response"
    else:
        kind, mime = ("response" if fields["URL"].startswith("dns:") else "resource"), fields["Content-type"]
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(file, number)), ("WARC-Date", iso_date(fields["Archive-date"]))]
    if kind != "warcinfo":
        headers += [("WARC-Target-URI", fields["URL"]), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if refers:
        headers[0] = ("WARC-Type", "revisit")
        headers += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", record_id(refers[0], refers[1])),
            ("WARC-Refers-To-Target-URI", refers[2]),
            ("WARC-Refers-To-Date", iso_date(refers[3])),
        ]
        block = head
    headers += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", mime)]
    return warc_record(headers, block)


def read_warc(stream):
    """Yield (headers by lower-case name, block) of the records of an uncompressed WARC stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:100]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"truncated WARC record {headers.get('warc-record-id')}")
        yield headers, block


def decisions(index, key_type, min_payload=0):
    """The index with what each record refers to (null: it is a response itself).

    Of records with equal payloads of at least ``min_payload`` bytes the one with the largest key is
    the response (a null key is the smallest; equal keys: the last file and number).
    """
    index = index.withColumn("order", F.col("key").cast(key_type))
    place = F.struct("order", "file", "number", "url", "date")
    best = index.filter(F.col("payload_bytes") >= min_payload).groupBy("payload_digest", "payload_bytes")
    best = best.agg(F.max(place).alias("to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    itself = (F.col("to.file") == F.col("file")) & (F.col("to.number") == F.col("number"))
    to = F.when(~itself, F.struct("to.file", "to.number", "to.url", "to.date"))
    # One page may be a third of all payloads: its rows are dealt over tasks.
    known = lookup_join(index, best, ["payload_digest", "payload_bytes"], "left")
    return known.select("file", "number", to.alias("to"))


def convert(manifest, folder, key_type="long", min_payload=0):
    """Write a WARC file for each ARC file; returns the manifest (file, records), written."""
    index = materialise(index_arc(manifest), "arc-index")
    found = decisions(index, key_type, min_payload).filter("to is not null")
    to = F.col("to")
    links = found.select("file", "number", *[to[c].alias(f"to_{c}") for c in ("file", "number", "url", "date")])
    # Files without any revisit need a row as well.
    every = manifest.select("file", F.lit(None).cast("long").alias("number"))
    links = links.unionByName(every, allowMissingColumns=True)

    def run(frame):
        file = frame["file"].iloc[0]
        links = frame[frame["number"].notna()]
        refers = {
            int(n): (f, int(m), u, d)
            for n, f, m, u, d in zip(links["number"], links["to_file"], links["to_number"], links["to_url"], links["to_date"])
        }
        name = posixpath.basename(file).replace(".arc.gz", f"-{_attempt()}.warc.gz")
        path, records = posixpath.join(folder, name), 0
        with _open(file, "r") as raw, gzip.GzipFile(fileobj=raw) as stream, _open(path, "w") as out:
            for number, fields, block in read_arc(stream):
                out.write(_member(from_arc(file, number, fields, block, refers.get(number))))
                records += 1
        return pd.DataFrame({"file": [path], "records": [records]})

    return materialise(links.groupBy("file").applyInPandas(run, "file string, records long"), "warc-manifest")


WARC_ROWS = (
    "record_id string, record_type string, key string, url string, date string, "
    "payload_bytes long, payload_digest string, refers_to_id string"
)


def index_warc(manifest):
    """A slim row per WARC record but warcinfo; a response's digest and length come from its payload."""

    def run(frames):
        for frame in frames:
            for file in frame["file"]:
                rows = []
                with _open(file, "r") as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for headers, block in read_warc(stream):
                        kind = headers["warc-type"]
                        if kind == "warcinfo":
                            continue
                        _, payload, http = http_parts(block)
                        declared = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        full = kind != "revisit"
                        if full and declared and digest(payload) != declared:
                            raise ValueError(f"payload digest differs in {headers['warc-record-id']}")
                        rows.append(
                            (
                                headers["warc-record-id"],
                                kind,
                                http.get(KEY_HEADER.lower()),
                                headers.get("warc-target-uri"),
                                headers.get("warc-date"),
                                len(payload) if full else None,
                                digest(payload) if full else declared,
                                headers.get("warc-refers-to"),
                            )
                        )
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in WARC_ROWS.split(", ")], dtype=object)
                frame["payload_bytes"] = frame["payload_bytes"].astype("Int64")
                yield frame

    return by_file(manifest).mapInPandas(run, WARC_ROWS)


def resolved(rows):
    """Revisits with key and payload length of the record they refer to: ``refers_to``."""
    full, revisits = rows.filter("record_type != 'revisit'"), rows.filter("record_type = 'revisit'").drop("payload_bytes")
    target = full.select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to"), "payload_bytes")
    joined = lookup_join(revisits, target, "refers_to_id", "left")
    return full.withColumn("refers_to", F.lit(None).cast("string")).unionByName(joined)


def round_trip(df, key="page_id", url="url", html="html", min_payload=0, file_bytes=FILE_BYTES):
    """Rows to ARC files, those to WARC files, and the WARC records read back (slim rows).

    Null html is an empty payload. An empty table gives no files and no rows.
    """
    spark, key_type = df.sparkSession, df.schema[key].dataType.simpleString()
    folder = scratch_dir(spark, "archives")
    arcs = write_arc(df, posixpath.join(folder, "arc"), key, url, html, file_bytes=file_bytes)
    warcs = convert(arcs, posixpath.join(folder, "warc"), key_type, min_payload)
    rows = resolved(materialise(index_warc(warcs), "warc-index"))
    return rows.withColumn("key", F.col("key").cast(key_type)).withColumn("refers_to", F.col("refers_to").cast(key_type))


def pages_query(pages):
    """op2: record type, payload and response of every page, as read back from its WARC record."""
    return round_trip(pages).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
