"""Deterministic sharded WARC archives of pages, and reading them back.

Pages are range-sorted by id. Where ranges begin is told from the pages alone (their total
size and a sample of them by hash), whatever their partitions and the session's settings.
Each task writes its range into files that roll by compressed size; every record is a gzip
member of its own, with headers and digests made anew from the payload, so the same pages
give the same files and bytes. A file gets its final name when it is whole, and Spark's
writer commits the manifest of all files.

Of pages with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the smallest
id is a response; the others are revisit records that refer to it and carry no payload.
Which is which is decided on digests alone; those decisions then travel through the same
range sort as the pages (one row just before each page), so html is shuffled once.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.llm.attach import attach
from wordmill.llm.durable import durable, fresh_path
from wordmill.llm.files import TemporaryFile, reading
from wordmill.llm.shipping import ship

MIN_REVISIT = 100
#: A file is closed once its compressed size reaches this.
ROLL_BYTES = 64 << 20
#: Bytes of html that a range aims at: at least the first, at most the last, between them so
#: that ranges grow in number and in size with the pages.
RANGE_BYTES = (16 << 20, 256 << 20)
#: About how many keys of pages are sampled for each range.
SAMPLED = 30
#: The date of every record: archives of the same pages are the same bytes.
DATE = "2000-01-01T00:00:00Z"
LEVEL = 6
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}/{digest}/{copy}'.encode()).digest()[:16], version=4)}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, copy: int = 0) -> bytes:
    """One record, uncompressed. ``refers_to``: the page that holds the payload, for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest, copy)}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_UNSAFE.sub(lambda m: quote(m[0], safe=''), url)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest, 0)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha1:{b32encode(hashlib.sha1(block).digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


MANIFEST = "file string, part long, seq long, n_records long, n_bytes long, first_id long, last_id long"


class _Roller:
    """Files of one task's range."""

    def __init__(self, folder: str, part: int, attempt: str) -> None:
        self.folder, self.part, self.attempt, self.seq, self.out = folder, part, attempt, 0, None
        self.rows: list[dict] = []

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.out is None:
            self.out = TemporaryFile(self.folder, f"pages-{self.part:06d}-{self.seq:05d}.warc.gz", self.attempt)
            info = f"software: wordmill\r\nformat: WARC File Format 1.1\r\npart: {self.part}.{self.seq}\r\n".encode()
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_record_id(None, f'info{self.part}.{self.seq}', 0)}\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode()
            self.out.write(_member(head + info + b"\r\n\r\n"))
            self.rows.append({"file": self.out.uri, "part": self.part, "seq": self.seq, "n_records": 0, "first_id": page_id})
        self.out.write(_member(data))
        self.rows[-1] |= {"n_records": self.rows[-1]["n_records"] + 1, "last_id": page_id, "n_bytes": self.out.size}
        if self.out.size >= ROLL_BYTES:
            self.close()

    def close(self) -> None:
        if self.out:
            self.out.commit()
            self.out, self.seq = None, self.seq + 1


def _range_bounds(rows: DataFrame) -> list[tuple[int | None, str]]:
    """The least (id, digest) of every range but the first, from the data alone; ranges are about equal in bytes."""
    size = F.octet_length("html").cast("long")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    parts = -(-total // min(max(RANGE_BYTES[0], int((total << 13) ** 0.5)), RANGE_BYTES[1]))
    if parts < 2:
        return []
    top = -(1 << 63) + int(min(1.0, SAMPLED * parts / n) * ((1 << 64) - 1))
    sample = rows.filter(F.xxhash64("id", "html") <= F.lit(min(top, (1 << 63) - 1))).groupBy("id", "digest").agg(F.sum(size + 1).alias("size"))
    keys = sorted(sample.collect(), key=lambda r: (r.id is not None, r.id or 0, r.digest))  # about SAMPLED rows per range
    every, before, bounds = sum(r.size for r in keys), 0, []
    for r in keys:
        if before * parts >= (len(bounds) + 1) * every:
            bounds.append((r.id, r.digest))
        before += r.size
    return bounds


def _range_of(bounds: list[tuple[int | None, str]]) -> Column:
    """How many of the bounds are not above (id, digest), by binary search; null ids come first."""
    if not bounds:
        return F.lit(0)
    known = F.expr("array(" + ",".join(f"named_struct('id', CAST({'NULL' if i is None else repr(str(i))} AS BIGINT), 'digest', '{d}')" for i, d in bounds) + ")")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) <= F.struct("id", "digest"), at + step).otherwise(at))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages below ``folder``; return the committed manifest.

    Null html has an empty payload, a null url no target. Null ids come first and are never
    referred to. Rows that repeat an id and a payload: the first is the response (if its id
    is the smallest), the others revisit it. Other columns are ignored. No pages, no files.
    """
    ship(pages.sparkSession)
    body = F.coalesce(pages[html_col], F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].alias("url"), body.alias("html"), F.sha2(body.cast("binary"), 256).alias("digest"))
    keyed = rows.filter(F.octet_length("html") >= MIN_REVISIT).select("id", "digest")
    holders = keyed.groupBy("digest").agg(F.min("id").alias("holder"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND holder IS NOT NULL").select("digest", "holder")
    decided = durable(attach(keyed, holders, ["digest"], deal_by="id").distinct(), "warc-decisions")
    both = rows.withColumn("holder", F.lit(None).cast("long")).withColumn("kind", F.lit(1)).unionByName(
        decided.select("id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "holder", F.lit(0).alias("kind"))
    )
    bounds = _range_bounds(rows)
    ordered = both.withColumn("part", _range_of(bounds)).repartitionById(len(bounds) + 1, "part").sortWithinPartitions("id", "digest", "kind", "url")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, attempt = None, uuid.uuid4().hex
        last, holder, copy = None, None, 0
        for b in batches:
            if b.num_rows and roller is None:
                roller = _Roller(folder, b.column("part")[0].as_py(), attempt)
            for page_id, url, html, digest, found, _ in zip(*(c.to_pylist() for c in b.columns)):
                if (page_id, digest) != last:
                    last, holder, copy = (page_id, digest), None, 0
                if html is None:
                    holder = found
                    continue
                refers = holder if holder is not None and (page_id != holder or copy) else None
                roller.add(page_id, record(page_id, url, html.encode(), digest, refers, copy))
                copy += 1
        if roller:
            roller.close()
            yield pa.RecordBatch.from_pylist(roller.rows, schema=_MANIFEST_ARROW)

    return durable(ordered.select("id", "url", "html", "digest", "holder", "part").mapInArrow(write, MANIFEST), "warc-manifest")


_MANIFEST_ARROW = pa.schema([("file", pa.string()), *((k, pa.int64()) for k in ("part", "seq", "n_records", "n_bytes", "first_id", "last_id"))])


def members(f) -> Iterator[bytes]:
    """The gzip members of an open file, one at a time."""
    rest, packer, parts = b"", None, []
    while True:
        if not rest:
            rest = f.read(1 << 20)
            if not rest:
                if packer is not None:
                    raise ValueError("the last record is cut short")
                return
        packer = packer or zlib.decompressobj(31)
        parts.append(packer.decompress(rest))
        rest = packer.unused_data
        if packer.eof:
            yield b"".join(parts)
            packer, parts = None, []


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, block


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per page record of the archives.

    A response's size and digest are taken from its payload, after its block digest and
    payload digest have been checked; a revisit's from its own headers.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("file").to_pylist():
                out: list[tuple] = []
                with reading(path) as f:
                    for data in members(f):
                        fields, block = parse(data)
                        kind = fields["warc-type"]
                        if kind == "warcinfo":
                            continue
                        if fields["warc-block-digest"] != "sha1:" + b32encode(hashlib.sha1(block).digest()).decode():
                            raise ValueError(f"a block of {path} is damaged")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                        if kind == "response" and (_sha(payload) != digest or len(payload) != size):
                            raise ValueError(f"a payload of {path} is damaged")
                        number = lambda k: int(fields[k]) if k in fields else None  # noqa: E731, B023
                        out.append((number("x-page-id"), fields.get("warc-target-uri"), size, digest, kind, number("x-refers-to-page-id")))
                for at in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 10_000]), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = max(1, manifest.count())
    return manifest.select("file").repartition(n, "file").mapInArrow(read, READ)


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, fresh_path(pages.sparkSession, "warc")))
