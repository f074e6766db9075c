"""Operator 2: a deterministic sharded WARC writer, and the reader of what it wrote.

Pages are dealt into ranges of page_id by splitters from a size-weighted sample that reruns draw alike, overfull ranges subdivided, sorted inside each range, and written one gzip member a record. A file is closed when its compressed size reaches the limit. Headers and digests are made anew from the payload. Each task writes under a temporary name of its own; then the files of the tasks that succeeded are renamed, in parallel, and the driver writes the manifest last, so a lost executor or a task that ran twice leaves no trace in it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import cut, lookup, scratch, table, utf8
from .sharding import range_of, splitters

REVISIT_FROM = 1000
"""Shorter payloads are never replaced by a reference."""
ROLL = 64 << 20
"""Compressed bytes at which a file is closed."""
RANGE = 16 << 20
"""Payload bytes meant for a range."""
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "range int, part int, tmp string, file string, bytes long, records long, sha256 string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

KEY = "coalesce(cast(cast(page_id as decimal(20,0)) + 10000000000000000000BD as string), '~')"


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of each record whose payload of REVISIT_FROM bytes or more a larger page_id has too; no payload is shuffled, and counts are combined before the shuffle."""
    body = utf8(F.col("html"))
    light = pages.filter(F.octet_length(body) >= REVISIT_FROM).select("page_id", F.sha1(body).alias("digest"))
    light = cut(light)
    n = light.count()
    owners = light.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    return lookup(light, owners, "digest", n).filter("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def warc_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, headers regenerated. The same input gives the same bytes: the date is fixed and the id is derived from the page's."""
    sha = hashlib.sha1(payload).digest()
    block = b"" if refers_to is not None else payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {warc_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c > " "))
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", f"Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {warc_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Roller:
    """Files of one range, in order, under temporary names."""

    def __init__(self, to: str, rng: int, roll: int):
        self.to, self.rng, self.roll, self.part, self.out, self.done = to, rng, roll, 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.tmp = f"_temporary/{self.rng:05d}-{self.part:05d}-{uuid.uuid4().hex}"
            self.out, self.bytes, self.records, self.sha = files.create(f"{self.to}/{self.tmp}"), 0, 0, hashlib.sha256()
        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = pack.compress(data) + pack.flush()
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.rng, self.part, self.tmp, f"part-{self.rng:05d}-{self.part:05d}.warc.gz", self.bytes, self.records, self.sha.hexdigest()))
            self.part, self.out = self.part + 1, None


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in ENTRY.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def write_warc(pages: DataFrame, to: str | None = None, roll: int = ROLL, range_bytes: int = RANGE) -> tuple[str, DataFrame]:
    """Write pages (page_id, url, html) as WARC files under `to` and return (to, manifest). Of records with equal payloads of at least REVISIT_FROM bytes the largest page_id is the response and the others revisit it.

    Null html: an empty payload. Null url: no target header. Null page_id: a response without a page header, after all others. Repeated rows are each written; those of the owner's page_id are all responses. Empty table: a manifest without files. Other columns are ignored."""
    spark = pages.sparkSession
    to = to or scratch(spark, "warc")
    sizes = pages.select(F.expr(KEY).alias("key"), (F.octet_length(utf8(F.col("html"))) + F.lit(300)).cast("long").alias("size"))
    sizes = cut(sizes)
    total = sizes.agg(F.sum("size")).first()[0] or 0
    marks, _ = splitters(sizes, "key", "size", total // range_bytes + 1)
    again = revisits(pages.select("page_id", "html"))
    # A mark that a page is a revisit sorts just before the page, so payloads are shuffled once, by range.
    both = pages.select("page_id", "url", "html", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to")).unionByName(again.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    dealt = both.withColumn("rng", range_of(F.expr(KEY), marks)).repartitionById(len(marks) + 1, F.col("rng")).sortWithinPartitions("rng", F.expr(KEY), "kind", F.sha1(utf8(F.col("html"))))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, marked = None, {}
        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                rng, page, kind = c["rng"][i].as_py(), c["page_id"][i].as_py(), c["kind"][i].as_py()
                if out is None or out.rng != rng:
                    if out is not None:
                        out.close()
                        yield _entries(out.done)
                    out, marked = Roller(to, rng, roll), {}
                if kind == 0:
                    if marked and marked["page"] != page:
                        marked = {}
                    marked |= {"page": page, c["digest"][i].as_py(): c["refers_to"][i].as_py()}
                    continue
                payload = (c["html"][i].as_py() or "").encode()
                refers = marked.get(hashlib.sha1(payload).hexdigest()) if marked.get("page", "") == page else None
                out.add(record(page, c["url"][i].as_py(), payload, refers))
        if out is not None:
            out.close()
            yield _entries(out.done)

    made = cut(dealt.mapInArrow(write, ENTRY))  # checkpointed: the names of the tries that counted
    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tmp, name in zip(batch.column("tmp").to_pylist(), batch.column("file").to_pylist(), strict=True):
                files.move(f"{to}/{tmp}", f"{to}/{name}")
            yield batch.select(["file"])

    made.select("tmp", "file").mapInArrow(commit, "file string").count()
    entries = made.orderBy("range", "part").select("file", "bytes", "records", "sha256").toLocalIterator()  # one row for each file
    files.put(spark, f"{to}/manifest.json", json.dumps({"files": [r.asDict() for r in entries]}, indent=1))
    return to, made


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file of gzip members, read as a stream."""
    with files.read(uri) as f:
        unpack, text, left = zlib.decompressobj(31), [], b""
        while data := left or f.read(1 << 16):
            left = b""
            text.append(unpack.decompress(data))
            if unpack.eof:
                whole, left, text = b"".join(text), unpack.unused_data, []
                unpack = zlib.decompressobj(31)
                head, _, rest = whole.partition(b"\r\n\r\n")
                headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                yield headers, rest[: int(headers["Content-Length"])]
        if text and any(text):
            raise ValueError(f"{uri} ends inside a record")


def read_warc(spark: SparkSession, to: str, manifest: DataFrame) -> DataFrame:
    """A row for each record of the manifest's files. The length and digest of a response are those of the bytes read; a revisit's are its headers'. A response whose bytes don't agree with its header raises."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [x.split()[0] for x in RECORD.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                for h, block in records(f"{to}/{name}"):
                    claimed = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    page, refers = h.get("Page-ID"), h.get("Refers-To-Page-ID")
                    if h["WARC-Type"] == "response" and (hashlib.sha1(block).hexdigest() != claimed or len(block) != int(h["Payload-Length"])):
                        raise ValueError(f"{name}: the payload of page {page} isn't the one written")
                    rows.append((page and int(page), int(h["Payload-Length"]), claimed, h["WARC-Type"], refers and int(refers)))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(parse, RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    to, manifest = write_warc(table(spark, sf_dir, "pages"))
    return read_warc(spark, to, manifest)


SQL = {
    "op2_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
o AS (SELECT d, max(page_id) AS owner FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest, CASE WHEN owner > page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN owner > page_id THEN owner END AS refers_to FROM p LEFT JOIN o ON p.d = o.d AND n >= 1000
"""
}
