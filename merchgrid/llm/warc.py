"""WARC archives: write records, index them first, read back by coalesced byte ranges.

Writing: every task lays its pages out as gzip members, one per record, in archive files of
about ``ARCHIVE_BYTES`` in a shared folder, and returns one index row per record: file, offset,
length, url, digest.  Files carry a name of their own per attempt, so a task that is run
again after an executor was lost leaves at worst a file that no index row names; the stored
index is what makes a record part of the archive.

Pages of equal payload become one response (the smallest page_id) and revisits that refer to
it.  Equality is that of SHA-256 and length; groups of any size are found by a map-side count and looked up
by ``attach``.

Reading: index rows are dealt out by stretches of a file, sorted by offset, and neighbouring
ranges are read in one go while the gap is small and the read bounded; each record
is taken from its range, unpacked, parsed and its digest checked.

Files are reached through ``pyarrow.fs`` by the URI of the shared folder (file, hdfs, s3, gs).

Defined results: null html counts as empty; a null url is written as empty; payloads shorter than
``min_revisit_bytes`` are always responses; of repeated rows with the same id the first written is the response; extra
columns are ignored; no pages give an empty index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchgrid.llm.common import attach, bare, chunks, shared_folder, stored

#: An archive file is closed once it has this many bytes.
ARCHIVE_BYTES = 256 << 20
#: Ranges closer than GAP are read together, up to READ bytes at once; a task gets stretches of SPAN bytes.
GAP, READ, SPAN = 64 << 10, 8 << 20, 16 << 20
#: Tasks that read at most; more stretches than these share tasks.
MOST_TASKS = 100_000
INDEX = "page_id long, url string, record_type string, digest string, file string, offset long, length long"
RECORD = "page_id long, url string, html string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the response's header, which tells the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields; raises if its payload doesn't have the digest that its header tells."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *rows = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    field = {k.lower(): v for k, _, v in (r.partition(": ") for r in rows)}
    block = rest[: int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")))
    revisit = field["warc-type"] == "revisit"
    digest = field["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"record {field['warc-record-id']} is damaged")

    def number(x: str) -> int | None:
        x = x.removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x else None

    return {
        "page_id": number(field["warc-record-id"]), "url": field["warc-target-uri"], "html": None if revisit else payload.decode("utf-8"), "record_type": field["warc-type"],
        "payload_bytes": size, "payload_digest": digest, "refers_to": number(field["warc-refers-to"]) if revisit else None,
    }


def with_references(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """``(page_id, url, html, refers_to)``: the smallest page_id of equal payloads, on all pages but that one."""
    rows = bare(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    keyed = rows.withColumn("sha", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    groups = keyed.where(F.col("size") >= min_revisit_bytes).groupBy("sha", "size").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    total = rows.count()
    out = attach(keyed, groups.where("n > 1").hint("shuffle_hash"), ["sha", "size"], total, F.struct("page_id", "url"))
    return out.select("page_id", "url", "html", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Write ``(page_id, url, html, refers_to)`` as archives in ``folder``; the stored index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, out, at = "", None, 0
        try:
            for b in chunks(batches, 4 << 20):
                rows = []
                for r in b.to_pylist():
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    payload = (r["html"] or "").encode("utf-8", "surrogatepass")
                    url = r["url"] or ""
                    data = gzip.compress(record(r["page_id"], url, payload, r["refers_to"], date), level, mtime=0)
                    out.write(data)
                    rows.append((r["page_id"], url, "response" if r["refers_to"] is None else "revisit", sha1_base32(payload), name, at, len(data)))
                    at += len(data)
                    if at >= archive_bytes:
                        out.close()
                        out = None
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "url", "record_type", "digest", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return stored(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, INDEX))


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that the rows of ``index`` name, from their archives in ``folder``."""

    def fetch(fs, root: str, run: list[dict]) -> Iterator[dict]:
        with fs.open_input_file(f"{root}/{run[0]['file']}") as f:
            lo = run[0]["offset"]
            data = f.read_at(run[-1]["offset"] + run[-1]["length"] - lo, lo)
        for r in run:
            yield parse(gzip.decompress(data[r["offset"] - lo : r["offset"] - lo + r["length"]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        near: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if near and (r["file"] != near[0]["file"] or r["offset"] - near[-1]["offset"] - near[-1]["length"] > GAP or r["offset"] + r["length"] - near[0]["offset"] > READ):
                    yield pa.RecordBatch.from_pylist(list(fetch(fs, root, near)), schema)
                    near = []
                near.append(r)
        if near:
            yield pa.RecordBatch.from_pylist(list(fetch(fs, root, near)), schema)

    spans = index.select("file", "offset", "length", F.floor(F.col("offset") / SPAN).alias("span"))
    # the index is small beside the payloads: its bytes must not decide how many tasks read them
    parts = max(1, spans.select("file", "span").distinct().count())
    return spans.repartition(min(parts, MOST_TASKS), "file", "span").sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(run, RECORD)


def archived(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write all ``pages`` and read all records back."""
    folder = shared_folder(pages.sparkSession)
    return read(write(with_references(pages, min_revisit_bytes), folder), folder)


#: Base 32 of a SHA-1 (40 hexadecimal digits), five digits and four letters at a time.
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {at}, 5))::INT // {div}) % 32), 1)"
_BASE32 = " || ".join(_LETTER.format(at=5 * k + 1, div=d) for k in range(8) for d in (32768, 1024, 32, 1))
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
j AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, upper(sha1(html)) AS h, first FROM p JOIN g USING (html))
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM j
"""
