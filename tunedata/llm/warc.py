"""WARC archives with an index: write records, pick some, read them back by byte range.

Writing comes with the index: each task writes one archive file of compressed records and returns,
for each record, its file, offset, length, URL and digest. Only the files that the index names are
part of the archive, so what a lost or repeated task leaves behind is never read. Reading starts
from index rows: they are sorted by file and offset, ranges that touch or lie close together are
read at once, and each record is cut out of what was read.

Equal payloads are stored once. The record of the smallest page id is a response, the others are
revisits that refer to it; payloads below ``SMALL`` bytes are always stored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from tunedata.session import cut_lineage, scratch_path

SMALL = 100
#: Bytes between two ranges that are read along rather than skipped, and the most read at once (one record may be longer).
GAP, READ = 64 << 10, 8 << 20
#: Rows an index partition is read in.
RECORDS = 4000
#: Most tasks of a reading; beyond, each reads more records, one file after the other.
MOST_PARTS = 20_000
DATE = "2000-01-01T00:00:00Z"


def resolve_revisits(pages: DataFrame) -> DataFrame:
    """Adds payload_bytes, payload_digest, record_type and refers_to to (page_id, url, html).

    A null html is an empty payload. Rows that repeat the smallest page id of a payload are all
    responses; a null page id is always one, and is never referred to.
    """
    body = F.coalesce("html", F.lit(""))
    known = pages.withColumn("payload_bytes", F.octet_length(body).cast("long")).withColumn("payload_digest", F.sha2(body, 256))
    first = known.filter((F.col("payload_bytes") >= SMALL) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = known.join(first, "payload_digest", "left")
    repeated = F.coalesce((F.col("page_id") != F.col("first")) & (F.col("payload_bytes") >= SMALL), F.lit(False))
    return joined.withColumn("record_type", F.when(repeated, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(repeated, F.col("first"))).drop("first")


def _identifier(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _record(row) -> bytes:
    revisit = row.record_type == "revisit"
    payload = b"" if revisit else (row.html or "").encode("utf-8", "replace")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
    url = "".join(c for c in (row.url or "about:blank") if c not in "\r\n")
    head = [
        "WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Target-URI: {url}", f"WARC-Date: {DATE}",
        f"WARC-Record-ID: {_identifier(row.page_id, row.payload_digest)}", f"WARC-Payload-Digest: sha256:{row.payload_digest}",
        f"X-Page-ID: {row.page_id or ''}", f"X-Payload-Length: {row.payload_bytes}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}",
    ]
    if revisit:
        head[5:5] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_identifier(row.refers_to, row.payload_digest)}", f"X-Refers-To-Page-ID: {row.refers_to}",
        ]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def _packed(data: bytes) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, html) as archives below ``folder`` and return the index.

    The index is itself a written table: (file, offset, length, page_id, url, digest, record_type,
    refers_to), one row per record. Page ids are whole numbers; others are cast to long. ``folder`` must be one that all executors reach. An empty table
    gives an empty index.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, offset, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                out = out or store.open_output_stream(f"{base}/{name}", compression=None)
                places = []
                for row in batch.itertuples(index=False):
                    data = _packed(_record(row))
                    out.write(data)
                    places.append((offset, len(data)))
                    offset += len(data)
                index = batch.drop(columns=["html", "payload_bytes"]).rename(columns={"payload_digest": "digest"})
                yield index.assign(file=name, offset=[p[0] for p in places], length=[p[1] for p in places])
        finally:
            if out:
                out.close()

    # Nullable whole numbers would be floats in pandas, so ids pass as strings.
    columns = "page_id string, url string, digest string, record_type string, refers_to string, file string, offset long, length long"
    ids = {name: F.col(name).cast("long") for name in ("page_id", "refers_to")}
    given = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    ready = resolve_revisits(given).select("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")
    texts = ready.withColumns({name: F.col(name).cast("string") for name in ids})
    return cut_lineage(texts.mapInPandas(write, columns).withColumns(ids))


def _records(data: bytes) -> tuple[dict[str, str], bytes]:
    text = zlib.decompress(data, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])}
    block = rest[:int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[tuple[int, int, list[int]]]:
    """Reads (offset, end, numbers of the ranges in it) that cover sorted (offset, length) ranges."""
    reads: list[tuple[int, int, list[int]]] = []
    for n, (offset, length) in enumerate(ranges):
        if reads and offset - reads[-1][1] <= gap and max(reads[-1][1], offset + length) - reads[-1][0] <= most:
            begin, end, numbers = reads.pop()
            numbers.append(n)
            reads.append((begin, max(end, offset + length), numbers))
        else:
            reads.append((offset, offset + length, [n]))
    return reads


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the given index rows: (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload).

    All but the file, offset and length is taken from the archives. A revisit has a null payload, and
    its payload_bytes and payload_digest are those of the page it repeats. A payload that does not
    agree with its digest raises an error.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = []
            for name, part in batch.sort_values(["file", "offset"]).groupby("file"):
                ranges = list(zip(part["offset"].tolist(), part["length"].tolist()))
                with store.open_input_file(f"{base}/{name}") as source:
                    for begin, end, numbers in coalesced(ranges):
                        data = source.read_at(end - begin, begin)
                        for n in numbers:
                            offset, length = ranges[n]
                            fields, payload = _records(data[offset - begin:offset - begin + length])
                            digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
                            if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"damaged record in {name} at {offset}")
                            refers = fields.get("x-refers-to-page-id")
                            rows.append((
                                int(fields["x-page-id"]) if fields["x-page-id"] else None, fields["warc-target-uri"], kind,
                                int(refers) if refers else None, int(fields["x-payload-length"]), digest,
                                payload.decode("utf-8") if kind == "response" else None))
            out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"], dtype=object)
            yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    wanted = index.select("file", "offset", "length")
    parts = min(max(1, -(-wanted.count() // RECORDS)), MOST_PARTS)
    ordered = wanted.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInPandas(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string")


def archive(pages: DataFrame) -> tuple[DataFrame, str]:
    """Write all pages below the shared folder; the index and the archives' folder."""
    folder = scratch_path(pages.sparkSession, "warc")
    return write_archives(pages, folder), folder


def archive_sql(pages: str) -> str:
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM {pages}),
f AS (SELECT *, CASE WHEN payload_bytes >= {SMALL} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
