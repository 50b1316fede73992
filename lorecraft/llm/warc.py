"""WARC archives with a two-level capture index.

Tasks write gzip-member WARC files into the shared store and return where each record lies.
Index lines are sorted by the reversed-host key of the URL (a range partition each), packed
into compressed blocks, and a sparse directory holds the first key of every block. A lookup
goes to its partition of the index, binary-searches the directory for the block, the block
for the line, and reads that range of the archive.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, stored

#: Payloads below this size are always written in full.
MIN_REVISIT_BYTES = 100
#: Index lines of a compressed block; records that end an archive file; index lines of a partition.
BLOCK_LINES, FILE_BYTES, PART_LINES = 1000, 1 << 30, 500_000
#: Bytes of records that a task of a lookup reads back.
LOOKUP_BYTES = 8 << 20
#: Adjacent ranges of a store that one read fetches.
READ_AHEAD = 1 << 20
LEVEL = 4


def surt(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then path and query; without scheme, `www.` and fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return ")" + url.strip().lower()
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) if host else ""
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def store_of(uri: str):
    """(file system, path) of a URI, for any store that pyarrow knows; executors and driver share it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def record_bytes(page_id: int | None, url: str | None, kind: str, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit keeps the HTTP header and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Target-URI: {(url or '').encode('ascii', 'backslashreplace').decode().replace(chr(13), '').replace(chr(10), '')}", "WARC-Date: 2024-01-31T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse_record(member: bytes) -> dict:
    """Headers and payload of a gzip member, with the payload's size and digest worked out again for a response."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    out = {"page_id": h["X-Page-ID"], "url": h["WARC-Target-URI"], "type": h["WARC-Type"], "size": size, "digest": h["WARC-Payload-Digest"].removeprefix("sha256:"), "refers_to": h.get("X-Refers-To-Page"), "payload": payload}
    if out["type"] == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != out["digest"]:
            raise ValueError(f"record of page {out['page_id']} is damaged")
    return out


@dataclass
class Archive:
    """captures(key, page_id, file, offset, length, ...), the URI of the index and the first key of each of its partitions."""

    captures: DataFrame
    index: str
    bounds: list[tuple[str, int]]


def classified(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(page_id, url, payload, size, digest, record_type, refers_to): of equal payloads the smallest id is the response."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    narrow = stored(rows.select("page_id", "size", "digest"), "digests")
    groups = narrow.filter((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # the written table has a known size: Spark sends it to the rows where it is small, and else cuts hot digests as it joins
    told = rows.join(stored(groups, "repeats"), "digest", "left")
    again = F.col("first_id").isNotNull() & (F.col("page_id") != F.col("first_id"))
    return told.select(
        "page_id", "url", F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "size", "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"),
    )


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> Archive:
    """Archives, capture index and directory of pages, in the shared store.

    Equal payloads of min_bytes bytes or more are written once, with the smallest id, and
    revisited by the others; smaller ones are always written. A null html is an empty
    payload, a null url an empty key, a null id a record that nothing refers to. Repeated
    rows are records of their own. Other columns are not read. An empty table gives an
    archive without records. A task that is run again writes new files, and the index names
    those of the run whose rows Spark committed.
    """
    spark = pages.sparkSession
    base = fresh_path(spark, "warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = store_of(base)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for pdf in batches:
                lines = []
                for r in pdf.itertuples(index=False):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    page_id = None if pd.isna(r.page_id) else int(r.page_id)
                    member = record_bytes(page_id, r.url, r.record_type, bytes(r.payload), int(r.size), r.digest, None if pd.isna(r.refers_to) else int(r.refers_to))
                    out.write(member)
                    lines.append((surt(r.url), page_id, name, at, len(member)))
                    at += len(member)
                yield pd.DataFrame(lines, columns=["key", "page_id", "file", "offset", "length"]).astype({"page_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    captures = stored(classified(pages, id_col, url_col, html_col, min_bytes).mapInPandas(write, "key string, page_id long, file string, offset long, length long"), "captures")
    index, bounds = write_index(captures, base)
    return Archive(captures, index, bounds)


def sort_id(c: str = "page_id"):
    return F.coalesce(F.col(c), F.lit(-(2**63)))


def write_index(captures: DataFrame, base: str) -> tuple[str, list[tuple[str, int]]]:
    """Writes the sorted lines as compressed blocks, one file for each range partition, with its directory beside it.

    Returns the URI and, for every partition, its first (key, id): one entry for PART_LINES captures.
    """
    parts = max(1, -(-captures.count() // PART_LINES))
    lines = captures.withColumn("sort_id", sort_id())
    dealt = lines.repartitionByRange(parts, "key", "sort_id").sortWithinPartitions("key", "sort_id", "file", "offset")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = store_of(base)
        name = uuid.uuid4().hex
        out, held, directory, at = None, [], [], 0

        def block() -> None:
            nonlocal at
            data = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), LEVEL)
            directory.append((held[0][0], held[0][1], at, len(data)))
            out.write(data)
            at += len(data)
            held.clear()

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                out = out or store.open_output_stream(f"{root}/{name}.cdx", compression=None)
                held.append([r.key, int(r.sort_id), r.file, int(r.offset), int(r.length)])
                if len(held) == BLOCK_LINES:
                    block()
        if held:
            block()
        if directory:
            out.close()
            with store.open_output_stream(f"{root}/{name}.dir", compression=None) as f:
                f.write(zlib.compress(json.dumps(directory).encode(), LEVEL))
            yield pd.DataFrame([(directory[0][0], directory[0][1], name, len(directory))], columns=["key", "sort_id", "name", "blocks"])

    told = stored(dealt.mapInPandas(write, "key string, sort_id long, name string, blocks long"), "directory")
    rows = sorted((r["key"], r["sort_id"], r["name"]) for r in told.collect())  # a row for each partition
    return base, [tuple(r) for r in rows]


class Ranges:
    """Range reads of one store, fetched READ_AHEAD at a time as lookups come in order."""

    def __init__(self, uri: str):
        self.store, self.root = store_of(uri)
        self.files: dict = {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        f, start, data = self.files.get(name, (None, 0, b""))
        if f is None:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files)))[0].close()
            f = self.store.open_input_file(f"{self.root}/{name}")
        if not start <= offset or offset + length > start + len(data):
            start, data = offset, f.read_at(max(length, min(READ_AHEAD, f.size() - offset)), offset)
        self.files[name] = (f, start, data)
        return data[offset - start : offset - start + length]


def lookup(archive: Archive, wanted: DataFrame, id_col: str = "page_id", url_col: str = "url", payloads: bool = False) -> DataFrame:
    """Every capture of the rows of wanted(id_col, url_col), read back from the archives.

    (page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]). Rows are
    dealt to the partition of the index that holds their key and come sorted, so directory,
    blocks and archives are read in order. Repeated rows are looked up once and give all
    captures; a row without a capture gives none.
    """
    base, bounds = archive.index, archive.bounds
    firsts = [(k, i) for k, i, _ in bounds]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [surt(u) for u in pdf["url"]]
            part = [max(0, bisect.bisect_right(firsts, (k, i)) - 1) for k, i in zip(keys, pdf["sort_id"])]
            # captures of one key may begin in the partition before
            part = [p - (p > 0 and firsts[p] == (k, i)) for p, k, i in zip(part, keys, pdf["sort_id"])]
            yield pd.DataFrame({"part": part, "key": keys, "sort_id": pdf["sort_id"]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges, part, heads, directory, block, lines = Ranges(base), None, [], [], None, []
        for pdf in batches:
            out = []
            for p, key, sort_id in zip(pdf["part"], pdf["key"], pdf["sort_id"]):
                want = (key, int(sort_id))
                while p < len(bounds):
                    if p != part:
                        with ranges.store.open_input_file(f"{ranges.root}/{bounds[p][2]}.dir") as f:
                            directory = json.loads(zlib.decompress(f.read()))
                        part, heads, block = p, [(d[0], d[1]) for d in directory], None
                    # the last block that begins before the key, then on as long as it matches
                    b, more = max(0, bisect.bisect_left(heads, want) - 1), True
                    while b < len(heads) and more:
                        if block != b:
                            data = ranges.read(f"{bounds[p][2]}.cdx", directory[b][2], directory[b][3])
                            block, lines = b, [json.loads(x) for x in zlib.decompress(data).split(b"\n")]
                        i = bisect.bisect_left(lines, [*want])
                        while i < len(lines) and (lines[i][0], lines[i][1]) == want:
                            out.append(parse_record(ranges.read(*lines[i][2:])))
                            i += 1
                        more = i == len(lines)
                        b += 1
                    if not more or p + 1 == len(bounds) or firsts[p + 1] > want:
                        break
                    p += 1
            yield pd.DataFrame(
                {
                    "page_id": pd.array([int(x["page_id"]) if x["page_id"] else None for x in out], "Int64"),
                    "url": [x["url"] for x in out], "record_type": [x["type"] for x in out],
                    "payload_bytes": [x["size"] for x in out], "payload_digest": [x["digest"] for x in out],
                    "refers_to": pd.array([int(x["refers_to"]) if x["refers_to"] else None for x in out], "Int64"),
                    **({"payload": [x["payload"] for x in out]} if payloads else {}),
                }
            )

    spark: SparkSession = wanted.sparkSession
    shape = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + (", payload binary" if payloads else "")
    if not bounds:
        return spark.createDataFrame([], shape)
    rows = wanted.select(F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("sort_id"))
    routed = rows.mapInPandas(route, "part int, key string, sort_id long").distinct()
    # rows are short, but each one fetches a record: partitions are counted by what they read
    held = archive.captures.agg(F.coalesce(F.avg("length"), F.lit(0.0))).first()[0]
    parts = max(1, math.ceil(wanted.count() * held / LOOKUP_BYTES))
    return routed.repartitionByRange(parts, "part", "key", "sort_id").sortWithinPartitions("part", "key", "sort_id").mapInPandas(read, shape)


def op8_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archive = write_archive(pages)
    return lookup(archive, pages.select("page_id", "url")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN g.first_id < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.first_id < p.page_id THEN g.first_id END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 100
"""
