"""WARC archives with revisit records for repeated payloads.

Pages become WARC/1.1 response records, written as archives of bounded size. Reading them back gives
headers; these (never the payloads) are shuffled by payload digest, every later record of an equal payload
of at least ``least`` bytes is joined with the original, and deduplicated archives are written with fresh
headers: a revisit keeps its headers and names the original, its payload is gone.

Spark's text writer places the files, so they come complete or not at all and lie wherever Spark can
write. One row is one run of records of about ``CHUNK_BYTES`` and one file; ``gzip`` packs a file as a
whole. The original is the record with the smallest id; rows with equal ids and payloads take turns by
record number.

Defined results: a null payload is empty. A null id stays null and sorts last. A null url gives no
WARC-Target-URI. Rows of equal id are records of their own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.session import scratch_path

LEAST_BYTES = 100
CHUNK_BYTES = 16 << 20
VERSION = "WARC/1.1"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("record_id string, record_number long, page_id long, url string, record_type string, payload_bytes long, "
          "payload_digest string, refers_to long, refers_to_record string")


def one_line(url: str) -> str:
    """A header value cannot hold line ends: they are percent-encoded."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(record_id: str, number: int, page_id: int | None, url: str | None, digest: str, size: int,
                 payload: bytes | None, refers_to: tuple[str, int | None] | None = None) -> bytes:
    """One record without its last line feed; a revisit holds the HTTP head alone."""
    head = HTTP_HEAD.format(size).encode()
    block = head if refers_to else head + payload
    lines = [VERSION, f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>",
             "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {one_line(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to[0]}>"]
        lines += [f"X-Refers-To-Page: {refers_to[1]}"] if refers_to[1] is not None else []
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += [f"X-Record-Number: {number}", f"X-Payload-Length: {size}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r"


def in_chunks(records: Iterator[bytes], limit: int) -> Iterator[pd.DataFrame]:
    """Rows of joined records; the writer ends each row with the line feed that ends its last record."""
    run, size = [], 0
    for record in records:
        run.append(record)
        size += len(record)
        if size >= limit:
            yield pd.DataFrame({"value": [b"\n".join(run)]})
            run, size = [], 0
    if run:
        yield pd.DataFrame({"value": [b"\n".join(run)]})


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an unpacked archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        yield fields, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def unpacked(content: bytes) -> bytes:
    return zlib.decompress(content, 47) if content[:2] == b"\x1f\x8b" else content


def number(text: str | None) -> int | None:
    return None if text is None else int(text)


def header_row(fields: dict[str, str], block: bytes) -> tuple:
    """One row of RECORD; digest and length of a response come from the payload itself."""
    kind = fields["WARC-Type"]
    digest, size = fields["WARC-Payload-Digest"].partition(":")[2], int(fields["X-Payload-Length"])
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4:]
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
    refers = fields.get("WARC-Refers-To")
    return (fields["WARC-Record-ID"][1:-1], int(fields["X-Record-Number"]), number(fields.get("X-Page-ID")),
            fields.get("WARC-Target-URI"), kind, size, digest, number(fields.get("X-Refers-To-Page")),
            refers[1:-1] if refers else None)


NAMES = [f.split()[0] for f in RECORD.split(", ")]


def save_archives(rows: DataFrame, path: str, compression: str) -> None:
    """Rows of joined records as files, one row each."""
    (rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n")
     .option("maxRecordsPerFile", 1).option("compression", compression)
     .option("zlib.compress.level", "BEST_SPEED").text(path))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
                   compression: str = "gzip", chunk_bytes: int = CHUNK_BYTES) -> None:
    """A response record for every row."""
    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each() -> Iterator[bytes]:
            task, count = TaskContext.get().partitionId(), 0
            for batch in batches:
                for page_id, target, text in zip(batch["page_id"], batch["url"], batch["payload"]):
                    body = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                    yield record_bytes(f"urn:record:{task}-{count}", (task << 40) + count,
                                       None if pd.isna(page_id) else int(page_id),
                                       target if isinstance(target, str) else None,
                                       hashlib.sha256(body).hexdigest(), len(body), body)
                    count += 1
        yield from in_chunks(each(), chunk_bytes)

    # Ids travel as text: a null among integers would make pandas turn them all into floats.
    rows = pages.select(F.col(key).cast("string").alias("page_id"), F.col(url).alias("url"),
                        F.col(payload).alias("payload"))
    save_archives(rows.mapInPandas(records, "value binary"), path, compression)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row of RECORD per archived record."""
    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = [header_row(*r) for r in parse(unpacked(content))]
                out = pd.DataFrame(rows, columns=NAMES)
                for name in ("page_id", "refers_to"):
                    out[name] = out[name].astype("Int64")
                yield out

    return archives(spark, path).mapInPandas(headers, RECORD)


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def revisits(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """record_id, refers_to_record, refers_to of the records that repeat an original's payload."""
    long_enough = headers.where(F.col("payload_bytes") >= least)
    originals = (
        long_enough.groupBy("payload_digest", "payload_bytes")
        .agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id",
                                                     "record_number", "record_id")).alias("first"))
        .where("n > 1").select("payload_digest", "payload_bytes", "first")
    )
    return (
        long_enough.join(originals, ["payload_digest", "payload_bytes"])
        .where(F.col("record_id") != F.col("first.record_id"))
        .select("record_id", F.col("first.record_id").alias("refers_to_record"), F.col("first.page_id").alias("refers_to"))
    )


def deduplicate(spark: SparkSession, source: str, target: str, least: int = LEAST_BYTES,
                compression: str = "gzip", chunk_bytes: int = CHUNK_BYTES) -> None:
    """Archives at ``target`` with revisit records in place of the repeated payloads at ``source``."""
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = [(*header_row(f, b)[:7], zlib.compress(b[b.index(b"\r\n\r\n") + 4:], 1))
                        for f, b in parse(unpacked(content))]
                out = pd.DataFrame(rows, columns=[*NAMES[:7], "packed"])
                out["page_id"] = out["page_id"].astype("Int64").astype("string")
                yield out

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each() -> Iterator[bytes]:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    own = None if pd.isna(r.page_id) else int(r.page_id)
                    first = (r.refers_to_record, None if pd.isna(r.refers_to) else int(r.refers_to))
                    yield record_bytes(
                        r.record_id, r.record_number, own, r.url if isinstance(r.url, str) else None,
                        r.payload_digest, r.payload_bytes, zlib.decompress(r.packed),
                        first if isinstance(r.refers_to_record, str) else None)
        yield from in_chunks(each(), chunk_bytes)

    again = revisits(read_headers(spark, source), least)
    schema = RECORD.split(", refers_to")[0].replace("page_id long", "page_id string") + ", packed binary"
    joined = archives(spark, source).mapInPandas(blocks, schema).join(
        again.select("record_id", "refers_to_record", F.col("refers_to").cast("string").alias("refers_to")),
        "record_id", "left")
    save_archives(joined.mapInPandas(records, "value binary"), target, compression)


def archive_pages(pages: DataFrame, least: int = LEAST_BYTES, folder: str | None = None, key: str = "page_id",
                  url: str = "url", payload: str = "html") -> DataFrame:
    """Writes plain and deduplicated archives below ``folder`` and returns the headers of the latter."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    write_archives(pages, f"{folder}/plain", key, url, payload)
    deduplicate(spark, f"{folder}/plain", f"{folder}/deduplicated", least)
    return read_headers(spark, f"{folder}/deduplicated")
