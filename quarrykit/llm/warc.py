"""WARC archives: monolithic gzip files rewritten as one member a record, with a sidecar offset index."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm.common import new_path, stored, utf8

#: Inflated bytes after which a task begins another archive.
ARCHIVE_BYTES = 128 * 2**20
LEVEL = 6
#: Deflated bytes that an archive's reader takes in at a time.
STEP = 2**18
BROADCAST_ROWS = 100_000
DATE = "2024-01-01T00:00:00Z"
MEMBERS = "archive string, ordinal long, member binary"
RECORDS = "archive string, ordinal long, offset long, length long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    value = (urn or "")[len("<urn:x-page:") : -1]
    return int(value) if value not in ("", "null") else None


def _clean(url: str | None) -> str:
    """A URL in one header line: white space and controls become percent codes."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in utf8(c)) for c in url or "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has no payload, but its digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {page_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {page_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    end = record.index(b"\r\n\r\n")
    headers = _headers(record[:end].partition(b"\r\n")[2])
    return headers, record[end + 4 : end + 4 + int(headers["content-length"])]


def inflate(data: bytes) -> Iterator[bytes]:
    """Inflated pieces of a gzip stream of any number of members, read once from front to back."""
    view, at, reader = memoryview(data), 0, zlib.decompressobj(31)
    while at < len(view):
        piece = reader.decompress(view[at : at + STEP])
        at = min(at + STEP, len(view))
        if piece:
            yield piece
        if reader.eof:
            at -= len(reader.unused_data)
            reader = zlib.decompressobj(31)


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream, by their content lengths; one record is held at a time."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(_headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends inside a record")


def member_of(record: bytes) -> bytes:
    """The record as a gzip member that ends in a zero byte (the top byte of its size), which ``write_binary`` counts on.

    Records of 16 MiB and more may end otherwise; they get an empty member behind them.
    """
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    member = packer.compress(record) + packer.flush()
    return member if member[-1] == 0 else member + gzip_empty()


def gzip_empty() -> bytes:
    return zlib.compressobj(LEVEL, zlib.DEFLATED, 31).flush()


def write_binary(rows: DataFrame, path: str) -> None:
    """Writes rows (``archive``, ``ordinal``, ``member``) as files of concatenated members, a folder for each archive. Rows of one archive
    must be in one partition, so that it becomes one file.

    Spark's text sink puts raw bytes on any store that Spark reaches and commits them task by task. It ends each
    row with a separator, here the zero byte that each member ends in.
    """
    bare = rows.select("archive", "ordinal", F.expr("CAST(substring(member, 1, length(member) - 1) AS STRING)").alias("value"))
    bare.sortWithinPartitions("archive", "ordinal").select("archive", "value").write.partitionBy("archive").option("lineSep", "\x00").option("compression", "none").option("maxRecordsPerFile", 0).text(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Archives written by ``write_binary``: ``archive`` and ``content``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", r"archive=([^/]+)", 1).alias("archive"), "content")


def decide(pages: DataFrame) -> DataFrame:
    """Adds ``refers_to`` and ``revisit`` to pages (``page_id``, ``url``, ``html``): of equal payloads the largest id is the response.

    Pages with equal ids and payloads are one page and keep one type. Null ids are smaller than all others; if a
    payload has no other, all its pages are responses. Payloads are compared by SHA-1, lengths with them.
    Only payloads that occur more than once get a row in the joined table; it is broadcast if it has at most
    ``BROADCAST_ROWS`` rows, and is else joined by a shuffle, where adaptive execution splits a hot payload.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.unhex(F.sha1(payload)).alias("_sha1"), F.octet_length(payload).alias("_n"))
    groups = keyed.groupBy("_sha1", "_n").agg(F.max("page_id").alias("_response"), F.count("*").alias("_rows"))
    groups = stored(groups.where("_rows > 1 AND _response IS NOT NULL").drop("_rows"), "payloads")
    found = keyed.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, ["_sha1", "_n"], "left")
    revisit = F.col("_response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_response"))
    return found.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("_response")).alias("refers_to"))


def write_monolithic(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes decided pages as WARC archives that are one gzip member each, of about ``archive_bytes`` inflated."""
    from pyspark import TaskContext

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k, held, size, packer = TaskContext.get().partitionId(), 0, [], 0, None

        def out() -> pd.DataFrame:
            whole = b"".join([*held, packer.flush()])
            whole += b"" if whole[-1] == 0 else gzip_empty()
            return pd.DataFrame({"archive": [f"{part:06d}-{k:04d}"], "ordinal": [0], "member": [whole]})

        for batch in batches:
            for page_id, url, html, revisit, refers_to in zip(*(batch[c].array for c in ("page_id", "url", "html", "revisit", "refers_to")), strict=True):
                packer = packer or zlib.compressobj(1, zlib.DEFLATED, 31)
                record = record_bytes(_int(page_id), url, utf8(html), _int(refers_to), bool(revisit))
                held.append(packer.compress(record))
                size += len(record)
                if size >= archive_bytes:
                    yield out()
                    k, held, size, packer = k + 1, [], 0, None
        if packer:
            yield out()

    write_binary(pages.mapInPandas(write, "archive string, ordinal long, member binary"), path)


def _int(value: object) -> int | None:
    return None if pd.isna(value) else int(value)


def normalise(archives: DataFrame) -> DataFrame:
    """Every record of the archives (``archive``, ``content``) as its own gzip member (``MEMBERS``), in one partition for each archive.

    A whole file is inflated once, front to back. Files of many members, empty members among them, are taken as well; an empty file
    has no records. A file that ends inside a record raises. One file must be below 2 GB, as rows of Spark's
    ``binaryFile`` are.
    """

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch.archive, batch.content, strict=True):
                rows, held = [], 0
                for k, record in enumerate(split_records(inflate(content))):
                    member = member_of(record)
                    rows.append((archive, k, member))
                    held += len(member)
                    if held >= 2**22:
                        yield pd.DataFrame(rows, columns=_names(MEMBERS))
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=_names(MEMBERS))

    return archives.mapInPandas(rewrite, MEMBERS)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(",")]


def read_records(archives: DataFrame) -> DataFrame:
    """Reads normalised archives member by member (``RECORDS``): what each record says, and its place in the file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch.archive, batch.content, strict=True):
                rows, view, at = [], memoryview(content), 0
                while at < len(view):
                    reader = zlib.decompressobj(31)
                    record, end = [], at
                    while not reader.eof:
                        record.append(reader.decompress(view[end : end + STEP]))
                        end = min(end + STEP, len(view))
                    end -= len(reader.unused_data)
                    record = b"".join(record)
                    if record:
                        headers, block = parse_record(record)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit = headers["warc-type"] == "revisit"
                        n = int(_headers(http)["content-length"])
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and (len(payload) != n or digest_of(payload) != digest):
                            raise ValueError(f"{archive} at {at}: the payload differs from its digest")
                        rows.append((archive, len(rows), at, end - at, page_of(headers["warc-record-id"]), n, digest, headers["warc-type"], page_of(headers.get("warc-refers-to"))))
                    elif rows:  # an empty member belongs to the one before it
                        rows[-1] = (*rows[-1][:3], rows[-1][3] + end - at, *rows[-1][4:])
                    at = end
                out = pd.DataFrame(rows, columns=_names(RECORDS))
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return archives.mapInPandas(read, RECORDS)


def read_at(content: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the one record at a place that the index names."""
    return parse_record(b"".join(inflate(content[offset : offset + length])))


def archive_pages(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, str]:
    """Writes pages as archives with a member a record under ``path``; returns the paths of the archives and of their index.

    Monolithic archives are written first (what a crawler that compresses whole files leaves), then normalised.
    The index is a Parquet table (``RECORDS``) of what the written files hold, record by record: ``archive``, ``ordinal``, ``offset``, ``length`` and
    what the record says of its page. Null html has an empty payload; an empty table gives no archives.
    """
    spark = pages.sparkSession
    write_monolithic(decide(pages), f"{path}/monolithic", archive_bytes)
    # a file is read, normalised and written in one task; nothing between them deals its members anew
    write_binary(normalise(read_binary(spark, f"{path}/monolithic")), f"{path}/archives")
    read_records(read_binary(spark, f"{path}/archives")).write.parquet(f"{path}/index")
    return f"{path}/archives", f"{path}/index"


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back: the index of their records (``RECORDS``)."""
    spark = pages.sparkSession
    _, index = archive_pages(pages, new_path(spark, "warc"))
    return spark.read.schema(RECORDS).parquet(index)
