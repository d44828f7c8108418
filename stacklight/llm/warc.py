"""WARC archives: one gzip member per record, written and read by Spark tasks.

Writing: payloads are digested natively and grouped by digest with map-side partial
aggregation. Of equal payloads of at least REVISIT_BYTES bytes the smallest page_id writes
a response record; the others write revisit records that refer to it and carry no payload.
The groups are broadcast behind a count of them, so that payloads stay where they are read;
only beyond it are both sides shuffled. A record's identifier is its page_id and the number of
its row, so no two records share one. Each task packs its records into archives of bounded
size. An archive is a row (archive, content) of a Parquet table in the shared folder;
``export`` writes such rows as .warc.gz files through Hadoop's file systems, and ``read_files``
reads .warc.gz files from any store.

Reading is sequential: bytes go piece by piece through an incremental zlib decompressor,
which ends at each member; the record header gives the block's length; the payload is
digested as it passes and checked against the header.

Defined results: a null payload is an empty payload; a null url is written as
"urn:none"; rows that repeat a page_id are written each, and of equal payloads all rows of the
smallest page_id are responses, the rest revisit one of them; a null page_id is written too and ranks after every other id; control
characters in a url are percent-encoded; other columns are ignored. A damaged record raises.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.llm.common import kept, utf8

REVISIT_BYTES, ARCHIVE_BYTES, PIECE = 100, 8 << 20, 64 << 10
#: Groups of equal payloads (some 120 bytes each) that may be broadcast.
BROADCAST_GROUPS = 200_000
DATE = "2024-01-01T00:00:00Z"
_URN = "urn:page:"


def _header(fields: list[tuple[str, str]], first: str) -> bytes:
    return ("\r\n".join([first, *(f"{k}: {v}" for k, v in fields)]) + "\r\n\r\n").encode("utf-8")


def _name(page_id: int | None, row: int) -> str:
    return f"<{_URN}{'' if page_id is None else page_id}:{row}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, row: int = 0, refers_row: int = 0) -> bytes:
    """One gzip member with one record; row and refers_row tell records of one page_id apart."""
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http if revisit else http + payload
    target = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else "urn:none"
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id, row)), ("WARC-Date", DATE), ("WARC-Target-URI", target)]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name(refers_to, refers_row))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(_header(fields, "WARC/1.1")) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes
    payload_digest: str
    payload_bytes: int

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    def page(self, name: str) -> int | None:
        value = self.headers.get(name, "").strip("<>").removeprefix(_URN).partition(":")[0]
        return int(value) if value else None


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def members(pieces: Iterable[bytes]) -> Iterator[Iterator[bytes]]:
    """For each gzip member of a stream of compressed pieces, an iterator over its decompressed pieces, each of bounded size."""
    source, rest = iter(pieces), b""
    while True:
        while not rest:
            rest = next(source, None)
            if rest is None:
                return
        unpack = zlib.decompressobj(31)

        def inside(unpack=unpack) -> Iterator[bytes]:
            nonlocal rest
            data = rest
            while not unpack.eof:
                if not data:
                    data = next(source, None)
                    if data is None:
                        raise ValueError("the archive ends inside a record")
                yield unpack.decompress(data, PIECE)
                data = unpack.unconsumed_tail
            rest = unpack.unused_data

        yield inside()


def records(pieces: Iterable[bytes], keep_payload: bool = True) -> Iterator[Record]:
    """The records of an archive, in order, each checked against its length and digests. Without keep_payload a record's payload is only digested."""
    for member in members(pieces):
        head = b""
        while b"\r\n\r\n" not in head:
            part = next(member, None)
            if part is None:
                raise ValueError("a record ends in its header")
            head += part
        head, _, rest = head.partition(b"\r\n\r\n")
        headers = _fields(head)
        left = int(headers["content-length"])
        block_digest, digest = hashlib.sha256(), hashlib.sha256()
        http, kept_parts, size, open_head, tail = {}, [], 0, b"", b""
        reading_head = True
        parts = iter([rest])
        while (part := next(parts, None)) is not None or (part := next(member, None)) is not None:
            own, over = part[:left], part[left:]
            left -= len(own)
            tail += over
            block_digest.update(own)
            if reading_head:
                open_head += own
                if b"\r\n\r\n" not in open_head:
                    continue
                first, _, own = open_head.partition(b"\r\n\r\n")
                http, reading_head = _fields(first), False
            digest.update(own)
            size += len(own)
            if keep_payload:
                kept_parts.append(own)
        if left or tail != b"\r\n\r\n":
            raise ValueError(f"a record's block doesn't have its {headers['content-length']} bytes")
        if headers.get("warc-block-digest", want := f"sha256:{block_digest.hexdigest()}") != want:
            raise ValueError("a record's block doesn't have its digest")
        named = headers.get("warc-payload-digest", "").removeprefix("sha256:")
        if headers["warc-type"] == "revisit":
            size, found = int(http.get("content-length", 0)), named
        elif (found := digest.hexdigest()) != (named or found):
            raise ValueError("a record's payload doesn't have its digest")
        yield Record(headers, http, b"".join(kept_parts), found, size)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives of about ARCHIVE_BYTES; one whole record at least."""
    parts: list[bytes] = []
    size = count = 0

    def out() -> pa.RecordBatch:
        content = b"".join(parts)
        name = hashlib.sha256(content).hexdigest()[:24] + ".warc.gz"
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([content], pa.binary())], ["archive", "n_records", "content"])

    for batch in batches:
        for i in range(batch.num_rows):
            page_id, url, body, digest, refers_to, revisit, row, refers_row = (c[i].as_py() for c in batch.columns)
            parts.append(record(page_id, url, body or b"", digest, refers_to, revisit, row, refers_row or 0))
            size, count = size + len(parts[-1]), count + 1
            if size >= ARCHIVE_BYTES:
                yield out()
                parts.clear()
                size = count = 0
    if parts:
        yield out()


def archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """archive, n_records, content: the pages as WARC archives."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), utf8(payload_col).alias("body"))
    rows = rows.withColumns({"digest": F.sha2("body", 256), "size": F.length("body"), "row": F.monotonically_increasing_id()})
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row"))
    groups = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    groups = kept(groups.where("n > 1 and first.page_id is not null").select("digest", "size", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row")))
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    # Joined by two columns, so that where both sides are shuffled, a payload that many pages share can be split.
    both = rows.join(F.broadcast(groups) if few else groups, ["digest", "size"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    both = both.select("page_id", "url", "body", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"), "row", F.when(revisit, F.col("first_row")).alias("refers_row"))
    return both.mapInArrow(_packed, "archive string, n_records bigint, content binary")


def export(archive_rows: DataFrame, folder: str) -> int:
    """Write each archive as a .warc.gz file into a folder of any store that Hadoop knows; the number of files.

    The driver streams one archive at a time, of about ARCHIVE_BYTES; a file that is there
    already is written anew, so that a second call after a loss ends in the same state.
    """
    spark = archive_rows.sparkSession
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for row in archive_rows.select("archive", "content").toLocalIterator():
        place = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{row['archive']}")
        out = place.getFileSystem(conf).create(place, True)
        try:
            out.write(bytes(row["content"]))
        finally:
            out.close()
        n += 1
    return n


_RECORDS = "page_id bigint, target_uri string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            view = memoryview(content.as_buffer())
            pieces = (bytes(view[at : at + PIECE]) for at in range(0, len(view), PIECE))
            rows = [(r.page("warc-record-id"), r.headers.get("warc-target-uri"), r.payload_bytes, r.payload_digest, r.kind, r.page("warc-refers-to")) for r in records(pieces, keep_payload=False)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read(archive_rows: DataFrame) -> DataFrame:
    """page_id, target_uri, payload_bytes, payload_digest, record_type, refers_to for each record of the archives."""
    return archive_rows.select("content").mapInArrow(_unpacked, _RECORDS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of the .warc.gz files under a path, in whatever store Spark reads."""
    return read(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path))


def write_and_read(pages: DataFrame) -> DataFrame:
    """Write the pages into the shared folder as archives, then read those."""
    return read(kept(archives(pages)))
