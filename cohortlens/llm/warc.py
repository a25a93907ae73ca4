"""Web archives: pages written as WARC records, an index first, and coalesced reads of chosen records.

Each task writes one archive of records compressed one by one, and for each record an index row:
archive, offset, length, URL and digest. The index is a table of its own, so records are chosen by
joins and filters on it, without touching the archives. Chosen records are then sorted by archive and
offset, neighbours are merged into one byte range, and only these ranges are read.

Equal payloads of at least ``MIN_DUPLICATE`` bytes are stored once: the record of the largest page id
holds the payload, the others are revisit records that refer to it. Archive names carry the attempt of
the task that wrote them, and the index names only archives of attempts that succeeded, so a task that
is run again never meets half a file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import open_folder, text_or_empty
from cohortlens.session import cut_lineage, scratch_path

MIN_DUPLICATE = 1000
#: Records closer than this are read together with the gap between them.
MAX_GAP = 64 * 1024
#: A merged range ends when it reaches this size; bounds a reader's memory with the longest record.
MAX_RANGE = 8 * 1024 * 1024
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, url string, payload_digest string, record_type string, archive string, offset long, length long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_id_of(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def header(fields: Iterable[tuple[str, str]], first: str) -> bytes:
    return "".join([f"{first}\r\n", *(f"{name}: {value}\r\n" for name, value in fields), "\r\n"]).encode()


def one_line(value: str | None) -> str:
    """A header value: line ends and control characters percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, ref_url: str | None) -> bytes:
    """A compressed record. ``refers_to`` names the record with the payload if this one is a revisit."""
    http = header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    block = http
    if refers_to:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to), ("WARC-Refers-To-Target-URI", one_line(ref_url))]
    else:
        block += payload
    fields.append(("Content-Length", str(len(block))))
    squeeze = zlib.compressobj(wbits=31)
    return squeeze.compress(header(fields, VERSION) + block + b"\r\n\r\n") + squeeze.flush()


def parse_headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines if line)


class Record:
    """A record read back from its compressed bytes."""

    def __init__(self, packed: bytes) -> None:
        raw = zlib.decompress(packed, wbits=31)
        fields, _, rest = raw.partition(b"\r\n\r\n")
        self.fields = parse_headers(fields)
        block = rest[: int(self.fields["Content-Length"])]
        http, _, self.payload = block.partition(b"\r\n\r\n")
        self.kind = self.fields["WARC-Type"]
        self.page_id = page_id_of(self.fields["WARC-Record-ID"])
        self.url = self.fields["WARC-Target-URI"]
        self.declared = self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        self.payload_bytes = int(parse_headers(http)["Content-Length"])
        refers_to = self.fields.get("WARC-Refers-To")
        self.refers_to = page_id_of(refers_to) if refers_to else None
        if self.kind == "response":
            if len(self.payload) != self.payload_bytes or sha1(self.payload).hexdigest() != self.declared:
                raise ValueError(f"record of page {self.page_id} does not hold the payload it declares")


def holders(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Per payload that occurs again: its digest, the page that holds it, and that page's URL.

    Counted with map-side partial sums, so a payload that a third of all pages share costs a row per task.
    """
    return cut_lineage(
        pages.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(
            F.count("*").alias("n"),
            F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "place", "url")).alias("holder"),
        )
        .where("n > 1")
        .select(
            "payload_digest",
            "payload_bytes",
            F.col("holder.page_id").alias("ref_page"),
            F.col("holder.place").alias("ref_place"),
            F.col("holder.url").alias("ref_url"),
        )
    )


def write_archives(pages: DataFrame, folder: str, min_duplicate: int = MIN_DUPLICATE) -> DataFrame:
    """Write a record per row of ``pages`` to archives in ``folder``; the index, stored as a table.

    The payload is the html in UTF-8, empty for NULL. Rows that repeat a page id stay records of their
    own; of rows with equal payload and id one holds it. A NULL page id holds a payload only if no
    known id does. The html is joined with the few payloads that occur again, by Spark's choice of
    join; a payload that very many pages share is split by the adaptive skew join.
    """
    html = text_or_empty("html")
    chosen = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.sha1(html).alias("payload_digest"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        html.cast("binary").alias("payload"),
        F.monotonically_increasing_id().alias("place"),
    )
    joined = chosen.join(holders(chosen.drop("payload"), min_duplicate), ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("ref_place").isNotNull() & (F.col("ref_place") != F.col("place"))
    typed = joined.select(
        "page_id",
        "url",
        "payload",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("ref_page")).alias("ref_page"),
        F.when(revisit, F.col("ref_url")).alias("ref_url"),
    )

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        stream, at = None, 0
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, kind, ref_page, ref_url in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None:
                    system, path = open_folder(folder)
                    stream = system.open_output_stream(f"{path}/{name}", compression=None)
                packed = record(page_id, url, payload, digest, record_id(ref_page) if kind == "revisit" else None, ref_url)
                stream.write(packed)
                rows.append((page_id, url, digest, kind, name, at, len(packed)))
                at += len(packed)
            if rows:
                types = (pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64())
                columns = [pa.array(*pair) for pair in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in INDEX.split(", ")])
        if stream is not None:
            stream.close()

    return cut_lineage(typed.mapInArrow(write, INDEX))


def ranges(records: Iterable[tuple[int, int]], max_gap: int, max_range: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Byte ranges (start, end, records) that cover sorted records (offset, length)."""
    start = end = 0
    inside: list[tuple[int, int]] = []
    for offset, length in records:
        if inside and (offset > end + max_gap or offset + length - start > max_range):
            yield start, end, inside
            inside = []
        if not inside:
            start = offset
        inside.append((offset, length))
        end = offset + length
    if inside:
        yield start, end, inside


def read_records(
    selected: DataFrame, folder: str, max_gap: int = MAX_GAP, max_range: int = MAX_RANGE, keep_payload: bool = False
) -> DataFrame:
    """The records that rows of the index name, read from the archives.

    Rows: ``page_id``, ``url``, ``payload_bytes``, ``payload_digest`` (of the full payload; a revisit
    declares both), ``record_type``, ``refers_to`` and, if asked for, ``payload`` (NULL for a revisit).
    Ranges of (archive, offset) are dealt to the tasks, so that each reads forward.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * keep_payload]
    schema += ", payload binary" * keep_payload
    names = [field.split()[0] for field in schema.split(", ")]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            runs: dict[str, list[tuple[int, int]]] = {}
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                runs.setdefault(archive, []).append((offset, length))
            for archive, places in runs.items():
                with system.open_input_file(f"{path}/{archive}") as file:
                    for start, end, inside in ranges(places, max_gap, max_range):
                        yield from parsed(file.read_at(end - start, start), start, inside)

    def parsed(data: bytes, start: int, inside: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        rows = []
        for offset, length in inside:
            r = Record(data[offset - start : offset - start + length])
            row = (r.page_id, r.url, r.payload_bytes, r.declared, r.kind, r.refers_to)
            rows.append((*row, r.payload if r.kind == "response" else None) if keep_payload else row)
        yield pa.RecordBatch.from_arrays([pa.array(*pair) for pair in zip(zip(*rows), types)], names)

    return (
        selected.select("archive", "offset", "length")
        .repartitionByRange("archive", "offset")
        .sortWithinPartitions("archive", "offset")
        .mapInArrow(read, schema)
    )


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives in ``folder`` (else a new shared one) and read all records back.

    An empty table gives an empty table; other columns of ``pages`` are ignored.
    """
    folder = folder or scratch_path(pages.sparkSession, "archives")
    return read_records(write_archives(pages, folder), folder)
