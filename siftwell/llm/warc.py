"""WARC writing and reading by a chunked record table.

A record's payload is streamed as rows of (record identifier, chunk number): on the way out each chunk
is a WARC segment (``WARC-Segment-Number``, ``continuation`` records as the standard has them), so no task
renders a whole record; on the way back a parser takes a file as a stream of bytes, hands out one chunk
at a time and carries the running SHA-256 from chunk to chunk. Archives are written by Spark's own text
writer with the record terminator as line separator: any file system that Spark writes works, the
commit protocol covers lost executors, and gzip keeps a file in one task, in order.

Equal payloads of at least ``min_revisit_bytes`` are one response, that with the smallest page_id; the
others are ``revisit`` records. Defined results: null html is an empty payload; all rows that hold
the smallest page_id of a group are responses; a null page_id is never smallest unless all are null; a null
url is empty; an empty table writes no record. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import join_unique, new_path, stage

END = b"\r\n\r\n"
CHUNK_BYTES = 1 << 16
#: Fixed, so that archives of equal pages are equal.
DATE = "2024-01-01T00:00:00Z"


def records(pages: DataFrame, min_revisit_bytes: int = 100) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses). A payload that many pages share is dealt to many tasks."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    groups = pages.select("page_id", F.octet_length(payload).alias("size"), F.sha2(payload, 256).alias("digest"))
    groups = groups.filter(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("owner"), F.count("*").alias("n"))
    owners = stage(groups.filter("n > 1"), "revisited")
    joined = join_unique(rows, owners, "digest", "n", "page_id", how="left", hint=None)
    refers = F.when(F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id")), F.col("owner"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _urn(page_id: int | None, chunk: int = 0) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}{f':{chunk}' if chunk else ''}>"


def segments_of(page_id: int | None, url: str, payload: bytes | memoryview, digest: str, refers_to: int | None, chunk_bytes: int) -> Iterator[bytes]:
    """A record's WARC segments, each without the terminator."""
    head = [f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_urn(refers_to)}", f"X-Payload-Length: {len(payload)}",
        ]
        yield _record("revisit", _urn(page_id), head, b"")
        return
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    view = memoryview(payload)
    parts = max(1, -(-len(payload) // chunk_bytes))
    for k in range(parts):
        body = bytes(view[k * chunk_bytes : (k + 1) * chunk_bytes])
        more = [f"WARC-Segment-Number: {k + 1}"] if parts > 1 else []
        if k:
            more.append(f"WARC-Segment-Origin-ID: {_urn(page_id)}")
        if k and k + 1 == parts:
            more.append(f"WARC-Segment-Total-Length: {len(http) + len(payload)}")
        if k:
            yield _record("continuation", _urn(page_id, k), more, body)
        else:
            yield _record("response", _urn(page_id), [*head, "Content-Type: application/http; msgtype=response", *more], http + body)


def _record(kind: str, urn: str, head: list[str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn}", f"WARC-Date: {DATE}", *head, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def write_archives(made: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                page, url, digest, refers = (batch.column(c)[i].as_py() for c in (0, 1, 3, 4))
                payload = memoryview(batch.column(2)[i].as_buffer())  # cut where it lies, not copied
                for part in segments_of(page, url, payload, digest, refers, chunk_bytes):
                    rows.append(part)
                    held += len(part)
                    if held >= 1 << 22:
                        yield pa.record_batch([pa.array(rows, pa.binary())], ["value"])
                        rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(rows, pa.binary())], ["value"])

    rows = made.select("page_id", "url", F.col("payload").cast("binary"), "digest", "refers_to")
    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


class ArchiveParser:
    """Takes an archive's bytes in pieces of any size; gives (head, chunk, whether the block ends)."""

    def __init__(self) -> None:
        self.buffer, self.left, self.head = bytearray(), 0, None

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
        self.buffer += data
        while True:
            if self.head is None:
                blank = 0
                while blank < len(self.buffer) and self.buffer[blank] in b"\r\n":
                    blank += 1
                del self.buffer[:blank]
                end = self.buffer.find(END)
                if end < 0:
                    return
                lines = self.buffer[:end].decode().split("\r\n")
                del self.buffer[: end + len(END)]
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
                self.head = dict(x.split(": ", 1) for x in lines[1:])
                self.left = int(self.head["Content-Length"])
            if self.left and not self.buffer:
                return
            take = bytes(self.buffer[: self.left])
            del self.buffer[: len(take)]
            self.left -= len(take)
            head = self.head
            if not self.left:
                self.head = None
            yield head, take, not self.left


CHUNKS = "page_id long, chunk long, record_type string, refers_to long, byte_offset long, n_bytes long, content binary, running_sha256 string, is_last boolean"


def read_chunks(spark: SparkSession, path: str, keep_content: bool = True) -> DataFrame:
    """The chunk table: one row per chunk, with the digest of all up to it; a record's last chunk has the
    digest of the whole payload. A revisit has one row, with the length and digest that its head states."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        parser, state = ArchiveParser(), None
        for batch in batches:
            for value in batch.column(0):
                for head, data, over in parser.feed(value.as_py() + END):
                    kind = head["WARC-Type"]
                    if kind == "revisit":
                        refers = int(head["WARC-Refers-To"][len("<urn:page:") : -1])
                        yield _page(head["WARC-Record-ID"]), 0, kind, refers, 0, int(head["X-Payload-Length"]), None, head["WARC-Payload-Digest"].split(":")[1], True
                        continue
                    if kind == "response" and state is None:
                        state = {"page": _page(head["WARC-Record-ID"]), "chunk": 0, "at": 0, "sha": hashlib.sha256(), "http": b"", "body": False}
                    if not state["body"]:  # the HTTP head is not payload
                        state["http"] += data
                        if (end := state["http"].find(END)) < 0:
                            continue
                        data, state["body"] = state["http"][end + len(END) :], True
                        state["size"] = int(re.search(rb"Content-Length: (\d+)", state["http"][:end])[1])
                    if not data and state["size"] > state["at"]:
                        continue
                    state["sha"].update(data)
                    last = state["at"] + len(data) == state["size"]
                    yield state["page"], state["chunk"], "response", None, state["at"], len(data), data if keep_content else None, state["sha"].copy().hexdigest(), last
                    state["at"] += len(data)
                    state["chunk"] += 1
                    if last:
                        state = None

    schema = pa.schema([
        ("page_id", pa.int64()), ("chunk", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("byte_offset", pa.int64()),
        ("n_bytes", pa.int64()), ("content", pa.binary()), ("running_sha256", pa.string()), ("is_last", pa.bool_()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in rows_of(batches):
            rows.append(row)
            if len(rows) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    lines = spark.read.schema("value string").option("lineSep", END.decode()).text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, CHUNKS)


def _page(urn: str) -> int | None:
    found = urn[len("<urn:page:") : -1]
    return int(found) if found else None


def archive(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 100, chunk_bytes: int = CHUNK_BYTES) -> str:
    """Writes ``pages`` as archives into the folder ``path`` (in the shared folder if not given)."""
    path = path or new_path(pages.sparkSession, "warc")
    write_archives(records(pages, min_revisit_bytes), path, chunk_bytes)
    return path
