"""WARC records in seekable Zstandard bundles: independent frames, a footer seek table, offsets inside frames."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values of the seekable Zstandard format and of WARC 1.1
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

INDEX = "page_id long, record_id string, archive string, frame int, frame_offset long, record_bytes long"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page}:{copy}')}>"


def _header(text: str) -> str:
    """A header value has one line: control characters leave as percent signs and hex."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def write_record(page, copy, url, payload: bytes, size: int, payload_digest: str, refers_to) -> bytes:
    """One response, or, if ``refers_to`` holds the page of a response, one revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page, copy)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to[0])}"]
        if refers_to[0] is not None:
            lines.append(f"X-Refers-To-Page: {refers_to[0]}")
    if page is not None:
        lines.append(f"X-Page: {page}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that starts at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    headers = dict(line.split(": ", 1) for line in lines)
    start, size = end + 4, int(headers["Content-Length"])
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} has no end")
    return headers, data[start : start + size], start + size + 4


class Bundle:
    """Appends records to frames of about ``frame_bytes`` and ends with the seek table."""

    def __init__(self, out, frame_bytes: int):
        self.out, self.frame_bytes = out, frame_bytes
        self.entries: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset inside the uncompressed frame) of the record."""
        if self.size and self.size + len(record) > self.frame_bytes:
            self.flush()
        place = len(self.entries), self.size
        self.held.append(record)
        self.size += len(record)
        return place

    def flush(self) -> None:
        if self.held:
            frame = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(b"".join(self.held))
            self.out.write(frame)
            self.entries.append((len(frame), self.size))
            self.written += len(frame)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *e) for e in self.entries)
        foot = struct.pack("<IBI", len(self.entries), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(foot)) + table + foot)
        self.out.close()


def seek_table(f) -> list[tuple[int, int, int]]:
    """(place in the file, compressed size, uncompressed size) of each frame, from the footer alone."""
    size = f.size()
    f.seek(size - 9)
    n, kind, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if kind & 0x80 else 8
    f.seek(size - 9 - n * width)
    rows = f.read(n * width)
    out, at = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", rows, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(f, place: tuple[int, int, int]) -> bytes:
    f.seek(place[0])
    return zstandard.ZstdDecompressor().decompress(f.read(place[1]), max_output_size=max(1, place[2]))


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def read_one(archive: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """The record at an index entry: reads the footer and one frame, nothing else."""
    files, path = open_folder(archive)
    with files.open_input_file(path) as f:
        headers, block, _ = read_record(read_frame(f, seek_table(f)[frame]), offset)
    return headers, block


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])


def _rows_out(rows: Iterator[tuple], schema: str, most: int = 10_000):
    arrow, held = _arrow(schema), []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, nth, url, payload (null for revisits), size, sha (hex), revisit, refers_to.

    Payloads are equal by SHA-1 and size. Of each group the smallest page_id answers (null last),
    the others revisit it; a repeated page_id is one response and revisits of itself. A payload
    travels once per map task and group, because the minimum is taken before the shuffle, and the
    members of a group travel without it, to a join with one row a group on the other side.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.sha1(payload).alias("sha"),
        F.length(payload).cast("long").alias("size"),
        payload.alias("payload"),
    )
    first = [F.col("page_id").isNull().alias("last"), "page_id", F.col("url").isNull().alias("bare"), "url"]
    large, small = rows.where(F.col("size") >= least_bytes), rows.where(F.col("size") < least_bytes)
    heads = large.groupBy("sha", "size").agg(F.min(F.struct(*first, "payload")).alias("h"))
    responses = heads.select("h.page_id", F.lit(0).alias("nth"), "h.url", "h.payload", "size", "sha")
    responses = responses.unionByName(small.withColumn("nth", F.lit(0)))
    groups = large.groupBy("sha", "size").agg(F.min(F.struct(*first)).alias("head"))
    members = large.groupBy("sha", "size", "page_id", "url").agg(F.count("*").cast("int").alias("n"))
    own = F.struct(*first) == F.col("head")
    revisits = (
        members.join(groups, ["sha", "size"])
        .withColumn("times", F.col("n") - own.cast("int"))
        .where("times > 0")
        .withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select("page_id", "nth", "url", F.lit(None).cast("binary").alias("payload"), "size", "sha", F.lit(True).alias("revisit"), F.col("head")["page_id"].alias("refers_to"))
    )
    return responses.withColumns({"revisit": F.lit(False), "refers_to": F.lit(None).cast("long")}).unionByName(revisits)


def write_archives(
    pages: DataFrame, folder: str, least_bytes: int = 0, frame_bytes: int = 1 << 20, archive_bytes: int = 64 << 20
) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a record below ``folder``; return the index.

    ``folder`` is a path or URI that all executors reach. Each task writes ``*.warc.zst`` files of
    at most about ``archive_bytes``, named by task attempt, so that a repeated or speculative
    attempt never touches a file that an index row names. A frame ends before the record that
    would take it over ``frame_bytes``; a longer record has a frame of its own. The index is
    written beside the archives and read again: page_id, record_id, archive, frame, frame_offset
    (inside the uncompressed frame) and record_bytes. Null html is an empty payload, a null url
    leaves no header, an empty table gives an empty index.
    """

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        files, root = open_folder(folder)

        def records():
            bundle, name, k = None, "", 0
            try:
                for batch in batches:
                    for row in batch.to_pylist():
                        if bundle is not None and bundle.written >= archive_bytes:
                            bundle.close()
                            bundle = None
                        if bundle is None:
                            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{k}.warc.zst"
                            bundle, k = Bundle(files.open_output_stream(f"{root}/{name}", compression=None), frame_bytes), k + 1
                        sha1 = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                        refers = (row["refers_to"],) if row["revisit"] else None
                        data = write_record(row["page_id"], row["nth"], row["url"], row["payload"], row["size"], sha1, refers)
                        frame, offset = bundle.add(data)
                        yield row["page_id"], record_id(row["page_id"], row["nth"]), f"{folder}/{name}", frame, offset, len(data)
            finally:
                if bundle is not None:
                    bundle.close()

        yield from _rows_out(records(), INDEX)

    files, root = open_folder(folder)
    files.create_dir(root, recursive=True)
    spark = pages.sparkSession
    # as many tasks as archives, but not fewer than the cluster runs at once: many small shuffle
    # partitions would otherwise leave as many small archives
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // archive_bytes))
    records = plan_records(pages, least_bytes).coalesce(tasks)
    records.mapInArrow(write, INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the archives that an index names, frame by frame; payload digests are checked.

    Rows: page_id, payload_bytes, payload_digest, record_type, refers_to, url.
    """

    def read(batches):
        def pages():
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    files, path = open_folder(name)
                    with files.open_input_file(path) as f:
                        for place in seek_table(f):
                            data, at = read_frame(f, place), 0
                            while at < len(data):
                                headers, block, at = read_record(data, at)
                                yield page_of(headers, block)

        yield from _rows_out(pages(), PAGE)

    archives = index.select("archive").distinct()
    return archives.mapInArrow(read, PAGE)


def page_of(headers: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    found, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != found):
        raise ValueError(f"damaged payload of {headers['WARC-Record-ID']}")
    page, refers = headers.get("X-Page"), headers.get("X-Refers-To-Page")
    return (
        int(page) if page else None,
        size,
        found,
        kind,
        int(refers) if refers else None,
        headers.get("WARC-Target-URI"),
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names."""
    from chalkline.session import cut_lineage

    if spark.sparkContext.getCheckpointDir() is None:
        cut_lineage(spark.range(0))  # sets the folder of a local session, or says that none is set
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
