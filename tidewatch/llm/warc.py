"""WARC archives: written with revisits for equal payloads, read back by boundary-chain verification.

Writing: payload digests are grouped (combined before the shuffle) and only those that occur again are joined back, by a
broadcast of at most a million digests of 20 bytes; only where more of them repeat are payloads shuffled. Each task writes its rows to files of its own in the shared folder; only files that
a finished task reports are part of the archive, so a lost or repeated task leaves nothing in the result.

Reading: tasks scan byte ranges of the files for the record magic and emit each candidate with its successor's
offset, the candidate's end by its own header, followed to the first successor beyond the range. Between ranges the
chains are followed from the files' starts by pointer jumping over these links, in rounds that double the stride. Only
candidates on a chain from a file's start are records, so magic inside a payload is never taken for one. Each range
then reads its records from its entry on, a chunk of a payload in memory at a time.

Defined results: a null payload is empty; equal payloads below ``least`` bytes are all responses; a null page id
writes no record and gives no row; equal page ids each write one, and all of them are responses if theirs is the smallest id of
an equal payload, whatever tasks write them; an empty table writes an archive without files. A header (its URL, that is) of more
than ``HEADER`` bytes is refused on writing. A chain that ends in bytes that are no record raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, few_or_not, materialised, shared_dir, short_batches

MAGIC, END = b"WARC/1.1\r\n", b"\r\n\r\n"
#: Bytes after which a file is full; of one range of a scan; of a header at most, and of most headers; read at once.
FULL, RANGE, HEADER, SHORT, CHUNK = 256 << 20, 8 << 20, 1 << 20, 64 << 10, 1 << 20
DATE = "2026-01-01T00:00:00Z"


def storage(path: str):
    """(file system, path) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/", 1)[0] else "file://" + path)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(kind: str, page: int, url: str | None, payload: bytes, refers: int | None, date: str) -> list[bytes]:
    """The parts of one record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if kind == "revisit" else http + payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    head.append("WARC-Payload-Digest: sha1:" + base32_sha1(hashlib.sha1(payload).digest()))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head.append(f"Content-Length: {len(block)}")
    fields = "\r\n".join(head).encode("utf-8", "surrogatepass")
    if len(MAGIC) + len(fields) + len(END) > HEADER:
        raise ValueError(f"the header of page {page} has more than {HEADER} bytes")
    return [MAGIC, fields, END, block, END]


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, full: int = FULL, date: str = DATE) -> DataFrame:
    """Writes the archive below ``folder``; returns (path, bytes, records), one row for each of its files."""
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    again = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("again"), "first")
    rows = rows.join(few_or_not(again), F.col("digest") == F.col("again"), "left").select("page", "url", "payload", "first")
    short_batches(pages.sparkSession)
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = storage(folder)
        made: list[tuple[str, int, int]] = []
        out, size, n, name = None, 0, 0, ""

        def close():
            nonlocal out
            if out is not None:
                out.close()
                made.append((f"{folder}/{name}", size, n))
                out = None

        for b in batches:
            for page, url, payload, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, size, n = f"{run_id}-{uuid.uuid4().hex}.warc", 0, 0
                    out = system.open_output_stream(f"{base}/{name}", buffer_size=CHUNK)
                revisit = first is not None and page != first
                for part in record("revisit" if revisit else "response", page, url, payload.encode("utf-8", "surrogatepass"), first, date):
                    out.write(part)
                    size += len(part)
                n += 1
                if size >= full:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    system, base = storage(folder)
    system.create_dir(base)
    return materialised(rows.mapInArrow(run, "path string, bytes bigint, records bigint"), "warc-files")


def header(data: bytes, at: int) -> tuple[int, int] | None:
    """(past the header, length of the block) of what may be a record at ``at``."""
    end = data.find(END, at, at + HEADER)
    if end < 0 or not data.startswith(MAGIC, at):
        return None
    for line in data[at + len(MAGIC) : end].split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length" and value.strip().isdigit() and len(value) < 20:
            return end + len(END), int(value)
    return None


def candidates(data: bytes, base: int, end: int) -> dict[int, int]:
    """Offset -> successor's offset, of all candidates that begin before ``end``; data begins at offset ``base``."""
    out, at = {}, data.find(MAGIC)
    while 0 <= at and base + at < end:
        if found := header(data, at):
            out[base + at] = base + found[0] + found[1] + len(END)
        at = data.find(MAGIC, at + 1)
    return out


def ranges(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, file: its number, begin, finish, bytes): the byte ranges of the files."""
    parts = files.where("bytes > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / size).cast("int"))))
    begin = F.col("k").cast("bigint") * size
    return parts.select("path", "file", begin.alias("begin"), F.least(begin + size, F.col("bytes")).alias("finish"), "bytes")


def window(f, begin: int, finish: int, total: int) -> bytes:
    """The bytes from ``begin`` on, with the whole headers of what may be records before ``finish``."""
    f.seek(begin)
    data = f.read(min(finish + SHORT, total) - begin)
    at = data.rfind(MAGIC, 0, finish - begin + len(MAGIC) - 1)
    if at >= 0 and data.find(END, at) < 0 and begin + len(data) < total:
        data += f.read(HEADER)
    return data


def links(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(file, at, to): each candidate and the first successor beyond its range that its chain reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, file, begin, finish, total in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, place = storage(path)
                with system.open_input_file(place) as f:
                    near = candidates(window(f, begin, finish, total), begin, finish)
                for at in sorted(near, reverse=True):  # a successor lies behind, so its own end is known
                    near[at] = near.get(near[at], near[at])
                made = ([file] * len(near), list(near), list(near.values()))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["file", "at", "to"])

    return spread(ranges(files, size)).mapInArrow(run, "file bigint, at bigint, to bigint")


def spread(parts: DataFrame) -> DataFrame:
    """One task for each few ranges."""
    n = max(parts.count(), 1)
    return parts.repartition(min(n, max(parts.sparkSession.sparkContext.defaultParallelism * 4, n // 8)), "path", parts.columns[2])


def entries(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(file, at): the first record of each range that is reachable from its file's start, by pointer jumping.

    Joins with what has a row for each record are sorted merges of numbers: their size goes with the input.
    """
    step = materialised(links(files, size), "links")
    start = files.where("bytes > 0").select("file", F.lit(0).cast("bigint").alias("at"))
    # what can be an entry: a file's start, and where chains enter a range
    land = step.select("file", F.col("to").alias("at")).distinct().unionByName(start).distinct()
    jump = checkpointed(step.hint("merge").join(land.hint("merge"), ["file", "at"]))
    reach, n = start, start.count()
    while True:
        reach = checkpointed(reach.unionByName(reach.hint("merge").join(jump.hint("merge"), ["file", "at"]).select("file", F.col("to").alias("at"))).distinct())
        now = reach.count()
        if now == n:
            return reach
        n = now
        far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("end"))
        jump = checkpointed(jump.hint("merge").join(far.hint("merge"), ["file", "to"]).select("file", "at", F.col("end").alias("to")))


RECORD = "path string, at bigint, kind string, page bigint, url string, refers bigint, stated string, payload_bytes bigint, digest string"


def read(files: DataFrame, size: int = RANGE) -> DataFrame:
    """The records of the files: type, page, URI, what it refers to, stated digest, payload's bytes and their digest."""
    files = files.withColumn("file", F.xxhash64("path")) if "file" not in files.columns else files
    start = entries(files, size).hint("merge").join(files.select("path", "file", "bytes").hint("merge"), "file").where("at < bytes")
    start = start.select("path", "file", "at", F.least((F.floor(F.col("at") / size) + 1) * size, F.col("bytes")).alias("finish"), "bytes")

    def payload(f, head: bytes, left: int) -> tuple[int, str]:
        """Bytes and digest of what follows the HTTP header in a block of ``left`` bytes whose start is in ``head``."""
        data = head[:left]
        skip = data.find(END)
        skip = skip + len(END) if skip >= 0 else 0
        n, sha = left - skip, hashlib.sha1(data[skip:])
        left -= len(data)
        while left:
            part = f.read(min(CHUNK, left))
            if not part:
                raise ValueError("a record is cut short")
            sha.update(part)
            left -= len(part)
        return n, base32_sha1(sha.digest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
        names = [x.split()[0] for x in RECORD.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        number = lambda v: int(v.rsplit(":", 1)[1].rstrip(">")) if v and v.startswith("<urn:page:") else None
        for b in batches:
            for path, _, at, finish, total in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, place = storage(path)
                out = []
                with system.open_input_file(place) as f:
                    data, base = b"", at
                    while at < finish:
                        if not base <= at <= base + len(data) - SHORT and base + len(data) < total or not data:
                            f.seek(at)
                            data, base = f.read(min(CHUNK + SHORT, total - at)), at
                        found = header(data, at - base)
                        if not found and base + len(data) < min(at + HEADER, total):  # an unusually long header
                            f.seek(at)
                            data, base = f.read(min(CHUNK + HEADER, total - at)), at
                            found = header(data, 0)
                        if not found:
                            raise ValueError(f"no record at {at} of {path}")
                        body, length = found
                        fields = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in data[at - base + len(MAGIC) : body - len(END)].split(b"\r\n"))}
                        f.seek(base + len(data))
                        n, digest = payload(f, data[body : body + length], length)
                        out.append((path, at, fields.get("warc-type"), number(fields.get("warc-record-id")), fields.get("warc-target-uri"), number(fields.get("warc-refers-to")), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, n, digest))
                        at = base + body + length + len(END)
                        if len(out) >= 5_000:
                            yield batch(out)
                            out = []
                yield batch(out)

    return spread(start).mapInArrow(run, RECORD)


def pages_of(records: DataFrame) -> DataFrame:
    """One row for each record: the payload of a revisit is that of the response it refers to; digests are compared."""
    records = materialised(records, "records")
    own = records.where("kind = 'response'").select("page", F.col("payload_bytes"), "digest", "stated", F.col("kind").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    of = records.where("kind = 'response'").groupBy(F.col("page").alias("of")).agg(F.min_by("payload_bytes", "at").alias("payload_bytes"), F.min_by("digest", "at").alias("digest")).hint("merge")  # its size goes with the pages
    more = records.where("kind = 'revisit'").select("page", "refers", "stated").join(of, F.col("refers") == F.col("of")).select("page", "payload_bytes", "digest", "stated", F.lit("revisit").alias("record_type"), F.col("refers").alias("refers_to"))
    wrong = F.raise_error(F.concat(F.lit("the payload of page "), F.col("page").cast("string"), F.lit(" has another digest than its record states")))
    return own.unionByName(more).select(F.col("page").alias("page_id"), "payload_bytes", F.when(F.col("digest") == F.col("stated"), F.col("digest")).otherwise(wrong).alias("payload_digest"), "record_type", "refers_to")


def query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    files = write(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return pages_of(read(files))
